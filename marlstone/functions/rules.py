"""Ordered text rules: screening of questions, noise and substance of passages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is refused, in order; the first that is found decides.
REFUSED = [
    (
        "mortgage_product",
        r"\b(which (mortgage|home loan|lender|broker).{0,30}(should|do you)|(what|which) (mortgage|home loan|lender).{0,30}(best|recommend)|(best|cheapest|top) (mortgage|home loan|lender|broker)"
        r"|recommend.{0,15}(mortgage|home loan|broker|lender)|(fix(ed)? or (float|variable)|fixed-rate or variable)|should i refinance)\b",
    ),
    (
        "insurance_product",
        r"\b(which (([a-z]+ )?(insurance|insurer|policy)).{0,30}(should|do you|recommend|buy)|(best|cheapest|top) (home insurance|landlord insurance|life insurance|income protection|building insurance|contents insurance)"
        r"|recommend.{0,30}(insurance|insurer|policy)|(should|do) i (need|get|buy) (life insurance|landlord insurance|income protection|home insurance|building insurance))\b",
    ),
    (
        "super_or_managed_fund",
        r"\b(which (super|super fund|smsf|managed fund|etf).{0,30}(should|do you|recommend|best)|(best|top) (super fund|smsf|managed fund|etf)|recommend.{0,15}(super fund|smsf|managed fund|etf)|should i (start|set up) (an? )?smsf)\b",
    ),
    ("specific_security_pick", r"\b((should|do) i (buy|sell|short) (shares?|stock|reit|etf|asx)|(best|top) (reit|property etf|asx code)|recommend (an? |me )?(stock|share|reit|etf|asx code))\b"),
]
ANNOTATED = r"\b(negative(?:ly)?[- ]?gear\w*|capital gains?(?: tax)?|cgt|quarantin\w*)\b"

# Headings and titles of passages without substance.
NOISE_SECTION = r"^(references?|bibliography|acronyms|list of (figures|tables|acronyms)|appendix \d|skip to (main )?(content|navigation)|[A-Z]{2,}—see |pwc—see |ecosa—see )"
NOISE_TITLE = r"^(skip to (main )?(content|navigation)|download)$"
THIN_SECTION = r"^(references?|bibliography|acronyms|list of (figures|tables|acronyms)|appendix \d|table of contents|terms (&|and) conditions|committees and charters|[A-Z]{2,}—see )"
OFF_TOPIC = r"^(land management|land degradation|greenhouse|working from home|terms (&|and) conditions|committees and charters)$"


def screen(query: Column) -> tuple[Column, Column]:
    """(action, category): refuse by the first rule found, else annotate, else allow."""
    q = F.coalesce(query, F.lit(""))
    action, category = F.when(F.trim(q) == "", "allow"), F.when(F.trim(q) == "", F.lit(None).cast("string"))
    for name, pattern in REFUSED:
        action, category = action.when(q.rlike(f"(?i){pattern}"), "refuse"), category.when(q.rlike(f"(?i){pattern}"), name)
    action, category = action.when(q.rlike(f"(?i){ANNOTATED}"), "annotate"), category.when(q.rlike(f"(?i){ANNOTATED}"), "temporal_currency")
    return action.otherwise("allow"), category


def is_noise(title: Column, section: Column, text: Column) -> Column:
    t, s, x = (F.trim(F.coalesce(c, F.lit(""))) for c in (title, section, text))
    menu = F.startswith(F.regexp_replace(x, "^[- ]+", ""), F.lit("News - Insights - Guides - Lifestyle"))
    listed = (F.regexp_count(x, F.lit(" - ")) >= 4) & F.contains(x, F.lit("Insights")) & F.contains(x, F.lit("Lifestyle"))
    return t.rlike(f"(?i){NOISE_TITLE}") | s.rlike(f"(?i){NOISE_SECTION}") | F.startswith(x, F.lit("**==>")) | F.startswith(x, F.lit("<!-- image -->")) | menu | listed


def alphabetic_words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w.rlike(r"^\p{L}+$")))


def is_substantive(title: Column, section: Column, text: Column, least: int = 60) -> Column:
    x = F.coalesce(text, F.lit(""))
    pictures = F.regexp_count(x, F.lit("==> picture")) > 3
    empty = F.contains(x, F.lit("**----- End of picture text -----**")) & (F.length(x) < 500)
    off = F.trim(F.coalesce(section, F.lit(""))).rlike(f"(?i){THIN_SECTION}") | F.trim(F.coalesce(title, F.lit(""))).rlike(f"(?i){OFF_TOPIC}")
    return (x != "") & ~pictures & ~empty & ~off & (alphabetic_words(x) >= least)
