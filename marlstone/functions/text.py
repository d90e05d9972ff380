"""Column functions over text.  Null texts count as empty unless a function says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that retrieval leaves out.
STOPWORDS = """a an and are as at be but by for from has have how if in into is it
its my of on or that the this to was what when where which who why will
with you your we us our over per up down do does did not no nor than
then there these those they them their i me he she his her one two
three between also among many much more most some any all each other
such same very can could should would may might must about across
after before during because only just like unlike within without
across towards toward upon under above below off out onto ought
am being been having
home housing house housekeeping property properties
australian australia au""".split()

# Substrings that make a text one about housing.
HOUSING = ["housing", "house", "houses", "dwelling", "dwellings", "property", "properties", "mortgage", "mortgages", "rent", "rental", "rents", "home", "homes", "real estate", "residential", "land"]

# Citation markers, and numbers that need one.
CITATION = r"\[(source|tool):\s*([^,\]]+?)\s*(?:,\s*(?:page|retrieved):\s*([^\]]+?)\s*)?\]"
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def terms(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits that are no stop words, in order."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z0-9]+"), F.lit(0))
    # a long IN list becomes a hash set
    return F.filter(F.transform(found, lambda t: F.lower(t)), lambda t: ~t.isin(*sorted(set(STOPWORDS))))


def about_housing(text: Column) -> Column:
    """Any of the words anywhere, inside others too."""
    return F.lower(text).rlike("|".join(HOUSING))


def slug(text: Column, size: int = 80) -> Column:
    """Letters, digits and single hyphens, lower-cased, of ``size`` characters at most."""
    plain = F.lower(F.trim(F.regexp_replace(text, r"(?U)[^\w\s-]", "")))
    return F.regexp_replace(F.substring(F.regexp_replace(plain, r"(?U)[\s_-]+", "-"), 1, size), "^-+|-+$", "")


def snippet(text: Column, size: int = 160) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, size)


def excerpt(text: Column, size: int = 320) -> Column:
    """The text, or its start with an ellipsis in place of white space and the rest."""
    return F.when(F.length(text) <= size, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, size), r"\s+$", ""), F.lit("…")))


def short_title(text: Column, size: int = 80) -> Column:
    return F.when(F.length(text) <= size, text).otherwise(F.concat(F.substring(text, 1, size - 1), F.lit("…")))


def heading_path(headings: Column) -> Column:
    return F.array_join(headings, " > ")


def title_of_url(url: Column) -> Column:
    """The last path segment as words with capitals."""
    last = F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"/([^/]+?)(?:\.[a-zA-Z0-9]+)?/?$", 1)
    return F.initcap(F.regexp_replace(last, "[-_]+", " "))


def citations(text: Column) -> Column:
    """Distinct citations 'kind|name|page or date' in order of first appearance."""
    marks = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CITATION), F.lit(0))
    part = lambda m, i: F.regexp_extract(m, CITATION, i)
    return F.array_distinct(F.transform(marks, lambda m: F.concat_ws("|", part(m, 1), F.trim(part(m, 2)), F.trim(part(m, 3)))))


def question_clean(text: Column) -> Column:
    """A suggested question without bullets or numbering."""
    return F.trim(F.regexp_replace(text, r"^[-*0-9. )]+", ""))


def greedy_json(text: Column) -> Column:
    """From the first '{' to the last '}', or null."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
