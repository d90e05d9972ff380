"""Agent turns: personas, citations, grounding, ambiguity, follow-ups, traces."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# What the interface calls personas; markers; numbers that need one nearby.
PERSONAS = {"Homebuyer": "first_home_buyer", "Investor": "investor", "Researcher": "policy_researcher", "Just exploring": "general"}
VOCABULARY = ("first_home_buyer", "investor", "policy_researcher", "journalist", "general")
MARK = re.compile(r"\[(?:source|tool):[^\]]+\]")
NUMBER = re.compile(r"(?<!\w)(?:\$\s?\d[\d,]*(?:\.\d+)?|\d[\d,]*(?:\.\d+)?\s?%|\d[\d,]*(?:\.\d+)?)(?!\w)")
DOC = re.compile(r"\[source:\s*([^,\]]+?)\s*(?:,\s*page:\s*([^\]]+?)\s*)?\]")
TOOL = re.compile(r"\[tool:\s*([^,\]]+?)\s*,\s*retrieved:\s*([^\]]+?)\s*\]")
NEAR, AROUND = 50, 40
PLACES = {"richmond": ["VIC", "NSW", "TAS"], "brighton": ["VIC", "SA", "QLD"], "st kilda": ["VIC", "SA"], "newcastle": ["NSW", "UK"], "perth": ["WA", "TAS", "Scotland"], "sydney": ["NSW", "Nova Scotia"]}
QUALIFIERS = re.compile(r"\b(nsw|vic|qld|wa|sa|tas|act|nt|australia|australian|victoria|queensland|tasmania|tassie|uk|scotland|england|tyne|canada|nova|scotia)\b", re.I)


def persona(shown: Column) -> Column:
    out = F.lit("general")
    for k, v in PERSONAS.items():
        out = F.when(shown == k, v).otherwise(out)
    return out


def chosen_persona(user: Column, classified: Column) -> Column:
    """The user's, else the classifier's, else general; only known ones count."""
    known = lambda c: F.when(c.isin(*VOCABULARY), c)
    return F.coalesce(known(user), known(classified), F.lit("general"))


def match_citations(cited: DataFrame, evidence: DataFrame, keys: list[str]) -> DataFrame:
    """cited (keys, name, page), evidence (name, page, pos): the same page's, else the name's first, else null."""
    e = evidence.select("name", F.col("page").alias("have"), "pos")
    both = cited.join(e, "name", "left")
    best = F.min_by("pos", F.struct(F.when(F.col("page") == F.col("have"), 0).otherwise(1).alias("other"), F.col("pos").alias("p")))
    return both.groupBy(*keys, "name", "page").agg(best.alias("pos"))


def _rows(df: DataFrame, keys: list[str], col: str, make: Callable[[str], list[tuple]], names: list[str], kinds: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(*k, *r) for *k, t in zip(*(f[c] for c in (*keys, col)), strict=True) for r in make(t or "")]
            yield pd.DataFrame(rows, columns=[*keys, *names])

    own = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, col).mapInPandas(run, f"{own}, {kinds}")


def grounded(text: str) -> tuple[float, int, int]:
    """(share, numbers, numbers with a whole marker within NEAR characters); digits inside markers are no numbers."""
    blank = MARK.sub(lambda m: " " * len(m[0]), text)
    found = [m.span() for m in NUMBER.finditer(blank)]
    near = sum(bool(MARK.search(text[max(0, a - NEAR) : b + NEAR])) for a, b in found)
    return (near / len(found) if found else 1.0), len(found), near


def groundedness(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    return _rows(df, keys, col, lambda t: [grounded(t)], ["groundedness", "n_numeric", "n_grounded"], "groundedness double, n_numeric int, n_grounded int")


def enforce(text: str, pages: dict[str, set[str]], tools: set[str]) -> tuple[str, int]:
    """The text with unknown citations marked, a footer where it has none, and the number of marks."""
    marks = 0

    def mark(m: re.Match, note: str | None) -> str:
        nonlocal marks
        marks += note is not None
        return m[0] + (f" ({note})" if note else "")

    def doc(m: re.Match) -> str:
        known, page = pages.get(m[1].strip()), (m[2] or "").strip()
        return mark(m, "unverified" if known is None else "page-unverified" if page and page not in known else None)

    out = DOC.sub(doc, text)
    out = TOOL.sub(lambda m: mark(m, None if m[1].strip() in tools else "unverified"), out)
    last = out.split("\n")[-3:]
    if "\nSources" not in out and "Sources:" not in last[0]:
        lines = [f"- {name}: {', '.join(sorted(have))}" for name, have in (("Documents", pages), ("Tools", tools)) if have]
        if lines:
            out = "\n".join([out.rstrip(), "", "Sources (auto):", *lines])
    return out, marks


def enforce_citations(df: DataFrame, keys: list[str], col: str, pages: dict[str, set[str]], tools: set[str]) -> DataFrame:
    return _rows(df, keys, col, lambda t: [enforce(t, pages, tools)], ["answer", "n_orphans"], "answer string, n_orphans int")


def renumbered(text: str) -> tuple[str, int]:
    """Markers as [1], [2], ... by first appearance of what they cite."""
    seen: dict[tuple, int] = {}

    def number(m: re.Match) -> str:
        d = DOC.fullmatch(m[0])
        t = None if d else TOOL.fullmatch(m[0])
        if not d and not t:
            return m[0]
        key = ("doc", d[1].strip(), (d[2] or "").strip()) if d else ("tool", t[1].strip(), t[2].strip())
        return f"[{seen.setdefault(key, len(seen) + 1)}]"

    return MARK.sub(number, text), len(seen)


def renumber(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    return _rows(df, keys, col, lambda t: [renumbered(t)], ["answer", "n_citations"], "answer string, n_citations int")


def places(text: str) -> list[tuple[int, str, str]]:
    """(position, place, options) of place names without a qualifier within AROUND characters, the first of each place."""
    out = []
    for place, options in PLACES.items():
        for m in re.finditer(rf"\b{place}\b", text, re.I):
            around = text[max(0, m.start() - AROUND) : m.start()] + " " + text[m.end() : m.end() + AROUND]
            if not QUALIFIERS.search(around):
                out.append((m.start(), m[0], "|".join(options)))
                break
    return sorted(out)


def ambiguous_places(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    return _rows(df, keys, col, places, ["pos", "place", "options"], "pos int, place string, options string")


def clarified(query: Column, qualifier: Column) -> Column:
    return F.when(F.coalesce(F.trim(qualifier), F.lit("")) == "", query).otherwise(F.concat(query, F.lit(" ("), qualifier, F.lit(")")))


# What is suggested after a tool's answer, to a persona, for a word of the question, and to everyone.
TOOL_QUESTIONS = {
    "rba_cash_rate": "How has the cash rate moved over the past 12 months?",
    "compute_stamp_duty_nsw": "How does NSW stamp duty compare with VIC and QLD on the same purchase price?",
    "compute_mortgage_repayment": "What would the repayment look like if rates rose by 1 percentage point?",
    "compute_rental_yield": "What's a typical rental vacancy rate in that market?",
    "abs_property_index": "How does that capital city compare with the national average?",
    "abs_lending_indicators": "How are first-home-buyer lending volumes tracking versus investors?",
    "sqm_vacancy": "How has rental vacancy moved over the past year in that city?",
}
PERSONA_QUESTIONS = {
    "first_home_buyer": ["What grants or stamp-duty concessions might I be eligible for?", "What are the typical upfront costs beyond the deposit?"],
    "investor": ["What's the gross rental yield on a property in that price range?", "How have rental vacancy rates trended recently?"],
    "policy_researcher": ["What does the recent evidence say about long-run trends in this area?", "How do these numbers compare across the major capital cities?"],
    "journalist": ["What's the most recent data point and how does it compare to a year ago?"],
}
WORD_QUESTIONS = {
    "cash rate|interest rate": "What did the latest RBA statement give as the reason for that decision?",
    "vacancy": "Which capital city has the tightest rental market right now?",
}
GENERIC_QUESTIONS = ["How does this compare across the major capital cities?", "What's the most recent data point on this?", "What's driving the recent trend?"]


def followups(query: Column, persona: Column, tools: Column, most: int = 3) -> Column:
    """Distinct questions: of the tools that answered (array of structs tool, failed), in call order; the persona's; the question's words'; general ones."""
    lit = lambda qs: F.array(*(F.lit(q) for q in qs))
    by_tool = F.create_map(*(F.lit(x) for kv in TOOL_QUESTIONS.items() for x in kv))
    answered = F.filter(F.coalesce(tools, F.array().cast("array<struct<tool: string, failed: boolean>>")), lambda t: ~F.coalesce(t["failed"], F.lit(False)))
    of_tools = F.filter(F.transform(answered, lambda t: F.try_element_at(by_tool, F.coalesce(F.trim(t["tool"]), F.lit("")))), lambda q: q.isNotNull())
    p, none = F.lower(F.trim(F.coalesce(persona, F.lit("")))), F.array().cast("array<string>")
    of_persona = none
    for name, qs in PERSONA_QUESTIONS.items():
        of_persona = F.when(p == name, lit(qs)).otherwise(of_persona)
    of_words = [F.when(F.lower(F.coalesce(query, F.lit(""))).rlike(words), lit([q])).otherwise(none) for words, q in WORD_QUESTIONS.items()]
    return F.slice(F.array_distinct(F.concat(of_tools, of_persona, *of_words, lit(GENERIC_QUESTIONS))), 1, most)


def memoised(turns: DataFrame, key: str, cache: DataFrame | None, make: Column) -> DataFrame:
    """(key, value) of each turn: the cached value if its key has one, else the one that ``make`` gives."""
    if cache is None:
        return turns.select(key, make.alias("value"))
    return turns.join(cache.select(key, F.col("value").alias("_had")), key, "left").select(key, F.coalesce("_had", make).alias("value"))


def today_line(day: Column, zone: str = "UTC") -> Column:
    """The line that tells a model the date."""
    return F.concat(F.lit("[Context] Today's date is "), F.date_format(day, "yyyy-MM-dd"), F.lit(f" ({zone}). Treat this as the current date when judging recency or whether cited material may be out of date.\n\n"))


def styled_markers(answer: Column, kinds: Column) -> Column:
    """An answer whose markers [n] are wrapped by the kind of the n-th citation; those without one count as documents."""
    parts = F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]|(?s)((?!\[\d+\]).)+"), F.lit(0))
    n = lambda x: F.regexp_extract(x, r"^\[(\d+)\]$", 1)
    kind = lambda x: F.when((F.length(n(x)) < 9) & (n(x).try_cast("int") >= 1), F.get(kinds, n(x).try_cast("int") - 1))
    cls = lambda x: F.when(kind(x) == "tool", "cite-tool").otherwise("cite-doc")
    return F.array_join(F.transform(parts, lambda x: F.when(n(x) == "", x).otherwise(F.concat(F.lit('<span class="cite '), cls(x), F.lit('">'), x, F.lit("</span>")))), "")


def pages_of_publishers(chunks: DataFrame, *by: str) -> DataFrame:
    """(by, publisher, pages sorted array): chunks (publisher, page); blank publishers are none, a null page is ''."""
    p = F.trim("publisher")
    rows = chunks.select(*by, p.alias("publisher"), F.coalesce(F.trim(F.col("page").cast("string")), F.lit("")).alias("page")).filter("publisher <> ''")
    return rows.groupBy(*by, "publisher").agg(F.array_sort(F.collect_set("page")).alias("pages"))


def trace(turns: DataFrame, key: str, subquestions: Column, tools: Column, answers: Column) -> DataFrame:
    """Five steps a turn, in order, with a status from its counts."""
    ok = lambda c, other: F.when(c, "ok").otherwise(other)
    status = [F.lit("ok"), ok(subquestions > 2, "skip"), ok(tools > 0, "skip"), F.when(answers > 1, "warn").otherwise("ok"), ok(answers > 0, "error")]
    steps = ("classify", "decompose", "tools", "reflect", "synthesize")
    rows = F.array(*(F.struct(F.lit(n).alias("step"), F.lit(i + 1).alias("pos"), s.alias("status")) for i, (n, s) in enumerate(zip(steps, status, strict=True))))
    return turns.select(key, F.inline(rows))


def failures(answer: Column, latency: Column, budget: float, wanted: list[str]) -> Column:
    """What a smoke run's answer lacks."""
    a = F.coalesce(answer, F.lit(""))
    checks = [F.when(F.trim(a) == "", "empty"), F.when(latency > budget, "slow"), *(F.when(~F.contains(F.lower(a), F.lit(w.lower())), f"lacks {w}") for w in wanted)]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def subquestions(parts: Column) -> Column:
    """Two to four questions that are not blank, else none: the question is atomic."""
    kept = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(kept).between(2, 4), kept).otherwise(F.array().cast("array<string>"))


def with_notice(notice: Column, answer: Column) -> Column:
    return F.when(F.trim(F.coalesce(notice, F.lit(""))) == "", answer).otherwise(F.concat(notice, F.lit("\n\n"), answer))


def known_arguments(args: Column, allowed: list[str], required: list[str]) -> tuple[Column, Column]:
    """(the allowed arguments, what is missing or null)."""
    lit = lambda names: F.array(*(F.lit(n) for n in names))
    missing = F.array_except(lit(required), F.map_keys(args))
    return F.map_filter(args, lambda k, _: F.array_contains(lit(allowed), k)), F.when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", ")))


def generated_pairs(answer: Column, personas: tuple[str, ...] = ("homebuyer", "investor", "researcher")) -> Column:
    """The (query, persona) structs of an answer's JSON whose query is not blank and whose persona is known."""
    from marlstone.functions.text import greedy_json

    got = F.from_json(greedy_json(answer), "queries array<struct<query: string, persona: string>>")["queries"]
    return F.filter(F.coalesce(got, F.array().cast("array<struct<query: string, persona: string>>")), lambda p: (F.trim(p["query"]) != "") & p["persona"].isin(*personas))


def has_exactly(raw: Column, names: list[str]) -> Column:
    """JSON with these keys and no others; false for what is no object."""
    keys = F.json_object_keys(raw)
    return F.coalesce(F.array_sort(keys) == F.array(*(F.lit(n) for n in sorted(names))), F.lit(False))
