"""Column functions that make keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.dates import date_prefix
from marlstone.functions.text import slug

#: Fixed value: the URL name space of name-based UUIDs.
URL_SPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column) -> Column:
    """The name-based (SHA-1) UUID of a name in the URL name space."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_SPACE)), name.cast("binary")))
    variant = F.element_at(F.array(*(F.lit(c) for c in "89ab")), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def chunk_id(publisher: Column, stem: Column, ordinal: Column) -> Column:
    return F.concat(slug(publisher, 40), F.lit("/"), stem, F.lit("__"), F.lpad(ordinal.cast("string"), 4, "0"))


def document_of_chunk(chunk: Column) -> Column:
    return F.regexp_replace(chunk, r"__\d+$", "")


def target_stem(publisher: Column, date: Column, title: Column) -> Column:
    named = lambda c, n, d: F.coalesce(F.nullif(slug(c, n), F.lit("")), F.lit(d))
    return F.concat(named(publisher, 40, "unknown"), F.lit("/"), date_prefix(date), F.lit("_"), named(title, 80, "untitled"))


def unique_stem(stem: Column, url: Column, times: Column) -> Column:
    """The stem, with eight digits of the address's digest where it is not alone."""
    return F.when(times > 1, F.concat(stem, F.lit("_"), F.substring(F.md5(url), 1, 8))).otherwise(stem)


def call_key(name: Column, args: Column) -> Column:
    """Name and arguments (a map) in the order of their keys."""
    return F.concat(name, F.lit("::"), F.to_json(F.map_from_entries(F.array_sort(F.map_entries(args)))))


def vector_key(model: Column, prefix: Column, query: Column) -> Column:
    return F.sha2(F.concat_ws("|", model, prefix, query), 256)
