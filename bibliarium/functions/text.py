"""Scalar functions over columns: trimming, cleaning, identifiers, names, keywords, years. Null gives null unless said otherwise."""

from __future__ import annotations

import html

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
_SPACES = r"(?U)[\s\x1c-\x1f]+"


def trim(c: Column) -> Column:
    """Without the whitespace, any of Unicode's, at both ends; trim() of SQL takes blanks only."""
    return F.regexp_replace(c, _EDGES, "")


def or_null(c: Column) -> Column:
    return F.nullif(trim(c), F.lit(""))


def is_blank(c: Column) -> Column:
    return c.isNull() | (trim(c) == "")


def is_populated(c: Column, kind: str = "string") -> Column:
    """Neither null nor empty; blanks and zeros count as populated."""
    if kind.startswith(("array", "map")):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    return F.coalesce(c != "", F.lit(False)) if kind == "string" else c.isNotNull()


def unescape(c: Column) -> Column:
    """HTML entities decoded. The whole HTML5 table is Python's, so an Arrow function does it; texts without an ampersand go by it as nulls."""
    @F.arrow_udf("string")
    def decode(x: pa.Array) -> pa.Array:
        return pa.array([None if s is None else html.unescape(s) for s in x.to_pylist()], pa.string())

    return F.coalesce(decode(F.when(F.contains(c, F.lit("&")), c)), c)


def unescape_common(c: Column) -> Column:
    """Four frequent entities, decoded without leaving the JVM; the ampersand's own comes last."""
    for entity, plain in (("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(plain))
    return c


def strip_markup(c: Column) -> Column:
    """Tags to blanks, LaTeX commands to their arguments, other escapes away, whitespace collapsed; blank gives null."""
    c = F.regexp_replace(c, "<[^>]+>", " ")
    c = F.regexp_replace(c, r"\\[a-zA-Z]+\{([^}]*)\}", "$1")
    c = F.regexp_replace(c, r"(?U)\\[^a-zA-Z\s\x1c-\x1f]", "")
    return or_null(F.regexp_replace(c, _SPACES, " "))


def clean_text(c: Column) -> Column:
    return strip_markup(unescape(c))


def doi_display(c: Column) -> Column:
    """Trimmed, without a resolver's address, case kept; blank gives null."""
    return F.nullif(F.regexp_replace(trim(c), r"(?i)^https?://(dx\.)?doi\.org/", ""), F.lit(""))


def doi_key(c: Column) -> Column:
    """The form in which identifiers are compared: trimmed, lower case, without any prefix; null gives an empty string."""
    return F.coalesce(F.regexp_replace(F.lower(trim(c)), r"^(https?://(dx\.)?doi\.org/|doi:)", ""), F.lit(""))


def doi_from_url(c: Column) -> Column:
    """What follows the last resolver's address, or all."""
    return F.substring_index(c, "doi.org/", -1)


def is_doi(c: Column) -> Column:
    return F.coalesce(doi_display(c).rlike(r"(?U)^10\.[0-9]{4,9}/[^\s\x1c-\x1f]+$"), F.lit(False))


def year(c: Column) -> Column:
    return c.try_cast("int")


def year_prefix(c: Column) -> Column:
    return F.substring(c, 1, 4).try_cast("int")


def is_year(c: Column, current_year: int) -> Column:
    return F.coalesce(year(c).between(1900, current_year), F.lit(False))


def last_first(c: Column) -> Column:
    """A name as "Last, First"; one word, or a name with a comma, stays as it is but for blanks."""
    t = trim(c)
    halves = F.split(t, ",", 2)
    words = F.split(t, _SPACES)
    comma = F.concat(trim(halves[0]), F.lit(", "), trim(F.get(halves, F.lit(1))))
    turned = F.concat(F.element_at(words, -1), F.lit(", "), F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), " "))
    return F.when(F.contains(t, F.lit(",")), comma).when(F.size(words) <= 1, t).otherwise(turned)


def author_list(c: Column) -> Column:
    """Names of an array as last_first(); null if none is left. Order stays, and so do repeats."""
    names = F.transform(F.filter(c, lambda a: a.isNotNull() & (a != "")), last_first)
    return F.when(F.size(names) > 0, names)


def author_split(c: Column) -> Column:
    """The same of a string, split at semicolons, ampersands and "and" between blanks."""
    return author_list(F.filter(F.transform(F.split(c, ";|&| and "), trim), lambda a: a != ""))


def byline(c: Column) -> Column:
    """Names of a free byline: no affiliations in brackets, split at semicolons (and "and") or else commas, over two characters, the first of those equal but for case."""
    text = F.regexp_replace(c, r"\([^)]*\)", " ")
    text = F.regexp_replace(text, r"(?iU)[\s\x1c-\x1f]+and[\s\x1c-\x1f]+", ";")
    parts = F.when(F.contains(text, F.lit(";")), F.split(text, ";")).otherwise(F.split(text, ","))
    names = F.transform(parts, lambda p: trim(F.regexp_replace(trim(p), "^,+|,+$", "")))
    names = F.filter(names, lambda p: F.length(p) > 2)
    low = F.transform(names, F.lower)
    return F.coalesce(F.filter(names, lambda n, i: F.array_position(low, F.lower(n)) == i + 1), F.array().cast("array<string>"))


def keyword_list(c: Column) -> Column:
    """Keywords of an array: trimmed, lower case, distinct, sorted; null if none is left. Members are not split."""
    words = F.sort_array(F.array_distinct(F.filter(F.transform(c, lambda k: F.lower(trim(k))), lambda k: k.isNotNull() & (k != ""))))
    return F.when(F.size(words) > 0, words)


def keyword_split(c: Column) -> Column:
    """The same of a string, split at semicolons, commas and bars."""
    return keyword_list(F.split(c, "[;,|]+"))


def contains_ci(c: Column, text: str) -> Column:
    """Whether c holds the trimmed text, letters in either case; per cent and low line in it are wild."""
    doubled = text.strip().replace("\\", "\\\\")
    return c.ilike(f"%{doubled}%")


def label_count(c: Column) -> Column:
    """A count for people: thousands as K, millions as M."""
    return F.when(c >= 1_000_000, F.concat(F.format_string("%.1f", c / 1_000_000), F.lit("M"))).when(c >= 1000, F.concat(F.format_string("%.1f", c / 1000), F.lit("K"))).otherwise(c.cast("string"))


def shortened(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("…"))).otherwise(c)


def best_link(url: Column, doi: Column) -> Column:
    return F.coalesce(F.nullif(url, F.lit("")), F.concat(F.lit("https://doi.org/"), F.nullif(doi, F.lit(""))))


def initials(c: Column) -> Column:
    return F.upper(F.array_join(F.transform(F.slice(F.split(trim(c), _SPACES), 1, 2), lambda w: F.substring(w, 1, 1)), ""))


def colour_group(c: Column, groups: int = 6) -> Column:
    """A group that is the same in every process."""
    return F.pmod(F.crc32(c), F.lit(groups)).cast("int")
