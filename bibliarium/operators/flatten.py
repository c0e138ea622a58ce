"""Raw records of four sources to one schema (NORMALISED). A raw record is a string of JSON, read as a variant."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import doi_from_url, trim, year, year_prefix

SOURCES = ["zenodo", "kaggle", "openalex", "datacite"]


def tag(df: DataFrame, source: str) -> DataFrame:
    return df.withColumn("_source", F.lit(source))


def _get(raw: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(raw, path, kind)


def _filled(c: Column) -> Column:
    """Without what is empty: an empty string says as little as null."""
    return F.nullif(c, F.lit(""))


def _members(raw: Column, path: str, key: Column, keep_empty: bool = False) -> Column:
    """One member of each object in an array."""
    items = F.coalesce(F.transform(_get(raw, path, "array<variant>"), key), F.array().cast("array<string>"))
    return items if keep_empty else F.filter(items, lambda x: x.isNotNull() & (x != ""))


def _number(raw: Column, path: str) -> Column:
    return F.nullif(year(_get(raw, path)), F.lit(0))


def zenodo(raw: Column) -> dict[str, Column]:
    words = _get(raw, "$.metadata.keywords", "array<string>")
    text = _get(raw, "$.metadata.keywords")
    return {
        "title": _get(raw, "$.metadata.title"),
        "authors": _members(raw, "$.metadata.creators", lambda c: _get(c, "$.name")),
        "publication_year": year_prefix(_get(raw, "$.metadata.publication_date")),
        "doi": F.coalesce(_filled(_get(raw, "$.doi")), _get(raw, "$.metadata.doi")),
        "keywords": F.coalesce(words, F.when(text.isNotNull(), F.transform(F.split(text, ","), trim)), F.array().cast("array<string>")),
        "repository": F.lit("Zenodo"),
        "access_url": _get(raw, "$.links.html"),
    }


def kaggle(raw: Column) -> dict[str, Column]:
    author = F.coalesce(_filled(_get(raw, "$.creatorNameNullable")), _filled(_get(raw, "$.creatorName")))
    return {
        "title": F.coalesce(_filled(_get(raw, "$.titleNullable")), _get(raw, "$.title")),
        "authors": F.when(author.isNotNull(), F.array(author)).otherwise(F.array().cast("array<string>")),
        "publication_year": year_prefix(_get(raw, "$.lastUpdated")),
        "doi": F.lit(None).cast("string"),
        "keywords": _members(raw, "$.tags", lambda t: F.coalesce(_get(t, "$.name"), F.lit("")), keep_empty=True),
        "repository": F.lit("Kaggle"),
        "access_url": F.concat(F.lit("https://www.kaggle.com/datasets/"), _filled(_get(raw, "$.ref"))),
    }


def openalex(raw: Column) -> dict[str, Column]:
    def word(k: Column) -> Column:
        named = F.coalesce(_get(k, "$.display_name"), _get(k, "$.keyword"))
        return F.when(F.schema_of_variant(k).startswith("OBJECT"), F.coalesce(named, F.lit(""))).otherwise(_get(k, "$"))

    return {
        "title": _get(raw, "$.title"),
        "authors": _members(raw, "$.authorships", lambda a: _get(a, "$.author.display_name")),
        "publication_year": _number(raw, "$.publication_year"),
        "doi": doi_from_url(_get(raw, "$.doi")),
        "keywords": _members(raw, "$.keywords", word, keep_empty=True),
        "repository": F.lit("OpenAlex"),
        "access_url": _get(raw, "$.primary_location.landing_page_url"),
    }


def datacite(raw: Column) -> dict[str, Column]:
    return {
        "title": _get(raw, "$.attributes.titles[0].title"),
        "authors": _members(raw, "$.attributes.creators", lambda c: _get(c, "$.name")),
        "publication_year": _number(raw, "$.attributes.publicationYear"),
        "doi": _get(raw, "$.attributes.doi"),
        "keywords": _members(raw, "$.attributes.subjects", lambda s: _get(s, "$.subject")),
        "repository": F.lit("DataCite"),
        "access_url": _get(raw, "$.attributes.url"),
    }


FLATTENERS = {"zenodo": zenodo, "kaggle": kaggle, "openalex": openalex, "datacite": datacite}


def flatten(raws: DataFrame, raw_col: str = "raw", source_col: str = "_source", carry: tuple[str, ...] = ()) -> DataFrame:
    """NORMALISED rows of all known sources in one pass (each field a CASE over the source); rows of others are left out.

    _md5 and the columns in carry are taken along where raws has them.
    """
    parsed = raws.where(F.col(source_col).isin(SOURCES)).withColumn("_v", F.try_parse_json(F.col(raw_col).cast("string")))
    by = {s: f(F.col("_v")) for s, f in FLATTENERS.items()}
    fields = []
    for name in by["zenodo"]:
        pick = reduce(lambda c, s: c.when(F.col(source_col) == s, by[s][name]), SOURCES[1:], F.when(F.col(source_col) == SOURCES[0], by[SOURCES[0]][name]))
        fields.append(pick.alias(name))
    md5 = F.col("_md5") if "_md5" in raws.columns else F.lit(None).cast("string")
    return parsed.select(*carry, *fields, F.col(source_col).alias("source"), md5.alias("_md5"))


def unknown_count(raws: DataFrame, source_col: str = "_source") -> DataFrame:
    """How many rows flatten() leaves out."""
    return raws.select(F.count_if(~F.coalesce(F.col(source_col).isin(SOURCES), F.lit(False))).alias("skipped"))
