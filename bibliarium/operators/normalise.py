"""Record-level normalisation: conflicts first, then every field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

GENERIC = ["repository", "access_url", "license", "file_format", "subject_area", "source_id", "source", "_source"]


def _names(df: DataFrame, column: str) -> Column:
    """Names of a column that holds strings, or objects with a name under one of three keys, or one string."""
    kind = df.schema[column].dataType.simpleString()
    c = F.col(column)
    if kind.startswith("array<struct"):
        keys = [f for f in ("name", "full_name", "display_name") if f in df.schema[column].dataType.elementType.names]
        c = F.transform(c, lambda a: F.coalesce(*(F.nullif(a[k], F.lit("")) for k in keys), F.lit("")))
    return text.author_list(c) if kind.startswith("array") else text.author_split(c)


def resolve_conflicts(df: DataFrame) -> DataFrame:
    """Where creators and authors are both given and differ, creators stay and a note tells of it. Always adds conflict_notes."""
    if not {"creators", "authors"} <= set(df.columns):
        return df.withColumn("conflict_notes", F.array().cast("array<string>"))
    c, a = F.col("creators"), F.col("authors")
    filled = lambda x, name: F.coalesce(F.size(x) > 0, F.lit(False)) if df.schema[name].dataType.simpleString().startswith("array") else F.coalesce(x != "", F.lit(False))
    differ = filled(c, "creators") & filled(a, "authors") & ~F.to_json(F.struct(c.alias("x"))).eqNullSafe(F.to_json(F.struct(a.alias("x"))))
    note = F.concat(F.lit("two lists of names; creators stay: "), F.to_json(F.struct(c.alias("creators"))), F.lit("; left out: "), F.to_json(F.struct(a.alias("authors"))))
    return df.withColumns({"conflict_notes": F.when(differ, F.array(note)).otherwise(F.array().cast("array<string>")), "authors": F.when(~differ, a)})


def normalise(df: DataFrame) -> DataFrame:
    """Text cleaned, names turned, identifier, keywords and year brought to one form; flags and other columns stay as they are."""
    df = resolve_conflicts(df)
    out: dict[str, Column] = {c: text.clean_text(F.col(c)) for c in ("title", "abstract") if c in df.columns}
    out |= {c: _names(df, c) for c in ("creators", "authors") if c in df.columns}
    if "doi" in df.columns:
        out["doi"] = text.doi_display(F.col("doi"))
    if "keywords" in df.columns:
        array = df.schema["keywords"].dataType.simpleString().startswith("array")
        out["keywords"] = text.keyword_list(F.col("keywords")) if array else text.keyword_split(F.col("keywords"))
    if "publication_year" in df.columns:
        out["publication_year"] = text.year(F.col("publication_year").cast("string"))
    out |= {c: text.or_null(F.col(c)) for c in GENERIC if c in df.columns}
    return df.withColumns(out)
