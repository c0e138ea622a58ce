"""Hard validation with the first reason that fails, soft flags, and routing of rows."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, is_doi, is_year, trim, year

# fixed values: reason codes, in the order in which the rules are tried
MISSING_TITLE, MISSING_IDENTIFIER, INVALID_DOI, MISSING_YEAR, INVALID_YEAR = "MISSING_TITLE", "MISSING_IDENTIFIER", "INVALID_DOI", "MISSING_YEAR", "INVALID_YEAR"


def reason_code(current_year: int) -> Column:
    """Null for an acceptable row."""
    title, doi, source_id, when = (F.col(c) for c in ("title", "doi", "source_id", "publication_year"))
    text_year = when.cast("string")
    return (
        F.when(is_blank(title), MISSING_TITLE)
        .when(is_blank(doi) & is_blank(source_id), MISSING_IDENTIFIER)
        .when(~is_blank(doi) & ~is_doi(doi), INVALID_DOI)
        .when(is_blank(text_year), MISSING_YEAR)
        .when(~is_year(text_year, current_year), INVALID_YEAR)
    )


def soft_flags(df: DataFrame, current_year: int) -> DataFrame:
    """missing_title_flag: under three characters; year_uncertain: the current year, or none that can be read."""
    short = F.length(F.coalesce(trim(F.col("title")), F.lit(""))) < 3
    doubtful = F.coalesce(year(F.col("publication_year").cast("string")) == current_year, F.lit(True))
    return df.withColumns({"missing_title_flag": short, "year_uncertain": doubtful})


def validate(df: DataFrame, current_year: int | None = None) -> DataFrame:
    """df with reason_code and the flags."""
    current_year = current_year or datetime.datetime.now(datetime.UTC).year
    return soft_flags(df.withColumn("reason_code", reason_code(current_year)), current_year)


def route(validated: DataFrame, run_time: datetime.datetime) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejected ones as REJECTED rows with the whole record as JSON."""
    content = [c for c in validated.columns if c not in ("reason_code", "missing_title_flag", "year_uncertain")]
    accepted = validated.where("reason_code IS NULL").drop("reason_code")
    rejected = validated.where("reason_code IS NOT NULL").select("reason_code", *(F.col(c).cast("string") for c in ("title", "doi", "source_id")), F.to_json(F.struct(*content)).alias("raw_record"), F.lit(run_time).cast("timestamp").alias("rejected_at"))
    return accepted, rejected


def reject_counts(validated: DataFrame) -> DataFrame:
    return validated.where("reason_code IS NOT NULL").groupBy("reason_code").agg(F.count("*").alias("n"))


def flagged_count(accepted: DataFrame) -> DataFrame:
    return accepted.select(F.count_if(F.col("missing_title_flag") | F.col("year_uncertain")).alias("flagged"))
