"""Exact duplicates: content hashes, keep-first, and the three-way split against what is stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import doi_key


def content_hash(raw: Column) -> Column:
    """MD5 of a JSON record with its keys in order at every depth."""
    return F.md5(F.to_json(F.parse_json(raw)))


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by order. Null keys are equal to each other. Tasks keep one row for each key before rows travel, so a frequent key is no one's burden."""
    whole, first = F.struct(*(F.col(f"`{c}`") for c in df.columns)), F.struct(*order)
    kept = df.groupBy(*(F.col(k).alias(f"key{i}") for i, k in enumerate(keys))).agg(F.min_by(whole, first).alias("row"))
    return kept.select(*(F.col("row").getField(c).alias(c) for c in df.columns))


def duplicate_count(df: DataFrame, key: str) -> DataFrame:
    return df.select((F.count("*") - F.count_distinct(F.coalesce(key, F.lit("")))).alias("duplicates"))


def exact_matches(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Incoming rows whose identifier an active existing row has; an empty one never matches."""
    keys = existing.where("is_active").select(doi_key(F.col("doi")).alias("_key")).where("_key <> ''").distinct()
    return incoming.withColumn("_key", doi_key(F.col("doi"))).join(keys, "_key", "left_semi").drop("_key")


def not_exact(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    keys = existing.where("is_active").select(doi_key(F.col("doi")).alias("_key")).where("_key <> ''").distinct()
    return incoming.withColumn("_key", doi_key(F.col("doi"))).join(keys, "_key", "left_anti").drop("_key")


def partition(incoming: DataFrame, existing: DataFrame, threshold: int = 90) -> DataFrame:
    """incoming with dup_type (exact, fuzzy, clean), dup_score, matched_id and matched_title.

    incoming: pos, title, doi; existing: id, title, doi, is_active. Both are compared as they are when this is called;
    incoming rows are not compared with each other.
    """
    from .fuzzy import best_matches

    live = existing.where("is_active")
    held = keep_first(live.select(doi_key(F.col("doi")).alias("_key"), "id", "title").where("_key <> ''"), ["_key"], ["id"])
    held = held.select("_key", F.col("id").alias("_id"), F.col("title").alias("_title"))
    marked = incoming.withColumn("_key", doi_key(F.col("doi"))).join(held, "_key", "left").drop("_key")
    exact = marked.where("_id IS NOT NULL").withColumns({"dup_type": F.lit("exact"), "dup_score": F.lit(1.0)})
    rest = marked.where("_id IS NULL").drop("_id", "_title")
    best = best_matches(rest.select("pos", "title"), live.select("id", "title"), threshold)
    fuzzy = rest.join(best.select("pos", F.col("existing_id").alias("_id"), F.col("existing_title").alias("_title"), "similarity"), "pos", "left")
    fuzzy = fuzzy.withColumns({"dup_type": F.when(F.col("_id").isNotNull(), "fuzzy").otherwise("clean"), "dup_score": F.col("similarity")}).drop("similarity")
    return exact.unionByName(fuzzy).withColumnsRenamed({"_id": "matched_id", "_title": "matched_title"})


def summary(parted: DataFrame) -> DataFrame:
    return parted.groupBy("dup_type").agg(F.count("*").alias("n"))


def review_queue(parted: DataFrame) -> DataFrame:
    return parted.where("dup_type = 'fuzzy'")


def merge_log(parted: DataFrame, run_time, carry: tuple[str, ...] = ()) -> DataFrame:
    """One MERGE_LOG row (with the columns in carry) for each decision; 0 where no record is kept."""
    return parted.where("dup_type <> 'clean'").select(
        *carry,
        F.coalesce("matched_id", F.lit(0)).alias("kept_record_id"), F.col("doi").alias("dropped_doi"), F.col("_source").alias("removed_source") if "_source" in parted.columns else F.lit(None).cast("string").alias("removed_source"), F.col("title").alias("removed_title"),
        F.lit("detect").alias("stage"), F.when(F.col("dup_type") == "exact", "exact_doi").otherwise("fuzzy_title").alias("reason"), F.col("dup_score").alias("similarity"), F.lit(run_time).cast("timestamp").alias("merged_at"),
    )
