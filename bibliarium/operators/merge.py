"""Completeness, field-by-field merging, and folding many duplicates into one record in their order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_populated
from ..schemas import CONTENT
from ..sources.scratch import cut
from .versions import given, record_key

SCORED = [*(c for c in CONTENT if c != "source_id"), "_source"]
MERGED = [*CONTENT, "_source"]


def _kind(df: DataFrame, c: str) -> str:
    return df.schema[c].dataType.simpleString()


def completeness(df: DataFrame, prefix: str = "") -> Column:
    """Share of the eleven scored fields that are populated, to four places; columns that df lacks are not."""
    has = [is_populated(F.col(prefix + c), _kind(df, prefix + c)).cast("int") for c in SCORED if prefix + c in df.columns]
    return F.round(reduce(lambda a, b: a + b, has, F.lit(0)) / len(SCORED), 4)


def merge_pairs(existing: DataFrame, incoming: DataFrame, on: Column, carry: tuple[str, ...] = ()) -> DataFrame:
    """Each existing row with one incoming row: merged fields, changed (their names), winner, completeness before and after.

    Gaps are filled; where both are populated and differ, the incoming value is taken only if the incoming row is the
    more complete one. Identity, creation time, version number and activity always are the existing row's. Columns of
    incoming in carry are taken along.
    """
    e, i = existing.select(*(F.col(c).alias(f"e_{c}") for c in existing.columns)), incoming.select(*(F.col(c).alias(f"i_{c}") for c in incoming.columns))
    both = e.join(i, on)
    both = both.withColumns({"e_score": completeness(both, "e_"), "i_score": completeness(both, "i_")})
    prefer_existing = F.col("e_score") >= F.col("i_score")
    out, changed = [], []
    for c in existing.columns:
        old = F.col(f"e_{c}")
        if c in MERGED and c in incoming.columns:
            new = F.col(f"i_{c}")
            has_old, has_new = is_populated(old, _kind(existing, c)), is_populated(new, _kind(incoming, c))
            takes = has_new & (~has_old | (~prefer_existing & ~old.eqNullSafe(new)))
            out.append(F.when(takes, new).otherwise(old).alias(c))
            changed.append(F.when(takes, F.lit(c)))
        else:
            out.append(old.alias(c))
    merged = both.select(*out, *(F.col(f"i_{c}").alias(c) for c in carry), F.filter(F.array(*changed), lambda x: x.isNotNull()).alias("changed"), F.when(prefer_existing, "existing").otherwise("incoming").alias("winner"), F.col("e_score").alias("score_before"))
    return merged.withColumns({"completeness": completeness(merged), "version_number": F.col("version_number") + F.when(F.size("changed") > 0, 1).otherwise(0)} if "version_number" in merged.columns else {"completeness": completeness(merged)})


def fold_steps(existing: DataFrame, duplicates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """existing (with id) after all duplicates (matched_id, dup_type, pos, and fields) are merged, exact ones first, then by pos;
    and a row for each merge that changed a record: it as it became, with changed, winner, pos, and old (what it was before).

    A merge that changes a record raises its completeness: it fills a gap, or the duplicate is the more complete one. So
    however many duplicates a record has, few change it, and each round finds, for all records, the first duplicate after
    the last that does. Rounds are as many as scored fields at most; each is a join and an aggregation by record.
    """
    order = F.struct(F.when(F.col("dup_type") == "exact", 0).otherwise(1).alias("kind"), F.col("pos").cast("bigint").alias("pos"))
    dups = duplicates.where("dup_type <> 'clean' AND matched_id IS NOT NULL").withColumn("fold_order", order)
    names = existing.columns
    state = existing.join(dups.select(F.col("matched_id").alias("id")).distinct(), "id", "left_semi").withColumn("fold_after", F.lit(None).cast("struct<kind:int,pos:bigint>"))
    rounds = []
    for k in range(len(SCORED) + 1):
        on = (F.col("e_id") == F.col("i_matched_id")) & (F.col("e_fold_after").isNull() | (F.col("i_fold_order") > F.col("e_fold_after")))
        before = state.withColumn("old", F.struct(*names))
        merged = merge_pairs(before, dups, on, carry=("fold_order",)).where(F.size("changed") > 0)
        first = F.min_by(F.struct(*(c for c in merged.columns)), F.col("fold_order"))
        best = cut(merged.groupBy(F.col("id").alias("of")).agg(first.alias("row")).select("row.*"))
        if best.isEmpty():
            break
        rounds.append(best.withColumn("fold_round", F.lit(k)))
        state = best.select(*names, F.col("fold_order").alias("fold_after"))
    if not rounds:
        none = merge_pairs(existing.limit(0).withColumn("old", F.struct(*names)), dups.limit(0), F.lit(False))
        return existing, none.select(*names, "changed", "winner", F.lit(None).cast("bigint").alias("pos"), "old")
    steps = reduce(lambda a, b: a.unionByName(b), rounds)
    last = steps.groupBy(F.col("id").alias("of")).agg(F.max_by(F.struct(*names), "fold_round").alias("row")).select("row.*")
    return existing.join(last.select("id"), "id", "left_anti").unionByName(last), steps.select(*names, "changed", "winner", F.col("fold_order.pos").alias("pos"), "old")


def fold(existing: DataFrame, duplicates: DataFrame) -> DataFrame:
    return fold_steps(existing, duplicates)[0]


def losers(duplicates: DataFrame) -> DataFrame:
    """Ids of duplicates that are records themselves (record_id), other than the one they are merged into."""
    return duplicates.where("dup_type <> 'clean' AND matched_id IS NOT NULL AND record_id IS NOT NULL AND record_id <> matched_id").select(F.col("record_id").alias("id"))


def merge_records(existing: DataFrame, duplicates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """fold_steps(), with duplicates that are records themselves made inactive."""
    records, steps = fold_steps(existing, duplicates)
    return (soft_delete(records, losers(duplicates)) if "record_id" in duplicates.columns else records), steps


def log_merges(decided: DataFrame, steps: DataFrame) -> DataFrame:
    """MERGE_LOG rows (with pos) of decisions: where the record lost to its duplicate, what it had been is what was dropped."""
    lost = steps.where("winner = 'incoming'").select("pos", F.col("old.doi").alias("old_doi"), F.col("old._source").alias("old_source"), F.col("old.title").alias("old_title"), F.lit(True).alias("lost"))
    both = decided.join(lost, "pos", "left")
    return both.withColumns({c: F.when(F.col("lost"), F.col(o)).otherwise(F.col(c)) for c, o in (("dropped_doi", "old_doi"), ("removed_source", "old_source"), ("removed_title", "old_title"))}).drop("old_doi", "old_source", "old_title", "lost")


def snapshots(steps: DataFrame, run_time) -> DataFrame:
    """VERSIONS rows of steps: the record as it became and what changed."""
    pair = lambda c: F.struct(F.lit(c).alias("key"), F.struct(F.col("old").getField(c).cast("string").alias("old"), F.col(c).cast("string").alias("new")).alias("value"))
    own = [c for c in MERGED if c in steps.columns]
    changed = F.map_from_entries(F.filter(F.array(*(pair(c) for c in own)), lambda e: F.array_contains("changed", e["key"])))
    return steps.select(
        record_key(F.col("doi"), F.col("source_id")).alias("record_key"), F.col("version_number").cast("int").alias("version_number"), F.lit("merged").alias("action"), changed.alias("changed"),
        given(steps, own).alias("snapshot"), F.lit(True).alias("is_active"), F.lit(run_time).cast("timestamp").alias("updated_at"),
    )


def soft_delete(records: DataFrame, losers: DataFrame) -> DataFrame:
    """records with those in losers (id) inactive."""
    gone = losers.select("id").distinct().withColumn("_gone", F.lit(True))
    return records.join(gone, "id", "left").withColumn("is_active", F.col("is_active") & F.col("_gone").isNull()).drop("_gone")
