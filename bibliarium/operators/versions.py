"""Versioned records: an append-only log of changes, from which current records and histories are derived.

A change is a row of (pos, record key, fields given). Fields that are not given stay as they are, which is not the same
as fields given as null; so a change holds a map of what it gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import doi_key


def record_key(doi: Column, source_id: Column) -> Column:
    """The identifier if there is one, else the source's own id."""
    key = doi_key(doi)
    return F.when(key != "", F.concat(F.lit("doi:"), key)).otherwise(F.concat(F.lit("src:"), source_id))


def given(df: DataFrame, columns: list[str]) -> Column:
    """The map of columns that a row gives, values as strings."""
    return F.map_from_arrays(F.array(*(F.lit(c) for c in columns)), F.array(*(F.col(c).cast("string") for c in columns)))


def chain(changes: DataFrame, columns: list[str]) -> DataFrame:
    """All versions that changes (record_key, pos, fields map) make, in order of pos: each field carried forward from the last change that gives it.

    Gives (record_key, pos, version_number, action, changed, snapshot); a change without effect has action unchanged, no
    changed fields, and the version of the one before. Keys that are not in columns say nothing.
    """
    order = Window.partitionBy("record_key").orderBy("pos")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    held = changes
    for c in columns:
        one = F.when(F.map_contains_key("fields", F.lit(c)), F.struct(F.try_element_at("fields", F.lit(c)).alias("v")))
        held = held.withColumn(f"_s_{c}", F.last(one, ignorenulls=True).over(so_far)["v"])
    for c in columns:
        held = held.withColumn(f"_p_{c}", F.lag(f"_s_{c}").over(order))
    first = F.row_number().over(order) == 1
    diff = F.array(*(F.when(~F.col(f"_s_{c}").eqNullSafe(F.col(f"_p_{c}")), F.struct(F.lit(c).alias("k"), F.struct(F.col(f"_p_{c}").alias("old"), F.col(f"_s_{c}").alias("new")).alias("v"))) for c in columns))
    held = held.withColumn("_first", first).withColumn("changed", F.map_from_entries(F.filter(diff, lambda x: x.isNotNull())))
    held = held.withColumn("_moves", F.col("_first") | (F.size("changed") > 0))
    held = held.withColumn("version_number", F.sum(F.col("_moves").cast("int")).over(so_far).cast("int"))
    held = held.withColumn("action", F.when(F.col("_first"), "inserted").when(F.col("_moves"), "updated").otherwise("unchanged"))
    empty = F.map_filter("changed", lambda k, v: F.lit(False))
    snapshot = F.map_from_arrays(F.array(*(F.lit(c) for c in columns)), F.array(*(F.col(f"_s_{c}") for c in columns)))
    return held.select("record_key", "pos", "version_number", "action", F.when(F.col("_first"), empty).otherwise(F.col("changed")).alias("changed"), snapshot.alias("snapshot"))


def apply(log: DataFrame, changes: DataFrame, columns: list[str], run_time) -> tuple[DataFrame, DataFrame]:
    """Changes against a VERSIONS log: rows to append, and an outcome (record_key, pos, action, version_number) for each change.

    A record whose latest row is a tombstone becomes active again with a new version. As in a plain re-load, a change
    without effect on a stored record is reported as updated, and appends nothing.
    """
    own = log.join(changes.select("record_key").distinct(), "record_key", "left_semi")  # before anything of the log is shuffled
    last = own.groupBy("record_key").agg(F.max_by(F.struct("version_number", "snapshot", "is_active"), F.struct("version_number", "updated_at")).alias("l"))
    base = last.select("record_key", F.lit(-1).cast("bigint").alias("pos"), F.col("l.snapshot").alias("fields"))
    made = chain(base.unionByName(changes.select("record_key", F.col("pos").cast("bigint").alias("pos"), "fields")), columns)
    state = last.select("record_key", F.col("l.version_number").alias("_v"), F.col("l.is_active").alias("_on"))
    made = made.where("pos >= 0").join(state, "record_key", "left")
    back = F.coalesce(~F.col("_on"), F.lit(False)) & (F.row_number().over(Window.partitionBy("record_key").orderBy("pos")) == 1)
    made = made.withColumn("_back", back).withColumn("_lift", F.max((F.col("_back") & (F.col("action") == "unchanged")).cast("int")).over(Window.partitionBy("record_key")))
    made = made.withColumn("version_number", (F.col("version_number") + F.coalesce(F.col("_v") - 1, F.lit(0)) + F.col("_lift")).cast("int"))
    rows = made.where(F.col("_back") | (F.col("action") != "unchanged")).select("record_key", "version_number", F.when(F.col("_back"), "reactivated").otherwise(F.col("action")).alias("action"), "changed", "snapshot", F.lit(True).alias("is_active"), F.lit(run_time).cast("timestamp").alias("updated_at"))
    outcome = made.select("record_key", "pos", F.when(F.col("action") == "inserted", "inserted").otherwise("updated").alias("action"), "version_number")
    return rows, outcome


def conflicts(log: DataFrame, changes: DataFrame) -> DataFrame:
    """Keys of changes (record_key) that can't be inserted, as they are those of active records, or are there twice: (record_key, n, stored)."""
    asked = changes.groupBy("record_key").agg(F.count("*").alias("n"))
    held = active(log.join(asked.select("record_key"), "record_key", "left_semi")).select("record_key", F.lit(True).alias("stored"))
    return asked.join(held, "record_key", "left").select("record_key", "n", F.coalesce("stored", F.lit(False)).alias("stored")).where("stored OR n > 1")


def tombstones(log: DataFrame, keys: DataFrame, run_time) -> DataFrame:
    """Rows that make active records (column record_key of keys) inactive; their version stays."""
    return active(log).join(keys.select("record_key").distinct(), "record_key", "left_semi").select("record_key", "version_number", F.lit("deleted").alias("action"), F.expr("map_filter(changed, (k, v) -> false)").alias("changed"), "snapshot", F.lit(False).alias("is_active"), F.lit(run_time).cast("timestamp").alias("updated_at"))


def latest(log: DataFrame) -> DataFrame:
    """The last row of each record, a tombstone after the version that it ends."""
    last = F.max_by(F.struct(*(F.col(f"`{c}`") for c in log.columns)), F.struct("version_number", "updated_at", ~F.col("is_active")))
    return log.groupBy(F.col("record_key").alias("key")).agg(last.alias("row")).select("row.*")


def active(log: DataFrame) -> DataFrame:
    return latest(log).where("is_active")


def history(log: DataFrame, key: str) -> DataFrame:
    """All versions of a record, ascending, tombstones left out."""
    return log.where((F.col("record_key") == key) & (F.col("action") != "deleted")).orderBy("version_number")
