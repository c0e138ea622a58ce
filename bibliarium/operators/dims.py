"""Dimensions of authors and keywords: get or create, and links with their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trim


def members(records: DataFrame, column: str, lower: bool) -> DataFrame:
    """(record_id, value, value_order) of each distinct value of an array column, at its first place (from 0)."""
    value: Column = trim(F.col("v"))
    value = F.lower(value) if lower else value
    each = records.select(F.col("id").alias("record_id"), F.posexplode(column).alias("value_order", "v")).select("record_id", value.alias("value"), "value_order").where("value <> ''")
    return each.groupBy("record_id", "value").agg(F.min("value_order").alias("value_order"))


def get_or_create(values: DataFrame, dimension: DataFrame, key: str, buckets: int | None = None) -> DataFrame:
    """dimension (id, key) with a row for every value (column value)."""
    return dimension.unionByName(created(values, dimension, key, buckets))


def created(values: DataFrame, dimension: DataFrame, key: str, buckets: int | None = None) -> DataFrame:
    """(id, key) of the values that dimension lacks; new ids follow the greatest, by hash bucket and value.

    Ranks are counted within buckets and shifted by the buckets before, so that no task sees all values. There are as
    many buckets as shuffle partitions, which follow the size of the data.
    """
    buckets = buckets or max(64, int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    new = values.select("value").distinct().join(dimension.select(F.col(key).alias("value")), "value", "left_anti").withColumn("_b", F.pmod(F.crc32("value"), F.lit(buckets)))
    sizes = new.groupBy("_b").agg(F.count("*").alias("_n"))
    before = sizes.select("_b", (F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    top = dimension.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    ranked = new.withColumn("_rn", F.row_number().over(Window.partitionBy("_b").orderBy("value"))).join(F.broadcast(before), "_b").join(F.broadcast(top))
    return ranked.select((F.col("_top") + F.col("_before") + F.col("_rn")).cast("bigint").alias("id"), F.col("value").alias(key))


def links(values: DataFrame, dimension: DataFrame, key: str, id_name: str, order_name: str | None = None) -> DataFrame:
    out = values.join(dimension.select(F.col("id").alias(id_name), F.col(key).alias("value")), "value")
    return out.select("record_id", id_name, *([F.col("value_order").alias(order_name)] if order_name else []))
