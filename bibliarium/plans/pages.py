"""Pages deep in a sorted table, without sorting the table.

A sample of keys cuts the order into ranges, one aggregate counts the rows of each, and the prefix sums of the counts
tell in which ranges a page lies. Those are cut again until they hold few rows, and only these are sorted. No pass
shuffles more than a row a range and task. The sample decides how even the ranges are, never what the page holds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Page:
    rows: DataFrame
    total: int
    sorted: int  #: rows of the ranges that are sorted for the page
    levels: int  #: how often the order was cut


def _key(order: list[tuple[str, bool]]) -> Column:
    """A struct in the order's order: nulls are first where it rises and last where it falls (numbers only)."""
    parts = []
    for k, (c, falls) in enumerate(order):
        parts += [F.col(c).isNull().alias(f"n{k}"), (-F.col(c)).alias(f"k{k}")] if falls else [F.col(c).alias(f"k{k}")]
    return F.struct(*parts)


def page_of(rows: DataFrame, order: list[tuple[str, bool]], offset: int, limit: int, most: int = 100_000, ranges: int = 64, sample: int = 10_000) -> Page:
    """Rows offset to offset + limit of an order: columns, each with whether it falls (then it is a number; nulls last).

    Sorted are the rows of at most three ranges or so, at most `most` where keys differ: rows of one key can't be cut. An
    offset behind the end, and an empty table, give no rows. Of rows with equal keys any may come, as with orderBy.
    """
    own = ["_key", "_range", "_bounds"]
    if set(own) & set(rows.columns):
        raise ValueError(f"columns {own} are the page's own")
    columns = [F.col(f"`{c}`") for c in rows.columns]
    lead = order[0][0]
    keyed, skip, total, held, levels = rows.withColumn("_key", _key(order)), offset, None, None, 0
    while held is None or held > most:
        some = keyed.select("_key").orderBy(F.rand(levels)).limit(sample).agg(F.array_sort(F.collect_list("_key")).alias("s"))
        cuts = F.transform(F.sequence(F.lit(1), F.lit(ranges - 1)), lambda k: F.get("s", F.floor(k * F.size("s") / ranges).cast("int")))
        cut = some.select(F.array_distinct(F.filter(cuts, lambda c: c.isNotNull())).alias("_bounds"))
        bounds = F.broadcast(rows.sparkSession.createDataFrame(cut.collect(), cut.schema))  # one row, of fewer than `ranges` keys
        dealt = keyed.join(bounds).withColumn("_range", F.size(F.filter("_bounds", lambda b: b <= F.col("_key")))).drop("_bounds")
        counts = sorted(dealt.groupBy("_range").agg(F.count("*").alias("n"), F.min(lead).alias("low"), F.max(lead).alias("high"), F.count_if(F.col(lead).isNull()).alias("nulls")).collect())
        levels += 1
        here, before = [], 0
        for r in counts:
            if before < skip + limit and before + r["n"] > skip:
                here.append((before, r))
            before += r["n"]
        total = before if total is None else total
        if not here:
            return Page(rows.where("false"), total, 0, levels)
        taken = [r for _, r in here]
        now, skip = sum(r["n"] for r in taken), skip - here[0][0]
        # the first column's bounds reach the scan, where no null is among the rows
        if not any(r["nulls"] for r in taken):
            dealt = dealt.where(F.col(lead).between(min(r["low"] for r in taken), max(r["high"] for r in taken)))
        keyed = dealt.where(F.col("_range").between(taken[0]["_range"], taken[-1]["_range"])).drop("_range")
        if now == before and held is not None:  # nothing was cut off: one key, or as many rows as asked for
            held = now
            break
        held = now
    sort = [F.desc(c) if falls else F.asc(c) for c, falls in order]
    return Page(keyed.orderBy(*sort).offset(skip).limit(limit).select(*columns), total, held, levels)
