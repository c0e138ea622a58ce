"""A trigram index for searches that look for a text anywhere in a column, letters in either case.

The index is two tables below one folder. `rows` holds the table itself with a row number (_row), in row groups that are
small enough to be skipped. `grams` is the inverted table: for each column, trigram of its lower-case values, and block of
BLOCK row numbers, how many rows have it and which (offsets in the block, ascending, which Parquet packs to two bytes or
less). A trigram that every row has is a row for each block, so no list grows with the table.

A search takes the trigrams of its text's pieces between wildcards, keeps the rarest of them, and intersects their lists
block by block; what is left are candidates, a superset of the result, on which the plain query runs as it would on the
table. A text without any piece of three characters has no trigram: then all rows are candidates, as in a scan. Values
that are null or shorter have no trigram, and can't hold such a text either.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

BLOCK_BITS = 16
#: Of a text's trigrams so many are looked up, the rarest: more cost reads and leave hardly fewer candidates.
RAREST = 4
#: Rows come from ranges of neighbouring row numbers while there are no more ranges than this; beyond, by a join alone.
MOST_RANGES = 256
#: Row numbers this close are read together.
NEAR = 1 << 12
#: Row numbers go to every task while there can be no more than this (8 bytes each); beyond, both sides are shuffled.
MOST_BROADCAST = 1_000_000
ROW_GROUP = 8 << 20


def trigrams(c: Column) -> Column:
    """The different trigrams of a string's lower-case form; null and short strings have none. One pass over its characters."""
    marks = F.regexp_extract_all(F.lower(c), F.lit("(?s)."), 0)
    two = F.zip_with(marks, F.slice(marks, 2, 1 << 30), lambda a, b: F.concat(a, b))
    three = F.zip_with(two, F.slice(marks, 3, 1 << 30), lambda a, b: F.concat(a, b))  # null at the end, where one is missing
    return F.coalesce(F.array_distinct(F.filter(three, lambda g: g.isNotNull())), F.array().cast("array<string>"))


def _pieces(lowered: str) -> set[str]:
    """Trigrams of a LIKE pattern's pieces, with a doubled backslash as one."""
    found = set()
    for piece in re.split("[%_]", lowered.replace("\\\\", "\\")):
        found |= {piece[i : i + 3] for i in range(len(piece) - 2)}
    return found


class GramIndex:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        sc = spark.sparkContext
        self._path = sc._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(sc._jsc.hadoopConfiguration())

    def _segments(self) -> list[str]:
        """What was added at a time, as far as it was written to its end."""
        where = self._path(f"{self.root}/grams")
        names = [s.getPath().getName() for s in self._fs.listStatus(where)] if self._fs.exists(where) else []
        return sorted(n for n in names if self._fs.exists(self._path(f"{self.root}/grams/{n}/_SUCCESS")))

    def _read(self, table: str) -> DataFrame:
        parts = self._segments()
        if not parts:
            raise FileNotFoundError(f"no index at {self.root}")
        return self.spark.read.parquet(*(f"{self.root}/{table}/{n}" for n in parts))

    def add(self, df: DataFrame, fields: list[str]) -> GramIndex:
        """Rows of df as a segment more, found by the columns given (those that it lacks are left out). Rows of before are not read again."""
        if "_row" in df.columns:
            raise ValueError("_row is the index's own column")
        parts = self._segments()
        name = f"{int(parts[-1]) + 1 if parts else 0:06d}"
        # partitions' numbers are in the high bits of _row, so a segment begins at the next free one
        last = self._read("rows").agg(F.max("_row")).first()[0] if parts else None
        base = 0 if last is None else ((last >> 33) + 1) << 33
        df.select("*", (F.monotonically_increasing_id() + base).alias("_row")).write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(f"{self.root}/rows/{name}")
        rows = self.spark.read.parquet(f"{self.root}/rows/{name}")
        known = [f for f in fields if f in df.columns]
        lists = F.array(*(F.struct(F.lit(f).alias("field"), trigrams(F.col(f"`{f}`").cast("string")).alias("grams")) for f in known)).cast("array<struct<field:string,grams:array<string>>>")
        each = rows.select("_row", F.inline(lists)).select("_row", "field", F.explode("grams").alias("gram"))
        block = F.shiftright("_row", BLOCK_BITS)
        offset = F.col("_row").bitwiseAND((1 << BLOCK_BITS) - 1).cast("int")
        lists = each.groupBy("field", "gram", block.alias("block")).agg(F.sort_array(F.collect_list(offset)).alias("offsets"))
        lists = lists.select("field", "gram", "block", F.size("offsets").alias("n"), "offsets")
        lists.repartitionByRange("field", "gram", "block").sortWithinPartitions("field", "gram", "block").write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(f"{self.root}/grams/{name}")
        return self

    def table(self) -> DataFrame:
        return self._read("rows").drop("_row")

    def counts(self) -> DataFrame:
        """How many rows have a trigram, of each column."""
        return self._read("grams").groupBy("field", "gram").agg(F.sum("n").alias("n"))

    def _wanted(self, text: str) -> set[str]:
        """Trigrams that a value must have if it holds the text, lowered as the comparison lowers it."""
        pattern = "%" + text.strip().replace("\\", "\\\\") + "%"
        return _pieces(self.spark.range(1).select(F.lower(F.lit(pattern))).first()[0])

    def candidates(self, text: str, fields: list[str]) -> tuple[DataFrame | None, int]:
        """_row of the rows of which any of the columns may hold the text, and how many there are at most; None if all may."""
        wanted = self._wanted(text)
        if not wanted:
            return None, 0
        lists = self._read("grams").where(F.col("field").isin(fields) & F.col("gram").isin(sorted(wanted)))
        told: dict[str, dict[str, int]] = {f: {} for f in fields}
        for r in lists.groupBy("field", "gram").agg(F.sum("n").alias("n")).collect():  # a row a column and trigram of the text
            told[r["field"]][r["gram"]] = r["n"]
        found, most = [], 0
        for f, counts in told.items():
            if set(counts) != wanted:
                continue  # a trigram that no row has
            chosen = sorted(wanted, key=lambda g: (counts[g], g))[:RAREST]
            most += counts[chosen[0]]
            blocks = lists.where((F.col("field") == f) & F.col("gram").isin(chosen)).groupBy("block").agg(F.collect_list("offsets").alias("o"))  # as many lists as trigrams are chosen
            both = F.aggregate(F.slice("o", 2, RAREST), F.get("o", F.lit(0)), F.array_intersect)
            found.append(blocks.where(F.size("o") == len(chosen)).select("block", F.explode(both).alias("offset")).select((F.shiftleft("block", BLOCK_BITS) + F.col("offset")).alias("_row")))
        if not found:
            return self._read("rows").where("false").select("_row"), 0
        every = found[0]
        for x in found[1:]:
            every = every.unionByName(x)
        return (every.distinct() if len(found) > 1 else every), most

    def rows(self, text: str, fields: list[str]) -> DataFrame:
        """Rows of the table among which are all of which any of the columns holds the text."""
        ids, most = self.candidates(text, fields)
        rows = self._read("rows")
        if ids is None:
            return rows.drop("_row")
        return self._at(rows, ids, most).drop("_row")

    def _at(self, rows: DataFrame, ids: DataFrame, most: int, seen: Observation | None = None) -> DataFrame:
        """The rows of the given numbers; seen counts those that are read for it."""
        small = most <= MOST_BROADCAST
        if small:
            near = ids.groupBy(F.floor(F.col("_row") / NEAR).alias("k")).agg(F.min("_row").alias("lo"), F.max("_row").alias("hi")).limit(MOST_RANGES + 1).collect()
            if len(near) <= MOST_RANGES:
                rows = rows.where(reduce(lambda a, b: a | b, (F.col("_row").between(r["lo"], r["hi"]) for r in near), F.lit(False)))
        rows = rows.observe(seen, F.count("*").alias("rows")) if seen else rows
        return rows.join(F.broadcast(ids) if small else ids, "_row", "left_semi")

    def report(self, text: str, fields: list[str]) -> dict[str, int]:
        """Rows of the table, those that are read for a text, and candidates among them."""
        ids, most = self.candidates(text, fields)
        rows = self._read("rows")
        total = rows.count()
        if ids is None:
            return {"rows": total, "read": total, "candidates": total}
        if not most:
            return {"rows": total, "read": 0, "candidates": 0}
        seen = Observation()
        found = self._at(rows, ids, most, seen).agg(F.count("*")).first()[0]
        return {"rows": total, "read": seen.get["rows"], "candidates": found}
