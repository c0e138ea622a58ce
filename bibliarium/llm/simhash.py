"""Document fingerprints (operator 6): SimHash and permuted block tables.

fingerprint() lets each word of a text (ASCII letters in lower case) vote, with a weight that grows with its length,
for or against each of 64 bits. Equal texts have equal fingerprints; null, empty and wordless texts have that of no
votes, all zeros. edited() adds the fingerprint of each document with its second half replaced by the beginning of the
next. search() finds, for query rows, all rows within a Hamming radius through permuted block tables, and neighbours()
counts them; both lose none. Repeated rows stay apart; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, Block, blocks, span_hash, written

SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string, near_edited double, near_next double, bits bigint"
#: Keys that rows of one block value are dealt to; queries ask all of them.
SALTS = 4


def votes(b: Block) -> np.ndarray:
    """The 64-bit fingerprint of each document of a block."""
    start, end, first = b.words()
    out = np.zeros(len(b), np.uint64)
    if not len(start):
        return out
    h = span_hash(b.prefix(LOWER), start, end)
    weight = np.minimum(end - start, 12).astype(np.uint8)
    full = np.flatnonzero(np.diff(first))
    sums = np.zeros((len(b), 64), np.int64)
    for lo in range(0, len(full), 512):
        some = full[lo : lo + 512]
        a, z = first[some[0]], first[some[-1] + 1]
        bits = np.unpackbits(h[a:z].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        bits *= weight[a:z, None]
        yes = np.add.reduceat(bits, first[some] - a, axis=0, dtype=np.int32)
        sums[some] = 2 * yes.astype(np.int64) - np.add.reduceat(weight[a:z], first[some] - a, dtype=np.int64)[:, None]
    return np.packbits(sums > 0, axis=1).view(">u8").reshape(-1).astype(np.uint64)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 - np.bitwise_count(a ^ b) / 64


def _hex(a: np.ndarray) -> list[str]:
    return [f"{x:016x}" for x in a.tolist()]


def _block(texts: list[str]) -> Block:
    return Block(pa.record_batch([pa.nulls(len(texts), pa.int64()), pa.array(texts, pa.large_string())], ["doc_id", "text"]))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint (bigint, whose bits are the fingerprint's)."""

    def run(batches):
        for b in blocks(batches):
            yield pa.record_batch([b.ids, pa.array(votes(b).view(np.int64))], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id bigint, fingerprint bigint")


def _compare(ids: list, texts: list[str], after: list[str]) -> pa.RecordBatch:
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, after)]
    own, new, follow = votes(_block(texts)), votes(_block(edited)), votes(_block(after))
    return pa.record_batch([pa.array(ids, pa.int64()), pa.array(list(map(len, texts)), pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()), *(pa.array(_hex(x), pa.string()) for x in (own, new, follow)), pa.array(likeness(own, new)), pa.array(likeness(own, follow)), pa.array(own.view(np.int64))], [x.split()[0] for x in SCHEMA.split(", ")])


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCHEMA of every document (bits: its fingerprint as a number). The next document is that of the next id (nulls first, ties by text); the first follows the last.

    Documents are range-partitioned by id and sorted in each partition, where all but the last find the next. Of each
    partition the first and the last text are kept as well, and those few rows, two for each task, are paired after.
    """

    def run(batches):
        head, held = None, None
        for b in blocks(batches):
            ids, texts = b.ids.to_pylist(), b.text.to_pylist()
            if head is None:
                head = ids[0], texts[0]
            else:
                ids, texts = [held[0], *ids], [held[1], *texts]
            held = ids[-1], texts[-1]
            if len(ids) > 1:
                out = _compare(ids[:-1], texts[:-1], texts[1:])
                yield pa.record_batch([*out.columns, pa.nulls(out.num_rows, pa.string()), pa.nulls(out.num_rows, pa.string())], [*out.schema.names, "head", "tail"])
        if head is not None:
            blank = [pa.nulls(1, f.type) for f in _compare([], [], []).schema]
            yield pa.record_batch([pa.array([held[0]], pa.int64()), *blank[1:], pa.array([head[1]]), pa.array([held[1]])], [*(x.split()[0] for x in SCHEMA.split(", ")), "head", "tail"])

    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    own = own.withColumn("text", F.coalesce("text", F.lit("")))
    rows = written(own.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, f"{SCHEMA}, head string, tail string"), "simhash")
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    # one row for each task of the sort: its last id, its first and its last text
    order = Window.orderBy(F.col("doc_id").asc_nulls_first(), "tail")
    ends = rows.where("head IS NOT NULL").select("doc_id", "tail", F.lead("head").over(order).alias("after"), F.first("head").over(order).alias("start"))

    def pair(batches):
        for b in batches:
            c = b.to_pydict()
            yield _compare(c["doc_id"], c["tail"], [s if a is None else a for a, s in zip(c["after"], c["start"])])

    return rows.where("head IS NULL").select(*names).unionByName(ends.mapInArrow(pair, SCHEMA))


def _near(rows: DataFrame, queries: DataFrame, radius: int, blocks_: int | None) -> DataFrame:
    """q, r and distance of all pairs of distinct fingerprints (of queries and of rows) within radius of each other.

    The 64 bits are cut into blocks_ blocks (twice the radius unless given); whichever radius of them differ, the others
    agree, so each choice of the others is a table in which equal keys meet. Rows of one key are dealt to SALTS keys, so
    that a frequent one is not one task's. A pair counts in the first table in which it meets.
    """
    blocks_ = blocks_ or max(2 * radius, 1)
    if radius < 0 or blocks_ <= radius:
        raise ValueError("more blocks than the radius are needed")
    edges = [64 * k // blocks_ for k in range(blocks_ + 1)]
    masks = [sum(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in c) for c in combinations(range(blocks_), blocks_ - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    array = ",".join(f"{m}L" if m != -(1 << 63) else "bigint(-9223372036854775808)" for m in signed)

    def tables(df: DataFrame, name: str, salts) -> DataFrame:
        one = df.where("fingerprint IS NOT NULL").select(F.col("fingerprint").alias(name)).distinct()
        return one.select(name, salts(name).alias("salt")).select(name, "salt", F.posexplode(F.expr(f"transform(array({array}), m -> {name} & m)")).alias("table", "key"))

    asks = tables(queries, "q", lambda name: F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    has = tables(rows, "r", lambda name: F.pmod(F.xxhash64(name), F.lit(SALTS)).cast("int"))
    met = asks.join(has.hint("merge"), ["table", "key", "salt"])  # few queries make many rows: they are not broadcast
    differ = F.col("q").bitwiseXOR(F.col("r"))
    earliest = F.expr(f"array_position(transform(array({array}), m -> ((q ^ r) & m) = 0), true) - 1")
    return met.where((F.bit_count(differ) <= radius) & (F.col("table") == earliest)).select("q", "r", F.bit_count(differ).alias("distance"))


def search(rows: DataFrame, queries: DataFrame, radius: int = 3, blocks_: int | None = None) -> DataFrame:
    """query_id, doc_id and distance of all fingerprints within radius of each query's, itself included.

    rows, queries: doc_id, fingerprint as of fingerprint(). Rows of one fingerprint meet as one, so that copies of a text
    make no pairs before the result. Null fingerprints find nothing.
    """
    asks = queries.select(F.col("doc_id").alias("query_id"), F.col("fingerprint").alias("q"))
    has = rows.select("doc_id", F.col("fingerprint").alias("r"))
    return _near(rows, queries, radius, blocks_).join(asks, "q").join(has, "r").select("query_id", "doc_id", "distance")


def neighbours(rows: DataFrame, queries: DataFrame, radius: int = 3, blocks_: int | None = None) -> DataFrame:
    """fingerprint and n_near of each distinct fingerprint of queries: how many rows are within radius of it. Copies are counted, not paired."""
    weights = rows.where("fingerprint IS NOT NULL").groupBy(F.col("fingerprint").alias("r")).agg(F.count("*").alias("n"))
    return _near(rows, queries, radius, blocks_).join(weights, "r").groupBy(F.col("q").alias("fingerprint")).agg(F.sum("n").alias("n_near"))
