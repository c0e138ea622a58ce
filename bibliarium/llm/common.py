"""What the operators share: text blocks as numpy arrays, word and span hashes, packed arrays, written tables.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. All arithmetic on hashes is modulo 2**64.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 2 << 20


def _return_memory() -> None:
    """Large arrays go back to the system when they are freed: otherwise workers, which stay from stage to stage, keep what their largest block took."""
    with contextlib.suppress(OSError, AttributeError):  # another C library
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 8 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 8 << 20)  # M_TRIM_THRESHOLD
    pa.set_memory_pool(pa.system_memory_pool())


_return_memory()
U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.default_rng(20240229)
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
LOWER = BYTE.copy()
LOWER[65:91] = LOWER[97:123]
_BASE = 0x9E3779B97F4A7C15 | 3
_INVERSE = pow(_BASE, -1, 2**64)
MULT = _rng.integers(1, 2**63, 64, dtype=np.uint64) | U64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash base to the powers 0..n-1, and its inverse."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(max(n, BLOCK_BYTES + 1), base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


class Block:
    """Some documents: their ids (Arrow array), the bytes of their texts end to end, and the offsets of each."""

    def __init__(self, batch: pa.RecordBatch):
        self.ids = batch.column(0)
        text = batch.column(1)
        if text.null_count:
            text = pc.fill_null(text, "")
        wide = pa.types.is_large_string(text.type)
        offs = np.frombuffer(text.buffers()[1], np.int64 if wide else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
        data = np.frombuffer(text.buffers()[2], np.uint8)[offs[0] : offs[-1]] if text.buffers()[2] is not None else np.zeros(0, np.uint8)
        self.text, self.data, self.offs = text, data, offs - offs[0]

    def __len__(self) -> int:
        return len(self.offs) - 1

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each document have their flag set."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return np.diff(total[self.offs])

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each word, and the index of each document's first word (one more at the end)."""
        n = len(self.data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(self) + 1, np.int64)
        space = SPACE[self.data]
        cut = np.zeros(n + 1, bool)
        cut[self.offs] = True
        before, after = cut[:-1].copy(), cut[1:].copy()
        before[1:] |= space[:-1]
        after[:-1] |= space[1:]
        start = np.flatnonzero(~space & before)
        return start, np.flatnonzero(~space & after) + 1, np.searchsorted(start, self.offs)

    def prefix(self, table: np.ndarray = BYTE) -> np.ndarray:
        """Prefix sums from which span_hash() takes the hash of any span."""
        c = table[self.data]
        c *= powers(len(c))[0]
        out = np.zeros(len(c) + 1, np.uint64)
        np.cumsum(c, out=out[1:])
        return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    h = prefix[end] - prefix[start]
    h *= powers(len(prefix))[1][start]
    h += (end - start).astype(np.uint64) * MULT[63]
    return mix(h)


def grams(h: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hash of each n consecutive hashes."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    g = np.full(m, salt, np.uint64)
    for k in range(n):
        g += h[k : k + m] * MULT[k]
    return mix(g)


def gram_bounds(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each document's n-grams of words: first and one past the last, when grams() ran over all words."""
    lo, hi = first[:-1], first[1:] - n + 1
    return lo, np.maximum(lo, hi)


def ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges lo..hi-1 end to end, and the range that each comes from."""
    n = np.maximum(hi - lo, 0)
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n), of


def flat(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All integers of the ranges that begin at lo and have n members, end to end."""
    at = np.cumsum(n)
    out = np.repeat(lo - at + n, n)
    out += np.arange(len(out))
    return out


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def slices(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about limit bytes of text (the second column), or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(size, (size[at - 1] if at else 0) + limit, side="right"))
            end = max(end, at + 1)
            yield batch.slice(at, end - at)
            at = end


def blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[Block]:
    for piece in slices(batches, limit):
        yield Block(piece)


def pack(a: np.ndarray) -> bytes:
    """An array as compressed bytes, its bytes by place so that equal high ones compress."""
    a = np.ascontiguousarray(a)
    head = a.dtype.str.encode().ljust(4)
    raw = a.view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes() if a.dtype.itemsize > 1 else a.tobytes()
    return head + zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(b: bytes) -> np.ndarray:
    kind = np.dtype(b[:4].decode().strip())
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[4:]), np.uint8)
    return raw.reshape(kind.itemsize, -1).T.copy().view(kind).reshape(-1) if kind.itemsize > 1 else raw.view(kind)


def pack_sorted(a: np.ndarray) -> bytes:
    """Ascending 64-bit values by their differences."""
    return pack(np.diff(a, prepend=U64(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b), dtype=np.uint64)


def labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of n nodes with links a-b: the smallest node that each is connected with. Larger roots hook to smaller ones, then paths are flattened."""
    top = np.arange(n)
    while True:
        x, y = top[a], top[b]
        apart = x != y
        if not apart.any():
            return top
        a, b = a[apart], b[apart]
        np.minimum.at(top, np.maximum(x[apart], y[apart]), np.minimum(x[apart], y[apart]))
        while not np.array_equal(up := top[top], top):
            top = up


def narrow(a: np.ndarray) -> np.ndarray:
    """Non-negative integers in the smallest unsigned type that holds them."""
    return a.astype(np.min_scalar_type(int(a.max(initial=0))))


_written: list[tuple[SparkSession, str]] = []


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path below spark.checkpoint.dir, which all executors share; in a local session without one, below a folder of our own."""
    sc = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not top:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="bibliarium-")
        sc.setCheckpointDir(top)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(top)
    path = f"{top.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _drop_all() -> None:
    for spark, path in _written:
        try:
            drop_path(spark, path)
        except Exception:  # the JVM has gone already
            return


#: While a table is written: shuffle files go when it is there, and Python gets a thousand rows at a time, not megabytes of texts.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: its lineage is cut, and a lost executor costs no recomputation of it.

    The shuffle files that made it are of no use then, and go when the write ends. free() takes the table back.
    """
    spark = df.sparkSession
    path, before = shared_path(spark, what), {k: spark.conf.get(k, None) for k in _WRITING}
    try:
        for k, v in _WRITING.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def free(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for t in tables:
        entry = (t.sparkSession, t.written_path)
        if entry in _written:
            _written.remove(entry)
            drop_path(*entry)


def unused(names: list[str], stem: str) -> str:
    """A column name that none of names equals, in letters of either case."""
    taken, name = {n.lower() for n in names}, stem
    while name.lower() in taken:
        name += "_"
    return name


def dealt(spark: SparkSession, n: int) -> np.ndarray:
    """n numbers (int) that a repartition into n by them deals one to each partition."""
    some = spark.range(n * (12 + n.bit_length())).select(F.col("id").cast("int").alias("key"))
    rows = some.groupBy(F.pmod(F.hash("key"), F.lit(n)).alias("p")).agg(F.min("key").alias("key")).collect()  # n rows
    out = np.full(n, -1, np.int64)
    for r in rows:
        out[r["p"]] = r["key"]
    lack = np.flatnonzero(out < 0)
    out[lack] = -1 - lack  # as good as any
    return out


def bucket_of(sorted_hashes: np.ndarray, n: int) -> np.ndarray:
    """For ascending hashes: where each of n equal ranges of hash values begins (n + 1 offsets)."""
    edges = np.array([(k << 64) // n for k in range(n)], dtype=np.uint64)
    return np.append(np.searchsorted(sorted_hashes, edges), len(sorted_hashes))
