"""Token-ID output (operator 4): documents encoded and kept as one compressed wavelet matrix per shard, a file each.

encode() range-partitions documents by id, so that shards and the documents in them ascend by id over the whole table,
writes one file a shard into a folder that all executors share, and gives a table of the files' paths: files of lost
attempts are not in it. A file has a header, the documents' ids and lengths, and the bit planes of a wavelet matrix in
blocks of BLOCK bits, each compressed by itself, with the number of ones before each. Shard reads from a file only what
a call needs: access, rank, select, counting and occurrence lookup take a block or two from each plane; ids() takes all
back by undoing the partition of each plane. directory() reads written files and gives each document's place. Null and
empty texts are documents of the end id alone; repeated ids keep every row (in the order of their texts); null ids come
first; an empty table gives no files; extra columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from py4j.protocol import Py4JJavaError
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks, pack, unpack, written
from .pieces import Pieces, laid

MAGIC = b"WMX2"
HEAD = struct.Struct("<4sIQQqqQ")  # magic, planes, ids, documents, writing task, place in it, length of the directory
BLOCK = 1 << 16
#: Symbols that are parted at a time.
CHUNK = 1 << 15


def planes_of(ids: np.ndarray) -> list[np.ndarray]:
    """The bit planes of a sequence, packed, the highest first, each a stable partition by the one before."""
    bits = max(1, int(ids.max(initial=0)).bit_length())
    out, cur = [], ids.astype(np.uint16 if bits <= 16 else np.uint32)
    after = np.empty_like(cur)
    for k in range(bits - 1, -1, -1):
        one = (cur >> k & 1).astype(np.uint8).view(bool)
        out.append(np.packbits(one))
        zero, ones = 0, len(cur) - int(np.count_nonzero(one))
        for lo in range(0, len(cur), CHUNK):  # places within a chunk stay in the processor's cache
            here, some = cur[lo : lo + CHUNK], one[lo : lo + CHUNK]
            at = np.flatnonzero(~some)
            here.take(at, out=after[zero : zero + len(at)], mode="clip")
            zero += len(at)
            at = np.flatnonzero(some)
            here.take(at, out=after[ones : ones + len(at)], mode="clip")
            ones += len(at)
        cur, after = after, cur
    return out


def image(ids: np.ndarray, doc_ids: np.ndarray, has_id: np.ndarray, lengths: np.ndarray, part: int = 0, seq: int = 0) -> bytes:
    """The bytes of a shard's file: header, directory, and all blocks of all planes.

    Directory: six arrays, each after its length: ids, which are not null, lengths; ones before each block of each
    plane, ones of each plane, and the places of blocks (one more at the end) after the directory.
    """
    planes, write = planes_of(ids), zstandard.ZstdCompressor(level=1)
    step = BLOCK // 8
    ones = [np.add.reduceat(np.bitwise_count(p).astype(np.int64), np.arange(0, len(p), step)) if len(p) else np.zeros(0, np.int64) for p in planes]
    body = [write.compress(p[at : at + step].tobytes()) for p in planes for at in range(0, len(p), step)]
    before = np.concatenate([np.cumsum(x) - x for x in ones])
    arrays = doc_ids, has_id, lengths, before.astype(np.uint32 if len(ids) < 1 << 32 else np.uint64), np.array([int(x.sum()) for x in ones]), np.cumsum([0, *map(len, body)])
    directory = b"".join(struct.pack("<Q", len(x)) + x for x in map(pack, arrays))
    return HEAD.pack(MAGIC, len(planes), len(ids), len(doc_ids), part, seq, len(directory)) + directory + b"".join(body)


class Shard:
    """A shard's file, through a function that reads `size` bytes at a place. Of the blocks those read last are kept."""

    KEPT = 64

    def __init__(self, read: Callable[[int, int], bytes]):
        self.read = read
        magic, self.planes, self.n, self.n_docs, self.part, self.seq, size = HEAD.unpack(read(0, HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a wavelet shard")
        raw, at, arrays = read(HEAD.size, size), 0, []
        while at < size:
            (n,) = struct.unpack_from("<Q", raw, at)
            arrays.append(unpack(raw[at + 8 : at + 8 + n]))
            at += 8 + n
        self.doc_ids, self.has_id, self.lengths, before, self.ones, self.places = arrays
        self.before = before.astype(np.int64).reshape(self.planes, -1)
        self.zeros = self.n - self.ones
        self.places = self.places + HEAD.size + size
        self.held: dict[int, np.ndarray] = {}

    def _block(self, k: int, b: int) -> np.ndarray:
        """Packed bits of block b of plane k."""
        at = k * self.before.shape[1] + b
        got = self.held.pop(at, None)
        if got is None:
            lo, hi = int(self.places[at]), int(self.places[at + 1])
            got = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.read(lo, hi - lo)), np.uint8)
            if len(self.held) >= self.KEPT:
                del self.held[next(iter(self.held))]
        self.held[at] = got
        return got

    def ids(self) -> np.ndarray:
        """All symbols, from the last plane to the first."""
        kind = np.uint16 if self.planes <= 16 else np.uint32
        cur = np.zeros(self.n, kind)
        read, per = zstandard.ZstdDecompressor(), self.before.shape[1]
        for k in range(self.planes - 1, -1, -1):
            places = self.places[k * per : (k + 1) * per + 1].tolist()
            raw = self.read(places[0], places[-1] - places[0])
            plane = b"".join(read.decompress(raw[a - places[0] : b - places[0]]) for a, b in zip(places, places[1:]))
            one = np.unpackbits(np.frombuffer(plane, np.uint8), count=self.n).view(bool)
            out, zero, ones = np.empty_like(cur), 0, int(self.zeros[k])
            cur[ones:] |= kind(1 << (self.planes - 1 - k))
            for lo in range(0, self.n, CHUNK):
                there, some = out[lo : lo + CHUNK], one[lo : lo + CHUNK]
                at = np.flatnonzero(~some)
                there[at] = cur[zero : zero + len(at)]
                zero += len(at)
                at = np.flatnonzero(some)
                there[at] = cur[ones : ones + len(at)]
                ones += len(at)
            cur = out
        return cur.astype(np.uint32)

    def _ones(self, k: int, i: int) -> int:
        """Ones among the first i bits of plane k."""
        if i >= self.n:
            return int(self.ones[k])
        b, rest = divmod(i, BLOCK)
        if not rest:
            return int(self.before[k, b])
        block = self._block(k, b)
        part = int(block[rest // 8]) >> (8 - rest % 8) if rest % 8 else 0
        return int(self.before[k, b]) + int(np.bitwise_count(block[: rest // 8]).sum(dtype=np.int64)) + part.bit_count()

    def _select(self, k: int, bit: int, j: int) -> int:
        """Place of the j-th (from 0) such bit of plane k."""
        sums = self.before[k] if bit else np.arange(self.before.shape[1]) * BLOCK - self.before[k]
        b = int(np.searchsorted(sums, j, side="right")) - 1
        part = np.unpackbits(self._block(k, b), count=min(BLOCK, self.n - b * BLOCK))
        return b * BLOCK + int(np.flatnonzero(part == bit)[j - int(sums[b])])

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        symbol = 0
        for k in range(self.planes):
            bit = int(self._block(k, i // BLOCK)[i % BLOCK // 8]) >> (7 - i % 8) & 1
            ones = self._ones(k, i)
            i = int(self.zeros[k]) + ones if bit else i - ones
            symbol = symbol << 1 | bit
        return symbol

    def _range(self, symbol: int, lo: int, hi: int) -> tuple[int, int]:
        if symbol >> self.planes:
            return 0, 0
        for k in range(self.planes):
            a, b = self._ones(k, lo), self._ones(k, hi)
            z = int(self.zeros[k])
            lo, hi = (z + a, z + b) if symbol >> (self.planes - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, symbol: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of a symbol in lo..hi-1."""
        a, b = self._range(symbol, lo, self.n if hi is None else hi)
        return b - a

    def rank(self, symbol: int, i: int) -> int:
        return self.count(symbol, 0, i)

    def select(self, symbol: int, j: int) -> int:
        """Place of the j-th (from 0) occurrence."""
        lo, hi = self._range(symbol, 0, self.n)
        if not 0 <= j < hi - lo:
            raise IndexError(j)
        i = lo + j
        for k in range(self.planes - 1, -1, -1):
            bit = symbol >> (self.planes - 1 - k) & 1
            i = self._select(k, bit, i - int(self.zeros[k]) if bit else i)
        return i

    def occurrences(self, symbol: int) -> list[int]:
        return [self.select(symbol, j) for j in range(self.count(symbol))]


# fixed values: schemes that Arrow's file systems, by which tasks read and write shards, share with Spark's
SCHEMES = ("abfs", "abfss", "file", "gs", "hdfs", "s3", "viewfs")


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder as all tasks must name it: one without a scheme lies in the session's default file system, as it does for Spark. A plain path for local files; ValueError for a file system that Arrow doesn't know."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    try:
        where = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where)
        scheme = where.toUri().getScheme()
    except Py4JJavaError as e:
        raise ValueError(f"Spark has no file system for {folder}") from e
    if scheme not in SCHEMES:
        raise ValueError(f"shards can't be kept in {folder}: its scheme, {scheme}, is none of {', '.join(SCHEMES)}")
    return where.toUri().getPath() if scheme == "file" else where.toString()


def _store(path: str):
    """A file system and the path in it; what qualified() gives has a scheme unless it is a local file."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def open_file(path: str) -> Shard:
    store, where = _store(path)
    file = store.open_input_file(where)

    def read(at: int, size: int) -> bytes:
        return file.read_at(size, at)

    return Shard(read)


def open_bytes(data: bytes) -> Shard:
    return Shard(lambda at, size: data[at : at + size])


def _byte_letters() -> dict[str, int]:
    """The letters that vocabularies of byte-level BPE write bytes with."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def open_pieces(vocabulary: str) -> Pieces:
    """Encodes as the tokenizers library does whole texts, its added tokens included."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    letters = _byte_letters()
    added = {i: t.content.encode() for i, t in tokenizer.get_added_tokens_decoder().items()}
    tokens = {i: bytes(letters[c] for c in t) for t, i in tokenizer.get_vocab(with_added_tokens=False).items() if all(c in letters for c in t)} | added
    blanks = any(b" " in t for t in added.values())  # such tokens could arise where pieces stand in one text

    size = np.zeros(max(tokens, default=-1) + 1, np.int64)
    for i, t in tokens.items():
        size[i] = len(t)

    def tokenise(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        # pieces that begin with a blank and end in ink keep apart when they stand in one text, which is encoded faster
        joins = np.fromiter((p[:1] == b" " and 33 <= p[-1] < 127 for p in pieces), bool, len(pieces)) & (not blanks)
        some, alone = np.flatnonzero(joins), np.flatnonzero(~joins)
        begin, count = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        parts, total = [], 0
        for lo in range(0, len(alone), 5000):
            part = alone[lo : lo + 5000]
            ids, at, n = laid([e.ids for e in tokenizer.encode_batch_fast([pieces[k].decode() for k in part], add_special_tokens=False)])
            begin[part], count[part] = at + total, n
            parts.append(ids)
            total += len(ids)
        for lo in range(0, len(some), 1000):
            part = some[lo : lo + 1000]
            texts = [pieces[k] for k in part]
            ids = np.array(tokenizer.encode_batch_fast([b"".join(texts).decode()], add_special_tokens=False)[0].ids, np.int32)
            reach, want = np.cumsum(size[ids]), np.cumsum([len(t) for t in texts])
            end = np.searchsorted(reach, want) + 1
            if not np.array_equal(reach[np.minimum(end, len(reach)) - 1], want):  # a vocabulary that merges across blanks
                lists = [e.ids for e in tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
                ids, _, n = laid(lists)
                end = np.cumsum(n)
            count[part] = np.diff(end, prepend=0)
            begin[part] = end - count[part] + total
            parts.append(ids)
            total += len(ids)
        return np.concatenate([*parts, np.zeros(0, np.int32)]), begin, count

    return Pieces(tokenise, tokens, tuple(added.values()))


_encoders: dict[str, Pieces] = {}


def encode(docs: DataFrame, vocabulary: str, folder: str, end_id: int = 2, shard_ids: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes shards of about shard_ids ids, or of one longer document, into folder, which all executors share (see qualified()); gives the paths of their files (path)."""

    def shards(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if vocabulary not in _encoders:
            _encoders.clear()
            _encoders[vocabulary] = open_pieces(vocabulary)
        encoder, end = _encoders[vocabulary], np.array([end_id], np.int32)
        part, seq, ids, held, lengths, chunks, size = TaskContext.get().partitionId(), 0, [], [], [], [], 0
        store, where = _store(folder)
        store.create_dir(where, recursive=True)

        def flush():
            name = f"{part:08d}-{seq:06d}-{uuid.uuid4().hex}.wmx"
            with store.open_output_stream(f"{where}/{name}") as out:
                out.write(image(np.concatenate(chunks).astype(np.uint32), np.array(ids, np.int64), np.array(held, bool), np.array(lengths, np.int64), part, seq))
            return pa.record_batch([pa.array([f"{folder}/{name}"])], ["path"])

        for block in blocks(batches, 4 << 20):
            out, offs = encoder.encode(block)
            for k, doc in enumerate(block.ids.to_pylist()):
                n = int(offs[k + 1] - offs[k]) + 1
                if ids and size + n > shard_ids:
                    yield flush()
                    seq, ids, held, lengths, chunks, size = seq + 1, [], [], [], [], 0
                ids.append(doc or 0), held.append(doc is not None), lengths.append(n), chunks.append(out[offs[k] : offs[k + 1]]), chunks.append(end)
                size += n
        if ids:
            yield flush()

    folder = qualified(docs.sparkSession, folder)
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return written(own.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(shards, "path string"), "shards")


def directory(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, taken from the files (path).

    The sums that place a shard run over one row per writing task, then over the shards within each task; headers tell them.
    """

    def heads(batches):
        _encoders.clear()  # what encoding has kept in this worker
        for batch in batches:
            for path in batch.column(0).to_pylist():
                s = open_file(path)
                first = int(s.doc_ids[0]) if s.has_id[0] else None
                yield pa.record_batch([pa.array([path]), *(pa.array([x], pa.int64()) for x in (s.part, s.seq, s.n, first))], ["path", "part", "seq", "n_ids", "first_id"])

    head = written(files.mapInArrow(heads, "path string, part bigint, seq bigint, n_ids bigint, first_id bigint"), "heads")
    tasks = head.groupBy("part").agg(F.sum("n_ids").alias("n"), F.min("first_id").alias("first"), F.max(F.col("first_id").isNull()).alias("nulls"))
    order = Window.orderBy(F.col("nulls").desc(), F.col("first"), F.col("part"))
    tasks = tasks.select("part", (F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    own = head.join(tasks, "part")
    own = own.select("path", (F.col("before") + F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_ids")).alias("start"))

    def read(batches):
        _encoders.clear()
        for batch in batches:
            for path, start in zip(*(batch.column(k).to_pylist() for k in range(2))):
                s = open_file(path)
                raw = s.ids().astype("<u4").tobytes()
                ends = np.cumsum(s.lengths)
                starts = ends - s.lengths
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.record_batch([pa.array(s.doc_ids, mask=~s.has_id), *(pa.array(x, pa.int64()) for x in (starts + start, s.lengths, crc))], ["doc_id", "start", "n_tokens", "ids_crc32"])

    few = max(1, -(-head.count() // 4))  # files of a task
    return own.repartition(few, "path").mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
