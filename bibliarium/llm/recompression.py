"""Substring dedup (operator 13): words under a window of words that starts anywhere else, found by recompression.

Words get global names; then each round replaces maximal runs of a name and pairs of neighbours by new names. A pair is
taken where its left part is of one class and its right one of the other, and a name's class follows from the name
alone, so equal stretches are cut alike but for their ends. Names are given by Spark: pieces ask hash buckets, once for
each different word, run or pair that they have; buckets tell equal ones by what they are made of, not by hashes, and
name those that stand at two places or more. What stands at one place only gets no name: nothing that contains it can
repeat, and it is left out of all later rounds, so that after the first ones little but repeated text is left.

A window's own part of a round is what its words alone determine: its first and last run, and an end that may pair with
what stands outside, are popped; the core goes on to the next round. Windows whose core has a part without a name go, and
with them what no other window needs. At last a window is the names of its core, which stand for most of its words, and
of the words around it; this determines its words and is determined by them. Pieces ask buckets which of these sequences
occur again (by digests of 128 bits), and windows that do are removed.

Null and empty texts have no words; texts shorter than a window lose none. Every row counts, so a repeated row repeats
its words; null ids stay. Texts are read whole, and one text is never split. An empty table gives no rows; extra columns
are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE, MULT, SPACE, U64, Block, blocks, bucket_of, dealt, flat, free, mix, narrow, pack, pack_sorted, powers, span_hash, unpack, unpack_sorted, written
from .exchange import pieces, text_columns

#: Rounds of runs and pairs. Each pops about three names of growing length: after five, windows of 35 words have no core.
ROUNDS = 4
#: Bytes of text that a bucket of what pieces ask stands for.
BUCKET_BYTES = 4 << 20
ASKED = "deal int, bucket int, piece bigint, a binary, b binary, c binary, d binary, twice binary"
TOLD = "piece bigint, bucket int, told binary"
LEVEL = "piece bigint, level int, dictionary binary, codes binary, starts binary, n_slots bigint, live binary, a binary, b binary, done binary"
HOLE = U64(0)


def _name_bits(level: int, bucket: int) -> int:
    """Names are of a level, a bucket and a number in it; 0 is no name."""
    return level << 58 | bucket << 32


def _coded(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different names, frequent ones first, as their small codes compress, and the code of each."""
    d = pa.array(names).dictionary_encode()
    codes, names = d.indices.to_numpy(), d.dictionary.to_numpy()
    by = np.argsort(-np.bincount(codes, minlength=len(names)), kind="stable")
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    return names[by], place[codes]


class Level:
    """A piece's documents as names end to end, one hole after each document; where each begins, in slots (a word, or a document's end).

    live: the slots where windows begin that may repeat, with their cores from a to b; done: those whose words are popped.
    """

    def __init__(self, names: np.ndarray, starts: np.ndarray, n_slots: int, live: np.ndarray, a: np.ndarray, b: np.ndarray, done: np.ndarray):
        self.names, self.starts, self.n_slots, self.live, self.a, self.b, self.done = names, starts, n_slots, live, a, b, done

    def index(self, slots: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, slots)

    def needed(self) -> Level:
        """Names outside all cores become holes, and holes side by side one."""
        open_ = np.bincount(self.index(self.a), minlength=len(self.names) + 1) - np.bincount(self.index(self.b), minlength=len(self.names) + 1)
        names = np.where(np.cumsum(open_)[:-1] > 0, self.names, HOLE)
        keep = np.ones(len(names), bool)
        keep[1:] = (names[1:] != HOLE) | (names[:-1] != HOLE)
        return Level(names[keep], self.starts[keep], self.n_slots, self.live, self.a, self.b, self.done)

    def row(self, piece: int, level: int) -> dict:
        names, codes = _coded(self.names)
        steps = {k: pack(narrow(np.diff(x, prepend=0))) for k, x in (("starts", self.starts), ("live", self.live), ("done", self.done))}
        return {"piece": piece, "level": level, "dictionary": pack(names), "codes": pack(narrow(codes)), "n_slots": self.n_slots, "a": pack(narrow(self.a - self.live)), "b": pack(narrow(self.b - self.live)), **steps}

    @classmethod
    def of(cls, row: dict) -> Level:
        starts, live, done = (np.cumsum(unpack(row[k]), dtype=np.int64) for k in ("starts", "live", "done"))
        return cls(unpack(row["dictionary"])[unpack(row["codes"])], starts, row["n_slots"], live, live + unpack(row["a"]), live + unpack(row["b"]), done)


class Cut:
    """A level's runs and pairs: what the next one is made of."""

    def __init__(self, level: Level, salt: int):
        names = level.names
        lead = np.ones(len(names), bool)
        lead[1:] = (names[1:] != names[:-1]) | (names[1:] == HOLE)
        self.run_of = np.cumsum(lead) - 1
        self.begin = np.flatnonzero(lead)
        self.size = np.diff(np.append(self.begin, len(names))).astype(np.uint64)
        self.name = names[self.begin]
        full = self.name != HOLE
        right = mix(self.name * MULT[20] + self.size * MULT[21] + U64(salt)) & U64(1) == 1
        self.left, self.right = full & ~right, full & right
        second = np.zeros(len(self.name), bool)  # of a pair
        second[1:] = self.left[:-1] & self.right[1:]
        self.unit_of = np.cumsum(~second) - 1
        first = np.flatnonzero(~second)
        paired = np.append(second[1:], False)[first]
        self.a, self.ka = self.name[first], self.size[first]
        after = np.minimum(first + 1, len(self.name) - 1)
        self.b, self.kb = np.where(paired, self.name[after], HOLE), np.where(paired, self.size[after], U64(0))
        self.starts = level.starts[self.begin[first]] if len(first) else level.starts[:0]
        self.fresh = np.flatnonzero((self.kb > 0) | (self.ka > 1))  # a run of one that is not paired keeps its name

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The key of each different run or pair in order, one that stands for it, which of them each is, and which stand there twice."""
        cols = [x[self.fresh] for x in (self.a, self.ka, self.b, self.kb)]
        key = mix(sum((x * MULT[30 + k] for k, x in enumerate(cols)), U64(0)))
        order = np.argsort(key)
        lead = np.zeros(len(key), bool)
        lead[:1] = True
        for x in cols:
            x = x[order]
            lead[1:] |= x[1:] != x[:-1]
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(lead) - 1
        return key[order][lead], self.fresh[order[lead]], rank, np.bincount(rank, minlength=int(lead.sum())) > 1

    def next(self, level: Level, told: np.ndarray, rank: np.ndarray) -> Level:
        names = self.a.copy()
        names[self.fresh] = told[rank]
        r, s = self.run_of[level.index(level.a)], self.run_of[level.index(level.b) - 1]
        # the first run and the last are popped, then a first that may pair with what is before it, and a last likewise
        off = self.right[np.minimum(r + 1, len(self.right) - 1)] if len(r) else r
        r = r + 1 + off
        s = s - ((s > r) & self.left[np.maximum(s - 1, 0)] if len(s) else s)
        over = r >= s
        live, a, b = level.live[~over], self.unit_of[r[~over]], self.unit_of[s[~over] - 1] + 1
        holes = np.cumsum(np.append(0, names == HOLE))
        fit = holes[b] == holes[a]
        live, a, b = live[fit], self.starts[a[fit]], np.append(self.starts, level.n_slots)[b[fit]]
        return Level(names, self.starts, level.n_slots, live, a, b, np.sort(np.append(level.done, level.live[over]))).needed()


PIECE = "ids binary, has_id binary, lengths binary, text binary, n_asked bigint"


def _words(text: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.DictionaryArray]:
    """Of a piece's documents: where words begin, their sizes, each document's first word, and the words."""
    offs = np.append(0, np.cumsum(lengths, dtype=np.int64))
    texts = pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offs), pa.py_buffer(text))
    begin, end, first = Block(pa.record_batch([texts, texts], ["id", "text"])).words()
    size = end - begin
    ends = np.append(0, np.cumsum(size))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(text[~SPACE[text]])])
    return begin, size, first, words.dictionary_encode()  # by their bytes


def _piece(batches: list[pa.RecordBatch]) -> dict:
    parts = [(b.data, np.diff(b.offs)) for b in blocks(iter(batches))]
    text, lengths = (np.concatenate(x) for x in zip(*parts))
    ids = pa.chunked_array([b.column(0) for b in batches])
    full = ~SPACE[text]
    return {"ids": pack(pc.fill_null(ids, 0).to_numpy()), "has_id": pack(pc.is_valid(ids).to_numpy()), "lengths": pack(narrow(lengths)), "text": pack(text), "n_asked": int(np.count_nonzero(full[1:] & ~full[:-1])) + 1}


def _in_order(words: pa.DictionaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of the different words, where they end, their keys, and their order by key."""
    d = words.dictionary
    ends = np.frombuffer(d.buffers()[1], np.int64)[: len(d) + 1] if len(d) else np.zeros(1, np.int64)
    data = np.frombuffer(d.buffers()[2], np.uint8)[: ends[-1]] if ends[-1] else np.zeros(0, np.uint8)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[data] * powers(len(data))[0])])
    key = span_hash(prefix, ends[:-1], ends[1:])
    return data, ends, key, np.argsort(key, kind="stable")


def _cells(piece: int, keys: np.ndarray, many: int, deal: np.ndarray, cols: list) -> pa.RecordBatch:
    """One row for each bucket that any of the ascending keys falls in; cols give a bucket's payload by the range of its keys."""
    edge = bucket_of(keys, many)
    some = np.flatnonzero(np.diff(edge))
    cells = [(int(edge[k]), int(edge[k + 1])) for k in some]
    cols = [[f(a, b) for a, b in cells] for f in cols]
    return pa.record_batch([pa.array(deal[some], pa.int32()), pa.array(some.astype(np.int32)), pa.array(np.full(len(some), piece)), *(pa.array(c, pa.binary()) for c in cols)], [x.split()[0] for x in ASKED.split(", ")])


def _nothing(a: int, b: int) -> bytes:
    return b""


def _ask_words(many: int, deal: np.ndarray):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                words = _words(unpack(r["text"]), unpack(r["lengths"]))[3]
                data, ends, key, order = _in_order(words)
                begin, size = ends[order], np.diff(ends)[order]
                twice = np.bincount(words.indices.to_numpy(), minlength=len(key))[order] > 1
                yield _cells(r["piece"], key[order], many, deal, [lambda x, y: pack(data[flat(begin[x:y], size[x:y])]), lambda x, y: pack(narrow(size[x:y])), _nothing, _nothing, lambda x, y: pack(twice[x:y])])

    return run


def _ask_pairs(level: int, many: int, deal: np.ndarray):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                cut = Cut(Level.of(r), level)
                keys, at, _, twice = cut.distinct()
                name, times, other, often = (x[at] for x in (cut.a, cut.ka, cut.b, cut.kb))
                yield _cells(r["piece"], keys, many, deal, [lambda x, y: pack(name[x:y]), lambda x, y: pack(narrow(times[x:y])), lambda x, y: pack(other[x:y]), lambda x, y: pack(narrow(often[x:y])), lambda x, y: pack(twice[x:y])])

    return run


def _answer(c: dict, told: np.ndarray, sizes: list[int]) -> pa.Table:
    return pa.table({"piece": pa.array(c["piece"], pa.int64()), "bucket": pa.array(c["bucket"], pa.int32()), "told": pa.array([pack(x) for x in np.split(told, np.cumsum(sizes)[:-1])], pa.binary())})


def _named(which: np.ndarray, twice: np.ndarray, level: int, bucket: int) -> np.ndarray:
    """A name for each of the things that stand at two places or more, else none."""
    shared = np.bincount(which) + np.bincount(which, twice) > 1
    names = np.where(shared, np.cumsum(shared).astype(np.uint64) + U64(_name_bits(level, bucket)), HOLE)
    return names[which]


def _name_words(t: pa.Table) -> pa.Table:
    c = t.sort_by("piece").to_pydict()
    sizes = [unpack(x).astype(np.int64) for x in c["b"]]
    ends = np.append(0, np.cumsum(np.concatenate(sizes)))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.concatenate([unpack(x) for x in c["a"]]))])
    which = words.dictionary_encode().indices.to_numpy()  # by their bytes
    return _answer(c, _named(which, np.concatenate([unpack(x) for x in c["twice"]]), 1, c["bucket"][0]), [len(x) for x in sizes])


def _name_pairs(level: int):
    def run(t: pa.Table) -> pa.Table:
        c = t.sort_by("piece").to_pydict()
        cols = [[unpack(x) for x in c[k]] for k in "abcd"]
        sizes = [len(x) for x in cols[0]]
        cols = [np.concatenate([y.astype(np.uint64) for y in x]) for x in cols]
        order = np.lexsort(cols)
        lead = np.zeros(len(order), bool)
        lead[:1] = True
        for x in cols:
            x = x[order]
            lead[1:] |= x[1:] != x[:-1]
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(lead) - 1
        return _answer(c, _named(which, np.concatenate([unpack(x) for x in c["twice"]]), level, c["bucket"][0]), sizes)

    return run


def _all_told(told: list[dict]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *(unpack(x["told"]) for x in sorted(told, key=lambda x: x["bucket"]))])


def _level_table(rows: list[dict]) -> pa.Table:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.table([pa.array([r[n] for r in rows], kinds[t]) for n, t in (x.split() for x in LEVEL.split(", "))], [x.split()[0] for x in LEVEL.split(", ")])


def _words_level(window: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        _, _, first, words = _words(unpack(row["text"]), unpack(row["lengths"]))
        order = _in_order(words)[3]
        told = np.empty(len(order), np.uint64)
        told[order] = _all_told(right.to_pylist())
        n_slots = len(words) + len(first) - 1
        names = np.zeros(n_slots, np.uint64)
        names[np.arange(len(words)) + np.repeat(np.arange(len(first) - 1), np.diff(first))] = told[words.indices.to_numpy()]
        holes = np.cumsum(np.append(0, names == HOLE))
        live = np.flatnonzero(holes[window:] == holes[: max(n_slots + 1 - window, 0)])
        return _level_table([Level(names, np.arange(n_slots), n_slots, live, live, live + window, live[:0]).needed().row(row["piece"], 1)])

    return run


def _next_level(left: pa.Table, right: pa.Table) -> pa.Table:
    row = left.to_pylist()[0]
    level = Level.of(row)
    cut = Cut(level, row["level"] + 1)
    return _level_table([cut.next(level, _all_told(right.to_pylist()), cut.distinct()[2]).row(row["piece"], row["level"] + 1)])


#: Numbers in MULT of each of two hashes of a window.
LANES = ((40, 41, 42, 43), (44, 45, 46, 47))


def _sums(level: Level, multiplier: int) -> np.ndarray:
    h = mix(level.names * MULT[multiplier] + U64(1))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers(len(h))[0])])


def _windows(window: int, many: int, deal: np.ndarray):
    """From a piece's words and its last level: the slots of the windows that may repeat, in order of their digests, and what is asked of buckets."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        words, last = Level.of(left.to_pylist()[0]), Level.of(right.to_pylist()[0])
        slots = np.append(last.live, last.done)
        end = slots + window
        a, b = np.append(last.a, end[len(last.a) :]), np.append(last.b, end[len(last.b) :])
        at = [words.index(x) for x in (slots, a, b, end)]
        core = last.index(last.a), last.index(last.b)
        lanes = []
        for i, j, k, m in LANES:
            up, above = _sums(words, i), _sums(last, i)
            h = span_hash(up, at[0], at[1]) * MULT[j] + span_hash(up, at[2], at[3]) * MULT[k]
            h[: len(core[0])] += span_hash(above, *core) * MULT[m]
            lanes.append(mix(h))
        one, two = lanes
        order = np.lexsort((two, one))
        slots, one, two = slots[order], one[order], two[order]
        lead = np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]))[: len(one)]
        count = np.diff(np.append(np.flatnonzero(lead), len(one)))
        one, two = one[lead], two[lead]
        piece = left.column("piece")[0].as_py()
        asked = _cells(piece, one, many, deal, [lambda x, y: pack_sorted(one[x:y]), lambda x, y: pack(two[x:y]), _nothing, _nothing, lambda x, y: pack(count[x:y] > 1)])
        own = [[-1], [-1], [piece], [pack(narrow(slots))], [pack(narrow(count))], [b""], [b""], [b""]]
        return pa.concat_tables([pa.Table.from_batches([asked]), pa.table([pa.array(v, f.type) for v, f in zip(own, asked.schema)], asked.schema.names)])

    return run


def _again(t: pa.Table) -> pa.Table:
    """Which windows occur twice or more."""
    c = t.sort_by("piece").to_pydict()
    one, two = [unpack_sorted(x) for x in c["a"]], np.concatenate([unpack(x) for x in c["b"]])
    sizes, one = [len(x) for x in one], np.concatenate(one)
    order = np.lexsort((two, one))
    a, b = one[order], two[order]
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) - 1
    return _answer(c, (np.bincount(which) + np.bincount(which, np.concatenate([unpack(x) for x in c["twice"]])) > 1)[which], sizes)


def _finish(window: int, with_text: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        told = right.to_pylist()
        own = next(x for x in told if x["bucket"] < 0)
        flags = _all_told([x for x in told if x["bucket"] >= 0]).astype(bool)
        slots = unpack(own["slots"]).astype(np.int64)[np.repeat(flags, unpack(own["count"]).astype(np.int64))]
        data = unpack(row["text"])
        begin, size, first, _ = _words(data, unpack(row["lengths"]))
        n_words = np.diff(first)
        doc = np.repeat(np.arange(len(n_words)), n_words)
        hit = np.zeros(len(doc) + len(n_words) + window + 1, np.int64)
        np.add.at(hit, slots, 1)
        np.add.at(hit, slots + window, -1)
        gone = np.cumsum(hit)[np.arange(len(doc)) + doc] > 0
        removed = np.bincount(doc, gone, minlength=len(n_words)).astype(np.int64)
        # kept words and a space after each, but for a document's last
        stay = np.flatnonzero(~gone)
        kept = n_words - removed
        ends = np.cumsum(kept)
        wide = size[stay] + 1
        out = np.full(int(wide.sum()), 32, np.uint8)
        at = np.cumsum(wide) - wide
        out[flat(at, wide - 1)] = data[flat(begin[stay], wide - 1)]
        edge = np.append(at, len(out))
        texts = [out[a : b - 1].tobytes() if b > a else b"" for a, b in zip(edge[ends - kept].tolist(), edge[ends].tolist())]
        cols = [pa.array(unpack(row["ids"]), mask=~unpack(row["has_id"])), pa.array(n_words), pa.array(removed), pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())]
        return pa.table(cols + [pa.array([x.decode() for x in texts], pa.string())] * with_text, ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text)

    return run


def dedup(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by spaces), and with_text also that text, of every row."""
    if window < 1:
        raise ValueError("windows of one word at least")
    spark = docs.sparkSession
    body = pieces(docs, _piece, PIECE, "pieces", text_columns(id_col, text_col))
    total = body.agg(F.sum(F.octet_length("text")), F.sum("n_asked")).first()
    many = max(8, math.ceil(max(total[0] or 0, 4 * (total[1] or 0)) / BUCKET_BYTES))
    deal = dealt(spark, many)

    def answers(asked: DataFrame, tell, what: str) -> DataFrame:
        return written(asked.repartition(many, "deal").groupBy("deal").applyInArrow(tell, TOLD), what)

    told = answers(body.select("piece", "text", "lengths").mapInArrow(_ask_words(many, deal), ASKED), _name_words, "told")
    words = written(body.select("piece", "text", "lengths").groupBy("piece").cogroup(told.groupBy("piece")).applyInArrow(_words_level(window), LEVEL), "words")
    free(told)
    level = words
    for k in range(2, ROUNDS + 2):
        told = answers(level.select("piece", "level", "dictionary", "codes", "starts", "n_slots", "live", "a", "b", "done").mapInArrow(_ask_pairs(k, many, deal), ASKED), _name_pairs(k), "told")
        before, level = level, written(level.groupBy("piece").cogroup(told.groupBy("piece")).applyInArrow(_next_level, LEVEL), "level")
        free(told, *[before] * (before is not words))
    asked = written(words.groupBy("piece").cogroup(level.groupBy("piece")).applyInArrow(_windows(window, many, deal), ASKED), "windows")
    free(words, level)
    told = answers(asked.where("bucket >= 0"), _again, "told")
    slots = asked.where("bucket < 0").select("piece", "bucket", F.lit(None).cast("binary").alias("told"), F.col("a").alias("slots"), F.col("b").alias("count"))
    told = told.withColumns({"slots": F.lit(None).cast("binary"), "count": F.lit(None).cast("binary")}).unionByName(slots)
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept string" * with_text
    return body.groupBy("piece").cogroup(told.groupBy("piece")).applyInArrow(_finish(window, with_text), schema)
