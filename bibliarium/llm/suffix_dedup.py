"""Suffix-array dedup (operator 10): bytes under a string of `window` bytes that starts anywhere else, in any document.

Every window has an anchor, the first of its least-hashed 16-byte grams, which its own bytes determine; neighbouring
windows with one anchor form a segment. Equal windows have equal anchors, at the same place: by that place windows are
of CLASSES classes, and those of one class share the gram and all but a CLASSES-th part of what stands around it.
Buckets of gram hashes tell pieces which of their segments share that much with another; each piece sends these once,
by gram, to shards. A shard compares the bytes of segments whose hashes are
equal, joins those that differ into one text, builds its suffix array by induced sorting, and finds by permuted common
prefixes which windows repeat. Hashes only choose what is compared; bytes decide.

A gram with over HOT different segments (as at the edge of a passage that a third of all documents share) would make one
shard as large as the corpus; its windows are told apart by two hashes of 64 bits instead, which are dealt and
pre-aggregated like everything else.

Null and empty texts have no bytes; texts shorter than a window lose none. Every row counts, so a repeated row repeats
its bytes; null ids stay. An empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE, MULT, U64, blocks, bucket_of, dealt, flat, mix, narrow, pack, pack_sorted, powers, repeated, span_hash, unpack, unpack_sorted, written
from .exchange import pieces, text_columns
from .suffix import common_prefixes, suffix_array

GRAM = 16
#: Different segments of one gram that a shard takes.
HOT = 2000
#: Classes of windows, by how many bytes stand before their anchors.
CLASSES = 3
NEAR = [f"near{k}" for k in range(CLASSES)]
PIECE_SCHEMA = "ids binary, has_id binary, lengths binary, text binary, start binary, windows binary, rank binary, grams binary, segments binary, twice binary, " + ", ".join(f"{x} binary" for x in NEAR) + ", n_segments bigint"
#: Bytes of text that one suffix array is built over; the segments of one gram stay together, however long.
SHARD_BYTES = 256 << 10
#: What a bucket tells of a segment: its windows are to be asked of a shard; of the buckets of windows.
SEND, SPREAD = 1, 2
#: Bytes of what pieces ask that a bucket takes, and of text, about.
BUCKET_BYTES = 4 << 20
#: Bytes that are compared, or hashed, at a time.
STEP_BYTES = 1 << 20
OTHER = mix(BYTE + MULT[0]) | U64(1)


def _anchors(prefix: np.ndarray, offs: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each segment's first window, its number of windows, and its anchor, for documents end to end."""
    n = len(prefix) - 1
    count = np.maximum(np.diff(offs) - window + 1, 0)
    none = np.zeros(0, np.int64)
    if not count.sum():
        return none, none, none
    at, span = np.arange(n - GRAM + 1), window - GRAM + 1
    key = span_hash(prefix, at, at + GRAM)
    padded = np.concatenate([key, np.full(-len(key) % span + span, ~U64(0))]).reshape(-1, span)
    ahead = np.minimum.accumulate(padded, axis=1).reshape(-1)
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    s = flat(offs[:-1][count > 0], count[count > 0])
    least = np.minimum(behind[s], ahead[s + span - 1])
    doc = np.repeat(np.arange(len(count)), count)
    # a window has another anchor than the one before it where that one's, which stood first, is left behind, or where a lesser gram comes in at its end
    left = np.append(True, (key[s[:-1]] == least[:-1]) | (doc[1:] != doc[:-1]))
    lead = np.flatnonzero(left | np.append(True, least[1:] != least[:-1]))
    first = s[lead]
    anchor = first + span - 1
    search = np.flatnonzero(left[lead])
    windows = np.lib.stride_tricks.sliding_window_view(key, span)
    for lo in range(0, len(search), 4096):
        some = search[lo : lo + 4096]
        anchor[some] = first[some] + windows[first[some]].argmin(axis=1)  # the first of those that tie
    return first, np.diff(np.append(lead, len(s))), anchor


def _differ(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which of the pairs of stretches that begin at a and b, of size bytes, are not equal."""
    out = np.zeros(len(a), bool)
    step = np.searchsorted(np.cumsum(size), np.arange(1, int(size.sum() // STEP_BYTES) + 1) * STEP_BYTES) if len(size) else []
    for lo, hi in zip([0, *step], [*step, len(a)]):
        n = size[lo:hi]
        unequal = data[flat(a[lo:hi], n)] != data[flat(b[lo:hi], n)]
        at = np.cumsum(np.append(0, unequal))
        ends = np.cumsum(n)
        out[lo:hi] = at[ends] > at[ends - n]
    return out


def _piece(window: int):
    def make(batches: list[pa.RecordBatch]) -> dict:
        start, windows, grams, segments, lengths, texts, near, at = [], [], [], [], [], [], [[] for _ in NEAR], 0
        around = window - GRAM
        for b in blocks(iter(batches)):
            prefix = b.prefix(BYTE)
            s, w, a = _anchors(prefix, b.offs, window)
            start.append(s + at), windows.append(w)
            grams.append(mix(span_hash(prefix, a, a + GRAM) + MULT[6]))  # anchors have low hashes; these are even
            segments.append(mix(span_hash(prefix, s, s + w + window - 1) + (a - s).astype(np.uint64) * MULT[5]))
            for k in range(CLASSES):
                # of windows with lo to hi bytes before the anchor: lo bytes before it, and what the others have after it
                lo, hi = around * k // CLASSES, around * (k + 1) // CLASSES
                h = mix(segments[-1] + MULT[7] + U64(k))  # of segments without such windows: like nothing else
                has = np.flatnonzero((a - s >= lo) & (a - s - w < hi))
                h[has] = span_hash(prefix, a[has] - lo, a[has]) * MULT[8] + span_hash(prefix, a[has] + GRAM, a[has] + GRAM + around - hi)
                near[k].append(h)
            lengths.append(np.diff(b.offs)), texts.append(b.data)
            at += len(b.data)
        ids = pa.chunked_array([b.column(0) for b in batches])
        g, s, data = np.concatenate(grams), np.concatenate(segments), np.concatenate(texts)
        begin, size = np.concatenate(start), np.concatenate(windows) + window - 1
        order = np.lexsort((s, g))
        lead = np.ones(len(g), bool)
        lead[1:] = (g[order][1:] != g[order][:-1]) | (s[order][1:] != s[order][:-1])
        first = order[lead][np.cumsum(lead) - 1] if len(order) else order
        same = np.flatnonzero(~lead)
        wrong = size[order[same]] != size[first[same]]
        wrong[~wrong] = _differ(data, begin[order[same][~wrong]], begin[first[same][~wrong]], size[order[same][~wrong]])
        lead[same[wrong]] = True  # equal hashes of different bytes
        rank = np.empty(len(g), np.int64)
        rank[order] = np.cumsum(lead) - 1
        return {
            "ids": pack(pc.fill_null(ids, 0).to_numpy()), "has_id": pack(pc.is_valid(ids).to_numpy()), "lengths": pack(np.concatenate(lengths)), "text": pack(data),
            "start": pack_sorted(begin.astype(np.uint64)), "windows": pack(narrow(np.concatenate(windows))), "rank": pack(rank.astype(np.uint32)),
            "grams": pack_sorted(g[order][lead]), "segments": pack(s[order][lead]), "twice": pack(np.bincount(rank, minlength=int(lead.sum()))[: int(lead.sum())] > 1), "n_segments": int(lead.sum()),
            **{x: pack(np.concatenate(h)[order][lead]) for x, h in zip(NEAR, near)},
        }

    return make


def _ask(many: int, key: np.ndarray):
    """Each piece's distinct segments, by bucket of their grams."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                g, others = unpack_sorted(row["grams"]), [unpack(row[k]) for k in ("segments", "twice", *NEAR)]
                edge = bucket_of(g, many)
                some = np.flatnonzero(np.diff(edge))
                cells = [(int(edge[k]), int(edge[k + 1])) for k in some]
                cols = [[pack_sorted(g[a:b]) for a, b in cells], *([pack(x[a:b]) for a, b in cells] for x in others)]
                yield pa.record_batch([pa.array(key[some], pa.int32()), pa.array(some.astype(np.int32)), pa.array(np.full(len(some), row["piece"])), *(pa.array(c, pa.binary()) for c in cols)], ["deal", "bucket", "piece", "grams", "segments", "twice", *NEAR])

    return run


def _tell(t: pa.Table, hot: int) -> pa.Table:
    """What is to be done with each segment of a bucket, for each piece."""
    c = t.sort_by("piece").to_pydict()
    g = [unpack_sorted(x) for x in c["grams"]]
    cut = np.cumsum([len(x) for x in g])[:-1]
    g = np.concatenate(g)
    s, twice, *near = (np.concatenate([unpack(x) for x in c[k]]) for k in ("segments", "twice", *NEAR))
    order = np.lexsort((s, g))  # stable: of equal segments the first piece's comes first
    sg, ss = g[order], s[order]
    new_g = np.append(True, sg[1:] != sg[:-1])[: len(sg)]
    new_s = new_g.copy()
    new_s[1:] |= ss[1:] != ss[:-1]
    which = np.cumsum(new_s) - 1
    often = np.bincount(which) + np.bincount(which, twice[order]).astype(np.int64) if len(which) else np.zeros(0, np.int64)
    own = order[new_s]
    meets = np.zeros(len(own), bool)
    for k, h in enumerate(near):
        meets |= repeated(mix(g[own] * MULT[9 + k] + h[own]))
    several = meets[which] | (often[which] > 1)
    gram = np.cumsum(new_g) - 1
    kinds = np.bincount(gram, new_s & several).astype(np.int64) if len(gram) else np.zeros(0, np.int64)
    code = np.where(several, np.where(kinds[gram] > hot, SPREAD, SEND), 0)
    out = np.empty(len(code), np.uint8)
    out[order] = code
    return pa.table({"piece": pa.array(c["piece"], pa.int64()), "bucket": pa.array(c["bucket"], pa.int32()), "kind": pa.array([0] * len(c["piece"]), pa.int32()), "told": pa.array([pack(x) for x in np.split(out, cut)], pa.binary())})


def _codes(told: list[dict], rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a piece's segments in order: their codes, and which stand for their rank (the first of each)."""
    code = np.concatenate([unpack(x["told"]) for x in sorted((x for x in told if x["kind"] == 0), key=lambda x: x["bucket"])]) if told else np.zeros(0, np.uint8)
    first = np.zeros(len(rank), bool)
    first[np.unique(rank, return_index=True)[1]] = True
    return code[rank].astype(np.int64), first


def _window_hashes(data: np.ndarray, start: np.ndarray, windows: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of all windows of some segments, one segment's after the other's."""
    out = ([], [])
    many = max(1, STEP_BYTES // (2 * window))
    for lo in range(0, len(start), many):
        s, w = start[lo : lo + many], windows[lo : lo + many]
        size = w + window - 1
        own = data[flat(s, size)]
        at = flat(np.cumsum(size) - size, w)
        for table, hashes in zip((BYTE, OTHER), out):
            up = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[own] * powers(len(own))[0])])
            hashes.append(span_hash(up, at, at + window))
    one, two = (np.concatenate([*x, np.zeros(0, np.uint64)]) for x in out)
    return one, two


def _distinct(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs in order, which of them each is, and how often each occurs."""
    order = np.lexsort((two, one))
    one, two = one[order], two[order]
    lead = np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]))[: len(one)]
    at = np.empty(len(one), np.int64)
    at[order] = np.cumsum(lead) - 1
    return one[lead], two[lead], at, np.bincount(at)


def _asked(code: np.ndarray, first: np.ndarray, rank: np.ndarray, grams: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """The segments that a piece sends to shards, in order of their grams, and where each bucket's begin."""
    go = np.flatnonzero((code & SEND > 0) & first)
    go = go[np.argsort(rank[go], kind="stable")]
    return go, bucket_of(grams[rank[go]], many)


def _split(many: int, window: int, key: np.ndarray):
    """From a piece and what it was told: the segments it sends to shards, and the window hashes it asks of buckets."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        start, windows, rank = unpack_sorted(row["start"]).astype(np.int64), unpack(row["windows"]).astype(np.int64), unpack(row["rank"]).astype(np.int64)
        data = unpack(row["text"])
        code, first = _codes(right.to_pylist(), rank)
        grams, hashes, twice = unpack_sorted(row["grams"]), unpack(row["segments"]), unpack(row["twice"])
        go, edge = _asked(code, first, rank, grams, many)
        rows = []
        for k, (a, b) in enumerate(zip(edge, edge[1:])):
            if b > a:
                seg = go[a:b]
                rows.append((1, k, pack(data[flat(start[seg], windows[seg] + window - 1)]), pack(narrow(windows[seg])), pack(twice[rank[seg]]), pack_sorted(grams[rank[seg]]), pack(hashes[rank[seg]])))
        far = np.flatnonzero(code & SPREAD)
        one, two, _, n = _distinct(*_window_hashes(data, start[far], windows[far], window))
        edge = bucket_of(one, many)
        rows += [(2, k, pack_sorted(one[a:b]), pack(two[a:b]), pack(n[a:b] > 1), b"", b"") for k, (a, b) in enumerate(zip(edge, edge[1:])) if b > a]
        return pa.table([pa.array([int(key[x[1]]) for x in rows], pa.int32()), pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.int32()), pa.array([row["piece"]] * len(rows), pa.int64()), *(pa.array([x[k] for x in rows], pa.binary()) for k in (2, 3, 4, 5, 6))], ["deal", "kind", "bucket", "piece", "a", "b", "c", "d", "e"])

    return run


def repeated_windows(data: np.ndarray, sizes: np.ndarray, window: int) -> np.ndarray:
    """For segments end to end: at each byte, whether the window that begins there lies within its segment and occurs again, by suffix array."""
    begin = np.cumsum(sizes) - sizes
    text = np.ones(len(data) + len(sizes), np.uint16)  # 1 stands after each segment
    place = flat(begin + np.arange(len(sizes)), sizes)
    text[place] = data.astype(np.uint16) + 2
    sa = suffix_array(text)
    # the comparison runs on bytes: a window never reaches the end of its segment, so what stands there is not looked at
    raw = np.zeros(len(text), np.uint8)
    raw[place] = data
    fits = np.zeros(len(text), bool)
    fits[flat(begin + np.arange(len(sizes)), np.maximum(sizes - window + 1, 0))] = True
    shared = common_prefixes(raw, sa, window)
    phi = np.full(len(text), -1)
    phi[sa[1:]] = sa[:-1]
    hit = np.flatnonzero((shared >= window) & fits & (phi >= 0))
    hit = hit[fits[phi[hit]]]
    out = np.zeros(len(text), bool)
    out[hit] = True
    out[phi[hit]] = True
    return out[place]


def _shard(t: pa.Table, window: int) -> pa.Table:
    """Of one shard's segments or one bucket's windows: which windows repeat, packed, for each piece."""
    c = t.to_pydict()
    kind = c["kind"][0]
    if kind == 1:
        windows = [unpack(x).astype(np.int64) for x in c["b"]]
        sizes = np.concatenate(windows) + window - 1
        data, twice, grams, h = (np.concatenate([read(x) for x in c[k]]) for k, read in (("a", unpack), ("c", unpack), ("d", unpack_sorted), ("e", unpack)))
        begin = np.cumsum(sizes) - sizes
        order = np.lexsort((sizes, h, grams))
        lead = np.ones(len(order), bool)
        lead[1:] = (grams[order][1:] != grams[order][:-1]) | (h[order][1:] != h[order][:-1]) | (sizes[order][1:] != sizes[order][:-1])
        same = np.flatnonzero(~lead)
        lead[same[_differ(data, begin[order[same]], begin[order[lead][np.cumsum(lead) - 1][same]], sizes[order[same]])]] = True
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(lead) - 1
        whole = np.bincount(which) + np.bincount(which, twice) > 1  # segments that repeat as they are
        own = order[lead]  # of equal segments one
        flags = np.repeat(whole[which], sizes)
        # one suffix array at a time, over whole grams, of those with different segments
        fresh = np.append(np.flatnonzero(np.append(True, np.diff(grams[own]) != 0)), len(own))
        several = np.flatnonzero(np.diff(fresh) > 1)
        weight = np.add.reduceat(sizes[own], fresh[:-1])[several]
        filled = np.append(0, np.cumsum(weight))
        lo = 0
        while lo < len(several):
            hi = max(lo + 1, int(np.searchsorted(filled, filled[lo] + SHARD_BYTES, side="right")) - 1)
            some = own[flat(fresh[several[lo:hi]], np.diff(fresh)[several[lo:hi]])]
            at = flat(begin[some], sizes[some])
            flags[at] |= repeated_windows(data[at], sizes[some], window)
            lo = hi
        begin = begin[own[which]]  # equal segments' answers are one
        at, told = 0, []
        for w in windows:
            told.append(np.packbits(flags[flat(begin[at : at + len(w)], w)]).tobytes())
            at += len(w)
    else:
        one, two, twice = [unpack_sorted(x) for x in c["a"]], [unpack(x) for x in c["b"]], [unpack(x) for x in c["c"]]
        cut = np.cumsum([len(x) for x in one])[:-1]
        _, _, at, n = _distinct(np.concatenate(one), np.concatenate(two))
        n = n + np.bincount(at, np.concatenate(twice)).astype(np.int64)
        told = [np.packbits(x).tobytes() for x in np.split(n[at] > 1, cut)]
    return pa.table({"piece": pa.array(c["piece"], pa.int64()), "bucket": pa.array(c["bucket"], pa.int32()), "kind": pa.array(c["kind"], pa.int32()), "told": pa.array(told, pa.binary())})


def _finish(many: int, window: int, with_text: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row, told = left.to_pylist()[0], right.to_pylist()
        start, windows, rank = unpack_sorted(row["start"]).astype(np.int64), unpack(row["windows"]).astype(np.int64), unpack(row["rank"]).astype(np.int64)
        data, lengths = unpack(row["text"]), unpack(row["lengths"])
        code, first = _codes(told, rank)
        hit = np.zeros(len(data) + 1, bool)
        whole = np.flatnonzero(unpack(row["twice"])[rank])  # twice within the piece, by their bytes
        hit[flat(start[whole], windows[whole])] = True
        go, edge = _asked(code, first, rank, unpack_sorted(row["grams"]), many)
        far = np.flatnonzero(code & SPREAD)
        one, _, inverse, _ = _distinct(*_window_hashes(data, start[far], windows[far], window))
        flags, spread = np.zeros(len(one), bool), bucket_of(one, many)
        for x in told:
            if x["kind"] == 1:
                seg = go[edge[x["bucket"]] : edge[x["bucket"] + 1]]
                at = flat(start[seg], windows[seg])
                hit[at] |= np.unpackbits(np.frombuffer(x["told"], np.uint8), count=len(at)).view(bool)
            elif x["kind"] == 2:
                a, b = spread[x["bucket"]], spread[x["bucket"] + 1]
                flags[a:b] = np.unpackbits(np.frombuffer(x["told"], np.uint8), count=int(b - a)).view(bool)
        at = flat(start[far], windows[far])
        hit[at] |= flags[inverse]
        n = len(data)
        total = np.zeros(n + 1, np.int64)
        np.cumsum(hit[:n], out=total[1:])
        gone = total[1:] > total[np.maximum(np.arange(n) + 1 - window, 0)]
        ends = np.cumsum(lengths)
        begins = ends - lengths
        fresh = gone.copy()
        fresh[1:] &= ~gone[:-1]
        real = begins[lengths > 0]
        fresh[real] = gone[real]
        sums = []
        for x in (gone, fresh, ~gone):
            np.cumsum(x, out=total[1:])
            sums.append((total[begins], total[ends]))
        kept = sums.pop()
        left_over = data[~gone].tobytes()
        texts = [left_over[a:b] for a, b in zip(kept[0].tolist(), kept[1].tolist())]
        cols = [pa.array(unpack(row["ids"]), mask=~unpack(row["has_id"])), pa.array(lengths), *(pa.array(b - a) for a, b in sums), pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())]
        return pa.table(cols + [pa.array(texts, pa.binary())] * with_text, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text)

    return run


def dedup(docs: DataFrame, window: int = 200, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, and with_text also the kept bytes, of every row."""
    if window < 2 * GRAM:
        raise ValueError(f"windows of {2 * GRAM} bytes at least")
    table = pieces(docs, _piece(window), PIECE_SCHEMA, "pieces", text_columns(id_col, text_col))
    total = table.agg(F.sum(F.octet_length("text")), F.sum("n_segments")).first()
    many = max(8, math.ceil(max(total[0] or 0, 40 * (total[1] or 0)) / BUCKET_BYTES))
    key = dealt(docs.sparkSession, many)
    asked = table.select("piece", "grams", "segments", "twice", *NEAR).mapInArrow(_ask(many, key), "deal int, bucket int, piece bigint, grams binary, segments binary, twice binary, " + ", ".join(f"{x} binary" for x in NEAR))
    told = written(asked.repartition(many, "deal").groupBy("deal").applyInArrow(lambda t: _tell(t, hot), "piece bigint, bucket int, kind int, told binary"), "told")
    body = table.select("piece", "ids", "has_id", "lengths", "text", "start", "windows", "rank", "grams", "twice")
    sent = table.select("piece", "text", "start", "windows", "rank", "grams", "segments", "twice").groupBy("piece").cogroup(told.groupBy("piece")).applyInArrow(_split(many, window, key), "deal int, kind int, bucket int, piece bigint, a binary, b binary, c binary, d binary, e binary")
    # a given number of partitions is not merged into few tasks, whose work is more than their bytes tell
    found = sent.repartition(many, "deal").groupBy("deal", "kind").applyInArrow(lambda t: _shard(t, window), "piece bigint, bucket int, kind int, told binary")
    answers = told.unionByName(written(found, "found"))
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_text
    return body.groupBy("piece").cogroup(answers.groupBy("piece")).applyInArrow(_finish(many, window, with_text), schema)
