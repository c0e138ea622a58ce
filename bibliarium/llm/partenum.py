"""N-gram Jaccard join (operator 9): PartEnum signatures, exact comparison within candidate families, components.

A document's set holds its distinct word n-grams (ASCII letters in lower case; of fewer words, the whole sequence). At a
threshold t, sets that link differ in size by a factor t at most, so sizes are cut into bands of that ratio; sets meet
under the tag of their own band and under that of each pair of neighbouring bands. Two linked sets under a tag differ
in at most k features. PartEnum deals the features to parts, of which some then hold at most one difference, and each
part to three cells; one of the three choices of two cells is thus equal in both sets, and its hash is a signature.

A choice without features says nothing, and would bring unrelated documents together: it is never told. With `extra`
more parts than needed, linked sets agree in a choice that has features as long as one of them has no more than `extra`
thin parts (with an empty choice). A set with more thin parts tells its signatures of another dealing as well, and so
on until a dealing suits it; the first that suits either of two linked sets is told by both, so no link is lost. Sets
that no dealing of ROUNDS suits (hardly any at 80 % and more; many below 75 %) tell the empty choices of the last one.
Features that many documents have (a license line) are left out of the first dealing, which they would fill with
chance signatures: sets differ no more without them, whichever they are.

Equal sets are one node. Each task finds the components of its own signatures and hands on each signature once, with
its component, so a signature that a third of all documents share reaches its bucket once for each task; buckets hand
on forests. Components of those links are families; large ones are taken apart by sketches, cell counts whose
difference bounds that of the sets from below. Families are compared exactly, in square pieces of bounded size, whose
results are forests and link counts instead of pairs.

Null, empty and wordless texts have no set and link with nothing. Rows that repeat an id are one node; null ids have no
component. An empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, MULT, U64, Block, blocks, bucket_of, dealt, free, grams, labels, mix, narrow, pack, pack_sorted, ranges, slices, span_hash, unpack, unpack_sorted, unused, written
from .components import components

#: Signatures that a task gathers before it hands them on, and those of a bucket (8 bytes each, before compression).
FLUSH, BUCKET = 3_000_000, 2_000_000
#: Dealings that a set tries before it tells empty choices.
ROUNDS = 16
#: Bytes of text in a window; the part of its documents in which a frequent feature stands; how many of those are left out at most.
WINDOW_BYTES, FREQUENT, MOST_FREQUENT = 16 << 20, 0.003, 200_000
#: Sets in each side of a square of comparisons, from small families to large ones, and features in them; keys that a large family's sets are dealt to.
SIDE, MOST_SIDE, SIDE_FEATURES, SALTS = 256, 1024, 4_000_000, 32
CHOICES = ((1, 2), (0, 2), (0, 1))


def sets(b: Block, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all documents, ascending within each; where each document's begin; hashes of each whole set (two, in columns)."""
    start, end, first = b.words()
    h = span_hash(b.prefix(LOWER), start, end)
    count = np.diff(first)
    at, of = ranges(first[:-1], np.maximum(first[:-1], first[1:] - n + 1))
    g = grams(h, n)[at] if len(at) else np.zeros(0, np.uint64)
    few = np.flatnonzero((count > 0) & (count < n))
    whole = np.zeros(len(few), np.uint64)
    for k in range(n - 1):
        has = count[few] > k
        whole[has] += h[first[few][has] + k] * MULT[k + 20]
    g, of = np.concatenate([g, mix(whole + count[few].astype(np.uint64))]), np.concatenate([of, few])
    order = np.argsort(g)
    order = order[np.argsort(of[order].astype(np.int32), kind="stable")]
    g, of = g[order], of[order]
    keep = np.ones(len(g), bool)
    keep[1:] = (g[1:] != g[:-1]) | (of[1:] != of[:-1])
    g, of = g[keep], of[keep]
    begin = np.searchsorted(of, np.arange(len(b) + 1))
    both = np.zeros((len(b), 2), np.uint64)
    full = np.flatnonzero(np.diff(begin))
    if len(full):
        for k in range(2):
            both[full, k] = np.add.reduceat(mix(g * MULT[40 + k] + MULT[42 + k]), begin[full])
    return g, begin, both


def _thin(features: float, parts: int) -> float:
    """Part of the parts that have an empty choice, when so many features are dealt to them."""
    x = math.exp(-features / parts / 3)
    return 3 * x * x * (1 - x) + x**3


def _suits(parts: int, thin: float, extra: int) -> float:
    """Probability that no more than extra of the parts are thin (normal approximation)."""
    spread = math.sqrt(max(parts * thin * (1 - thin), 1e-9))
    return 0.5 * (1 + math.erf((extra + 0.5 - parts * thin) / spread / math.sqrt(2)))


class Bands:
    """Bands of set sizes at a threshold of percent / 100, up to sizes of 2**bits.

    least, most: sizes of a band. parts, extra: by tag (0: both sets in the band, 1: one in the next) and band; the
    least `extra` with which a dealing suits four of ten sets of the least size.
    """

    def __init__(self, percent: int, bits: int):
        self.least, self.most = [1], [100 // percent]
        while len(self.most) < 3 or self.most[-3] < 1 << bits:
            self.least.append(self.most[-1] + 1)
            self.most.append(self.least[-1] * 100 // percent)
        self.parts, self.extra = (np.zeros((2, len(self.least)), np.int64) for _ in range(2))
        for ahead in (0, 1):
            for i, (least, most) in enumerate(zip(self.least[: len(self.least) - 1], self.most)):
                smallest = max(least, -(-percent * self.least[i + ahead] // 100))
                differ = (100 - percent) * (most + min(self.most[i + ahead], most * 100 // percent)) // (100 + percent)
                if smallest > most or not differ:
                    continue  # no such pair, or equal sets only
                need = differ // 2 + 1
                likely = [(_suits(need + e, _thin(smallest, need + e), e), e) for e in dict.fromkeys((np.geomspace(1, max(need, 2) + 1, 60) - 1).astype(int).tolist())]
                best = next((e for p, e in likely if p >= 0.4), max(likely, key=lambda x: (x[0], -x[1]))[1])
                self.parts[ahead, i], self.extra[ahead, i] = need + best, best
        self.least, self.most = np.array(self.least), np.array(self.most)


bands = lru_cache(64)(Bands)


def signatures(g: np.ndarray, begin: np.ndarray, percent: int, frequent: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of each set, the set that each is of, and which sets tell empty choices. frequent: features (ascending) that the first dealing leaves out."""
    size = np.diff(begin)
    b = bands(percent, int(size.max(initial=1)).bit_length())
    own = np.searchsorted(b.most, np.maximum(size, 1))
    every = np.repeat(np.arange(len(size)), size)
    rare = np.ones(len(g), bool)
    if frequent is not None and len(frequent):
        rare = frequent[np.minimum(np.searchsorted(frequent, g), len(frequent) - 1)] != g
    out, docs, tells = [], [], np.zeros(len(size), bool)
    for ahead, upper in ((0, False), (1, False), (1, True)):
        band = np.maximum(own - upper, 0)
        # only those whose size lets them reach a partner
        reach = size * percent <= 100 * b.most[band] if upper else size * 100 >= percent * b.least[band + ahead]
        parts, extra = np.where((size > 0) & (own >= upper) & reach, b.parts[ahead, band], 0), b.extra[ahead, band]
        code = mix((band * 2 + ahead).astype(np.uint64) * MULT[56] + MULT[50])
        for k in range(ROUNDS):
            if not parts.any():
                break
            cell = np.cumsum(parts) - parts
            live = (parts[every] > 0) & rare if k == 0 else parts[every] > 0
            of = every[live]
            f = mix(g[live] + code[of] + MULT[k])
            part = (f >> U64(24)) % parts[of].astype(np.uint64)
            at = (cell[of] + part.astype(np.int64)) * 3 + ((f & U64(0xFFFFF)) % U64(3)).astype(np.int64)
            total = int(parts.sum())
            sums, counts = np.zeros(3 * total, np.uint64), np.bincount(at, minlength=3 * total).reshape(-1, 3)
            np.add.at(sums, at, mix(f + MULT[51]))
            sums, empty = sums.reshape(-1, 3), counts == 0
            doc = np.repeat(np.arange(len(size)), parts)
            salt = mix(code[doc] + (np.arange(total) - cell[doc]).astype(np.uint64) * MULT[52])
            unsuited = (np.bincount(doc, empty.sum(1) >= 2, minlength=len(size)) > extra) & (parts > 0)
            last = unsuited if k == ROUNDS - 1 else np.zeros(len(size), bool)
            for j, (x, y) in enumerate(CHOICES):
                keep = ~(empty[:, x] & empty[:, y]) | last[doc]
                out.append(mix(sums[keep, x] * MULT[53] + sums[keep, y] * MULT[54] + salt[keep] * MULT[58 + j]))
                docs.append(doc[keep])
            tells |= last
            parts = np.where(unsuited, parts, 0)
    return (np.concatenate(out), np.concatenate(docs), tells) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64), tells)


def _groups(sig: np.ndarray, node: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending distinct signatures, a node (0..n-1) of each, and the smallest node that each node is connected with through signatures."""
    order = np.argsort(sig, kind="stable")
    sig, node = sig[order], node[order]
    lead = np.ones(len(sig), bool)
    lead[1:] = sig[1:] != sig[:-1]
    head = node[lead][np.cumsum(lead) - 1] if len(sig) else node
    far = head != node
    return sig[lead], node[lead], labels(n, head[far], node[far])


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _ids(b: Block) -> np.ndarray:
    """Which documents have an id."""
    return ~b.ids.is_null().to_numpy(zero_copy_only=False)


def _frequent(held: list[np.ndarray], documents: int) -> np.ndarray:
    """Features that stand in many of a window's documents, and how many; each document's are distinct."""
    g = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint64)
    at = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
    n = np.diff(np.append(at, len(g)))
    keep = n >= max(8, math.ceil(FREQUENT * documents))
    return np.stack([g[at[keep]].view(np.int64), n[keep]])


def sizes(docs: DataFrame, n: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, the set's two hashes and its sketch; besides, rows without n_shingles: a feature that is frequent in some window (h1), and in how many documents (h2)."""
    names = ["doc_id", "n_shingles", "h1", "h2", "sketch"]

    def window(held: list[np.ndarray], documents: int) -> pa.RecordBatch:
        feature, count = _frequent(held, documents)
        none = pa.nulls(len(feature), pa.int64())
        return pa.record_batch([none, none, pa.array(feature), pa.array(count), pa.nulls(len(feature), pa.binary())], names)

    def run(batches):
        held, documents, read = [], 0, 0
        for b in blocks(batches):
            g, begin, both = sets(b, n)
            yield pa.record_batch([b.ids, pa.array(np.diff(begin)), pa.array(both[:, 0].copy().view(np.int64)), pa.array(both[:, 1].copy().view(np.int64)), pa.array(sketches(g, begin), pa.binary())], names)
            once = np.unique(both[:, 0], return_index=True)[1]  # equal sets count once
            held.append(g[ranges(begin[once], begin[once + 1])[0]])
            documents, read = documents + len(once), read + len(b.data)
            if read > WINDOW_BYTES:
                yield window(held, documents)
                held, documents, read = [], 0, 0
        if held:
            yield window(held, documents)

    return _own(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint, sketch binary")


def sketches(g: np.ndarray, begin: np.ndarray) -> list[bytes]:
    """How many features of each set fall into each of a power of two of cells, about one for four features.

    The counts of two sets differ, summed over cells, by no more than the sets do. Half as many cells are the sums of both halves.
    """
    size = np.diff(begin)
    cells = 1 << np.ceil(np.log2(np.maximum(size / 4, 16))).astype(np.int64)
    at = np.cumsum(cells) - cells
    of = np.repeat(np.arange(len(size)), size)
    counts = np.minimum(np.bincount(at[of] + (mix(g + MULT[59]) & (cells[of] - 1).astype(np.uint64)).astype(np.int64), minlength=int(cells.sum())), 255).astype(np.uint8)
    return [counts[a : a + n].tobytes() for a, n in zip(at.tolist(), cells.tolist())]


def _diagonal(t: pa.Table) -> bool | None:
    """Whether a square compares a piece with itself; None if it is of two pieces one of which is empty, so that there is nothing to compare."""
    if t.column("i")[0] == t.column("j")[0]:
        return True
    side = t.column("side").to_numpy()
    return False if (side != side[0]).any() else None


def _none(*names: str) -> pa.Table:
    return pa.table({c: pa.array([], pa.int64()) for c in names})


def _sift(t: pa.Table, percent: int) -> pa.Table:
    """Of a square's sketches: (node, parent), a forest of the pairs that their sketches and sizes let link."""
    diagonal = _diagonal(t)
    if diagonal is None:
        return _none("a", "b")
    t = t.sort_by("n_shingles")
    node, side, size = (t.column(c).to_numpy() for c in ("node", "side", "n_shingles"))
    raw = [np.frombuffer(x, np.uint8).astype(np.int16) for x in t.column("sketch").to_pylist()]
    cells = np.array([len(x) for x in raw])
    links = [np.zeros((2, 0), np.int64)]
    for c in np.unique(cells).tolist():
        # sets of this many cells, with those of the same and of twice as many
        some = np.flatnonzero((cells == c) | (cells == 2 * c))
        x = np.stack([raw[k] if cells[k] == c else raw[k].reshape(2, c).sum(0, dtype=np.int16) for k in some.tolist()])
        own = np.flatnonzero(cells[some] == c)
        lo = own.min(initial=0)
        while lo <= own.max(initial=-1):
            far = int(np.searchsorted(size[some], size[some][lo] * 100 // percent, side="right"))
            step = max(1, (4 << 20) // max((far - lo) * c, 1))
            k = min(lo + step, int(own.max()) + 1)
            far = int(np.searchsorted(size[some], size[some][k - 1] * 100 // percent, side="right"))
            apart = np.abs(x[lo:k, None, :] - x[None, lo:far, :]).sum(2, dtype=np.int32)
            most = (100 - percent) * (size[some][lo:k, None] + size[some][None, lo:far]) // (100 + percent)
            a, b = np.nonzero(apart <= most)
            a, b = some[a + lo], some[b + lo]
            keep = (a < b) & (diagonal | (side[a] != side[b]))
            links.append(np.stack([a[keep], b[keep]]))
            lo = k
    top = labels(len(node), *np.concatenate(links, axis=1))
    keep = top != np.arange(len(node))
    return pa.table({"a": node[keep], "b": node[top[keep]]})


def candidates(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", frequent: np.ndarray | None = None, many: int = 8) -> DataFrame:
    """(a, b): links of sets, named by their first hash, that connect those which share a signature; pairs may repeat. many: buckets of signatures."""
    key = dealt(docs.sparkSession, many).tolist()
    schema = "bucket int, sigs binary, which binary, nodes binary, a binary, b binary"

    def emit(batches) -> Iterator[pa.RecordBatch]:
        seen, held, size = np.zeros(0, np.uint64), [], 0

        def flush():
            sig, node, top = _groups(np.concatenate([s for s, _ in held]), np.concatenate([d for _, d in held]), len(seen))
            node, edge = top[node], bucket_of(sig, many)
            child = np.flatnonzero(top != np.arange(len(top)))
            share = np.linspace(0, len(child), many + 1).astype(np.int64)
            rows = []
            for k, (lo, hi, x, y) in enumerate(zip(edge.tolist(), edge[1:].tolist(), share.tolist(), share[1:].tolist())):
                if hi > lo or y > x:
                    few, which = np.unique(node[lo:hi], return_inverse=True)
                    rows.append((key[k], pack_sorted(sig[lo:hi]), pack(narrow(which)), pack(seen[few]), pack(seen[child[x:y]]), pack(seen[top[child[x:y]]])))
            return pa.record_batch([pa.array([r[k] for r in rows], pa.binary() if k else pa.int32()) for k in range(6)], ["bucket", "sigs", "which", "nodes", "a", "b"])

        for block in blocks(batches):
            g, begin, both = sets(block, n)
            new = _fresh(both[:, 0], _ids(block) & (np.diff(begin) > 0), seen)  # equal sets tell once
            at, _ = ranges(begin[new], begin[new + 1])
            sig, doc, _ = signatures(g[at], np.concatenate([[0], np.cumsum(begin[new + 1] - begin[new])]), percent, frequent)
            held.append((sig, doc + len(seen)))
            seen, size = np.concatenate([seen, both[new, 0]]), size + len(sig)
            if size > FLUSH:
                yield flush()
                seen, held, size = np.zeros(0, np.uint64), [], 0
        if size:
            yield flush()

    def meet(t: pa.Table) -> pa.Table:
        sigs, which, nodes, a, b = ([unpack_sorted(x) if k == 1 else unpack(x) for x in t.column(k).to_pylist()] for k in range(1, 6))
        node = np.concatenate([x[w] for x, w in zip(nodes, which)])
        names, node = np.unique(node, return_inverse=True)
        _, _, top = _groups(np.concatenate(sigs), node, len(names))
        child = np.flatnonzero(top != np.arange(len(top)))
        return pa.table({"a": np.concatenate([names[child], *a]).view(np.int64), "b": np.concatenate([names[top[child]], *b]).view(np.int64)})

    rows = _own(docs, id_col, text_col).mapInArrow(emit, schema)
    return rows.repartition(many, "bucket").groupBy("bucket").applyInArrow(meet, "a bigint, b bigint")  # tasks follow the data


def _fresh(h: np.ndarray, real: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The first of each set hash, among rows that are real, that is not among those seen."""
    some = np.flatnonzero(real)
    some = some[np.unique(h[some], return_index=True)[1]]
    return some[~np.isin(h[some], seen)]


def overlaps(g: np.ndarray, begin: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets of two lists, as a matrix; features go through it a tile at a time."""
    _, code = np.unique(g, return_inverse=True)
    code = code.astype(np.int64)
    freq = np.bincount(code)
    of = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    shared = freq[code] > 1
    rank = np.cumsum(freq > 1) - 1
    code, of = rank[code[shared]], of[shared]
    order = np.argsort(code, kind="stable")
    code, of = code[order], of[order]
    out = np.zeros((len(left), len(right)), np.float32)
    tile = 4096
    width = int(code[-1]) + 1 if len(code) else 0
    for lo in range(0, width, tile):
        x, y = np.searchsorted(code, [lo, lo + tile])
        dense = np.zeros((len(begin) - 1, min(tile, width - lo)), np.float32)
        dense[of[x:y], code[x:y] - lo] = 1
        out += dense[left] @ dense[right].T
    return np.rint(out).astype(np.int64)


def _compare(t: pa.Table, percent: int) -> pa.Table:
    """Of a square's sets: (node, first_id, parent, links): a forest of the links found, between first ids, and how many documents each set links with."""
    diagonal = _diagonal(t)
    if diagonal is None:
        return _none("node", "first_id", "parent", "links")
    t = t.take(np.sort(np.unique(t.column("node").to_numpy(), return_index=True)[1]))  # rows that repeat an id and its text are one
    node, first, side, weight = (t.column(c).to_numpy() for c in ("node", "first_id", "side", "weight"))
    packed = [unpack(x) for x in t.column("features").to_pylist()]
    size = np.array([len(x) for x in packed])
    g, begin = np.concatenate(packed), np.concatenate([[0], np.cumsum(size)])
    left = np.flatnonzero(side == side.min())
    right = left if diagonal else np.flatnonzero(side == side.max())
    common = overlaps(g, begin, left, right)
    linked = 100 * common >= percent * (size[left][:, None] + size[right][None, :] - common)
    linked &= common > 0
    if diagonal:
        np.fill_diagonal(linked, False)
    links = np.zeros(len(node), np.int64)
    links[left] += linked @ weight[right]
    if not diagonal:
        links[right] += linked.T @ weight[left]
    i, j = np.nonzero(linked)
    top = labels(len(node), left[i], right[j])
    keep = links > 0
    return pa.table({"node": node[keep], "first_id": first[keep], "parent": first[top[keep]], "links": links[keep]})


def join(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and n_links (other documents whose sets link with the document's) of every row."""
    table = written(sizes(docs, n, id_col, text_col), "sizes")  # read below without the sketches but where they are named
    own = table.where("n_shingles IS NOT NULL")
    often = table.where("n_shingles IS NULL").groupBy("h1").agg(F.sum("h2").alias("n")).orderBy(F.desc("n"), "h1").limit(MOST_FREQUENT)
    frequent = np.sort(np.array([r["h1"] for r in often.select("h1").collect()], np.int64).view(np.uint64))  # at most MOST_FREQUENT numbers
    full = own.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = full.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("weight"), F.max("n_shingles").alias("n_shingles"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # numbers that stay, once written
    n_signatures = 1.4 * (classes.agg(F.sum("n_shingles")).first()[0] or 0)  # about, at 80 %
    many = math.ceil(max(8, n_signatures / BUCKET, min(64, 8 * n_signatures / BUCKET)))
    families = components(candidates(docs, n, percent, id_col, text_col, frequent, many))
    members = classes.join(families.select(F.col("node").alias("h1"), "component"), "h1")

    def squared(members: DataFrame) -> DataFrame:
        """Sets with their family's number of pieces, so many that a piece has about SIDE to MOST_SIDE sets and SIDE_FEATURES features at most, and their own piece."""
        side = F.least(F.greatest(F.count("*") / 16, F.lit(float(SIDE))), F.lit(float(max(SIDE, MOST_SIDE))))
        pieces = members.groupBy("component").agg(F.ceil(F.greatest(F.count("*") / side, F.sum("n_shingles") / SIDE_FEATURES)).cast("int").alias("pieces")).where("pieces > 1")
        # a large family's members meet its number of pieces under SALTS keys
        pieces = pieces.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = members.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(pieces, ["component", "salt"], "left").drop("salt").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
        return out.withColumn("piece", F.pmod(F.xxhash64("node", F.lit(1)), F.col("pieces")).cast("int"))

    # chance signatures chain families together: large ones are taken apart by sketches, which are small, before sets travel
    first = written(squared(members), "families")
    sketch = own.select("h1", "h2", F.col("doc_id").alias("first_id"), "sketch")
    large = first.where("pieces > 1").join(sketch, ["first_id", "h1", "h2"]).dropDuplicates(["node"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    large = large.select("component", F.least("piece", "other").alias("i"), F.greatest("piece", "other").alias("j"), F.col("piece").alias("side"), "node", "n_shingles", "sketch")
    sifted = components(large.groupBy("component", "i", "j").applyInArrow(lambda t: _sift(t, percent), "a bigint, b bigint"))
    apart = first.where("pieces > 1").drop("component", "pieces", "piece").join(sifted, "node")
    light = written(first.where("pieces = 1").select("node", "h1", "h2", "first_id", "weight", "component", "pieces", "piece").unionByName(squared(apart).select("node", "h1", "h2", "first_id", "weight", "component", "pieces", "piece")), "light")
    free(first, families, sifted)

    def features(batches):
        for batch in slices(batches):
            g, begin, both = sets(Block(batch), n)
            h1, h2, component, node, weight, count, piece = (batch.column(k).to_numpy() for k in range(2, 9))
            mine = np.flatnonzero((both[:, 0].copy().view(np.int64) == h1) & (both[:, 1].copy().view(np.int64) == h2))
            other, of = ranges(np.zeros(len(mine), np.int64), count[mine].astype(np.int64))
            of = mine[of]
            packed = {int(k): pack(g[begin[k] : begin[k + 1]]) for k in mine}
            cols = [component[of], np.minimum(piece[of], other), np.maximum(piece[of], other), piece[of], node[of], batch.column(0).to_numpy()[of], weight[of]]
            yield pa.record_batch([*(pa.array(c.astype(np.int64)) for c in cols), pa.array([packed[int(k)] for k in of], pa.binary())], ["component", "i", "j", "side", "node", "first_id", "weight", "features"])

    named = light.select(F.col("first_id").alias("doc_id"), "h1", "h2", "component", "node", "weight", "pieces", "piece")
    # by a shuffle at every size, here and in one_of_each(): a broadcast that only small tables allow would hide what large ones cost
    rows = _own(docs, id_col, text_col).join(named.hint("merge"), "doc_id").mapInArrow(features, "component bigint, i bigint, j bigint, side bigint, node bigint, first_id bigint, weight bigint, features binary")
    found = written(rows.groupBy("component", "i", "j").applyInArrow(lambda t: _compare(t, percent), "node bigint, first_id bigint, parent bigint, links bigint"), "found")
    free(light)
    # sets are connected through their first ids, which are one node where an id has several texts; so are the other ids that have
    several = full.groupBy("doc_id").agg(*(f(c).alias(f"{c}_{k}") for c in ("h1", "h2") for k, f in enumerate((F.min, F.max)))).where("h1_0 <> h1_1 OR h2_0 <> h2_1").select("doc_id")
    repeats = full.select("doc_id", "h1", "h2").join(several, "doc_id").join(classes, ["h1", "h2"]).select(F.col("first_id").alias("a"), F.col("doc_id").alias("b"))
    groups = components(found.select(F.col("first_id").alias("a"), F.col("parent").alias("b")).unionByName(repeats)).withColumnRenamed("node", "first_id")
    result = classes.join(groups, "first_id", "left").join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
    result = result.select("h1", "h2", F.coalesce("component", "first_id").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = own.select("doc_id", "n_shingles", "h1", "h2").join(result, ["h1", "h2"], "left")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return out.select("doc_id", "n_shingles", F.when(linked, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"), F.when(linked, F.col("n_links")).otherwise(F.lit(0)).alias("n_links"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but one document of each component: the one whose id is the component's (of rows that repeat that id, the first by text).

    Documents without a set, or without an id, stay. The columns are those of docs, whatever their names.
    """
    names = docs.columns
    gone, place = unused(names, "_drop"), unused(names, "_row")
    found = written(join(docs, n, percent, id_col, text_col), "components")
    drop = found.where("component_id <> doc_id").select(F.col("doc_id").alias(gone)).distinct()
    left = docs.join(drop.hint("merge"), F.col(id_col).cast("bigint") == F.col(gone), "left_anti")
    again = found.where("n_shingles > 0 AND component_id = doc_id").groupBy("doc_id").count().where("count > 1")
    if not again.isEmpty():
        order = Window.partitionBy(id_col).orderBy(F.col(text_col).isNull(), text_col)
        left = left.withColumn(place, F.row_number().over(order)).where(F.col(id_col).isNull() | (F.col(place) == 1) | F.coalesce(~F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(True)))
    return left.select(*(f"`{c}`" for c in names))
