"""Conversation structure repair (operator 12): the cheapest edits that make roles alternate, as shortest paths by Dial's bucket queue.

Roles must read, by their initials, `(s?(ua)+)?`. A node is a place between rows and a state of that pattern; an edit is
an arc of cost 0 to 4: keeping a row, giving it another role, deleting it, inserting an empty one. Distances to the end
are recorded by a bucket queue that turns round a few buckets, as costs are small integers; then tight arcs are walked
from the start, always the one whose letter comes first, which gives the ASCII-least of the cheapest audits.

Rows are ordered over all tasks by conversation and turn (nulls first; rows of one turn by role, the text's beginning and
its hash), so that a conversation is a run of neighbouring rows. A run that ends within its task is repaired there. What
may go on in another task, or is longer than a chunk, is repaired in chunks: each tells its costs from state to state,
which are put together backwards to distances at its end; from these, what state it leaves in for each one it is entered
in, put together forwards; then its own edits. Only a conversation's digest is made of its chunks one after the other,
and of one chunk at a time, as SHA-256 asks for. So no conversation need fit a task, whatever its length.

Nulls in any column count as one space, a null turn as one of its own that gaps don't count; a null conv_id is a
conversation. Repeated rows are duplicates. An empty table gives no rows; texts are read whole; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Fixed values of the contract: costs of edits, and the pattern's states by the initials that they take.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
NAMES = {"u": "user", "a": "assistant"}
FULL = re.compile("[^\x20\x09-\x0d]")
STATES = len(NEXT)
BACK = tuple(tuple((p, x) for p in range(STATES) for x, to in NEXT[p].items() if to == q) for q in range(STATES))
FAR = 1 << 60
#: A chunk has so many rows, or characters, at most (but one row at least).
CHUNK_ROWS, CHUNK_CHARS = 1 << 16, 16 << 20
OUT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
PARTS = "conv_id bigint, chunk bigint, turns array<bigint>, roles array<string>, texts array<string>"


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and n, how often the row stands there (0: not), of each row."""
    conv, turn = F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint")
    key = F.concat_ws(":", F.coalesce(conv.cast("string"), F.lit(" ")), F.coalesce(turn.cast("string"), F.lit(" ")))
    raw = rows.select(conv.alias("conv_id"), turn.alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), (F.crc32(key) % 20).alias("k"))
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return raw.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), F.when(F.col("k") == 0, "").otherwise(text).alias("text"), F.when(F.col("k") == 0, 0).when(F.col("k") == 3, 2).otherwise(1).alias("n"))


def ordered(rows: DataFrame) -> DataFrame:
    """The rows by conversation and turn over all tasks; those that are alike in all are spread by a salt, as their order is of no matter."""
    keyed = rows.withColumns({"head": F.left("text", F.lit(100)), "h": F.xxhash64("text"), "salt": F.monotonically_increasing_id() % 1024})
    by = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "head", "h", "salt"]
    return keyed.repartitionByRange(*by).sortWithinPartitions(*by).select("conv_id", "turn", "role", "text", "n")


def faults(roles: list[str], texts: list[str], before: set[int] = frozenset()) -> list[str]:
    """Each row's first fault (b, d, t or none), where `before` has the rows whose like stands in an earlier chunk."""
    seen, out = set(), []
    for k, row in enumerate(zip(roles, texts)):
        full = FULL.search(row[1])
        again = row in seen or k in before
        seen.add(row)
        out.append("b" if not full else "d" if again else "t" if row[1].rstrip("\x20\x09\x0a\x0b\x0c\x0d")[-1] not in ".!?" else "")
    return out


def distances(initials: list[str], found: list[str], ends: list[int]) -> list[int]:
    """Of each node, STATES to a place: the cost of the cheapest edits to the end of the rows, where ends has each state's cost from there."""
    dist = [FAR] * (STATES * (len(initials) + 1))
    top = STATES * len(initials)
    low = min(ends)
    size = 1 + max([REROLE + TRUNCATED, DELETE, *(e - low for e in ends if e < FAR)])
    buckets: list[list[int]] = [[] for _ in range(size)]
    waiting = 0
    for q, e in enumerate(ends):
        if e < FAR:
            dist[top + q] = e
            buckets[e % size].append(top + q)
            waiting += 1
    now = low
    while waiting:
        bucket = buckets[now % size]
        while bucket:
            node = bucket.pop()
            waiting -= 1
            if dist[node] != now:
                continue  # stale: it was reached at less
            at, q = divmod(node, STATES)
            arcs = [(at * STATES + p, INSERT) for p, x in BACK[q] if x in NAMES]
            if at:
                back, fault = (at - 1) * STATES, found[at - 1]
                arcs.append((back + q, DELETE))
                if fault not in ("b", "d"):
                    more = TRUNCATED * (fault == "t")
                    arcs += [(back + p, KEEP + more) for p, x in BACK[q] if x == initials[at - 1]]
                    arcs += [(back + p, REROLE + more) for p, x in BACK[q] if x in NAMES]
            for to, cost in arcs:
                if now + cost < dist[to]:
                    dist[to] = now + cost
                    buckets[(now + cost) % size].append(to)
                    waiting += 1
        now += 1
    return dist


def walk(roles: list[str], texts: list[str], found: list[str], dist: list[int], ends: list[int], q: int) -> tuple[str, list[str], int]:
    """The edits' letters of the first of the cheapest ways from state q, the lines that they leave, and the state at the end."""
    letters, lines, at = [], [], 0
    while True:
        d = dist[at * STATES + q]
        ins = next((x for x in NAMES if x in NEXT[q]), None)  # a state takes one of them
        if at == len(roles):
            if d == ends[q]:
                return "".join(letters), lines, q
        elif dist[(at + 1) * STATES + q] + DELETE == d:
            letters.append("D")
            at += 1
            continue
        if dist[at * STATES + NEXT[q][ins]] + INSERT == d:
            letters.append("I")
            lines.append(NAMES[ins] + ":")
            q = NEXT[q][ins]
            continue
        more = TRUNCATED * (found[at] == "t")
        kept = NEXT[q].get(roles[at][:1])
        at += 1
        if kept is not None and dist[at * STATES + kept] + KEEP + more == d:
            letters.append("K")
            lines.append(f"{roles[at - 1]}:{texts[at - 1]}")
            q = kept
        else:
            letters.append("R")
            lines.append(f"{NAMES[ins]}:{texts[at - 1]}")
            q = NEXT[q][ins]


def tallies(turns: list, roles: list[str], found: list[str]) -> dict:
    """What of a chunk can be put together with its neighbours' to a conversation's counts."""
    real = [t for t in turns if t is not None]
    x = [r[:1] for r in roles]
    return {
        "blank": found.count("b"), "duplicate": found.count("d"), "truncated": found.count("t"), "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(x, x[1:])),
        "head": x[0] if x else None, "tail": x[-1] if x else None, "least": min(real, default=None), "most": max(real, default=None), "distinct": len(set(real)),
    }


def joined(a: dict, b: dict) -> dict:
    """Tallies of a chunk and the one after it as of one."""
    out = {k: a[k] + b[k] for k in ("blank", "duplicate", "truncated", "illegal", "distinct")}
    if a["tail"] is not None and b["head"] is not None:
        out["illegal"] += a["tail"] + b["head"] not in ("su", "ua", "au")
    out["distinct"] -= a["most"] is not None and a["most"] == b["least"]
    out["head"], out["tail"] = a["head"] if a["head"] is not None else b["head"], b["tail"] if b["tail"] is not None else a["tail"]
    out["least"], out["most"] = a["least"] if a["least"] is not None else b["least"], b["most"] if b["most"] is not None else a["most"]
    return out


def gaps(t: dict) -> int:
    return 0 if t["least"] is None else t["most"] - t["least"] + 1 - t["distinct"]


LAST = [0 if q in ENDS else FAR for q in range(STATES)]


def repair(turns: list, roles: list[str], texts: list[str]) -> tuple:
    """What OUT has of a whole conversation, after its id."""
    found = faults(roles, texts)
    dist = distances([r[:1] for r in roles], found, LAST)
    audit, lines, _ = walk(roles, texts, found, dist, LAST, 0)
    t = tallies(turns, roles, found)
    return gaps(t), t["blank"], t["duplicate"], t["truncated"], t["illegal"], dist[0], audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def _runs(batches: Iterator[pa.RecordBatch], rows_most: int, chars_most: int) -> Iterator[pa.RecordBatch]:
    """Repaired conversations, and chunks of those that may go on before or after this task's rows."""
    task, seq = TaskContext.get().partitionId(), 0
    made, parts = [], []
    names = ["conv_id", "chunk", "turns", "roles", "texts", *(x.split()[0] for x in OUT.split(", ")[1:])]
    types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), *[pa.int64()] * 6, pa.string(), pa.string()]

    def out() -> pa.RecordBatch:
        rows = [(c, None, None, None, None, *x) for c, x in made] + [(*x, *[None] * 8) for x in parts]
        made.clear(), parts.clear()
        return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    conv, held, chars, edge, begun = None, ([], [], []), 0, True, False

    def chunk() -> None:
        nonlocal held, chars, seq, edge
        parts.append((conv, (task << 32) + seq, *held))
        held, chars, seq, edge = ([], [], []), 0, seq + 1, True

    for batch in batches:
        for c, turn, role, text, n in zip(*(batch.column(k).to_pylist() for k in range(5))):
            if begun and c != conv:
                if edge:
                    chunk()
                else:
                    made.append((conv, repair(*held)))
                held, chars, edge = ([], [], []), 0, False
            conv, begun = c, True
            for _ in range(n):
                for x, v in zip(held, (turn, role, text)):
                    x.append(v)
                chars += len(text)
                if len(held[0]) >= rows_most or chars >= chars_most:
                    chunk()
            if parts and n:
                yield out()
        if made or parts:
            yield out()
    if begun:
        chunk()
        yield out()


def _told(rows: Iterator[dict], make, schema: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    for r in rows:
        yield pa.record_batch([pa.array([v], t) for v, (_, t) in zip(make(r), schema)], [n for n, _ in schema])


def _each(batches) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


TALLY = "blank bigint, duplicate bigint, truncated bigint, illegal bigint, head string, tail string, least bigint, most bigint, distinct bigint"
_NAMES = [x.split()[0] for x in TALLY.split(", ")]
_TALLY = [(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in TALLY.split(", ")]
_LONGS = pa.list_(pa.int64())


def _costs(batches) -> Iterator[pa.RecordBatch]:
    """Of each chunk: the least cost from each state to each, and its tallies."""

    def make(r: dict) -> tuple:
        found = faults(r["roles"], r["texts"], set(r["again"] or ()))
        initials = [x[:1] for x in r["roles"]]
        cols = [distances(initials, found, [0 if p == q else FAR for p in range(STATES)])[:STATES] for q in range(STATES)]
        return r["conv_id"], r["chunk"], [cols[q][p] for p in range(STATES) for q in range(STATES)], *tallies(r["turns"], r["roles"], found).values()

    return _told(_each(batches), make, [("conv_id", pa.int64()), ("chunk", pa.int64()), ("costs", _LONGS), *_TALLY])


def _backwards(t: pa.Table) -> pa.Table:
    """Of one conversation's chunks: each state's cost from the chunk's end on; the first one's row has what is known of the whole."""
    rows = sorted(t.to_pylist(), key=lambda r: r["chunk"])
    ends = LAST
    for r in reversed(rows):
        r["ends"] = ends
        ends = [min(FAR, *(r["costs"][p * STATES + q] + ends[q] for q in range(STATES))) for p in range(STATES)]
    whole = {k: rows[0][k] for k in _NAMES}
    for r in rows[1:]:
        whole = joined(whole, r)
    told = [gaps(whole), whole["blank"], whole["duplicate"], whole["truncated"], whole["illegal"], ends[0]]
    first = [told, *[None] * (len(rows) - 1)]
    return pa.table([pa.array([r["chunk"] for r in rows], pa.int64()), pa.array([r["ends"] for r in rows], _LONGS), pa.array(first, _LONGS)], ["chunk", "ends", "told"])


def _ways(batches) -> Iterator[pa.RecordBatch]:
    """Of each chunk: the state that it is left in, for each one that it is entered in."""

    def make(r: dict) -> tuple:
        found = faults(r["roles"], r["texts"], set(r["again"] or ()))
        dist = distances([x[:1] for x in r["roles"]], found, r["ends"])
        return r["conv_id"], r["chunk"], [walk(r["roles"], r["texts"], found, dist, r["ends"], q)[2] if dist[q] < FAR else q for q in range(STATES)]

    return _told(_each(batches), make, [("conv_id", pa.int64()), ("chunk", pa.int64()), ("ways", _LONGS)])


def _forwards(t: pa.Table) -> pa.Table:
    q, rows = 0, sorted(t.to_pylist(), key=lambda r: r["chunk"])
    entered = []
    for r in rows:
        entered.append(q)
        q = r["ways"][q]
    return pa.table([pa.array([r["chunk"] for r in rows], pa.int64()), pa.array(entered, pa.int64())], ["chunk", "entered"])


def _edits(batches) -> Iterator[pa.RecordBatch]:
    def make(r: dict) -> tuple:
        found = faults(r["roles"], r["texts"], set(r["again"] or ()))
        audit, lines, _ = walk(r["roles"], r["texts"], found, distances([x[:1] for x in r["roles"]], found, r["ends"]), r["ends"], r["entered"])
        return r["conv_id"], r["chunk"], r["told"], audit, "\n".join(lines) if lines else None

    return _told(_each(batches), make, [("conv_id", pa.int64()), ("chunk", pa.int64()), ("told", _LONGS), ("audit", pa.string()), ("lines", pa.string())])


def _digests(batches) -> Iterator[pa.RecordBatch]:
    """Conversations from their chunks, which come in order; one chunk's lines are held at a time."""
    names = [x.split()[0] for x in OUT.split(", ")]
    types = [*[pa.int64()] * 7, pa.string(), pa.string()]
    told = None

    def out() -> pa.RecordBatch:
        return pa.record_batch([pa.array([v], t) for v, t in zip((conv, *told, "".join(audit), digest.hexdigest()), types)], names)

    for r in _each(batches):
        if r["told"] is not None:  # the first chunk of a conversation
            if told:
                yield out()
            conv, told, audit, digest, any_line = r["conv_id"], r["told"], [], hashlib.sha256(), False
        audit.append(r["audit"])
        if r["lines"] is not None:
            digest.update(b"\n" * any_line + r["lines"].encode())
            any_line = True
    if told:
        yield out()


def _in_chunks(chunks: DataFrame) -> DataFrame:
    """OUT of conversations whose chunks (PARTS) are in several tasks, or several to a task."""
    # where the like of a row stands in an earlier chunk: by digests, one of each to a chunk
    row = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.char_length("r.roles").cast("string"), F.concat("r.roles", "r.texts"))
    rows = chunks.select("conv_id", "chunk", F.posexplode(F.arrays_zip("roles", "texts")).alias("at", "r")).select("chunk", "at", F.sha2(row, 256).alias("d"))
    firsts = rows.groupBy("d", "chunk").agg(F.min("at").alias("at"))
    least = firsts.groupBy("d").agg(F.min("chunk").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = firsts.join(least, "d").where("chunk > first").groupBy("chunk").agg(F.collect_list("at").alias("again"))  # at most a chunk's rows
    body = written(chunks.join(again, "chunk", "left"), "chunks")
    costs = body.mapInArrow(_costs, f"conv_id bigint, chunk bigint, costs array<bigint>, {TALLY}")
    ends = written(costs.groupBy("conv_id").applyInArrow(_backwards, "chunk bigint, ends array<bigint>, told array<bigint>"), "ends")
    body = body.join(ends, "chunk")
    entered = written(body.mapInArrow(_ways, "conv_id bigint, chunk bigint, ways array<bigint>").groupBy("conv_id").applyInArrow(_forwards, "chunk bigint, entered bigint"), "entered")
    edits = body.join(entered, "chunk").mapInArrow(_edits, "conv_id bigint, chunk bigint, told array<bigint>, audit string, lines string")
    by = [F.asc_nulls_first("conv_id"), "chunk"]
    return edits.repartition("conv_id").sortWithinPartitions(*by).mapInArrow(_digests, OUT)


def repaired(rows: DataFrame, rows_most: int = CHUNK_ROWS, chars_most: int = CHUNK_CHARS) -> DataFrame:
    """OUT of every conversation of rows of damage()."""
    names = [x.split()[0] for x in OUT.split(", ")]
    runs = written(ordered(rows).mapInArrow(lambda b: _runs(b, rows_most, chars_most), f"{PARTS}, {OUT.partition(', ')[2]}"), "runs")
    done = runs.where("chunk IS NULL").select(*names)
    return done.unionByName(_in_chunks(runs.where("chunk IS NOT NULL").select(*(x.split()[0] for x in PARTS.split(", ")))))
