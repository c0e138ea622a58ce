"""Files of quoted CSV and of JSON arrays read by many tasks, wherever the ranges of bytes that Spark deals them begin.

Spark's text reader cuts a file into ranges and a range into chunks: lines for CSV, what ends at a closing brace for JSON
(so that an array on one line is cut, too). Whether a chunk begins between quotes is not known within its range, so each
range first tells what it does to either case, as a function of the state it is entered in. A running composition of these
functions over a file's ranges, in order, gives each range its state (and, for JSON, its depth and the number of elements
before it); then every range cuts its records in parallel. A record that goes over a range's edge comes in pieces, two to
a range at most, which are put together again.

A range's function of the two states is a constant, the identity or the exchange, so the state at a range's begin is the
last constant's, exchanged as often as it was since: sums and last values over a window of one row a range.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Separators of chunks.
LINE, BRACE = "\n", "}"
_RANGE = "path string, at bigint"
PIECES = f"{_RANGE}, part int, pos bigint, text string"
#: Of a piece: a whole record; the end, or the middle, of one that began in an earlier range; the beginning of one.
WHOLE, HEAD, TAIL = 0, 1, 2


def _chunks(spark: SparkSession, path: str, separator: str) -> DataFrame:
    return spark.read.text(path, lineSep=separator).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.col("_metadata.file_size").alias("bytes"), "value")


def _ranges(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Runs of rows of one range, as ((path, at), rows); a range's rows come one after the other."""
    rows = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("path", "at", *columns))))
    return itertools.groupby(rows, key=lambda r: r[:2])


def _in_order(per_range: DataFrame) -> DataFrame:
    """per_range (path, at, f0, f1: the state after the range if it is entered outside, or between, quotes) with the state that each is entered in."""
    before = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    constant, turn = F.col("f0") == F.col("f1"), (F.col("f0") & ~F.col("f1")).cast("int")
    turned = per_range.withColumn("_t", F.sum(turn).over(Window.partitionBy("path").orderBy("at")))
    last = F.last(F.when(constant, F.struct(F.col("f0").cast("int").alias("v"), F.col("_t").alias("t"))), ignorenulls=True).over(before)
    so_far = F.coalesce(F.max("_t").over(before), F.lit(0))
    return turned.withColumn("inside", F.pmod(F.coalesce(last["v"] + so_far - last["t"], so_far), F.lit(2)) == 1).drop("_t")


def _whole(pieces: DataFrame) -> DataFrame:
    """Records of one piece, and those of several put together: (path, at, pos, text)."""
    parts = pieces.where(F.col("part") != WHOLE)
    order = Window.partitionBy("path").orderBy("at", "part").rowsBetween(Window.unboundedPreceding, 0)
    owned = parts.withColumn("_own", F.count_if(F.col("part") == TAIL).over(order))
    made = owned.groupBy("path", "_own").agg(F.sort_array(F.collect_list(F.struct("at", "part", "pos", "text"))).alias("p"))  # the pieces of one record
    made = made.select("path", F.col("p")[0]["at"].alias("at"), F.col("p")[0]["pos"].alias("pos"), F.array_join(F.col("p")["text"], "").alias("text"))
    return pieces.where(F.col("part") == WHOLE).select("path", "at", "pos", "text").unionByName(made)


# --- CSV ---
def ends_inside(line: str, inside: bool) -> bool:
    """Whether the line ends within quotes, if it begins so or not. Quotes open a cell at its beginning only; doubled, they are one of its characters."""
    at = 0
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('"', at + 1):
                at += 2
                continue
            inside = False
            at = line.find(",", at)
        elif line.startswith('"', at):
            inside = True
            at += 1
            continue
        else:
            at = line.find(",", at)
        if at < 0:
            return False
        at += 1


def _csv_functions(batches) -> Iterator[pa.RecordBatch]:
    for (path, at), rows in _ranges(batches, ["value"]):
        f = [False, True]
        for *_, line in rows:
            if '"' in line:  # else nothing changes between quotes, and nothing outside
                f = [ends_inside(line, x) for x in f] if f[0] != f[1] else [ends_inside(line, f[0])] * 2
        yield pa.record_batch([pa.array([path]), pa.array([at]), pa.array([f[0]]), pa.array([f[1]])], ["path", "at", "f0", "f1"])


def _csv_records(batches) -> Iterator[pa.RecordBatch]:
    for (path, at), rows in _ranges(batches, ["inside", "value"]):
        out: list[tuple] = []
        held, part, size, inside, done = [], WHOLE, 0, None, 0
        for *_, entered, line in rows:
            if inside is None:
                inside = entered
                part = HEAD if inside else WHOLE
            held.append(line)
            inside = ends_inside(line, inside) if '"' in line else inside
            if not inside:
                text = "\n".join(held)
                out.append((part, text))
                size += len(text)
                held, part = [], WHOLE
            if size > 4 << 20:
                yield _pieces(path, at, out, list(range(done, done + len(out))))
                out, size, done = [], 0, done + len(out)
        if held:
            # a record that goes on in the next range, or the middle of one
            out.append((TAIL if part == WHOLE else HEAD, "\n".join(held) + "\n"))
        yield _pieces(path, at, out, list(range(done, done + len(out))))


def _pieces(path: str, at: int, rows: list[tuple], pos: list[int]) -> pa.RecordBatch:
    n = len(rows)
    return pa.record_batch([pa.array([path] * n, pa.string()), pa.array([at] * n, pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array(pos, pa.int64()), pa.array([r[1] for r in rows], pa.string())], [x.split()[0] for x in PIECES.split(", ")])


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(path, at, pos, text) of each record of quoted CSV, its line breaks kept: at is where its range begins, pos its place there. Empty lines are none."""
    lines = _chunks(spark, path, LINE)
    entered = _in_order(lines.select("path", "at", "value").mapInArrow(_csv_functions, f"{_RANGE}, f0 boolean, f1 boolean"))
    given = lines.join(F.broadcast(entered.select("path", "at", "inside")), ["path", "at"]).select("path", "at", "inside", "value")  # one row a range
    records = _whole(given.mapInArrow(_csv_records, PIECES))
    text = F.regexp_replace("text", r"\n\z", "")
    # a record whose line ends with both marks has both wherever it has a line break
    text = F.when(F.endswith(text, F.lit("\r")), F.replace(F.regexp_replace(text, r"\r\z", ""), F.lit("\r\n"), F.lit("\n"))).otherwise(text)
    return records.select("path", "at", "pos", F.when(F.col("at") == 0, F.regexp_replace(text, "^\ufeff", "")).otherwise(text).alias("text")).where("text <> ''")


# --- JSON ---
_MARK = re.compile(r'["{}\[\],]')


class JsonState:
    """What is known of a place in JSON text: within a string or not, after its backslash or not, and how deep in brackets."""

    def __init__(self, inside: bool, depth: int = 0):
        self.inside, self.depth, self.escaped = inside, depth, False

    def feed(self, text: str, seen: Callable[[int, str], None] | None = None) -> None:
        """Goes over text; seen() is told place and mark of every bracket and comma outside strings, after the depth has changed."""
        at, n = 0, len(text)
        if self.escaped and n:
            at, self.escaped = 1, False
        while at < n:
            if self.inside:
                quote, slash = text.find('"', at), text.find("\\", at)
                if quote < 0 and slash < 0:
                    return
                if slash >= 0 and (quote < 0 or slash < quote):
                    at = slash + 2
                    self.escaped = at > n
                    continue
                self.inside, at = False, quote + 1
            found = _MARK.search(text, at)
            if not found:
                return
            mark, at = found[0], found.end()
            if mark == '"':
                self.inside = True
                continue
            self.depth += 1 if mark in "{[" else -1 if mark in "}]" else 0
            if seen:
                seen(at, mark)


def _json_functions(batches) -> Iterator[pa.RecordBatch]:
    """Of each range and both states: the state after it, how much deeper it is then, and how many commas there are at each relative depth."""
    for (path, at), rows in _ranges(batches, ["bytes", "value"]):
        states, commas, total, first, size = [JsonState(False), JsonState(True)], [Counter(), Counter()], 0, None, 0
        for *_, size, chunk in rows:
            total += len(chunk.encode()) + 1
            first = first or chunk.lstrip("\ufeff \t\r\n")[:1] or None
            for s, c in zip(states, commas):
                s.feed(chunk + BRACE, lambda _, mark, s=s, c=c: c.update([s.depth]) if mark == "," else None)
        maps = [pa.array([list(c.items())], pa.map_(pa.int32(), pa.int64())) for c in commas]
        yield pa.record_batch([pa.array([path]), pa.array([at]), pa.array([size]), pa.array([total]), pa.array([first], pa.string()), *(pa.array([s.inside]) for s in states), *(pa.array([s.depth], pa.int32()) for s in states), *maps], ["path", "at", "bytes", "total", "first", "f0", "f1", "d0", "d1", "c0", "c1"])


def _json_records(batches) -> Iterator[pa.RecordBatch]:
    """Objects at the depth where elements stand; their places count the commas there."""
    for (path, at), rows in _ranges(batches, ["inside", "depth", "top", "before", "value"]):
        out: list[tuple] = []
        places: list[int] = []
        held, state, size = [], None, 0
        part = WHOLE
        for *_, inside, depth, top, before, chunk in rows:
            if state is None:
                state, place = JsonState(inside, depth), before
                part = HEAD if depth > top else WHOLE
            text, begin = chunk + BRACE, 0
            cuts: list[tuple[int, str, int]] = []
            state.feed(text, lambda k, mark: cuts.append((k, mark, state.depth)))  # noqa: B023
            for k, mark, deep in cuts:
                if mark == "," and deep == top:
                    place += 1
                elif mark in "{[" and deep == top + 1:
                    held, begin, part = [], k - 1, WHOLE
                elif mark in "}]" and deep == top:
                    held.append(text[begin:k])
                    if mark == "}":
                        out.append((part, "".join(held)))
                        places.append(place)
                        size += len(out[-1][1])
                    held, part = [], WHOLE
                    begin = k
            if state.depth > top:
                held.append(text[begin:])
            if size > 4 << 20:
                yield _pieces(path, at, out, places)
                out, places, size = [], [], 0
        if held:
            out.append((TAIL if part == WHOLE else HEAD, "".join(held)))
            places.append(place)
        yield _pieces(path, at, out, places)


def json_objects(spark: SparkSession, path: str) -> DataFrame:
    """(path, at, pos, text) of each object of files that hold an array, or one object; pos is its place in the array.

    Files that end within a string or a bracket give nothing, as they are not JSON.
    """
    chunks = _chunks(spark, path, BRACE)
    told = chunks.select("path", "at", "bytes", "value").mapInArrow(_json_functions, f"{_RANGE}, bytes bigint, total bigint, first string, f0 boolean, f1 boolean, d0 int, d1 int, c0 map<int,bigint>, c1 map<int,bigint>")
    file, before = Window.partitionBy("path"), Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)

    def by_state(a: str, b: str) -> Column:
        return F.when(F.col("inside"), F.col(b)).otherwise(F.col(a))

    ordered = _in_order(told).withColumns({"deeper": by_state("d0", "d1"), "commas": by_state("c0", "c1"), "after": by_state("f0", "f1")})
    ordered = ordered.withColumns({"depth": F.coalesce(F.sum("deeper").over(before), F.lit(0)).cast("int"), "top": (F.first("first", ignorenulls=True).over(file.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) == "[").cast("int")})
    own = F.coalesce(F.try_element_at("commas", F.col("top") - F.col("depth")), F.lit(0))
    ordered = ordered.withColumn("before", F.coalesce(F.sum(own).over(before), F.lit(0)))
    # the last chunk of a file has no brace after it unless the file ends with one
    beyond = F.sum("total").over(file) - F.col("bytes")  # a byte order mark, three bytes, is not among the chunks
    left_open = F.sum("deeper").over(file) + F.when(beyond.isin(1, -2), 1).otherwise(0)
    ends = F.last("after").over(file.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    sound = ordered.withColumn("_ok", (left_open == 0) & ~ends).where("_ok")
    given = chunks.join(F.broadcast(sound.select("path", "at", "inside", "depth", "top", "before")), ["path", "at"]).select("path", "at", "inside", "depth", "top", "before", "value")  # one row a range
    return _whole(given.mapInArrow(_json_records, PIECES))
