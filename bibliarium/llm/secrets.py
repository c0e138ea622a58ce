"""Secret scans (operator 1): fixed patterns, and character Markov models compared by log-likelihood ratio.

Everything here is DataFrame expressions. Two first-order models of characters, one of random strings and one of
ordinary identifiers, are counted from labelled samples; a run of 20 or more token characters is a secret if the
mean log-likelihood ratio of its transitions is above a threshold. Spans of the patterns (assign, access, hex) always
stay; spans of the models (markov) are added where they overlap none of those. Offsets count code points. Null and
empty texts have no spans; every row is scanned, repeated or not; an empty table gives no rows (and a model of no
samples, under which nothing is random); extra columns are not read. A text's cost is in proportion to its length and
spans, however many they are: running sums and maxima go by blocks, as appending to an array copies it.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

#: Fixed patterns: kind, pattern, and the least length of group 2. A run that is too short holds no long one, so that
#: access and hex ask for their 18 and 16 characters at once; an assignment that is too short takes its text with it.
KINDS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12),
    ("access", r"AKIA[A-Z0-9]{14,}", None),
    ("hex", r"[0-9a-f]{16,}", None),
]
#: What may hold a match that is long enough; the texts without one are not split.
GUARDS = {"assign": r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", "access": r"AKIA[A-Z0-9]{14}", "hex": r"[0-9a-f]{16}"}
RUN = r"[A-Za-z0-9+/_-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
SIZE = len(ALPHABET) + 1
SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"
#: Values in a block of running(), and code points in a piece of a text that is rewritten.
BLOCK, PIECE = 128, 1024


def let(value: Column, use) -> Column:
    """use(value), with value evaluated once: lambdas evaluate a column they name for each element."""
    return F.get(F.transform(F.array(value), use), 0)


def running(values: Column, add, levels: int = 2) -> Column:
    """Running results of add (sum or greatest; 0 changes neither) over an array of longs of 0 and more.

    Blocks are folded by themselves, then their last values a level higher: BLOCK ** 3 values cost no more than
    3 * BLOCK copies each.
    """
    last = lambda a: F.coalesce(F.get(a, F.size(a) - 1), F.lit(0).cast("bigint"))
    within = lambda block: F.aggregate(block, F.array().cast("array<bigint>"), lambda acc, x: F.array_append(acc, add(last(acc), x)))
    if levels == 0:
        return within(values)
    cut = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(v), F.lit(1)) - 1) / BLOCK).cast("int")), lambda k: within(F.slice(v, k * BLOCK + 1, BLOCK)))
    shift = lambda block, before: F.transform(block, lambda x: add(x, before))
    join = lambda blocks: let(running(F.transform(blocks, last), add, levels - 1), lambda ends: F.flatten(F.transform(blocks, lambda b, k: let(F.coalesce(F.get(ends, k - 1), F.lit(0).cast("bigint")), lambda before: shift(b, before)))))
    return let(values, lambda v: let(cut(v), join))


def _found(text: Column, pattern: str, guard: str, kind: str, rank: int, keep=None) -> Column:
    """The spans of a pattern's matches of which keep() holds: matches and what lies between them alternate."""

    def spans(matches: Column) -> Column:
        sizes = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(matches)), matches, lambda gap, m: (F.length(gap) + F.length(m)).cast("bigint"))
        span = lambda end, m: F.struct((end - F.length(m)).alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"))
        return F.array_compact(F.zip_with(running(sizes, lambda a, b: a + b), matches, lambda end, m: F.when(keep(m), span(end, m)) if keep else span(end, m)))

    return F.when(text.rlike(guard), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans).cast(SPAN)).otherwise(F.array().cast(SPAN))


def ratio(run: Column, model: str) -> Column:
    """Mean log-likelihood ratio of a run's transitions, its first character's included."""
    chars = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    table = F.split(F.lit(model), ",").cast("array<double>")
    total = F.aggregate(chars, F.struct(F.lit(0).alias("before"), F.lit(0.0).alias("sum")), lambda s, c: F.struct(c.alias("before"), (s["sum"] + F.get(table, s["before"] * SIZE + c)).alias("sum")), lambda s: s["sum"])
    return total / F.length(run)


def samples(docs: DataFrame, sample_docs: int = 400, sample_random: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Labelled strings: (label, string), label 1 for random ones.

    Random strings are drawn in three alphabets (hexadecimal, base 64, capital letters with digits) from digests of
    counters. Identifiers are the words, and pairs of them joined by a low line, of at most sample_docs documents, those
    whose ids hash lowest; words of more than 40 characters, or in which a digit stands, are not taken.
    """
    spark = docs.sparkSession
    n = spark.range(sample_random).select(F.sha2(F.col("id").cast("string"), 512).alias("d"))
    rand = n.select(F.explode(F.array(F.substring("d", 1, 40), F.substring(F.base64(F.unhex("d")), 1, 60), F.translate(F.substring(F.upper(F.base64(F.unhex("d"))), 1, 40), "+/", "XQ"))).alias("string"))
    some = docs.select(F.col(id_col).cast("bigint").alias("_id")).where("_id IS NOT NULL").distinct().orderBy(F.xxhash64("_id"), "_id").limit(sample_docs)
    text = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).cast("string").alias("t")).join(F.broadcast(some), "_id")  # of at most sample_docs ids
    words = text.select(F.regexp_extract_all("t", F.lit("[A-Za-z][A-Za-z_-]+"), F.lit(0)).alias("w")).select(F.filter("w", lambda x: F.length(x).between(3, 40)).alias("w"))
    pairs = F.zip_with("w", F.slice("w", 2, F.size("w")), lambda a, b: F.concat_ws("_", a, b))
    names = words.select(F.explode(F.concat("w", pairs)).alias("string"))
    return rand.select(F.lit(1).alias("label"), "string").unionByName(names.select(F.lit(0).alias("label"), "string"))


def train(labelled: DataFrame) -> str:
    """The table of log-likelihood ratios, by last and next character, as text; at most 2 * SIZE**2 counts come to the driver."""
    chars = F.transform(F.split("string", ""), lambda c: F.instr(F.lit(ALPHABET), c))
    steps = F.zip_with(F.concat(F.array(F.lit(0)), chars), chars, lambda a, b: a * SIZE + b)
    rows = labelled.where("string IS NOT NULL AND string <> ''").select("label", F.explode(steps).alias("step")).where("step IS NOT NULL").groupBy("label", "step").count().collect()
    counts = {0: defaultdict(int), 1: defaultdict(int)}
    for r in rows:
        counts[r["label"]][r["step"]] += r["count"]
    if not counts[0] or not counts[1]:
        return ",".join(["-1.0"] * SIZE**2)
    total = {k: [sum(counts[k][a * SIZE + b] for b in range(SIZE)) for a in range(SIZE)] for k in counts}
    p = lambda k, a, b: math.log((counts[k][a * SIZE + b] + 0.5) / (total[k][a] + 0.5 * SIZE))
    return ",".join(f"{p(1, a, b) - p(0, a, b):.6f}" for a in range(SIZE) for b in range(SIZE))


def _text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, model: str, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, base and found (SPAN arrays in order of start, then kind; found holds base)."""
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return own.withColumns(spans_of("text", model, threshold)).withColumn("found", with_models("base", "markov")).select("doc_id", "text", "base", "found")


def spans_of(text_col: str, model: str, threshold: float) -> dict[str, Column]:
    text = F.col(text_col)
    parts = []
    for rank, (kind, pattern, least) in enumerate(KINDS):
        keep = (lambda m, p=pattern, n=least: F.length(F.regexp_extract(m, p, 2)) >= n) if least else None
        parts.append(_found(text, pattern, GUARDS[kind], kind, rank, keep))
    markov = _found(text, RUN, RUN, "markov", len(KINDS), lambda m: ratio(m, model) > threshold)
    return {"base": F.array_sort(F.concat(*parts)), "markov": markov}


def with_models(base: str, markov: str) -> Column:
    """Spans of base, and those of markov (which overlap none of their own) that overlap none of base, in order.

    A span overlaps one that starts no later, if the furthest end up to there is behind its start, or the next one.
    """
    own = len(KINDS)
    after = lambda every, i: F.coalesce((F.get(every, i + 1)["rank"] < own) & (F.get(every, i + 1)["start"] < F.get(every, i)["end"]), F.lit(False))
    free = lambda every: let(running(F.transform(every, lambda s: F.when(s["rank"] < own, s["end"]).otherwise(0)), F.greatest), lambda ends: F.filter(every, lambda s, i: (s["rank"] < own) | ((F.get(ends, i) <= s["start"]) & ~after(every, i))))
    return F.when(F.size(markov) == 0, F.col(base)).otherwise(let(F.array_sort(F.concat(base, markov)), free))


def report(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov."""
    count = lambda c, kind: F.size(F.filter(c, lambda s: s["kind"] == kind)).cast("bigint")
    return scanned.select("doc_id", *(count("base", k).alias(f"n_{k}") for k, _, _ in KINDS), F.sha2(_text(F.col("base")), 256).alias("base_sha256"), _text(F.col("found")).alias("spans"), count("found", "markov").alias("n_markov"))


def redact(docs: DataFrame, model: str, threshold: float = 0.8, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns, with every span in text_col (overlapping ones as one) replaced by mark; null stays null."""
    names = docs.columns
    own, base, markov, found = (unused(names, f"_{k}") for k in ("text", "base", "markov", "found"))
    text = F.col(f"`{text_col}`")
    spans = docs.withColumn(own, F.coalesce(text.cast("string"), F.lit("")))
    spans = spans.withColumns(dict(zip((base, markov), spans_of(own, model, threshold).values()))).withColumn(found, with_models(base, markov))
    # the text between two spans is taken from the pieces it lies in: substring() counts from its text's beginning
    between = lambda pieces, a, b: F.substring(F.array_join(F.slice(pieces, F.floor(a / PIECE).cast("int") + 1, (F.floor(b / PIECE) - F.floor(a / PIECE)).cast("int") + 1), ""), (a % PIECE).cast("int") + 1, (b - a).cast("int"))
    ends = running(F.transform(found, lambda s: s["end"]), F.greatest)
    before = lambda reach, i: F.coalesce(F.get(reach, i - 1), F.lit(0).cast("bigint"))
    marked = lambda pieces, reach: F.transform(F.filter(F.transform(found, lambda s, i: F.struct(s["start"].alias("start"), before(reach, i).alias("at"))), lambda s: s["start"] >= s["at"]), lambda s: F.concat(between(pieces, s["at"], s["start"]), F.lit(mark)))
    whole = lambda pieces, reach: F.concat(F.array_join(marked(pieces, reach), ""), between(pieces, F.get(reach, F.size(reach) - 1), F.length(own).cast("bigint")))
    clean = let(F.regexp_extract_all(own, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), lambda pieces: let(ends, lambda reach: whole(pieces, reach)))
    return spans.withColumn(text_col, F.when(F.size(found) > 0, clean).otherwise(text)).select(*(f"`{c}`" for c in names))
