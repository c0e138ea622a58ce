"""Mixing sources to target weights (operator 2): temperature, and budgeted block permutations.

Everything here is DataFrame expressions; the token totals of up to MOST_SOURCES sources come to the driver, of more
sources two sums for each step of the bisection. A source's weight is its token share to the power of an exponent,
normalised. The exponent is bisected: the largest at which the weights reach the target entropy (a part of the greatest
possible), but no smaller than that at which a source would be repeated more often than the limit; a budget of more
epochs of all tokens than the limit can't keep it and is an error. The weights are realised within a token budget: each
source is cut into blocks by hash, of about BLOCK_TOKENS or smaller, each epoch takes the blocks in an order of its
own, whole epochs first, and the last epoch ends in a block whose documents are taken in hash order while they fit.

A null source is a source of its own; null ids are documents as any. Null and empty texts have no tokens: they are taken
in each whole epoch, and in the last one with their block. Repeated rows are one document each, told apart by their
texts; rows equal in id, source and text are taken together. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Sources whose totals may come to the driver; the weights of more are summed where they are.
MOST_SOURCES = 100_000
#: Tokens of a block, about: what one task orders to cut the last epoch.
BLOCK_TOKENS = 10_000_000
#: Rows of a plan (sources times blocks) up to which it is broadcast; larger ones are joined by shuffle.
MOST_BROADCAST = 200_000
WORDS = r"[^\x20\x09-\x0D]+"


@dataclass
class Plan:
    """Of each source: its tokens, weight, budget, whole epochs, and the tokens of the last epoch (sources stays empty where they are too many)."""

    exponent: float
    sources: list[dict]


def weights(tokens: list[int], exponent: float) -> list[float]:
    """Shares to a power, normalised; a source without tokens has weight 0."""
    top = max(tokens, default=0)
    raw = [(t / top) ** exponent if t else 0.0 for t in tokens]
    return [r / sum(raw) for r in raw] if top else raw


def entropy(w: list[float]) -> float:
    return -sum(x * math.log(x) for x in w if x > 0)


def _bisect(holds, steps: int = 60) -> float:
    """The largest exponent in 0..1 up to which holds() is true, given that it is true at 0 and goes from true to false once."""
    if holds(1.0):
        return 1.0
    lo, hi = 0.0, 1.0
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if holds(mid) else (lo, mid)
    return lo


def exponent_for(sums, live: int, least: int, top: int, total: int, target_entropy: float, most_epochs: float, budget: float | None) -> tuple[float, float, float]:
    """The exponent, the sum of the powers of all shares of the greatest total, and the tokens of all epochs.

    sums(e): over the live sources, the sum of x**e and that of x**e * log(x), x being tokens / top. least, top and
    total: the smallest and the greatest total of a live source, and that of all. Entropy and the most repeated source
    (the smallest) follow from these.
    """
    if not live:
        return 1.0, 1.0, 0.0
    if (1.0 if budget is None else budget) > most_epochs:
        raise ValueError(f"a budget of {budget or 1.0} epochs can't keep a limit of {most_epochs}")
    goal = target_entropy * math.log(live)

    def evenness(e: float) -> float:
        z, zl = sums(e)
        return math.log(z) - e * zl / z

    def size(e: float) -> float:
        """With no budget, the least with which the greatest source, the last to be, is taken whole."""
        return budget * total if budget is not None else sums(e)[0] * top

    def repeats(e: float) -> float:
        return (least / top) ** e / sums(e)[0] * size(e) / least

    flat = _bisect(lambda e: evenness(e) >= goal - 1e-12)
    # towards exponent 0 small sources are repeated ever more: 1 - e is bisected for the limit
    limit = 0.0 if repeats(0.0) <= most_epochs else 1.0 - _bisect(lambda x: repeats(1.0 - x) <= most_epochs)
    e = max(flat, limit)
    return e, sums(e)[0], size(e)


def plan(totals: list[tuple[str | None, int]], target_entropy: float, most_epochs: float, budget: float | None = 1.0) -> Plan:
    """totals: (source, tokens). budget: a multiple of all tokens, or None for the least with which every document is taken."""
    totals = sorted(totals, key=lambda x: (x[0] is not None, x[0]))
    tokens = [t for _, t in totals if t]
    top = max(tokens, default=1)

    def sums(e: float) -> tuple[float, float]:
        x = [t / top for t in tokens]
        return sum(v**e for v in x), sum(v**e * math.log(v) for v in x)

    exponent, z, size = exponent_for(sums, len(tokens), min(tokens, default=1), top, sum(tokens), target_entropy, most_epochs, budget)
    out = []
    for source, t in totals:
        x = (t / top) ** exponent / z if t else 0.0
        own = round(x * size)
        whole = own // t if t else 1
        if t and budget is None and whole == 0:  # by rounding
            whole, own = 1, t
        out.append({"source": source, "tokens": t, "weight": x, "budget": own, "whole": int(whole), "rest": int(own - whole * t if t else 0)})
    return Plan(exponent, out)


def _plan_apart(totals: DataFrame, target_entropy: float, most_epochs: float, budget: float | None) -> tuple[DataFrame, float]:
    """plan() of a table of totals (source, tokens) that stays where it is: the same columns, and the exponent."""
    live = totals.where("tokens > 0")
    n, least, top, total = live.agg(F.count("*"), F.min("tokens"), F.max("tokens"), F.sum("tokens")).first()
    held: dict[float, tuple[float, float]] = {}

    def sums(e: float) -> tuple[float, float]:
        if e not in held:
            x = F.col("tokens") / F.lit(float(top))
            held[e] = tuple(live.agg(F.sum(F.pow(x, F.lit(e))), F.sum(F.pow(x, F.lit(e)) * F.log(x))).first())
        return held[e]

    exponent, z, size = exponent_for(sums, n, least or 1, top or 1, total or 0, target_entropy, most_epochs, budget)
    t = F.col("tokens")
    out = totals.withColumn("weight", F.when(t > 0, F.pow(t / F.lit(float(top or 1)), F.lit(exponent)) / F.lit(z)).otherwise(F.lit(0.0)))
    out = out.withColumn("budget", F.rint(F.col("weight") * F.lit(float(size))).cast("bigint"))
    if budget is None:
        out = out.withColumn("budget", F.greatest("budget", "tokens"))
    out = out.withColumn("whole", F.when(t > 0, F.floor(F.col("budget") / t)).otherwise(1).cast("int"))
    return out.withColumn("rest", F.when(t > 0, F.col("budget") - F.col("whole") * t).otherwise(0).cast("bigint")), exponent


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: bool = False) -> DataFrame:
    """doc_id, source, n_tokens (words) and a hash of the text, of each row; with carry also all its columns, as the struct row."""
    text = F.col(text_col).cast("string")
    own = [F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("bigint").alias("n_tokens"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("text_hash")]
    return docs.select(*own, *[F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] * carry)


def mix(rows: DataFrame, sizes: DataFrame | None = None, target_entropy: float = 0.97, most_epochs: float = 4.0, budget: float | None = 1.0, blocks: int = 1024, seed: int = 1) -> tuple[DataFrame, Plan]:
    """rows: as of counted(). Gives (doc_id, source, text_hash, n_tokens, epoch, block, slot, weight) of each copy taken
    (and row, if rows have it), and the plan. sizes: the same rows, from which totals are cheaper to take. blocks: of
    each source; more where one would hold over BLOCK_TOKENS.

    slot: the place in its source's sequence, 0 to 1; reading all copies in order of slot mixes sources at their weights.
    """
    spark = rows.sparkSession
    sizes = rows if sizes is None else sizes
    totals = written(sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), "totals")
    n_sources = totals.count()
    if n_sources <= MOST_SOURCES:
        made = plan([(r["source"], r["tokens"]) for r in totals.collect()], target_entropy, most_epochs, budget)
        schema = "array<struct<source:string,tokens:bigint,weight:double,budget:bigint,whole:int,rest:bigint>>"
        per_source = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(made.sources)), schema)))
    else:
        per_source, exponent = _plan_apart(totals, target_entropy, most_epochs, budget)
        per_source, made = written(per_source, "plan"), Plan(exponent, [])
    per_source = per_source.select(F.col("source").alias("s"), "tokens", "weight", "budget", "whole", "rest", F.greatest(F.lit(blocks), F.ceil(F.col("tokens") / BLOCK_TOKENS)).alias("n_blocks"))
    few = n_sources <= MOST_SOURCES
    counts = per_source.select(F.col("s").alias("of"), "n_blocks")
    counts = F.broadcast(counts) if few else counts

    def cut(df: DataFrame) -> DataFrame:
        both = df.join(counts, F.col("source").eqNullSafe(F.col("of")))
        return both.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_hash", F.lit(seed)), F.col("n_blocks"))).drop("of", "n_blocks")

    rows = cut(rows)
    per_block = cut(sizes).groupBy("source", "block").agg(F.sum("n_tokens").alias("block_tokens"))

    # a row for each source, block and epoch at most
    epochs = F.broadcast(per_source) if few else per_source
    plans = per_block.join(epochs, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    plans = plans.withColumn("epoch", F.explode(F.when((F.col("rest") > 0) | (F.col("whole") == 0), F.sequence(F.lit(0), F.col("whole"))).otherwise(F.sequence(F.lit(0), F.col("whole") - 1))))
    order = Window.partitionBy("source", "epoch").orderBy(F.xxhash64("block", "epoch", F.lit(seed)), "block")
    plans = plans.withColumn("before", F.sum("block_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("block_tokens"))
    last = F.col("epoch") == F.col("whole")
    plans = plans.withColumn("room", F.when(last, F.col("rest") - F.col("before")).otherwise(F.col("block_tokens"))).where(~last | (F.col("room") > 0))
    plans = plans.withColumn("cut", F.col("room") < F.col("block_tokens"))
    slot = (F.col("epoch").cast("double") * F.col("tokens") + F.col("before")) / F.greatest(F.col("budget"), F.lit(1))
    plans = plans.select(F.col("source").alias("s"), F.col("block").alias("b"), "epoch", "room", "cut", "weight", slot.alias("slot"))

    # the epochs that take a block whole, together, so that documents find them by one join
    whole = plans.where(~F.col("cut")).groupBy("s", "b").agg(F.collect_list(F.struct("epoch", "slot", "weight")).alias("takes"))
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))
    columns: list[str | Column] = ["doc_id", "source", "text_hash", "n_tokens", "epoch", "block", "slot", "weight", *(c for c in rows.columns if c == "row")]
    n_blocks = per_source.agg(F.sum("n_blocks")).first()[0] or 0
    small = F.broadcast if n_blocks <= MOST_BROADCAST else (lambda df: df)
    taken = rows.join(small(whole), same).select("*", F.inline("takes")).select(*columns)
    # one block for each source at most is cut
    inside = Window.partitionBy("source", "block").orderBy(F.xxhash64("doc_id", "text_hash", F.lit(seed + 1)), "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    part = rows.join(small(plans.where("cut")), same).withColumn("used", F.sum("n_tokens").over(inside)).where("used <= room").select(*columns)
    return taken.unionByName(part), made


def draw(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The same columns, with every row as often as mix() takes it."""
    rows = counted(docs, id_col, text_col, source_col, carry=True)
    sizes = written(counted(docs, id_col, text_col, source_col), "mixing")
    return mix(rows, sizes, **how)[0].select("row.*")
