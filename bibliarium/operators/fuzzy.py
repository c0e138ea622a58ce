"""Best fuzzy title match, exact without comparing everything.

Two sorted token strings of lengths l1 and l2 score 200 * LCS / (l1 + l2). A score of t or more bounds the LCS from
below, and so what either string loses: a character of its own that goes destroys q of its q-grams at most, one of the
other that stands between destroys q - 1. What is left is shared (q-grams are told apart by how many equal ones stand
before them). Short strings, which a match may leave without a shared q-gram, do the same with single characters.

Grams are made once and kept in order of rising frequency, as hashes of 64 bits. Titles meet under a prefix of theirs
only, one gram more than a match may lack; where they meet, lengths and what is left behind either place must allow
the number of shared grams that their lengths ask for, and then all grams are counted. A gram in the prefixes of very many titles
is dealt to blocks on both sides, whose squares meet in tasks of their own. Rows carry digests of titles, not titles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import lcs_length, sorted_tokens
from ..sources.scratch import cut

#: Titles of one side in a block of a frequent gram; a square compares the lengths and places of its square.
BLOCK = 1000
#: Parts that the rows of a frequent gram, or of a title that very many rows have, are dealt to before a join.
SALTS = 16
#: The most frequent grams, whose counts go to all tasks: what is left has a thousandth of all rows at most.
FREQUENT = 1000


def _lost(own: int, other: int, q: int, threshold: int) -> int | None:
    """How many q-grams a string may lose to a match of another length; None if no match has these lengths."""
    common = -(-threshold * (own + other) // 200)
    return None if common > min(own, other) else q * (own - common) + (q - 1) * (other - common)


def gram_length(threshold: int, most_short: int = 12) -> tuple[int, int]:
    """The greatest q of up to three with which strings of more than `short` characters share a q-gram with every match; and short."""
    for q in (3, 2):
        if q * (200 - 2 * threshold) >= 200 - threshold or (q - 1) * (200 - 2 * threshold) >= threshold:
            continue  # long strings may lose all
        lengths = range(1, 200)
        fail = [a for a in lengths if any((x := _lost(a, b, q, threshold)) is not None and a - q + 1 - x < 1 for b in range(1, 2 * a + 200))]
        if max(fail, default=0) <= most_short:
            return q, max(fail, default=0)
    return 1, 0


def _grams(chars: Column, q: int) -> Column:
    n = F.greatest(F.size(chars) - (q - 1), F.lit(0))
    return F.transform(F.slice(chars, F.lit(1), n), lambda c, i: F.struct(F.lit(q).alias("q"), F.array_join(F.slice(chars, i + 1, F.lit(q)), "").alias("g")))


def ordered(keys: DataFrame, threshold: int) -> DataFrame:
    """keys: kid, k, in_a, in_b, one row a title. Gives kid, q, in_a, in_b, l, gs: all q-grams of a title, the rarest first; titles of middling length have a row of single characters, too."""
    q, short = gram_length(threshold)
    chars, size = F.col("_chars"), F.col("l")
    all_grams = _grams(chars, q)
    if short:
        most = short * (200 - threshold) // threshold
        none = F.array().cast("array<struct<q:int,g:string>>")
        all_grams = F.concat(F.when(size > short, _grams(chars, q)).otherwise(none), F.when(size <= most, _grams(chars, 1)).otherwise(none))
    each = keys.withColumns({"_chars": F.split("k", ""), "l": F.length("k")}).select("kid", "in_a", "in_b", "l", F.explode(all_grams).alias("x"))
    each = each.groupBy("kid", "in_a", "in_b", "l", "x.q", "x.g").agg(F.count("*").alias("c"))
    each = each.select("kid", "in_a", "in_b", "l", "q", "g", F.explode(F.sequence(F.lit(1), F.col("c").cast("int"))).alias("nth")).withColumn("p", F.xxhash64("q", "g", "nth")).drop("g", "nth")
    df = each.groupBy("p").agg(F.count("*").alias("df")).where("df > 1")
    top = F.broadcast(df.orderBy(F.desc("df"), "p").limit(FREQUENT).withColumnRenamed("df", "_top"))
    # rows of the most frequent grams have their count, and travel by their title
    each = each.join(top, "p", "left").withColumn("_by", F.when(F.col("_top").isNull(), F.col("p")).otherwise(F.xxhash64("kid")))
    each = each.join(df.withColumnRenamed("p", "_by"), "_by", "left")
    rank = F.struct(F.coalesce("_top", "df", F.lit(1)).alias("df"), "p")
    return each.groupBy("kid", "q", "in_a", "in_b", "l").agg(F.sort_array(F.collect_list(rank)).alias("gs")).withColumn("gs", F.col("gs.p"))


def prefixes(table: DataFrame, threshold: int) -> DataFrame:
    """One row for each gram of a title under which it meets others: one more than a match of any length may lack. place counts from 1, n are all of its grams."""
    lack = F.greatest(F.col("q") * (F.col("l") - F.col("l") * threshold / (200 - threshold)), (F.col("q") - 1) * (F.col("l") * (200 - threshold) / threshold - F.col("l")))
    own = F.slice("gs", F.lit(1), (F.floor(lack + 1e-6) + 1).cast("int"))
    return table.select("kid", "q", "in_a", "in_b", "l", F.size("gs").alias("n"), F.posexplode(own).alias("place", "p")).withColumn("place", F.col("place") + 1)


def squares(pre: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The prefixes of both sides with their square (xa, xb). A gram that more than `block` titles of a side have there is dealt to blocks of about as many; each of one side meets each of the other once."""
    most = F.greatest("ca", "cb")
    hot = pre.groupBy("p").agg(F.count_if("in_a").alias("ca"), F.count_if("in_b").alias("cb")).where((most > block) & (F.least("ca", "cb") > 0))
    hot = hot.select("p", F.ceil(F.col("ca") / block).alias("na"), F.ceil(F.col("cb") / block).alias("nb"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    dealt = pre.withColumn("_salt", F.pmod(F.hash("kid"), F.lit(SALTS))).join(hot, ["p", "_salt"], "left").drop("_salt").fillna(1, ["na", "nb"])
    own = lambda n: F.pmod(F.xxhash64("kid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    a = dealt.where("in_a").select("p", "q", F.col("kid").alias("ka"), F.col("l").alias("la"), F.col("n").alias("n_a"), F.col("place").alias("pa"), own("na").alias("xa"), every("nb").alias("xb"))
    b = dealt.where("in_b").select("p", F.col("kid").alias("kb"), F.col("l").alias("lb"), F.col("n").alias("n_b"), F.col("place").alias("pb"), own("nb").alias("xb"), every("na").alias("xa"))
    return a, b


def meeting(a: DataFrame, b: DataFrame, threshold: int) -> DataFrame:
    """(ka, kb, q, need) of titles whose lengths, and places of a gram of both prefixes, allow a match; each pair once.

    Of a match's shared grams the first in order is in both prefixes, and all others stand behind it on both sides.
    """
    short = gram_length(threshold)[1]
    la, lb, q = F.col("la"), F.col("lb"), F.col("q")
    near = F.least(la, lb) * (200 - threshold) >= F.greatest(la, lb) * threshold
    common = F.ceil(threshold * (la + lb) / 200)
    need = F.greatest(F.col("n_a") - q * (la - common) - (q - 1) * (lb - common), F.col("n_b") - q * (lb - common) - (q - 1) * (la - common), F.lit(1))
    behind = 1 + F.least(F.col("n_a") - F.col("pa"), F.col("n_b") - F.col("pb"))
    by = gram_length(threshold)[0]
    fits = (q == by) & (F.least(la, lb) > short) | (q == 1) & (F.least(la, lb) <= short)
    return a.join(b, ["p", "xa", "xb"]).where(near & fits & (behind >= need)).select("ka", "kb", "q", need.alias("need")).distinct()


def candidates(met: DataFrame, table: DataFrame) -> DataFrame:
    """The pairs (ka, kb) of meeting() that share as many grams as they need."""
    side = lambda k, g: table.select(F.col("kid").alias(k), "q", F.col("gs").alias(g))
    both = met.join(side("ka", "_ga"), ["ka", "q"]).join(side("kb", "_gb"), ["kb", "q"])
    return both.where(F.size(F.array_intersect("_ga", "_gb")) >= F.col("need")).select("ka", "kb")


def _sides(incoming: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of incoming with the digest of their title, titles of existing with their smallest id, and all titles once."""
    digest = F.unhex(F.md5("k"))
    a = incoming.select("pos", sorted_tokens(F.col("title")).alias("k")).where("k <> ''").withColumn("kid", digest)
    b = existing.where("id IS NOT NULL").select("id", F.col("title").alias("existing_title"), sorted_tokens(F.col("title")).alias("k")).where("k <> ''").withColumn("kid", digest)
    marks = a.select("kid", "k", F.lit(True).alias("in_a"), F.lit(False).alias("in_b")).unionByName(b.select("kid", "k", F.lit(False).alias("in_a"), F.lit(True).alias("in_b")))
    titles = marks.groupBy("kid").agg(F.first("k").alias("k"), F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
    # titles of one token string are scored once, for the smallest id
    named = b.groupBy("kid").agg(F.first("k").alias("tb"), F.min("id").alias("existing_id"), F.min_by("existing_title", "id").alias("existing_title"))
    return a, named, titles


def best_matches(incoming: DataFrame, existing: DataFrame, threshold: int = 90) -> DataFrame:
    """incoming: pos, title; existing: id, title. Gives (pos, existing_id, existing_title, similarity) of each row's best match of at least threshold; of equal scores the smallest id.

    Titles that are null or blank match nothing, nor do existing rows without an id. Rows of one title, on either side, are one until the end.
    """
    a, named, titles = _sides(incoming, existing)
    table = cut(ordered(titles, threshold))
    pairs = candidates(meeting(*squares(prefixes(table, threshold)), threshold), table)
    la, lb = F.length("ta"), F.length("tb")
    pairs = pairs.join(titles.where("in_a").select(F.col("kid").alias("ka"), F.col("k").alias("ta")), "ka").join(named.withColumnRenamed("kid", "kb"), "kb")
    scored = pairs.withColumn("lcs", F.coalesce(lcs_length(F.when(F.col("ta") != F.col("tb"), F.col("ta")), F.col("tb")), la)).where(200 * F.col("lcs") >= threshold * (la + lb))
    score = F.col("lcs") / (la + lb)
    best = scored.groupBy(F.col("ka").alias("kid")).agg(F.min(F.struct((-score).alias("s"), "existing_id", "existing_title", F.round(2 * F.col("lcs") / (la + lb), 4).alias("similarity"))).alias("m"))
    best = best.select("kid", "m.existing_id", "m.existing_title", "m.similarity", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    return a.withColumn("_salt", F.pmod(F.hash("pos"), F.lit(SALTS))).join(best, ["kid", "_salt"]).select("pos", "existing_id", "existing_title", "similarity")


def report(incoming: DataFrame, existing: DataFrame, threshold: int = 90, block: int = BLOCK) -> dict[str, int]:
    """What best_matches() does: titles of both sides, rows under which they meet, the largest square's rows, pairs that meet, and pairs whose titles are compared."""
    titles = _sides(incoming, existing)[2]
    table = cut(ordered(titles, threshold))
    a, b = squares(prefixes(table, threshold), block)
    met = cut(meeting(a, b, threshold))
    rows = a.select("p", "xa", "xb").unionByName(b.select("p", "xa", "xb")).groupBy("p", "xa", "xb").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    return {"titles": titles.count(), "prefix_rows": rows[0], "largest_square": rows[1], "met": met.count(), "compared": candidates(met, table).count()}
