"""Queries over a table of datasets: search, author profile, co-author network, and analytics.

Columns that a table lacks are null, as DATASETS names them; year is a number.
"""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import byline, colour_group, contains_ci
from .pages import Page, page_of

FIRST, LAST = 1990, 2026


def _has(df: DataFrame, c: str) -> Column:
    return F.col(c) if c in df.columns else F.lit(None).cast("string")


def years(df: DataFrame, year_from: int | None = FIRST, year_to: int | None = LAST) -> DataFrame:
    """Rows of years in an inclusive range (turned round if its ends are); none given, all."""
    if year_from is not None and year_to is not None and year_from > year_to:
        year_from, year_to = year_to, year_from
    df = df if year_from is None else df.where(F.col("year") >= year_from)
    return df if year_to is None else df.where(F.col("year") <= year_to)


def matching(df: DataFrame, q: str = "", field: str = "all") -> DataFrame:
    q = (q or "").strip()
    if not q:
        return df
    if field in ("author", "doi"):
        return df.where(contains_ci(_has(df, "authors" if field == "author" else "doi"), q))
    over = [contains_ci(F.col(c), q) for c in ("title", "keywords", "description") if c in df.columns]
    return df.where(reduce(lambda a, b: a | b, over)) if over else df.where("false")


def projected(df: DataFrame, *more: str) -> DataFrame:
    link = F.col("url") if "url" in df.columns else _has(df, "doi")
    return df.select("title", "authors", "year", "doi", _has(df, "keywords").alias("categories"), link.alias("arxiv_id"), _has(df, "repository").alias("repository"), *more)


def with_id(df: DataFrame) -> DataFrame:
    """projected() with the table's id, if it has one, as _id."""
    return projected(df.withColumn("_id", F.col("id")), "_id") if "id" in df.columns else projected(df)


def last_keys(rows: DataFrame) -> list[str]:
    """What comes last in the order of with_id()'s rows, so that no tie is left open and pages neither share nor lose a row: the id, or else all that a page shows."""
    return ["_id"] if "_id" in rows.columns else ["title", "authors", "year", "doi", "categories", "arxiv_id", "repository"]


def filtered(df: DataFrame, q: str = "", field: str = "all", year_from: int = FIRST, year_to: int = LAST, category: str | None = None, exact_year: int | None = None, month_from: int = 1, month_to: int = 12, exact_month: int | None = None) -> DataFrame:
    """The rows that search() pages through."""
    found = years(matching(df, q, field), year_from, year_to)
    if exact_year is not None:
        found = found.where(F.col("year") == exact_year)
    if exact_month is not None:
        found = found.where(_has(df, "month") == exact_month)
    elif (month_from, month_to) != (1, 12):
        found = found.where(_has(df, "month").between(*sorted((month_from, month_to))))
    if category:
        found = found.where(contains_ci(_has(df, "keywords"), category))
    return found


def search(df: DataFrame, q: str = "", field: str = "all", year_from: int = FIRST, year_to: int = LAST, limit: int = 50, offset: int = 0, category: str | None = None, exact_year: int | None = None, sort: str = "year", tie: str = "title", month_from: int = 1, month_to: int = 12, exact_month: int | None = None) -> tuple[DataFrame, DataFrame]:
    """One page of results, newest first (ties by title, then identifier, then last_keys()), and a row of total_count, page, page_size, total_pages, range_start, range_end.

    Months hold for tables with a column month; a row without one passes the whole year only.
    """
    found = filtered(df, q, field, year_from, year_to, category, exact_year, month_from, month_to, exact_month)
    order = {"year": [F.desc("year")], "oldest": [F.asc("year")], "title": [F.asc("title")]}[sort]
    rows = with_id(found)
    page = rows.orderBy(*order, tie, "doi", *last_keys(rows)).offset(offset).limit(limit).drop("_id")
    size = F.lit(max(limit, 1)).cast("bigint")
    total = found.agg(F.count("*").alias("total_count")).select("total_count", F.lit(offset // max(limit, 1) + 1).cast("bigint").alias("page"), size.alias("page_size"), F.ceil(F.col("total_count") / size).alias("total_pages"), F.least(F.lit(offset + 1).cast("bigint"), "total_count").alias("range_start"), F.least(F.lit(offset + limit).cast("bigint"), "total_count").alias("range_end"))
    return page, total


def search_deep(df: DataFrame, q: str = "", field: str = "all", limit: int = 50, offset: int = 0, sort: str = "year", tie: str = "title", most: int = 100_000, **where) -> Page:
    """search()'s page and total by counts of ranges: for offsets of any depth, where search() keeps offset + limit rows in every task. where: the other parameters of filtered()."""
    order = [("title", False)] if sort == "title" else [("year", sort == "year")]
    rows = with_id(filtered(df, q, field, **where))
    led = {c for c, _ in order}
    page = page_of(rows, [*order, *((c, False) for c in dict.fromkeys((tie, "doi", *last_keys(rows))) if c not in led)], offset, limit, most)
    page.rows = page.rows.drop("_id")
    return page


def answer(page: DataFrame, total: DataFrame) -> dict:
    """What a client gets of one page: results, the row of counts, and the milliseconds that both took."""
    began = time.monotonic()
    results, counts = [r.asDict(recursive=True) for r in page.collect()], total.first().asDict()
    return {"results": results} | counts | {"elapsed_ms": round(1000 * (time.monotonic() - began), 1)}


def page_authors(page: DataFrame) -> DataFrame:
    """How many different author strings a page has."""
    return page.agg(F.count_distinct("authors").alias("authors"))


def guarded(df: DataFrame, most: int | None, order: list[str]) -> DataFrame:
    """At most so many rows, the first in order; all if no limit is given, which is the rule."""
    return df if most is None else df.orderBy(*order).limit(most)


def page_window(page: Column, total_pages: Column, around: int = 3) -> Column:
    """The page numbers shown beside a page."""
    return F.sequence(F.greatest(page - around, F.lit(1)), F.greatest(F.least(page + around, total_pages), F.greatest(page - around, F.lit(1))))


def info(df: DataFrame) -> DataFrame:
    """total, min_year and max_year; the columns are df.columns."""
    known = F.when(F.col("year") > 0, F.col("year"))
    return df.agg(F.count("*").alias("total"), F.coalesce(F.min(known), F.lit(FIRST)).alias("min_year"), F.coalesce(F.max(known), F.lit(LAST)).alias("max_year"))


def by_year(df: DataFrame) -> DataFrame:
    return df.groupBy("year").agg(F.count("*").alias("n")).orderBy("year")


def cumulative(counts: DataFrame) -> DataFrame:
    """Running totals of by_year(); years are few."""
    return counts.withColumn("cumulative", F.sum("n").over(Window.orderBy("year").rowsBetween(Window.unboundedPreceding, 0)))


def peak_year(counts: DataFrame) -> DataFrame:
    return counts.agg(F.max_by("year", F.struct("n", -F.col("year"))).alias("peak_year"), F.max("n").alias("peak_n"))


def bar_heights(counts: DataFrame, tallest: int = 60, least: int = 4) -> DataFrame:
    return counts.withColumn("height", F.greatest(F.lit(least), F.round(F.lit(float(tallest)) * F.col("n") / F.max("n").over(Window.partitionBy())).cast("int")))


def _names(df: DataFrame) -> DataFrame:
    return df.select(F.explode(byline(F.col("authors"))).alias("name"))


def author_profile(df: DataFrame, name: str, year_from: int = FIRST, year_to: int = LAST, top: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Papers of bylines that hold a name, newest first; their counts by year; and the most frequent other names."""
    papers = years(df.where(contains_ci(F.col("authors"), name)), year_from, year_to)
    others = _names(papers).where(F.lower("name") != name.lower()).groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(top)
    return projected(papers).orderBy(F.desc("year"), "title"), by_year(papers), others


def collaborators(df: DataFrame, name: str, top: int = 8) -> DataFrame:
    """Names beside a name, split at semicolons and commas; any that holds all words of the name is the name itself."""
    words = name.lower().split()
    each = df.where(contains_ci(F.col("authors"), name)).select(F.explode(F.split("authors", "[;,]")).alias("name")).select(F.trim("name").alias("name")).where("name <> ''")
    own = reduce(lambda a, b: a & b, [F.contains(F.lower("name"), F.lit(w)) for w in words], F.lit(True))
    return each.where(~own).groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(top)


def _bylines(df: DataFrame, year_from: int, year_to: int, category: str | None) -> DataFrame:
    rows = years(df.where("authors IS NOT NULL"), year_from, year_to)
    rows = rows.where(contains_ci(_has(df, "keywords"), category)) if category else rows
    return rows.select("authors", byline(F.col("authors")).alias("names"))


def total_authors(df: DataFrame, year_from: int = FIRST, year_to: int = LAST, category: str | None = None) -> DataFrame:
    """How many names the bylines of a network have, among its nodes or not."""
    return _bylines(df, year_from, year_to, category).select(F.explode("names").alias("name")).agg(F.count_distinct("name").alias("total_authors"))


def network(df: DataFrame, focus: str = "", year_from: int = FIRST, year_to: int = LAST, max_nodes: int = 50, min_weight: int = 1, depth: int = 1, category: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (the max_nodes most frequent names of bylines with two or more) and edges among them.

    Pairs are made inside each byline's array, without a self-join. With depth 2 and a focus, bylines that share a name
    with those of the focus count as well.
    """
    ranged = _bylines(df, year_from, year_to, category)
    rows = ranged.where(contains_ci(F.col("authors"), focus)) if focus else ranged
    if focus and depth > 1:
        near = rows.select(F.explode("names").alias("name")).distinct()
        rows = ranged.where(F.size("names") > 0)
        rows = rows.withColumn("_k", F.xxhash64("authors")).join(rows.select(F.xxhash64("authors").alias("_k"), F.explode("names").alias("name")).join(near, "name", "left_semi").select("_k").distinct(), "_k", "left_semi")
    return graph(rows.select("names"), focus, max_nodes, min_weight)


def graph(rows: DataFrame, focus: str = "", max_nodes: int = 50, min_weight: int = 1) -> tuple[DataFrame, DataFrame]:
    """Of rows of names (an array without repeats)."""
    rows = rows.where(F.size("names") >= 2)
    top = rows.select(F.explode("names").alias("id")).groupBy("id").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "id").limit(max_nodes)
    nodes = top.select("id", F.col("id").alias("label"), "count", colour_group(F.col("id")).alias("group"), (F.lower("id").contains(focus.lower()) if focus else F.lit(False)).alias("is_seed"))
    own = F.sort_array("names")
    pairs = F.flatten(F.transform(own, lambda a, i: F.transform(F.slice(own, i + 2, F.size(own)), lambda b: F.struct(a.alias("source"), b.alias("target")))))
    # only names among the nodes make pairs: at most max_nodes of them go to every task
    ids = F.broadcast(top.agg(F.collect_list("id").alias("_ids")))
    few = rows.join(ids).select(F.array_intersect("names", "_ids").alias("names")).where(F.size("names") >= 2)
    edges = few.select(F.inline(pairs)).groupBy("source", "target").agg(F.count("*").alias("weight")).where(F.col("weight") >= min_weight)
    return nodes, edges


def author_match(df: DataFrame, name: str, top: int = 20) -> DataFrame:
    return _names(df.where(contains_ci(F.col("authors"), name))).where(F.lower("name").contains(name.lower())).groupBy("name").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "name").limit(top)


def authors(df: DataFrame, search_text: str = "", year_from: int = FIRST, year_to: int = LAST, limit: int = 50, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """A page of names by their number of papers, with ranks, and the total of names."""
    names = _names(years(df, year_from, year_to))
    if search_text:
        names = names.where(contains_ci(F.col("name"), search_text))
    counts = names.groupBy("name").agg(F.count("*").alias("count"))
    page = counts.orderBy(F.desc("count"), "name").offset(offset).limit(limit)
    return page.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("count"), "name")) + offset), counts.agg(F.count("*").alias("total"))


def categories(df: DataFrame, year_from: int = FIRST, year_to: int = LAST) -> DataFrame:
    """Papers of each keyword, in lower case, with its share of all papers in per cent."""
    ranged = years(df, year_from, year_to)
    counts = ranged.select(F.explode(F.split(_has(df, "keywords"), "[;,|]+")).alias("c")).select(F.lower(F.trim("c")).alias("category")).where("category <> ''").groupBy("category").agg(F.count("*").alias("n"))
    total = ranged.agg(F.count("*").alias("total"))
    return counts.join(F.broadcast(total)).select("category", "n", F.round(100.0 * F.col("n") / F.col("total"), 1).alias("pct")).orderBy(F.desc("n"), "category")


def top_authors_in_category(df: DataFrame, category: str, top: int = 8) -> DataFrame:
    each = df.where(contains_ci(_has(df, "keywords"), category)).select(F.explode(F.split("authors", ";")).alias("name")).select(F.trim("name").alias("name")).where("name <> ''")
    return each.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(top)


def analytics(df: DataFrame, year_from: int = FIRST, year_to: int = LAST) -> DataFrame:
    """total, with_doi, doi_pct, missing_pct, first and last year, papers a year."""
    has = F.coalesce(F.col("doi") != "", F.lit(False))
    a = years(df, year_from, year_to).agg(F.count("*").alias("total"), F.count_if(has).alias("with_doi"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    whole = F.greatest(F.col("total"), F.lit(1))
    return a.select("*", F.round(100.0 * F.col("with_doi") / whole, 1).alias("doi_pct"), F.round(100.0 * (F.col("total") - F.col("with_doi")) / whole, 1).alias("missing_pct"), F.round(F.col("total") / F.greatest(F.coalesce(F.col("last_year") - F.col("first_year") + 1, F.lit(1)), F.lit(1))).cast("bigint").alias("per_year"))


def researcher(df: DataFrame, name: str, year_from: int = FIRST, year_to: int = LAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Papers, counts by year, and categories with the most frequent first."""
    papers = years(df.where(contains_ci(F.col("authors"), name)), year_from, year_to)
    return projected(papers).orderBy(F.desc("year"), "title"), by_year(papers), categories(papers, None, None)
