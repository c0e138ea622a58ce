"""The catalogue's operators on the driver's tables, each with SQL of the same result.

The tables hold no bibliographic data, so datasets() derives records from parts: the same expressions stand in DS.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import dedup, dims, fuzzy, merge, normalise, runlog, validate, versions
from ..operators.grams import GramIndex
from ..operators.flatten import flatten
from ..schemas import RECORDS, VERSIONS
from ..sources import scratch
from ..sources.tables import Store
from ..streaming.versions import versioned
from . import search as S
from .pipeline import fresh_rows

YEAR, RUN_TIME = 2026, datetime.datetime(2026, 1, 1)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DS = """ds AS (SELECT p_partkey AS id, p_name AS title,
  CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN 'Solo ' || (p_partkey % 17)
    WHEN p_partkey % 2 = 0 THEN 'Author ' || (p_partkey % 37) || ' (Dept); Author ' || (p_partkey * 7 % 41) || ';author ' || (p_partkey % 37)
    ELSE 'Author ' || (p_partkey * 3 % 29) || ' and Author ' || (p_partkey % 31) || '; X' END AS authors,
  CAST(CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE 1988 + p_partkey % 38 END AS INT) AS year,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE '10.1234/ds.' || p_partkey END AS doi,
  lower(p_type) || '; ' || p_brand AS keywords, p_name || ' from ' || p_brand AS description,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'http://example.org/' || p_partkey END AS url, p_brand AS repository FROM part)"""
NAMES = """, parts AS (SELECT id, year, unnest(a) AS raw, generate_subscripts(a, 1) AS pos FROM (SELECT id, year, CASE WHEN strpos(t, ';') > 0 THEN string_split(t, ';') ELSE string_split(t, ',') END AS a
    FROM (SELECT id, year, regexp_replace(regexp_replace(authors, '\\([^)]*\\)', ' ', 'g'), '\\s+and\\s+', ';', 'gi') AS t FROM ds WHERE authors IS NOT NULL))),
  trimmed AS (SELECT id, year, trim(trim(raw), ', ') AS name, pos FROM parts),
  names AS (SELECT id, year, name, pos FROM trimmed WHERE length(name) > 2 QUALIFY row_number() OVER (PARTITION BY id, lower(name) ORDER BY pos) = 1)"""


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def datasets(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    s = lambda c: c.cast("string")
    return _t(spark, sf, "part").select(
        k.alias("id"), F.col("p_name").alias("title"),
        F.when(k % 13 == 0, None).when(k % 5 == 0, F.concat(F.lit("Solo "), s(k % 17)))
        .when(k % 2 == 0, F.concat(F.lit("Author "), s(k % 37), F.lit(" (Dept); Author "), s(k * 7 % 41), F.lit(";author "), s(k % 37)))
        .otherwise(F.concat(F.lit("Author "), s(k * 3 % 29), F.lit(" and Author "), s(k % 31), F.lit("; X"))).alias("authors"),
        F.when(k % 11 != 0, 1988 + k % 38).cast("int").alias("year"), F.when(k % 7 != 0, F.concat(F.lit("10.1234/ds."), s(k))).alias("doi"),
        F.concat(F.lower("p_type"), F.lit("; "), F.col("p_brand")).alias("keywords"), F.concat("p_name", F.lit(" from "), F.col("p_brand")).alias("description"),
        F.when(k % 3 != 0, F.concat(F.lit("http://example.org/"), s(k))).alias("url"), F.col("p_brand").alias("repository"),
    )


def query(sql: str | None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _long(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint, as the SQL side casts them."""
    return df.select(*(F.col(c).cast("bigint") if t in ("int", "smallint") else F.col(c) for c, t in df.dtypes))


# --- search and analytics ---
@query(f"WITH {DS} SELECT title, authors, CAST(year AS BIGINT) AS year, doi, keywords AS categories, url AS arxiv_id, repository FROM ds WHERE year BETWEEN 1990 AND 2026 AND (title ILIKE '%bolt%' OR keywords ILIKE '%bolt%' OR description ILIKE '%bolt%') ORDER BY year DESC, title, doi NULLS FIRST LIMIT 50 OFFSET 10")
def search_page(spark, sf):
    return _long(S.search(datasets(spark, sf), "bolt", limit=50, offset=10)[0])


@query(f"WITH {DS} SELECT title, authors, CAST(year AS BIGINT) AS year, doi, keywords AS categories, url AS arxiv_id, repository, count(*) OVER () AS total FROM ds WHERE year BETWEEN 1990 AND 2026 ORDER BY year DESC, title, doi NULLS FIRST LIMIT 40 OFFSET 120")
def search_deep_page(spark, sf):
    """A page found by counts of ranges, each cut again while it holds more than 50 rows."""
    page = S.search_deep(datasets(spark, sf), limit=40, offset=120, most=50)
    return _long(page.rows).withColumn("total", F.lit(page.total).cast("bigint"))


@query(f"WITH {DS}, c AS (SELECT count(*) AS n FROM ds WHERE year BETWEEN 1990 AND 2026 AND authors ILIKE '%author 1%') SELECT n AS total_count, CAST(3 AS BIGINT) AS page, CAST(20 AS BIGINT) AS page_size, CAST(ceil(n / 20.0) AS BIGINT) AS total_pages, least(41, n) AS range_start, least(60, n) AS range_end FROM c")
def search_count(spark, sf):
    return S.search(datasets(spark, sf), "author 1", "author", limit=20, offset=40)[1]


@query(f"WITH {DS} SELECT count(*) AS total, CAST(coalesce(min(CASE WHEN year > 0 THEN year END), 1990) AS BIGINT) AS min_year, CAST(coalesce(max(CASE WHEN year > 0 THEN year END), 2026) AS BIGINT) AS max_year FROM ds")
def info_bounds(spark, sf):
    return _long(S.info(datasets(spark, sf)))


_BY_YEAR = "SELECT CAST(year(o_orderdate) AS BIGINT) AS year, count(*) AS n FROM orders GROUP BY 1"


def _order_years(spark, sf):
    return S.by_year(_t(spark, sf, "orders").select(F.year("o_orderdate").cast("bigint").alias("year")))


@query(_BY_YEAR)
def by_year_counts(spark, sf):
    return _order_years(spark, sf)


@query(f"SELECT year, n, CAST(sum(n) OVER (ORDER BY year) AS BIGINT) AS cumulative FROM ({_BY_YEAR})")
def cumulative_by_year(spark, sf):
    return S.cumulative(_order_years(spark, sf))


@query(f"SELECT year AS peak_year, n AS peak_n FROM ({_BY_YEAR}) ORDER BY n DESC, year LIMIT 1")
def peak_year(spark, sf):
    return S.peak_year(_order_years(spark, sf))


@query(f"SELECT year, n, CAST(greatest(4, round(60.0 * n / max(n) OVER ())) AS BIGINT) AS height FROM ({_BY_YEAR})")
def bar_heights(spark, sf):
    return _long(S.bar_heights(_order_years(spark, sf)))


@query(f"WITH {DS}, r AS (SELECT * FROM ds WHERE year BETWEEN 1990 AND 2026), c AS (SELECT lower(trim(unnest(string_split_regex(keywords, '[;,|]+')))) AS category FROM r) SELECT category, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM r), 1) AS pct FROM c WHERE category <> '' GROUP BY 1")
def category_share(spark, sf):
    return S.categories(datasets(spark, sf))


@query(f"WITH {DS}, a AS (SELECT count(*) AS total, count(*) FILTER (WHERE doi <> '') AS with_doi, min(year) AS y1, max(year) AS y2 FROM ds WHERE year BETWEEN 1990 AND 2026) SELECT total, with_doi, CAST(y1 AS BIGINT) AS first_year, CAST(y2 AS BIGINT) AS last_year, round(100.0 * with_doi / greatest(total, 1), 1) AS doi_pct, round(100.0 * (total - with_doi) / greatest(total, 1), 1) AS missing_pct, CAST(round(total / greatest(y2 - y1 + 1, 1)) AS BIGINT) AS per_year FROM a")
def analytics_summary(spark, sf):
    return _long(S.analytics(datasets(spark, sf)))


@query(f"WITH {DS}{NAMES} SELECT name, n AS count, row_number() OVER (ORDER BY n DESC, name) AS rank FROM (SELECT name, count(*) AS n FROM names WHERE year BETWEEN 1990 AND 2026 GROUP BY 1) ORDER BY n DESC, name LIMIT 30")
def author_list_ranked(spark, sf):
    return _long(S.authors(datasets(spark, sf), limit=30)[0])


@query(f"WITH {DS}{NAMES} SELECT name, count(*) AS count FROM names WHERE lower(name) LIKE '%author 1%' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def author_match(spark, sf):
    return S.author_match(datasets(spark, sf), "author 1")


SEARCHED = ["title", "authors", "doi", "keywords", "description"]


def _index(spark, sf, fields=SEARCHED) -> GramIndex:
    return GramIndex(spark, scratch.folder(spark, "index")).add(datasets(spark, sf), fields)


@query(ORACLES["search_page"])
def search_indexed(spark, sf):
    """search_page() of the candidates that the trigram index finds."""
    return _long(S.search(_index(spark, sf, ["title", "keywords", "description"]).rows("bolt", ["title", "keywords", "description"]), "bolt", limit=50, offset=10)[0])


@query(ORACLES["author_match"])
def author_match_indexed(spark, sf):
    return S.author_match(_index(spark, sf, ["authors"]).rows("author 1", ["authors"]), "author 1")


@query(f"""WITH {DS}, v AS (SELECT id, 'authors' AS field, lower(authors) AS t FROM ds UNION ALL SELECT id, 'doi', lower(doi) FROM ds),
  g AS (SELECT DISTINCT id, field, t[i : i + 2] AS gram FROM (SELECT id, field, t, unnest(range(1, length(t) - 1)) AS i FROM v WHERE length(t) >= 3)) SELECT field, gram, count(*) AS n FROM g GROUP BY 1, 2""")
def index_counts(spark, sf):
    """The inverted table's trigrams, with the number of rows of each."""
    return _index(spark, sf, ["authors", "doi"]).counts()


@query(f"WITH {DS} SELECT title, authors, CAST(year AS BIGINT) AS year, doi, keywords AS categories, url AS arxiv_id, repository FROM ds WHERE authors ILIKE '%Author 12%' AND year BETWEEN 1990 AND 2026")
def author_papers(spark, sf):
    return _long(S.author_profile(datasets(spark, sf), "Author 12")[0])


@query(f"WITH {DS} SELECT CAST(year AS BIGINT) AS year, count(*) AS n FROM ds WHERE authors ILIKE '%Author 12%' AND year BETWEEN 1990 AND 2026 GROUP BY 1")
def author_by_year(spark, sf):
    return _long(S.author_profile(datasets(spark, sf), "Author 12")[1])


@query(f"WITH {DS}{NAMES} SELECT name, count(*) AS n FROM names WHERE id IN (SELECT id FROM ds WHERE authors ILIKE '%Author 12%') AND year BETWEEN 1990 AND 2026 AND lower(name) <> 'author 12' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def collab_profile(spark, sf):
    return S.author_profile(datasets(spark, sf), "Author 12")[2]


@query(f"WITH {DS}, e AS (SELECT trim(unnest(string_split_regex(authors, '[;,]'))) AS name FROM ds WHERE authors ILIKE '%author 12%') SELECT name, count(*) AS n FROM e WHERE name <> '' AND NOT (contains(lower(name), 'author') AND contains(lower(name), '12')) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def collaborators_by_words(spark, sf):
    return S.collaborators(datasets(spark, sf), "author 12")


@query(f"WITH {DS}, e AS (SELECT trim(unnest(string_split(authors, ';'))) AS name FROM ds WHERE keywords ILIKE '%economy%') SELECT name, count(*) AS n FROM e WHERE name <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def top_authors_in_category(spark, sf):
    return S.top_authors_in_category(datasets(spark, sf), "economy")


_GRAPH = f"""WITH {DS}{NAMES}, many AS (SELECT id, name FROM names WHERE year BETWEEN 1990 AND 2026 AND id IN (SELECT id FROM names GROUP BY 1 HAVING count(*) >= 2)),
  top AS (SELECT name, count(*) AS n FROM many GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50)"""


@query(f"{_GRAPH} SELECT name AS id, name AS label, n AS count, false AS is_seed FROM top")
def network_nodes(spark, sf):
    return S.network(datasets(spark, sf))[0].drop("group")


@query(f"{_GRAPH} SELECT a.name AS source, b.name AS target, count(*) AS weight FROM many a JOIN many b ON a.id = b.id AND a.name < b.name WHERE a.name IN (SELECT name FROM top) AND b.name IN (SELECT name FROM top) GROUP BY 1, 2")
def network_edges(spark, sf):
    return S.network(datasets(spark, sf))[1]


_COOCCUR = "WITH s AS (SELECT DISTINCT l_orderkey AS o, 'Supplier ' || l_suppkey AS n FROM lineitem), many AS (SELECT * FROM s WHERE o IN (SELECT o FROM s GROUP BY 1 HAVING count(*) >= 2)), top AS (SELECT n, count(*) AS c FROM many GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40)"


def _suppliers(spark, sf):
    return _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.concat(F.lit("Supplier "), F.col("l_suppkey").cast("string"))).alias("names"))


@query(f"{_COOCCUR} SELECT n AS id, n AS label, c AS count, contains(lower(n), 'supplier 1') AS is_seed FROM top")
def cooccur_nodes(spark, sf):
    return S.graph(_suppliers(spark, sf), "supplier 1", 40)[0].drop("group")


@query(f"{_COOCCUR} SELECT a.n AS source, b.n AS target, count(*) AS weight FROM many a JOIN many b ON a.o = b.o AND a.n < b.n WHERE a.n IN (SELECT n FROM top) AND b.n IN (SELECT n FROM top) GROUP BY 1, 2 HAVING count(*) >= 2")
def cooccur_edges(spark, sf):
    return S.graph(_suppliers(spark, sf), max_nodes=40, min_weight=2)[1]


@query(f"{_GRAPH.replace(') >= 2)),', ') >= 2) AND id IN (SELECT id FROM ds WHERE keywords ILIKE ' + chr(39) + '%economy%' + chr(39) + ')),')} SELECT a.name AS source, b.name AS target, count(*) AS weight FROM many a JOIN many b ON a.id = b.id AND a.name < b.name WHERE a.name IN (SELECT name FROM top) AND b.name IN (SELECT name FROM top) GROUP BY 1, 2 HAVING count(*) >= 2")
def network_category(spark, sf):
    return S.network(datasets(spark, sf), category="economy", min_weight=2)[1]


@query(f"WITH {DS}{NAMES} SELECT count(DISTINCT name) AS total_authors FROM names WHERE year BETWEEN 1990 AND 2026")
def network_total(spark, sf):
    return S.total_authors(datasets(spark, sf))


#: Of a string of ASCII letters s.
_CRC = "xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({s}, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: list_reduce(list_prepend(xor(a, b), CAST(range(8) AS BIGINT[])), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"


@query(f"{_GRAPH} SELECT name AS id, CAST({_CRC.format(s='name')} % 6 AS BIGINT) AS colour FROM top")
def network_groups(spark, sf):
    return S.network(datasets(spark, sf))[0].select("id", F.col("group").cast("bigint").alias("colour"))


@query(f"WITH {DS}, p AS (SELECT * FROM ds WHERE authors ILIKE '%author 1%' AND year BETWEEN 1995 AND 2020), e AS (SELECT lower(trim(unnest(string_split_regex(keywords, '[;,|]+')))) AS category FROM p) SELECT category, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM p), 1) AS pct FROM e WHERE category <> '' GROUP BY 1")
def researcher_categories(spark, sf):
    return S.researcher(datasets(spark, sf), "author 1", 1995, 2020)[2]


@query(f"WITH {DS} SELECT CAST(year AS BIGINT) AS year, count(*) AS n FROM ds WHERE authors ILIKE '%author 1%' AND year BETWEEN 1995 AND 2020 GROUP BY 1")
def researcher_years(spark, sf):
    return _long(S.researcher(datasets(spark, sf), "author 1", 1995, 2020)[1])


@query(f"WITH {DS} SELECT title, authors, CAST(year AS BIGINT) AS year, doi, keywords AS categories, url AS arxiv_id, repository FROM ds WHERE year BETWEEN 1990 AND 2026 AND 1 + id % 12 BETWEEN 3 AND 7 AND keywords ILIKE '%economy%' ORDER BY title, doi NULLS FIRST LIMIT 40")
def search_months(spark, sf):
    rows = datasets(spark, sf).withColumn("month", 1 + F.col("id") % 12)
    return _long(S.search(rows, month_from=7, month_to=3, category="economy", sort="title", limit=40)[0])


@query(f"WITH {DS}, p AS (SELECT authors FROM ds WHERE year = 2001 AND 1 + id % 12 = 5 ORDER BY title, doi NULLS FIRST LIMIT 30) SELECT count(DISTINCT authors) AS authors FROM p")
def page_author_strings(spark, sf):
    rows = datasets(spark, sf).withColumn("month", 1 + F.col("id") % 12)
    return S.page_authors(S.search(rows, exact_year=2001, exact_month=5, limit=30)[0])


@query(f"WITH {DS}, p AS (SELECT year FROM ds WHERE year BETWEEN 1990 AND 2026 AND title ILIKE '%bolt%' OR year BETWEEN 1990 AND 2026 AND keywords ILIKE '%bolt%' OR year BETWEEN 1990 AND 2026 AND description ILIKE '%bolt%' ORDER BY title, doi NULLS FIRST LIMIT 60) SELECT CAST(year AS BIGINT) AS year, count(*) AS n FROM p GROUP BY 1")
def page_years(spark, sf):
    return _long(S.by_year(S.search(datasets(spark, sf), "bolt", limit=60, sort="title")[0]))


@query(f"WITH {DS} SELECT id FROM ds WHERE authors ILIKE '%author 2%' ORDER BY id LIMIT 25")
def guarded_rows(spark, sf):
    return S.guarded(S.matching(datasets(spark, sf), "author 2", "author"), 25, ["id"]).select("id")


# --- scalar functions ---
@query(f"WITH {DS}{NAMES} SELECT id, string_agg(name, '|' ORDER BY pos) AS names FROM names GROUP BY 1")
def byline_names(spark, sf):
    return datasets(spark, sf).select("id", F.array_join(text.byline(F.col("authors")), "|").alias("names")).where("names <> ''")


_DOIS = "d AS (SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN '  https://doi.org/10.1000/AbC.' || c_custkey || ' ' WHEN 1 THEN 'HTTP://DX.DOI.ORG/10.1000/x' || c_custkey WHEN 2 THEN 'doi:10.1000/y' || c_custkey WHEN 3 THEN '10.1/z' WHEN 4 THEN '  ' ELSE NULL END AS doi FROM customer)"


def _dois(spark, sf):
    k = F.col("c_custkey")
    return _t(spark, sf, "customer").select(k.alias("id"), F.when(k % 6 == 0, F.concat(F.lit("  https://doi.org/10.1000/AbC."), k, F.lit(" "))).when(k % 6 == 1, F.concat(F.lit("HTTP://DX.DOI.ORG/10.1000/x"), k)).when(k % 6 == 2, F.concat(F.lit("doi:10.1000/y"), k)).when(k % 6 == 3, "10.1/z").when(k % 6 == 4, "  ").alias("doi"))


@query(f"WITH {_DOIS}, e AS (SELECT id, doi, nullif(regexp_replace(trim(doi), '(?i)^https?://(dx\\.)?doi\\.org/', ''), '') AS display FROM d) SELECT id, display, coalesce(regexp_replace(lower(trim(doi)), '^(https?://(dx\\.)?doi\\.org/|doi:)', ''), '') AS key, coalesce(regexp_matches(display, '^10\\.[0-9]{{4,9}}/\\S+$'), false) AS valid, list_extract(string_split(doi, 'doi.org/'), -1) AS tail FROM e")
def doi_normalise(spark, sf):
    d = F.col("doi")
    return _dois(spark, sf).select("id", text.doi_display(d).alias("display"), text.doi_key(d).alias("key"), text.is_doi(d).alias("valid"), text.doi_from_url(d).alias("tail"))


_PEOPLE = "p AS (SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN ' John Q  Smith' || c_custkey || ' ' WHEN 1 THEN 'Smith' || c_custkey || ',  J. ' WHEN 2 THEN 'Aristotle' WHEN 3 THEN 'Smith,' ELSE NULL END AS name FROM customer)"


@query(f"WITH {_PEOPLE} SELECT id, CASE WHEN contains(name, ',') THEN trim(name[:strpos(name, ',') - 1]) || ', ' || trim(name[strpos(name, ',') + 1:]) WHEN len(string_split_regex(trim(name), '\\s+')) <= 1 THEN trim(name) ELSE list_extract(string_split_regex(trim(name), '\\s+'), -1) || ', ' || array_to_string(string_split_regex(trim(name), '\\s+')[:-2], ' ') END AS name FROM p")
def author_last_first(spark, sf):
    k = F.col("c_custkey")
    name = F.when(k % 5 == 0, F.concat(F.lit(" John Q  Smith"), k, F.lit(" "))).when(k % 5 == 1, F.concat(F.lit("Smith"), k, F.lit(",  J. "))).when(k % 5 == 2, "Aristotle").when(k % 5 == 3, "Smith,")
    return _t(spark, sf, "customer").select(k.alias("id"), text.last_first(name).alias("name"))


@query("SELECT o_orderkey AS id, CAST(CASE o_orderkey % 4 WHEN 0 THEN year(o_orderdate) WHEN 3 THEN year(o_orderdate) END AS BIGINT) AS year FROM orders")
def year_cast(spark, sf):
    k, y = F.col("o_orderkey"), F.year("o_orderdate").cast("string")
    raw = F.when(k % 4 == 0, y).when(k % 4 == 1, F.concat(y, F.lit(".0"))).when(k % 4 == 2, "not-a-year").otherwise(F.concat(F.lit(" "), y))
    return _t(spark, sf, "orders").select(k.alias("id"), text.year(raw).cast("bigint").alias("year"))


@query("WITH k AS (SELECT p_partkey AS id, trim(lower(unnest(string_split_regex(p_type || ' ; ' || p_brand || ',' || lower(p_type) || '| ' || p_name, '[;,|]+')))) AS w FROM part) SELECT id, string_agg(DISTINCT w, '|' ORDER BY w) AS keywords FROM k WHERE w <> '' GROUP BY 1")
def keyword_normalise(spark, sf):
    raw = F.concat("p_type", F.lit(" ; "), "p_brand", F.lit(","), F.lower("p_type"), F.lit("| "), "p_name")
    return _t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array_join(text.keyword_split(raw), "|").alias("keywords"))


_WS = r"\s\x0b\x1c-\x1f\x85\p{Z}"
_PLAIN = "replace(replace(replace(replace(html, '&middot;', '·'), '&copy;', '©'), '&quot;', '\"'), '&amp;', '&')"
_NO_TAGS = rf"regexp_replace(regexp_replace(regexp_replace({_PLAIN}, '<[^>]+>', ' ', 'g'), '\\[a-zA-Z]+\{{([^}}]*)\}}', '\1', 'g'), '\\[^a-zA-Z{_WS}]', '', 'g')"


@query(rf"SELECT page_id, nullif(trim(regexp_replace({_NO_TAGS}, '[{_WS}]+', ' ', 'g')), '') AS clean FROM pages")
def html_clean_native(spark, sf):
    return _t(spark, sf, "pages").select("page_id", text.strip_markup(text.unescape_common(F.col("html"))).alias("clean"))


@query(None)
def html_clean(spark, sf):
    """With the whole table of entities, for which SQL has no function."""
    return _t(spark, sf, "pages").select("page_id", text.clean_text(F.col("html")).alias("clean"))


# --- validation ---
_RECORDS = """r AS (SELECT o_orderkey AS pos, CASE WHEN o_orderkey % 9 = 0 THEN '  ' WHEN o_orderkey % 9 = 1 THEN 'Ab' ELSE 'Order ' || o_orderkey END AS title,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN 'http://example.com/no' WHEN o_orderkey % 5 = 2 THEN 'https://doi.org/10.1234/' || o_orderkey ELSE '10.1234/' || o_orderkey END AS doi,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE 'o-' || o_orderkey END AS source_id,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 = 1 THEN '1899' WHEN o_orderkey % 7 = 2 THEN '2026' WHEN o_orderkey % 7 = 3 THEN 'soon' ELSE CAST(year(o_orderdate) AS VARCHAR) END AS publication_year FROM orders),
 v AS (SELECT *, CASE WHEN trim(coalesce(title, '')) = '' THEN 'MISSING_TITLE' WHEN trim(coalesce(doi, '')) = '' AND trim(coalesce(source_id, '')) = '' THEN 'MISSING_IDENTIFIER'
  WHEN trim(coalesce(doi, '')) <> '' AND NOT regexp_matches(regexp_replace(trim(doi), '(?i)^https?://(dx\\.)?doi\\.org/', ''), '^10\\.[0-9]{4,9}/\\S+$') THEN 'INVALID_DOI'
  WHEN publication_year IS NULL THEN 'MISSING_YEAR' WHEN NOT regexp_matches(publication_year, '^[0-9]+$') OR CAST(CASE WHEN regexp_matches(publication_year, '^[0-9]+$') THEN publication_year END AS INT) NOT BETWEEN 1900 AND 2026 THEN 'INVALID_YEAR' END AS reason_code,
  length(trim(title)) < 3 AS missing_title_flag, coalesce(CASE WHEN regexp_matches(publication_year, '^[0-9]+$') THEN publication_year = '2026' END, true) AS year_uncertain FROM r)"""


def _records(spark, sf):
    k = F.col("o_orderkey")
    return _t(spark, sf, "orders").select(
        k.alias("pos"), F.when(k % 9 == 0, "  ").when(k % 9 == 1, "Ab").otherwise(F.concat(F.lit("Order "), k)).alias("title"),
        F.when(k % 5 == 0, None).when(k % 5 == 1, "http://example.com/no").when(k % 5 == 2, F.concat(F.lit("https://doi.org/10.1234/"), k)).otherwise(F.concat(F.lit("10.1234/"), k)).alias("doi"),
        F.when(k % 10 != 0, F.concat(F.lit("o-"), k)).alias("source_id"),
        F.when(k % 7 == 0, None).when(k % 7 == 1, "1899").when(k % 7 == 2, "2026").when(k % 7 == 3, "soon").otherwise(F.year("o_orderdate").cast("string")).alias("publication_year"),
    )


@query(f"WITH {_RECORDS} SELECT pos, reason_code FROM v")
def validate_reason(spark, sf):
    return validate.validate(_records(spark, sf), YEAR).select("pos", "reason_code")


@query(f"WITH {_RECORDS} SELECT pos, missing_title_flag, year_uncertain FROM v WHERE reason_code IS NULL")
def soft_flags(spark, sf):
    return validate.route(validate.validate(_records(spark, sf), YEAR), RUN_TIME)[0].select("pos", "missing_title_flag", "year_uncertain")


@query(f"WITH {_RECORDS} SELECT reason_code, count(*) AS n FROM v WHERE reason_code IS NOT NULL GROUP BY 1")
def reject_counts(spark, sf):
    return validate.reject_counts(validate.validate(_records(spark, sf), YEAR))


@query(f"WITH {_RECORDS} SELECT reason_code, title, doi, source_id FROM v WHERE reason_code IS NOT NULL")
def rejected_rows(spark, sf):
    return validate.route(validate.validate(_records(spark, sf), YEAR), RUN_TIME)[1].select("reason_code", "title", "doi", "source_id")


@query(f"WITH {_RECORDS} SELECT count(*) AS loaded, count(*) FILTER (WHERE reason_code IS NULL) AS accepted, count(*) FILTER (WHERE reason_code IS NOT NULL) AS rejected, count(*) FILTER (WHERE reason_code IS NULL AND (missing_title_flag OR year_uncertain)) AS flagged FROM v")
def stage_counts(spark, sf):
    return runlog.stage_counts(validate.validate(_records(spark, sf), YEAR))


@query(f"WITH {_RECORDS} SELECT pos, trim(title) AS title, regexp_replace(doi, '^https://doi.org/', '') AS doi, CAST(publication_year AS BIGINT) AS publication_year, source_id FROM v WHERE reason_code IS NULL")
def normalise_records(spark, sf):
    accepted = validate.route(validate.validate(_records(spark, sf), YEAR), RUN_TIME)[0]
    return _long(normalise.normalise(accepted).select("pos", "title", "doi", "publication_year", "source_id"))


# --- duplicates ---
@query("SELECT doc_id, md5(text) AS h FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1")
def md5_dedup_first(spark, sf):
    return dedup.keep_first(_t(spark, sf, "documents").select("doc_id", F.md5("text").alias("h")), ["h"], ["doc_id"])


@query("SELECT count(*) - count(DISTINCT md5(text)) AS duplicates FROM documents")
def dup_count(spark, sf):
    return dedup.duplicate_count(_t(spark, sf, "documents").select(F.md5("text").alias("h")), "h")


@query("SELECT p_name AS title, p_brand AS authors, min(p_partkey) AS pos FROM part GROUP BY 1, 2")
def csv_keep_first(spark, sf):
    return dedup.keep_first(_t(spark, sf, "part").select(F.col("p_name").alias("title"), F.col("p_brand").alias("authors"), F.col("p_partkey").alias("pos")), ["title", "authors"], ["pos"])


def _sides(spark, sf):
    docs = _t(spark, sf, "documents").select("doc_id", F.md5("text").alias("h"))
    incoming = docs.where("doc_id % 2 = 1").select(F.col("doc_id").alias("pos"), F.concat(F.lit(" DOI:10.1/"), F.col("h")).alias("doi"))
    return incoming, docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.concat(F.lit("https://doi.org/10.1/"), F.upper("h")).alias("doi"), (F.col("doc_id") % 3 != 0).alias("is_active"))


@query("SELECT doc_id AS pos FROM documents a WHERE doc_id % 2 = 1 AND EXISTS (SELECT 1 FROM documents b WHERE b.doc_id % 2 = 0 AND b.doc_id % 3 <> 0 AND b.text = a.text)")
def exact_semi(spark, sf):
    return dedup.exact_matches(*_sides(spark, sf)).select("pos")


@query("SELECT doc_id AS pos FROM documents a WHERE doc_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM documents b WHERE b.doc_id % 2 = 0 AND b.doc_id % 3 <> 0 AND b.text = a.text)")
def clean_anti(spark, sf):
    return dedup.not_exact(*_sides(spark, sf)).select("pos")


_LCS = """WITH RECURSIVE names AS (SELECT p_name AS title, min(p_partkey) AS id FROM part GROUP BY 1), keys AS (SELECT title, id, array_to_string(list_sort(string_split(lower(title), ' ')), ' ') AS k FROM names),
 pairs AS (SELECT a.title AS ta, a.id AS ia, a.k AS ka, b.title AS tb, b.id AS ib, b.k AS kb FROM keys a JOIN keys b ON a.id % 2 = 1 AND b.id % 2 = 0),
 dp AS (SELECT ta, ia, ka, tb, ib, kb, 0 AS i, [0 FOR x IN range(length(kb) + 1)] AS row FROM pairs
  UNION ALL SELECT ta, ia, ka, tb, ib, kb, i + 1, list_reduce(range(1, length(kb) + 1), lambda acc, j: list_append(acc, CASE WHEN ka[i + 1] = kb[j] THEN row[j] + 1 ELSE greatest(row[j + 1], acc[j]) END), [CAST(0 AS INTEGER)]) FROM dp WHERE i < length(ka)),
 scored AS (SELECT ia, ib, tb, row[length(kb) + 1] AS lcs, length(ka) + length(kb) AS l FROM dp WHERE i = length(ka)),
 best AS (SELECT * FROM scored WHERE 200 * lcs >= 80 * l QUALIFY row_number() OVER (PARTITION BY ia ORDER BY lcs / l DESC, ib) = 1)"""


def _titles(spark, sf):
    return _t(spark, sf, "part").groupBy(F.col("p_name").alias("title")).agg(F.min("p_partkey").alias("id"))


@query(f"{_LCS} SELECT ia AS pos, ib AS existing_id, tb AS existing_title, round(2 * lcs / l, 4) AS similarity FROM best")
def fuzzy_best_match(spark, sf):
    t = _titles(spark, sf)
    return fuzzy.best_matches(t.where("id % 2 = 1").select(F.col("id").alias("pos"), "title"), t.where("id % 2 = 0"), 80)


@query(f"{_LCS} SELECT CASE WHEN s.id % 3 = 0 THEN 'exact' WHEN b.ia IS NOT NULL THEN 'fuzzy' ELSE 'clean' END AS dup_type, count(*) AS n FROM names s LEFT JOIN best b ON b.ia = s.id WHERE s.id % 2 = 1 GROUP BY 1")
def partition3(spark, sf):
    t = _titles(spark, sf)
    shared = F.concat(F.lit("10.5/"), F.col("id"))
    incoming = t.where("id % 2 = 1").select(F.col("id").alias("pos"), "title", F.when(F.col("id") % 3 == 0, shared).alias("doi"))
    twins = incoming.where("doi IS NOT NULL").select((F.col("pos") + 1_000_000).alias("id"), F.lit("").alias("title"), "doi")
    existing = t.where("id % 2 = 0").select("id", "title", F.lit(None).cast("string").alias("doi")).unionByName(twins).withColumn("is_active", F.lit(True))
    return dedup.summary(dedup.partition(incoming, existing, 80))


# --- merging ---
_MERGE = """e AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS title, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS abstract, CAST(CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey END AS BIGINT) AS citation_count, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'MIT' END AS license FROM customer),
 i AS (SELECT c_custkey AS id, upper(c_name) AS title, CASE WHEN c_custkey % 7 <> 0 THEN 'new ' || c_mktsegment END AS abstract, CAST(CASE WHEN c_custkey % 2 = 0 THEN c_nationkey + 1 END AS BIGINT) AS citation_count, CASE WHEN c_custkey % 11 = 0 THEN 'BSD' END AS license FROM customer WHERE c_custkey % 3 <> 1),
 s AS (SELECT e.id, e.title AS et, i.title AS it, e.abstract AS ea, i.abstract AS ia, e.citation_count AS ec, i.citation_count AS ic, e.license AS el, i.license AS il,
  round((CASE WHEN e.title <> '' THEN 1 ELSE 0 END + CASE WHEN e.abstract <> '' THEN 1 ELSE 0 END + CASE WHEN e.citation_count IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN e.license <> '' THEN 1 ELSE 0 END) / 11, 4) AS es,
  round((CASE WHEN i.title <> '' THEN 1 ELSE 0 END + CASE WHEN i.abstract <> '' THEN 1 ELSE 0 END + CASE WHEN i.citation_count IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN i.license <> '' THEN 1 ELSE 0 END) / 11, 4) AS si FROM e JOIN i ON e.id = i.id)"""


def _pair(spark, sf):
    c, k = _t(spark, sf, "customer"), F.col("c_custkey")
    e = c.select(k.alias("id"), F.when(k % 2 == 0, F.col("c_name")).alias("title"), F.when(k % 3 == 0, F.col("c_mktsegment")).alias("abstract"), F.when(k % 5 != 0, F.col("c_nationkey")).cast("bigint").alias("citation_count"), F.when(k % 4 == 0, "").otherwise("MIT").alias("license"))
    i = c.where(k % 3 != 1).select(k.alias("id"), F.upper("c_name").alias("title"), F.when(k % 7 != 0, F.concat(F.lit("new "), "c_mktsegment")).alias("abstract"), F.when(k % 2 == 0, F.col("c_nationkey") + 1).cast("bigint").alias("citation_count"), F.when(k % 11 == 0, "BSD").alias("license"))
    return e, i


@query(f"WITH {_MERGE} SELECT id, round((CASE WHEN title <> '' THEN 1 ELSE 0 END + CASE WHEN abstract <> '' THEN 1 ELSE 0 END + CASE WHEN citation_count IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN license <> '' THEN 1 ELSE 0 END) / 11, 4) AS completeness FROM e")
def completeness_every_row(spark, sf):
    """Of rows without an incoming one, too."""
    e, _ = _pair(spark, sf)
    return e.select("id", merge.completeness(e).alias("completeness"))


_TAKES = {c: f"(coalesce({n} <> '', false) AND (NOT coalesce({o} <> '', false) OR (es < si AND {o} <> {n})))" for c, o, n in (("title", "et", "it"), ("abstract", "ea", "ia"), ("license", "el", "il"))} | {"citation_count": "(ic IS NOT NULL AND (ec IS NULL OR (es < si AND ec <> ic)))"}


@query(f"WITH {_MERGE} SELECT id, CASE WHEN {_TAKES['title']} THEN it ELSE et END AS title, CASE WHEN {_TAKES['abstract']} THEN ia ELSE ea END AS abstract, CASE WHEN {_TAKES['citation_count']} THEN ic ELSE ec END AS citation_count, CASE WHEN {_TAKES['license']} THEN il ELSE el END AS license, concat_ws('|', CASE WHEN {_TAKES['title']} THEN 'title' END, CASE WHEN {_TAKES['abstract']} THEN 'abstract' END, CASE WHEN {_TAKES['citation_count']} THEN 'citation_count' END, CASE WHEN {_TAKES['license']} THEN 'license' END) AS changed, CASE WHEN es >= si THEN 'existing' ELSE 'incoming' END AS winner FROM s")
def field_merge(spark, sf):
    merged = merge.merge_pairs(*_pair(spark, sf), F.col("e_id") == F.col("i_id"))
    return merged.select("id", "title", "abstract", "citation_count", "license", F.array_join("changed", "|").alias("changed"), "winner")


_DUPS = """x AS (SELECT c_custkey AS pos, c_custkey % 40 + 1 AS matched_id, CASE WHEN c_custkey % 3 = 0 THEN 'exact' ELSE 'fuzzy' END AS dup_type, CASE WHEN c_custkey % 4 <> 0 THEN c_name END AS title,
  CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment END AS abstract, CASE WHEN c_custkey % 7 = 0 THEN 'L' || c_custkey END AS license, CASE WHEN c_custkey % 11 = 0 THEN 'S' || c_nationkey END AS subject_area, CASE WHEN c_custkey % 2 = 0 THEN '10.9/' || c_custkey END AS doi FROM customer),
 o AS (SELECT *, row_number() OVER (PARTITION BY matched_id ORDER BY CASE WHEN dup_type = 'exact' THEN 0 ELSE 1 END, pos) AS k FROM x),
 f(id, k, title, abstract, license, subject_area, doi, version_number, took) AS (SELECT range, 0, CASE WHEN range % 2 = 0 THEN 'own ' || range END, CAST(NULL AS VARCHAR), CASE WHEN range % 3 = 0 THEN 'MIT' END, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), 1, false FROM range(1, 41)
  UNION ALL SELECT id, k, CASE WHEN t THEN nt ELSE ot END, CASE WHEN a THEN na ELSE oa END, CASE WHEN l THEN nl ELSE ol END, CASE WHEN s THEN ns ELSE os END, CASE WHEN d THEN nd ELSE od END, CAST(v + CASE WHEN t OR a OR l OR s OR d THEN 1 ELSE 0 END AS INT), t OR a OR l OR s OR d
   FROM (SELECT *, nt IS NOT NULL AND (ot IS NULL OR (more AND ot <> nt)) AS t, na IS NOT NULL AND (oa IS NULL OR (more AND oa <> na)) AS a, nl IS NOT NULL AND (ol IS NULL OR (more AND ol <> nl)) AS l, ns IS NOT NULL AND (os IS NULL OR (more AND os <> ns)) AS s, nd IS NOT NULL AND (od IS NULL OR (more AND od <> nd)) AS d
    FROM (SELECT f.id, o.k, f.version_number AS v, f.title AS ot, o.title AS nt, f.abstract AS oa, o.abstract AS na, f.license AS ol, o.license AS nl, f.subject_area AS os, o.subject_area AS ns, f.doi AS od, o.doi AS nd,
     (f.title IS NOT NULL)::INT + (f.abstract IS NOT NULL)::INT + (f.license IS NOT NULL)::INT + (f.subject_area IS NOT NULL)::INT + (f.doi IS NOT NULL)::INT < (o.title IS NOT NULL)::INT + (o.abstract IS NOT NULL)::INT + (o.license IS NOT NULL)::INT + (o.subject_area IS NOT NULL)::INT + (o.doi IS NOT NULL)::INT AS more
     FROM f JOIN o ON o.matched_id = f.id AND o.k = f.k + 1)))"""


def _folded(spark, sf):
    c, k = _t(spark, sf, "customer"), F.col("c_custkey")
    none = F.lit(None).cast("string")
    dups = c.select(k.alias("pos"), (k % 40 + 1).alias("matched_id"), F.when(k % 3 == 0, "exact").otherwise("fuzzy").alias("dup_type"), F.when(k % 4 != 0, F.col("c_name")).alias("title"), F.when(k % 5 == 0, F.col("c_mktsegment")).alias("abstract"), F.when(k % 7 == 0, F.concat(F.lit("L"), k)).alias("license"), F.when(k % 11 == 0, F.concat(F.lit("S"), "c_nationkey")).alias("subject_area"), F.when(k % 2 == 0, F.concat(F.lit("10.9/"), k)).alias("doi"))
    n = F.col("id")
    own = spark.range(1, 41).select(n, F.when(n % 2 == 0, F.concat(F.lit("own "), n)).alias("title"), none.alias("abstract"), F.when(n % 3 == 0, "MIT").alias("license"), none.alias("subject_area"), none.alias("doi"), none.alias("source_id"), none.alias("_source"), F.lit(1).alias("version_number"), F.lit(True).alias("is_active"))
    return own, dups


@query(f"WITH RECURSIVE {_DUPS} SELECT id, title, abstract, license, subject_area, doi, CAST(version_number AS BIGINT) AS version_number FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY k DESC) = 1")
def merge_batch(spark, sf):
    """Many duplicates folded into each record, in order."""
    records = merge.fold(*_folded(spark, sf))
    return _long(records.select("id", "title", "abstract", "license", "subject_area", "doi", "version_number"))


@query(f"WITH RECURSIVE {_DUPS} SELECT f.id, o.pos, CAST(f.version_number AS BIGINT) AS version_number FROM f JOIN o ON o.matched_id = f.id AND o.k = f.k WHERE f.took")
def merge_versions(spark, sf):
    """A version for each merge that changed something."""
    return _long(merge.fold_steps(*_folded(spark, sf))[1].select("id", "pos", "version_number"))


@query("SELECT c_custkey AS id, c_custkey % 5 <> 0 AND NOT (c_custkey % 3 = 0 AND c_custkey % 7 <> 0 AND c_custkey % 40 + 1 <> c_custkey) AS is_active FROM customer")
def merge_losers(spark, sf):
    """Duplicates that are records themselves become inactive."""
    c, k = _t(spark, sf, "customer"), F.col("c_custkey")
    dups = c.where(k % 3 == 0).select(k.alias("record_id"), (k % 40 + 1).alias("matched_id"), F.when(k % 7 == 0, "clean").otherwise("exact").alias("dup_type"))
    return merge.soft_delete(c.select(k.alias("id"), (k % 5 != 0).alias("is_active")), merge.losers(dups)).select("id", "is_active")


@query("SELECT a.doc_id AS pos, coalesce((SELECT min(b.doc_id) FROM documents b WHERE b.doc_id % 2 = 0 AND b.doc_id % 3 <> 0 AND b.text = a.text), 0) AS kept_record_id, 'exact_doi' AS reason, ' DOI:10.1/' || md5(a.text) AS dropped_doi FROM documents a WHERE a.doc_id % 2 = 1 AND EXISTS (SELECT 1 FROM documents b WHERE b.doc_id % 2 = 0 AND b.doc_id % 3 <> 0 AND b.text = a.text)")
def merge_log_rows(spark, sf):
    incoming, existing = _sides(spark, sf)
    none = F.lit(None).cast("string").alias("title")
    parted = dedup.partition(incoming.select("*", none), existing.select("*", none))
    return dedup.merge_log(parted, RUN_TIME, carry=("pos",)).select("pos", "kept_record_id", "reason", "dropped_doi")


# --- dimensions ---
def _words(spark, sf):
    docs = _t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.split(F.concat("p_name", F.lit(" "), F.upper("p_type"), F.lit(" "), "p_name"), " ").alias("keywords"))
    return dims.members(docs, "keywords", lower=True)


_WORDS = "w AS (SELECT p_partkey AS record_id, lower(unnest(string_split(p_name || ' ' || upper(p_type) || ' ' || p_name, ' '))) AS value FROM part)"


@query(f"WITH {_WORDS} SELECT value AS keyword, count(DISTINCT record_id) AS n FROM w GROUP BY 1")
def dim_keywords(spark, sf):
    words = _words(spark, sf)
    dim = dims.get_or_create(words, spark.createDataFrame([(7, "ring")], "id bigint, keyword string"), "keyword")
    return dims.links(words, dim, "keyword", "keyword_id").groupBy("keyword_id").agg(F.count("*").alias("n")).join(dim, F.col("keyword_id") == F.col("id")).select("keyword", "n")


@query("SELECT p_partkey AS record_id, min(CAST(pos - 1 AS BIGINT)) AS value_order, value FROM (SELECT p_partkey, unnest(a) AS value, generate_subscripts(a, 1) AS pos FROM (SELECT p_partkey, string_split(lower(p_name || ' ' || upper(p_type) || ' ' || p_name), ' ') AS a FROM part)) GROUP BY 1, 3")
def link_keywords(spark, sf):
    return _long(_words(spark, sf))


@query(f"WITH {DS}{NAMES} SELECT name, count(*) AS n, min(CAST(pos - 1 AS BIGINT)) AS first_order FROM (SELECT id, name, row_number() OVER (PARTITION BY id ORDER BY pos) AS pos FROM names) GROUP BY 1")
def dim_authors(spark, sf):
    """Names through the dimension and its links, in their order."""
    rows = datasets(spark, sf).select("id", text.byline(F.col("authors")).alias("authors"))
    values = dims.members(rows, "authors", lower=False)
    dim = dims.get_or_create(values, spark.createDataFrame([(5, "Nobody")], "id bigint, name string"), "name")
    links = dims.links(values, dim, "name", "author_id", "author_order")
    return links.join(dim, F.col("author_id") == F.col("id")).groupBy("name").agg(F.count("*").alias("n"), F.min("author_order").cast("bigint").alias("first_order"))


@query("SELECT count(DISTINCT lower(w)) + 1 AS ids, count(DISTINCT lower(w)) + 7 AS greatest, 7 AS least FROM (SELECT unnest(string_split(p_name || ' ' || upper(p_type) || ' ' || p_name, ' ')) AS w FROM part) WHERE lower(w) <> 'nothing'")
def dim_ids(spark, sf):
    """Every new value has an id of its own, without a gap after the greatest."""
    dim = dims.get_or_create(_words(spark, sf), spark.createDataFrame([(7, "nothing")], "id bigint, keyword string"), "keyword")
    return _long(dim.agg(F.count_distinct("id").alias("ids"), F.max("id").alias("greatest"), F.min("id").alias("least")))


# --- the store ---
_SPELLED = """d AS (SELECT p_partkey AS pos, p_name AS title, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE CASE p_partkey % 4 WHEN 0 THEN '10.1234/Ds.' WHEN 1 THEN 'https://doi.org/10.1234/dS.' WHEN 2 THEN ' doi:10.1234/DS.' ELSE 'HTTP://dx.doi.org/10.1234/ds.' END || (p_partkey // 5) END AS doi FROM part),
 k AS (SELECT *, coalesce(regexp_replace(lower(trim(doi)), '^(https?://(dx\\.)?doi\\.org/|doi:)', ''), '#' || pos) AS key FROM d)"""


def _spelled(spark, sf):
    k = F.col("p_partkey")
    form = F.when(k % 4 == 0, "10.1234/Ds.").when(k % 4 == 1, "https://doi.org/10.1234/dS.").when(k % 4 == 2, " doi:10.1234/DS.").otherwise("HTTP://dx.doi.org/10.1234/ds.")
    return _t(spark, sf, "part").select(k.cast("bigint").alias("pos"), F.col("p_name").alias("title"), F.when(k % 9 != 0, F.concat(form, F.floor(k / 5).cast("string"))).alias("doi"))


@query(f"WITH {_SPELLED} SELECT pos, title, doi FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY pos) = 1")
def insert_fresh(spark, sf):
    """The first row of each identifier, in whichever of its forms."""
    return fresh_rows(_spelled(spark, sf))


@query(f"WITH {_SPELLED}, c AS (SELECT CASE WHEN doi IS NULL THEN 'src:' || pos ELSE 'doi:' || key END AS record_key, count(*) AS n FROM k GROUP BY 1), held AS (SELECT DISTINCT 'doi:' || key AS record_key FROM k WHERE doi IS NOT NULL AND pos % 50 = 1), gone AS (SELECT DISTINCT 'doi:' || key AS record_key FROM k WHERE doi IS NOT NULL AND pos % 150 = 1) SELECT record_key, n, record_key IN (SELECT record_key FROM held) AND record_key NOT IN (SELECT record_key FROM gone) AS stored FROM c WHERE n > 1 OR (record_key IN (SELECT record_key FROM held) AND record_key NOT IN (SELECT record_key FROM gone))")
def insert_conflicts(spark, sf):
    """What a strict insert refuses: identifiers twice in it, and those of active records; not those of deleted ones."""
    rows = _spelled(spark, sf)
    changes = rows.select(versions.record_key(F.col("doi"), F.col("pos").cast("string")).alias("record_key"), "pos", versions.given(rows, ["title"]).alias("fields"))
    held = changes.where("record_key LIKE 'doi:%'")
    log = versions.apply(spark.createDataFrame([], VERSIONS), held.where("pos % 50 = 1"), ["title"], RUN_TIME)[0]
    log = log.unionByName(versions.tombstones(log, held.where("pos % 150 = 1"), RUN_TIME + datetime.timedelta(days=1)))
    return versions.conflicts(log, changes)


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN upper(c_mktsegment) ELSE c_name END AS title FROM customer UNION ALL SELECT -c_custkey, c_name FROM customer WHERE c_custkey % 10 = 0")
def store_upsert(spark, sf):
    """Records in buckets: all customers, then some with another title and some that are new."""
    store = Store(spark, scratch.folder(spark, "store"), buckets=16)
    store.create()
    c, k = _t(spark, sf, "customer"), F.col("c_custkey")
    full = lambda df: df.select("id", "title", *(F.lit(None).cast(f.dataType).alias(f.name) for f in RECORDS if f.name not in ("id", "title")))
    store.upsert("records", full(c.select(k.alias("id"), F.col("c_name").alias("title"))))
    changed = c.where(k % 7 == 0).select(k.alias("id"), F.upper("c_mktsegment").alias("title"))
    store.upsert("records", full(changed.unionByName(c.where(k % 10 == 0).select((-k).alias("id"), F.col("c_name").alias("title")))))
    return store.read("records").select("id", "title")


# --- versions ---
def _changes(spark, sf):
    e = _t(spark, sf, "events")
    given = F.when(F.col("event_id") % 3 == 0, F.map_from_arrays(F.array(F.lit("type")), F.array(F.col("event_type")))).otherwise(F.map_from_arrays(F.array(F.lit("type"), F.lit("half")), F.array(F.col("event_type"), (F.floor("value") % 2).cast("string"))))
    return e.select(F.concat(F.lit("user:"), F.col("user_id")).alias("record_key"), F.col("event_id").alias("pos"), given.alias("fields"))


_CHAIN = """c AS (SELECT user_id, event_id AS pos, event_type AS type, CASE WHEN event_id % 3 <> 0 THEN CAST(CAST(floor(value) AS BIGINT) % 2 AS VARCHAR) END AS half, event_id % 3 <> 0 AS gives FROM events),
 g AS (SELECT *, sum(CAST(gives AS INT)) OVER (PARTITION BY user_id ORDER BY pos) AS grp FROM c), h AS (SELECT user_id, pos, type, max(half) OVER (PARTITION BY user_id, grp) AS half FROM g),
 l AS (SELECT *, lag(type) OVER w AS old_type, lag(half) OVER w AS old_half, row_number() OVER w AS rn FROM h WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
 m AS (SELECT *, rn = 1 OR type IS DISTINCT FROM old_type OR half IS DISTINCT FROM old_half AS moves FROM l),
 v AS (SELECT *, CAST(sum(CAST(moves AS INT)) OVER (PARTITION BY user_id ORDER BY pos) AS BIGINT) AS version_number FROM m)"""


@query(f"WITH {_CHAIN} SELECT 'user:' || user_id AS record_key, pos, version_number, CASE WHEN rn = 1 THEN 'inserted' WHEN moves THEN 'updated' ELSE 'unchanged' END AS action FROM v")
def version_chain(spark, sf):
    return _long(versions.chain(_changes(spark, sf), ["type", "half"]).select("record_key", "pos", "version_number", "action"))


@query(ORACLES["version_chain"])
def version_stream(spark, sf):
    """The same from keyed state, by a stream that is stopped twice and goes on from its checkpoint."""
    changes, root = _changes(spark, sf), scratch.folder(spark, "stream")
    low, high = changes.agg(F.min("pos"), F.max("pos")).first()
    third = ((high or 0) - (low or 0)) // 3 + 1
    for k in range(3):
        changes.where(F.floor((F.col("pos") - F.lit(low)) / third) == k).write.mode("append").parquet(f"{root}/in")
        stream = versioned(spark.readStream.schema(changes.schema).parquet(f"{root}/in"), ["type", "half"])
        stream.writeStream.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start(f"{root}/out", format="parquet").awaitTermination()
    return _long(spark.read.parquet(f"{root}/out").select("record_key", "pos", "version_number", "action"))


@query(f"WITH {_CHAIN} SELECT 'user:' || user_id AS record_key, max(version_number) AS version_number, arg_max(type, pos) AS type, (list(half ORDER BY pos DESC))[1] AS half FROM v GROUP BY 1")
def current_view(spark, sf):
    log = versions.apply(spark.createDataFrame([], "record_key string, version_number int, action string, changed map<string,struct<old:string,new:string>>, snapshot map<string,string>, is_active boolean, updated_at timestamp"), _changes(spark, sf), ["type", "half"], RUN_TIME)[0]
    return _long(versions.active(log).select("record_key", "version_number", F.element_at("snapshot", "type").alias("type"), F.element_at("snapshot", "half").alias("half")))


@query(f"WITH {_CHAIN} SELECT 'user:' || user_id AS record_key, version_number, 'half' AS field, old_half AS old, half AS new FROM v WHERE rn > 1 AND half IS DISTINCT FROM old_half UNION ALL SELECT 'user:' || user_id, version_number, 'type', old_type, type FROM v WHERE rn > 1 AND type IS DISTINCT FROM old_type")
def history_diff(spark, sf):
    rows = versions.chain(_changes(spark, sf), ["type", "half"]).select("record_key", "version_number", F.explode("changed").alias("field", "c"))
    return _long(rows.select("record_key", "version_number", "field", F.col("c.old").alias("old"), F.col("c.new").alias("new")))


@query(f"WITH {_CHAIN} SELECT CASE WHEN rn = 1 THEN 'inserted' ELSE 'updated' END AS action, count(*) AS n FROM v GROUP BY 1")
def upsert_actions(spark, sf):
    empty = spark.createDataFrame([], "record_key string, version_number int, action string, changed map<string,struct<old:string,new:string>>, snapshot map<string,string>, is_active boolean, updated_at timestamp")
    return versions.apply(empty, _changes(spark, sf), ["type", "half"], RUN_TIME)[1].groupBy("action").agg(F.count("*").alias("n"))


@query(f"WITH {_CHAIN} SELECT version_number, CASE WHEN rn = 1 THEN 'inserted' ELSE 'updated' END AS action, type, half FROM v WHERE user_id = 3 AND moves")
def version_history(spark, sf):
    empty = spark.createDataFrame([], VERSIONS)
    log = versions.apply(empty, _changes(spark, sf), ["type", "half"], RUN_TIME)[0]
    return _long(versions.history(log, "user:3").select("version_number", "action", F.element_at("snapshot", "type").alias("type"), F.element_at("snapshot", "half").alias("half")))


@query(f"WITH {_CHAIN}, l2 AS (SELECT user_id, max(version_number) AS version_number FROM v GROUP BY 1) SELECT 'user:' || user_id AS record_key, version_number, user_id % 4 <> 0 AS is_active FROM l2")
def soft_deletes(spark, sf):
    """The last state of every record after tombstones for some."""
    empty = spark.createDataFrame([], VERSIONS)
    log = versions.apply(empty, _changes(spark, sf), ["type", "half"], RUN_TIME)[0]
    gone = _t(spark, sf, "events").where("user_id % 4 = 0").select(F.concat(F.lit("user:"), F.col("user_id")).alias("record_key"))
    log = log.unionByName(versions.tombstones(log, gone, RUN_TIME + datetime.timedelta(days=1)))
    return _long(versions.latest(log).select("record_key", "version_number", "is_active"))


@query(f"WITH {_CHAIN}, before AS (SELECT user_id, arg_max(type, pos) AS type, (list(half ORDER BY pos DESC))[1] AS half, max(version_number) AS n FROM v GROUP BY 1), again AS (SELECT user_id, n, user_id % 2 = 0 AS odd, CASE WHEN user_id % 2 = 0 THEN 'other' ELSE type END AS type FROM before) SELECT 'user:' || user_id AS record_key, 'updated' AS action, n + CASE WHEN odd THEN 1 ELSE 0 END AS version_number FROM again")
def upsert_again(spark, sf):
    """Against a log that has every record: half of them change."""
    empty = spark.createDataFrame([], VERSIONS)
    log = versions.apply(empty, _changes(spark, sf), ["type", "half"], RUN_TIME)[0]
    key = F.split("record_key", ":")[1].cast("bigint")
    more = versions.active(log).select("record_key", F.lit(0).cast("bigint").alias("pos"), F.map_from_arrays(F.array(F.lit("type")), F.array(F.when(key % 2 == 0, "other").otherwise(F.element_at("snapshot", "type")))).alias("fields"))
    return _long(versions.apply(log, more, ["type", "half"], RUN_TIME + datetime.timedelta(days=1))[1].select("record_key", "action", "version_number"))


# --- raw records ---
_RAW = {
    "zenodo": """'{"doi":"","metadata":{"title":"T' || k || '","publication_date":"20' || lpad(CAST(k % 25 AS VARCHAR), 2, '0') || '-01-02","doi":"10.1/' || k || '","creators":[{"name":"A, B"},{"name":""},{"x":1}],"keywords":"a, b ,c"},"links":{"html":"http://z/' || k || '"}}'""",
    "kaggle": """'{"titleNullable":"","title":"T' || k || '","creatorName":"C' || k || '","lastUpdated":"2019-03-04 01:02:03","tags":[{"name":"t1"},{}],"ref":"r/' || k || '"}'""",
    "openalex": """'{"title":"T' || k || '","doi":"https://doi.org/10.2/' || k || '","publication_year":' || (k % 2 * 2001) || ',"authorships":[{"author":{"display_name":"D' || k || '"}},{"author":{}}],"keywords":[{"display_name":"d"},{"keyword":"e"},"f"],"primary_location":{"landing_page_url":"http://o/' || k || '"}}'""",
    "datacite": """'{"attributes":{"titles":[{"title":"T' || k || '"}],"creators":[{"name":"E"}],"publicationYear":2011,"doi":"10.3/' || k || '","subjects":[{"subject":"s"},{"subject":""}],"url":"http://d/' || k || '"}}'""",
}


@query("""WITH p AS (SELECT p_partkey AS k, p_partkey % 5 AS s FROM part)
SELECT k AS pos, 'T' || k AS title, CASE s WHEN 0 THEN 'A, B' WHEN 1 THEN 'C' || k WHEN 2 THEN 'D' || k ELSE 'E' END AS authors,
 CAST(CASE s WHEN 0 THEN 2000 + k % 25 WHEN 1 THEN 2019 WHEN 2 THEN nullif(k % 2 * 2001, 0) ELSE 2011 END AS BIGINT) AS publication_year, CASE s WHEN 0 THEN '10.1/' || k WHEN 2 THEN '10.2/' || k WHEN 3 THEN '10.3/' || k END AS doi,
 CASE s WHEN 0 THEN 'a|b|c' WHEN 1 THEN 't1|' WHEN 2 THEN 'd|e|f' ELSE 's' END AS keywords, CASE s WHEN 0 THEN 'Zenodo' WHEN 1 THEN 'Kaggle' WHEN 2 THEN 'OpenAlex' ELSE 'DataCite' END AS repository,
 CASE s WHEN 0 THEN 'http://z/' || k WHEN 1 THEN 'https://www.kaggle.com/datasets/r/' || k WHEN 2 THEN 'http://o/' || k ELSE 'http://d/' || k END AS access_url FROM p WHERE s < 4""")
def flatten_sources(spark, sf):
    part = _t(spark, sf, "part").select(F.col("p_partkey").alias("k"))
    raw = F.when(F.lit(False), F.lit(""))
    source = F.when(F.lit(False), F.lit(""))
    for n, (name, sql) in enumerate(_RAW.items()):
        raw = raw.when(F.col("k") % 5 == n, F.expr(sql.replace("VARCHAR", "STRING")))
        source = source.when(F.col("k") % 5 == n, name)
    raws = part.select(F.col("k").alias("pos"), raw.otherwise("{}").alias("raw"), source.otherwise("unknown").alias("_source"))
    out = flatten(raws, carry=("pos",))
    return _long(out.select("pos", "title", F.array_join("authors", "|").alias("authors"), "publication_year", "doi", F.array_join("keywords", "|").alias("keywords"), "repository", "access_url"))


@query("""SELECT event_id, md5('{"a":{"k":' || json_extract(props, '$.k') || ',"u":' || user_id || '},"t":"' || event_type || '"}') AS h FROM events""")
def content_hashes(spark, sf):
    """Keys in order at every depth, however the record has them."""
    raw = F.concat(F.lit('{"t": "'), "event_type", F.lit('", "a": {"u":'), F.col("user_id"), F.lit(', "k": '), F.try_variant_get(F.parse_json("props"), "$.k", "string"), F.lit("}}"))
    return _t(spark, sf, "events").select("event_id", dedup.content_hash(raw).alias("h"))


@query("SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'Smith, J ' || c_custkey || '|Roe, Ann' WHEN 1 THEN 'Doe, Jo|' || c_custkey || ', Al' WHEN 3 THEN 'Aristotle' END AS names FROM customer")
def author_lists(spark, sf):
    """Names as objects, whose name stands under one of three keys, and as one string."""
    c, k = _t(spark, sf, "customer"), F.col("c_custkey")
    one = lambda a, b, d: F.struct(a.cast("string").alias("name"), b.cast("string").alias("full_name"), d.cast("string").alias("display_name"))
    none = F.lit(None)
    objects = F.when(k % 4 == 0, F.array(one(F.concat(F.lit("Smith, J "), k), none, none), one(F.lit(""), none, F.lit("Ann Roe")))).when(k % 4 == 2, F.array(one(none, none, none))).when(k % 4 == 3, F.array(one(none, F.lit(" Aristotle "), F.lit("x"))))
    strings = F.when(k % 4 == 1, F.concat(F.lit("Jo Doe & Al "), k, F.lit(" and ; ")))
    made = normalise.normalise(c.select(k.alias("id"), objects.alias("creators"), strings.alias("authors")))
    return made.select("id", F.array_join(F.coalesce("creators", "authors"), "|").alias("names"))


@query("SELECT c_custkey % 3 AS kind, count(*) AS n, sum(CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END) AS notes, sum(CASE WHEN c_custkey % 3 = 1 THEN 1 ELSE 0 END) AS with_authors FROM customer GROUP BY 1")
def name_conflicts(spark, sf):
    """Where two lists differ, a note tells of it and one is left out."""
    c, k = _t(spark, sf, "customer"), F.col("c_custkey")
    rows = c.select(k.alias("id"), F.array("c_name").alias("creators"), F.when(k % 3 == 0, F.array(F.upper("c_mktsegment"))).when(k % 3 == 1, F.array("c_name")).alias("authors"))
    out = normalise.resolve_conflicts(rows)
    return out.groupBy((F.col("id") % 3).alias("kind")).agg(F.count("*").alias("n"), F.sum(F.size("conflict_notes")).alias("notes"), F.count("authors").alias("with_authors"))
