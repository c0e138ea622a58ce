"""Paged REST catalogues as a Spark data source, format "catalogue".

Options: source (zenodo, kaggle, openalex, datacite), base_url, query, max_records, token, and retries, wait, limit_wait,
pause in seconds. A source's pages are read one after the other by one task, which keeps to the pause between requests
and leaves no hole: an attempt that fails waits longer each time, and a source whose attempts run out ends with the
pages before. Sources are read side by side. A catalogue that needs a token gives no rows without one.

As a stream, a micro-batch is one page, and its offset the page or cursor that comes next: a scan that failed goes on
with the first page that no batch has committed, and no committed page is fetched again. A page whose attempts run out
fails the query, which begins there when it is started again. One page at a time goes through the
driver; a source that has ended asks for nothing more. Trigger.AvailableNow takes one page.

With the option years=true rows have a column year (int, null where a record tells none), and filters on it go into the
request as a range of years, which narrows what max_records counts, too; Spark filters what comes again, so that a
catalogue that knows no such parameter gives the same rows. Null years never pass a pushed filter, as none passes
Spark's. Needs spark.sql.python.filterPushdown.enabled, which register() sets.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, SimpleDataSourceStreamReader


@dataclass
class Catalogue:
    url: str
    size: int
    fixed: dict
    page: str
    size_name: str
    query: str
    hits: tuple[str, ...]
    first: int = 1
    cursor: bool = False
    needs_token: bool = False
    year: tuple[str, ...] = ()
    years: tuple[str, str, str, str] = ("", "", "", "")  # parameter, what joins it to a value there, from, to


#: Addresses, page sizes and parameters of the public interfaces.
CATALOGUES = {
    "zenodo": Catalogue("https://zenodo.org/api/records", 50, {"type": "dataset"}, "page", "size", "q", ("hits", "hits"), year=("metadata", "publication_date"), years=("q", " AND ", "publication_date:[{}-01-01 TO *]", "publication_date:[* TO {}-12-31]")),
    "kaggle": Catalogue("https://www.kaggle.com/api/v1/datasets/list", 20, {"sortBy": "votes"}, "page", "pageSize", "search", (), needs_token=True),
    "openalex": Catalogue("https://api.openalex.org/works", 100, {"filter": "type:dataset", "select": "id,title,doi,publication_year,authorships,keywords,primary_location"}, "cursor", "per-page", "search", ("results",), cursor=True, year=("publication_year",), years=("filter", ",", "from_publication_date:{}-01-01", "to_publication_date:{}-12-31")),
    "datacite": Catalogue("https://api.datacite.org/dois", 100, {"resource-type-id": "dataset", "sort": "-created"}, "page[number]", "page[size]", "query", ("data",), year=("attributes", "publicationYear"), years=("query", " AND ", "publicationYear:[{} TO *]", "publicationYear:[* TO {}]")),
}


@dataclass
class Page(InputPartition):
    most: int


class Client:
    """One catalogue's pages."""

    def __init__(self, options: dict):
        self.source = options["source"]
        self.catalogue = CATALOGUES[self.source]
        self.url = options.get("base_url", self.catalogue.url)
        self.token, self.query = options.get("token"), options.get("query")
        self.most = int(options.get("max_records", 250))
        self.retries = int(options.get("retries", 3))
        self.wait, self.limit_wait, self.pause = (float(options.get(k, d)) for k, d in (("wait", 5), ("limit_wait", 10), ("pause", 1)))
        self.with_year = str(options.get("years", "false")).lower() == "true"
        self.low: int | None = None
        self.high: int | None = None

    @property
    def first(self) -> str | int:
        return "*" if self.catalogue.cursor else self.catalogue.first

    @property
    def closed(self) -> bool:
        return self.catalogue.needs_token and not self.token

    def fetch(self, params: dict) -> dict | list | None:
        request = urllib.request.Request(f"{self.url}?{urllib.parse.urlencode(params)}", headers={"Authorization": f"Bearer {self.token}"} if self.token else {})
        for attempt in range(1, self.retries + 1):
            try:
                with urllib.request.urlopen(request, timeout=15) as answer:
                    out = json.load(answer)
                time.sleep(self.pause)
                return out
            except urllib.error.HTTPError as e:
                time.sleep(self.limit_wait if e.code == 429 else self.wait * attempt)
            except (OSError, ValueError):
                time.sleep(self.wait * attempt)
        return None

    def params(self, mark: str | int) -> dict:
        c = self.catalogue
        out = c.fixed | {c.size_name: c.size, c.page: mark} | ({c.query: self.query} if self.query else {})
        name, join, *forms = c.years
        ranges = [form.format(f"{year:04d}") for form, year in zip(forms, (self.low, self.high)) if name and year is not None and 0 < year < 10_000]
        return out | ({name: join.join([out[name], *ranges] if out.get(name) else ranges)} if ranges else {})

    def page(self, mark: str | int) -> tuple[list, str | int | None] | None:
        """A page's records and the next page's mark (None at the end); None if its attempts run out."""
        c = self.catalogue
        answer = self.fetch(self.params(mark))
        if answer is None:
            return None
        hits = answer
        for key in c.hits:
            hits = hits.get(key, {}) if isinstance(hits, dict) else {}
        if not isinstance(hits, list) or not hits:
            return [], None
        return hits, (answer.get("meta", {}).get("next_cursor") or None) if c.cursor else mark + 1

    def row(self, hit, pos: int) -> tuple:
        return (json.dumps(hit, ensure_ascii=False), self.source, pos, *([self.year_of(hit)] if self.with_year else []))

    def year_of(self, hit) -> int | None:
        for key in self.catalogue.year:
            hit = hit.get(key) if isinstance(hit, dict) else None
        text = str(hit)[:4] if self.catalogue.year else ""
        return int(text) if len(text) == 4 and text.isascii() and text.isdigit() else None


class Reader(Client, DataSourceReader):
    def partitions(self) -> list[Page]:
        return [] if self.closed else [Page(self.most)]

    def read(self, partition: Page | None) -> Iterator[tuple]:
        if partition is None:  # what Spark hands out where there are no partitions
            return
        mark, pos = self.first, 0
        while pos < partition.most and mark is not None:
            found = self.page(mark)
            if found is None:
                return
            hits, mark = found
            for hit in hits[: partition.most - pos]:
                yield self.row(hit, pos)
                pos += 1


class YearReader(Reader):
    """Reader whose requests carry the years asked for."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == ("year",) and f.value is not None:
                low = f.value + 1 if isinstance(f, GreaterThan) else f.value
                high = f.value - 1 if isinstance(f, LessThan) else f.value
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.low = low if self.low is None else max(self.low, low)
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.high = high if self.high is None else min(self.high, high)
            yield f  # Spark filters again


class StreamReader(Client, SimpleDataSourceStreamReader):
    """Offsets: the mark of the next page (null at the end) and the position of its first record."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"mark": None if self.closed else self.first, "pos": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        mark, pos = start["mark"], start["pos"]
        if mark is None or pos >= self.most:
            return iter([]), start
        found = self.page(mark)
        if found is None:
            raise ConnectionError(f"{self.source}: page {mark} can't be had; the stream goes on there when it is started again")
        rows = [self.row(hit, pos + k) for k, hit in enumerate(found[0][: self.most - pos])]
        return iter(rows), {"mark": found[1], "pos": pos + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        """The rows of a batch that was planned and not committed, page by page."""
        at = start
        while at != end and at["mark"] is not None and at["pos"] < end["pos"]:
            rows, at = self.read(at)
            yield from (r for r in rows if r[2] < end["pos"])


class CatalogueSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "catalogue"

    def schema(self) -> str:
        return "raw string, _source string, pos bigint" + (", year int" if str(self.options.get("years", "false")).lower() == "true" else "")

    def _given(self) -> dict:
        return {k: self.options.get(k) for k in ("source", "base_url", "token", "query", "max_records", "retries", "wait", "limit_wait", "pause", "years") if self.options.get(k) is not None}

    def reader(self, schema) -> Reader:
        client = Reader(self._given())
        return YearReader(self._given()) if client.with_year else client

    def simpleStreamReader(self, schema) -> StreamReader:  # noqa: N802
        return StreamReader(self._given())


def register(spark) -> None:
    spark.dataSource.register(CatalogueSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)


def collect_all(spark, max_records: int = 1000, **options):
    """All four catalogues in order, a quarter of the records of each, as (raw, _source, pos)."""
    from functools import reduce

    from pyspark.sql import functions as F

    register(spark)
    parts = []
    for k, source in enumerate(CATALOGUES):
        df = spark.read.format("catalogue").options(source=source, max_records=max_records // 4, **{o: v[source] if isinstance(v, dict) else v for o, v in options.items() if not isinstance(v, dict) or source in v}).load()
        parts.append(df.withColumn("pos", F.col("pos") + k * max_records))
    return reduce(lambda a, b: a.unionByName(b), parts)
