"""Scans of paged catalogues that go on where they failed, and filters that reach the request."""

import http.server
import json
import threading
import urllib.parse

import pytest
from bibliarium.sources import rest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F


@pytest.fixture
def catalogue():
    """Numbered pages (230 records) or cursors, years 2000 to 2022 in turn; what was asked is kept, and what `refused` names fails."""

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            q = dict(urllib.parse.parse_qsl(urllib.parse.urlparse(self.path).query))
            mark, size = (q["cursor"], 100) if "cursor" in q else (q["page"], 50)
            s.asked.append(q)
            if mark in s.refused:
                self.send_response(503)
                self.end_headers()
                return
            low, high = s.range(q)
            every = [k for k in range(230) if low <= 2000 + k % 23 <= high]
            at = (0 if mark == "*" else int(mark)) if "cursor" in q else (int(mark) - 1) * size
            hits = [{"k": k, "publication_year": 2000 + k % 23, "metadata": {"publication_date": f"{2000 + k % 23}-02-03"} if k != 7 else None} for k in every[at : at + size]]
            body = {"results": hits, "meta": {"next_cursor": str(at + size) if at + size < len(every) else None}} if "cursor" in q else {"hits": {"hits": hits}}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *a):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    s.asked, s.refused, s.range = [], set(), lambda q: (0, 9999)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s
    s.shutdown()


def options(s, source, **more):
    return {"source": source, "base_url": f"http://127.0.0.1:{s.server_port}/", "wait": 0, "limit_wait": 0, "pause": 0, "max_records": 1000} | more


def drain(spark, s, source, path, **more):
    q = spark.readStream.format("catalogue").options(**options(s, source, **more)).load().writeStream.format("parquet").option("checkpointLocation", f"{path}/cp").option("path", f"{path}/out").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


@pytest.mark.parametrize("source,bad,marks", [("zenodo", "3", ["1", "2", "3", "4", "5", "6"]), ("openalex", "100", ["*", "100", "200"])])
def test_a_scan_goes_on_where_it_failed(spark, catalogue, tmp_path, source, bad, marks):
    rest.register(spark)
    name = "cursor" if source == "openalex" else "page"
    catalogue.refused = {bad}
    with pytest.raises(StreamingQueryException):
        drain(spark, catalogue, source, tmp_path, retries=2)
    first = [q[name] for q in catalogue.asked]
    done = marks[: marks.index(bad)]
    assert first == done + [bad] * 2
    catalogue.refused, catalogue.asked = set(), []
    drain(spark, catalogue, source, tmp_path)
    assert [q[name] for q in catalogue.asked] == marks[marks.index(bad) :]
    catalogue.asked = []
    drain(spark, catalogue, source, tmp_path)
    assert catalogue.asked == []  # the source has ended
    rows = spark.read.parquet(f"{tmp_path}/out").orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(230)) and [json.loads(r.raw)["k"] for r in rows] == list(range(230))
    batch = spark.read.format("catalogue").options(**options(catalogue, source)).load().orderBy("pos").collect()
    assert [tuple(r) for r in batch] == [tuple(r) for r in rows]


def test_the_limit_of_records_and_a_missing_token(spark, catalogue, tmp_path):
    rest.register(spark)
    drain(spark, catalogue, "zenodo", f"{tmp_path}/z", max_records=60)
    assert spark.read.parquet(f"{tmp_path}/z/out").count() == 60 and len(catalogue.asked) == 2
    catalogue.asked = []
    drain(spark, catalogue, "kaggle", f"{tmp_path}/k")
    assert catalogue.asked == []


def test_a_planned_batch_is_read_again_in_full(catalogue):
    reader = rest.StreamReader({k: str(v) for k, v in options(catalogue, "zenodo").items()})
    at, seen = reader.initialOffset(), []
    for _ in range(3):
        rows, at = reader.read(at)
        seen += rows
    assert list(reader.readBetweenOffsets(reader.initialOffset(), at)) == seen and len(seen) == 150


@pytest.mark.parametrize("source", ["zenodo", "openalex"])
def test_years_reach_the_request(spark, catalogue, source):
    rest.register(spark)
    load = lambda: spark.read.format("catalogue").options(**options(catalogue, source, years="true", query="soil")).load()
    every = {(r.pos, r.year) for r in load().collect()}
    assert len(every) == 230 and all("2003" not in json.dumps(q) for q in catalogue.asked)
    wide = load().where("year > 2002 AND year <= 2005")
    ks = lambda df: sorted(json.loads(r.raw)["k"] for r in df.collect())
    want = [k for k in range(230) if 3 <= k % 23 <= 5 and (source == "openalex" or k != 7)]
    catalogue.asked = []
    assert ks(wide) == want  # a server that does not know the parameter
    low, high = {"zenodo": ("publication_date:[2003-01-01 TO *]", "publication_date:[* TO 2005-12-31]"), "openalex": ("from_publication_date:2003-01-01", "to_publication_date:2005-12-31")}[source]
    key = {"zenodo": "q", "openalex": "filter"}[source]
    assert all(low in q[key] and high in q[key] and ("soil" in q[key] or q["search"] == "soil") for q in catalogue.asked) and catalogue.asked
    catalogue.asked, catalogue.range = [], lambda q: (2003, 2005)
    assert ks(wide) == want and len(catalogue.asked) < 3  # a server that does
    catalogue.asked, catalogue.range = [], lambda q: (0, 9999)
    assert ks(load().where(F.col("year").isNull())) == ([7] if source == "zenodo" else [])
    assert all("TO" not in q.get("q", "") for q in catalogue.asked)
    assert ks(load().where("year = 2004")) == [k for k in range(230) if k % 23 == 4]
