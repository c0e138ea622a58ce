import datetime
import http.server
import json
import threading
import urllib.parse

import pytest
from bibliarium.operators import dedup, dims, merge, normalise, validate, versions
from bibliarium.plans import pipeline
from bibliarium.plans import search as S
from bibliarium.schemas import VERSIONS
from bibliarium.sources import files, rest
from bibliarium.sources.tables import Store
from bibliarium.streaming.upserts import upsert_stream
from pyspark.sql import functions as F

NOW = datetime.datetime(2025, 5, 5)
BASE = {"title": "A Study on Climate Data", "doi": "10.1234/climate.2023", "publication_year": "2023", "source_id": "zenodo-12345"}


def records(spark, *changes):
    rows = [(i, *({**BASE, **c}[k] for k in BASE)) for i, c in enumerate(changes)]
    return spark.createDataFrame(rows, "pos long, title string, doi string, publication_year string, source_id string")


def test_validation_takes_the_first_failing_rule(spark):
    cases = [
        ({}, None), ({"title": " "}, "MISSING_TITLE"), ({"title": None, "doi": "x"}, "MISSING_TITLE"), ({"doi": None}, None), ({"doi": None, "source_id": ""}, "MISSING_IDENTIFIER"), ({"source_id": None}, None),
        ({"doi": "http://example.com/not-a-doi"}, "INVALID_DOI"), ({"doi": "https://doi.org/10.1234/abc"}, None), ({"publication_year": None}, "MISSING_YEAR"), ({"publication_year": "1899"}, "INVALID_YEAR"), ({"publication_year": "2026"}, "INVALID_YEAR"), ({"publication_year": "not-a-year"}, "INVALID_YEAR"), ({"publication_year": "2025"}, None),
    ]
    out = validate.validate(records(spark, *(c for c, _ in cases)), 2025).orderBy("pos").collect()
    assert [r.reason_code for r in out] == [w for _, w in cases]
    assert [r.year_uncertain for r in out][-1] and not out[0].year_uncertain and out[11].year_uncertain and not out[0].missing_title_flag
    accepted, rejected = validate.route(validate.validate(records(spark, {}, {"title": "Ab"}, {"title": ""}), 2025), NOW)
    assert accepted.count() == 2 and validate.flagged_count(accepted).first().flagged == 1
    row = rejected.first()
    assert row.reason_code == "MISSING_TITLE" and json.loads(row.raw_record)["source_id"] == "zenodo-12345" and row.rejected_at == NOW


def test_normalise(spark):
    df = spark.createDataFrame([(" <i>T</i> &amp; x", [("Jane Smith", None)], ["Jane Smith"], "k; J", "https://doi.org/10.1/A", "2020", " Zenodo ", True)], "title string, creators array<struct<name:string,full_name:string>>, authors array<string>, keywords string, doi string, publication_year string, repository string, year_uncertain boolean")
    r = normalise.normalise(df).first()
    assert (r.title, r.creators, r.authors, r.keywords, r.doi, r.publication_year, r.repository, r.year_uncertain) == ("T & x", ["Smith, Jane"], None, ["j", "k"], "10.1/A", 2020, "Zenodo", True)
    assert len(r.conflict_notes) == 1
    same = spark.createDataFrame([(["A B"], ["A B"]), (["A B"], None), (["A B"], ["C D"])], "creators array<string>, authors array<string>")
    assert [len(x.conflict_notes) for x in normalise.normalise(same).collect()] == [0, 0, 1]


def test_partition_merge_and_fold(spark):
    existing = spark.createDataFrame([(1, "Deep Learning for Climate Data", "10.1/A", None, 5, True), (2, "Other Title Entirely", None, "x", None, True), (3, "Gone", "10.9/z", None, None, False)], "id long, title string, doi string, abstract string, citation_count int, is_active boolean").withColumn("version_number", F.lit(1))
    incoming = spark.createDataFrame([(0, "whatever", "https://doi.org/10.1/a", "abs"), (1, "Deep Learning for Climate Datas", None, None), (2, "Brand new", "10.9/z", None), (3, "again", "doi:10.1/A", "abs2")], "pos long, title string, doi string, abstract string")
    parted = dedup.partition(incoming, existing)
    assert {r.pos: (r.dup_type, r.matched_id) for r in parted.collect()} == {0: ("exact", 1), 1: ("fuzzy", 1), 2: ("clean", None), 3: ("exact", 1)}
    assert dedup.merge_log(parted, NOW).count() == 3 and dedup.review_queue(parted).count() == 1
    out = {r.id: r for r in merge.fold(existing, parted).collect()}
    assert len(out) == 3 and out[1].abstract == "abs" and out[1].version_number == 2 and out[1].title.startswith("Deep") and out[2].version_number == 1
    assert [r.is_active for r in merge.soft_delete(existing, spark.createDataFrame([(2,)], "id long")).orderBy("id").collect()] == [True, False, False]
    assert {r.pos for r in dedup.exact_matches(incoming, existing).collect()} == {0, 3} and {r.pos for r in dedup.not_exact(incoming, existing).collect()} == {1, 2}


def test_content_hash_ignores_key_order(spark):
    df = spark.createDataFrame([('{"a":1,"b":{"c":2,"d":3}}',), ('{"b":{"d":3,"c":2},"a":1}',), ('{"a":2}',)], "raw string").select(dedup.content_hash(F.col("raw")).alias("h"))
    a, b, c = (r.h for r in df.collect())
    assert a == b != c and dedup.duplicate_count(df, "h").first().duplicates == 1


def test_dimensions(spark):
    rows = spark.createDataFrame([(1, ["B ", "A", "b", "", None]), (2, ["A", "C"])], "id long, authors array<string>")
    values = dims.members(rows, "authors", lower=False)
    dim = dims.get_or_create(values, spark.createDataFrame([(4, "A")], "id bigint, name string"), "name")
    got = {r.name: r.id for r in dim.collect()}
    assert got["A"] == 4 and sorted(got.values()) == [4, 5, 6, 7] and set(got) == {"A", "B", "b", "C"}
    assert {(r.record_id, r.author_id, r.author_order) for r in dims.links(values, dim, "name", "author_id", "author_order").collect()} == {(1, got["B"], 0), (1, 4, 1), (1, got["b"], 2), (2, 4, 0), (2, got["C"], 1)}


def test_version_log(spark):
    cols = ["title", "abstract"]
    change = lambda *x: spark.createDataFrame([(k, p, f) for k, p, f in x], "record_key string, pos long, fields map<string,string>")
    log = spark.createDataFrame([], VERSIONS)

    def step(log, *x, day=1):
        rows, out = versions.apply(log, change(*x), cols, NOW + datetime.timedelta(days=day))
        return spark.createDataFrame(log.unionByName(rows).collect(), VERSIONS), {(r.record_key, r.pos): (r.action, r.version_number) for r in out.collect()}

    log, out = step(log, ("a", 0, {"title": "T", "abstract": "x"}), ("a", 1, {"title": "U"}), ("a", 2, {"abstract": None}), ("b", 3, {"title": "B"}))
    assert out == {("a", 0): ("inserted", 1), ("a", 1): ("updated", 2), ("a", 2): ("updated", 3), ("b", 3): ("inserted", 1)}
    log, out = step(log, ("a", 0, {"title": "U", "other": "1"}), ("b", 1, {"title": "C"}), day=2)
    assert out == {("a", 0): ("updated", 3), ("b", 1): ("updated", 2)}
    h = versions.history(log, "a").collect()
    assert [r.version_number for r in h] == [1, 2, 3] and h[0].changed == {} and h[1].changed["title"].new == "U" and h[2].snapshot == {"title": "U", "abstract": None}
    log = spark.createDataFrame(log.unionByName(versions.tombstones(log, change(("a", 0, {})), NOW + datetime.timedelta(days=3))).collect(), VERSIONS)
    assert [r.record_key for r in versions.active(log).collect()] == ["b"] and versions.history(log, "a").count() == 3
    log, out = step(log, ("a", 0, {"title": "U"}), ("c", 1, {"title": "new"}), day=4)
    assert out[("a", 0)][1] == 4 and {r.record_key for r in versions.active(log).collect()} == {"a", "b", "c"}


@pytest.fixture
def server():
    class Handler(http.server.BaseHTTPRequestHandler):
        failed: list = []

        def do_GET(self):
            q = dict(urllib.parse.parse_qsl(urllib.parse.urlparse(self.path).query))
            if "cursor" in q:
                n = 0 if q["cursor"] == "*" else int(q["cursor"])
                body = {"results": [{"title": f"o{n + k}"} for k in range(100 if n < 200 else 30)], "meta": {"next_cursor": str(n + 100) if n < 200 else None}}
            else:
                page = int(q["page"])
                if page == 2 and page not in self.failed:
                    self.failed.append(page)
                    self.send_response(429)
                    self.end_headers()
                    return
                body = {"hits": {"hits": [{"metadata": {"title": f"z{page}-{k}"}} for k in range(50 if page < 4 else 7 if page == 4 else 0)]}}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *a):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/"
    s.shutdown()


def test_rest_source(spark, server):
    rest.register(spark)
    load = lambda **o: spark.read.format("catalogue").options(base_url=server, wait=0, limit_wait=0, pause=0, **o).load()
    z = load(source="zenodo", max_records=400)
    assert z.count() == 157 and [r.pos for r in z.orderBy("pos").limit(3).collect()] == [0, 1, 2]
    assert load(source="zenodo", max_records=60).count() == 60
    assert load(source="openalex", max_records=500).count() == 230 and load(source="openalex", max_records=120).count() == 120
    assert load(source="kaggle").count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"b": 1, "a": "x\\ny"}, 3, {"a": null}]')
    (tmp_path / "o.json").write_text('{"a": 1}')
    (tmp_path / "s.json").write_text("7")
    (tmp_path / "c.csv").write_text('title,authors,year\n"A ""q"",\nb","X",2020-01-01\n,Y,\n')
    (tmp_path / "r.bib").write_text('@comment{x}\n@Article{k1, title = {A {B} C}, year = 2020,\n author="X, Y and Z",}\n\n@book{k2,\n title={D, e}}\n')
    assert [(r.raw, r.pos) for r in files.read_any(spark, f"{tmp_path}/a.json").orderBy("pos").collect()] == [('{"a":"x\\ny","b":1}', 0), ('{"a":null}', 2)]
    assert files.read_any(spark, f"{tmp_path}/o.json").count() == 1 and files.read_any(spark, f"{tmp_path}/s.json").count() == 0
    c = files.read_any(spark, f"{tmp_path}/c.csv").collect()
    assert [tuple(r) for r in c] == [('A "q",\nb', "X", "2020-01-01"), ("", "Y", "")]
    b = {r.entry_key: r for r in files.read_any(spark, f"{tmp_path}/r.bib").collect()}
    assert b["k1"].entry_type == "article" and b["k1"].fields == {"title": "A {B} C", "year": "2020", "author": "X, Y and Z"} and b["k2"].fields == {"title": "D, e"}
    assert files.read_any(spark, f"{tmp_path}/x.xml") is None and files.read_any(spark, f"{tmp_path}/none.json") is None
    with pytest.raises(FileNotFoundError):
        files.read_required(spark, f"{tmp_path}/none.json")
    files.write_csv(spark.createDataFrame([(["a", "b"], 'x"y')], "k array<string>, t string"), f"{tmp_path}/out")
    assert spark.read.csv(f"{tmp_path}/out", header=True, escape='"').first() == ("a, b", 'x"y')
    files.write_json(spark.range(2), f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 2


def test_pipeline_of_the_catalogue(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(f"{tmp_path}/cp")
    z = lambda t, d, *k: json.dumps({"doi": d, "metadata": {"title": t, "publication_date": "2020-02-02", "creators": [{"name": "A, B"}, {"name": "C"}], "keywords": list(k)}})
    raws = [(z("One title", "10.1/one", "k1"), "zenodo", 0), (z("One title", "10.1/one", "k1"), "zenodo", 1), (z("One again", "10.1/ONE"), "zenodo", 2), (z("Two", None, "K1", "k2"), "zenodo", 3), ("{}", "nowhere", 4)]
    frame = lambda r: spark.createDataFrame(r, "raw string, _source string, pos long")
    got = pipeline.run(spark, f"{tmp_path}/db", frame(raws), NOW)
    store = Store(spark, f"{tmp_path}/db")
    assert got["inserted"] == 2 and {r.title for r in store.read("records").collect()} == {"One title", "Two"}
    assert {r.keyword for r in store.read("keywords").collect()} == {"k1", "k2"} and store.read("authors").count() == 2 and store.read("record_authors").count() == 4
    more = [(json.dumps({"attributes": {"titles": [{"title": "One other"}], "doi": "https://doi.org/10.1/one", "url": "http://u", "publicationYear": 2020}}), "datacite", 0), (z("Twos", "10.1/new"), "zenodo", 1)]
    got = pipeline.run(spark, f"{tmp_path}/db", frame(more), NOW)
    rows = {r.title: r for r in store.read("records").collect()}
    assert got["exact"] == 1 and got["inserted"] == 1 and rows["One title"].access_url == "http://u" and rows["One title"].version_number == 2
    assert sorted(r.id for r in rows.values()) == [1, 2, 3] and store.read("merge_log").count() == 1
    assert [r.status for r in spark.read.parquet(f"{tmp_path}/db/runs").collect()] == ["success", "success"]
    assert "completeness" in store.columns("records") and store.columns("none") == []
    store.drop()
    assert store.read("records").count() == 0


def test_curation_is_idempotent_and_streams(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/db")
    store.create()
    rows = records(spark, {}, {"doi": "10.1234/b", "title": "Second"}, {"title": " "})
    assert pipeline.curate(store, rows, NOW, 2025, f"{tmp_path}/rej", f"{tmp_path}/norm") == {"loaded": 3, "accepted": 2, "rejected": 1, "flagged": 0, "inserted": 2}
    again = pipeline.curate(store, rows, NOW, 2025)
    assert again["inserted"] == 0 and again["updated"] == 2 and store.read("record_versions").count() == 2
    records(spark, {"title": "A changed title"}).write.json(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).json(f"{tmp_path}/in")
    upsert_stream(stream, store, f"{tmp_path}/cp", 2025).awaitTermination()
    h = versions.history(store.read("record_versions"), "doi:10.1234/climate.2023").collect()
    assert [r.version_number for r in h] == [1, 2] and h[1].snapshot["title"] == "A changed title"


def test_search_extras(spark):
    df = spark.createDataFrame([("T1", "Ann Lee; Bob Ray", 2000, "10/1", "x;y"), ("T2", "Ann Lee; Cid Moe", 2001, None, "X"), ("T3", "Cid Moe; Dan Fox", 2001, "10/3", None), ("T4", None, 0, "", "z")], "title string, authors string, year int, doi string, keywords string")
    assert [r.title for r in S.search(df, "lee", "author")[0].collect()] == ["T2", "T1"]
    assert [r.title for r in S.search(df, "", year_from=2001, year_to=2000, sort="oldest")[0].collect()] == ["T1", "T2", "T3"]
    assert S.search(df, "a\\q")[0].count() == 0 and S.search(df, category="x", exact_year=2001)[1].first().total_count == 1
    nodes, edges = S.network(df, "Ann Lee", depth=2)
    assert {r.id for r in nodes.collect()} == {"Ann Lee", "Bob Ray", "Cid Moe", "Dan Fox"} and edges.count() == 3
    assert {r.id for r in S.network(df, "Ann Lee")[0].where("is_seed").collect()} == {"Ann Lee"}
    papers, counts, cats = S.researcher(df, "Ann Lee")
    assert papers.count() == 2 and counts.count() == 2 and cats.first().category == "x"
    assert S.info(df).first() == (4, 2000, 2001) and S.info(df.where("false")).first() == (0, 1990, 2026)
    assert spark.range(1).select(S.page_window(F.lit(1), F.lit(9))).first()[0] == [1, 2, 3, 4]
    assert S.matching(df.select("authors"), "x").count() == 0
