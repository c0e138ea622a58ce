import datetime
import json
import os

import pytest
from bibliarium.operators import versions
from bibliarium.plans import pipeline
from bibliarium.schemas import RECORDS, VERSIONS
from bibliarium.sources.tables import MOST_FOLDERS, Store

NOW = datetime.datetime(2025, 5, 5)


def buckets(store, table):
    """Of each bucket, the files that the store reads."""
    out = {}
    for key, folder in store._manifest()[table]:
        out.setdefault(key, set()).update(f"{folder}/{n}" for n in os.listdir(folder) if n.endswith(".parquet"))
    return out


def records(spark, rows):
    none = {f.name: None for f in RECORDS}
    return spark.createDataFrame([none | {"id": k, "title": t, "is_active": True, "version_number": 1} for k, t in rows], RECORDS)


def zenodo(title, doi, *words):
    return json.dumps({"doi": doi, "metadata": {"title": title, "publication_date": "2020-02-02", "creators": [{"name": f"{w}, A"} for w in words], "keywords": list(words)}})


def raws(spark, *rows):
    return spark.createDataFrame([(r, "zenodo", k) for k, r in enumerate(rows)], "raw string, _source string, pos long")


def test_an_upsert_writes_the_buckets_of_its_rows_only(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/db", buckets=32)
    store.create()
    store.upsert("records", records(spark, [(k, f"t{k}") for k in range(400)]))
    before = buckets(store, "records")
    assert len(before) == 32
    store.upsert("records", records(spark, [(7, "new"), (399, "also new"), (1000, "more")]))
    after = buckets(store, "records")
    assert 1 <= sum(before.get(b) != after[b] for b in after) <= 3
    assert all(os.path.exists(f) for files in before.values() for f in files)  # readers of the manifest before still have them
    got = {r.id: r.title for r in store.read("records").collect()}
    assert len(got) == 401 and got[7] == "new" and got[1000] == "more" and got[8] == "t8"
    near = store.near("records", spark.createDataFrame([(7,), (None,)], "id long"))
    assert 7 in {r.id for r in near.collect()} and near.count() < 100
    store.upsert("records", records(spark, [(8, "x")]))
    gone = {f for files in before.values() for f in files} - {f for files in buckets(store, "records").values() for f in files}
    assert any(not os.path.exists(f) for f in gone)
    assert Store(spark, f"{tmp_path}/db", buckets=5)._count() == 32


def test_a_small_insert_leaves_most_buckets_of_every_table(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/db")
    store.create()
    many = [zenodo(f"{'abcdefghij'[k % 10] * 9} {k * 7919} title of number {k}", f"10.1/{k}", f"w{k}", f"v{k}") for k in range(116)]
    forms = ["10.1234/abc", "https://doi.org/10.1234/abc", "doi:10.1234/ABC", " HTTP://dx.doi.org/10.1234/aBc "]  # one identifier
    many += [zenodo(f"Title {'xyzw'[k] * 8}", d, "k") for k, d in enumerate(forms)] + [zenodo(t, None) for t in ("No identifier one", "Other, none either", "Third of none")]
    assert pipeline.insert(store, pipeline.ingest(raws(spark, *many)), NOW)["inserted"] == 120
    assert [r.title for r in store.read("records").where("title LIKE 'Title %'").collect()] == ["Title xxxxxxxx"]
    before = {t: buckets(store, t) for t in ("records", "authors", "keywords")}
    assert all(len(b) == 16 for b in before.values()) and store.read("records").count() == 120
    full = json.dumps({"doi": "10.1/5", "metadata": {"title": "again", "publication_date": "2021-01-01", "creators": [{"name": "w5, A"}], "description": "a"}, "links": {"html": "http://x"}})
    got = pipeline.insert(store, pipeline.ingest(raws(spark, zenodo("Quite another thing", "10.1/new", "w5", "fresh"), full)), NOW)
    assert got["inserted"] == 1 and got["exact"] == 1
    for table, most in (("records", 2), ("authors", 1), ("keywords", 1)):
        after = buckets(store, table)
        assert sum(before[table].get(b) != after[b] for b in after) <= most, table
        assert {b: f for b, f in before[table].items() if b not in after} == {}
    assert store.read("records").count() == 121 and store.read("authors").where("name = 'fresh, A'").count() == 1
    assert store.read("records").where("doi = '10.1/5'").first().access_url == "http://x"


def test_inserting_an_active_record_again_is_an_error(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/db")
    store.create()
    frame = lambda *rows: spark.createDataFrame([(k, t, d, f"s{t}") for k, (t, d) in enumerate(rows)], "pos long, title string, doi string, source_id string")
    assert pipeline.insert_new(store, frame(("A", "10.1/a"), ("B", None)), NOW) == 2
    for again in (("C", "https://doi.org/10.1/A"), ("B", None)):
        with pytest.raises(ValueError, match="there already"):
            pipeline.insert_new(store, frame(("New", "10.1/new"), again), NOW)
    with pytest.raises(ValueError, match="doi:10.1/x"):
        pipeline.insert_new(store, frame(("X", "10.1/x"), ("Y", "doi:10.1/X")), NOW)
    assert store.read("record_versions").count() == 2
    log = store.read("record_versions")
    store.add("record_versions", versions.tombstones(log, spark.createDataFrame([("doi:10.1/a",)], "record_key string"), NOW + datetime.timedelta(days=1)))
    assert pipeline.insert_new(store, frame(("A2", "10.1/a")), NOW + datetime.timedelta(days=2)) == 1
    assert {r.record_key: r.version_number for r in versions.active(store.read("record_versions")).collect()} == {"doi:10.1/a": 2, "src:sB": 1}


def test_many_small_batches_leave_few_folders(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/db", buckets=2)
    store.create()
    for day in range(2 * MOST_FOLDERS):
        rows = [("k1" if day % 2 else "k2", day, "updated", {}, {"title": str(day)}, True, NOW + datetime.timedelta(days=day))]
        store.add("record_versions", spark.createDataFrame(rows, VERSIONS))
    assert store.read("record_versions").count() == 2 * MOST_FOLDERS and len(store._manifest()["record_versions"]) <= 2 * MOST_FOLDERS - 2
    assert sorted(r.version_number for r in versions.history(store.read("record_versions"), "k1").collect()) == list(range(1, 2 * MOST_FOLDERS, 2))
