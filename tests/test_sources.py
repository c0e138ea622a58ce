import datetime
import itertools
import json
import sqlite3

import pytest
from bibliarium.operators import fuzzy, merge, runlog
from bibliarium.plans import pipeline
from bibliarium.plans import search as S
from bibliarium.schemas import RECORDS
from bibliarium.sources import files, rest, sqlite
from bibliarium.sources.tables import Store
from tests.test_catalogue import server  # noqa: F401

NOW = datetime.datetime(2025, 5, 5)


def test_bibtex_fields_of_any_length_and_depth():
    long = "word " * 200_000
    deep = "{" * 5000 + "x" + "}" * 5000
    got = files.bibtex_fields(f'title = {{A {{B {{C {{D}}}}}} e}}, Abstract={{{long}}}, deep = {deep}, note = "say {{"}}hi{{"}} x", year=1999, year = 2000, open = {{never closed')
    assert got == {"title": "A {B {C {D}}} e", "abstract": long, "deep": deep[1:-1], "note": 'say {"}hi{"} x', "year": "1999", "open": "never closed"}
    assert files.bibtex_fields("") == {} and files.bibtex_fields("a = , b = {}") == {"b": ""}


def test_bibtex_file_with_a_megabyte_of_abstract(spark, tmp_path):
    text = "climate {data} " * 70_000
    (tmp_path / "a.bib").write_text("@article{k,\n title={T},\n abstract = {" + text + "}\n}\n@misc{l, title = {U}}\n")
    rows = {r.entry_key: r.fields for r in files.read_bibtex(spark, f"{tmp_path}/a.bib").collect()}
    assert rows["k"]["abstract"].strip() == text.strip() and rows["l"] == {"title": "U"}


def test_bibtex_macros(spark, tmp_path):
    (tmp_path / "a.bib").write_text("""@string{jcd = "Journal of Climate Data"}
@STRING(pub = {Press of } # "Basel")
@article{k1, journal = JCD, month = jan, publisher = pub, year = 2020, note = "see " # jcd # { no. } # 7, other = unknown # "x"}
@string{jcd = jcd # ", second series"}
@comment{jcd = "no"}
@string{long = jcd # " (" # pub # ")", mar = "Maerz"}
@article{k2, journal = jcd # { } # long, month = MAR # "~" # 3, empty = {} # "", title = {A # B}}
""")
    (tmp_path / "b.bib").write_text('@misc{k3, journal = jcd, month = dec}\n@string{jcd = "late"}\n')
    got = {r.entry_key: r.fields for r in files.read_bibtex(spark, f"{tmp_path}/*.bib").collect()}
    first, second = "Journal of Climate Data", "Journal of Climate Data, second series"
    assert got["k1"] == {"journal": first, "month": "January", "publisher": "Press of Basel", "year": "2020", "note": f"see {first} no. 7", "other": "unknownx"}
    assert got["k2"] == {"journal": f"{second} {second} (Press of Basel)", "month": "Maerz~3", "empty": "", "title": "A # B"}
    assert got["k3"] == {"journal": "jcd", "month": "December"} and len(got) == 3


def test_sqlite(spark, tmp_path):
    path = f"{tmp_path}/a.db"
    with sqlite3.connect(path) as con:
        con.execute('CREATE TABLE "odd name" (id INTEGER PRIMARY KEY, title TEXT, score REAL, raw BLOB)')
        con.executemany('INSERT INTO "odd name" VALUES (?, ?, ?, ?)', [(k * 3, f"t{k}" if k % 4 else None, k / 2, bytes([k % 256])) for k in range(1, 500)])
        con.execute("CREATE TABLE empty (a TEXT)")
    sqlite.register(spark)
    df = spark.read.format("sqlite").options(path=path, table="odd name", partitions=5).load()
    assert dict(df.dtypes) == {"id": "bigint", "title": "string", "score": "double", "raw": "binary"} and df.rdd.getNumPartitions() == 5
    rows = {r.id: r for r in df.collect()}
    assert len(rows) == 499 and rows[12].title is None and rows[15].title == "t5" and rows[15].score == 2.5 and bytes(rows[15].raw) == b"\x05"
    assert spark.read.format("sqlite").options(path=path, table="empty").load().count() == 0


def test_a_failed_page_ends_its_source_without_a_hole(spark, server, monkeypatch):  # noqa: F811
    rest.register(spark)
    z = spark.read.format("catalogue").options(source="zenodo", base_url=server, wait=0, limit_wait=0, pause=0, retries=1, max_records=400).load()
    assert [r.pos for r in z.collect()] == list(range(50))  # the second page's only attempt is refused


def test_collected_table(spark, server, tmp_path):  # noqa: F811
    files.collect_csv(spark, f"{tmp_path}/out", base_url=server, wait=0, limit_wait=0, pause=0, max_records=60)
    rows = spark.read.csv(f"{tmp_path}/out", header=True).collect()
    assert len(rows) == 60 and {"title", "authors", "year", "repository"} <= set(rows[0].asDict()) and rows[0].repository == "Zenodo"


def test_store_changes_all_tables_or_none(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/db")
    store.create()
    authors = lambda *names: spark.createDataFrame(list(enumerate(names)), "id long, name string")
    words = lambda *names: spark.createDataFrame(list(enumerate(names)), "id long, keyword string")
    with store.transaction():
        store.replace("authors", authors("a"))
        store.append("keywords", words("k"))
        assert store.read("authors").count() == 0
    assert store.read("authors").count() == store.read("keywords").count() == 1
    with pytest.raises(ZeroDivisionError), store.transaction():
        store.replace("authors", authors("b", "c"))
        1 / 0  # noqa: B018
    assert [r.name for r in store.read("authors").collect()] == ["a"]
    for _ in range(2):
        store.append("keywords", words("again"), "batch 7")
    assert sorted(r.keyword for r in store.read("keywords").collect()) == ["again", "k"]
    other = Store(spark, f"{tmp_path}/db")
    with pytest.raises(RuntimeError), store.transaction():
        other.replace("authors", authors("first"))
        store.replace("authors", authors("late"))
    assert [r.name for r in store.read("authors").collect()] == ["first"]


def test_run_log_from_start_to_end(spark, tmp_path):
    path = f"{tmp_path}/runs"
    with runlog.run(spark, path, "a") as counts:
        assert [r.status for r in runlog.runs(spark, path).collect()] == ["running"]
        counts["loaded"] = 3
    with pytest.raises(KeyError), runlog.run(spark, path, "b"):
        raise KeyError
    assert sorted((r.source, r.status, r.loaded) for r in runlog.runs(spark, path).collect()) == [("a", "success", 3), ("b", "failed", None)]


def test_curation_logs_its_run_and_batches_leave_rejects_once(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/db")
    rows = spark.createDataFrame([(0, "A title", "10.1234/a", "2020", "s"), (1, " ", "10.1234/b", "2020", "s")], "pos long, title string, doi string, publication_year string, source_id string")
    for _ in range(2):
        pipeline.curate(store, rows, NOW, 2025, log_path=f"{tmp_path}/runs", batch="stream/3")
    assert store.read("rejected_records").count() == 1 and store.read("record_versions").count() == 1
    assert [(r.status, r.loaded, r.rejected) for r in runlog.runs(spark, f"{tmp_path}/runs").collect()] == [("success", 2, 1)] * 2


def test_merges_leave_versions_and_say_what_was_dropped(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/db")
    z = lambda t, d: json.dumps({"doi": d, "metadata": {"title": t, "publication_date": "2020-02-02", "creators": [{"name": "A, B"}]}})
    frame = lambda *raws: spark.createDataFrame([(r, s, k) for k, (r, s) in enumerate(raws)], "raw string, _source string, pos long")
    pipeline.run(spark, f"{tmp_path}/db", frame((z("One title", "10.1/one"), "zenodo")), NOW)
    full = json.dumps({"attributes": {"titles": [{"title": "One other title"}], "doi": "https://doi.org/10.1/ONE", "url": "http://u", "publicationYear": 2021}})
    pipeline.run(spark, f"{tmp_path}/db", frame((full, "datacite"), (z("One title", "10.1/one"), "zenodo")), NOW)
    record = store.read("records").collect()[0]
    assert (record.version_number, record.access_url) == (2, "http://u")
    version = store.read("record_versions").collect()[0]
    assert version.version_number == 2 and version.action == "merged" and version.changed["access_url"].new == "http://u" and version.snapshot["access_url"] == "http://u"
    dropped = {r.dropped_doi for r in store.read("merge_log").collect()}
    assert store.read("merge_log").count() == 2 and "10.1/one" in dropped


def test_duplicates_that_are_records_become_inactive(spark):
    none = {f.name: None for f in RECORDS}
    own = spark.createDataFrame([none | {"id": k, "title": f"t{k}", "version_number": 1, "is_active": True} for k in (1, 2, 3)], RECORDS)
    dups = spark.createDataFrame([(2, 1, "exact", 0, "t2", "MIT"), (1, 1, "fuzzy", 1, "t1", None), (None, 3, "fuzzy", 2, "x", "BSD")], "record_id long, matched_id long, dup_type string, pos long, title string, license string")
    records, steps = merge.merge_records(own, dups)
    assert {r.id: (r.is_active, r.license, r.version_number) for r in records.collect()} == {1: (True, "MIT", 2), 2: (False, None, 1), 3: (True, "BSD", 2)}
    assert sorted((r.id, r.pos, r.winner) for r in steps.collect()) == [(1, 0, "incoming"), (3, 2, "incoming")]
    assert merge.fold_steps(own, dups.where("false"))[1].count() == 0


def test_files_of_records_and_dumps(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/db")
    (tmp_path / "n.json").write_text('[{"title": "A", "doi": "10.1/a", "authors": ["X"], "keywords": ["k"], "source": "s"}, {"title": "B", "doi": "10.1/a", "source": "s"}]')
    assert pipeline.insert_file(store, f"{tmp_path}/n.json", NOW)["inserted"] == 1 and pipeline.insert_file(store, f"{tmp_path}/none.json", NOW) == {"inserted": 0}
    raws = spark.createDataFrame([("{}", "zenodo", 0), ("{}", "kaggle", 1)], "raw string, _source string, pos long")
    pipeline.dump(raws, f"{tmp_path}/raw")
    pipeline.dump(raws, f"{tmp_path}/each", each=True)
    assert spark.read.json(f"{tmp_path}/raw").count() == 2 and spark.read.json(f"{tmp_path}/each/_source=kaggle").count() == 1


def test_what_a_client_gets(spark):
    df = spark.createDataFrame([("T1", "Ann Lee; Bob Ray", 2000, 1, "10/1", "x;y"), ("T2", "Ann Lee; Bob Ray", 2000, 7, None, "X"), ("T3", "Cid Moe; Dan Fox", 2001, None, "10/3", None)], "title string, authors string, year int, month int, doi string, keywords string")
    got = S.answer(*S.search(df, limit=2))
    assert got["total_count"] == 3 and len(got["results"]) == 2 and got["elapsed_ms"] > 0 and got["total_pages"] == 2
    titles = lambda **how: [r.title for r in S.search(df, sort="title", **how)[0].collect()]
    assert titles(month_from=8, month_to=6) == ["T2"] and titles(exact_month=1) == ["T1"] and titles() == ["T1", "T2", "T3"]
    assert S.page_authors(df).first().authors == 2 and S.guarded(df, 1, ["title"]).first().title == "T1" and S.guarded(df, None, ["title"]).count() == 3
    assert S.total_authors(df, category="x").first().total_authors == 2 and S.network(df, category="y")[1].count() == 1


def test_fuzzy_candidates_are_few(spark):
    """Of 3,000 titles' pairs, few reach the comparison."""
    import random

    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randint(2, 10))) for _ in range(400)]
    titles = [" ".join(sorted(rng.choices(words, k=9))) for _ in range(3000)]
    rows = lambda some, names: spark.createDataFrame(list(enumerate(some)), names)
    got = fuzzy.report(rows(titles[::2], "pos long, title string"), rows(titles[1::2], "id long, title string"), 90)
    assert fuzzy.gram_length(90) == (3, 2) and got["titles"] == 3000 and got["compared"] < 0.01 * 1500 * 1500 and got["compared"] <= got["met"] < 0.2 * 1500 * 1500


def test_frequent_grams_are_dealt_to_squares(spark):
    """Titles of which all have the same few grams: no square holds more than about two blocks, and no match goes."""
    titles = ["".join(t) for t in itertools.product("ab", repeat=9)]
    rows = lambda some, names: spark.createDataFrame(list(enumerate(some)), names)
    a, b = rows(titles[::2], "pos long, title string"), rows(titles[1::2], "id long, title string")
    whole, parted = fuzzy.report(a, b, 80), fuzzy.report(a, b, 80, block=40)
    assert whole["largest_square"] > 300 and parted["largest_square"] < 150 and parted["prefix_rows"] > whole["prefix_rows"]
    assert parted["met"] == whole["met"] and parted["compared"] == whole["compared"] > 0


def test_titles_that_very_many_rows_have(spark):
    """Copies on both sides, ids and titles that are null, an empty side."""
    a = spark.createDataFrame([(k, "Deep nets for climate") for k in range(500)] + [(500, None), (501, "  ")], "pos long, title string")
    b = spark.createDataFrame([(k, "climate for deep net") for k in range(7, 300)] + [(None, "deep nets for climate"), (1, None)], "id long, title string")
    got = fuzzy.best_matches(a, b, 90).collect()
    assert sorted(r.pos for r in got) == list(range(500)) and {(r.existing_id, r.existing_title) for r in got} == {(7, "climate for deep net")}
    assert fuzzy.best_matches(a, b.limit(0), 90).count() == 0 == fuzzy.best_matches(a.limit(0), b, 90).count()
