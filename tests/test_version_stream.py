import datetime
import random

import pyarrow as pa
import pytest
from bibliarium.operators import versions
from bibliarium.streaming import versions as stream_versions
from bibliarium.streaming.versions import to_log, versioned

COLUMNS = ["title", "abstract"]
SCHEMA = "record_key string, pos long, fields map<string,string>, deleted boolean, at timestamp"
START = datetime.datetime(2025, 1, 1)


def changes(n):
    rng = random.Random(n)
    rows = []
    for pos in range(n):
        fields = {c: rng.choice(["a", "b", None]) for c in COLUMNS if rng.random() < 0.6} | ({"other": "x"} if pos % 5 == 0 else {})
        rows.append((rng.choice(["k1", "k2", "k3", None]) or "k4", pos, fields or None, False, START + datetime.timedelta(minutes=pos)))
    return rows


def run(spark, folder, batches, **how):
    """Rows that a stream makes which is started again for each batch."""
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = versioned(spark.readStream.schema(SCHEMA).parquet(f"{folder}/in"), COLUMNS, **how)
        stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out", format="parquet").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@pytest.mark.parametrize("cuts", [[], [7, 8, 20]])
def test_equals_the_chain_in_any_cut(spark, tmp_path, cuts):
    rows = [(*r[:2], r[2] or {}, *r[3:]) for r in changes(40)]
    got = run(spark, tmp_path, [rows[a:b] for a, b in zip([0, *cuts], [*cuts, 40])])
    want = versions.chain(spark.createDataFrame(rows, SCHEMA), COLUMNS)
    plain = lambda r: (r.record_key, r.pos, r.version_number, r.action, {k: (v.old, v.new) for k, v in r.changed.items()}, dict(r.snapshot))
    assert sorted(map(plain, got.collect()), key=lambda r: r[1]) == sorted(map(plain, want.collect()), key=lambda r: r[1])
    assert to_log(got).where("action = 'unchanged'").count() == 0


def test_tombstones_by_change_and_by_timer(spark, tmp_path):
    at = lambda m: START + datetime.timedelta(minutes=m)
    first = [("a", 0, {"title": "T"}, False, at(0)), ("b", 1, {"title": "B"}, False, at(0)), ("a", 2, None, True, at(1)), ("a", 3, None, True, at(2)), ("a", 4, {"title": "T"}, False, at(3))]
    later = [("c", 5, {"title": "C"}, False, at(600))]
    last = [("c", 6, {"title": "C"}, False, at(601)), ("b", 7, {"title": "B2"}, False, at(602))]
    got = run(spark, tmp_path, [first, later, last], idle_ms=3_600_000)
    seen = [(r.record_key, r.pos, r.action, r.version_number, r.is_active) for r in got.collect()]
    assert {x for x in seen if x[0] == "a" and x[1] is not None} == {("a", 0, "inserted", 1, True), ("a", 2, "deleted", 1, False), ("a", 3, "unchanged", 1, False), ("a", 4, "reactivated", 2, True)}
    assert ("a", None, "deleted", 2, False) in seen and ("b", None, "deleted", 1, False) in seen  # no change for an hour
    assert ("b", 7, "reactivated", 2, True) in seen and not any(x[0] == "c" and x[2] == "deleted" for x in seen)


@pytest.mark.parametrize("most, packs", [(1 << 18, 1), (500, 2)])
def test_a_keys_changes_reach_the_state_as_one_row(monkeypatch, most, packs):
    """Whatever the order of the rows of a micro-batch, and however they are cut into Arrow batches; a null key is a key."""
    monkeypatch.setattr(stream_versions, "PACKED", most)
    rows = [(None if i % 5 == 0 else f"k{i % 5}", i, str(i)) for i in range(1000)]
    random.Random(1).shuffle(rows)
    batches = [pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows[a : a + 100]), (pa.string(), pa.int64(), pa.string()))], ["record_key", "pos", "v0"]) for a in range(0, 1000, 100)]
    got = [r for b in stream_versions._pack(iter(batches)) for r in b.to_pylist()]
    assert len(got) == 5 * packs and all(r["pos"] == sorted(r["pos"]) and r["v0"] == [str(p) for p in r["pos"]] for r in got)
    assert {p: r["record_key"] for r in got for p in r["pos"]} == {p: k for k, p, _ in rows}
