"""Readers of ranges against readers of whole files, with ranges cut at every place."""

import csv
import io
import json
import random

import pytest
from bibliarium.sources import files, ranges

CELLS = ["", "plain", 'a "quoted" word', "two\nlines", "comma, comma", '"', '""', "\n", "tail\n", " lead", "ünï 🙂", 'x"y', '",\n"', "a\r\nb"]


@pytest.fixture
def cut(spark):
    """Sets how many bytes a range has."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}

    def to(n):
        spark.conf.set(keys[0], n)
        spark.conf.set(keys[1], 1)

    yield to
    for k, v in before.items():
        spark.conf.set(k, v)


def whole_csv(spark, path):
    return spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False).na.fill("")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def sample(n, seed=1):
    rng = random.Random(seed)
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(["title", "the authors", "year"])
    w.writerows([[rng.choice(CELLS), rng.choice(CELLS), k] for k in range(n)])
    return out.getvalue()


@pytest.mark.parametrize("size", [1, 7, 1 << 20])
def test_csv_equals_the_whole_reader_on_every_cut(spark, tmp_path, cut, size):
    (tmp_path / "a.csv").write_text(sample(12))
    want = rows(whole_csv(spark, f"{tmp_path}/a.csv"))
    cut(size)
    got = files.read_csv(spark, f"{tmp_path}/a.csv")
    assert rows(got) == want and len(want) == 12 and got.columns == ["title", "the authors", "year"]
    assert size > 64 or spark.read.text(f"{tmp_path}/a.csv", lineSep="\n").rdd.getNumPartitions() > 4


def test_csv_of_many_files_and_awkward_shapes(spark, tmp_path, cut):
    for k, text in enumerate([sample(9, 2), sample(9, 3).replace("\n", "\r\n"), "title,the authors,year\n", "﻿title,the authors,year\nx,y,1", 'title,the authors,year\n\n\na,b\n1,2,3,4\n"q",mid"quote,5\n']):
        (tmp_path / f"{k}.csv").write_bytes(text.encode())
    want = [rows(whole_csv(spark, f"{tmp_path}/{k}.csv")) for k in range(5)]
    for size in (16, 1 << 20):
        cut(size)
        assert [rows(files.read_csv(spark, f"{tmp_path}/{k}.csv")) for k in range(5)] == want
        assert rows(files.read_csv(spark, f"{tmp_path}/[014].csv")) == sorted(want[0] + want[1] + want[4], key=repr)
    assert files.read_csv(spark, f"{tmp_path}/4.csv", empty_as_null=True).where("year IS NULL").count() == 1


def test_a_record_over_many_ranges_and_one_that_is_long(spark, tmp_path, cut):
    long = ("line, with \"quotes\"\n" * 4000) + "end"
    (tmp_path / "a.csv").write_text("k,t\n1," + '"' + long.replace('"', '""') + '"\n2,short\n')
    cut(1000)
    assert rows(files.read_csv(spark, f"{tmp_path}/a.csv")) == [("1", long), ("2", "short")]


VALUES = [{}, {"a": 1}, {"b": "br}ace", "a": [1, {"c": "]"}]}, {"q": 'say "hi" \\ {'}, 3, "text } , {", None, [1, {"x": {}}], {"u": "ünï 🙂\n"}, {"deep": [[[{"z": [{}]}]]]}, {"e": "\\"}, {"f": '\\"}'}]


@pytest.mark.parametrize("size", [1, 13, 1 << 20])
def test_json_equals_the_whole_reader_on_every_cut(spark, tmp_path, cut, size):
    cut(size)
    for k, how in enumerate(({"separators": (",", ":")}, {"indent": 1, "ensure_ascii": False})):
        (tmp_path / f"{k}.json").write_text(json.dumps(VALUES, **how))
        got = sorted((r.pos, json.loads(r.raw)) for r in files.read_json(spark, f"{tmp_path}/{k}.json").collect())
        assert [p for p, _ in got] == [k for k, v in enumerate(VALUES) if isinstance(v, dict)] and all(v == VALUES[p] for p, v in got)


def test_other_json_files(spark, tmp_path, cut):
    texts = {"o": '{"a": {"b": [1, 2]}}\n', "e": "[]", "s": '"x } y"', "n": "7", "none": "", "t": '[{"a": 1}, {"b": ', "u": '[{"a": "open', "x": '[{"a": 1}]}', "w": ' \n [ {"a" : 1} , 2 , {"b" : 2} ] \n', "bom": '﻿[{"a": 1}]', "c": '{"a": 1'}
    for k, t in texts.items():
        (tmp_path / f"{k}.json").write_text(t)
    for size in (5, 1 << 20):
        cut(size)
        got = {k: sorted((r.pos, json.loads(r.raw)) for r in files.read_json(spark, f"{tmp_path}/{k}.json").collect()) for k in texts}
        assert got == {"o": [(0, {"a": {"b": [1, 2]}})], "w": [(0, {"a": 1}), (2, {"b": 2})], "bom": [(0, {"a": 1})]} | {k: [] for k in ("e", "s", "n", "none", "t", "u", "x", "c")}


def test_ends_inside():
    for line, want in {"": (False, True), "a,b": (False, True), '"a': (True, False), 'a"b': (False, False), '"a""': (True, True), '"a",b': (False, False), '""': (False, True), 'x,"': (True, False), '"a"x"y,"': (True, False)}.items():
        assert ranges.ends_inside(line, False) == want[0], line
    assert ranges.ends_inside('end",next', True) is False and ranges.ends_inside('end",next,"', True) is True and ranges.ends_inside('""', True) is True
