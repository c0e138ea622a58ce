import itertools
import random
import re

import pytest
from bibliarium.llm import conversations, oracles
from tests.oracle import difference

PATTERN = re.compile("(s?(ua)+)?")
ROW = "conv_id long, turn long, role string, text string"


def every_way(roles, texts):
    """The cheapest audit and what it leaves, from all edits with up to two rows inserted at a place."""
    seen, rows = set(), []
    for r, t in zip(roles, texts):
        full = t.strip("\x20\x09\x0a\x0b\x0c\x0d")
        rows.append((r, t, not full or (r, t) in seen, bool(full) and (r, t) not in seen and full[-1] not in ".!?"))
        seen.add((r, t))
    best = None
    inserts = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    edits = [[("D", 3, None)] if must else [("D", 3, None), ("K", cut, (r, t)), ("R", 2 + cut, ("user", t)), ("R", 2 + cut, ("assistant", t))] for r, t, must, cut in rows]
    for ins in itertools.product(inserts, repeat=len(rows) + 1):
        for way in itertools.product(*edits):
            audit, cost, lines = "", 0, []
            for k in range(len(rows) + 1):
                audit, cost, lines = audit + "I" * len(ins[k]), cost + 2 * len(ins[k]), lines + [(r, "") for r in ins[k]]
                if k < len(rows):
                    letter, price, line = way[k]
                    audit, cost, lines = audit + letter, cost + price, lines + [line] * (line is not None)
            if (best is None or (cost, audit) < best[:2]) and PATTERN.fullmatch("".join(r[:1] or "-" for r, _ in lines)):
                best = cost, audit, [f"{r}:{t}" for r, t in lines]
    return best


def test_equals_all_ways():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randint(0, 3)
        roles, texts = [rng.choice(["user", "assistant", "system", "", " ", "tool"]) for _ in range(n)], [rng.choice(["a.", "b", "", " ", "c!\n", "d? e"]) for _ in range(n)]
        found = conversations.faults(roles, texts)
        dist = conversations.distances([r[:1] for r in roles], found, conversations.LAST)
        audit, lines, _ = conversations.walk(roles, texts, found, dist, conversations.LAST, 0)
        assert (dist[0], audit, lines) == every_way(roles, texts), (roles, texts)


def awkward():
    rng = random.Random(7)
    rows = []
    for c in [*range(60), None]:
        for t in range(rng.randint(0, 9)):
            rows += [(c, rng.choice([t, t, t, t + 3, None]), rng.choice(["user", "assistant", "system", "user", "assistant", None, "", "tool"]), rng.choice([f"text {rng.randint(0, 5)}.", "cut off", None, "", "why?\n", "a.b!c"]))] * rng.choice([1, 1, 1, 2])
    rows += [(1000, k, ("user", "assistant")[k % 2], f"line {k % 50}" + "." * (k % 3 > 0)) for k in range(700)]  # one conversation with most rows
    rows += [(1001, 5, "user", "the same.")] * 200
    return rows + [(5000 + k, 0, "user", "alone.") for k in range(60)]  # of some no row is left


@pytest.mark.parametrize("most", [1 << 16, 16, 3])
def test_equals_sql_in_chunks_of_any_size(spark, tmp_path, most):
    spark.createDataFrame(awkward(), ROW).repartition(4).write.parquet(f"{tmp_path}/x")
    rows = spark.read.parquet(f"{tmp_path}/x")
    rows.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}).to_parquet(f"{tmp_path}/conversations.parquet")
    query = lambda s, sf: conversations.repaired(conversations.damage(s.read.parquet(f"{sf}/conversations.parquet")), most)
    assert difference(spark, query, oracles.CONVERSATIONS, str(tmp_path)) == ""


def test_long_texts_clashing_columns_and_an_empty_table(spark):
    rows = [(1, 0, "user", "x" * 300_000 + ".", "a", 3), (1, 1, "assistant", "y " * 100_000, "b", None)]
    df = spark.createDataFrame(rows, ROW + ", k string, n int")
    one = conversations.repaired(conversations.damage(df), chars_most=1000).collect()
    assert len(one) == 1 and one[0] == conversations.repaired(conversations.damage(df)).collect()[0]
    assert conversations.repaired(conversations.damage(spark.createDataFrame([], ROW))).collect() == []
