import random

import pytest
from bibliarium.functions import similarity, text
from bibliarium.operators import fuzzy
from pyspark.sql import functions as F


def apply(spark, f, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


CASES = [
    (text.clean_text, ["<b>Hi</b>", "A &amp; B", r"\emph{word}", "a  b", None, "   ", "&nbsp;x&uuml;&ldquo;", r"50\% \textbf{a}\&b"], ["Hi", "A & B", "word", "a b", None, None, "xü“", "50 ab"]),
    (text.doi_display, ["https://doi.org/10.1/X", "http://dx.doi.org/10.1/a", "10.1/a", None, " 10.1/a ", " "], ["10.1/X", "10.1/a", "10.1/a", None, "10.1/a", None]),
    (text.doi_key, ["doi:10.1/A", "HTTPS://DOI.ORG/10.1/A", None, " 10.1/a\t"], ["10.1/a", "10.1/a", "", "10.1/a"]),
    (text.is_doi, ["10.1234/abc", "http://example.com/x", "doi:10.1234/a", None, "10.123/a", "10.1234/a b"], [True, False, False, False, False, False]),
    (text.last_first, ["John Smith", "Smith, John", "J. Smith", "Aristotle", "Smith,", " A  B  C ", None], ["Smith, John", "Smith, John", "Smith, J.", "Aristotle", "Smith, ", "C, A B", None]),
    (text.author_split, ["John Smith; Jane Doe & X Y and Z", "", None], [["Smith, John", "Doe, Jane", "Y, X", "Z"], None, None]),
    (text.keyword_split, ["a; b; c", "X,x|Y", "", None, " ; "], [["a", "b", "c"], ["x", "y"], None, None, None]),
    (text.byline, ["A Bc (Uni, X) and D Ef; a bc", "Ab, Cde, ,", None, "One Two AND Three Four"], [["A Bc", "D Ef"], ["Cde"], [], ["One Two", "Three Four"]]),
    (text.year, ["2020", " 2020 ", "2020.0", "x", None], [2020, 2020, None, None, None]),
    (text.year_prefix, ["2020-01-02", "", "abcd-1", None], [2020, None, None, None]),
    (text.trim, [" a\t\n", "\x1cb\x1f", ""], ["a", "b", ""]),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_literals(spark, case):
    f, given, want = CASES[case]
    assert apply(spark, f, given) == want


def test_small_functions(spark):
    r = spark.range(1).select(
        text.label_count(F.lit(1500)).alias("k"), text.label_count(F.lit(2_500_000)).alias("m"), text.label_count(F.lit(12)).alias("n"), text.shortened(F.lit("abcdef"), 3).alias("s"),
        text.best_link(F.lit(""), F.lit("10.1/a")).alias("l"), text.initials(F.lit("jane q doe")).alias("i"), text.colour_group(F.lit("x")).alias("g"), text.doi_from_url(F.lit("https://doi.org/10.1/doi.org/x")).alias("d"),
        text.keyword_list(F.array(F.lit("a; b"), F.lit(" X "), F.lit("x"))).alias("w"),
    ).first()
    assert (r.k, r.m, r.n, r.s, r.l, r.i, r.d, r.w) == ("1.5K", "2.5M", "12", "abc…", "https://doi.org/10.1/a", "JQ", "x", ["a; b", "x"]) and 0 <= r.g < 6


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_common_length():
    rng = random.Random(1)
    for _ in range(500):
        a, b = ("".join(rng.choice("abcd ") for _ in range(rng.randint(0, 30))) for _ in range(2))
        assert similarity.common_length(a, b) == plain_lcs(a, b)


@pytest.mark.parametrize("threshold", [90, 80, 60])
def test_best_matches_equal_brute_force(spark, threshold):
    rng = random.Random(threshold)
    words = ["deep", "learning", "for", "climate", "data", "study", "x", "of", "neural", "nets", "ab"]
    titles = [" ".join(rng.choices(words, k=rng.randint(1, 6))) for _ in range(60)]
    titles += [t[:p] + rng.choice("abz") + t[p:] for t in titles for p in [rng.randrange(len(t) + 1)]] + ["", None, "a", "b", "A"]
    rng.shuffle(titles)
    a, b = list(enumerate(titles))[::2], list(enumerate(titles))[1::2]
    got = {r.pos: (r.existing_id, r.similarity) for r in fuzzy.best_matches(spark.createDataFrame(a, "pos long, title string"), spark.createDataFrame(b, "id long, title string"), threshold).collect()}
    key = lambda t: " ".join(sorted((t or "").lower().split()))
    want = {}
    for i, t in a:
        best = None
        for j, u in b:
            x, y = key(t), key(u)
            if x and y and 200 * (n := plain_lcs(x, y)) >= threshold * (len(x) + len(y)):
                best = max(best, (n / (len(x) + len(y)), -j)) if best else (n / (len(x) + len(y)), -j)
        if best:
            want[i] = (-best[1], round(2 * best[0], 4))
    assert got == want and want
