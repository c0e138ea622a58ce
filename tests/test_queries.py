import re

import pytest
from bibliarium.plans import driver
from tests.oracle import difference


@pytest.mark.parametrize("name", sorted(driver.QUERIES))
def test_query_equals_its_sql(spark, name):
    if name in driver.ORACLES:
        assert difference(spark, driver.QUERIES[name], driver.ORACLES[name], "/root/testdata/sf0.001") == ""
    else:
        assert driver.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_html_clean_native_keeps_pages_with_backslashes(spark, tmp_path):
    pages = [r"<p>\textbf{bold} &amp; \emph{it}</p>", r"<script>x = 'C:\dir\1' + \"\\n\"</script> end", r"\% \_ \\ \ a", "\\", "a\\", "\\é\\\u3000x\\\x1cy", r"\frac{a}{b} \cmd \{x\}", "<b>plain</b> &copy; &middot; &quot;q&quot;", "<br>", "", None]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")

    def clean(t):
        for entity, plain in (("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&amp;", "&")):
            t = t.replace(entity, plain)
        t = re.sub(r"\\[a-zA-Z]+\{([^}]*)\}", r"\1", re.sub("<[^>]+>", " ", t))
        return re.sub(r"\s+", " ", re.sub(r"\\[^a-zA-Z\s]", "", t)).strip() or None

    got = {r.page_id: r.clean for r in driver.QUERIES["html_clean_native"](spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else clean(t) for i, t in enumerate(pages)}


def test_completeness_scores_every_customer(spark):
    sf = "/root/testdata/sf0.001"
    ids = sorted(r.id for r in driver.QUERIES["completeness_every_row"](spark, sf).select("id").collect())
    assert ids == sorted(r.c_custkey for r in spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey").collect())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
