"""The index gives what a scan gives, and reads the buckets that it needs."""

import re

from pyspark.sql import functions as F

from webloom.operators import report
from webloom.operators.search import SearchIndex


def test_search(spark):
    rows = [(k, f"https://h/{k}/Ab{k % 7}", f"<title>Page {k} é{'XyZ' * (k % 3)}</title>") for k in range(200)] + [(None, None, None), (500, "u", "<title>only one of these</title>"), (500, "u", "<title>only one of these</title>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    index = SearchIndex.build(pages.withColumn("html", F.coalesce("html", F.lit(""))), buckets=16)
    again = SearchIndex(spark, index.path, 16)
    filled = pages.withColumn("url", F.coalesce("url", F.lit(""))).withColumn("html", F.coalesce("html", F.lit("")))
    for term in ("xyzxyz", "XYZ", "ab3", "page 1", "é", "", "h/", "only one", "none of it", "page 77 é", "https://h/19/", "a_b", "%"):
        want = sorted((str(r.page_id)) for r in report.search(filled, term).collect())
        assert sorted(str(r.page_id) for r in again.find(term).collect()) == want, term
    plan = again.find("only one")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"PartitionFilters: \[[^\]]*bucket#\d+ = \d+", plan)) == 2, plan
    assert SearchIndex.build(pages.limit(0), buckets=4).find("abc").count() == 0
