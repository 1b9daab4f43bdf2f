"""Titles as their SQL has them, on what the small tables have no case of."""

import duckdb

from webloom.plans.registry import ORACLE_SQL, QUERIES

TITLES = [
    "<title>cut &amp</title>", "<title>a &amp; b &eacute; &lt;i&gt; &amp;lt; &copy</title>", "<TITLE lang=en>\n x\u00a0&nbsp;y&nbsp;\n</Title>", "<titlebar>n</titlebar><title>t</title>",
    "<title>open", "<title>one</title ><title>two</title>", "<title", "", None, "<svg><title>s</title></svg><title>t</title>", "<title></title>", "<title>&#39;&quot;&#65;</title>",
]


def test_titles_as_in_sql(spark, tmp_path):
    pages = list(enumerate(TITLES))
    spark.createDataFrame(pages, "page_id bigint, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = QUERIES["page_titles"](spark, str(tmp_path)).orderBy("page_id").collect()
    assert [tuple(r) for r in got] == con.sql(ORACLE_SQL["page_titles"] + " ORDER BY page_id").fetchall()


def test_many_open_titles(spark):
    """A page of openings alone is read once, not once for each."""
    from pyspark.sql import functions as F

    from webloom.functions import html as H

    rows = spark.createDataFrame([("<title>" * 300_000,), ("<title" * 300_000,)], "html string")
    assert [r[0] for r in rows.select(H.written_title(F.col("html"))).collect()] == ["", ""]
