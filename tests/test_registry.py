"""Every registered query against its SQL."""

import pytest

from pagemill.plans import registry
from tests.conftest import same_rows


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, duck, name):
    same_rows(registry.QUERIES[name](spark, sf), duck, registry.ORACLES[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


#: Queries that read references, over pages whose references are cut off before the semicolon.
CUT = ["article_dates", "article_sink", "article_text", "css_extract", "page_title", "page_title_dom", "page_titles_dom", "stream_articles"]


@pytest.mark.parametrize("name", CUT)
def test_cut_references(spark, tmp_path, name):
    import duckdb

    html = "<html><head><title>Salt &amp; pepper&{0}</title></head><body><article><p>A text of over thirty bytes &amp; one more, &lt and &copy 2 &amp</p></article><a href=\"/x?a=1&amp;b&lt\">A link, and &quot</a><script>a && b &amp c</script></body></html>"
    rows = [(i, f"http://h.org/{i}", html.format(cut)) for i, cut in enumerate(["", "a", "am", "amp", "amp;", "ampx;", "lt", "#39", "#3", "#x27", "copy"])]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    same_rows(registry.QUERIES[name](spark, str(tmp_path)), con, registry.ORACLES[name])
