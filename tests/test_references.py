"""Queries on pages decode only references with their semicolon, as their SQL does; a cut title may end within one."""

import duckdb
import pytest

from sparkloom.operators import html
from sparkloom.plans import catalogue

PAGES = [
    (0, "<html lang=\"en\"><head><title>Cut&amp;&amp;&amp</title></head><body><p>terms of the license &amp contact</p></body></html>"),
    (1, "<html lang=\"en\"><head><title>a &ampx; b &copy</title></head><body><p>x &quot y &middot; z</p><a href=\"/a?b=1&copy=2\">t</a></body></html>"),
    (2, "<title>&amp;amp; &amp;quot; &copy;</title><p>b &am"),
    (3, "<title>a&amp</title><p>&amp;&amp</p>"),
]


def _equal(spark, tmp_path, name):
    path = str(tmp_path)
    spark.createDataFrame([(i, f"http://a.example/{i}", h) for i, h in PAGES], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{path}/pages.parquet/*.parquet'")
    cursor = con.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    got = catalogue.queries()[name](spark, path).select(*columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(cursor.fetchall(), key=str)


@pytest.mark.parametrize("name", ["gate_spans", "page_title", "typ_pages"])
def test_cut_references_equal_sql(spark, tmp_path, name):
    _equal(spark, tmp_path, name)


def test_reader_still_decodes_as_html_if_not_asked():
    assert html.read_page("<title>a &amp b</title>")["title"] == "a & b"


def test_scripts_keep_their_ampersands():
    page = html.read_page('<script type="application/ld+json">{"a": "x && y &amp"}</script>', False, True)
    assert page["json_ld"] == ['{"a": "x && y &amp"}']
