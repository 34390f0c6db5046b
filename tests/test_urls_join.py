"""Links resolved against their pages, as the standard library does."""

from urllib.parse import urldefrag, urljoin

from pyspark.sql import functions as F

from sparkloom.functions import url

BASES = ["https://a.example/b/c/d?q=1#f", "http://a.example", "https://a.example:8443/x/", "https://a.example/x?y/z"]
HREFS = [
    "g", "./g", "g/", "/g", "//h.example/g", "?y", "g?y", "#s", "g#s", "g?y#s", "", ".", "./", "..", "../", "../g", "../..", "../../", "../../g", "../../../g", "/./g", "/../g", "g.", ".g", "g..", "..g", "./../g", "./g/.", "g/./h", "g/../h",
    "https://z.example/a/../b#c", "mailto:x@y", "g?y/./x", "g?y/../x", "a//b", "/a//b/../c", "data:text/plain,x",
]


def test_joined_links(spark):
    rows = [(b, h) for b in BASES for h in HREFS]
    got = spark.createDataFrame(rows, "b string, h string").select("b", "h", url.join(F.col("b"), F.col("h")).alias("u")).collect()
    wrong = [(r["b"], r["h"], r["u"], urldefrag(urljoin(r["b"], r["h"])).url) for r in got if r["u"] != urldefrag(urljoin(r["b"], r["h"])).url]
    assert not wrong, wrong[:6]
