from urllib.parse import urljoin

from pyspark.sql import functions as F

from tessera.sources import careers as C

PAGES = "domain string, url string, html string"


def test_links_are_joined_as_usual(spark):
    bases = ["https://a.com", "https://a.com/", "http://a.com/x/y?q=/z/1", "https://u@b.org:8/p/#f"]
    links = ["https://z.io/1", "//c.com/q", "/jobs/7", "open/8?x=1", "?y=2", "mailto:a@b.c"]
    df = spark.createDataFrame([(b, k) for b in bases for k in links], "b string, k string")
    for r in df.select("b", "k", C.joined(F.col("b"), F.col("k")).alias("j")).collect():
        assert r.j == urljoin(r.b, r.k), r


def test_hosts_and_paths(spark):
    df = spark.createDataFrame([("HTTPS://www.A.com:8/x/y?q#f",), ("no url",), ("x://u@b.c",)], "u string")
    assert [tuple(r) for r in df.select(C.host_of(F.col("u")), C.path_of(F.col("u"))).collect()] == [("a.com", "/x/y"), ("", ""), ("b.c", "")]


def test_ladder_of_sources(spark):
    heading = "<h3>Data Analyst</h3>"
    link = "<a href='https://jobs.a.com/openings/data-1'>Data Engineer Hybrid</a>"
    posting = '<script type="application/ld+json">{"@type":"JobPosting","title":"Writer"}</script>'
    pages = [("a", heading), ("b", heading + link), ("c", heading + link + posting), ("d", None), ("e", link.replace("a.com", "ba.com")), ("f", "<h3>Engineer</h3>"), ("g", heading * 150)]
    df = spark.createDataFrame([(d, "https://www.a.com/careers", h) for d, h in pages], PAGES)
    got = sorted((r.domain, r.job_no, r.title, r.source, r.url) for r in C.page_jobs(df).collect())
    at = "https://www.a.com/careers"
    assert got == [("a", 0, "Data Analyst", "heading", at), ("b", 0, "Data Engineer", "link", "https://jobs.a.com/openings/data-1"), ("c", 0, "Writer", "posting", ""), ("g", 0, "Data Analyst", "heading", at)]
    assert C.page_jobs(df.limit(0)).count() == 0


def test_many_links_are_bounded_and_first_ones_count(spark):
    html = "".join(f"<a href='/jobs/nr-{k % 130:03d}'>Sales Lead {k}</a>" for k in range(260))
    got = C.page_jobs(spark.createDataFrame([("a", "https://a.com/", html)], PAGES)).orderBy("job_no").collect()
    assert [r.title for r in got] == [f"Sales Lead {k}" for k in range(C.MOST_JOBS)]
