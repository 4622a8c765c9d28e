"""Queries over careers pages: the driver's pages with job cards planted in them, each page a company's.

What each kind of planted page must give is known from how it is written; the SQL has those rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import sql_values
from tessera.plans.registry import query
from tessera.plans.site_queries import chosen
from tessera.sources import careers as C

#: Planted parts, ¤ stands for the page's number.
PARTS = (
    """<script type="application/ld+json">[{"@type":"JobPosting","title":" Nurse ¤ ","description":"<p>Care &amp; rest</p>","url":"https://x/¤","jobLocationType":"TELECOMMUTE"},{"@type":["Thing","JobPosting"],"jobLocation":{"address":{"addressLocality":"Waco","addressRegion":"TX"}}},{"@type":"Event"}]</script><a href="/jobs/other1">Sales Manager Two</a>""",
    """<script type="application/ld+json">{"@graph":[{"@type":"WebSite"},{"@type":"JobPosting","title":"Cook","jobLocation":{"address":"Ulm"}},{"inner":{"@type":"JobPosting","title":"Deep"}}]}</script>""",
    """<script type="application/ld+json">{bad</script><a class="x" href="/careers/eng-¤?x=1">Senior Software Engineer <b>Remote</b> Full-time View role</a><a href='/careers/eng-¤?x=1'>Second Engineer Name</a><a href="/jobs/all">View all jobs</a>
    <a href="https://other.test/jobs/abc">Sales Manager Role</a><a href="/about/team">Product Designer One</a><a href="/positions/acc¤">Staff Accountant In person</a><a href="/roles/zz¤">Bees and honey</a>""",
    """<h3>Applications Engineer</h3><h2>Our team lead</h2><h4 class="x">Head of Sales &amp; Growth</h4><h3>Applications <i>Engineer</i></h3><h5>Manager</h5><h2>Account Executive (EMEA) - Berlin</h2>""",
    """<script type="application/ld+json">{"@type":"JobPosting"} {}</script><h1>Lead Engineer</h1><a href="/jobs/x1">Lead Engineer</a>""",
    "",
)
_SITE = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"
#: kind, job_no, title, location, remote, description, url (^ stands for scheme and host, ~ for the page's address), source.
WANTED = (
    (0, 0, "Nurse ¤", "", True, "Care & rest", "https://x/¤", "posting"), (0, 1, "", "Waco, TX", False, "", "", "posting"), (1, 0, "Cook", "", False, "", "", "posting"),
    (2, 0, "Senior Software Engineer", "", True, "", "^/careers/eng-¤?x=1", "link"), (2, 1, "Staff Accountant", "in person", False, "", "^/positions/acc¤", "link"),
    (3, 0, "Applications Engineer", "", False, "", "~", "heading"), (3, 1, "Head of Sales & Growth", "", False, "", "~", "heading"), (3, 2, "Account Executive (EMEA) - Berlin", "", False, "", "~", "heading"),
)


def pages(spark, sf_dir) -> DataFrame:
    n = F.col("page_id")
    part = F.replace(chosen(PARTS, n), F.lit("¤"), n.cast("string"))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.concat(F.lit("p"), n.cast("string")).alias("domain"), "page_id", "url", F.concat("html", part).alias("html"))


CAREERS_SQL = f"""{sql_values([tuple(str(x).lower() if isinstance(x, bool) else x for x in row) for row in WANTED], "wanted", "kind, job_no, title, location, remote, description, url, source")},
careers AS (SELECT 'p' || page_id AS domain, job_no, replace(title, '¤', CAST(page_id AS VARCHAR)) AS title, location, CAST(remote AS BOOLEAN) AS remote, description,
  replace(replace(replace(w.url, '¤', CAST(page_id AS VARCHAR)), '^', {_SITE.replace("url", "p.url")}), '~', p.url) AS url, source FROM pages p JOIN wanted w ON page_id % {len(PARTS)} = kind)"""


@query("careers_page_jobs", f"WITH {CAREERS_SQL} SELECT * FROM careers")
def careers_page_jobs(spark, sf_dir):
    return C.page_jobs(pages(spark, sf_dir))


# A third of the companies link to boards: the fourth board's jobs aren't looked at, an empty board hands on to the next.
_LINKED = {"dover": "page_id % 3 = 0", "lever": "page_id % 3 = 0", "greenhouse": "page_id % 6 = 0", "breezy": "page_id % 5 = 0", "ashby": "page_id % 12 = 3"}
_HAS_JOBS = {"lever": "page_id % 9 = 0", "dover": "page_id % 2 = 0", "breezy": "TRUE", "ashby": "page_id % 7 = 0"}
_ORDER = ("greenhouse", "lever", "ashby", "dover", "breezy")
_LINKS = " UNION ALL ".join(f"SELECT page_id, {k} AS k, '{b}' AS board, {_HAS_JOBS.get(b, 'FALSE')} AS has_jobs FROM pages WHERE {_LINKED[b]}" for k, b in enumerate(_ORDER))


@query(
    "jobs_looked_up",
    f"""WITH {CAREERS_SQL}, links AS ({_LINKS}), asked AS (SELECT * FROM links QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY k) <= {C.MOST_BOARDS}),
    best AS (SELECT page_id, arg_min(board, k) AS board FROM asked WHERE has_jobs GROUP BY page_id)
    SELECT 'p' || page_id AS domain, 0 AS job_no, 'Job at ' || board AS title, '' AS location, FALSE AS remote, '' AS description, '' AS url, board AS source FROM best
    UNION ALL SELECT * FROM careers WHERE domain NOT IN (SELECT 'p' || page_id FROM best)""",
)
def jobs_looked_up(spark, sf_dir):
    """Each company's jobs, by its boards or its careers page."""
    found = pages(spark, sf_dir)
    links = F.array(*[F.when(F.expr(test), F.struct(F.lit(b).alias("board"), F.expr(_HAS_JOBS.get(b, "FALSE")).alias("full"))) for b, test in _LINKED.items()])
    boards = found.select("domain", F.explode(F.array_compact(links)).alias("b")).select("domain", "b.board", "b.full")
    nothing = F.lit("")
    jobs = boards.where("full").select("domain", F.col("board").alias("shape"), F.lit(0).alias("job_no"), F.concat(F.lit("Job at "), F.col("board")).alias("title"), nothing.alias("location"), F.lit(False).alias("remote"), nothing.alias("description"), nothing.alias("url"))
    return C.looked_up(jobs, boards.select("domain", "board"), C.page_jobs(found))
