"""Queries over technologies' fingerprints: a thousand rules against the driver's pages.

Rule k of ten shapes names a code word spelled by its number; pages get traces of three technologies each by their own
number, some of which no rule knows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import fingerprints as P
from tessera.plans.registry import query
from tessera.plans.site_queries import chosen

N_RULES, N_TRACES = 1000, 1300
#: JSON of each shape's rules; @ is the code word, # the next one, % the number.
SPECS = (
    r"""{"cats":[1],"html":"<div id=\"@-app\"","implies":["Tech #\\;confidence:50"]}""",
    r"""{"html":["@\\.js\\?v=([\\d.]+)\\;version:\\1","never @ seen"]}""",
    r"""{"scriptSrc":"cdn\\.@\\.com/v(\\d+)\\;version:\\1"}""",
    r"""{"meta":{"Generator":"^@ ([\\d.]+)\\;version:v\\1"}}""",
    r"""{"headers":{"X-Powered-By":"@"}}""",
    r"""{"url":"/(?:en|de|fr|es)/%(?:[^0-9]|$)"}""",
    r"""{"dns":{"TXT":"@-verification"}}""",
    r"""{"dom":"link[href*='@.css'], b[x]"}""",
    r"""{"dom":{"a[href^='https://@.']":{"attributes":{"href":"@\\.io/(\\w+)"}}}}""",
    r"""{"html":"broken(@","scriptSrc":["x-@","@-late\\.js"]}""",
)
#: What a page holds of a technology of each shape.
TRACES = (
    '<div id="@-APP">', "<b>@.js?v=1.2.3</b>", '<script async src="https://cdn.@.com/v12/x.js"></script>', '<meta name="generator" content="@ 4.5">', "", "", "",
    '<link rel="x" href="/a/@.css">', '<a href="https://@.io/abc">', '<script src="/@-late.js"></script>',
)
_LETTERS = ("0123456789", "bdfgklmnpr")


def code(n) -> F.Column:
    return F.translate(F.lpad(n.cast("string"), 5, "0"), *_LETTERS)


def rule_files(spark) -> DataFrame:
    k = F.col("id")
    spec = F.replace(F.replace(F.replace(chosen(SPECS, k), F.lit("@"), code(k)), F.lit("#"), code(k + 1)), F.lit("%"), k.cast("string"))
    one = F.concat(F.lit('"Tech '), code(k), F.lit('":'), spec)
    files = spark.range(N_RULES).groupBy((k % 7).alias("file")).agg(F.concat(F.lit("{"), F.array_join(F.collect_list(one), ","), F.lit("}")).alias("content"))
    return files.unionByName(spark.range(1).select((k + 7).alias("file"), F.lit("not json").alias("content")))


def pages(spark, sf_dir) -> DataFrame:
    n = F.col("page_id")
    trace = lambda t: F.replace(chosen(TRACES, t), F.lit("@"), code(t))
    found = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    traces = [trace((n * a + b) % N_TRACES) for a, b in ((7, 0), (13, 5), (29, 11))]
    return found.select(F.regexp_extract("url", "://([^/]+)", 1).alias("domain"), n.alias("page_no"), "url", F.concat("html", *traces).alias("html"))


def inputs(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    site = pages(spark, sf_dir)
    n = F.col("page_no")
    sites = site.groupBy("domain").agg(F.min_by("url", "page_no").alias("url"))
    headers = site.select("domain", F.lit("X-Powered-By").alias("name"), F.concat(F.lit("PHP, "), code(n * 3 % N_TRACES)).alias("value"))
    records = site.select("domain", n.alias("record_no"), F.lit("TXT").alias("kind"), F.concat(code(n * 17 % N_TRACES), F.lit("-verification=1")).alias("record"))
    return sites, site, headers, records


def _code(n: str) -> str:
    return f"translate(lpad(CAST({n} AS VARCHAR), 5, '0'), '{_LETTERS[0]}', '{_LETTERS[1]}')"


def _trace(n: str) -> str:
    items = ", ".join("'" + t.replace("'", "''") + "'" for t in TRACES)
    return f"replace(([{items}])[({n}) % {len(TRACES)} + 1], '@', {_code(n)})"


_SCRIPT, _META = P.SCRIPT.replace("'", "''"), P.META
FOUND_SQL = rf"""techs AS (SELECT range AS k, range % 10 AS shape, {_code("range")} AS code FROM range({N_RULES})),
site AS (SELECT regexp_extract(url, '://([^/]+)', 1) AS domain, page_id AS page_no, url, html || {_trace(f"((page_id * 7) % {N_TRACES})")} || {_trace(f"((page_id * 13 + 5) % {N_TRACES})")} || {_trace(f"((page_id * 29 + 11) % {N_TRACES})")} AS html FROM pages),
scripts AS (SELECT domain, page_no, url, src, k_src FROM (SELECT domain, page_no, url, regexp_extract_all(html, '{_SCRIPT}', 1) AS srcs FROM site), unnest(srcs) WITH ORDINALITY AS u(src, k_src)),
tags AS (SELECT domain, url, page_no, tag, k_tag FROM (SELECT domain, page_no, url, regexp_extract_all(html, '{_META}') AS all_tags FROM site), unnest(all_tags) WITH ORDINALITY AS u(tag, k_tag)),
metas AS (SELECT domain, url, page_no, regexp_extract(tag, '(?is)\scontent\s*=\s*["'']([^"'']*)["'']', 1) AS content FROM tags
  WHERE lower(regexp_extract(tag, '(?is)\sname\s*=\s*["'']([^"'']*)["'']', 1)) = 'generator' QUALIFY row_number() OVER (PARTITION BY domain ORDER BY page_no, k_tag) = 1),
hits AS (
  SELECT domain, code, 0 AS place, 0 AS x0, 0 AS pattern_no, page_no AS x1, 'page code on ' || url AS how, '' AS version FROM site JOIN techs ON shape = 0 AND regexp_matches(html, '(?i)<div id="' || code || '-app"')
  UNION ALL SELECT domain, code, 0, 0, 0, page_no, 'page code on ' || url, regexp_extract(html, '(?i)' || code || '\.js\?v=([\d.]+)', 1) FROM site JOIN techs ON shape = 1 AND regexp_matches(html, '(?i)' || code || '\.js\?v=([\d.]+)')
  UNION ALL SELECT domain, code, 1, page_no * 100000 + k_src, 0, 0, 'script ' || src[:100] || ' on ' || url, regexp_extract(src, '(?i)cdn\.' || code || '\.com/v(\d+)', 1) FROM scripts JOIN techs ON shape = 2 AND regexp_matches(src, '(?i)cdn\.' || code || '\.com/v(\d+)')
  UNION ALL SELECT domain, code, 2, 0, 0, 0, 'meta generator on ' || url, 'v' || regexp_extract(content, '(?i)^' || code || ' ([\d.]+)', 1) FROM metas JOIN techs ON shape = 3 AND regexp_matches(content, '(?i)^' || code || ' ([\d.]+)')
  UNION ALL SELECT domain, {_code(f"(page_no * 3 % {N_TRACES})")}, 3, 0, 0, 0, 'response header x-powered-by', '' FROM site WHERE page_no * 3 % {N_TRACES} < {N_RULES} AND page_no * 3 % 10 = 4
  UNION ALL SELECT domain, code, 4, 0, 0, 0, 'site address', '' FROM (SELECT domain, min_by(url, page_no) AS url FROM site GROUP BY domain) JOIN techs ON shape = 5 AND regexp_matches(url, '/(?:en|de|fr|es)/' || k || '(?:[^0-9]|$)')
  UNION ALL SELECT domain, {_code(f"(page_no * 17 % {N_TRACES})")}, 5, page_no, 0, 0, 'DNS TXT record ' || {_code(f"(page_no * 17 % {N_TRACES})")} || '-verification=1', '' FROM site WHERE page_no * 17 % {N_TRACES} < {N_RULES} AND page_no * 17 % 10 = 6
  UNION ALL SELECT domain, code, 0, 0, 0, page_no, 'page code on ' || url, '' FROM site JOIN techs ON shape = 7 AND regexp_matches(html, '(?i)<link\b[^>]*\bhref\s*=\s*["''][^"'']*' || code || '\.css[^"'']*["'']')
  UNION ALL SELECT domain, code, 0, 0, 0, page_no, 'page code on ' || url, '' FROM site JOIN techs ON shape = 8 AND regexp_matches(html, '(?i)<a\b[^>]*\bhref\s*=\s*["'']https://' || code || '\.io/\w+[^"'']*["'']')
  UNION ALL SELECT domain, code, 1, page_no * 100000 + k_src, CASE WHEN contains(src, '-late') THEN 1 ELSE 0 END, 0, 'script ' || src[:100] || ' on ' || url, '' FROM scripts JOIN techs ON shape = 9 AND regexp_matches(src, '(?i)x-' || code || '|' || code || '-late\.js')),
found AS (SELECT domain, 'Tech ' || code AS tech, how, version FROM hits QUALIFY row_number() OVER (PARTITION BY domain, code ORDER BY place, x0, pattern_no, x1) = 1)"""


@query("tech_fingerprints", f"WITH {FOUND_SQL} SELECT domain, tech, how, version FROM found")
def tech_fingerprints(spark, sf_dir):
    """Technologies of each host with the sign of each and its version."""
    return P.technologies(P.read_rules(rule_files(spark)), *inputs(spark, sf_dir))


@query(
    "tech_with_implied",
    f"""WITH {FOUND_SQL}, pairs AS (SELECT 'Tech ' || code AS tech, 'Tech ' || {_code("(k + 1)")} AS also FROM techs WHERE shape = 0)
    SELECT domain, tech, how FROM found UNION ALL SELECT f.domain, also, 'implied by ' || min(f.tech) FROM found f JOIN pairs USING (tech) WHERE NOT EXISTS (SELECT 1 FROM found g WHERE g.domain = f.domain AND g.tech = also) GROUP BY f.domain, also""",
)
def tech_with_implied(spark, sf_dir):
    files = rule_files(spark)
    return P.with_implied(P.technologies(P.read_rules(files), *inputs(spark, sf_dir)), P.implied(files)).select("domain", "tech", "how")
