"""Queries over fact sheets: overviews, disagreements, reasons, both phases side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import page_rules as P
from tessera.operators import answers as A
from tessera.operators import page_facts as O
from tessera.plans.answer_queries import PLAN_SQL, planned
from tessera.plans.decision_queries import HEAD, SEGMENT_SQL, SETTLED_SQL, core, decide_sql, facts_of, score_sql, settled
from tessera.plans.registry import query
from tessera.plans.site_queries import _CODE, _KEY, JOBS_SQL, PAGES_SQL, TOOLS_SQL, _chosen, _has, _key_elsewhere, chosen, tools
from tessera.plans.site_queries import pages as site_pages


def read(spark, sf_dir, table) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@query(
    "list_overview",
    f"""{HEAD}, {SEGMENT_SQL}, {score_sql("services")}, {decide_sql("services")}
    SELECT l.region, count(*) AS companies, count(*) FILTER (icp = 'YES') AS yes, count(*) FILTER (icp = 'PENDING') AS pending, count(*) FILTER (icp = 'NO') AS no, count(*) FILTER (tier = 'Strong fit' AND icp = 'YES') AS strong
    FROM decided JOIN scored USING (domain) JOIN leads l USING (domain) GROUP BY l.region""",
)
def list_overview(spark, sf_dir):
    icp = F.col("icp")
    return core(spark, sf_dir, "services").groupBy("region").agg(
        F.count(F.lit(1)).alias("companies"), *[F.count_if(icp == v).alias(n) for v, n in (("YES", "yes"), ("PENDING", "pending"), ("NO", "no"))], F.count_if((F.col("tier") == "Strong fit") & (icp == "YES")).alias("strong")
    )


@query(
    "question_cost_summary",
    f"""{HEAD}, {PLAN_SQL}, n AS (SELECT domain, count(*) FILTER (next = 'pages') AS pages, count(*) FILTER (next = 'web') AS web FROM planned WHERE next IS NOT NULL GROUP BY domain)
    SELECT count(*) AS companies, CAST(sum(pages) AS BIGINT) AS page_questions, CAST(sum(web) AS BIGINT) AS web_questions, CAST(sum(ceil(pages / 8.0)) AS BIGINT) AS calls, CAST(sum(pages * 900 + web * 400) AS BIGINT) AS tokens FROM n""",
)
def question_cost_summary(spark, sf_dir):
    """What the open questions of all companies come to: pages are asked eight in a call."""
    each = A.questions(planned(spark, sf_dir)).where("next is not null").groupBy("domain").agg(F.count_if(F.col("next") == "pages").alias("pages"), F.count_if(F.col("next") == "web").alias("web"))
    return each.agg(F.count(F.lit(1)).alias("companies"), F.sum("pages").alias("page_questions"), F.sum("web").alias("web_questions"), F.sum(F.ceil(F.col("pages") / 8)).alias("calls"), F.sum(F.col("pages") * 900 + F.col("web") * 400).alias("tokens"))


@query(
    "question_cost_by_mode",
    f"""{HEAD}, {PLAN_SQL}, n AS (SELECT domain, count(*) FILTER (next = 'pages') AS pages, count(*) FILTER (next = 'web') AS web FROM planned WHERE next IS NOT NULL GROUP BY domain), modes(mode, size) AS (VALUES ('accurate', 1), ('cheap', 8))
    SELECT mode, CAST(sum(ceil(pages / CAST(size AS DOUBLE))) AS BIGINT) AS calls, round(sum(ceil(pages / CAST(size AS DOUBLE))) * 0.0008 + sum(web) * 0.011, 6) AS usd FROM n CROSS JOIN modes GROUP BY mode""",
)
def question_cost_by_mode(spark, sf_dir):
    """The estimate in both ways of asking: a call for each question, or for eight."""
    each = A.questions(planned(spark, sf_dir)).where("next is not null").groupBy("domain").agg(F.count_if(F.col("next") == "pages").alias("pages"), F.count_if(F.col("next") == "web").alias("web"))
    modes = F.explode(F.array(F.struct(F.lit("accurate").alias("mode"), F.lit(1).alias("size")), F.struct(F.lit("cheap").alias("mode"), F.lit(8).alias("size"))))
    rows = each.select("pages", "web", modes.alias("m"))
    calls = F.sum(F.ceil(F.col("pages") / F.col("m.size")))
    return rows.groupBy(F.col("m.mode").alias("mode")).agg(calls.alias("calls"), F.round(calls * 0.0008 + F.sum("web") * 0.011, 6).alias("usd"))


_WHY = """CASE WHEN web_run = 'first' THEN 'only a web search can answer it' WHEN pages_run IN ('if_open', 'always') AND value <> 'check' THEN 'still open after the free layers'
    WHEN value = 'check' THEN 'a rule found a clue but could not confirm it' ELSE 'the rules found nothing for it' END"""


@query("why_asked", f"{HEAD}, {PLAN_SQL} SELECT sid, {_WHY} AS why, count(*) AS companies FROM planned WHERE next IS NOT NULL GROUP BY ALL")
def why_asked(spark, sf_dir):
    return A.questions(planned(spark, sf_dir)).where("next is not null").select("sid", F.expr(_WHY).alias("why")).groupBy("sid", "why").agg(F.count(F.lit(1)).alias("companies"))


@query("unreached_questions", f"{HEAD}, {PLAN_SQL} SELECT domain, sid FROM planned WHERE status = 'blocked' AND must_or_stop AND web_run <> 'off' AND value = 'unknown'")
def unreached_questions(spark, sf_dir):
    """What the web is asked for sites that could not be read: open must-haves and stops."""
    return A.questions(planned(spark, sf_dir)).where("status = 'blocked' and must_or_stop and web_run <> 'off' and value = 'unknown'").select("domain", "sid")


@query("sheet_by_group", f"{HEAD} SELECT grp, sid, value, count(*) AS companies FROM signals JOIN roles USING (sid) WHERE pipeline = 'services' AND value <> 'unknown' GROUP BY ALL")
def sheet_by_group(spark, sf_dir):
    _, signals = facts_of(spark, sf_dir, "services")
    return signals.where("value <> 'unknown'").groupBy("grp", "sid", "value").agg(F.count(F.lit(1)).alias("companies"))


@query(
    "company_explained",
    f"""{HEAD}, {SETTLED_SQL}, own AS (SELECT s.domain, s.sid, CASE WHEN r.grp IN ('must', 'exclusion') THEN s.value ELSE t.value END AS value FROM signals s JOIN roles r ON r.sid = s.sid AND r.pipeline = 'services' JOIN settled t ON t.domain = s.domain AND t.sid = s.sid)
    SELECT domain, string_agg(sid || '=' || value, ' ' ORDER BY place) AS facts FROM own JOIN roles USING (sid) WHERE pipeline = 'services' AND value <> 'unknown' GROUP BY domain""",
)
def company_explained(spark, sf_dir):
    """Both phases in one line a company: must-haves and stops from the first, all else from the second; unknown left out."""
    _, first = facts_of(spark, sf_dir, "services")
    both = first.select("domain", "sid", "grp", "place", "value").join(settled(spark, sf_dir).withColumnRenamed("value", "later"), ["domain", "sid"])
    own = both.withColumn("value", F.when(F.col("grp").isin("must", "exclusion"), F.col("value")).otherwise(F.col("later"))).where("value <> 'unknown'")
    parts = F.array_sort(F.collect_list(F.struct("place", F.concat("sid", F.lit("="), "value").alias("text"))))  # 69 facts at most
    return own.groupBy("domain").agg(F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("facts"))


@query(
    "partners_named",
    f"""WITH {PAGES_SQL}, {JOBS_SQL}, {TOOLS_SQL}, posted AS (SELECT DISTINCT domain, tool FROM job_tools), every AS (SELECT domain, tool FROM tools_found WHERE value = 'yes' UNION SELECT domain, tool FROM posted)
    SELECT domain, string_agg(tool, '; ' ORDER BY tool) AS partners FROM every GROUP BY domain""",
)
def partners_named(spark, sf_dir):
    """Union of the tools that are proven and those that job posts name, sorted."""
    from tessera.plans.site_queries import jobs

    proven = tools(spark, sf_dir).where("value = 'yes'").groupBy("domain").agg(F.collect_set("tool").alias("a"))
    named = F.array_compact(F.array(*[F.when(F.col("description").rlike(p) | F.col("title").rlike(p), F.lit(t)) for t, _, p in P.TOOLS]))
    posted = jobs(spark, sf_dir).select("domain", F.explode(named).alias("tool")).groupBy("domain").agg(F.collect_set("tool").alias("b"))
    none = F.array().cast("array<string>")
    return proven.join(posted, "domain", "full").select("domain", F.array_join(F.array_sort(F.array_union(F.coalesce("a", none), F.coalesce("b", none))), "; ").alias("partners"))


@query(
    "run_disagreements",
    """WITH r AS (SELECT user_id, event_type, max(value) FILTER (event_id % 2 = 0) AS a, max(value) FILTER (event_id % 2 = 1) AS b FROM events GROUP BY ALL), d AS (SELECT *, abs(a - b) AS gap FROM r WHERE a IS NOT NULL AND b IS NOT NULL)
    SELECT user_id, event_type, round(gap, 6) AS gap FROM d""",
)
def run_disagreements(spark, sf_dir):
    """All disagreements of two runs, the widest first."""
    even = F.col("event_id") % 2 == 0
    runs = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max(F.when(even, F.col("value"))).alias("a"), F.max(F.when(~even, F.col("value"))).alias("b"))
    gap = runs.where("a is not null and b is not null").withColumn("gap", F.abs(F.col("a") - F.col("b")))
    return gap.orderBy(F.col("gap").desc(), "user_id", "event_type").select("user_id", "event_type", F.round("gap", 6).alias("gap"))


@query(
    "most_common_by_day",
    """WITH c AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL)
    SELECT day, string_agg(event_type || ' ' || n, ', ' ORDER BY n DESC, event_type) AS top FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY day ORDER BY n DESC, event_type) <= 3) GROUP BY day""",
)
def most_common_by_day(spark, sf_dir):
    """Each day's three most common events."""
    counts = read(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    ranked = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("down"), "event_type"))), 1, 3)  # a row for each kind of event
    return counts.groupBy("day").agg(F.array_join(F.transform(ranked, lambda x: F.concat(x["event_type"], F.lit(" "), (-x["down"]).cast("string"))), ", ").alias("top"))


RAW_STAGES = ("PRE_SEED", "seed round", "Series_A", "series b extension", "Series F", "POST_IPO", "private equity buyout", "angel", "")
#: What a provider's stage begins with.
EARLY = (("pre seed", "Pre-Seed"), ("pre-seed", "Pre-Seed"), ("seed", "Seed"), ("series a", "Series A"), ("series b", "Series B"))
_LOW = f"lower(replace({_chosen(RAW_STAGES, 'event_id')}, '_', ' '))"
_STAGE = "CASE " + " ".join(f"WHEN starts_with(low, '{k}') THEN '{v}'" for k, v in EARLY) + " WHEN regexp_matches(low, '^(?:series [c-z]|ipo|post ipo|private equity)') THEN 'Series C or later' END"
_ORDER = "CASE stage WHEN 'Pre-Seed' THEN 0 WHEN 'Seed' THEN 1 WHEN 'Series A' THEN 2 WHEN 'Series B' THEN 3 WHEN 'Series C or later' THEN 4 END"


def staged(spark, sf_dir) -> DataFrame:
    low = F.lower(F.replace(chosen(RAW_STAGES, F.col("event_id")), F.lit("_"), F.lit(" ")))
    stage = F.when(F.lit(False), "")
    for begin, name in EARLY:
        stage = stage.when(low.startswith(begin), name)
    stage = stage.when(low.rlike("^(?:series [c-z]|ipo|post ipo|private equity)"), "Series C or later")
    return read(spark, sf_dir, "events").select("event_id", "user_id", "ts", stage.alias("stage"))


@query("provider_stages", f"SELECT event_id, {_STAGE} AS stage FROM (SELECT event_id, {_LOW} AS low FROM events)")
def provider_stages(spark, sf_dir):
    return staged(spark, sf_dir).select("event_id", "stage")


@query(
    "stage_overridden",
    f"""WITH s AS (SELECT event_id, user_id, ts, {_STAGE} AS stage FROM (SELECT event_id, user_id, ts, {_LOW} AS low FROM events)), k AS (SELECT *, {_ORDER} AS place FROM s WHERE stage IS NOT NULL),
    a AS (SELECT user_id, min_by(place, (ts, event_id)) AS old, max_by(place, (ts, event_id)) AS new FROM k GROUP BY user_id)
    SELECT user_id, old, new, CASE WHEN new > old THEN new ELSE old END AS now FROM a""",
)
def stage_overridden(spark, sf_dir):
    """A later round takes the place of an older stage where it is higher."""
    at = F.struct("ts", "event_id")
    ends = staged(spark, sf_dir).where("stage is not null").withColumn("place", F.expr(_ORDER)).groupBy("user_id").agg(F.min_by("place", at).alias("old"), F.max_by("place", at).alias("new"))
    return ends.select("user_id", "old", "new", F.greatest("old", "new").alias("now"))


@query("pages_needing_browser", "SELECT page_id, length(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS text_chars, length(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) < 250 AND length(html) > 500 AS needs_browser FROM pages")
def pages_needing_browser(spark, sf_dir):
    """Pages with much markup and little text."""
    text = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"\s+", " "))
    return read(spark, sf_dir, "pages").select("page_id", F.length(text).cast("long").alias("text_chars"), ((F.length(text) < 250) & (F.length("html") > 500)).alias("needs_browser"))


@query(
    "gateways_merged",
    f"""WITH {PAGES_SQL}, saved AS (SELECT DISTINCT domain, CASE WHEN page_no % 3 = 0 THEN 'Stripe' ELSE 'Adyen' END AS gateway FROM pages_of WHERE page_no % 5 < 2),
    found AS (SELECT domain, bool_or({_has("html", "(?i)" + _CODE["Stripe"])} OR ({_has("html", "(?i)" + _KEY)} AND NOT {_key_elsewhere("html")})) AS stripe FROM pages_of GROUP BY domain), s AS (SELECT domain, 'Stripe' AS gateway FROM found WHERE stripe)
    SELECT coalesce(s.domain, v.domain) AS domain, coalesce(s.gateway, v.gateway) AS gateway, CASE WHEN s.domain IS NOT NULL THEN 'page' ELSE 'saved' END AS source FROM s FULL JOIN saved v ON v.domain = s.domain AND v.gateway = s.gateway""",
)
def gateways_merged(spark, sf_dir):
    """Gateways found on pages and those saved earlier; what pages show wins."""
    sites = site_pages(spark, sf_dir)
    found = O.gateways(sites).where("gateway = 'Stripe'").select("domain", "gateway", F.lit(True).alias("shown"))
    saved = sites.where("page_no % 5 < 2").select("domain", F.when(F.col("page_no") % 3 == 0, "Stripe").otherwise("Adyen").alias("gateway")).distinct()
    return found.join(saved, ["domain", "gateway"], "full").select("domain", "gateway", F.when(F.col("shown"), "page").otherwise("saved").alias("source"))
