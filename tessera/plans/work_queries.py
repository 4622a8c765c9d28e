"""Queries over work lists, excerpts, reviews and run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import sql_values
from tessera.functions import scalars as S
from tessera.plans.decision_queries import HEAD, decide_sql, verdicts
from tessera.plans.registry import query
from tessera.plans.site_queries import DESCRIPTIONS, JOBS_SQL, TITLES, _chosen, _has, chosen, jobs  # noqa: F401

PASSING = ("Yes", "Yes (some must-haves unconfirmed)", "Yes (pre-launch)", "Needs AI check")
LIMIT = 800


def read(spark, sf_dir, table) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_PASSES = ", ".join(repr(v) for v in PASSING)


@query("phase_select", f"{HEAD}, {decide_sql('services')} SELECT row_no, domain, verdict FROM decided JOIN leads USING (domain) WHERE verdict IN ({_PASSES}) AND verdict <> 'Needs AI check' AND row_no <= 100")
def phase_select(spark, sf_dir):
    """Leads for the second phase: passing verdicts, settled ones alone, among the list's first hundred rows."""
    from tessera.plans import leads as L

    rows = L.leads(spark, sf_dir).where("row_no <= 100").select("row_no", "domain")
    return verdicts(spark, sf_dir, "services").where(F.col("verdict").isin(*PASSING) & (F.col("verdict") != "Needs AI check")).select("domain", "verdict").join(rows, "domain")


@query("phase_skipped", f"{HEAD}, {decide_sql('services')} SELECT verdict AS reason, count(*) AS skipped FROM decided WHERE verdict NOT IN ({_PASSES}) OR verdict = 'Needs AI check' GROUP BY verdict")
def phase_skipped(spark, sf_dir):
    return verdicts(spark, sf_dir, "services").where(~F.col("verdict").isin(*PASSING) | (F.col("verdict") == "Needs AI check")).groupBy(F.col("verdict").alias("reason")).agg(F.count(F.lit(1)).alias("skipped"))


@query("pages_to_delete", f"{HEAD}, {decide_sql('services')} SELECT domain, verdict = 'No' OR status = 'unreachable' AS useful_drops, FALSE AS all_drops, TRUE AS none_drops FROM decided JOIN leads USING (domain)")
def pages_to_delete(spark, sf_dir):
    """Which saved pages each way of keeping drops: useful ones alone, all, none."""
    from tessera.plans import leads as L

    rows = L.leads(spark, sf_dir).select("domain", "status")
    drops = (F.col("verdict") == "No") | (F.col("status") == "unreachable")
    return verdicts(spark, sf_dir, "services").join(rows, "domain").select("domain", drops.alias("useful_drops"), F.lit(False).alias("all_drops"), F.lit(True).alias("none_drops"))


_HEAD = int(LIMIT * 0.6)


@query(
    "excerpt_decisive",
    rf"""WITH d AS (SELECT doc_id, replace(text, '. ', ' offices. ') AS text FROM documents), long AS (SELECT doc_id, text, unnest(string_split(regexp_replace(substr(text, {_HEAD + 1}), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS s, generate_subscripts(string_split(regexp_replace(substr(text, {_HEAD + 1}), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), 1) AS place
      FROM d WHERE length(text) > {LIMIT}),
    able AS (SELECT *, coalesce(sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM long WHERE length(s) < 400 AND {_has("s", S.DECISIVE)}),
    kept AS (SELECT doc_id, string_agg(trim(s), ' ' ORDER BY place) AS kept FROM able WHERE {_HEAD} + before < {LIMIT} GROUP BY doc_id)
    SELECT doc_id, CASE WHEN length(text) <= {LIMIT} THEN text ELSE substr(text, 1, {_HEAD}) || CASE WHEN kept IS NULL THEN '' ELSE substr(' [...] ' || kept, 1, {LIMIT - _HEAD}) END END AS excerpt FROM d LEFT JOIN kept USING (doc_id)""",
)
def excerpt_decisive(spark, sf_dir):
    """A text's opening and its later decisive sentences ("offices" is put before each full stop, so that there are some)."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit(". "), F.lit(" offices. ")).alias("text"))
    return docs.select("doc_id", S.excerpt(F.col("text"), LIMIT).alias("excerpt"))


_CUT, _FACTS = 40, r"(?i)\d|\b(?:ARR|MRR|revenue|customers?|clients?|growth|payroll|benefits|finance|accounting|bookkeep)\b|\bQuickBooks\b|\bXero\b|\bGusto\b"


@query(
    "job_digest",
    rf"""WITH {JOBS_SQL}, j AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY job_no) AS n FROM jobs_of QUALIFY n <= 15),
    parts AS (SELECT domain, job_no, title, description, list_filter(string_split(regexp_replace(substr(description, {_CUT + 1}), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_matches(s, '{_FACTS}') AND length(s) < 400) AS more FROM j)
    SELECT domain, substr(string_agg(title || ': ' || substr(description, 1, {_CUT}) || CASE WHEN len(more) > 0 AND substr(array_to_string(more, ' '), 1, 700) <> '' THEN ' [...] ' || substr(array_to_string(more, ' '), 1, 700) ELSE '' END, chr(10) || chr(10) ORDER BY job_no), 1, 9000) AS digest FROM parts GROUP BY domain""",
)
def job_digest(spark, sf_dir):
    """The first fifteen jobs of each company: their openings and the later sentences that carry facts."""
    first = jobs(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("domain").orderBy("job_no"))).where("n <= 15")
    more = F.filter(S.sentences_of(F.substring("description", F.lit(_CUT + 1), F.length("description"))), lambda s: s.rlike(_FACTS) & (F.length(s) < 400))
    more = F.substring(F.array_join(more, " "), 1, 700)
    text = F.concat("title", F.lit(": "), F.substring("description", 1, _CUT), F.when(more != "", F.concat(F.lit(" [...] "), more)).otherwise(""))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("job_no", text.alias("text")))), lambda x: x["text"]), "\n\n")
    return first.groupBy("domain").agg(F.substring(joined, 1, 9000).alias("digest"))


NAMES = ("Privacy Policy Overview Acme Ltd.", "Bank of Ohio Inc", "All rights reserved by The Sun and Moon LLC", "Terms Inc.", "Contact Us Bee Keepers of Utah Corp", "Welcome to Foo the Bar Baz PBC", "Solo")
_WORDS, _INNER = (", ".join(repr(w) for w in words) for words in (S.PAGE_WORDS, [w for w in S.PAGE_WORDS if w not in ("of", "and", "&")]))
_BARE = "regexp_replace(lower(w), '^[,.]+|[,.]+$', '', 'g')"


@query(
    "legal_names_cleaned",
    f"""WITH n AS (SELECT s_suppkey, {_chosen(NAMES, "s_suppkey")} AS name FROM supplier), w AS (SELECT *, string_split(name, ' ') AS words FROM n),
    b AS (SELECT *, words[1:len(words) - 1] AS body FROM w),
    f AS (SELECT *, coalesce(list_position(list_transform(body, lambda w: {_BARE} NOT IN ({_WORDS})), TRUE), 0) AS first FROM b),
    c AS (SELECT *, CASE WHEN first > 0 THEN body[first:] ELSE [] END AS rest FROM f),
    l AS (SELECT *, coalesce(list_position(list_reverse(list_transform(rest, lambda w: {_BARE} IN ({_INNER}))), TRUE), 0) AS last FROM c),
    e AS (SELECT *, CASE WHEN last > 0 THEN rest[len(rest) - last + 2:] ELSE rest END AS kept FROM l)
    SELECT s_suppkey, CASE WHEN len(kept) > 0 THEN array_to_string(kept, ' ') || ' ' || words[-1] ELSE name END AS legal_name FROM e""",
)
def legal_names_cleaned(spark, sf_dir):
    return read(spark, sf_dir, "supplier").select("s_suppkey", S.clean_legal_name(chosen(NAMES, F.col("s_suppkey"))).alias("legal_name"))


MONEY = (
    "We raised $750 million last year.", "Our customers raised $900 million together.", "We closed a round of $20 million.", "We reached a $44 billion valuation.", "Acme raised $300 million.", "We are valued at $2 billion and raised $150 million.", "Our launch was announced at $5 only.",
    "We have secured $120M in new money.",
)
_MONEY = r"(?i)(.{0,20})\$\s?(\d+(?:\.\d+)?)\s?(million|billion|[MB])\b(.{0,15})"
_GROUPS = ", ".join(f"regexp_extract_all(s, '{_MONEY}', {k})" for k in (1, 2, 3, 4))


@query(
    "late_stage_sentences",
    rf"""WITH m AS (SELECT s_suppkey, {_chosen(MONEY, "s_suppkey")} AS s FROM supplier),
    z AS (SELECT *, list_zip({_GROUPS}) AS z, regexp_matches(s, '(?i)\b(?:we|we''ve|we have|our)\b') AND NOT {_has("s", S.NOT_OWN_MONEY)} AND ({_has("s", S.BIG_RAISE)} OR {_has("s", S.VALUATION)}) AS own, {_has("s", S.BIG_RAISE)} AS big FROM m),
    l AS (SELECT s_suppkey, own, list_filter(list_transform(z, lambda x: CASE
        WHEN (contains(lower(x[4]), 'valuation') OR contains(lower(x[1]), 'valued at') OR contains(lower(x[1]), 'valuation of')) THEN CASE WHEN CAST(x[2] AS DOUBLE) * CASE WHEN lower(x[3]) IN ('billion', 'b') THEN 1e9 ELSE 1e6 END >= 1e9 THEN 'valued at $' || x[2] || ' ' || x[3] END
        WHEN CAST(x[2] AS DOUBLE) * CASE WHEN lower(x[3]) IN ('billion', 'b') THEN 1e9 ELSE 1e6 END >= 1e8 AND big THEN 'raised $' || x[2] || ' ' || x[3] || ' in one round' END), lambda x: x IS NOT NULL) AS labels FROM z)
    SELECT s_suppkey, CASE WHEN own THEN labels[1] END AS label FROM l""",
)
def late_stage_sentences(spark, sf_dir):
    return read(spark, sf_dir, "supplier").select("s_suppkey", S.late_stage_label(chosen(MONEY, F.col("s_suppkey"))).alias("label"))


RAW = ("Seed (confirmed)", "series b (Estimated)", "Series E (confirmed)", "Unknown (confirmed)", "Seed", "", "bootstrapped (not found)", " pre-seed  (estimated) ")


@query(
    "funding_lines",
    rf"""WITH {sql_values(list(S.STAGES), "stages", "named, value")}, r AS (SELECT s_suppkey, {_chosen(RAW, "s_suppkey")} AS raw, s_suppkey % 9 = 0 AS late FROM supplier),
    p AS (SELECT *, lower(trim(regexp_extract(raw, '(?i)^\s*(.+?)\s*\((confirmed|estimated|not found)\)\s*$', 1))) AS named, lower(regexp_extract(raw, '(?i)^\s*(.+?)\s*\((confirmed|estimated|not found)\)\s*$', 2)) AS basis FROM r)
    SELECT s_suppkey, CASE WHEN late THEN 'Funding stage: Series C or later (confirmed)' WHEN value IS NULL OR value = 'Unknown' OR basis = '' THEN 'Funding stage: Unknown (not found)' ELSE 'Funding stage: ' || value || ' (' || basis || ')' END AS line
    FROM p LEFT JOIN stages USING (named)""",
)
def funding_lines(spark, sf_dir):
    n = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select("s_suppkey", S.funding_line(chosen(RAW, n), n % 9 == 0).alias("line"))


_TITLE = ("CEO", "Head of Finance", "Engineer", "VP of Finance", "Chief Clerk", "Cook", "Co-Founder")


@query(
    "people_keys",
    f"""SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN 'id' || c_custkey ELSE '' END, ''), nullif(CASE WHEN c_custkey % 5 = 0 THEN 'in/' || c_custkey END, ''), lower(c_name)) AS person_key, {_has(_chosen(_TITLE, "c_custkey"), S.DECIDES)} AS decides,
      (3 <= length(split_part(lower(c_mktsegment), ' ', 1)) AND (contains(regexp_replace(lower(c_name || ' of ' || c_mktsegment), '[^a-z0-9]', '', 'g'), lower(c_mktsegment)))) AS named FROM customer""",
)
def people_keys(spark, sf_dir):
    n = F.col("c_custkey")
    key = S.person_key(F.when(n % 3 == 0, F.concat(F.lit("id"), n.cast("string"))).otherwise(""), F.when(n % 5 == 0, F.concat(F.lit("in/"), n.cast("string"))), F.col("c_name"))
    named = S.mentions_company(F.concat("c_name", F.lit(" of "), "c_mktsegment"), F.lower("c_mktsegment"), F.lit(""))
    return read(spark, sf_dir, "customer").select("c_custkey", key.alias("person_key"), chosen(_TITLE, n).rlike(S.DECIDES).alias("decides"), named.alias("named"))


# Reviews: an event is one; its user is the company, its type the fact, its number the verdict.
_VERDICT = ("approve", "reject", "correct", "investigate", "partially_correct", "approve")
_REVIEWS = f"reviews AS (SELECT user_id, event_type, event_id, ts, {_chosen(_VERDICT, 'event_id')} AS action, value FROM events), latest AS (SELECT * FROM reviews QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1)"


def latest_reviews(spark, sf_dir) -> DataFrame:
    """The latest review of each company and fact; it folds inside map tasks."""
    rows = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", chosen(_VERDICT, F.col("event_id")).alias("action"), "value")
    return rows.groupBy("user_id", "event_type").agg(F.max_by(F.struct("action", "value"), F.struct("ts", "event_id")).alias("r")).select("user_id", "event_type", "r.*")


@query("review_summary", f"WITH {_REVIEWS} SELECT event_type AS fact, count(*) AS tests, count(*) FILTER (action = 'approve') AS approved, count(*) FILTER (action = 'reject') AS rejected, count(*) FILTER (action = 'correct') AS corrected, round(avg(value), 6) AS mean_cost FROM latest GROUP BY event_type")
def review_summary(spark, sf_dir):
    return latest_reviews(spark, sf_dir).groupBy(F.col("event_type").alias("fact")).agg(
        F.count(F.lit(1)).alias("tests"), *[F.count_if(F.col("action") == a).alias(n) for a, n in (("approve", "approved"), ("reject", "rejected"), ("correct", "corrected"))], F.round(F.avg("value"), 6).alias("mean_cost")
    )


@query(
    "review_progress",
    f"""WITH {_REVIEWS} SELECT count(*) AS company_tests, count(DISTINCT event_type) AS facts_tested, count(DISTINCT event_type) FILTER (action IN ('approve', 'reject', 'correct')) AS facts_reviewed,
      (SELECT count(DISTINCT event_type) FROM events) - count(DISTINCT event_type) FILTER (action = 'reject') AS never_rejected, count(*) FILTER (action = 'investigate') AS to_investigate FROM latest""",
)
def review_progress(spark, sf_dir):
    final = F.col("action").isin("approve", "reject", "correct")
    tested = F.count_distinct("event_type")
    return latest_reviews(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("company_tests"), tested.alias("facts_tested"), F.count_distinct(F.when(final, F.col("event_type"))).alias("facts_reviewed"),
        (tested - F.count_distinct(F.when(F.col("action") == "reject", F.col("event_type")))).alias("never_rejected"), F.count_if(F.col("action") == "investigate").alias("to_investigate"),
    )


@query(
    "answer_rows_by_step",
    """WITH a AS (SELECT user_id, event_type, event_id % 2 + 1 AS step, max(event_id) AS last FROM events GROUP BY ALL)
    SELECT user_id, event_type, step, last, CASE WHEN step = max(step) OVER (PARTITION BY user_id, event_type) THEN 'counts' ELSE '' END AS counted_as FROM a""",
)
def answer_rows_by_step(spark, sf_dir):
    """Each step's answer; what it counted for stands on the last step alone."""
    rows = read(spark, sf_dir, "events").groupBy("user_id", "event_type", (F.col("event_id") % 2 + 1).alias("step")).agg(F.max("event_id").alias("last"))
    last = F.max("step").over(Window.partitionBy("user_id", "event_type"))
    return rows.select("user_id", "event_type", "step", "last", F.when(F.col("step") == last, "counts").otherwise("").alias("counted_as"))


_RESULT = "CASE WHEN event_type = 'purchase' THEN 'sold ' || CAST(user_id AS VARCHAR(20)) WHEN value > 50 THEN 'large' WHEN event_type = 'error' THEN 'failed' ELSE '' END"


@query("run_log_view", f"SELECT event_id, {_RESULT} AS result FROM events")
def run_log_view(spark, sf_dir):
    """A run's result in words: the first of its fields that is filled says it."""
    return read(spark, sf_dir, "events").select("event_id", F.expr(_RESULT).alias("result"))


@query("last_runs_start", "SELECT min(CAST(floor(epoch(ts)) AS BIGINT) - CAST(floor(value) AS BIGINT)) AS earliest FROM (SELECT ts, value FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 5)")
def last_runs_start(spark, sf_dir):
    """When the earliest of the last five runs began: its end less its seconds."""
    last = read(spark, sf_dir, "events").where("event_type = 'purchase'").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(5)
    return last.agg(F.min(F.unix_timestamp("ts") - F.floor("value")).alias("earliest"))


@query("costs_by_company", "SELECT user_id, round(sum(value), 4) AS cost, count(*) AS runs FROM events GROUP BY user_id")
def costs_by_company(spark, sf_dir):
    """All companies, the dearest first."""
    sums = read(spark, sf_dir, "events").groupBy("user_id").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("runs"))
    return sums.orderBy(F.col("s").desc(), "user_id").select("user_id", F.round("s", 4).alias("cost"), "runs")


@query(
    "sparse_cells",
    """SELECT c_custkey, array_to_string(list_filter(['name=' || c_name, 'segment=' || CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE c_mktsegment END, 'balance=' || CASE WHEN c_acctbal < 0 THEN '' ELSE 'paid' END], lambda x: NOT x LIKE '%='), '; ') AS cells FROM customer""",
)
def sparse_cells(spark, sf_dir):
    """A row's filled cells alone."""
    cells = F.create_map(F.lit("name"), "c_name", F.lit("segment"), F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment")), F.lit("balance"), F.when(F.col("c_acctbal") < 0, "").otherwise("paid"))
    filled = F.map_entries(F.map_filter(cells, lambda _, v: v != ""))
    return read(spark, sf_dir, "customer").select("c_custkey", F.array_join(F.transform(filled, lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ").alias("cells"))


@query(
    "provider_eligible",
    """WITH bought AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND event_id % 97 = 3), seen AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS errors, min(event_id) AS row_no FROM events GROUP BY user_id)
    SELECT user_id, row_no FROM seen WHERE errors < 30 AND user_id NOT IN (SELECT user_id FROM bought)""",
)
def provider_eligible(spark, sf_dir):
    """Companies that may still be bought: nothing against them, not bought yet."""
    rows = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    seen = rows.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.min("event_id").alias("row_no"))
    return seen.where("errors < 30").join(rows.where("event_type = 'purchase' AND event_id % 97 = 3").select("user_id").distinct(), "user_id", "left_anti").select("user_id", "row_no")


@query(
    "budget_check",
    """WITH m AS (SELECT date_trunc('month', ts) AS month, user_id, sum(value) AS spent, count(*) AS calls FROM events GROUP BY ALL)
    SELECT CAST(month AS DATE) AS month, user_id, calls <= 12 AS within_calls, spent <= 400 AS within_budget, round(greatest(0, 400 - spent), 4) AS left_over FROM m""",
)
def budget_check(spark, sf_dir):
    """Calls and spending of each company and month against their caps."""
    sums = read(spark, sf_dir, "events").groupBy(F.trunc(F.col("ts").cast("date"), "month").alias("month"), "user_id").agg(F.sum("value").alias("spent"), F.count(F.lit(1)).alias("calls"))
    return sums.select("month", "user_id", (F.col("calls") <= 12).alias("within_calls"), (F.col("spent") <= 400).alias("within_budget"), F.round(F.greatest(F.lit(0.0), 400 - F.col("spent")), 4).alias("left_over"))


@query(
    "highest_stage",
    """WITH s AS (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 END AS rank FROM events)
    SELECT user_id, rank, event_id FROM s WHERE rank IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rank DESC, event_id) = 1""",
)
def highest_stage(spark, sf_dir):
    """The highest stage that each company reached, with the first proof of it."""
    kind = F.col("event_type")
    rank = F.when(kind == "signup", 0).when(kind == "view", 1).when(kind == "click", 2).when(kind == "purchase", 3)
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", rank.alias("rank")).where("rank is not null")
    return rows.groupBy("user_id").agg(F.max(F.struct("rank", (-F.col("event_id")).alias("back"))).alias("best")).select("user_id", "best.rank", (-F.col("best.back")).alias("event_id"))
