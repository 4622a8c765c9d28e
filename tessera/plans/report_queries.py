"""Reports over answers, runs, labels and contacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import relational as R
from tessera.plans.leads import AS_OF
from tessera.plans.registry import query
from tessera.plans.text_queries import read

EVENTS_AS_OF = "2024-01-31"


def events(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "events")


# Answers: an event is an answer of an entity (user_id) to a question (event_type) with a step and a cost.
ANSWERS_SQL = "answers AS (SELECT event_id, user_id, event_type AS prompt, CAST(event_id % 2 + 1 AS INT) AS step, value AS cost, ts AS created, event_id % 13 = 0 AS failed FROM events)"


def answers(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).select(
        "event_id", "user_id", F.col("event_type").alias("prompt"), (F.col("event_id") % 2 + 1).cast("int").alias("step"), F.col("value").alias("cost"), F.col("ts").alias("created"), (F.col("event_id") % 13 == 0).alias("failed")
    )


@query(
    "answers_latest_step",
    f"WITH {ANSWERS_SQL} SELECT user_id, prompt, step, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, prompt ORDER BY failed, step DESC, created DESC, event_id DESC) AS n FROM answers) WHERE n = 1",
)
def answers_latest_step(spark, sf_dir):
    """Step 2 where it didn't fail, else step 1; the latest of each."""
    order = [F.col("failed"), F.col("step").desc(), F.col("created").desc(), F.col("event_id").desc()]
    return R.latest(answers(spark, sf_dir), ["user_id", "prompt"], order).select("user_id", "prompt", "step", "event_id")


@query(
    "answers_keep_latest",
    "SELECT user_id, event_type, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
)
def answers_keep_latest(spark, sf_dir):
    """An upsert's outcome: the last row of each key."""
    best = F.max_by(F.struct("event_id", "ts"), F.struct("ts", "event_id")).alias("b")
    return events(spark, sf_dir).groupBy("user_id", "event_type").agg(best).select("user_id", "event_type", "b.event_id", "b.ts")


FRESH_DAYS = (("view", 30), ("click", 60), ("signup", 30), ("purchase", 14), ("error", 7))
TTL_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {d}" for k, d in FRESH_DAYS) + " END"


def ttl(column: str = "event_type"):
    out = None
    for kind, days in FRESH_DAYS:
        out = F.when(F.col(column) == kind, days) if out is None else out.when(F.col(column) == kind, days)
    return out


@query("ttl_stale", f"SELECT event_type, count(*) AS n, count(*) FILTER (CAST(ts AS DATE) < DATE '{EVENTS_AS_OF}' - {TTL_SQL}) AS stale FROM events GROUP BY event_type")
def ttl_stale(spark, sf_dir):
    old = F.col("ts").cast("date") < F.date_sub(F.lit(EVENTS_AS_OF).cast("date"), ttl())
    return events(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(old).alias("stale"))


@query(
    "cache_adopt_all_or_nothing",
    f"""WITH s AS (SELECT user_id, event_type, event_id, CAST(ts AS DATE) >= DATE '{EVENTS_AS_OF}' - {TTL_SQL} AS fresh FROM events),
    g AS (SELECT user_id, event_type, count(*) AS steps FROM s GROUP BY user_id, event_type HAVING bool_and(fresh))
    SELECT g.user_id, g.event_type, g.steps FROM g WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = g.user_id AND c_acctbal > 5000)""",
)
def cache_adopt_all_or_nothing(spark, sf_dir):
    """Answer sets of which every step is fresh, for entities that have none of their own."""
    good = F.col("ts").cast("date") >= F.date_sub(F.lit(EVENTS_AS_OF).cast("date"), ttl())
    sets = events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("steps"), F.bool_and(good).alias("fresh")).where("fresh").drop("fresh")
    have = read(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("user_id"))
    return sets.join(have, "user_id", "left_anti")


@query(
    "ai_cost_per_domain",
    f"""WITH {ANSWERS_SQL} SELECT user_id, round(sum(cost) FILTER (step = 1), 4) AS first_cost, round(sum(cost) FILTER (step = 2), 4) AS second_cost,
    count(*) AS calls, count(*) FILTER (failed) AS failures FROM answers WHERE created >= TIMESTAMP '2024-01-10' GROUP BY user_id""",
)
def ai_cost_per_domain(spark, sf_dir):
    cost = lambda s: F.round(F.sum(F.when(F.col("step") == s, F.col("cost"))), 4)
    since = answers(spark, sf_dir).where(F.col("created") >= F.lit("2024-01-10").cast("timestamp"))
    return since.groupBy("user_id").agg(cost(1).alias("first_cost"), cost(2).alias("second_cost"), F.count(F.lit(1)).alias("calls"), F.count_if("failed").alias("failures"))


@query(
    "usage_report_rollup",
    """WITH u AS (SELECT event_type, substr(CAST(ts AS VARCHAR), 1, 7) AS month, user_id, value FROM events)
    SELECT event_type, month, max(user_id) AS most, count(*) AS calls, round(sum(value), 2) AS cost FROM u GROUP BY ROLLUP (event_type, month)""",
)
def usage_report_rollup(spark, sf_dir):
    """Per kind and month: the largest of one measure, sums of the others, with totals."""
    u = events(spark, sf_dir).withColumn("month", F.date_format("ts", "yyyy-MM"))
    return u.rollup("event_type", "month").agg(F.max("user_id").alias("most"), F.count(F.lit(1)).alias("calls"), F.round(F.sum("value"), 2).alias("cost"))


@query("monthly_spend", "SELECT substr(CAST(ts AS VARCHAR), 1, 7) AS month, round(sum(value) FILTER (event_type IN ('purchase', 'signup')), 2) AS spend FROM events GROUP BY 1")
def monthly_spend(spark, sf_dir):
    spend = F.when(F.col("event_type").isin("purchase", "signup"), F.col("value"))
    return events(spark, sf_dir).groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.round(F.sum(spend), 2).alias("spend"))


@query("stage_timing_median", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total, round(median(value), 6) AS median, max(value) AS longest FROM events GROUP BY event_type")
def stage_timing_median(spark, sf_dir):
    return events(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"), F.round(F.median("value"), 6).alias("median"), F.max("value").alias("longest"))


@query(
    "event_proposals_having",
    """WITH g AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'view') AS views,
      list_sort(list_distinct(list(event_type))) AS kinds FROM events WHERE ts > TIMESTAMP '2024-01-05' GROUP BY user_id)
    SELECT user_id, n, errors, views, array_to_string(kinds[1:3], ',') AS examples FROM g WHERE (n >= 8 AND views >= 0.3 * n) OR errors >= 3""",
)
def event_proposals_having(spark, sf_dir):
    """Groups over a threshold since the last decision, with their first examples."""
    kind = F.col("event_type")
    g = (
        events(spark, sf_dir).where(F.col("ts") > F.lit("2024-01-05").cast("timestamp")).groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(kind == "error").alias("errors"), F.count_if(kind == "view").alias("views"), F.array_sort(F.collect_set(kind)).alias("kinds"))
    )
    over = ((F.col("n") >= 8) & (F.col("views") >= 0.3 * F.col("n"))) | (F.col("errors") >= 3)
    return g.where(over).select("user_id", "n", "errors", "views", F.array_join(F.slice("kinds", 1, 3), ",").alias("examples"))


@query("outcomes_by_fact", "SELECT user_id % 50 AS fact, count(*) FILTER (event_type = 'view') AS counted, count(*) FILTER (event_type = 'error') AS rejected, count(*) FILTER (event_type NOT IN ('view', 'error')) AS unknown FROM events GROUP BY 1")
def outcomes_by_fact(spark, sf_dir):
    kind = F.col("event_type")
    return events(spark, sf_dir).groupBy((F.col("user_id") % 50).alias("fact")).agg(F.count_if(kind == "view").alias("counted"), F.count_if(kind == "error").alias("rejected"), F.count_if(~kind.isin("view", "error")).alias("unknown"))


@query("allocate_group_cost", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id) / count(*) OVER (PARTITION BY user_id), 6) AS share FROM events")
def allocate_group_cost(spark, sf_dir):
    w = Window.partitionBy("user_id")
    return events(spark, sf_dir).select("event_id", F.round(F.sum("value").over(w) / F.count(F.lit(1)).over(w), 6).alias("share"))


@query(
    "cost_estimate_chunks",
    "SELECT user_id, CAST(ceil(count(*) / 4.0) AS BIGINT) AS calls, round(ceil(count(*) / 4.0) * 0.9 + count(*) * 0.25, 4) AS tokens FROM events GROUP BY user_id",
)
def cost_estimate_chunks(spark, sf_dir):
    n = F.count(F.lit(1))
    calls = F.ceil(n / 4.0)
    return events(spark, sf_dir).groupBy("user_id").agg(calls.cast("long").alias("calls"), F.round(calls * F.lit(0.9) + n * F.lit(0.25), 4).cast("double").alias("tokens"))


@query(
    "call_cost_formula",
    "SELECT o_orderkey, round(((o_orderkey % 5000 - o_orderkey % 700) * 0.15 + (o_orderkey % 700) * 0.075 + (o_orderkey % 900) * 0.6 + (o_orderkey % 3) * 10000.0) / 1e6, 9) AS usd FROM orders",
)
def call_cost_formula(spark, sf_dir):
    k = F.col("o_orderkey")
    usd = ((k % 5000 - k % 700) * F.lit(0.15) + (k % 700) * F.lit(0.075) + (k % 900) * F.lit(0.6) + (k % 3) * F.lit(10000.0)) / F.lit(1e6)
    return read(spark, sf_dir, "orders").select("o_orderkey", F.round(usd, 9).alias("usd"))


# Runs: a customer's finished orders against the open ones.
RUNS_SQL = """a AS (SELECT o_custkey, count(*) AS n, max(o_orderpriority) AS top FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey),
b AS (SELECT o_custkey, count(*) AS n, max(o_orderpriority) AS top FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey)"""


def run(spark, sf_dir, status: str) -> DataFrame:
    return read(spark, sf_dir, "orders").where(F.col("o_orderstatus") == status).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderpriority").alias("top"))


@query(
    "compare_runs",
    f"""WITH {RUNS_SQL}, j AS (SELECT a.o_custkey, CAST(a.n AS VARCHAR) AS n0, CAST(b.n AS VARCHAR) AS n1, a.top AS t0, b.top AS t1 FROM a JOIN b USING (o_custkey))
    SELECT o_custkey, 'n' AS field, n0 AS before, n1 AS after FROM j WHERE n0 IS DISTINCT FROM n1 UNION ALL SELECT o_custkey, 'top', t0, t1 FROM j WHERE t0 IS DISTINCT FROM t1""",
)
def compare_runs(spark, sf_dir):
    """Fields that differ between two runs of the same entities."""
    a, b = run(spark, sf_dir, "F").alias("a"), run(spark, sf_dir, "O").alias("b")
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"a.{c}").cast("string").alias("before"), F.col(f"b.{c}").cast("string").alias("after")) for c in ("n", "top")])
    joined = a.join(b, F.col("a.o_custkey") == F.col("b.o_custkey")).select("a.o_custkey", F.explode(cells).alias("c"))
    return joined.select("o_custkey", "c.*").where(~F.col("before").eqNullSafe(F.col("after")))


@query(
    "bench_full_outer",
    f"WITH {RUNS_SQL} SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, a.n AS n_a, b.n AS n_b, CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'gone' WHEN a.n = b.n THEN 'same' ELSE 'changed' END AS state FROM a FULL JOIN b ON a.o_custkey = b.o_custkey",
)
def bench_full_outer(spark, sf_dir):
    a, b = run(spark, sf_dir, "F").select("o_custkey", F.col("n").alias("n_a")), run(spark, sf_dir, "O").select("o_custkey", F.col("n").alias("n_b"))
    state = F.when(F.col("n_a").isNull(), "added").when(F.col("n_b").isNull(), "gone").when(F.col("n_a") == F.col("n_b"), "same").otherwise("changed")
    return a.join(b, "o_custkey", "full_outer").withColumn("state", state)


@query("overlay_precedence", f"WITH {RUNS_SQL} SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, coalesce(a.top, b.top) AS top FROM a FULL JOIN b ON a.o_custkey = b.o_custkey")
def overlay_precedence(spark, sf_dir):
    return R.overlay(run(spark, sf_dir, "F"), run(spark, sf_dir, "O"), ["o_custkey"], "top")


@query(
    "key_sets",
    """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P')
    SELECT 'union' AS op, count(*) AS n FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'both', count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)
    UNION ALL SELECT 'only first', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)""",
)
def key_sets(spark, sf_dir):
    keys = lambda s: read(spark, sf_dir, "orders").where(F.col("o_orderstatus") == s).select("o_custkey").distinct()
    a, b = keys("F"), keys("P")
    n = lambda df, op: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(op).alias("op"), "n")
    return n(a.union(b).distinct(), "union").unionByName(n(a.intersect(b), "both")).unionByName(n(a.subtract(b), "only first"))


@query(
    "dup_rows_first_seen",
    "SELECT o_orderkey, o_custkey, min(o_orderkey) OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE)) AS first_row, o_orderkey > min(o_orderkey) OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE)) AS is_dup FROM orders",
)
def dup_rows_first_seen(spark, sf_dir):
    first = F.min("o_orderkey").over(Window.partitionBy("o_custkey", F.col("o_orderdate").cast("date")))
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", first.alias("first_row"), (F.col("o_orderkey") > first).alias("is_dup"))


# Contacts: a customer's orders are its people; line items their details.
CONTACT_RANK = "CASE WHEN o_orderpriority = '1-URGENT' THEN 0 WHEN o_orderpriority = '2-HIGH' THEN 1 WHEN o_orderstatus = 'F' THEN 2 ELSE 3 END"


@query("top_contacts", f"SELECT o_custkey, o_orderkey, rank, place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY rank, o_orderkey) AS place FROM (SELECT o_custkey, o_orderkey, {CONTACT_RANK} AS rank FROM orders)) WHERE place <= 3")
def top_contacts(spark, sf_dir):
    """The three best contacts of each company, ties by their order."""
    ranked = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.expr(CONTACT_RANK).alias("rank"))
    return R.top_n(ranked, ["o_custkey"], [F.col("rank"), F.col("o_orderkey")], 3)


@query(
    "contacts_wide",
    f"""WITH l AS (SELECT l_orderkey, count(*) AS items, min(l_linenumber) AS first_line, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS returned FROM lineitem GROUP BY l_orderkey)
    SELECT c_custkey, c_name, o_orderkey, {CONTACT_RANK} AS rank, coalesce(items, 0) AS items, coalesce(CASE WHEN returned = 1 THEN 'returned' END, CASE WHEN items > 3 THEN 'many' END, '') AS source
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN l ON l_orderkey = o_orderkey""",
)
def contacts_wide(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("items"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("returned"))
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus")
    joined = read(spark, sf_dir, "customer").select("c_custkey", "c_name").join(orders, F.col("o_custkey") == F.col("c_custkey"), "left").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    source = F.coalesce(F.when(F.col("returned") == 1, "returned"), F.when(F.col("items") > 3, "many"), F.lit(""))
    return joined.select("c_custkey", "c_name", "o_orderkey", F.expr(CONTACT_RANK).alias("rank"), F.coalesce("items", F.lit(0)).alias("items"), source.alias("source"))


@query("contact_counts", "SELECT c_custkey, count(o_orderkey) AS contacts, count(DISTINCT o_orderpriority) AS kinds FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def contact_counts(spark, sf_dir):
    joined = read(spark, sf_dir, "customer").select("c_custkey").join(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.groupBy("c_custkey").agg(F.count("o_orderkey").alias("contacts"), F.count_distinct("o_orderpriority").alias("kinds"))


@query(
    "contacts_still_needed",
    f"""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY {CONTACT_RANK}, o_orderkey) AS place FROM orders)
    SELECT o_custkey, o_orderkey FROM r WHERE place <= 2 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""",
)
def contacts_still_needed(spark, sf_dir):
    ranked = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.expr(CONTACT_RANK).alias("rank"))
    done = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.top_n(ranked, ["o_custkey"], [F.col("rank"), F.col("o_orderkey")], 2).join(done, "o_orderkey", "left_anti").select("o_custkey", "o_orderkey")


# Labels: quality against what a rule says of a document.
JUDGED_SQL = """judged AS (SELECT doc_id, quality, CASE WHEN n_chars >= 800 THEN 'yes' WHEN n_chars < 300 THEN 'no' ELSE 'pending' END AS said, CAST(floor(ln(n_chars + 1) * 4) AS BIGINT) AS score
FROM documents JOIN labels USING (doc_id))"""


def judged(spark, sf_dir) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    said = F.when(F.col("n_chars") >= 800, "yes").when(F.col("n_chars") < 300, "no").otherwise("pending")
    return docs.join(read(spark, sf_dir, "labels"), "doc_id").select("doc_id", "quality", said.alias("said"), F.floor(F.ln(F.col("n_chars") + 1) * 4).cast("long").alias("score"))


@query(
    "evaluate_confusion",
    f"""WITH {JUDGED_SQL}, o AS (SELECT CASE WHEN said = 'pending' THEN 'pending' WHEN (said = 'yes') = (quality = 1) THEN 'right' WHEN said = 'no' THEN 'wrong_no' ELSE 'wrong_yes' END AS outcome FROM judged)
    SELECT count(*) FILTER (outcome = 'right') AS right_n, count(*) FILTER (outcome = 'wrong_no') AS wrong_no, count(*) FILTER (outcome = 'wrong_yes') AS wrong_yes, count(*) FILTER (outcome = 'pending') AS pending,
      round(count(*) FILTER (outcome = 'right') / nullif(count(*) FILTER (outcome <> 'pending'), 0)::DOUBLE, 6) AS accuracy FROM o""",
)
def evaluate_confusion(spark, sf_dir):
    """Right and wrong among the decided; undecided ones don't count against."""
    outcome = (
        F.when(F.col("said") == "pending", "pending").when((F.col("said") == "yes") == (F.col("quality") == 1), "right").when(F.col("said") == "no", "wrong_no").otherwise("wrong_yes")
    )
    n = lambda v: F.count_if(F.col("outcome") == v)
    accuracy = F.round(F.try_divide(n("right"), F.count_if(F.col("outcome") != "pending")), 6)
    return judged(spark, sf_dir).select(outcome.alias("outcome")).agg(n("right").alias("right_n"), n("wrong_no").alias("wrong_no"), n("wrong_yes").alias("wrong_yes"), n("pending").alias("pending"), accuracy.alias("accuracy"))


@query(
    "calibrate_log_ratio",
    """WITH f AS (SELECT doc_id, quality, unnest(['table', 'shout', 'symbols', 'phone']) AS fact, unnest([contains(text, ' | '), regexp_matches(text, '[A-Z]{4,}'), regexp_matches(text, '[#*$%&]{3}'), regexp_matches(text, '[+][0-9]')]) AS yes
      FROM documents JOIN labels USING (doc_id)),
    g AS (SELECT fact, count(*) FILTER (yes AND quality = 1) AS h, count(*) FILTER (yes AND quality = 0) AS d, count(*) FILTER (quality = 1) AS hn, count(*) FILTER (quality = 0) AS dn FROM f GROUP BY fact),
    r AS (SELECT fact, h, d, round(ln(((h + 0.5) / (hn + 1)) / ((d + 0.5) / (dn + 1))), 6) AS log_ratio FROM g)
    SELECT fact, h, d, log_ratio, CASE WHEN h + d < 5 THEN 'too few' WHEN abs(log_ratio) >= 1.0 THEN 'high' WHEN abs(log_ratio) >= 0.5 THEN 'medium' WHEN abs(log_ratio) >= 0.2 THEN 'low' ELSE 'none' END AS weight FROM r""",
)
def calibrate_log_ratio(spark, sf_dir):
    """How much more often a fact is yes on one side of the labels, and the weight that it earns."""
    t = F.col("text")
    facts = {"table": t.contains(" | "), "shout": t.rlike("[A-Z]{4,}"), "symbols": t.rlike("[#*$%&]{3}"), "phone": t.rlike("[+][0-9]")}
    cells = F.array(*[F.struct(F.lit(k).alias("fact"), v.alias("yes")) for k, v in facts.items()])
    long = read(spark, sf_dir, "documents").select("doc_id", F.explode(cells).alias("c")).join(read(spark, sf_dir, "labels"), "doc_id")
    yes, good = F.col("c.yes"), F.col("quality") == 1
    g = long.groupBy("c.fact").agg(F.count_if(yes & good).alias("h"), F.count_if(yes & ~good).alias("d"), F.count_if(good).alias("hn"), F.count_if(~good).alias("dn"))
    ratio = F.round(F.ln(((F.col("h") + 0.5) / (F.col("hn") + 1)) / ((F.col("d") + 0.5) / (F.col("dn") + 1))), 6)
    size = F.abs("log_ratio")
    weight = F.when(F.col("h") + F.col("d") < 5, "too few").when(size >= 1.0, "high").when(size >= 0.5, "medium").when(size >= 0.2, "low").otherwise("none")
    return g.withColumn("log_ratio", ratio).select("fact", "h", "d", "log_ratio", weight.alias("weight"))


@query(
    "auc_rank",
    f"""WITH {JUDGED_SQL}, p AS (SELECT score, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality = 0) AS n FROM judged GROUP BY score)
    SELECT round(sum(a.p * b.n * CASE WHEN a.score > b.score THEN 1.0::DOUBLE WHEN a.score = b.score THEN 0.5::DOUBLE ELSE 0 END) / (sum(a.p * b.n)), 6) AS auc FROM p a CROSS JOIN p b""",
)
def auc_rank(spark, sf_dir):
    return R.auc(judged(spark, sf_dir), "score", "quality")


@query(
    "best_cutoff",
    f"""WITH {JUDGED_SQL}, p AS (SELECT score, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality = 0) AS n FROM judged GROUP BY score),
    c AS (SELECT score, sum(p) OVER (ORDER BY score DESC) / sum(p) OVER ()::DOUBLE - sum(n) OVER (ORDER BY score DESC) / sum(n) OVER ()::DOUBLE AS j FROM p)
    SELECT score AS cutoff, round(j, 6) AS j FROM c ORDER BY round(j, 9) DESC, score LIMIT 1""",
)
def best_cutoff(spark, sf_dir):
    return R.best_cutoff(judged(spark, sf_dir), "score", "quality")


@query(
    "label_columns_long",
    "SELECT doc_id, unnest(['quality', 'toxic']) AS fact, unnest([CAST(quality AS INT), CAST(toxic AS INT)]) AS expected FROM labels",
)
def label_columns_long(spark, sf_dir):
    return read(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int"), F.col("toxic").cast("int")).unpivot("doc_id", ["quality", "toxic"], "fact", "expected")


# Time: windows before a day, and the snapshot nearest to a year ago.
@query(
    "recent_window",
    f"""SELECT c_custkey, count(o_orderkey) FILTER (date_diff('day', CAST(o_orderdate AS DATE), DATE '{AS_OF}') BETWEEN 0 AND 183) AS half_year,
      count(o_orderkey) FILTER (date_diff('day', CAST(o_orderdate AS DATE), DATE '{AS_OF}') BETWEEN 0 AND 365) AS year,
      count(o_orderkey) FILTER (date_diff('day', CAST(o_orderdate AS DATE), DATE '{AS_OF}') BETWEEN 0 AND 548) AS longer FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""",
)
def recent_window(spark, sf_dir):
    back = F.datediff(F.lit(AS_OF).cast("date"), F.col("o_orderdate"))
    n = lambda d: F.count_if(back.between(0, d))
    joined = read(spark, sf_dir, "customer").select("c_custkey").join(read(spark, sf_dir, "orders").select("o_custkey", "o_orderdate"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.groupBy("c_custkey").agg(n(183).alias("half_year"), n(365).alias("year"), n(548).alias("longer"))


@query(
    "as_of_nearest",
    f"""WITH s AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day, abs(date_diff('day', CAST(o_orderdate AS DATE), DATE '{AS_OF}') - 365) AS gap FROM orders
      WHERE date_diff('day', CAST(o_orderdate AS DATE), DATE '{AS_OF}') BETWEEN 183 AND 547)
    SELECT o_custkey, CAST(day AS VARCHAR) AS day, o_orderkey, CAST(gap AS INT) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY gap, day, o_orderkey) AS n FROM s) WHERE n = 1""",
)
def as_of_nearest(spark, sf_dir):
    """Each customer's snapshot nearest to a year before the day, within six to eighteen months."""
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    first = orders.groupBy("o_custkey", "day").agg(F.min("o_orderkey").alias("o_orderkey"))
    return R.nearest(first, ["o_custkey"], "day", F.lit(AS_OF).cast("date"), 183, 547).select("o_custkey", F.col("day").cast("string").alias("day"), "o_orderkey", F.col("gap").cast("int").alias("gap"))


# Grid: a nested filter and a sort over customers.
TREE = {"any": [{"all": [{"column": "c_mktsegment", "op": "is", "value": "building"}, {"column": "c_acctbal", "op": "gt", "value": "5000"}]},
                {"all": [{"column": "c_name", "op": "contains", "value": "0001"}, {"column": "c_acctbal", "op": "lt", "value": "0"}, {"column": "c_name", "op": "empty", "on": False}]}]}


@query("grid_filter_tree", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE (lower(c_mktsegment) = 'building' AND c_acctbal > 5000) OR (contains(lower(c_name), '0001') AND c_acctbal < 0)")
def grid_filter_tree(spark, sf_dir):
    return read(spark, sf_dir, "customer").where(R.predicate(TREE)).select("c_custkey", "c_mktsegment", "c_acctbal")


@query(
    "grid_sort_empties_last",
    """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN '' ELSE c_mktsegment END AS seg, c_acctbal FROM customer)
    SELECT c_custkey, row_number() OVER (PARTITION BY c_custkey % 20 ORDER BY CASE WHEN seg = '' THEN 1 ELSE 0 END, lower(seg) DESC, c_acctbal, c_custkey) AS place FROM c""",
)
def grid_sort_empties_last(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 10 == 0, "").otherwise(F.col("c_mktsegment")).alias("seg"), "c_acctbal")
    return rows.select("c_custkey", F.row_number().over(Window.partitionBy(F.col("c_custkey") % 20).orderBy(*R.grid_order([("seg", True), ("c_acctbal", False)]), "c_custkey")).alias("place"))


@query("grid_quick_search", "SELECT c_custkey FROM customer WHERE contains(lower(c_name), '77') OR contains(lower(c_mktsegment), 'house')")
def grid_quick_search(spark, sf_dir):
    rows = read(spark, sf_dir, "customer")
    return rows.where(R.text_search(["c_name"], "77") | R.text_search(["c_mktsegment"], "HOUSE")).select("c_custkey")


@query("grid_cells", "SELECT c_custkey, c_name, max(o_orderpriority) FILTER (o_orderstatus = 'F') AS done, count(o_orderkey) AS details FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name")
def grid_cells(spark, sf_dir):
    joined = read(spark, sf_dir, "customer").select("c_custkey", "c_name").join(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.groupBy("c_custkey", "c_name").agg(F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))).alias("done"), F.count("o_orderkey").alias("details"))


# Layers, plans and settings.
@query(
    "waterfall_layers",
    """WITH layers(ord, layer) AS (VALUES (1, 'rules'), (2, 'directories'), (3, 'ai_pages'), (4, 'ai_web'), (5, 'provider')),
    w AS (SELECT user_id, max(event_id % 5 + 1) AS done FROM events GROUP BY user_id)
    SELECT user_id, layer, CASE WHEN ord < done THEN 'asked' WHEN ord = done THEN 'decided' ELSE 'not needed' END AS status FROM w CROSS JOIN layers""",
)
def waterfall_layers(spark, sf_dir):
    """What each of five layers did for an entity; the layers are an array, so nothing is joined."""
    done = events(spark, sf_dir).groupBy("user_id").agg(F.max(F.col("event_id") % 5 + 1).alias("done"))
    long = done.select("user_id", "done", F.posexplode(F.array(*map(F.lit, ("rules", "directories", "ai_pages", "ai_web", "provider")))).alias("pos", "layer"))
    at = F.col("pos") + 1
    return long.select("user_id", "layer", F.when(at < F.col("done"), "asked").when(at == F.col("done"), "decided").otherwise("not needed").alias("status"))


@query(
    "settings_validation",
    "SELECT page_id, CASE WHEN regexp_full_match(url, 'https://.*') THEN 'ok' WHEN regexp_full_match(url, 'http://.*') THEN 'not secure' ELSE 'bad' END AS url_state, page_id BETWEEN 10 AND 200 AS in_range FROM pages",
)
def settings_validation(spark, sf_dir):
    state = F.when(F.col("url").startswith("https://"), "ok").when(F.col("url").startswith("http://"), "not secure").otherwise("bad")
    return read(spark, sf_dir, "pages").select("page_id", state.alias("url_state"), F.col("page_id").between(10, 200).alias("in_range"))


@query(
    "error_rates_by_day",
    """SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, max(ts) FILTER (event_type = 'error') AS last_error,
      max(ts) FILTER (event_type <> 'error') > max(ts) FILTER (event_type = 'error') AS recovered FROM events GROUP BY ALL""",
)
def error_rates_by_day(spark, sf_dir):
    """Errors of each user and day, and whether anything went well after the last one; folded inside map tasks."""
    bad = F.col("event_type") == "error"
    last = F.max(F.when(bad, F.col("ts")))
    return events(spark, sf_dir).groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("errors"), last.alias("last_error"), (F.max(F.when(~bad, F.col("ts"))) > last).alias("recovered")
    )


@query(
    "newest_wins_import",
    "SELECT c_mktsegment, c_nationkey, max_by(c_custkey, (c_acctbal, c_custkey)) AS newest FROM customer GROUP BY c_mktsegment, c_nationkey",
)
def newest_wins_import(spark, sf_dir):
    return read(spark, sf_dir, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.max_by("c_custkey", F.struct("c_acctbal", "c_custkey")).alias("newest"))


@query("implied_one_hop", """WITH own AS (SELECT DISTINCT user_id, event_type AS tech FROM events), implies(tech, also) AS (VALUES ('purchase', 'signup'), ('signup', 'view'), ('click', 'view'))
    SELECT user_id, tech FROM own UNION SELECT o.user_id, i.also FROM own o JOIN implies i USING (tech)""")
def implied_one_hop(spark, sf_dir):
    """What entities have, and what that implies directly; implied things imply nothing further."""
    own = events(spark, sf_dir).select("user_id", F.col("event_type").alias("tech")).distinct()
    also = F.when(F.col("tech") == "purchase", "signup").when(F.col("tech").isin("signup", "click"), "view")
    return own.unionByName(own.select("user_id", also.alias("tech")).where(F.col("tech").isNotNull())).distinct()
