"""Queries over the decision core: facts, verdicts, merging, conditional facts, scores, tiers and the wide list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import merging, scoring
from tessera import config
from tessera.plans import leads as L
from tessera.plans.registry import query

HEAD = f"WITH {L.ROLES_SQL}, {L.WEIGHTS_SQL}, {L.LEADS_SQL}, {L.SIGNALS_SQL}"


def facts_of(spark: SparkSession, sf_dir: str, pipeline: str) -> tuple[DataFrame, DataFrame]:
    """Leads and their facts with grp, place, name and hard."""
    found = L.leads(spark, sf_dir)
    return found, scoring.with_roles(L.signals(found), L.roles(spark), pipeline).withColumn("hard", F.lit(False))


def core(spark: SparkSession, sf_dir: str, pipeline: str) -> DataFrame:
    """Leads with their facts, verdict, segment and score in one row; orders are the only shuffle."""
    wide = L.wide(L.leads(spark, sf_dir)).withColumn("segment", scoring.segment(F.col("employees")))
    return scoring.score_wide(scoring.decide_wide(wide, pipeline), pipeline)


VERDICT = ("domain", "gate", "verdict", "icp", "confirmed", "checks", "excluded", "failed", "prelaunch")


def verdicts(spark: SparkSession, sf_dir: str, pipeline: str) -> DataFrame:
    """Services by rows of facts side by side, product by one row a fact: the two forms of the operator."""
    if pipeline == "services":
        return scoring.decide_wide(L.wide(L.leads(spark, sf_dir)), pipeline).select(*VERDICT)
    found, signals = facts_of(spark, sf_dir, pipeline)
    return scoring.decide(signals, found.select("domain", "status"), pipeline)


def decide_sql(pipeline: str, source: str = "signals") -> str:
    soft = ", ".join(repr(s) for s in config.SOFT_MUSTS[pipeline]) or "''"
    listed = lambda when: f"coalesce(string_agg(sid, ',' ORDER BY place) FILTER ({when}), '')"
    return f"""
flags AS (
  SELECT domain,
    {listed("grp = 'exclusion' AND value = 'yes'")} AS excluded,
    {listed(f"grp = 'must' AND value = 'no' AND sid NOT IN ({soft})")} AS failed,
    {listed(f"grp = 'must' AND value = 'no' AND sid IN ({soft})")} AS prelaunch,
    {listed("grp IN ('must', 'exclusion') AND value = 'check'")} AS checks,
    count(*) FILTER (grp = 'must' AND value = 'yes') AS confirmed, count(*) FILTER (grp = 'must') AS musts,
    count(*) FILTER (grp = 'must' AND value = 'no') AS nos
  FROM {source} JOIN roles USING (sid) WHERE pipeline = '{pipeline}' GROUP BY domain),
gated AS (
  SELECT f.*, l.status, CASE
    WHEN status IN ('unreachable', 'error') OR (status = 'blocked' AND checks = '' AND excluded = '' AND nos = 0 AND confirmed = 0) THEN 'not reached'
    WHEN excluded <> '' THEN 'excluded' WHEN failed <> '' THEN 'failed must-have'
    WHEN confirmed = musts THEN 'pass' ELSE 'pass (some unknown)' END AS gate
  FROM flags f JOIN leads l USING (domain)),
decided0 AS (
  SELECT *, CASE WHEN gate = 'not reached' THEN 'Unknown: site not reached' WHEN gate IN ('excluded', 'failed must-have') THEN 'No'
    WHEN checks <> '' THEN 'Needs AI check' WHEN gate = 'pass' THEN 'Yes' WHEN prelaunch <> '' THEN 'Yes (pre-launch)'
    ELSE 'Yes (some must-haves unconfirmed)' END AS verdict
  FROM gated),
decided AS (
  SELECT domain, gate, verdict, CASE WHEN verdict LIKE 'Yes%' THEN 'YES' WHEN verdict = 'No' THEN 'NO' ELSE 'PENDING' END AS icp,
    confirmed, checks, excluded, failed, prelaunch
  FROM decided0)"""


for _p in config.PIPELINES:
    query(f"icp_decide_{_p}", f"{HEAD}, {decide_sql(_p)} SELECT * FROM decided")(lambda spark, sf_dir, p=_p: verdicts(spark, sf_dir, p))


@query("signals_long", f"{HEAD} SELECT domain, sid, value FROM signals")
def signals_long(spark, sf_dir):
    return L.signals(L.leads(spark, sf_dir))


@query("verdict_counts", f"{HEAD}, {decide_sql('services')} SELECT verdict, count(*) AS n FROM decided GROUP BY verdict")
def verdict_counts(spark, sf_dir):
    return verdicts(spark, sf_dir, "services").groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query(
    "signal_summary",
    f"""{HEAD} SELECT sid, count(*) FILTER (value = 'yes') AS n_yes, count(*) FILTER (value = 'check') AS n_check,
    count(*) FILTER (value = 'no') AS n_no, count(*) FILTER (value = 'unknown') AS n_unknown FROM signals GROUP BY sid""",
)
def signal_summary(spark, sf_dir):
    n = lambda v: F.count_if(F.col("value") == v).alias(f"n_{v}")
    return signals_long(spark, sf_dir).groupBy("sid").agg(*map(n, ("yes", "check", "no", "unknown")))


SEGMENT_SQL = """segments AS (
  SELECT domain, CASE WHEN n BETWEEN 1 AND 5 THEN 'SMB' WHEN n BETWEEN 6 AND 25 THEN 'MM' WHEN n >= 26 THEN 'ENT' ELSE 'SMB' END AS segment
  FROM (SELECT domain, TRY_CAST(replace(regexp_extract(employees, '[0-9][0-9,]*'), ',', '') AS BIGINT) AS n FROM leads))"""


@query("segment_banding", f"{HEAD}, {SEGMENT_SQL} SELECT * FROM segments")
def segment_banding(spark, sf_dir):
    return L.leads(spark, sf_dir).select("domain", scoring.segment(F.col("employees")).alias("segment"))


@query(
    "fact_reference",
    f"""{HEAD}, {SEGMENT_SQL}, yes_of AS (SELECT segment, sid, count(*) AS n_yes FROM signals JOIN segments USING (domain) WHERE value = 'yes' GROUP BY ALL)
    SELECT r.pipeline, r.sid, r.name, r.grp, w.segment, w.points, coalesce(y.n_yes, 0) AS n_yes FROM roles r LEFT JOIN weights w ON r.pipeline = w.pipeline AND r.sid = w.sid LEFT JOIN yes_of y ON y.sid = w.sid AND y.segment = w.segment""",
)
def fact_reference(spark, sf_dir):
    """Every fact with its group and points by segment, and how many leads of the segment have it."""
    found = signals_long(spark, sf_dir).where("value = 'yes'").join(segment_banding(spark, sf_dir), "domain").groupBy("segment", "sid").agg(F.count(F.lit(1)).alias("n_yes"))
    facts = L.roles(spark).drop("place").join(L.weights(spark).drop("place"), ["pipeline", "sid"], "left")
    return facts.join(found, ["sid", "segment"], "left").select("pipeline", "sid", "name", "grp", "segment", "points", F.coalesce("n_yes", F.lit(0)).alias("n_yes"))


def score_sql(pipeline: str) -> str:
    skips = "".join(
        f" AND NOT (s.sid IN ({', '.join(map(repr, skipped))}) AND s.domain IN (SELECT domain FROM signals WHERE sid = '{sid}' AND value = 'yes'))"
        for sid, skipped in config.SKIP[pipeline].items()
    )
    return f"""
parts AS (
  SELECT s.domain, w.points, w.place AS seq, r.name || ' ' || CASE WHEN w.points > 0 THEN '+' ELSE '' END || w.points AS text
  FROM signals s JOIN segments g USING (domain) JOIN weights w ON w.pipeline = '{pipeline}' AND w.sid = s.sid AND w.segment = g.segment AND w.points <> 0
  JOIN roles r ON r.pipeline = '{pipeline}' AND r.sid = s.sid
  WHERE s.value = 'yes'{skips}),
sums AS (SELECT domain, sum(points) AS total, string_agg(text, '; ' ORDER BY seq) AS parts FROM parts GROUP BY domain),
scored AS (
  SELECT g.domain, g.segment, CAST(coalesce(total, 0) AS BIGINT) AS score,
    CASE WHEN coalesce(total, 0) >= {config.STRONG_AT} THEN 'Strong fit' ELSE 'Weak fit' END AS tier, coalesce(parts, '') AS breakdown
  FROM segments g LEFT JOIN sums USING (domain))"""


def scores(spark, sf_dir, pipeline: str) -> DataFrame:
    if pipeline == "services":
        return core(spark, sf_dir, pipeline).select("domain", "segment", "score", "tier", "breakdown")
    found, signals = facts_of(spark, sf_dir, pipeline)
    segments = found.select("domain", scoring.segment(F.col("employees")).alias("segment"))
    return scoring.score(signals, segments, L.weights(spark), pipeline)


def ranges(spark, sf_dir, pipeline: str) -> DataFrame:
    if pipeline == "services":
        return core(spark, sf_dir, pipeline).select("domain", "score", "tier", "low", "high", "locked")
    _, signals = facts_of(spark, sf_dir, pipeline)
    return scoring.tier_range(signals, scores(spark, sf_dir, pipeline), L.weights(spark), pipeline)


def range_sql(pipeline: str) -> str:
    return f"""
moves AS (
  SELECT s.domain, sum(least(w.points, 0)) AS loss, sum(greatest(w.points, 0)) AS gain
  FROM signals s JOIN segments g USING (domain) JOIN weights w ON w.pipeline = '{pipeline}' AND w.sid = s.sid AND w.segment = g.segment
  WHERE s.value IN ('unknown', 'check') GROUP BY s.domain),
reach AS (
  SELECT c.domain, c.score, c.tier, CAST(c.score + coalesce(loss, 0) AS BIGINT) AS low, CAST(c.score + coalesce(gain, 0) AS BIGINT) AS high
  FROM scored c LEFT JOIN moves USING (domain))"""


for _p in config.PIPELINES:
    query(f"lead_score_{_p}", f"{HEAD}, {SEGMENT_SQL}, {score_sql(_p)} SELECT * FROM scored")(lambda spark, sf_dir, p=_p: scores(spark, sf_dir, p))
    query(
        f"tier_range_lock_{_p}",
        f"{HEAD}, {SEGMENT_SQL}, {score_sql(_p)}, {range_sql(_p)} SELECT *, (low >= {config.STRONG_AT}) = (high >= {config.STRONG_AT}) AS locked FROM reach",
    )(lambda spark, sf_dir, p=_p: ranges(spark, sf_dir, p))

PRIORITY_SQL = """CASE WHEN verdict IN ('Yes (pre-launch)', 'Needs a call: no website') THEN 'C' WHEN icp <> 'YES' THEN '' WHEN score >= 6 THEN 'A' WHEN score >= 3 THEN 'B' ELSE 'C' END"""
RANK_SQL = "CASE icp WHEN 'YES' THEN 0 WHEN 'PENDING' THEN 1 ELSE 2 END"


@query("outreach_priority", f"{HEAD}, {SEGMENT_SQL}, {score_sql('services')}, {decide_sql('services')} SELECT d.domain, d.verdict, s.score, {PRIORITY_SQL} AS priority FROM decided d JOIN scored s USING (domain)")
def outreach_priority(spark, sf_dir):
    return core(spark, sf_dir, "services").select("domain", "verdict", "score", scoring.priority(F.col("verdict"), F.col("icp"), F.col("score"), "services").alias("priority"))


@query(
    "lead_score_ranked",
    f"""{HEAD}, {SEGMENT_SQL}, {score_sql("services")}, {decide_sql("services")}
    SELECT l.row_no, d.domain, l.company, d.icp, d.verdict, s.segment, s.score, s.tier, s.breakdown, d.excluded, d.failed, {PRIORITY_SQL} AS priority,
      {RANK_SQL} AS verdict_rank, rank() OVER (PARTITION BY d.icp, l.region ORDER BY s.score DESC, l.row_no) AS place
    FROM decided d JOIN scored s USING (domain) JOIN leads l USING (domain)""",
)
def lead_score_ranked(spark, sf_dir):
    """The whole core in one plan: leads, facts, verdict, score, tier, priority and rank inside verdict and region."""
    joined = core(spark, sf_dir, "services")
    rank = F.when(F.col("icp") == "YES", 0).when(F.col("icp") == "PENDING", 1).otherwise(2)
    place = F.rank().over(Window.partitionBy("icp", "region").orderBy(F.col("score").desc(), "row_no"))
    return joined.select(
        "row_no", "domain", "company", "icp", "verdict", "segment", "score", "tier", "breakdown", "excluded", "failed",
        scoring.priority(F.col("verdict"), F.col("icp"), F.col("score"), "services").alias("priority"), rank.alias("verdict_rank"), place.alias("place"),
    )


# Later layers: what a directory and a provider say of the must-haves and exclusions.
OFFERS = {
    "M1": "CASE WHEN row_no % 5 = 0 THEN 'no' WHEN row_no % 5 < 3 THEN 'yes' END",
    "E4": "CASE WHEN row_no % 5 = 0 THEN 'yes' END",
    "M3": "CASE WHEN row_no % 3 = 0 THEN 'yes' END",
    "E1": "CASE WHEN row_no % 11 = 0 THEN 'yes' WHEN row_no % 11 = 1 THEN 'check' END",
    "F3": "CASE WHEN row_no % 2 = 0 THEN 'yes' ELSE 'no' END",
    "B1": "CASE WHEN row_no % 7 = 0 THEN 'yes' END",
}
MATCH = {1: "CASE WHEN row_no % 4 = 0 THEN 'strong' WHEN row_no % 4 = 1 THEN 'weak' ELSE 'medium' END", 2: "CASE WHEN row_no % 6 < 2 THEN 'strong' ELSE 'medium' END"}
PROVIDER = "CASE WHEN row_no % 9 = 0 THEN 'no' WHEN row_no % 9 < 4 THEN 'yes' END"


def candidates(leads: DataFrame) -> DataFrame:
    cells = [F.struct(F.lit(s).alias("sid"), F.lit(1).alias("layer"), F.expr(e).alias("value"), F.expr(MATCH[1]).alias("match")) for s, e in OFFERS.items()]
    cells += [F.struct(F.lit(s).alias("sid"), F.lit(2).alias("layer"), F.expr(PROVIDER).alias("value"), F.expr(MATCH[2]).alias("match")) for s in ("M1", "M3", "F3")]
    return leads.select("domain", F.explode(F.array(*cells)).alias("c")).select("domain", "c.*").where(F.col("value").isNotNull())


def _settle_sql(cur: str, new: str, match: str) -> str:
    strict = f"((grp = 'exclusion' AND {new} = 'yes') OR (grp = 'must' AND {new} = 'no'))"
    said = f"(CASE WHEN {new} IN ('yes', 'no') AND NOT ({match} = 'strong' OR ({match} = 'medium' AND NOT {strict})) THEN CASE WHEN grp = 'exclusion' AND {new} = 'yes' THEN 'check' END ELSE {new} END)"
    return f"""CASE WHEN {said} IS NULL THEN {cur} WHEN {cur} IN ('yes', 'no') AND {said} IN ('yes', 'no') AND {cur} <> {said} AND {match} = 'strong' THEN 'check'
      WHEN {cur} NOT IN ('check', 'unknown') THEN {cur} WHEN {cur} = 'check' AND {said} = 'check' THEN {cur} ELSE {said} END"""


_OFFERED = [(s, 1, e, MATCH[1]) for s, e in OFFERS.items()] + [(s, 2, PROVIDER, MATCH[2]) for s in ("M1", "M3", "F3")]
SETTLED_SQL = f"""offers AS MATERIALIZED (SELECT domain, unnest([{", ".join(f"{{'sid': '{s}', 'layer': {layer}, 'new': {e}, 'how': {how}}}" for s, layer, e, how in _OFFERED)}], recursive := true) FROM leads),
wide_offers AS MATERIALIZED (SELECT domain, sid, max(new) FILTER (layer = 1) AS new1, max(how) FILTER (layer = 1) AS how1, max(new) FILTER (layer = 2) AS new2, max(how) FILTER (layer = 2) AS how2 FROM offers GROUP BY domain, sid),
base AS MATERIALIZED (SELECT s.domain, s.sid, r.grp, s.value AS v0, new1, how1, new2, how2 FROM signals s JOIN roles r ON r.sid = s.sid AND r.pipeline = 'services' LEFT JOIN wide_offers o ON o.domain = s.domain AND o.sid = s.sid),
m1 AS MATERIALIZED (SELECT domain, v0 IN ('yes', 'no') AND v1 = 'check' AS open1, v1 IN ('yes', 'no') AND v2 = 'check' AS open2
  FROM (SELECT *, {_settle_sql("v1", "new2", "how2")} AS v2 FROM (SELECT *, {_settle_sql("v0", "new1", "how1")} AS v1 FROM base WHERE sid = 'M1'))),
one AS (SELECT b.*, {_settle_sql("b.u0", "b.new1", "b.how1")} AS v1 FROM (SELECT b.*, m.open2, CASE WHEN b.sid = 'E4' AND b.v0 = 'yes' AND coalesce(m.open1, FALSE) THEN 'check' ELSE b.v0 END AS u0 FROM base b LEFT JOIN m1 m USING (domain)) b),
two AS (SELECT *, CASE WHEN sid = 'E4' AND v1 = 'yes' AND coalesce(open2, FALSE) THEN 'check' ELSE v1 END AS u1 FROM one),
settled AS MATERIALIZED (SELECT domain, sid, {_settle_sql("u1", "new2", "how2")} AS value FROM two)"""


def settled(spark, sf_dir) -> DataFrame:
    found, signals = facts_of(spark, sf_dir, "services")
    return merging.settle_layers(signals.select("domain", "sid", "value", "grp"), candidates(found)).select("domain", "sid", "value")


query("merge_settle", f"{HEAD}, {SETTLED_SQL} SELECT domain, sid, value FROM settled")(settled)


# The same with what each answer rests on: the rules' guess at E5 by legal form, and a register that answers it.
_FIRST = {"value": "CASE WHEN sid = 'E5' AND row_no % 2 = 0 THEN 'no' ELSE value END", "evidence": "CASE WHEN sid = 'E5' AND row_no % 4 = 0 THEN 'for-profit legal entity: Inc' WHEN value = 'unknown' THEN '' ELSE 'page on ' || sid END"}
_E5 = "CASE WHEN row_no % 3 = 0 THEN 'yes' WHEN row_no % 3 = 1 THEN 'no' END"
_ALL = [*_OFFERED, ("E5", 1, _E5, MATCH[1])]
_METHOD = {1: "directory", 2: "provider"}
_LAYER = ("new", "how", "ev", "u", "nt", "m")


def _step_sql(k: int) -> str:
    """Columns of a fact after layer k, from those before it and the layer's offer."""
    new, how, ev, u, nt, m = (f"{c}{k}" for c in _LAYER)
    over = f"coalesce(sid = 'E5' AND {new} = 'yes' AND value = 'no' AND starts_with(evidence, '{merging.GUESSED}'), FALSE)"
    strict = f"((grp = 'exclusion' AND {new} = 'yes') OR (grp = 'must' AND {new} = 'no'))"
    possible = f"({new} IN ('yes', 'no') AND NOT ({how} = 'strong' OR ({how} = 'medium' AND NOT {strict})))"
    said, note = f"(CASE WHEN {possible} THEN 'check' ELSE {new} END)", f"(CASE WHEN {possible} THEN 'possible match only, to confirm: ' ELSE '' END || {nt})"
    against = f"(value IN ('yes', 'no') AND {said} IN ('yes', 'no') AND {said} <> value AND {how} = 'strong' AND NOT {over})"
    what = f"""CASE WHEN {new} IS NULL OR ({possible} AND NOT (grp = 'exclusion' AND {new} = 'yes')) THEN 'kept' WHEN {against} THEN 'both' WHEN value NOT IN ('check', 'unknown') AND NOT {over} THEN 'kept' WHEN value = 'check' AND {said} = 'check' THEN 'kept' ELSE 'new' END"""
    pick = lambda kept, both, fresh: f"CASE {what} WHEN 'kept' THEN {kept} WHEN 'both' THEN {both} ELSE {fresh} END"
    return f"""{pick("value", "'check'", said)} AS value, {pick("evidence", f"'website: ' || evidence || ' | ' || {m} || ': ' || {ev}", ev)} AS evidence, {pick("url", u, u)} AS url,
      {pick("note", f"'website said ' || value || ', ' || {m} || ' said ' || {new} || ' (' || {note} || ')'", f"{m} || ', ' || {how} || ' match: ' || {note}")} AS note, {pick("method", m, m)} AS method, {what} = 'both' AS opened"""


_OFFER_LIST = ", ".join(f"{{'sid': '{s}', 'layer': {layer}, 'new': {e}, 'how': {how}, 'ev': '{_METHOD[layer]} on {s}', 'u': 'https://{_METHOD[layer]}/' || row_no, 'nt': 'n' || (row_no % 3), 'm': '{_METHOD[layer]}'}}" for s, layer, e, how in _ALL)
_WIDE = ", ".join(f"max({c}) FILTER (layer = {k} AND new IS NOT NULL) AS {c}{k}" for k in (1, 2) for c in _LAYER)
_OPEN = lambda before, k, at: f"""SELECT b.* EXCLUDE (value, note, method), CASE WHEN b.sid = 'E4' AND b.value = 'yes' AND m.opened THEN 'check' ELSE b.value END AS value, CASE WHEN b.sid = 'E4' AND b.value = 'yes' AND m.opened THEN 'directory shows a US location: ' || m.ev{k} ELSE b.note END AS note,
  CASE WHEN b.sid = 'E4' AND b.value = 'yes' AND m.opened THEN 'directory' ELSE b.method END AS method FROM {before} b LEFT JOIN {at} m ON m.domain = b.domain AND m.sid = 'M1'"""  # noqa: E731
EVIDENCE_SQL = f"""offers AS MATERIALIZED (SELECT domain, unnest([{_OFFER_LIST}], recursive := true) FROM leads), wide_offers AS MATERIALIZED (SELECT domain, sid, {_WIDE} FROM offers GROUP BY domain, sid),
base AS MATERIALIZED (SELECT s.domain, s.sid, grp, {_FIRST["value"].replace("value", "s.value").replace("sid =", "s.sid =")} AS value, {_FIRST["evidence"].replace("value", "s.value").replace("sid", "s.sid")} AS evidence, '' AS url, '' AS note, 'code' AS method, o.* EXCLUDE (domain, sid)
  FROM signals s JOIN leads l USING (domain) JOIN roles r ON r.sid = s.sid AND r.pipeline = 'services' LEFT JOIN wide_offers o ON o.domain = s.domain AND o.sid = s.sid),
layer1 AS MATERIALIZED (SELECT * EXCLUDE (value, evidence, url, note, method), {_step_sql(1)} FROM base), begun AS MATERIALIZED ({_OPEN("base", 1, "layer1")}),
first AS MATERIALIZED (SELECT * EXCLUDE (value, evidence, url, note, method), {_step_sql(1)} FROM begun),
layer2 AS MATERIALIZED (SELECT * EXCLUDE (value, evidence, url, note, method, opened), {_step_sql(2)} FROM first), again AS MATERIALIZED ({_OPEN("first", 2, "layer2")}),
second AS (SELECT * EXCLUDE (value, evidence, url, note, method, opened), {_step_sql(2)} FROM again)"""


@query("merge_evidence", f"{HEAD}, {EVIDENCE_SQL} SELECT domain, sid, value, evidence, url, note, method FROM second")
def merge_evidence(spark, sf_dir):
    """Facts after a directory's and a provider's answers, with what each rests on."""
    found, signals = facts_of(spark, sf_dir, "services")
    rows = signals.select("domain", "sid", "value", "grp").join(found.select("domain", "row_no"), "domain")
    first = rows.select("domain", "sid", "grp", *[F.expr(e).alias(c) for c, e in _FIRST.items()], F.lit("").alias("url"), F.lit("").alias("note"), F.lit("code").alias("method"))
    cells = [
        F.struct(F.lit(s).alias("sid"), F.lit(layer).alias("layer"), F.expr(e).alias("value"), F.expr(how).alias("match"), F.lit(f"{_METHOD[layer]} on {s}").alias("evidence"), F.concat(F.lit(f"https://{_METHOD[layer]}/"), F.col("row_no").cast("string")).alias("url"), F.concat(F.lit("n"), (F.col("row_no") % 3).cast("string")).alias("note"), F.lit(_METHOD[layer]).alias("method"))
        for s, layer, e, how in _ALL
    ]
    offers = found.select("domain", F.explode(F.array(*cells)).alias("c")).select("domain", "c.*").where(F.col("value").isNotNull())
    return merging.settle_evidence(first, offers).drop("grp")


@query(
    "opposites",
    f"""{HEAD}, {config.sql_values(list(config.OPPOSITES.items()), "pairs", "sid, other")}
    SELECT s.domain, s.sid, CASE WHEN s.value IN ('unknown', 'check') AND o.value = 'yes' THEN 'no' ELSE s.value END AS value
    FROM signals s LEFT JOIN pairs p ON p.sid = s.sid LEFT JOIN signals o ON o.domain = s.domain AND o.sid = p.other""",
)
def opposites(spark, sf_dir):
    return merging.derive(signals_long(spark, sf_dir))


def gates_sql(pipeline: str, source: str = "signals") -> str:
    sids = [sid for _, sid, _ in config.facts()]
    is_no, closed = merging.no_rules(pipeline)
    steps = [f"wide AS (SELECT domain, {', '.join(f'''max(value) FILTER (sid = '{s}') AS v_{s}''' for s in sids)} FROM {source} GROUP BY domain)"]
    steps.append(f"g0 AS (SELECT * REPLACE ({', '.join(f'''CASE WHEN ({is_no}) AND v_{s} IN ('unknown', 'check') THEN 'na' ELSE v_{s} END AS v_{s}''' for s in closed)}) FROM wide)")
    last = "g0"
    for k, (sid, rule) in enumerate(merging.gate_rules(pipeline), 1):
        steps.append(f"g{k} AS (SELECT * REPLACE ({rule} AS v_{sid}) FROM {last})")
        last = f"g{k}"
    steps.append(f"gates AS (SELECT domain, unnest([{', '.join(f'''{s!r}''' for s in sids)}]) AS sid, unnest([{', '.join(f'v_{s}' for s in sids)}]) AS value FROM {last})")
    return ", ".join(steps)


for _p in config.PIPELINES:
    query(f"gate_unrolled_{_p}", f"{HEAD}, {gates_sql(_p)} SELECT domain, sid, value FROM gates")(lambda spark, sf_dir, p=_p: merging.unpivoted(merging.close_wide(L.wide(L.leads(spark, sf_dir)), p)))


@query("redecide_after_merge", f"{HEAD}, {SETTLED_SQL}, {gates_sql('services', 'settled')}, {decide_sql('services', 'gates')} SELECT domain, gate, verdict, icp, confirmed, checks, excluded, failed FROM decided")
def redecide_after_merge(spark, sf_dir):
    """Settled layers, closed facts, then the verdict once more: one pivot, all else in its row."""
    closed = merging.close_wide(merging.pivoted(settled(spark, sf_dir)), "services")
    status = L.leads(spark, sf_dir).select("domain", "status")
    return scoring.decide_wide(closed.join(status, "domain"), "services").select(*VERDICT[:-1])


@query(
    "final_wide",
    f"""{HEAD}, {SEGMENT_SQL}, {score_sql("services")}, {decide_sql("services")},
    cells AS (SELECT domain, {", ".join(f"max(CASE WHEN value = 'unknown' THEN '' ELSE value END) FILTER (sid = '{s}') AS {s.lower()}" for _, s, _ in config.facts())} FROM signals GROUP BY domain)
    SELECT l.row_no, l.company, l.employees, d.icp, d.verdict, s.score, s.tier, c.* FROM leads l JOIN decided d USING (domain) JOIN scored s USING (domain) JOIN cells c USING (domain)""",
)
def final_wide(spark, sf_dir):
    """Original columns, verdict, score and a column for each fact, from a fixed list; unknown is an empty cell."""
    sids = [sid for _, sid, _ in config.facts()]
    cells = [F.when(F.col(f"v_{s}") == "unknown", "").otherwise(F.col(f"v_{s}")).alias(s.lower()) for s in sids]
    return core(spark, sf_dir, "services").select("row_no", "company", "employees", "icp", "verdict", "score", "tier", "domain", *cells)


@query(
    "top_positive_parts",
    f"""{HEAD}, {SEGMENT_SQL}, {score_sql("services")}, numbered AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY points DESC, seq) AS n FROM parts WHERE points > 0)
    SELECT domain, string_agg(text, '; ' ORDER BY n) AS reasons FROM numbered WHERE n <= 5 GROUP BY domain""",
)
def top_positive_parts(spark, sf_dir):
    found, signals = facts_of(spark, sf_dir, "services")
    segments = found.select("domain", scoring.segment(F.col("employees")).alias("segment"))
    own = F.broadcast(L.weights(spark).where("pipeline = 'services' AND points > 0").select("sid", "segment", "points", F.col("place").alias("at")))
    parts = signals.where("value = 'yes'").select("domain", "sid", "name").join(segments, "domain").join(own, ["sid", "segment"])
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("points")).alias("down"), "at", F.concat("name", F.lit(" +"), F.col("points").cast("string")).alias("text"))))
    return parts.groupBy("domain").agg(F.array_join(F.transform(F.slice(ordered, 1, 5), lambda x: x["text"]), "; ").alias("reasons"))


@query(
    "open_questions_by_worth",
    f"""{HEAD}, {SEGMENT_SQL}, worth AS (
      SELECT s.domain, s.sid, CASE WHEN r.grp = 'must' THEN 4 WHEN r.grp = 'weak' THEN 2 WHEN r.grp = 'exclusion' THEN 4 ELSE coalesce(w.points, 0) END AS worth, r.place
      FROM signals s JOIN roles r ON r.sid = s.sid AND r.pipeline = 'services' JOIN segments g USING (domain)
      LEFT JOIN weights w ON w.pipeline = 'services' AND w.sid = s.sid AND w.segment = g.segment AND w.points > 0
      WHERE s.value IN ('unknown', 'check') AND r.grp <> 'info')
    SELECT domain, sid, worth, n FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY worth DESC, place) AS n FROM worth WHERE worth > 0) WHERE n <= 3""",
)
def open_questions_by_worth(spark, sf_dir):
    """The three open facts of each lead that an answer is worth most for, found in its row."""
    wide = L.wide(L.leads(spark, sf_dir)).withColumn("segment", scoring.segment(F.col("employees")))
    return scoring.worth_wide(wide, "services", 3)


@query(
    "work_order",
    f"""{HEAD}, {SEGMENT_SQL}, {score_sql("services")}, {decide_sql("services")}, waiting AS (SELECT domain, count(*) AS open_facts FROM signals WHERE value IN ('unknown', 'check') GROUP BY domain)
    SELECT d.domain, {RANK_SQL} AS verdict_rank, s.score, w.open_facts FROM decided d JOIN scored s USING (domain) JOIN waiting w USING (domain) WHERE d.icp <> 'NO'""",
)
def work_order(spark, sf_dir):
    """Leads that are still in the running and have open facts, best first."""
    waiting = signals_long(spark, sf_dir).where(F.col("value").isin("unknown", "check")).groupBy("domain").agg(F.count(F.lit(1)).alias("open_facts"))
    joined = verdicts(spark, sf_dir, "services").where("icp <> 'NO'").join(scores(spark, sf_dir, "services"), "domain").join(waiting, "domain")
    rank = F.when(F.col("icp") == "YES", 0).when(F.col("icp") == "PENDING", 1).otherwise(2)
    return joined.select("domain", rank.alias("verdict_rank"), "score", "open_facts").orderBy("verdict_rank", F.col("score").desc(), "domain")


@query(
    "compare_pipelines",
    f"""{HEAD}, a AS (WITH {decide_sql("product").strip().removeprefix(",")} SELECT domain, verdict FROM decided), b AS (WITH {decide_sql("services")} SELECT domain, verdict FROM decided)
    SELECT a.domain, a.verdict AS product, b.verdict AS services FROM a JOIN b USING (domain) WHERE a.verdict <> b.verdict""",
)
def compare_pipelines(spark, sf_dir):
    """The same facts, two role tables: where the verdicts differ."""
    a = verdicts(spark, sf_dir, "product").select("domain", F.col("verdict").alias("product"))
    b = verdicts(spark, sf_dir, "services").select("domain", F.col("verdict").alias("services"))
    return a.join(b, "domain").where("product <> services")


@query(
    "exclusion_reason",
    f"""{HEAD} SELECT s.domain, string_agg(r.name || ': ' || l.region || ', ' || l.mktsegment, '; ' ORDER BY r.place) AS reason
    FROM signals s JOIN roles r ON r.sid = s.sid AND r.pipeline = 'product' AND r.grp = 'exclusion' JOIN leads l USING (domain) WHERE s.value = 'yes' GROUP BY s.domain""",
)
def exclusion_reason(spark, sf_dir):
    found, signals = facts_of(spark, sf_dir, "product")
    out = signals.where("grp = 'exclusion' AND value = 'yes'").join(found.select("domain", "region", "mktsegment"), "domain")
    text = F.concat("name", F.lit(": "), "region", F.lit(", "), "mktsegment")
    return out.groupBy("domain").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", text.alias("text")))), lambda x: x["text"]), "; ").alias("reason"))
