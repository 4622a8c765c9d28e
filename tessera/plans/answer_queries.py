"""Queries over questions and answers: what is asked next, what waits, what an answer counts for, what to offer.

Events are answers here: their number picks the fact, the answer and its quote from short lists, the same in the SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import config
from tessera.config import sql_values
from tessera.operators import answers as A
from tessera.operators import structured as J
from tessera.plans import leads as L
from tessera.plans.decision_queries import HEAD, decide_sql, facts_of, verdicts
from tessera.plans.registry import query
from tessera.plans.site_queries import _chosen, _has, _in, chosen, late_money_sql

AS_OF = "2026-11-28"
SIDS = ("M1", "E1", "F2", "B1", "B2", "B6", "B7", "B12", "B13", "F9", "E4", "W4", "M3", "F12")
GIVEN = ("yes", "no", "unknown", "yes", "", "no", "yes")
CONFIDENCE = ("high", "medium", "low", "high", "medium")
ENTITY = ("domain", "name_and_location", "name_only")
QUOTES = (
    "Zed closed its $38M seed extension on 6/9/2026", "", "Acme raised a seed round on June 3, 2026", "founded 12 Nov. 2026 in Ohio", "launched new pricing in Oct 2026", "joined the batch of 2025-12-30", "Jane joins as board member, Sept 2026",
    "trusted by 40,000 companies such as Ramp", "a Series D round, then an IPO", "a tender offer for staff", "converted to a corporation on 2025-02-30", "raised $150 million in May 2019", "we pay with Brex", "We raised $150M in one go on 2026-10-01", "a $150 million market awaits", "Orbit reaches a valuation of $3 billion", "Orbit customers raised $400 million",
)
DATES = ("", "", "2026-09-30", "", "May 2019")
COMPANIES = ("Zed Tools", "", "Orbit")
REASONS = ("the page says so", "it does not mention the topic", "there is no sign of it", "", "reported 2026-10-02")


def given(spark, sf_dir) -> DataFrame:
    n = F.col("event_id")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    roles = spark.createDataFrame([(s, g) for p, s, g, _, _ in config.roles() if p == "services"], "sid string, grp string")
    rows = rows.select(
        "event_id", F.concat(F.lit("c"), (n % 97).cast("string")).alias("domain"), chosen(SIDS, n).alias("sid"), chosen(("unknown", "check", "unknown", "yes"), n * 3 + F.floor(n / 7)).alias("value"), (n % 2 + 1).cast("int").alias("step"), chosen(GIVEN, n + F.floor(n / 14)).alias("answer"),
        chosen(CONFIDENCE, n * 3 + F.floor(n / 5)).alias("confidence"), chosen(ENTITY, n + F.floor(n / 3)).alias("entity_match"), chosen(QUOTES, n * 5 + F.floor(n / 13)).alias("quote"), F.lit("").alias("announced"), chosen(DATES, n + F.floor(n / 19)).alias("date"), chosen(COMPANIES, n * 3 + F.floor(n / 17)).alias("company"), chosen(REASONS, n * 2 + F.floor(n / 11)).alias("reason"),
    )
    return rows.join(F.broadcast(roles), "sid")  # 69 roles


GIVEN_SQL = f"""{L.ROLES_SQL}, given AS (SELECT e.*, r.grp FROM (SELECT event_id, 'c' || (event_id % 97) AS domain, {_chosen(SIDS, "event_id")} AS sid, {_chosen(("unknown", "check", "unknown", "yes"), "event_id * 3 + event_id // 7")} AS value, CAST(event_id % 2 + 1 AS INT) AS step,
  {_chosen(GIVEN, "event_id + event_id // 14")} AS answer, {_chosen(CONFIDENCE, "event_id * 3 + event_id // 5")} AS confidence, {_chosen(ENTITY, "event_id + event_id // 3")} AS entity_match, {_chosen(QUOTES, "event_id * 5 + event_id // 13")} AS quote, '' AS announced, {_chosen(DATES, "event_id + event_id // 19")} AS date, {_chosen(COMPANIES, "event_id * 3 + event_id // 17")} AS company,
  {_chosen(REASONS, "event_id * 2 + event_id // 11")} AS reason FROM events) e JOIN roles r ON r.sid = e.sid AND r.pipeline = 'services')"""


def _dates_sql(text: str) -> str:
    parts = []
    for pattern, year, month, day in A.date_formats():
        years, names = (f"regexp_extract_all({text}, '{pattern}', {k})" for k in (year, month))
        days = f"regexp_extract_all({text}, '{pattern}', {day})" if day else f"list_transform({years}, lambda x: '15')"
        m = "CASE WHEN regexp_matches(z[2], '^[0-9]') THEN z[2] ELSE CAST((instr('janfebmaraprmayjunjulaugsepoctnovdec', substr(lower(z[2]), 1, 3)) + 2) // 3 AS VARCHAR) END"
        parts.append(f"list_filter(list_transform(list_zip({years}, {names}, {days}), lambda z: TRY_CAST(z[1] || '-' || lpad({m}, 2, '0') || '-' || lpad(z[3], 2, '0') AS DATE)), lambda d: d IS NOT NULL)")
    return f"list_concat({', '.join(parts)})"


@query("dates_in_quotes", f"WITH {GIVEN_SQL}, d AS (SELECT event_id, {_dates_sql('quote')} AS dates FROM given) SELECT event_id, len(dates) AS n_dates, list_max(dates) AS latest FROM d")
def dates_in_quotes(spark, sf_dir):
    found = A.dates_in(F.col("quote"))
    return given(spark, sf_dir).select("event_id", F.size(found).cast("long").alias("n_dates"), F.array_max(found).alias("latest"))


_DAYS = "CASE sid " + " ".join(f"WHEN '{s}' THEN {n}" for s, (n, _) in A.RECENT.items()) + " END"
_EVENT = " OR ".join(f"(sid = '{s}' AND {_has('quote', w)})" for s, (_, w) in A.RECENT.items())
APPLIED_SQL = f"""flagged AS (SELECT *, {_in("sid", A.RECENT)} AS is_recent, len(list_filter({_dates_sql("concat_ws(' ', quote, announced, date, reason)")}, lambda d: date_diff('day', d, DATE '{AS_OF}') BETWEEN 0 AND {_DAYS})) > 0 AS inside, {_EVENT} AS event,
  {_has("reason", A.NOT_MENTIONED)} AS not_mentioned, trim(quote) <> '' AS has_quote, CASE WHEN {_has("quote", A.SECONDARY)} AND NOT {_has("quote", A.LATE_PROOF)} THEN FALSE ELSE {_has("quote", A.LATE_PROOF)} OR {late_money_sql("quote", "company")} END AS late_proof,
  {_in("sid", A.TOOL_FACTS)} AS is_tool, {_has("quote", A.CUSTOMERS)} AS customers, CASE WHEN step = 2 THEN entity_match ELSE 'domain' END AS entity FROM given),
dated AS (SELECT *, {A.DATED} AS dated FROM flagged), counted AS (SELECT *, {A.COUNTED} AS after FROM dated), outcomes AS (SELECT *, {A.OUTCOME} AS outcome FROM counted)"""


@query("answers_applied", f"WITH {GIVEN_SQL}, {APPLIED_SQL} SELECT event_id, domain, sid, dated, after, outcome FROM outcomes")
def answers_applied(spark, sf_dir):
    return A.applied(given(spark, sf_dir), AS_OF).select("event_id", "domain", "sid", "dated", "after", "outcome")


@query("answer_outcomes", f"WITH {GIVEN_SQL}, {APPLIED_SQL} SELECT sid, outcome, count(*) AS n, count(DISTINCT domain) AS companies FROM outcomes GROUP BY sid, outcome")
def answer_outcomes(spark, sf_dir):
    found = A.applied(given(spark, sf_dir), AS_OF)
    return found.groupBy("sid", "outcome").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("domain").alias("companies"))


# Questions over the leads' facts: which have been asked already, and what is replied, is taken from numbers.
_STEP1, _STEP2 = "(row_no + place) % 3 = 0", "(row_no + place) % 7 = 0"
_ANSWER = f"""CASE WHEN {_STEP1} THEN CASE row_no % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'yes' WHEN 2 THEN 'no' ELSE '' END END"""
_KNOWN = {"must_or_stop": "grp IN ('must', 'exclusion')", "has_page": "row_no % 2 = 0", "step1": _STEP1, "step2": _STEP2, "answer": _ANSWER, "confidence": "CASE WHEN row_no % 5 = 0 THEN 'low' ELSE 'high' END"}
_REPLY = "CASE (row_no * 5 + place * 3) % 7 WHEN 0 THEN 'unknown' WHEN 1 THEN 'no' WHEN 4 THEN 'no' ELSE 'yes' END"
PLAN_SQL = f"""{sql_values(A.settings(), "settings", "sid, pages_run, needs_page, web_run")},
rows AS MATERIALIZED (SELECT s.domain, s.sid, s.value, l.status, row_no, place, {", ".join(f"{rule} AS {name}" for name, rule in _KNOWN.items())}, pages_run, needs_page, web_run
  FROM signals s JOIN leads l USING (domain) JOIN roles r ON r.sid = s.sid AND r.pipeline = 'services' JOIN settings t ON t.sid = s.sid),
asked AS (SELECT *, {A.ASKED} AS asked, {A.WEB_AFTER} AS web_after FROM rows), planned AS MATERIALIZED (SELECT *, {A.NEXT} AS next FROM asked)"""


def planned(spark, sf_dir) -> DataFrame:
    """A row a lead, with the plan of its questions."""
    own = lambda rule: A.of_element(rule, "x", ("place", "grp"))
    return A.planned(L.wide(L.leads(spark, sf_dir)), "services", {name: own(rule) for name, rule in _KNOWN.items()})


@query("question_plan", f"{HEAD}, {PLAN_SQL} SELECT domain, sid, asked, web_after, next FROM planned")
def question_plan(spark, sf_dir):
    return A.questions(planned(spark, sf_dir)).select("domain", "sid", "asked", "web_after", "next")


@query("questions_open", f"{HEAD}, {PLAN_SQL} SELECT next, sid, count(*) AS companies FROM planned WHERE next IS NOT NULL GROUP BY next, sid")
def questions_open(spark, sf_dir):
    return A.questions(planned(spark, sf_dir)).where("next IS NOT NULL").groupBy("next", "sid").agg(F.count(F.lit(1)).alias("companies"))


GATE_STATES_SQL = f"""{sql_values(A.conditions("services"), "conditions", "child, place, parent, allowed, is_opposite")},
states AS MATERIALIZED (SELECT domain, child, c.place, {A.CONDITION} AS state FROM (SELECT domain, sid, value, next IS NOT NULL AS waiting FROM planned) p JOIN conditions c ON c.parent = p.sid),
firsts AS MATERIALIZED (SELECT domain, child AS sid, min_by(state, place) AS state FROM states WHERE state <> 'run' GROUP BY domain, child),
gate_of AS (SELECT p.domain, p.sid, p.next, coalesce(f.state, 'run') AS gate FROM planned p LEFT JOIN firsts f ON f.domain = p.domain AND f.sid = p.sid)"""


@query("gate_states", f"{HEAD}, {PLAN_SQL}, {GATE_STATES_SQL} SELECT domain, sid, gate FROM gate_of")
def gate_states(spark, sf_dir):
    return A.gate_states(planned(spark, sf_dir), "services").select("domain", "sid", "gate")


@query("questions_runnable", f"{HEAD}, {PLAN_SQL}, {GATE_STATES_SQL} SELECT domain, sid, next FROM gate_of WHERE next IS NOT NULL AND gate = 'run'")
def questions_runnable(spark, sf_dir):
    return A.gate_states(planned(spark, sf_dir), "services").where("next IS NOT NULL AND gate = 'run'").select("domain", "sid", "next")


WAVES_SQL = f"""{sql_values(A.conditions("services"), "conditions", "child, place, parent, allowed, is_opposite")},
st AS (SELECT domain, sid, value, next IS NOT NULL AS waiting, {_REPLY} AS reply, 0 AS wave, 0 AS n, FALSE AS last FROM planned
  UNION ALL (WITH held AS (SELECT DISTINCT domain, child FROM (SELECT domain, child, {A.CONDITION} AS state FROM st JOIN conditions ON parent = sid) WHERE state <> 'run'),
    r AS (SELECT s.*, s.waiting AND h.child IS NULL AS ready FROM st s LEFT JOIN held h ON h.domain = s.domain AND h.child = s.sid WHERE NOT s.last),
    e AS (SELECT *, bool_or(ready) OVER (PARTITION BY domain) AS any_left FROM r)
    SELECT domain, sid, CASE WHEN ready THEN reply ELSE value END, waiting AND NOT ready, reply, CASE WHEN ready THEN n + 1 ELSE wave END, n + 1, NOT any_left FROM e)),
wave_of AS MATERIALIZED (SELECT domain, sid, wave, value FROM st WHERE last)"""


_REPLY_OF = A.of_element(_REPLY, "x", ("place",))


@query("question_waves", f"{HEAD.replace('WITH', 'WITH RECURSIVE', 1)}, {PLAN_SQL}, {WAVES_SQL} SELECT domain, sid, wave, value FROM wave_of")
def question_waves(spark, sf_dir):
    """The wave in which each lead's questions are asked, parents first, and what each fact ends on."""
    return A.waves(planned(spark, sf_dir), "services", _REPLY_OF)


@query(
    "wave_pages",
    f"""{HEAD.replace("WITH", "WITH RECURSIVE", 1)}, {PLAN_SQL}, {WAVES_SQL}, {sql_values([(sid, k, page) for sid, pages in config.PAGES_READ.items() for k, page in enumerate(pages)], "reads", "sid, k, page")},
    places AS (SELECT sid, min(place) AS place FROM roles WHERE pipeline = 'services' GROUP BY sid), firsts AS (SELECT domain, wave, page, min((place, k)) AS seen_at FROM wave_of JOIN reads USING (sid) JOIN places USING (sid) WHERE wave > 0 GROUP BY ALL)
    SELECT domain, wave, n_questions, coalesce(pages, '') AS pages FROM (SELECT domain, wave, count(*) AS n_questions FROM wave_of WHERE wave > 0 GROUP BY ALL) LEFT JOIN (SELECT domain, wave, string_agg(page, ', ' ORDER BY seen_at) AS pages FROM firsts GROUP BY ALL) USING (domain, wave)""",
)
def wave_pages(spark, sf_dir):
    """The pages that each wave of a lead's questions reads."""
    return A.pages_of_waves(planned(spark, sf_dir), "services", _REPLY_OF)


_YES = ", ".join(f"bool_or(sid = '{s}' AND value = 'yes') AS y_{s.lower()}" for s in A.ROUTE_FACTS)


@query(
    "outreach_routes",
    f"""{HEAD}, {decide_sql("services")}, flags_of AS (SELECT domain, {_YES} FROM signals GROUP BY domain)
    SELECT domain, {", ".join(f"{rule} AS {name}" for name, rule in A.ROUTES.items())} FROM decided JOIN flags_of USING (domain)""",
)
def outreach_routes(spark, sf_dir):
    _, signals = facts_of(spark, sf_dir, "services")
    return A.routes(signals, verdicts(spark, sf_dir, "services"))


_METHOD, _NOTE = "CASE event_id % 6 WHEN 0 THEN 'code' WHEN 1 THEN 'directory' WHEN 2 THEN 'provider' WHEN 3 THEN 'skipped' ELSE 'ai' END", "CASE WHEN event_id % 4 = 0 THEN 'AI, web search' ELSE 'AI, company website' END"


@query(
    "decided_by_layer",
    f"""WITH {GIVEN_SQL}, {APPLIED_SQL}, m AS (SELECT after AS value, {_METHOD} AS method, {_NOTE} AS note FROM outcomes)
    SELECT coalesce({A.DECIDED_BY}, 'open') AS layer, value, count(*) AS n FROM m GROUP BY ALL""",
)
def decided_by_layer(spark, sf_dir):
    rows = A.applied(given(spark, sf_dir), AS_OF).select(F.col("after").alias("value"), F.expr(_METHOD).alias("method"), F.expr(_NOTE).alias("note"))
    return rows.select(F.coalesce(F.expr(A.DECIDED_BY), F.lit("open")).alias("layer"), "value").groupBy("layer", "value").agg(F.count(F.lit(1)).alias("n"))


#: Ways in which a model writes its answer; @ is the quote as a JSON text.
SHAPES = (
    '```json\n{"answer": "yes", "confidence": 0.9, "quote": @, "parts": [{"n": 1}]}\n```', 'Sure: {"answer": "no", "confidence": 1, "quote": @, "parts": []} Anything else?', '{"answer": "maybe", "confidence": 1, "quote": @, "parts": []}',
    '{"answer": "yes", "quote": @}', '{"answer": "yes", "confidence": "high", "quote": @, "parts": []}', '{"answer": "yes", "confidence": 1, "quote": @, "parts": []} or {"answer": "no"}', 'I found @', '{"answer": "no", "confidence": 0.5, "quote": @, "parts": [], "more": 1}',
    '{"answer": "no", "confidence": 0.5, "quote": @, "parts": [{"n": "x"}]}',
)
SCHEMA = {"properties": {"answer": {"enum": ["yes", "no", "unknown"]}, "confidence": {"type": "number"}, "quote": {"type": "string"}, "parts": {"type": "array", "items": {"properties": {"n": {"type": "integer"}}}}}}
_SAID = "conv_id * 5 + turn"


@query(
    "answers_read",
    f"""WITH said AS (SELECT conv_id, turn, replace({_chosen(SHAPES, _SAID)}, '@', CAST(to_json(text) AS VARCHAR)) AS t FROM conversations WHERE role = 'assistant'),
    bare AS (SELECT conv_id, turn, regexp_replace(regexp_replace(trim(t), '^```(?:json)?\\s*', ''), '\\s*```$', '') AS b FROM said),
    cut AS (SELECT conv_id, turn, CASE WHEN regexp_matches(b, '(?s)\\{{.*\\}}') THEN regexp_extract(b, '(?s)\\{{.*\\}}') ELSE b END AS c FROM bare), v AS (SELECT conv_id, turn, TRY_CAST(c AS JSON) AS j FROM cut WHERE json_valid(c))
    SELECT conv_id, turn, j->>'$.answer' AS answer, length(j->>'$.quote') AS quote_chars, coalesce(list_sort(json_keys(j)) = ['answer', 'confidence', 'parts', 'quote'] AND (j->>'$.answer') IN ('yes', 'no', 'unknown') AND json_type(j, '$.confidence') IN ('UBIGINT', 'DOUBLE')
      AND len(list_filter(json_extract(j, '$.parts[*]'), lambda x: json_type(x, '$.n') <> 'UBIGINT')) = 0, FALSE) AS is_strict FROM v""",
)
def answers_read(spark, sf_dir):
    """Answers written into conversations, read out of fences and prose, and whether each is as its schema says."""
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'assistant'")
    quote = F.expr("substring(to_json(named_struct('t', text)), 6, char_length(to_json(named_struct('t', text))) - 6)")
    read = said.select("conv_id", "turn", J.fenced_json(F.replace(chosen(SHAPES, F.expr(_SAID)), F.lit("@"), quote)).alias("v")).where("v is not null")
    return read.select("conv_id", "turn", F.expr("try_variant_get(v, '$.answer', 'string')").alias("answer"), F.char_length(F.expr("try_variant_get(v, '$.quote', 'string')")).cast("long").alias("quote_chars"), J.conforms("v", SCHEMA).alias("is_strict"))
