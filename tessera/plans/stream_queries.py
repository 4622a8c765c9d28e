"""The event windows in batch form, so that SQL can check them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.registry import query
from tessera.plans.text_queries import read
from tessera.streaming import events as E


@query("events_tumbling", "SELECT time_bucket(INTERVAL '1 hour', ts) AS begins, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark, sf_dir):
    return E.tumbling(read(spark, sf_dir, "events"))


@query(
    "events_sliding",
    """WITH w AS (SELECT unnest([time_bucket(INTERVAL '2 hours', ts), time_bucket(INTERVAL '2 hours', ts) - INTERVAL '2 hours', time_bucket(INTERVAL '2 hours', ts) - INTERVAL '4 hours']) AS begins FROM events)
    SELECT begins, count(*) AS n FROM w GROUP BY begins""",
)
def events_sliding(spark, sf_dir):
    return E.sliding(read(spark, sf_dir, "events"))


@query(
    "events_session",
    """WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT user_id, ts, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
    SELECT user_id, min(ts) AS begins, count(*) AS n FROM s GROUP BY user_id, session""",
)
def events_session(spark, sf_dir):
    return E.sessions(read(spark, sf_dir, "events"))


_STEP = " ".join(f"WHEN f.state = '{s}' AND e.event_type = '{k}' THEN '{v}'" for s, moves in E.MOVES.items() for k, v in moves.items())


@query(
    "review_states",
    f"""WITH RECURSIVE e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    f AS (SELECT DISTINCT user_id, 0::BIGINT AS n, 'idle' AS state FROM e
      UNION ALL SELECT f.user_id, e.n, CASE {_STEP} ELSE f.state END FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
    SELECT user_id, max_by(state, n) AS state, max(n) AS events FROM f GROUP BY user_id""",
)
def review_states(spark, sf_dir):
    return E.review_states_batch(read(spark, sf_dir, "events"))


@query("props_json", "SELECT event_type, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS k_sum FROM events GROUP BY event_type")
def props_json(spark, sf_dir):
    """A JSON column read by path."""
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("k_sum"))


@query("daily_top_kind", "SELECT begins, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY begins ORDER BY n DESC, event_type) AS r FROM (SELECT time_bucket(INTERVAL '1 day', ts) AS begins, event_type, count(*) AS n FROM events GROUP BY 1, 2)) WHERE r = 1")
def daily_top_kind(spark, sf_dir):
    days = E.tumbling(read(spark, sf_dir, "events"), "1 day").drop("total")
    return days.groupBy("begins").agg(F.max_by(F.struct("event_type", "n"), F.struct("n", F.transform(F.split("event_type", ""), lambda c: -F.ascii(c)))).alias("b")).select("begins", "b.*")
