"""Leads and their facts taken from the order tables, so that the scoring operators run on any data of that shape.

A customer is a lead; its place, orders and market segment answer facts by portable CASE rules, which the SQL shares.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import config

#: The day on which everything is judged.
AS_OF = "2001-08-01"

STATUS = "CASE WHEN n_orders = 0 AND acctbal < 0 THEN 'unreachable' WHEN acctbal < -900 THEN 'blocked' ELSE 'live' END"
EMPLOYEES = "CASE WHEN n_orders = 0 THEN '' WHEN n_orders % 3 = 0 THEN concat(cast(n_orders AS varchar(20)), '-', cast(n_orders + 9 AS varchar(20))) ELSE cast(n_orders AS varchar(20)) END"

#: The first layer's answer to each fact; all others are unknown.
RULES = {
    "M1": "CASE WHEN region = 'AMERICA' THEN 'yes' WHEN region = 'EUROPE' THEN 'no' WHEN region = 'ASIA' THEN 'unknown' ELSE 'check' END",
    "M2": "CASE WHEN n_orders > 0 THEN 'yes' WHEN acctbal < 500 THEN 'no' ELSE 'unknown' END",
    "M3": "CASE WHEN n_urgent >= 2 THEN 'yes' WHEN n_urgent = 1 THEN 'check' ELSE 'unknown' END",
    "M4": "CASE WHEN n_done > 0 THEN 'yes' WHEN n_orders > 0 THEN 'no' ELSE 'unknown' END",
    "E1": "CASE WHEN max_order > 450000 THEN 'yes' WHEN max_order > 400000 THEN 'check' ELSE 'unknown' END",
    "E2": "CASE WHEN n_orders = 0 AND acctbal < 0 THEN 'check' WHEN n_orders > 0 THEN 'no' ELSE 'unknown' END",
    "E3": "CASE WHEN acctbal < -950 THEN 'check' ELSE 'unknown' END",
    "E4": "CASE WHEN region = 'EUROPE' THEN 'yes' WHEN region = 'AMERICA' THEN 'no' ELSE 'unknown' END",
    "E5": "CASE WHEN mktsegment = 'HOUSEHOLD' AND acctbal > 9000 THEN 'check' ELSE 'unknown' END",
    "E6": "CASE WHEN mktsegment = 'FURNITURE' AND n_orders > 15 THEN 'yes' ELSE 'unknown' END",
    "F1": "CASE WHEN mktsegment = 'BUILDING' THEN 'yes' WHEN mktsegment = 'MACHINERY' THEN 'no' ELSE 'unknown' END",
    "F2": "CASE WHEN n_orders >= 12 THEN 'yes' ELSE 'unknown' END",
    "F3": "CASE WHEN acctbal > 5000 THEN 'yes' WHEN acctbal > 4500 THEN 'check' ELSE 'unknown' END",
    "F4": "CASE WHEN n_urgent >= 3 THEN 'yes' ELSE 'unknown' END",
    "F5": "CASE WHEN mktsegment = 'AUTOMOBILE' THEN 'yes' ELSE 'unknown' END",
    "F6": "CASE WHEN mktsegment IN ('BUILDING', 'MACHINERY') THEN 'yes' ELSE 'unknown' END",
    "F7": "CASE WHEN n_orders BETWEEN 1 AND 6 THEN 'yes' ELSE 'unknown' END",
    "F8": "CASE WHEN max_order > 200000 THEN 'yes' ELSE 'unknown' END",
    "F9": "CASE WHEN n_done >= 5 THEN 'yes' ELSE 'unknown' END",
    "F13": "CASE WHEN acctbal < 2000 THEN 'yes' ELSE 'unknown' END",
    "F14": "CASE WHEN acctbal >= 8000 THEN 'yes' ELSE 'unknown' END",
    "B1": "CASE WHEN recent_orders >= 1 THEN 'yes' ELSE 'unknown' END",
    "B3": "CASE WHEN recent_orders >= 3 THEN 'yes' ELSE 'no' END",
    "B10": "CASE WHEN n_orders % 4 = 1 THEN 'yes' ELSE 'unknown' END",
    "S3": "CASE WHEN n_orders % 5 = 2 THEN 'yes' ELSE 'unknown' END",
    "S12": "CASE WHEN n_done >= 8 THEN 'yes' ELSE 'unknown' END",
    "W1": "CASE WHEN n_orders BETWEEN 1 AND 3 THEN 'check' ELSE 'unknown' END",
    "W5": "CASE WHEN n_orders > 0 AND n_done = 0 THEN 'yes' ELSE 'unknown' END",
    "W8": "CASE WHEN n_orders > 20 THEN 'yes' ELSE 'unknown' END",
    "W9": "CASE WHEN mktsegment = 'FURNITURE' THEN 'check' ELSE 'unknown' END",
}


def leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_no, domain, company, employees, status and the measures that the rules read; one shuffle of orders."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    customer = read("customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    recent = F.col("o_orderdate").cast("date") > F.date_sub(F.lit(AS_OF).cast("date"), 183)
    orders = (
        read("orders")
        .groupBy("o_custkey")
        .agg(
            F.count(F.lit(1)).alias("n_orders"),
            F.count_if(F.col("o_orderstatus") == "F").alias("n_done"),
            F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("n_urgent"),
            F.count_if(recent).alias("recent_orders"),
            F.max("o_totalprice").alias("max_order"),
            F.max("o_orderdate").alias("last_order"),
        )
    )
    # nation and region have 25 and 5 rows by definition of the schema; Spark broadcasts them by their size.
    places = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    joined = customer.join(places, F.col("c_nationkey") == F.col("n_nationkey")).join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    out = joined.select(
        F.col("c_custkey").alias("row_no"),
        F.concat(F.lower(F.regexp_replace("c_name", "[^A-Za-z0-9]", "")), F.lit(".com")).alias("domain"),
        F.col("c_name").alias("company"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"),
        F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("mktsegment"),
        *map(zero, ("n_orders", "n_done", "n_urgent", "recent_orders")), F.coalesce("max_order", F.lit(0.0)).alias("max_order"), "last_order",
    )
    return out.withColumn("status", F.expr(STATUS)).withColumn("employees", F.expr(EMPLOYEES))


LEADS_SQL = f"""
leads0 AS (
  SELECT c_custkey AS row_no, lower(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) || '.com' AS domain, c_name AS company,
    n_name AS nation, r_name AS region, c_acctbal AS acctbal, c_mktsegment AS mktsegment,
    coalesce(n_orders, 0) AS n_orders, coalesce(n_done, 0) AS n_done, coalesce(n_urgent, 0) AS n_urgent,
    coalesce(recent_orders, 0) AS recent_orders, coalesce(max_order, 0) AS max_order, last_order
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN (
    SELECT o_custkey, count(*) AS n_orders, count(*) FILTER (o_orderstatus = 'F') AS n_done,
      count(*) FILTER (o_orderpriority = '1-URGENT') AS n_urgent,
      count(*) FILTER (CAST(o_orderdate AS DATE) > DATE '{AS_OF}' - 183) AS recent_orders,
      max(o_totalprice) AS max_order, max(o_orderdate) AS last_order
    FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey),
leads AS (SELECT *, {STATUS} AS status, {EMPLOYEES} AS employees FROM leads0)"""


def signals(leads: DataFrame) -> DataFrame:
    """(domain, sid, value): one row per lead and fact."""
    cells = [F.struct(F.lit(sid).alias("sid"), F.expr(RULES.get(sid, "'unknown'")).alias("value")) for _, sid, _ in config.facts()]
    return leads.select("domain", F.explode(F.array(*cells)).alias("cell")).select("domain", "cell.sid", "cell.value")


def wide(leads: DataFrame) -> DataFrame:
    """leads with v_<fact> for each fact: all facts of a lead in its row, so what is decided over them needs no shuffle."""
    return leads.select("*", *[F.expr(RULES.get(sid, "'unknown'")).alias(f"v_{sid}") for _, sid, _ in config.facts()])


SIGNALS_SQL = "signals AS (SELECT domain, unnest([{}]) AS sid, unnest([{}]) AS value FROM leads)".format(
    ", ".join(f"'{sid}'" for _, sid, _ in config.facts()), ", ".join(RULES.get(sid, "'unknown'") for _, sid, _ in config.facts())
)
ROLES_SQL = config.sql_values(config.roles(), "roles", "pipeline, sid, grp, place, name")
WEIGHTS_SQL = config.sql_values(config.weights(), "weights", "pipeline, sid, segment, points, place")


def roles(spark: SparkSession) -> DataFrame:
    """The role table: two rows for each of 69 facts."""
    return spark.createDataFrame(config.roles(), "pipeline string, sid string, grp string, place int, name string")


def weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(config.weights(), "pipeline string, sid string, segment string, points int, place int")
