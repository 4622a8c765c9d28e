"""Queries over a company register: suppliers are its companies, customers the leads that are looked up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import registers as R
from tessera.plans.fingerprint_queries import _code, code
from tessera.plans.registry import query

#: Names that a company and a lead share by their number's code; cities and sites by number.
_N = 37
XML = (
    "<edgarSubmission><primaryIssuer><entityType>Corporation</entityType><jurisdictionOfInc>DELAWARE</jurisdictionOfInc><issuerPreviousNameList><previousName>None</previousName><previousName> Old @ </previousName></issuerPreviousNameList>"
    "<yearOfInc><withinFiveYears>true</withinFiveYears><value>20@</value></yearOfInc></primaryIssuer><offeringData><typeOfFiling><dateOfFirstSale><value>2024-01-@</value></dateOfFirstSale></typeOfFiling>"
    "<offeringSalesAmounts><totalOfferingAmount>Indefinite</totalOfferingAmount><totalAmountSold>@500</totalAmountSold></offeringSalesAmounts></offeringData></edgarSubmission>"
)


def companies(spark, sf_dir) -> DataFrame:
    n = F.col("s_suppkey")
    name = F.concat(F.lit("ACME "), F.upper(code(n * 7 % _N)), F.when(n % 2 == 0, ", Inc.").otherwise(" (Group) LLC"))
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        n.alias("cik"), name.alias("name"), F.when(n % 5 == 0, "other").when(n % 5 == 1, F.lit(None).cast("string")).otherwise("operating").alias("entity_type"),
        F.when(n % 4 == 0, F.concat(F.lit("https://www.c"), (n * 7 % _N).cast("string"), F.lit(".com/x"))).otherwise("").alias("website"), F.when(n % 3 == 0, "Austin").when(n % 3 == 1, "Waco").alias("city"),
    )


def leads(spark, sf_dir) -> DataFrame:
    n = F.col("c_custkey")
    own = F.concat(F.lit("Acme "), code(n % 61))
    one = lambda name, basis: F.struct(name.alias("name"), F.lit(basis).alias("basis"))
    legal = F.when(n % 3 == 0, F.concat(own, F.lit(" Corporation"))).when(n % 3 == 1, F.concat(F.lit("Zed "), code(n))).otherwise("A")
    names = F.array(one(legal, "legal name"), one(own, "company name"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("c"), (n % 61).cast("string"), F.lit("."), F.when(n < 61, "com").otherwise(n.cast("string"))).alias("domain"), names.alias("names"), F.when(n % 2 == 0, "offices in austin and bonn").alias("places"))


REGISTER_SQL = f"""companies AS (SELECT s_suppkey AS cik, 'ACME ' || upper({_code(f"(s_suppkey * 7 % {_N})")}) || CASE WHEN s_suppkey % 2 = 0 THEN ', Inc.' ELSE ' (Group) LLC' END AS name, s_suppkey * 7 % {_N} AS k,
  CASE WHEN s_suppkey % 5 = 0 THEN 'other' WHEN s_suppkey % 5 = 1 THEN NULL ELSE 'operating' END AS entity_type, s_suppkey % 4 = 0 AS has_site, CASE s_suppkey % 3 WHEN 0 THEN 'Austin' WHEN 1 THEN 'Waco' END AS city FROM supplier),
top AS (SELECT * FROM companies QUALIFY row_number() OVER (PARTITION BY k ORDER BY cik) <= {R.MOST_HITS}),
lead AS (SELECT 'c' || (c_custkey % 61) || '.' || CASE WHEN c_custkey < 61 THEN 'com' ELSE CAST(c_custkey AS VARCHAR) END AS domain, c_custkey % 61 AS k, CASE WHEN c_custkey % 3 = 0 THEN 'legal name' ELSE 'company name' END AS basis, c_custkey % 2 = 0 AS in_austin FROM customer),
counted AS (SELECT l.domain, l.k, l.basis, l.in_austin, t.*EXCLUDE(k) FROM lead l JOIN top t ON t.k = l.k WHERE coalesce(t.entity_type, '') <> 'other' OR NOT EXISTS (SELECT 1 FROM top o WHERE o.k = t.k AND coalesce(o.entity_type, '') <> 'other')),
best AS (SELECT domain, k, basis, in_austin, count(*) AS n, arg_min(cik, cik) AS cik, arg_min(name, cik) AS name, arg_min(has_site, cik) AS has_site, arg_min(coalesce(city, ''), cik) AS city FROM counted GROUP BY ALL),
sited AS (SELECT *, has_site AND domain = 'c' || k || '.com' AS by_site FROM best),
matches AS (SELECT domain, cik, name, CASE WHEN by_site THEN 'strong' WHEN n > 1 THEN 'weak' WHEN basis = 'legal name' THEN 'strong' WHEN city = 'Austin' AND in_austin THEN 'medium' ELSE 'weak' END AS match, basis, by_site, n FROM sited),
register AS (SELECT domain, cik, name, match, CASE WHEN by_site THEN 'website on the record' WHEN match = 'medium' THEN 'company name and city' ELSE basis END AS basis, n AS same_name_count FROM matches)"""


@query("register_matches", f"WITH {REGISTER_SQL} SELECT * FROM register")
def register_matches(spark, sf_dir):
    """Each lead's company in the register and how strong the match is."""
    return R.matched(leads(spark, sf_dir), companies(spark, sf_dir))


@query(
    "register_offerings",
    f"""WITH {REGISTER_SQL}, two AS (SELECT s_suppkey AS cik, lpad(CAST(s_suppkey % 28 + 1 AS VARCHAR), 2, '0') AS d FROM supplier WHERE s_suppkey % 6 <> 5)
    SELECT domain, r.cik, match, '20' || d AS year_of_incorporation, '2024-01-' || d AS first_sale, CAST(d || '500' AS DOUBLE) AS sold, CAST(NULL AS DOUBLE) AS offered, CASE WHEN d IS NOT NULL THEN 'Old ' || d END AS previous_names
    FROM register r LEFT JOIN two t ON t.cik = r.cik AND match <> 'weak'""",
)
def register_offerings(spark, sf_dir):
    """What the latest offering's document says of each lead's company, where the match isn't weak."""
    n = F.col("s_suppkey")
    day = F.lpad((n % 28 + 1).cast("string"), 2, "0")
    body = F.replace(F.lit(XML), F.lit("@"), F.when(F.col("k") == 1, day).otherwise("77"))
    documents = spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_suppkey % 6 <> 5").select(n, F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).select(n.alias("cik"), (F.lit(2020) + F.col("k")).alias("filed"), body.alias("body"))
    found = R.confirmed(R.matched(leads(spark, sf_dir), companies(spark, sf_dir)), R.offering_details(documents))
    return found.select("domain", "cik", "match", "year_of_incorporation", "first_sale", "sold", "offered", "previous_names")


_FORM = "CASE o_orderkey % 6 WHEN 0 THEN 'D' WHEN 1 THEN 'D/A' WHEN 2 THEN '10-K' WHEN 3 THEN '20-F' ELSE '8-K' END"


@query(
    "register_filings",
    f"""WITH f AS (SELECT o_custkey AS cik, {_FORM} AS form, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS filed FROM orders)
    SELECT cik, coalesce(string_agg(DISTINCT filed, '; ' ORDER BY filed DESC) FILTER (form IN ('D', 'D/A')), '') AS offerings, coalesce(string_agg(DISTINCT filed, '; ' ORDER BY filed DESC) FILTER (form IN ('10-K', '20-F')), '') AS reports FROM f GROUP BY cik""",
)
def register_filings(spark, sf_dir):
    """Orders as filings: each company's offering and report days."""
    forms = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("cik"), F.expr(_FORM).alias("form"), F.col("o_orderdate").cast("date").cast("string").alias("filed"))
    return R.filings(forms).select("cik", F.array_join("offerings", "; ").alias("offerings"), F.array_join("reports", "; ").alias("reports"))
