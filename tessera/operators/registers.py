"""Companies of an official register matched to leads by name, as far as the register's own data bear it out.

A lead has names in order (its legal name, its company name). The first name whose key the register knows decides: of the
key's MOST_HITS first companies those count that aren't of type "other" (all, if none is left), and the first of them is the
match. How strong it is: its website is the lead's domain; else several of one name are weak; one by a legal name is strong; one
by a company name is medium where its city is among the lead's places; all others are weak.

The register's companies are ranked within a key by a window whose tasks keep MOST_HITS rows a key, so a name that very many
companies share is cut before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scalars as S

MOST_HITS = 3
LEAST_KEY = 3
#: Form types that count as offerings and as yearly reports.
OFFERINGS, REPORTS = ("D", "D/A"), ("10-K", "20-F", "40-F")
#: What is read of an offering's document.
OFFERING_SCHEMA = (
    "primaryIssuer struct<entityType:string,jurisdictionOfInc:string,yearOfInc:struct<value:string,withinFiveYears:string>,"
    "issuerPreviousNameList:struct<previousName:array<string>>>,"
    "offeringData struct<typeOfFiling:struct<dateOfFirstSale:struct<value:string>>,offeringSalesAmounts:struct<totalOfferingAmount:string,totalAmountSold:string>>"
)


def first_of_each_key(companies: DataFrame) -> DataFrame:
    """companies (cik, name, entity_type, website, city) with key and place: the first MOST_HITS of each key by cik."""
    keyed = companies.withColumn("key", S.name_key(F.col("name"))).where(F.length("key") >= LEAST_KEY)
    return keyed.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("cik"))).where(F.col("place") <= MOST_HITS)


def strength(domain: Column, basis: Column, n: Column, company: Column, places: Column) -> Column:
    by_site = F.coalesce(S.normalize_domain(company.website) == domain, F.lit(False))
    city = F.lower(F.coalesce(company.city, F.lit("")))
    return (
        F.when(by_site, "strong").when(n > 1, "weak").when(basis == "legal name", "strong").when((city != "") & F.lower(F.coalesce(places, F.lit(""))).contains(city), "medium").otherwise("weak")
    )


def matched(leads: DataFrame, companies: DataFrame) -> DataFrame:
    """(domain, cik, name, match, basis, same_name_count) from leads (domain, names: array of (name, basis), places: text)."""
    asked = leads.select("domain", "places", F.posexplode("names").alias("no", "n")).select("domain", "places", "no", F.col("n.basis").alias("basis"), S.name_key(F.col("n.name")).alias("key"))
    hits = asked.where(F.length("key") >= LEAST_KEY).join(first_of_each_key(companies), "key")
    # At most MOST_HITS companies a lead and name.
    each = hits.groupBy("domain", "no", "basis").agg(F.first("places").alias("places"), F.array_sort(F.collect_list(F.struct("place", "cik", "name", "entity_type", "website", "city"))).alias("found"))
    operating = F.filter("found", lambda c: F.coalesce(c.entity_type, F.lit("")) != "other")
    counted = each.withColumn("counted", F.when(F.size(operating) > 0, operating).otherwise(F.col("found")))
    best = counted.groupBy("domain").agg(F.min_by(F.struct("basis", "places", "counted"), "no").alias("b")).select("domain", "b.*").withColumn("c", F.get("counted", F.lit(0)))
    n = F.size("counted")
    match = strength(F.col("domain"), F.col("basis"), n, F.col("c"), F.col("places"))
    by_site = F.coalesce(S.normalize_domain(F.col("c.website")) == F.col("domain"), F.lit(False))
    how = F.when(by_site, "website on the record").when(match == "medium", "company name and city").otherwise(F.col("basis"))
    return best.select("domain", "c.cik", "c.name", match.alias("match"), how.alias("basis"), n.cast("long").alias("same_name_count"))


def offering_details(documents: DataFrame) -> DataFrame:
    """(cik, filed, ...) read off offerings' documents (cik, filed, body: XML); of several of one cik the latest."""
    latest = documents.groupBy("cik").agg(F.max_by(F.struct("filed", "body"), "filed").alias("d"))
    read = latest.select("cik", F.col("d.filed").alias("filed"), F.from_xml("d.body", OFFERING_SCHEMA).alias("x"))
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    names = F.filter(F.transform("x.primaryIssuer.issuerPreviousNameList.previousName", lambda n: F.trim(n)), lambda n: (n != "") & (F.lower(n) != "none"))
    issuer, data = "x.primaryIssuer", "x.offeringData"
    return read.select(
        "cik", "filed", text(F.col(f"{issuer}.yearOfInc.value")).alias("year_of_incorporation"), text(F.col(f"{issuer}.yearOfInc.withinFiveYears")).alias("within_five_years"),
        text(F.col(f"{data}.typeOfFiling.dateOfFirstSale.value")).alias("first_sale"), text(F.col(f"{data}.offeringSalesAmounts.totalAmountSold")).try_cast("double").alias("sold"),
        text(F.col(f"{data}.offeringSalesAmounts.totalOfferingAmount")).try_cast("double").alias("offered"), text(F.col(f"{issuer}.entityType")).alias("entity_type"),
        text(F.col(f"{issuer}.jurisdictionOfInc")).alias("jurisdiction"), F.array_join(F.coalesce(names, F.array().cast("array<string>")), "; ").alias("previous_names"),
    )


def filings(forms: DataFrame) -> DataFrame:
    """(cik, offerings, reports): the days on which offerings and yearly reports were filed, the latest first, from
    (cik, form, filed)."""
    # A company's filing days are some hundreds.
    days = lambda names: F.sort_array(F.collect_set(F.when(F.col("form").isin(*names), F.col("filed"))), asc=False)
    return forms.groupBy("cik").agg(days(OFFERINGS).alias("offerings"), days(REPORTS).alias("reports"))


def confirmed(matches: DataFrame, details: DataFrame) -> DataFrame:
    """matches with the offering's details where the match isn't weak."""
    return matches.join(details.withColumnRenamed("entity_type", "issuer_type"), (matches["cik"] == details["cik"]) & (matches["match"] != "weak"), "left").drop(details["cik"])
