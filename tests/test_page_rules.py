"""Page rules by plain cases: a text and what it must give."""

import pytest

from pyspark.sql import functions as F

from tessera.functions import page_rules as P
from tessera.functions import scalars as S
from tessera.operators import page_facts

SCHEMA = "domain string, page_no long, kind string, text string, html string, company string"
CASES = [
    # domain, kind, text, html, fact, value
    ("a.com", "home", "Thousands of tutors trust us; we are a marketplace for lessons.", "", "S2", "yes"),
    ("b.com", "home", "Find it: it is a top marketplace, the AWS Marketplace.", "", "S2", None),
    ("c.com", "about", "Roofing the valley since 1998.", "", "S12", "yes"),
    ("d.com", "about", "Selling shoes since 2024.", "", "S12", None),
    ("e.com", "about", "We bring over 20 years of experience.", "", "S12", None),
    ("f.com", "home", "", "<a href=https://app.jobber.com/x>", "S11", "yes"),
    ("g.ng", "contact", "Offices in Nairobi and Lagos.", "", "M1", "check"),
    ("h.com", "terms", "These terms are governed by the laws of Ukraine. ", "", "M1", "check"),
    ("i.hu", "terms", "These terms are governed by the laws of Turkey.", "", "E4", "yes"),
    ("j.com", "terms", "These terms are governed by the laws of the State of Ohio.", "", "M1", "yes"),
    ("k.com", "blog", "Ketone Inc raised $450 million in one go.", "", "E1", "yes"),
    ("l.com", "blog", "Lumen clients raised $450 million in one go.", "", "E1", None),
    ("m.com", "blog", "Mango is now at a $3 billion valuation.", "", "E1", "yes"),
    ("n.com", "blog", "The robot market is at a $3 billion valuation.", "", "E1", None),
    ("o.com", "about", "Opal grew 30% over the year.", "", "F15", "yes"),
    ("p.com", "about", "Somebody grew 30% over the year.", "", "F15", "check"),
]
COMPANIES = {"k.com": "Ketone Inc", "m.com": "Mango", "n.com": "Novel", "o.com": "Opal Bank", "p.com": "Plum"}


def test_facts_of_single_pages(spark):
    pages = spark.createDataFrame([(d, k, kind, text, html, COMPANIES.get(d)) for k, (d, kind, text, html, *_) in enumerate(CASES)], SCHEMA)
    found = page_facts.page_facts(pages).unionByName(page_facts.place_facts(pages, 2026)).unionByName(page_facts.sentence_facts(pages))
    values = {(r.domain, r.sid): r.value for r in found.collect()}
    assert {(d, sid): values.get((d, sid)) for d, *_, sid, _ in CASES} == {(d, sid): value for d, *_, sid, value in CASES}


@pytest.mark.parametrize(
    "html,methods",
    [
        ("<script>stripe.setKey('pk_live_abcdefghij12')</script>", "Stripe publishable key"),
        ("<script>stripe={k:'pk_live_abcdefghij12'};clerk.load()</script>", None),
        ("<script>k='pk_live_abcdefghij12'</script>", None),
        ("<script src=//js.stripe.com/v3></script><a href=//buy.stripe.com/1>", "Stripe.js loaded; Stripe Payment Link"),
    ],
)
def test_gateway_keys(spark, html, methods):
    found = page_facts.gateways(spark.createDataFrame([("a.com", 1, "home", "", html, "")], SCHEMA)).collect()
    assert [r.methods for r in found] == ([methods] if methods else [])


def test_tables_are_whole():
    assert (len(P.JURISDICTIONS), len(P.CITIES), len(P.COUNTRY_DOMAINS), len(P.FIELD_SOFTWARE)) == (64, 43, 42, 11)


def test_money_of_any_case(spark):
    texts = {"raised $150M in one round": 1.5e8, "a $2 Billion fund": 2e9, "$5,000K a year": 5e6, "no money": None}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.money_usd(F.col("t")).alias("usd")).collect()
    assert {r.t: r.usd for r in rows} == texts
