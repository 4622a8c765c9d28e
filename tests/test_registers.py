from tessera.operators import registers as R

LEADS = "domain string, names array<struct<name: string, basis: string>>, places string"
COMPANIES = "cik long, name string, entity_type string, website string, city string"


def test_ladder_of_matches(spark):
    legal, own = "legal name", "company name"
    companies = [
        (1, "Alder Inc", "operating", "", "Bonn"), (2, "BIRCH, LLC", "other", None, None), (3, "Birch Corp", "operating", "https://www.birch.io/", ""), (4, "Cedar", "other", "", ""), (5, "CEDAR CO", "other", "cedar.com", ""),
        (6, "Elm Ltd", None, None, "Austin"), *((k, "Common Inc", "operating", "", "") for k in range(10, 30)), (40, "AB", "operating", "", ""), (41, None, "operating", "", ""), (42, "Fir", "operating", "fir.dev", None),
    ]
    leads = [
        ("alder.com", [("Alder Corporation", legal)], None), ("birch.io", [("Unknown Name", legal), ("Birch", own)], ""), ("cedar.org", [("Cedar", legal)], ""), ("elm.com", [("Elm", own)], "offices in AUSTIN"), ("elm.net", [("The Elm, Inc.", own)], "Waco"),
        ("common.com", [("Common", legal)], None), ("ab.com", [("AB", legal)], ""), ("none.com", [], ""), ("fir.dev", [("Fir", own), ("Alder", legal)], None), ("null.com", [(None, legal), ("Fir", legal)], None),
    ]
    got = {r.domain: tuple(r)[1:] for r in R.matched(spark.createDataFrame(leads, LEADS), spark.createDataFrame(companies, COMPANIES)).collect()}
    assert got == {
        "alder.com": (1, "Alder Inc", "strong", legal, 1), "birch.io": (3, "Birch Corp", "strong", "website on the record", 1), "cedar.org": (4, "Cedar", "weak", legal, 2),
        "elm.com": (6, "Elm Ltd", "medium", "company name and city", 1), "elm.net": (6, "Elm Ltd", "weak", own, 1), "common.com": (10, "Common Inc", "weak", legal, 3),
        "fir.dev": (42, "Fir", "strong", "website on the record", 1), "null.com": (42, "Fir", "strong", legal, 1),
    }
    assert R.matched(spark.createDataFrame(leads, LEADS).limit(0), spark.createDataFrame([], COMPANIES)).count() == 0


def test_offering_details(spark):
    body = "<d><primaryIssuer><jurisdictionOfInc> NEVADA </jurisdictionOfInc><issuerPreviousNameList><previousName>Old A</previousName><previousName>none</previousName></issuerPreviousNameList></primaryIssuer><offeringData><offeringSalesAmounts><totalAmountSold>70</totalAmountSold></offeringSalesAmounts></offeringData></d>"
    docs = spark.createDataFrame([(1, "2020", "<d/>"), (1, "2021", body), (2, "2020", "not xml"), (3, "2020", None)], "cik long, filed string, body string")
    got = {r.cik: r for r in R.offering_details(docs).collect()}
    assert (got[1].filed, got[1].jurisdiction, got[1].sold, got[1].previous_names, got[1].first_sale) == ("2021", "NEVADA", 70.0, "Old A", None)
    assert got[2].sold is None and got[3].previous_names == "" and len(got) == 3
