"""Nested JSON: structured data of pages walked to flat objects, and JSON answers read out of prose.

Values are variants. The walk is recursive SQL: each step opens the objects and arrays of the step before, so any depth of
nests and of arrays in arrays is reached. An object's members come in the order of their keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import page_facts

BLOCK = r"(?is)<script[^>]+application/ld\+json[^>]*>(.*?)</script>"
#: Types of places that people visit, and of local services.
PHYSICAL = (
    "Restaurant", "CafeOrCoffeeShop", "BarOrPub", "Bakery", "FoodEstablishment", "Store", "ClothingStore",
    "HealthClub", "ExerciseGym", "BeautySalon", "HairSalon", "DaySpa", "NailSalon", "Dentist", "MedicalClinic",
    "Physician", "Plumber", "Electrician", "HVACBusiness", "RoofingContractor", "HomeAndConstructionBusiness",
    "GeneralContractor", "AutoRepair", "AutomotiveBusiness", "LodgingBusiness", "Hotel", "VeterinaryCare",
    "ChildCare", "Florist", "HomeGoodsStore", "SportsActivityLocation", "MedicalBusiness", "Optician",
    "Winery", "Brewery", "Farm",
)
LOCAL_SERVICE = ("LegalService", "Attorney", "RealEstateAgent", "ProfessionalService", "InsuranceAgency", "EmploymentAgency", "LocalBusiness")
NONPROFIT = ("NGO", "NonprofitType")
US_NAMES = ("US", "USA", "UNITED STATES", "UNITED STATES OF AMERICA")


def whole_json(text: Column) -> Column:
    """A JSON text as a variant; null if it isn't one, or if more follows its value (Spark's reader alone overlooks that)."""
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    only = F.try_variant_get(listed, "$", "array<variant>")
    return F.when(F.size(only) == 1, F.get(only, F.lit(0)))


def is_open(value: str) -> str:
    """SQL test that a variant is an object or an array."""
    return f"(schema_of_variant({value}) LIKE 'OBJECT%' OR schema_of_variant({value}) LIKE 'ARRAY%')"


def flat_objects(values: DataFrame) -> DataFrame:
    """values (any columns, v variant) with a row for each object in v, at any depth: path (keys and places by /) and node.

    Spark's limits on recursive SQL count rows and steps; they are lifted for the session, as a JSON text ends by itself.
    """
    spark = values.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    spark.conf.set("spark.sql.cteRecursionLevelLimit", "-1")
    # Columns travel in a struct, so their names can't clash with the walk's.
    start = values.where("v is not null").select(F.struct(*[F.col(c) for c in values.columns if c != "v"] or [F.lit(0).alias("none")]).alias("row"), "v")
    walked = spark.sql(
        f"""WITH RECURSIVE walk(row, path, v) AS (
          SELECT row, '', v FROM {{start}}
          UNION ALL SELECT w.row, concat(w.path, '/', coalesce(e.key, CAST(e.pos AS STRING))), e.value FROM walk w, LATERAL variant_explode(w.v) e WHERE {is_open("e.value")})
        SELECT row, path, v AS node FROM walk WHERE schema_of_variant(v) LIKE 'OBJECT%'""",
        start=start,
    )
    return walked.select(*[F.col(f"row.{c}").alias(c) for c in values.columns if c != "v"], "path", "node")


def page_objects(pages: DataFrame) -> DataFrame:
    """Objects of pages' structured data; blocks that aren't JSON are left out."""
    blocks = pages.select("domain", "page_no", F.posexplode(F.regexp_extract_all("html", F.lit(BLOCK), F.lit(1))).alias("block_no", "text"))
    return flat_objects(blocks.select("domain", "page_no", "block_no", whole_json(F.col("text")).alias("v")))


def types_of(node: str = "node") -> Column:
    """An object's types: a text or the texts of a list; empty without one."""
    listed = F.expr(f"transform(filter(try_variant_get({node}, \"$['@type']\", 'array<variant>'), x -> schema_of_variant(x) = 'STRING'), x -> variant_get(x, '$', 'string'))")
    one = F.expr(f"CASE WHEN schema_of_variant(variant_get({node}, \"$['@type']\")) = 'STRING' THEN array(variant_get({node}, \"$['@type']\", 'string')) END")
    return F.coalesce(listed, one, F.array().cast("array<string>"))


def country_of(node: str = "node") -> Column:
    """The country of an object's address, given as text or as a named object; empty without one."""
    at = f"try_variant_get({node}, '$.address.addressCountry'"
    named = F.expr(f"CASE WHEN schema_of_variant({at})) LIKE 'OBJECT%' THEN try_variant_get({node}, '$.address.addressCountry.name', 'string') ELSE {at}, 'string') END")
    return F.trim(F.coalesce(named, F.lit("")))


def has_member(name: str, node: str = "node") -> Column:
    return F.expr(f"variant_get({node}, '$.{name}') IS NOT NULL")


def domain_flags(objects: DataFrame) -> DataFrame:
    """One row a domain: what its objects tell."""
    types, country = types_of(), F.upper(country_of())
    any_of = lambda names: F.arrays_overlap(types, F.array(*[F.lit(n) for n in names]))
    flags = {
        "nonprofit": any_of(NONPROFIT) | has_member("nonprofitStatus"),
        "accounting": F.array_contains(types, "AccountingService"),
        "physical": any_of(PHYSICAL),
        "hours": has_member("openingHours") | has_member("openingHoursSpecification"),
        "local_service": any_of(LOCAL_SERVICE),
        "us_country": country.isin(*US_NAMES),
        "foreign_country": (country != "") & ~country.isin(*US_NAMES),
    }
    return objects.groupBy("domain").agg(*[F.coalesce(F.max(c), F.lit(False)).alias(n) for n, c in flags.items()])


#: Portable rules over these flags.
STRUCTURED_FACTS = {
    "E5": "CASE WHEN nonprofit THEN 'yes' END",
    "E3": "CASE WHEN accounting THEN 'check' END",
    "W3": "CASE WHEN physical THEN 'yes' WHEN hours THEN 'check' END",
    "W1": "CASE WHEN local_service THEN 'check' END",
}


def structured_facts(objects: DataFrame) -> DataFrame:
    """(domain, sid, value) of facts by structured data alone; country clues go to page_facts.place_facts."""
    return page_facts.as_facts(domain_flags(objects), STRUCTURED_FACTS)


def fenced_json(text: Column) -> Column:
    """The JSON object of an answer as a variant: code fences are taken off, then what stands from the first { to the last }
    is read; null if that isn't JSON."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    cut = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return whole_json(F.when(cut != "", cut).otherwise(bare))


def strict(schema: dict) -> dict:
    """A JSON schema in its strict form: objects require all their fields and allow no others, bare lists of values are texts."""
    out = {k: v for k, v in schema.items() if k not in ("required", "additionalProperties")} if "properties" in schema or schema.get("type") == "object" else dict(schema)
    if "enum" in out:
        out.setdefault("type", "string")
    if "properties" in out or out.get("type") == "object":
        out["properties"] = {name: strict(field) for name, field in out.get("properties", {}).items()}
        out |= {"type": "object", "required": list(out["properties"]), "additionalProperties": False}
    if isinstance(out.get("items"), dict):
        out["items"] = strict(out["items"])
    return out


#: What schema_of_variant says of a value of a schema's type.
KINDS = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DECIMAL%", "DOUBLE"), "boolean": ("BOOLEAN",), "array": ("ARRAY%",), "object": ("OBJECT%",)}


def conforms(value: str, schema: dict) -> Column:
    """Whether a variant is as a strict schema says: an expression unrolled over the schema's fields."""

    def test(v: str, s: dict) -> str:
        kind = s.get("type", "string")
        tests = ["(" + " OR ".join(f"schema_of_variant({v}) LIKE '{k}'" for k in KINDS[kind]) + ")"]
        if "enum" in s:
            tests.append(f"variant_get({v}, '$', 'string') IN ({', '.join(repr(x) for x in s['enum'])})")
        if kind == "object":
            names = sorted(s["properties"])
            tests.append(f"array_sort(map_keys(try_variant_get({v}, '$', 'map<string,variant>'))) <=> array({', '.join(map(repr, names))})")
            tests += [f"coalesce({test(f"variant_get({v}, '$.{n}')", s['properties'][n])}, false)" for n in names]
        if kind == "array" and "items" in s:
            tests.append(f"forall(try_variant_get({v}, '$', 'array<variant>'), x -> coalesce({test('x', s['items'])}, false))")
        # A later test may only be read where the first holds.
        return "CASE WHEN " + " THEN CASE WHEN ".join(tests) + " THEN true ELSE false END" + " ELSE false END" * (len(tests) - 1)

    return F.coalesce(F.expr(test(value, strict(schema))), F.lit(False))
