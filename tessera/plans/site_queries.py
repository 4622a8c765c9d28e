"""Queries over companies' pages, job posts and DNS records, laid over the driver's tables.

Four documents make a company's pages; a part is a job post, a supplier two records. What the rules look for is put before
or into them from short lists by number, the same in the SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import sql_values
from tessera.functions import page_rules as P
from tessera.functions import scalars as S
from tessera.operators import page_facts as O
from tessera.operators import structured as J
from tessera.plans.registry import query
from tessera.sources import files

YEAR = 2026
COMPANIES = ("Acme", "Beta Labs", "")
KINDS = ("home", "about", "pricing", "terms")
ENDS = ("com", "de", "io", "com", "ng", "com", "org")
PHRASES = (
    "Plans start at $49 per month for a team of 120 people.", "We use Gusto for payroll.", "Our app connects to QuickBooks and Xero.", "Acme is a Delaware corporation.",
    "These terms are governed by the laws of the State of California.", "We are located at 12 Main Street, Austin, TX 78701.", "Payments are processed by Stripe.",
    "Contact sales for custom pricing.", "Prices: €20 or $25 a seat.", "Join our waitlist today.", "We are a marketplace for used tools.", "This agreement is governed by the laws of Germany.",
    "Ramp up quickly with Brex cards.", "Serving customers since 1990; established 1995 in Ohio.", "Over 25 years in business.", "Our team of 64 is fully remote.", "Add to cart. Free shipping. In stock.",
    "Instant download after checkout, add to cart.", "Acme Holdings, Inc is a family of brands.", "We do our own books.", "Become a member now, billed annually.", "An accounting firm for doctors.",
    "Areas we serve: all of it. Monday - Friday 9 am.", "The bank account is held at Mercury, supported by partners.", "Acme operates as a sole proprietorship.", "Donations through Stripe help us.",
    "Acme is an Ohio limited liability company.", "Our payroll runs on Rippling or Deel.", "Cap table kept in Carta; we like Ramp.", "Offices in London and Berlin.", "A registered charity, gifts are tax-deductible.", "Nothing to see here.",
    "We passed $5 million in ARR this year.", "The market grew 20% and 4,000 companies joined.", "Acme is a YC W21 company.", "Friends at Y Combinator like it.", "Listed as NASDAQ: ACME since May.", "We closed our Series D round.", "We raised $300 million from funds.", "Acme raises $250M for its robots.", "Beta is valued at $2 billion now.", "Acme grew 40% this year.",
    "Find us: we are the Acme marketplace on the AWS Marketplace.", "Acme trades since 2001 in Lagos.", "This agreement is governed by the laws of Nigeria.",
    "The dashboard works with Rho checking accounts.", "We're 75 employees of the month.",
)
CODES = (
    "<script src=https://js.stripe.com/v3></script>", "<a href=https://buy.stripe.com/x>Buy</a><script src=https://www.paypal.com/sdk/js></script>", "<script>Paddle.Setup({})</script>", "<link href=//cdn.shopify.com/x.css>",
    "<a href=https://boards.greenhouse.io/acme>Jobs</a>", "<a href=https://jobs.lever.co/jobs>x</a><a href=https://jobs.lever.co/Acme.io>y</a>", "<a href=https://acme.wd5.myworkdayjobs.com/en-US/Site>Jobs</a>", "<p>USD / EUR</p>",
    "<a href=https://apps.apple.com/us/app/x>App</a>", "<a href=https://whop.com/acme>Whop</a>", "<a href=https://www.producthunt.com/posts/acme>PH</a>", "<script src=https://js.chargebee.com/v2></script>", "<iframe src=https://acme.servicetitan.com></iframe>",
    "<a href=https://connect.stripe.com/oauth>Pay out</a>", "<p>Made with Printful</p><div class=woocommerce>", "<p>This domain is for sale</p>", "<p>plain</p>", "<a href=https://acme.recruitee.com>Jobs</a><a href=https://jobs.smartrecruiters.com/Acme1>Jobs</a>",
    "<script>braintree.dropin.create ({})</script>", "<script>stripeKey='pk_live_0123456789ab'</script>", "<script>var stripe={key:'pk_test_0123456789ab'}; clerk.load()</script>",
    '<script type="application/ld+json">{"@graph":[{"@type":["Organization","Store",7],"address":{"addressCountry":{"name":"United States"}}}]}</script>',
    '<script type="application/ld+json">[[{"@type":"NGO","department":{"address":{"addressCountry":" DE "}}}],[]]</script>',
    '<script data-x=1 type="application/ld+json">{"@type":"LocalBusiness","openingHours":"Mo-Fr"}</script><script type="application/ld+json">{bad</script>',
    '<script type="application/ld+json">{"a":{"b":{"c":[{"d":{"@type":"AccountingService","address":"x","n":null}}]}}}</script>',
)
TITLES = ("Staff Accountant", "Controller", "Software Engineer", "Operations Manager", "HR Partner", "Warehouse Lead", "Bookkeeper", "Chief of Staff", "Sales Lead", "Support Agent", "FP&A Analyst")
DESCRIPTIONS = (
    "You know Gusto and Excel.", "Experience with NetSuite is a plus.", "You will clean up our books and reconcile accounts.", "Prepare for an audit of the year.", "Bookkeeping is kept in spreadsheets now.",
    "We use QuickBooks and Brex.", "You lead our integration with Xero.", "You catch up with customers.", "Our stack is Stripe and Carta.", "You like people.", "Work from anywhere.", "QuickBooks Enterprise migration ahead.", "A team player.",
)
RECORDS = (
    ("TXT", "stripe-verification=abc"), ("TXT", "v=spf1 include:_spf.google.com include:mail.zendesk.com ~all"), ("MX", "10 aspmx.l.google.com"), ("TXT", "rippling-domain-verification=1f"), ("MX", "0 acme-com.mail.protection.outlook.com"),
    ("TXT", "google-site-verification=xyz"), ("TXT", "ramp-verification=9"), ("TXT", "no tool here"), ("MX", "5 mx1.mimecast.com"), ("TXT", "Expensify-verify"), ("TXT", "quickbooks_domain_verification=1"),
)


def chosen(items, number) -> F.Column:
    """The item of a short list that a number picks."""
    return F.element_at(F.array(*[F.lit(x) for x in items]), (number % len(items) + 1).cast("int"))


def domain_of(n) -> F.Column:
    return F.concat(F.lit("c"), n.cast("string"), F.lit("."), chosen(ENDS, n))


def pages(spark, sf_dir) -> DataFrame:
    n = F.col("doc_id")
    company = F.floor(n / 4)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.select(
        domain_of(company).alias("domain"), n.alias("page_no"), chosen(KINDS, n).alias("kind"), F.concat(chosen(PHRASES, n * 7 + company), F.lit(" "), "text").alias("text"), F.concat(F.lit("<body>"), chosen(CODES, n * 5 + company), F.lit("</body>")).alias("html")
    )


def jobs(spark, sf_dir) -> DataFrame:
    n = F.col("p_partkey")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey")
    return parts.select(
        domain_of(n * 13 % 211).alias("domain"), n.alias("job_no"), chosen(TITLES, n * 3).alias("title"), F.concat(chosen(DESCRIPTIONS, n * 5), F.lit(" "), chosen(DESCRIPTIONS, n * 7 + 3)).alias("description"), (n % 3 != 0).alias("remote")
    )


def records(spark, sf_dir) -> DataFrame:
    n = F.col("s_suppkey")
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
    at = n * 3 + F.col("k") * 4 + F.floor(n / 7)
    return suppliers.select(domain_of(n).alias("domain"), F.col("k").alias("record_no"), chosen([k for k, _ in RECORDS], at).alias("kind"), chosen([r for _, r in RECORDS], at).alias("record"))


def _list(items) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


def _chosen(items, number: str) -> str:
    return f"({_list(items)})[({number}) % {len(items)} + 1]"


def _domain(n: str) -> str:
    return f"('c' || CAST({n} AS VARCHAR) || '.' || {_chosen(ENDS, n)})"


def _has(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, '{pattern.replace(chr(39), chr(39) * 2)}')"


def _part(column: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract({column}, '{pattern.replace(chr(39), chr(39) * 2)}', {group})"


def _near(column: str, pattern: str, width: int = 90) -> str:
    flags, body = ("(?is)", pattern[4:]) if pattern.startswith("(?i)") else ("(?s)", pattern)
    return _part(column, f"{flags}.{{0,{width}}}?(?:{body}).{{0,{width}}}")


def _in(column: str, names) -> str:
    return f"{column} IN ({', '.join(repr(n) for n in names)})"


PAGES_SQL = f"""pages_of AS (SELECT {_domain("(doc_id // 4)")} AS domain, doc_id AS page_no, {_chosen(KINDS, "doc_id")} AS kind, {_chosen(PHRASES, "doc_id * 7 + doc_id // 4")} || ' ' || text AS text,
  '<body>' || {_chosen(CODES, "doc_id * 5 + doc_id // 4")} || '</body>' AS html FROM documents)"""
JOBS_SQL = f"""jobs_of AS (SELECT {_domain("(p_partkey * 13 % 211)")} AS domain, p_partkey AS job_no, {_chosen(TITLES, "p_partkey * 3")} AS title,
  {_chosen(DESCRIPTIONS, "p_partkey * 5")} || ' ' || {_chosen(DESCRIPTIONS, "p_partkey * 7 + 3")} AS description, p_partkey % 3 <> 0 AS remote FROM part)"""
_KEY = next(p for _, how, p in P.GATEWAYS if how == P.KEY_METHOD)


def _key_elsewhere(html: str) -> str:
    return _has(_near(html, "(?i)" + _KEY, 60), P.NOT_STRIPE_KEY)


GATEWAYS_SQL = f"""{sql_values([(k, g, how, "(?i)" + p) for k, (g, how, p) in enumerate(P.GATEWAYS)], "gateway_rules", "k, gateway, how, pattern")},
gateway_hits AS (SELECT domain, page_no, gateway, k, how FROM pages_of JOIN gateway_rules ON regexp_matches(html, pattern) WHERE how <> '{P.KEY_METHOD}' OR NOT {_key_elsewhere("html")}),
gateways AS (SELECT domain, gateway, (SELECT string_agg(how, '; ' ORDER BY k) FROM (SELECT DISTINCT k, how FROM gateway_hits i WHERE i.domain = o.domain AND i.gateway = o.gateway)) AS methods, page_no
  FROM (SELECT domain, gateway, min(page_no) AS page_no FROM gateway_hits GROUP BY domain, gateway) o)"""


@query("payment_gateways", f"WITH {PAGES_SQL}, {GATEWAYS_SQL} SELECT domain, gateway, methods, page_no FROM gateways")
def payment_gateways(spark, sf_dir):
    return O.gateways(pages(spark, sf_dir))


_CODE = {name: "|".join(p for g, how, p in P.GATEWAYS if g == name and how != P.KEY_METHOD) for name, _, _ in P.TOOLS}
TOOLS_SQL = f"""{sql_values([(k, name, "(?i)" + _CODE[name] if _CODE[name] else None, raw, text, _near("", text).split("'", 1)[1].rsplit("', 0)", 1)[0].replace("''", "'")) for k, (name, raw, text) in enumerate(P.TOOLS)], "tool_rules", "k, tool, code, raw, pattern, wide")},
page_tools AS (SELECT domain, page_no, kind, tool, coalesce(regexp_matches(html, code), FALSE) OR coalesce(regexp_matches(html, raw), FALSE) OR (tool = 'Stripe' AND {_has("html", "(?i)" + _KEY)} AND NOT {_key_elsewhere("html")}) AS code, regexp_matches(text, pattern) AS named, CASE WHEN regexp_matches(text, pattern) THEN regexp_extract(text, wide) END AS near FROM pages_of, tool_rules),
used AS (SELECT domain, tool, CASE WHEN {_has("near", P.INTEGRATION)} OR {_has("near", P.DONATION)} THEN 'check' ELSE 'yes' END AS used FROM page_tools
  WHERE named AND {_in("kind", P.USAGE_KINDS)} QUALIFY row_number() OVER (PARTITION BY domain, tool ORDER BY page_no) = 1),
job_tools AS (SELECT domain, tool, job_no, title, CASE WHEN regexp_matches(description, pattern) THEN regexp_extract(description, wide) ELSE regexp_extract(title, wide) END AS near
  FROM jobs_of JOIN tool_rules ON regexp_matches(description, pattern) OR regexp_matches(title, pattern)),
said AS (SELECT domain, tool, CASE WHEN {_has("title", P.FINANCE_ROLE)} OR {_has("title", P.OPERATIONS_ROLE)} OR {_has("title", P.PEOPLE_ROLE)} OR {_has("near", P.USAGE)} THEN 'yes' ELSE 'check' END AS said
  FROM job_tools QUALIFY row_number() OVER (PARTITION BY domain, tool ORDER BY job_no) = 1),
seen AS (SELECT domain, tool, bool_or(code) AS code, bool_or(named AND {_in("kind", P.MENTION_KINDS)}) AS other FROM page_tools GROUP BY domain, tool),
tools_of AS (SELECT domain, tool, CASE WHEN code THEN 'yes' WHEN used = 'yes' THEN 'yes' ELSE coalesce(said, used, CASE WHEN other THEN 'check' END) END AS value
  FROM seen FULL JOIN said USING (domain, tool) LEFT JOIN used USING (domain, tool)),
tools_found AS (SELECT * FROM tools_of WHERE value IS NOT NULL)"""


def tools(spark, sf_dir) -> DataFrame:
    return O.tools(pages(spark, sf_dir), jobs(spark, sf_dir))


@query("tool_signs", f"WITH {PAGES_SQL}, {JOBS_SQL}, {TOOLS_SQL} SELECT domain, tool, value FROM tools_found")
def tool_signs(spark, sf_dir):
    return tools(spark, sf_dir)


@query(
    "facts_by_tools",
    f"""WITH {PAGES_SQL}, {JOBS_SQL}, {TOOLS_SQL}, {sql_values([(s, t) for s, ts in P.TOOL_FACTS.items() for t in ts], "tool_facts", "sid, tool")}
    SELECT domain, sid, max(value) AS value FROM tools_found JOIN tool_facts USING (tool) GROUP BY domain, sid""",
)
def facts_by_tools(spark, sf_dir):
    return O.tool_facts(tools(spark, sf_dir))


@query(
    "facts_by_competitors",
    f"""WITH {PAGES_SQL}, {JOBS_SQL}, {sql_values([(n, p, _near("", p).split("'", 1)[1].rsplit("', 0)", 1)[0].replace("''", "'")) for n, p in P.COMPETITORS], "rivals", "name, pattern, wide")},
    used AS (SELECT DISTINCT domain, name FROM (SELECT domain, name, CASE WHEN regexp_matches(description, pattern) THEN regexp_extract(description, wide) ELSE regexp_extract(title, wide) END AS near
      FROM jobs_of JOIN rivals ON regexp_matches(description, pattern) OR regexp_matches(title, pattern)) WHERE NOT {_has("near", P.INTEGRATION)}),
    named AS (SELECT DISTINCT domain FROM pages_of WHERE {_in("kind", P.MENTION_KINDS)} AND {_has("text", P.COMPETITORS[0][1])})
    SELECT domain, 'F4' AS sid, 'yes' AS value FROM used WHERE name = 'QuickBooks Online'
    UNION ALL SELECT domain, 'F4', 'check' FROM named WHERE domain NOT IN (SELECT domain FROM used WHERE name = 'QuickBooks Online')
    UNION ALL SELECT DISTINCT domain, 'W10', 'check' FROM used WHERE name IN ('NetSuite', 'QuickBooks Enterprise')""",
)
def facts_by_competitors(spark, sf_dir):
    return O.competitor_facts(pages(spark, sf_dir), jobs(spark, sf_dir))


def _facts(rules: dict[str, str], source: str) -> str:
    return " UNION ALL ".join(f"SELECT domain, '{sid}' AS sid, {rule} AS value FROM {source} WHERE ({rule}) IS NOT NULL" for sid, rule in rules.items())


_JOB_FLAGS = ", ".join(f"bool_or({' AND '.join(_has(c, p) for c, p in tests)}) AS {name}" for name, tests in O.JOB_FLAGS.items())


@query(
    "facts_by_jobs",
    f"""WITH {PAGES_SQL}, {JOBS_SQL}, {TOOLS_SQL}, known_jobs AS (SELECT domain, count(*) AS n_jobs, count(*) FILTER (remote) AS n_remote, {_JOB_FLAGS},
      bool_or({_has(_near("description", P.BOOKS_BEHIND, 80), "(?i)book|account|reconcil")}) AS maybe_behind FROM jobs_of GROUP BY domain),
    site AS (SELECT DISTINCT domain FROM pages_of WHERE {_in("kind", P.PAGE_FLAGS["remote"][0])} AND {_has("text", P.PAGE_FLAGS["remote"][2])}),
    known AS (SELECT k.*, domain IN (SELECT domain FROM site) AS remote_site, domain IN (SELECT domain FROM tools_found WHERE value = 'yes') AS has_tool FROM known_jobs k)
    {_facts(O.JOB_FACTS, "known")}""",
)
def facts_by_jobs(spark, sf_dir):
    posts, sites = jobs(spark, sf_dir), pages(spark, sf_dir)
    return O.job_facts(posts, sites, O.tools(sites, posts))


def _flag(kinds, column: str, pattern: str, unless: str | None = None) -> str:
    others = f" AND NOT {_has(_near(column, pattern, 80), unless)}" if unless else ""
    return f"bool_or({_in('kind', kinds) + ' AND ' if kinds else ''}{_has(column, pattern)}{others})"


@query(
    "facts_by_pages",
    f"""WITH {PAGES_SQL}, {GATEWAYS_SQL}, flags AS (SELECT domain, {", ".join(f"{_flag(*rule)} AS {name}" for name, rule in P.PAGE_FLAGS.items())}, count(*) AS n_pages,
      max(CASE WHEN kind = 'home' THEN length(text) ELSE 0 END) AS home_chars FROM pages_of GROUP BY domain),
    paid AS (SELECT domain, count(*) FILTER ({_in("gateway", P.PROCESSORS)}) AS n_processors, bool_or({_in("gateway", P.SUBSCRIPTION_BILLING)}) AS billed, bool_or(contains(methods, 'Stripe Connect')) AS pays_out FROM gateways GROUP BY domain),
    known AS (SELECT f.*, coalesce(n_processors, 0) AS n_processors, coalesce(billed, FALSE) AS billed, coalesce(pays_out, FALSE) AS pays_out FROM flags f LEFT JOIN paid USING (domain))
    {_facts(O.PAGE_FACTS, "known")}""",
)
def facts_by_pages(spark, sf_dir):
    return O.page_facts(pages(spark, sf_dir))


_STATE, _FORM = f"lower({_part('text', P.STATE_ENTITY, 1)})", f"lower({_part('text', P.STATE_ENTITY, 2)})"
_LAW = _in("kind", O.LAW_KINDS)


def _any_type(names) -> str:
    return f"list_has_any(types, {_list(names)})"


OBJECTS_SQL = f"""objects AS (SELECT domain, page_no, value AS v, CASE json_type(value, '$."@type"') WHEN 'VARCHAR' THEN [value->>'$."@type"'] WHEN 'ARRAY' THEN list_transform(list_filter(json_extract(value, '$."@type"[*]'), lambda x: json_type(x) = 'VARCHAR'), lambda x: x->>'$') ELSE [] END AS types,
    trim(coalesce(CASE WHEN json_type(value, '$.address.addressCountry') = 'OBJECT' THEN value->>'$.address.addressCountry.name' ELSE value->>'$.address.addressCountry' END, '')) AS country
  FROM (SELECT domain, page_no, unnest(regexp_extract_all(html, '{J.BLOCK}', 1)) AS block FROM pages_of), json_tree(CASE WHEN json_valid(block) THEN block ELSE 'null' END) WHERE type = 'OBJECT'),
object_flags AS (SELECT domain, bool_or({_any_type(J.NONPROFIT)} OR json_exists(v, '$.nonprofitStatus')) AS nonprofit, bool_or(list_contains(types, 'AccountingService')) AS accounting, bool_or({_any_type(J.PHYSICAL)}) AS physical,
  bool_or(json_exists(v, '$.openingHours') OR json_exists(v, '$.openingHoursSpecification')) AS hours, bool_or({_any_type(J.LOCAL_SERVICE)}) AS local_service,
  bool_or({_in("upper(country)", J.US_NAMES)}) AS us_country, bool_or(country <> '' AND NOT {_in("upper(country)", J.US_NAMES)}) AS foreign_country FROM objects GROUP BY domain)"""


@query(
    "facts_by_place",
    f"""WITH {PAGES_SQL}, forms AS (SELECT domain, CASE WHEN {_STATE} = 'delaware' AND NOT contains({_FORM}, 'benefit') AND NOT contains({_FORM}, 'limited') THEN 'delaware corporation' ELSE {_FORM} END AS form
      FROM pages_of WHERE {_LAW} AND {_has("text", P.STATE_ENTITY)} QUALIFY row_number() OVER (PARTITION BY domain ORDER BY page_no) = 1),
    clues AS (SELECT domain, bool_or(({_in("kind", O.ADDRESS_KINDS)} AND {_has("text", P.US_ADDRESS)}) OR ({_LAW} AND {_has("text", P.US_LAW)}) OR ({_LAW} AND {_has("text", P.STATE_ENTITY)})) AS us,
      bool_or({_LAW} AND {_has("text", P.FOREIGN_LAW)}) AS foreign_law, bool_or({_in("kind", ("contact", "legal"))} AND {_has("text", P.FOREIGN_PLACE)}) AS foreign_place,
      bool_or({_in("lower(split_part(domain, '.', 2))", P.COUNTRY_DOMAINS)}) AS country_domain, bool_or({_in("kind", P.PAGE_FLAGS["sole_self"][0])} AND {_has("text", P.PAGE_FLAGS["sole_self"][2])}) AS sole_self,
      max(CASE WHEN {_in("kind", ("home", "about", "contact"))} THEN coalesce({YEAR} - TRY_CAST({_part("text", P.SINCE_YEAR, 1)} AS INT), TRY_CAST({_part("text", P.YEARS_IN_BUSINESS, 1)} AS INT)) END) AS years FROM pages_of GROUP BY domain),
    {OBJECTS_SQL}, known AS (SELECT c.* REPLACE (us OR coalesce(us_country, FALSE) AS us), form, CAST(foreign_law AS INT) + CAST(foreign_place AS INT) + CAST(country_domain AS INT) + CAST(coalesce(foreign_country, FALSE) AS INT) AS n_foreign,
      foreign_law OR coalesce(foreign_country, FALSE) AS strong_foreign FROM clues c LEFT JOIN forms USING (domain) LEFT JOIN object_flags USING (domain))
    {_facts(O.PLACE_FACTS, "known")}""",
)
def facts_by_place(spark, sf_dir):
    found = pages(spark, sf_dir)
    return O.place_facts(found, YEAR, J.domain_flags(J.page_objects(found)))


@query("facts_by_structured", f"WITH {PAGES_SQL}, {OBJECTS_SQL} {_facts(J.STRUCTURED_FACTS, 'object_flags')}")
def facts_by_structured(spark, sf_dir):
    return J.structured_facts(J.page_objects(pages(spark, sf_dir)))


@query("structured_objects", f"WITH {PAGES_SQL}, {OBJECTS_SQL} SELECT domain, page_no, types, country, count(*) AS n FROM (SELECT domain, page_no, array_to_string(types, '; ') AS types, country FROM objects) GROUP BY ALL")
def structured_objects(spark, sf_dir):
    """Every object of the pages' structured data, at any depth, by its types and country."""
    found = J.page_objects(pages(spark, sf_dir)).select("domain", "page_no", F.array_join(J.types_of(), "; ").alias("types"), J.country_of().alias("country"))
    return found.groupBy("domain", "page_no", "types", "country").agg(F.count(F.lit(1)).alias("n"))


_TOLD = f"coalesce(TRY_CAST({_part('text', P.OWN_HEADCOUNT, 1)} AS BIGINT), TRY_CAST({_part('text', P.OWN_HEADCOUNT, 2)} AS BIGINT))"


@query(
    "facts_by_headcount",
    f"""WITH {PAGES_SQL}, lead AS (SELECT {_domain("c_custkey")} AS domain, CASE WHEN c_custkey % 4 = 0 THEN CAST(c_custkey % 150 AS VARCHAR) || '+ people' ELSE '' END AS employees FROM customer),
    told AS (SELECT domain, n FROM (SELECT domain, {_TOLD} AS n, CASE kind WHEN 'about' THEN 0 WHEN 'home' THEN 1 WHEN 'careers' THEN 2 END AS rank FROM pages_of) WHERE rank IS NOT NULL AND n IS NOT NULL QUALIFY row_number() OVER (PARTITION BY domain ORDER BY rank) = 1),
    p AS (SELECT domain, coalesce(TRY_CAST(replace({_part("employees", "[0-9][0-9,]*")}, ',', '') AS BIGINT), n) AS people FROM lead LEFT JOIN told USING (domain))
    SELECT domain, people, CASE WHEN people >= 100 THEN 'yes' ELSE 'no' END AS s7, CASE WHEN people BETWEEN 50 AND 99 THEN 'yes' ELSE 'no' END AS s8 FROM p WHERE people IS NOT NULL""",
)
def facts_by_headcount(spark, sf_dir):
    n = F.col("c_custkey")
    leads = spark.read.parquet(f"{sf_dir}/customer.parquet").select(domain_of(n).alias("domain"), F.when(n % 4 == 0, F.concat((n % 150).cast("string"), F.lit("+ people"))).otherwise("").alias("employees"))
    return O.headcount_facts(leads, pages(spark, sf_dir))


@query(
    "job_boards_linked",
    f"""WITH {PAGES_SQL}, {sql_values([(b, "(?i)" + p) for b, p in P.BOARDS], "boards", "board, pattern")},
    found AS (SELECT domain, page_no, board, list_filter(regexp_extract_all(html, pattern, 1), lambda x: lower(x) NOT IN ({", ".join(map(repr, P.NO_ACCOUNTS))}))[1] AS account FROM pages_of, boards)
    SELECT domain, board, account FROM found WHERE account IS NOT NULL QUALIFY row_number() OVER (PARTITION BY domain, board ORDER BY page_no) = 1""",
)
def job_boards_linked(spark, sf_dir):
    return O.job_boards(pages(spark, sf_dir))


_MONEY = r"(?i)(.{0,20})\$\s?(\d+(?:\.\d+)?)\s?(million|billion|[MB])\b(.{0,15})"
_USD = "TRY_CAST(x[2] AS DOUBLE) * CASE WHEN lower(x[3]) IN ('billion', 'b') THEN 1e9 ELSE 1e6 END"



def names_word_sql(sentence: str, name: str) -> str:
    spaced = lambda c: f"(' ' || regexp_replace(lower({c}), '[^a-z0-9_]+', ' ', 'g') || ' ')"
    first = spaced(f"split_part(trim(coalesce({name}, '')), ' ', 1)")
    return f"(trim({first}) <> '' AND contains({spaced(sentence)}, {first}))"


def late_money_sql(s: str, company: str) -> str:
    zipped = f"list_zip({', '.join(f"regexp_extract_all({s}, '{_MONEY}', {k})" for k in (1, 2, 3, 4))})"
    own = f"(regexp_matches({s}, '(?i)\\b(?:we|we''ve|we have|our)\\b') OR {names_word_sql(s, company)})"
    amount = f"len(list_filter({zipped}, lambda x: ({_VALUED} AND {_USD} >= 1e9) OR (NOT {_VALUED} AND {_USD} >= 1e8 AND {_has(s, S.BIG_RAISE)}))) > 0"
    return f"({own} AND NOT {_has(s, S.NOT_OWN_MONEY)} AND ({_has(s, S.BIG_RAISE)} OR {_has(s, S.VALUATION)}) AND {amount})"


_VALUED = "(contains(lower(x[4]), 'valuation') OR contains(lower(x[1]), 'valued at') OR contains(lower(x[1]), 'valuation of'))"


@query(
    "facts_by_sentences",
    rf"""WITH {PAGES_SQL}, rows AS (SELECT domain, {_chosen(COMPANIES, "page_no // 4")} AS company, unnest(string_split(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS s FROM pages_of WHERE {_in("kind", O.SENTENCE_KINDS)}),
    m AS (SELECT domain, s, {_has("s", P.FIRST_PERSON)} OR {names_word_sql("s", "company")} AS own, {_has("s", P.METRIC)} AND NOT {_has("s", P.NOT_OWN_METRIC)} AS metric, {late_money_sql("s", "company")} AS late_money FROM rows WHERE length(s) <= 400),
    known AS (SELECT domain, bool_or(metric AND own) AS own_metric, bool_or(metric) AS metric, bool_or(own AND {_has("s", P.LATE_ROUND)} AND {_has("s", P.ROUND_WORDS)} AND NOT {_has("s", S.NOT_OWN_MONEY)}) AS late_round, bool_or(late_money) AS late_money,
      bool_or({_has("s", P.TICKER)}) AS ticker, bool_or({_has("s", P.YC_STRONG)}) AS yc, bool_or({_has("s", P.YC_NAMED)}) AS yc_named FROM m GROUP BY domain)
    {_facts(O.SENTENCE_FACTS, "known")}""",
)
def facts_by_sentences(spark, sf_dir):
    return O.sentence_facts(pages(spark, sf_dir).withColumn("company", chosen(COMPANIES, F.floor(F.col("page_no") / 4))))


_AT = "s_suppkey * 3 + k * 4 + s_suppkey // 7"


@query(
    "facts_by_dns",
    f"""WITH recs AS (SELECT {_domain("s_suppkey")} AS domain, k AS record_no, {_chosen([k for k, _ in RECORDS], _AT)} AS kind, {_chosen([r for _, r in RECORDS], _AT)} AS record FROM supplier, (VALUES (0), (1), (2)) v(k)),
    {sql_values(list(P.TXT_TOOLS), "txt_tools", "tool, pattern")}, {sql_values([(i, a, b) for i, (a, b) in enumerate(P.MAIL)], "mails", "i, key, name")},
    t AS (SELECT domain, string_agg(DISTINCT tool, '; ' ORDER BY tool) AS tools FROM recs JOIN txt_tools ON kind = 'TXT' AND regexp_matches(lower(record), pattern) GROUP BY domain),
    v AS (SELECT domain, string_agg(DISTINCT x, '; ' ORDER BY x) AS verified_with FROM (SELECT domain, {_part("lower(record)", P.VERIFIED, 1)} AS x FROM recs WHERE kind = 'TXT') WHERE x <> '' GROUP BY domain),
    s AS (SELECT domain, string_agg(DISTINCT x, '; ' ORDER BY x) AS spf_includes FROM (SELECT domain, unnest(regexp_extract_all(record, '{P.SPF_INCLUDE}', 1)) AS x FROM recs WHERE kind = 'TXT' AND starts_with(lower(record), 'v=spf1')) GROUP BY domain),
    m AS (SELECT domain, name AS email FROM recs JOIN mails ON kind = 'MX' AND contains(lower(record), key) QUALIFY row_number() OVER (PARTITION BY domain ORDER BY record_no, i) = 1)
    SELECT domain, coalesce(tools, '') AS tools, coalesce(verified_with, '') AS verified_with, coalesce(spf_includes, '') AS spf_includes, coalesce(email, '') AS email
    FROM (SELECT DISTINCT domain FROM recs) LEFT JOIN t USING (domain) LEFT JOIN v USING (domain) LEFT JOIN s USING (domain) LEFT JOIN m USING (domain)""",
)
def facts_by_dns(spark, sf_dir):
    return O.dns_facts(records(spark, sf_dir))


#: A feed of each board with two jobs and one without a title; @t stands for the title, @n for a number.
BODIES = {
    "greenhouse": ('{"jobs":[{"title":"@t","location":{"name":"Remote, US"},"content":"<p>Do &amp; say</p>","absolute_url":"https://g/@n"},{"title":" "},{"title":"Two"}]}', "@t", "Remote, US", True, "Do & say", "https://g/@n"),
    "lever": ('[{"text":"@t","categories":{"location":"Ulm"},"descriptionPlain":"One","lists":[{"content":"<li>two</li>"}],"additionalPlain":"three","workplaceType":"remote","hostedUrl":"https://l/@n"},{"text":""},{"text":"Two"}]', "@t", "Ulm", True, "One two three", "https://l/@n"),
    "ashby": ('{"jobs":[{"title":"@t","location":"Rome","isRemote":true,"descriptionPlain":"","descriptionHtml":"<b>Hi</b>","jobUrl":"https://a/@n"},{"location":"x"},{"title":"Two"}]}', "@t", "Rome", True, "Hi", "https://a/@n"),
    "workable": ('{"jobs":[{"title":"@t","city":"Bonn","country":"Germany","telecommuting":false,"description":"x","url":"https://w/@n"},{"title":null},{"title":"Two"}]}', "@t", "Bonn, Germany", False, "x", "https://w/@n"),
    "rippling": ('{"items":[{"name":"@t","locations":[{"name":"Remote"},{"name":"NYC"}],"url":"https://r/@n"},{"name":""},{"name":"Two"}]}', "@t", "Remote, NYC", True, "", "https://r/@n"),
    "workday": ('{"jobPostings":[{"title":"@t","locationsText":"Oslo","remoteType":"Fully Remote","externalPath":"/job/@n"},{"title":""},{"title":"Two"}]}', "@t", "Oslo", True, "", "https://acme.wd5.myworkdayjobs.com/Site/job/@n"),
    "bamboohr": ('{"result":[{"id":"@n","jobOpeningName":"@t","location":{"city":"Waco","state":"TX"},"isRemote":null,"locationType":"1"},{"id":"2"},{"id":"3","jobOpeningName":"Two"}]}', "@t", "Waco, TX", True, "", "https://acme.wd5/Site.bamboohr.com/careers/@n"),
    "dover": ('{"results":[{"title":"@t","locations":[{"name":null,"location_type":"REMOTE"}]},{"title":""},{"title":"Two","locations":[]}]}', "@t", "REMOTE", True, "", ""),
    "smartrecruiters": ('{"content":[{"name":"@t","location":{"city":"Lyon","country":"fr","remote":false}},{"name":""},{"name":"Two"}]}', "@t", "Lyon, fr", False, "", ""),
    "recruitee": ('{"offers":[{"title":"@t","location":"Gent","remote":true,"description":"<p>a</p>b","careers_url":"https://o/@n"},{"title":""},{"title":"Two"}]}', "@t", "Gent", True, "a b", "https://o/@n"),
    "breezy": ('[{"name":"@t","location":{"name":"Kiel","is_remote":false},"url":"https://b/@n"},{"name":""},{"name":"Two"}]', "@t", "Kiel", False, "", "https://b/@n"),
    "teamtailor": ("<rss><channel><item><title>@t</title><description>hey</description><link>https://t/@n</link></item><item><title></title></item><item><title>Two</title></item></channel></rss>", "@t", "", False, "hey", "https://t/@n"),
    "personio": ("<workzag-jobs><position><name>@t</name><office>Graz</office><jobDescriptions><jobDescription><value>v1</value></jobDescription><jobDescription><value>v2</value></jobDescription></jobDescriptions></position><position><office>x</office></position><position><name>Two</name></position></workzag-jobs>", "@t", "Graz", False, "v1 v2", ""),
}
_WANTED = [(k, b, *[str(x).replace("True", "true").replace("False", "false") for x in row[1:]]) for k, (b, row) in enumerate(BODIES.items())]


@query(
    "job_feeds",
    f"""WITH {sql_values(_WANTED, "wanted", "k, shape, title, location, remote, description, url")}, p AS (SELECT 'd' || p_partkey AS domain, p_name, p_partkey, shape, wanted.* EXCLUDE (k, shape) FROM part JOIN wanted ON k = p_partkey % {len(BODIES)})
    SELECT domain, shape, 0 AS job_no, p_name AS title, location, CAST(remote AS BOOLEAN) AS remote, description, replace(url, '@n', CAST(p_partkey AS VARCHAR)) AS url FROM p
    UNION ALL SELECT domain, shape, 1, 'Two', '', FALSE, '', CASE shape WHEN 'workday' THEN 'https://acme.wd5.myworkdayjobs.com/Site' WHEN 'bamboohr' THEN 'https://acme.wd5/Site.bamboohr.com/careers/3' ELSE '' END FROM p""",
)
def job_feeds(spark, sf_dir):
    """The feeds of all boards, each built from a part's name; what is read out is known from how they are built."""
    n = F.col("p_partkey")
    body = F.replace(F.replace(chosen([b for b, *_ in BODIES.values()], n), F.lit("@t"), F.col("p_name")), F.lit("@n"), n.cast("string"))
    feeds = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("d"), n.cast("string")).alias("domain"), chosen(list(BODIES), n).alias("shape"), F.lit("acme.wd5/Site").alias("account"), body.alias("body"))
    return files.parse_feeds(feeds).join(feeds.select("domain", "shape"), "domain").select("domain", "shape", "job_no", "title", "location", "remote", "description", "url")
