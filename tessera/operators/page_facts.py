"""Facts read off a company's pages and job posts.

pages: domain, page_no (order of pages), kind, text, html; jobs: domain, job_no, title, description, remote. Patterns are
unrolled to expressions, so each text is scanned where it lies; only short hits are shuffled, folded by domain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import page_rules as P
from tessera.functions import scalars as S
from tessera.operators.fingerprints import guarded


def around(text: Column, pattern: str, width: int = 90) -> Column:
    """The first match with up to width characters on either side; empty without one."""
    flags, body = ("(?is)", pattern[4:]) if pattern.startswith("(?i)") else ("(?s)", pattern)
    # The plain test goes first: looking for a match with its surroundings is slow where there is none.
    return F.when(text.rlike(pattern), F.regexp_extract(text, rf"{flags}.{{0,{width}}}?(?:{body}).{{0,{width}}}", 0)).otherwise("")


def hits(cells: list[Column], *keep: str) -> Column:
    """Rows of the cells (structs with a value) that have one."""
    return F.explode(F.filter(F.array(*cells), lambda c: c["value"].isNotNull()))


def shown(how: str, pattern: str) -> Column:
    """Whether page code shows a gateway's method. A key of Stripe's shape counts where nothing near it names another owner."""
    found = guarded(F.col("html"), "(?i)" + pattern)
    return found & ~around(F.col("html"), "(?i)" + pattern, 60).rlike(P.NOT_STRIPE_KEY) if how == P.KEY_METHOD else found


def gateways(pages: DataFrame) -> DataFrame:
    """(domain, gateway, methods, page_no): payment gateways in page code, the methods in the rules' order and the first page."""
    cells = [F.when(shown(how, p), F.struct(F.lit(g).alias("gateway"), F.lit(k).alias("k"), F.lit(how).alias("how"))) for k, (g, how, p) in enumerate(P.GATEWAYS)]
    found = pages.select("domain", "page_no", F.explode(F.array_compact(F.array(*cells))).alias("c")).select("domain", "page_no", "c.*")
    methods = F.transform(F.array_sort(F.collect_set(F.struct("k", "how"))), lambda x: x["how"])
    return found.groupBy("domain", "gateway").agg(F.array_join(methods, "; ").alias("methods"), F.min("page_no").alias("page_no"))


def tools(pages: DataFrame, jobs: DataFrame) -> DataFrame:
    """(domain, tool, value): yes or check, by the strongest sign: page code, a statement on a legal page, a job post, any
    other mention. The first legal page and the first job that name a tool speak for their kind."""
    in_page = []
    for name, raw, text in P.TOOLS:
        code = [p for g, how, p in P.GATEWAYS if g == name and how != P.KEY_METHOD]
        code = guarded(F.col("html"), "(?i)" + "|".join(code)) if code else F.lit(False)
        for how, p in [(how, p) for g, how, p in P.GATEWAYS if g == name and how == P.KEY_METHOD]:
            code = code | shown(how, p)
        code = (code | guarded(F.col("html"), raw)) if raw else code
        named = guarded(F.col("text"), text)
        near = around(F.col("text"), text)
        used = F.when(F.col("kind").isin(*P.USAGE_KINDS) & named, F.when(near.rlike(P.INTEGRATION) | near.rlike(P.DONATION), "check").otherwise("yes"))
        other = F.col("kind").isin(*P.MENTION_KINDS) & named
        cell = F.struct(F.lit(name).alias("tool"), code.alias("code"), used.alias("used"), other.alias("other"))
        in_page.append(F.when(code | used.isNotNull() | other, cell))
    seen = pages.select("domain", "page_no", F.explode(F.array_compact(F.array(*in_page))).alias("c")).select("domain", "page_no", "c.*")
    seen = seen.groupBy("domain", "tool").agg(F.max("code").alias("code"), F.min_by("used", F.when(F.col("used").isNotNull(), F.col("page_no"))).alias("used"), F.max("other").alias("other"))
    in_job = []
    for name, _, text in P.TOOLS:
        near = F.when(F.col("description").rlike(text), around(F.col("description"), text)).otherwise(around(F.col("title"), text))
        role = F.col("title").rlike(P.FINANCE_ROLE) | F.col("title").rlike(P.OPERATIONS_ROLE) | F.col("title").rlike(P.PEOPLE_ROLE)
        value = F.when(role | near.rlike(P.USAGE), "yes").otherwise("check")
        in_job.append(F.when(F.col("description").rlike(text) | F.col("title").rlike(text), F.struct(F.lit(name).alias("tool"), value.alias("said"))))
    posted = jobs.select("domain", "job_no", F.explode(F.array_compact(F.array(*in_job))).alias("c")).select("domain", "job_no", "c.*")
    posted = posted.groupBy("domain", "tool").agg(F.min_by("said", "job_no").alias("said"))
    value = F.when(F.col("code"), "yes").when(F.col("used") == "yes", "yes").otherwise(F.coalesce("said", "used", F.when(F.col("other"), "check")))
    return seen.join(posted, ["domain", "tool"], "full").select("domain", "tool", value.alias("value"))


def tool_facts(found: DataFrame) -> DataFrame:
    """(domain, sid, value) of the facts that tools decide."""
    pairs = F.explode(F.array(*[F.struct(F.lit(sid).alias("sid"), F.lit(t).alias("name")) for sid, names in P.TOOL_FACTS.items() for t in names]))
    rows = found.select("domain", "tool", "value", pairs.alias("p")).where(F.col("tool") == F.col("p.name"))
    return rows.groupBy("domain", F.col("p.sid").alias("sid")).agg(F.max("value").alias("value"))  # yes is after check


def competitor_facts(pages: DataFrame, jobs: DataFrame) -> DataFrame:
    """(domain, sid, value): F4 and W10 by competing products in job posts (own use) and on pages (mentions)."""
    cells = []
    for name, text in P.COMPETITORS:
        near = F.when(F.col("description").rlike(text), around(F.col("description"), text)).otherwise(around(F.col("title"), text))
        cells.append(F.when((F.col("description").rlike(text) | F.col("title").rlike(text)) & ~near.rlike(P.INTEGRATION), F.lit(name)))
    used = jobs.select("domain", F.explode(F.array_distinct(F.array_compact(F.array(*cells)))).alias("name")).withColumn("used", F.lit(True))
    named = pages.where(F.col("kind").isin(*P.MENTION_KINDS) & F.col("text").rlike(P.COMPETITORS[0][1])).select("domain", F.lit(P.COMPETITORS[0][0]).alias("name"), F.lit(False).alias("used"))
    seen = used.unionByName(named).groupBy("domain", "name").agg(F.max("used").alias("used"))
    f4 = seen.where(F.col("name") == "QuickBooks Online").select("domain", F.lit("F4").alias("sid"), F.when(F.col("used"), "yes").otherwise("check").alias("value"))
    w10 = seen.where(F.col("used") & F.col("name").isin("NetSuite", "QuickBooks Enterprise")).select("domain", F.lit("W10").alias("sid"), F.lit("check").alias("value")).distinct()
    return f4.unionByName(w10)


#: Portable rules over what is known of a company's jobs; unset where nothing is said.
JOB_FACTS = {
    "F12": "CASE WHEN n_jobs >= 3 THEN 'yes' ELSE 'no' END",
    "B3": "CASE WHEN n_jobs >= 3 THEN 'yes' ELSE 'no' END",
    "B4": "CASE WHEN finance THEN 'yes' END",
    "B5": "CASE WHEN operations THEN 'yes' END",
    "B9": "CASE WHEN bookkeeper THEN 'check' END",
    "B14": "CASE WHEN audit THEN 'yes' END",
    "W7": "CASE WHEN making THEN 'check' END",
    "W12": "CASE WHEN sheets AND NOT has_tool THEN 'check' END",
    "F16": "CASE WHEN n_remote >= greatest(1, n_jobs // 2) OR remote_site THEN 'yes' END",
    "S3": "CASE WHEN behind THEN 'yes' WHEN maybe_behind THEN 'check' END",
    "S4": "CASE WHEN books THEN 'yes' END",
}
#: What is known of a job, by its title and description.
JOB_FLAGS = {
    "finance": (("title", P.FINANCE_ROLE),),
    "operations": (("title", P.OPERATIONS_ROLE),),
    "bookkeeper": (("title", "(?i)bookkeep"),),
    "audit": (("title", P.FINANCE_ROLE), ("description", P.AUDIT)),
    "making": (("title", P.MAKING_ROLE),),
    "sheets": (("description", P.SPREADSHEETS),),
    "books": (("title", P.BOOKS_ROLE),),
    "behind": (("title", P.FINANCE_ROLE + "|" + P.BOOKS_ROLE[4:]), ("description", P.BOOKS_BEHIND)),
}


def job_facts(jobs: DataFrame, pages: DataFrame, found: DataFrame) -> DataFrame:
    """(domain, sid, value) of facts by job posts; found: the tools of each domain."""
    flags = {}
    for name, tests in JOB_FLAGS.items():
        test = F.lit(True)
        for column, pattern in tests:
            test = test & F.col(column).rlike(pattern)
        flags[name] = test
    flags["maybe_behind"] = around(F.col("description"), P.BOOKS_BEHIND, 80).rlike("(?i)book|account|reconcil")
    known = jobs.groupBy("domain").agg(F.count(F.lit(1)).alias("n_jobs"), F.count_if("remote").alias("n_remote"), *[F.max(c).alias(n) for n, c in flags.items()])
    _, _, remote = P.PAGE_FLAGS["remote"]
    site = pages.where(F.col("kind").isin(*P.PAGE_FLAGS["remote"][0]) & F.col("text").rlike(remote)).select("domain").distinct().withColumn("remote_site", F.lit(True))
    proven = found.where("value = 'yes'").select("domain").distinct().withColumn("has_tool", F.lit(True))
    known = known.join(site, "domain", "left").join(proven, "domain", "left").fillna(False, ["remote_site", "has_tool"])
    return as_facts(known, JOB_FACTS)


def as_facts(known: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(domain, sid, value) of the portable rules over a row of flags for each domain."""
    cells = [F.struct(F.lit(sid).alias("sid"), F.expr(rule.replace("//", "div")).alias("value")) for sid, rule in rules.items()]
    return known.select("domain", hits(cells).alias("c")).select("domain", "c.sid", "c.value")


#: Portable rules over page flags and gateways.
PAGE_FACTS = {
    "M2": "CASE WHEN parked THEN 'no' WHEN n_pages >= 3 OR home_chars > 1500 THEN 'yes' ELSE 'check' END",
    "F8": """CASE WHEN has_pricing THEN CASE WHEN priced THEN 'yes' WHEN contact_priced THEN 'no' ELSE 'check' END
        WHEN priced_elsewhere THEN 'check' WHEN contact_only THEN 'no' WHEN pricing_words THEN 'check' ELSE 'no' END""",
    "W6": "CASE WHEN foreign_price AND dollar_price THEN 'check' WHEN currency_switch THEN 'check' END",
    "M4": "CASE WHEN priced OR checkout OR app_listing THEN 'yes' WHEN waitlist THEN 'no' END",
    "W5": "CASE WHEN waitlist AND NOT (priced OR checkout OR app_listing) THEN 'yes' END",
    "S2": "CASE WHEN marketplace_self THEN 'yes' WHEN pays_out THEN 'check' END",
    "S5": "CASE WHEN own_books THEN 'yes' END",
    "S9": "CASE WHEN n_processors + CASE WHEN whop THEN 1 ELSE 0 END >= 2 THEN 'yes' END",
    "S10": "CASE WHEN billed OR recurring_price OR membership THEN 'yes' END",
    "S11": "CASE WHEN field_software THEN 'yes' END",
    "F17": "CASE WHEN holding THEN 'check' END",
    "F18": "CASE WHEN launch_link THEN 'yes' END",
    "E3": "CASE WHEN accounting_firm THEN 'check' END",
    "E5": "CASE WHEN tax_exempt THEN 'check' END",
    "E6": "CASE WHEN (store_platform OR cart) AND (stock OR shipping) AND NOT printed AND NOT digital THEN 'yes' WHEN store_platform OR cart THEN 'check' END",
    "W9": "CASE WHEN store_platform AND NOT ((stock OR shipping) AND NOT printed AND NOT digital) THEN CASE WHEN printed OR digital THEN 'yes' ELSE 'check' END END",
    "W1": "CASE WHEN service_area THEN 'check' END",
    "W3": "CASE WHEN opening_hours THEN 'check' END",
}


def page_facts(pages: DataFrame) -> DataFrame:
    """(domain, sid, value) of facts by what pages say and load. Texts stay where they are: flags are folded by domain."""
    def flag(kinds, column, pattern, unless=None):
        found = guarded(F.col(column), pattern)
        if unless:
            found = found & ~around(F.col(column), pattern, 80).rlike(unless)
        return F.max(F.col("kind").isin(*kinds) & found if kinds else found)

    known = pages.groupBy("domain").agg(
        *[flag(*rule).alias(name) for name, rule in P.PAGE_FLAGS.items()], F.count(F.lit(1)).alias("n_pages"), F.max(F.when(F.col("kind") == "home", F.char_length("text")).otherwise(0)).alias("home_chars")
    )
    has = lambda names: F.max(F.col("gateway").isin(*names))
    paid = gateways(pages).groupBy("domain").agg(
        F.count_if(F.col("gateway").isin(*P.PROCESSORS)).alias("n_processors"), has(P.SUBSCRIPTION_BILLING).alias("billed"), F.max(F.col("methods").contains("Stripe Connect")).alias("pays_out")
    )
    known = known.join(paid, "domain", "left").fillna(0, ["n_processors"]).fillna(False, ["billed", "pays_out"])
    return as_facts(known, PAGE_FACTS)


#: Portable rules over clues of place and legal form.
PLACE_FACTS = {
    "M1": "CASE WHEN us THEN 'yes' WHEN n_foreign >= 2 AND strong_foreign THEN 'no' WHEN n_foreign > 0 THEN 'check' END",
    "E4": "CASE WHEN us AND n_foreign >= 2 THEN 'check' WHEN us THEN 'no' WHEN n_foreign >= 2 AND strong_foreign THEN 'yes' WHEN n_foreign > 0 THEN 'check' END",
    "F3": "CASE WHEN form IS NULL THEN NULL WHEN form = 'delaware corporation' THEN 'yes' ELSE 'no' END",
    "S1": "CASE WHEN sole_self THEN 'yes' WHEN form IS NOT NULL THEN 'no' END",
    "S12": "CASE WHEN years BETWEEN 10 AND 150 THEN 'yes' END",
}
ADDRESS_KINDS, LAW_KINDS = ("terms", "privacy", "legal", "contact", "about", "security"), ("terms", "legal", "privacy")


def place_facts(pages: DataFrame, year: int, countries: DataFrame | None = None) -> DataFrame:
    """(domain, sid, value) by addresses, governing law, legal form and stated age; year: the current one; countries (domain,
    us_country, foreign_country): what structured data says."""
    law, text = F.col("kind").isin(*LAW_KINDS), F.col("text")
    state, kind = F.lower(F.regexp_extract(text, P.STATE_ENTITY, 1)), F.lower(F.regexp_extract(text, P.STATE_ENTITY, 2))
    form = F.when(law & text.rlike(P.STATE_ENTITY), F.when((state == "delaware") & ~kind.contains("benefit") & ~kind.contains("limited"), "delaware corporation").otherwise(kind))
    since, told = F.regexp_extract(text, P.SINCE_YEAR, 1), F.regexp_extract(text, P.YEARS_IN_BUSINESS, 1)
    age = F.when(F.col("kind").isin("home", "about", "contact"), F.coalesce(F.lit(year) - since.try_cast("int"), told.try_cast("int")))
    _, _, sole = P.PAGE_FLAGS["sole_self"]
    own = F.lower(F.element_at(F.split("domain", r"\."), -1)).isin(*P.COUNTRY_DOMAINS)
    known = pages.groupBy("domain").agg(
        F.max((F.col("kind").isin(*ADDRESS_KINDS) & text.rlike(P.US_ADDRESS)) | (law & text.rlike(P.US_LAW)) | (law & text.rlike(P.STATE_ENTITY))).alias("us"),
        F.max(law & text.rlike(P.FOREIGN_LAW)).alias("foreign_law"),
        F.max(F.col("kind").isin("contact", "legal") & text.rlike(P.FOREIGN_PLACE)).alias("foreign_place"),
        F.max(own).alias("country_domain"),
        F.min_by(form, F.when(form.isNotNull(), F.col("page_no"))).alias("form"),
        F.max(F.col("kind").isin(*P.PAGE_FLAGS["sole_self"][0]) & text.rlike(sole)).alias("sole_self"),
        F.max(age).alias("years"),
    )
    if countries is None:
        known = known.withColumns({"us_country": F.lit(False), "foreign_country": F.lit(False)})
    else:
        known = known.join(countries.select("domain", "us_country", "foreign_country"), "domain", "left").fillna(False, ["us_country", "foreign_country"])
    clues = sum(F.col(c).cast("int") for c in ("foreign_law", "foreign_place", "country_domain", "foreign_country"))
    return as_facts(known.withColumns({"us": F.col("us") | F.col("us_country"), "n_foreign": clues, "strong_foreign": F.col("foreign_law") | F.col("foreign_country")}), PLACE_FACTS)


def headcount_facts(leads: DataFrame, pages: DataFrame) -> DataFrame:
    """(domain, people, s7, s8) by the list's number, else by what the site says of its team."""
    told = F.coalesce(*[F.regexp_extract("text", P.OWN_HEADCOUNT, k).try_cast("long") for k in (1, 2)])
    rank = F.when(F.col("kind") == "about", 0).when(F.col("kind") == "home", 1).when(F.col("kind") == "careers", 2)
    said = pages.where(rank.isNotNull() & told.isNotNull()).groupBy("domain").agg(F.min_by(told, rank).alias("told"))
    listed = F.regexp_replace(F.regexp_extract("employees", r"[0-9][0-9,]*", 0), ",", "").try_cast("long")
    people = leads.join(said, "domain", "left").select("domain", F.coalesce(listed, "told").alias("people")).where("people is not null")
    return people.select("domain", "people", F.when(F.col("people") >= 100, "yes").otherwise("no").alias("s7"), F.when(F.col("people").between(50, 99), "yes").otherwise("no").alias("s8"))


def job_boards(pages: DataFrame) -> DataFrame:
    """(domain, board, account): the first account of each board that a company's pages link to, none that is a path word."""
    cells = []
    for board, pattern in P.BOARDS:
        able = F.filter(F.regexp_extract_all("html", F.lit("(?i)" + pattern), F.lit(1)), lambda x: ~F.lower(x).isin(*P.NO_ACCOUNTS))
        cells.append(F.struct(F.lit(board).alias("board"), F.get(able, F.lit(0)).alias("value")))
    found = pages.select("domain", "page_no", hits(cells).alias("c")).select("domain", "page_no", "c.*")
    return found.groupBy("domain", "board").agg(F.min_by("value", "page_no").alias("account"))


def dns_facts(records: DataFrame) -> DataFrame:
    """(domain, tools, verified_with, spf_includes, email) from records (domain, record_no, kind: TXT or MX, record)."""
    low = F.lower("record")
    txt = F.col("kind") == "TXT"
    tool = F.array_compact(F.array(*[F.when(txt & low.rlike(p), F.lit(t)) for t, p in P.TXT_TOOLS]))
    mail = F.coalesce(*[F.when((F.col("kind") == "MX") & low.contains(key), F.lit(name)) for key, name in P.MAIL])
    verified = F.when(txt, F.nullif(F.regexp_extract(low, P.VERIFIED, 1), F.lit("")))
    spf = F.when(txt & low.startswith("v=spf1"), F.regexp_extract_all("record", F.lit(P.SPF_INCLUDE), F.lit(1))).otherwise(F.array().cast("array<string>"))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), "; ")
    return records.groupBy("domain").agg(
        joined(F.flatten(F.collect_set(tool))).alias("tools"), joined(F.collect_set(verified)).alias("verified_with"),
        joined(F.flatten(F.collect_set(spf))).alias("spf_includes"), F.coalesce(F.min_by(mail, F.when(mail.isNotNull(), F.col("record_no"))), F.lit("")).alias("email"),
    )


#: Portable rules over flags of a company's sentences.
SENTENCE_FACTS = {
    "F15": "CASE WHEN own_metric THEN 'yes' WHEN metric THEN 'check' END",
    "E1": "CASE WHEN late_round OR late_money OR ticker THEN 'yes' END",
    "F11": "CASE WHEN yc THEN 'yes' WHEN yc_named THEN 'check' END",
}
SENTENCE_KINDS = ("home", "about", "customers", "blog", "careers")


def sentence_facts(pages: DataFrame) -> DataFrame:
    """(domain, sid, value) of facts that single sentences tell: growth in numbers, a late stage, an accelerator. pages have
    company: a sentence is a company's own if it says we or names it."""
    rows = pages.where(F.col("kind").isin(*SENTENCE_KINDS)).select("domain", "company", F.explode(S.sentences_of(F.regexp_replace("text", r"\s+", " "))).alias("s")).where(F.length("s") <= 400)
    s = F.col("s")
    own = s.rlike(P.FIRST_PERSON) | S.names_word(s, F.col("company"))
    metric = s.rlike(P.METRIC) & ~s.rlike(P.NOT_OWN_METRIC)
    flags = {
        "own_metric": metric & own, "metric": metric, "late_round": own & s.rlike(P.LATE_ROUND) & s.rlike(P.ROUND_WORDS) & ~s.rlike(S.NOT_OWN_MONEY), "late_money": S.late_stage_label(s, F.col("company")).isNotNull(),
        "ticker": s.rlike(P.TICKER), "yc": s.rlike(P.YC_STRONG), "yc_named": s.rlike(P.YC_NAMED),
    }
    return as_facts(rows.groupBy("domain").agg(*[F.max(c).alias(n) for n, c in flags.items()]), SENTENCE_FACTS)
