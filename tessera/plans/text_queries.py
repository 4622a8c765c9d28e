"""Queries over text: names and domains, page kinds, pattern joins, sentences, money and dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.config import sql_values
from tessera.plans.registry import query


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


DOMAIN_SQL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^[a-z]+://', ''), '[/?#:].*$', ''), '^www\.', ''), '^\.+|\.+$', '', 'g')"""


@query("normalize_domain", rf"SELECT page_id, CASE WHEN regexp_full_match(d, '[a-z0-9-]+(\.[a-z0-9-]+)+') THEN d END AS domain FROM (SELECT page_id, {DOMAIN_SQL} AS d FROM pages)")
def normalize_domain(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", S.normalize_domain(F.col("url")).alias("domain"))


NAME_KEY_SQL = rf"""regexp_replace(regexp_replace(trim(regexp_replace(replace(regexp_replace(lower(%s), '\([^\n]*?\)', ' ', 'g'), '&', ' and '), '[^a-z0-9]+', ' ', 'g')), '^(the( |$))+', ''), '(?:(?:^| )(?:inc|incorporated|corp|corporation|co|llc|lc|ltd|limited|pbc|plc|lp|llp|org|the))+$', '')"""


@query("name_key", f"SELECT p_partkey, {NAME_KEY_SQL % repr('The ').replace(repr('The '), chr(39) + 'The ' + chr(39) + ' || p_name || ' + chr(39) + ' & Sons (US), Inc. LLC' + chr(39))} AS name_key FROM part")
def name_key(spark, sf_dir):
    name = F.concat(F.lit("The "), "p_name", F.lit(" & Sons (US), Inc. LLC"))
    return read(spark, sf_dir, "part").select("p_partkey", S.name_key(name).alias("name_key"))


@query(
    "text_scalars",
    r"""SELECT doc_id, md5(text) AS text_hash, length(trim(regexp_replace(text, '[ \t\r\n\f]+', ' ', 'g'))) AS squeezed_chars,
      substr(regexp_replace(regexp_replace(lower(source || ' ' || lang || '!'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40) AS slug,
      regexp_replace(lower(source || '-' || lang), '[^a-z0-9]', '', 'g') AS bare,
      CASE WHEN n_chars < 1024 THEN n_chars || ' B' ELSE printf('%.1f', round(n_chars / 1024.0::DOUBLE, 1)) || ' KB' END AS size_text FROM documents""",
)
def text_scalars(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs.select(
        "doc_id", F.md5(F.col("text").cast("binary")).alias("text_hash"), F.length(S.squeezed(F.col("text"))).cast("long").alias("squeezed_chars"),
        S.slug(F.concat("source", F.lit(" "), "lang", F.lit("!"))).alias("slug"), S.bare_key(F.concat("source", F.lit("-"), "lang")).alias("bare"), S.human_bytes(F.col("n_chars")).alias("size_text"),
    )


#: Page kinds by path, the first that fits wins.
KINDS = ((1, "tracked", "utm_"), (2, "listing", "page="), (3, "article", "[.]html$"), (4, "folder", "/$"), (5, "section", "#"), (6, "plain", ""))
KIND_SQL = "CASE " + " ".join(f"WHEN regexp_matches(url, '{p}') THEN {k}" for k, _, p in KINDS) + " END"


@query(
    "page_classify",
    rf"""WITH {sql_values(list(KINDS), "kinds", "rank, kind, pattern")}, p AS (
      SELECT page_id, url, {DOMAIN_SQL} AS domain, {KIND_SQL} AS rank, len(regexp_extract_all(url, '/')) - 2 AS depth FROM pages)
    SELECT domain, k.kind, url, depth FROM (SELECT *, row_number() OVER (PARTITION BY domain, rank ORDER BY depth, length(url), url, page_id) AS n FROM p) q JOIN kinds k USING (rank) WHERE n = 1""",
)
def page_classify(spark, sf_dir):
    """The best page of each kind of each site: least depth, then shortest, then first by name."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", S.normalize_domain(F.col("url")).alias("domain"))
    kind = None
    for _, name, pattern in KINDS:
        test = F.col("url").rlike(pattern)
        kind = F.when(test, name) if kind is None else kind.when(test, name)
    found = pages.withColumn("kind", kind).withColumn("depth", (F.regexp_count("url", F.lit("/")) - 2).cast("long"))
    best = F.min_by(F.struct("url", "depth"), F.struct("depth", F.length("url").alias("n"), "url", "page_id")).alias("best")
    return found.groupBy("domain", "kind").agg(best).select("domain", "kind", "best.url", "best.depth")


@query("page_titles", r"SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS h1, len(regexp_extract_all(html, '<a href=')) AS n_links FROM pages")
def page_titles(spark, sf_dir):
    of = lambda tag: F.regexp_extract("html", f"(?s)<{tag}>(.*?)</{tag}>", 1)
    return read(spark, sf_dir, "pages").select("page_id", of("title").alias("title"), of("h1").alias("h1"), F.regexp_count("html", F.lit("<a href=")).cast("long").alias("n_links"))


@query(
    "page_links",
    r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)
    SELECT page_id, href, count(*) AS n FROM l GROUP BY page_id, href""",
)
def page_links(spark, sf_dir):
    links = read(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href"))
    return links.groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n"))


#: Rule rows of a pattern join: a literal that must be there, and the pattern. Rules are few by nature.
RULES = (("phone", "+", r"[+][0-9]+ [(]?[0-9]{3}"), ("email", "@", "[a-z]+@[a-z]+[.][a-z]+"), ("address", ".", "[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}"), ("token", "token", 'token = "[0-9a-f]+"'), ("marked", "###", "###"), ("shout", "!!", "[A-Z]{4,}!!"))


@query(
    "pattern_join_rules",
    "WITH " + sql_values(list(RULES), "rules", "rule, needs, pattern") + " SELECT doc_id, rule, regexp_extract(text, pattern) AS hit FROM documents JOIN rules ON contains(text, needs) AND regexp_matches(text, pattern)",
)
def pattern_join_rules(spark, sf_dir):
    """Text against a rule table. The rules are unrolled to expressions, so texts are scanned once, where they lie."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    hit = lambda needs, p: F.when(F.col("text").contains(needs) & F.col("text").rlike(p), F.regexp_extract("text", p, 0))
    cells = F.array(*[F.struct(F.lit(r).alias("rule"), hit(needs, p).alias("hit")) for r, needs, p in RULES])
    return docs.select("doc_id", F.explode(F.filter(cells, lambda c: c["hit"].isNotNull())).alias("c")).select("doc_id", "c.rule", "c.hit")


@query(
    "rule_hit_counts",
    "WITH " + sql_values(list(RULES), "rules", "rule, needs, pattern") + " SELECT rule, source, count(*) AS n FROM documents JOIN rules ON contains(text, needs) AND regexp_matches(text, pattern) GROUP BY rule, source",
)
def rule_hit_counts(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "source")
    return pattern_join_rules(spark, sf_dir).join(docs, "doc_id").groupBy("rule", "source").agg(F.count(F.lit(1)).alias("n"))


SENTENCES_SQL = r"""sent AS (
  SELECT doc_id, unnest(parts) AS sentence, generate_subscripts(parts, 1) AS place
  FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])[ \n]+', '\1|#|', 'g'), '|#|') AS parts FROM documents))"""


def sentences(spark, sf_dir) -> DataFrame:
    marked = F.regexp_replace("text", r"([.!?])[ \n]+", "$1|#|")
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(marked, r"\|#\|")).alias("place", "sentence")).withColumn("place", F.col("place") + 1)


@query("sentence_metric", f"WITH {SENTENCES_SQL} SELECT doc_id, count(*) AS n_sentences, max(length(sentence)) AS longest, count(*) FILTER (length(sentence) < 20) AS short FROM sent GROUP BY doc_id")
def sentence_metric(spark, sf_dir):
    n = F.length("sentence")
    return sentences(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.max(n).cast("long").alias("longest"), F.count_if(n < 20).alias("short"))


@query(
    "excerpt_running_cut",
    f"""WITH {SENTENCES_SQL}, r AS (SELECT *, coalesce(sum(length(sentence)) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sent WHERE length(sentence) < 400)
    SELECT doc_id, string_agg(sentence, ' ' ORDER BY place) AS excerpt FROM r WHERE before < 600 GROUP BY doc_id""",
)
def excerpt_running_cut(spark, sf_dir):
    """Sentences of a text until 600 characters are full."""
    before = F.coalesce(F.sum(F.length("sentence")).over(Window.partitionBy("doc_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = sentences(spark, sf_dir).where(F.length("sentence") < 400).withColumn("before", before).where("before < 600")
    return kept.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "sentence"))), lambda x: x["sentence"]), " ").alias("excerpt"))


@query(
    "first_hit_by_page_order",
    r"""WITH h AS (SELECT conv_id, turn, regexp_extract(text, '[A-Za-z]*ing\b') AS hit FROM conversations)
    SELECT conv_id, turn, hit FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM h WHERE hit <> '') WHERE n = 1""",
)
def first_hit_by_page_order(spark, sf_dir):
    found = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_extract("text", r"[A-Za-z]*ing\b", 0).alias("hit")).where("hit <> ''")
    return found.groupBy("conv_id").agg(F.min_by(F.struct("turn", "hit"), "turn").alias("x")).select("conv_id", "x.turn", "x.hit")


MONEY = "concat('raised $', cast(o_orderkey % 900 AS varchar(10)), '.5 ', CASE WHEN o_orderkey % 3 = 0 THEN 'million' WHEN o_orderkey % 3 = 1 THEN 'billion' ELSE 'k' END, ' on ', cast(cast(o_orderdate AS date) AS varchar(20)), ' and 2001-02-30')"


@query(
    "money_late_stage",
    f"""WITH t AS (SELECT o_orderkey, {MONEY} AS line FROM orders), m AS (
      SELECT o_orderkey, TRY_CAST(regexp_extract(line, '[$]([0-9.]+) (million|billion|k)', 1) AS DOUBLE) * CASE regexp_extract(line, '[$]([0-9.]+) (million|billion|k)', 2) WHEN 'million' THEN 1e6 WHEN 'billion' THEN 1e9 ELSE 1e3 END AS usd FROM t)
    SELECT o_orderkey, usd, usd >= 100000000 AS late FROM m""",
)
def money_late_stage(spark, sf_dir):
    usd = S.money_usd(F.expr(MONEY))
    return read(spark, sf_dir, "orders").select("o_orderkey", usd.alias("usd"), (usd >= 1e8).alias("late"))


@query(
    "dates_in_text",
    f"""WITH t AS (SELECT o_orderkey, unnest(regexp_extract_all({MONEY}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')) AS d FROM orders)
    SELECT o_orderkey, count(TRY_CAST(d AS DATE)) AS n_valid, CAST(max(TRY_CAST(d AS DATE)) AS VARCHAR) AS last FROM t GROUP BY o_orderkey""",
)
def dates_in_text(spark, sf_dir):
    dates = S.iso_dates(F.expr(MONEY))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.size(dates).cast("long").alias("n_valid"), F.array_max(dates).cast("string").alias("last"))


@query(
    "name_match_ladder",
    rf"""WITH d AS (SELECT s_suppkey AS ein, s_nationkey AS state, {NAME_KEY_SQL % "'The ' || regexp_replace(s_name, 'Supplier#0*', 'Firm ') || ', Inc.'"} AS k FROM supplier),
    l AS (SELECT c_custkey, c_nationkey AS state, {NAME_KEY_SQL % "'Firm ' || (c_custkey % 400) || ' LLC'"} AS k FROM customer),
    c AS (SELECT l.c_custkey, d.ein, l.state = d.state AS same_state, count(*) OVER (PARTITION BY l.c_custkey) AS n,
      row_number() OVER (PARTITION BY l.c_custkey ORDER BY (l.state = d.state) DESC, d.ein) AS r FROM l JOIN d USING (k))
    SELECT l.c_custkey, c.ein, CASE WHEN c.ein IS NULL THEN 'none' WHEN same_state THEN 'strong' WHEN n = 1 THEN 'medium' ELSE 'weak' END AS match
    FROM l LEFT JOIN c ON c.c_custkey = l.c_custkey AND r = 1""",
)
def name_match_ladder(spark, sf_dir):
    """Leads against a directory by normal name: same place first, then first listed; how sure the match is."""
    listed = read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("ein"), F.col("s_nationkey").alias("d_state"), S.name_key(F.concat(F.lit("The "), F.regexp_replace("s_name", "Supplier#0*", "Firm "), F.lit(", Inc."))).alias("k")
    )
    own = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("state"), S.name_key(F.concat(F.lit("Firm "), (F.col("c_custkey") % 400).cast("string"), F.lit(" LLC"))).alias("k"))
    same = F.col("state") == F.col("d_state")
    best = own.join(listed, "k").groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct((~same).alias("other"), "ein")).alias("b"))
    match = F.when(F.col("b").isNull(), "none").when(~F.col("b.other"), "strong").when(F.col("n") == 1, "medium").otherwise("weak")
    return own.select("c_custkey").join(best, "c_custkey", "left").select("c_custkey", F.col("b.ein").alias("ein"), match.alias("match"))


@query(
    "directory_prefix_match",
    r"""SELECT c_custkey, s_suppkey, CASE WHEN starts_with(regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g'), 'supplier00') THEN 'strong' ELSE 'weak' END AS match
    FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey AND s_nationkey = c_nationkey""",
)
def directory_prefix_match(spark, sf_dir):
    joined = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "supplier"), (F.col("s_suppkey") == F.col("c_custkey")) & (F.col("s_nationkey") == F.col("c_nationkey")), "left")
    return joined.select("c_custkey", "s_suppkey", F.when(S.bare_key(F.col("s_name")).startswith("supplier00"), "strong").otherwise("weak").alias("match"))


@query(
    "split_names",
    r"""SELECT p_partkey, split_part(trim(p_name), ' ', 1) AS first_name, trim(substr(trim(p_name), length(split_part(trim(p_name), ' ', 1)) + 1)) AS other_names FROM part""",
)
def split_names(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", S.first_name(F.col("p_name")).alias("first_name"), S.other_names(F.col("p_name")).alias("other_names"))


@query(
    "hashes",
    "SELECT c_custkey, substr(sha1(c_name), 1, 8) AS short_sha1, md5(c_name) AS md5, sha256(c_name) AS sha256 FROM customer",
)
def hashes(spark, sf_dir):
    b = F.col("c_name").cast("binary")
    return read(spark, sf_dir, "customer").select("c_custkey", F.substring(F.sha1(b), 1, 8).alias("short_sha1"), F.md5(b).alias("md5"), F.sha2(b, 256).alias("sha256"))


#: Kinds of refusal by the first pattern that fits.
REJECTS = (("token", "token"), ("phone", "[+][0-9]"), ("shout", "[A-Z]{5,}"), ("list", " [|] "), ("symbols", "[#*$%&]{3}"))


@query("reject_kinds", "SELECT kind, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{k}'" for k, p in REJECTS) + " ELSE 'other' END AS kind FROM documents) GROUP BY kind")
def reject_kinds(spark, sf_dir):
    kind = None
    for name, pattern in REJECTS:
        kind = F.when(F.col("text").rlike(pattern), name) if kind is None else kind.when(F.col("text").rlike(pattern), name)
    return read(spark, sf_dir, "documents").groupBy(kind.otherwise("other").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "season_dates",
    r"""WITH b AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'W' WHEN 1 THEN 'S' WHEN 2 THEN 'F' ELSE 'X' END || (10 + o_orderkey % 15) AS batch FROM orders)
    SELECT o_orderkey, batch, CAST(CASE left(batch, 1) WHEN 'W' THEN make_date(2000 + CAST(substr(batch, 2) AS INT), 1, 1) WHEN 'S' THEN make_date(2000 + CAST(substr(batch, 2) AS INT), 6, 1)
      WHEN 'F' THEN make_date(2000 + CAST(substr(batch, 2) AS INT), 9, 1) END AS VARCHAR) AS starts FROM b""",
)
def season_dates(spark, sf_dir):
    letter = F.element_at(F.array(*map(F.lit, "WSFX")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    batch = F.concat(letter, (F.col("o_orderkey") % 15 + 10).cast("string"))
    return read(spark, sf_dir, "orders").select("o_orderkey", batch.alias("batch"), S.season_start(batch).cast("string").alias("starts"))


@query(
    "tax_deadline",
    """WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders), x AS (
      SELECT o_orderkey, date_diff('day', day, make_date(CAST(year(day) AS INT), 4, 15)) AS a, date_diff('day', day, make_date(CAST(year(day) AS INT), 10, 15)) AS o FROM d)
    SELECT o_orderkey, CAST(coalesce(CASE WHEN a BETWEEN 0 AND 45 THEN a END, CASE WHEN o BETWEEN 0 AND 45 THEN o END) AS BIGINT) AS days_left FROM x""",
)
def tax_deadline(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    left = [F.datediff(F.make_date(F.year(day), F.lit(m), F.lit(15)), day) for m in (4, 10)]
    return read(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(*[F.when(d.between(0, 45), d) for d in left]).cast("long").alias("days_left"))
