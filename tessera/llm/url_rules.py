"""URL filtering: fixed rules first, then association rules that Spark's FP-growth mines from labelled URLs.

A labelled URL is a transaction of its tokens and the item BAD or GOOD. Rules whose consequent is one of these two are kept
at MIN_SUPPORT, MIN_CONFIDENCE and MIN_LIFT, shares that mean the same at every size, where they are surer than chance (DOUBT);
a rule is dropped where it stays as sure without one of its items. A rule must carry over: the labelled URLs that fit it come from two registered domains or
more, and from two sources of labels or more. The surest rule that fits a URL decides (then the one of more labelled URLs,
then the least by name); where none fits the URL is allowed. Rules are matched by an inverted index: each stands under its
rarest token, and the URLs that have that token are tried for the others.

Tokens that the same labelled URLs have are one item; a rule needs all tokens of its items. All labelled URLs are learned
from. FP-growth lists every frequent set, 2 ** k of them where enough URLs share k items. So where a labelled URL has more than
MOST_ITEMS items, the sets are grown item by item instead (sparing_sets), and only those from which a rule can be kept: the
rules are the same.

The op7 query has no labels of pages (labels.doc_id names documents), so it learns from the pages that the fixed rules
decide: block is BAD, allow is GOOD, the fixed rule is the source. What a fixed rule names itself, its host's labels and its
path's words, is no token to learn: else one rule on a language of one host would block that language everywhere.

Defined cases: a null url or one without "://" has empty host and path, no token and the verdict allow; of several labels
of one url the worst counts, and copies of a url are one transaction; repeated pages are judged each; an empty table gives
an empty result, without labels nothing is mined; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, discarded, saved

#: (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
BAD, GOOD = "label=bad", "label=good"
MIN_SUPPORT = 0.01
MIN_CONFIDENCE = 0.9
MIN_LIFT = 1.1
#: A rule is believed where its confidence, less the doubt that its number of URLs leaves at so many standard deviations, is
#: above the label's own share.
DOUBT = 2.58
#: FP-growth mines where no labelled URL has more items than this, sparing_sets elsewhere; both find the same rules.
MOST_ITEMS = 16


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null where none does."""
    found = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        this = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, this) if found is None else found.when(fits, this)
    return found


def registered_domain(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: scheme, host labels by place from the right, path words, the extension and query keys.

    Numbers in paths are one token, as they name single pages.
    """
    labels = F.filter(F.reverse(F.split(host, r"\.")), lambda x: x != "")
    placed = F.transform(labels, lambda x, i: F.concat(F.lit("host"), F.least(i, F.lit(3)).cast("string"), F.lit("="), x))
    words = F.transform(F.filter(F.split(F.lower(path), r"[/._\-]+"), lambda x: x != ""), lambda x: F.concat(F.lit("path="), F.when(x.rlike("^[0-9]+$"), F.lit("#")).otherwise(x)))
    parts = F.flatten(F.transform(F.filter(placed, lambda x: x.contains("-")), lambda x: F.split(F.substring_index(x, "=", -1), "-")))
    pieces = F.transform(parts, lambda x: F.concat(F.lit("piece="), x))
    keys = F.transform(F.regexp_extract_all(url, F.lit(r"[?&]([^=&#?]+)="), F.lit(1)), lambda x: F.concat(F.lit("query="), x))
    scheme = F.array(F.concat(F.lit("scheme="), F.lower(F.substring_index(url, "://", 1))))
    every = F.array_distinct(F.concat(scheme, placed, pieces, words, keys))
    return F.when(host != "", F.filter(every, lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))


def items_of(labelled: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(url, bad, items) of all labelled URLs, and (item, tokens, n) of items that at least so many have."""
    rows = labelled.select("url", "bad", F.explode_outer("tokens").alias("token"))
    named = F.xxhash64("url")
    # Tokens of one set of URLs have equal counts, sums and xors of the URLs' hashes.
    sets = rows.where(F.col("token").isNotNull()).groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum(F.shiftright(named, 24)).alias("sum"), F.bit_xor(named).alias("xor"))
    items = sets.where(F.col("n") >= least).groupBy("n", "sum", "xor").agg(F.min("token").alias("item"), F.array_sort(F.collect_list("token")).alias("tokens"))
    items = items.select("item", "tokens", "n")
    held = rows.join(items.select("item"), F.col("token") == F.col("item"), "left").groupBy("url", "bad").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return held, items


def sparing_sets(baskets: DataFrame, least: int) -> DataFrame:
    """(items, bad, good): the sets of items that at least so many URLs of one label have, that fewer URLs have than each
    set with one item less, and no part of which is of one label alone; with the numbers of URLs.

    No other set makes a rule that is kept: one that as many URLs have as a part of it, or that holds a part of one label
    alone, is no surer than that part. Parts of such sets are such sets, so each round adds one item to those of the round
    before. Rounds go on until nothing grows.
    """
    at = F.when(F.col("bad"), 1).otherwise(0)
    # One row for each different basket and set that it holds; rest are its items after the set's last.
    held = saved(baskets.groupBy(F.col("items").alias("rest")).agg(F.sum(at).alias("bad"), F.sum(1 - at).alias("good")).select("rest", "bad", "good", F.array().cast("array<string>").alias("items")), "baskets")
    grown = saved(held.groupBy("items").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")), "sets")
    found = grown.limit(0)
    n_items = 0
    while grown.where("bad > 0 AND good > 0").count():
        n_items += 1
        mixed = grown.where("bad > 0 AND good > 0")
        more = held.join(mixed.select("items"), "items", "left_semi").select("bad", "good", "items", "rest", F.posexplode("rest").alias("k", "item"))
        more = saved(more.select(F.expr("slice(rest, k + 2, size(rest))").alias("rest"), "bad", "good", F.concat("items", F.array("item")).alias("items")), "baskets")
        counted = more.groupBy("items").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).where(F.greatest("bad", "good") >= least)
        parts = counted.select("*", F.explode("items").alias("left_out")).withColumn("part", F.array_except("items", F.array("left_out")))
        wider = mixed.select(F.col("items").alias("part"), (F.col("bad") + F.col("good")).alias("n"))
        kept = parts.join(wider, "part").groupBy("items", "bad", "good").agg(F.count(F.lit(1)).alias("parts"), F.min("n").alias("n"))
        grown_on = saved(kept.where((F.col("parts") == n_items) & (F.col("n") > F.col("bad") + F.col("good"))).select("items", "bad", "good"), "sets")
        discarded(held)
        held, grown, found = more, grown_on, found.unionByName(grown_on)
    discarded(held)
    return found


def rules_of(baskets: DataFrame, least: int, n: int, confidence: float, most: int = MOST_ITEMS) -> DataFrame:
    """(items, verdict, confidence, lift, support) of sets of items that foretell a label, from the n baskets."""
    if not baskets.where(F.size("items") > most).limit(1).count():
        labelled = baskets.select(F.concat("items", F.array(F.when(F.col("bad"), BAD).otherwise(GOOD))).alias("items"))
        # Half a URL less, as Spark rounds the share times the number of URLs up.
        model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / max(n, 1)), minConfidence=confidence).fit(labelled)
        label = F.col("consequent")[0]
        found = model.associationRules.where((F.size("consequent") == 1) & label.isin(BAD, GOOD))
        return found.select(F.array_sort("antecedent").alias("items"), F.when(label == BAD, "block").otherwise("allow").alias("verdict"), "confidence", "lift", "support")
    n_bad = baskets.where("bad").count()
    says = lambda verdict, hits, share: F.struct(F.lit(verdict).alias("verdict"), F.col(hits).alias("hits"), F.lit(share).alias("share"))
    both = sparing_sets(baskets, least).select("items", (F.col("bad") + F.col("good")).alias("n"), F.explode(F.array(says("block", "bad", n_bad / n), says("allow", "good", (n - n_bad) / n))).alias("says"))
    sure = F.col("says.hits") / F.col("n")
    both = both.where((F.col("says.hits") >= least) & (sure >= confidence))
    return both.select("items", "says.verdict", sure.alias("confidence"), (sure / F.col("says.share")).alias("lift"), (F.col("says.hits") / n).alias("support"))


def fitting(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (tokens) met with rules (key, needed) that they fit, by the inverted index."""
    return urls.withColumn("key", F.explode("tokens")).join(rules, "key").where(F.size(F.array_except("needed", "tokens")) == 0)


def mine(labelled: DataFrame, support: float = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE, lift: float = MIN_LIFT, most: int = MOST_ITEMS) -> DataFrame:
    """(rule, verdict, confidence, support, needed, key) of token sets that foretell a label, from url, host, tokens, bad
    (boolean) and source, one row for each url. key is the rule's rarest token, needed its tokens."""
    # Each step is read several times and mining runs FP-growth anew for each reader, so steps are saved: else one plan holds them
    # dozens of times over, which the driver has to plan and keep.
    labelled = saved(labelled.select("url", "host", "tokens", "bad", "source"), "labelled")
    n = labelled.count()
    least = max(2, int(-(-support * n // 1)))
    baskets, items = (saved(df, name) for df, name in zip(items_of(labelled, least), ("baskets", "items"), strict=True))
    found = rules_of(baskets, least, n, confidence, most).where(F.col("lift") >= lift)
    # Wilson's lower bound of the confidence, from the number of URLs that have the antecedent; the label's share is confidence / lift.
    c, m, z2 = F.col("confidence"), F.col("support") * n / F.col("confidence"), DOUBT**2
    lower = (c + z2 / (2 * m) - DOUBT * F.sqrt(c * (1 - c) / m + z2 / (4 * m * m))) / (1 + z2 / m)
    found = saved(found.where(lower > c / F.col("lift")).select("items", "verdict", "confidence", "support"), "found")
    discarded(baskets)
    shorter = found.select("items", "verdict", "confidence", F.explode("items").alias("left_out")).where(F.size("items") > 1)
    shorter = shorter.select("items", "verdict", "confidence", F.array_except("items", F.array("left_out")).alias("rest"))
    as_sure = found.select(F.col("items").alias("rest"), "verdict", F.col("confidence").alias("sure"))
    kept = found.join(shorter.join(as_sure, ["rest", "verdict"]).where("sure >= confidence").select("items", "verdict").distinct(), ["items", "verdict"], "left_anti")
    parts = kept.select("*", F.explode("items").alias("item")).join(items, "item")
    whole = parts.groupBy("items", "verdict", "confidence", "support").agg(F.array_sort(F.flatten(F.collect_list("tokens"))).alias("needed"), F.min_by("item", F.struct("n", "item")).alias("key"))
    rules = whole.select(F.array_join("needed", " ").alias("rule"), "verdict", "confidence", "support", "needed", "key")
    # Without a rule nothing is left to look up.
    rules = saved(rules if not found.isEmpty() else rules.limit(0), "rules")
    discarded(items, found)
    if rules.isEmpty():
        discarded(labelled)
        return rules
    # More than one value is there where the least and the greatest differ.
    spread = lambda c: F.min(c) != F.max(c)
    wide = fitting(labelled.select("tokens", registered_domain(F.col("host")).alias("domain"), "source"), rules.select("key", "rule", "verdict", "needed"))
    wide = wide.groupBy("rule", "verdict").agg((spread("domain") & spread("source")).alias("carries")).where("carries")
    carried = saved(rules.join(wide.select("rule", "verdict"), ["rule", "verdict"], "left_semi"), "rules")
    discarded(labelled, rules)
    return carried


def judge(pages: DataFrame, labelled: DataFrame, rules=RULES, support: float = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE, lift: float = MIN_LIFT) -> DataFrame:
    """page_id, url, host, path, rule, verdict and mined (the mined rule that decides where no fixed one does).

    labelled has url, bad and, where known, source: what the label is from (the URL itself where it isn't said). URLs are
    judged once each: copies of a URL share its verdict.
    """
    def parsed(df: DataFrame) -> DataFrame:
        df = df.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
        return df.withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path")))

    named = labelled if "source" in labelled.columns else labelled.withColumn("source", F.col("url"))
    known = parsed(named.where(F.col("url").isNotNull()).groupBy("url").agg(F.max("bad").alias("bad"), F.min("source").alias("source")))
    said = tokens_named(pages.sparkSession, rules)
    known = known.withColumn("tokens", F.array_except("tokens", F.array(*[F.lit(t) for t in said]).cast("array<string>")))
    learned = mine(known.where(F.size("tokens") > 0), support, confidence, lift)
    index = learned.select("key", "rule", F.col("verdict").alias("says"), "confidence", "support", "needed")
    urls = parsed(pages.where(F.col("url").isNotNull()).select("url").distinct())
    urls = urls.where(fixed_rule(F.col("host"), F.col("path"), rules).isNull()).select("url", "tokens")
    best = F.max_by(F.struct("rule", "says"), F.struct("confidence", "support", F.col("says") == "block", "rule"))
    # No rule fits no URL: then the URLs aren't dealt out for the index.
    met = fitting(urls, index) if not learned.isEmpty() else fitting(urls, index).limit(0)
    best = met.groupBy(F.col("url").alias("hit")).agg(best.alias("best"))
    own = pages.select("page_id", "url").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    own = own.withColumn("fixed", fixed_rule(F.col("host"), F.col("path"), rules))
    joined = own.join(best, F.col("url") == F.col("hit"), "left")
    verdict = F.coalesce(F.col("fixed.verdict"), F.col("best.says"), F.lit("allow"))
    return joined.select("page_id", "url", "host", "path", F.col("fixed.rule").alias("rule"), verdict.alias("verdict"), F.col("best.rule").alias("mined"))


def tokens_named(spark, rules) -> list[str]:
    """Tokens of the fixed rules' own hosts and paths."""
    made = spark.range(1).select(*[tokens(F.lit(f"x://{h}{p}"), F.lit(h), F.lit(p)).alias(f"r{k}") for k, (_, h, p) in enumerate(rules)]).first()
    return sorted({t for found in made or () for t in found if not t.startswith("scheme=")})


def decided(pages: DataFrame, rules=RULES) -> DataFrame:
    """(url, bad, source) of the URLs that a fixed rule decides."""
    found = fixed_rule(host_of(F.col("url")), path_of(F.col("url")), rules)
    return pages.select("url", found["verdict"].alias("said"), found["rule"].alias("source")).where(F.col("said").isNotNull()).select("url", (F.col("said") == "block").alias("bad"), "source")


def op7_url_rules(spark, sf_dir: str) -> DataFrame:
    """Every page's URL, by the fixed rules and what is mined from the URLs that they decide."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, decided(pages)).select("page_id", "host", "path", "rule", "verdict")
