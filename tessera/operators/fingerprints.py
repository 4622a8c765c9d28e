r"""Technologies by fingerprints: thousands of patterns over page code, found by an index of their literals.

Rules come as JSON files of technologies, each with patterns by where they look: html, scriptSrc, meta, headers, url, dns, and
dom selectors (one tag with one attribute test). A pattern may end in tags: \;version:<template of groups>.

No pattern is tried on a text that can't match it: of the literal that every match must hold, the rarest run of ANCHOR letters
or digits among the rules is the rule's anchor. A text is cut to its different runs of that length, those that are anchors
meet the rules, and only these rules' patterns are run on it. Rules without such a run are tried on every text of their kind.
The rules are a table of known size (MOST_RULES anchors, checked; cached for the session); texts aren't shuffled, only hits are, folded by domain.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANCHOR = 4
MOST_RULES = 100_000
#: Letters of a long text that are cut to runs at a time.
SLICE = 1 << 16
#: Where a rule looks, in the order in which sources are asked.
SOURCES = ("html", "scriptSrc", "meta", "headers", "url", "dns")
#: A selector of one tag with one attribute test.
SELECTOR = re.compile(r"\s*([a-zA-Z][a-zA-Z0-9-]*)?\[([a-zA-Z0-9_:-]+)(?:([*^$]?)=\s*['\"]?([^'\"\]]*)['\"]?)?\]\s*")
SCRIPT = r"(?is)<script[^>]+src=[\"']([^\"']+)[\"']"
META = r"(?is)<meta\s[^>]*>"


def required_literal(pattern: str) -> str:
    """The longest run of letters and digits that every match of a pattern holds, in lower case; empty without one."""
    from re import _parser  # Python's own reading of the pattern

    runs = [""]

    def walk(items) -> None:
        for op, arg in items:
            name = str(op)
            if name == "LITERAL" and chr(arg).isascii() and chr(arg).isalnum():
                runs[-1] += chr(arg).lower()
                continue
            if name == "SUBPATTERN":
                walk(arg[-1])
                continue
            runs.append("")
            if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
                walk(arg[2])
                runs.append("")

    walk(_parser.parse(pattern))
    return max(runs, key=len)


def any_literals(pattern: str, least: int = 3) -> list[str]:
    """Lower-case literals of which every match of a pattern holds one or more; empty where none are sure. Of all such sets the
    one whose shortest literal is longest."""
    from re import _parser

    def better(a: list[str], b: list[str]) -> list[str]:
        return max(a, b, key=lambda found: min(map(len, found), default=0))

    def walk(items) -> list[str]:
        best: list[str] = []
        run = ""
        for op, arg in [*items, (None, None)]:
            name = str(op)
            if name == "LITERAL" and chr(arg).isascii():
                run += chr(arg).lower()
                continue
            best, run = better(best, [run] if run else []), ""
            if name == "SUBPATTERN":
                best = better(best, walk(arg[-1]))
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
                best = better(best, walk(arg[2]))
            elif name == "BRANCH":
                each = [walk(branch) for branch in arg[1]]
                best = better(best, sorted({x for found in each for x in found}) if all(each) else [])
        return best

    try:
        found = walk(_parser.parse(pattern))
    except re.error:
        return []
    return found if min(map(len, found), default=0) >= least else []


def guarded(text: Column, pattern: str) -> Column:
    """text.rlike(pattern), tried only where the text holds a literal that a match needs."""
    literals = any_literals(pattern)
    if not literals:
        return text.rlike(pattern)
    low = F.lower(text)
    held = low.contains(literals[0])
    for x in literals[1:]:
        held = held | low.contains(x)
    return F.when(held, text.rlike(pattern)).otherwise(F.when(text.isNotNull(), False))


def selector_pattern(selector: str, attribute: str | None = None) -> tuple[str, str, str] | None:
    """(pattern of the tag, its test, the test's value) of a selector's first part; None if it is of another form. With an
    attribute the pattern's group is that attribute's value."""
    m = SELECTOR.fullmatch(selector.split(",")[0])
    if not m:
        return None
    tag, name, test, value = m[1] or "[a-z][a-z0-9-]*", m[2], m[3] or "", m[4]
    if attribute:
        same = attribute.lower() == name.lower() and value is not None
        return rf"<{tag}\b[^>]*\b{re.escape(attribute)}\s*=\s*[\"']([^\"']*)[\"']", (test or "=") if same else "", value if same else ""
    any_value = "[^\"']*"
    inner = any_value if value is None else {"*": any_value, "$": any_value}.get(test, "") + re.escape(value) + {"*": any_value, "^": any_value}.get(test, "")
    return rf"<{tag}\b[^>]*\b{re.escape(name)}\s*=\s*[\"']{inner}[\"']", "", ""


RULES = (
    "tech string, source string, key string, pattern_no int, pattern string, version string, n_groups int, literal string, "
    "value_pattern string, test string, test_value string"
)


def rules_of(tech: str, spec: dict) -> Iterator[tuple]:
    """Rules of one technology in the order of its file; patterns that can't be read are left out."""
    listed = lambda v: v if isinstance(v, list) else [v] if v else []

    def parts(raw) -> tuple[str, str] | None:
        pattern, *tags = str(raw).split(r"\;")
        try:
            re.compile(pattern)
        except re.error:
            return None
        return pattern, next((t.split(":", 1)[1] for t in tags if t.startswith("version:")), "")

    def rule(source, key, raw, literal_of=None, value=None, test="", test_value=""):
        found = parts(raw)
        if found:
            groups = re.compile(found[0]).groups
            yield [tech, source, key, None, found[0], found[1], groups, required_literal(literal_of or found[0]), value, test, test_value]

    out = []
    for raw in listed(spec.get("html")):
        out += rule("html", "", raw)
    dom = spec.get("dom") or []
    for selector, how in dom.items() if isinstance(dom, dict) else ((s, {}) for s in listed(dom)):
        how = how if isinstance(how, dict) else {}
        wanted = {k: v for k, v in (how.get("attributes") or {}).items() if v}
        if how.get("text") and not wanted:
            continue  # the text of a link needs a parsed page
        attribute = next(iter(wanted), None)
        if attribute == "text":
            continue
        made, value = selector_pattern(selector, attribute), None
        if attribute:
            value = parts(wanted[attribute])
            made = made if value else None
        if made:
            literal = value[0] if value else None
            out += rule("html", "", made[0], literal, value[0] if value else None, made[1], made[2])
    for source in ("scriptSrc", "url"):
        for raw in listed(spec.get(source)):
            out += rule(source, "", raw)
    for source in ("meta", "headers", "dns"):
        if isinstance(spec.get(source), dict):
            for key, raws in spec[source].items():
                for raw in listed(raws):
                    out += rule(source, key.lower(), raw)
    seen: dict[str, int] = {}
    for r in out:
        r[3] = seen[r[1]] = seen.get(r[1], -1) + 1
        yield tuple(r)


def _entries(files: DataFrame) -> DataFrame:
    """(tech, spec) of files that are JSON objects."""
    objects = files.select(F.expr("try_variant_get(try_parse_json(content), '$', 'map<string,variant>')").alias("m"))
    return objects.select(F.explode("m").alias("tech", "spec"))


def read_rules(files: DataFrame) -> DataFrame:
    """Rules with their anchors from files (content: a JSON object of technologies), and none of a file that isn't JSON.

    A column more, anchor: of the literal's runs of ANCHOR signs the one that the fewest rules hold.
    """
    entries = _entries(files).select("tech", F.to_json("spec").alias("spec"))

    def parsed(batches):
        import json

        for batch in batches:
            rows = [r for tech, spec in zip(batch.tech, batch.spec) for r in rules_of(tech, json.loads(spec) or {})]
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in RULES.split(", ")])

    rules = entries.mapInPandas(parsed, RULES)
    runs = F.array_distinct(F.regexp_extract_all("literal", F.lit(rf"(?=([a-z0-9]{{{ANCHOR}}}))"), F.lit(1)))
    each = rules.select("tech", "source", "pattern_no", F.explode(runs).alias("run"))
    held = each.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    anchors = each.join(held, "run").groupBy("tech", "source", "pattern_no").agg(F.min_by("run", F.struct("n", "run")).alias("anchor"))
    return rules.join(anchors, ["tech", "source", "pattern_no"], "left")


def implied(files: DataFrame) -> DataFrame:
    """(tech, also): what technologies imply, where that is one of the files' own; tags of an implication are cut off."""
    entries = _entries(files)
    listed = F.coalesce(F.expr("try_variant_get(spec, '$.implies', 'array<string>')"), F.expr("array_compact(array(try_variant_get(spec, '$.implies', 'string')))"))
    pairs = entries.select("tech", F.explode(listed).alias("also")).select("tech", F.split_part("also", F.lit(r"\;"), F.lit(1)).alias("also"))
    return pairs.join(entries.select(F.col("tech").alias("also")), "also", "left_semi").select("tech", "also")


def anchor_runs(text: Column) -> Column:
    """The different runs of ANCHOR letters or digits of a text, cut slice by slice."""
    size = F.lit(SLICE)
    starts = F.sequence(F.lit(0), F.floor(F.greatest(F.char_length(text) - 1, F.lit(0)) / size).cast("int"))
    found = lambda part: F.array_distinct(F.regexp_extract_all(F.lower(part), F.lit(rf"(?=([a-z0-9]{{{ANCHOR}}}))"), F.lit(1)))
    return F.array_distinct(F.flatten(F.transform(starts, lambda k: found(F.substring(text, k * size + 1, size + ANCHOR - 1)))))


def _tested(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """texts (source, key, text, at) with the rules of their source and key that match: tech, pattern_no, version."""
    rules = rules.withColumn("anchor", F.coalesce("anchor", F.lit(""))).cache()
    known = [r.anchor for r in rules.select("anchor").distinct().limit(MOST_RULES + 1).collect()]
    if len(known) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} anchors: that is no table of fingerprints")
    # A rule has one anchor, so a text meets it once; rules without one have the empty run, which all texts get.
    runs = F.filter(anchor_runs(F.col("text")), lambda r: r.isin(*known)) if known else F.array().cast("array<string>")
    met = texts.select("*", F.explode(F.concat(F.array(F.lit("")), runs)).alias("anchor")).join(F.broadcast(rules), ["source", "key", "anchor"]).drop("anchor")
    pattern = F.concat(F.lit("(?i)"), F.col("pattern"))
    value = F.lower("test_value")

    def fits(v: Column) -> Column:
        low = F.lower(v)
        by_test = F.when(F.col("test") == "*", low.contains(value)).when(F.col("test") == "^", low.startswith(value)).when(F.col("test") == "$", low.endswith(value)).when(F.col("test") == "=", low == value).otherwise(True)
        return by_test & F.rlike(v, F.concat(F.lit("(?i)"), F.col("value_pattern")))

    matches = F.when(F.col("value_pattern").isNull(), F.rlike("text", pattern)).otherwise(F.exists(F.regexp_extract_all("text", pattern, F.lit(1)), fits))
    version = F.col("version")
    for k in (1, 2, 3):
        group = F.when(F.col("n_groups") >= k, F.call_function("regexp_extract", F.col("text"), pattern, F.lit(k))).otherwise("")
        version = F.when(version.contains(f"\\{k}"), F.replace(version, F.lit(f"\\{k}"), group)).otherwise(version)
    return met.where(matches).withColumn("version", F.substring(version, 1, 20))


def technologies(rules: DataFrame, sites: DataFrame, pages: DataFrame, headers: DataFrame, records: DataFrame) -> DataFrame:
    """(domain, tech, how, version) of the first sign of each technology.

    sites (domain, url), pages (domain, page_no, url, html), headers (domain, name, value), records (domain, record_no, kind, record). Sources are
    asked in the order of SOURCES; in page code the rule's first pattern that any page has counts, of scripts the first page's,
    of meta tags the rule's first key that a page's tags name.
    """
    no = F.lit(0).cast("long")
    at = lambda *xs: F.struct(*[x.cast("long").alias(f"x{k}") for k, x in enumerate(xs)])
    # x1 orders signs before the pattern (pages of scripts), x2 after it (pages of code).
    row = lambda source, key, text, before, after, label: F.struct(F.lit(source).alias("source"), key.alias("key"), text.alias("text"), at(before, after).alias("at"), label.alias("label"))
    scripts = F.transform(F.regexp_extract_all("html", F.lit(SCRIPT), F.lit(1)), lambda s, k: row("scriptSrc", F.lit(""), s, F.col("page_no") * 100_000 + k, no, F.concat(F.lit("script "), F.substring(s, 1, 100), F.lit(" on "), F.col("url"))))
    attribute = lambda tag, name: F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*[\"']([^\"']*)[\"']", 1)
    key = lambda tag: F.lower(F.when(attribute(tag, "name") != "", attribute(tag, "name")).otherwise(attribute(tag, "property")))
    metas = F.transform(
        F.regexp_extract_all("html", F.lit(META), F.lit(0)),
        lambda tag, k: row("meta", key(tag), attribute(tag, "content"), no, F.col("page_no") * 100_000 + k, F.concat(F.lit("meta "), key(tag), F.lit(" on "), F.col("url"))),
    )
    code = F.array(row("html", F.lit(""), F.col("html"), no, F.col("page_no"), F.concat(F.lit("page code on "), F.col("url"))))
    paged = pages.select("domain", F.explode(F.concat(code, scripts, metas)).alias("t")).select("domain", "t.*").where("text is not null and (source <> 'meta' or key <> '')")
    # Of each key the first tag of the first page speaks.
    tags = paged.where("source = 'meta'")
    tags = tags.groupBy("domain", "source", "key").agg(F.min_by(F.struct("text", "at", "label"), "at").alias("t")).select("domain", "source", "key", "t.*")
    address = sites.select("domain", F.lit("url").alias("source"), F.lit("").alias("key"), F.col("url").alias("text"), at(no, no).alias("at"), F.lit("site address").alias("label"))
    sent = headers.select("domain", F.lit("headers").alias("source"), F.lower("name").alias("key"), F.col("value").alias("text"), at(no, no).alias("at"), F.concat(F.lit("response header "), F.lower("name")).alias("label"))
    dns = records.select("domain", F.lit("dns").alias("source"), F.lower("kind").alias("key"), F.col("record").alias("text"), at(F.col("record_no"), no).alias("at"), F.concat(F.lit("DNS "), F.col("kind"), F.lit(" record "), F.substring("record", 1, 80)).alias("label"))
    every = paged.where("source <> 'meta'").unionByName(tags).unionByName(address).unionByName(sent).unionByName(dns)
    found = _tested(every, rules)
    place = F.element_at(F.create_map(*[F.lit(x) for k, s in enumerate(SOURCES) for x in (s, k)]), F.col("source"))
    rank = F.struct(place.alias("place"), F.col("at.x0"), "pattern_no", F.col("at.x1"))
    best = found.groupBy("domain", "tech").agg(F.min_by(F.struct("label", "version"), rank).alias("b"))
    return best.select("domain", "tech", F.col("b.label").alias("how"), "b.version")


def with_implied(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """found and what it implies in one step; what is found itself stays as found."""
    more = found.join(pairs, "tech").groupBy("domain", F.col("also").alias("tech")).agg(F.concat(F.lit("implied by "), F.min("tech")).alias("how"), F.lit("").alias("version"))
    return found.unionByName(more.join(found.select("domain", "tech"), ["domain", "tech"], "left_anti"))
