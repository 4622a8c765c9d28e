import random
import re

import pytest

from pyspark.sql import functions as F

from tessera.functions import page_rules
from tessera.operators import fingerprints as P

TEXTS = "source string, key string, text string, at struct<x0: long, x1: long>, label string, domain string"


@pytest.mark.parametrize(
    "pattern,literal",
    [
        (r"cdn\.shopx\.com/v\d+", "shopx"), (r"(?:foo|bar)baz9", "baz9"), (r"x(?:widget)+y?zz", "widget"), (r"ab*cdef", "cdef"), (r"[a-z]{4,}", ""), (r"a(bcd(efg))h", "abcdefgh"), (r"^Word", "word"),
    ],
)
def test_required_literal(pattern, literal):
    assert P.required_literal(pattern) == literal


def test_literals_that_matches_need():
    cases = {r"\bStripe\b": ["stripe"], r"(?i)abc\.com|x(?:yzw|vuts)": ["abc.com", "vuts", "yzw"], r"a|bcd": [], r"(?:foo)?barez+": ["bare"], r"\d+%": [], r"Offer\s+(?:one|two)!": ["offer"], r"(": [], r"(?:ab|cd)x": []}
    assert {p: P.any_literals(p) for p in cases} == cases


def test_guarded_equals_plain_search(spark):
    rng = random.Random(8)
    patterns = [p for rules in (page_rules.PAGE_FLAGS.values(),) for _, column, p, *_ in rules if column != "kind"] + [p for *_, p in page_rules.GATEWAYS] + [t for *_, t in page_rules.TOOLS]
    parts = [x for p in patterns for x in P.any_literals(p)] + ["$5", "/mo", " ", "a", "Add to Cart", "€ 7", "12 left", "Stripe", "Brex", "js.stripe.com/v3", None]
    texts = [None, "", *("".join(rng.choice(["", " ", "\n"]) + rng.choice([str.upper, str.title, str])(rng.choice(parts) or "-") for _ in range(rng.randint(1, 12))) for _ in range(300))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    differ = [F.count_if(~P.guarded(F.col("t"), p).eqNullSafe(F.col("t").rlike(p))).alias(f"p{k}") for k, p in enumerate(patterns)]
    assert set(df.agg(*differ).first()) == {0}


def test_selectors():
    tag, test, value = P.selector_pattern("link[href*='x.css'], b")
    assert re.search(tag, "<link rel=1 href='/a/x.css?1'>", re.I) and not re.search(tag, "<link href='/y.css'>", re.I) and (test, value) == ("", "")
    assert P.selector_pattern("div > p") is None and P.selector_pattern(".a[b]") is None
    tag, test, value = P.selector_pattern("[data-x^='Q']", "data-x")
    assert re.search(tag, "<p data-x='Qr'>", re.I)[1] == "Qr" and (test, value) == ("^", "Q")
    assert P.selector_pattern("a[href]", "rel")[1:] == ("", "")


def test_rules_of_odd_specs():
    spec = {"html": ["(broken", "fine"], "dom": {"a[x]": {"text": "t"}, "a[y]": {"attributes": {"text": "u"}}, "b > c": {"attributes": {"z": "w"}}, "i[k]": {"attributes": {"k": "(bad"}}}, "meta": "no", "url": None}
    assert [r[:5] for r in P.rules_of("T", spec)] == [("T", "html", "", 0, "fine")]


def test_every_rule_equals_plain_search(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdef") for _ in range(rng.randint(2, 7))) for _ in range(150)]
    shapes = [lambda w, v: w, lambda w, v: rf"{w}-({v}|\d+)", lambda w, v: rf"(?:{w}|{v})x", lambda w, v: rf"{w}\s*{v}", lambda w, v: rf"^{w[:2]}", lambda w, v: rf"{w}?{v}"]
    patterns = {f"T{k}": rng.choice(shapes)(rng.choice(words), rng.choice(words)) for k in range(1000)}
    content = "{" + ",".join(f'"{t}": {{"html": "{p.replace(chr(92), chr(92) * 2)}"}}' for t, p in patterns.items()) + "}"
    rules = P.read_rules(spark.createDataFrame([(content,), ("{",), ("[1]",)], "content string"))
    texts = ["", *(rng.choice(["", " ", "-"]).join(rng.choice([*words, "x", "7"]) for _ in range(rng.randint(1, 60))).upper() for _ in range(40))]
    df = spark.createDataFrame([("html", "", t, (0, 0), "l", str(k)) for k, t in enumerate(texts)], TEXTS)
    got = {(r.domain, r.tech) for r in P._tested(df, rules).select("domain", "tech").collect()}
    assert got == {(str(k), t) for k, text in enumerate(texts) for t, p in patterns.items() if re.search(p, text, re.I)}


def test_runs_across_slices(spark, monkeypatch):
    monkeypatch.setattr(P, "SLICE", 5)
    texts = ["", "abc", "abcdefghijklmnop", "ab cdef-GHIJKLé12345"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", P.anchor_runs(F.col("t")).alias("r")).collect()
    for r in rows:
        assert sorted(r.r) == sorted({r.t.lower()[k : k + 4] for k in range(len(r.t)) if re.fullmatch("[a-z0-9]{4}", r.t.lower()[k : k + 4])})


def test_first_sign_counts(spark):
    content = r'{"A": {"html": ["late", "early"], "scriptSrc": "src"}, "B": {"meta": {"Name": "m (\\d)\\;version:v\\1"}, "implies": "A"}, "C": {"headers": {"X": "h"}, "implies": ["D", "Z"]}, "D": {}}'
    files = spark.createDataFrame([(content,)], "content string")
    pages = [("a.com", 2, "u2", "late"), ("a.com", 1, "u1", 'early <script src="src.js"></script><meta property="name" content="m 5"><meta name="name" content="m 6">'), ("b.com", 1, "w", "<script src='src'></script>")]
    found = P.technologies(
        P.read_rules(files), spark.createDataFrame([("a.com", "u1")], "domain string, url string"), spark.createDataFrame(pages, "domain string, page_no long, url string, html string"),
        spark.createDataFrame([("a.com", "X", "h")], "domain string, name string, value string"), spark.createDataFrame([], "domain string, record_no long, kind string, record string"),
    )
    assert sorted(map(tuple, found.collect())) == [("a.com", "A", "page code on u2", ""), ("a.com", "B", "meta name on u1", "v5"), ("a.com", "C", "response header x", ""), ("b.com", "A", "script src on w", "")]
    more = P.with_implied(found, P.implied(files))
    assert ("a.com", "D", "implied by C", "") in set(map(tuple, more.collect())) and more.where("tech = 'Z'").count() == 0
