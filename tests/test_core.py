"""The decision core on small cases made by hand."""

import itertools

import pytest
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import answers, merging, page_facts, relational, scoring
from tessera import config
from tessera.plans import answer_queries, decision_queries
from tessera.plans import leads as L

DATA = "/root/testdata/sf0.001"


def settle_one(cur, new, match, grp):
    """The truth table in plain Python."""
    strict = grp == "exclusion" and new == "yes" or grp == "must" and new == "no"
    if new in ("yes", "no") and not (match == "strong" or match == "medium" and not strict):
        if not (grp == "exclusion" and new == "yes"):
            return cur
        new = "check"
    if cur in ("yes", "no") and new in ("yes", "no") and cur != new and match == "strong":
        return "check"
    if cur not in ("check", "unknown") or cur == new == "check":
        return cur
    return new


def test_settle_truth_table(spark):
    cases = list(itertools.product(("yes", "no", "check", "unknown", "na"), ("yes", "no", "check"), ("strong", "medium", "weak"), ("must", "exclusion", "fit")))
    df = spark.createDataFrame(cases, "cur string, new string, match string, grp string")
    got = df.select("*", merging.settle(F.col("cur"), F.col("new"), F.col("match"), F.col("grp")).alias("out")).collect()
    assert all(r.out == settle_one(r.cur, r.new, r.match, r.grp) for r in got) and len(got) == len(cases)


def test_layers_fold_in_order_and_open_e4(spark):
    signals = spark.createDataFrame([("a.com", "M1", "no", "must"), ("a.com", "E4", "yes", "exclusion"), ("b.com", "M1", "unknown", "must")], "domain string, sid string, value string, grp string")
    offers = spark.createDataFrame([("a.com", "M1", 2, "yes", "weak"), ("a.com", "M1", 1, "yes", "strong"), ("b.com", "M1", 1, "yes", "medium")], "domain string, sid string, layer int, value string, match string")
    got = {(r.domain, r.sid): r.value for r in merging.settle_layers(signals, offers).collect()}
    assert got == {("a.com", "M1"): "check", ("a.com", "E4"): "check", ("b.com", "M1"): "yes"}


def test_gates_close_children_of_closed_parents(spark):
    facts = {"M1": "yes", "M2": "unknown", "F1": "no", "B1": "unknown", "F4": "unknown", "B11": "check", "F8": "check", "B12": "unknown"}
    df = spark.createDataFrame([("a.com", k, v) for k, v in facts.items()], "domain string, sid string, value string")
    got = {r.sid: r.value for r in merging.close_gates(df, "product").collect()}
    assert got["B1"] == "na" and got["B11"] == "check" and got["B12"] == "unknown" and got["M2"] == "unknown"


def test_a_no_closes_open_musts(spark):
    df = spark.createDataFrame([("a.com", "M1", "no"), ("a.com", "M3", "check"), ("a.com", "F1", "unknown")], "domain string, sid string, value string")
    got = {r.sid: r.value for r in merging.close_gates(df, "services").collect()}
    assert got["M3"] == "na" and got["F1"] == "unknown"


def test_circular_conditions_are_refused(monkeypatch):
    monkeypatch.setitem(config.RUN_IF, "product", {"M1": {"M2": config.YES}, "M2": {"M1": config.YES}})
    with pytest.raises(ValueError):
        config.in_order("product")


def test_opposites(spark):
    df = spark.createDataFrame([("a", "F5", "yes"), ("a", "F7", "check"), ("a", "W1", "yes"), ("b", "F7", "unknown")], "domain string, sid string, value string")
    got = {(r.domain, r.sid): r.value for r in merging.derive(df).collect()}
    assert got == {("a", "F5"): "yes", ("a", "F7"): "no", ("a", "W1"): "yes", ("b", "F7"): "unknown"}


def test_segments(spark):
    cases = {"11-50": "MM", "1,200": "ENT", "": "SMB", "about 5": "SMB", "0": "SMB", "26+": "ENT", None: "SMB"}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "employees string, want string")
    assert all(r.got == r.want for r in df.select("want", scoring.segment(F.col("employees")).alias("got")).collect())


def test_domains_and_names(spark):
    df = spark.createDataFrame([("https://www.Example.com/a?b#c",), ("EXAMPLE.co.uk:80",), ("no domain",), ("",), (None,)], "x string")
    assert [r[0] for r in df.select(S.normalize_domain(F.col("x"))).collect()] == ["example.com", "example.co.uk", None, None, None]
    df = spark.createDataFrame([("The Acme & Sons (US), Inc. LLC",), ("Company",), ("The Wikimedia Foundation Org",), ("The the Inc",), ("Theory Lc",), (None,)], "x string")
    assert [r[0] for r in df.select(S.name_key(F.col("x"))).collect()] == ["acme and sons", "company", "wikimedia foundation", "", "theory", None]
    long = "A " + "b" * 3000
    assert spark.createDataFrame([(long,)], "x string").select(S.other_names(F.col("x"))).first()[0] == "b" * 3000


def test_money_and_dates(spark):
    df = spark.createDataFrame([("raised $1,250.5 million on 2020-02-30 and 2021-03-04",), ("nothing",)], "x string")
    got = df.select(S.money_usd(F.col("x")).alias("m"), S.iso_dates(F.col("x")).alias("d")).collect()
    assert got[0].m == 1250.5e6 and [str(d) for d in got[0].d] == ["2021-03-04"] and got[1].m is None and got[1].d == []


def test_auc_and_cutoff(spark):
    df = spark.createDataFrame([(1, 0), (2, 0), (2, 1), (3, 1)], "score long, label int")
    assert relational.auc(df, "score", "label").first()[0] == 0.875
    assert relational.best_cutoff(df, "score", "label").first().cutoff == 2


def test_filter_tree(spark):
    df = spark.createDataFrame([("A10", "5 people"), ("a9", None), ("", "7")], "name string, size string")
    keep = lambda tree: [r.name for r in df.where(relational.predicate(tree)).collect()]
    assert keep({"all": []}) == ["A10", "a9", ""]
    assert keep({"any": [{"column": "name", "op": "is", "value": "A9"}, {"column": "size", "op": "gt", "value": "6"}]}) == ["a9", ""]
    assert keep({"all": [{"column": "name", "op": "filled"}, {"column": "size", "op": "lt", "value": "9", "on": False}]}) == ["A10", "a9"]
    assert [r.name for r in df.orderBy(*relational.grid_order([("name", False)])).collect()] == ["a9", "A10", ""]
    assert [r.name for r in df.orderBy(*relational.grid_order([("name", True)])).collect()] == ["A10", "a9", ""]


def test_a_later_layer_settles_what_an_earlier_one_opened(spark):
    """A strong contradiction of M1 opens E4 at its layer; the next layer may answer E4 again."""
    facts = spark.createDataFrame([("a", "M1", "no", "must"), ("a", "E4", "yes", "exclusion"), ("b", "M1", "no", "must"), ("b", "E4", "yes", "exclusion")], "domain string, sid string, value string, grp string")
    offers = spark.createDataFrame([("a", "M1", 1, "yes", "strong"), ("a", "E4", 2, "no", "strong"), ("b", "M1", 2, "yes", "strong"), ("b", "E4", 1, "no", "weak")], "domain string, sid string, layer int, value string, match string")
    got = {(r.domain, r.sid): r.value for r in merging.settle_layers(facts, offers).collect()}
    assert got == {("a", "M1"): "check", ("a", "E4"): "no", ("b", "M1"): "check", ("b", "E4"): "check"}
    off = {(r.domain, r.sid): r.value for r in merging.settle_layers(facts, offers, {1: ("M1",), 2: ("M1", "E4")}).collect()}
    assert off == {("a", "M1"): "no", ("a", "E4"): "yes", ("b", "M1"): "no", ("b", "E4"): "yes"}


def test_facts_of_pages_and_jobs(spark):
    pages = spark.createDataFrame(
        [("a.com", 1, "home", "We use Ramp. Ramp up now.", "<script>loadStripe ('x')</script>"), ("a.com", 2, "terms", "Acme is a Delaware corporation. Cards by Brex.", ""), ("b.io", 3, "legal", "You may connect your Brex account.", ""),
         ("b.io", 4, "home", "Ramp up quickly with Mercury.", ""), ("c.de", 5, "terms", "governed by the laws of Germany", "")],
        "domain string, page_no int, kind string, text string, html string",
    )
    jobs = spark.createDataFrame([("b.io", 1, "Controller", "We know QuickBooks Enterprise and Brex.", True), ("a.com", 1, "Engineer", "You like QuickBooks", False)], "domain string, job_no int, title string, description string, remote boolean")
    tools = {(r.domain, r.tool): r.value for r in page_facts.tools(pages, jobs).collect()}
    assert tools == {("a.com", "Stripe"): "yes", ("a.com", "Ramp"): "check", ("a.com", "Brex"): "yes", ("b.io", "Brex"): "yes"}
    assert {(r.domain, r.sid): r.value for r in page_facts.competitor_facts(pages, jobs).collect()} == {("a.com", "F4"): "yes", ("b.io", "W10"): "check"}
    place = {(r.domain, r.sid): r.value for r in page_facts.place_facts(pages, 2026).collect()}
    assert place[("a.com", "M1")] == "yes" and place[("a.com", "F3")] == "yes" and place[("c.de", "M1")] == "no" and place[("c.de", "E4")] == "yes"
    boards = pages.limit(1).withColumn("html", F.lit("<a href=https://jobs.lever.co/jobs></a><a href=https://jobs.lever.co/Acme.io>"))
    assert [tuple(r) for r in page_facts.job_boards(boards).collect()] == [("a.com", "lever", "Acme.io")]


def test_waves_shuffle_no_more_than_plans(spark):
    """A lead's waves and their pages are worked out in its row: question_waves, wave_pages."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    shuffles = lambda df: (plan(df).count("Exchange hashpartitioning"), plan(df).count("Aggregate"), plan(df).count("UnionLoop"))
    plans = shuffles(answer_queries.planned(spark, DATA))
    assert shuffles(answer_queries.question_waves(spark, DATA)) == shuffles(answer_queries.wave_pages(spark, DATA)) == plans


def test_waves_end_by_themselves(spark, monkeypatch):
    """The longest chain of conditions bounds the waves: more waves change nothing, and circles are bounded too."""
    plans = answer_queries.planned(spark, DATA)
    rows = lambda: sorted(map(tuple, answers.waves(plans, "services", "'yes'").collect()))
    mine, most = rows(), answers.most_waves("services")
    assert 1 < max(r[2] for r in mine) <= most < 20
    with monkeypatch.context() as m:
        m.setattr(answers, "most_waves", lambda pipeline: most + 3)
        assert rows() == mine
    monkeypatch.setattr(answers, "conditions", lambda pipeline: [("M1", 1, "M2", "yes", False), ("M2", 1, "M1", "yes", False)])
    assert answers.most_waves("services") == len(config.facts())


def test_worth_of_open_questions_is_found_in_the_row(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    mine, base = plan(decision_queries.open_questions_by_worth(spark, DATA)), plan(L.leads(spark, DATA))
    assert "Window" not in mine and mine.count("Exchange hashpartitioning") == base.count("Exchange hashpartitioning")
