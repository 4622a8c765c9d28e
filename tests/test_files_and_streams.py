"""Sources and sinks with files, and the streaming forms against the batch ones."""

import pytest
from pyspark.sql import functions as F

from tessera.sources import files
from tessera.streaming import events as E

DATA = "/root/testdata/sf0.001"


def test_lead_list(spark, tmp_path):
    path = tmp_path / "leads.csv"
    path.write_text('﻿Company Name,Website,Employees,Note\n"A, Inc.",https://www.a.com/x,11-50,"say ""hi"""\nB,b.org,,\nA again,a.com,7,x\nC,not a domain,3,\n', encoding="utf-8")
    rows = files.read_rows(spark, str(path))
    got = rows.orderBy("row_no").collect()
    assert [(r.row_no, r.domain, r.company, r.employees) for r in got] == [(2, "a.com", "A, Inc.", "11-50"), (3, "b.org", "B", ""), (4, "a.com", "A again", "7"), (5, None, "C", "3")]
    assert got[0].input["Note"] == 'say "hi"'
    assert sorted(r.row_no for r in files.work_list(rows).collect()) == [2, 3]
    assert files.list_report(rows).first().asDict() == {"rows": 4, "bad": 1, "repeats": 1}
    found = spark.createDataFrame([("a.com", "YES"), ("b.org", "NO")], "domain string, icp string")
    final = {r.row_no: (r.icp, r.note) for r in files.final_list(rows, found).collect()}
    assert final == {2: ("YES", ""), 3: ("NO", ""), 4: ("YES", "Duplicate of row 2"), 5: ("NO", "bad domain")}


def test_log(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"time": "2024-01-02", "step": "AI"}\nnot json\n{"time": "2024-02-02", "step": "crawl"}\n')
    assert [r.step for r in files.read_log(spark, str(tmp_path), "time string, step string", "2024-01").collect()] == ["AI"]


def test_feeds(spark):
    rows = [
        ("a", "greenhouse", "x", '{"jobs": [{"title": ""}, {"title": "Clerk", "location": {"name": "Remote"}, "content": "<p>Do  it &amp;amp; go</p>", "absolute_url": "u"}]}'),
        ("b", "lever", "x", '[{"text": "Cook", "categories": {"location": "Bonn"}, "descriptionPlain": "x", "hostedUrl": "v"}]'),
        ("c", "dover", "x", "<html>"), ("d", "recruitee", "x", '{"offers": []}'), ("e", "personio", "x", "<workzag-jobs><position><name>Baker</name><office>Ulm</office></position></workzag-jobs>"),
    ]
    feeds = spark.createDataFrame(rows, "domain string, shape string, account string, body string")
    got = {r.domain: (r.title, r.location, r.remote, r.description, r.url) for r in files.parse_feeds(feeds).collect()}
    assert got == {"a": ("Clerk", "Remote", True, "Do it &amp; go", "u"), "b": ("Cook", "Bonn", False, "x", "v"), "e": ("Baker", "Ulm", False, "", "")}
    assert files.parse_feeds(feeds, most=1).count() == 3
    assert {r.domain: r.jobs for r in files.feed_counts(feeds).collect()} == {"a": 2, "b": 1, "c": None, "d": 0, "e": 1}


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([("k", 1, "2024-01-01"), ("l", 2, "2024-01-01")], "k string, v int, created string")
    new = spark.createDataFrame([("k", 9, "2024-02-01")], "k string, v int, created string")
    assert {r.k: r.v for r in files.upsert(old, new, ["k"], "created").collect()} == {"k": 9, "l": 2}
    assert files.without_expired(old.withColumn("created", F.to_date("created")), "created", "2024-03-01", 10).count() == 0
    files.write_log(old, str(tmp_path / "log"))
    files.write_log(new, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 3
    files.write_wide(old.withColumn("row_no", F.col("v")), str(tmp_path / "wide"))
    assert spark.read.csv(str(tmp_path / "wide"), header=True).count() == 2


@pytest.fixture()
def folder(spark, tmp_path):
    """The events in four files, so that a stream sees several batches."""
    rows = spark.read.parquet(f"{DATA}/events.parquet")
    for k in range(4):
        rows.where(F.col("event_id") % 4 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in"), rows


def run(df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)


def test_stream_windows_equal_batch(spark, folder, tmp_path):
    path, rows = folder
    run(E.tumbling(E.event_stream(spark, path, 1)), "tumbling", "complete", tmp_path)
    key = lambda df: sorted((r.begins, r.event_type, r.n) for r in df.collect())
    assert key(spark.table("tumbling")) == key(E.tumbling(rows))


def test_stream_drops_repeats(spark, folder, tmp_path):
    path, rows = folder
    rows.coalesce(1).write.mode("append").parquet(path)
    run(E.without_repeats(E.event_stream(spark, path, 8), "60 days"), "unique", "append", tmp_path)
    assert spark.table("unique").count() == rows.count()


def test_review_states_fold(spark):
    rows = spark.createDataFrame([(1, 1, "view"), (1, 2, "click"), (1, 3, "purchase"), (2, 1, "view"), (2, 2, "error"), (2, 3, "view"), (3, 1, "click")], "user_id long, event_id long, event_type string").withColumn("ts", F.timestamp_seconds("event_id"))
    assert {r.user_id: r.state for r in E.review_states_batch(rows).collect()} == {1: "idle", 2: "stopped", 3: "idle"}


def test_review_states_stream(spark, tmp_path):
    rows = spark.read.parquet(f"{DATA}/events.parquet").where("user_id < 20")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    run(E.review_states(E.event_stream(spark, str(tmp_path / "in"))), "states", "update", tmp_path)
    got = {r.user_id: (r.state, r.events) for r in spark.table("states").collect()}
    assert got == {r.user_id: (r.state, r.events) for r in E.review_states_batch(rows).collect()}
