import hashlib
import itertools
import math
import os
import random
import re
from zlib import crc32

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing, url_rules, warc

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def views():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def same(df, sql, con):
    columns = sorted(df.columns)
    show = lambda v: "" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
    mine = sorted(tuple(show(r[c]) for c in columns) for r in df.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    return mine == sorted(tuple(show(r[names.index(c)]) for c in columns) for r in cursor.fetchall())


def test_mix_matches_sql(spark, views):
    assert same(mixing.op6_mix(spark, DATA), mixing.OP6_SQL, views)


def water_fill(sizes, weights, most=3):
    """The excess reshared round by round, in plain Python."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        target = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if target[s] > most * sizes[s]]
        if not over:
            return {**capped, **target}
        capped |= {s: most * sizes[s] for s in over}


def test_targets_equal_resharing(spark):
    rng = random.Random(3)
    for _ in range(4):
        sizes = {rng.choice([None, *"abcdefghij"]): rng.randint(0, 500) for _ in range(6)}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        want = water_fill(sizes, mixing.WEIGHTS)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_mix_with_clashing_names_and_near_targets(spark):
    rng = random.Random(8)
    rows = [(k, " ".join(["w"] * rng.randint(1, 400)), "abc"[rng.choice((0, 0, 0, 1, 2))]) for k in range(2500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    names = ("first", "cls", "salt", "place", "due", "shift", "p_source", "row", "size", "copies")
    for n in names:
        df = df.withColumn(n, F.lit(f"own {n}"))
    out = mixing.mix(df)
    assert {tuple(r[n] for n in names[:-2]) for r in out.collect()} == {tuple(f"own {n}" for n in names[:-2])}
    for r in out.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("largest")).collect():
        assert abs(r.taken - r.target) <= r.largest
    drawn = mixing.mixed_documents(df)
    assert drawn.columns == df.columns and {tuple(r[n] for n in names) for r in drawn.collect()} == {tuple(f"own {n}" for n in names)}


def test_mix_edges(spark):
    rows = [(1, "a b c", "x", 9), (1, "a b c", "x", 9), (None, None, None, 1), (4, "", "y", 1), (5, "q " * 300, "y", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    out = mixing.mix(df).collect()
    assert len(out) == 5 and all(r.taken <= 3 * r.size for r in out) and {r.size for r in out} == {3, 0, 300}
    assert mixing.mixed_documents(df).columns == df.columns
    assert mixing.mix(df.limit(0)).count() == 0
    again = sorted((r.doc_id or -1, r.taken) for r in mixing.mix(df.repartition(3)).collect())
    assert again == sorted((r.doc_id or -1, r.taken) for r in out)


def test_warc_round_trip(spark, views, tmp_path):
    assert same(warc.op5_warc(spark, DATA), warc.OP5_SQL, views)
    long = "é" * 60
    rows = [(3, "http://a/", long), (1, "http://b/ c\n", long), (2, None, ""), (5, "u", None), (5, "u", long), (5, "u", long), (None, "n", long), (7, "v", "short")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archive(pages, str(tmp_path / "a"))
    got = warc.read_archive(spark, str(tmp_path / "a")).collect()
    assert len(got) == len(rows)
    assert spark.read.parquet(str(tmp_path / "a/payloads")).count() == 3  # each payload once
    by = {}
    for r in got:
        raw = bytes(r.record)
        head, _, rest = raw.partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        assert int(fields[b"Content-Length"]) == len(rest) - 4 and rest.endswith(b"\r\n\r\n")
        if r.record_type == "response":
            payload = rest[:-4].partition(b"\r\n\r\n")[2]
            assert hashlib.sha256(payload).hexdigest() == r.payload_digest == fields[b"WARC-Payload-Digest"].decode().removeprefix("sha256:")
        by.setdefault(r.page_id, []).append((r.record_type, r.refers_to, r.payload_bytes))
    assert by[1] == [("response", None, 120)] and by[3] == [("revisit", 1, 120)] and by[None] == [("revisit", 1, 120)]
    assert sorted(by[5], key=str) == sorted([("response", None, 0), ("revisit", 1, 120), ("revisit", 1, 120)], key=str)
    warc.write_archive(pages.limit(0), str(tmp_path / "b"))
    assert warc.read_archive(spark, str(tmp_path / "b")).count() == 0


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), h + p, v) for v, h, p in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[1:]) if fits else (host, path, None, None)


def test_fixed_rules(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "x://a.net/es/", "x://net/fr/a", "x://anet/es/", "x://a.com", "x://a.com?q=/en/", "x://b.example.com/en/#", "ftp://É.com/ü", "a://b://c/d", "x://www.example.com/en"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    none = pages.limit(0).select("url", F.lit(True).alias("bad"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(pages, none).collect()}
    for k, url in enumerate(urls):
        host, path, rule, verdict = plain_rule(url)
        assert got[k] == (host, path, rule, verdict or "allow"), url


def test_mined_rules_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(k, f"https://{rng.choice(['spam', 'good'])}-{rng.choice('ab')}.{rng.choice('xyz')}.org/{rng.choice(['de', 'it'])}/{k}{rng.choice(['', '?utm=1'])}") for k in range(400)]
    bad = lambda u: "spam-" in u and "/de/" in u
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labelled = spark.createDataFrame([(u, bad(u)) for _, u in rows], "url string, bad boolean")
    got = {r.page_id: r.verdict for r in url_rules.judge(pages.unionByName(pages), labelled, support=0.05, confidence=0.9).collect()}
    assert got == {k: "block" if bad(u) else "allow" for k, u in rows}
    # The same labels from one source, or of one registered domain, carry over to nothing.
    one = url_rules.judge(pages, labelled.withColumn("source", F.lit("s")), support=0.05)
    assert one.where("mined is not null").count() == 0
    same = spark.createDataFrame([(k, re.sub(r"\.[xyz]\.", ".x.", u)) for k, u in rows], "page_id long, url string")
    assert url_rules.judge(same, same.select("url", F.lit(True).alias("bad")), support=0.05, lift=0.0).where("mined is not null").count() == 0


def test_long_urls_are_mined_in_time(spark):
    """Tokens that always come together are one item; labelled URLs of many nested tokens aren't learned from."""
    words = "/".join(f"word{k}" for k in range(40))
    rows = [(k, f"https://a.x{k % 3}.org/{words}/{k}") for k in range(40)] + [(100 + k, f"https://b.y{k % 2}.org/{'/'.join(f'n{j}' for j in range(k))}/p") for k in range(120)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labelled = pages.select("url", (F.col("page_id") < 100).alias("bad"))
    got = {r.page_id: r.verdict for r in url_rules.judge(pages, labelled).collect()}
    assert got == {k: "block" if k < 100 else "allow" for k, _ in rows}


def test_long_labelled_urls_are_learned_from(spark):
    """Two words of a long blocked URL foretell a block, one alone doesn't."""
    words = [f"word{k}" for k in range(24)]
    rows = [(k, f"https://a.x{k % 3}.org/{'/'.join(words)}/{k}", True) for k in range(60)]
    rows += [(1000 + k, f"https://b.y{k % 5}.org/{words[k % 24]}/{k}", False) for k in range(24 * 12)]
    pages = spark.createDataFrame([*[(k, u) for k, u, _ in rows], (5000, "https://c.z.org/word3/word17/new"), (5001, "https://c.z.org/word3/new")], "page_id long, url string")
    labelled = spark.createDataFrame([(u, bad) for _, u, bad in rows], "url string, bad boolean")
    got = {r.page_id: (r.verdict, r.mined) for r in url_rules.judge(pages, labelled).collect()}
    assert got[5000] == ("block", "path=word17 path=word3") and got[5001] == ("allow", None)
    assert all(got[k][0] == ("block" if bad else "allow") for k, _, bad in rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_sparing_sets_make_the_rules_of_fp_growth(spark, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(300):
        words = sorted(rng.sample([f"w{j}" for j in range(9)], rng.randint(0, 6)))
        bad = rng.random() < (0.97 if {"w1", "w2"} <= set(words) or "w7" in words and "w3" not in words else 0.1)
        rows.append((f"https://h{k % 4}.x{k % 7}.org/{'/'.join(words)}/{k}", "", ["all", *words], bad, f"s{k % 3}"))
    labelled = spark.createDataFrame(rows, "url string, path string, tokens array<string>, bad boolean, source string").withColumn("host", url_rules.host_of(F.col("url")))
    rules = lambda most: sorted((r.rule, r.verdict, round(r.confidence, 12), round(r.support, 12), r.needed, r.key) for r in url_rules.mine(labelled, 0.02, most=most).collect())
    found = rules(16)
    assert found == rules(0) and {r[1] for r in found} >= {"block"} and max(len(r[4]) for r in found) > 1


def plain_mined(labelled, least, confidence, lift, tokens_of, left_out):
    """{frozenset of tokens: (verdict, confidence, support)} of all token sets of up to three tokens that carry over."""
    found, n = {}, len(labelled)
    base = {v: sum((bad == (v == "block")) for bad, _ in labelled.values()) / n for v in ("block", "allow")}
    sets = {}
    for url in labelled:
        for size in (1, 2, 3):
            for s in itertools.combinations(sorted(set(tokens_of[url]) - left_out), size):
                sets.setdefault(s, []).append(url)
    for s, urls in sets.items():
        if len({".".join(u.split("://")[1].split("/")[0].lower().split(".")[-2:]) for u in urls}) < 2 or len({labelled[u][1] for u in urls}) < 2:
            continue
        for v in ("block", "allow"):
            hits = sum(labelled[u][0] == (v == "block") for u in urls)
            c, m, z = hits / len(urls), len(urls), url_rules.DOUBT
            lower = (c + z * z / (2 * m) - z * math.sqrt(c * (1 - c) / m + z * z / (4 * m * m))) / (1 + z * z / m)
            if hits >= least and c >= confidence and c / base[v] >= lift and lower > base[v]:
                found.setdefault(frozenset(s), []).append((v, hits / len(urls), hits / n))
    return found


@pytest.mark.parametrize("folder,support", [("sf0.01", 0.02), ("sf0.1", 0.004)])
def test_mined_verdicts_equal_all_token_sets(spark, folder, support):
    """Verdicts of pages that no fixed rule decides, with spam words planted in hosts of every domain, against all token sets
    of up to three tokens; no rule names what a fixed rule names."""
    planted = F.when(F.xxhash64("url") % 4 == 0, F.regexp_replace("url", "://", "://zzwin-zzbets.")).otherwise(F.col("url"))
    pages = spark.read.parquet(f"/root/testdata/{folder}/pages.parquet").select("page_id", planted.alias("url"))
    by = url_rules.decided(pages).withColumn("bad", F.col("bad") | F.col("url").contains("zzwin-zzbets"))
    labelled = {r.url: (r.bad, r.source) for r in by.collect()}
    rows = pages.withColumn("t", url_rules.tokens(F.col("url"), url_rules.host_of(F.col("url")), url_rules.path_of(F.col("url")))).collect()
    left_out = set(url_rules.tokens_named(spark, url_rules.RULES))
    assert {"path=en", "path=es", "path=fr", "host0=com", "host0=net", "host1=example", "host2=www"} == left_out
    rules = plain_mined(labelled, max(2, -(-support * len(labelled) // 1)), url_rules.MIN_CONFIDENCE, url_rules.MIN_LIFT, {r.url: r.t for r in rows}, left_out)
    got = {r.page_id: r for r in url_rules.judge(pages, by, support=support).collect()}
    n_mined = 0
    # Without planted words nothing carries over, at any size.
    plain = spark.read.parquet(f"/root/testdata/{folder}/pages.parquet").select("page_id", "url")
    assert url_rules.judge(plain, url_rules.decided(plain)).where("mined is not null").count() == 0
    for r in rows:
        if got[r.page_id].rule is None:
            fits = [x for s, found in rules.items() if s <= set(r.t) for x in found]
            surest = max((c for _, c, _ in fits), default=None)
            assert got[r.page_id].verdict in ({v for v, c, _ in fits if c == surest} or {"allow"})
            assert (got[r.page_id].mined is None) == (not fits)
            n_mined += bool(fits)
            assert got[r.page_id].verdict == "block" or "zzwin-zzbets" not in r.url
    assert n_mined > 0


def test_url_query_rows(spark):
    out = url_rules.op7_url_rules(spark, DATA)
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    rows = out.collect()
    assert len(rows) == len(pages)
    for r in rows:
        host, path, rule, verdict = plain_rule(pages[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and (verdict is None or verdict == r.verdict)


@pytest.mark.parametrize("planted", [False, True])
def test_url_plan_holds_no_mining(spark, planted):
    """Mining's steps are saved: what is planned for the judged pages reads the rules, and mines them for no reader again."""
    url = F.when(F.xxhash64("url") % 4 == 0, F.regexp_replace("url", "://", "://zzwin-zzbets.")).otherwise(F.col("url")) if planted else F.col("url")
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", url.alias("url"))
    by = url_rules.decided(pages).withColumn("bad", F.col("bad") | F.col("url").contains("zzwin-zzbets"))
    out = url_rules.judge(pages, by, support=0.02)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") <= 2 and plan.count("Join") <= 2 and plan.count("Relation") <= 3
    assert (out.where("mined is not null").count() > 0) == planted
