import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, graph, near_dup, substring


def plain_components(texts, share=80, size=4):
    sets = {}
    for i, t in texts:
        w = bytes((t or "").encode()).lower().split()
        sets[i] = frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= share * (len(sets[a]) + len(sets[b]) - n):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def variants(seed, n, words=120):
    """Copies, near copies of them and near copies of those, so that links come in chains and groups have stragglers."""
    rng = random.Random(seed)
    made = []
    for k in range(n):
        if k and rng.random() < 0.8:
            w = list(rng.choice(made[-25:]))
            for _ in range(rng.choice((0, 1, 1, 2, 3, 6))):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        else:
            w = [f"w{rng.randrange(500)}" for _ in range(rng.choice((1, 3, 4, 20, words)))]
        made.append(w)
    return [(k, " ".join(w)) for k, w in enumerate(made)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, docs_of, seed):
    rows = [*variants(seed, 220), (900, None), (901, ""), (902, " \t\n"), (903, "Hello World"), (904, "hello world"), (905, "ÄB c d e"), (906, "äB c d e")]
    want = plain_components(rows)
    got = {r.doc_key: (r.n_shingles, r.component) for r in near_dup.near_duplicates(docs_of(rows)).collect()}
    assert got == want


def test_only_texts_that_may_be_asked_for_are_sent(spark, docs_of):
    keyed = near_dup.keyed(docs_of([(k, f"text {k % 1500}") for k in range(3000)] + [(None, None), (-5, "")]))
    asked = keyed.where("doc_key % 50 = 0 or text is null").drop("text")
    found = near_dup.likely(keyed, asked)
    assert found.columns == keyed.columns and found.join(asked, ["doc_key", "text_key"]).count() == asked.count() == 61
    assert found.count() < 61 + 3 * 3000 / near_dup.BITS
    assert near_dup.likely(keyed, asked.limit(0)).count() == 0


def test_members_are_joined_with_their_nodes_once(spark, docs_of, monkeypatch):
    plans, saved = {}, near_dup.saved
    monkeypatch.setattr(near_dup, "saved", lambda df, name: plans.setdefault(name, []).append(df._jdf.queryExecution().optimizedPlan().toString()) or saved(df, name))
    rows = variants(1, 220)
    got = {r.doc_key: (r.n_shingles, r.component) for r in near_dup.near_duplicates(docs_of(rows)).collect()}
    assert got == plain_components(rows)
    by_node = [len(re.findall(r"Join Inner, \(\(node#\d+L = node#\d+L\) AND \(leader#", p)) for ps in plans.values() for p in ps]
    assert sum(by_node) == 1


def test_sets_are_dealt_out_once(spark, docs_of):
    """Joins of sets by node shuffle the other side alone, also where it is too large to be broadcast; of many copies of a text
    its node's own row makes the set."""
    docs = docs_of([*variants(1, 120), *[(k, "one text of many copies " + "a b c " * 5) for k in range(1000, 1400)]])
    sketch = near_dup.saved(near_dup.sketches(docs), "sketches")
    nodes, _ = near_dup.node_components(docs, sketch)
    sets = near_dup.set_pieces(nodes.select("node"), docs, nodes)
    held = {}
    for r in sets.collect():
        held.setdefault(r.node, []).append((r.piece, r.members))
    assert {n: sum(len(m) // 8 for _, m in x) for n, x in held.items()} == {r.node: r.n for r in nodes.collect()}
    assert sets.count() == sets.distinct().count()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = sets.join(nodes.select("node", "n"), "node")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 1 and plan.count("Exchange hashpartitioning(node") == 1
        near_dup.discarded(sets)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_hot_group_is_linked_whole(spark, docs_of):
    rng = random.Random(7)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(300):
        w = list(base)
        for _ in range(rng.choice((0, 1, 2, 3, 5, 9))):
            w[rng.randrange(150)] = f"x{k}-{rng.random()}"
        rows.append((k, " ".join(w)))
    want = plain_components(rows)
    got = {r.doc_key: (r.n_shingles, r.component) for r in near_dup.near_duplicates(docs_of(rows)).collect()}
    assert got == want


def test_a_large_group_with_copies_as_leaders(spark, docs_of):
    """1,500 near copies of a text that is not among them, against counts by an inverted index."""
    rng = random.Random(9)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(1500):
        w = list(base)
        for _ in range(rng.choice((1, 2, 3, 4, 5))):
            w[rng.randrange(150)] = f"x{k}-{rng.random()}"
        rows.append((k, " ".join(w)))
    sets = [[" ".join(w[k : k + 4]) for k in range(147)] for w in (t.split() for _, t in rows)]
    numbers = {}
    ids = [np.unique([numbers.setdefault(x, len(numbers)) for x in s]) for s in sets]
    held = [[] for _ in numbers]
    for k, s in enumerate(ids):
        for x in s:
            held[x].append(k)
    root = list(range(len(ids)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, s in enumerate(ids):
        both = np.bincount(np.concatenate([held[x] for x in s]), minlength=len(ids))
        for j in np.flatnonzero(100 * both >= 80 * (np.array(list(map(len, ids))) + len(s) - both)):
            a, b = sorted((find(k), find(int(j))))
            root[b] = a
    got = {r.doc_key: r.component for r in near_dup.near_duplicates(docs_of(rows)).collect()}
    assert got == {k: find(k) for k in range(len(ids))} and len(set(got.values())) > 20


def test_long_and_repeated_texts_in_pieces(spark, docs_of, monkeypatch):
    """Sets of many pieces, parts of a group, repeated rows, equal ids of unlike texts."""
    monkeypatch.setattr(near_dup, "PIECE", 40)
    monkeypatch.setattr(near_dup, "PART", 3)
    rows = variants(6, 60, 300)
    want = plain_components(rows)
    docs = docs_of([*rows, *rows[:20]])
    assert {r.doc_key: (r.n_shingles, r.component) for r in near_dup.near_duplicates(docs).collect()} == want
    a, b = "a b c d e f", "q r s t u v"
    found = near_dup.near_duplicates(docs_of([(3, a), (5, a), (5, b)])).collect()
    assert sorted((r.doc_key, r.component) for r in found) == [(3, 3), (5, 3), (5, 5)]


def test_near_duplicates_edges(spark, docs_of):
    docs = docs_of([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (None, "q r s t u"), (3, None)])
    rows = near_dup.near_duplicates(docs).collect()
    assert len(rows) == 5 and sorted(r.component for r in rows if r.n_shingles == 3) == [5, 5, 5]
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0
    kept = near_dup.without_near_duplicates(docs_of([(2, "a b c d e f"), (1, "a b c d e f"), (7, "z")]))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 7] and "kept" in kept.columns


def test_stage_keeps_one_row_of_each_group(spark, docs_of):
    a, b, c = "a b c d e f", "q r s t u v", "k l m n o p"
    rows = [(None, a), (None, a), (None, a.upper()), (None, b), (5, c), (5, c), (5, "g h i j"), (None, c), (8, None), (8, " "), (None, "")]
    kept = near_dup.without_near_duplicates(docs_of(rows))
    got = sorted(((r.doc_id, r.text and r.text.lower()) for r in kept.collect()), key=str)
    assert got == sorted([(None, a), (None, b), (5, c), (5, "g h i j"), (8, None), (8, " "), (None, "")], key=str)
    assert kept.columns == docs_of(rows).columns


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.root for r in graph.components(links).collect()}
    assert got == {**{k: 0 for k in range(201)}, 1000: 1000, 1001: 1000}


def plain_removed(rows):
    first, out = {}, []
    key = lambda i: 2**63 if i is None else i
    for i, t in sorted(rows, key=lambda r: key(r[0])):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            window = tuple(w[k : k + 50])
            if first.setdefault(window, key(i)) < key(i):
                gone[k : k + 50] = [True] * 50
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def passages(seed, n):
    rng = random.Random(seed)
    own = lambda k: [f"w{rng.randrange(3000)}" for _ in range(k)]
    shared = [own(rng.choice((49, 50, 51, 80, 200))) for _ in range(6)]
    rows = []
    for k in range(n):
        w = []
        for _ in range(rng.randint(0, 3)):
            w += own(rng.randint(0, 60)) + rng.choice(shared)[rng.choice((0, 0, 3)) :]
        rows.append((rng.choice((k, k, k, k // 2, None)), "\n".join(w) if k % 3 else "  ".join(w)))
    return [*rows, (5000, "same " * 200), (5001, "same " * 120), (5002, None), (5003, "")]


@pytest.mark.parametrize(("seed", "share"), [(1, 1 << 18), (2, 1 << 18), (1, 20), (3, 60)])
def test_removed_words_equal_brute_force(spark, docs_of, monkeypatch, seed, share):
    """With small shares nearly every bucket is dealt to several groups."""
    monkeypatch.setattr(substring, "SHARE", share)
    rows = passages(seed, 80)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.removed(docs_of(rows)).collect()), key=str)
    assert got == plain_removed(rows)


def test_removed_edges(spark, docs_of):
    docs = docs_of([(1, "a")])
    assert substring.removed(docs.limit(0)).count() == 0
    out = substring.removed(docs)
    assert out.first().kept_text is None and "kept" in out.columns


def test_removed_with_clashing_names(spark, docs_of):
    rows = passages(5, 12)
    names = ("doc_key", "text_key", "row", "cut", "ranges", "wanted", "minimiser", "name", "first", "end", "n", "n_removed", "kept_text")
    docs = docs_of(rows)
    for n in names:
        docs = docs.withColumn(n, F.lit(f"own {n}"))
    out = substring.removed(docs)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out.collect()), key=str) == plain_removed(rows)
    assert {tuple(r[n] for n in names[:-2]) for r in out.collect()} == {tuple(f"own {n}" for n in names[:-2])}
    kept = near_dup.without_near_duplicates(docs)
    assert kept.columns == docs.columns and {r.doc_key for r in kept.collect()} == {"own doc_key"}


def test_super_kmers_cover_every_window_once():
    rng = random.Random(4)
    words = [f"w{rng.randrange(40)}".encode() for _ in range(700)]
    least, first, n = substring.super_kmers(words, substring.WordHashes())
    covered = [k for a, b in zip(first, n, strict=True) for k in range(a, a + b)]
    assert covered == list(range(651)) and len(least) == len(first)


def test_shared_dir_reads_the_session(spark):
    assert common.shared_dir(spark) == common.shared_dir(spark)
