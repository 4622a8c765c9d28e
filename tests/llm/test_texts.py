import hashlib
import math
import os
import random
import time
from zlib import crc32

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from tessera.llm import bpe, fingerprint, html_text, near_dup, quality, toxicity

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def odd_texts(n, seed):
    rng = random.Random(seed)
    pool = [*"abcdefghijklmnopqrstuvwxyz  \n\t.,!?0123'", "the", "ing", "é", "ß", "Σ", "İ", "ы", "中", "🙂", "́", "’", "<|endoftext|>", "<|start", "\x1c", "\u3000", "½"]
    return ["".join(rng.choice(pool) for _ in range(rng.randint(0, 120))) for _ in range(n)]


def test_bpe_equals_library(spark, library):
    texts = [*odd_texts(400, 1), "", " ", "a" * 5000, "<|startoftext|>Hi<|endoftext|>", "ΟΔΥΣΣΕΥΣ ΑΣ"]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate([*texts, None])], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in bpe.tokenized(df, with_ids=True).collect()}
    for k, t in enumerate([*texts, ""]):
        want = library.encode(t, add_special_tokens=False).ids
        assert got[k].ids == want and got[k].n_tokens == len(want)
        assert got[k].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.tokenized(df.limit(0)).count() == 0


def test_bpe_query(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in bpe.op2_bpe(spark, DATA).collect():
        assert r.ids_sha256 == hashlib.sha256(np.array(library.encode(texts[r.doc_id], add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()


def test_bpe_words_met_often_stay_known(monkeypatch, library):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    e, rng = bpe.Encoder(bpe.tokenizer_path()), random.Random(5)
    met, encode_word = [], e.encode_word
    monkeypatch.setattr(e, "encode_word", lambda w: met.append(w) or encode_word(w))
    for k in range(60):
        text = " ".join(["often", *("".join(rng.choice("abcdeé") for _ in range(6)) + f"x{'q' * k}" for _ in range(10)), "often"])
        want = library.encode(text, add_special_tokens=False).ids
        ids, written = e.encoded(text)
        assert ids == np.array(want, "<u4").tobytes() and written == e.decode(ids) == library.decode(want, skip_special_tokens=False).encode()
    assert len(e.known) + len(e.older) <= 100 and met.count("often") == 1


def plain_quality(text):
    text = text or ""
    ws = [c for c in "".join(x if x not in " \t\n\x0b\x0c\r" else " " for x in text).split(" ") if c]
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if line.strip(" \t\n\x0b\x0c\r"):
            dup += line in seen
            seen.add(line)
    grams = [tuple(ws[k : k + 3]) for k in range(len(ws) - 2)]
    inside = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def test_base_counts(spark):
    texts = [None, "", "a b c a b c d", "x\nx\n \n \nx y", "ä#é\x1c ö\u3000z &|", "p q r\x0bp q r\rp q", *(t[:200] for t in odd_texts(60, 2))]
    df = spark.createDataFrame([(k, t, None if k % 2 else "en", 1) for k, t in enumerate(texts)], "doc_id long, text string, lang string, kept int")
    for r in quality.judged(df).collect():
        n, chars, symbols, dup, rep = plain_quality(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n) and not (r.base_failed and r.kept)
    assert quality.judged(df.limit(0)).count() == 0


def test_references_leave_out_what_fails_the_base_rules(spark):
    rng = random.Random(4)
    prose = lambda lang, n: " ".join(rng.choice([*quality.COMMON[lang], *(f"{lang}{k}" for k in range(60))]) for _ in range(n))
    good = {lang: [prose(lang, n) for n in (50, 80, 300)] for lang in ("de", "en")}
    bad = [("de", "### 11 " * 20_000), ("en", "the " * 60), ("en", prose("en", 49)), ("fr", "la 1 " * 40), ("en", None)]
    df = spark.createDataFrame([*((lang, t) for lang, ts in good.items() for t in ts), *bad], "lang string, text string")
    assert not any(100 * plain_quality(t)[4] > 50 * plain_quality(t)[0] for ts in good.values() for t in ts)
    chars, common = quality.references(df)
    assert len(chars) == len(common) == 2 + len(quality.SHARES)
    for k, lang in enumerate(("de", "en")):
        text, ws = "".join(good[lang]), " ".join(good[lang]).split()
        lower, digit, blank = (sum(map(text.count, c)) / len(text) for c in ("abcdefghijklmnopqrstuvwxyz", "0123456789", " "))
        assert np.allclose(chars[k][[quality.CLASSES.index(c) for c in ("lower", "digit", "blank", "symbol")]], [lower, digit, blank, 0])
        assert np.allclose(common[k][:-1], [ws.count(w) / len(ws) for w in quality.VOCABULARY])


def test_quality_keeps_clean_and_drops_junk(spark):
    rows = quality.op3_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    clean = [r.kept for r in rows if r.quality == 1 and not r.base_failed]
    junk = [r.kept for r in rows if r.quality == 0]
    assert all(clean) and sum(junk) <= 0.12 * len(junk)


def test_distance_bounds():
    p, q = np.array([3.0, 1, 0]), np.array([[0.75, 0.25, 0], [0, 0, 1.0]])
    d = quality.distance(p, q)
    assert d[0] == 0 and abs(d[1] - 1) < 1e-9


def plain_sketch(text):
    ws = text.encode().split()
    ws = [w.decode() for w in ws]

    def h(parts):
        seed = 42
        for x in parts:
            seed = xxhash.xxh64_intdigest(x.encode(), seed)
        return seed - 2**64 if seed >= 2**63 else seed

    every = {h(ws[k : k + 5]) for k in range(len(ws) - 4)} if len(ws) >= 5 else ({h([" ".join(ws)])} if ws else set())
    low = {x for x in every if x < -(2**63) + 2**64 // 4}
    return sorted(low or ([min(every)] if every else []))


def test_fingerprints_equal_brute_force(spark):
    texts = {k: t for k, t in enumerate(["", "one", "a b c d", *(f"{t} tail of words here" for t in odd_texts(40, 3)), "same " * 30, "same " * 30])}
    texts[90] = " ".join(f"w{k}" for k in range(900))
    df = spark.createDataFrame([(k, t or None, 5) for k, t in texts.items()], "doc_id long, text string, print int")
    got = {r.doc_id: r for r in fingerprint.fingerprints(df).collect()}
    order = sorted(texts, reverse=True)
    show = lambda s: "".join(f"{x % 2**64:016x}" for x in s)
    like = lambda a, b: 1.0 if not a and not b else 0.0 if not a or not b else len(set(a) & set(b)) / min(len(a), len(b))
    for k, i in enumerate(order):
        t, after = texts[i], texts[order[(k + 1) % len(order)]]
        third = len(t) // 3
        edited = t[: len(t) - third] + after[:third]
        a, b, c = plain_sketch(t), plain_sketch(edited), plain_sketch(after)
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (show(a), show(b))
        assert abs(r.near_edited - like(a, b)) < 1e-12 and abs(r.near_next - like(a, c)) < 1e-12
    assert fingerprint.fingerprints(df.limit(0)).count() == 0
    assert fingerprint.fingerprints(df.where("doc_id = 90")).first().near_next == 1.0


@pytest.mark.parametrize("ids", [
    [0, 1, 2, 50, 51, 7, 7, 1000, None, None, None, None],
    [-(2**63), -(2**62) - 5, 1, 2**62 + 9, 2**63 - 1, None],
    [(k * 0x9E3779B97F4A7C15) % 2**64 - 2**63 for k in range(60)],
    [c * 2**30 + k for c in (3, 900_000) for k in range(40)],
])
def test_next_over_many_blocks(spark, monkeypatch, ids):
    """Repeated and null ids, hashed ids of 64 bits, clusters of ids."""
    monkeypatch.setattr(fingerprint, "BLOCK", 3)
    df = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "doc_id long, text string")
    got = {(r.doc_id, r.text): r.next_text for r in fingerprint.with_next(df, {}).collect()}
    h = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) + 2**63) % 2**64
    order = sorted(((i, f"t{k}") for k, i in enumerate(ids)), key=lambda x: (x[0] is None, -(x[0] or 0), h(x[1])))
    assert got == {order[k]: order[(k + 1) % len(order)][1] for k in range(len(order))}
    most = df.select(fingerprint.blocks_of(df).alias("b")).groupBy("b").count().agg(F.max("count")).first()[0]
    assert most <= 9


def test_fingerprints_of_unions(spark):
    """The merged fingerprints of two hash sets are the fingerprint of the united set, small sets too."""
    rng = random.Random(3)
    sets = [[rng.randrange(-(2**63), 2**63) for _ in range(rng.choice((0, 1, 1, 2, 9)))] for _ in range(120)]
    df = spark.createDataFrame(list(zip(sets[::2], sets[1::2])), "a array<long>, b array<long>")
    out = df.select(fingerprint.merged(fingerprint.retained(F.col("a")), fingerprint.retained(F.col("b"))).alias("got"), fingerprint.retained(F.array_union("a", "b")).alias("want"))
    assert all(r.got == r.want for r in out.collect())


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    out = toxicity.op1_toxicity(spark, folder)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    rows = out.collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels and lang[r.doc_id] == "en"]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([a > b for a in good for b in bad]) > 0.93


def test_toxicity_edges(spark, docs_of):
    docs = docs_of([(1, "you idiot"), (2, None), (3, ""), (None, "fine"), (2, "a b"), (9, "x" * 100_000)])
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.scored(docs, labels).count() == 6
    assert toxicity.scored(docs, labels.limit(0)).where("score is null").count() == 0
    assert toxicity.scored(docs.limit(0), labels).count() == 0


def test_misspellings_share_grams():
    word, bucket = toxicity.grams([b"Worthless!", b"worthles", b"--"])
    a, b = set(bucket[word == 0]), set(bucket[word == 1])
    assert len(a & b) > len(b) / 2 and not (word == 2).any()
    # n-grams of 3 to 6 letters of <worthless>, each hashed alike wherever it stands
    assert (word == 0).sum() == 9 + 8 + 7 + 6
    assert {*toxicity.grams([b"x", b"worthless"])[1]} >= a


def test_long_words_are_read_whole():
    long = "".join(chr(0x4E00 + k * 7 % 5000) for k in range(500))
    split = toxicity.words_of(f"a {long}, {'b' * (toxicity.PIECE - 2)}")
    assert split[0] == b"a" and split[-1] == b"b" * (toxicity.PIECE - 2) and max(map(len, split[1:-1])) == toxicity.PIECE
    assert {*toxicity.grams(split[1:-1])[1]} == {*toxicity.grams([long.encode()])[1]}
    assert len({*toxicity.grams([long.encode()])[1]}) > 1900  # 500 n-grams of each of four sizes


def test_toxicity_of_joined_texts():
    rng = random.Random(3)
    plain = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    bad = ["worthless", "idiot", "scum", "moron"]
    line = lambda n, k: [rng.choice(plain) for _ in range(n)] + rng.sample(bad, k)
    model = toxicity.train([" ".join(line(30, k)) for k in (0, 4) * 150], np.array([0, 1] * 150))
    score = lambda t: model.scores_of([t], toxicity.WordScores(model.scores))[0]
    for joint in ("\u00a0", "\u3000", "_", "/", ""):
        clean = line(200, 0)
        assert score(joint.join([*clean, *bad, *line(60, 0)])) > score(joint.join([*clean, *line(60, 0)])) + 0.2, joint


def test_blocks():
    page = "<html><head><title>t</title><style>x</style></head><body><nav><a href='/'>Home</a></nav><article class=main><h1>A &amp; B</h1><p>one <b>two</b>\n three<br>four<p>five</article><script>if (a<b) {}</script><!-- <p>no</p> --><p>six &lt;p&gt;"
    got = [(b.text, b.path and b.path.names, round(b.linked)) for b in html_text.blocks(page)]
    assert [x[0] for x in got] == ["Home", "A & B", "one two three four", "five", "six <p>"] and got[0][2] == 1
    assert html_text.blocks(None) == [] and html_text.blocks("<<<>>> < a") != []
    assert len(html_text.blocks("<div class=\"a" * 20_000)) < 3


def test_blocks_of_formulas_media_and_custom_elements():
    texts = lambda page: [b.text for b in html_text.blocks(page)]
    assert texts("<article><p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi></math> here.</p></article>") == ["Energy is E=m here."]
    for tag in ("video", "audio", "object", "math", "svg", "canvas", "noscript", "template", "iframe", "select"):
        page = f"<article><p>Before.</p><{tag} class=x><p>Inside.</p></{tag}><p>After.</p></article><footer>End.</footer>"
        got = html_text.blocks(page)
        assert [b.text for b in got] == ["Before.", "Inside.", "After.", "End."] and "article" in got[1].path.nearest(9) and tag not in got[2].path.nearest(9)
        got = html_text.blocks(page.replace(f"</{tag}>", ""))
        assert [b.text for b in got] == ["Before.", "Inside.", "After.", "End."] and tag not in got[3].path.nearest(9)
        got = html_text.blocks(f"<article><{tag} class='x'/><p>After.</p></article>")
        assert [(b.text, b.path.nearest(9)) for b in got] == [("After.", ("p", "article"))]
    assert texts("<article><title-bar>One.</title-bar><video-player>Two.</video-player><style-x>Three.</style-x><p>Four.") == ["One.", "Two.", "Three.", "Four."]
    assert texts("<title>a</title-b>c</title><script>x</scripts>y</script ><textarea>z</textarea><svg><style/></svg><p>One.<script>no") == ["One."]
    assert texts('<p>One.</p><script src="a.js"/>var x=1;</script><title/>t</title><p>Two.<style/>p{}') == ["One.", "Two."]
    assert texts("<p>One.</p><script src=/a/>var x=1;</script>") == ["One."]
    assert texts("<svg><path d='M0'/><text>Label</text></svg><p>One.") == ["Label", "One."]


@pytest.mark.parametrize("part", ["<a '", "<b>x", "<div>x", "<h1>x", "<!", "<script", "</script ", "<p class='a", "<li>x<b>", "</b>x", "<a \"'"])
@pytest.mark.parametrize("end", ["", "\" >"])
def test_malformed_pages_are_read_in_time(part, end):
    """Long pages without a single closed tag: one pass each, and the long sequence in bounded steps."""
    page = part * (150_000 // len(part)) + end
    began = time.time()
    found = html_text.blocks(page)
    assert time.time() - began < 8
    model, vectors = html_text.Labeller(np.random.default_rng(1)), html_text.Vectors()
    some = found[:2500]
    assert len(html_text.main_texts([page[:40_000]], model, vectors)) == 1
    if some:
        x, mask = html_text.padded([vectors.of(some)])
        assert np.allclose(model.page_logits(some, vectors, 400), model.logits(x, mask)[:, 0], atol=1e-4)


def test_forward_pass_equals_plain_loops():
    rng = np.random.default_rng(2)
    model, h = html_text.Labeller(rng), html_text.HIDDEN_DIM
    x = rng.normal(size=(4, html_text.INPUT)).astype(np.float32)
    sig = lambda v: 1 / (1 + math.exp(-v))
    want = [float(model.p["out_b"][0])] * 4
    for way, base in (("on", 0), ("back", h)):
        state, cell = [0.0] * h, [0.0] * h
        for t in range(4) if way == "on" else range(3, -1, -1):
            z = [float(model.p[f"{way}_b"][j]) + sum(float(x[t, i]) * float(model.p[f"{way}_x"][i, j]) for i in range(html_text.INPUT)) + sum(state[i] * float(model.p[f"{way}_h"][i, j]) for i in range(h)) for j in range(4 * h)]
            cell = [sig(z[h + j]) * cell[j] + sig(z[j]) * math.tanh(z[3 * h + j]) for j in range(h)]
            state = [sig(z[2 * h + j]) * math.tanh(cell[j]) for j in range(h)]
            want[t] += sum(state[j] * float(model.p["out"][base + j, 0]) for j in range(h))
    assert np.allclose(model.logits(x[:, None], np.ones((4, 1), bool))[:, 0], want, atol=1e-3)


#: Pages written by hand; main text stands between two §.
BY_HAND = (
    "<html><body><div id=top><a href=/>Start</a> <a href=/b>Blog</a> <a href=/c>Kontakt</a></div><div class=post><h1>§How to keep bees§</h1><p>§Bees need water, shade and flowers near the hive.§</p>"
    "<p>§In spring the keeper looks into every hive once a week, and feeds weak ones.§</p><ul><li>§Smoke the hive gently.§</li><li>§Lift one frame at a time.§</li></ul></div>"
    "<div class=sidebar><h3>Popular posts</h3><ul><li><a href=1>Ten trees to plant</a></li><li><a href=2>Why we mulch</a></li></ul></div><div id=footer>Copyright 2019. <a href=/p>Privacy</a></div></body></html>",
    "<body><header><p>The Daily Page</p><nav><ul><li><a href=1>World</a><li><a href=2>Sport</a></ul></nav></header><div class='cookie-banner'>This page uses cookies. <button>Accept</button></div>"
    "<main><h1>§Bridge opens after nine years§</h1><p>§The bridge over the river was opened on Monday by the mayor, who walked across it first.§<div class=advert>Buy two lamps, get one free!</div>"
    "<p>§Work began nine years ago and cost twice what was planned.§<blockquote>§It was worth the wait, said one of the builders.§</blockquote></main>"
    "<section class=comments><h2>2 comments</h2><div class=comment><p>I walk there each day and it is lovely.</p></div><div class=comment><p>Far too expensive if you ask me.</p></div></section><footer>All rights reserved</footer>",
    "<div class=wrap><div class=menu><a href=a>Home</a><a href=b>Shop</a></div><article><h2>§Onion soup§</h2><p>§Slice six onions as thin as you can and cook them slowly in butter.§</p><table><tr><td>§Onions§</td><td>§six§</td></tr></table>"
    "<p>§Pour in the stock and let it simmer for half an hour.§</p></article><form class=newsletter><p>Get recipes by mail</p><input><button>Sign up</button></form><aside class=related><a href=x>Leek soup</a></aside></div>",
)


def test_pages_by_hand():
    """Labels are the writer's own: no rule on elements gives them."""
    model, vectors = html_text.train(html_text.labelled_pages([])), html_text.Vectors()
    right = n = 0
    for page in BY_HAND:
        truth = {b.text.strip("§"): b.text.startswith("§") for b in html_text.blocks(page)}
        got = html_text.main_texts([page.replace("§", "")], model, vectors)[0].split("\n\n")
        right, n = right + sum((t in got) == yes for t, yes in truth.items()), n + len(truth)
    assert n > 30 and right >= 0.9 * n


def test_what_deep_elements_are_inside_counts():
    model, vectors = html_text.train(html_text.labelled_pages([])), html_text.Vectors()
    for k in (10, 45, 300):
        deep = lambda x: "<div>" * k + x + "</div>" * k
        page = (
            "<nav><ul><li><a href=x>Home</a></li></ul></nav>" + deep("<article><h1>A title here</h1><p>The first long sentence of the article stands here, and it goes on.</p><p>And a second one, as long as the first.</p></article>")
            + deep('<aside class="comments"><p>I do not agree with this text at all, said a reader.</p></aside>') + f'<aside class="comments">{deep("<p>A hidden reader says that this is wrong, so wrong.</p>")}</aside><footer>Copyright 2020</footer>'
        )
        assert html_text.main_texts([page], model, vectors)[0].split("\n\n")[1:] == ["The first long sentence of the article stands here, and it goes on.", "And a second one, as long as the first."], k


def test_path_vectors_need_no_cache(monkeypatch):
    page = html_text.blocks("<div class=a>" * 50 + "<p>x</p>" * 30 + "<i>y</i>")
    whole = html_text.Vectors().of(page)
    monkeypatch.setattr(html_text, "HELD", 3)
    assert np.array_equal(whole, html_text.Vectors().of(page))


def test_gradients_are_right():
    rng = np.random.default_rng(1)
    model = html_text.Labeller(rng)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, mask = html_text.padded([rng.normal(size=(5, html_text.INPUT)), rng.normal(size=(3, html_text.INPUT))])
    truth = (rng.random(mask.shape) > 0.5) * 1.0

    def loss():
        z = model.logits(x, mask)
        return float(((np.logaddexp(0, z) - truth * z) * mask).sum() / mask.sum())

    g = model.gradients(x, mask, truth)
    for name in model.p:
        at = tuple(int(rng.integers(n)) for n in model.p[name].shape)
        keep, eps = model.p[name][at], 1e-4
        model.p[name][at] = keep + eps
        up = loss()
        model.p[name][at] = keep - eps
        down = loss()
        model.p[name][at] = keep
        assert abs((up - down) / (2 * eps) - g[name][at]) < 1e-3, name


def test_html_query(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    rows = html_text.op8_html_text(spark, DATA).collect()
    right = sum(r.text == "\n\n".join(b.text for b in html_text.blocks(pages[r.page_id]) if html_text.said_main(b.path)) for r in rows)
    assert len(rows) == len(pages) and right >= 0.98 * len(rows) and all(r.n_chars == len(r.text) for r in rows)


def test_html_edges(spark):
    df = spark.createDataFrame([(1, "u", None, 1), (2, None, "", 1), (None, "v", "<article><p>Text here.</article>", 1)], "page_id long, url string, html string, text int")
    rows = html_text.extracted(df).collect()
    assert len(rows) == 3 and {r.text for r in rows if r.page_id} == {""}


def plain_class(c):
    if c in " \t":
        return "blank"
    if c in "\n\r":
        return "line"
    if c in ".,;:!?":
        return "stop"
    if c in "'\"-()[]/":
        return "mark"
    if c in "#*$%&|<>@^_~=+{}\\`":
        return "symbol"
    if "a" <= c <= "z":
        return "lower"
    if "A" <= c <= "Z":
        return "upper"
    if "0" <= c <= "9":
        return "digit"
    if ord(c) < 32 or 0x7F <= ord(c) <= 0x9F:
        return "control"
    return "accented" if 0xC0 <= ord(c) <= 0x24F else "other"


def plain_histograms(text):
    chars, words = {}, {}
    for c in text:
        chars[plain_class(c)] = chars.get(plain_class(c), 0) + 1
    listed = {w for ws in quality.COMMON.values() for w in ws}
    for w in text.split():
        key = w.strip(".,;:!?'\"-()[]").lower()
        key = key if key in listed else ""
        words[key] = words.get(key, 0) + 1
    return chars, words


def plain_distance(p, q):
    p, q = ({k: v / sum(h.values()) for k, v in h.items()} for h in (p, q))
    total = 0.0
    for k in p.keys() | q.keys():
        a, b = p.get(k, 0), q.get(k, 0)
        m = (a + b) / 2
        total += (a * math.log2(a / m) if a else 0) / 2 + (b * math.log2(b / m) if b else 0) / 2
    return math.sqrt(max(total, 0))


def test_quality_verdict_equals_plain_loops(spark):
    rng = random.Random(12)
    pool = {lang: [*ws, *[f"{lang}wort{k}" for k in range(40)]] for lang, ws in quality.COMMON.items()}
    write = lambda lang, n: " ".join(rng.choice(pool[lang]) + rng.choice(("", "", "", ",", ".")) for _ in range(n))
    rows = [(write(lang, rng.choice((45, 70, 200, 400))), lang) for lang in ("de", "en", "fr") for _ in range(12)]
    rows += [(" ".join(f"#{k}$" for k in range(n)), "en") for n in (60, 90)] + [("QXZ " * 3 + " ".join(f"Z{k}Q" for k in range(80)), "de"), (write("en", 150) + " " + write("de", 150), None)]
    rows += [("one two three four " * 30, "en"), (None, "en"), ("", "fr")]
    docs = spark.createDataFrame([(k, t, lang) for k, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality.judged(docs).collect()}
    sums = {}
    for k, (t, lang) in enumerate(rows):
        if lang and not got[k].base_failed:
            for total, part in zip(sums.setdefault(lang, ({}, {})), plain_histograms(t), strict=True):
                for key, n in part.items():
                    total[key] = total.get(key, 0) + n
    shares = [tuple({k: v / sum(h.values()) for k, v in h.items()} for h in sums[lang]) for lang in sorted(sums)]
    blend = lambda a, b, s: {k: s * a.get(k, 0) + (1 - s) * b.get(k, 0) for k in a.keys() | b.keys()}
    shares += [tuple(blend(x, y, s) for x, y in zip(shares[i], shares[j], strict=True)) for i in range(len(sums)) for j in range(i) for s in (0.25, 0.5, 0.75)]
    kept = 0
    for k, (t, _) in enumerate(rows):
        r = got[k]
        if r.base_failed:
            assert not r.kept and r.char_distance is None
            continue
        chars, words = plain_histograms(t)
        n = len(t.split())
        near = [(plain_distance(chars, c), plain_distance(words, w)) for c, w in shares]
        want = any(a <= 0.16 + 0.9 / math.sqrt(n) and (n < 60 or b <= 0.18 + 1.5 / math.sqrt(n)) for a, b in near)
        a, b = min(near, key=sum)
        assert r.kept == want and abs(r.char_distance - a) < 1e-9 and abs(r.word_distance - b) < 1e-9
        kept += want
    assert 20 < kept < len([r for r in got.values() if not r.base_failed])


def test_toxicity_scores_equal_plain_loops():
    rng = np.random.default_rng(3)
    table = rng.normal(size=toxicity.BUCKETS).astype(np.float32)
    model = toxicity.Model(table, 0.25, 1.5, 0.5)

    def bucket(gram):
        h = 0
        for c in gram:
            h = (h * 0x100000001B3 + ord(c)) % 2**64
        return ((h + len(gram)) * 0x9E3779B97F4A7C15) % 2**64 >> 46

    def word_score(edged):
        grams = [edged[k : k + n] for n in (3, 4, 5, 6) for k in range(len(edged) - n + 1)]
        return sum(float(table[bucket(g)]) for g in grams) / max(len(grams), 1)

    def score(text):
        words = []
        for w in (text or "").split():
            edged = f"<{w.lower().strip(toxicity._STRIP)}>"
            # Pieces of a long run: 16 characters each, the last five of one the first of the next.
            words += [edged] if len(w) <= 64 or len(edged) <= 66 else [edged[k : k + 16] for k in range(0, len(edged) - 5, 11)]
        each = [word_score(w) for w in words]
        n = max(1, (len(each) + 12) // 24)
        chunks = [each[24 * k : 24 * (k + 1) if k + 1 < n else None] for k in range(n)]
        z = 0.25 + (max(sum(c) / len(c) for c in chunks) if each else 0)
        return 1 / (1 + math.exp(-(1.5 * (z - 0.5) + math.log(0.7 / 0.3))))

    texts = [None, "", "one", "Bad, WORDS here!", " ".join(f"w{k}" for k in range(100)), "x" * 64 + "worthless", "ab_" * 60 + " end", " ".join(f"wort{k}é" for k in range(37)), "- . !"]
    got = model.scores_of(texts, toxicity.WordScores(table))
    assert np.allclose(got, [score(t) for t in texts], atol=1e-6)


def test_blocks_tagged_alike_in_one_element_share_a_path_vector(monkeypatch):
    page = html_text.blocks("<article class='x'>" + "<p>One 2 three</p>" * 200 + "<p id='last'>End</p></article>")
    vectors, asked = html_text.Vectors(), []
    of_names = vectors.of_names
    monkeypatch.setattr(vectors, "of_names", lambda names: asked.append(names) or of_names(names))
    rows = vectors.of(page)
    assert len(rows) == 201 and len(asked) <= 4
    assert (rows[:200, : html_text.PATH_DIM] == rows[0, : html_text.PATH_DIM]).all() and (rows[200, : html_text.PATH_DIM] != rows[0, : html_text.PATH_DIM]).any()


def test_a_worker_drops_the_encoder_when_other_operators_use_it(spark, docs_of, monkeypatch):
    """One task after the other in one Python worker: the encoder stays between its own tasks, others let go of it."""
    monkeypatch.setitem(spark.sparkContext.environment, "WORKERS_OF", "this test alone")
    docs = docs_of([(k, f"some words of text {k}") for k in range(20)]).coalesce(1)

    def encoders(batches):
        import gc

        list(batches)
        yield pd.DataFrame({"pid": [os.getpid()], "n": [sum(type(x).__name__ == "Encoder" and type(x).__module__ == bpe.__name__ for x in gc.get_objects())]})

    seen = lambda: docs.select("doc_id").mapInPandas(encoders, "pid long, n long").collect()[0]
    bpe.tokenized(docs).collect()
    before = seen()
    quality.judged(docs).collect()
    near_dup.sketches(docs).collect()
    after = seen()
    assert before.pid == after.pid and (before.n, after.n) == (1, 0)
