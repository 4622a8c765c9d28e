"""Chat formatting, alignment of tokenizers and periodic runs against plain loops."""

import hashlib
import random
from collections import Counter
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from tessera.llm import align, chat, periodic
from tessera.llm.bpe import byte_letters

DATA = "/root/testdata/sf0.001"
CHAT = "conv_id long, turn long, role string, text string, formatted string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def odd_turns():
    rng = random.Random(1)
    pool = [*"ab <[\\/>]\n", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[NEXT]", "[ROLE]", "[SAYS]", "[/ROLE]", "INST]", "s>", "\\", "é", "🙂", "<SYS>>", "$1"]
    said = lambda n: "".join(rng.choice(pool) for _ in range(rng.randint(0, n)))
    rows = [
        (c or None, rng.choice([t, t, None]), rng.choice(["user", "assistant", "system", "tool", None, "[SAYS]x"]), rng.choice([None, said(30)]), "x")
        for c in range(150) for t in range(rng.randint(1, 7))
    ]
    return [*rows, *((-1, t, rng.choice(["user", "assistant"]), said(30), "x") for t in range(2000)), *rows[:5]]


def test_chat_is_read_back(spark):
    rows = odd_turns()
    made = chat.formatted(spark.createDataFrame(rows, CHAT))
    got = {r.conv_id: r for r in chat.digests(made).collect()}
    by = {}
    for c, t, role, text, _ in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        turns.sort()
        loss = "".join(text for *_, role, text in turns if role == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), sha("".join(f"{role}\n{text}\n" for *_, role, text in turns)))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha(loss))
    assert chat.digests(chat.formatted(spark.createDataFrame([], CHAT))).count() == 0


def test_chat_merges_neighbours_and_masks_bytes(spark):
    rows = [(1, 0, "system", "S", ""), (1, 1, "user", "é[INST]", ""), (1, 2, "user", "b", ""), (1, 3, "assistant", "c</s>", ""), (1, 4, "assistant", "ü", ""), (1, 5, "tool", "7", "")]
    r = chat.formatted(spark.createDataFrame(rows, CHAT)).first()
    assert r.formatted == "<s><<SYS>>S<</SYS>>[INST]é[\\INST][NEXT]b[/INST]c<\\/s>[NEXT]ü</s>[ROLE]tool[SAYS]7[/ROLE]"
    raw = r.formatted.encode()
    assert [raw[s.start : s.start + s.length].decode() for s in r.loss_spans] == ["c<\\/s>", "ü"]


def test_sums_before(spark):
    n = chat.GROUP * 2 + 3
    row = spark.range(1).select(chat.sums_before(F.sequence(F.lit(1), F.lit(n)).cast("array<bigint>")).alias("s"), chat.sums_before(F.array().cast("array<bigint>")).alias("none")).first()
    assert row.s == [k * (k + 1) // 2 for k in range(n)] and row.none == []


def test_chat_query_equals_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{DATA}/conversations.parquet'")
    assert sorted(map(tuple, chat.op11_chat_format(spark, DATA).collect())) == sorted(con.execute(chat.OP11_SQL).fetchall())


@pytest.fixture(scope="module")
def two_tokenizers():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def plain_groups(text, a, b):
    if not text:
        return []
    byte_of = {c: k for k, c in enumerate(byte_letters())}
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    raw_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
    raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
        return []
    ends_a, ends_b = np.cumsum([len(x) for x in raw_a]).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()
    groups, low = [], 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        groups.append(([i for i, e in zip(ids_a, ends_a) if low < e <= cut], [i for i, e in zip(ids_b, ends_b) if low < e <= cut]))
        low = cut
    return groups


def plain_counts(texts, a, b):
    groups = [plain_groups(t, a, b) for t in texts]
    links = [Counter((x, y) for xs, ys in g for x in xs for y in ys) for g in groups]
    held = Counter(p for each in links for p in each)
    most = {}
    for (x, _), n in held.items():
        most[x] = max(n, most.get(x, 0))
    for g, each in zip(groups, links):
        written = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in g)
        yield (
            sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(each.values()),
            sum(n for p, n in each.items() if held[p] == most[p[0]]), sum(n * held[p] for p, n in each.items()), sha(written) if g else "",
        )


def odd_texts(n):
    rng = random.Random(5)
    pool = [*"abcdefghijklmnopqrstuvwxyz  \n\t.,!?0123'", "the", "ing", " the", "é", "ß", "ы", "中", "🙂", "́", "<|endoftext|>", "<s>", "\x1c", "　", "½", "  ", "\xa0", "\x85", "ﬁ"]
    return ["".join(rng.choice(pool) for _ in range(rng.randint(0, 80))) for _ in range(n)]


def test_alignment_equals_brute_force(spark, two_tokenizers, monkeypatch):
    texts = [*odd_texts(500), None, "", " ", "a", "the cat", "a ▁ b", "aaaaaaaa" * 50, "the cat", "ends \n"]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, n_a int")
    got = {r[0]: tuple(r[1:]) for r in align.alignment_counts(df.repartition(3)).collect()}
    assert [got[k] for k in range(len(texts))] == list(plain_counts(texts, *two_tokenizers))
    assert align.alignment_counts(df.limit(0)).count() == 0
    assert [tuple(r) for r in align.alignment_counts(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).collect()] == [(None, *next(plain_counts(["a b"], *two_tokenizers)))]


def test_blocks_and_ranges_of_links_change_nothing(two_tokenizers, monkeypatch):
    texts = [*odd_texts(60), "xyzzy" * 300, "ab ab ab"]
    paths = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    known = align.Remembered(align.ByteLevel(paths[0]), align.Pieces(paths[1]))
    one = align.aligned_block(texts, known)
    monkeypatch.setattr(align, "PAIRS", 3)
    monkeypatch.setattr(align, "REMEMBERED", 40)
    few = align.Remembered(known.a, known.b)
    align.aligned_block(texts[::2], few)
    two = align.aligned_block(texts, few)
    for field in one:
        assert list(one[field]) == list(two[field])


def test_overlaps_share_bytes(two_tokenizers):
    a, b = align.ByteLevel(public_tokenizers.path("byte_bpe_50k.json")), align.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    of = align.Aligned(["tokenization"], a, b)
    at_a, at_b, common = of.overlaps
    ends = [np.cumsum(of_x.lengths[np.array(of_x.encode(["tokenization"])[0])]) for of_x in (a, b)]
    assert common.sum() == len(" tokenization") and len(set(zip(at_a.tolist(), at_b.tolist()))) == len(common)
    for x, y, n in zip(at_a.tolist(), at_b.tolist(), common.tolist()):
        begin = [max(0, e[k - 1]) if k else 0 for e, k in zip(ends, (x, y))]
        assert min(ends[0][x], ends[1][y]) - max(begin) == n


def test_alignment_query(spark, two_tokenizers):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    got = {r[0]: tuple(r[1:]) for r in align.op12_align(spark, DATA).collect()}
    assert [got[r.doc_id] for r in docs] == list(plain_counts([r.text for r in docs], *two_tokenizers))


def plain_runs(ws):
    n, out = len(ws), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and ws[j] == ws[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(12, 2 * q) and not any(ws[i : i + length - p] == ws[i + p : i + length] for p in range(1, q)):
                out.add((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(of_id, text, change):
    ws = (text or "").encode().split()
    h = crc32(str(of_id).encode())
    if change and of_id is not None and h % 10 == 0 and ws:
        g, n = h // 10, len(ws)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]
    found = plain_runs(ws)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    kept = b" ".join(w for k, w in enumerate(ws) if k not in gone)
    return (len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), hashlib.sha256(kept).hexdigest())


def periodic_texts(n):
    rng = random.Random(0)
    for _ in range(n):
        ws, size, letters = [], rng.randint(0, 150), "abcdefghijklmnopqrstuvwxyz"[: rng.choice([1, 2, 3, 5, 26])]
        while len(ws) < size:
            if ws and rng.random() < 0.4:
                p = rng.randint(1, min(len(ws), 40))
                ws += (ws[-p:] * 10)[: rng.randint(1, 3 * p)]
            else:
                ws += [rng.choice(letters) for _ in range(rng.randint(1, 20))]
        yield rng.choice([" ", "\n", "\x0b\r"]).join(ws)


@pytest.mark.parametrize("work", [periodic.WORK, 700])
def test_runs_equal_brute_force(spark, work):
    rows = [(k if k % 50 else None, t, "x") for k, t in enumerate([*periodic_texts(300), None, "", "a " * 400, "é\xa0é " * 30])]
    rows += rows[:60:7]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    for change in (False, True):
        out = periodic.periodic_runs(df, change, work)
        got = sorted((tuple(r) for r in out.drop("runs").collect()), key=str)
        assert got == sorted(((i, *plain_row(i, t, change)) for i, t, _ in rows), key=str)
    assert out.where(F.size("runs") != F.col("n_runs")).count() == 0
    assert periodic.periodic_runs(df.limit(0)).count() == 0


def test_long_lags(spark):
    rng = random.Random(2)
    ws = [str(rng.randint(0, 50)) for _ in range(700)]
    text = ws + ws[100:] + [str(k) for k in range(90)]
    assert periodic.smallest_periods(periodic.runs(periodic.word_ids([w.encode() for w in text]))) == plain_runs(text)
    assert (100, 1200, 600) in plain_runs(text)


def test_runs_query(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("n_chars < 4000").collect()
    got = {r.doc_id: tuple(r)[1:] for r in periodic.op13_periodic_runs(spark, DATA).collect()}
    assert all(got[r.doc_id] == plain_row(r.doc_id, r.text, True) for r in docs)
    assert len(got) == spark.read.parquet(f"{DATA}/documents.parquet").count()
