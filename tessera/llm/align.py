"""Alignment of two tokenizers' tokens over the bytes of the same texts, and how often their ids meet in a corpus.

Each byte of a text is owned by one token of A and one of B: np.repeat of token indices by token lengths. Where the pair of
owners changes, one overlap ends and the next begins; where both owners change at once, the text is cut, and what lies
between two cuts is a group. Tokens of one group are linked, each of A with each of B.

Texts are taken in blocks of whole documents, BLOCK_BYTES or one document each. A block's texts fall into pieces at spaces
behind which neither tokenizer's tokens can reach; the different pieces of a block that its worker has not met before are
encoded and aligned in one owner array, and documents are put together from their pieces. A text with white space before a space, or whose
pieces don't give back its bytes, is one piece.

Counts: each block is one saved row with its documents' results and, by document, places in the block's list of different id
pairs. Blocks send their lists with the number of documents that hold each pair, so a pair that all documents hold travels
once a block; the lists are summed by pair, the highest count of each A id is taken over its pairs (as many as B has ids at
most), and every block gets its own pairs' counts back. No task holds the pairs of the corpus.

Tokenizer files are read by each Python worker from where they are installed; their paths are parameters.

Defined cases: null and empty texts, and those whose tokens' bytes differ from space and text, have no tokens; repeated rows
count as documents each; a null doc_id stays null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import cache
from itertools import chain, count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import byte_letters, tokenizer_path
from tessera.llm.common import saved

#: Bytes of text of a block.
BLOCK_BYTES = 3 << 20
#: An A id and a B id in one number.
B_BITS = 32
#: Pieces that a worker remembers.
REMEMBERED = 250_000
#: Linked pairs that are written out at a time.
PAIRS = 1 << 22
#: Word pieces of a byte-level text, a fixed value of these files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def token_bytes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all ids in a row, where each id's begin and the last one's end, and their lengths."""
    lengths = np.array([len(raw) for raw in raws], np.int64)
    return np.frombuffer(b"".join(raws), np.uint8), np.r_[0, np.cumsum(lengths)], lengths


class ByteLevel:
    """Tokenizer A: a byte-level BPE file, special tokens' strings taken as plain text."""

    def __init__(self, path: str):
        import tiktoken

        file = json.load(open(path, encoding="utf-8"))
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        special = {t["content"] for t in file["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in special}
        raws = [b""] * (max(ranks.values()) + 1)
        for raw, i in ranks.items():
            raws[i] = raw
        self.text, self.bounds, self.lengths = token_bytes(raws)
        self.encoding = tiktoken.Encoding("byte level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, pieces: list[str]) -> list[list[int]]:
        return [self.encoding.encode_ordinary(" " + p) for p in pieces]


class Pieces:
    """Tokenizer B: a sentence piece model that puts a space before the text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        named = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.text, self.bounds, self.lengths = token_bytes([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(named)])

    def encode(self, pieces: list[str]) -> list[list[int]]:
        return self.model.encode(pieces, num_threads=1)


def flat(lists: list[list]) -> tuple[np.ndarray, np.ndarray]:
    """All numbers in a row, and where each list begins and the last one ends."""
    bounds = np.r_[0, np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))]
    return np.fromiter(chain.from_iterable(lists), np.int64, int(bounds[-1])), bounds


def dealt(texts: list[str]) -> tuple[list[str], list[np.ndarray]]:
    """The texts' different pieces, without the space that stands before each, and by text the places of its own.

    Neither tokenizer joins what is before a space with what is behind it, where that space follows no white space.
    """
    split = [t.split(" ") if t else [] for t in texts]
    while True:
        first: dict[str, int] = {}
        bounds = np.r_[0, np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))]
        at = np.fromiter(map(first.setdefault, chain.from_iterable(split), count()), np.int64, int(bounds[-1]))
        place = np.zeros(len(at) + 1, np.int64)
        place[list(first.values())] = np.arange(len(first))
        seq, pieces = place[at], list(first)
        white = np.array([not p or p[-1].isspace() for p in pieces], bool)
        inner = white[seq]
        inner[bounds[1:][np.diff(bounds) > 0] - 1] = False
        mended = [k for k in np.unique(np.searchsorted(bounds, np.flatnonzero(inner), "right") - 1).tolist() if len(split[k]) > 1]
        if not mended:
            return pieces, [seq[i:j] for i, j in zip(bounds[:-1], bounds[1:])]
        for k in mended:
            split[k] = [texts[k]]


def gathered(bounds: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Places of all members of the lists named by which, in order."""
    sizes = bounds[which + 1] - bounds[which]
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(bounds[which] - (ends - sizes), sizes)


def summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the sum of each one's weights."""
    order = np.argsort(keys)
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[first], np.add.reduceat(weights, first) if len(first) else weights


class Aligned:
    """Pieces, encoded by both tokenizers and aligned in one owner array."""

    def __init__(self, pieces: list[str], a, b):
        n = len(pieces)
        ids_a, self.bounds_a = flat(a.encode(pieces))
        ids_b, self.bounds_b = flat(b.encode(pieces))
        raw = [(" " + p).encode("utf-8", "surrogatepass") for p in pieces]
        lengths_a, lengths_b = a.lengths[ids_a], b.lengths[ids_b]
        ends = np.r_[0, np.cumsum(np.fromiter(map(len, raw), np.int64, n))]
        #: Whether the tokens give back the piece.
        self.whole = np.ones(n, bool)
        text = np.frombuffer(b"".join(raw), np.uint8)
        for ids, lengths, bounds, of in ((ids_a, lengths_a, self.bounds_a, a), (ids_b, lengths_b, self.bounds_b, b)):
            joined = of.text[gathered(of.bounds, ids)]
            at = np.r_[0, np.cumsum(lengths)][bounds]
            if (at != ends).any() or (joined != text).any():
                self.whole &= np.array([joined[i:j].tobytes() == r for i, j, r in zip(at[:-1].tolist(), at[1:].tolist(), raw)], bool)
        keep_a, keep_b = np.repeat(self.whole, np.diff(self.bounds_a)), np.repeat(self.whole, np.diff(self.bounds_b))
        # Pieces that are not given back have no tokens from here on.
        ids_a, ids_b, lengths_a, lengths_b = ids_a[keep_a], ids_b[keep_b], lengths_a[keep_a], lengths_b[keep_b]
        self.n_a, self.n_b = np.diff(self.bounds_a) * self.whole, np.diff(self.bounds_b) * self.whole
        owner_a, owner_b = np.repeat(np.arange(len(ids_a), dtype=np.int32), lengths_a), np.repeat(np.arange(len(ids_b), dtype=np.int32), lengths_b)
        turns_a, turns_b = owner_a[1:] != owner_a[:-1], owner_b[1:] != owner_b[:-1]
        begins = np.flatnonzero(np.r_[True, turns_a | turns_b][: len(owner_a)])
        #: Overlaps: token of A, token of B (numbered over all pieces), bytes in common.
        self.overlaps = owner_a[begins], owner_b[begins], np.diff(np.r_[begins, len(owner_a)])
        group = np.r_[0, np.cumsum(turns_a & turns_b)][: len(owner_a)]
        group_a, group_b = group[np.cumsum(lengths_a) - lengths_a], group[np.cumsum(lengths_b) - lengths_b]
        n_groups = int(group[-1]) + 1 if len(group) else 0
        in_a, in_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
        piece_of = np.repeat(np.arange(n), self.n_a)
        of_group = piece_of[np.cumsum(in_a) - in_a]
        self.n_groups = np.bincount(of_group, minlength=n)
        self.n_links = np.bincount(of_group, in_a * in_b, minlength=n).astype(np.int64)
        self.written = self._written(ids_a, ids_b, group_a, group_b, in_a, in_b, of_group, n)
        self._link(ids_a, ids_b, group_a, in_b, piece_of, n)

    @staticmethod
    def _written(ids_a, ids_b, group_a, group_b, in_a, in_b, of_group, n) -> list[bytes]:
        """Each piece's groups as text, each id with the sign that follows it."""
        last_a, last_b = np.r_[group_a[1:] != group_a[:-1], True][: len(group_a)], np.r_[group_b[1:] != group_b[:-1], True][: len(group_b)]
        total = len(ids_a) + len(ids_b)
        sign = np.zeros(total, np.int64)
        ids = np.zeros(total, np.int64)
        # In front of a token of A stand all tokens of earlier groups and those of A of its own; the same with A's whole group for B.
        before_b, before_a = np.cumsum(in_b) - in_b, np.cumsum(in_a)
        at_a, at_b = np.arange(len(ids_a)) + before_b[group_a], np.arange(len(ids_b)) + before_a[group_b]
        ids[at_a], ids[at_b] = ids_a, ids_b
        sign[at_a], sign[at_b] = last_a, 2 + last_b
        text, bounds, _ = _names(int(ids.max()) + 1 if total else 1)
        which = ids * 4 + sign
        written = text[gathered(bounds, which)].tobytes()
        # The last sign of a piece is left to whoever joins pieces.
        ends = np.r_[0, np.cumsum(np.diff(bounds)[which])][np.r_[0, np.cumsum(np.bincount(of_group, in_a + in_b, minlength=n).astype(np.int64))]].tolist()
        return [written[i : max(i, j - 1)] for i, j in zip(ends, ends[1:])]

    def _link(self, ids_a, ids_b, group_a, in_b, piece_of, n) -> None:
        """Different linked id pairs: known has them all, place and links those of each piece and how often it has each."""
        first_b = np.cumsum(in_b) - in_b
        each = in_b[group_a]
        upto = np.cumsum(each)
        found = []
        low = 0
        while low < len(ids_a):
            # A range of tokens of A with PAIRS links, or one token.
            high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + PAIRS, "right")))
            sizes = each[low:high]
            ends = np.cumsum(sizes)
            b = np.arange(int(ends[-1])) + np.repeat(first_b[group_a[low:high]] - (ends - sizes), sizes)
            pair = np.repeat(ids_a[low:high] << B_BITS, sizes) | ids_b[b]
            found.append(linked(np.repeat(piece_of[low:high], sizes), pair, np.ones(len(pair), np.int64)))
            low = high
        # Ranges may meet within a piece.
        piece, self.known, self.place, self.links = found[0] if len(found) == 1 else linked(*(np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*((p, k[at], m) for p, k, at, m in found)))) if found else linked(*[np.zeros(0, np.int64)] * 3)
        self.bounds_pairs = np.searchsorted(piece, np.arange(n + 1))


def linked(piece: np.ndarray, pair: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links summed by piece and pair, in that order: pieces, all different pairs, each one's place among these, links."""
    known, place = np.unique(pair, return_inverse=True)
    keys, links = summed(piece * max(1, len(known)) + place, links)
    return keys // max(1, len(known)), known, keys % max(1, len(known)), links


@cache
def _all_names(top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return token_bytes([b"%d%c" % (i, sign) for i in range(top) for sign in b",|,;"])


def _names(top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Decimal numbers below some power of two, each followed by comma, bar, comma and semicolon."""
    return _all_names(1 << max(1, top - 1).bit_length())


FIELDS = ("n_a", "n_b", "n_groups", "n_links")


class Remembered:
    """Alignments of the pieces that a worker has met, up to a bound."""

    def __init__(self, a, b):
        self.a, self.b = a, b
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.written: list[bytes] = []
        self.whole, self.known = np.zeros(0, bool), np.zeros(0, np.int64)
        self.parts = {f: np.zeros(0, np.int64) for f in (*FIELDS, "sizes", "place_of", "links")}

    def places(self, pieces: list[str]) -> np.ndarray:
        """Place of each piece; those not met before are aligned."""
        new = [p for p in pieces if p not in self.place]
        if self.place and len(self.place) + len(new) > REMEMBERED:
            self._forget()
            new = pieces
        if new:
            more = Aligned(new, self.a, self.b)
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
            self.written += more.written
            known = np.union1d(self.known, more.known)
            held = {"place_of": np.searchsorted(known, more.known)[more.place], "sizes": np.diff(more.bounds_pairs), "links": more.links} | {f: getattr(more, f) for f in FIELDS}
            self.parts["place_of"] = np.searchsorted(known, self.known)[self.parts["place_of"]]
            self.parts = {f: np.concatenate([old, held[f]]) for f, old in self.parts.items()}
            self.known, self.whole = known, np.concatenate([self.whole, more.whole])
            self.bounds = np.r_[0, np.cumsum(self.parts["sizes"])]
        return np.fromiter(map(self.place.__getitem__, pieces), np.int64, len(pieces))


@cache
def remembered(path_a: str, path_b: str) -> Remembered:
    return Remembered(ByteLevel(path_a), Pieces(path_b))


def aligned_block(texts: list[str], pieces: Remembered) -> dict:
    """Results of a block's texts: numbers and digest of each, the block's different id pairs with the number of texts that
    hold each, and by text the places of its pairs in that list with their links."""
    words, seqs = dealt(texts)
    places = pieces.places(words)
    if not pieces.whole[places].all():
        # Texts of such pieces are judged as a whole, by one piece each.
        again = [k for k, at in enumerate(seqs) if not pieces.whole[places[at]].all()]
        of_again = {k: i for i, k in enumerate(again)}
        places = pieces.places([*words, *(texts[k] for k in again)])
        seqs = [at if k not in of_again else np.array([len(words) + of_again[k]]) for k, at in enumerate(seqs)]
        seqs = [at if pieces.whole[places[at]].all() else at[:0] for at in seqs]
    bounds = np.r_[0, np.cumsum([len(x) for x in seqs])]
    seq = places[np.concatenate([np.zeros(0, np.int64), *seqs])]
    of = pieces.parts
    text_of = np.repeat(np.arange(len(texts)), np.diff(bounds))
    out = {f: np.bincount(text_of, of[f][seq], minlength=len(texts)).astype(np.int64) for f in FIELDS}
    out["sha"] = [hashlib.sha256(b";".join(map(pieces.written.__getitem__, places[at].tolist()))).hexdigest() if len(at) else "" for at in seqs]
    at = gathered(pieces.bounds, seq) if len(seq) else seq
    n_known = max(1, len(pieces.known))
    key, links = summed(np.repeat(text_of, of["sizes"][seq]) * n_known + of["place_of"][at], of["links"][at])
    text, place = key // n_known, key % n_known
    held = np.bincount(place, minlength=n_known)
    out["pairs"], out["held"] = pieces.known[np.flatnonzero(held)], held[held > 0]
    place = (np.cumsum(held > 0) - 1)[place]
    cut = np.searchsorted(text, np.arange(len(texts) + 1))
    # Places rise within a text: their steps are small numbers, which pack well.
    out["places"] = [np.diff(place[i:j], prepend=0).astype("<u4").tobytes() for i, j in zip(cut[:-1], cut[1:])]
    out["links"] = [links[i:j].astype("<u4").tobytes() for i, j in zip(cut[:-1], cut[1:])]
    return out


BLOCK = (
    "block string, pairs array<struct<a: int, b: int, held: int>>, "
    "texts array<struct<doc_id: long, n_a: long, n_b: long, n_groups: long, n_links: long, sha: string, places: binary, links: binary>>"
)


def aligned_blocks(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """One row a block: its documents' results and its id pairs."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = remembered(path_a or tokenizer_path("byte_bpe_50k.json"), path_b or tokenizer_path("piece_bpe_32k.model"))
        for batch in batches:
            texts = ["" if t is None else t for t in batch.text.tolist()]
            ids = [None if pd.isna(i) else int(i) for i in batch.doc_id.tolist()]
            low, size = 0, 0
            for k, t in enumerate(texts, 1):
                size += len(t)
                if size >= BLOCK_BYTES or k == len(texts):
                    r = aligned_block(texts[low:k], pieces)
                    rows = zip(ids[low:k], *(r[f].tolist() for f in FIELDS), r["sha"], r["places"], r["links"])
                    names = ("doc_id", *FIELDS, "sha", "places", "links")
                    pairs = [{"a": p >> B_BITS, "b": p & (1 << B_BITS) - 1, "held": h} for p, h in zip(r["pairs"].tolist(), r["held"].tolist())]
                    yield pd.DataFrame({"block": [uuid.uuid4().hex], "pairs": [pairs], "texts": [[dict(zip(names, x)) for x in rows]]})
                    low, size = k, 0

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(of, BLOCK)


OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def alignment_counts(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Per document: tokens, groups, links, how many links are their A id's most frequent ones in the corpus, the sum of the
    links' counts, and the digest of its groups."""
    blocks = saved(aligned_blocks(docs, path_a, path_b), "aligned")
    sent = blocks.select("block", F.explode("pairs").alias("p")).select("block", "p.a", "p.b", "p.held")
    counts = sent.groupBy("a", "b").agg(F.sum("held").alias("n"))
    best = counts.groupBy("a").agg(F.max("n").alias("most"))
    ranked = counts.join(best, "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("is_best"))
    back = sent.join(ranked, ["a", "b"]).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("a", "b", "n", "is_best"))).alias("ranked"))

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for texts, n, is_best in zip(batch.texts, batch.n, batch.is_best):
                n, is_best = (np.zeros(0, np.int64),) * 2 if n is None else (np.asarray(n, np.int64), np.asarray(is_best, np.int64))
                rows = []
                for t in texts:
                    at, links = np.cumsum(np.frombuffer(t["places"], "<u4").astype(np.int64)), np.frombuffer(t["links"], "<u4").astype(np.int64)
                    rows.append((t["doc_id"], *(t[f] for f in FIELDS), int(links @ is_best[at]), int(links @ n[at]), t["sha"]))
                yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in OUT.split(", ")]).astype({"doc_id": "Int64"})

    # A block's pairs are in the same order on both sides: by A's id, then B's.
    own = blocks.select("block", "texts").join(back, "block", "left")
    return own.select("texts", F.col("ranked.n").alias("n"), F.col("ranked.is_best").cast("array<tinyint>").alias("is_best")).mapInPandas(told, OUT)


def op12_align(spark, sf_dir: str) -> DataFrame:
    return alignment_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
