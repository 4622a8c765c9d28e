"""BPE encoding by dynamic programming over prefixes, and decoding.

A greedy merge of a word gives each of its prefixes one encoding, and of that encoding one last token. So for a prefix of
length n the last token is the vocabulary entry that ends there, starts where a shorter prefix ends, and is compatible
with that prefix's own last token: merging the pair's symbols leaves just these two tokens. For every prefix the encoder
finds the entries that end there with a suffix automaton of the vocabulary, tests them against the stored last tokens, and
stores the one that fits; back-pointers from the end of the word spell the ids.

The tokenizer file is one of the public ones with word ends (word_bpe_49k.json): text is put in NFC, white space runs
become one space, letters lower case; words are contractions, letter runs, single digits and runs of other signs; a
word's bytes are symbols, the last one in its end-of-word form. Strings of special tokens in a text become their ids.

Memory: the automaton is built once in each Python worker; encodings of words are remembered up to a bound. Tasks of other
operators that need a worker's memory drop both.

Defined cases: a null text counts as empty and has no ids; repeated rows are encoded each; texts of any length are
encoded whole; an empty table gives an empty result; other columns are passed through, those named like the added ones
are replaced.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import kept_between_tasks, rowed

WORD_END = "</w>"
#: The file's own pre-tokenizer pattern, a fixed value.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words whose encodings a worker remembers, and as many of those met before them.
REMEMBERED = 300_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    moved = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(moved)) for b in range(256)]


class SuffixAutomaton:
    """Of a set of symbol sequences: finds every one of them that ends at a place of a sequence."""

    def __init__(self, entries: list[tuple[tuple[int, ...], int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        #: The entries in a state as (length, token), longest first; one may be a shorter string of its state.
        self.marks: dict[int, list[tuple[int, int]]] = {}
        for symbols, _ in entries:
            state = 0
            for c in symbols:
                state = self._extend(state, c)
        for symbols, token in entries:
            state = 0
            for c in symbols:
                state = self.next[state][c]
            self.marks.setdefault(state, []).append((len(symbols), token))
        for found in self.marks.values():
            found.sort(reverse=True)
        #: Nearest state by links, itself left out, that has entries.
        self.above: list[int] = [-1] * len(self.length)
        for s in sorted(range(len(self.length)), key=self.length.__getitem__):
            up = self.link[s]
            self.above[s] = -1 if up < 0 else up if up in self.marks else self.above[up]
        #: All entries that may end in a state, its own and those above it, longest first.
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(self.length)
        for s in sorted(range(len(self.length)), key=self.length.__getitem__):
            own, up = tuple(self.marks.get(s, ())), self.above[s]
            self.ends[s] = own + self.ends[up] if up >= 0 else own

    def _new(self, length: int) -> int:
        self.next.append({})
        self.link.append(-1)
        self.length.append(length)
        return len(self.length) - 1

    def _extend(self, last: int, c: int) -> int:
        """Adds symbol c after state last; a state that is there already is used again."""
        old = self.next[last].get(c)
        if old is not None:
            return old if self.length[old] == self.length[last] + 1 else self._split(last, c, old)
        new, p = self._new(self.length[last] + 1), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def _split(self, p: int, c: int, q: int) -> int:
        """A copy of q for the strings that end by p and c alone."""
        copy = self._new(self.length[p] + 1)
        self.next[copy] = dict(self.next[q])
        self.link[copy] = self.link[q]
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy


class Encoder:
    def __init__(self, path: str):
        file = json.load(open(path, encoding="utf-8"))
        vocab: dict[str, int] = file["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in file["model"]["merges"]]
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.final = [vocab[c + WORD_END] for c in letters]
        #: Pair of ids to (rank, merged id); the parts of each merged id; the symbols of each id.
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        symbols: dict[int, tuple[int, ...]] = {i: (i,) for i in (*self.inner, *self.final)}
        for rank, (a, b) in enumerate(merges):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.pairs[left, right] = (rank, whole)
            if whole not in self.parts:
                self.parts[whole] = (left, right)
                symbols[whole] = symbols[left] + symbols[right]
        self.automaton = SuffixAutomaton(sorted((s, i) for i, s in symbols.items()))
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        named = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        #: What decode gives for an id: tokens as they are written, joined by a space.
        self.written = [named.get(i, "").encode() for i in range(max(named) + 1)]
        #: Each id as four bytes.
        self.packed = [i.to_bytes(4, "little") for i in range(len(self.written))]
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces = regex.compile(PIECES)
        self.fits_known: dict[int, bool] = {}
        #: Encodings of words met lately, and those remembered before them.
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}

    def fits(self, left: int, right: int) -> bool:
        """Whether the symbols of left and right, merged greedily, end as these two tokens.

        They don't where some merge across the border comes before a merge that closes it off. The border's neighbours
        are undone from the latest merge to the earliest; a pair across it merges if it ranks before what was undone on
        either side, with the left one first among equals.
        """
        found = self.fits_known.get(left << 32 | right)
        if found is None:
            if len(self.fits_known) > 2_000_000:
                self.fits_known.clear()
            found = self.fits_known[left << 32 | right] = self._fits(left, right)
        return found

    def _rank(self, token: int) -> int:
        parts = self.parts.get(token)
        return -1 if parts is None else self.pairs[parts][0]

    def _fits(self, left: int, right: int) -> bool:
        # A spine: the tokens that touch the border at some time, each with the rank at which it is merged away.
        a, a_until, b, b_until = left, 1 << 60, right, 1 << 60
        while True:
            pair = self.pairs.get((a, b))
            if pair is not None:
                rank = pair[0]
                # The pair stood side by side until the sooner of the two was merged with its other neighbour. On the left
                # side a merge of equal rank lies further left, so it comes first; on the right it comes after.
                if rank < a_until and rank <= b_until:
                    return False
            ra, rb = self._rank(a), self._rank(b)
            if ra < 0 and rb < 0:
                return True
            # Go back in time past the later of the two merges that made a and b; of equal ranks the right one is later.
            if ra > rb:
                a_until, a = ra, self.parts[a][1]
            else:
                b_until, b = rb, self.parts[b][0]

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word. The automaton is walked symbol by symbol, and only as many entries are tried at a place as it
        takes to find the one that fits."""
        raw = word.encode("utf-8", "surrogatepass")
        symbols = [self.inner[b] for b in raw]
        symbols[-1] = self.final[raw[-1]]
        steps, link, length, ends = self.automaton.next, self.automaton.link, self.automaton.length, self.automaton.ends
        fits, fits_known = self.fits, self.fits_known
        tokens, sizes = [-1], [0]  # of each prefix: last token and its length
        state = held = end = 0
        for c in symbols:
            end += 1
            after = steps[state].get(c)
            while after is None and state:
                state = link[state]
                held = length[state]
                after = steps[state].get(c)
            if after is not None:
                state, held = after, held + 1
            for size, token in ends[state]:
                if size > held:
                    continue
                if size == end:
                    break
                before = tokens[end - size]
                if before >= 0:
                    fit = fits_known.get(before << 32 | token)
                    if fit or fit is None and fits(before, token):
                        break
            else:
                size, token = 0, -1
            tokens.append(token)
            sizes.append(size)
        ids, at = [], end
        while at:
            ids.append(tokens[at])
            at -= sizes[at]
        return ids[::-1]

    def known_word(self, word: str) -> tuple[bytes, bytes]:
        """What encoded gives for one word; words that aren't long are remembered."""
        found = self.known.get(word)
        if found is None:
            found = self.older.get(word)
            if found is None:
                ids = self.encode_word(word)
                found = b"".join([self.packed[i] for i in ids]), b" ".join([self.written[i] for i in ids])
            if len(word) <= 64:
                if len(self.known) >= REMEMBERED:
                    self.known, self.older = {}, self.known
                self.known[word] = found
        return found

    def encoded(self, text: str) -> tuple[bytes, bytes]:
        """Ids of a text as little-endian unsigned 32-bit integers, and what decode gives for them.

        White space needs no change before: the pieces hold none of it, and any of it parts them.
        """
        out: list[tuple[bytes, bytes]] = []
        for k, part in enumerate(self.splitter.split(text) if self.splitter and "<|" in text else [text]):
            if k % 2:
                out.append((self.packed[self.special[part]], self.written[self.special[part]]))
                continue
            words = self.pieces.findall(self.lowered(unicodedata.normalize("NFC", part)))
            found = list(map(self.known.get, words))
            if None in found:
                found = [self.known_word(w) if f is None else f for w, f in zip(words, found, strict=True)]
            out += found
        return b"".join([ids for ids, _ in out]), b" ".join([written for _, written in out])

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        return self.encoded(text)[0]

    @staticmethod
    def lowered(text: str) -> str:
        """Each character's own lower case, whatever stands around it (str.lower turns a final capital sigma otherwise)."""
        return text.lower() if "Σ" not in text else "".join(map(str.lower, text))

    def decode(self, ids: bytes) -> bytes:
        """Text of ids in UTF-8. The file names no decoder: tokens are joined by spaces as they are written."""
        return b" ".join(map(self.written.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encoder(path: str) -> Encoder:
    return kept_between_tasks(("bpe", path), lambda: Encoder(path))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer file on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


ADDED = ("n_tokens", "ids_sha256", "decoded_sha256")


def tokenized(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """docs with n_tokens and the digests of ids and decoded text; with_ids adds ids, array<int>.

    path is a tokenizer file that every executor has; None takes the installed public one.
    """
    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    names = [*ADDED, *["ids"] * with_ids]

    def row(e: Encoder, text: str | None) -> tuple:
        ids, written = e.encoded(text or "")
        out = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(written).hexdigest())
        return (*out, np.frombuffer(ids, "<i4")) if with_ids else out

    @F.pandas_udf(kind)
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        e = encoder(path or tokenizer_path())
        for texts in batches:
            yield pd.DataFrame([row(e, t) for t in texts], columns=names)

    own = [c for c in docs.columns if c not in names]
    return rowed(docs, own, encoded=encode(F.col("text"))).select("row.*", *[F.col(f"encoded.{c}") for c in names])


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    return tokenized(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")
