"""Removal of long passages that an earlier document holds already, by super-k-mer partitioning.

A window is WINDOW consecutive words. Its minimiser is the least hash among the runs of MMER words inside it; equal
windows have equal minimisers. Consecutive windows of a document with one minimiser travel as one packed string (their
words joined by a space, compressed) to the bucket of that minimiser, at most MOST windows in a string. There the windows
are cut out again and sorted by their 128-bit digests, so equal windows stand together and the least doc_id that starts
each is known exactly. Windows that start in a document with a smaller doc_id are sent back as ranges, and the words that
they cover are removed.

A census goes first: each string's minimiser and 64-bit name, without its text. Folded by name inside each map task and
again after the shuffle, it gives the least doc_id that holds a string. Of a later document that holds the same string
every window is repeated, whatever the number of copies, and no text has to travel for that. Only strings of least
documents go to a bucket, one for each name, and only to buckets where least documents differ.

A bucket is as many groups as its windows need at SHARE windows each, so no task sorts more; strings are dealt among them by
name. Where a bucket has several groups each first gives its distinct digests, folded; what the others hold of a smaller
doc_id comes back to it beside its strings. That is the same sort with some more rows, at every size.

Texts are shuffled by document once; the steps that need them share that exchange.

Defined cases: a null text has no words; a null doc_id ranks after all others; rows with equal doc_ids aren't earlier
than each other; windows repeated inside one document stay; an empty table gives an empty result; other columns are
passed through whatever their names, those named like the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discarded, let_go, rowed, saved

WINDOW = 50
MMER = 8
#: Windows of one string at most, and of one group of a bucket.
MOST, SHARE = 128, 1 << 18
LAST = 2**63 - 1
ADDED = ("n_words", "n_removed", "kept_sha256", "kept_text")
_ODD = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hash of each word, remembered up to a bound."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def minimisers(hashes: np.ndarray, window: int = WINDOW, mmer: int = MMER) -> np.ndarray:
    """The minimiser of each window of a sequence of word hashes."""
    n = len(hashes) - mmer + 1
    run = np.zeros(n, np.uint64)
    for k in range(mmer):
        run = run * _ODD + hashes[k : k + n]
    least, width, need = mixed(run), 1, window - mmer + 1
    while width * 2 <= need:
        least, width = np.minimum(least[:-width], least[width:]), width * 2
    more = need - width
    return np.minimum(least[: len(least) - more], least[more:]) if more else least


def super_kmers(words: list[bytes], known: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimisers, first windows, numbers of windows) of a document's runs; empty for fewer than WINDOW words. Runs of more
    than MOST windows are several."""
    if len(words) < WINDOW:
        return (np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 2)
    least = minimisers(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    n = np.diff(np.append(first, len(least)))
    if n.max() > MOST:
        parts = -(-n // MOST)
        inside = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first = np.repeat(first, parts) + MOST * inside
        n = np.diff(np.append(first, len(least)))
    return least[first], first, n


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def line_of(words: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The words joined by a space, and where each begins; one more place after the last."""
    return b" ".join(words), np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)))


def _dictionary(docs: DataFrame) -> bytes:
    """Some text that primes the compression of packed strings; it has no effect on results."""
    some = docs.select(F.substring("text", 1, 4000).alias("t")).where(F.length("t") > 0).limit(24).collect()
    return " ".join(r.t for r in some).encode("utf-8", "surrogatepass")[:65536]


def _pack_with(primer: bytes):
    return zstandard.ZstdCompressionDict(primer, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if primer else None


def _runs(found: np.ndarray) -> list[tuple[int, int]]:
    """Runs of true values as (first, end)."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], found.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def digests(line: bytes) -> bytes:
    """The 16-byte digests of a string's windows, one after the other."""
    at = [0, *(np.flatnonzero(np.frombuffer(line, np.uint8) == 32) + 1).tolist(), len(line) + 1]
    return b"".join([xxhash.xxh3_128_digest(line[at[j] : at[j + WINDOW] - 1]) for j in range(len(at) - WINDOW)])


class Group:
    """The strings of one group of a bucket, cut into windows."""

    def __init__(self):
        self.names, self.leasts, self.counts, self.bytes = [], [], [], []
        self.seen: set[int] = set()
        self.others: list[tuple[int, int, int]] = []

    def add(self, name: int, least: int, line: bytes) -> None:
        if name not in self.seen:
            self.seen.add(name)
            found = digests(line)
            self.names.append(name)
            self.leasts.append(least)
            self.counts.append(len(found) // 16)
            self.bytes.append(found)

    def sorted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(digests' halves, docs, order, starts of equal digests in that order) of all windows and what others hold."""
        own = np.frombuffer(b"".join(self.bytes), np.int64).reshape(-1, 2)
        more = np.array(self.others, np.int64).reshape(-1, 3)
        high, low = np.concatenate([own[:, 0], more[:, 0]]), np.concatenate([own[:, 1], more[:, 1]])
        doc = np.concatenate([np.repeat(np.array(self.leasts, np.int64), self.counts), more[:, 2]])
        order = np.lexsort((doc, low, high))
        h, w = high[order], low[order]
        start = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (w[1:] != w[:-1])))) if len(h) else np.empty(0, np.int64)
        return high, low, doc, order, start

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct digests with the least doc of each."""
        high, low, doc, order, start = self.sorted()
        first = order[start]
        return high[first], low[first], doc[first]

    def repeated(self) -> list[tuple[int, int, int]]:
        """(name, first, end) of each run of windows that a smaller doc starts too."""
        _, _, doc, order, start = self.sorted()
        lowest = np.empty_like(doc)
        lowest[order] = np.repeat(doc[order[start]], np.diff(np.append(start, len(doc))))
        found, at, out = doc > lowest, 0, []
        for name, n in zip(self.names, self.counts, strict=True):
            if found[at : at + n].any():
                out += [(name, a, b) for a, b in _runs(found[at : at + n])]
            at += n
        return out


def _keyed(docs: DataFrame) -> DataFrame:
    """(row, doc_key, text_key, text), row with all columns but text: the keys tell rows apart; rows of equal key have equal
    texts and equal results."""
    keys = {"doc_key": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), "text_key": F.coalesce(F.xxhash64("text"), F.lit(0))}
    return rowed(docs, [c for c in docs.columns if c != "text"], **keys, text=F.col("text"))


def census(keyed: DataFrame) -> DataFrame:
    """(minimiser, name, doc_key, text_key, first, n) of every string."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        known = WordHashes()
        for batch in batches:
            minimiser, names, firsts, counts, owner = [], [], [], [], []
            for k, text in enumerate(batch["text"]):
                words = split_words(text)
                least, first, n = super_kmers(words, known)
                if len(first):
                    line, at = line_of(words)
                    names += [xxhash.xxh3_64_intdigest(line[a:b]) for a, b in zip(at[first].tolist(), (at[first + n + WINDOW - 1] - 1).tolist(), strict=True)]
                    minimiser.append(least)
                    firsts.append(first)
                    counts.append(n)
                    owner.append(np.full(len(first), k))
            of = np.concatenate([*owner, np.empty(0, np.int64)])
            yield pd.DataFrame({
                "minimiser": np.concatenate([*minimiser, np.empty(0, np.uint64)]).view(np.int64), "name": np.array(names, np.uint64).view(np.int64),
                "doc_key": batch["doc_key"].to_numpy()[of], "text_key": batch["text_key"].to_numpy()[of],
                "first": np.concatenate([*firsts, np.empty(0, np.int64)]), "n": np.concatenate([*counts, np.empty(0, np.int64)]),
            })

    return keyed.select("doc_key", "text_key", "text").mapInPandas(found, "minimiser long, name long, doc_key long, text_key long, first int, n int")


def packed_strings(texts: DataFrame, primer: bytes) -> DataFrame:
    """(minimiser, share, name, least, packed) of the strings that each row of texts (doc_key, text, wanted) has to send."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prime = _pack_with(primer)
        if prime:
            prime.precompute_compress(level=3)
        press = zstandard.ZstdCompressor(level=3, dict_data=prime, write_content_size=True, write_checksum=False, write_dict_id=False).compress
        for batch in batches:
            out = []
            for doc, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc_key", "text", "wanted")), strict=True):
                line, at = line_of(split_words(text))
                for w in wanted:
                    a, b = at[w["first"]], at[w["first"] + w["n"] + WINDOW - 1] - 1
                    out.append((w["minimiser"], w["share"], w["name"], doc, press(line[a:b])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], ["minimiser", "share", "name", "least", "packed"])

    kinds = [pa.int64()] * 4 + [pa.binary()]
    # The whole row goes in, other columns too, so that this step's exchange of texts is the one the last step uses.
    return texts.mapInArrow(packed, "minimiser long, share long, name long, least long, packed binary")


def each_group(batches: Iterator[pd.DataFrame], primer: bytes) -> Iterator[tuple[int, int, Group]]:
    """(minimiser, share, group) from rows sorted by these. Rows without packed words tell what other groups hold."""
    press = zstandard.ZstdDecompressor(dict_data=_pack_with(primer)).decompress
    at, group = None, Group()
    for batch in batches:
        columns = ("minimiser", "share", "name", "least", "packed", "high", "low")
        for minimiser, share, name, least, packed, high, low in zip(*(batch[c].tolist() if c in batch else [0] * len(batch) for c in columns), strict=True):
            if (minimiser, share) != at:
                if at:
                    yield *at, group
                at, group = (minimiser, share), Group()
            if packed is None:
                group.others.append((high, low, least))
            else:
                group.add(name, least, press(packed))
    if at:
        yield *at, group


def repeated_in_buckets(strings: DataFrame, split: DataFrame, primer: bytes) -> DataFrame:
    """(minimiser, name, a, b): windows a to b of a string are started by a smaller doc_id in its bucket too.

    strings: all strings; split: those of buckets with several groups.
    """

    def distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for minimiser, share, group in each_group(batches, primer):
            high, low, least = group.distinct()
            yield pd.DataFrame({"minimiser": np.full(len(high), minimiser), "share": np.full(len(high), share), "high": high, "low": low, "least": least})

    def repeated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for minimiser, _, group in each_group(batches, primer):
            out += [(minimiser, *found) for found in group.repeated()]
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=["minimiser", "name", "a", "b"])
                out = []
        yield pd.DataFrame(out, columns=["minimiser", "name", "a", "b"])

    def grouped(df: DataFrame, *then: str) -> DataFrame:
        return df.repartition("minimiser", "share").sortWithinPartitions("minimiser", "share", *then)

    held = grouped(split).mapInPandas(distinct, "minimiser long, share long, high long, low long, least long")
    held = saved(held, "digests")
    # As many rows of one digest as its bucket has groups.
    lowest = held.groupBy("high", "low").agg(F.min("least").alias("lowest"), F.max("least").alias("last")).where("lowest < last")
    others = held.join(lowest, ["high", "low"]).where("lowest < least")
    others = others.select("minimiser", "share", F.lit(0).cast("long").alias("name"), F.col("lowest").alias("least"), F.lit(None).cast("binary").alias("packed"), "high", "low")
    none = F.lit(0).cast("long")
    rows = strings.select("minimiser", "share", "name", "least", "packed", none.alias("high"), none.alias("low")).unionByName(others)
    return grouped(rows).mapInPandas(repeated, "minimiser long, name long, a int, b int")


def repeated_windows(keyed: DataFrame) -> DataFrame:
    """(doc_key, text_key, first, end): ranges of windows that start in a document with a smaller doc_id too."""
    every = saved(census(keyed), "census")
    folded = every.groupBy("minimiser", "name").agg(F.min("doc_key").alias("least"), F.max("doc_key").alias("most"), F.max("n").alias("n"))
    buckets = folded.groupBy("minimiser").agg(F.min("least").alias("low"), F.max("least").alias("high"), F.sum("n").alias("windows")).where("low < high")
    named = folded.join(buckets.select("minimiser", "windows"), "minimiser", "left").where("least < most or windows is not null")
    named = saved(named.select("minimiser", "name", "least", F.ceil(F.col("windows") / SHARE).alias("groups")), "names")
    held = saved(every.join(named, ["minimiser", "name"]), "held")
    discarded(every, named)
    whole = held.where("doc_key > least").select("doc_key", "text_key", "first", (F.col("first") + F.col("n")).alias("end"))
    own = held.where("doc_key = least and groups is not null")
    share = F.pmod(F.xxhash64("name"), F.col("groups")).alias("share")
    sent = own.groupBy("doc_key", "text_key", "minimiser", "name", "groups", "n").agg(F.min("first").alias("first"))
    lists = sent.groupBy("doc_key", "text_key").agg(F.collect_list(F.struct("minimiser", share, "name", "first", "n")).alias("wanted"))
    primer = _dictionary(keyed)
    strings = saved(packed_strings(keyed.join(lists, ["doc_key", "text_key"]), primer), "strings")
    several = own.where("groups > 1").select("minimiser").distinct()
    runs = repeated_in_buckets(strings, strings.join(several, "minimiser", "left_semi"), primer)
    parts = own.join(runs, ["minimiser", "name"]).select("doc_key", "text_key", (F.col("first") + F.col("a")).alias("first"), (F.col("first") + F.col("b")).alias("end"))
    return whole.unionByName(parts)


def removed(docs: DataFrame) -> DataFrame:
    """docs with n_words, n_removed, kept_sha256 (of the kept words joined by a space) and kept_text, which is null where
    nothing is removed."""

    @F.pandas_udf("n_words long, n_removed long, kept_sha256 string, kept_text string")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, ranges in batches:
            out = []
            for text, found in zip(texts, ranges, strict=True):
                words, gone = split_words(text), 0
                n = len(words)
                if found is not None and len(found):
                    edge = np.zeros(n + 1, np.int64)
                    spans = np.array([(r["first"], r["end"]) for r in found], np.int64)
                    np.add.at(edge, spans[:, 0], 1)
                    np.add.at(edge, spans[:, 1] + WINDOW - 1, -1)
                    keep = np.cumsum(edge[:-1]) == 0
                    gone = int((~keep).sum())
                    words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                line = b" ".join(words)
                out.append((n, gone, sha256(line).hexdigest(), line.decode("utf-8", "surrogatepass") if gone else None))
            yield pd.DataFrame(out, columns=list(ADDED))

    own = [c for c in docs.columns if c not in ADDED]
    keyed = _keyed(docs)
    ranges = repeated_windows(keyed).groupBy("doc_key", "text_key").agg(F.collect_set(F.struct("first", "end")).alias("ranges"))
    joined = keyed.join(ranges, ["doc_key", "text_key"], "left").withColumn("cut", cut(F.col("text"), F.col("ranges")))
    return joined.select(*[F.col("text" if c == "text" else f"row.`{c}`") for c in own], *[F.col(f"cut.{c}") for c in ADDED])


def op10_substrings(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return removed(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
