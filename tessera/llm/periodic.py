"""Periodic runs of words: stretches in which words some distance apart are identical, found at every distance.

A document's words become an array of ids. It is compared with itself shifted by every lag up to n / MIN_EXP; a stretch of
equal words of the comparison is a run if the words it joins are LEAST or more and MIN_EXP periods or more, and no smaller
lag has the same stretch. Lags are first compared on a grid of every eighth part of the lag, all lags of a similar size in
one matrix: a stretch of lag q holds q equal words in a row or more, so STEPS or more neighbours on the grid; lags where so
many neighbours are equal are compared at every word; lags below LEAST have a grid of every word and LEAST / MIN_EXP
neighbours. Nothing is missed by that and a text without runs costs n log n.

Spark deals the documents, and of long ones ranges of lags: a document of n words has n / MIN_EXP lags, each a comparison of
n words at worst, and is dealt out in as many ranges as it takes to keep each below WORK comparisons (a text of up to
89,000 words is one range, and stays where it is read). Ranges are shuffled by a hash of document and range, and their runs
are gathered again by document: at most n of them.

Defined cases: a null or empty text has no words and no run; repeated rows and equal doc_ids are documents of their own;
a null doc_id stays null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import n_words

LEAST, MIN_EXP = 12, 2
#: Equal neighbours on a lag's grid that a run of that lag has at least.
STEPS = 7
#: Comparisons of one range of lags at most, where a document has more than one.
WORK = 4_000_000_000
#: Cells of a comparison matrix at most.
CELLS = 1 << 21


def word_ids(words: list[bytes]) -> np.ndarray:
    """Place of each word's first occurrence."""
    first: dict[bytes, int] = {}
    return np.fromiter(map(first.setdefault, words, range(len(words))), np.int32, len(words))


def true_stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the stretches of true values."""
    edges = np.flatnonzero(np.diff(flags.view(np.int8), prepend=0, append=0))
    return edges[::2], edges[1::2] - edges[::2]


def candidate_lags(ids: np.ndarray, low: int, high: int) -> Iterator[int]:
    """Lags of low up to high, high left out, that may have a run: those with enough equal neighbours on the lag's grid."""
    # What lies behind the text equals no word.
    padded = np.concatenate([ids, np.full(high + high // (STEPS + 1) + 1, -1, np.int32)])
    size = padded.itemsize
    while low < high:
        # Lags below LEAST are compared at every word. Lags of one matrix share the smallest one's grid, which is the finest.
        step, need = (1, LEAST // MIN_EXP) if low < LEAST else (low // (STEPS + 1), STEPS)
        n_grid = -(-len(ids) // step)
        top = min(high, LEAST if low < LEAST else 2 * low, low + max(1, CELLS // n_grid))
        shifted = np.lib.stride_tricks.as_strided(padded[low:], (top - low, n_grid), (size, step * size), writeable=False)
        # need equal neighbours stay true under and-ing with shifts of 1, 2 and so on, need - 1 in all.
        held, done = shifted == ids[::step], 1
        while done < need and held.shape[1]:
            by = min(done, need - done)
            held = held[:, : max(0, held.shape[1] - by)] & held[:, by:]
            done += by
        yield from (low + np.flatnonzero(held.any(axis=1))).tolist()
        low = top


def runs(ids: np.ndarray, low: int = 1, high: int | None = None) -> list[tuple[int, int, int]]:
    """(start, length, lag) of stretches of the lags low up to high that are runs by length, in order of lags. A stretch that
    a multiple of its period finds too is there once for each such lag of the range."""
    n = len(ids)
    high = n // MIN_EXP + 1 if high is None else min(high, n // MIN_EXP + 1)
    found = []
    for q in candidate_lags(ids, low, high):
        starts, lengths = true_stretches(ids[q:] == ids[:-q])
        long_enough = lengths >= max(LEAST - q, (MIN_EXP - 1) * q)
        found += [(s, k + q, q) for s, k in zip(starts[long_enough].tolist(), lengths[long_enough].tolist())]
    return found


def smallest_periods(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs by start, then period: of one stretch's lags the smallest, which its other lags are multiples of."""
    least: dict[tuple[int, int], int] = {}
    for start, length, q in found:
        least[start, length] = min(q, least.get((start, length), q))
    return sorted(((s, n, q) for (s, n), q in least.items()), key=lambda r: (r[0], r[2]))


def repeated_copies(n: int, of_id: int | None) -> np.ndarray:
    """For each word of a text the word that stands there in its changed form: of one document in ten, by a hash of its id,
    the rest of the text from some place on repeats the words from there."""
    from zlib import crc32

    at = np.arange(n)
    h = crc32(str(of_id).encode()) if of_id is not None else 1
    if h % 10 or not n:
        return at
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at[a:] = a + (at[a:] - a) % p
    return at


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """Words that no run has after its first period."""
    if not found:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, q in found:
        change[start + q] += 1
        change[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def changed_words(text: str | None, of_id: int | None, change: bool) -> list[bytes]:
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not change:
        return words
    at = repeated_copies(len(words), of_id)
    return [words[k] for k in at.tolist()] if len(at) and at[-1] != len(at) - 1 else words


def ranges(text: Column, work: int) -> Column:
    """Array of (low, high) ranges of a document's lags: one, or as many as keep each one's comparisons below work. Words are
    counted where a text of that many bytes may need more than one."""
    most = F.octet_length(text).cast("long") / 2 + 1
    n = F.when(most * most / MIN_EXP <= work, 1).otherwise(n_words(text))
    lags = F.floor(n / MIN_EXP)
    each = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(work) / F.greatest(n, F.lit(1).cast("long"))))
    starts = F.sequence(F.lit(1).cast("long"), F.greatest(lags, F.lit(1).cast("long")), each)
    return F.transform(starts, lambda s: F.struct(s.alias("low"), (s + each).alias("high")))


OUT = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, "
    "runs array<struct<start: long, length: long, period: long>>"
)


def _described(of_id, words: list[bytes], found: list[tuple[int, int, int]]) -> tuple:
    found = smallest_periods(found)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    return (of_id, len(found), *longest, sha(listed.encode()), sha(b" ".join(collapsed(words, found))), [{"start": s, "length": n, "period": q} for s, n, q in found])


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[c.split(" ")[0] for c in OUT.split(", ")[:8]] + ["runs"])
    return frame.astype({c: "Int64" for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")})


def periodic_runs(docs: DataFrame, change: bool = False, work: int = WORK) -> DataFrame:
    """doc_id, number of runs, the longest one, digests of the runs and of the words left, and all runs.

    change puts the changed form of each document (repeated_copies) in its place.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("lags", ranges(F.coalesce("text", F.lit("")), work))

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for of_id, text in zip(batch.doc_id.tolist(), batch.text.tolist()):
                of_id = None if pd.isna(of_id) else int(of_id)
                words = changed_words(text, of_id, change)
                rows.append(_described(of_id, words, runs(word_ids(words))))
            yield _frame(rows)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for of_key, of_id, text, low, high in batch.itertuples(index=False):
                found = runs(word_ids(changed_words(text, None if pd.isna(of_id) else int(of_id), change)), low, high)
                # In each range the smallest lag of a stretch is enough.
                yield pd.DataFrame([(of_key, *r) for r in smallest_periods(found)], columns=["key", "start", "length", "period"])

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for of_id, text, found in zip(batch.doc_id.tolist(), batch.text.tolist(), batch.found.tolist()):
                of_id = None if pd.isna(of_id) else int(of_id)
                rows.append(_described(of_id, changed_words(text, of_id, change), [] if found is None else [(r["start"], r["length"], r["period"]) for r in found]))
            yield _frame(rows)

    short = own.where(F.size("lags") == 1).select("doc_id", "text").mapInPandas(whole, OUT)
    # Long documents are dealt by a digest of id and text; equal rows share their runs.
    long = own.where(F.size("lags") > 1).withColumn("key", F.sha2(F.encode(F.concat_ws(":", F.col("doc_id").cast("string"), "text"), "UTF-8"), 256))
    dealt = long.dropDuplicates(["key"]).select("key", "doc_id", "text", F.explode("lags").alias("r")).select("key", "doc_id", "text", "r.low", "r.high")
    found = dealt.repartition("key", "low").mapInPandas(part, "key string, start long, length long, period long")
    found = found.groupBy("key", "start", "length").agg(F.min("period").alias("period")).groupBy("key").agg(F.collect_list(F.struct("start", "length", "period")).alias("found"))
    return short.unionByName(long.select("key", "doc_id", "text").join(found, "key", "left").select("doc_id", "text", "found").mapInPandas(joined, OUT))


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    return periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), change=True).drop("runs")
