r"""Quality rules: divergence of a document from its language, after fixed base rules.

A document has two histograms: its characters by class, and its words by a fixed list of common words of each language
(all other words in one bin). The reference of a language is the sum of both over every document of that language that
passes the base rules. A document is kept where the Jensen-Shannon distances of both histograms to one language's
reference stay within their limits; the limit widens with 1 / sqrt(n) for short texts, and the word histogram counts only
from MIN_WORDS words on. The language column serves to gather the references, never to judge: each document is held
against all of them and against mixtures of two, so a missing or wrong language costs nothing.

Base rules: words are runs of anything but ASCII white space; a text fails with fewer than 50 words, or where more than
half of its words stand in 3-word windows that occur twice or more in it.

Defined cases: a null or empty text has no words and fails; a document of an unlisted or null language adds to no
reference; without any reference (empty table, no listed language) the base rules alone decide; repeated rows are judged
each; other columns are passed through, those named like the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import let_go, rowed

#: Common words of four languages.
COMMON = {
    "de": "der die das und in zu den von mit sich des auf für ist im dem nicht ein eine als auch es an er".split(),
    "en": "the of and to in a is that for it was on are as with be by this from at or an have not which".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur pas plus au avec ce il se ne".split(),
}
LANGUAGES = tuple(COMMON)
VOCABULARY = tuple(sorted({w for ws in COMMON.values() for w in ws}))
#: Character classes: fixed sets, the rest by code point.
CLASSES = ("lower", "upper", "accented", "digit", "blank", "line", "stop", "mark", "symbol", "control", "other")
SYMBOLS = "#*$%&|<>"
MIN_BASE_WORDS = 50
MIN_WORDS = 60
#: Limits of the two distances, and how they widen with 1 / sqrt(number of words).
CHAR_LIMIT, CHAR_SLACK = 0.16, 0.9
WORD_LIMIT, WORD_SLACK = 0.18, 1.5

ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept")
STATS = T.StructType(
    [T.StructField(c, T.LongType()) for c in ADDED[:5]]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("char_distance", T.DoubleType()), T.StructField("word_distance", T.DoubleType()), T.StructField("kept", T.BooleanType())]
)


def _classes() -> np.ndarray:
    """Class of each code point below 0x3000; beyond that all are other."""
    of = np.full(0x3000, CLASSES.index("other"), np.int64)
    for first, last, name in ((0xC0, 0x24F, "accented"), (0x00, 0x1F, "control"), (0x7F, 0x9F, "control"), (ord("a"), ord("z"), "lower"), (ord("A"), ord("Z"), "upper"), (ord("0"), ord("9"), "digit")):
        of[first : last + 1] = CLASSES.index(name)
    for chars, name in ((" \t", "blank"), ("\n\r", "line"), (".,;:!?", "stop"), ("'\"-()[]/", "mark"), ("#*$%&|<>@^_~=+{}\\`", "symbol")):
        for c in chars:
            of[ord(c)] = CLASSES.index(name)
    return of


_CLASS_OF = _classes()
_WORD_AT = {w: i for i, w in enumerate(VOCABULARY)}
_STRIP = b".,;:!?'\"-()[]"


def char_histogram(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount(_CLASS_OF[np.minimum(points, 0x2FFF)], minlength=len(CLASSES))


class Bins(dict):
    """Bin of a word in a histogram, found once; emptied when it has grown large."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.LIMIT:
            self.clear()
        self[word] = found = _WORD_AT.get(word.strip(_STRIP).decode("utf-8", "surrogatepass").lower(), len(VOCABULARY))
        return found


def word_histogram(words: list[bytes], bins: Bins) -> np.ndarray:
    """Counts of the common words, last of all others."""
    return np.bincount(np.fromiter(map(bins.__getitem__, words), np.int64, len(words)), minlength=len(VOCABULARY) + 1)


def encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def repeat_words(words: list[bytes], size: int = 3) -> int:
    """Words inside windows of size words that occur at least twice."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    ids_of = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(ids) == len(words):
        return 0
    key = ids_of[:n]
    for k in range(1, size):
        # Keys are numbered anew where another factor could overflow.
        key = np.unique(key, return_inverse=True)[1] if len(ids) ** (k + 1) >= 2**62 else key
        key = key * len(ids) + ids_of[k : k + n]
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    if not len(starts):
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    seen, again = set(), 0
    for line in text.split("\n"):
        if line in seen:
            again += 1
        elif line.encode("utf-8", "surrogatepass").split():
            seen.add(line)
    return again


def base_failed(n: int, repeated: int) -> bool:
    return n < MIN_BASE_WORDS or 100 * repeated > 50 * n


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of histogram p to each row of shares q."""
    p = p / max(p.sum(), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(-1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.sqrt(np.maximum((left + right) / 2, 0))


def references(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shares of character classes and of common words, a row for each listed language that has documents which pass the base rules."""
    size = len(CLASSES) + len(VOCABULARY) + 1

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        bins = Bins()
        total = {lang: np.zeros(size, np.int64) for lang in LANGUAGES}
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"], strict=True):
                words = encoded(text).split()
                # Counting repeats is left out for texts that are too short anyway.
                if len(words) >= MIN_BASE_WORDS and not base_failed(len(words), repeat_words(words)):
                    total[lang][: len(CLASSES)] += char_histogram(text)
                    total[lang][len(CLASSES) :] += word_histogram(words, bins)
        yield pd.DataFrame([(lang, i, int(v)) for lang, h in total.items() for i, v in enumerate(h) if v], columns=["lang", "bin", "n"])

    listed = docs.where(F.col("lang").isin(*LANGUAGES) & F.col("text").isNotNull()).select("text", "lang")
    found = listed.mapInPandas(sums, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).collect()  # at most languages x bins
    table = np.zeros((len(LANGUAGES), size))
    for lang, at, n in found:
        table[LANGUAGES.index(lang), at] = n
    table = table[table.sum(1) > 0]
    chars, words = table[:, : len(CLASSES)], table[:, len(CLASSES) :]
    return with_mixtures(chars / np.maximum(chars.sum(1, keepdims=True), 1)), with_mixtures(words / np.maximum(words.sum(1, keepdims=True), 1))


#: Shares of the first language in texts of two.
SHARES = (0.25, 0.5, 0.75)


def with_mixtures(table: np.ndarray) -> np.ndarray:
    """Reference rows and mixtures of each two of them, so that a text in two languages is near one of them."""
    pairs = [(a, b) for a in range(len(table)) for b in range(a)]
    return np.concatenate([table, *[[s * table[a] + (1 - s) * table[b]] for a, b in pairs for s in SHARES]]) if pairs else table


def judge_text(text: str | None, chars: np.ndarray, common: np.ndarray, bins: Bins) -> tuple:
    """All added columns of one text."""
    text = text or ""
    words = encoded(text).split()
    n, repeated = len(words), repeat_words(words)
    letters = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    failed = base_failed(n, repeated)
    char_d = word_d = None
    kept = not failed
    if kept and len(chars):
        by_char = distance(char_histogram(text), chars)
        by_word = distance(word_histogram(words, bins), common)
        near = by_char <= CHAR_LIMIT + CHAR_SLACK / np.sqrt(n)
        if n >= MIN_WORDS:
            near &= by_word <= WORD_LIMIT + WORD_SLACK / np.sqrt(n)
        best = int(np.argmin(by_char + by_word))
        char_d, word_d, kept = float(by_char[best]), float(by_word[best]), bool(near.any())
    return n, letters, sum(map(text.count, SYMBOLS)), dup_lines(text), repeated, failed, char_d, word_d, kept


def verdicts(docs: DataFrame, own: list[str] | None = None) -> DataFrame:
    """row (columns of docs, all if not said) and judged: base counts, both distances and the verdict kept."""
    chars, common = references(docs)

    @F.pandas_udf(STATS)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        let_go()
        bins = Bins()
        for texts in batches:
            yield pd.DataFrame([judge_text(t, chars, common, bins) for t in texts], columns=list(ADDED)).astype({"char_distance": "float64", "word_distance": "float64"})

    return rowed(docs, own, judged=judge(F.col("text")))


def judged(docs: DataFrame) -> DataFrame:
    """docs with the base counts, both distances and the verdict kept."""
    return verdicts(docs, [c for c in docs.columns if c not in ADDED]).select("row.*", *[F.col(f"judged.{c}") for c in ADDED])


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return judged(docs).drop("text", "lang")
