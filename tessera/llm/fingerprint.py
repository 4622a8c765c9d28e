"""Threshold-scaled document fingerprints, with DataFrame functions alone.

The shingles of a text are its runs of SHINGLE consecutive words (fewer words: the whole sequence as one; no words:
none), hashed to 64 bits. A fingerprint keeps each distinct hash below a fixed fraction of the hash space, so its size
follows the text's, and the share of one fingerprint that is in another estimates containment even where one text is far
longer. A set without a hash below the fraction keeps its smallest hash instead, so that only a text without words has an
empty fingerprint. The same rule put to the union of two fingerprints gives the fingerprint of the united sets (merged):
where one of them has a hash below the fraction all others fall away, else the smaller of the two smallest stays.

Defined cases: a null text counts as empty; two empty fingerprints have likeness 1, an empty and another 0; repeated
rows are documents of their own; equal and null doc_ids stand in the order of their texts' hashes, then texts, null
doc_ids last; in a table of one document that document is its own next; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import words

SHINGLE = 5
#: One in so many hashes is kept.
SCALE = 4
#: Documents in a block that are sorted together, and blocks at most (their numbers are put in order by one task).
BLOCK, MOST_BLOCKS = 2048, 1 << 16
#: Points of the ids' distribution, between which it is taken as even.
POINTS = 512


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """Array of a 64-bit hash for each shingle of the text."""
    def of(w: Column) -> Column:
        short = F.when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))
        at = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)])
        return F.when(F.size(w) >= size, F.transform(F.sequence(F.lit(0), F.size(w) - size), at)).otherwise(short)

    # One pass over a one-element array gives the word array a name, so that the text is split once.
    return F.flatten(F.transform(F.array(words(text)), of))


def retained(hashes: Column, scale: int = SCALE) -> Column:
    """Sorted distinct hashes below 1/scale of the hash space, or the smallest hash where there is none."""
    limit = -(2**63) + 2**64 // scale

    def kept(h: Column) -> Column:
        low = F.array_sort(F.array_distinct(F.filter(h, lambda x: x < F.lit(limit).cast("long"))))
        return F.when((F.size(low) > 0) | (F.size(h) == 0), low).otherwise(F.array(F.array_min(h)))

    return F.flatten(F.transform(F.array(hashes), kept))


def sketch(text: Column, scale: int = SCALE) -> Column:
    return retained(shingle_hashes(text), scale)


def merged(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The fingerprint of the united shingle sets of two fingerprints."""
    return retained(F.array_union(a, b), scale)


def as_text(fingerprint: Column) -> Column:
    """Hashes as 16 lower-case hex digits each."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def containment(a: Column, b: Column) -> Column:
    """Share of the smaller fingerprint that is in the other."""
    least = F.least(F.size(a), F.size(b))
    both_empty = F.greatest(F.size(a), F.size(b)) == 0
    return F.when(both_empty, 1.0).when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def blocks_of(docs: DataFrame) -> Column:
    """Block of each row, rising with doc_id: by the share of ids below it, which POINTS quantiles of the ids give and a
    straight line between two of them. Clusters and outliers of ids so widen no block, but for the up to 1,024 ids that a
    double doesn't tell apart and rows of one id, which stay together. Null ids have negative blocks, by
    their texts' hashes."""
    row = docs.agg(F.count("doc_id").alias("n"), F.count(F.lit(1)).alias("rows"), F.percentile_approx("doc_id", [k / POINTS for k in range(POINTS + 1)], 20 * POINTS).alias("edges")).first()
    edges = [int(x) for x in row.edges or [0]]
    n_blocks = lambda n: min(MOST_BLOCKS // 2, max(1, -(-n // BLOCK)))
    of_id = F.col("doc_id").cast("long")
    points, doubles = F.array(*[F.lit(x).cast("long") for x in edges]), F.array(*[F.lit(float(x)) for x in edges])
    below = F.greatest(F.size(F.filter(points, lambda x: x <= of_id)), F.lit(1)) - 1
    here, there = F.get(doubles, below), F.get(doubles, below + 1)
    part = F.when(there > here, (of_id.cast("double") - here) / (there - here)).otherwise(0.0)
    share = (below + F.greatest(F.lit(0.0), F.least(part, F.lit(1 - 1e-9)))) / F.lit(float(len(edges)))
    # Half a hash keeps the sum below 2 ** 63.
    null_share = (F.xxhash64("text") / 2 + F.lit(2.0**62)) / F.lit(2.0**63)
    block = F.when(of_id.isNotNull(), F.floor(share * n_blocks(row.n))).otherwise(-1 - F.floor(null_share * n_blocks(row.rows - row.n)))
    return block.cast("long")


def with_next(docs: DataFrame, derived: dict[str, Column]) -> DataFrame:
    """doc_id and text with the derived columns, and next_<name> for text and each of them: that of the next document by
    descending doc_id, the first again after the last.

    Documents are dealt to blocks of neighbouring ids, each sorted by a task of its own; the first document of a block is
    lent to the block before it, so no task holds the whole order. The first documents are found by an aggregation that
    each map task does over its own rows, so texts are shuffled once.
    """
    blocked = docs.select("doc_id", "text", blocks_of(docs).alias("_block"))
    heads = blocked.groupBy("_block").agg(F.min(F.struct(F.bitwise_not("doc_id").alias("down"), F.xxhash64("text").alias("h"), "text")).alias("_head"))
    # Block numbers alone, MOST_BLOCKS at most: their order is found in one small task.
    ring = blocked.select("_block").distinct()
    down = Window.orderBy(F.col("_block").desc())
    ring = ring.select("_block", F.coalesce(F.lag("_block").over(down), F.min("_block").over(Window.partitionBy())).alias("_before"))
    lent = heads.join(ring, "_block").select(F.bitwise_not("_head.down").alias("doc_id"), F.col("_head.text").alias("text"), F.col("_before").alias("_block"))
    both = blocked.withColumn("_is_lent", F.lit(0)).unionByName(lent.withColumn("_is_lent", F.lit(1)))
    both = both.select("*", *[c.alias(name) for name, c in derived.items()])
    inside = Window.partitionBy("_block").orderBy("_is_lent", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text")
    led = both.select("*", *[F.lead(c).over(inside).alias(f"next_{c}") for c in ("text", *derived)])
    return led.where("_is_lent = 0").drop("_block", "_is_lent")


def edited(text: Column, after: Column) -> Column:
    """text with its last third replaced by as much of the start of after."""
    third = F.floor(F.char_length(text) / 3).cast("int")
    return F.concat(F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 3) as int))"), F.substring(after, F.lit(1), third))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints and their likeness to each other and to the next document's."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    pairs = with_next(own, {"print": sketch(F.col("text"))})
    out = pairs.withColumn("edited", edited(F.col("text"), F.col("next_text"))).select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        "print",
        "next_print",
        sketch(F.col("edited")).alias("edited_print"),
    )
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("print")).alias("fingerprint"),
        as_text(F.col("edited_print")).alias("edited_fingerprint"),
        containment(F.col("print"), F.col("edited_print")).alias("near_edited"),
        containment(F.col("print"), F.col("next_print")).alias("near_next"),
    )


def op9_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
