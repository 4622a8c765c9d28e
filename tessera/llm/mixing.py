"""Mixing sources to target weights by systematic sampling.

Each document is due target / source_size copies. Within a source the documents stand in a fixed order by size; the
running sum of due copies, shifted by one offset per source, gives a document one copy for each whole number that it
crosses. Neighbours are of like size, so the words taken come near the target.

The order within a source is (size class, salt, size, doc_id). Ranks are made from counts of (source, class, salt) cells
and a row number inside a cell, so a source with most of the rows is never sorted by one task. Sources themselves are
ranked by one task, a row each.

A source's taken words come near its target up to about its largest document: neighbours in the order are of like size, so
what one draw takes too much the next ones take less. A source of a few long texts can so be far from its target.

Defined cases: a null text has size 0; a null source is a source of its own, the last; null doc_ids come after others of
their size; repeated rows are documents of their own; an empty table gives an empty result. Other columns are passed
through whatever their names; columns named like the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import n_words, rowed

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
SALTS = 256
SEED = "mix-1"
ADDED = ("size", "source_size", "target", "copies", "taken")


def size_class(size: Column) -> Column:
    """Octave of the size and the five leading bits: classes about 6 % wide."""
    octave = F.length(F.bin(size))
    return (octave * 32 + F.call_function("shiftright", size, F.greatest(octave - 5, F.lit(0)).cast("int"))).cast("int")


def source_offset(source: Column) -> Column:
    """A source's random offset in [0, 1), the same in every run."""
    digest = F.md5(F.concat(F.lit(SEED + "/"), F.coalesce(source, F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sources: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size) with target: all words dealt by weight, none above most times its source's size.

    Sources are taken by the ratio of cap to weight; one is capped while its cap is below what the words that are left
    would give it. That is the fixed point of resharing the excess.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("idx") % len(weights) + 1).cast("int"))
    ranked = (
        sources.withColumn("idx", F.row_number().over(everything) - 1)
        .withColumn("weight", weight.cast("long"))
        .withColumn("cap", F.col("source_size") * most)
    )
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "idx")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = Window.partitionBy()
    filled = (
        ranked.withColumn("left", F.sum("source_size").over(total) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("rest", F.sum("weight").over(onward))
        .withColumn("capped", F.col("cap") * F.col("rest") < F.col("left") * F.col("weight"))
    )
    level = filled.withColumn("place", F.row_number().over(by_ratio)).withColumn(
        "free", F.min(F.when(~F.col("capped"), F.struct("place", "left", "rest"))).over(total)
    )
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(
        (F.col("weight") * F.col("free.left")).cast("double") / F.col("free.rest").cast("double")
    )
    return level.select("source", "source_size", target.alias("target"))


def drawn(docs: DataFrame, own: list[str], weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """row (the columns own of docs), size, source_size, target, copies and taken (copies times size)."""
    size = n_words(F.col("text"))
    salt = F.coalesce(F.pmod(F.col("doc_id"), F.lit(SALTS)), F.lit(0)).cast("int")
    sized = rowed(docs, own, source=F.col("source"), doc_id=F.col("doc_id"), size=size, cls=size_class(size), salt=salt)
    cells = sized.groupBy("source", "cls", "salt").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    sources = targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    order = Window.partitionBy("source").orderBy("cls", "salt").rowsBetween(Window.unboundedPreceding, -1)
    places = cells.withColumn("first", F.coalesce(F.sum("n").over(order), F.lit(0)))
    a, b = places.alias("a"), sources.alias("b")
    places = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source"))).select(
        F.col("a.source").alias("p_source"), F.col("cls").alias("p_cls"), F.col("salt").alias("p_salt"), "first", "source_size", "target"
    )
    inside = Window.partitionBy("source", "cls", "salt").orderBy("size", F.col("doc_id").asc_nulls_last())
    keys = F.col("source").eqNullSafe(F.col("p_source")) & (F.col("cls") == F.col("p_cls")) & (F.col("salt") == F.col("p_salt"))
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    place = (F.col("first") + F.row_number().over(inside) - 1).cast("double")
    copies = F.floor((F.col("place") + 1) * F.col("due") + F.col("shift")) - F.floor(F.col("place") * F.col("due") + F.col("shift"))
    out = (
        sized.join(places, keys)
        .withColumn("due", due)
        .withColumn("shift", source_offset(F.col("source")))
        .withColumn("place", place)
        .withColumn("copies", F.least(copies, F.lit(most)).cast("long"))
        .withColumn("taken", F.col("copies") * F.col("size"))
    )
    return out.select("row", *ADDED)


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """docs with size, source_size, target, copies and taken."""
    return drawn(docs, [c for c in docs.columns if c not in ADDED], weights, most).select("row.*", *ADDED)


def mixed_documents(docs: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """The mix itself: each row as often as it has copies, with the columns of docs."""
    taken = drawn(docs, docs.columns, weights, most).where(F.col("copies") > 0)
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op6_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
classed AS (
  SELECT *, length(bin(size)) * 32 + (size >> greatest(length(bin(size)) - 5, 0)) AS cls,
    coalesce(((doc_id % 256) + 256) % 256, 0) AS salt
  FROM sized),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS idx
  FROM sized GROUP BY source),
wt AS (
  SELECT *, CASE idx % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap FROM src),
filled AS (
  SELECT *,
    (SELECT sum(source_size) FROM src) - coalesce(sum(cap) OVER (ORDER BY cap / weight, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rem,
    sum(weight) OVER (ORDER BY cap / weight, idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
    row_number() OVER (ORDER BY cap / weight, idx) AS place
  FROM wt),
capped AS (SELECT *, cap * rest < rem * weight AS capped FROM filled),
free AS (SELECT rem, rest FROM capped WHERE NOT capped ORDER BY place LIMIT 1),
targets AS (
  SELECT c.source, c.source_size,
    CASE WHEN c.capped THEN CAST(c.cap AS DOUBLE)
         ELSE CAST(CAST(c.weight * f.rem AS BIGINT) AS DOUBLE) / CAST(CAST(f.rest AS BIGINT) AS DOUBLE) END AS target
  FROM capped c LEFT JOIN free f ON TRUE),
placed AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY cls, salt, size, doc_id ASC NULLS LAST) - 1 AS DOUBLE) AS place
  FROM classed),
due AS (
  SELECT p.doc_id, p.size, p.place, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS due,
    CAST(('0x' || substr(md5('mix-1/' || coalesce(p.source, '')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS shift
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(least(floor((place + 1) * due + shift) - floor(place * due + shift), 3) AS BIGINT) * size AS taken
FROM due
"""
