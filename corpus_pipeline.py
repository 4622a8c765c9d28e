"""From raw documents to token counts: quality rules, near duplicates, repeated passages, source mix, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. run writes each stage's rows as
Parquet in the folder that driver and executors share, rereads them as the next one's docs, and deletes a stage's rows when
the next one's are written.

Defined cases, beside those of the operators: a null or empty text fails the quality rules, so no later stage sees one; a
null doc_id ranks last, and of near copies with null ids one stays; of wholly repeated rows one stays; documents of one
doc_id and unlike texts are each judged by their own text; a null source is a source of its own; an empty table gives an
empty result of the last stage's columns; further columns of documents are passed through, whatever their names (the last
stage replaces n_tokens, ids_sha256 and decoded_sha256, and drops text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, mixing, near_dup, quality, substring
from tessera.llm.common import new_folder, removed_folder

#: Words of a shingle in the near-duplicate stage; op4's own query takes the four that its contract names.
SHINGLE = 5


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    # Columns of docs may be named like those that the operator adds.
    return quality.verdicts(docs).where("judged.kept").select("row.*")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dup.without_near_duplicates(docs, SHINGLE)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one holds. A document that loses words keeps the others, joined by
    one space; n_chars follows. All other documents stay as they are."""
    # Further columns travel in a struct, as one may be named like what the operator adds.
    more = [c for c in docs.columns if c not in ("doc_id", "text")]
    cut = substring.removed(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in more] or [F.lit(0)]).alias("more")))
    own = {c: F.col(f"more.`{c}`") for c in more} | {"doc_id": F.col("doc_id"), "text": F.coalesce("kept_text", "text")}
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("kept_text").isNotNull(), F.char_length("kept_text").cast("long")).otherwise(own["n_chars"])
    return cut.select(*[own[c].alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: each document as often as it is drawn."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of each row's ids and decoded text."""
    return bpe.tokenized(docs).drop("text")


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("substrings", cut_repeats),
    ("mix", mix_sources),
    ("bpe", encode),
]

#: The quality stage's histograms, the MinHash buckets and BPE aren't SQL; tests hold run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        out = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before:
            removed_folder(spark, before)
        before = out
    return docs
