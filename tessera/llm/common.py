"""Small helpers that the corpus operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words as long; null counts as an empty text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rowed(docs: DataFrame, columns: list[str] | None = None, **helpers: Column) -> DataFrame:
    """Columns of docs (all, if not said) as one struct row, beside it helpers: no name in docs can clash with theirs."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in columns or docs.columns]).alias("row"), *[c.alias(name) for name, c in helpers.items()])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the session names none, a temporary one is set on a single machine (as in tests); on a cluster that is an error,
    as no executor would see the driver's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        found = context._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
        if not found:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            found = tempfile.mkdtemp(prefix="tessera-")
            context.setCheckpointDir(found)
    return found


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts its lineage."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def saved_by(df: DataFrame, name: str, key: str, then: Callable[[DataFrame], DataFrame] = lambda dealt_out: dealt_out) -> DataFrame:
    """Deals df out by key, writes what then makes of it to the shared folder as a table bucketed by key, and reads it back: joins
    and sums by key don't shuffle it again. The folder outlasts the catalog's name for it, which goes at once."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = new_folder(spark, name)
    table_name = path.rsplit("/", 1)[1].replace("-", "_")
    then(df.repartition(n, key)).write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, key).saveAsTable(table_name)
    out = spark.table(table_name)
    out.schema  # noqa: B018  resolves the table while it has a name
    spark.sql(f"DROP TABLE {table_name}")
    return out


def removed_folder(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discarded(*tables: DataFrame) -> None:
    """Deletes the files of saved tables that nothing reads any more: all that follows from them is saved itself."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            removed_folder(df.sparkSession, folder)


#: What this Python process keeps between tasks, of one operator at a time.
_kept: dict[tuple, object] = {}


def kept_between_tasks(key: tuple, make: Callable[[], object]) -> object:
    """make's result, the same for all tasks of this worker that ask for key, until one asks for another or lets go."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def let_go() -> None:
    """Drops what an earlier operator's tasks left: Spark uses a worker again, and its tables would count beside this one's."""
    _kept.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
