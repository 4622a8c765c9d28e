"""Joins and rankings that the reports share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first by order."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """At most n rows per key with their place."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= n)


def overlay(first: DataFrame, second: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Both tables' keys; first's value where it has one."""
    a, b = first.select(*keys, F.col(value).alias("_a")), second.select(*keys, F.col(value).alias("_b"))
    return a.join(b, keys, "full_outer").select(*keys, F.coalesce("_a", "_b").alias(value))


def nearest(df: DataFrame, keys: list[str], day: str, target: Column, low: int, high: int) -> DataFrame:
    """Per key the row whose day is nearest to target, among those between low and high days before it."""
    back = F.datediff(target, F.col(day))
    rows = df.where(back.between(low, high)).withColumn("gap", F.abs(back - (low + high) // 2))
    best = F.min_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct("gap", day)).alias("best")
    return rows.groupBy(*keys).agg(best).select(*keys, "best.*")


def fresh(created: Column, as_of: str, days: int) -> Column:
    """Whether something made at a time is still good on a day."""
    return created >= F.date_sub(F.lit(as_of).cast("date"), days)


#: Ranges of an ordered running sum.
RANGES = 64


def running(df: DataFrame, order: str, names: list[str]) -> DataFrame:
    """df with before_<name> for each of names: its sum over the rows of smaller order, and total_<name>.

    Rows are dealt to ranges by quantiles of the order; each range sums its own, and the sums of the ranges before it, RANGES
    at most, are added. So no task holds the whole order.
    """
    edges = df.agg(F.percentile_approx(order, [k / RANGES for k in range(1, RANGES)]).alias("e")).first().e or []
    part = F.lit(0)
    for e in sorted(set(edges)):
        part = part + (F.col(order) > e).cast("int")
    ranged = df.withColumn("_range", part)
    inside = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_range").agg(*[F.sum(n).alias(f"sum_{n}") for n in names])
    before, every = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    sums = sums.select("_range", *[F.coalesce(F.sum(f"sum_{n}").over(before), F.lit(0)).alias(f"base_{n}") for n in names], *[F.sum(f"sum_{n}").over(every).alias(f"total_{n}") for n in names])
    joined = ranged.join(F.broadcast(sums), "_range")  # RANGES rows
    return joined.select(*df.columns, *[(F.col(f"base_{n}") + F.coalesce(F.sum(n).over(inside), F.lit(0))).alias(f"before_{n}") for n in names], *[f"total_{n}" for n in names])


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the curve from mid-ranks of distinct scores; scores are folded first."""
    by_score = df.groupBy(score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    pairs = running(by_score, score, ["n"]).withColumn("won", F.col("p") * (F.col("before_n") + F.col("n") / 2))
    sums = pairs.agg(F.sum("won").alias("won"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return sums.select(F.round(F.try_divide("won", F.col("p") * F.col("n")), 6).alias("auc"))


def best_cutoff(df: DataFrame, score: str, label: str) -> DataFrame:
    """The score from which on the true less the false positive rate is highest; the smallest of equals."""
    by_score = df.groupBy(score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    rates = running(by_score, score, ["p", "n"])
    rate = lambda n: (F.col(f"total_{n}") - F.col(f"before_{n}")) / F.col(f"total_{n}")
    j = F.round(rate("p") - rate("n"), 9)
    return rates.select(score, j.alias("j")).agg(F.max(F.struct("j", (-F.col(score)).alias("down"))).alias("b")).select((-F.col("b.down")).alias("cutoff"), F.round("b.j", 6).alias("j"))


def predicate(node: dict) -> Column:
    """A filter tree as one expression.

    A leaf is {column, op, value}, a group {all: [...]} or {any: [...]}; on: False switches a node off. Inactive nodes are
    left out and an empty group holds for every row. Texts compare without case, gt and lt by the number a text begins with.
    """
    if not node.get("on", True):
        return F.lit(True)
    if "all" in node or "any" in node:
        parts = [predicate(x) for x in node.get("all", node.get("any")) if x.get("on", True)]
        return reduce((lambda a, b: a & b) if "all" in node else (lambda a, b: a | b), parts) if parts else F.lit(True)
    raw = F.coalesce(F.col(node["column"]).cast("string"), F.lit(""))
    text, want = F.lower(raw), str(node.get("value", "")).lower()
    number = lambda c: F.regexp_extract(c, r"^\s*([-+]?[0-9]*\.?[0-9]+)", 1).try_cast("double")
    ops = {
        "is": lambda: text == want, "is_not": lambda: text != want, "contains": lambda: text.contains(want), "not_contains": lambda: ~text.contains(want),
        "starts": lambda: text.startswith(want), "empty": lambda: raw == "", "filled": lambda: raw != "",
        "gt": lambda: F.coalesce(number(raw) > float(want), F.lit(False)), "lt": lambda: F.coalesce(number(raw) < float(want), F.lit(False)),
    }
    return ops[node["op"]]()


def grid_order(columns: list[tuple[str, bool]]) -> list[Column]:
    """Sort keys of a grid: empties last either way, numbers as numbers, texts by padded digits so that a9 is before a10."""
    out = []
    for name, down in columns:
        raw = F.coalesce(F.col(name).cast("string"), F.lit(""))
        number = raw.try_cast("double")
        text = F.lower(F.regexp_replace(F.regexp_replace(raw, "([0-9]+)", "0000000000$1"), "0*([0-9]{10})(?![0-9])", "$1"))
        keys = [number, text]
        out += [F.when(raw == "", 1).otherwise(0).asc(), *(k.desc_nulls_last() if down else k.asc_nulls_last() for k in keys)]
    return out


def text_search(columns: list[str], words: str) -> Column:
    """Whether any cell has the words, without case."""
    return reduce(lambda a, b: a | b, [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).contains(words.lower()) for c in columns])
