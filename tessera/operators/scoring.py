"""Verdict, score, tier and priority from answered facts in long form: (domain, sid, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import config


def segment(employees: Column) -> Column:
    """Size band by the first number in the text; none, or one outside all bands, is SMB."""
    n = F.regexp_replace(F.regexp_extract(employees, r"[0-9][0-9,]*", 0), ",", "").try_cast("bigint")
    out = None
    for name, low, high in config.BANDS:
        fits = (n >= low) if high is None else n.between(low, high)
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out.otherwise("SMB")


def with_roles(signals: DataFrame, roles: DataFrame, pipeline: str) -> DataFrame:
    """signals with grp, place and name of one pipeline. roles has 69 rows a pipeline, so it may go to every task."""
    own = roles.where(F.col("pipeline") == pipeline).select("sid", "grp", "place", "name")
    return signals.join(F.broadcast(own), "sid")


def decide(signals: DataFrame, status: DataFrame, pipeline: str) -> DataFrame:
    """One row per domain of status (domain, status): gate, verdict, confirmed and the ordered lists behind them.

    signals carries grp, place and hard (boolean: a must that failed for good). One aggregation by domain.
    """
    soft = F.col("sid").isin(*config.SOFT_MUSTS[pipeline]) & ~F.coalesce("hard", F.lit(False)) if config.SOFT_MUSTS[pipeline] else F.lit(False)
    must, out, v = F.col("grp") == "must", F.col("grp") == "exclusion", F.col("value")
    listed = lambda when: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("place", "sid")))), lambda x: x["sid"]), ",")
    flags = signals.groupBy("domain").agg(
        listed(out & (v == "yes")).alias("excluded"),
        listed(must & (v == "no") & ~soft).alias("failed"),
        listed(must & (v == "no") & soft).alias("prelaunch"),
        listed((must | out) & (v == "check")).alias("checks"),
        F.count_if(must & (v == "yes")).alias("confirmed"),
        F.count_if(must).alias("musts"),
        F.count_if(must & (v == "no")).alias("nos"),
        F.max(F.when(F.col("sid") == "M2", v)).alias("m2"),
    )
    joined = with_verdict(status.join(flags, "domain"), pipeline)
    return joined.select("domain", "gate", "verdict", icp("verdict").alias("icp"), F.col("confirmed").cast("long").alias("confirmed"), "checks", "excluded", "failed", "prelaunch")


def with_verdict(flags: DataFrame, pipeline: str) -> DataFrame:
    """flags (status, excluded, failed, prelaunch, checks, confirmed, musts, nos, m2) with gate and verdict."""
    some = lambda c: F.col(c) != ""
    lost = F.col("status").isin("unreachable", "error") | ((F.col("status") == "blocked") & ~(some("checks") | some("excluded") | (F.col("nos") > 0) | (F.col("confirmed") > 0)))
    gate = (
        F.when(lost, "not reached").when(some("excluded"), "excluded").when(some("failed"), "failed must-have")
        .when(F.col("confirmed") == F.col("musts"), "pass").otherwise("pass (some unknown)")
    )
    no_site = (F.col("confirmed") == 0) & F.lit(config.WEBSITE_OPTIONAL[pipeline]) & (F.coalesce("m2", F.lit("unknown")) != "yes")
    verdict = (
        F.when(F.col("gate") == "not reached", "Unknown: site not reached").when(F.col("gate").isin("excluded", "failed must-have"), "No")
        .when(some("checks"), "Needs AI check").when(F.col("gate") == "pass", "Yes").when(some("prelaunch"), "Yes (pre-launch)")
        .when(no_site, "Needs a call: no website").otherwise("Yes (some must-haves unconfirmed)")
    )
    return flags.withColumn("gate", gate).withColumn("verdict", verdict)


def decide_wide(wide: DataFrame, pipeline: str) -> DataFrame:
    """decide on one row a domain: wide (status and v_<fact> for each fact) with gate, verdict, icp and the lists behind them.
    Nothing is shuffled."""
    of = {g: [sid for p, sid, group, _, _ in config.roles() if p == pipeline and group == g] for g in ("must", "exclusion")}
    soft = config.SOFT_MUSTS[pipeline]
    v = lambda sid: F.col(f"v_{sid}")
    listed = lambda sids, value: F.array_join(F.array_compact(F.array(F.lit(None).cast("string"), *[F.when(v(s) == value, s) for s in sids])), ",")
    count = lambda sids, value: sum(((F.coalesce(v(s), F.lit("")) == value).cast("int") for s in sids), F.lit(0))
    both = [sid for p, sid, group, _, _ in config.roles() if p == pipeline and group in ("must", "exclusion")]
    flags = wide.withColumns({
        "excluded": listed(of["exclusion"], "yes"), "failed": listed([s for s in of["must"] if s not in soft], "no"), "prelaunch": listed([s for s in of["must"] if s in soft], "no"), "checks": listed(both, "check"),
        "confirmed": count(of["must"], "yes").cast("long"), "musts": F.lit(len(of["must"])).cast("long"), "nos": count(of["must"], "no").cast("long"), "m2": v("M2"),
    })
    return with_verdict(flags, pipeline).withColumn("icp", icp("verdict")).drop("musts", "nos", "m2")


def score_wide(wide: DataFrame, pipeline: str) -> DataFrame:
    """score on one row a domain: wide (segment and v_<fact> for each fact) with score, tier, breakdown, low, high and locked."""
    names = {sid: name for _, sid, name in config.facts()}
    skipped = {s: parent for parent, sids in config.SKIP[pipeline].items() for s in sids}
    levels: dict[str, dict[str, int]] = {}
    for p, sid, segment, points, _ in sorted(config.weights(), key=lambda w: w[4]):
        if p == pipeline:
            levels.setdefault(sid, {})[segment] = points
    points_of = {sid: F.element_at(F.create_map(*[F.lit(x) for pair in by.items() for x in pair]), F.col("segment")) for sid, by in levels.items()}
    parts, moves = [], []
    for sid, points in points_of.items():
        value = F.col(f"v_{sid}")
        yes = value == "yes"
        if sid in skipped:
            yes = yes & (F.coalesce(F.col(f"v_{skipped[sid]}"), F.lit("")) != "yes")
        text = F.concat(F.lit(names[sid] + " "), F.when(points > 0, "+").otherwise(""), points.cast("string"))
        parts.append(F.when(yes & (points != 0), F.struct(points.alias("points"), text.alias("text"))))
        moves.append(F.when(value.isin("unknown", "check"), points))
    own, still = F.array_compact(F.array(*parts)), F.array_compact(F.array(*moves))
    total = F.aggregate(own, F.lit(0).cast("long"), lambda acc, x: acc + x["points"])
    loss = F.aggregate(still, F.lit(0).cast("long"), lambda acc, x: acc + F.least(x, F.lit(0)))
    gain = F.aggregate(still, F.lit(0).cast("long"), lambda acc, x: acc + F.greatest(x, F.lit(0)))
    out = wide.withColumn("score", total).withColumn("breakdown", F.array_join(F.transform(own, lambda x: x["text"]), "; "))
    out = out.withColumns({"tier": tier(F.col("score")), "low": F.col("score") + loss, "high": F.col("score") + gain})
    return out.withColumn("locked", (F.col("low") >= config.STRONG_AT) == (F.col("high") >= config.STRONG_AT))


def worth_wide(wide: DataFrame, pipeline: str, most: int) -> DataFrame:
    """(domain, sid, worth, n): the open facts of each row of wide (segment and v_<fact> for each fact) that an answer is worth
    most for, then by place, at most so many. Nothing is shuffled."""
    fixed = {"must": 4, "exclusion": 4, "weak": 2}
    levels: dict[str, dict[str, int]] = {}
    for p, sid, segment, points, _ in config.weights():
        if p == pipeline and points > 0:
            levels.setdefault(sid, {})[segment] = points
    cells = []
    for p, sid, group, place, _ in config.roles():
        if p == pipeline and group != "info" and (group in fixed or sid in levels):
            by = levels.get(sid, {})
            worth = F.lit(fixed[group]) if group in fixed else F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in by.items() for x in pair]), F.col("segment")), F.lit(0))
            cells.append(F.when(F.col(f"v_{sid}").isin("unknown", "check") & (worth > 0), F.struct((-worth).alias("down"), F.lit(place).alias("place"), F.lit(sid).alias("sid"))))
    # The outer form spares Spark a test for empty arrays, which would work them out once more.
    rows = wide.select("domain", F.posexplode_outer(F.slice(F.array_sort(F.array_compact(F.array(*cells))), 1, most)).alias("k", "x")).where("x IS NOT NULL")
    return rows.select("domain", "x.sid", (-F.col("x.down")).alias("worth"), (F.col("k") + 1).alias("n"))


def icp(verdict: str) -> Column:
    v = F.col(verdict)
    return F.when(v.startswith("Yes"), "YES").when(v == "No", "NO").otherwise("PENDING")


def score(signals: DataFrame, segments: DataFrame, weights: DataFrame, pipeline: str) -> DataFrame:
    """(domain, segment, score, tier, breakdown) of each domain of segments: points of its yes facts.

    The weight table has at most 69 x 3 rows a pipeline, so the join moves no signals.
    """
    own = F.broadcast(weights.where((F.col("pipeline") == pipeline) & (F.col("points") != 0)).select("sid", "segment", "points", F.col("place").alias("at")))
    yes = signals.where(F.col("value") == "yes").select("domain", "sid", "name")
    for sid, skipped in config.SKIP[pipeline].items():
        has = F.max(F.col("sid") == sid).over(Window.partitionBy("domain"))
        yes = yes.withColumn("_has", has).where(~(F.col("_has") & F.col("sid").isin(*skipped))).drop("_has")
    parts = yes.join(segments, "domain").join(own, ["sid", "segment"])
    text = F.concat("name", F.lit(" "), F.when(F.col("points") > 0, "+").otherwise(""), F.col("points").cast("string"))
    sums = parts.groupBy("domain").agg(
        F.sum("points").alias("total"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", text.alias("text")))), lambda x: x["text"]), "; ").alias("parts")
    )
    total = F.coalesce("total", F.lit(0)).cast("long")
    return segments.join(sums, "domain", "left").select("domain", "segment", total.alias("score"), tier(total).alias("tier"), F.coalesce("parts", F.lit("")).alias("breakdown"))


def tier(score: Column) -> Column:
    return F.when(score >= config.STRONG_AT, "Strong fit").otherwise("Weak fit")


def tier_range(signals: DataFrame, scores: DataFrame, weights: DataFrame, pipeline: str) -> DataFrame:
    """Lowest and highest score that open facts can still lead to, and whether the tier is locked."""
    own = F.broadcast(weights.where(F.col("pipeline") == pipeline).select("sid", "segment", "points"))
    still = signals.where(F.col("value").isin("unknown", "check")).select("domain", "sid").join(scores.select("domain", "segment"), "domain").join(own, ["sid", "segment"])
    moves = still.groupBy("domain").agg(F.sum(F.least("points", F.lit(0))).alias("loss"), F.sum(F.greatest("points", F.lit(0))).alias("gain"))
    low, high = (F.col("score") + F.coalesce(c, F.lit(0)) for c in ("loss", "gain"))
    out = scores.join(moves, "domain", "left").withColumn("low", low.cast("long")).withColumn("high", high.cast("long"))
    return out.select("domain", "score", "tier", "low", "high", ((F.col("low") >= config.STRONG_AT) == (F.col("high") >= config.STRONG_AT)).alias("locked"))


def priority(verdict: Column, icp: Column, score: Column, pipeline: str) -> Column:
    cut = config.PRIORITY[pipeline]
    if not cut:
        return F.lit("")
    return (
        F.when(verdict.isin("Yes (pre-launch)", "Needs a call: no website"), "C").when(icp != "YES", "")
        .when(score >= cut[0], "A").when(score >= cut[1], "B").otherwise("C")
    )
