"""Answers of several layers made one: settle, opposites, conditional facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import config


def settle(cur: Column, new: Column, match: Column, grp: Column, overrule: Column | None = None) -> Column:
    """What a fact's value becomes when a later layer answers it; all arguments are values of that one fact.

    A weaker match never makes a company a No; a strong one that contradicts a settled answer opens it again.
    """
    overrule = F.lit(False) if overrule is None else overrule
    strict = ((grp == "exclusion") & (new == "yes")) | ((grp == "must") & (new == "no"))
    good = (match == "strong") | ((match == "medium") & ~strict)
    said = F.when(new.isin("yes", "no") & ~good, F.when((grp == "exclusion") & (new == "yes"), "check")).otherwise(new)
    settled = cur.isin("yes", "no") & said.isin("yes", "no")
    return (
        F.when(said.isNull(), cur)
        .when(settled & (cur != said) & (match == "strong") & ~overrule, "check")
        .when(~cur.isin("check", "unknown") & ~overrule, cur)
        .when((cur == "check") & (said == "check"), cur)
        .otherwise(said)
    )


#: Type of a fact's offers: the layer, 0 for a marker of that layer and 1 for its answer, the answer and how sure it is.
OFFERS = "array<struct<layer:int,rank:int,value:string,match:string>>"


def _folded(joined: DataFrame) -> DataFrame:
    """joined (domain, sid, value, grp, offers) with end: the value and the layers that opened a settled answer again."""
    start = F.struct(F.col("value").alias("value"), F.array().cast("array<int>").alias("opened"))

    def step(acc: Column, offer: Column) -> Column:
        after = F.when(offer["match"] == "reopen", F.when(acc["value"] == "yes", "check").otherwise(acc["value"])).otherwise(settle(acc["value"], offer["value"], offer["match"], F.col("grp")))
        opened = acc["value"].isin("yes", "no") & (after == "check") & (offer["rank"] == 1)
        return F.struct(after.alias("value"), F.when(opened, F.concat(acc["opened"], F.array(offer["layer"]))).otherwise(acc["opened"]).alias("opened"))

    return joined.withColumn("end", F.aggregate(F.coalesce("offers", F.array().cast(OFFERS)), start, step))


def settle_layers(signals: DataFrame, candidates: DataFrame, off: dict[int, tuple[str, ...]] | None = None) -> DataFrame:
    """signals (domain, sid, value, grp) after all candidates (domain, sid, layer, value, match), lowest layer first.

    off: facts that a layer may not answer. A fact's candidates are a handful, one a layer, so the fold runs inside one row.
    Where a layer contradicts M1, it opens E4 = yes too, before its own answer to E4; later layers may settle E4 again.
    """
    for layer, sids in (off or {}).items():
        candidates = candidates.where(~((F.col("layer") == layer) & F.col("sid").isin(*sids)))
    offer = F.struct("layer", F.lit(1).alias("rank"), "value", "match")
    offers = candidates.groupBy("domain", "sid").agg(F.array_sort(F.collect_list(offer)).alias("offers"))
    joined = signals.join(offers, ["domain", "sid"], "left")
    first = _folded(joined.where("sid = 'M1'")).select("domain", F.transform(F.col("end.opened"), lambda x: F.struct(x.alias("layer"), F.lit(0).alias("rank"), F.lit(None).cast("string").alias("value"), F.lit("reopen").alias("match"))).alias("marks"))
    first = first.where(F.size("marks") > 0).select("domain", F.lit("E4").alias("sid"), "marks")
    marked = joined.join(first, ["domain", "sid"], "left")
    every = F.when(F.col("marks").isNull(), F.col("offers")).otherwise(F.array_sort(F.concat(F.coalesce("offers", F.array().cast(OFFERS)), "marks")))
    return _folded(marked.withColumn("offers", every)).select("domain", "sid", "grp", F.col("end.value").alias("value"))


def derive(signals: DataFrame, opposites: dict[str, str] = config.OPPOSITES) -> DataFrame:
    """Open facts whose opposite is yes become no."""
    pairs = signals.sparkSession.createDataFrame(list(opposites.items()), "sid string, other string")
    yes = signals.where(F.col("value") == "yes").select("domain", F.col("sid").alias("other"))
    # Eight pairs at most: known size.
    closed = yes.join(F.broadcast(pairs), "other").select("domain", "sid").distinct().withColumn("_no", F.lit(True))
    value = F.when(F.col("_no") & F.col("value").isin("unknown", "check"), "no").otherwise(F.col("value"))
    return signals.join(closed, ["domain", "sid"], "left").withColumn("value", value).drop("_no")


def gate_rules(pipeline: str) -> list[tuple[str, str]]:
    """(fact, portable expression over v_<fact> columns) in an order in which parents come first.

    Nothing is left to ask, so an open parent counts as unknown.
    """
    out = []
    for child in config.in_order(pipeline):
        tests = []
        for parent, allowed in config.run_if(pipeline)[child].items():
            final = f"CASE WHEN v_{parent} = 'check' THEN 'unknown' ELSE v_{parent} END"
            tests.append(f"({final}) NOT IN ({', '.join(repr(a) for a in allowed)})")
        out.append((child, f"CASE WHEN v_{child} IN ('unknown', 'check') AND ({' OR '.join(tests)}) THEN 'na' ELSE v_{child} END"))
    return out


def no_rules(pipeline: str) -> tuple[str, list[str]]:
    """(portable test that the company is a No already, facts that are closed then)."""
    group = {sid: g for p, sid, g, _, _ in config.roles() if p == pipeline}
    tests = [f"v_{s} = 'yes'" for s, g in group.items() if g == "exclusion"]
    tests += [f"v_{s} = 'no'" for s, g in group.items() if g == "must" and s not in config.SOFT_MUSTS[pipeline]]
    return " OR ".join(tests), [s for s, g in group.items() if g in ("must", "exclusion")]


def close_wide(wide: DataFrame, pipeline: str) -> DataFrame:
    """wide (v_<fact> for each fact) once facts that don't apply any more are na: parents first, one projection for each depth
    of the run_if graph. Nothing is shuffled."""
    is_no, closed = no_rules(pipeline)
    out = wide.withColumn("_no", F.expr(is_no))
    out = out.withColumns({f"v_{s}": F.expr(f"CASE WHEN _no AND v_{s} IN ('unknown', 'check') THEN 'na' ELSE v_{s} END") for s in closed})
    depth: dict[str, int] = {}
    rules: dict[int, dict[str, Column]] = {}
    for sid, rule in gate_rules(pipeline):
        depth[sid] = 1 + max((depth.get(p, 0) for p in config.run_if(pipeline)[sid]), default=0)
        rules.setdefault(depth[sid], {})[f"v_{sid}"] = F.expr(rule)
    for k in sorted(rules):
        out = out.withColumns(rules[k])
    return out.drop("_no")


def unpivoted(wide: DataFrame) -> DataFrame:
    """(domain, sid, value) of wide rows; facts without a value are left out."""
    cells = [F.struct(F.lit(sid).alias("sid"), F.col(f"v_{sid}").alias("value")) for _, sid, _ in config.facts()]
    return wide.select("domain", F.explode(F.array(*cells)).alias("cell")).select("domain", "cell.sid", "cell.value").where(F.col("value").isNotNull())


def pivoted(signals: DataFrame) -> DataFrame:
    """One row a domain from (domain, sid, value): one shuffle of the facts."""
    return signals.groupBy("domain").agg(*[F.max(F.when(F.col("sid") == s, F.col("value"))).alias(f"v_{s}") for _, s, _ in config.facts()])


def close_gates(signals: DataFrame, pipeline: str) -> DataFrame:
    """Facts (domain, sid, value) that don't apply any more become na."""
    return unpivoted(close_wide(pivoted(signals), pipeline))


#: What a settled fact carries beside its value.
CARRIED = ("value", "evidence", "url", "note", "method")
#: A fact's answer by a guess of the rules that the register overrules.
GUESSED = "for-profit legal entity"


def settle_with(cur: Column, offer: Column, sid: Column, grp: Column) -> Column:
    """A fact's state (CARRIED) after an offer (value, match, evidence, url, note, method), by the rules of settle.

    A contradiction keeps both sides' evidence; an exclusion that only weakly matches is left to be confirmed; E5 = no by a
    guess from the legal form gives way to a yes.
    """
    overrule = (sid == "E5") & (offer["value"] == "yes") & (cur["value"] == "no") & cur["evidence"].startswith(GUESSED)
    after = settle(cur["value"], offer["value"], offer["match"], grp, overrule)
    strict = ((grp == "exclusion") & (offer["value"] == "yes")) | ((grp == "must") & (offer["value"] == "no"))
    good = (offer["match"] == "strong") | ((offer["match"] == "medium") & ~strict)
    possible = offer["value"].isin("yes", "no") & ~good
    note = F.when(possible, F.concat(F.lit("possible match only, to confirm: "), offer["note"])).otherwise(offer["note"])
    said = F.when(possible, "check").otherwise(offer["value"])
    against = cur["value"].isin("yes", "no") & said.isin("yes", "no") & (said != cur["value"]) & (offer["match"] == "strong") & ~overrule
    written = F.when(possible & ~((grp == "exclusion") & (offer["value"] == "yes")), False).when(against, True).when(~cur["value"].isin("check", "unknown") & ~overrule, False).otherwise(~((cur["value"] == "check") & (said == "check")))
    both = F.struct(
        after.alias("value"), F.concat(F.lit("website: "), cur["evidence"], F.lit(" | "), offer["method"], F.lit(": "), offer["evidence"]).alias("evidence"), offer["url"].alias("url"),
        F.concat(F.lit("website said "), cur["value"], F.lit(", "), offer["method"], F.lit(" said "), offer["value"], F.lit(" ("), note, F.lit(")")).alias("note"), offer["method"].alias("method"),
    )
    new = F.struct(after.alias("value"), offer["evidence"].alias("evidence"), offer["url"].alias("url"), F.concat(offer["method"], F.lit(", "), offer["match"], F.lit(" match: "), note).alias("note"), offer["method"].alias("method"))
    return F.when(~written, F.struct(*[cur[c].alias(c) for c in CARRIED])).when(against, both).otherwise(new)


def settle_evidence(signals: DataFrame, candidates: DataFrame) -> DataFrame:
    """signals (domain, sid, grp and CARRIED) after all candidates (domain, sid, layer, value, match, evidence, url, note,
    method), lowest layer first; one fold inside each fact's row.

    Where a layer contradicts M1, it opens E4 = yes before its own answer to E4, with the layer's evidence as the note.
    """
    offer = F.struct("layer", F.lit(1).alias("rank"), "value", "match", "evidence", "url", "note", "method")
    kind = "array<struct<layer:int,rank:int,value:string,match:string,evidence:string,url:string,note:string,method:string>>"
    offers = candidates.groupBy("domain", "sid").agg(F.array_sort(F.collect_list(offer)).cast(kind).alias("offers"))
    joined = signals.join(offers, ["domain", "sid"], "left")
    none = F.array().cast(kind)

    def folded(rows: DataFrame) -> DataFrame:
        start = F.struct(F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in CARRIED]).alias("s"), none.alias("marks"))

        def step(acc: Column, o: Column) -> Column:
            s = acc["s"]
            mark = (o["rank"] == 0) & (s["value"] == "yes")
            opened = F.struct(F.lit("check").alias("value"), s["evidence"].alias("evidence"), s["url"].alias("url"), F.concat(F.lit("directory shows a US location: "), o["evidence"]).alias("note"), F.lit("directory").alias("method"))
            kept = F.struct(*[s[c].alias(c) for c in CARRIED])
            after = F.when(o["rank"] == 0, F.when(mark, opened).otherwise(kept)).otherwise(settle_with(s, o, F.col("sid"), F.col("grp")))
            against = (o["rank"] == 1) & s["value"].isin("yes", "no") & (settle(s["value"], o["value"], o["match"], F.col("grp")) == "check")
            sent = F.struct(o["layer"].alias("layer"), F.lit(0).alias("rank"), o["value"].alias("value"), o["match"].alias("match"), o["evidence"].alias("evidence"), o["url"].alias("url"), o["note"].alias("note"), o["method"].alias("method"))
            return F.struct(after.alias("s"), F.when(against, F.concat(acc["marks"], F.array(sent))).otherwise(acc["marks"]).alias("marks"))

        return rows.withColumn("end", F.aggregate(F.coalesce("offers", none), start, step))

    marks = folded(joined.where("sid = 'M1'")).select("domain", F.lit("E4").alias("sid"), F.col("end.marks").alias("marks")).where(F.size("marks") > 0)
    every = joined.join(marks, ["domain", "sid"], "left").withColumn("offers", F.array_sort(F.concat(F.coalesce("offers", none), F.coalesce("marks", none)))).drop("marks")
    return folded(every).select("domain", "sid", "grp", *[F.col(f"end.s.{c}").alias(c) for c in CARRIED])
