"""Mixing sources to target weights: entropy balancing.

Every document starts with rate 1: taken once. Among all rates that give each source its share of the tokens and stay within
its cap, those are wanted that are closest to the start in relative entropy. They are exponentially tilted,
``min(cap, exp(tilt * tokens / scale))``, and the tilt of a source solves a convex dual problem: Newton iterations whose sums are taken
over all documents at once. Rates are then rounded into whole copies without losing the shares.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratograph.session import cut

#: Newton ends when every source is as close as this to its tokens; a tilt beyond which all documents of a source are at the cap.
TOLERANCE, STEPS, SATURATED = 1e-10, 80, 1e12
_TILTS = T.StructType([T.StructField("mix_id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("tilt", T.DoubleType()),
                       T.StructField("scale", T.DoubleType()), T.StructField("cap", T.DoubleType()), T.StructField("share", T.DoubleType()), T.StructField("budget", T.DoubleType())])


def _histogram(sizes: DataFrame) -> DataFrame:
    """(source, tokens, docs): documents per size, which is all the sums need; the largest source is as small as its sizes are few."""
    return sizes.filter("source IS NOT NULL AND tokens > 0").groupBy("source", "tokens").agg(F.count("*").alias("docs"))


def _targets(targets: DataFrame) -> list:
    """The parameter table: one row per mix and source. Rows without positive weight ask for nothing."""
    return (targets.filter("mix_id IS NOT NULL AND source IS NOT NULL AND weight > 0").groupBy("mix_id", F.lower(F.trim("source")).alias("source"))
            .agg(F.sum("weight").alias("weight"), F.min("max_repeats").alias("cap")).orderBy("mix_id", "source").collect())


def _rate(tilt: Column | str, cap: Column | str) -> Column:
    """min(cap, exp(tilt * tokens / scale)), compared as logarithms so that nothing overflows."""
    return F.exp(F.least(F.log(F.col(cap)), F.col(tilt) * F.col("tokens") / F.col("scale")))


def _next(r: dict, s: float, slope: float) -> None:
    """One safeguarded Newton step on log(tokens) of a source, which is increasing in the tilt and nearly linear: outside the bracket it halves that instead."""
    gap = math.log(s / r["goal"]) if s > 0 else -math.inf
    r["gap"] = abs(gap)
    if r["gap"] <= TOLERANCE:
        return
    if gap > 0:
        r["high"] = r["tilt"]
    else:
        r["low"] = r["tilt"]
    step = r["tilt"] - gap * s / slope if slope > 0 and math.isfinite(gap) else math.nan
    low, high = r["low"], r["high"]
    if low < step < high:
        r["tilt"] = step
    elif math.isfinite(low) and math.isfinite(high):
        r["tilt"] = (low + high) / 2
    else:  # one end is open: go on, twice as far each time
        r["tilt"] = max(2 * abs(low), 1.0) if math.isfinite(low) else -max(2 * abs(high), 1.0)


def plan_mix(sizes: DataFrame, targets: DataFrame) -> tuple[list[tuple], DataFrame]:
    """Solve the dual: rows (mix_id, source, tilt, scale, cap, share, budget) and the histogram.

    A source without documents cannot give anything; the weights of the others are scaled up to one.
    The total of a mix is the tokens of all its sources, or as many of them as the cap of the most
    wanted source allows, so that every share is reached. Then for every source

        sum over documents of tokens * min(cap, exp(tilt * tokens / scale)) = share * total

    has one solution: the left side grows with the tilt from 0 to cap times all tokens. A tilt above 0 repeats long
    documents most, one below 0 thins them out first. Each round is one job over the histogram for all sources of
    all mixes; the driver holds a few numbers per row of the parameter table. Where all tokens the cap allows are wanted, every document
    is at the cap.
    """
    spark = sizes.sparkSession
    histogram = cut(_histogram(sizes))
    wanted = _targets(targets)
    stats = {r["source"]: r for r in histogram.groupBy("source").agg(F.sum("docs").alias("docs"), F.sum(F.col("docs") * F.col("tokens")).alias("tokens"))
             .join(F.broadcast(spark.createDataFrame([(s,) for s in sorted({w["source"] for w in wanted})] or [("",)], "source string")), "source").collect()}
    rows = []
    for mix in sorted({w["mix_id"] for w in wanted}):
        mine = [w for w in wanted if w["mix_id"] == mix and w["source"] in stats and (w["cap"] is None or w["cap"] > 0)]
        total = sum(w["weight"] for w in mine)
        if not mine:
            continue
        budget = float(sum(stats[w["source"]]["tokens"] for w in mine))
        for w in mine:
            if w["cap"] is not None:
                budget = min(budget, w["cap"] * stats[w["source"]]["tokens"] / (w["weight"] / total))
        for w in mine:
            s = stats[w["source"]]
            cap, goal = float(w["cap"]) if w["cap"] is not None else math.inf, w["weight"] / total * budget
            full = goal >= cap * s["tokens"] * (1 - TOLERANCE)
            rows.append({"mix_id": int(mix), "source": w["source"], "cap": cap, "share": w["weight"] / total, "budget": budget, "goal": goal, "scale": s["tokens"] / s["docs"],
                         "tilt": SATURATED if full else 0.0, "low": -math.inf, "high": math.inf, "gap": 0.0 if full else math.inf})
    for _ in range(STEPS):
        open_ = [(i, r) for i, r in enumerate(rows) if r["gap"] > TOLERANCE]
        if not open_:
            break
        tilts = spark.createDataFrame([(i, r["source"], r["tilt"], r["scale"], r["cap"]) for i, r in open_], "i int, source string, tilt double, scale double, cap double")
        mass = F.col("docs") * F.col("tokens") * _rate("tilt", "cap")
        below = F.col("tilt") * F.col("tokens") / F.col("scale") < F.log(F.col("cap"))  # at the cap, a tilt changes nothing
        sums = histogram.join(F.broadcast(tilts), "source").groupBy("i").agg(F.sum(mass).alias("s"), F.sum(F.when(below, mass * F.col("tokens") / F.col("scale")).otherwise(0.0)).alias("d"))  # rows of the parameter table
        for x in sums.collect():
            _next(rows[x["i"]], x["s"], x["d"])
    return [(r["mix_id"], r["source"], r["tilt"], r["scale"], r["cap"], r["share"], r["budget"]) for r in rows], histogram


_COPIES = "mix_id long, source string, tokens long, docs long, rate double, copies long"
#: How far a size may depart from its rate to make up for what larger ones left over.
LEEWAY = 0.1


def _whole(frame: pd.DataFrame) -> pd.DataFrame:
    """Copies per size of one source in one mix: rows are distinct sizes, so at most as many as the largest text has tokens."""
    frame = frame.sort_values("tokens", ascending=False, kind="stable")
    wanted, got, out = 0.0, 0, []
    for tokens, docs, rate, cap in zip(frame["tokens"], frame["docs"], frame["rate"], frame["cap"]):
        ideal = docs * rate
        wanted += ideal * tokens
        spare = math.ceil(LEEWAY * ideal)
        most = math.ceil(ideal) + spare if math.isinf(cap) else min(math.ceil(ideal) + spare, int(docs * cap))
        copies = min(max(round((wanted - got) / tokens), math.floor(ideal) - spare, 0), most)
        got += copies * int(tokens)
        out.append(copies)
    return frame.assign(copies=out)[["mix_id", "source", "tokens", "docs", "rate", "copies"]]


def mix_sources(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_id, doc_id, source, tokens, repeats, rate) for every document a mix takes.

    Rounding: the sizes of a source are walked from the largest to the smallest, each getting the whole
    number of copies that brings the tokens so far closest to what the rates ask for, so a source
    misses its share by about half of a small document. Within a size, documents differ by at most one copy; who gets one more is decided
    by hash rank, counted in two steps so that no size is ordered in one task. No document exceeds
    the cap. Documents of null source or without tokens are in no mix; a mix whose sources are all
    missing has no rows.
    """
    spark = sizes.sparkSession
    plan, histogram = plan_mix(sizes, targets)
    tilts = spark.createDataFrame(plan, _TILTS)
    rates = histogram.join(F.broadcast(tilts), "source").withColumn("rate", _rate("tilt", "cap"))  # rows of the parameter table
    copies = rates.groupBy("mix_id", "source").applyInPandas(_whole, _COPIES)
    copies = cut(copies.select("mix_id", "source", "tokens", "rate", F.floor(F.col("copies") / F.col("docs")).cast("long").alias("each"), F.pmod(F.col("copies"), F.col("docs")).alias("more")))
    # rank within a size: hash slices first, then within a slice; everything is joined by slice, so a size that many documents share is split
    docs = sizes.filter("source IS NOT NULL AND tokens > 0").select("doc_id", "source", "tokens", F.xxhash64("doc_id").alias("h"))
    docs = docs.withColumn("slice", F.shiftrightunsigned("h", 56))
    slices = docs.groupBy("source", "tokens", "slice").agg(F.count("*").alias("n"))
    offset = F.coalesce(F.sum("n").over(Window.partitionBy("source", "tokens").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # at most 256 rows
    shares = slices.withColumn("before", offset).drop("n").join(copies.filter("each > 0 OR more > 0"), ["source", "tokens"])
    ranked = docs.withColumn("_r", F.row_number().over(Window.partitionBy("source", "tokens", "slice").orderBy("h", "doc_id")))
    chosen = ranked.join(shares, ["source", "tokens", "slice"]).withColumn("repeats", F.col("each") + F.when(F.col("_r") + F.col("before") <= F.col("more"), 1).otherwise(0))
    return chosen.filter("repeats > 0").select("mix_id", "doc_id", "source", "tokens", "repeats", "rate")


def mix_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per mix and source of ``targets``: target share, share reached, tokens, documents used, most repeats."""
    wanted = targets.filter("mix_id IS NOT NULL AND source IS NOT NULL AND weight > 0").groupBy(F.col("mix_id").cast("long").alias("mix_id"), F.lower(F.trim("source")).alias("source")).agg(F.sum("weight").alias("weight"), F.min("max_repeats").alias("max_repeats"))
    per_mix = Window.partitionBy("mix_id")  # rows of the parameter table
    got = mixed.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"))
    both = wanted.join(got, ["mix_id", "source"], "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    there = F.sum(F.when(F.col("tokens") > 0, F.col("weight")).otherwise(0.0)).over(per_mix)
    return both.select("mix_id", "source", (F.col("weight") / F.sum("weight").over(per_mix)).alias("asked_share"), F.when(F.col("tokens") > 0, F.col("weight") / there).otherwise(0.0).alias("target_share"),
                       (F.col("tokens") / F.nullif(F.sum("tokens").over(per_mix), F.lit(0))).alias("reached_share"), "tokens", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), "max_repeats")
