"""Mixing sources to target weights by entropy balancing.

Each source has a target number of words. Among all ways to give documents rates between 0 and
``most`` that meet the targets, the one of greatest entropy relative to one copy each (with the upper
bound kept, so of the Fermi kind) has the rates

    rate = most / (1 + (most - 1) exp(-lambda_source * x)),  x = (size / mean size of the source) ^ power

where lambda solves the convex dual. With power 1 each document weighs alike in the entropy and the tilt
falls on long documents alone; with power 0 each word does and all rates of a source are equal; the default
of a half lies between. The dual is solved by Newton steps, each one aggregation over the documents, which
enter as a histogram (source, size, documents), so a hot source is pre-aggregated and never in one task.
Rates become whole copies by error diffusion in bounded pieces of each source, longest documents first,
so what remains open at the end of a piece is about half of a short document. Only DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.llm.common import WORD, beside, cut, numbered

#: Documents whose copies are rounded together.
PIECE = 500


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """``sources`` (key, source_size, docs) with ``target``: filled by weight up to ``most`` times the source's size.

    The level at which the filling stands is found in closed form: sources fill up in order of
    most * size / weight. One row a source is all that is ranked here.
    """
    ordered = Window.orderBy("key")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int"))
    s = sources.withColumn("weight", weight).withColumn("cap", most * F.col("source_size").cast("double"))
    s = s.withColumn("full_at", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy()
    below = Window.orderBy("full_at", "key").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy("full_at", "key").rowsBetween(0, Window.unboundedFollowing)
    budget = share * F.sum("source_size").over(everything)
    level = (budget - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / F.sum("weight").over(onward)
    s = s.withColumn("level", level)
    first = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "key", "level"))).over(everything)
    s = s.withColumn("level", first["level"])
    return s.withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))).select("key", "source_size", "docs", "target")


def rate(lam: Column, x: Column, most: int) -> Column:
    return most / (1 + (most - 1) * F.exp(-F.least(F.lit(500.0), F.greatest(F.lit(-500.0), lam * x))))


def dual(sources: DataFrame, sizes: DataFrame, most: int, power: float, rounds: int = 200) -> DataFrame:
    """``sources`` with ``lam`` by Newton's method; sizes: (key, size, n).

    What a source gives grows with its lam, so each step also narrows the interval that holds the solution; a Newton step
    beyond it is replaced by the interval's middle, and none is longer than 2. ``rounds`` is a bound that raises.
    """
    columns = [*sources.columns, "lam", "mean", "low", "high"]
    nothing = F.lit(None).cast("double")
    state = cut(sources.withColumn("lam", F.lit(0.0)).withColumn("mean", F.col("source_size") / F.col("docs")).withColumn("low", nothing).withColumn("high", nothing))
    x = F.pow(F.col("size") / F.col("mean"), F.lit(power))
    for _ in range(rounds):
        w = rate(F.col("lam"), x, most)
        sums = beside(sizes, state.select("key", "lam", "mean"), ["key"], ["size"]).groupBy("key").agg(F.sum(F.col("n") * F.col("size") * w).alias("taken"), F.sum(F.col("n") * F.col("size") * x * w * (1 - w / most)).alias("slope"))
        off = F.col("target") - F.col("taken")
        open_ = (F.col("target") < most * F.col("source_size") * (1 - 1e-9)) & (F.abs(off) > 1e-7 * F.col("source_size")) & ((F.col("high") - F.col("low") > 1e-12).isNull() | (F.col("high") - F.col("low") > 1e-12))
        newton = F.when(F.col("slope") > 0, off / F.col("slope")).otherwise(F.signum(off) * 2)
        next_ = F.col("lam") + F.least(F.lit(2.0), F.greatest(F.lit(-2.0), newton))
        low, high = F.when(off > 0, F.col("lam")).otherwise(F.col("low")), F.when(off < 0, F.col("lam")).otherwise(F.col("high"))
        told = state.join(sums, "key", "left").select(*sources.columns, "lam", "mean", low.alias("low"), high.alias("high"), F.coalesce(open_, F.lit(False)).alias("open"), next_.alias("next"))
        beyond = (F.col("next") <= F.col("low")) | (F.col("next") >= F.col("high"))
        lam = F.when(~F.col("open"), F.col("lam")).when(beyond, (F.col("low") + F.col("high")) / 2).otherwise(F.col("next"))
        state = cut(told.withColumn("lam", F.coalesce(lam, F.col("next"), F.col("lam"))))
        if state.where("open").limit(1).count() == 0:
            break
        state = state.select(*columns)
    else:
        raise RuntimeError(f"mixing: the dual is not solved after {rounds} rounds")
    return state.select(*sources.columns, "lam", "mean")


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, power: float = 0.5) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, copies and rate for every row of ``docs``.

    Sources in order of their code points, null last, weigh ``weights`` in turn; together they are to give ``share``
    times all words, none more than ``most`` times its own. ``copies`` is between 0 and ``most``; taken = copies * size.
    A null text has size 0 and is taken once or never, which counts nothing. Repeated rows are rows of their own, and are dealt to
    pieces like others, however many there are. An empty table gives an empty result; other columns play no part. Reruns agree.
    """
    key = F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"), F.coalesce(F.col("source"), F.lit("")))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    base = cut(docs.select("doc_id", "source", key.alias("key"), size.alias("size"), F.xxhash64("text").alias("h")))
    sizes = cut(base.groupBy("key", "size").agg(F.count("*").alias("n")))
    sources = cut(targets(sizes.groupBy("key").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("docs")), weights, share, most))
    solved = dual(sources, sizes.where("size > 0"), most, power)

    full = F.col("target") >= most * F.col("source_size") * (1 - 1e-9)
    x = F.pow(F.col("size") / F.col("mean"), F.lit(power))
    rated = beside(numbered(base, ["doc_id", "key", "h"], PIECE), solved, ["key"], ["doc_id", "h", "nth"]).withColumn("rate", F.when(F.col("source_size") == 0, 1.0).when(full, float(most)).otherwise(rate(F.col("lam"), x, most)))
    piece = F.pmod(F.xxhash64("doc_id", "h", "nth", F.lit(11)), F.ceil(F.col("docs") / PIECE))
    row = F.struct((-F.col("size")).alias("less"), F.xxhash64("doc_id", "h").alias("tie"), "doc_id", "size", "rate", "source")
    listed = rated.groupBy("key", "source_size", "target", piece.alias("piece")).agg(F.sort_array(F.collect_list(row)).alias("rows"))

    def diffuse(state, r):
        want = r["rate"] * r["size"] + state["open"]
        n = F.when(r["size"] == 0, F.round(r["rate"])).otherwise(F.least(F.lit(float(most)), F.greatest(F.lit(0.0), F.round(want / F.greatest(r["size"], F.lit(1))))))
        return F.struct((want - n * r["size"]).alias("open"), F.concat(state["copies"], F.array(n.cast("int"))).alias("copies"))

    start = F.struct(F.lit(0.0).alias("open"), F.array().cast("array<int>").alias("copies"))
    copies = F.aggregate("rows", start, diffuse, lambda s: s["copies"])
    out = listed.withColumn("x", F.explode(F.arrays_zip("rows", copies.alias("copies"))))
    return out.select(
        F.col("x.rows.doc_id").alias("doc_id"), F.col("x.rows.size").alias("size"), "source_size", "target",
        (F.col("x.copies").cast("long") * F.col("x.rows.size")).alias("taken"), F.col("x.rows.source").alias("source"), F.col("x.copies").alias("copies"), F.col("x.rows.rate").alias("rate"),
    )
