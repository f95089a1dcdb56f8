"""Mixing sources to target weights by entropy balancing, in DataFrame operations alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from verdigraph.llm.common import fresh, own_columns, settle, small_enough, word_count

#: No document is taken more often.
MOST = 2
WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPAIRS = 3
#: Rates are whole numbers of this part of a copy, and sums are taken over whole numbers, so the order of adding can't show.
RATE_UNIT = 1_000_000
#: Cells that are broadcast at most, and the salts of the join beyond that.
BROADCAST_CELLS, BROADCAST_SOURCES, SALTS = 500_000, 200_000, 64


def _ranked(sources: DataFrame) -> DataFrame:
    """sources (one row each) with their rank from 0 by code point, null last: ranges of the order, ranked and offset."""
    parts = sources.repartitionByRange(F.col("source").asc_nulls_last())
    parts = settle(parts.withColumn("part", F.spark_partition_id()), "ranges")
    own = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each partition
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    local = parts.withColumn("local", F.row_number().over(own) - 1).join(before, "part")
    return local.select("source", "source_size", (F.col("local") + F.col("offset")).alias("rank"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources by code point, null last, weigh weights in turn. They share
    `share` of all sizes by weight; a target stops at `most` times its
    source's size, and what is over goes to the rest by weight until no
    target is above. Each pass of that is one global sum; two numbers reach
    the driver.
    """
    ranked = _ranked(sizes)
    turn = F.array(*[F.lit(float(w)) for w in weights])
    at = settle(ranked.select("source", "source_size", turn[F.pmod(F.col("rank"), F.lit(len(weights))).cast("int")].alias("weight"), (F.col("source_size") * float(most)).alias("cap")), "weights")
    total = at.agg(F.sum("source_size")).first()[0] or 0
    level, left = None, None
    while True:
        capped = F.lit(False) if level is None else F.col("weight") * level > F.col("cap")
        fixed, free, n = at.agg(F.sum(F.when(capped, F.col("cap")).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))), F.count_if(capped)).first()
        if n == left or not free:
            break
        level, left = max(0.0, share * total - fixed) / free, n
    goal = F.least("cap", F.col("weight") * (level or 0.0))
    return at.select("source", "source_size", goal.alias("target"))


def _rate(size: Column, tilt: Column, unit: Column, most: float) -> Column:
    """Expected copies of a document: exp(tilt * size), the exponential tilt of one copy each, and most at most."""
    return F.least(F.lit(float(most)), F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), tilt * size / unit))))


def _exact_sum(x: Column) -> Column:
    """Sum of doubles to six digits, the same in any order."""
    return F.sum(x.cast("decimal(28,6)")).cast("double")


def tilts(histogram: DataFrame, goals: DataFrame, most: float = MOST, tolerance: float = 1e-6, rounds: int = 200) -> DataFrame:
    """(source, unit, tilt): the dual solution of entropy balancing, one multiplier for each source's token constraint.

    Rates r minimise sum(r log r - r), the relative entropy to one copy each,
    under sum(r * size) = target and r <= most; so r = min(most, exp(tilt *
    size / unit)), where unit is the mean size. The dual is convex and
    one-dimensional for each source; each round is a safeguarded Newton step
    for all sources at once over the (source, size) histogram: a step that
    leaves the bracket is replaced by its middle, or by doubling while there
    is no bracket. A source at its cap has an infinite tilt, given as null.
    """
    unit = histogram.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum(F.col("n"))).alias("unit"))
    free = goals.filter((F.col("target") < F.col("source_size") * float(most)) & (F.col("source_size") > 0))
    state = free.join(unit, free["source"].eqNullSafe(unit["source"])).select(free["source"], "target", "unit", F.lit(0.0).alias("tilt"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(False).alias("done"))
    state = settle(state, "tilts")
    body = histogram.filter("size > 0")
    for _ in range(rounds):
        now = state.filter("NOT done").select(F.col("source").alias("s"), "tilt", "unit")
        met = body.join(now, body["source"].eqNullSafe(now["s"]))
        rate = _rate(F.col("size"), F.col("tilt"), F.col("unit"), most)
        mass = F.col("size") * F.col("n")
        grows = F.when(rate < most, mass * rate * F.col("size") / F.col("unit")).otherwise(F.lit(0.0))
        sums = met.groupBy("source").agg(_exact_sum(mass * rate).alias("got"), _exact_sum(grows).alias("slope"))
        both = state.join(sums.withColumnRenamed("source", "s"), state["source"].eqNullSafe(F.col("s")), "left")
        over = F.col("got") - F.col("target")
        low = F.when(over < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(over >= 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - F.try_divide(over, F.col("slope"))
        inside = newton.isNotNull() & (F.col("l").isNull() | (newton > F.col("l"))) & (F.col("h").isNull() | (newton < F.col("h"))) & (F.abs(newton) < 2 * F.abs(F.col("tilt")) + 4)
        fallback = F.when(F.col("l").isNull(), F.col("tilt") * 2 - 1).when(F.col("h").isNull(), F.col("tilt") * 2 + 1).otherwise((F.col("l") + F.col("h")) / 2)
        stop = F.abs(over) <= F.lit(tolerance) * F.col("target") + 1e-5
        stepped = both.withColumn("l", low).withColumn("h", high).select(
            "source", "target", "unit",
            F.when(F.col("done") | stop, F.col("tilt")).when(inside, newton).otherwise(fallback).alias("tilt"),
            F.when(F.col("done"), F.col("low")).otherwise(F.col("l")).alias("low"),
            F.when(F.col("done"), F.col("high")).otherwise(F.col("h")).alias("high"),
            (F.col("done") | F.coalesce(stop, F.lit(True))).alias("done"),
        )
        left = Observation()
        state = settle(stepped.observe(left, F.count_if(~F.col("done")).alias("n")), "tilts")
        if not left.get["n"]:
            break
    else:
        raise RuntimeError(f"tilts of {left.get['n']} sources not found after {rounds} rounds")
    return state.select("source", "unit", "tilt")


def _running(cells: DataFrame, value: Column, name: str, few: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """cells (source, part, size, slice and more) with the sum of value over the cells before, by source in the order of size (largest first) and slice.

    Parts are ranges of that order, so sums are taken in a part and over the
    sums of the parts before (as many as there are parts and sources); no
    task has to hold a source. few broadcasts tables of that size, if it can.
    """
    order = [F.desc("size"), "slice"]
    local = Window.partitionBy("source", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("vs").orderBy("vp").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each part
    sums = cells.groupBy(F.col("source").alias("vs"), F.col("part").alias("vp")).agg(F.sum(value).alias("v"))
    before = sums.select("vs", "vp", F.coalesce(F.sum("v").over(earlier), F.lit(0)).alias("offset"))
    within = cells.withColumn("inside", F.coalesce(F.sum(value).over(local), F.lit(0)))
    met = within.join(few(before), within["source"].eqNullSafe(F.col("vs")) & (within["part"] == F.col("vp")))
    return met.withColumn(name, F.col("inside") + F.col("offset")).drop("vs", "vp", "inside", "offset")


def _as_it_is(df: DataFrame) -> DataFrame:
    return df


def _sliced(sized: DataFrame, cut: DataFrame) -> DataFrame:
    """sized with its slice: rows of cells in cut (cs, cz, slices) are dealt by hash, all others are slice 0."""
    if small_enough(cut, BROADCAST_CELLS):
        met = sized.join(F.broadcast(cut), sized["source"].eqNullSafe(F.col("cs")) & (sized["size"] == F.col("cz")), "left")
    else:
        # The rows of a cell, which may be very many, are dealt to SALTS copies of its row.
        spread = cut.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = sized.join(spread, sized["source"].eqNullSafe(F.col("cs")) & (sized["size"] == F.col("cz")) & (F.pmod(F.xxhash64("h"), F.lit(SALTS)) == F.col("salt")), "left").drop("salt")
    return met.withColumn("slice", F.coalesce(F.pmod(F.col("h"), F.col("slices")), F.lit(0)).cast("int")).drop("cs", "cz", "slices")


def plan(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, cell_rows: int = 512) -> tuple[DataFrame, DataFrame]:
    """(cut, cells): which (source, size) are sliced, and how many copies the documents of each (source, size, slice) get.

    Cells have source_size, target, n documents, `whole` copies of each and
    an `extra` copy of so many. Rates are rounded by systematic selection
    along each source's order of size: the running sum of the rates over the
    cells gives each a whole number of copies. What a source's words then
    miss of its target, about one document, is made up in REPAIRS rounds: the
    largest cells that are no larger than the gap give or take copies until
    the next one would be too many. Cells with more than cell_rows documents
    (copies of one text, say) are sliced by hash.
    """
    counted = settle(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "histogram")
    totals = settle(counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size")), "sizes")
    goals = settle(targets(totals, weights, share, most), "targets")
    tilt = tilts(counted, goals, most)
    g = goals.join(tilt.withColumnRenamed("source", "s"), goals["source"].eqNullSafe(F.col("s")), "left").drop("s")
    g = settle(g.select(F.col("source").alias("gs"), "source_size", "target", "unit", "tilt"), "goals")
    cut = settle(counted.select(F.col("source").alias("cs"), F.col("size").alias("cz"), F.ceil(F.col("n") / cell_rows).cast("int").alias("slices")).filter("slices > 1"), "slices")
    cells = _sliced(sized.select("source", "size", "h"), cut).groupBy("source", "size", "slice").agg(F.count("*").alias("n"))
    rate = F.when(F.col("tilt").isNull(), F.when(F.col("target") > 0, F.lit(float(most))).otherwise(F.lit(1.0))).otherwise(_rate(F.col("size"), F.col("tilt"), F.col("unit"), most))
    few = F.broadcast if small_enough(g, BROADCAST_SOURCES) else _as_it_is
    rated = cells.join(few(g), cells["source"].eqNullSafe(F.col("gs"))).select("source", "size", "slice", "n", F.round(rate * RATE_UNIT).cast("long").alias("rate"))
    parts = settle(rated.repartitionByRange(F.col("source"), F.desc("size"), F.col("slice")).withColumn("part", F.spark_partition_id()), "cells")
    upto = _running(parts, F.col("rate") * F.col("n"), "upto", few).withColumn("k", F.floor((F.col("upto") + F.col("rate") * F.col("n")) / RATE_UNIT + 0.5) - F.floor(F.col("upto") / RATE_UNIT + 0.5))
    # Rounding may ask one copy too many of a small cell.
    now = settle(upto.select("source", "size", "slice", "part", "n", F.greatest(F.lit(0), F.least(F.col("k"), F.col("n") * most)).cast("long").alias("k")), "rounded")
    for _ in range(REPAIRS):
        got = now.groupBy("source").agg(F.sum(F.col("k") * F.col("size")).alias("got"))
        gap = got.join(few(g), got["source"].eqNullSafe(F.col("gs"))).select("gs", (F.col("target") - F.col("got")).alias("gap"))
        met = now.join(few(gap), now["source"].eqNullSafe(F.col("gs"))).drop("gs")
        room = F.when(F.col("gap") > 0, F.col("n") * most - F.col("k")).otherwise(F.col("k"))
        met = met.withColumn("room", F.when((F.col("size") > 0) & (F.col("size") <= F.abs("gap")), room).otherwise(F.lit(0)))
        met = _running(met, F.col("room") * F.col("size"), "before", few)
        moved = F.least(F.col("room"), F.floor(F.try_divide(F.abs("gap") - F.col("before"), F.col("size"))))
        k = F.when(F.col("room") > 0, F.col("k") + F.signum("gap").cast("int") * F.greatest(F.lit(0), moved)).otherwise(F.col("k"))
        now = settle(met.select("source", "size", "slice", "part", "n", k.cast("long").alias("k")), "repaired")
    told = now.join(few(g), now["source"].eqNullSafe(F.col("gs")))
    return cut, settle(told.select("source", "size", "slice", "n", "source_size", "target", F.floor(F.col("k") / F.col("n")).cast("int").alias("whole"), (F.col("k") % F.col("n")).alias("extra")), "plan")


def _planned(sized: DataFrame, cut: DataFrame, cells: DataFrame) -> DataFrame:
    """sized with its cell's plan and the row's turn in it, by hash. A cell has few rows, but for repeated ones."""
    rows = _sliced(sized, cut)
    told = cells.select(F.col("source").alias("ps"), F.col("size").alias("pz"), F.col("slice").alias("pl"), "source_size", "target", "whole", "extra")
    here = rows["source"].eqNullSafe(F.col("ps")) & (rows["size"] == F.col("pz")) & (rows["slice"] == F.col("pl"))
    return rows.join(told, here).drop("ps", "pz", "pl").withColumn("turn", F.row_number().over(Window.partitionBy("source", "size", "slice").orderBy("h")))


def copies(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, cell_rows: int = 512) -> DataFrame:
    """sized (columns source, size, h and any others) with source_size, target and copies.

    h is a hash that tells documents apart; reruns agree as it does. A cell's
    copies (see plan) go to its documents evenly, what is over to the least
    hashes.
    """
    taken = _planned(sized, *plan(sized, weights, share, most, cell_rows)).withColumn("copies", F.col("whole") + (F.col("turn") <= F.col("extra")).cast("int"))
    return taken.select(*sized.columns, "source_size", "target", "copies")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """How many words of each document the mix takes.

    Returns doc_id, size (words of the text, 0 for null), source_size, target
    (of the source), copies (0 to 2) and taken = copies * size, a row for
    each row of docs. Null is a source of its own, the last. Sources without
    words have target 0; their documents are taken once, for no words. Of
    equal rows any may get the extra copy. An empty table gives no rows.
    """
    slim = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("h"))
    out = copies(settle(slim, "sizes"), weights, share)
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """docs, each row as many times as the mix takes it (see mix); all columns as they are, whatever their names.

    A cell's extra copies go to the rows up to a hash, so where the cells are
    few enough to be broadcast no text is shuffled. Beyond that, and where
    that hash is of several equal rows, rows meet their own decisions. Nulls,
    repeated rows and empty tables are as in mix.
    """
    size, h, source = word_count(F.col("text")), F.xxhash64("doc_id", "text"), F.col("source")
    sized = settle(docs.select("source", size.alias("size"), h.alias("h")), "sizes")
    cut, cells = plan(sized, weights, share)
    turned = _planned(sized, cut, cells).select("source", "size", "slice", "whole", "extra", "h", "turn", F.lead("h").over(Window.partitionBy("source", "size", "slice").orderBy("h", "turn")).alias("next"))
    last = settle(turned.filter(F.col("turn") == F.col("extra")).select("source", "size", "slice", F.col("h").alias("upto"), F.coalesce(F.col("next") == F.col("h"), F.lit(False)).alias("tied")), "last")
    names = fresh(docs, "vg_source", "vg_size", "vg_slice", "vg_whole", "vg_upto", "vg_cut_source", "vg_cut_size", "vg_slices", "vg_h", "vg_length", "vg_n", "vg_c", "vg_turn", "vg_times", "vg_copy")
    s_, z_, l_, whole, upto, cs, cz, slices, hash_, length, n_, c_, turn, times, copy = names
    if small_enough(cells, BROADCAST_CELLS) and last.filter("tied").isEmpty():
        met = cells.alias("c").join(last.alias("l"), F.col("c.source").eqNullSafe(F.col("l.source")) & (F.col("c.size") == F.col("l.size")) & (F.col("c.slice") == F.col("l.slice")), "left")
        told = F.broadcast(met.select(F.col("c.source").alias(s_), F.col("c.size").alias(z_), F.col("c.slice").alias(l_), F.col("whole").alias(whole), F.col("upto").alias(upto)))
        keyed = docs.withColumn(length, size).withColumn(hash_, h)
        keyed = keyed.join(F.broadcast(cut.select(F.col("cs").alias(cs), F.col("cz").alias(cz), F.col("slices").alias(slices))), source.eqNullSafe(F.col(cs)) & (F.col(length) == F.col(cz)), "left")
        part = F.coalesce(F.pmod(F.col(hash_), F.col(slices)), F.lit(0)).cast("int")
        out = keyed.join(told, source.eqNullSafe(F.col(s_)) & (F.col(length) == F.col(z_)) & (part == F.col(l_)))
        out = out.withColumn(times, F.col(whole) + F.coalesce(F.col(hash_) <= F.col(upto), F.lit(False)).cast("int"))
    else:
        # Rows with the same id, source and text share their copies, dealt to them by turn.
        took = _planned(sized, cut, cells).withColumn("copies", F.col("whole") + (F.col("turn") <= F.col("extra")).cast("int"))
        per = settle(took.groupBy("source", "h").agg(F.count("*").alias("n"), F.sum("copies").cast("int").alias("c")), "copies")
        per = per.filter("c > 0").select(F.col("source").alias(s_), F.col("h").alias(hash_), F.col("n").alias(n_), F.col("c").alias(c_))
        out = docs.join(per, source.eqNullSafe(F.col(s_)) & (h == F.col(hash_)))
        out = out.withColumn(turn, F.row_number().over(Window.partitionBy(s_, hash_).orderBy(n_)))
        out = out.withColumn(times, (F.floor(F.col(c_) / F.col(n_)) + (F.col(turn) <= F.pmod(F.col(c_), F.col(n_))).cast("int")).cast("int"))
    return out.filter(F.col(times) > 0).withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col(times)))).select(*own_columns(docs))
