"""Firing rules: group assignments by head, test clause thresholds, aggregate clause intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigraph.functions.aggregators import PythonAggregate, aggregator, counted_evidence, matched_weights
from verdigraph.functions.intervals import closed
from verdigraph.functions.thresholds import passes
from verdigraph.operators.ground import Grounding, ground
from verdigraph.plans.rules import Rule, in_order
from verdigraph.sources.graph import Graph
from verdigraph.sources.scratch import settle

STATEMENTS = "label string, arg0 string, arg1 string, l double, u double"
UPDATES = STATEMENTS + ", delta int, ord int, emit int, static boolean, source string"


def _args(rule: Rule) -> list[Column]:
    return [F.col(rule.head[0]).cast("string").alias("arg0"), (F.col(rule.head[1]).cast("string") if rule.kind == "edge" else F.lit(None).cast("string")).alias("arg1")]


def _heads(rule: Rule, found: Grounding) -> DataFrame:
    """Head variables, n (assignments) and s<i> (of those, the ones that satisfy loop clause i)."""
    head = list(dict.fromkeys(rule.head))
    needs_counts = aggregator(rule.aggregate) is not None or any(not t.trivial for t in rule.thresholds) or found.loops
    if not needs_counts:
        rows = found.assignments.select(*head)
        # Each head once: true already if the head names every variable and no assignment repeats.
        once = rows if found.unique and set(head) == set(found.variables) else rows.distinct()
        return once.withColumn("n", F.lit(1))
    rows = found.assignments
    counts = [F.count("*").alias("n")]
    for i, clause in enumerate(found.loops):
        counts.append(F.sum(F.coalesce(F.col(f"loop{i}"), F.lit(0))).alias(f"s{rule.clauses.index(clause)}"))
    return rows.groupBy(*head).agg(*counts)


def derive(rule: Rule, graph: Graph) -> DataFrame | None:
    """(label, arg0, arg1, l, u), one row for each head that the rule fires for; None if it can't fire.

    All assignments of a head satisfy a grounded clause, or none does (its
    bound excludes presence), so thresholds and aggregates are closed forms
    in the number of assignments. A clause that none satisfies but that may
    fail (a threshold like less_equal 0) gives one interval [0, 1].
    """
    rule.validate()
    found = ground(rule, graph)
    if found is None or any(v not in found.variables for v in rule.head):
        return None
    for i, clause in enumerate(found.loops):
        x = clause.variables[0]
        loop = graph.edges.filter((F.col("u") == F.col("v")) & F.array_contains("labels", clause.label)).select(F.col("u").alias(x), F.lit(1).alias(f"loop{i}"))
        found = Grounding(found.assignments.join(loop, x, "left"), found.variables, found.unique, found.loops)
    heads = _heads(rule, found)
    n, counts, intervals = F.col("n"), [], []
    for i, clause in enumerate(rule.clauses):
        looped = clause in found.loops
        satisfied = F.lit(0) if not clause.holds_if_present else F.col(f"s{i}") if looped else n
        spec = rule.threshold(i)
        if looped or not (spec.trivial and clause.holds_if_present):
            heads = heads.filter(passes(spec, satisfied, n, n))
        counts.append(F.greatest(satisfied, F.lit(1)) if clause.holds_if_present else F.lit(1))
        if looped:
            counts[-1] = F.when(satisfied > 0, satisfied).otherwise(1)
        intervals.append((1.0, 1.0) if clause.holds_if_present and clause.kind != "comparison" else (0.0, 1.0))
    aggregate = aggregator(rule.aggregate)
    if isinstance(aggregate, PythonAggregate):
        lows = [F.when(F.col(f"s{i}") > 0, l).otherwise(0.0) if clause in found.loops and clause.holds_if_present else F.lit(l) for i, (clause, (l, _)) in enumerate(zip(rule.clauses, intervals))]
        bound = aggregate.column([(low, F.lit(u), c) for low, (_, u), c in zip(lows, intervals, counts)], matched_weights(rule.weights, len(rule.clauses)))
    elif aggregate is not None:
        evidence = counted_evidence(counts, intervals, matched_weights(rule.weights, len(rule.clauses)))
        if found.loops:
            # An unsatisfied loop clause counts as one [0, 1].
            for i, clause in enumerate(rule.clauses):
                if clause in found.loops and clause.holds_if_present:
                    evidence.lower[i] = F.when(F.col(f"s{i}") > 0, evidence.lower[i]).otherwise(0.0)
        bound = aggregate(evidence)
    else:
        bound = closed(*(rule.head_bound or (1.0, 1.0)))
    fired = heads.select(F.lit(rule.target).alias("label"), *_args(rule), bound.alias("b"))
    return fired.select("label", "arg0", "arg1", F.col("b.l").alias("l"), F.col("b.u").alias("u"))


def updates(rules: list[Rule], graph: Graph) -> DataFrame:
    """What all valid rules schedule at a step: statements with delay, order, source and static flag.

    Edge rules that infer edges also give the inferred label, with the same
    interval. No clause sees what a rule derives, so every step schedules the
    same.
    """
    spark = graph.nodes.sparkSession
    out = spark.createDataFrame([], UPDATES)
    for at, rule in enumerate(in_order(rules)):
        fired = derive(rule, graph)
        if fired is None:
            continue
        labels = _labels_made(rule)
        if len(labels) > 1:
            names = F.array(*[F.struct(F.lit(i).alias("emit"), F.lit(x).alias("name")) for i, x in enumerate(labels)])
            fired = fired.withColumn("as", F.explode(names)).withColumn("label", F.col("as.name"))
            emit = F.col("as.emit")
        else:
            emit = F.lit(0)
        out = out.unionByName(fired.select("label", "arg0", "arg1", "l", "u", F.lit(rule.delta).alias("delta"), F.lit(at).alias("ord"), emit.alias("emit"), F.lit(rule.static).alias("static"), F.lit(rule.id).alias("source")))
    return out


def _labels_read(rule: Rule, kind: str) -> set[str]:
    return {c.label for c in rule.clauses if c.kind == kind and c.well_formed}


def _labels_made(rule: Rule) -> list[str]:
    return [rule.target] + ([rule.infer_label.strip()] if rule.kind == "edge" and rule.infer_edges and rule.infer_label.strip() else [])


def _within(table: DataFrame, keys: list[str], labels: set[str]) -> DataFrame:
    """Rows of a graph table (keys, labels) that have any of the labels, with these alone."""
    mine = F.array_intersect("labels", F.array(*map(F.lit, sorted(labels))) if labels else F.array().cast("array<string>"))
    return table.select(*keys, mine.alias("labels")).filter(F.size("labels") > 0)


def _told(base: DataFrame, keys: list[str], known: DataFrame, labels: set[str], new: set[str]) -> DataFrame:
    """_within() with the statements of known (label, arg0, arg1) as labels too; new are the labels that known has."""
    rows = _within(base, keys, labels)
    if not labels & new:
        return rows
    said = known.filter(F.col("label").isin(*labels)).select(*[F.col(f"arg{i}").alias(k) for i, k in enumerate(keys)], F.array("label").alias("labels"))
    flags = [F.bool_or(F.array_contains("labels", k)).alias(f"has{i}") for i, k in enumerate(sorted(labels))]
    merged = rows.unionByName(said).groupBy(*keys).agg(*flags)
    return merged.select(*keys, F.array_compact(F.array(*[F.when(F.col(f"has{i}"), F.lit(k)) for i, k in enumerate(sorted(labels))])).alias("labels"))


def derive_recursively(rules: list[Rule], graph: Graph, most_rounds: int | None = None) -> DataFrame:
    """Statements of the rules when clauses do see derived labels: rounds of derivation until no statement is new.

    The graph's own labels count as present; each statement keeps the
    intersection of what its rules gave in the round that first derived it.
    What rules read of the graph is written once. A round looks only at the
    rules that read a label of the round before: all others would give what
    is known. Of the graph, each rule is shown the labels that it reads.
    Each round is written to the shared folder, so plans don't grow. Rules
    make no new nodes, so it ends; with most_rounds it raises if that is not
    the end.
    """
    from verdigraph.operators.temporal import combine

    ordered, kinds = in_order(rules), (("node", ["id"]), ("edge", ["u", "v"]))
    read = {kind: set().union(*[_labels_read(r, kind) for r in ordered]) for kind, _ in kinds}
    base = {kind: settle(_within(table, keys, read[kind]), "graph") for (kind, keys), table in zip(kinds, (graph.nodes, graph.edges))}
    made = [label for r in ordered for label in _labels_made(r)]
    often = {label for label in made if made.count(label) > 1}
    known, n, new = graph.nodes.sparkSession.createDataFrame([], STATEMENTS), 0, None
    have: dict[str, set[str]] = {kind: set() for kind, _ in kinds}
    while True:
        due = [r for r in ordered if new is None or any(_labels_read(r, kind) & new for kind, _ in kinds)]
        got = None
        for rule in due:
            seen = [_told(base[kind], keys, known.filter(F.col("arg1").isNull() if kind == "node" else F.col("arg1").isNotNull()), _labels_read(rule, kind), have[kind]) for kind, keys in kinds]
            fired = updates([rule], Graph(*seen)).withColumn("ord", F.lit(ordered.index(rule)))
            got = fired if got is None else got.unionByName(fired)
        if got is None:
            return known
        # What just one rule makes, once for each head, needs no combining.
        some = {label for r in due for label in _labels_made(r)}
        single = got.filter(F.col("delta") >= 0).select("label", "arg0", "arg1", "l", "u")
        if some & often:
            single = single.filter(~F.col("label").isin(*often)).unionByName(combine(got.filter(F.col("label").isin(*often))))
        if some & (have["node"] | have["edge"]):
            key = [F.col("g.label") == F.col("k.label"), F.col("g.arg0") == F.col("k.arg0"), F.col("g.arg1").eqNullSafe(F.col("k.arg1"))]
            single = single.alias("g").join(known.filter(F.col("label").isin(*some)).alias("k"), key, "left_anti")
        fresh = settle(single, "derived")
        told = fresh.select("label", F.col("arg1").isNull().alias("node")).distinct().collect()
        if not told:
            return known
        n += 1
        if most_rounds is not None and n > most_rounds:
            raise RuntimeError(f"derivation has not ended after {most_rounds} rounds")
        new = {r["label"] for r in told}
        for r in told:
            have["node" if r["node"] else "edge"].add(r["label"])
        known = known.unionByName(fresh)
