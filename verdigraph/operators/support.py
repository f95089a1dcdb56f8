"""Surest supports: for each statement the derivation whose weakest part is strongest."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigraph.operators.hyper import BROADCAST_ROWS, implications, resolved
from verdigraph.sources.scratch import maybe_broadcast, settle


def best_supports(facts: DataFrame, edges: DataFrame, context: dict[str, Any] | None = None, most_rounds: int | None = None) -> DataFrame:
    """(scope, statement, confidence, edge_id, rule_id, authority, rule_text, rule_confidence, premises, path_confidence, round).

    A support is as sure as its rule and its least sure premise, and a
    statement as its surest support: the largest solution of conf(s) =
    max(given, max over edges into s of min(rule, premises)), found from
    below. premises is an array of (premise, confidence) in the rule's order.
    A fact that no rule makes surer is its own support, with null edge_id and
    no premises. Nothing competes or fires here: all supports count.

    Rounds are semi-naive: only edges with a premise that the round before
    made surer are looked at, and only those take a statement that are surer
    than what it had, so supports never go in circles. Confidences are among
    the given ones, so it ends; with most_rounds it raises if that isn't the
    end. Of equal supports the one found first counts, then the first
    inserted. Without facts or rules there are no derived statements.
    """
    rules = settle(implications(edges, context).select("edge_id", "tails", "heads", "rule_id", "authority", "rule_text", F.col("confidence").alias("rc"), "seq"), "rules")
    tails = maybe_broadcast(rules.select("edge_id", F.size(F.array_distinct("tails")).alias("need"), F.explode(F.array_distinct("tails")).alias("key")), BROADCAST_ROWS)
    heads = maybe_broadcast(rules.select("edge_id", "rc", "seq", F.explode(F.array_distinct("heads")).alias("head")), BROADCAST_ROWS)
    given = resolved(facts).select("scope", "key", "confidence", F.lit(None).cast("string").alias("edge_id"), F.lit(0).alias("round"))
    best = settle(given, "best")
    new, n = best, 0
    while True:
        touched = new.select("scope", "key").join(tails, "key").select("scope", "edge_id").distinct()
        met = touched.join(tails, "edge_id").join(best.select("scope", "key", "confidence"), ["scope", "key"])
        met = met.groupBy("scope", "edge_id", "need").agg(F.count("*").alias("have"), F.min("confidence").alias("least")).filter("have = need")
        path = met.join(heads, "edge_id").select("scope", F.col("head").alias("key"), F.least("least", "rc").alias("confidence"), (-F.col("seq")).alias("first"), "edge_id")
        surest = path.groupBy("scope", "key").agg(F.max(F.struct("confidence", "first", "edge_id")).alias("p"))
        had = best.select("scope", "key", F.col("confidence").alias("had"))
        surer = surest.join(had, ["scope", "key"], "left").filter("had IS NULL OR p.confidence > had")
        new = settle(surer.select("scope", "key", "p.confidence", "p.edge_id", F.lit(n + 1).alias("round")), "surer")
        if new.isEmpty():
            break
        n += 1
        if most_rounds is not None and n > most_rounds:
            raise RuntimeError(f"supports have not settled after {most_rounds} rounds")
        best = settle(best.join(new.select("scope", "key"), ["scope", "key"], "left_anti").unionByName(new), "best")
    made = best.filter("edge_id IS NOT NULL")
    each = made.select("scope", F.col("key").alias("statement"), "edge_id").join(maybe_broadcast(rules.select("edge_id", F.posexplode("tails").alias("at", "key")), BROADCAST_ROWS), "edge_id")
    said = each.join(best.select("scope", "key", "confidence"), ["scope", "key"]).groupBy("scope", "statement").agg(F.array_sort(F.collect_list(F.struct("at", F.col("key").alias("premise"), "confidence"))).alias("p"))
    premises = F.transform(F.coalesce("p", F.array().cast("array<struct<at:int,premise:string,confidence:double>>")), lambda x: F.struct(x["premise"].alias("premise"), x["confidence"].alias("confidence")))
    shape = maybe_broadcast(rules.select("edge_id", "rule_id", "authority", "rule_text", F.col("rc").alias("rule_confidence")), BROADCAST_ROWS)
    out = best.withColumnRenamed("key", "statement").join(shape, "edge_id", "left").join(said, ["scope", "statement"], "left").withColumn("premises", premises)
    weakest = F.least("rule_confidence", F.array_min(F.transform("premises", lambda x: x["confidence"])))
    return out.select("scope", "statement", "confidence", "edge_id", "rule_id", "authority", "rule_text", "rule_confidence", "premises", F.coalesce(weakest, "confidence").alias("path_confidence"), "round")


def support_tree(supports: DataFrame, asked: DataFrame) -> DataFrame:
    """(scope, asked, statement, edge_id, depth): all statements that the surest support of each asked (scope, statement) rests on, level by level."""
    steps = settle(supports.select("scope", "statement", F.explode("premises.premise").alias("premise")).distinct(), "steps")
    front = settle(asked.select("scope", F.col("statement").alias("asked"), "statement", F.lit(0).alias("depth")).distinct(), "tree")
    seen = front
    while not front.isEmpty():
        more = front.join(steps, ["scope", "statement"]).select("scope", "asked", F.col("premise").alias("statement"), (F.col("depth") + 1).alias("depth")).distinct()
        front = settle(more.join(seen.select("scope", "asked", "statement"), ["scope", "asked", "statement"], "left_anti"), "tree")
        seen = seen.unionByName(front)
    return seen.join(supports.select("scope", "statement", "edge_id"), ["scope", "statement"]).select("scope", "asked", "statement", "edge_id", "depth")
