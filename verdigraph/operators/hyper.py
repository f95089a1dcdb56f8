"""Forward chaining over hyperedges (all premises imply the conclusions), with conflicts, confidence and explanations.

Tables:
  facts(scope, id, type, statement, confidence, seq)
  edges(edge_id, relation, tails array<string>, heads array<string>, rule_id, authority, rule_text, priority int,
        confidence, jurisdiction, valid_from timestamp, valid_to timestamp, authority_level, seq)
A scope (document, user, ...) has facts of its own; edges hold in all scopes. seq is the order of insertion.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from datetime import datetime
from itertools import groupby
from operator import itemgetter
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigraph.sources.scratch import maybe_broadcast, settle

FACT_TYPES = ("Fact", "DerivedFact")
FACTS = "scope string, id string, type string, statement string, confidence double, seq long"
DERIVED = "scope string, id string, confidence double, edge_id string, step int"
_DERIVED = ["scope", "id", "confidence", "edge_id", "step"]
#: Rows that a task hands on together.
CHAINED_ROWS = 10_000
LEVELS = {"federal": 3, "state": 2, "local": 1}
TYPE_BOOST = {"constitutional": 1000, "statutory": 500, "regulation": 300, "case_law": 200, "administrative": 100}
LEVEL_BOOST = {"federal": 300, "state": 200, "local": 100}
#: Rows of a policy table (rules, their premises) or of a round's new facts that are broadcast at most.
BROADCAST_ROWS = 200_000
#: Least confidence that a geometric mean counts with.
LEAST_CONFIDENCE = 1e-6


def by_name(table: dict[str, int], key: Column) -> Column:
    out = F.lit(0)
    for k, v in table.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def applicable(jurisdiction: Column, valid_from: Column, valid_to: Column, context: dict[str, Any] | None) -> Column:
    """Whether a rule's own context fits: its jurisdiction is a prefix, and its validity covers the context's.

    Each check is left out where either side is missing.
    """
    context = context or {}
    tests = F.lit(True)
    if context.get("jurisdiction"):
        tests = tests & (F.coalesce(F.lit(context["jurisdiction"]).startswith(jurisdiction), F.lit(True)) | (jurisdiction == ""))
    if context.get("valid_from") is not None:
        tests = tests & F.coalesce(F.lit(context["valid_from"]) >= valid_from, F.lit(True))
    if context.get("valid_to") is not None:
        tests = tests & F.coalesce(F.lit(context["valid_to"]) <= valid_to, F.lit(True))
    return tests


def contexts_apply(rules: DataFrame, contexts: DataFrame) -> DataFrame:
    """Theta join of rules(rule_id, jurisdiction, valid_from, valid_to) and contexts(context_id, ...): pairs that apply.

    Rules are a policy table: as long as they are few enough, this is a
    broadcast nested loop over contexts, whose result is as large as what applies.
    """
    r, c = maybe_broadcast(rules, BROADCAST_ROWS).alias("r"), contexts.alias("c")
    prefix = F.col("c.jurisdiction").startswith(F.col("r.jurisdiction"))
    since = F.col("c.valid_from") >= F.col("r.valid_from")
    until = F.col("c.valid_to") <= F.col("r.valid_to")
    fits = F.coalesce(prefix, F.lit(True)) & F.coalesce(since, F.lit(True)) & F.coalesce(until, F.lit(True))
    return c.join(r, fits).select("r.rule_id", "c.context_id")


def rules_as_edges(rules: DataFrame) -> DataFrame:
    """edges from rules(id, rule_type, priority, authority, premises, conclusions, rule_text, confidence, jurisdiction, ..., seq)."""
    return rules.select(F.col("id").alias("edge_id"), F.lit("implies").alias("relation"), F.col("premises").alias("tails"), F.col("conclusions").alias("heads"), F.col("id").alias("rule_id"), "authority", "rule_text", "priority", "confidence", "jurisdiction", "valid_from", "valid_to", "authority_level", "seq")


def resolved(facts: DataFrame) -> DataFrame:
    """(scope, key, confidence, id): what each premise key stands for.

    A key is a fact's id, or else a statement, whose surest fact counts (the
    first of equals).
    """
    ids = facts.select("scope", F.col("id").alias("key"), F.lit(0).alias("by"), "confidence", "seq", "id")
    said = facts.filter("statement IS NOT NULL").select("scope", F.col("statement").alias("key"), F.lit(1).alias("by"), "confidence", "seq", "id")
    best = F.min(F.struct("by", (-F.col("confidence")).alias("less"), "seq", "id")).alias("b")
    return ids.unionByName(said).groupBy("scope", "key").agg(best).select("scope", "key", (-F.col("b.less")).alias("confidence"), F.col("b.id").alias("id"))


def implications(edges: DataFrame, context: dict[str, Any] | None = None) -> DataFrame:
    return edges.filter("relation = 'implies'").filter(applicable(F.col("jurisdiction"), F.col("valid_from"), F.col("valid_to"), context))


def satisfied(edges: DataFrame, known: DataFrame) -> DataFrame:
    """(scope, edge_id, confs): edges all of whose premises are known in a scope (relational division)."""
    each = edges.select("edge_id", F.size(F.array_distinct("tails")).alias("need"), F.posexplode("tails").alias("at", "key"))
    met = each.join(known, "key").groupBy("scope", "edge_id", "need").agg(F.count_distinct("key").alias("have"), F.array_sort(F.collect_list(F.struct("at", "confidence"))).alias("c"))
    return met.filter("have = need").select("scope", "edge_id", F.transform("c", lambda x: x["confidence"]).alias("confs"))


def missing_premises(edges: DataFrame, facts: DataFrame) -> DataFrame:
    """(scope, edge_id, premise): premises of an edge that a scope doesn't know (left anti join)."""
    scopes = facts.select("scope").distinct()
    need = scopes.crossJoin(maybe_broadcast(edges.select("edge_id", F.explode("tails").alias("premise")).distinct(), BROADCAST_ROWS))
    known = resolved(facts).select("scope", F.col("key").alias("premise"))
    return need.join(known, ["scope", "premise"], "left_anti").select("scope", "edge_id", "premise")


def priority_order() -> list[Column]:
    """Best first: authority level, number of premises, newest validity, priority, and of equals the first inserted."""
    return [by_name(LEVELS, F.col("authority_level")).desc(), F.size("tails").desc(), F.coalesce("valid_from", F.timestamp_seconds(F.lit(0))).desc(), F.coalesce("priority", F.lit(100)).desc(), F.col("seq").asc()]


def conflict_winners(edges: DataFrame, met: DataFrame) -> DataFrame:
    """Rows of met(scope, edge_id, ...) whose edge is the best of the satisfied ones for every one of its heads."""
    shape = edges.select("edge_id", "tails", "heads", "authority_level", "valid_from", "priority", "seq")
    heads = met.select("scope", "edge_id").join(shape, "edge_id").withColumn("head", F.explode("heads"))
    ranked = heads.withColumn("rank", F.row_number().over(Window.partitionBy("scope", "head").orderBy(*priority_order())))
    best = ranked.groupBy("scope", "edge_id").agg(F.max("rank").alias("worst")).filter("worst = 1").select("scope", "edge_id")
    return met.join(best, ["scope", "edge_id"])


def confidence(confs: Column, rule: Column, aggregator: str = "min", alpha: float = 0.8) -> Column:
    """Of a conclusion: the least of premises and rule, or their weighted geometric mean ("wgm")."""
    if aggregator != "wgm":
        return F.least(F.coalesce(F.array_min(confs), rule), rule)
    n = F.size(confs)
    product = F.aggregate(confs, F.lit(1.0), lambda p, c: p * F.greatest(c, F.lit(LEAST_CONFIDENCE)))
    mean = F.pow(F.pow(product, 1.0 / n), F.lit(alpha)) * F.pow(F.greatest(rule, F.lit(LEAST_CONFIDENCE)), F.lit(1 - alpha))
    return F.when(n > 0, mean).otherwise(rule)


def forward_chain_rounds(facts: DataFrame, edges: DataFrame, context: dict[str, Any] | None = None, aggregator: str = "min", alpha: float = 0.8, most_rounds: int | None = None) -> DataFrame:
    """(scope, id, confidence, edge_id, step): facts derived in rounds, all rules of a round at once.

    In each round the satisfied edges compete for their heads; winners add
    the heads that no fact is or states yet. It ends when a round satisfies
    no further edge; with most_rounds it raises if that is not the end.
    Rounds are semi-naive: only edges with a premise that the round before
    added are looked at (a satisfied edge stays so, and one that has lost a
    head to a better edge never wins it later). Differs from
    forward_chain_exact only where a rule that is satisfied later would have
    competed with one that fires before.
    """
    rules = settle(implications(edges, context).select("edge_id", "tails", "heads", "confidence", "authority_level", "valid_from", "priority", "seq"), "rules")
    need = rules.select("edge_id", F.size(F.array_distinct("tails")).alias("need"), F.posexplode("tails").alias("at", "key"))
    tails, heads = maybe_broadcast(need, BROADCAST_ROWS), maybe_broadcast(rules.select("edge_id", "tails", "heads", "authority_level", "valid_from", "priority", "seq", F.explode(F.array_distinct("heads")).alias("head")), BROADCAST_ROWS)
    known = settle(resolved(facts).select("scope", "key", "confidence"), "known")
    stated = facts.filter("type = 'Fact' AND statement IS NOT NULL").select("scope", F.col("statement").alias("id"))
    taken = settle(facts.select("scope", "id").unionByName(stated).distinct(), "taken")
    out = facts.sparkSession.createDataFrame([], DERIVED)
    new, held, step = known, None, 0
    while True:
        touched = new.select("scope", "key").join(tails, "key").select("scope", "edge_id").distinct()
        if held is not None:
            touched = touched.join(held, ["scope", "edge_id"], "left_anti")
        met = touched.join(tails, "edge_id").join(known, ["scope", "key"])
        met = met.groupBy("scope", "edge_id", "need").agg(F.count_distinct("key").alias("have"), F.array_sort(F.collect_list(F.struct("at", "confidence"))).alias("c")).filter("have = need")
        met = settle(met.select("scope", "edge_id", F.transform("c", lambda x: x["confidence"]).alias("confs")), "met")
        if met.isEmpty():
            return out
        step += 1
        if most_rounds is not None and step > most_rounds:
            raise RuntimeError(f"chaining has not ended after {most_rounds} rounds")
        pairs = met.select("scope", "edge_id")
        held = settle(pairs if held is None else held.unionByName(pairs), "held")
        asked = pairs.join(heads, "edge_id").select("scope", "head").distinct()
        rivals = held.join(heads, "edge_id").join(asked, ["scope", "head"], "left_semi")
        ranked = rivals.withColumn("rank", F.row_number().over(Window.partitionBy("scope", "head").orderBy(*priority_order())))
        won = ranked.join(pairs.withColumn("now", F.lit(True)), ["scope", "edge_id"]).groupBy("scope", "edge_id").agg(F.max("rank").alias("worst")).filter("worst = 1").select("scope", "edge_id")
        fired = met.join(won, ["scope", "edge_id"]).join(rules.select("edge_id", "heads", F.col("confidence").alias("rc")), "edge_id")
        fresh = fired.select("scope", "edge_id", F.explode(F.array_distinct("heads")).alias("id"), confidence(F.col("confs"), F.col("rc"), aggregator, alpha).alias("confidence"))
        fresh = settle(fresh.join(taken, ["scope", "id"], "left_anti").select("scope", "id", "confidence", "edge_id", F.lit(step).alias("step")), "fresh")
        if fresh.isEmpty():
            return out
        out = out.unionByName(fresh)
        taken = taken.unionByName(fresh.select("scope", "id"))
        # A fact of its own comes before a statement of another one.
        new = fresh.select("scope", F.col("id").alias("key"), "confidence")
        known = settle(known.join(new.select("scope", "key"), ["scope", "key"], "left_anti").unionByName(new), "known")


def _by_key(rules: list[dict], side: str) -> dict[str, list[dict]]:
    """Rules by each of their tails or heads, in order."""
    out: dict[str, list[dict]] = {}
    for r in rules:
        for k in dict.fromkeys(r[side]):
            out.setdefault(k, []).append(r)
    return out


def _chain(facts: list[tuple], using: dict[str, list[dict]], making: dict[str, list[dict]], aggregator: str, alpha: float) -> list[tuple]:
    """Agenda chaining of one scope by rules under their tails and heads, in first-in first-out order; it ends, as each head is added once."""
    nodes = {i: {"statement": s, "confidence": c, "type": t} for i, t, s, c in facts}
    # What a statement is good for, whoever says it: its surest confidence, and whether a fact says it.
    surest: dict[str, float] = {}
    said: set[str] = set()
    for n in nodes.values():
        if n["statement"] is not None:
            surest[n["statement"]] = max(n["confidence"], surest.get(n["statement"], n["confidence"]))
            if n["type"] == "Fact":
                said.add(n["statement"])

    def premise(key: str) -> float | None:
        if key in nodes:
            return nodes[key]["confidence"]
        return surest.get(key)

    def ready(r: dict) -> bool:
        return all(premise(k) is not None for k in r["tails"])

    out, fired = [], set()
    agenda = deque(i for kind in FACT_TYPES for i, n in nodes.items() if n["type"] == kind)
    while agenda:
        at = agenda.popleft()
        for key in dict.fromkeys([at, nodes[at]["statement"]]):
            for r in using.get(key, ()):
                if r["edge_id"] in fired or not ready(r):
                    continue
                # max() keeps the first of equals, and rules come in order of insertion.
                if any(max(filter(ready, making[h]), key=lambda x: x["rank"])["edge_id"] != r["edge_id"] for h in r["heads"]):
                    continue
                confs = [premise(k) for k in r["tails"]]
                if aggregator == "wgm" and confs:
                    product = 1.0
                    for c in confs:
                        product *= max(c, LEAST_CONFIDENCE)
                    got = (product ** (1 / len(confs))) ** alpha * max(r["confidence"], LEAST_CONFIDENCE) ** (1 - alpha)
                else:
                    got = min([*confs, r["confidence"]])
                for h in r["heads"]:
                    if h in nodes or h in said:
                        continue
                    nodes[h] = {"statement": h, "confidence": got, "type": "Fact"}
                    said.add(h)
                    out.append((h, got, r["edge_id"], len(out) + 1))
                    agenda.append(h)
                fired.add(r["edge_id"])
    return out


def _relevant(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """Facts that a rule's premise or conclusion names by id or statement; no other can have a part in anything.

    Of facts with one id in a scope the last counts, in the place of the first.
    """
    last = F.max_by(F.struct("type", "statement", "confidence"), "seq").alias("f")
    once = facts.groupBy("scope", "id").agg(last, F.min("seq").alias("seq")).select("scope", "id", "f.*", "seq")
    keys = maybe_broadcast(rules.select(F.explode(F.array_union("tails", "heads")).alias("key"), F.lit(True).alias("named")).distinct(), BROADCAST_ROWS)
    by_id, by_statement = (keys.select(F.col("key").alias(k), F.col("named").alias(f"by_{k}")) for k in ("id", "statement"))
    return once.join(by_id, "id", "left").join(by_statement, "statement", "left").filter("by_id OR by_statement").select("scope", "id", "type", "statement", "confidence", "seq")


def _agenda(facts: DataFrame, rules: DataFrame, aggregator: str, alpha: float) -> DataFrame:
    """forward_chain_exact by rounds: in each, every scope fires the next rule of its agenda; a scope is no group.

    What happens until then changes nothing: a rule that is not ready, or
    doesn't win, is passed over. So the next to fire is the first event after
    the last one (a fact's place in the queue, its id before its statement,
    rules in order) of those that are ready and win now. Readiness and rank
    are settled for each scope and rule, and the events are a minimum over
    facts, summed in parts before it is shuffled.
    """
    tails = rules.select("edge_id", F.size(F.array_distinct("tails")).alias("need"), F.posexplode("tails").alias("at", "key"))
    uses = rules.select("edge_id", F.struct("seq", "edge_id").alias("turn"), F.explode(F.array_distinct("tails")).alias("key"))
    tails, uses, shape = (maybe_broadcast(t, BROADCAST_ROWS) for t in (tails, uses, rules))
    asked = rules.select(F.explode("tails").alias("key")).distinct()
    known = settle(resolved(facts).select("scope", "key", "confidence").join(maybe_broadcast(asked, BROADCAST_ROWS), "key", "left_semi"), "known")
    stated = facts.filter("type = 'Fact' AND statement IS NOT NULL").select("scope", F.col("statement").alias("id"))
    taken = facts.select("scope", "id").unionByName(stated).distinct()
    kind = F.array_position(F.array(*map(F.lit, FACT_TYPES)), F.col("type")).cast("long")
    queue = facts.filter(F.col("type").isin(*FACT_TYPES)).select("scope", F.struct(kind.alias("kind"), "seq", "id").alias("place"), "id", "statement")
    by_id = queue.select("scope", "place", F.lit(0).alias("by"), F.col("id").alias("key"))
    places = settle(by_id.unionByName(queue.filter("statement IS NOT NULL AND statement <> id").select("scope", "place", F.lit(1).alias("by"), F.col("statement").alias("key"))), "places")
    # Rules without premises never fire, but are rivals at any time.
    free = facts.select("scope").distinct().join(rules.filter("size(tails) = 0").select("edge_id", F.array().cast("array<double>").alias("confs")), F.lit(True))
    made, fired = None, None
    out = facts.sparkSession.createDataFrame([], DERIVED)
    while True:
        now, at = known, places
        if made is not None:
            fresh = made.select("scope", F.col("id").alias("key"), "confidence")
            now = known.join(fresh.select("scope", "key"), ["scope", "key"], "left_anti").unionByName(fresh)
            place = F.struct(F.lit(len(FACT_TYPES) + 1).cast("long").alias("kind"), F.col("step").cast("long").alias("seq"), "id").alias("place")
            at = places.unionByName(made.select("scope", place, F.lit(0).alias("by"), F.col("id").alias("key")))
        met = now.join(tails, "key").groupBy("scope", "edge_id", "need").agg(F.count_distinct("key").alias("have"), F.array_sort(F.collect_list(F.struct("at", "confidence"))).alias("c")).filter("have = need")
        ready = settle(met.select("scope", "edge_id", F.transform("c", lambda x: x["confidence"]).alias("confs")).unionByName(free), "ready")
        able = conflict_winners(rules, ready)
        if fired is not None:
            able = able.join(fired.select("scope", "edge_id"), ["scope", "edge_id"], "left_anti")
        able = settle(able, "able")
        events = at.join(maybe_broadcast(able.select("scope", "edge_id").join(uses, "edge_id"), BROADCAST_ROWS), ["scope", "key"]).select("scope", F.struct("place", "by", "turn").alias("event"))
        if fired is not None:
            last = fired.groupBy("scope").agg(F.max("event").alias("last"))
            events = events.join(maybe_broadcast(last, BROADCAST_ROWS), "scope", "left").filter("last IS NULL OR event > last")
        new = settle(events.groupBy("scope").agg(F.min("event").alias("event")).select("scope", F.col("event.turn.edge_id").alias("edge_id"), "event"), "fired")
        if new.isEmpty():
            return out
        fired = new if fired is None else settle(fired.unionByName(new), "fired")
        told = new.select("scope", "edge_id").join(able, ["scope", "edge_id"]).join(shape.select("edge_id", "heads", F.col("confidence").alias("rc")), "edge_id")
        told = told.select("scope", "edge_id", F.posexplode(F.array_distinct("heads")).alias("n", "id"), confidence(F.col("confs"), F.col("rc"), aggregator, alpha).alias("confidence")).join(taken, ["scope", "id"], "left_anti")
        if made is not None:
            done = made.groupBy("scope").agg(F.max("step").alias("done"))
            told = told.join(made.select("scope", "id"), ["scope", "id"], "left_anti").join(done, "scope", "left")
        else:
            told = told.withColumn("done", F.lit(0))
        step = (F.coalesce("done", F.lit(0)) + F.row_number().over(Window.partitionBy("scope").orderBy("n"))).cast("int").alias("step")
        told = settle(told.select("scope", "id", "confidence", "edge_id", step), "made")
        made = told if made is None else settle(made.unionByName(told), "made")
        out = made.select("scope", "id", "confidence", "edge_id", "step")


def forward_chain_exact(facts: DataFrame, edges: DataFrame, context: dict[str, Any] | None = None, aggregator: str = "min", alpha: float = 0.8, group_rows: int = 100_000) -> DataFrame:
    """(scope, id, confidence, edge_id, step): facts derived by an agenda, first in first out, scope by scope.

    A rule fires once, if it wins every head against the rules satisfied at
    that moment; losers may try again. Facts that no rule names are left out
    first. A scope with more than group_rows of the others is chained in
    rounds, one for each rule that fires, in which nothing of the scope is
    ever together (_agenda); all other scopes are gone through one after the
    other, each once, in a partition sorted by scope, and the rules, a policy
    table, go with the function. Both give the same.
    """
    columns = ["edge_id", "tails", "heads", "confidence", "authority_level", "valid_from", "priority", "seq"]
    held = settle(implications(edges, context).select(*columns), "rules")
    facts = settle(_relevant(facts, held), "facts")
    large = settle(facts.groupBy("scope").agg(F.count("*").alias("n")).filter(F.col("n") > group_rows).select("scope"), "large")
    rules = []
    for r in held.orderBy("seq", "edge_id").collect():
        since = r["valid_from"].timestamp() if isinstance(r["valid_from"], datetime) else 0.0
        rank = (LEVELS.get(r["authority_level"], 0), len(r["tails"]), since, 100 if r["priority"] is None else r["priority"])
        rules.append({"edge_id": r["edge_id"], "tails": list(r["tails"]), "heads": list(r["heads"]), "confidence": r["confidence"], "rank": rank})

    using, making = _by_key(rules, "tails"), _by_key(rules, "heads")

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(b[c] for c in ("scope", "id", "type", "statement", "confidence")))

    def per_scope(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A scope's rows follow one another; many scopes are a batch, as a frame for each of them would cost more than its chaining.
        rows: list[tuple] = []
        for scope, given in groupby(told(batches), key=itemgetter(0)):
            facts = [(i, t, s if isinstance(s, str) else None, c) for _, i, t, s, c in given]
            rows += [(scope, *r) for r in _chain(facts, using, making, aggregator, alpha)]
            if len(rows) >= CHAINED_ROWS:
                yield pd.DataFrame(rows, columns=_DERIVED)
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=_DERIVED)

    def by_scope(facts: DataFrame) -> DataFrame:
        ordered = facts.repartition("scope").sortWithinPartitions("scope", F.asc_nulls_last("seq"), F.asc_nulls_last("id"))
        return ordered.select("scope", "id", "type", "statement", "confidence").mapInPandas(per_scope, DERIVED)

    if large.isEmpty():
        return by_scope(facts)
    apart = maybe_broadcast(large, BROADCAST_ROWS)
    small = by_scope(facts.join(apart, "scope", "left_anti"))
    return small.unionByName(_agenda(settle(facts.join(apart, "scope", "left_semi"), "facts"), held, aggregator, alpha))


def traces(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """(head, edge_id, premise, depth): every premise behind each edge into a head of asked(head), with its least depth.

    Breadth first over the rule table alone, a level a round, until a level
    finds nothing new: no scope, no path is ever listed. Steps lead from a
    premise to those of all edges that make it, never back to the head.
    """
    into = edges.select("edge_id", F.explode(F.array_distinct("heads")).alias("head"), "tails")
    steps = settle(into.select("head", F.explode("tails").alias("premise")).distinct(), "steps")
    front = settle(into.join(asked.select("head").distinct(), "head", "left_semi").select("head", "edge_id", F.explode("tails").alias("premise")).distinct().withColumn("depth", F.lit(1)), "trace")
    seen = front
    while not front.isEmpty():
        more = front.join(steps.select(F.col("head").alias("premise"), F.col("premise").alias("next")), "premise").filter(F.col("next") != F.col("head"))
        more = more.select("head", "edge_id", F.col("next").alias("premise"), (F.col("depth") + 1).alias("depth")).distinct()
        front = settle(more.join(seen.select("head", "edge_id", "premise"), ["head", "edge_id", "premise"], "left_anti"), "trace")
        seen = seen.unionByName(front)
    return seen


def explain(facts: DataFrame, edges: DataFrame, conclusions: DataFrame) -> DataFrame:
    """(scope, conclusion, edge_id, premise, confidence, depth, leaf, premise_id, type, statement, critical): every known premise behind each support of the conclusions.

    facts include derived ones. From each edge into a conclusion (scope, id)
    the premises are traced back, edge by edge, to facts that no edge makes
    (leaf). The immediate premises are at depth 1; such a one is critical if
    it is the only premise of the only edge into the conclusion. premise_id,
    type and statement are those of the fact that the premise stands for.
    """
    asked = conclusions.select("scope", F.col("id").alias("conclusion")).distinct()
    into = edges.select("edge_id", F.size("tails").alias("need"), F.explode(F.array_distinct("heads")).alias("head"))
    sole = into.groupBy("head").agg(F.count("*").alias("n"), F.max("need").alias("need")).select("head", ((F.col("n") == 1) & (F.col("need") == 1)).alias("sole"))
    traced = traces(edges, asked.select(F.col("conclusion").alias("head"))).join(sole, "head")
    made = sole.select(F.col("head").alias("premise"), F.lit(False).alias("leaf"))
    traced = maybe_broadcast(settle(traced.join(made, "premise", "left").select(F.col("head").alias("conclusion"), "edge_id", "premise", "depth", F.coalesce("leaf", F.lit(True)).alias("leaf"), (F.col("sole") & (F.col("depth") == 1)).alias("critical")), "traced"), BROADCAST_ROWS)
    known = resolved(facts).select("scope", F.col("key").alias("premise"), "confidence", F.col("id").alias("premise_id"))
    told = facts.groupBy("scope", F.col("id").alias("premise_id")).agg(F.min_by(F.struct("type", "statement"), "seq").alias("f"))
    met = asked.join(traced, "conclusion").join(known, ["scope", "premise"]).join(told, ["scope", "premise_id"])
    return met.select("scope", "conclusion", "edge_id", "premise", "confidence", "depth", "leaf", "premise_id", "f.type", "f.statement", "critical")


def explanations(traced: DataFrame, edges: DataFrame) -> DataFrame:
    """(scope, conclusion, edge_id, rule_id, authority, rule_text, relation, path_confidence, confidence) from explain(): the least along each support, and overall."""
    shown = traced.filter("depth = 1 OR leaf").groupBy("scope", "conclusion", "edge_id").agg(F.min("confidence").alias("c"))
    met = shown.join(edges.select("edge_id", "rule_id", "authority", "rule_text", "relation", F.col("confidence").alias("rc")), "edge_id")
    path = met.withColumn("path_confidence", F.least("c", "rc"))
    overall = F.min("path_confidence").over(Window.partitionBy("scope", "conclusion"))
    return path.select("scope", "conclusion", "edge_id", "rule_id", "authority", "rule_text", "relation", "path_confidence", overall.alias("confidence"))


def priority_score(rule_type: Column, priority: Column, authority_level: Column, conf: Column) -> Column:
    return (priority + by_name(TYPE_BOOST, rule_type) + by_name(LEVEL_BOOST, authority_level)) * conf


def resolve_conflicts(rules: DataFrame) -> DataFrame:
    """(conclusion, rule_id): the rule that stands for each conclusion.

    rules(id, rule_type, priority, premises, conclusions, confidence,
    authority_level, valid_from, seq). In turn: the first rule of the highest
    authority level; the only rule with most premises; the newest; the one
    with the highest score; always the first of equals. Where no conclusion
    has two rules, all rules are taken for rivals and one stands for all:
    a single row, whose conclusion is null.
    """
    each = rules.withColumn("conclusion", F.explode(F.array_distinct("conclusions")))
    if each.groupBy("conclusion").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        each = rules.withColumn("conclusion", F.lit(None).cast("string"))
    per, n = Window.partitionBy("conclusion"), F.size("premises")
    level = by_name(LEVELS, F.col("authority_level"))
    most = F.max(n).over(per)
    alone = F.sum((n == F.col("most")).cast("int")).over(per) == 1
    told = each.withColumn("level", level).withColumn("top", F.max("level").over(per)).withColumn("most", most).withColumn("alone", alone).withColumn("newest", F.max("valid_from").over(per))
    score = priority_score(F.col("rule_type"), F.col("priority"), F.col("authority_level"), F.col("confidence"))
    preferred = (
        F.when(F.col("top") > 0, F.col("level").cast("double"))
        .when(F.col("alone"), (n == F.col("most")).cast("double"))
        .when(F.col("newest").isNotNull(), F.coalesce((F.col("valid_from") == F.col("newest")).cast("double"), F.lit(0.0)))
        .otherwise(score)
    )
    order = Window.partitionBy("conclusion").orderBy(F.desc("preferred"), F.asc("seq"))
    return told.withColumn("preferred", preferred).withColumn("rn", F.row_number().over(order)).filter("rn = 1").select("conclusion", F.col("id").alias("rule_id"))
