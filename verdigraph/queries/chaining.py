"""Queries over forward chaining, conflicts, confidence and explanations: facts of users, rules of a table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigraph.operators.hyper import confidence, conflict_winners, contexts_apply, explain, explanations, forward_chain_exact, forward_chain_rounds, implications, missing_premises, priority_score, resolve_conflicts, resolved, rules_as_edges, satisfied
from verdigraph.operators.support import best_supports
from verdigraph.plugins import RULES
from verdigraph.queries.tables import SQL_FACTS, event_facts, read

Q: dict = {}
SQL: dict[str, str] = {}

#: id, rule_type, priority, premises, conclusions, confidence, jurisdiction, valid_from (year), authority_level
_RULES = [
    ("r1", "statutory", 100, ["click", "purchase"], ["engaged"], 0.9, "US", 2001, "federal"),
    ("r2", "case_law", 120, ["click"], ["engaged"], 0.8, "US", 2005, "state"),
    ("r3", "regulation", 100, ["view", "click"], ["curious"], 0.7, "US-CA", 2003, None),
    ("r4", "regulation", 100, ["view", "signup"], ["curious"], 0.6, "US-CA", 2003, None),
    ("r5", "statutory", 100, ["engaged", "curious"], ["loyal"], 0.95, "US", None, "local"),
    ("r6", "administrative", 200, ["error"], ["troubled"], 0.5, None, 2010, None),
    ("r7", "constitutional", 100, ["troubled", "loyal"], ["kept", "valued"], 1.0, "US", None, "federal"),
    ("r8", "case_law", 150, ["signup"], ["valued"], 0.4, "UK", 2001, "state"),
    ("r9", "case_law", 90, ["troubled"], ["kept"], 0.85, "US", 2015, "state"),
]


def rules(spark: SparkSession) -> DataFrame:
    rows = [(i, kind, p, f"Act {i}", pre, con, f"text of {i}", c, j, datetime(y, 1, 1) if y else None, None, a, n) for n, (i, kind, p, pre, con, c, j, y, a) in enumerate(_RULES)]
    return spark.createDataFrame(rows, RULES)


def edges(spark: SparkSession) -> DataFrame:
    return rules_as_edges(rules(spark))


_KINDS = ["constitutional", "statutory", "regulation", "case_law", "administrative"]
_PLACES = ["US", "US-CA", "US-NY", "UK"]


def part_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for each part: one to three premises, one or two conclusions of fifty, in the order of the part keys."""
    k, size = F.col("p_partkey"), F.col("p_size")
    pick = lambda words, at: F.get(F.array(*map(F.lit, words)), at.cast("int"))
    premises = F.transform(F.sequence(F.lit(0), (size % 3).cast("int")), lambda i: F.concat(F.lit("p"), (k + i * 7) % 30))
    conclusions = F.when(k % 6 == 0, F.array(F.concat(F.lit("c"), k % 50), F.concat(F.lit("c"), (k + 1) % 50))).otherwise(F.array(F.concat(F.lit("c"), k % 50)))
    return read(spark, sf_dir, "part").select(
        F.concat(F.lit("r"), k).alias("id"), pick(_KINDS, k % 5).alias("rule_type"), (size + 50).cast("int").alias("priority"), F.concat(F.lit("Act "), "p_brand").alias("authority"),
        premises.alias("premises"), conclusions.alias("conclusions"), F.col("p_name").alias("rule_text"), ((size % 10 + 1) / F.lit(10.0)).alias("confidence"),
        F.when(k % 9 != 0, pick(_PLACES, k % 4)).alias("jurisdiction"), F.when(size % 7 != 0, F.make_timestamp(size % 20 + 1990, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))).alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"),
        F.when(k % 50 >= 10, pick(["federal", "state", "local", "other"], size % 4)).alias("authority_level"), k.cast("long").alias("seq"),
    )


PART_RULES_SQL = f"""r AS (SELECT 'r' || k AS id, {_KINDS!r}[k % 5 + 1] AS kind, s + 50 AS priority, 'Act ' || b AS authority, [('p' || (k + i * 7) % 30) FOR i IN range(s % 3 + 1)] AS tails,
CASE WHEN k % 6 = 0 THEN ['c' || k % 50, 'c' || (k + 1) % 50] ELSE ['c' || k % 50] END AS heads, CAST(s % 10 + 1 AS DOUBLE) / 10 AS rc, CASE WHEN k % 9 <> 0 THEN {_PLACES!r}[k % 4 + 1] END AS j,
CASE WHEN s % 7 <> 0 THEN s % 20 + 1990 END AS y, CASE WHEN k % 50 >= 10 THEN [3, 2, 1, 0][s % 4 + 1] ELSE 0 END AS lvl, k AS seq FROM (SELECT p_partkey AS k, p_size AS s, p_brand AS b FROM part))"""
_SCORE = "(priority + CASE kind WHEN 'constitutional' THEN 1000 WHEN 'statutory' THEN 500 WHEN 'regulation' THEN 300 WHEN 'case_law' THEN 200 ELSE 100 END + CASE lvl WHEN 3 THEN 300 WHEN 2 THEN 200 WHEN 1 THEN 100 ELSE 0 END) * rc"


def _sql_rules() -> str:
    level = {"federal": 3, "state": 2, "local": 1}
    rows = []
    for n, (i, kind, p, pre, con, c, j, y, a) in enumerate(_RULES):
        rows.append(f"('{i}', '{kind}', {p}, {pre!r}, {con!r}, CAST({c} AS DOUBLE), {repr(j) if j else 'CAST(NULL AS VARCHAR)'}, {y or 'CAST(NULL AS INT)'}, {level.get(a, 0)}, {n})")
    return "r(id, kind, priority, tails, heads, rc, j, y, lvl, seq) AS (VALUES " + ", ".join(rows) + ")"


_R = _sql_rules()
#: Satisfied rules of facts `{0}` as CTE `{1}`, winners as `{1}w`, and the conclusions not yet known as `{1}n`.
_ROUND = """{1} AS (SELECT f.scope, r.id, count(DISTINCT t.p) AS have, min(f.confidence) AS low, exp(avg(ln(f.confidence))) AS gm FROM (SELECT id, unnest(tails) AS p FROM r) t JOIN r ON r.id = t.id JOIN {0} f ON f.id = t.p GROUP BY f.scope, r.id HAVING count(DISTINCT t.p) = max(len(r.tails))),
{1}h AS (SELECT s.scope, s.id, h.head, row_number() OVER (PARTITION BY s.scope, h.head ORDER BY r.lvl DESC, len(r.tails) DESC, coalesce(r.y, 1970) DESC, r.priority DESC, r.seq) AS k FROM {1} s JOIN r ON r.id = s.id JOIN (SELECT id, unnest(heads) AS head FROM r) h ON h.id = s.id),
{1}w AS (SELECT scope, id FROM {1}h GROUP BY scope, id HAVING max(k) = 1),
{1}n AS (SELECT w.scope, h.head AS id, least(s.low, r.rc) AS confidence, w.id AS edge_id FROM {1}w w JOIN {1} s ON s.scope = w.scope AND s.id = w.id JOIN r ON r.id = w.id JOIN (SELECT id, unnest(heads) AS head FROM r) h ON h.id = w.id WHERE NOT EXISTS (SELECT 1 FROM {0} f WHERE f.scope = w.scope AND f.id = h.head))"""


def _rounds(n: int) -> str:
    parts, facts = [SQL_FACTS, _R], "f"
    for i in range(1, n + 1):
        parts.append(_ROUND.format(facts, f"s{i}"))
        parts.append(f"f{i} AS (SELECT scope, id, confidence FROM {facts} UNION ALL SELECT scope, id, confidence FROM s{i}n)")
        facts = f"f{i}"
    return "WITH " + ",\n".join(parts)


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(_rounds(1) + " SELECT scope, id AS edge_id FROM s1")
def premises_satisfied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return satisfied(edges(spark), resolved(event_facts(spark, sf_dir))).select("scope", "edge_id")


@query(_rounds(1) + " SELECT scope, id AS edge_id FROM s1")
def premises_by_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Premises that no fact is, but that facts state."""
    facts = event_facts(spark, sf_dir)
    stating = facts.withColumn("statement", F.col("id")).withColumn("id", F.concat(F.lit("fact of "), "id"))
    return satisfied(edges(spark), resolved(stating)).select("scope", "edge_id")


@query(f"WITH {SQL_FACTS}, {_R} SELECT s.scope, t.id AS edge_id, t.p AS premise FROM (SELECT DISTINCT scope FROM f) s CROSS JOIN (SELECT id, unnest(tails) AS p FROM r) t WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.scope = s.scope AND f.id = t.p)")
def missing_premises_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing_premises(edges(spark), event_facts(spark, sf_dir))


@query(_rounds(1) + " SELECT scope, id AS edge_id FROM s1w")
def conflict_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark)
    return conflict_winners(e, satisfied(e, resolved(event_facts(spark, sf_dir)))).select("scope", "edge_id")


@query(f"""WITH {PART_RULES_SQL}, d AS (SELECT *, {_SCORE} AS score, unnest(heads) AS conclusion, len(tails) AS n FROM r),
q AS (SELECT *, max(lvl) OVER w AS top, max(n) OVER w AS most, max(y) OVER w AS newest FROM d WINDOW w AS (PARTITION BY conclusion)),
z AS (SELECT *, sum(CASE WHEN n = most THEN 1 ELSE 0 END) OVER (PARTITION BY conclusion) AS ties FROM q),
o AS (SELECT *, row_number() OVER (PARTITION BY conclusion ORDER BY CASE WHEN top > 0 THEN lvl WHEN ties = 1 THEN CASE WHEN n = most THEN 1 ELSE 0 END WHEN newest IS NOT NULL THEN CASE WHEN y = newest THEN 1 ELSE 0 END ELSE score END DESC, seq) AS k FROM z)
SELECT conclusion, id AS rule_id FROM o WHERE k = 1""")
def conflict_resolver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all rules made of parts, the one that stands for each conclusion."""
    return resolve_conflicts(part_rules(spark, sf_dir))


@query(f"WITH {PART_RULES_SQL} SELECT id, round({_SCORE}, 6) AS score FROM r")
def rule_priority_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_rules(spark, sf_dir).select("id", F.round(priority_score(F.col("rule_type"), F.col("priority"), F.col("authority_level"), F.col("confidence")), 6).alias("score"))


@query(_rounds(1) + " SELECT s.scope, s.id AS edge_id, round(least(s.low, r.rc), 9) AS confidence FROM s1 s JOIN r ON r.id = s.id")
def confidence_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark)
    met = satisfied(e, resolved(event_facts(spark, sf_dir))).join(e.select("edge_id", F.col("confidence").alias("rc")), "edge_id")
    return met.select("scope", "edge_id", F.round(confidence(F.col("confs"), F.col("rc")), 9).alias("confidence"))


@query(_rounds(1) + " SELECT s.scope, s.id AS edge_id, round(pow(s.gm, 0.8) * pow(r.rc, 0.2), 6) AS confidence FROM s1 s JOIN r ON r.id = s.id")
def confidence_wgm(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark)
    met = satisfied(e, resolved(event_facts(spark, sf_dir))).join(e.select("edge_id", F.col("confidence").alias("rc")), "edge_id")
    return met.select("scope", "edge_id", F.round(confidence(F.col("confs"), F.col("rc"), "wgm"), 6).alias("confidence"))


@query(_rounds(4) + " SELECT scope, id, round(confidence, 9) AS confidence, edge_id, 1 AS step FROM s1n UNION ALL SELECT scope, id, round(confidence, 9), edge_id, 2 FROM s2n UNION ALL SELECT scope, id, round(confidence, 9), edge_id, 3 FROM s3n UNION ALL SELECT scope, id, round(confidence, 9), edge_id, 4 FROM s4n")
def forward_chain_by_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forward_chain_rounds(event_facts(spark, sf_dir), edges(spark)).withColumn("confidence", F.round("confidence", 9))


@query()
def forward_chain_by_agenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First in, first out, rule by rule: held against a reference loop in the tests."""
    return forward_chain_exact(event_facts(spark, sf_dir), edges(spark))


@query(f"""WITH {PART_RULES_SQL}, c AS (SELECT n_name AS context_id, CASE WHEN n_nationkey % 6 <> 0 THEN ['US-CA', 'US-NY', 'UK', 'US'][n_nationkey % 4 + 1] END AS j, CASE WHEN n_nationkey % 5 <> 0 THEN n_nationkey % 20 + 1990 END AS y FROM nation)
SELECT r.id AS rule_id, c.context_id FROM r, c WHERE coalesce(starts_with(c.j, r.j), true) AND coalesce(c.y >= r.y, true)""")
def context_applicability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of parts in contexts of nations: by prefix of jurisdiction and by date, each checked where both sides say something."""
    n = F.col("n_nationkey")
    place, since = F.get(F.array(*map(F.lit, ["US-CA", "US-NY", "UK", "US"])), (n % 4).cast("int")), F.make_timestamp(n % 20 + 1990, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    contexts = read(spark, sf_dir, "nation").select(F.col("n_name").alias("context_id"), F.when(n % 6 != 0, place).alias("jurisdiction"), F.when(n % 5 != 0, since).alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"))
    return contexts_apply(part_rules(spark, sf_dir).withColumnRenamed("id", "rule_id"), contexts)


@query(f"WITH {PART_RULES_SQL} SELECT id AS edge_id FROM r WHERE coalesce(starts_with('US-CA', j), true) AND coalesce(2004 >= y, true)")
def rules_in_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return implications(rules_as_edges(part_rules(spark, sf_dir)), {"jurisdiction": "US-CA", "valid_from": datetime(2004, 1, 1)}).select("edge_id")


def _all_facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    facts = event_facts(spark, sf_dir)
    derived = forward_chain_rounds(facts, edges(spark))
    more = derived.select("scope", "id", F.lit("Fact").alias("type"), F.col("id").alias("statement"), "confidence", F.col("step").cast("long").alias("seq"))
    return facts.unionByName(more), derived


_BACK = _rounds(4).replace("WITH ", "WITH RECURSIVE ", 1) + """, i AS (SELECT id AS edge_id, unnest(heads) AS head, tails FROM r), i2 AS (SELECT edge_id, head, unnest(tails) AS p FROM i),
back(scope, conclusion, edge_id, premise, depth, seen) AS (SELECT a.scope, a.id, i2.edge_id, i2.p, 1, [a.id, i2.p] FROM f4 a JOIN i2 ON i2.head = a.id
UNION ALL SELECT b.scope, b.conclusion, b.edge_id, n.p, b.depth + 1, list_append(b.seen, n.p) FROM back b JOIN (SELECT DISTINCT head, p FROM i2) n ON n.head = b.premise WHERE NOT list_contains(b.seen, n.p)),
g AS (SELECT b.scope, b.conclusion, b.edge_id, b.premise, f4.confidence, min(b.depth) AS depth, bool_and(b.premise NOT IN (SELECT head FROM i2)) AS leaf FROM back b JOIN f4 ON f4.scope = b.scope AND f4.id = b.premise GROUP BY ALL)"""


@query(_BACK + " SELECT scope, conclusion, edge_id, premise, round(confidence, 9) AS confidence, CAST(depth AS INT) AS depth, leaf, premise AS statement, depth = 1 AND (SELECT count(*) = 1 AND max(len(i.tails)) = 1 FROM i WHERE i.head = g.conclusion) AS critical FROM g")
def explain_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, derived = _all_facts(spark, sf_dir)
    told = explain(facts, edges(spark), derived.select("scope", "id"))
    return told.select("scope", "conclusion", "edge_id", "premise", F.round("confidence", 9).alias("confidence"), "depth", "leaf", "statement", "critical")


@query(_BACK + """, k AS (SELECT scope, conclusion, edge_id, min(confidence) AS c FROM g WHERE depth = 1 OR leaf GROUP BY ALL), m AS (SELECT k.scope, k.conclusion, k.edge_id, least(k.c, r.rc) AS p FROM k JOIN r ON r.id = k.edge_id)
SELECT scope, conclusion, edge_id, edge_id AS rule_id, 'Act ' || edge_id AS authority, 'text of ' || edge_id AS rule_text, 'implies' AS relation, round(p, 9) AS path_confidence, round(min(p) OVER (PARTITION BY scope, conclusion), 9) AS confidence FROM m""")
def explain_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, derived = _all_facts(spark, sf_dir)
    e = edges(spark)
    told = explanations(explain(facts, e, derived.select("scope", "id")), e)
    return told.withColumn("path_confidence", F.round("path_confidence", 9)).withColumn("confidence", F.round("confidence", 9))


def _surest(n: int) -> str:
    """v<n>: the surest confidence of each statement after n rounds of all rules."""
    parts = [SQL_FACTS, _R, "v0 AS (SELECT scope, id, max(confidence) AS c FROM f GROUP BY scope, id)"]
    for i in range(1, n + 1):
        parts.append(f"""v{i} AS (SELECT scope, id, max(c) AS c FROM (SELECT scope, id, c FROM v{i - 1} UNION ALL
SELECT scope, unnest(heads) AS id, least(low, rc) AS c FROM (SELECT v.scope, r.id AS e, any_value(r.heads) AS heads, any_value(r.rc) AS rc, min(v.c) AS low FROM (SELECT id, unnest(tails) AS p FROM r) t JOIN r ON r.id = t.id JOIN v{i - 1} v ON v.id = t.p GROUP BY v.scope, r.id HAVING count(*) = max(len(r.tails)))) GROUP BY scope, id)""")
    return "WITH " + ",\n".join(parts)


@query(_surest(5) + " SELECT scope, id AS statement, round(c, 9) AS confidence, round(c, 9) AS path_confidence FROM v5")
def surest_supports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How sure each statement is by its surest support, and that the support told is as sure."""
    told = best_supports(event_facts(spark, sf_dir), edges(spark))
    return told.select("scope", "statement", F.round("confidence", 9).alias("confidence"), F.round("path_confidence", 9).alias("path_confidence"))


@query("SELECT user_id AS scope, count(*) AS n FROM events GROUP BY user_id HAVING count(DISTINCT CASE WHEN value > 100 THEN event_type END) = 5")
def premises_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Premises within a scope's set of facts, as an array test."""
    e = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("scope")).agg(F.count("*").alias("n"), F.collect_set(F.when(F.col("value") > 100, F.col("event_type"))).alias("known"))
    need = F.array(*map(F.lit, ["click", "error", "purchase", "signup", "view"]))
    return e.filter(F.size(F.array_except(need, "known")) == 0).select("scope", "n")
