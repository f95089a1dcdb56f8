"""Queries over the hypergraph store, traces and sets."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigraph.operators.hyper import rules_as_edges
from verdigraph.operators.interpretation import reason
from verdigraph.operators.temporal import timeline
from verdigraph.plans.library import derivation_rules
from verdigraph.plans.rules import parse_rules
from verdigraph.queries.chaining import PART_RULES_SQL, event_facts, part_rules
from verdigraph.queries.logic import _STEPS, _timeline_sql, rounded
from verdigraph.queries.tables import SQL_EDGES, citation_graph, line_updates, read
from verdigraph.sources.scratch import scratch
from verdigraph.sources.store import GraphStore

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _folder(spark: SparkSession) -> str:
    return f"{scratch(spark)}/store-{uuid.uuid4().hex}"


def _prov(kind: str) -> F.Column:
    return F.from_json(F.lit(f'{{"source":[{{"type":"{kind}"}}],"method":"load","agent":"query","confidence":0.5}}'), "source array<map<string,string>>, method string, agent string, time timestamp, confidence double, hash string, evidence string, derivation array<string>").alias("prov")


def store(spark: SparkSession, sf_dir: str) -> GraphStore:
    """Parts as nodes, some of them written twice, and orders as edges from their parts to themselves."""
    s = GraphStore(spark, _folder(spark))
    parts = read(spark, sf_dir, "part")
    none = F.lit(None)

    def nodes(df: DataFrame, kind: str) -> DataFrame:
        return df.select(F.concat(F.lit("p:"), "p_partkey").alias("id"), F.lit(kind).alias("type"), F.array().cast("array<string>").alias("labels"), F.create_map(F.lit("statement"), F.col("p_name")).alias("data"), none.alias("context"), _prov(kind.lower()))

    s.add_nodes(nodes(parts, "Part"))
    s.add_nodes(nodes(parts.filter("p_size % 2 = 0"), "Even"))
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.concat(F.lit("p:"), "l_partkey"))).alias("tails"))
    s.add_edges(lines.select(F.concat(F.lit("o:"), "l_orderkey").alias("id"), F.when(F.col("l_orderkey") % 5 == 0, "implies").otherwise("cites").alias("relation"), "tails", F.array(F.concat(F.lit("h:"), F.col("l_orderkey") % 100)).alias("heads"), F.create_map(F.lit("priority"), F.lit("7")).alias("qualifiers"), none.alias("context"), _prov("order")))
    return s


@query("SELECT CASE WHEN p_size % 2 = 0 THEN 'Even' ELSE 'Part' END AS type, count(*) AS n FROM part GROUP BY 1")
def store_upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node written again replaces the one before."""
    return store(spark, sf_dir).nodes().groupBy("type").agg(F.count("*").alias("n"))


@query("""WITH h AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS p FROM lineitem), e AS (SELECT DISTINCT k FROM h)
SELECT 'by_type' AS lookup, count(*) AS n FROM part WHERE p_size % 2 = 0 UNION ALL SELECT 'by_source', count(*) FROM part WHERE p_size % 2 = 1
UNION ALL SELECT 'by_statement', count(*) FROM part WHERE p_name = (SELECT min(p_name) FROM part WHERE p_partkey = 7) UNION ALL SELECT 'by_relation', count(*) FROM e WHERE k % 5 = 0
UNION ALL SELECT 'incoming', count(*) FROM e WHERE k % 100 = 42 UNION ALL SELECT 'outgoing', count(*) FROM h WHERE p = 7 UNION ALL SELECT 'node', 1 UNION ALL SELECT 'edge', count(*) FROM e WHERE k = 3""")
def store_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every index of the store as a filter over its tables."""
    s = store(spark, sf_dir)
    name = read(spark, sf_dir, "part").filter("p_partkey = 7").first()["p_name"]
    found = {"by_type": s.nodes_by_type("Even"), "by_source": s.nodes_by_source_type("part"), "by_statement": s.nodes_by_statement(name), "by_relation": s.edges_by_relation("implies"), "incoming": s.incoming("h:42"), "outgoing": s.outgoing("p:7"), "node": s.node("p:7"), "edge": s.edge("o:3")}
    out = None
    for k, df in found.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(k).alias("lookup"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {PART_RULES_SQL} SELECT id AS edge_id, array_to_string(tails, ' ') AS tails, array_to_string(heads, ' ') AS heads, priority, authority FROM r")
def rules_to_hyperedges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of parts as hyperedges from their premises to their conclusions."""
    return rules_as_edges(part_rules(spark, sf_dir)).filter("relation = 'implies'").select("edge_id", F.concat_ws(" ", "tails").alias("tails"), F.concat_ws(" ", "heads").alias("heads"), "priority", "authority")


_TRACED = f"""WITH {SQL_EDGES}, f AS (SELECT 'derive_controlling_for' AS rule_id, count(*) AS n FROM e WHERE same_issue AND controlling_relation AND v IN (SELECT id FROM pr)
UNION ALL SELECT 'derive_persuasive_for', count(*) FROM e WHERE same_issue AND persuasive_relation UNION ALL SELECT 'derive_contrary_authority', count(DISTINCT u) FROM e WHERE contrary_to)"""


@query(_TRACED + " SELECT rule_id, n AS events, CASE rule_id WHEN 'derive_controlling_for' THEN 4 WHEN 'derive_persuasive_for' THEN 3 ELSE 1 END AS clauses FROM f")
def rule_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What fired at which step, by rule."""
    told = reason(derivation_rules(), citation_graph(spark, sf_dir)).trace
    return told.groupBy("rule_id").agg(F.count("*").alias("events"), F.max("clauses").alias("clauses"))


@query(_TRACED + " SELECT rule_id, n * CASE rule_id WHEN 'derive_controlling_for' THEN 4 WHEN 'derive_persuasive_for' THEN 3 ELSE 1 END AS n FROM f")
def rule_supports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clauses behind each statement, by rule."""
    return reason(derivation_rules(), citation_graph(spark, sf_dir)).supports.groupBy("rule_id").agg(F.count("*").alias("n"))


@query(_timeline_sql("false") + " SELECT arg0, CAST(t AS INT) AS t, round(l, 9) AS l, round(u, 9) AS u FROM s WHERE present AND t = (SELECT max(t) FROM s)")
def last_timestep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts at the last step of a timeline."""
    told = timeline(line_updates(spark, sf_dir).withColumn("static", F.lit(False)), _STEPS).filter("present")
    last = told.groupBy("label", "arg0", "arg1").agg(F.max_by(F.struct("t", "l", "u"), "t").alias("x"))
    return rounded(last.select("arg0", "x.t", F.col("x.l").alias("l"), F.col("x.u").alias("u")))


@query(f"""WITH {SQL_EDGES} SELECT 'wary' AS label, q.u AS arg0 FROM (SELECT DISTINCT v AS u FROM e WHERE v IN (SELECT id FROM pr)) q WHERE false
UNION ALL SELECT 'known', id FROM pr""")
def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules read from text: one fires for every precedential part, one for none."""
    from verdigraph.operators.derive import updates

    rules = parse_rules("rule a: known(X) :- precedential(X); ann=average; weights=1\nrule b: wary(X) :- precedential(X), absent(X)  # nothing is absent")
    return updates(rules, citation_graph(spark, sf_dir)).select("label", "arg0")


@query("""WITH t AS (SELECT l_orderkey AS k, list_sort(list_distinct(list(l_returnflag))) AS a, list_sort(list_distinct(list(l_linestatus))) AS b FROM lineitem GROUP BY l_orderkey)
SELECT k, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS both, len(list_intersect(a, ['A', 'R'])) > 0 AS touches FROM t""")
def tag_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of tag sets in order, and whether sets meet."""
    t = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set("l_returnflag").alias("a"), F.collect_set("l_linestatus").alias("b"))
    return t.select("k", F.array_join(F.array_sort(F.array_union("a", "b")), ",").alias("both"), F.arrays_overlap("a", F.array(F.lit("A"), F.lit("R"))).alias("touches"))


@query("SELECT CAST(user_id AS VARCHAR) AS scope, string_agg(event_type, ',' ORDER BY event_type) AS known FROM (SELECT user_id, event_type FROM events GROUP BY ALL HAVING max(value) >= 150) GROUP BY user_id")
def facts_by_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = event_facts(spark, sf_dir)
    return f.groupBy("scope").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("known"))


