"""The reference domain over the star-schema tables: orders are cases, parts are authorities, line items cite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigraph.sources.graph import Graph, label_set

NOW_YEAR = 2002
COURTS = ["US_SCOTUS", "US_CIRCUIT", "US_DISTRICT", "STATE_SUPREME", "STATE_APPEALS", "STATE_TRIAL"]
TREATMENTS = ["followed", "positive", "neutral", "criticized", "distinguished", "overruled", "unheard_of"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def order_id(c: str = "l_orderkey") -> Column:
    return F.concat(F.lit("o:"), F.col(c))


def part_id(c: str = "l_partkey") -> Column:
    return F.concat(F.lit("p:"), F.col(c))


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each (order, part), with the flags of its lines."""
    flags = {
        "same_issue": F.col("l_discount") >= 0.05,
        "controlling_relation": F.col("l_returnflag") == "R",
        "persuasive_relation": F.col("l_returnflag") == "A",
        "contrary_to": (F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F"),
    }
    lines = read(spark, sf_dir, "lineitem")
    return lines.groupBy("l_orderkey", "l_partkey").agg(*[F.bool_or(c).alias(k) for k, c in flags.items()])


def citation_graph(spark: SparkSession, sf_dir: str) -> Graph:
    flags = ["same_issue", "controlling_relation", "persuasive_relation", "contrary_to"]
    edges = citations(spark, sf_dir).select(order_id().alias("u"), part_id().alias("v"), label_set(cites=F.lit(True), **{k: F.col(k) for k in flags}).alias("labels"))
    nodes = read(spark, sf_dir, "part").filter("p_size > 25").select(part_id("p_partkey").alias("id"), F.array(F.lit("precedential")).alias("labels"))
    return Graph(nodes, edges)


#: The same in SQL, as the start of a WITH clause.
SQL_EDGES = """e AS (SELECT 'o:' || l_orderkey AS u, 'p:' || l_partkey AS v, bool_or(l_discount >= 0.05) AS same_issue,
  bool_or(l_returnflag = 'R') AS controlling_relation, bool_or(l_returnflag = 'A') AS persuasive_relation,
  bool_or(l_returnflag = 'N' AND l_linestatus = 'F') AS contrary_to FROM lineitem GROUP BY l_orderkey, l_partkey),
pr AS (SELECT 'p:' || p_partkey AS id FROM part WHERE p_size > 25)"""


def line_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates of a statement for each order, one for each line number: bounds, delay and static flag vary by line."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.col("l_discount") + 0.0).alias("d"), F.max(F.col("l_tax") + 0.0).alias("x"), F.bool_or(F.col("l_returnflag") == "R").alias("r"))
    low = F.col("d") * 5
    return lines.select(
        F.lit("band").alias("label"), order_id().alias("arg0"), F.lit(None).cast("string").alias("arg1"),
        low.alias("l"), F.least(F.lit(1.0), low + F.col("x") * 5).alias("u"), (F.col("l_linenumber") % 3).cast("int").alias("delta"),
        F.col("l_linenumber").cast("int").alias("ord"), F.lit(0).alias("emit"), (F.col("r") & (F.col("l_linenumber") == 2)).alias("static"), F.concat(F.lit("r"), F.col("l_linenumber")).alias("source"),
    )


SQL_UPDATES = """g AS (SELECT l_orderkey, l_linenumber, min(l_discount + 0.0) AS d, max(l_tax + 0.0) AS x, bool_or(l_returnflag = 'R') AS r FROM lineitem GROUP BY l_orderkey, l_linenumber),
w AS (SELECT 'o:' || l_orderkey AS arg0, d * 5 AS l, least(1.0, d * 5 + x * 5) AS u, CAST(l_linenumber % 3 AS INT) AS delta, l_linenumber AS ord,
  r AND l_linenumber = 2 AS static, 'r' || l_linenumber AS source FROM g)"""
SQL_FOLD = "list_reduce(list({'l': CAST(l AS DOUBLE), 'u': CAST(u AS DOUBLE)} ORDER BY delta DESC, ord), lambda a, x: CASE WHEN greatest(a.l, x.l) > least(a.u, x.u) THEN {'l': CAST(0 AS DOUBLE), 'u': CAST(1 AS DOUBLE)} ELSE {'l': greatest(a.l, x.l), 'u': least(a.u, x.u)} END)"


def edge_facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Legal metadata of the citation graph: edges(u, v, label, treatment, year), nodes(id, court, jurisdiction), ancestors(jurisdiction, line).

    A case's jurisdiction is its customer's nation, an authority's that of
    its (first) supplier; nations belong to regions and those to GLOBAL.
    """
    lines = read(spark, sf_dir, "lineitem")
    labels = F.array_compact(F.array(F.lit("cites"), F.when(F.col("l_returnflag") == "R", "controlling_relation"), F.when(F.col("l_returnflag") == "A", "persuasive_relation"), F.when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F"), "contrary_to")))
    told = F.array(*map(F.lit, TREATMENTS))[F.col("l_linenumber") - 1]
    edges = lines.select(order_id().alias("u"), part_id().alias("v"), F.explode(labels).alias("label"), told.alias("treatment"), F.year("l_shipdate").alias("year"))
    nations = read(spark, sf_dir, "nation")
    cases = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    cases = cases.select(order_id("o_orderkey").alias("id"), F.lit("").alias("court"), F.col("n_name").alias("jurisdiction"))
    first = lines.groupBy("l_partkey").agg(F.min("l_suppkey").alias("s"))
    kinds = read(spark, sf_dir, "part").select("p_partkey", F.array(*map(F.lit, COURTS))[F.col("p_size") % 6].alias("court"))
    parts = kinds.join(first, F.col("p_partkey") == F.col("l_partkey")).join(read(spark, sf_dir, "supplier"), F.col("s") == F.col("s_suppkey")).join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    parts = parts.select(part_id("p_partkey").alias("id"), "court", F.col("n_name").alias("jurisdiction"))
    return edges, cases.unionByName(parts), ancestors(spark, sf_dir)


def parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations, regions = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    up = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("child"), F.col("r_name").alias("parent"))
    return up.unionByName(regions.select(F.col("r_name").alias("child"), F.lit("GLOBAL").alias("parent")))


def ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verdigraph.operators.authority import lineages

    lines = lineages(parents(spark, sf_dir)).filter("distance > 0")
    return lines.groupBy("jurisdiction").agg(F.transform(F.array_sort(F.collect_list(F.struct("distance", "ancestor"))), lambda x: x["ancestor"]).alias("line"))


SQL_AUTHORITY = """n AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
cs AS (SELECT 'o:' || o_orderkey AS id, n_name AS j, r_name AS r FROM orders JOIN customer ON o_custkey = c_custkey JOIN n ON c_nationkey = n_nationkey),
ps AS (SELECT 'p:' || p_partkey AS id, p_size % 6 AS court, n_name AS j, r_name AS r FROM part
  JOIN (SELECT l_partkey, min(l_suppkey) AS s FROM lineitem GROUP BY l_partkey) ON p_partkey = l_partkey JOIN supplier ON s = s_suppkey JOIN n ON s_nationkey = n_nationkey),
a AS (SELECT 'o:' || l_orderkey AS u, 'p:' || l_partkey AS v, l_linenumber AS ln, year(l_shipdate) AS y, l_returnflag AS f, l_linestatus AS st,
  CASE l_linenumber WHEN 1 THEN 1.08 WHEN 2 THEN 1.03 WHEN 3 THEN 1.0 WHEN 4 THEN 0.9 WHEN 5 THEN 0.88 WHEN 6 THEN 0.5 ELSE 1.0 END::DOUBLE AS tm,
  greatest(0.5, exp(-ln(2) * greatest(0, 2002 - year(l_shipdate)) / 10))::DOUBLE AS rc,
  CASE WHEN cs.j IS NULL OR ps.j IS NULL OR cs.j = ps.j THEN 1.0 ELSE 0.85 END::DOUBLE AS al,
  CASE ps.court WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 WHEN 2 THEN 0.8 WHEN 3 THEN 0.95 WHEN 4 THEN 0.88 WHEN 5 THEN 0.78 ELSE 1.0 END::DOUBLE AS lv
  FROM lineitem LEFT JOIN cs ON cs.id = 'o:' || l_orderkey LEFT JOIN ps ON ps.id = 'p:' || l_partkey)"""


def event_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of each user: one for each type of event with a large value, as sure as its largest value allows."""
    e = read(spark, sf_dir, "events")
    top = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.05), F.max("value") / 500.0)), 6)
    return e.groupBy(F.col("user_id").cast("string").alias("scope"), F.col("event_type").alias("id")).agg(top.alias("confidence"), F.max("value").alias("m")).filter("m >= 150").select("scope", "id", F.lit("Fact").alias("type"), F.col("id").alias("statement"), "confidence", F.crc32(F.col("id").cast("binary")).alias("seq"))


SQL_FACTS = "f AS (SELECT CAST(user_id AS VARCHAR) AS scope, event_type AS id, round(least(1.0, greatest(0.05, max(value) / 500.0)), 6) AS confidence FROM events GROUP BY user_id, event_type HAVING max(value) >= 150)"
