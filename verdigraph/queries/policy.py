"""Queries over authority, policy and lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigraph.operators.authority import alignment, authority_sums, edge_metadata, lineages, lookup, multipliers, node_metadata, recency
from verdigraph.plans.library import derivation_rules, rules_for_claim
from verdigraph.plans.policy import burden_for, clause_weights, select_rules, style_for, styled
from verdigraph.queries.tables import COURTS, NOW_YEAR, SQL_AUTHORITY, SQL_EDGES, TREATMENTS, ancestors, citation_graph, edge_facts, parents, read

Q: dict = {}
SQL: dict[str, str] = {}
RECENCY = {"half_life_years": 10, "min_multiplier": 0.5}
LEVELS = {"US_SCOTUS": 1.0, "US_CIRCUIT": 0.9, "US_DISTRICT": 0.8, "STATE_SUPREME": 0.95, "STATE_APPEALS": 0.88, "STATE_TRIAL": 0.78}
MODIFIERS = {"followed": 1.08, "positive": 1.03, "neutral": 1.0, "criticized": 0.9, "distinguished": 0.88, "overruled": 0.5}
ALIGNMENT = {"exact": 1.0, "ancestor": 0.9, "sibling": 0.85, "foreign": 0.75}
POLICY = {"recency": RECENCY, "court_levels": LEVELS, "treatment_modifier": MODIFIERS, "jurisdiction_alignment": ALIGNMENT}
COURTS_CFG = {"weights": {"controlling": 0.6, "persuasive": 0.3, "contrary": 0.1}, "hierarchy": {"US-FED": [], "US-CA": ["US-FED"], "US-NY": ["US-FED"]}}
BURDEN = {"DEFAULT_BURDEN": 0.51, "BURDEN_OVERRIDES": {"US-FED": {"criminal": 0.90}, "US-CA": {"punitive_damages": 0.75}, "US-NY": {"fraud": 0.75}}}
PREFS = {"default_style": "textualism", "style_overrides": {"US-CA": {"default": "purposivism", "breach_of_contract": "textualism"}, "US-NY": {"fraud": "purposivism"}}}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT l_linenumber AS line, year(l_shipdate) AS year, count(*) AS n, round(max(greatest(0.5, exp(-ln(2) * greatest(0, 2002 - year(l_shipdate)) / 10))), 9) AS m FROM lineitem GROUP BY ALL")
def recency_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("line"), F.year("l_shipdate").cast("long").alias("year"))
    return lines.groupBy("line", "year").agg(F.count("*").alias("n"), F.round(F.max(recency(F.col("year"), NOW_YEAR, RECENCY)), 9).alias("m"))


@query("SELECT p_partkey AS part, CASE p_size % 7 WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 WHEN 2 THEN 0.8 WHEN 3 THEN 0.95 WHEN 4 THEN 0.88 WHEN 5 THEN 0.78 ELSE 1.0 END::DOUBLE AS m FROM part")
def court_level_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    court = F.get(F.array(*map(F.lit, COURTS)), F.col("p_size") % 7)
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), lookup(LEVELS, F.coalesce(court, F.lit("?"))).alias("m"))


@query("SELECT l_linenumber AS line, count(*) AS n, max(CASE l_linenumber WHEN 1 THEN 1.08 WHEN 2 THEN 1.03 WHEN 3 THEN 1.0 WHEN 4 THEN 0.9 WHEN 5 THEN 0.88 WHEN 6 THEN 0.5 ELSE 1.0 END)::DOUBLE AS m FROM lineitem GROUP BY 1")
def treatment_modifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.upper(F.array(*map(F.lit, TREATMENTS))[F.col("l_linenumber") - 1])
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("line"), lookup(MODIFIERS, F.lower(told)).alias("m"))
    return lines.groupBy("line").agg(F.count("*").alias("n"), F.max("m").alias("m"))


@query("""WITH j AS (SELECT n_name AS a, r_name AS p FROM nation JOIN region ON n_regionkey = r_regionkey), r AS (SELECT r_name AS a, 'GLOBAL' AS p FROM region)
SELECT x.a AS src, y.a AS dst, (CASE WHEN x.a = y.a THEN 1.0 WHEN y.k = 'region' AND x.p = y.a THEN 0.9 ELSE 0.85 END)::DOUBLE AS m
FROM j x CROSS JOIN (SELECT a, p, 'nation' AS k FROM j UNION ALL SELECT a, p, 'region' FROM r) y""")
def jurisdiction_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations against nations and regions: exact, an ancestor, or siblings below a region or GLOBAL."""
    lines = ancestors(spark, sf_dir).filter("jurisdiction <> 'GLOBAL'")
    nations = read(spark, sf_dir, "nation").select(F.col("n_name").alias("src"))
    src = nations.join(lines, F.col("src") == F.col("jurisdiction"), "left").select("src", F.col("line").alias("sl"))
    dst = lines.select(F.col("jurisdiction").alias("dst"), F.col("line").alias("dl"))
    return src.crossJoin(dst).select("src", "dst", alignment(F.col("src"), F.col("dst"), F.col("sl"), F.col("dl"), ALIGNMENT).alias("m"))


@query("""WITH RECURSIVE p AS (SELECT n_name AS child, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 'GLOBAL' FROM region),
up(jurisdiction, ancestor, distance) AS (SELECT child, child, 0 FROM p UNION SELECT 'GLOBAL', 'GLOBAL', 0 UNION ALL SELECT jurisdiction, parent, distance + 1 FROM up JOIN p ON child = ancestor)
SELECT jurisdiction, ancestor, min(distance) AS distance FROM up GROUP BY 1, 2""")
def jurisdiction_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineages(parents(spark, sf_dir))


_SUMS = f"""WITH {SQL_AUTHORITY}, s AS (SELECT round(sum(CASE WHEN f = 'R' THEN tm * rc * al * lv ELSE 0.0 END), 4) AS c,
round(sum(tm * rc * al * lv) + sum(CASE WHEN f = 'A' THEN tm * rc * al * lv ELSE 0.0 END), 4) AS p, round(sum(CASE WHEN f = 'N' AND st = 'F' THEN tm * rc * al * lv ELSE 0.0 END), 4) AS k FROM a)"""


@query(_SUMS + " SELECT c AS m_controlling, p AS m_persuasive, k AS m_contrary FROM s")
def authority_multipliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All citations by class; plain ones count as persuasive."""
    found = multipliers(authority_sums(*edge_facts(spark, sf_dir), POLICY, NOW_YEAR))
    return found.select(*[F.round(c, 4).alias(c) for c in found.columns])


@query(_SUMS + " SELECT round(0.6 * c / (0.6 * c + 0.27 * p + 0.1 * k), 6) AS w_controlling, round(0.27 * p / (0.6 * c + 0.27 * p + 0.1 * k), 6) AS w_persuasive, round(0.1 * k / (0.6 * c + 0.27 * p + 0.1 * k), 6) AS w_contrary FROM s")
def scaled_support_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of the support rule under textualism, scaled by the authority found."""
    m = list(multipliers(authority_sums(*edge_facts(spark, sf_dir), POLICY, NOW_YEAR)).first())
    rules = rules_for_claim("breach_of_contract", "US-CA", courts=COURTS_CFG, burden=BURDEN, prefs=PREFS, multipliers=m)
    w = next(r for r in rules if r.target.startswith("support_for")).weights
    return spark.createDataFrame([tuple(round(x, 6) for x in w)], "w_controlling double, w_persuasive double, w_contrary double")


@query("""SELECT 'o:' || l_orderkey AS u, label, count(*) AS n, CAST(sum(y) AS BIGINT) AS years FROM (
SELECT l_orderkey, 'cites' AS label, year(l_shipdate) AS y FROM lineitem UNION ALL SELECT l_orderkey, 'same_issue', year(l_shipdate) FROM lineitem WHERE l_discount >= 0.05) GROUP BY ALL""")
def edge_legal_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each legal label of an edge's attributes, with treatment and year."""
    attrs = F.create_map(F.lit("cites"), F.lit("yes"), F.lit("same_issue"), F.when(F.col("l_discount") >= 0.05, "1").otherwise("No"), F.lit("weight"), F.lit("3"), F.lit("year"), F.concat(F.lit(" "), F.year("l_shipdate")), F.lit("treatment"), F.lit(" Followed "))
    edges = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("o:"), "l_orderkey").alias("u"), F.concat(F.lit("p:"), "l_partkey").alias("v"), attrs.alias("attrs"))
    return edge_metadata(edges).filter("treatment = 'followed'").groupBy("u", "label").agg(F.count("*").alias("n"), F.sum("year").alias("years"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 4 <> 3 THEN p_size + 1950 ELSE -1 END AS year, p_size % 2 = 0 AS precedential, p_brand AS court, CASE WHEN p_size % 3 = 0 THEN 2 ELSE 0 END AS n_refs FROM part")
def node_legal_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    attrs = F.create_map(F.lit("court"), F.concat(F.lit(" "), "p_brand", F.lit(" ")), F.lit("year"), F.when(size % 4 == 3, "c. 1950").otherwise(F.concat(size + 1950, F.lit(" "))), F.lit("precedential"), F.when(size % 2 == 0, "Yes").otherwise("none"), F.lit("statute_refs"), F.when(size % 3 == 0, "a , b,,").otherwise(" "))
    found = node_metadata(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), attrs.alias("attrs")))
    return found.select("id", F.coalesce("year", F.lit(-1)).alias("year"), "precedential", "court", F.size("statute_refs").alias("n_refs"))


_CLAIMS = [("punitive_damages", "US-CA"), ("criminal", "US-FED"), ("anything", "US-FED"), ("fraud", "US-NY"), ("fraud", "US-CA"), ("breach_of_contract", "US-TX"), ("breach_of_contract", "US-CA")]


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim of each customer, with the customer's nation."""
    said = F.get(F.array(*[F.struct(F.lit(c).alias("claim"), F.lit(j).alias("jurisdiction")) for c, j in _CLAIMS]), (F.col("c_custkey") % 7).cast("int"))
    return read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", said.alias("s")).select("n_name", "s.*")


_CLAIMS_SQL = f"q AS (SELECT n_name, {[c for c, _ in _CLAIMS]!r}[c_custkey % 7 + 1] AS claim, {[j for _, j in _CLAIMS]!r}[c_custkey % 7 + 1] AS jurisdiction FROM customer JOIN nation ON c_nationkey = n_nationkey)"


@query(f"""WITH {_CLAIMS_SQL}, t(claim, jurisdiction, burden) AS (VALUES ('punitive_damages', 'US-CA', 'legal_burden_clear_075'), ('criminal', 'US-FED', 'legal_burden_criminal_090'), ('anything', 'US-FED', 'legal_burden_criminal_090'),
('fraud', 'US-NY', 'legal_burden_clear_075'), ('fraud', 'US-CA', 'legal_burden_civil_051'), ('breach_of_contract', 'US-TX', 'legal_burden_civil_051'), ('breach_of_contract', 'US-CA', 'legal_burden_civil_051'))
SELECT n_name, claim, jurisdiction, burden, count(*) AS n FROM q JOIN t USING (claim, jurisdiction) GROUP BY ALL""")
def burden_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Burdens of customers' claims: the policy is resolved for each (claim, jurisdiction), then joined."""
    policy = spark.createDataFrame([(c, j, burden_for(c, j, BURDEN)) for c, j in _CLAIMS], "claim string, jurisdiction string, burden string")
    return claims(spark, sf_dir).groupBy("n_name", "claim", "jurisdiction").agg(F.count("*").alias("n")).join(F.broadcast(policy), ["claim", "jurisdiction"])


@query(f"""WITH {_CLAIMS_SQL}, t(claim, jurisdiction, style, c, p, k) AS (VALUES ('punitive_damages', 'US-CA', 'purposivism', 0.6, 0.33, 0.1), ('criminal', 'US-FED', 'textualism', 0.6, 0.27, 0.1), ('anything', 'US-FED', 'textualism', 0.6, 0.27, 0.1),
('fraud', 'US-NY', 'purposivism', 0.6, 0.33, 0.1), ('fraud', 'US-CA', 'purposivism', 0.6, 0.33, 0.1), ('breach_of_contract', 'US-TX', 'textualism', 0.6, 0.27, 0.1), ('breach_of_contract', 'US-CA', 'textualism', 0.6, 0.27, 0.1))
SELECT n_name, claim, jurisdiction, style, round((c / (c + p + k))::DOUBLE, 9) AS w_controlling, round((p / (c + p + k))::DOUBLE, 9) AS w_persuasive, round((k / (c + p + k))::DOUBLE, 9) AS w_contrary, count(*) AS n FROM q JOIN t USING (claim, jurisdiction) GROUP BY ALL""")
def style_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for c, j in _CLAIMS:
        style = style_for(c, j, PREFS, COURTS_CFG)
        rows.append((c, j, style, *(round(w, 9) for w in styled(clause_weights(COURTS_CFG), style))))
    policy = spark.createDataFrame(rows, "claim string, jurisdiction string, style string, w_controlling double, w_persuasive double, w_contrary double")
    return claims(spark, sf_dir).groupBy("n_name", "claim", "jurisdiction").agg(F.count("*").alias("n")).join(F.broadcast(policy), ["claim", "jurisdiction"])


@query(f"""WITH {SQL_EDGES} SELECT 'controlling_for' AS label, count(*) AS n FROM e WHERE same_issue AND controlling_relation AND v IN (SELECT id FROM pr) UNION ALL SELECT 'persuasive_for', count(*) FROM e WHERE same_issue AND persuasive_relation""")
def rule_filter_by_jurisdiction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A local exclusion holds against the parent's include list; what neither names is shut out by that list."""
    from verdigraph.operators.derive import updates

    courts = {**COURTS_CFG, "rule_overrides": {"US-CA": {"exclude_labels": ["contrary_authority"]}, "US-FED": {"include_labels": ["controlling_for", "persuasive_for", "contrary_authority"]}}}
    kept = select_rules(derivation_rules(), courts, "US-CA")
    return updates(kept, citation_graph(spark, sf_dir)).groupBy("label").agg(F.count("*").alias("n"))


