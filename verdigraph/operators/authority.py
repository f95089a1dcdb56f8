"""Authority of precedents: treatment, recency, jurisdiction and court level of each citing edge."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigraph.plans.policy import lineage
from verdigraph.sources.graph import collapse_parallel
from verdigraph.sources.scratch import maybe_broadcast, settle

#: Nodes with their court and jurisdiction that are broadcast at most.
BROADCAST_ROWS = 500_000
CLASSES = {"controlling_relation": "controlling", "persuasive_relation": "persuasive", "contrary_to": "contrary", "cites": "persuasive"}
LEGAL_LABELS = ("cites", "same_issue", "controlling_relation", "persuasive_relation", "contrary_to")
YES = ("true", "yes", "y", "1")


def node_metadata(nodes: DataFrame) -> DataFrame:
    """(id, court, jurisdiction, year, precedential, statute_refs, pii_tags) from nodes(id, attrs map<string,string>)."""

    def attr(k: str) -> Column:
        return F.trim(F.try_element_at("attrs", F.lit(k)))

    def listed(k: str) -> Column:
        return F.filter(F.transform(F.split(F.coalesce(attr(k), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "").alias(k)

    return nodes.select("id", F.coalesce(attr("court"), F.lit("")).alias("court"), F.coalesce(attr("jurisdiction"), F.lit("")).alias("jurisdiction"), attr("year").try_cast("int").alias("year"), F.coalesce(F.lower(attr("precedential")).isin(*YES), F.lit(False)).alias("precedential"), listed("statute_refs"), listed("pii_tags"))


def edge_metadata(edges: DataFrame) -> DataFrame:
    """(u, v, label, treatment, year): a row for each legal label of edges(u, v, attrs map<string,string>).

    Here only the false words themselves (not none or null) count as absent.
    """
    present = F.filter(F.array(*map(F.lit, LEGAL_LABELS)), lambda k: F.coalesce(~F.lower(F.trim(F.try_element_at("attrs", k))).isin("", "false", "no", "n", "0"), F.lit(False)))
    told = F.coalesce(F.lower(F.trim(F.try_element_at("attrs", F.lit("treatment")))), F.lit(""))
    return edges.select("u", "v", F.explode(present).alias("label"), told.alias("treatment"), F.trim(F.try_element_at("attrs", F.lit("year"))).try_cast("int").alias("year"))


def lookup(table: dict[str, float], key: Column, default: float = 1.0) -> Column:
    """The number of a key in a small policy table, else the default."""
    if not table:
        return F.lit(default)
    known = F.create_map(*chain.from_iterable((F.lit(str(k)), F.lit(float(v))) for k, v in table.items()))
    return F.coalesce(F.try_element_at(known, key), F.lit(default))


def recency(year: Column, now_year: int, cfg: dict) -> Column:
    """Halved every half-life, but no lower than min_multiplier; 1 without a year or a half-life."""
    half_life, least = float(cfg.get("half_life_years", 10)), float(cfg.get("min_multiplier", 0.5))
    if half_life <= 0:
        return F.lit(1.0)
    age = F.greatest(F.lit(0), F.lit(now_year) - year)
    return F.when(year.isNull(), 1.0).otherwise(F.greatest(F.lit(least), F.exp(-F.log(F.lit(2.0)) * age / half_life)))


def alignment(src: Column, dst: Column, src_line: Column, dst_line: Column, cfg: dict) -> Column:
    """exact, ancestor (either way), sibling (a common ancestor) or foreign; a missing jurisdiction counts as exact.

    src_line and dst_line are the ancestors, nearest first, without the jurisdiction itself.
    """
    number = {k: float(cfg.get(k, d)) for k, d in (("exact", 1.0), ("ancestor", 0.9), ("sibling", 0.85), ("foreign", 0.75))}
    a, b = F.coalesce(F.trim(src), F.lit("")), F.coalesce(F.trim(dst), F.lit(""))
    up, down = (F.coalesce(x, F.array().cast("array<string>")) for x in (src_line, dst_line))
    return (
        F.when((a == "") | (b == "") | (a == b), number["exact"])
        .when(F.array_contains(up, b) | F.array_contains(down, a), number["ancestor"])
        .when(F.coalesce(F.arrays_overlap(up, down), F.lit(False)), number["sibling"])
        .otherwise(number["foreign"])
    )


def lineages(parents: DataFrame) -> DataFrame:
    """(jurisdiction, ancestor, distance) over parents(child, parent), itself at 0, by a recursive query; cycles end.

    A line longer than spark.sql.cteRecursionLevelLimit raises.
    """
    return parents.sparkSession.sql("""
        WITH RECURSIVE up(jurisdiction, ancestor, distance, seen) AS (
            SELECT j, j, 0, array(j) FROM (SELECT child AS j FROM {parents} UNION SELECT parent FROM {parents} WHERE parent IS NOT NULL)
            UNION ALL
            SELECT up.jurisdiction, p.parent, up.distance + 1, concat(up.seen, array(p.parent))
            FROM up JOIN {parents} p ON p.child = up.ancestor
            WHERE p.parent IS NOT NULL AND NOT array_contains(up.seen, p.parent)
        )
        SELECT jurisdiction, ancestor, min(distance) AS distance FROM up GROUP BY jurisdiction, ancestor""", parents=parents)


def _own_factors(cfg: dict, now_year: int) -> Column:
    """The factors of an edge (treatment, year) by itself."""
    return lookup(cfg.get("treatment_modifier") or {}, F.lower(F.trim(F.coalesce("treatment", F.lit(""))))) * recency(F.col("year"), now_year, cfg.get("recency") or {})


def _place_factors(cfg: dict) -> tuple[Column, Column]:
    """The factors of jurisdictions and court of a row (sj, sl, dj, dl, court)."""
    return alignment(F.col("sj"), F.col("dj"), F.col("sl"), F.col("dl"), cfg.get("jurisdiction_alignment") or {}), lookup(cfg.get("court_levels") or {}, F.trim(F.coalesce("court", F.lit(""))))


def _factors(cfg: dict, now_year: int) -> Column:
    """Authority of a row (treatment, year, sj, sl, dj, dl, court): the product of its four factors."""
    aligned, level = _place_factors(cfg)
    return _own_factors(cfg, now_year) * aligned * level


def _class() -> Column:
    kinds = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in CLASSES.items()))
    return F.try_element_at(kinds, F.col("label"))


def edge_authority(edges: DataFrame, nodes: DataFrame, ancestors: DataFrame, cfg: dict, now_year: int) -> DataFrame:
    """edges(u, v, label, treatment, year) with class and authority, the product of its four factors.

    nodes(id, court, jurisdiction); ancestors(jurisdiction, line), a policy
    table. Endpoints without metadata count as neutral.
    """
    lined = maybe_broadcast(settle(nodes.join(ancestors, "jurisdiction", "left").select("id", "court", "jurisdiction", "line"), "lined"), BROADCAST_ROWS)
    src = lined.select(F.col("id").alias("u"), F.col("jurisdiction").alias("sj"), F.col("line").alias("sl"))
    dst = lined.select(F.col("id").alias("v"), F.col("jurisdiction").alias("dj"), F.col("line").alias("dl"), "court")
    met = edges.join(src, "u", "left").join(dst, "v", "left")
    return met.select("u", "v", "label", _class().alias("class"), _factors(cfg, now_year).alias("authority"))


def authority_sums(edges: DataFrame, nodes: DataFrame, ancestors: DataFrame, cfg: dict, now_year: int) -> DataFrame:
    """(class, authority): sums of edge_authority() by class and cited node.

    Of an edge only its class and the factors of its own are kept, and equal
    ones are counted before the cited node is looked up, so a famous
    precedent is a few rows by then. Lines of ancestors are looked up last,
    by jurisdiction, and never shuffled with nodes or edges.
    """
    # Written once: each is looked at for its size, and then joined, more than once.
    lines = settle(ancestors.select("jurisdiction", "line"), "lines")
    known = settle(nodes.select("id", "court", "jurisdiction"), "known")
    own = edges.select("u", "v", _class().alias("class"), _own_factors(cfg, now_year).alias("own"))
    src = known.select(F.col("id").alias("u"), F.col("jurisdiction").alias("sj"))
    counted = own.join(maybe_broadcast(src, BROADCAST_ROWS), "u", "left").groupBy("v", "class", "own", "sj").agg(F.count("*").alias("n"))
    dst = known.select(F.col("id").alias("v"), F.col("jurisdiction").alias("dj"), "court")
    met = counted.join(maybe_broadcast(dst, BROADCAST_ROWS), "v", "left")
    for j, line in (("sj", "sl"), ("dj", "dl")):
        met = met.join(maybe_broadcast(lines.select(F.col("jurisdiction").alias(j), F.col("line").alias(line)), BROADCAST_ROWS), j, "left")
    return met.select("class", (F.col("n") * (F.col("own") * _place_factors(cfg)[0] * _place_factors(cfg)[1])).alias("authority"))


def multipliers(authority: DataFrame) -> DataFrame:
    """One row (m_controlling, m_persuasive, m_contrary): sums by class, at least 1e-9; all 1 without any signal."""
    sums = [F.coalesce(F.sum(F.when(F.col("class") == c, F.col("authority"))), F.lit(0.0)).alias(c) for c in ("controlling", "persuasive", "contrary")]
    whole = F.col("controlling") + F.col("persuasive") + F.col("contrary")
    return authority.agg(*sums).select(*[F.when(whole == 0, 1.0).otherwise(F.greatest(F.col(c), F.lit(1e-9))).alias(f"m_{c}") for c in ("controlling", "persuasive", "contrary")])


def graph_multipliers(nodes: DataFrame, edges: DataFrame, cfg: dict, courts: dict, now_year: int) -> list[float]:
    """The three multipliers of a graph's nodes(id, attrs) and edges(src, dst, attrs, seq) as graphml_tables() reads them, under the policies precedent_weights and courts."""
    said = F.transform_values("attrs", lambda _, x: x["value"])
    cited = edge_metadata(collapse_parallel(edges).select(F.col("src").alias("u"), F.col("dst").alias("v"), said.alias("attrs")))
    known = node_metadata(nodes.select("id", said.alias("attrs"))).select("id", "court", "jurisdiction")
    hierarchy = courts.get("hierarchy") or {}
    names = sorted({*hierarchy, *(str(p) for ps in hierarchy.values() for p in ps or [])})
    lines = nodes.sparkSession.createDataFrame([(j, lineage(courts, j)[1:]) for j in names], "jurisdiction string, line array<string>")
    return list(multipliers(authority_sums(cited, known, lines, cfg, now_year)).first())
