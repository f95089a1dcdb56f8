"""Command line: analyze texts with a plugin, reason over a GraphML graph, or turn texts into a graph.

  python -m verdigraph.cli analyze PLUGIN_FOLDER NAME PATH [--jurisdiction US] [--format summary|detailed|json]
  python -m verdigraph.cli reason GRAPHML CLAIM [--jurisdiction US-FED] [--config FOLDER] [--tmax 1]
  python -m verdigraph.cli freeze GRAPHML CLAIM OUT.json [as for reason]
  python -m verdigraph.cli graph PATH OUT [--jurisdiction US-CA]
  python -m verdigraph.cli check CONFIG_FOLDER

PATH is a file, a glob or a folder of .txt files. Exit codes: 2 reading or a wrong configuration, 3 reasoning or building, 4 writing.
"""

from __future__ import annotations

import argparse
import json
import sys
from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigraph.operators.interpretation import Interpretation


def _documents(spark: SparkSession, path: str) -> DataFrame:
    from verdigraph.sources.documents import read_documents, read_folder

    docs = read_folder(spark, path) if Path(path).is_dir() else read_documents(spark, path)
    return docs.select(F.col("path").alias("doc_id"), "text")


def analyze(spark: SparkSession, a: argparse.Namespace) -> None:
    from verdigraph.plugins import PluginLoader, analysis_report
    from verdigraph.plugins import analyze as run
    from verdigraph.sources.documents import detailed, entity_counts

    docs = _documents(spark, a.path)
    found = run(docs, PluginLoader(a.folder).load(a.name), {"jurisdiction": a.jurisdiction})
    if a.format == "json":
        for r in analysis_report(docs, found, {"jurisdiction": a.jurisdiction}).toLocalIterator():
            print(r["value"])
        return
    if a.format == "detailed":
        ends = found["derived_facts"].select(F.col("scope").alias("doc_id"), F.col("statement").alias("id"), "statement", F.col("rule_authority").alias("authority"), "confidence")
        entities = found["entities"]
        for c, kind in (("word", "string"), ("start", "int"), ("score", "double")):
            entities = entities if c in entities.columns else entities.withColumn(c, F.lit(None).cast(kind))
        for r in detailed(entities, found["citations"], ends).toLocalIterator():
            print(r["value"])
        return
    for r in entity_counts(found["entities"]).collect():
        print(f"{r['entity_group']}: {r['n']}")
    for r in found["conclusions"].groupBy("id").agg(F.count("*").alias("n")).orderBy("id").toLocalIterator():
        print(f"{r['id']}: concluded in {r['n']} documents")


def _reasoned(spark: SparkSession, a: argparse.Namespace) -> Interpretation:
    """Facts of a GraphML graph under the policies of a folder; clause weights are scaled by authority if it has precedent_weights."""
    from verdigraph.operators.authority import graph_multipliers
    from verdigraph.operators.interpretation import reason as run
    from verdigraph.plans.library import rules_for_claim
    from verdigraph.sources.config import CHECKS, check_all, read_config
    from verdigraph.sources.graph import from_attributes, graphml_tables

    cfg = {k: read_config(str(path)) for k in CHECKS if a.config and (path := Path(a.config) / f"{k}.yaml").exists()}
    check_all(cfg, strict=True)
    nodes, edges = graphml_tables(spark, a.path)
    weights = cfg.get("precedent_weights")
    multipliers = graph_multipliers(nodes, edges, weights, cfg.get("courts") or {}, a.year) if weights else None
    rules = rules_for_claim(a.claim, a.jurisdiction, courts=cfg.get("courts"), burden=cfg.get("burden"), prefs=cfg.get("statutory_prefs"), multipliers=multipliers)
    return run(rules, from_attributes(nodes, edges), tmax=a.tmax)


def reason(spark: SparkSession, a: argparse.Namespace) -> None:
    for r in _reasoned(spark, a).jsonl().toLocalIterator():
        print(r["value"])


def freeze(spark: SparkSession, a: argparse.Namespace) -> None:
    """One JSON record of facts, supports and trace, to hold later runs against."""
    said = {"meta": {"graph": a.path, "claim": a.claim, "jurisdiction": a.jurisdiction, "tmax": a.tmax}, "interpretation": _reasoned(spark, a).as_dict()}
    try:
        Path(a.out).write_text(json.dumps(said, indent=2, sort_keys=True, default=str), encoding="utf-8")
    except OSError as e:
        print(e, file=sys.stderr)
        sys.exit(4)


def graph(spark: SparkSession, a: argparse.Namespace) -> None:
    from verdigraph.operators.extract import documents_graph_auto
    from verdigraph.sources.graphml import write_graphml

    nodes, edges = documents_graph_auto(_documents(spark, a.path), a.jurisdiction)
    attrs = F.create_map(F.lit("jurisdiction"), "jurisdiction", F.lit("year"), F.col("year").cast("string"), F.lit("precedential"), F.col("precedential").cast("string"), F.lit("statute_refs"), F.concat_ws(",", "statute_refs"), F.lit("pii_tags"), F.concat_ws(",", "pii_tags"))
    # Of several documents that name a node, the first by name tells its attributes.
    ns = nodes.groupBy("id").agg(F.min_by(attrs, "doc_id").alias("attrs"))
    es = edges.groupBy("src", "dst").agg(F.map_from_entries(F.collect_set(F.struct("label", F.lit("true")))).alias("attrs"))
    try:
        write_graphml(ns, es, a.out)
    except Exception as e:
        print(e, file=sys.stderr)
        sys.exit(4)


def check(spark: SparkSession | None, a: argparse.Namespace) -> None:
    """All configurations of a folder; what is wrong is said, and the exit code is 2 then."""
    from verdigraph.sources.config import check_folder

    errors = check_folder(a.path)
    for e in errors:
        print(e, file=sys.stderr)
    if errors:
        sys.exit(2)
    print("all configurations are valid")


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="verdigraph")
    sub = p.add_subparsers(required=True)
    x = sub.add_parser("analyze")
    for k in ("folder", "name", "path"):
        x.add_argument(k)
    x.add_argument("--jurisdiction", default="US")
    x.add_argument("--format", choices=["summary", "detailed", "json"], default="summary")
    x.set_defaults(run=analyze)
    for name, run in (("reason", reason), ("freeze", freeze)):
        x = sub.add_parser(name)
        x.add_argument("path")
        x.add_argument("claim")
        if name == "freeze":
            x.add_argument("out")
        x.add_argument("--jurisdiction", default="US-FED")
        x.add_argument("--config")
        x.add_argument("--tmax", type=int, default=1)
        x.add_argument("--year", type=int, default=date.today().year, help="year from which precedents age")
        x.set_defaults(run=run)
    x = sub.add_parser("graph")
    x.add_argument("path")
    x.add_argument("out")
    x.add_argument("--jurisdiction", default="US-CA")
    x.set_defaults(run=graph)
    x = sub.add_parser("check")
    x.add_argument("path")
    x.set_defaults(run=check)
    a = p.parse_args(args)
    if not any(c in a.path for c in "*?[{:") and not Path(a.path).exists():
        print(f"can't read {a.path}", file=sys.stderr)
        return 2
    spark = None if a.run is check else SparkSession.builder.appName("verdigraph").getOrCreate()
    try:
        a.run(spark, a)
    except SystemExit as e:
        return int(e.code or 0)
    except Exception as e:
        print(e, file=sys.stderr)
        return 3
    return 0


if __name__ == "__main__":
    sys.exit(main())
