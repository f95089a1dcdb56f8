"""Domain plugins: providers of ontology, extraction, rules, explanations and checks, found by a manifest."""

from __future__ import annotations

import importlib.util
import sys
from abc import ABC, abstractmethod
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigraph.errors import PluginError
from verdigraph.operators.extract import extract_citations, standard_form
from verdigraph.operators.hyper import BROADCAST_ROWS, FACTS, forward_chain_exact, rules_as_edges
from verdigraph.sources.scratch import maybe_broadcast, settle

RULES = "id string, rule_type string, priority int, authority string, premises array<string>, conclusions array<string>, rule_text string, confidence double, jurisdiction string, valid_from timestamp, valid_to timestamp, authority_level string, seq long"


class OntologyProvider(ABC):
    @abstractmethod
    def classes(self) -> list[dict[str, Any]]: ...

    @abstractmethod
    def properties(self) -> list[dict[str, Any]]: ...

    @abstractmethod
    def constraints(self) -> list[dict[str, Any]]: ...


class MappingProvider(ABC):
    """Each method maps documents (doc_id, text, ...) to rows of what is found in them."""

    @abstractmethod
    def extract_entities(self, docs: DataFrame) -> DataFrame: ...

    @abstractmethod
    def extract_relations(self, docs: DataFrame) -> DataFrame: ...

    @abstractmethod
    def extract_obligations(self, docs: DataFrame) -> DataFrame: ...


class RuleProvider(ABC):
    """Each method returns rules as a table (RULES)."""

    @abstractmethod
    def statutory_rules(self) -> DataFrame: ...

    @abstractmethod
    def case_law_rules(self) -> DataFrame: ...

    @abstractmethod
    def exception_rules(self) -> DataFrame: ...


class Explainer(ABC):
    """Each method renders rows of explain() for one kind of reader: a `text` for each conclusion."""

    @abstractmethod
    def statutory_explanation(self, traced: DataFrame) -> DataFrame: ...

    @abstractmethod
    def precedential_explanation(self, traced: DataFrame) -> DataFrame: ...


class ValidationProvider(ABC):
    """Each method returns rows of errors (doc_id, message)."""

    @abstractmethod
    def validate_extraction(self, entities: DataFrame) -> DataFrame: ...

    @abstractmethod
    def validate_reasoning(self, conclusions: DataFrame) -> DataFrame: ...


CAPABILITIES = {"ontology": OntologyProvider, "mapping": MappingProvider, "rules": RuleProvider, "explainer": Explainer, "validator": ValidationProvider}


@dataclass(frozen=True)
class Manifest:
    schema: str
    id: str
    version: str
    displayName: str
    domains: list[str]
    jurisdictions: list[dict[str, Any]]
    capabilities: dict[str, Any]
    optional: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def read(cls, path: Path) -> Manifest:
        data = yaml.safe_load(path.read_text(encoding="utf-8"))
        needed = ("schema", "id", "version", "displayName", "domains", "jurisdictions", "capabilities")
        if lacking := [k for k in needed if k not in (data or {})]:
            raise PluginError(f"{path}: no {', '.join(lacking)}")
        return cls(**{k: data[k] for k in needed}, optional={k: v for k, v in data.items() if k not in needed})


@dataclass(frozen=True)
class Plugin:
    manifest: Manifest
    instance: Any

    def provides(self, capability: str) -> bool:
        return isinstance(self.instance, CAPABILITIES[capability])


class PluginLoader:
    """Plugins in the folders of a directory, each with plugin.yaml and a module whose Plugin class has no arguments."""

    def __init__(self, folder: str):
        self.folder, self.loaded = Path(folder), {}

    def discover(self) -> list[str]:
        return sorted(p.parent.name for p in self.folder.glob("*/plugin.yaml"))

    def load(self, name: str) -> Plugin:
        """Load a plugin once; ValueError if it lacks a capability that its manifest claims."""
        if name in self.loaded:
            return self.loaded[name]
        at = self.folder / name
        manifest = Manifest.read(at / "plugin.yaml")
        spec = importlib.util.spec_from_file_location(f"verdigraph_plugin_{name}", at / "plugin.py")
        module = importlib.util.module_from_spec(spec)
        sys.modules[spec.name] = module
        spec.loader.exec_module(module)
        plugin = Plugin(manifest, module.Plugin())
        for claimed in manifest.capabilities.get("provides", []):
            if claimed in CAPABILITIES and not plugin.provides(claimed):
                raise PluginError(f"plugin {manifest.id} says that it provides {claimed}, but doesn't")
        self.loaded[name] = plugin
        return plugin

    def unload(self, name: str) -> bool:
        return self.loaded.pop(name, None) is not None

    def reload(self, name: str) -> Plugin:
        self.unload(name)
        return self.load(name)

    def with_capability(self, capability: str) -> list[Plugin]:
        return [p for p in self.loaded.values() if p.provides(capability)]

    def for_jurisdiction(self, code: str) -> list[Plugin]:
        return [p for p in self.loaded.values() if any(j.get("code") == code for j in p.manifest.jurisdictions)]


def analyze(docs: DataFrame, plugin: Plugin, context: dict[str, Any] | None = None) -> dict[str, DataFrame]:
    """What is found in documents (doc_id, text), and what follows from it, as tables:

    entities         the plugin's, with doc_id, entity_group and, where one stands for a fact, statement, score and
                     seq, its place in the order in which facts are told (without seq: statements go by their bytes)
    citations        doc_id, type, raw, start, end, standard_form, confidence
    facts            one for each statement found, as forward chaining reads them
    original_facts   scope, statement, confidence and the entity_type that stands for it
    derived_facts    scope, statement, confidence, rule_id, rule_authority, rule_text, step
    conclusions      scope, id, confidence, edge_id, step: the chaining itself, by document
    """
    entities = plugin.instance.extract_entities(docs)
    place = F.min("seq" if "seq" in entities.columns else "statement").alias("place")
    surest = F.max_by("entity_group", F.struct("score", "entity_group")).alias("entity_type")
    stated = entities.filter("statement IS NOT NULL").groupBy("doc_id", "statement").agg(F.max("score").alias("confidence"), place, surest)
    stated = stated.withColumn("seq", F.row_number().over(Window.partitionBy("doc_id").orderBy("place", "statement")).cast("long")).withColumn("scope", F.col("doc_id").cast("string"))
    stated = settle(stated, "stated")
    facts = stated.select("scope", F.col("statement").alias("id"), F.lit("Fact").alias("type"), "statement", "confidence", "seq")
    rules = plugin.instance.statutory_rules().unionByName(plugin.instance.case_law_rules()).unionByName(plugin.instance.exception_rules())
    edges = rules_as_edges(rules)
    conclusions = forward_chain_exact(facts, edges, context)
    basis = edges.select("edge_id", "rule_id", F.col("authority").alias("rule_authority"), "rule_text")
    return {
        "entities": entities,
        "citations": standard_form(extract_citations(docs)).drop("groups"),
        "facts": facts,
        "original_facts": stated.select("scope", "statement", "confidence", "entity_type"),
        "derived_facts": conclusions.join(maybe_broadcast(basis, BROADCAST_ROWS), "edge_id").select("scope", F.col("id").alias("statement"), "confidence", "rule_id", "rule_authority", "rule_text", "step"),
        "conclusions": conclusions,
    }


def analysis_report(docs: DataFrame, found: dict[str, DataFrame], context: dict[str, Any] | None = None) -> DataFrame:
    """(doc_id, value): an analyze() result as one JSON object for each document, those in which nothing was found included.

    entities, citations, original_facts and derived_facts are lists (in order
    of the text, of their names, or of derivation), conclusions are the
    derived facts with their legal basis; context is given as it is.
    """

    def listed(rows: DataFrame, key: str, name: str, order: list[Column], **fields: Column) -> DataFrame:
        item = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.struct(*[c.alias(k) for k, c in fields.items()]).alias("item"))
        return rows.groupBy(F.col(key).cast("string").alias("doc_id")).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["item"]).alias(name))

    def own(rows: DataFrame, name: str, kind: str) -> Column:
        return F.col(name) if name in rows.columns else F.lit(None).cast(kind)

    e, c, d = found["entities"], found["citations"], found["derived_facts"]
    parts = [
        listed(e, "doc_id", "entities", [own(e, "start", "int"), F.col("entity_group")], type=F.col("entity_group"), text=own(e, "word", "string"), start=own(e, "start", "int"), end=own(e, "end", "int"), confidence=own(e, "score", "double")),
        listed(c, "doc_id", "citations", [F.col("start"), F.col("end"), F.col("type")], text=F.col("raw"), start=F.col("start"), end=F.col("end"), citation_type=F.col("type"), normalized=F.col("standard_form")),
        listed(found["original_facts"], "scope", "original_facts", [F.col("statement")], statement=F.col("statement"), entity_type=F.col("entity_type")),
        listed(d, "scope", "derived_facts", [F.col("step")], statement=F.col("statement"), rule_authority=F.col("rule_authority")),
        listed(d, "scope", "conclusions", [F.col("step")], conclusion=F.col("statement"), legal_basis=F.col("rule_authority"), confidence=F.col("confidence"), reason=F.col("rule_text")),
    ]
    out = docs.select(F.col("doc_id").cast("string").alias("doc_id")).distinct()
    for part in parts:
        out = out.join(part, "doc_id", "left")
    names = [p.columns[1] for p in parts]
    filled = [F.coalesce(F.col(n), F.array().cast(p.schema[n].dataType)).alias(n) for n, p in zip(names, parts)]
    said = [F.lit(str(v)).alias(k) for k, v in sorted((context or {}).items())]
    return out.select("doc_id", F.to_json(F.struct("doc_id", *filled, *([F.struct(*said).alias("context")] if said else []))).alias("value"))


__all__ = ["CAPABILITIES", "FACTS", "RULES", "Explainer", "Manifest", "MappingProvider", "OntologyProvider", "Plugin", "PluginLoader", "RuleProvider", "ValidationProvider", "analysis_report", "analyze"]
