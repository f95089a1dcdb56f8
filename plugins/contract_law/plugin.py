"""A sample plugin: what makes a contract, found by patterns, and when it is breached, by two rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigraph.operators.extract import extract_obligations as obligations
from verdigraph.plugins import RULES, Explainer, MappingProvider, OntologyProvider, RuleProvider, ValidationProvider

#: entity group, pattern, the fact it stands for
SIGNS = [
    ("OFFER", r"(?i)\boffer(?:s|ed)?\b", "offer_made"),
    ("ACCEPTANCE", r"(?i)\baccept(?:s|ed|ance)?\b", "offer_accepted"),
    ("CONSIDERATION", r"(?i)\b(?:consideration|in exchange for|pays?|paid)\b", "consideration_given"),
    ("BREACH", r"(?i)\b(?:breach(?:es|ed)?|fail(?:s|ed) to (?:perform|deliver|pay))\b", "obligation_unmet"),
]


class Plugin(OntologyProvider, MappingProvider, RuleProvider, ValidationProvider, Explainer):
    def classes(self):
        return [{"name": group, "fact": fact} for group, _, fact in SIGNS]

    def properties(self):
        return [{"name": "evidences", "domain": "Entity", "range": "Fact"}]

    def constraints(self):
        return [{"on": "Entity", "requires": "score between 0 and 1"}]

    def extract_entities(self, docs: DataFrame) -> DataFrame:
        found = [F.when(F.regexp_like("text", F.lit(p)), F.struct(F.lit(g).alias("entity_group"), F.regexp_substr("text", F.lit(p)).alias("word"), F.lit(s).alias("statement"), F.lit(0.9).alias("score"), F.lit(i).alias("seq"))) for i, (g, p, s) in enumerate(SIGNS)]
        return docs.select("doc_id", F.explode(F.array_compact(F.array(*found))).alias("e")).select("doc_id", "e.*")

    def extract_relations(self, docs: DataFrame) -> DataFrame:
        return self.extract_entities(docs).select("doc_id", F.lit("evidences").alias("relation"), F.col("entity_group").alias("src"), F.col("statement").alias("dst"))

    def extract_obligations(self, docs: DataFrame) -> DataFrame:
        return obligations(docs)

    def _rules(self, rows: list[tuple]) -> DataFrame:
        return SparkSession.active().createDataFrame(rows, RULES)

    def statutory_rules(self) -> DataFrame:
        formed = ["offer_made", "offer_accepted", "consideration_given"]
        return self._rules([("formation", "statutory", 100, "Restatement (Second) of Contracts § 17", formed, ["contract_formed"], "offer, acceptance and consideration form a contract", 0.95, "US", None, None, "federal", 1)])

    def case_law_rules(self) -> DataFrame:
        return self._rules([("breach", "case_law", 100, "Hadley v. Baxendale", ["contract_formed", "obligation_unmet"], ["damages_due"], "breach of a contract gives damages", 0.9, "US", None, None, "state", 2)])

    def exception_rules(self) -> DataFrame:
        return self._rules([])

    def validate_extraction(self, entities: DataFrame) -> DataFrame:
        return entities.filter(~F.col("score").between(0, 1)).select("doc_id", F.lit("score out of range").alias("message"))

    def validate_reasoning(self, conclusions: DataFrame) -> DataFrame:
        return conclusions.filter("confidence IS NULL").select(F.col("scope").alias("doc_id"), F.lit("no confidence").alias("message"))

    def statutory_explanation(self, traced: DataFrame) -> DataFrame:
        return traced.groupBy("scope", "conclusion").agg(F.concat_ws("; ", F.array_sort(F.collect_set("premise"))).alias("text"))

    def precedential_explanation(self, traced: DataFrame) -> DataFrame:
        return self.statutory_explanation(traced.filter("leaf"))
