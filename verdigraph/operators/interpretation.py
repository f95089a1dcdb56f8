"""What a run derived: facts, trace and supports as tables, with exports, redaction and comparison."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigraph.errors import StatementError
from verdigraph.operators.derive import updates
from verdigraph.operators.temporal import Convergence, run
from verdigraph.plans.rules import Rule, in_order
from verdigraph.sources.graph import Graph

STATEMENT = r"^\s*([A-Za-z0-9_]+)\s*\(\s*([^)]+)\s*\)\s*$"


def statement(label: str = "label", arg0: str = "arg0", arg1: str = "arg1") -> Column:
    """Label(arg0) or Label(arg0,arg1)."""
    return F.concat(F.col(label), F.lit("("), F.concat_ws(",", arg0, arg1), F.lit(")"))


def parse_statement(text: Column) -> Column:
    """struct<label, arg0, arg1> of a statement with one or two arguments; null for anything else."""
    args = F.transform(F.split(F.regexp_extract(text, STATEMENT, 2), ","), lambda x: F.trim(x))
    parsed = F.struct(F.regexp_extract(text, STATEMENT, 1).alias("label"), F.get(args, F.lit(0)).alias("arg0"), F.get(args, F.lit(1)).alias("arg1"))
    return F.when(F.regexp_like(text, F.lit(STATEMENT)) & F.size(args).isin(1, 2), parsed)


def by_arity(statements: DataFrame, column: str = "statement") -> tuple[DataFrame, DataFrame]:
    """Node statements (label, id) and edge statements (label, u, v); others are dropped."""
    p = statements.select(parse_statement(F.col(column)).alias("p")).filter("p IS NOT NULL")
    nodes = p.filter("p.arg1 IS NULL").select("p.label", F.col("p.arg0").alias("id"))
    return nodes, p.filter("p.arg1 IS NOT NULL").select("p.label", F.col("p.arg0").alias("u"), F.col("p.arg1").alias("v"))


@dataclass(frozen=True)
class Interpretation:
    """facts(label, arg0, arg1, l, u), trace(t, rule_id, head, delta, static, clauses), supports(statement, rule_id, clause)."""

    facts: DataFrame
    trace: DataFrame
    supports: DataFrame
    converged: bool | None = None
    last: int = 0

    def table(self) -> DataFrame:
        """(statement, lower, upper)."""
        return self.facts.select(statement().alias("statement"), F.col("l").alias("lower"), F.col("u").alias("upper"))

    def jsonl(self) -> DataFrame:
        """value: one JSON object a line, keys and lines in order."""
        line = F.to_json(F.struct("lower", "statement", "upper")).alias("value")
        return self.table().orderBy("statement").select(line)

    def write_jsonl(self, path: str) -> None:
        self.jsonl().write.mode("overwrite").text(path)

    @staticmethod
    def from_pairs(spark: SparkSession, pairs: list[tuple[str, tuple[float, float]]]) -> Interpretation:
        """Facts from (statement, (lower, upper)) pairs; text that is no statement with one or two arguments raises."""
        found = spark.createDataFrame([(s, float(l), float(u)) for s, (l, u) in pairs], "s string, l double, u double").withColumn("p", parse_statement(F.col("s")))
        if wrong := found.filter("p IS NULL").select("s").head(1):
            raise StatementError(f"no statement: {wrong[0]['s']}")
        facts = found.select("p.label", "p.arg0", "p.arg1", "l", "u")
        empty = facts.sparkSession.createDataFrame
        return Interpretation(facts, empty([], "t int, rule_id string, head string, delta int, static boolean, clauses int"), empty([], "statement string, rule_id string, clause int, kind string, label string"))

    def as_dict(self) -> dict:
        """facts by statement, supports by statement and trace, collected: for results that fit the driver."""
        supports: dict[str, list[dict]] = {}
        for r in self.supports.collect():
            own = r.asDict()
            supports.setdefault(own.pop("statement"), []).append(own)
        return {"facts": {r["statement"]: (r["lower"], r["upper"]) for r in self.table().collect()}, "supports": supports, "trace": [r.asDict() for r in self.trace.collect()]}

    def export(self, profile: str = "default_profile", blocked: list[str] | None = None) -> dict[str, DataFrame]:
        """Facts without blocked labels; only audit_profile (or audit) also shows supports and trace, without blocked labels as well."""
        facts = redact(self.facts, blocked or [])
        shown = Interpretation(facts, self.trace, self.supports).table()
        if profile not in ("audit_profile", "audit"):
            return {"facts": shown}
        names = list(dict.fromkeys(b.strip() for b in blocked or [] if b.strip()))

        def allowed(text: str) -> Column:
            return ~F.regexp_extract(text, STATEMENT, 1).isin(*names) if names else F.lit(True)

        return {"facts": shown, "supports": self.supports.filter(allowed("statement")), "trace": self.trace.filter(allowed("head"))}


def redact(facts: DataFrame, blocked: list[str]) -> DataFrame:
    """Facts whose label isn't blocked."""
    names = list(dict.fromkeys(b.strip() for b in blocked if b.strip()))
    return facts.filter(~F.col("label").isin(*names)) if names else facts


def blocklist(redaction: dict) -> list[str]:
    """Blocked labels of a redaction policy, nested ones first, each once."""
    nested = redaction.get("redact") if isinstance(redaction.get("redact"), dict) else {}
    return list(dict.fromkeys(str(x).strip() for x in [*(nested.get("labels_blocklist") or []), *(redaction.get("labels_blocklist") or [])] if str(x).strip()))


def reason(rules: list[Rule], graph: Graph, tmax: int = 1, mode: str = "intersection", convergence: Convergence = Convergence(), emit_facts: bool = True) -> Interpretation:
    """Fire all rules over the graph's labels and run their updates through time."""
    scheduled = updates(rules, graph)
    valid = in_order(rules)
    labels = [x for r in valid for x in ([r.target, r.infer_label.strip()] if r.kind == "edge" and r.infer_edges else [r.target])]
    ran = run(scheduled, tmax, mode, convergence, emit_facts, max([0, *(r.delta for r in valid)]), len(set(labels)) == len(labels))
    trace = scheduled.filter("emit = 0").select("source", "delta", "static", statement().alias("head"))
    spark = scheduled.sparkSession
    clauses = spark.createDataFrame([(r.id, i, c.kind, c.label, r.delta) for r in valid for i, c in enumerate(r.clauses)], "rule_id string, clause int, kind string, label string, delta int")
    sizes = clauses.groupBy("rule_id").agg(F.count("*").cast("int").alias("clauses"))
    steps = F.explode(F.sequence(F.lit(0), F.lit(max(0, ran.last)))).alias("t")
    traced = trace.join(F.broadcast(sizes), F.col("source") == F.col("rule_id"), "left").select(steps, F.col("source").alias("rule_id"), "head", "delta", "static", F.coalesce("clauses", F.lit(0)).alias("clauses"))
    supports = trace.join(F.broadcast(clauses), F.col("source") == F.col("rule_id")).select(F.col("head").alias("statement"), "rule_id", "clause", "kind", "label")
    return Interpretation(ran.facts, traced, supports, ran.converged, ran.last)


def compare(left: DataFrame, right: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """(statement, status) for every difference of two (statement, lower, upper) tables: left_only, right_only or differs."""
    met = left.alias("a").join(right.alias("b"), "statement", "full_outer")
    apart = (F.abs(F.col("a.lower") - F.col("b.lower")) > tolerance) | (F.abs(F.col("a.upper") - F.col("b.upper")) > tolerance)
    status = F.when(F.col("b.lower").isNull(), "left_only").when(F.col("a.lower").isNull(), "right_only").when(apart, "differs")
    return met.select("statement", status.alias("status")).filter("status IS NOT NULL")


def previous_values(history: DataFrame) -> DataFrame:
    """A timeline with each statement's interval at the step before ([0, 1] at first) and whether it changed."""
    from pyspark.sql import Window

    w = Window.partitionBy("label", "arg0", "arg1").orderBy("t")
    out = history.withColumn("prev_l", F.coalesce(F.lag("l").over(w), F.lit(0.0))).withColumn("prev_u", F.coalesce(F.lag("u").over(w), F.lit(1.0)))
    return out.withColumn("has_changed", (F.col("l") != F.col("prev_l")) | (F.col("u") != F.col("prev_u")))
