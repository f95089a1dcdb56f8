"""Policy vectors, configuration checks, and forward chaining against an independent loop."""

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from verdigraph.operators.authority import alignment, authority_sums, edge_authority, edge_metadata, graph_multipliers, lineages, lookup, multipliers, recency
from verdigraph.operators.hyper import FACTS, confidence, contexts_apply, explain, explanations, forward_chain_exact, forward_chain_rounds, missing_premises, resolve_conflicts
from verdigraph.plans.library import rules_for_claim, scale
from verdigraph.plans.policy import burden_for, clause_weights, label_filter, lineage, style_for, styled
from verdigraph.plugins import RULES
from verdigraph.operators.hyper import rules_as_edges
from verdigraph.sources.config import check_all, read_config
from verdigraph.sources.graph import graphml_tables

COURTS, BURDEN, PREFS, PRECEDENT = (read_config(f"config/{n}.yaml") for n in ("courts", "burden", "statutory_prefs", "precedent_weights"))


def test_lineage():
    chain = {"hierarchy": {"US-CA": ["US-FED"], "US-FED": ["INTL"]}}
    assert lineage(chain, "US-CA") == ["US-CA", "US-FED", "INTL"]
    assert lineage(chain, "US-NY") == ["US-NY"] and lineage({}, "") == []
    assert lineage({"hierarchy": {"A": ["B"], "B": ["A"]}}, "A") == ["A", "B"]


@pytest.mark.parametrize("claim, where, want", [
    ("punitive_damages", "US-CA", "clear_075"), ("criminal", "US-FED", "criminal_090"), ("breach_of_contract", "US-TX", "civil_051"), ("anything", "US-FED", "criminal_090"),
])
def test_burden(claim, where, want):
    assert burden_for(claim, where, BURDEN) == f"legal_burden_{want}"


def test_global_and_bad_burdens():
    cfg = {"DEFAULT_BURDEN": 0.51, "BURDEN_OVERRIDES": {"GLOBAL": {"fraud": 0.75}, "X": {"fraud": "much", "civil": 0.9}}}
    assert burden_for("fraud", "US-NY", cfg) == "legal_burden_clear_075"
    assert burden_for("fraud", "X", cfg) == "legal_burden_criminal_090"


def test_styles():
    base = clause_weights(COURTS)
    assert base == pytest.approx([0.6, 0.3, 0.1])
    assert styled(base, "textualism") == pytest.approx([0.6 / 0.97, 0.27 / 0.97, 0.1 / 0.97])
    assert styled(base, "purposivism") == pytest.approx([0.6 / 1.03, 0.33 / 1.03, 0.1 / 1.03])
    assert styled(base, "lenity") == pytest.approx([0.6 / 1.01, 0.3 / 1.01, 0.11 / 1.01])
    assert styled(base, "") == pytest.approx(base)
    assert style_for("x", "US-CA", PREFS, COURTS) == "purposivism" and style_for("breach_of_contract", "US-CA", PREFS, COURTS) == "textualism"
    parents = {"default_style": "textualism", "style_overrides": {"US-FED": {"default": "purposivism"}}}
    assert style_for("x", "US-CA", parents, COURTS) == "purposivism"


def test_rules_for_claim():
    rules = rules_for_claim("fraud", "US-NY", courts=COURTS, burden=BURDEN, prefs=PREFS)
    top = rules[0]
    assert len(rules) == 6 and top.target == "support_for_fraud" and top.aggregate == "legal_burden_clear_075" and sum(top.weights) == pytest.approx(1)
    assert rules_for_claim("fraud", conservative=True)[0].aggregate == "legal_conservative_min"
    assert rules_for_claim("fraud", weights=[1, 2, 3])[0].weights == (1, 2, 3)
    assert scale([0.5, 0.3, 0.2], [1, 0, 0]) == [1, 0, 0] and scale([0.5, 0.5], None) == [0.5, 0.5] and scale([0.5, 0.5], [0, 0]) == [0.5, 0.5]


def test_rule_selection_prefers_the_nearer():
    courts = {"hierarchy": {"US-CA": ["US-FED"]}, "rule_overrides": {"US-CA": {"exclude_labels": ["a"], "include_labels": ["b"]}, "US-FED": {"include_labels": ["a", "c"], "exclude_labels": ["b"]}}}
    assert label_filter(courts, "US-CA") == ({"b", "c"}, {"a"})


def test_configuration_checks():
    good = {"courts": COURTS, "burden": BURDEN, "statutory_prefs": PREFS, "precedent_weights": PRECEDENT}
    assert check_all(good) == []
    bad = {"courts": {"weights": {"controlling": -1}, "hierarchy": {"A": "B"}}, "burden": {"DEFAULT_BURDEN": 2, "BURDEN_OVERRIDES": {"X": {"y": "z"}}}, "statutory_prefs": {"default_style": "vibes"}, "precedent_weights": {"recency": {"min_multiplier": 3}}, "redaction": {"patterns": [{"regex": "(", "action": "burn"}]}}
    assert len(check_all(bad)) == 8
    with pytest.raises(ValueError):
        check_all(bad, strict=True)


def test_authority_factor(spark):
    line = F.array().cast("array<string>")
    factor = lookup(PRECEDENT["treatment_modifier"], F.lit("followed")) * recency(F.lit(1992), 2002, PRECEDENT["recency"]) * alignment(F.lit(""), F.lit("X"), line, line, {}) * lookup(PRECEDENT["court_levels"], F.lit("US_SCOTUS"))
    assert spark.range(1).select(factor.alias("f")).first()["f"] == pytest.approx(0.54)
    neutral = spark.createDataFrame([("controlling", 1.0), ("persuasive", 1.0)], "class string, authority double")
    assert list(multipliers(neutral).first()) == [1, 1, 1e-9]
    assert list(multipliers(neutral.limit(0)).first()) == [1, 1, 1]
    lookups = [recency(F.lit(None).cast("int"), 2002, {}), recency(F.lit(1900), 2002, {"half_life_years": 0}), recency(F.lit(2050), 2002, {})]
    assert list(spark.range(1).select(*lookups).first()) == [1, 1, 1]


def test_alignment_kinds(spark):
    rows = [("A", "A", [], [], 1.0), ("A", "F", ["F"], [], 0.9), ("F", "A", [], ["F"], 0.9), ("A", "B", ["F"], ["F"], 0.85), ("A", "Z", ["F"], ["Y"], 0.75), (None, "Z", None, None, 1.0), ("A", "B", None, None, 0.75)]
    df = spark.createDataFrame(rows, "s string, d string, sl array<string>, dl array<string>, w double")
    got = df.select("w", alignment(F.col("s"), F.col("d"), F.col("sl"), F.col("dl"), PRECEDENT["jurisdiction_alignment"]).alias("m")).collect()
    assert [r["m"] for r in got] == [r["w"] for r in got]


def test_lineage_table_ends_on_cycles(spark):
    got = {(r["jurisdiction"], r["ancestor"], r["distance"]) for r in lineages(spark.createDataFrame([("A", "B"), ("B", "A"), ("C", "A")], "child string, parent string")).collect()}
    assert got == {("A", "A", 0), ("A", "B", 1), ("B", "B", 0), ("B", "A", 1), ("C", "C", 0), ("C", "A", 1), ("C", "B", 2)}


def test_edge_metadata_counts_none_as_present(spark):
    df = spark.createDataFrame([("a", "b", {"cites": "none", "same_issue": "0", "year": "x"})], "u string, v string, attrs map<string,string>")
    assert [(r["label"], r["year"]) for r in edge_metadata(df).collect()] == [("cites", None)]


# -- chaining ---------------------------------------------------------------------


def rules_table(spark, rows):
    full = [(i, "statutory", p, "auth", pre, con, "", c, j, since, None, level, n) for n, (i, p, pre, con, c, j, since, level) in enumerate(rows)]
    return rules_as_edges(spark.createDataFrame(full, RULES))


def facts_table(spark, rows):
    return spark.createDataFrame([("s", i, "Fact", t, c, n) for n, (i, t, c) in enumerate(rows)], FACTS)


def derived(df):
    return {(r["id"], r["edge_id"]): r["confidence"] for r in df.collect()}


BOTH = [forward_chain_rounds, forward_chain_exact]


@pytest.mark.parametrize("chain", BOTH)
def test_chain_and_confidence(spark, chain):
    facts = facts_table(spark, [("f1", "P", 0.9), ("f2", "P", 0.7), ("f3", "Q", 0.8)])
    rules = rules_table(spark, [("r1", 100, ["P", "f3"], ["R1"], 0.95, None, None, None), ("r2", 100, ["R1"], ["R2"], 0.6, None, None, None), ("r3", 100, ["R1", "missing"], ["R3"], 1.0, None, None, None)])
    assert derived(chain(facts, rules)) == {("R1", "r1"): 0.8, ("R2", "r2"): 0.6}
    wgm = derived(chain(facts, rules, aggregator="wgm"))
    assert wgm["R1", "r1"] == pytest.approx((0.9 * 0.8) ** 0.4 * 0.95**0.2)


@pytest.mark.parametrize("chain", BOTH)
@pytest.mark.parametrize("a, b, winner", [
    ((100, ["P"], None, None, "federal"), (100, ["P"], None, None, "state"), "r1"), ((100, ["P"], None, None, "local"), (100, ["P"], None, None, "state"), "r2"),
    ((100, ["P"], None, None, None), (100, ["P", "Q"], None, None, None), "r2"), ((100, ["P"], None, datetime(2001, 1, 1), None), (100, ["P"], None, datetime(2010, 1, 1), None), "r2"),
    ((100, ["P"], None, None, None), (101, ["P"], None, None, None), "r2"), ((100, ["P"], None, None, None), (100, ["P"], None, None, None), "r1"),
])
def test_conflicts(spark, chain, a, b, winner):
    facts = facts_table(spark, [("p", "P", 1.0), ("q", "Q", 1.0)])
    rules = rules_table(spark, [(f"r{n}", x[0], x[1], ["H"], 1.0, x[2], x[3], x[4]) for n, x in enumerate((a, b), 1)])
    assert derived(chain(facts, rules)) == {("H", winner): 1.0}


@pytest.mark.parametrize("chain", BOTH)
def test_a_rule_must_win_every_head_and_not_derive_what_is_known(spark, chain):
    facts = facts_table(spark, [("p", "P", 1.0), ("x", "KNOWN", 1.0)])
    rules = rules_table(spark, [("two", 100, ["P"], ["A", "B"], 1.0, None, None, None), ("best", 200, ["P"], ["B"], 1.0, None, None, None), ("known", 100, ["P"], ["KNOWN", "x"], 1.0, None, None, None)])
    assert derived(chain(facts, rules)) == {("B", "best"): 1.0}


def test_context(spark):
    facts = facts_table(spark, [("p", "P", 1.0)])
    rules = rules_table(spark, [("us", 1, ["P"], ["US"], 1.0, "US", None, None), ("uk", 1, ["P"], ["UK"], 1.0, "UK", None, None), ("new", 1, ["P"], ["NEW"], 1.0, None, datetime(2020, 1, 1), None)])
    got = derived(forward_chain_exact(facts, rules, {"jurisdiction": "US-CA", "valid_from": datetime(2010, 1, 1)}))
    assert set(got) == {("US", "us")}


def slow_chain(facts, rules):
    """Agenda chaining over plain lists, written apart from the library's."""
    known, agenda, fired, out = dict(facts), list(dict(facts)), set(), {}
    while agenda:
        at = agenda.pop(0)
        for r in rules:
            if at not in r["pre"] or r["id"] in fired or not all(p in known for p in r["pre"]):
                continue
            ready = [x for x in rules if all(p in known for p in x["pre"])]
            best = {h: sorted((x for x in ready if h in x["con"]), key=lambda x: (-len(x["pre"]), -x["pri"], rules.index(x)))[0]["id"] for h in r["con"]}
            if set(best.values()) != {r["id"]}:
                continue
            c = min([known[p] for p in r["pre"]] + [r["c"]])
            for h in r["con"]:
                if h not in known:
                    known[h] = c
                    out[h, r["id"]] = c
                    agenda.append(h)
            fired.add(r["id"])
    return out


@pytest.mark.parametrize("seed", range(5))
def test_exact_chaining_is_the_loop(spark, seed):
    rng = random.Random(seed)
    names = list("abcdefgh")
    facts = [(x, round(rng.uniform(0.1, 1), 3)) for x in rng.sample(names, 3)]
    rules = [{"id": f"r{i}", "pre": rng.sample(names, rng.randint(1, 2)), "con": rng.sample(names, rng.choice([1, 1, 2])), "pri": rng.choice([1, 2]), "c": round(rng.uniform(0.3, 1), 3)} for i in range(12)]
    table = rules_table(spark, [(r["id"], r["pri"], r["pre"], r["con"], r["c"], None, None, None) for r in rules])
    assert derived(forward_chain_exact(facts_table(spark, [(x, x, c) for x, c in facts]), table)) == slow_chain(facts, rules)


def test_explanations(spark):
    facts = facts_table(spark, [("p", "P", 0.9), ("q", "Q", 0.5)])
    rules = rules_table(spark, [("r1", 1, ["P"], ["M"], 0.8, None, None, None), ("r2", 1, ["M", "Q"], ["H"], 1.0, None, None, None), ("back", 1, ["H"], ["M"], 0.1, None, None, None)])
    more = forward_chain_exact(facts, rules).select("scope", "id", F.lit("Fact").alias("type"), F.col("id").alias("statement"), "confidence", F.lit(9).cast("long").alias("seq"))
    every = facts.unionByName(more)
    asked = spark.createDataFrame([("s", "H")], "scope string, id string")
    traced = explain(every, rules, asked)
    assert {(r["edge_id"], r["premise"], r["depth"], r["leaf"]) for r in traced.collect()} == {("r2", "M", 1, False), ("r2", "Q", 1, True), ("r2", "P", 2, True)}
    (row,) = explanations(traced, rules).collect()
    assert (row["path_confidence"], row["confidence"], row["authority"]) == (0.5, 0.5, "auth")


def test_missing_and_resolver_and_contexts(spark):
    facts = facts_table(spark, [("p", "P", 1.0)])
    rules = rules_table(spark, [("r1", 1, ["P", "Z"], ["M"], 0.8, None, None, None)])
    assert [tuple(r) for r in missing_premises(rules, facts).collect()] == [("s", "r1", "Z")]
    rows = [("a", "statutory", 1, "", ["x"], ["H"], "", 1.0, None, None, None, None, 0), ("b", "case_law", 900, "", ["x"], ["H"], "", 1.0, None, None, None, None, 1), ("c", "case_law", 1, "", ["x", "y"], ["K"], "", 1.0, None, None, None, None, 2), ("d", "case_law", 1, "", ["x"], ["K"], "", 1.0, None, datetime(2020, 1, 1), None, None, 3)]
    assert {tuple(r) for r in resolve_conflicts(spark.createDataFrame(rows, RULES)).collect()} == {("H", "b"), ("K", "c")}
    r = spark.createDataFrame([("r", "US", None, None)], "rule_id string, jurisdiction string, valid_from timestamp, valid_to timestamp")
    c = spark.createDataFrame([("in", "US-CA", None, None), ("out", "FR", None, None), ("any", None, None, None)], "context_id string, jurisdiction string, valid_from timestamp, valid_to timestamp")
    assert {x["context_id"] for x in contexts_apply(r, c).collect()} == {"in", "any"}
    assert spark.range(1).select(confidence(F.array().cast("array<double>"), F.lit(0.7), "wgm").alias("c")).first()["c"] == 0.7


def ladder(spark, n, scopes=1):
    """A chain of n rules, each from the conclusion of the one before, over facts k0 of each scope."""
    rules = spark.createDataFrame([(f"r{i}", "statutory", 100, "Act", [f"k{i}"], [f"k{i + 1}"], "", 0.9, None, None, None, None, i) for i in range(n)], RULES)
    return spark.range(scopes).select(F.concat(F.lit("s"), "id").alias("scope"), F.lit("k0").alias("id"), F.lit("Fact").alias("type"), F.lit("k0").alias("statement"), F.lit(0.8).alias("confidence"), F.lit(0).cast("long").alias("seq")), rules_as_edges(rules)


@pytest.mark.parametrize("chain", BOTH)
def test_long_chains_run_to_their_end(spark, chain):
    facts, edges = ladder(spark, 15)
    assert sorted(r["id"] for r in chain(facts, edges).collect()) == sorted(f"k{i}" for i in range(1, 16))


def test_chaining_raises_where_it_is_cut_short(spark):
    facts, edges = ladder(spark, 4)
    with pytest.raises(RuntimeError):
        forward_chain_rounds(facts, edges, most_rounds=2)


def test_explanation_of_a_ladder_over_many_scopes(spark):
    """Every rung has two rules over two premises, so paths double at each of 12 levels; only premises and levels are listed."""
    rows = [(f"{x}{i}", "statutory", 100, "Act", [f"a{i}", f"b{i}"], [f"a{i + 1}", f"b{i + 1}"], "", 0.9, None, None, None, None, i) for i in range(12) for x in "xy"]
    edges = rules_as_edges(spark.createDataFrame(rows, RULES))
    facts = spark.range(400).select(F.concat(F.lit("s"), "id").alias("scope"), F.explode(F.array(*[F.lit(f"{x}{i}") for x in "ab" for i in range(13)])).alias("id"))
    facts = facts.select("scope", "id", F.lit("Fact").alias("type"), F.col("id").alias("statement"), F.lit(0.8).alias("confidence"), F.lit(0).cast("long").alias("seq"))
    told = explain(facts, edges, facts.filter("id = 'a12'").select("scope", "id"))
    got = told.groupBy("edge_id", "premise", "depth", "leaf").agg(F.count("*").alias("n")).collect()
    assert {(r["edge_id"], r["premise"], r["depth"], r["leaf"]) for r in got} == {(f"{x}11", f"{p}{i}", 12 - i, i == 0) for x in "xy" for p in "ab" for i in range(12)}
    assert {r["n"] for r in got} == {400}


def test_rules_without_shared_conclusions_are_rivals(spark):
    rows = [("a", "case_law", 100, "", ["p"], [], "", 1.0, None, None, None, None, 0), ("b", "statutory", 100, "", ["p"], ["C"], "", 1.0, None, None, None, None, 1), ("c", "statutory", 100, "", ["p"], ["D"], "", 1.0, None, None, None, None, 2)]
    assert [tuple(r) for r in resolve_conflicts(spark.createDataFrame(rows, RULES)).collect()] == [(None, "b")]


def test_sums_are_those_of_single_edges(spark):
    edges = spark.createDataFrame([(f"u{i % 7}", "v", "cites", ["followed", "overruled", ""][i % 3], 1990 + i % 5) for i in range(60)], "u string, v string, label string, treatment string, year int")
    nodes = spark.createDataFrame([(f"u{i}", "", f"j{i % 3}") for i in range(5)] + [("v", "TOP", "j0")], "id string, court string, jurisdiction string")
    lines = spark.createDataFrame([("j1", ["j0"]), ("j2", [])], "jurisdiction string, line array<string>")
    cfg = {"treatment_modifier": {"followed": 1.1, "overruled": 0.2}, "court_levels": {"TOP": 1.5}}
    one = list(multipliers(edge_authority(edges, nodes, lines, cfg, 2020)).first())
    assert list(multipliers(authority_sums(edges, nodes, lines, cfg, 2020)).first()) == pytest.approx(one)


def test_multipliers_of_a_graph_file(spark, tmp_path):
    from verdigraph.cli import main

    (tmp_path / "g.graphml").write_text("""<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="directed">
      <node id="a"><data key="jurisdiction">US-CA</data></node><node id="b"><data key="jurisdiction">US-FED</data><data key="precedential">true</data></node>
      <edge source="a" target="b"><data key="cites">true</data><data key="treatment">followed</data></edge></graph></graphml>""")
    nodes, edges = graphml_tables(spark, str(tmp_path / "g.graphml"))
    got = graph_multipliers(nodes, edges, {"treatment_modifier": {"followed": 1.2}}, {"hierarchy": {"US-CA": ["US-FED"]}}, 2020)
    assert got == pytest.approx([1e-9, 1.2 * 0.9, 1e-9])
    assert main(["reason", str(tmp_path / "g.graphml"), "fraud", "--config", "config"]) == 0
    assert main(["freeze", str(tmp_path / "g.graphml"), "fraud", str(tmp_path / "out.json"), "--config", "config"]) == 0
    assert set(json.loads((tmp_path / "out.json").read_text())["interpretation"]) == {"facts", "supports", "trace"}


def test_checks_of_a_folder(tmp_path, capsys):
    from verdigraph.cli import main

    assert main(["check", "config"]) == 0 and "valid" in capsys.readouterr().out
    (tmp_path / "reporters.yml").write_text("canonical: {US: {names: [U.S.], patterns: ['U\\.?S']}, F: {names: [], patterns: ['(']}, G: 3}\nnormalization: []\n")
    assert main(["check", str(tmp_path)]) == 2
    said = capsys.readouterr().err.splitlines()
    assert said == ["reporters: canonical.F.names: no list, or an empty one", "reporters: canonical.F.patterns[0]: regex doesn't compile", "reporters: canonical.G: not a mapping"]
    (tmp_path / "reporters.yml").write_text("canonical: {}\nnormalization: 5\n")
    (tmp_path / "redaction.yaml").write_text("mode: other\npatterns: [{regex: 'a', action: burn}, 7]\n")
    (tmp_path / "courts.yml").write_text("- a list\n")
    (tmp_path / "burden.yml").write_text("a: [\n")
    assert main(["check", str(tmp_path)]) == 2
    said = capsys.readouterr().err
    for part in ("reporters: canonical: no mapping", "reporters: normalization: not a mapping", "redaction: mode", "redaction: patterns[0]: action", "redaction: patterns[1]: not a mapping", "courts: not a mapping", "burden: "):
        assert part in said


def random_scopes(spark, seed, scopes, rules):
    """Facts of some scopes and rules over a few keys, with ties of rank, statements that several facts say, and types that wait or never come up."""
    rng = random.Random(seed)
    keys = [f"k{i}" for i in range(9)]
    facts = []
    for s in range(scopes):
        for n in range(rng.randrange(1, 9)):
            k = rng.choice(keys)
            facts.append((f"s{s}", rng.choice([k, f"f{rng.randrange(6)}"]), rng.choice(["Fact", "Fact", "DerivedFact", "Other"]), rng.choice([k, k, None, "unasked"]), rng.choice([0.9, 0.8, 0.8, 0.7]), n))
    rows = [(f"r{i}", rng.choice(["statutory", "case_law"]), rng.choice([90, 100]), "", rng.sample(keys, rng.randrange(0 if i % 11 == 10 else 1, 4)), rng.sample(keys, rng.randrange(1, 3)), "", rng.choice([0.5, 0.85, 1.0]), None, rng.choice([None, datetime(2001, 1, 1)]), None, rng.choice(["federal", None]), i) for i in range(rules)]
    return spark.createDataFrame(facts, FACTS).repartition(4), rules_as_edges(spark.createDataFrame(rows, RULES))


def test_agenda_in_rounds_is_the_agenda_of_groups(spark, aggregator="wgm"):
    facts, edges = random_scopes(spark, 5, 500, 11)
    grouped = forward_chain_exact(facts, edges, aggregator=aggregator)
    rounds = forward_chain_exact(facts, edges, aggregator=aggregator, group_rows=0)
    plain = lambda df: sorted((r["scope"], r["step"], r["id"], round(r["confidence"], 9), r["edge_id"]) for r in df.collect())
    assert plain(rounds) == plain(grouped) and rounds.count() > 300


def test_one_scope_of_a_million_facts(spark):
    """Facts that rules name, in one scope, half of them stating the same: the groups' loop gives the same."""
    n = F.col("id")
    facts = spark.range(0, 1_000_000, 1, 8).select(F.lit("s").alias("scope"), F.concat(F.lit("f"), n).alias("id"), F.when(n % 5 == 0, "DerivedFact").otherwise("Fact").alias("type"), F.when(n % 2 == 0, "p").otherwise(F.concat(F.lit("q"), n % 7)).alias("statement"), (F.lit(0.5) + (n % 50) / 100).alias("confidence"), (F.lit(999_999) - n).alias("seq"))
    rows = [("a", "statutory", 100, "", ["q1", "q2"], ["x"], "", 0.9, None, None, None, None, 0), ("b", "statutory", 100, "", ["p", "x"], ["y", "z"], "", 0.95, None, None, None, None, 1), ("c", "statutory", 120, "", ["q3"], ["x"], "", 0.8, None, None, None, None, 2), ("d", "statutory", 100, "", ["y", "none"], ["w"], "", 0.8, None, None, None, None, 3)]
    edges = rules_as_edges(spark.createDataFrame(rows, RULES))
    plain = lambda df: [tuple(r) for r in df.orderBy("step").collect()]
    assert plain(forward_chain_exact(facts, edges)) == plain(forward_chain_exact(facts, edges, group_rows=10_000_000)) != []


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_surest_supports(spark, seed):
    """Confidences are those of a loop over all rules until nothing changes; supports are as sure as they say, and rest on facts."""
    from verdigraph.operators.support import best_supports, support_tree

    facts, edges = random_scopes(spark, seed, 40, 14)
    table = {r["edge_id"]: r for r in edges.collect()}
    want = {}
    for f in facts.collect():
        scope = want.setdefault(f["scope"], {})
        scope.setdefault("id", {})[f["id"]] = f["confidence"] if f["id"] not in scope.get("id", {}) else max(scope["id"][f["id"]], f["confidence"])
        if f["statement"] is not None:
            scope.setdefault("said", {})[f["statement"]] = max(f["confidence"], scope.get("said", {}).get(f["statement"], 0))
    flat = {(s, k): c for s, w in want.items() for k, c in {**w.get("said", {}), **w["id"]}.items()}
    changed = True
    while changed:
        changed = False
        for s in want:
            for r in table.values():
                if r["tails"] and all((s, k) in flat for k in r["tails"]):
                    c = min([r["confidence"], *(flat[s, k] for k in r["tails"])])
                    for h in r["heads"]:
                        if flat.get((s, h), -1) < c:
                            flat[s, h], changed = c, True
    supports = best_supports(facts, edges)
    got = supports.collect()
    assert {(r["scope"], r["statement"]): r["confidence"] for r in got} == flat
    for r in got:
        assert r["path_confidence"] == r["confidence"]
        assert [p["premise"] for p in r["premises"]] == (table[r["edge_id"]]["tails"] if r["edge_id"] else []) and all(flat[r["scope"], p["premise"]] == p["confidence"] for p in r["premises"])
    made = supports.filter("edge_id IS NOT NULL")
    tree = support_tree(supports, made.select("scope", "statement")).collect()
    rounds = {(r["scope"], r["statement"]): r["round"] for r in got}
    assert all(t["depth"] == 0 or t["statement"] != t["asked"] for t in tree)
    assert {(t["scope"], t["asked"]) for t in tree if t["edge_id"] is None} == {(r["scope"], r["statement"]) for r in made.collect()} and max(rounds.values()) > 1
