"""Intervals, thresholds, aggregates, rules, grounding and time: literal vectors and an independent simulation."""

import itertools
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verdigraph.functions import intervals as iv
from verdigraph.functions.aggregators import Evidence, aggregator, array_evidence, register_aggregator
from verdigraph.functions.thresholds import Threshold, passes
from verdigraph.operators.derive import derive, updates
from verdigraph.operators.ground import atoms, ground, join_order
from verdigraph.errors import StatementError
from verdigraph.operators.interpretation import Interpretation, blocklist, compare, reason
from verdigraph.operators.temporal import Convergence, combine, run, timeline
from verdigraph.plans.library import derivation_rules
from verdigraph.plans.rules import Clause, Rule, edge, node, parse_rules, rules_from_dicts
from verdigraph.sources.graph import from_labels


def value(spark, column):
    r = spark.range(1).select(column.alias("c")).first()["c"]
    return (r["l"], r["u"]) if hasattr(r, "l") else r


def test_closed_clamps_and_resets(spark):
    assert value(spark, iv.closed(1.2, -0.1)) == (0, 1)
    assert value(spark, iv.closed(-0.5, 0.4)) == (0, 0.4)
    assert value(spark, iv.intersection(iv.closed(0.2, 0.9), iv.closed(0.5, 1))) == (0.5, 0.9)
    assert value(spark, iv.intersection(iv.closed(0, 0.3), iv.closed(0.4, 0.7))) == (0, 1)
    assert value(spark, iv.contains(iv.closed(0.1, 0.9), iv.closed(0.2, 0.9))) is True
    assert value(spark, iv.same(iv.closed(0.2, 0.8), iv.closed(0.2, 0.8))) is True
    assert value(spark, iv.width(iv.closed(0.25, 0.75))) == 0.5


def test_fold_depends_on_order(spark):
    a, b, c = iv.closed(0, 0.3), iv.closed(0.4, 0.7), iv.closed(0.5, 0.6)
    assert value(spark, iv.fold_intersection(F.array(a, b, c))) == (0.5, 0.6)
    assert value(spark, iv.fold_intersection(F.array(b, c, a))) == (0, 1)
    assert value(spark, iv.fold_intersection(F.array(a))) == (0, 0.3)
    assert value(spark, iv.fold_intersection(F.array().cast(f"array<{iv.TYPE}>"))) == (0, 1)


@pytest.mark.parametrize("spec, counts, want", [
    (("greater_equal", "number", "total", 2), (2, 3, 3), True), (("greater_equal", "number", "total", 2), (1, 3, 3), False),
    (("equal", "number", "total", 1), (1, 5, 5), True), (("equal", "number", "total", 1), (2, 5, 5), False),
    (("greater", "percent", "available", 50), (3, 10, 4), True), (("greater", "percent", "available", 50), (2, 10, 4), False),
    (("greater_equal", "percent", "total", 0), (0, 0, 0), True), (("less", "percent", "total", 1), (0, 0, 0), True), (("less_equal", "number", "total", 0), (0, 4, 4), True),
])
def test_thresholds(spark, spec, counts, want):
    assert value(spark, passes(Threshold(*spec), *map(F.lit, counts))) is want


def test_no_such_threshold():
    with pytest.raises(ValueError):
        Threshold("about")


THREE = [[(0.2, 0.7)], [(0.4, 0.9)], [(0.6, 0.8)]]
TWO = [[(0.2, 0.9)], [(0.55, 0.95)]]


@pytest.mark.parametrize("name, clauses, weights, want", [
    ("average", THREE, [1, 1, 1], (0.4, 0.8)), ("maximum", THREE, [1, 1, 1], (0.6, 0.9)), ("minimum", THREE, [1, 1, 1], (0.2, 0.7)), ("average_lower", THREE, [1, 1, 1], (0.4, 0.9)),
    ("legal_burden_civil_051", TWO, [1, 1], (0.51, 0.925)), ("legal_burden_clear_075", TWO, [1, 1], (0.75, 0.925)), ("legal_burden_criminal_090", TWO, [1, 1], (0.9, 0.925)),
    ("legal_conservative_min", TWO, [1, 1], (0.2, 0.925)), ("legal_conservative_min", [[(0.6, 0.8)], [(0.4, 0.6)]], [0.6, 0.4], (0.16, 0.36)),
    ("precedent_weighted", [[(0.5, 0.5)]] * 3, [1, 1, 1], (0.5, 0.5)), ("precedent_weighted", [[(0.8, 0.9)], [], []], [0.6, 0.3, 0.1], (0.48, 0.54)),
    ("precedent_weighted", [[(0.7, 0.9)], [(0.5, 0.8)], [(0.2, 0.3)]], [0.6, 0.3, 0.1], (0.59 / 3, 0.81 / 3)),
    ("legal_burden_civil_051", [[(1, 1)]] * 3, [0.6, 0.3, 0.1], (0, 1)), ("maximum", [[(1, 1)]] * 3, [0.6, 0.3, 0.1], (0.6, 0.6)), ("average_lower", [[(1, 1)]] * 3, [0.6, 0.3, 0.1], (1 / 3, 1)),
    ("lenity_alpha", [[(1, 1)]] * 3, [0.6, 0.3, 0.1], (0.95 / 3, 1 / 3)), ("textualism_alpha", [[(0.2, 0.6)]], [1], (0.2, 0.58)), ("purposivism_alpha", [[(0.2, 0.6)]], [1], (0.2, 0.62)),
])
def test_aggregates(spark, name, clauses, weights, want):
    items = [F.array(*[iv.closed(*x) for x in c]).cast(f"array<{iv.TYPE}>") for c in clauses]
    assert value(spark, aggregator(name)(array_evidence(items, weights))) == pytest.approx(want)


def test_registered_and_unknown_aggregates(spark):
    register_aggregator("half", lambda e: iv.closed(e.mean[0] / 2, e.mean[1] / 2))
    one = [F.array(iv.closed(1, 1)).cast(f"array<{iv.TYPE}>")]
    assert value(spark, aggregator("half")(array_evidence(one, [1]))) == (0.5, 0.5)
    assert aggregator("no such") is None and aggregator(None) is None
    assert value(spark, aggregator("average")(Evidence([], [], [], []))) == (0, 1)


def test_rule_text():
    r1, r3, r4 = parse_rules("""
        # a comment
        rule R1: head(X) :- p(X), q(X); ann=average; weights=1,1; delta=1; set_static=true  # and one here
        not a rule
        RULE R3: h(X,Y) :- e(X,Y)
        rule R4: lone(X)
    """)
    assert (r1.kind, [c.label for c in r1.clauses], r1.weights, r1.delta, r1.static, r1.aggregate, r1.head_bound) == ("node", ["p", "q"], (1.0, 1.0), 1, True, "average", None)
    assert (r3.kind, r3.clauses, r3.head_bound) == ("edge", (), (1.0, 1.0))
    assert r4.clauses == ()
    with pytest.raises(ValueError):
        parse_rules("rule R2: head(X) :- p(X), q(X); ann=average; weights=1")
    (d,) = rules_from_dicts([{"id": "d", "kind": "node", "target": "t", "head": ["x"], "clauses": [{"kind": "edge", "label": "e", "variables": ["x", "y"], "bound": [1, 1]}], "thresholds": [{"value": 2}]}])
    assert d.clauses[0].bound == (1, 1) and d.thresholds[0].value == 2


def graph_of(spark, nodes, edges):
    return from_labels(spark.createDataFrame(nodes, "label string, id string"), spark.createDataFrame(edges, "label string, u string, v string"))


def facts_of(df):
    return {(r["label"], r["arg0"], r["arg1"]): (r["l"], r["u"]) for r in df.collect()}


def test_min_case(spark):
    g = graph_of(spark, [("case_id", "A"), ("case_id", "B"), ("precedential", "B")], [(k, "A", "B") for k in ("cites", "same_issue", "controlling_relation")])
    assert facts_of(reason(derivation_rules(), g).facts) == {("controlling_for", "A", "B"): (1, 1)}
    bare = graph_of(spark, [], [("Friends", "John", "Mary"), ("owns", "John", "Dog")])
    assert facts_of(reason(derivation_rules(), bare).facts) == {}


def slow_ground(clauses, nodes, edges):
    """All assignments by nested loops over clauses; a loop clause that binds takes the end of every edge."""
    rows, bound = [{}], set()
    for c in sorted((c for c in clauses if c.well_formed and c.kind != "comparison"), key=lambda c: len(set(c.variables)) == 1 and c.kind == "edge"):
        out = []
        for a in rows:
            if c.kind == "node":
                ids = [i for k, i in nodes if k == c.label]
                x = c.variables[0]
                out += [{**a, x: i} for i in ids if a.get(x, i) == i]
            else:
                u, v = c.variables
                for k, s, t in edges:
                    if k != c.label:
                        continue
                    if u == v:
                        out += [{**a, u: t}] if u not in bound else ([a] if s == t == a[u] else [])
                    elif a.get(u, s) == s and a.get(v, t) == t:
                        out.append({**a, u: s, v: t})
        bound |= set(c.variables)
        rows = out
    return rows


CLAUSES = [node("a", "x"), node("b", "y"), edge("p", "x", "y"), edge("q", "x", "y"), edge("p", "y", "z"), edge("q", "z", "x"), node("a", "z"), Clause("comparison", "c", ())]


@pytest.mark.parametrize("seed", range(6))
def test_grounding_is_every_assignment(spark, seed):
    rng = random.Random(seed)
    ids = list("123456")
    nodes = sorted({(rng.choice("ab"), rng.choice(ids)) for _ in range(8)})
    edges = sorted({(rng.choice("pq"), rng.choice(ids), rng.choice(ids)) for _ in range(22)})
    g = graph_of(spark, nodes, edges)
    body = tuple(rng.sample(CLAUSES, rng.randint(1, 4)))
    found = ground(Rule("r", "node", "h", ("x",), body), g)
    want = slow_ground(body, nodes, edges)
    if found is None:
        assert want == [{}]
        return
    got = sorted(tuple(sorted(r.asDict().items())) for r in found.assignments.collect())
    assert got == sorted(tuple(sorted(a.items())) for a in want)


def test_clauses_over_the_same_variables_are_one_scan():
    rule = derivation_rules()[0]
    assert [(a.kind, a.labels) for a in join_order(atoms(rule))] == [("edge", ("cites", "same_issue", "controlling_relation")), ("node", ("precedential",))]
    plan = join_order(atoms(Rule("r", "node", "h", ("x",), (node("a", "x"), node("b", "w"), edge("p", "x", "y"), edge("q", "y", "w")))))
    bound = set(plan[0].variables)
    for a in plan[1:]:
        assert bound & set(a.variables)
        bound |= set(a.variables)


def test_loop_clause_thresholds_and_aggregate(spark):
    g = graph_of(spark, [], [("p", "a", "b"), ("p", "b", "b"), ("p", "c", "d")])
    rule = Rule("r", "node", "h", ("x",), (edge("p", "x", "x"),), head_bound=None, aggregate="average")
    assert facts_of(derive(rule, g)) == {("h", "b", None): (1, 1)}
    lax = Rule("r", "node", "h", ("x",), (edge("p", "x", "x"),), (Threshold("greater_equal", "number", "total", 0),), head_bound=None, aggregate="average")
    assert facts_of(derive(lax, g)) == {("h", "b", None): (1, 1), ("h", "d", None): (0, 1)}


def test_malformed_and_excluded_clauses(spark):
    g = graph_of(spark, [("a", "1"), ("a", "2")], [])
    body = (node("a", "x"), Clause("node", "b", ()))
    assert facts_of(derive(Rule("r", "node", "h", ("x",), body), g)) == {}
    may_fail = (Threshold(), Threshold("less_equal", "number", "total", 0))
    got = facts_of(derive(Rule("r", "node", "h", ("x",), body, may_fail, head_bound=None, aggregate="average"), g))
    assert got == {("h", "1", None): (0.5, 1), ("h", "2", None): (0.5, 1)}
    assert derive(Rule("r", "node", "h", ("x",), (Clause("comparison", "c", ()),)), g) is None
    bad = Rule("r", "edge", "h", ("x",), (node("a", "x"),))
    assert updates([bad], g).count() == 0


# -- time, against a step-by-step simulation -------------------------------------


def meet(a, b):
    low, high = max(a[0], b[0]), min(a[1], b[1])
    return (low, high) if low <= high else (0.0, 1.0)


def simulate(rules, tmax, mode, bound=-1, changed_limit=-1, most=60):
    """rules: (statement, delta, l, u, static, source) in rule order; facts after each step, and the per-step counts."""
    queue, static, facts, trace = {}, set(), {}, []
    t = 0
    while (tmax == -1 or t < tmax) and t < most:
        for s, d, l, u, st_, src in rules:
            queue.setdefault(t + d, []).append((s, (l, u), st_, src))
        due = queue.pop(t, [])
        changed, move = 0, 0.0
        for s, _, st_, _ in due:
            if st_:
                static.add(s)
        for s in dict.fromkeys(x[0] for x in due):
            if s in static and s in facts:
                continue
            own = [x for x in due if x[0] == s]
            if mode == "intersection":
                to = own[0][1]
                for x in own[1:]:
                    to = meet(to, x[1])
                after = meet(facts.get(s, (0.0, 1.0)), to)
            else:
                after = min(own, key=lambda x: (x[1][1] - x[1][0], x[3], x[1]))[1]
            before = facts.get(s, (0.0, 1.0))
            facts[s] = after
            d = max(abs(before[0] - after[0]), abs(before[1] - after[1]))
            changed += d > 0
            move = max(move, d)
        trace.append((t, changed, move))
        if (move <= bound) if bound != -1 else (changed <= changed_limit) if changed_limit != -1 else (changed == 0 and not any(k > t for k in queue)):
            break
        t += 1
    return facts, trace


RULES = st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 3), st.sampled_from([0.0, 0.25, 0.5, 0.75]), st.sampled_from([0.25, 0.5, 0.75, 1.0]), st.booleans()), min_size=1, max_size=5)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(RULES, st.sampled_from([-1, 0, 1, 2, 4, 7]), st.sampled_from(["intersection", "override"]), st.sampled_from([(-1, -1), (0.3, -1), (-1, 0), (-1, 1)]))
def test_timeline_is_the_simulation(spark, drawn, tmax, mode, stop):
    rules = [(s, d, min(l, u), max(l, u), f, f"r{i}") for i, (s, d, l, u, f) in enumerate(drawn)]
    rows = [(s, "n", None, l, u, d, i, 0, f, src) for i, (s, d, l, u, f, src) in enumerate(rules)]
    df = spark.createDataFrame(rows, "label string, arg0 string, arg1 string, l double, u double, delta int, ord int, emit int, static boolean, source string").coalesce(1)
    got = run(df, tmax, mode, Convergence(*stop))
    facts, trace = simulate(rules, tmax, mode, *stop)
    assert {k[0]: v for k, v in facts_of(got.facts).items()} == facts
    n = got.steps.count()
    assert [tuple(r) for r in got.steps.orderBy("t").collect()] == trace[:n]


def test_timeline_steps_and_silence(spark):
    df = spark.createDataFrame([("a", "n", None, 0.5, 1.0, 0, 0, 0, False, "r")], "label string, arg0 string, arg1 string, l double, u double, delta int, ord int, emit int, static boolean, source string")
    assert [(r["t"], r["l"], r["moved"]) for r in timeline(df, 3).orderBy("t").collect()] == [(0, 0.5, 0.5), (1, 0.5, 0.0), (2, 0.5, 0.0)]
    assert run(df, 3, emit_facts=False).facts.count() == 0
    assert run(df.limit(0), 3).facts.count() == 0


@pytest.mark.parametrize("order", list(itertools.permutations(range(3)))[:4])
def test_order_of_rows_does_not_matter(spark, order):
    rows = [("a", "n", None, l, u, 0, i, 0, False, "r") for i, (l, u) in enumerate([(0.0, 0.3), (0.4, 0.7), (0.5, 0.6)])]
    schema = "label string, arg0 string, arg1 string, l double, u double, delta int, ord int, emit int, static boolean, source string"
    df = spark.createDataFrame([rows[i] for i in order], schema).repartition(3)
    assert facts_of(combine(df)) == {("a", "n", None): (0.5, 0.6)}


def test_exports(spark):
    facts = spark.createDataFrame([("foo", "A", None, 0.3, 0.8), ("bar", "A", "B", 0.5, 0.9)], "label string, arg0 string, arg1 string, l double, u double")
    i = Interpretation(facts, facts, facts)
    assert [r["value"] for r in i.jsonl().collect()] == ['{"lower":0.5,"statement":"bar(A,B)","upper":0.9}', '{"lower":0.3,"statement":"foo(A)","upper":0.8}']
    assert set(i.export(blocked=["foo"])) == {"facts"} and i.export(blocked=["foo"])["facts"].count() == 1
    assert blocklist({"redact": {"labels_blocklist": ["a", " b "]}, "labels_blocklist": ["b", "c", ""]}) == ["a", "b", "c"]
    g = graph_of(spark, [("precedential", "B")], [(k, "A", "B") for k in ("cites", "same_issue", "controlling_relation")])
    ran = reason(derivation_rules(), g)
    for profile in ("audit", "audit_profile"):
        # What is blocked shows nowhere, its supports included.
        assert {k: t.count() for k, t in ran.export(profile, ["controlling_for"]).items()} == {"facts": 0, "supports": 0, "trace": 0}
        assert ran.export(profile, ["other"])["supports"].count() == 4
    assert compare(i.table(), i.table()).count() == 0


def test_delayed_and_inferred(spark):
    g = graph_of(spark, [], [("e", "a", "b")])
    rule = Rule("r", "edge", "h", ("x", "y"), (edge("e", "x", "y"),), delta=2, infer_edges=True, infer_label="k")
    assert facts_of(reason([rule], g, tmax=2).facts) == {}
    assert set(facts_of(reason([rule], g, tmax=3).facts)) == {("h", "a", "b"), ("k", "a", "b")}
    assert set(facts_of(reason([rule], g, tmax=-1).facts)) == {("h", "a", "b"), ("k", "a", "b")}


def test_interpretation_from_pairs_and_as_dict(spark):
    made = Interpretation.from_pairs(spark, [("foo(A)", (0.3, 0.8)), ("bar(A,B)", (0.5, 0.9))])
    assert made.as_dict() == {"facts": {"foo(A)": (0.3, 0.8), "bar(A,B)": (0.5, 0.9)}, "supports": {}, "trace": []}
    with pytest.raises(StatementError):
        Interpretation.from_pairs(spark, [("no statement", (0, 1))])


def test_python_aggregates(spark):
    """What a function sees of each clause; what it raises, or returns beyond [0, 1], stays with its head."""
    from verdigraph.functions.aggregators import Repeated, register_python_aggregator

    assert list(Repeated((0.5, 1.0), 3)) == [(0.5, 1.0)] * 3 and list(Repeated((0.5, 1.0), 5)[1:3]) == [(0.5, 1.0)] * 2
    cells = {"a": lambda c, w: (len(c[0]) / 10, 0.5), "b": lambda c, w: (-3, 7), "c": lambda c, w: 1 / 0, "d": lambda c, w: (float("nan"), 1), "e": lambda c, w: (w[0], c[0][len(c[0]) - 1][1])}
    g = from_labels(spark.createDataFrame([("t", "z")], "label string, id string"), spark.createDataFrame([("p", "x", str(i)) for i in range(4)] + [("p", "y", "0")], "label string, u string, v string"))
    got = {}
    for name, f in cells.items():
        register_python_aggregator(name, f)
        rule = Rule(name, "node", "out", ("x",), (edge("p", "x", "y"),), head_bound=None, aggregate=name, weights=(0.25,))
        got[name] = {(r["arg0"], r["l"], r["u"]) for r in derive(rule, g).collect()}
    assert got["a"] == {("x", 0.4, 0.5), ("y", 0.1, 0.5)} and got["b"] == got["c"] == got["d"] == {("x", 0.0, 1.0), ("y", 0.0, 1.0)}
    assert got["e"] == {("x", 0.25, 1.0), ("y", 0.25, 1.0)}


@pytest.mark.parametrize("mode", ["intersection", "override"])
def test_runs_are_the_steps_in_which_something_happens(spark, mode):
    """Delays of thousands of steps: states of a few steps each, the same at every step as those of short delays stretched."""
    from verdigraph.operators.temporal import runs

    rng = random.Random(3)
    schema = "label string, arg0 string, arg1 string, l double, u double, delta int, ord int, emit int, static boolean, source string"
    rows = [("p", f"x{i}", None, lo := rng.choice([0.0, 0.2, 0.6, 0.9]), min(1.0, lo + rng.choice([0.05, 0.3, 0.5])), rng.randrange(4) * 10, k, 0, rng.random() < 0.15, f"r{k}") for i in range(40) for k in range(rng.randrange(1, 5))]
    near = spark.createDataFrame(rows, schema)
    far = spark.createDataFrame([(*r[:5], r[5] * 1000, *r[6:]) for r in rows], schema)
    states = lambda df, at: {(r["arg0"], r["l"], r["u"], r["present"]) for r in df.filter((F.col("t") <= at) & (F.col("until") >= at)).collect()}
    a, b = runs(near, 40, mode).persist(), runs(far, 40_000, mode).persist()
    assert all(states(a, t) == states(b, t // 10 * 10_000 + t % 10) for t in range(0, 40, 3)) and a.count() == b.count() < 40 * 17
    told = {(r["arg0"], r["t"]): (r["l"], r["u"], r["present"], r["moved"]) for r in timeline(near, 40, mode).collect()}
    assert len(told) == 40 * len({r[1] for r in rows})
    for r in a.collect():
        assert told[r["arg0"], r["t"]] == (r["l"], r["u"], r["present"], r["moved"])
        assert all(told[r["arg0"], t] == (r["l"], r["u"], r["present"], 0.0) for t in range(r["t"] + 1, r["until"] + 1))
    x, y = run(near, -1, mode), run(far, -1, mode)
    facts = lambda r: {tuple(f) for f in r.facts.collect()}
    assert facts(x) == facts(y) and (x.last, y.last) == (33, 30_003)
