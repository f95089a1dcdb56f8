"""Steps whose work must not grow faster than their input."""

from verdigraph.operators import derive as derivation
from verdigraph.operators.derive import derive_recursively
from verdigraph.plans.rules import Rule, edge, node
from verdigraph.sources.graph import from_labels


def small_graph(spark):
    nodes = spark.createDataFrame([("start", "a"), ("other", "b")], "label string, id string")
    edges = spark.createDataFrame([("next", x, y) for x, y in ("ab", "bc", "cd")] + [("same", "a", "b")], "label string, u string, v string")
    return from_labels(nodes, edges)


def test_a_round_derives_only_what_reads_new_labels(spark, monkeypatch):
    rules = [
        Rule("r1", "node", "reached", ("y",), (node("start", "x"), edge("next", "x", "y")), head_bound=(0.5, 1.0)),
        Rule("r2", "node", "reached", ("y",), (node("reached", "x"), edge("next", "x", "y")), head_bound=(0.6, 0.9)),
        Rule("r3", "edge", "pair", ("x", "y"), (edge("same", "x", "y"),), head_bound=(0.1, 0.2)),
        Rule("r4", "node", "met", ("x",), (edge("pair", "x", "y"), node("reached", "y")), head_bound=(0.3, 0.4)),
    ]
    ran = []
    plain = derivation.updates
    monkeypatch.setattr(derivation, "updates", lambda rs, g: ran.append([r.id for r in rs]) or plain(rs, g))
    got = {tuple(r) for r in derive_recursively(rules, small_graph(spark)).collect()}
    assert got == {("reached", "b", None, 0.5, 1.0), ("reached", "c", None, 0.6, 0.9), ("reached", "d", None, 0.6, 0.9), ("pair", "a", "b", 0.1, 0.2), ("met", "a", None, 0.3, 0.4)}
    each = [i for ids in ran for i in ids]
    assert each.count("r1") == 1 and each.count("r3") == 1


def test_rows_of_one_key_are_not_taken_apart(spark, monkeypatch, tmp_path):
    from verdigraph.sources import graph as graphs

    attr = "map<string,struct<type:string,value:string>>"
    said = lambda **x: {k: ("string", v) for k, v in x.items()}
    rows = [("a", "b", said(p="yes", q="no"), 1), ("a", "b", said(p="no", r="yes"), 2), ("b", "c", said(p="yes", q=None, z="1"), 3), ("c", "d", None, 4), ("d", "d", {}, 5)]
    edges, nodes = spark.createDataFrame(rows, f"src string, dst string, attrs {attr}, seq long"), spark.createDataFrame([("a", said(big="x"), 1)], f"id string, attrs {attr}, seq long")
    monkeypatch.setattr(graphs, "collapse", None)
    g = graphs.from_attributes(nodes, edges)
    assert {(r["u"], r["v"], *r["labels"]) for r in g.edges.collect()} == {("a", "b", "r"), ("b", "c", "p", "z"), ("c", "d"), ("d", "d")}
    assert [tuple(r["labels"]) for r in g.nodes.collect()] == [("big",)]


def test_rendered_elements_are_escaped(spark, tmp_path):
    from verdigraph.sources.graph import graphml_tables
    from verdigraph.sources.graphml import write_graphml

    odd = "a\"<&>'\tb"
    nodes = spark.createDataFrame([(odd, {"k&": odd, "none": None}), ("plain", None)], "id string, attrs map<string,string>")
    write_graphml(nodes, spark.createDataFrame([(odd, "plain", {})], "src string, dst string, attrs map<string,string>"), str(tmp_path / "out"))
    back, edges = graphml_tables(spark, str(tmp_path / "out"))
    assert {(r["id"], r["attrs"]["k&"]["value"] if r["attrs"] else None) for r in back.collect()} == {(odd, odd), ("plain", None)}
    assert [(r["src"], r["dst"]) for r in edges.collect()] == [(odd, "plain")]


def test_hops_are_counted_without_rows_for_each(spark):
    from verdigraph.operators.ground import hop_counts

    pairs = [(f"x{i % 5}", f"y{i % 7}") for i in range(35)] + [("x0", "none")]
    ends = [(f"y{i}", f"z{j}") for i in range(7) for j in range(i, i + 4)]
    want = {}
    for x, y in pairs:
        for at, z in ends:
            if at == y:
                want.setdefault(x, []).append(z)
    first, second = spark.createDataFrame(pairs, "x string, y string"), spark.createDataFrame(ends, "y string, z string")
    for gathered in (10**6, 3):
        assert {tuple(r) for r in hop_counts(first, second, gathered).collect()} == {(x, len(zs), len(set(zs))) for x, zs in want.items()}


def test_ancestors_are_not_carried_by_nodes(spark, monkeypatch):
    from verdigraph.operators import authority

    seen, plain = [], authority.settle
    monkeypatch.setattr(authority, "settle", lambda df, name: seen.append(set(df.columns)) or plain(df, name))
    edges = spark.createDataFrame([("u", "v", "cites", "followed", 2000), ("u", "v", "persuasive_relation", " Followed", 2000), ("w", "v", "odd", None, None)], "u string, v string, label string, treatment string, year int")
    nodes = spark.createDataFrame([("u", "", "j1"), ("v", "TOP", "j0")], "id string, court string, jurisdiction string")
    lines = spark.createDataFrame([("j1", ["j0"])], "jurisdiction string, line array<string>")
    got = authority.authority_sums(edges, nodes, lines, {"treatment_modifier": {"followed": 2.0}, "court_levels": {"TOP": 1.5}}, 2000).collect()
    assert sorted(((r["class"], round(r["authority"], 9)) for r in got), key=str) == [("persuasive", 5.4), (None, 1.5)]
    assert not any({"id", "line"} <= columns for columns in seen)


def test_a_text_is_looked_through_once(monkeypatch):
    import re

    from verdigraph.operators import matching
    from verdigraph.operators.extract import graph_edges_of, readings_of

    class Counted:
        def __init__(self, pattern):
            self.pattern, self.n = pattern, 0

        def __getattr__(self, name):
            self.n += 1
            return getattr(self.pattern, name)

    versus, runs = Counted(matching._VERSUS), Counted(re.compile(matching._RUN.pattern))
    monkeypatch.setattr(matching, "_VERSUS", versus)
    monkeypatch.setattr(matching, "_RUN", runs)
    text = "so; it; was; said; " * 50 + "; Ann v. Bob, 1 U.S. 2 (1999); Cy v. Di; Ann v. Bob; 5 USC 6;" + " and, then, no, more;" * 50
    edges = graph_edges_of(readings_of(text, None, True), True)
    assert {(e["src"], e["label"], e["dst"], e["year"]) for e in edges} >= {("case::Ann_v_Bob_1999", "cites", "statute::5_USC_6", 1999), ("case::Ann_v_Bob_1999", "persuasive_relation", "case::Cy_v_Di", 1999)}
    assert (versus.n, runs.n) == (1, 3)


def test_graphs_of_odd_documents(spark):
    from pyspark.sql import functions as F

    from verdigraph.functions.text import case_id, statute_id
    from verdigraph.operators.extract import _case, _statute, documents_graph_auto

    odd = [("A  b\t c", " D\x1ce ", None), ("  A", "B\n", "1999"), ("A x", "B", "٣٣٣٣"), ("", "x y", "")]
    got = spark.createDataFrame(odd, "p string, d string, y string").select(case_id(F.col("p"), F.col("d"), F.col("y"))).collect()
    assert [r[0] for r in got] == [_case(*x, None)[0] for x in odd] and _case("A", "B", "٣٣٣٣", 7)[1] == 7
    assert spark.range(1).select(statute_id(F.lit("42"), F.lit("7(a)"))).first()[0] == _statute("42", "7(a)")[0]
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "; Ann v. Bob; Ann v. Bob; 29 CFR 1630.2;"), (4, "; Ann v. Bob, 1 U.S. 2 (1999); 5 USC 6;")], "doc_id long, text string")
    nodes, edges = documents_graph_auto(docs, jurisdiction="X", default_year=1980)
    shown = {(r["doc_id"], r["id"], r["kind"], r["jurisdiction"], r["year"], r["precedential"], tuple(r["statute_refs"]), tuple(r["pii_tags"])) for r in nodes.collect()}
    case = lambda k, i, y: (k, i, "case", "X", y, True, (), ())
    statute = lambda k, t, s: (k, f"statute::{t}_USC_{s}", "statute", "X", None, None, (f"{t} U.S.C. § {s}",), ())
    assert shown == {(k, "doc::X", "document", None, None, None, (), ("pii_basic",)) for k in (1, 2, 3, 4)} | {case(3, "case::Ann_v_Bob", 1980), case(4, "case::Ann_v_Bob_1999", 1999), case(4, "case::Ann_v_Bob", 1980), statute(3, "29", "1630.2"), statute(4, "5", "6")}
    assert {(r["doc_id"], r["src"], r["dst"], r["label"], r["year"]) for r in edges.collect()} == {
        (3, "case::Ann_v_Bob", "case::Ann_v_Bob", "persuasive_relation", 1980), (3, "case::Ann_v_Bob", "statute::29_USC_1630.2", "cites", 1980),
        (4, "case::Ann_v_Bob_1999", "statute::5_USC_6", "cites", 1999), (4, "case::Ann_v_Bob", "statute::5_USC_6", "cites", 1980), (4, "case::Ann_v_Bob_1999", "case::Ann_v_Bob", "persuasive_relation", 1999),
    }


def test_scopes_are_chained_many_at_a_time(spark):
    from verdigraph.operators.hyper import FACTS, forward_chain_exact, rules_as_edges
    from verdigraph.plugins import RULES

    facts = [(scope, x, "Fact", x, 0.9 - i / 10, 5 - i) for n in range(40) for scope in [None if n == 7 else f"s{n}"] for i, x in enumerate("abcd"[: n % 5])]
    rules = [("r1", "statutory", 1, "A", ["a", "b"], ["x"], "", 0.95, None, None, None, "federal", 1), ("r2", "statutory", 1, "B", ["x", "c"], ["y", "z"], "", 0.9, None, None, None, "state", 2)]
    facts, edges = spark.createDataFrame(facts, FACTS), rules_as_edges(spark.createDataFrame(rules, RULES))
    want = set()
    for n in range(40):
        scope = None if n == 7 else f"s{n}"
        want |= {(scope, "x", 0.8, "r1", 1)} if n % 5 >= 2 else set()
        want |= {(scope, "y", 0.7, "r2", 2), (scope, "z", 0.7, "r2", 3)} if n % 5 >= 3 else set()
    most = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for rows in (most, "3"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
            got = forward_chain_exact(facts, edges)
            assert {(r[0], r[1], round(r[2], 9), r[3], r[4]) for r in got.collect()} == want
        assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)


def test_what_documents_state_is_found_once(spark, monkeypatch):
    from pyspark.sql import functions as F

    from verdigraph import plugins

    read = spark.sparkContext.accumulator(0)
    counted = F.udf(lambda t: (read.add(1), t)[1], "string").asNondeterministic()
    docs = spark.createDataFrame([(1, "She offered, he accepted and paid; then he breached it."), (2, "none")], "doc_id long, text string")
    told = docs.select("doc_id", counted("text").alias("text"))
    found = plugins.analyze(told, plugins.PluginLoader("plugins").load("contract_law"), {"jurisdiction": "US-CA"})
    assert found["original_facts"].count() == 4 and found["derived_facts"].count() == 2
    assert read.value == 2


def test_lines_of_elements_are_read_without_xml(spark, tmp_path, monkeypatch):
    """Files as they are written never go through the XML source; a file that isn't elements line by line does, and it alone."""
    from pyspark.sql import functions as F

    from verdigraph.sources import graph as graphs
    from verdigraph.sources.graphml import graphml_rows, write_graphml

    odd = "a\"<&>'\té 字\n<edge source=\"x\" target=\"y\"/>\nb &amp;"
    nodes = spark.createDataFrame([(odd, {"k&": odd, "none": None, "empty": ""}), ("plain", None), ("o", {"p": "yes"})], "id string, attrs map<string,string>")
    edges = spark.createDataFrame([(odd, "plain", {}), ("o", "plain", {"p": "no", "q": "x"}), ("o", "plain", {"p": "yes"})], "src string, dst string, attrs map<string,string>")
    out = tmp_path / "a b%20"
    write_graphml(nodes, edges, str(out))
    xml, asked = graphs._xml_tables, []
    monkeypatch.setattr(graphs, "_xml_tables", lambda s, p, names=None: asked.append(names) or xml(s, p, names))

    def agree():
        plain = lambda rows: sorted(repr([sorted((k, tuple(v)) for k, v in x.items()) if isinstance(x, dict) else x for x in r]) for r in rows)
        told, (n, e) = graphml_rows(spark, str(out)), graphs.graphml_tables(spark, str(out))
        assert plain(n.select("id", "attrs").collect()) == plain(told.filter("kind = 'node'").select("id", "attrs").collect())
        assert plain(e.select("src", "dst", "directed", "attrs").collect()) == plain(told.filter("kind = 'edge'").select("src", "dst", "directed", "attrs").collect())

    agree()
    assert asked == []
    g = graphs.read_graphml(spark, str(out))
    assert {(r["u"], r["v"], *r["labels"]) for r in g.edges.collect()} == {(odd, "plain"), ("o", "plain", "p", "q")} and g.nodes.count() == 3
    head = '<graphml>\n<key id="d" for="all" attr.name="p" attr.type="int"/>'
    (out / "lines.graphml").write_text(f'{head}\n<graph edgedefault="undirected">\r\n<node id="n"><data key="d">0</data></node>\n<edge source="n" target="m"><data key="d">1</data><data key="e">&#10;</data></edge>\n</graph>\n</graphml>')
    (out / "over.graphml").write_text(f'{head}\n<graph edgedefault="directed">\n<!--\n<edge source="no" target="no"/>\n-->\n<node id="c"/>\n<edge source="c"\n target="d"/>\n</graph></graphml>\n')
    agree()
    assert [[n.rpartition("/")[2] for n in names] for names in asked] == [["over.graphml"]]
    monkeypatch.setattr(graphs, "LINE", 60)
    assert graphs._line_files(spark, str(out)).filter(F.col("whole") & F.col("file").endswith("/lines.graphml")).isEmpty()
