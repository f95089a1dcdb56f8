"""Graphs, stores, documents, extraction, plugins, streams and the command line."""

import hashlib
import json
import random
import re
import sys

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from verdigraph.cli import main
from verdigraph.functions.text import OBLIGATION_PATTERNS, PARALLEL_ORDER, PII_PATTERNS, REPORTERS, canonical_reporter, pii_left, preferred_reporter, redact_pii, reporters_in
from verdigraph.operators.extract import citation_parts, documents_graph, entities_of, extract_citations, greedy_spans, obligations_of, standard_form
from verdigraph.operators.interpretation import reason
from verdigraph.plans.library import derivation_rules
from verdigraph.plans.rules import Rule, edge
from verdigraph.plugins import PluginLoader, analysis_report, analyze
from verdigraph.queries import QUERIES
from verdigraph.sources.documents import audit_chain, detailed, read_folder, verify_chain
from verdigraph.sources.graph import from_attributes, from_labels, graphml_tables, read_graphml, truthy
from verdigraph.sources.graphml import graphml_rows, write_graphml
from verdigraph.sources.scratch import scratch
from verdigraph.sources.store import GraphStore
from verdigraph.streaming.facts import keep_facts, latest_facts, windowed_counts


def test_truth_of_attributes(spark):
    cases = [("string", "false", False), ("string", "No", False), ("string", " 0 ", False), ("string", "none", False), ("string", "", False), ("string", "x", True), ("double", "0.0", False), ("long", "0", False), ("long", "-1", True), ("double", "NaN", True), ("double", "abc", False), ("boolean", "true", True), ("string", None, False)]
    df = spark.createDataFrame(cases, "k string, v string, want boolean")
    assert all(r["got"] == r["want"] for r in df.select("want", truthy(F.col("v"), F.col("k")).alias("got")).collect())


GRAPHML = """<?xml version="1.0"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="k0" for="edge" attr.name="knows" attr.type="long"/><graph edgedefault="%s">
<node id="a"/><node id="b"/><edge source="a" target="b"><data key="k0">1</data></edge><edge source="a" target="b"><data key="k0">%s</data></edge></graph></graphml>"""


@pytest.mark.parametrize("kind, last, want", [("directed", 1, {("a", "b")}), ("directed", 0, set()), ("undirected", 1, {("a", "b"), ("b", "a")})])
def test_graphml(spark, tmp_path, kind, last, want):
    (tmp_path / "g.graphml").write_text(GRAPHML % (kind, last))
    g = read_graphml(spark, str(tmp_path / "g.graphml"))
    assert {(r["u"], r["v"]) for r in g.edge_labels().collect()} == want
    assert {(r["u"], r["v"]) for r in read_graphml(spark, str(tmp_path / "g.graphml"), reverse=True).edge_labels().collect()} == {(v, u) for u, v in want}
    assert read_graphml(spark, str(tmp_path / "g.graphml")).nodes.count() == 2


def test_graphml_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("a&b", {"p": "yes", "refs": "1,2"}), ("c<d", {"p": None})], "id string, attrs map<string,string>")
    edges = spark.createDataFrame([("a&b", "c<d", {"cites": "true"})], "src string, dst string, attrs map<string,string>")
    write_graphml(nodes, edges, str(tmp_path / "out"))
    back, into = graphml_tables(spark, str(tmp_path / "out"))
    assert {r["id"]: {k: v["value"] for k, v in r["attrs"].items()} for r in back.collect()} == {"a&b": {"p": "yes", "refs": "1,2"}, "c<d": {}}
    assert [(r["src"], r["dst"], r["directed"]) for r in into.collect()] == [("a&b", "c<d", True)]
    write_graphml(nodes.filter("false"), edges.filter("false"), str(tmp_path / "out"))
    assert [p.name for p in (tmp_path / "out").glob("*.graphml")] == ["part-00000.graphml"] and graphml_tables(spark, str(tmp_path / "out"))[0].isEmpty()


def graphml_text(way, keys, nodes, edges):
    known = "".join(f'<key id="{k}" for="all" attr.name="{name}" attr.type="{kind}"/>' for k, (name, kind) in keys.items())
    data = lambda d: "".join(f'<data key="{k}">{v}</data>' for k, v in d.items())
    body = "".join(f'<node id="{n}">{data(d)}</node>' for n, d in nodes) + "\n".join(f'<edge source="{u}" target="{v}">{data(d)}</edge>' for u, v, d in edges)
    return f'<?xml version="1.0"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">{known}<graph id="G" edgedefault="{way}">{body}</graph></graphml>'


def test_each_file_has_its_own_keys_and_direction(spark, tmp_path):
    (tmp_path / "a.graphml").write_text(graphml_text("directed", {"d0": ("cites", "string"), "d1": ("big", "double")}, [("n", {"d1": "0.0"}), ("m", {"d1": "2"})], [("n", "m", {"d0": "x"})]))
    (tmp_path / "b.graphml").write_text(graphml_text("undirected", {"d0": ("contrary_to", "string"), "d1": ("big", "string")}, [("n", {"d1": "0.0"})], [("n", "k", {"d0": "x", "d9": "1"}), ("k", "n", {"d9": "no"})]))
    g = read_graphml(spark, str(tmp_path))
    assert {(r["u"], r["v"], tuple(r["labels"])) for r in g.edges.collect()} == {("n", "m", ("cites",)), ("n", "k", ("contrary_to",)), ("k", "n", ("contrary_to",))}
    assert {(r["id"], tuple(r["labels"])) for r in g.nodes.collect()} == {("n", ("big",)), ("m", ("big",))}
    assert read_graphml(spark, str(tmp_path / "*.graphml"), reverse=True).edges.count() == 3


def test_both_readers_agree(spark, tmp_path):
    """Splits and streams give the same nodes and edges, in the same order within a file; a file is a partition of the stream."""
    rng = random.Random(8)
    for i in range(5):
        keys = {f"d{j}": (rng.choice(["p", "q", "r &amp; s", f"d{j}"]) + str(j), rng.choice(["string", "int", "double", "boolean"])) for j in range(3)}
        data = lambda: {k: rng.choice(["1", "0", "a&amp;b", "true"]) for k in rng.sample([*keys, "d7"], 2)}  # noqa: E731, B023
        nodes = [(f"n{rng.randrange(9)}", data()) for _ in range(30)]
        (tmp_path / f"g{i}.graphml").write_text(graphml_text(rng.choice(["directed", "undirected"]), keys, nodes, [(rng.choice(nodes)[0], rng.choice(nodes)[0], data()) for _ in range(40)]))
    streamed = graphml_rows(spark, str(tmp_path))
    assert streamed.rdd.getNumPartitions() == 5
    nodes, edges = graphml_tables(spark, str(tmp_path))
    plain = lambda rows: [tuple(sorted((k, tuple(v)) for k, v in x.items()) if isinstance(x, dict) else x for x in r) for r in rows]
    a = streamed.filter("kind = 'node'").orderBy("file", "pos").select("id", "attrs").collect()
    assert plain(a) == plain(nodes.orderBy("seq").select("id", "attrs").collect())
    b = streamed.filter("kind = 'edge'").orderBy("file", "pos").select("src", "dst", "directed", "attrs").collect()
    assert plain(b) == plain(edges.orderBy("seq").select("src", "dst", "directed", "attrs").collect())


def test_graphml_is_written_by_partitions(spark, tmp_path):
    at = str(tmp_path / "out")
    nodes = spark.range(0, 90, 1, 3).select(F.concat(F.lit("n"), "id").alias("id"), F.create_map(F.lit("k"), F.col("id").cast("string")).alias("attrs"))
    edges = spark.range(0, 500, 1, 4).select((F.col("id") % 90).alias("src"), (F.col("id") % 7).alias("dst"), F.create_map(F.lit("k"), F.lit("x"), F.lit("w"), F.lit("y")).alias("attrs"))
    write_graphml(nodes, edges, f"file://{at}")
    assert len([p for p in (tmp_path / "out").iterdir() if p.suffix == ".graphml"]) == 7 and len(list((tmp_path / "out").iterdir())) == 7
    back, into = graphml_tables(spark, at)
    assert back.count() == 90 and into.count() == 500 and into.filter("attrs['w'].value = 'y'").count() == 500
    broken = edges.withColumn("dst", F.when(F.col("dst") == 3, F.raise_error(F.lit("stop"))).otherwise(F.col("dst")))
    with pytest.raises(Exception, match="stop"):
        write_graphml(nodes, broken, at)
    assert len(list((tmp_path / "out").glob("*.graphml"))) == 7 and graphml_tables(spark, at)[1].count() == 500


def test_attributes_with_and_without_order(spark):
    at = "map<string,struct<type:string,value:string>>"
    nodes = spark.createDataFrame([("n", {"p": ("double", "0")})], f"id string, attrs {at}")
    edges = spark.createDataFrame([("a", "b", {"p": ("string", "x")}, 1), ("a", "b", {"p": ("string", "no"), "q": ("string", "x")}, 2)], f"src string, dst string, attrs {at}, seq long")
    assert from_attributes(nodes, edges).edges.first()["labels"] == ["q"]
    assert from_attributes(nodes, edges).nodes.first()["labels"] == []


def test_store(spark, tmp_path):
    s = GraphStore(spark, f"file://{tmp_path}/store")
    prov = ([{"type": "statute"}], "m", "a", None, 0.9, None, None, None)
    node = "id string, type string, labels array<string>, data map<string,string>, context struct<jurisdiction:string,valid_from:timestamp,valid_to:timestamp,law_type:string,authority_level:string>, prov struct<source:array<map<string,string>>,method:string,agent:string,time:timestamp,confidence:double,hash:string,evidence:string,derivation:array<string>>"
    edge_ = node.replace("type string, labels array<string>, data map<string,string>", "relation string, tails array<string>, heads array<string>, qualifiers map<string,string>", 1)
    assert s.nodes().count() == 0
    s.add_nodes(spark.createDataFrame([("n1", "Fact", [], {"statement": "P"}, None, prov), ("n2", "Case", [], {}, None, prov)], node))
    s.add_nodes(spark.createDataFrame([("n1", "Fact", [], {"statement": "Q"}, None, prov)], node))
    s.add_edges(spark.createDataFrame([("e1", "implies", ["Q"], ["R"], {"priority": "5"}, ("US", None, None, None, "federal"), prov)], edge_))
    assert s.nodes().count() == 2 and s.node("n1").first()["data"] == {"statement": "Q"}
    assert [r["id"] for r in s.nodes_by_type("Case").collect()] == ["n2"] and s.nodes_by_source_type("statute").count() == 2
    assert s.nodes_by_statement("P").count() == 0 and s.nodes_by_statement("Q").count() == 1
    assert s.incoming("R").count() == s.outgoing("Q").count() == s.edges_by_relation("implies").count() == s.edge("e1").count() == 1 and s.incoming("Q").count() == 0
    from verdigraph.operators.hyper import forward_chain_exact

    got = forward_chain_exact(s.facts("x").filter("type = 'Fact'"), s.implications()).collect()
    assert [(r["scope"], r["id"], r["confidence"]) for r in got] == [("x", "R", 0.9)]
    with pytest.raises(ValueError):
        s.add_nodes(spark.createDataFrame([("n3", "Fact", [], {}, None, ([], "m", "a", None, 0.9, None, None, None))], node))
    with pytest.raises(ValueError):
        s.add_edges(spark.createDataFrame([("e2", "implies", [], ["R"], {}, None, prov)], edge_))


PROV_ROW = ([{"type": "statute"}], "m", "a", None, 0.9, None, None, None)


def stored_edges(spark, rows):
    none = F.lit(None)
    df = spark.createDataFrame(rows, "id string, relation string, tails array<string>, heads array<string>")
    return df.select("*", none.alias("qualifiers"), none.alias("context"), F.lit(1).alias("n")).select("id", "relation", "tails", "heads", "qualifiers", "context", F.from_json(F.lit('{"confidence":0.9}'), "source array<map<string,string>>, method string, agent string, time timestamp, confidence double, hash string, evidence string, derivation array<string>").alias("prov"))


def stored_nodes(spark, rows):
    df = spark.createDataFrame(rows, "id string, type string, statement string")
    return df.select("id", "type", F.array().cast("array<string>").alias("labels"), F.create_map(F.lit("statement"), "statement").alias("data"), F.lit(None).alias("context"), F.from_json(F.lit('{"source":[{"type":"statute"}],"confidence":0.9}'), "source array<map<string,string>>, method string, agent string, time timestamp, confidence double, hash string, evidence string, derivation array<string>").alias("prov"))


def test_store_keeps_the_order_of_insertion(spark, tmp_path):
    """Four equal rules: the first inserted fires, before and after compaction, also if it is written again."""
    from verdigraph.operators.hyper import forward_chain_exact

    s = GraphStore(spark, f"file://{tmp_path}/store")
    s.add_nodes(stored_nodes(spark, [("z", "Fact", "P"), ("a", "Fact", "Q")]))
    s.add_edges(stored_edges(spark, [("r9", "implies", ["z"], ["R"]), ("r2", "implies", ["z"], ["R"]), ("r5", "implies", ["z"], ["R"]), ("r1", "implies", ["z"], ["R"])]).repartition(1))
    s.add_edges(stored_edges(spark, [("r0", "implies", ["z"], ["R"]), ("r9", "implies", ["z"], ["R"])]))
    for _ in range(2):
        assert [r["id"] for r in s.edges().orderBy("ord").collect()] == ["r9", "r2", "r5", "r1", "r0"]
        assert [r["edge_id"] for r in forward_chain_exact(s.facts("x"), s.implications()).collect()] == ["r9"]
        assert [r["id"] for r in s.facts().orderBy("seq").collect()] == ["z", "a"]
        s.compact()
    s.add_edges(stored_edges(spark, [("r8", "implies", ["z"], ["R"])]))
    assert [r["id"] for r in s.edges().orderBy("ord").collect()] == ["r9", "r2", "r5", "r1", "r0", "r8"]


def test_store_lookups_against_a_dictionary(spark, tmp_path):
    rng = random.Random(11)
    s, want = GraphStore(spark, f"file://{tmp_path}/store", buckets=4), {}
    for k in range(4):
        rows = [(f"e{rng.randrange(60)}", rng.choice(["implies", "cites"]), rng.sample("abcdefgh", rng.randrange(1, 4)), rng.sample("uvwxyz", rng.randrange(1, 3))) for _ in range(40)]
        s.add_edges(stored_edges(spark, rows).coalesce(1))
        for r in rows:
            want[r[0]] = r
        if k == 2:
            s.compact()
        ids = lambda df: sorted(r["id"] for r in df.collect())
        for key in "ah":
            assert ids(s.outgoing(key)) == sorted(i for i, r in want.items() if key in r[2])
        assert ids(s.incoming("x")) == sorted(i for i, r in want.items() if "x" in r[3])
        assert ids(s.edges_by_relation("cites")) == sorted(i for i, r in want.items() if r[1] == "cites")
        assert [r["tails"] for r in s.edge("e7").collect()] == [want[k][2] for k in ["e7"] if k in want] and s.edge("none").count() == s.outgoing("none").count() == 0
        assert [r["id"] for r in s.edges().orderBy("ord").collect()] == list(want)


def test_lookups_read_the_index_and_few_buckets(spark, tmp_path):
    s = GraphStore(spark, f"file://{tmp_path}/store", buckets=8)
    s.add_edges(stored_edges(spark, [(f"e{i}", "cites", [f"t{i}"], [f"h{i % 3}"]) for i in range(4000)]))

    def read(df):
        """The scans of the edge table and of its index."""
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        scans = [x for x in plan.splitlines() if "FileScan" in x]
        return {"edges_index": [x for x in scans if "[key#" in x], "edges": [x for x in scans if "[key#" not in x]}, plan

    scans, plan = read(s.outgoing("t77"))
    assert scans["edges_index"] and all("bucket" in x.split("PartitionFilters:")[1].split("PushedFilters")[0] for x in scans["edges_index"]) and "EqualTo(key,t77)" in plan
    assert scans["edges"] and all("dynamicpruning" in x for x in scans["edges"])
    scans, plan = read(s.edge("e77"))
    assert not scans["edges_index"] and all("bucket" in x.split("PartitionFilters:")[1].split("PushedFilters")[0] for x in scans["edges"])


def test_a_batch_without_its_mark_does_not_count(spark, tmp_path):
    s = GraphStore(spark, f"file://{tmp_path}/store")
    s.add_edges(stored_edges(spark, [("a", "cites", ["x"], ["y"])]))
    s.add_edges(stored_edges(spark, [("b", "cites", ["x"], ["y"])]))
    (tmp_path / "store/edges/_done-00000002").unlink()
    assert [r["id"] for r in s.outgoing("x").collect()] == ["a"]
    s.add_edges(stored_edges(spark, [("c", "cites", ["x"], ["y"])]))
    assert sorted(r["id"] for r in s.outgoing("x").collect()) == ["a", "c"]


def test_folder(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("café \n two".encode() + b"\xff")
    (tmp_path / "b.txt").write_text("")
    (tmp_path / "c.md").write_text("no")
    (tmp_path / "d.txt").write_text("ok")
    got = {r["path"].rsplit("/", 1)[1]: (r["text"], r["failed"]) for r in read_folder(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("café \n two�", True), "d.txt": ("ok", False)}


def test_spans_are_greedy():
    rng = random.Random(1)
    for _ in range(50):
        found = [{"start": (a := rng.randint(0, 60)), "end": a + rng.randint(1, 9), "score": rng.choice([0.85, 0.9])} for _ in range(30)]
        kept = []
        for e in sorted(found, key=lambda e: -e["score"]):
            if not any(e["start"] < k["end"] and e["end"] > k["start"] for k in kept):
                kept.append(e)
        assert greedy_spans(found) == kept


def test_entities_and_obligations():
    got = [(e["entity_group"], e["word"]) for e in entities_of("Jane Doe paid $5,000 on 3/4/2020 under 42 U.S.C. § 1981.")]
    assert ("MONEY", "$5,000") in got and ("DATE", "3/4/2020") in got and ("STATUTE", "42 U.S.C. § 1981") in got and ("PERSON", "Jane Doe") in got
    assert entities_of(None) == [] and obligations_of(None) == []
    (o,) = obligations_of("The employer must provide notice. Others may not.")
    assert (o["bearer"], o["duty"], o["start"]) == ("The employer", "provide notice", 0)


def test_obligations_are_what_the_patterns_find():
    rng = random.Random(3)
    words = ["a", "tenant", "shall", "must", "owes", "is required to", "are required to", "pay", ",", ".", "!", "\n", "has a duty to", "-"]
    for _ in range(400):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 25)))
        want = [(m.group(1).strip(), m.group(2).strip(), m.start(), m.end()) for p in OBLIGATION_PATTERNS for m in re.finditer(p, text, re.IGNORECASE)]
        assert [(o["bearer"], o["duty"], o["start"], o["end"]) for o in obligations_of(text)] == want, text
    assert obligations_of("word " * 20000) == []


def test_citations(spark):
    text = "; Brown v. Board, 347 U.S. 483 (1954); 42 U.S.C. § 1981; 29 CFR 1630.2; U.S. Const. Amend. XIV; U.S. Const. Art. I, § 8;"
    got = standard_form(citation_parts(extract_citations(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")))).collect()
    full = next(r for r in got if r["type"] == "case" and r["page"])
    assert (full["plaintiff"], full["defendant"], full["volume"], full["reporter"], full["page"], full["year"], full["confidence"]) == ("Brown", "Board", "347", "U.S.", "483", "1954", 0.95)
    assert full["standard_form"] == "Brown v. Board, 347 U.S. 483"
    assert {(r["title"], r["section"]) for r in got if r["type"] == "statute"} == {("42", "1981"), ("29", "1630.2")}
    assert {r["article_or_amendment"] for r in got if r["type"] == "constitution"} == {"XIV", "I"}


def test_document_graph_years(spark):
    docs = spark.createDataFrame([(1, "; Ann v. Bob, 1 U.S. 2 (1999); Cy v. Di; 5 USC 6;")], "doc_id long, text string")
    nodes, edges = documents_graph(docs, default_year=1980)
    assert {r["id"]: r["year"] for r in nodes.collect() if r["kind"] == "case"} == {"case::Ann_v_Bob_1999": 1999, "case::Cy_v_Di": 1980}
    assert {(r["label"], r["src"], r["year"]) for r in edges.collect() if r["label"] == "persuasive_relation"} == {("persuasive_relation", "case::Ann_v_Bob_1999", 1999)}
    assert documents_graph(docs, assume_persuasive=False)[1].count() == 2


def test_redaction(spark):
    text = "SSN 123-45-6789, born 1980-02-03 or 2/3/1980, mail A.B@x.org, call (555) 123-4567, at 12 Main Street, 90210-1234, DL A1234567"
    row = spark.createDataFrame([(text,)], "t string").select(redact_pii(F.col("t")).alias("r"), pii_left(redact_pii(F.col("t"))).alias("l"), pii_left(F.col("t")).alias("b")).first()
    assert row["r"].startswith("SSN XXX-XX-XXXX, born YYYY-MM-DD or MM/DD/YYYY, mail [redacted_email], call ") and "[redacted_zip]" in row["r"] and "[redacted_dl]" in row["r"] and "[redacted_address]" in row["r"]
    assert row["b"] and not row["l"]
    other = [("d", r"\d+", "#", "drop"), ("h", "x+", "#", "hash")]
    got = spark.createDataFrame([("a1xx",)], "t string").select(redact_pii(F.col("t"), other).alias("r")).first()["r"]
    assert len(got) == 65 and got[0] == "a"
    assert [r["c"] for r in spark.createDataFrame([("F. Supp. 2d",), ("F.2d",), ("Zzz",)], "t string").select(canonical_reporter(F.col("t")).alias("c")).collect()] == ["FSupp2d", "F2d", None]


def test_plugin(spark, tmp_path):
    loader = PluginLoader("plugins")
    assert loader.discover() == ["contract_law"]
    plugin = loader.load("contract_law")
    assert loader.load("contract_law") is plugin and plugin.provides("rules") and loader.with_capability("mapping") == [plugin] and loader.for_jurisdiction("US") == [plugin]
    docs = spark.createDataFrame([(1, "She offered, he accepted and paid; then he breached it."), (2, "She offered a seat.")], "doc_id long, text string")
    found = analyze(docs, plugin, {"jurisdiction": "US-CA"})
    assert {(r["scope"], r["id"]) for r in found["conclusions"].collect()} == {("1", "contract_formed"), ("1", "damages_due")}
    assert plugin.instance.validate_extraction(found["entities"]).count() == 0
    assert {(r["scope"], r["statement"], r["rule_authority"]) for r in found["derived_facts"].collect()} == {("1", "contract_formed", "Restatement (Second) of Contracts § 17"), ("1", "damages_due", "Hadley v. Baxendale")}
    assert [r["statement"] for r in found["facts"].filter("scope = '1'").orderBy("seq").collect()] == ["offer_made", "offer_accepted", "consideration_given", "obligation_unmet"]
    more = docs.unionByName(spark.createDataFrame([(3, "see 42 U.S.C. § 12112")], docs.schema))
    told = {r["doc_id"]: json.loads(r["value"]) for r in analysis_report(more, analyze(more, plugin), {"jurisdiction": "US"}).collect()}
    assert set(told) == {"1", "2", "3"} and told["3"]["citations"] == [{"text": "42 U.S.C. § 12112", "start": 4, "end": 21, "citation_type": "statute", "normalized": "42 U.S.C. § 12112"}]
    assert [f["statement"] for f in told["1"]["derived_facts"]] == ["contract_formed", "damages_due"] and told["1"]["conclusions"][1]["legal_basis"] == "Hadley v. Baxendale" and told["2"]["derived_facts"] == [] and told["1"]["context"] == {"jurisdiction": "US"}
    assert [f["statement"] for f in told["2"]["original_facts"]] == ["offer_made"] and told["2"]["entities"][0]["type"] == "OFFER"
    loader.unload("contract_law")
    (tmp_path / "liar").mkdir()
    (tmp_path / "liar" / "plugin.yaml").write_text("{schema: s, id: liar, version: '1', displayName: L, domains: [], jurisdictions: [], capabilities: {provides: [rules]}}")
    (tmp_path / "liar" / "plugin.py").write_text("class Plugin: pass")
    with pytest.raises(ValueError):
        PluginLoader(str(tmp_path)).load("liar")
    (tmp_path / "liar" / "plugin.yaml").write_text("{schema: s}")
    with pytest.raises(ValueError):
        PluginLoader(str(tmp_path)).load("liar")


def test_streams(spark, tmp_path):
    spark.createDataFrame([("cites", "a", "b"), ("same_issue", "a", "b")], "label string, u string, v string").write.parquet(str(tmp_path / "in" / "1"))
    spark.createDataFrame([("persuasive_relation", "a", "b")], "label string, u string, v string").write.parquet(str(tmp_path / "in" / "2"))
    stream = spark.readStream.schema("label string, u string, v string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    keep_facts(stream, derivation_rules(), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert [r["statement"] for r in latest_facts(spark, str(tmp_path / "out")).collect()] == ["persuasive_for(a,b)"]
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    live = spark.readStream.schema(events.schema).parquet("/root/testdata/sf0.001/events*.parquet")
    q = windowed_counts(live).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM counts").first()[0] == events.count()


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "t.txt").write_text("; Ann v. Bob; 5 USC 6; She offered, he accepted and paid;")
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    assert main(["graph", str(tmp_path / "t.txt"), str(tmp_path / "g")]) == 0
    assert {r["label"] for r in read_graphml(spark, str(tmp_path / "g")).edge_labels().collect()} == {"cites"}
    (tmp_path / "m.graphml").write_text('<graphml><key id="c" for="edge" attr.name="contrary_to" attr.type="double"/><graph edgedefault="directed"><node id="A"/><node id="B"/><edge source="A" target="B"><data key="c">1.0</data></edge></graph></graphml>')
    assert main(["reason", str(tmp_path / "m.graphml"), "fraud", "--config", "config"]) == 0
    assert '"statement":"contrary_authority(A)"' in capsys.readouterr().out
    assert main(["analyze", "plugins", "contract_law", str(tmp_path), "--format", "json"]) == 0
    assert "contract_formed" in capsys.readouterr().out
    assert main(["analyze", "plugins", "contract_law", str(tmp_path)]) == 0
    assert main(["reason", str(tmp_path / "none.graphml"), "fraud"]) == 2


def test_reason_on_derived_labels(spark):
    g = from_labels(spark.createDataFrame([], "label string, id string"), spark.createDataFrame([("e", "a", "b")], "label string, u string, v string"))
    first = Rule("r", "edge", "f", ("x", "y"), (edge("e", "x", "y"),))
    second = Rule("s", "node", "n", ("x",), (edge("f", "x", "y"),))
    assert reason([first, second], g).facts.count() == 1
    from verdigraph.operators.derive import derive_recursively

    assert {r["label"] for r in derive_recursively([first, second], g).collect()} == {"f", "n"}


def test_each_match_is_hashed_by_itself(spark):
    text = "a@x.org, b@y.net and a@x.org!"
    email = [(*p, "hash") for p in PII_PATTERNS if p[0] == "email"]
    a, b = (hashlib.sha256(x.encode()).hexdigest() for x in ("a@x.org", "b@y.net"))
    got = spark.createDataFrame([(text,), ("none",), (None,), ("",)], "t string").select(redact_pii(F.col("t"), email).alias("r")).collect()
    assert [r["r"] for r in got] == [f"{a}, {b} and {a}!", "none", None, ""]


def test_redaction_of_documents_is_that_of_re(spark):
    want = {}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        t = r["text"]
        for _, pattern, mask in PII_PATTERNS:
            t = re.sub(pattern, mask, t, flags=re.ASCII)
        want[r["doc_id"]] = hashlib.md5(t.encode()).hexdigest()
    assert {r["doc_id"]: r["digest"] for r in QUERIES["redact_documents"](spark, "/root/testdata/sf0.001").collect()} == want


def test_every_reporter_and_the_order_of_parallel_ones(spark):
    spelt = [(k, w) for k, written, _ in REPORTERS for w in (written, written.lower().replace(".", ""), f" {written} ")]
    got = spark.createDataFrame(spelt, "k string, w string").select("k", "w", canonical_reporter(F.col("w")).alias("c")).collect()
    assert len(REPORTERS) == 33 and not [r for r in got if r["c"] != r["k"]]
    assert sorted(PARALLEL_ORDER) == sorted(k for k, *_ in REPORTERS)
    row = spark.createDataFrame([("410 U.S. 113, 93 S. Ct. 705",)], "t string").select(reporters_in(F.col("t")).alias("r"), preferred_reporter(reporters_in(F.col("t"))).alias("p"), preferred_reporter(F.array(F.lit("nothing"))).alias("n")).first()
    assert {"US", "Sct"} <= set(row["r"]) and row["p"] == "US" and row["n"] is None


def test_audit_chain_over_partitions(spark):
    rows = [(f"log{i % 3}", i, None if i == 7 else f'say "{i}" é') for i in range(50)] + [("one", 1, "x")]
    got = {(r["log"], r["seq"]): (r["prev_hash"], r["hash"]) for r in audit_chain(spark.createDataFrame(rows, "log string, seq long, payload string").repartition(5)).collect()}
    last = {}
    for log, seq, payload in sorted(rows, key=lambda r: r[:2]):
        entry = ({} if payload is None else {"payload": payload}) | {"prev_hash": last.get(log, "")}
        digest = hashlib.sha256(json.dumps(entry, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
        assert got.pop((log, seq)) == (last.get(log, ""), digest)
        last[log] = digest
    assert not got


@pytest.mark.parametrize("parts", [1, 2, 9, 200])
def test_faults_of_a_chain(spark, parts):
    """One long log and some short ones, wherever ranges end: changed, missing, moved and added entries are placed."""
    rows = [("long", i, f"p{i % 5}") for i in range(500)] + [(f"log{i % 30}", i, "x") for i in range(60)]
    entries = [tuple(r) for r in audit_chain(spark.createDataFrame(rows, "log string, seq long, payload string")).collect()]
    schema = "log string, seq long, payload string, prev_hash string, hash string"
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert verify_chain(spark.createDataFrame(entries, schema)).count() == 0
        bad = []
        for log, seq, said, before, own in entries:
            if log == "long" and seq in (0, 100, 250, 333):
                continue
            if (log, seq) in (("long", 77), ("log3", 3)):
                said = "changed"
            if (log, seq) == ("long", 400):
                own = None
            bad.append((log, seq, said, before, own))
        bad.append(("log4", 999, "added", "f" * 64, "0" * 64))
        got = {tuple(r) for r in verify_chain(spark.createDataFrame(bad, schema)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    links = {("long", i + 1, "link") for i in (0, 100, 250, 333, 400)} | {("log4", 999, "link")}
    assert got == links | {("long", 77, "hash"), ("log3", 3, "hash"), ("long", 400, "hash"), ("log4", 999, "hash")}


def test_detailed_report(spark):
    e = spark.createDataFrame([(1, "MONEY", "$5", 9, 0.9), (1, "DATE", "2020-01-02", 2, 0.9)], "doc_id long, entity_group string, word string, start int, score double")
    c = spark.createDataFrame([(1, "case", "A v. B"), (2, "statute", "1 USC 2")], "doc_id long, type string, raw string")
    d = spark.createDataFrame([(1, "x", "It holds", "Act 1", 0.75)], "doc_id long, id string, statement string, authority string, confidence double")
    got = {r["value"] for r in detailed(e, c, d).collect()}
    assert got == {"Document 1\nEntities found\n  DATE: 2020-01-02 (90.0%)\n  MONEY: $5 (90.0%)\nCitations found\n  case: A v. B\nConclusions reached\n  It holds (75.0%, by Act 1)", "Document 2\nCitations found\n  statute: 1 USC 2"}


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Fake:
        def __init__(self, **conf):
            self.conf = self.sparkContext = self
            self.getConf = lambda: self
            self.get = lambda k, d=None: conf.get(k, d)

    with pytest.raises(ValueError):
        scratch(Fake(**{"spark.master": "spark://host:7077"}))
    assert scratch(Fake(**{"spark.master": "yarn", "spark.checkpoint.dir": "hdfs:///x/"})) == "hdfs:///x"


def test_entry_survives_a_missing_library(monkeypatch):
    monkeypatch.setitem(sys.modules, "verdigraph.llm.queries", None)
    assert set(entry.queries()) == set(QUERIES)
