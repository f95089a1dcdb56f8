"""Labelled graphs as two tables with one row for each node and edge, and their label sets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigraph.sources.scratch import maybe_broadcast, settle

#: Files whose keys may be broadcast.
FILES = 100_000
#: Hashes of repeated keys that may be broadcast.
REPEATED = 1_000_000
#: Bytes of the longest line that is read as one element.
LINE = 1 << 24
_SAID = r'(?:\s+[\w:.-]+="[^"<]*+")*+\s*+'
_DATA = r'(?:<data key="[^"<]*+">[^<"]*+</data>)*+'
#: Lines of one whole element, and those around the elements.
ELEMENT = rf'^(?:<edge source="[^"<]*+" target="[^"<]*+"(?:/>|>{_DATA}</edge>)|<node id="[^"<]*+"(?:/>|>{_DATA}</node>))\s*+$'
HEAD = rf'^\s*+(?:<\?xml version="1\.0"(?: encoding="(?i:utf-8)")?\s*\?>|<(?:graphml|graph){_SAID}>|<key{_SAID}/>|(?:</graph>)?(?:</graphml>)?)\s*+$'
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "#10": "\n", "#13": "\r", "#9": "\t", "amp": "&"}
OTHER_ENTITY = rf"&(?!(?:{'|'.join(ENTITIES)});)"
FALSE_WORDS = ("", "false", "no", "n", "0", "none", "null")
NUMERIC = ("int", "long", "float", "double")
ATTRS = "map<string,struct<type:string,value:string>>"


def truthy(value: Column, kind: Column | None = None) -> Column:
    """Whether an attribute is a label: numbers by value (NaN counts), booleans and strings by word; null is none."""
    word = F.lower(F.trim(value))
    by_word = ~word.isin(*FALSE_WORDS)
    if kind is not None:
        number = word.try_cast("double")
        by_word = F.when(F.lower(kind).isin(*NUMERIC), F.coalesce(number != 0, F.lit(False))).otherwise(by_word)
    return F.coalesce(by_word, F.lit(False))


@dataclass(frozen=True)
class Graph:
    """nodes(id, labels array<string>) and edges(u, v, labels array<string>), each id and each pair once.

    Clauses over the same variables read one row, so a conjunction of edge
    labels is a filter and not a join. node_labels() and edge_labels() are
    the same as one row for each label.
    """

    nodes: DataFrame
    edges: DataFrame

    def node_labels(self) -> DataFrame:
        return self.nodes.select(F.explode("labels").alias("label"), "id")

    def edge_labels(self) -> DataFrame:
        return self.edges.select(F.explode("labels").alias("label"), "u", "v")

    def reversed(self) -> Graph:
        return Graph(self.nodes, self.edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "labels"))

    def undirected(self) -> Graph:
        """Every edge in both directions; labels of opposite edges are joined."""
        both = self.edges.unionByName(self.reversed().edges)
        return Graph(self.nodes, both.groupBy("u", "v").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("labels")))).alias("labels")))

    def with_labels(self, derived: DataFrame) -> Graph:
        """The graph with derived statements (label, arg0, arg1) as labels too."""
        nodes = self.node_labels().unionByName(derived.filter("arg1 IS NULL").select("label", F.col("arg0").alias("id")))
        edges = self.edge_labels().unionByName(derived.filter("arg1 IS NOT NULL").select("label", F.col("arg0").alias("u"), F.col("arg1").alias("v")))
        return from_labels(nodes, edges)


def from_labels(node_labels: DataFrame, edge_labels: DataFrame) -> Graph:
    """A graph from (label, id) and (label, u, v) rows; repeats are fine."""
    gathered = F.array_sort(F.collect_set("label")).alias("labels")
    return Graph(node_labels.groupBy("id").agg(gathered), edge_labels.groupBy("u", "v").agg(gathered))


def label_set(**flags: Column) -> Column:
    """Array of the names whose flag holds."""
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in flags.items()]))


def from_attributes(nodes: DataFrame, edges: DataFrame, reverse: bool = False) -> Graph:
    """A graph from nodes(id, attrs[, seq]) and edges(src, dst, attrs[, seq, directed]): truthy attributes are labels.

    attrs maps a name to its type and value. Where there is a seq, repeated
    nodes and parallel edges are one, with the last value of each attribute.
    An edge that isn't directed goes both ways.
    """
    own = F.transform(F.filter(F.map_entries("attrs"), lambda e: truthy(e["value"]["value"], e["value"]["type"])), lambda e: e["key"])
    if "directed" in edges.columns:
        way, back = F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))
        each = edges.withColumn("way", F.explode(F.when(~F.col("directed"), F.array(way, back)).otherwise(F.array(way))))
        edges = each.withColumns({"src": F.col("way.src"), "dst": F.col("way.dst")}).drop("way")
    labelled = lambda df, keys: _last_labels(df, keys) if "seq" in df.columns else df.select(*keys, F.array_sort(own).alias("labels"))
    graph = Graph(labelled(nodes, ["id"]), labelled(edges, ["src", "dst"]).select(F.col("src").alias("u"), F.col("dst").alias("v"), "labels"))
    return graph.reversed() if reverse else graph


def _last_labels(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, labels) of rows(keys, attrs, seq): the names whose last value for a key is truthy.

    Keys are counted by a hash. Rows whose hash occurs once, nearly all, keep
    their names as they are and aren't shuffled; the others (repeated keys,
    and different ones of an equal hash) are taken apart and compared by seq.
    """
    told = F.transform(F.map_entries("attrs"), lambda e: F.struct(e["key"].alias("key"), truthy(e["value"]["value"], e["value"]["type"]).alias("yes")))
    hashed = rows.withColumn("hash", F.xxhash64(*keys))
    again = settle(hashed.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash"), "again")
    own = F.transform(F.filter(told, lambda e: e["yes"]), lambda e: e["key"])
    labels = F.sort_array(F.coalesce(own, F.array().cast("array<string>"))).alias("labels")
    if again.isEmpty():
        return settle(rows.select(*keys, labels), "labels")
    some = maybe_broadcast(again, REPEATED)
    once = hashed.join(some, "hash", "left_anti").select(*keys, labels)
    each = hashed.join(some, "hash", "left_semi").select(*keys, "seq", F.explode_outer(told).alias("t"))
    last = each.groupBy(*keys, F.col("t.key").alias("key")).agg(F.max_by("t.yes", "seq").alias("yes"))
    return settle(once.unionByName(last.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("yes"), F.col("key")))).alias("labels"))), "labels")


def collapse(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows(keys, attrs, seq) with one row for each key; the last value of each attribute wins."""
    each = rows.select(*keys, "seq", F.explode_outer(F.map_entries("attrs")).alias("a"))
    last = each.groupBy(*keys, F.col("a.key").alias("key")).agg(F.max_by("a.value", "seq").alias("value"))
    kept = F.collect_list(F.when(F.col("key").isNotNull(), F.struct("key", "value")))
    return last.groupBy(*keys).agg(F.map_from_entries(F.array_sort(kept)).alias("attrs"))


def collapse_parallel(edges: DataFrame) -> DataFrame:
    """edges(src, dst, attrs, seq) with one row for each pair; the last value of each attribute wins."""
    return collapse(edges, ["src", "dst"])


def read_graphml(spark: SparkSession, path: str, reverse: bool = False) -> Graph:
    """A GraphML file (or many: a folder or a glob) as one graph."""
    return from_attributes(*graphml_tables(spark, path), reverse=reverse)


def graphml_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes(id, attrs, seq) and edges(src, dst, attrs, seq, directed) of GraphML files, through Spark's readers.

    Keys and direction are those of the file that a node or edge is in: a
    key's id may mean something else in another file. seq goes by file, then
    by place in the file. (graphml.graphml_rows() reads a file as one stream.)

    Files that have an element a line throughout, as write_graphml() writes
    them, are split and read as lines; all others by Spark's XML source.
    """
    files = _line_files(spark, path)
    told = files.select("file", "whole", "nodes", "edges").limit(FILES + 1).collect()
    if len(told) > FILES or not any(r["whole"] for r in told):
        return _xml_tables(spark, path)
    nodes, edges = (_line_elements(spark, path, files, kind, [r["file"] for r in told if r["whole"] and r[f"{kind}s"]]) for kind in ("node", "edge"))
    odd = [r["file"] for r in told if not r["whole"]]
    if odd:
        others = _xml_tables(spark, path, odd)
        nodes, edges = nodes.unionByName(others[0]), edges.unionByName(others[1])
    return nodes, edges


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the files of a path; those too long for a line of one element are left out, by which _line_files() tells their files."""
    return spark.read.option("lineSep", "\n").option("mapreduce.input.linerecordreader.line.maxlength", str(LINE)).text(path)


def _line_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, whole, nodes, edges, known, directed, plain) of the files of a path.

    whole: every byte of the file is in a line that is one element, or a head
    or an end. Then nothing goes over lines (no comment, no CDATA), and lines
    can be read by themselves. known has the file's keys, by id; plain: all
    are strings named as their ids.
    """
    line = F.col("value")
    head = F.when(line.rlike(HEAD), line)
    well = (line.rlike(ELEMENT) | head.isNotNull()) & ~(line.contains("&") & line.rlike(OTHER_ENTITY))
    kinds = {f"{kind}s": F.count_if(line.startswith(f"<{kind} ")).alias(f"{kind}s") for kind in ("node", "edge")}
    each = _lines(spark, path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), "value")
    seen = each.groupBy("file", "size", head.alias("head")).agg(F.sum(F.octet_length("value") + 1).alias("bytes"), F.bool_and(well).alias("well"), *kinds.values())
    said = lambda name: F.nullif(_unescaped(F.regexp_extract("head", rf'\s{name}="([^"]*)"', 1)), F.lit(""))
    key = F.struct(said("id"), F.struct(F.coalesce(said(r"attr\.name"), said("id")).alias("name"), F.coalesce(said(r"attr\.type"), F.lit("string")).alias("type")))
    kept = F.array_sort(F.collect_list(F.when(F.col("head").rlike(r"^\s*<key\s") & said("id").isNotNull(), key)))
    first = F.filter(kept, lambda k, i: (i == 0) | (k["col1"] != F.get(kept, i - 1)["col1"]))
    by_file = seen.groupBy("file", "size").agg(
        (F.bool_and("well") & (F.sum("bytes") - F.col("size")).isin(0, 1)).alias("whole"), F.sum("nodes").alias("nodes"), F.sum("edges").alias("edges"),
        F.map_from_entries(first).alias("known"),
        F.coalesce(F.bool_and(F.when(F.col("head").rlike(r"^\s*<graph\s"), F.coalesce(said("edgedefault"), F.lit("")) != "undirected")), F.lit(True)).alias("directed"),
    )
    own_names = F.forall(F.map_entries("known"), lambda e: (e["key"] == e["value"]["name"]) & (e["value"]["type"] == "string"))
    return settle(by_file.withColumn("plain", own_names), "files")


def _line_elements(spark: SparkSession, path: str, files: DataFrame, kind: str, names: list[str]) -> DataFrame:
    """Nodes or edges of the files with these names, in which each line is an element: what stands between quotes alternates with the rest."""
    line = F.col("value")
    read = _lines(spark, path).filter(F.col("_metadata.file_path").isin(names)).filter(line.startswith(f"<{kind} "))
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("seq")
    ends = {"node": ["id"], "edge": ["src", "dst"]}[kind]
    p = F.split(line, '"', 2 * len(ends) + 1)
    met = read.select(p.alias("p"), F.regexp_extract(F.get(p, F.lit(2 * len(ends))), '(?s)^><data key="(.*)</data></', 1).alias("body"), place)
    met = met.join(maybe_broadcast(files.select("file", "known", "plain", "directed"), FILES), F.col("seq.file") == F.col("file"))
    said = F.str_to_map("body", F.lit('</data><data key="'), F.lit('">'))
    each = F.transform(F.map_entries(said), lambda d: F.struct(_unescaped(d["key"]).alias("k"), F.nullif(_unescaped(d["value"]), F.lit("")).alias("v")))
    met_key = F.transform(each, lambda d: F.struct(d["k"].alias("k"), F.try_element_at("known", d["k"]).alias("of"), d["v"].alias("v")))
    named = F.transform(met_key, lambda d: F.struct(F.coalesce(d["of"]["name"], d["k"]).alias("key"), F.struct(F.coalesce(d["of"]["type"], F.lit("string")).alias("type"), d["v"].alias("value")).alias("value")))
    as_they_are = F.transform_values(said, lambda _, v: F.struct(F.lit("string").alias("type"), F.nullif(v, F.lit("")).alias("value")))
    attrs = F.when(F.col("body") == "", F.create_map().cast(ATTRS)).when(F.col("plain") & ~F.col("body").contains("&"), as_they_are).otherwise(F.map_from_entries(named))
    found = met.select(*[_unescaped(F.get("p", F.lit(2 * n + 1))).alias(c) for n, c in enumerate(ends)], attrs.alias("attrs"), "seq", "directed")
    return found if kind == "edge" else found.drop("directed")


def _unescaped(c: Column) -> Column:
    plain = c
    for name, mark in ENTITIES.items():
        plain = F.replace(plain, F.lit(f"&{name};"), F.lit(mark))
    return F.when(c.contains("&"), plain).otherwise(c)


def _xml_tables(spark: SparkSession, path: str, names: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a path's files, or of those with these names, through Spark's XML source."""
    data = "data array<struct<_key:string,_VALUE:string>>"
    source = spark.read.format("xml").option("ignoreNamespace", "true")
    file = F.col("_metadata.file_path").alias("file")
    wanted = F.lit(True) if names is None else F.col("_metadata.file_path").isin(names)
    keys = source.option("rowTag", "key").schema("_id string, `_attr.name` string, `_attr.type` string").load(path).filter(wanted)
    said = F.struct(F.coalesce("`_attr.name`", "_id").alias("name"), F.coalesce("`_attr.type`", F.lit("string")).alias("type"))
    by_file = keys.select(file, "_id", said.alias("said")).groupBy("file", "_id").agg(F.first("said").alias("said"))
    known = by_file.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("_id", "said"))).alias("known"))
    # A text up to each ">" is a tag: whole graphs never are one record.
    tags = spark.read.option("lineSep", ">").text(path).filter(wanted).select(file, F.regexp_extract("value", r"<(?:\w+:)?graph\s[^<]*edgedefault\s*=\s*[\"'](\w+)[\"']", 1).alias("way")).filter("way <> ''")
    ways = tags.groupBy("file").agg(F.bool_and(F.col("way") != "undirected").alias("directed"))

    def rows(tag: str, schema: str) -> DataFrame:
        read = source.option("rowTag", tag).schema(f"{schema}, {data}").load(path).filter(wanted)
        place = F.struct(file, F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("seq")
        met = read.select("*", file, place).join(maybe_broadcast(known, FILES), "file", "left").join(maybe_broadcast(ways, FILES), "file", "left")
        named = lambda d: F.try_element_at("known", d["_key"])
        entry = F.transform(F.coalesce("data", F.array().cast("array<struct<_key:string,_VALUE:string>>")), lambda d: F.struct(
            F.coalesce(named(d)["name"], d["_key"]).alias("key"),
            F.struct(F.coalesce(named(d)["type"], F.lit("string")).alias("type"), d["_VALUE"].alias("value")).alias("value"),
        ))
        return met.withColumns({"attrs": F.map_from_entries(entry), "directed": F.coalesce("directed", F.lit(True))})

    nodes = rows("node", "_id string").select(F.col("_id").alias("id"), "attrs", "seq")
    edges = rows("edge", "_source string, _target string").select(F.col("_source").alias("src"), F.col("_target").alias("dst"), "attrs", "seq", "directed")
    return nodes, edges
