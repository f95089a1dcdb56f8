"""GraphML as a Spark data source: a partition for each file when read, a file for each partition when written.

    spark.dataSource.register(GraphmlSource)
    spark.read.format("graphml").load("graphs/*.graphml")
    rows.write.format("graphml").option("keys", json.dumps(names)).mode("overwrite").save("out")

Each file is read by itself, with its own keys and its own direction, as a
stream. Paths are those that pyarrow.fs opens (local and shared folders, hdfs,
s3, gs, abfs); graph.graphml_tables() reads files of any store that Spark
reads, and splits large ones.
"""

from __future__ import annotations

import fnmatch
import json
import posixpath
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: What stands for a mark in the texts that are written: no line break, quote or bracket, so that an element is one line.
MARKS = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "\n": "&#10;", "\r": "&#13;", "\t": "&#9;"}
ROWS = "file string, pos bigint, kind string, id string, src string, dst string, directed boolean, attrs map<string,struct<type:string,value:string>>"


def _plain(text: str) -> str:
    return escape(text, {k: v for k, v in MARKS.items() if k not in "&<>"})


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else posixpath.abspath(path))


def _files(path: str) -> list[str]:
    """The files of a path, a folder or a pattern in the last part of a path, in order; hidden ones are left out."""
    store, at = _opened(path)
    folder, pattern = (posixpath.dirname(at), posixpath.basename(at)) if "*" in posixpath.basename(at) else (at, "*")
    info = store.get_file_info(folder)
    if info.type == fs.FileType.File:
        return [at]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    inside = store.get_file_info(fs.FileSelector(folder))
    return sorted(f.path for f in inside if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")) and fnmatch.fnmatch(f.base_name, pattern))


def parsed(stream, name: str) -> Iterator[tuple]:
    """Rows of one file, as they come; what has been read is let go."""
    keys: dict[str, tuple[str, str]] = {}
    graph, directed, pos = None, True, 0
    for event, e in ElementTree.iterparse(stream, events=("start", "end")):
        tag = e.tag.rpartition("}")[2]
        if event == "start":
            if tag == "graph" and graph is None:
                graph, directed = e, e.get("edgedefault") != "undirected"
            continue
        if tag == "key":
            keys[e.get("id")] = (e.get("attr.name") or e.get("id"), e.get("attr.type") or "string")
        elif tag in ("node", "edge"):
            attrs = {}
            for d in e:
                if d.tag.rpartition("}")[2] == "data":
                    label, kind = keys.get(d.get("key"), (d.get("key"), "string"))
                    attrs[label] = (kind, d.text)
            yield name, pos, tag, e.get("id") if tag == "node" else None, e.get("source"), e.get("target"), directed, attrs
            pos += 1
            graph.clear()


class GraphmlReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in _files(self.path)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition is None:
            return
        store, _ = _opened(self.path)
        with store.open_input_stream(partition.value) as stream:
            yield from parsed(stream, partition.value)


@dataclass
class Written(WriterCommitMessage):
    part: str | None


class GraphmlWriter(DataSourceArrowWriter):
    """Each task writes a whole GraphML file aside; commit puts those of the tasks that count in place, whatever was tried twice.

    Rows have kind, id, src, dst and attrs, or just `line`, the element itself, as Spark has rendered it.
    """

    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.keys = json.loads(options["keys"])
        self.rendered = schema.names == ["line"]
        self.run = uuid.uuid4().hex

    def _aside(self, root: str) -> str:
        return f"{root}/_temporary-{self.run}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        some = (b for b in batches if b.num_rows)
        first = next(some, None)
        if first is None:
            return Written(None)
        store, root = _opened(self.path)
        store.create_dir(self._aside(root), recursive=True)
        part = uuid.uuid4().hex
        with store.open_output_stream(f"{self._aside(root)}/{part}") as out:
            out.write(self._head())
            for batch in (b for part_ in ([first], some) for b in part_):
                out.write(self._lines(batch))
            out.write(b"</graph></graphml>\n")
        return Written(part)

    def _lines(self, batch: pa.RecordBatch) -> bytes | memoryview:
        if not self.rendered:
            return b"".join(map(self._line, batch.to_pylist()))
        if batch.column(0).null_count:
            raise ValueError("a node or an edge has no id")
        # A string array's data are its texts, one after the other.
        texts = batch.column(0).cast(pa.large_string())
        ends = np.frombuffer(texts.buffers()[1], np.int64)
        return memoryview(texts.buffers()[2])[ends[texts.offset] : ends[texts.offset + len(texts)]]

    def _head(self) -> bytes:
        known = "".join(f'<key id="{_plain(k)}" for="{of}" attr.name="{_plain(k)}" attr.type="string"/>\n' for k, of in sorted(self.keys.items()))
        return f'<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n{known}<graph edgedefault="directed">\n'.encode()

    def _line(self, row: dict) -> bytes:
        kind, name, src, dst, attrs = (row[c] for c in ("kind", "id", "src", "dst", "attrs"))
        said = "".join(f'<data key="{_plain(k)}">{_plain(v)}</data>' for k, v in dict(attrs or {}).items() if v is not None)
        ends = f'id="{_plain(name)}"' if kind == "node" else f'source="{_plain(src)}" target="{_plain(dst)}"'
        return f"<{kind} {ends}>{said}</{kind}>\n".encode()

    def commit(self, messages: list[Written]) -> None:
        store, root = _opened(self.path)
        old = _files(self.path) if store.get_file_info(root).type == fs.FileType.Directory else []
        if old and not self.overwrite:
            raise FileExistsError(self.path)
        for f in old:
            store.delete_file(f)
        store.create_dir(root, recursive=True)
        parts = [m.part for m in messages if m and m.part]
        for i, part in enumerate(parts):
            store.move(f"{self._aside(root)}/{part}", f"{root}/part-{i:05d}.graphml")
        if not parts:
            with store.open_output_stream(f"{root}/part-00000.graphml") as out:
                out.write(self._head() + b"</graph></graphml>\n")
        self._clear(store, root)

    def abort(self, messages: list[Written]) -> None:
        store, root = _opened(self.path)
        self._clear(store, root)

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        if store.get_file_info(self._aside(root)).type == fs.FileType.Directory:
            store.delete_dir(self._aside(root))


class GraphmlSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "graphml"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema: StructType) -> GraphmlReader:
        return GraphmlReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> GraphmlWriter:
        return GraphmlWriter(self.options, schema, overwrite)


def graphml_rows(spark: SparkSession, path: str) -> DataFrame:
    """Nodes and edges of the files of a path (ROWS), pos in order within each file."""
    spark.dataSource.register(GraphmlSource)
    return spark.read.format("graphml").load(path)


def _escaped(c: Column) -> Column:
    for mark, name in MARKS.items():
        c = F.replace(c, F.lit(mark), F.lit(name))
    return c


def _element(kind: str, **ends: Column) -> Column:
    """A node or an edge with its attrs as a line; null without an end. Texts are escaped only in rows that have a mark."""

    def line(text: Callable[[Column], Column]) -> Column:
        said = F.transform(F.map_entries("attrs"), lambda e: F.concat(F.lit('<data key="'), text(e["key"]), F.lit('">'), text(e["value"]), F.lit("</data>")))
        named = [x for k, c in ends.items() for x in (F.lit(f' {k}="'), text(c.cast("string")), F.lit('"'))]
        return F.concat(F.lit(f"<{kind}"), *named, F.lit(">"), F.coalesce(F.array_join(said, ""), F.lit("")), F.lit(f"</{kind}>\n"))

    texts = F.concat_ws("", *[c.cast("string") for c in ends.values()], F.map_keys("attrs"), F.map_values("attrs"))
    return F.when(texts.rlike(f"[{''.join(MARKS)}]"), line(_escaped)).otherwise(line(lambda c: c)).alias("line")


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """nodes(id, attrs map<string,string>) and edges(src, dst, attrs) as a folder of GraphML files, one for each partition of either.

    Nothing is sorted or brought together: each file is whole by itself, and
    the folder is read as one graph. Keys are strings, named as the
    attributes are (only their names reach the driver). Null values have no
    entry. Files of an earlier graph in the folder are replaced.
    """
    spark = nodes.sparkSession
    spark.dataSource.register(GraphmlSource)
    named = lambda df, of: df.select(F.explode(F.map_keys("attrs")).alias("k"), F.lit(of).alias("of"))
    keys = named(nodes, "node").unionByName(named(edges, "edge")).groupBy("k").agg(F.min("of").alias("of"), F.count_distinct("of").alias("n"))
    names = {r["k"]: "all" if r["n"] > 1 else r["of"] for r in keys.collect()}
    rows = nodes.select(_element("node", id=F.col("id"))).unionByName(edges.select(_element("edge", source=F.col("src"), target=F.col("dst"))))
    rows.write.format("graphml").option("keys", json.dumps(names)).mode("overwrite").save(path)
