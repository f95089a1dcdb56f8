"""Hypergraph tables in a folder: upsert with last one wins, inverted indexes for lookups, and compaction.

    nodes|edges/batch=N/bucket=B          rows of a batch, dealt by a hash of their id and sorted by it
    nodes_index|edges_index/field=F/batch=N/bucket=B   (key, id) for what rows are looked up by, dealt by the key

A lookup reads the index files of its key's bucket, and of the tables the
buckets that the found ids are in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigraph.errors import StoreError
from verdigraph.sources.scratch import settle

CONTEXT = "struct<jurisdiction:string,valid_from:timestamp,valid_to:timestamp,law_type:string,authority_level:string>"
PROV = "struct<source:array<map<string,string>>,method:string,agent:string,time:timestamp,confidence:double,hash:string,evidence:string,derivation:array<string>>"
NODE = f"id string, type string, labels array<string>, data map<string,string>, context {CONTEXT}, prov {PROV}"
EDGE = f"id string, relation string, tails array<string>, heads array<string>, qualifiers map<string,string>, context {CONTEXT}, prov {PROV}"
SCHEMAS = {"nodes": NODE, "edges": EDGE}
#: What each kind is looked up by: an array of keys of a row.
INDEXED = {
    "nodes": {
        "type": lambda: F.array("type"),
        "statement": lambda: F.array(F.try_element_at("data", F.lit("statement"))),
        "source": lambda: F.array_distinct(F.transform(F.coalesce("prov.source", F.array().cast("array<map<string,string>>")), lambda s: F.try_element_at(s, F.lit("type")))),
    },
    "edges": {"relation": lambda: F.array("relation"), "tail": lambda: F.array_distinct("tails"), "head": lambda: F.array_distinct("heads")},
}


class GraphStore:
    """nodes and edges as Parquet under a path that Spark can read and write; each write is one append-only batch, by one writer at a time.

    `ord` numbers the rows of all batches in the order of insertion: of rows
    with one id the last counts, in the place of the first.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int").alias("bucket")

    def _fs(self, at: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _batches(self, kind: str) -> list[int]:
        """The batches that count: whole ones, from the last compaction on."""
        fs, at = self._fs(f"{self.path}/{kind}")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        base = max([int(n.split("-")[1]) for n in names if n.startswith("_base-")], default=0)
        return sorted(b for n in names if n.startswith("_done-") and (b := int(n.split("-")[1])) >= base)

    def _marked(self, kind: str, name: str) -> None:
        fs, at = self._fs(f"{self.path}/{kind}/{name}")
        fs.create(at, True).close()

    def _ordered(self, rows: DataFrame, start: int) -> DataFrame:
        """Written rows with ord from start on, gapless, in the order of partitions and of rows in them: only a number of rows for each partition reaches the driver."""
        low = (1 << 33) - 1
        staged = settle(rows.withColumn("at", F.monotonically_increasing_id()), "batch")
        part = F.shiftright("at", 33).alias("part")
        sizes = sorted((r["part"], r["n"]) for r in staged.groupBy(part).agg(F.count("*").alias("n")).collect())
        starts, upto = [], start
        for p, n in sizes:
            starts.append((p, upto))
            upto += n
        offsets = F.broadcast(self.spark.createDataFrame(starts, "part long, start long"))
        return staged.withColumn("part", part).join(offsets, "part").withColumn("ord", F.col("start") + F.col("at").bitwiseAND(F.lit(low))).drop("part", "start", "at")

    def _write(self, kind: str, batch: int, rows: DataFrame) -> None:
        """rows (with ord) and their indexes; the batch counts once its mark is there."""
        at = f"{self.path}/{kind}/batch={batch:08d}"
        rows.withColumn("bucket", self._bucket(F.col("id"))).repartition(self.buckets, "bucket").sortWithinPartitions("bucket", "id").write.mode("overwrite").partitionBy("bucket").parquet(at)
        written = self.spark.read.schema(f"{SCHEMAS[kind]}, ord long, bucket int").parquet(at)
        for field, keys in INDEXED[kind].items():
            entries = written.select(F.explode(keys()).alias("key"), "id").filter("key IS NOT NULL").withColumn("bucket", self._bucket(F.col("key")))
            # Keys may be few: their entries are dealt by id too, so that no key is one task or one file.
            dealt = entries.repartition(self.buckets * 4, "bucket", F.pmod(F.xxhash64("id"), F.lit(4))).sortWithinPartitions("bucket", "key", "id")
            dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{kind}_index/field={field}/batch={batch:08d}")
        self._marked(kind, f"_done-{batch:08d}")

    def _add(self, kind: str, rows: DataFrame) -> None:
        schema = SCHEMAS[kind]
        cast = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.spark.createDataFrame([], schema).schema])
        batches = self._batches(kind)
        last = self._read(kind, [batches[-1]]).agg(F.max("ord")).first()[0] if batches else None
        self._write(kind, batches[-1] + 1 if batches else 1, self._ordered(cast, 0 if last is None else last + 1))

    def _read(self, kind: str, batches: list[int]) -> DataFrame:
        paths = [f"{self.path}/{kind}/batch={b:08d}" for b in batches]
        return self.spark.read.schema(f"{SCHEMAS[kind]}, ord long, batch int, bucket int").option("basePath", f"{self.path}/{kind}").parquet(*paths)

    def _latest(self, kind: str, rows: DataFrame) -> DataFrame:
        names = [f.name for f in self.spark.createDataFrame([], SCHEMAS[kind]).schema]
        last = F.max_by(F.struct(*names), "ord").alias("r")
        return rows.groupBy(F.col("id").alias("key")).agg(last, F.min("ord").alias("ord")).select("r.*", "ord")

    def _all(self, kind: str) -> DataFrame:
        batches = self._batches(kind)
        return self._latest(kind, self._read(kind, batches)) if batches else self.spark.createDataFrame([], f"{SCHEMAS[kind]}, ord long")

    def _by(self, kind: str, field: str, key: str) -> DataFrame:
        """Rows by an index: ids of the key, then of the tables only the buckets of these ids; rows that have lost the key since are left out."""
        batches = self._batches(kind)
        if not batches:
            return self._all(kind)
        at = f"{self.path}/{kind}_index/field={field}"
        index = self.spark.read.schema("key string, id string, batch int, bucket int").option("basePath", at).parquet(*[f"{at}/batch={b:08d}" for b in batches])
        ids = index.filter((F.col("bucket") == self._bucket(F.lit(key))) & (F.col("key") == key)).select("id").distinct().withColumn("bucket", self._bucket(F.col("id")))
        rows = self._read(kind, batches).join(ids, ["bucket", "id"], "left_semi")
        return self._latest(kind, rows).filter(F.array_contains(INDEXED[kind][field](), key))

    def _one(self, kind: str, id: str) -> DataFrame:
        batches = self._batches(kind)
        if not batches:
            return self._all(kind)
        return self._latest(kind, self._read(kind, batches).filter((F.col("bucket") == self._bucket(F.lit(id))) & (F.col("id") == id)))

    def compact(self) -> None:
        """Each kind's batches as one: the last row of each id, in the place of the first; earlier batches are deleted once it counts."""
        for kind in SCHEMAS:
            old = self._batches(kind)
            if len(old) < 2:
                continue
            new = old[-1] + 1
            self._write(kind, new, self._all(kind))
            self._marked(kind, f"_base-{new:08d}")
            for b in old:
                for at in (f"{kind}/batch={b:08d}", f"{kind}/_done-{b:08d}", *(f"{kind}_index/field={f}/batch={b:08d}" for f in INDEXED[kind])):
                    fs, where = self._fs(f"{self.path}/{at}")
                    fs.delete(where, True)

    def add_nodes(self, nodes: DataFrame) -> None:
        """Insert or replace nodes by id; a node without a source in its provenance is refused."""
        if not nodes.filter("prov IS NULL OR coalesce(size(prov.source), 0) < 1 OR NOT coalesce(prov.confidence BETWEEN 0 AND 1, false)").isEmpty():
            raise StoreError("every node needs a source and a confidence between 0 and 1")
        self._add("nodes", nodes)

    def add_edges(self, edges: DataFrame) -> None:
        """Insert or replace edges by id; an edge without tails or heads is refused."""
        if not edges.filter("coalesce(size(tails), 0) < 1 OR coalesce(size(heads), 0) < 1").isEmpty():
            raise StoreError("every edge needs tails and heads")
        self._add("edges", edges)

    def nodes(self) -> DataFrame:
        """All nodes, and ord, the order in which their ids came."""
        return self._all("nodes")

    def edges(self) -> DataFrame:
        return self._all("edges")

    def node(self, id: str) -> DataFrame:
        return self._one("nodes", id)

    def edge(self, id: str) -> DataFrame:
        return self._one("edges", id)

    def nodes_by_type(self, type: str) -> DataFrame:
        return self._by("nodes", "type", type)

    def nodes_by_source_type(self, type: str) -> DataFrame:
        return self._by("nodes", "source", type)

    def nodes_by_statement(self, statement: str) -> DataFrame:
        return self._by("nodes", "statement", statement)

    def edges_by_relation(self, relation: str) -> DataFrame:
        return self._by("edges", "relation", relation)

    def incoming(self, id: str) -> DataFrame:
        return self._by("edges", "head", id)

    def outgoing(self, id: str) -> DataFrame:
        return self._by("edges", "tail", id)

    def facts(self, scope: str = "") -> DataFrame:
        """Nodes as the facts table of forward chaining, in the order of insertion."""
        return self.nodes().select(F.lit(scope).alias("scope"), "id", "type", F.try_element_at("data", F.lit("statement")).alias("statement"), F.col("prov.confidence").alias("confidence"), F.col("ord").alias("seq"))

    def implications(self) -> DataFrame:
        """Edges as the edges table of forward chaining, in the order of insertion."""
        q = lambda k: F.try_element_at("qualifiers", F.lit(k))
        return self.edges().select(F.col("id").alias("edge_id"), "relation", "tails", "heads", F.coalesce(q("rule_id"), F.col("id")).alias("rule_id"), F.coalesce(q("authority"), F.lit("Unknown")).alias("authority"), F.coalesce(q("rule_text"), F.lit("")).alias("rule_text"), q("priority").try_cast("int").alias("priority"), F.col("prov.confidence").alias("confidence"), "context.jurisdiction", "context.valid_from", "context.valid_to", "context.authority_level", F.col("ord").alias("seq"))
