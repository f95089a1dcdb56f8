"""Documents from files and folders, and reports on what was found in them."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdigraph.sources.scratch import settle


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, failed): a row for each file of a path or glob that isn't empty.

    Texts are UTF-8; bytes that aren't are replaced, and failed tells so.
    """
    raw = spark.read.format("binaryFile").load(path)
    return raw.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"), (~F.is_valid_utf8(F.col("content").cast("string"))).alias("failed"))


def read_folder(spark: SparkSession, path: str, suffix: str = ".txt") -> DataFrame:
    """read_documents for every file of a folder with the suffix."""
    return read_documents(spark, f"{path.rstrip('/')}/*{suffix}")


def entity_counts(entities: DataFrame) -> DataFrame:
    """(entity_group, n), in order of the group."""
    return entities.groupBy("entity_group").agg(F.count("*").alias("n")).orderBy("entity_group")


def report(entities: DataFrame, citations: DataFrame, conclusions: DataFrame, key: str = "doc_id") -> DataFrame:
    """value: one JSON line for each document, with its entity counts, citations and conclusions."""
    e = entities.groupBy(key, "entity_group").agg(F.count("*").alias("n")).groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity_group", "n")))).alias("entities"))
    c = citations.groupBy(key).agg(F.array_sort(F.collect_list("raw")).alias("citations"))
    d = conclusions.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("id", "confidence"))).alias("conclusions"))
    return e.join(c, key, "full_outer").join(d, key, "full_outer").select(F.to_json(F.struct("citations", "conclusions", F.col(key), "entities")).alias("value"))


def dot(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """value: Graphviz lines for nodes(id, label) and edges(src, dst, label); rendering is left to Graphviz."""
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.col(c), '"', "'"), F.lit('"'))
    body = nodes.select(F.concat(F.lit("  "), quoted("id"), F.lit(" [label="), quoted("label"), F.lit("];")).alias("value"), F.lit(1).alias("part"))
    body = body.unionByName(edges.select(F.concat(F.lit("  "), quoted("src"), F.lit(" -> "), quoted("dst"), F.lit(" [label="), quoted("label"), F.lit("];")).alias("value"), F.lit(2).alias("part")))
    spark = nodes.sparkSession
    ends = spark.createDataFrame([("digraph {", 0), ("}", 3)], "value string, part int")
    return body.unionByName(ends).orderBy("part", "value").select("value")


def audit_chain(entries: DataFrame, log: str = "log", order: str = "seq", payload: str = "payload") -> DataFrame:
    """entries with prev_hash and hash: each log's entries chained by SHA-256 of the JSON of (payload, prev_hash).

    A chain has to be followed entry by entry: logs are dealt to partitions
    and sorted, and a task goes through its entries once, batch by batch,
    with no more than the last hash of the log it is in.
    """

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = object(), ""
        for batch in batches:
            before, digests = [], []
            for name, said in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                last = "" if name != at else last
                before.append(last)
                at, last = name, _digest(said, last)
                digests.append(last)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.string()), pa.array(digests, pa.string())], names=[log, order, payload, "prev_hash", "hash"])

    slim = entries.select(F.col(log).cast("string").alias(log), F.col(order).cast("long").alias(order), F.col(payload).cast("string").alias(payload))
    return slim.repartition(log).sortWithinPartitions(log, order, payload).mapInArrow(link, f"`{log}` string, `{order}` bigint, `{payload}` string, prev_hash string, hash string")


def _digest(said: str | None, before: str | None) -> str:
    entry = ({} if said is None else {"payload": said}) | {"prev_hash": before}
    return hashlib.sha256(json.dumps(entry, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def verify_chain(entries: DataFrame, log: str = "log", order: str = "seq", payload: str = "payload", prev_hash: str = "prev_hash", hash: str = "hash") -> DataFrame:
    """(log, seq, fault): entries of audit_chain() that are not as they were written; no row if all are.

    Fault `hash`: the hash isn't that of the payload and prev_hash (either
    was changed). Fault `link`: prev_hash isn't the hash of the entry before
    ('' for the first of a log), as where an entry was taken out, put in or
    moved. Building a chain goes entry by entry; checking one doesn't: logs
    are cut into ranges, however long one is, each is gone through by itself,
    and only the ends of ranges meet. Null hashes are faults.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, first = TaskContext.get().partitionId(), None, None
        for batch in batches:
            out = []
            for name, at, said, before, own in zip(*(c.to_pylist() for c in batch.columns)):
                if own is None or _digest(said, before) != own:
                    out.append((name, at, "hash", part, None))
                if last is None:
                    out.append((name, at, "first", part, before))
                elif before != (last[2] if last[0] == name else ""):
                    out.append((name, at, "link", part, None))
                last = (name, at, own)
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(("log", "seq", "fault", "part", "value"), r)) for r in out], schema=schema)
        if last is not None:
            yield pa.RecordBatch.from_pylist([{"log": last[0], "seq": last[1], "fault": "last", "part": part, "value": last[2]}], schema=schema)

    schema = pa.schema([("log", pa.string()), ("seq", pa.int64()), ("fault", pa.string()), ("part", pa.int32()), ("value", pa.string())])
    slim = entries.select(F.col(log).cast("string").alias("log"), F.col(order).cast("long").alias("seq"), F.col(payload).cast("string").alias("payload"), F.col(prev_hash).alias("prev_hash"), F.col(hash).alias("hash"))
    ranged = slim.repartitionByRange("log", "seq").sortWithinPartitions("log", "seq", "payload")
    found = settle(ranged.mapInArrow(run, "log string, seq bigint, fault string, part int, value string"), "ranges")
    # One first and one last row for each range.
    ends = found.filter("fault IN ('first', 'last')")
    w = Window.orderBy("part", F.col("fault") == "last")
    met = ends.withColumn("before", F.lag(F.struct("log", "value")).over(w)).filter("fault = 'first'")
    want = F.when(F.col("before.log") == F.col("log"), F.col("before.value")).otherwise("")
    broken = met.filter(~F.coalesce(F.col("value") == want, F.lit(False))).select("log", "seq", F.lit("link").alias("fault"))
    return found.filter("fault IN ('hash', 'link')").select("log", "seq", "fault").unionByName(broken)


def detailed(entities: DataFrame, citations: DataFrame, conclusions: DataFrame, key: str = "doc_id") -> DataFrame:
    """value: a readable report for each document, with each entity, citation and conclusion, in order of the text or of their names.

    entities(key, entity_group, word, start, score), citations(key, type, raw),
    conclusions(key, id, statement, authority, confidence). Documents without any of these have no report.
    """

    def section(title: str, rows: DataFrame, order: list[str], line: Column) -> DataFrame:
        lines = F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("said")))), lambda x: x["said"])
        return rows.groupBy(key).agg(F.concat(F.lit(f"{title}\n"), F.array_join(lines, "\n")).alias(title.split()[0].lower()))

    def percent(c: str) -> Column:
        return F.concat(F.round(F.col(c) * 100, 1).cast("string"), F.lit("%"))

    e = section("Entities found", entities, ["start", "entity_group"], F.concat(F.lit("  "), "entity_group", F.lit(": "), F.coalesce("word", F.lit("")), F.coalesce(F.concat(F.lit(" ("), percent("score"), F.lit(")")), F.lit(""))))
    c = section("Citations found", citations, ["type", "raw"], F.concat(F.lit("  "), "type", F.lit(": "), "raw"))
    basis = F.when(F.coalesce("authority", F.lit("")) != "", F.concat(F.lit(", by "), "authority")).otherwise("")
    d = section("Conclusions reached", conclusions, ["id"], F.concat(F.lit("  "), F.coalesce("statement", "id"), F.lit(" ("), percent("confidence"), basis, F.lit(")")))
    met = e.join(c, key, "full_outer").join(d, key, "full_outer")
    return met.select(F.concat_ws("\n", F.concat(F.lit("Document "), F.col(key).cast("string")), "entities", "citations", "conclusions").alias("value"))
