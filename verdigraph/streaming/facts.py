"""Optional streams: labels arriving over time, late ones included, kept as facts and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from verdigraph.operators.interpretation import reason
from verdigraph.plans.rules import Rule
from verdigraph.sources.graph import Graph, from_labels


def windowed_counts(events: DataFrame, time: str = "ts", key: str = "event_type", window: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(start, key, n) for each window of event time; events later than the watermark are left out."""
    at = F.window(time, window, slide) if slide else F.window(time, window)
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(at.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def keep_facts(edge_labels: DataFrame, rules: list[Rule], path: str, checkpoint: str, node_labels: DataFrame | None = None) -> StreamingQuery:
    """Maintain the rules' facts under path/facts while (label, u, v) rows arrive; latest_facts() reads them.

    Each micro-batch is written to path/labels and its facts to path/facts by
    its number, so a repeated batch overwrites itself and readers keep what
    they read. A rule counts all assignments of a head, so facts are derived
    from all labels so far; a batch without a label that was not there yet
    derives nothing and adds no facts.
    """

    def advance(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.select("label", "u", "v").distinct().write.mode("overwrite").parquet(f"{path}/labels/batch={number}")
        labels = spark.read.parquet(f"{path}/labels")
        first = labels.groupBy("label", "u", "v").agg(F.min("batch").alias("batch"))
        if first.filter(F.col("batch") == number).isEmpty():
            return
        nodes = node_labels if node_labels is not None else spark.createDataFrame([], "label string, id string")
        graph: Graph = from_labels(nodes, labels.select("label", "u", "v"))
        reason(rules, graph).table().write.mode("overwrite").parquet(f"{path}/facts/batch={number}")

    return edge_labels.writeStream.foreachBatch(advance).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_facts(spark: SparkSession, path: str) -> DataFrame:
    """(statement, lower, upper) of the last batch that keep_facts() has written."""
    every = spark.read.parquet(f"{path}/facts")
    return every.filter(F.col("batch") == every.agg(F.max("batch")).first()[0]).drop("batch")
