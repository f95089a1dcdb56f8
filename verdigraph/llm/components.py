"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from verdigraph.llm.common import settle


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _marked(edges: DataFrame) -> tuple[DataFrame, tuple[int, int | None]]:
    """The edges, written, with their number and a checksum that are observed while they are written."""
    seen = Observation()
    out = settle(edges.observe(seen, F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")), "edges")
    return out, (seen.get["n"], seen.get["x"])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, root) for every end of an edge, root being the least end in its component.

    edges has longs u and v without nulls; loops and repeats may occur. Each
    round is two grouped minima and two joins on the moved edges, written to
    the shared folder, and the number of rounds grows with the logarithm of
    the longest path. Nothing but a count and a checksum reaches the driver.
    """
    now, last = _marked(edges.select("u", "v").filter("u <> v").distinct()), None
    for _ in range(max_rounds):
        mark = now[1]
        if mark[0] == 0 or mark == last:
            break
        last = mark
        now = _marked(_small_star(_large_star(now[0])))
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    now = now[0]
    roots = now.select(F.col("v").alias("u"), F.col("v").alias("root"))
    return now.select("u", F.col("v").alias("root")).unionByName(roots).distinct()
