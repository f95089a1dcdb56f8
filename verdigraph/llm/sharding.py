"""Uniform shuffle into shards of exact size through a hypergeometric communication matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigraph.llm.common import own_columns, settle

#: numpy draws from populations below this.
_NUMPY_MOST = 10**9


def cell_sizes(total: int, shards: int, cell_rows: int) -> list[tuple[int, int, int]]:
    """(shard, first slot, rows) of each cell: shard sizes differ by one at most, and a shard is cut into even cells."""
    out = []
    for s in range(shards):
        rows = total // shards + (s < total % shards)
        cells = max(1, -(-rows // cell_rows))
        cuts = [rows * i // cells for i in range(cells + 1)]
        out += [(s, a, b - a) for a, b in zip(cuts, cuts[1:])]
    return out


def _large_hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A hypergeometric draw for populations of any size, by inversion within 14 standard deviations of the mean."""
    low, high = max(0, n - bad), min(n, good)
    p = good / (good + bad)
    reach = int(14 * (n * p * (1 - p)) ** 0.5) + 14
    k = np.arange(max(low, int(n * p) - reach), min(high, int(n * p) + reach) + 1, dtype=np.float64)
    a = k[:-1]
    steps = np.log(good - a) + np.log(n - a) - np.log(a + 1) - np.log(bad - n + a + 1)
    weights = np.concatenate([[0.0], np.cumsum(steps)])
    cdf = np.cumsum(np.exp(weights - weights.max()))
    return int(k[min(int(np.searchsorted(cdf, rng.random() * cdf[-1], side="right")), len(k) - 1)])


def _draw(rng: np.random.Generator, room: np.ndarray, n: int) -> np.ndarray:
    """Multivariate hypergeometric: how n rows taken at random fall on the cells' remaining room."""
    total = int(room.sum())
    if n == total:
        return room.copy()
    if total < _NUMPY_MOST:
        return rng.multivariate_hypergeometric(room, n, method="marginals")
    if len(room) == 1:
        return np.array([n], dtype=np.int64)
    half = len(room) // 2
    left = int(room[:half].sum())
    taken = _large_hypergeometric(rng, left, total - left, n) if 0 < left < total else (n if left else 0)
    return np.concatenate([_draw(rng, room[:half], taken), _draw(rng, room[half:], n - taken)])


def communication_matrix(blocks: list[int], cells: list[int], seed: int) -> Iterator[np.ndarray]:
    """For each block, how many of its rows go to each cell, distributed as under a uniform random permutation of all rows.

    Each row of the matrix is drawn from the room that earlier blocks left, so row sums are blocks and column sums cells.
    """
    rng, room = np.random.default_rng(seed), np.array(cells, dtype=np.int64)
    for n in blocks:
        draw = _draw(rng, room, n)
        room -= draw
        yield draw


def shard_rows(rows: DataFrame, shards: int = 24, seed: int = 7, cell_rows: int = 250_000, max_blocks: int = 2048, max_cells: int = 2048) -> DataFrame:
    """The columns of rows, `shard` (0 to shards - 1) and `slot` (gapless from 0 in each shard): a uniform random permutation.

    1. The rows are written to the shared folder with the partition they are
       in and their place in it; the partition sizes are counted. Blocks are
       runs of partitions, at most max_blocks of them.
    2. The driver draws the exact block-to-cell counts. A cell is a run of
       about cell_rows slots of one shard (more only if there would be more
       than max_cells of them), so no task sorts a whole shard. The matrix has
       at most max_blocks * (max_cells + shards) entries of 8 bytes, 34 MB,
       whatever the number of rows; that and a size for each partition is
       what the broadcast sends.
    3. Tasks draw in the same way how a block's counts fall on its
       partitions, and deal each partition's labels to its rows in a random
       order (the local permutation); rows are exchanged by cell and permuted
       again within it, which gives their slots.

    Columns that are already called shard or slot are replaced. Equal rows,
    null values and any further columns are kept as they are; an empty table
    gives an empty result; shards without rows have no rows. The written
    partitions are read again after a loss, so retried tasks draw the same.
    """
    rows = rows.drop("shard", "slot")
    numbered = rows.select(F.struct(*own_columns(rows)).alias("vg_row"), F.monotonically_increasing_id().alias("vg_m"))
    place = F.col("vg_m").bitwiseAND(F.lit((1 << 33) - 1))
    placed = settle(numbered.select("vg_row", F.shiftright("vg_m", 33).cast("int").alias("vg_part"), place.alias("vg_place")), "parts")
    sizes = dict(sorted((r["vg_part"], r["n"]) for r in placed.groupBy("vg_part").agg(F.count("*").alias("n")).collect()))
    total, parts = sum(sizes.values()), list(sizes)
    blocks = [b.tolist() for b in np.array_split(np.array(parts, dtype=np.int64), min(max_blocks, len(parts)))] if parts else []
    cells = cell_sizes(total, shards, max(cell_rows, -(-total // max_cells)))
    matrix = communication_matrix([sum(sizes[p] for p in b) for b in blocks], [n for *_, n in cells], seed)
    sent = [(np.flatnonzero(draw).astype(np.int32), draw[draw > 0], [sizes[p] for p in b]) for b, draw in zip(blocks, matrix)]
    at = {p: (k, i) for k, b in enumerate(blocks) for i, p in enumerate(b)}
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((at, sent))
    held: dict[int, np.ndarray] = {}

    def labels(part: int) -> np.ndarray:
        where, blocks_sent = shared.value
        block, own = where[part]
        kinds, room, owners = blocks_sent[block]
        rng, room = np.random.default_rng([seed, block]), room.copy()
        for n in owners[:own]:
            room -= _draw(rng, room, n)
        return np.random.default_rng([seed, block, own]).permutation(np.repeat(kinds, _draw(rng, room, owners[own])))

    @F.pandas_udf("int")
    def deal(part: pd.Series, place: pd.Series) -> pd.Series:
        b, p = part.to_numpy(), place.to_numpy()
        out = np.empty(len(b), dtype=np.int32)
        for k in np.unique(b):
            if k not in held:
                held.clear()  # the labels of one partition at a time
                held[k] = labels(int(k))
            mine = b == k
            out[mine] = held[k][p[mine]]
        return pd.Series(out)

    dealt = placed.withColumn("vg_cell", deal("vg_part", "vg_place"))
    order = Window.partitionBy("vg_cell").orderBy(F.xxhash64(F.lit(seed), "vg_part", "vg_place"), "vg_part", "vg_place")
    starts = F.broadcast(spark.createDataFrame([(i, s, a) for i, (s, a, _) in enumerate(cells)], "vg_cell int, shard int, vg_first long"))
    turned = dealt.withColumn("vg_rank", F.row_number().over(order) - 1).join(starts, "vg_cell")
    return turned.select(*[F.col("vg_row").getField(c).alias(c) for c in rows.columns], "shard", (F.col("vg_first") + F.col("vg_rank")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 7) -> DataFrame:
    """Shard assignment of each document under the `rows` law (counts at most one apart).

    Returns doc_id, size (UTF-8 bytes of the text, none for null, plus 8),
    text_crc32 (unsigned; null for a null text), law, shard, slot and
    grown_shard (null under this law). A row for each row of docs, repeated
    ones included; an empty table gives an empty result; other columns of
    docs don't matter. Only these columns are moved, not the texts.
    """
    text = F.col("text").cast("binary")
    slim = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("size"), F.crc32(text).alias("text_crc32"))
    out = shard_rows(slim, shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
