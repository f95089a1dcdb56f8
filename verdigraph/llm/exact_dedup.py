"""Exact dedup: groups of a 128-bit content hash, told apart by their bytes where a hash collides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigraph.llm.common import counted_join, fresh, maybe_broadcast, settle

#: Rows of a table that may be broadcast.
BROADCAST_ROWS = 200_000


def content_hash(text: Column) -> Column:
    """16 bytes of a text (MD5 of its UTF-8)."""
    return F.unhex(F.md5(text.cast("binary")))


def _whole(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def _groups(rows: DataFrame) -> DataFrame:
    """(h, v, n, top) of equal texts that occur more than once: how many rows, and the largest (id, uid)."""
    return rows.groupBy("h", "v").agg(F.count("*").alias("n"), F.max(F.struct("id", "uid")).alias("top")).filter("n > 1")


def _copies(docs: DataFrame, text: str, key: str, fold: Callable[[Column], Column], rows: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Rows (id, h, v, sha, uid), groups of more than one row (h, v, n, top), and the colliding hashes (h), None without any.

    A hash whose rows have the same bytes has v = ''. Where they don't, v is
    the text itself, so that such rows are grouped by their bytes.
    """
    own = docs.select(F.col(key).cast("long").alias("id"), _whole(text).alias("t")).withColumn("h", fold(F.col("t")))
    # Numbered once and written: ids may be null or repeated.
    numbered = own.withColumns({"uid": F.monotonically_increasing_id(), "sha": F.sha2(F.col("t").cast("binary"), 256)})
    slim = settle(numbered.select("id", "h", F.lit("").alias("v"), "sha", "uid"), "hashes")
    groups = settle(_groups(slim), "copies")
    # Bytes are compared within each hash: one text for each hash and partition is shuffled, and only of hashes that occur again.
    again = counted_join(own.select("h", "t"), groups.select("h", "n"), ["h"], "n", rows=rows)
    several = settle(again.select("h", "t").distinct().groupBy("h").count().filter("count > 1").select("h"), "collisions")
    if several.isEmpty():
        return slim, groups, None
    small = maybe_broadcast(several, rows)
    parted = settle(numbered.join(small, "h", "left_semi").select("id", "h", F.col("t").alias("v"), "sha", "uid"), "parted")
    slim = slim.join(small, "h", "left_anti").unionByName(parted)
    groups = settle(groups.join(small, "h", "left_anti").unionByName(_groups(parted)), "copies")
    return slim, groups, several


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", fold: Callable[[Column], Column] = content_hash, rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256, one row for each row of docs.

    Texts are equal if all their bytes are; of equal texts the row with the
    largest key stays. Null texts count as empty ones, and whatever the text
    is, it is read whole. A null key is less than any other, so such a row
    stays only among its like; of repeated rows (same key and text) one
    stays. An empty table gives an empty result; other columns of docs don't
    matter, whatever their names. `fold` is the content hash; texts that it
    can't tell apart are compared byte by byte.

    Only hashes are shuffled, and of hashes that occur again one text for
    each partition. Counts are summed before the shuffle. Groups are joined
    to their rows by broadcast (up to `rows` groups, and always those of many
    rows) or else in a shuffled join.
    """
    slim, groups, _ = _copies(docs, text, key, fold, rows)
    met = counted_join(slim, groups, ["h", "v"], "n", "left", rows)
    alone = F.col("n").isNull()
    return met.select(
        F.col("id").alias("doc_id"),
        F.when(alone, F.col("id")).otherwise(F.col("top.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("uid") == F.col("top.uid"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def without_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", fold: Callable[[Column], Column] = content_hash, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of docs that exact_dedup keeps, all columns as they are; of a text that occurs once nothing is shuffled with few groups."""
    _, groups, several = _copies(docs, text, key, fold, rows)
    h, v, n, k, hit = fresh(docs, "vg_h", "vg_v", "vg_n", "vg_keep", "vg_hit")
    found = docs.withColumn(h, fold(_whole(text))).withColumn(v, F.lit(""))
    if several is not None:
        hits = maybe_broadcast(several.select(F.col("h").alias(h), F.lit(True).alias(hit)), rows)
        found = found.join(hits, h, "left").withColumn(v, F.when(F.col(hit), _whole(text)).otherwise("")).drop(hit)
    stays = groups.select(F.col("h").alias(h), F.col("v").alias(v), F.col("n").alias(n), F.struct(F.col("top.id").alias("id")).alias(k))
    met = counted_join(found, stays, [h, v], n, "left", rows)
    once = met.filter(F.col(n).isNull())
    first = met.filter(F.col(n).isNotNull() & F.col(key).cast("long").eqNullSafe(F.col(f"{k}.id"))).dropDuplicates([h, v])
    return once.unionByName(first).drop(h, v, n, k)
