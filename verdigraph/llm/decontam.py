"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame operations alone."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigraph.llm.common import fresh, maybe_broadcast, settle

SHINGLE, SIMILAR = 5, 0.8
#: Words are runs of letters and digits, lower-cased.
BETWEEN = r"[^\p{L}\p{N}]+"
#: Blocks of eight bits; of 24 differing bits at most, some block has at most three.
BLOCKS, BLOCK_BITS, RADIUS = 8, 8, 24
BROADCAST_ROWS = 500_000


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), BETWEEN), "")


def _shingle(ws: Column, i: Column, width: int) -> Column:
    """Hash of the width words from i (counted from 0)."""
    return F.xxhash64(*[F.try_element_at(ws, (i + k + 1).cast("int")) for k in range(width)])


def _shingler(ws: Column, width: int) -> Callable[[Column], Column]:
    return lambda i: _shingle(ws, i, width)


def _shingles(ws: Column, width: Column, widths: list[int]) -> Column:
    """Hashes of all shingles of the width in each row, in order."""
    picked = F.lit(None).cast("array<bigint>")
    for w in widths:
        every = F.transform(F.sequence(F.lit(0), F.size(ws) - w), _shingler(ws, w))
        picked = F.when((width == w) & (F.size(ws) >= w), every).otherwise(picked)
    return picked


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once for each row, even if it is used inside lambdas (a generator isn't inlined)."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def with_simhash(df: DataFrame, hashes: str, name: str) -> DataFrame:
    """df with the 64-bit SimHash of an array column of hashes, repeats counted: a bit is 1 if set in over half of them."""
    ones = f"transform(sequence(0, 63), k -> aggregate({hashes}, 0L, (n, h) -> n + (shiftrightunsigned(h, k) & 1L)))"
    bits = f"zip_with(sequence(0, 63), {ones}, (k, n) -> if(2 * n > size({hashes}), shiftleft(1L, k), 0L))"
    return df.withColumn(name, F.expr(f"aggregate({bits}, 0L, (x, y) -> x | y)"))


def _needed(a: Column, b: Column, least: float) -> Column:
    """Fewest common shingles with which texts of a and b shingles can be similar enough."""
    return F.ceil((a + b) * F.lit(least / (1 + least)) - 1e-9)


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """Items as (item_id, ik, words, width, n, shingles): ik tells different rows apart, repeats are one item."""
    ws = benchmark.select("item_id", F.xxhash64("item_id", "text").alias("ik"), _words(F.col("text")).alias("ws")).filter("size(ws) > 0").dropDuplicates(["ik"])
    width = F.least(F.lit(SHINGLE), F.size("ws"))
    sized = ws.withColumn("width", width).withColumn("n", F.size("ws") - F.col("width") + 1)
    cut = held(sized, "shingles", _shingles(F.col("ws"), F.col("width"), list(range(1, SHINGLE + 1))))
    return with_simhash(cut, "shingles", "item_fp").select("item_id", "ik", F.size("ws").alias("words"), "width", "n", "shingles", "item_fp")


def _rarest(items: DataFrame, least: float) -> DataFrame:
    """(width, h, ik): for each item its rarest shingles, of which every similar text has at least one.

    A similar text shares at least ceil(least * n) of an item's n shingles,
    so it can't miss all of n - ceil(least * n) + 1 of them. Rarest is by the
    number of items that have a shingle, so what many items share is left out
    where possible.
    """
    each = items.select("ik", "width", "n", F.explode("shingles").alias("h")).groupBy("ik", "width", "n", "h").agg(F.count("*").alias("c"))
    known = each.groupBy("width", "h").agg(F.count("*").alias("items"))
    order = Window.partitionBy("ik").orderBy("items", "h").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("c").over(order), F.lit(0))
    return each.join(known, ["width", "h"]).withColumn("before", before).filter(F.col("before") < F.col("n") - F.ceil(F.col("n") * F.lit(least) - 1e-9) + 1).select("width", "h", "ik")


def _flips() -> list[int]:
    """All 8-bit masks with at most RADIUS // BLOCKS bits."""
    return [sum(1 << i for i in bits) for n in range(RADIUS // BLOCKS + 1) for bits in combinations(range(BLOCK_BITS), n)]


def _block(fp: str) -> Column:
    return F.expr(f"shiftrightunsigned({fp}, j * {BLOCK_BITS}) & {(1 << BLOCK_BITS) - 1}L")


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(doc_id, th, item_id, start_word, hamming, similarity): each document and benchmark item that it contains.

    A document contains an item if one of its windows of as many words as the
    item (all its words, if it has fewer) has a weighted Jaccard similarity
    of at least `least` with it, over 5-word shingles with their counts
    (items of fewer words are one shingle). Words are lower-cased runs of
    letters and digits. The row tells the most similar window, of those the
    first. th is the hash of the text.

    1. Documents that hold none of an item's rarest shingles can't contain
       it; positions are hashed in generated code and met with the items'
       shingles, broadcast if they are at most BROADCAST_ROWS.
    2. Of the documents left, windows that begin with a shingle of the item
       (or end the text) and hold enough of them are SimHashed. A window that
       begins with another shingle is no better than the next one.
    3. Multi-index Hamming blocks find, of the items that a window is
       suspected of, those within RADIUS bits: of 8 blocks one differs in at
       most 3 bits, so each item is listed under all such values of each
       block. A window meets no item that its document isn't suspected of.
    4. Candidates are verified by their exact similarity.

    Documents with null texts, without words or with fewer words than a
    shingle contain nothing. Repeated rows count once; items without words
    are none. Empty tables give an empty result.
    """
    items = settle(benchmark_items(benchmark), "items")
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())
    rare = maybe_broadcast(settle(_rarest(items, least), "rarest"), BROADCAST_ROWS)
    worded = docs.select("doc_id", F.xxhash64("text").alias("th"), _words(F.col("text")).alias("ws"))
    met = None
    for w in widths:
        at = F.when(F.size("ws") >= w, F.sequence(F.lit(0), F.size("ws") - w))
        hashed = worded.select("doc_id", "th", "ws", F.explode(at).alias("p")).select("doc_id", "th", F.lit(w).alias("width"), _shingle(F.col("ws"), F.col("p"), w).alias("h"))
        hit = hashed.join(rare, ["width", "h"]).select("doc_id", "th", "ik")
        met = hit if met is None else met.unionByName(hit)
    if met is None:
        return docs.select("doc_id", F.xxhash64("text").alias("th")).limit(0).select("doc_id", "th", *[F.lit(None).cast(k).alias(c) for c, k in (("item_id", benchmark.schema["item_id"].dataType.simpleString()), ("start_word", "int"), ("hamming", "int"), ("similarity", "double"))])
    found = settle(met.groupBy("doc_id", "th").agg(F.collect_set("ik").alias("iks")), "suspects")
    suspects = maybe_broadcast(found.select(F.col("doc_id").alias("sd"), F.col("th").alias("st"), "iks"), BROADCAST_ROWS)
    again = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    again = again.join(suspects, again["doc_id"].eqNullSafe(F.col("sd")) & (again["th"] == F.col("st"))).select("doc_id", "th", _words(F.col("text")).alias("ws"), F.explode("iks").alias("ik"))
    mine = maybe_broadcast(items.select("ik", "words", "width", "n", "shingles"), BROADCAST_ROWS // 50)
    pairs = held(again.join(mine, "ik"), "hs", _shingles(F.col("ws"), F.col("width"), widths)).drop("ws")
    pairs = pairs.withColumn("size", F.least(F.size("hs"), F.col("n"))).withColumn("need", _needed(F.col("size"), F.col("n"), least).cast("int"))
    pairs = held(pairs, "hits", F.expr("filter(sequence(0, size(hs) - 1), i -> array_contains(shingles, hs[i]))")).filter("size(hits) >= need")
    last = F.size("hs") - F.col("size")
    inner = F.expr("filter(transform(hits, (p, i) -> if(get(hits, i + need - 1) < p + size AND p <= size(hs) - size, p, NULL)), p -> p IS NOT NULL)")
    ending = F.when(F.expr("size(filter(hits, p -> p >= size(hs) - size)) >= need"), F.array(last)).otherwise(F.array().cast("array<int>"))
    windows = pairs.withColumn("s", F.explode(F.array_union(inner, ending))).select("doc_id", "th", "ik", "s", F.slice("hs", F.col("s") + 1, F.col("size")).alias("part"))
    windows = settle(with_simhash(windows.dropDuplicates(["doc_id", "th", "ik", "s"]), "part", "fp"), "windows")
    j = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))
    listed = items.select("ik", "item_fp", j.alias("j"))
    listed = listed.withColumn("b", _block("item_fp")).withColumn("flip", F.explode(F.array(*map(F.lit, _flips()))))
    listed = maybe_broadcast(listed.select("ik", "item_fp", "j", F.col("b").bitwiseXOR(F.col("flip")).alias("b")), BROADCAST_ROWS // 2)
    asked = windows.withColumn("j", j).withColumn("b", _block("fp"))
    near = asked.join(listed, ["ik", "j", "b"]).withColumn("hamming", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))).filter(F.col("hamming") <= RADIUS)
    # Of the blocks that find a pair, the first counts.
    near_block = F.expr(f"get(filter(sequence(0, {BLOCKS - 1}), x -> bit_count(shiftrightunsigned(fp ^ item_fp, x * {BLOCK_BITS}) & {(1 << BLOCK_BITS) - 1}L) <= {RADIUS // BLOCKS}), 0)")
    near = near.filter(F.col("j") == near_block).join(maybe_broadcast(items.select("item_id", "ik", "n", "shingles"), BROADCAST_ROWS // 50), "ik")
    common = F.expr("aggregate(array_distinct(shingles), 0, (n, x) -> n + least(size(filter(part, y -> y = x)), size(filter(shingles, y -> y = x))))")
    scored = near.withColumn("common", common).withColumn("similarity", F.col("common") / (F.size("part") + F.col("n") - F.col("common"))).filter(F.col("similarity") >= least - 1e-12)
    best = F.max(F.struct("similarity", (-F.col("s")).alias("minus"), "hamming")).alias("b")
    return scored.groupBy("doc_id", "th", "ik", "item_id").agg(best).select("doc_id", "th", "item_id", (-F.col("b.minus")).cast("int").alias("start_word"), F.col("b.hamming").cast("int").alias("hamming"), F.col("b.similarity").alias("similarity"))


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = SIMILAR) -> DataFrame:
    """doc_id, item_id, start_word, hamming and similarity of each leak (see leaks)."""
    return leaks(docs, benchmark, least).drop("th")


def without_leaks(docs: DataFrame, benchmark: DataFrame, least: float = SIMILAR) -> DataFrame:
    """docs without the rows whose text contains a benchmark item (see leaks); all columns as they are, whatever their names.

    Null texts contain nothing and stay; repeated rows go or stay together;
    an empty benchmark leaves docs as they are.
    """
    bad_id, bad_text = fresh(docs, "vg_id", "vg_th")
    bad = settle(leaks(docs, benchmark, least).select(F.col("doc_id").alias(bad_id), F.col("th").alias(bad_text)).distinct(), "leaks")
    return docs.join(maybe_broadcast(bad, BROADCAST_ROWS), docs["doc_id"].eqNullSafe(F.col(bad_id)) & (F.xxhash64(docs["text"]) == F.col(bad_text)), "left_anti")
