"""SimHash fingerprints, pivot distance tables and near-duplicate groups."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigraph.llm.common import LOWER_AZ, few_texts, fresh, maybe_broadcast, own_columns, settle, slices, small_enough
from verdigraph.llm.components import components

SHINGLE, RADIUS, SEED = 3, 2, 42
#: Near copies of the pipeline: sets of words in fives, of which 4 in 5 are common. Two such sets share no band by a chance of (1 - 0.8 ** 4) ** 28, under 5e-7.
NEAR_SHINGLE, NEAR_PARTS = 5, (4, 5)
BANDS, BAND_ROWS = 28, 4
#: Least hashes, of 112, in whose four bits two sets must agree to be looked at; those of similar sets agree in 91 or more on average, with a deviation of 4.1.
AGREED = 68
#: Pivots are packed seven to a long, in lanes of nine bits; each long has the pivots of one block of the fingerprint's bits.
LANES, LANE_BITS, BLOCKS = 7, 9, 4
#: Parts of the shingle space in which what two sets may have in common is counted.
PARTS = 64
BLOCK_STEP = 1 << 16
#: Rows of a decision table that are broadcast at most; beyond that rows meet their decisions by a shuffle.
BROADCAST_ROWS = 1_000_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the text's word shingles; 0 for a text without words."""
    ws = [] if text is None else text.encode("utf-8", "replace").translate(LOWER_AZ).split()
    if not ws:
        return 0
    n = max(1, len(ws) - shingle + 1)
    joined = map(b" ".join, zip(*(ws[i:] for i in range(shingle)))) if len(ws) >= shingle else [b" ".join(ws)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(SEED)), dtype=np.uint64, count=n)
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, n, BLOCK_STEP):
        bits = np.unpackbits(hashes[at : at + BLOCK_STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for i in range(0, len(bits), 255):
            votes += np.add.reduce(bits[i : i + 255], axis=0, dtype=np.uint8)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0])


def shingle_set(text: str | None, shingle: int = NEAR_SHINGLE) -> np.ndarray:
    """Sorted hashes of the text's different word shingles; a shorter text is one shingle, one without words has none."""
    ws = [] if text is None else text.encode("utf-8", "replace").translate(LOWER_AZ).split()
    if not ws:
        return np.zeros(0, np.uint64)
    joined = map(b" ".join, zip(*(ws[i:] for i in range(shingle)))) if len(ws) >= shingle else [b" ".join(ws)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(SEED)), dtype=np.uint64))


def _band_turns() -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets of the orders in which minima are taken."""
    n = BANDS * BAND_ROWS
    turns = np.array([xxhash.xxh64_intdigest(b"order %d" % i, 11) for i in range(2 * n)], dtype=np.uint64)
    return turns[:n] | np.uint64(1), turns[n:]


def bands(shingles: np.ndarray) -> tuple[list[int], list[int]]:
    """A key (signed) for each band of least hashes, and the last four bits of each least hash, 16 to a long; none for an empty set."""
    if not len(shingles):
        return [], []
    factor, offset = _TURNS
    least = np.full(len(factor), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        least = np.minimum(least, (shingles[at : at + 4096, None] * factor + offset).min(0))
    keys = [int(np.uint64(xxhash.xxh64_intdigest(r.tobytes(), b)).astype(np.int64)) for b, r in enumerate(least.reshape(BANDS, BAND_ROWS))]
    low = ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(60)).astype(np.uint8)
    return keys, (low[::2] | low[1::2] << 4).view(np.int64).tolist()


_TURNS = _band_turns()


def _set_hash(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), SEED)).astype(np.int64)) if len(shingles) else 0


def _sketches(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, `sim` (the text's SimHash), `fp` (hash of the shingle set), its `size`, its `bands` and their `low` bits, one row per row of docs; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(len(keys)).to_pylist()
            sims = np.array([fingerprint(t) for t in texts], dtype=np.uint64)
            sets = [shingle_set(t) for t in texts]
            told = [bands(x) for x in sets]
            cols = [pa.array(sims.view(np.int64)), pa.array([_set_hash(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64()), *(pa.array([t[i] for t in told], pa.list_(pa.int64())) for i in (0, 1))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keys))), *cols], names=[*keys, "sim", "fp", "size", "bands", "low"])

    few_texts(docs.sparkSession)
    slim = docs.select(*keys, text)
    kinds = ", ".join(f"`{k}` {slim.schema[k].dataType.simpleString()}" for k in keys)
    return slim.mapInArrow(run, f"{kinds}, sim long, fp long, size long, bands array<long>, low array<long>")


def _shingles(texts: DataFrame) -> DataFrame:
    """`fp`, `sh`, the shingle set, and `parts`, how many of it are in each part, of each row of a table of one text column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(t) for t in batch.column(0).to_pylist()]
            counts = [np.bincount((x % np.uint64(PARTS)).astype(np.int64), minlength=PARTS).astype(np.int32) for x in sets]
            cols = [pa.array([_set_hash(x) for x in sets], pa.int64()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, names=["fp", "sh", "parts"])

    few_texts(texts.sparkSession)
    return texts.mapInArrow(run, "fp long, sh array<long>, parts array<int>")


def _found(sets: DataFrame) -> DataFrame:
    """(fp, found): in each part, how many shingles of a set (fp, sh, parts) another set has too; two sets have no more than the lesser of these in common."""
    once = sets.select("fp", F.explode("sh").alias("s")).groupBy("s").agg(F.count("*").alias("n"), F.min("fp").alias("fp")).filter("n = 1")
    own = once.groupBy("fp", F.pmod(F.col("s"), F.lit(PARTS)).cast("int").alias("part")).agg(F.count("*").cast("int").alias("n"))
    own = own.groupBy("fp").agg(F.map_from_entries(F.collect_list(F.struct("part", "n"))).alias("own"))
    lost = F.transform("parts", lambda n, i: n - F.coalesce(F.try_element_at("own", i), F.lit(0)))
    return sets.join(own, "fp", "left").select("fp", F.when(F.col("own").isNull(), F.col("parts")).otherwise(lost).alias("found"))


def _common(a: str, b: str) -> Column:
    """At most so many shingles are common to two sets, by their counts in each part."""
    return sum((F.least(F.col(a)[i], F.col(b)[i]) for i in range(1, PARTS)), F.least(F.col(a)[0], F.col(b)[0]))


def fingerprints(docs: DataFrame, keys: list[str], text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """keys and `fp`, the fingerprint as a signed long, one row per row of docs; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([fingerprint(t, shingle) for t in batch.column(len(keys)).to_pylist()], dtype=np.uint64)
            cols = [batch.column(i) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(fps.view(np.int64))], names=[*keys, "fp"])

    few_texts(docs.sparkSession)
    slim = docs.select(*keys, text)
    kinds = ", ".join(f"`{k}` {slim.schema[k].dataType.simpleString()}" for k in keys)
    return slim.mapInArrow(run, f"{kinds}, fp long")


def pivots() -> list[list[int]]:
    """The fixed reference fingerprints (signed), LANES for each of BLOCKS blocks of bits: some bits of that block, all others 0."""
    width = 64 // BLOCKS
    return [[int(np.uint64((xxhash.xxh64_intdigest(b"pivot %d" % (b * LANES + i), 7) >> 1 & ((1 << width) - 1)) << (b * width)).astype(np.int64)) for i in range(LANES)] for b in range(BLOCKS)]


def pivot_table(fp: Column) -> list[Column]:
    """Hamming distances of fp to the pivots, packed into longs c0, c1, ..., one for each block."""
    out = []
    for b, refs in enumerate(pivots()):
        packed = F.lit(0).cast("long")
        for lane, p in enumerate(refs):
            packed = packed.bitwiseOR(F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("long"), lane * LANE_BITS))
        out.append(packed.alias(f"c{b}"))
    return out


def _cells(fp: Column) -> list[Column]:
    """Keys of which two fingerprints within RADIUS bits share at least one, from the coordinates c0, c1, ...

    The distance to a pivot less that to the zero fingerprint depends on the
    bits of the pivot's block alone. Two fingerprints that differ in two bits
    differ in two of the four blocks at most, so in the two others all these
    differences are equal.
    """
    ones = sum(1 << (i * LANE_BITS) for i in range(LANES))
    level = (F.lit(64) - F.bit_count(fp)).cast("long") * F.lit(ones)
    return [F.xxhash64(F.lit(t), F.col(f"c{i}") + level, F.col(f"c{j}") + level) for t, (i, j) in enumerate(combinations(range(BLOCKS), BLOCKS - RADIUS))]


def within_table(a: Column, b: Column, radius: int) -> Column:
    """True unless some lane of the packed coordinates differs by more than radius.

    A lane holds 128 + a - b + radius, from 64 to 194, so lanes don't borrow
    from each other; it lies in [128, 128 + 2 radius] just if the coordinates
    are near. Lanes of 8 values are tested by a mask, from both sides.
    """
    if radius > 3:
        raise ValueError("packed pivot lanes test radii up to 3")
    ones = sum(1 << (i * LANE_BITS) for i in range(LANES))
    lift, mask, want = F.lit(ones * (128 + radius)), F.lit(ones * 0x1F8), F.lit(ones * 128)
    return ((a + lift - b).bitwiseAND(mask) == want) & ((b + lift - a).bitwiseAND(mask) == want)


def _ball(fp: Column) -> Column:
    """All fingerprints within one bit of fp."""
    return F.array(fp, *[fp.bitwiseXOR(F.lit(int(np.uint64(1 << k).astype(np.int64)))) for k in range(64)])


def _parts_of_cells() -> Column:
    """Keys of the parts of a row's cell k (of kind t) by two further coordinates: two fingerprints of the cell within RADIUS bits share one.

    The coordinates are the distances to a pivot of each block that the cell
    doesn't fix. They differ by RADIUS at most; cut into ranges of
    RADIUS + 1 values, x lies in its own range and, where RADIUS more reaches
    it, in the next one.
    """
    free = [[b for b in range(BLOCKS) if b not in fixed] for fixed in combinations(range(BLOCKS), BLOCKS - RADIUS)]

    def ranges(n: int) -> Column:
        x = F.get(F.array(*[F.col(f"c{f[n]}").bitwiseAND(F.lit((1 << LANE_BITS) - 1)) for f in free]), F.col("t"))
        return F.array_distinct(F.array(F.floor(x / (RADIUS + 1)), F.floor((x + RADIUS) / (RADIUS + 1))))

    return F.flatten(F.transform(ranges(0), lambda x: F.transform(ranges(1), lambda y: F.xxhash64("k", x, y))))


def links(fps: DataFrame, bucket_limit: int = 64) -> DataFrame:
    """(u, v) edges over distinct fingerprints: every pair within RADIUS bits is connected, and no other.

    The distances to the pivots are computed once for each fingerprint, and
    these coordinates are the index: pairs meet in the cells of _cells(), are
    discarded by the largest difference of any coordinate (at most their
    Hamming distance, so no link is lost), and survivors are verified. Cells
    with over bucket_limit fingerprints are split by two further coordinates.
    Only in parts that still have more, pairs are not formed: there each
    fingerprint is listed under every fingerprint within one bit of it, 65,
    and linked with the least of those it meets, which happens just if they
    are within two bits. So work is linear in a cell's size.
    """
    table = fps.select("fp", *pivot_table(F.col("fp")))
    names = table.columns
    keyed = settle(table.select(*names, F.posexplode(F.array(*_cells(F.col("fp")))).alias("t", "k")), "cells")

    def crowd(cells: DataFrame) -> DataFrame:
        return settle(cells.groupBy("k").agg(F.count("*").alias("n")).filter(F.col("n") > bucket_limit).select("k"), "crowded")

    def paired(sides: DataFrame) -> DataFrame:
        a, b = sides.alias("a"), sides.alias("b")
        near = (F.col("a.k") == F.col("b.k")) & (F.col("a.fp") < F.col("b.fp"))
        for c in names[1:]:
            near = near & within_table(F.col(f"a.{c}"), F.col(f"b.{c}"), RADIUS)
        near = near & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= RADIUS)
        return a.join(b, near).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))

    crowded = crowd(keyed)
    pairs = paired(keyed.join(crowded, "k", "left_anti"))
    if crowded.isEmpty():
        return pairs.distinct()
    parts = settle(keyed.join(crowded, "k", "left_semi").withColumn("k", F.explode(_parts_of_cells())), "parts")
    still = crowd(parts)
    pairs = pairs.unionByName(paired(parts.join(still, "k", "left_anti")))
    dense = parts.join(still, "k", "left_semi").select("fp").distinct()
    met = settle(dense.select("fp", F.explode(_ball(F.col("fp"))).alias("z")), "balls")
    least = met.groupBy("z").agg(F.min("fp").alias("m"), F.count("*").alias("n")).filter("n > 1").select("z", "m")
    stars = met.join(least, "z").filter("fp <> m").select(F.col("fp").alias("u"), F.col("m").alias("v"))
    return pairs.unionByName(stars).distinct()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose shingle sets have a Jaccard similarity of 0.8 or more, by the sets themselves."""
    a, b = (sets.select(F.col("fp").alias(x), F.col("sh").alias(f"{x}_sh")) for x in ("u", "v"))
    common, both = F.size(F.array_intersect("u_sh", "v_sh")), F.size("u_sh") + F.size("v_sh")
    part, whole = NEAR_PARTS
    return pairs.join(a, "u").join(b, "v").filter(common * whole >= (both - common) * part).select("u", "v")


def _agreed(a: Column, b: Column) -> Column:
    """In how many groups of four bits two arrays of longs are equal."""
    ones, out = F.lit(0x1111111111111111), F.lit(0)
    for i in range(BANDS * BAND_ROWS // 16):
        x = a[i].bitwiseXOR(b[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        out = out + F.lit(16) - F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(ones))
    return out


def fingerprint_pairs(owners: DataFrame, bucket_limit: int = 64) -> DataFrame:
    """(u, v): sets of owners (fp, sim, size) whose texts' SimHashes are equal or linked by links(), so by pivots.

    Of sets with one SimHash the least stands for all: the others are paired
    with it, and it with those of the SimHashes that are linked.
    """
    rows = owners.filter("size > 0").select("sim", "fp")
    least = settle(rows.groupBy("sim").agg(F.min("fp").alias("m")), "least")
    same = rows.join(least, "sim").filter("fp <> m").select(F.col("m").alias("u"), F.col("fp").alias("v"))
    a, b = (least.select(F.col("sim").alias(x), F.col("m").alias(f"{x}_fp")) for x in ("u", "v"))
    near = links(least.select(F.col("sim").alias("fp")), bucket_limit).join(a, "u").join(b, "v").select(F.col("u_fp").alias("u"), F.col("v_fp").alias("v"))
    return settle(same.unionByName(near).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "near_prints")


def similar(owners: DataFrame, texts: DataFrame, leaders: int = 2, bucket_limit: int = 64) -> DataFrame:
    """(u, v) edges over shingle sets of owners (fp, sim, size, th, bands, low) that have the components of all pairs with similarity 0.8 or more.

    Texts are linked by their SimHashes first, through the pivots, and each
    such pair is verified by its sets. What is that similar but more than
    RADIUS bits apart is looked for among sets that share a band; each such
    pair is verified too. A set has no more in common
    with another than the shingles that any other set has (of those that
    share a band), which takes two grouped counts to know, in all and for
    each of PARTS parts of the shingle space. Sets and pairs that can't reach
    0.8 by that are left out. It is what keeps copies with many edits, and
    texts that share a template, from being compared one by one. In a band,
    sets are first met with two leaders, one of them with few shingles
    of its own, so near the text that others are copies of. Then all pairs
    are formed but those within a component, so that a large group of near
    copies costs what its stragglers cost, and no pair that could join two
    components is left out. texts has th and t.
    """
    part, whole = NEAR_PARTS
    keyed = owners.select("fp", F.explode("bands").alias("k"))
    shared = keyed.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").select("k")
    meeting = settle(keyed.join(shared, "k"), "bands")
    printed = fingerprint_pairs(owners, bucket_limit)
    looked = meeting.select("fp").unionByName(printed.select(F.explode(F.array("u", "v")).alias("fp"))).distinct()
    wanted = owners.join(looked, "fp", "left_semi").select("th")
    sets = _shingles(texts.join(maybe_broadcast(wanted, BROADCAST_ROWS), "th", "left_semi").select("t")).groupBy("fp").agg(F.first("sh").alias("sh"), F.first("parts").alias("parts"))
    sets = settle(sets, "sets")
    found = settle(_found(sets), "found")
    able = owners.join(found.select("fp", F.aggregate("found", F.lit(0), lambda x, y: x + y).alias("found")), "fp").filter(F.col("found") * whole >= F.col("size") * part)
    rows = settle(meeting.join(able.select("fp", "size", "found", "low"), "fp"), "candidates")
    sizes = F.col("a.size") + F.col("b.size")

    def enough(common: Column) -> Column:
        return common * whole >= (sizes - common) * part

    near = (F.col("a.k") == F.col("b.k")) & (F.least("a.size", "b.size") * whole >= F.greatest("a.size", "b.size") * part) & enough(F.least("a.found", "b.found"))
    near = near & (_agreed(F.col("a.low"), F.col("b.low")) >= AGREED)

    def verified(pairs: DataFrame) -> DataFrame:
        return _verified(pairs.select(F.least("a.fp", "b.fp").alias("u"), F.greatest("a.fp", "b.fp").alias("v")).distinct(), sets)

    alone = F.floor(20 * (F.col("size") - F.col("found")) / F.col("size"))
    orders = [F.struct(alone if j % 2 == 0 else F.lit(0).cast("long"), F.xxhash64("fp", "k", F.lit(j)), "fp", "size", "found", "low") for j in range(leaders)]
    main = rows.groupBy("k").agg(*[F.min(o).alias(f"m{j}") for j, o in enumerate(orders)])
    each = F.array_distinct(F.array(*[F.struct(f"m{j}.fp", f"m{j}.size", f"m{j}.found", f"m{j}.low") for j in range(leaders)]))
    led = main.select("k", F.explode(each).alias("m")).select("k", "m.*")
    met = rows.alias("a").join(led.alias("b"), near & (F.col("a.fp") != F.col("b.fp")))
    edges = settle(_verified(printed, sets).unionByName(verified(met)).distinct(), "near")
    roots = settle(components(edges).withColumnRenamed("u", "fp"), "roots")
    rooted = rows.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = settle(rooted.join(found.select("fp", F.col("found").alias("by_part")), "fp"), "rooted")
    # In each band the largest component needs no row of its own on one side; bands of one component need none at all.
    main = rooted.groupBy("k", "root").agg(F.count("*").alias("c")).groupBy("k").agg(F.max(F.struct("c", "root"))["root"].alias("main"), F.count("*").alias("roots")).filter("roots > 1")
    open_ = rooted.join(settle(main, "leaders"), "k")
    more = open_.filter("root <> main").alias("a").join(open_.alias("b"), near & (F.col("a.root") != F.col("b.root")) & enough(_common("a.by_part", "b.by_part")))
    return settle(edges.unionByName(verified(more)).distinct(), "near")


def groups(slim: DataFrame, bucket_limit: int = 64) -> DataFrame:
    """(fp, component_id, n) for each distinct fingerprint of slim (doc_id, fp); component_id is the least doc_id reachable, n counts rows."""
    owners = slim.groupBy("fp").agg(F.min("doc_id").alias("owner"), F.count("*").alias("n"))
    fps = settle(owners, "fingerprints")
    return _linked(fps, links(fps.select("fp"), bucket_limit))


def _linked(fps: DataFrame, edges: DataFrame) -> DataFrame:
    """(fp, component_id, n) for each row of fps (fp, owner, n)."""
    roots = settle(components(edges), "roots")
    rooted = fps.join(roots.withColumnRenamed("u", "fp"), "fp")
    least = rooted.groupBy("root").agg(F.min("owner").alias("component_id"))
    linked = rooted.join(least, "root").select("fp", F.col("component_id").alias("linked_id"))
    return fps.join(linked, "fp", "left").select("fp", F.coalesce("linked_id", "owner").alias("component_id"), "n")


def _with_components(slim: DataFrame, found: DataFrame, hot_rows: int = 1000, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """slim with the component of its fingerprint. Fingerprints of very many rows are looked up apart, by a broadcast if they are few, so that their rows stay where they are."""
    told = settle(found, "components")
    hot = told.filter(F.col("n") > hot_rows).select(F.col("fp").alias("hot"), F.col("component_id").alias("hot_id"))
    if hot.isEmpty() or not small_enough(hot, broadcast_rows):
        return slim.join(told, "fp")
    met = slim.join(F.broadcast(hot), F.col("fp") == F.col("hot"), "left")
    some = met.filter("hot IS NOT NULL").select(*slim.columns, F.col("hot_id").alias("component_id"))
    rest = met.filter("hot IS NULL").select(*slim.columns).join(told.filter(F.col("n") <= hot_rows), "fp")
    return some.unionByName(rest.select(*slim.columns, "component_id"))


def simhash_dedup(docs: DataFrame, text: str = "text", bucket_limit: int = 64) -> DataFrame:
    """Fingerprint and near-duplicate group of each document.

    Returns doc_id, fingerprint (16 lowercase hex digits) and component_id, a
    row for each row of docs. Texts are lower-cased (A-Z) and cut into 3-word
    shingles, repeats counted; shorter texts are one shingle. Null texts and
    texts without words have fingerprint zero and so form one group. A null
    doc_id is no candidate for component_id (null if a group has no other).
    Repeated rows each keep their row. An empty table gives an empty result.
    """
    slim = settle(fingerprints(docs, ["doc_id"], text), "simhash")
    found = groups(slim, bucket_limit)
    return _with_components(slim, found).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with just one row of each near-duplicate group: of the least doc_id, then the least text hash.

    Near duplicates share 0.8 or more of their different five-word shingles
    (Jaccard), directly or by way of others: pairs linked by SimHash and
    pivots, verified, and those beyond its radius. Texts without words are one group.
    All columns stay as they are, whatever their names. Null doc_ids come last
    in that order; of repeated rows with the same doc_id and text one stays. An
    empty table gives an empty result.
    """
    key = docs.select("doc_id", F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("t"))
    slim = settle(_sketches(key, ["doc_id", "th"], "t"), "sketches")
    owners = settle(slim.groupBy("fp").agg(F.min("doc_id").alias("owner"), F.count("*").alias("n"), F.min(F.struct("th", "sim")).alias("r"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("low").alias("low")).select("*", "r.th", "r.sim").drop("r"), "owners")
    found = _linked(owners.select("fp", "owner", "n"), similar(owners, key.select("th", "t")))
    # The first row of each fingerprint, with partial aggregates, before fingerprints meet their groups: copies by the thousand are one row by then.
    rows = slim.groupBy("doc_id", "th", "fp").agg(F.count("*").alias("n"))
    best = rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("th"), F.col("n"))).alias("r"))
    # A group without any doc_id is told apart by its least fingerprint.
    grouped = found.select("fp", F.coalesce("component_id", "fp").alias("g"), F.col("component_id").isNull().alias("gn"))
    kept = settle(best.join(grouped, "fp").groupBy("g", "gn").agg(F.min("r").alias("r")).select(F.col("r.doc_id").alias("doc_id"), F.col("r.th").alias("th"), F.col("r.n").alias("n")), "kept")
    # Rows that go, and those of which only one stays, are fewer than those that stay; where they can be broadcast, no text is shuffled.
    stays = kept.filter("n = 1").select(F.col("doc_id").alias("i"), F.col("th").alias("t"))
    every = slim.select("doc_id", "th").distinct()
    away = settle(every.join(stays, every["doc_id"].eqNullSafe(F.col("i")) & (every["th"] == F.col("t")), "left_anti"), "away")
    id_, th_ = fresh(docs, "vg_id", "vg_th")
    same = docs["doc_id"].eqNullSafe(F.col(id_)) & (F.xxhash64(docs[text]) == F.col(th_))
    left = docs.join(maybe_broadcast(away.select(F.col("doc_id").alias(id_), F.col("th").alias(th_)), BROADCAST_ROWS), same, "left_anti")
    again = settle(kept.filter("n > 1").select(F.col("doc_id").alias(id_), F.col("th").alias(th_)), "again")
    if again.isEmpty():
        return left
    met = docs.join(maybe_broadcast(again, BROADCAST_ROWS), same)
    # One of each task first, so that a row repeated very often is few rows when they meet.
    first = met.groupBy(id_, th_).agg(F.first(F.struct(*own_columns(docs))).alias("r"))
    return left.unionByName(first.select(*[F.col("r").getField(c).alias(c) for c in docs.columns]))
