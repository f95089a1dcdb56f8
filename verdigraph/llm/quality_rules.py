"""Quality rules: counts within each text, and lines that too many documents of a host share."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigraph.llm.common import LOWER_AZ, salted_join, settle, slices

WINDOW = 5
SYMBOLS, WHITE = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
BROADCAST_ROWS = 500_000


def repeated_words(ws: list[bytes]) -> int:
    """Words that lie in a 5-word window found at least twice in the text, the first included.

    Windows are told apart exactly: words, pairs, fours and fives are
    numbered one after the other, equal ones alike.
    """
    n = len(ws) - WINDOW + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    own = np.fromiter((known.setdefault(w, len(known)) for w in ws), dtype=np.int64, count=len(ws))
    if len(known) == len(ws):
        return 0

    def numbered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a * (len(ws) + 1) + b, return_inverse=True)[1]

    pairs = numbered(own[:-1], own[1:])
    if pairs.max() + 1 == len(pairs):
        return 0
    fives = numbered(numbered(pairs[:-2], pairs[2:])[:n], own[WINDOW - 1 :])
    again = (np.bincount(fives) > 1)[fives]
    covered = np.zeros(len(ws) + 1, dtype=np.int64)
    covered[:n] += again
    covered[WINDOW:] -= again
    return int((np.cumsum(covered)[:-1] > 0).sum())


def line_words(raw: bytes, seed: int) -> tuple[dict[int, int], int]:
    """Words of the text on each normalised line (by the hash of host and line), and how many lines repeat an earlier one.

    A line is normalised by lower-casing A-Z and joining its words with one space.
    """
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
    found: dict[int, int] = {}
    for line in lines:
        ws = line.translate(LOWER_AZ).split()
        h = xxhash.xxh64_intdigest(b" ".join(ws), seed)
        found[h] = found.get(h, 0) + len(ws)
    return found, len(lines) - len(set(lines))


FEATURES = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, line_keys array<bigint>, line_words array<int>"


def features(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The counts of each text and its lines; no shuffle. Null texts have no words and no lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            cols: list[list] = [[] for _ in range(7)]
            for t, where in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = b"" if t is None else t.encode("utf-8", "replace")
                ws = raw.split()
                seed = xxhash.xxh64_intdigest(b"0" if where is None else b"1" + where.encode("utf-8", "replace"))
                found, dup = line_words(raw, seed)
                chars = len(t or "") - (len(raw) - len(raw.translate(None, WHITE)))
                symbols = len(raw) - len(raw.translate(None, SYMBOLS))
                keys = np.fromiter(found, dtype=np.uint64, count=len(found)).view(np.int64)
                for c, v in zip(cols, (len(ws), chars, symbols, dup, repeated_words(ws), keys, list(found.values()))):
                    c.append(v)
            kinds = [*repeat(pa.int64(), 5), pa.list_(pa.int64()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=names)

    names = [x.split()[0] for x in FEATURES.split(", ")]
    return docs.select(F.col("doc_id").cast("long"), F.col(text), F.col(host).cast("string")).mapInArrow(run, FEATURES)


def line_frequency_rules(docs: DataFrame, limit: int = 10, least_share: float = 0.3, least_words: int = 10) -> DataFrame:
    """Counts of each text, whether the base rules fail, and whether the document is kept.

    Lines are normalised and hashed together with their host (source); the
    distinct documents of each are counted, by doc_id. A line on more than
    `limit` documents of a host is removed from all of them. A document is
    rejected if the base rules fail (under 10 words, or over 20 % of its
    words repeated) or removal depletes it: under least_words words or under
    least_share of its words are left.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, n_removed_words, kept; a row for each row of
    docs. Null texts have no words and fail. A null source is a host of its
    own. Rows with the same doc_id are one document where documents are
    counted; a row without doc_id is a document of its own. Ties don't occur.
    An empty table gives an empty result; other columns don't matter.
    """
    own = settle(features(docs).withColumn("uid", F.monotonically_increasing_id()), "features")
    lines = own.select("uid", "doc_id", F.explode(F.arrays_zip("line_keys", "line_words")).alias("l")).select("uid", "doc_id", F.col("l.line_keys").alias("k"), F.col("l.line_words").alias("w"))
    once = lines.select("k", "doc_id", F.when(F.col("doc_id").isNull(), F.col("uid")).alias("u")).distinct()
    frequent = settle(once.groupBy("k").agg(F.count("*").alias("n")).filter(F.col("n") > limit).select("k"), "frequent")
    removed = salted_join(lines, frequent, "k", F.col("uid"), BROADCAST_ROWS).groupBy("uid").agg(F.sum("w").cast("long").alias("gone"))
    met = own.drop("line_keys", "line_words").join(removed, "uid", "left")
    left = F.col("n_words") - F.coalesce("gone", F.lit(0))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    depleted = F.col("gone").isNotNull() & ((left < least_words) | (left < least_share * F.col("n_words")))
    return met.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), F.coalesce("gone", F.lit(0)).cast("long").alias("n_removed_words"), (~base & ~depleted).alias("kept"))
