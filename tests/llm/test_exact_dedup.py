"""Exact dedup against a loop over rows, with good hashes and with hashes that collide."""

import collections
import hashlib

import pytest
from pyspark.sql import functions as F

from verdigraph.llm.exact_dedup import content_hash, exact_dedup, without_copies
from verdigraph.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
ROWS = [(1, "a"), (2, "a"), (3, "A"), (4, None), (5, ""), (6, " "), (None, "a"), (None, "b"), (None, "b"), (9, "c"), (9, "c"), (9, "d"), (10, "x" * 300000), (11, "x" * 300000), (12, "x" * 299999 + "y"), (13, "é"), (14, "é")]
SCHEMA = "doc_id bigint, text string"


def by_loop(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        ids = sorted(ids, key=lambda i: (i is not None, i or 0))
        out += [(i, ids[-1], len(ids), j == len(ids) - 1, hashlib.sha256(t.encode()).hexdigest()) for j, i in enumerate(ids)]
    return sorted(out, key=str)


#: A good hash, one that gives 2 values in all, and one that is the same for all texts.
FOLDS = {"md5": content_hash, "weak": lambda t: F.unhex(F.lpad(F.hex(F.length(t) % 2), 2, "0")), "none": lambda t: F.lit(b"0")}


@pytest.mark.parametrize("rows", [0, 200_000])
@pytest.mark.parametrize("fold", FOLDS)
def test_against_a_loop(spark, fold, rows):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    got = exact_dedup(docs, fold=FOLDS[fold], rows=rows)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == by_loop(ROWS)
    kept = without_copies(docs, fold=FOLDS[fold], rows=rows)
    assert kept.columns == docs.columns
    texts = {hashlib.sha256((t or "").encode()).hexdigest(): t or "" for _, t in ROWS}
    want = [(keep, texts[sha]) for _, keep, _, stays, sha in by_loop(ROWS) if stays]
    assert sorted(((r["doc_id"], r["text"] or "") for r in kept.collect()), key=str) == sorted(want, key=str)


def test_query_against_a_loop(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = QUERIES["op13_exact_dedup"](spark, SF).collect()
    assert sorted(map(tuple, got), key=str) == by_loop([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_empty_and_clashing(spark):
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(1, "a", 5, "q"), (2, "a", 6, "r")], "doc_id bigint, text string, h int, vg_h string")
    assert [tuple(r) for r in without_copies(docs).collect()] == [(2, "a", 6, "r")]
    assert without_copies(docs.filter("false")).columns == docs.columns


def test_hot_text_is_summed_first(spark):
    docs = spark.range(40000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("t"), (F.col("id") / 2).cast("int").cast("string"))).alias("text"))
    got = exact_dedup(docs, rows=10)
    assert got.filter("kept").count() == got.select("text_sha256").distinct().count()
    assert got.filter("keep_id = 39999").agg(F.max("group_size")).first()[0] == 13334


def test_no_python_in_the_plans(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for out in (exact_dedup(docs), exact_dedup(docs, rows=1), without_copies(docs)):
        plan = out._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "ExistingRDD"))
