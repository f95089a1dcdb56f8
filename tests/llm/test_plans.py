"""What the plans of the operators must and must not hold."""

import re

import pytest

from verdigraph.llm import decontam, mixing, simhash
from verdigraph.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name, module", [("op4_entropy_balanced_mix", mixing), ("op10_simhash_decontamination", decontam)])
def test_native_operators_run_no_python(spark, monkeypatch, name, module):
    seen = []

    def settle(df, label, real=module.settle):
        seen.append(plan(df))
        return real(df, label)

    monkeypatch.setattr(module, "settle", settle)
    seen.append(plan(QUERIES[name](spark, SF)))
    assert len(seen) > 3
    assert not [p for p in seen if re.search(r"Python|Pandas|Arrow|ExistingRDD", p)]


@pytest.mark.parametrize("name", ["op3_compression_language_id", "op6_license_scan", "op7_prefix_token_counts", "op9_best_fit_packing"])
def test_scans_do_not_shuffle(spark, name):
    assert "Exchange" not in plan(QUERIES[name](spark, SF))


def test_no_cross_join_in_near_dedup(spark, monkeypatch):
    seen = []

    def settle(df, label, real=simhash.settle):
        seen.append(plan(df))
        return real(df, label)

    monkeypatch.setattr(simhash, "settle", settle)
    seen.append(plan(QUERIES["op8_simhash_dedup"](spark, SF)))
    assert not [p for p in seen if re.search("CartesianProduct|BroadcastNestedLoopJoin", p)]


def test_windows_meet_only_the_items_they_are_suspected_of(spark, monkeypatch):
    """Many items of as many words, each in some documents: a window is a candidate for one item, whatever their number."""
    rows = [(i, " ".join(f"w{(i * 13 + k) % 997}x{i % 5}" for k in range(12))) for i in range(300)]
    items = spark.createDataFrame(rows, "item_id bigint, text string")
    docs = spark.createDataFrame([(i, "so it is said " + t + " and more of it") for i, t in rows], "doc_id bigint, text string")
    seen = {}

    def settle(df, label, real=decontam.settle):
        seen[label] = real(df, label)
        return seen[label]

    monkeypatch.setattr(decontam, "settle", settle)
    got = decontam.contaminated(docs, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} >= {(i, i) for i, _ in rows}
    windows = seen["windows"].select("doc_id", "s").distinct().count()
    assert seen["windows"].count() < 2 * windows
    assert re.search(r"ik#\d+L?, j#\d+, b#\d+", decontam.contaminated(docs, items)._jdf.queryExecution().toString())
