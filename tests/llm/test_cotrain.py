"""Co-training against a brute-force version, and what it learns."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigraph.llm import cotrain
from verdigraph.llm.cotrain import Rows, Settings

SETTINGS = Settings(max_labelled=120, rounds=3, exchanged=40, sure=0.9)


@pytest.fixture(scope="module")
def made(spark):
    """Documents of which both the words and the source tell the quality, mostly, and labels for some."""
    rng = random.Random(1)
    good, bad, any_ = [[f"{k}{i}" for i in range(60)] for k in ("fine", "spam", "word")]
    docs, labels = [], []
    for i in range(900):
        q = int(rng.random() < 0.7)
        words = [rng.choice((good if q else bad) if rng.random() < 0.25 else any_) for _ in range(rng.randint(5, 80))]
        docs.append((i, " ".join(words), f"s{q if rng.random() < 0.95 else 1 - q}", rng.choice(["en", None]), 4**q * 50))
        if i < 200:
            labels.append((i, q, 0))
    docs += [(899, None, None, None, None), (None, "fine1 fine2", "s1", "en", 9), (5, "another text of document five", "s0", "en", 9)]
    return spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def slow_nominate(rows, labelled, settings):
    def nominate(fitted, good, before):
        out = []
        for v, (x, w) in enumerate(zip((rows.text, rows.metadata), fitted)):
            z = x.astype(np.float64) @ w[:-1] + w[-1]
            line = math.log(settings.sure / (1 - settings.sure))
            taken = set(before[v].tolist())
            k = max(1, round(settings.exchanged * (1 - good)))
            order = sorted(range(len(z)), key=lambda i: (int(rows.keys[i]) % 2**64 >> 1, int(rows.keys[i])))
            free = [i for i in order if not labelled[i] and int(rows.keys[i]) not in taken]
            bad, fine = [i for i in free if z[i] <= -line][:k], [i for i in free if z[i] >= line][: max(1, settings.exchanged - k)]
            at = sorted(bad + fine, key=lambda i: rows.keys[i])
            q = np.array([0.0 if i in set(bad) else 1.0 for i in at])
            out.append(Rows(rows.keys[at], rows.text[at], rows.metadata[at], q, np.ones(len(at))))
        return out

    return nominate


def test_rounds_are_those_of_brute_force(spark, made):
    docs, labels = made
    feats = cotrain.settle(cotrain.features(docs), "views")
    model = cotrain.fit(feats, labels, SETTINGS)
    every = cotrain._rows(feats.withColumn("quality", F.lit(0.0)).withColumn("weight", F.lit(1.0)), SETTINGS.gain)
    owner = {r["h"]: r["doc_id"] for r in feats.collect()}
    have = {r["doc_id"] for r in labels.collect()}
    labelled = [owner[int(h)] in have for h in every.keys]
    want = cotrain.co_train(*_known(feats, labels), slow_nominate(every, labelled, SETTINGS), SETTINGS)
    assert len(model.handed) == len(want.handed) == SETTINGS.rounds
    for a, b in zip(model.handed, want.handed):
        assert [sorted(x.tolist()) for x in a] == [sorted(x.tolist()) for x in b]
    assert np.allclose(model.text, want.text, atol=1e-4) and np.allclose(model.combine, want.combine, atol=1e-3)
    # Each view hands over new documents in every round, none of them labelled.
    for v in (0, 1):
        rounds = [set(h[v].tolist()) for h in model.handed]
        assert all(len(x) > 20 for x in rounds) and not set.intersection(*rounds) and sum(map(len, rounds)) == len(set.union(*rounds))
        assert not any(owner[x] in have for x in set.union(*rounds))


def _known(feats, labels):
    """What fit() hands to co_train()."""
    seen, real = [], cotrain.co_train

    def keep(known, good, nominate, settings):
        seen.extend([known, good])
        return real(known, good, lambda *a: [Rows(known.keys[:0], known.text[:0], known.metadata[:0], known.quality[:0], known.weight[:0])] * 2, settings)

    cotrain.co_train = keep
    try:
        cotrain.fit(feats, labels, SETTINGS)
    finally:
        cotrain.co_train = real
    return seen


def test_scores_are_those_of_the_model(spark, made):
    docs, labels = made
    feats = cotrain.settle(cotrain.features(docs), "views")
    model = cotrain.fit(feats, labels, SETTINGS)
    got = {r["h"]: r for r in cotrain._score(feats, model, SETTINGS).collect()}
    assert len(got) == docs.count()
    for r in docs.withColumn("h", F.xxhash64("doc_id", "text", F.lit(31))).collect():
        at, share = cotrain.text_view((r["text"] or "").encode())
        t = sum(model.text[s] * float(x) for s, x in zip(at, share)) * SETTINGS.gain + model.text[-1]
        m = sum(model.metadata[s] for s in cotrain.metadata_view(r["source"], r["lang"], r["n_chars"])) + model.metadata[-1]
        a, b, c = model.combine
        assert got[r["h"]]["text_logit"] == pytest.approx(t, abs=1e-6) and got[r["h"]]["metadata_logit"] == pytest.approx(m, abs=1e-9)
        assert got[r["h"]]["score"] == pytest.approx(1 / (1 + math.exp(-(a * t + b * m + c))), abs=1e-6)


def test_views_are_apart_and_help_each_other(spark, made):
    docs, labels = made
    truth = docs.filter("doc_id >= 200 AND text IS NOT NULL").select("doc_id", (F.col("n_chars") > 100).alias("good"))
    got = cotrain.quality_scores(docs, labels, SETTINGS).join(truth, "doc_id").collect()
    assert sum(r["kept"] == r["good"] for r in got) / len(got) > 0.97
    # The metadata view doesn't see the text, the text view nothing else.
    other = docs.withColumn("text", F.lit("x")), docs.withColumn("source", F.lit("q")).withColumn("n_chars", F.lit(1))
    a, b, c = ({(r["doc_id"], bytes(r["slots"])): tuple(r["metadata"]) for r in cotrain.features(d).filter("doc_id < 50 AND doc_id <> 5").collect()} for d in (docs, *other))
    assert {k[0]: v for k, v in a.items()} == {k[0]: v for k, v in b.items()} and set(a) == set(c)


def test_rare_classes_are_sampled(spark):
    docs = spark.createDataFrame([(i, "bad text" if i % 97 == 0 else "good text", "a", "en", 9) for i in range(2000)], "doc_id long, text string, source string, lang string, n_chars long")
    labels = docs.select("doc_id", (F.col("text") == "good text").cast("int").alias("quality"))
    got = cotrain.quality_scores(docs, labels, Settings(max_labelled=80, rounds=1)).groupBy((F.col("doc_id") % 97 == 0).alias("bad")).agg(F.min("score"), F.max("score")).collect()
    by = {r["bad"]: r for r in got}
    assert by[True][2] < 0.5 < by[False][1]
