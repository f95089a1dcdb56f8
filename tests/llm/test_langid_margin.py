"""The rejection of language ID fits on texts that no dictionary holds, however rare some languages are."""

import random

import pytest
from pyspark.sql import functions as F

from verdigraph.llm import langid


def speech(rng, lang, n):
    """Short texts; languages of a family share most of their words, so that some can't be told."""
    family = random.Random(lang[0]).sample(range(4000), 60)
    own = random.Random(lang).sample(range(4000), 25)
    return " ".join(f"{'bcdfghklmn'[w % 10]}{'aeiou'[w // 10 % 5]}{'rstvwz'[w // 50 % 6]}{'aeiou'[w // 300 % 5]}{w % 7 * 'n'}" for w in (rng.choice(family if rng.random() < 0.6 else own) for _ in range(n)))


@pytest.fixture(scope="module")
def learned(spark):
    rng = random.Random(1)
    rows = [(speech(rng, f"{'ab'[i % 2]}{i % 4 // 2}", rng.randrange(1, 12)), f"{'ab'[i % 2]}{i % 4 // 2}") for i in range(24_000)]
    rows += [(speech(rng, "c0", 5), "c0") for _ in range(100)] + [(speech(rng, f"d{k}", 4), f"d{k}") for k in range(40) for _ in range(1 + k % 4)]
    return spark.createDataFrame(rows, "text string, lang string").repartition(4).cache()


def test_rare_languages_leave_the_fit_alone(spark, learned, monkeypatch):
    seen, plain = [], langid.narrowest
    monkeypatch.setattr(langid, "narrowest", lambda told, *a: seen.append(told) or plain(told, *a))
    model = langid.fit(learned)
    assert len(model.dictionaries) == 45 and all(c.strip() for _, c, _ in model.dictionaries)
    (told,) = seen
    assert 3900 <= len(told) <= 4000 and model.margin > 0
    # Rejected rows of other texts are more often wrong than right, and the kept ones mostly right.
    rng = random.Random(2)
    fresh = spark.createDataFrame([(speech(rng, f"{'ab'[i % 2]}{i % 4 // 2}", rng.randrange(1, 12)), f"{'ab'[i % 2]}{i % 4 // 2}") for i in range(4000)], "text string, lang string")
    got = langid.identify(fresh, model, ["lang"]).select("rejected", (F.col("lang") == F.col("lang_pred")).alias("right")).groupBy("rejected", "right").count().collect()
    n = {(r["rejected"], r["right"]): r["count"] for r in got}
    assert n[True, False] > n[True, True] > 0 and n[False, True] > 3 * n[False, False]


def test_dictionaries_hold_no_row_that_fits(spark, learned):
    """Every text is one that a dictionary drew, or one that may fit the margin, never both."""
    edge = int(langid._SPACE * (1 - langid.APART))
    known = learned.withColumn("h", F.shiftrightunsigned(F.xxhash64("text", F.lit(17)), 1))
    model = langid.fit(learned, margin_rows=0)
    parts = dict((k, c) for k, c, _ in model.dictionaries)
    for lang in ("c0", "d3", "d7"):
        rows = known.filter(F.col("lang") == lang).collect()
        low = [r for r in rows if r["h"] < edge]
        held = {r["text"] for r in (low or rows)}
        for r in rows:
            assert (langid.plain(r["text"]) in parts[lang]) >= (r["text"] in held)
        content = b" ".join(langid.plain(r["text"]) for r in sorted(low or rows, key=lambda r: r["h"]) )
        assert set(parts[lang].split()) <= set(content.split())


@pytest.mark.parametrize("n", [1, 2, 9, 40])
def test_small_tables(spark, n):
    rng = random.Random(n)
    docs = spark.createDataFrame([(i, speech(rng, f"{'ab'[i % 2]}0", 9), f"{'ab'[i % 2]}0") for i in range(n)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert [k for k, *_ in model.dictionaries] == ["a0", "b0"][: min(n, 2)]
    assert langid.identify(docs, model, ["doc_id"]).count() == n


def test_every_language_is_learned(spark):
    rows = [(f"word{k} of tongue {k}", f"l{k:04d}") for k in range(2500)]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"), margin_rows=0, total_bytes=1 << 20)
    assert len(model.dictionaries) == 2500
