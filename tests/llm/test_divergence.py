"""The divergence audit against loops over all terms."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from verdigraph.llm import divergence
from verdigraph.llm.divergence import count_bucket, count_buckets, search, source_divergence

SCHEMA = "doc_id bigint, text string, lang string, source string, p long"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def by_loop(rows, least_docs, top):
    counts, docs = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for text, lang, source in rows:
        found = TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        counts[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = []
    for lang in docs:
        kept = sorted(t for t, n in docs[lang].items() if n >= least_docs)
        sources = [s for k, s in counts if k == lang]
        whole = collections.Counter()
        for s in sources:
            whole.update(counts[lang, s])

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        q = shares(whole)
        for s in sources:
            p = shares(counts[lang, s])
            pairs = [(x, sum(abs(p[t] - o[t]) for t in kept)) for x in sources if x != s for o in [shares(counts[lang, x])]]
            terms = [(t, p[t] - q[t]) for t in kept if counts[lang, s][t] and p[t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                out += [(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most])]
    return sorted(out)


def made(seed, n=150):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)] + ["é", "Ünï", "漢字", "x\x85y", "", "\U0001f600"]
    rows = []
    for _ in range(n):
        lang, source = rng.choice(["en", "de", None, ""]), rng.choice(["a", "a", "a", "b", "c", "é", None])
        tilt = hash((source,)) % 7 if source is None else len(source) + ord(source[0]) % 5
        rows.append((None if rng.random() < 0.05 else " ".join(rng.choice(words[: 20 * (tilt % 4 + 1)] + words[-6:]) for _ in range(rng.randrange(60))), lang, source))
    return rows + [("", "xx", "alone"), (None, "xx", "other"), ("A-B a_b A1b", "xx", None)]


@pytest.mark.parametrize(("seed", "least_docs", "top", "held", "rows"), [(1, 3, 7, 200_000, 100_000), (2, 3, 3, 5, 0), (3, 1, 50, 40, 3), (4, 1000, 5, 10, 100_000)])
def test_against_loops(spark, seed, least_docs, top, held, rows):
    data = made(seed)
    docs = spark.createDataFrame([(i, *r, 3) for i, r in enumerate(data)], SCHEMA).repartition(3)
    got = source_divergence(docs, least_docs=least_docs, top=top, held=held, rows=rows).collect()
    assert sorted(map(tuple, got)) == by_loop(data, least_docs, top)


def test_empty(spark):
    assert source_divergence(spark.createDataFrame([], SCHEMA)).count() == 0


def test_large_counts_stay_exact(spark):
    c, n, v = 3 * 10**14 + 7, 10**15 + 1, 123_457
    got = spark.range(1).select(divergence._share(F.lit(c), F.lit(n), F.lit(v)).alias("p")).first()[0]
    assert got == 1 + 10**9 * (c + 5) // (n + 5 * v)


def test_search_leaves_most_buckets_out(spark, monkeypatch):
    rng = random.Random(9)
    rows = [("en", s, f"t{i:05d}", c, 2 * c + rng.randrange(c + 3)) for s in "abc" for i in range(4000) for c in [int(1 + 2000 / (1 + rng.random() * 900))]]
    posts = spark.createDataFrame(rows, "lang string, source string, term string, c long, q long").withColumn("p", F.col("c") * 3).withColumn("bucket", count_bucket(F.col("c")))
    seen, plain = [], divergence.counted_join

    def watched(big, small, *args, **more):
        seen.append(small.agg(F.sum("n")).first()[0] or 0)
        return plain(big, small, *args, **more)

    monkeypatch.setattr(divergence, "counted_join", watched)
    got = {(r["source"], r["item"], r["value"]) for r in search(posts, count_buckets(posts), 20, 1000).collect()}
    want = {(s, t, 3 * c - q) for x in "abc" for _, s, t, c, q in sorted([r for r in rows if r[1] == x and 3 * r[3] > r[4]], key=lambda r: (r[4] - 3 * r[3], r[2]))[:20]}
    assert got == want and sum(seen) < len(rows) / 4
