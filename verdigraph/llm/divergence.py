"""Source divergence audit: how far a source's words are from those of its language, and of the language's other sources."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdigraph.llm.common import LOWER_AZ, counted_join, salted_join, settle, slices

#: A-Z to a-z, other ASCII to a space: what is left between spaces is a term.
_TERMS = bytes(32 if c < 128 and not chr(c).isalpha() else c for c in LOWER_AZ)
SCALE, PRIOR = 1_000_000_000, 5
GROUP = ["lang", "source"]


def _counted(docs: DataFrame, held: int) -> DataFrame:
    """(lang, source, term, c, d): occurrences and documents of a term in parts of the rows; a row without a term for each group seen.

    A task keeps at most about `held` terms (and those of one document) and hands on what it has summed then.
    """

    def out(sums: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, docs) in sums.items():
            terms = [None, *counts]
            c, d = [0, *counts.values()], [0, *map(docs.__getitem__, counts)]
            for at in range(0, len(terms), 20_000):
                part = slice(at, at + 20_000)
                n = len(terms[part])
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), n), pa.repeat(pa.scalar(source, pa.string()), n), pa.array(terms[part], pa.binary()), pa.array(c[part], pa.int64()), pa.array(d[part], pa.int64())], names=["lang", "source", "term", "c", "d"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        size = 0
        for batch in slices(batches):
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                counts, docs = sums.setdefault((lang, source), (Counter(), Counter()))
                before = len(counts)
                words = text.translate(_TERMS).split()
                counts.update(words)
                docs.update(set(words))
                size += len(counts) - before
                if size >= held:
                    yield from out(sums)
                    sums, size = {}, 0
        yield from out(sums)

    read = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in GROUP], F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return read.mapInArrow(run, "lang string, source string, term binary, c bigint, d bigint")


def _share(count: Column, whole: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (whole + 5 terms)), in whole numbers."""
    wide = lambda c: c.cast("decimal(28,0)")
    return F.call_function("div", wide(F.lit(SCALE) * wide(count + PRIOR)), wide(whole + PRIOR * terms)) + 1


def _pairs(posts: DataFrame, groups: DataFrame, rows: int) -> DataFrame:
    """(lang, a, b, value) for a < b. A term that neither has counts |p0 - p0'|; what a term adds to that is found from its postings."""
    a = groups.select("lang", F.col("source").alias("a"), F.col("p0").alias("p0a"), "terms")
    two = salted_join(a, groups.select("lang", F.col("source").alias("b"), F.col("p0").alias("p0b")), "lang", F.col("a"), rows).filter("a < b")
    none = two.select("lang", "a", "b", F.coalesce(F.col("terms") * F.abs(F.col("p0a") - F.col("p0b")), F.lit(0)).alias("v"))
    # Terms that one source has, against the other as if it lacked them: by the few different counts.
    by_count = posts.groupBy(*GROUP, "p", "p0").agg(F.count("*").alias("m"))
    other = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("po"))
    met = salted_join(by_count, other, "lang", F.struct("source", "p"), rows)
    one = met.filter("source <> other").select("lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b"), (F.col("m") * (F.abs(F.col("p") - F.col("po")) - F.abs(F.col("p0") - F.col("po")))).alias("v"))
    # Terms that both have: postings of a term meet.
    left = posts.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("p0").alias("p0a"))
    right = posts.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("p0").alias("p0b"))
    both = left.join(right.hint("merge"), ["lang", "term"]).filter("a < b").select("lang", "a", "b", F.expr("abs(pa - pb) - abs(pa - p0b) - abs(p0a - pb) + abs(p0a - p0b)").alias("v"))
    return none.unionByName(one).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("v").alias("value"))


def count_bucket(c: Column) -> Column:
    """Counts to 15 one by one, above that eight buckets for each doubling."""
    return F.when(c < 16, c.cast("int")).otherwise((F.log2(c.cast("double")) * 8).cast("int"))


def count_buckets(posts: DataFrame) -> DataFrame:
    """(lang, source, bucket, n, bound): no term of the bucket is further above its language than bound."""
    known = posts.groupBy(*GROUP, "bucket").agg(F.count("*").alias("n"), F.max("p").alias("most"), F.min("q").alias("least"))
    return known.select(*GROUP, "bucket", "n", (F.col("most") - F.col("least")).alias("bound")).filter("bound > 0")


def search(posts: DataFrame, buckets: DataFrame, top: int, rows: int) -> DataFrame:
    """(lang, source, item, value), at most `top` for each group: terms with the largest p - q > 0, ties by term.

    Buckets are evaluated in the order of their bounds: first those that
    hold `top` terms together; then, with the value of the top-th term, all
    whose bound isn't below that. What is left can't reach the list.
    """
    best = Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")

    def evaluated(chosen: DataFrame) -> DataFrame:
        met = counted_join(posts, chosen.select(*GROUP, "bucket", "n"), [*GROUP, "bucket"], "n", rows=rows)
        return met.select(*GROUP, F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")).filter("value > 0")

    def listed(found: DataFrame) -> DataFrame:
        return found.withColumn("at", F.row_number().over(best)).filter(F.col("at") <= top)

    order = Window.partitionBy(*GROUP).orderBy(F.desc("bound"), "bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranked = settle(buckets.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))), "buckets")
    first = settle(listed(evaluated(ranked.filter(F.col("before") < top))), "terms")
    kth = first.filter(F.col("at") == top).select(*GROUP, F.col("value").alias("kth"))
    later = settle(ranked.filter(F.col("before") >= top).join(kth, GROUP, "left").filter("kth IS NULL OR bound >= kth"), "buckets")
    return listed(first.drop("at").unionByName(evaluated(later))).drop("at")


def source_divergence(docs: DataFrame, least_docs: int = 30, top: int = 50, held: int = 200_000, rows: int = 100_000) -> DataFrame:
    """lang, source, part, item, value, rank: see below; docs has text, lang and source, nulls of which count as ''.

    Terms are runs of ASCII letters (in lower case) and non-ASCII characters.
    A language keeps the terms that at least least_docs of its documents
    (rows, repeated ones included) have. A source's share of a term is
    p = 1 + floor(10^9 (count + 5) / (all its kept occurrences + 5 kept terms)),
    and so is a language's, q. Part `pair`: for each other source of the
    language, the sum of |p - p'| over all kept terms (0 without any).
    Part `term`: the terms that the source has, with the largest p - q > 0,
    at most `top`. Ranks go from 1, larger values first, ties by the bytes
    of the item. Empty texts make groups without terms; an empty table gives
    an empty result; other columns of docs don't matter.

    Occurrences are summed in the tasks before they are shuffled, and from
    then on the work is on (source, term) counts, not on texts; a text of any
    length is one dictionary of its own terms. Sources are joined to their
    terms by broadcast up to `rows` of them, else in a join that deals those
    of many terms apart.
    """
    counts = settle(_counted(docs, held).withColumn("term", F.col("term").cast("string")).groupBy(*GROUP, "term").agg(F.sum("c").alias("c"), F.sum("d").alias("d")), "counts")
    kept = counts.filter("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("c").alias("c_lang"), F.sum("d").alias("docs")).filter(F.col("docs") >= least_docs).drop("docs")
    held_terms = settle(counts.filter("term IS NOT NULL").drop("d").join(kept, ["lang", "term"]), "kept")
    # Totals of a language are the sums of its sources.
    sums = held_terms.groupBy(*GROUP).agg(F.sum("c").alias("whole"), F.count("*").alias("n"))
    langs = sums.groupBy("lang").agg(F.sum("whole").alias("whole_lang")).join(held_terms.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("terms")), "lang")
    groups = counts.filter("term IS NULL").select(*GROUP).join(sums, GROUP, "left").join(langs, "lang", "left")
    groups = groups.fillna(0, ["whole", "n", "terms", "whole_lang"]).withColumn("p0", F.when(F.col("terms") > 0, _share(F.lit(0), F.col("whole"), F.col("terms"))))
    groups = settle(groups, "groups")
    posts = counted_join(held_terms, groups, GROUP, "n", rows=rows)
    shares = {"p": _share(F.col("c"), F.col("whole"), F.col("terms")), "q": _share(F.col("c_lang"), F.col("whole_lang"), F.col("terms")), "bucket": count_bucket(F.col("c"))}
    posts = settle(posts.select(*GROUP, "term", "p0", *[v.alias(k) for k, v in shares.items()]), "postings")
    half = _pairs(posts, groups, rows)
    pair = half.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(half.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    term = search(posts, count_buckets(posts), top, rows)
    out = pair.withColumn("part", F.lit("pair")).unionByName(term.withColumn("part", F.lit("term")))
    ranks = Window.partitionBy(*GROUP, "part").orderBy(F.desc("value"), "item")
    return out.select(*GROUP, "part", "item", "value", F.row_number().over(ranks).alias("rank"))
