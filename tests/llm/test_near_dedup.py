"""The near-dedup stage goes by SimHash and pivots, and beyond their radius by bands."""

from pyspark.sql import functions as F

from verdigraph.llm import simhash


def owned(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", F.xxhash64("text").alias("th"), F.col("text").alias("t"))
    return docs, simhash._sketches(docs, ["doc_id", "th"], "t").withColumn("n", F.lit(1)).localCheckpoint()


def test_texts_are_linked_by_simhash_before_bands(spark):
    words = [f"w{i}" for i in range(3000)]
    copy = [*words[:1500], "x", *words[1501:]]
    other = [f"v{i}" for i in range(3000)]
    docs, owners = owned(spark, [" ".join(words), " ".join(copy), " ".join(other)])
    a, b, c = (r["fp"] for r in owners.orderBy("doc_id").collect())
    assert {tuple(r) for r in simhash.fingerprint_pairs(owners).collect()} == {(min(a, b), max(a, b))}
    # Without any band in common the SimHashes still link the two.
    apart = owners.withColumn("bands", F.array("fp"))
    assert {tuple(r) for r in simhash.similar(apart, docs.select("th", "t")).collect()} == {(min(a, b), max(a, b))}


def test_simhash_links_are_verified(spark):
    # Equal SimHashes of unlike texts: the pair is a candidate, and no link.
    docs, owners = owned(spark, [" ".join(f"w{i}" for i in range(50)), " ".join(f"v{i}" for i in range(50)), None, ""])
    alike = owners.withColumn("sim", F.lit(7).cast("long"))
    assert simhash.fingerprint_pairs(alike).count() == 1
    assert simhash.similar(alike, docs.select("th", "t")).count() == 0
