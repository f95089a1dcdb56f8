"""Nulls, empty and long texts, repeats, empty tables and clashing columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from verdigraph.llm.alignment import token_alignment
from verdigraph.llm.cotrain import quality_scores
from verdigraph.llm.decontam import contaminated, without_leaks
from verdigraph.llm.divergence import source_divergence
from verdigraph.llm.exact_dedup import exact_dedup, without_copies
from verdigraph.llm.langid import language_id
from verdigraph.llm.licenses import license_scan
from verdigraph.llm.mixing import mix, mixed
from verdigraph.llm.packing import pack
from verdigraph.llm.quality_rules import line_frequency_rules
from verdigraph.llm.queries import packing_vocabulary
from verdigraph.llm.sharding import shard_documents, shard_rows
from verdigraph.llm.simhash import keep_representatives, simhash_dedup
from verdigraph.llm.tokencount import prefix_counts

NAMES = [
    "vg_id", "vg_th", "vg_n", "vg_c", "vg_h", "vg_source", "vg_size", "vg_slice", "vg_whole", "vg_upto", "vg_cut_source", "vg_cut_size", "vg_slices",
    "VG_Length", "vg_turn", "vg_times", "vg_copy", "vg_text", "vg_row", "vg_m", "vg_part", "vg_place", "vg_cell", "vg_rank", "vg_first",
    "h", "uid", "k", "w", "n", "held_out", "root", "found", "slots", "weight", "i", "t", "source_size", "part", "salt",
]
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Names that the operators also use.
    T.StructField("size", T.StringType()), T.StructField("fp", T.LongType()), T.StructField("shard", T.StringType()),
    T.StructField("copies", T.StringType()), T.StructField("th", T.StringType()), T.StructField("a.b", T.StringType()),
    # Names that they add while they work.
    *[T.StructField(n, T.StringType()) for n in NAMES],
])


def rows():
    base = [
        (1, "the cat sat on the mat and the dog ran home with one more cat", "en", "a", 60),
        (2, "der Hund und die Katze sind nicht im Haus und auch nicht im Garten", "de", "b", 66),
        (2, "der Hund und die Katze sind nicht im Haus und auch nicht im Garten", "de", "b", 66),
        (3, None, None, None, None),
        (4, "", "en", "a", 0),
        (5, " \n\t ", "en", None, 4),
        (6, "123 456 !!!", "en", "c", 11),
        (None, "the cat sat on the mat and the dog ran home with one more cat", "en", "a", 60),
        (None, None, "de", "a", None),
        (7, "word " * 60000, "en", "c", 300000),
        (8, "x" * 200000, "en", "c", 200000),
        (9, "ünï 漢字 \U0001f600 é", "fr", "b", 12),
        (10, " " * 1_200_000 + "the end of it", "en", "c", 1_200_013),
        (11, "ein Anfang\n" + "\n\t" * 800_000 + "und mehr" + " " * 1_100_000, "de", "b", 2_700_019),
    ]
    return [r + ("s", 7, "q", "c", "t", "dot") + ("x",) * len(NAMES) for r in base]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "the cat sat on the mat and the dog ran home"), (2, None), (3, "!!"), (None, "123 456"), (4, "the cat sat on the mat and the dog ran home")], "item_id bigint, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0), (None, 1, 0), (4, None, 1), (99, 1, 1)], "doc_id bigint, quality int, toxic int")


ROW_FOR_ROW = {
    "language": lambda d, x: language_id(d),
    "mix": lambda d, x: mix(d),
    "rules": lambda d, x: line_frequency_rules(d),
    "licence": lambda d, x: license_scan(d, ["doc_id"]),
    "tokens": lambda d, x: prefix_counts(d, x["path"], ["doc_id"], [2048]),
    "simhash": lambda d, x: simhash_dedup(d),
    "shards": lambda d, x: shard_documents(d),
    "quality": lambda d, x: quality_scores(d, x["labels"]),
    "alignment": lambda d, x: token_alignment(d, x["bytes"], x["pieces"]),
    "exact": lambda d, x: exact_dedup(d),
}


@pytest.mark.parametrize("name", ROW_FOR_ROW)
def test_a_row_for_each_row(name, docs, none, labels):
    import public_tokenizers

    more = {"labels": labels, "path": public_tokenizers.path("word_bpe_49k.json"), "bytes": public_tokenizers.path("byte_bpe_50k.json"), "pieces": public_tokenizers.path("piece_bpe_32k.model")}
    got = ROW_FOR_ROW[name](docs, more).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows())
    empty = ROW_FOR_ROW[name](none, more)
    assert empty.count() == 0


def test_no_labels_gives_even_scores(docs, spark):
    got = quality_scores(docs, spark.createDataFrame([], "doc_id bigint, quality int")).collect()
    assert {r["score"] for r in got} == {0.5}


def test_leaks(docs, none, items, spark):
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(docs, items).collect()}
    assert got == {(1, 1), (None, 1), (1, 4), (None, 4), (6, None)}
    assert without_leaks(docs, items).count() == len(rows()) - 3
    assert without_leaks(docs, items).columns == docs.columns
    assert contaminated(none, items).count() == 0
    assert contaminated(docs, spark.createDataFrame([], items.schema)).count() == 0
    assert without_leaks(docs, spark.createDataFrame([], items.schema)).count() == len(rows())


def test_pack_keeps_every_document(docs, none):
    got = pack(docs, packing_vocabulary(), length=256).collect()
    assert sum(s == 0 for r in got for s in r["starts"]) == len(rows())
    assert pack(none, packing_vocabulary()).count() == 0


def test_representatives(docs, none):
    kept = keep_representatives(docs)
    assert kept.columns == docs.columns
    got = sorted(str(r["doc_id"]) for r in kept.collect())
    # Null, empty, blank and null-id texts without words are one group (its least id is 3); 1 stands for its copy without id.
    assert got == sorted(map(str, [1, 2, 3, 6, 7, 8, 9, 10, 11]))
    assert keep_representatives(none).count() == 0


def test_copies_and_divergence(docs, none):
    kept = without_copies(docs)
    assert kept.columns == docs.columns
    # Texts of 1 and its copy without id, of 2 and its repeated row, and the empty ones of 3, 4 and a row without id.
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [1, 2, 4, 5, 6, 7, 8, 9, 10, 11]))
    assert without_copies(none).count() == 0
    got = source_divergence(docs, least_docs=1).collect()
    assert {(r["lang"], r["source"]) for r in got if r["part"] == "pair"} == {("en", "a"), ("en", ""), ("en", "c"), ("de", "a"), ("de", "b")}
    assert source_divergence(none).count() == 0


def test_mixed_rows(docs, none):
    out, plan = mixed(docs), mix(docs)
    assert out.columns == docs.columns
    assert out.count() == plan.agg(F.sum("copies")).first()[0]
    assert mixed(none).count() == 0


def test_shards_replace_clashing_columns(docs):
    out = shard_rows(docs, shards=5, cell_rows=2)
    assert sorted(out.columns) == sorted(set(docs.columns) | {"slot"})
    got = out.collect()
    assert sorted((r["shard"], r["slot"]) for r in got) == [(s, i) for s in range(5) for i in range(3 if s < len(rows()) % 5 else 2)]


def test_pipeline_over_edges(spark, tmp_path):
    spark.createDataFrame(rows(), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "der Hund und die Katze sind nicht im Haus und auch nicht")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs.count())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen[-1] > 0
