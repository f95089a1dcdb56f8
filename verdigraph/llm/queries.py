"""One query opN_<name> for each training-data operator, over whole tables, with SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigraph.llm.alignment import token_alignment
from verdigraph.llm.common import read
from verdigraph.llm.cotrain import quality_scores
from verdigraph.llm.decontam import contaminated
from verdigraph.llm.divergence import source_divergence
from verdigraph.llm.exact_dedup import exact_dedup
from verdigraph.llm.langid import language_id
from verdigraph.llm.licenses import license_scan
from verdigraph.llm.mixing import mix
from verdigraph.llm.packing import Vocabulary, pack
from verdigraph.llm.quality_rules import line_frequency_rules
from verdigraph.llm.sharding import shard_documents
from verdigraph.llm.simhash import simhash_dedup
from verdigraph.llm.tokencount import prefix_counts


def op1_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_hypergeometric_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read(spark, sf_dir, "documents"))


def op3_compression_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(read(spark, sf_dir, "documents"))


def op4_entropy_balanced_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


def op5_line_frequency_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency_rules(read(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents"), ["doc_id"])


def op7_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prefix_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), ["doc_id"], [2048])
    return found.select("doc_id", "n_bytes", "n_tokens", F.col("over_2048").alias("over_limit"), F.col("cut_2048").alias("limit_chars"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(read(spark, sf_dir, "documents"))


def op10_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(read(spark, sf_dir, "documents"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


def packing_vocabulary() -> Vocabulary:
    """The byte-level vocabulary of 50,256 ranks; the free id after them ends a document."""
    return Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), 50256)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), packing_vocabulary())


def sharded_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op2 says of sizes, and how many rows each shard has."""
    out = op2_hypergeometric_shuffle(spark, sf_dir)
    shards = out.groupBy("shard").agg(F.count("*").alias("size")).select(F.lit("shard").alias("kind"), F.col("shard").cast("long").alias("id"), "size")
    return shards.unionByName(out.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "size"))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and targets of op4's sources."""
    out = op4_entropy_balanced_mix(spark, sf_dir).join(read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return out.groupBy("source", "source_size").agg(F.sum("size").alias("words"), F.round(F.max("target"), 6).alias("target"), F.round(F.min("target"), 6).alias("least_target"))


def license_base_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op6."""
    return op6_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


#: Words of a text, and a text with A-Z lower-cased, in DuckDB.
_WORDS_SQL = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_LOWER_SQL = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RULES_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, source FROM documents), w AS (SELECT doc_id, t, source, {_WORDS_SQL.format("t")} AS ws FROM d),
l AS (SELECT doc_id, source, line, array_to_string({_WORDS_SQL.format(_LOWER_SQL.format("line"))}, ' ') AS norm, len({_WORDS_SQL.format("line")}) AS n FROM (SELECT doc_id, source, unnest(string_split(t, chr(10))) AS line FROM d)),
q AS (SELECT source, norm FROM l WHERE n > 0 GROUP BY source, norm HAVING count(DISTINCT doc_id) > 10),
g AS (SELECT doc_id, sum(l.n) AS gone FROM l JOIN q ON l.norm = q.norm AND l.source IS NOT DISTINCT FROM q.source GROUP BY doc_id),
s AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup FROM l WHERE n > 0 GROUP BY doc_id),
p AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
r AS (SELECT doc_id, count(DISTINCT j) AS again FROM (SELECT p.doc_id, unnest(range(p.i, p.i + 5)) AS j FROM p JOIN (SELECT doc_id, k FROM p GROUP BY ALL HAVING count(*) > 1) x ON x.doc_id = p.doc_id AND x.k = p.k) GROUP BY doc_id),
a AS (SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(again, 0) AS n_repeat_words, coalesce(gone, 0) AS gone
FROM w LEFT JOIN s ON s.doc_id = w.doc_id LEFT JOIN r ON r.doc_id = w.doc_id LEFT JOIN g ON g.doc_id = w.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM a)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
CAST(gone AS BIGINT) AS n_removed_words, NOT base_failed AND NOT (gone > 0 AND (n_words - gone < 10 OR n_words - gone < CAST(0.3 AS DOUBLE) * n_words)) AS kept FROM b"""
_SHARDS_SQL = """SELECT 'document' AS kind, doc_id AS id, CAST(coalesce(strlen(text), 0) + 8 AS BIGINT) AS size FROM documents
UNION ALL SELECT 'shard', s, CAST(n // 24 + CASE WHEN s < n % 24 THEN 1 ELSE 0 END AS BIGINT) FROM range(24) r(s), (SELECT count(*) AS n FROM documents)"""
_MIX_SQL = f"""WITH z AS (SELECT source, sum(len({_WORDS_SQL.format("coalesce(text, '')")}))::DOUBLE AS size FROM documents GROUP BY source),
k AS (SELECT source, size, 2 * size AS cap, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS wt FROM z), t AS (SELECT 1.5 * sum(size) AS whole FROM z),
o AS (SELECT *, row_number() OVER (ORDER BY cap / wt, source) AS n, coalesce(sum(cap) OVER (ORDER BY cap / wt, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(wt) OVER (ORDER BY cap / wt, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS later FROM k),
v AS (SELECT arg_min((whole - before) / later, n) AS level FROM o, t WHERE (whole - before) / later <= cap / wt)
SELECT source, CAST(size AS BIGINT) AS source_size, CAST(size AS BIGINT) AS words, round(CASE WHEN level IS NULL THEN cap ELSE least(cap, wt * level) END, 6) AS target, round(CASE WHEN level IS NULL THEN cap ELSE least(cap, wt * level) END, 6) AS least_target FROM k, v"""
_LICENSE_SQL = f"""WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER_SQL.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
h AS (SELECT doc_id, i, CASE WHEN ws[i] = 'cc' AND ws[i + 1] = 'by' THEN 'cc-by' WHEN ws[i:i + 2] = ['general', 'public', 'license'] THEN 'gpl' WHEN ws[i:i + 2] = ['all', 'rights', 'reserved'] THEN 'reserved' END AS label FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
f AS (SELECT doc_id, count(*) AS n, min(i) - 1 AS first, max(i) - 1 AS last, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels FROM h WHERE label IS NOT NULL GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, first AS first_word, last AS last_word, coalesce(labels, '') AS base_labels FROM w LEFT JOIN f ON f.doc_id = w.doc_id"""

_EXACT_SQL = """WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS n FROM t GROUP BY text)
SELECT doc_id, keep_id, CAST(n AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(t.text) AS text_sha256 FROM t JOIN g ON t.text = g.text"""

_DIVERGENCE_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all({_LOWER_SQL.format("t")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
g AS (SELECT DISTINCT lang, source FROM d), k AS (SELECT lang, term, count(*) AS c FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
l AS (SELECT lang, count(*) AS v, sum(c) AS n FROM k GROUP BY lang), o AS (SELECT lang, source, term, count(*) AS c FROM w GROUP BY ALL),
x AS (SELECT g.lang, g.source, k.term, coalesce(o.c, 0) AS c, k.c AS c_lang FROM g JOIN k ON g.lang = k.lang LEFT JOIN o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
p AS (SELECT x.*, 1 + (CAST(1000000000 AS HUGEINT) * (c + 5)) // (sum(c) OVER (PARTITION BY x.lang, source) + 5 * v) AS p, 1 + (CAST(1000000000 AS HUGEINT) * (c_lang + 5)) // (n + 5 * v) AS q FROM x JOIN l ON l.lang = x.lang),
s AS (SELECT a.lang, a.source AS a, b.source AS b, sum(abs(a.p - b.p)) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
f AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, CAST(coalesce(s.f, 0) AS BIGINT) AS value FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN s ON s.lang = g.lang AND s.a = g.source AND s.b = h.source
UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM f) WHERE part = 'pair' OR rank <= 50"""


QUERIES = {
    "op1_cotrained_quality": op1_cotrained_quality,
    "op6_license_scan": op6_license_scan,
    "op5_line_frequency_rules": op5_line_frequency_rules,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_simhash_decontamination": op10_simhash_decontamination,
    "op2_hypergeometric_shuffle": op2_hypergeometric_shuffle,
    "op4_entropy_balanced_mix": op4_entropy_balanced_mix,
    "op7_prefix_token_counts": op7_prefix_token_counts,
    "op3_compression_language_id": op3_compression_language_id,
    "op8_simhash_dedup": op8_simhash_dedup,
    "op11_cross_tokenizer_alignment": op11_cross_tokenizer_alignment,
    "op12_source_divergence": op12_source_divergence,
    "op13_exact_dedup": op13_exact_dedup,
    # What SQL can say of operators that it can't express as a whole.
    "sharded_sizes": sharded_sizes,
    "mix_targets": mix_targets,
    "license_base_places": license_base_places,
}
ORACLES: dict[str, str] = {
    "op12_source_divergence": _DIVERGENCE_SQL,
    "op13_exact_dedup": _EXACT_SQL,
    "op5_line_frequency_rules": _RULES_SQL,
    "sharded_sizes": _SHARDS_SQL,
    "mix_targets": _MIX_SQL,
    "license_base_places": _LICENSE_SQL,
}
