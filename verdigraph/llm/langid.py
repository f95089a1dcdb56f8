"""Language identification by compression: the language whose text makes a document's encoding smallest."""

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigraph.llm.common import few_texts, slices

UNKNOWN = "und"
#: a-z stay, all other ASCII becomes a space, bytes of non-ASCII characters stay.
_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_ASCII_LETTER = re.compile(rb"[a-z]")


@dataclass(frozen=True)
class LanguageModel:
    """Language, raw-content dictionary and share of the learned documents, in code-point order of the languages."""

    dictionaries: tuple[tuple[str, bytes, float], ...]
    level: int = 6
    piece: int = 2048
    #: Bytes by which one language must be smaller, as a share of the runner-up, or the document is rejected; fitted (see fit).
    margin: float = 0.0
    #: Nats of preference for each byte of difference, in the score.
    sharpness: float = 0.05


def plain(text: str) -> bytes:
    """Lower-cased words of ASCII letters and non-ASCII characters, joined by single spaces."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).split())


def has_letter(text: str | None, flat: bytes) -> bool:
    return text is not None and (bool(_ASCII_LETTER.search(flat)) or any(map(str.isalpha, text)))


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from: crc32(doc_id as text) mod 4 is 2 (a null doc_id is learned from)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def narrowest(told: list[tuple[float, bool]], least: float = 0.0) -> float:
    """The margin under which predictions (margin, right) are more often wrong than right: of all thresholds the one that rejects most wrong ones less right ones."""
    best, at, gain = 0, least, 0
    for m, right in sorted(told, key=lambda x: (x[0], not x[1])):
        gain += -1 if right else 1
        if gain > best:
            best, at = gain, math.nextafter(m, math.inf)
    return max(least, at)


#: The part of all hashes whose texts no dictionary holds: they fit the margin.
APART = 0.25
_SPACE = 1 << 63


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", dictionary_bytes: int = 112 << 10, total_bytes: int = 32 << 20, excerpt: int = 512, margin_rows: int = 4000, **settings) -> LanguageModel:
    """Learn dictionaries and the margin from rows of docs (the caller has left out those not to learn from).

    The model is fitted on a bounded sample: for each language, excerpts of
    at most `excerpt` bytes from the documents with the least hashes of their
    texts, until dictionary_bytes are full; all dictionaries together hold at
    most total_bytes, however many languages there are, and every language
    has one. Rows without text or language teach nothing; repeated texts
    count once (ties of hashes: the least excerpt).

    Dictionaries draw from the lower three quarters of the hashes. The margin
    is the one under which predictions for margin_rows texts of the upper
    quarter, by largest hash, are more often wrong than right; ties are
    rejected in any case. Only a language all of whose texts lie in the upper
    quarter draws from there, and its texts don't fit the margin. Without any
    row to learn from there is no language.
    """
    known = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    known = known.withColumn("h", F.shiftrightunsigned(F.xxhash64("text", F.lit(17)), 1))
    edge = int(_SPACE * (1 - APART))
    lower = F.col("h") < F.lit(edge)
    counted = known.groupBy("lang", "h").agg(F.count("*").alias("n")).groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("texts"), F.count(F.when(lower, 1)).alias("lower"))
    counts = {r["lang"]: (r["n"], r["texts"], r["lower"]) for r in counted.collect()}
    if not counts:
        return LanguageModel((), **settings)
    spark, total, texts = docs.sparkSession, sum(n for n, *_ in counts.values()), sum(t for _, t, _ in counts.values())
    room = max(1, min(dictionary_bytes, total_bytes // len(counts)))
    want = max(1, 2 * room // excerpt)
    limits = [(k, min(_SPACE - 1, edge - 1 if low else _SPACE, math.ceil((edge if low else _SPACE) * min(1.0, 2 * want / (low or t)))), bool(low)) for k, (_, t, low) in counts.items()]
    limits = F.broadcast(spark.createDataFrame(limits, "k string, most bigint, has_lower boolean"))
    # From the middle of a text: openings and closings are often the same in many documents.
    start = F.greatest(F.lit(1), ((F.length("text") - excerpt) / 2).cast("int"))
    picked = known.join(limits, F.col("lang") == F.col("k")).filter(F.col("h") <= F.col("most"))
    picked = picked.groupBy("lang", "h").agg(F.min(F.col("text").substr(start, F.lit(excerpt))).alias("part"))
    parts: dict[str, list[tuple[int, str]]] = {k: [] for k in counts}
    for r in picked.collect():
        parts[r["lang"]].append((r["h"], r["part"]))
    out = []
    for k in sorted(parts):
        got, size = [], 0
        for _, part in sorted(parts[k]):
            if size >= room:
                break
            got.append(plain(part)[:excerpt])
            size += len(got[-1]) + 1
        content = b" ".join(got)[:room]
        out.append((k, content.ljust(8), counts[k][0] / total))
    model = LanguageModel(tuple(out), **settings)
    if len(out) < 2 or not margin_rows:
        return model
    told = identify(_apart(known, limits, texts, edge, margin_rows), model, ["lang"], margins=True).select("margin", (F.col("lang") == F.col("lang_pred")).alias("right"))
    return replace(model, margin=narrowest([(r["margin"], r["right"]) for r in told.collect()]))


def _apart(known: DataFrame, limits: DataFrame, texts: int, edge: int, margin_rows: int) -> DataFrame:
    """Texts that no dictionary holds, each once, those with the largest hashes: at most margin_rows."""
    # Twice as many as are wanted, by the number of different texts: what is sorted and dealt stays small.
    least = max(edge, int(_SPACE * (1 - min(1.0, 2 * margin_rows / texts))))
    others = known.filter(F.col("h") >= F.lit(least)).join(limits.filter("has_lower"), F.col("lang") == F.col("k"), "left_semi")
    return others.dropDuplicates(["lang", "h"]).orderBy(F.desc("h"), "lang").limit(margin_rows)


class Identifier:
    """A model made ready for use in one worker."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.coders = []
        for lang, content, share in model.dictionaries:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=model.level)
            coder = zstandard.ZstdCompressor(dict_data=d, level=model.level, write_content_size=False, write_checksum=False, write_dict_id=False)
            # The language itself costs its entropy in bytes; that settles texts too short to compress.
            self.coders.append((lang, coder.compress, -math.log2(share) / 8))

    def __call__(self, text: str | None) -> tuple[str, float, bool, float]:
        """Language, score, whether the margin is too narrow, and the margin. The whole text is coded, piece by piece."""
        flat = b"" if text is None else plain(text)
        if not self.coders or not has_letter(text, flat):
            return UNKNOWN, 0.0, True, 0.0
        step = self.model.piece
        # The final piece joins the one before it if it is short.
        ends = [*range(step, max(step + 1, len(flat) - step // 2), step)][: max(0, (len(flat) - 1) // step)]
        cuts = [0, *ends, len(flat)]
        pieces = [flat[a:b] for a, b in zip(cuts, cuts[1:]) if b > a]
        sizes = [price + sum(map(len, map(code, pieces))) for _, code, price in self.coders]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        if len(sizes) == 1:
            return self.coders[0][0], 1.0, False, 1.0
        rest = sizes[:best] + sizes[best + 1 :]
        second = min(rest)
        score = 1 / (1 + sum(math.exp(-self.model.sharpness * (s - sizes[best])) for s in rest))
        margin = (second - sizes[best]) / second
        return self.coders[best][0], score, margin < self.model.margin or second == sizes[best], margin


def identify(docs: DataFrame, model: LanguageModel, keep: list[str], text: str = "text", margins: bool = False) -> DataFrame:
    """keep (columns of docs), lang_pred, score in 0..1, rejected and with margins the margin, one row per row of docs; no shuffle.

    The prediction sees the text alone. Null texts and texts without a
    letter (Unicode category L) get `und`, score 0 and are rejected. Of
    languages with equal sizes the first by code point wins, and the
    document is rejected. Without any learned language all are `und`.
    Repeated rows each keep theirs; an empty table gives an empty result.
    """
    few_texts(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tell = Identifier(sent.value)
        for batch in slices(batches):
            told = [tell(t) for t in batch.column(len(keep)).to_pylist()]
            lang, score, rejected, margin = zip(*told) if told else ((), (), (), ())
            cols = [*(batch.column(i) for i in range(len(keep))), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
            cols += [pa.array(margin, pa.float64())] * margins
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "lang_pred", "score", "rejected", *["margin"] * margins])

    slim = docs.select(*keep, F.col(text).alias("vg_text"))
    kinds = "".join(f"`{k}` {slim.schema[k].dataType.simpleString()}, " for k in keep)
    return slim.mapInArrow(run, f"{kinds}lang_pred string, score double, rejected boolean" + ", margin double" * margins)


def identified(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The rows of docs that identify() doesn't reject, all columns as they are, whatever their names; no shuffle.

    Null texts and texts without a letter go; repeated rows go or stay together.
    """
    few_texts(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def told(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tell = Identifier(sent.value)
        for batch in texts:
            yield pa.array([not tell(t.as_py())[2] for t in batch], pa.bool_())

    return docs.filter(told(F.col(text)))


def language_id(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out, then tell every document's language.

    Returns doc_id, held_out, lang_pred, score and rejected (see identify).
    """
    marked = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    model = fit(marked.filter("NOT held_out"))
    return identify(marked, model, ["doc_id", "held_out"])
