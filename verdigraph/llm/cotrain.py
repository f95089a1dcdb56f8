"""Quality classifier by co-training: a text view and a metadata view label documents for each other."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigraph.llm.common import maybe_broadcast, settle, slices

#: Hash room of the text view, and of the names (source, language) and stated lengths (powers of two) in the metadata view.
TEXT_ROOM, NAME_ROOM, LENGTH_ROOM = 2048, 64, 33
METADATA_ROOM = 2 * NAME_ROOM + LENGTH_ROOM
#: Parts of the labelled rows that are told by views fitted on the other parts.
FOLDS = 4
#: First slots of the text view: words like the one before, then shares of kinds of characters and logarithms of lengths.
SHAPE = 10
BROADCAST_ROWS = 1_000_000
_KINDS = (bytes(range(65, 91)), bytes(b for b in range(33, 127) if not chr(b).isalnum() and b not in b".,;:!?'\"()-"), bytes(range(48, 58)), b".,;:!?", b" \t\n\x0b\x0c\r")


def token_slots(word: bytes) -> tuple[int, int, int]:
    """Slots of the text view for a word, its opening and its ending."""
    room = TEXT_ROOM - SHAPE
    return SHAPE + zlib.crc32(word) % room, SHAPE + zlib.crc32(b"<" + word[:3]) % room, SHAPE + zlib.crc32(b">" + word[-3:]) % room


def text_shape(raw: bytes, ws: list[bytes]) -> list[float]:
    """What a text looks like, scaled to about a tenth: repeats, kinds of characters (upper case, symbols, digits, stops, white), lengths of words, lines and text."""
    size, lines = max(1, len(raw)), raw.count(b"\n") + 1
    kinds = [(len(raw) - len(raw.translate(None, kind))) / size for kind in _KINDS]
    return [sum(map(eq, ws, ws[1:])) / max(1, len(ws)), *(k * s for k, s in zip(kinds, (1, 4, 2, 2, 1))), (1 - kinds[-1]) * size / max(1, len(ws)) / 50, math.log1p(len(ws) / lines) / 50, math.log(lines) / 50, math.log1p(len(raw)) / 100]


def text_view(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Slots in use and what is in them: the shape of the text, and the mean over its words of what they put there."""
    ws = raw.split()
    if not ws:
        return np.zeros(0, "<u2"), np.zeros(0, "<f2")
    counts: dict[bytes, int] = {}
    for w in ws:
        counts[w] = counts.get(w, 0) + 1
    slots = np.array([token_slots(w) for w in counts], dtype=np.int64).ravel()
    out = np.bincount(slots, np.repeat(np.fromiter(counts.values(), dtype=np.float64, count=len(counts)), 3), TEXT_ROOM) / len(ws)
    out[:SHAPE] = text_shape(raw, ws)
    at = np.flatnonzero(out)
    return at.astype("<u2"), out[at].astype("<f2")


def metadata_view(source: str | None, lang: str | None, stated: int | None) -> list[int]:
    """Slots of what a document's row says besides its text: source, language and the power of two of the stated length (null is a value)."""
    source, lang = (zlib.crc32(b"0" if x is None else b"1" + x.encode("utf-8", "replace")) % NAME_ROOM for x in (source, lang))
    return [source, NAME_ROOM + lang, 2 * NAME_ROOM + (0 if stated is None or stated < 0 else min(LENGTH_ROOM - 1, 1 + int(stated).bit_length()))]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, decay: float = 1e-4, rounds: int = 120) -> np.ndarray:
    """Weights (the bias last) of a logistic regression, by Nesterov steps on all rows."""
    n, d = x.shape
    scale = float(np.einsum("ij,ij->", x, x)) / max(1, n) + 1
    w, v, step, total = np.zeros(d + 1), np.zeros(d + 1), 4 / scale, weight.sum()
    for k in range(rounds):
        ahead = w + k / (k + 3) * (w - v)
        err = (_sigmoid(x @ ahead[:-1].astype(x.dtype) + ahead[-1]) - y) * weight / total
        grad = np.append((err.astype(x.dtype) @ x) + decay * ahead[:-1], err.sum())
        v, w = w, ahead - step * grad
    return w


@dataclass(frozen=True)
class Settings:
    """Bounds of what the views are fitted on, and the co-training schedule."""

    #: Labelled rows to fit and calibrate on, half of each class, by least hash of their ids.
    max_labelled: int = 4000
    rounds: int = 4
    #: Documents that each view hands to the other in a round, of all those it is sure of.
    exchanged: int = 400
    sure: float = 0.95
    gain: float = 12.0
    threshold: float = 0.5


@dataclass(frozen=True)
class Rows:
    """Documents as both views see them (text scaled by gain), with quality and weight."""

    keys: np.ndarray
    text: np.ndarray
    metadata: np.ndarray
    quality: np.ndarray
    weight: np.ndarray


@dataclass(frozen=True)
class QualityModel:
    """Weights of both views and of their combination: score = sigmoid(a * text + b * metadata + c)."""

    text: np.ndarray
    metadata: np.ndarray
    combine: tuple[float, float, float]
    #: Keys that each view handed over in each round.
    handed: tuple[tuple[np.ndarray, np.ndarray], ...] = ()


#: Given the weights of both views, the share of good documents and the keys handed over so far, what each view hands over now.
Nominate = Callable[[list[np.ndarray], float, list[np.ndarray]], list[Rows]]


def co_train(known: Rows, good: float, nominate: Nominate, settings: Settings) -> QualityModel:
    """Fit on the labelled rows and what the views label for each other.

    In each round both views are fitted on their own rows, then each hands
    documents it is sure of, and hasn't handed over before, to the other. At
    the end the labelled rows are told by views that are fitted without them,
    a quarter of each class at a time; half of these logits calibrate each
    view, the other half weighs the calibrated views. Without rows of both
    classes in every quarter, the score is the share of good ones (a half if
    there are none). good is the share of good documents among all labels.
    """
    fold = np.zeros(len(known.quality), np.int64)
    for c in (0, 1):
        at = np.flatnonzero(known.quality == c)
        fold[at] = np.arange(len(at)) % FOLDS
    if any(len(set(known.quality[fold == f])) < 2 for f in range(FOLDS)):
        rate = min(max(good, 1e-3), 1 - 1e-3)
        return QualityModel(np.zeros(TEXT_ROOM + 1), np.zeros(METADATA_ROOM + 1), (0.0, 0.0, math.log(rate / (1 - rate))))
    views = [known.text, known.metadata]
    xs: list[list[np.ndarray]] = [[], []]
    ys: list[list[np.ndarray]] = [[], []]
    handed: list[tuple[np.ndarray, np.ndarray]] = []

    def fitted_on(v: int, rows: np.ndarray) -> np.ndarray:
        x, y = np.concatenate([views[v][rows], *xs[v]]), np.concatenate([known.quality[rows], *ys[v]])
        return fit_logistic(x, y, np.where(y > 0.5, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)))

    for turn in range(settings.rounds + 1):
        fitted = [fitted_on(v, fold >= 0) for v in (0, 1)]
        if turn == settings.rounds:
            break
        before = [np.concatenate([h[v] for h in handed]) if handed else np.zeros(0, np.int64) for v in (0, 1)]
        text_says, metadata_says = nominate(fitted, good, before)
        if not len(text_says.keys) and not len(metadata_says.keys):
            break
        xs[1].append(text_says.metadata)
        ys[1].append(text_says.quality)
        xs[0].append(metadata_says.text)
        ys[0].append(metadata_says.quality)
        handed.append((text_says.keys, metadata_says.keys))
    logits = np.zeros((len(known.quality), 2))
    for f in range(FOLDS):
        for v in (0, 1):
            w = fitted_on(v, fold != f)
            logits[fold == f, v] = views[v][fold == f] @ w[:-1].astype(np.float32) + w[-1]
    calibrate, weigh = fold % 2 == 0, fold % 2 == 1
    one = [fit_logistic(logits[calibrate][:, [i]], known.quality[calibrate], known.weight[calibrate], 1e-3, 300) for i in (0, 1)]
    calibrated = np.stack([logits[weigh][:, i] * one[i][0] + one[i][1] for i in (0, 1)], 1)
    both = fit_logistic(calibrated, known.quality[weigh], known.weight[weigh], 1e-3, 300)
    a, b = both[0] * one[0][0], both[1] * one[1][0]
    return QualityModel(fitted[0], fitted[1], (float(a), float(b), float(both[0] * one[0][1] + both[1] * one[1][1] + both[2])), tuple(handed))


FEATURES = "doc_id bigint, h bigint, slots binary, shares binary, metadata array<int>"


def features(docs: DataFrame) -> DataFrame:
    """doc_id, h (a hash of id and text) and what both views see of each whole document, a row for each row of docs; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            slots, shares, metadata = [], [], []
            for text, source, lang, stated in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
                at, share = text_view(b"" if text is None else text.encode("utf-8", "replace"))
                slots.append(at.tobytes())
                shares.append(share.tobytes())
                metadata.append(metadata_view(source, lang, stated))
            cols = [pa.array(slots, pa.binary()), pa.array(shares, pa.binary()), pa.array(metadata, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=["doc_id", "h", "slots", "shares", "metadata"])

    own = docs.columns
    source, lang = (F.col(c).cast("string") if c in own else F.lit(None).cast("string") for c in ("source", "lang"))
    stated = F.col("n_chars").cast("long") if "n_chars" in own else F.lit(None).cast("long")
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, "text", F.lit(31)).alias("h"), F.col("text").alias("t"), source.alias("s"), lang.alias("l"), stated.alias("n")).mapInArrow(run, FEATURES)


def _flat(column: pa.BinaryArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column, and how many each row has."""
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
    return data.view(kind), np.diff(ends) // np.dtype(kind).itemsize


def _logits(batch: pa.RecordBatch, text: np.ndarray, metadata: np.ndarray, gain: float) -> tuple[np.ndarray, np.ndarray]:
    """Logits of both views for rows of features()."""
    slots, sizes = _flat(batch.column("slots"), "<u2")
    shares, _ = _flat(batch.column("shares"), "<f2")
    row = np.repeat(np.arange(len(sizes)), sizes)
    t = np.bincount(row, (text[:-1] * gain)[slots] * shares.astype(np.float64), len(sizes)) + text[-1]
    return t, metadata[:-1][batch.column("metadata").flatten().to_numpy()].reshape(len(sizes), -1).sum(1) + metadata[-1]


def _score(feats: DataFrame, model: QualityModel, settings: Settings) -> DataFrame:
    """doc_id, h, score, text_logit and metadata_logit of each row of feats."""
    sent, gain = feats.sparkSession.sparkContext.broadcast(model), settings.gain

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        a, b, c = m.combine
        for batch in batches:
            if batch.num_rows:
                t, d = _logits(batch, m.text, m.metadata, gain)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), *(pa.array(x, pa.float64()) for x in (_sigmoid(a * t + b * d + c), t, d))], names=["doc_id", "h", "score", "text_logit", "metadata_logit"])

    return feats.mapInArrow(run, "doc_id bigint, h bigint, score double, text_logit double, metadata_logit double")


def _rows(found: DataFrame, gain: float) -> Rows:
    """Collected rows of features() with quality and weight (bounded by who calls), in order of h; of rows with equal h one."""
    got = found.dropDuplicates(["h"]).toArrow().sort_by("h").combine_chunks()
    n = got.num_rows
    text, metadata = np.zeros((n, TEXT_ROOM), np.float32), np.zeros((n, METADATA_ROOM), np.float32)
    for i, (at, share, slots) in enumerate(zip(got["slots"].to_pylist(), got["shares"].to_pylist(), got["metadata"].to_pylist())):
        text[i, np.frombuffer(at, "<u2")] = np.frombuffer(share, "<f2").astype(np.float32) * np.float32(gain)
        metadata[i, slots] = 1
    return Rows(got["h"].to_numpy().astype(np.int64), text, metadata, np.array(got["quality"].to_pylist(), dtype=np.float64), np.array(got["weight"].to_pylist(), dtype=np.float64))


def _fewest(df: DataFrame, hashed: Column, n: int, k: int) -> DataFrame:
    """The k rows of df, which has n, with the least hashes; what is sorted is about 4 k rows, whatever n is."""
    at = F.shiftrightunsigned(hashed, 1)
    most = 1.0 if n <= 8 * k else 4 * k / n
    return df.filter(at <= F.lit(min(2**63 - 1, int(most * 2**63)))).orderBy(at, hashed).limit(k)


def _nominator(feats: DataFrame, known: DataFrame, settings: Settings) -> Nominate:
    """Scores every document without a label in each round; of those that a view is sure of, it hands over the ones with the least hashes, in the proportion of the classes."""
    spark = feats.sparkSession
    told = maybe_broadcast(known.select(F.col("doc_id").alias("k")), BROADCAST_ROWS)

    def nominate(fitted: list[np.ndarray], good: float, before: list[np.ndarray]) -> list[Rows]:
        scored = _score(feats, QualityModel(fitted[0], fitted[1], (0.0, 0.0, 0.0)), settings)
        pool = settle(scored.join(told, F.col("doc_id") == F.col("k"), "left_anti").select("h", "text_logit", "metadata_logit"), "pool")
        line = math.log(settings.sure / (1 - settings.sure))
        cases = []
        for v, name in enumerate(("text_logit", "metadata_logit")):
            handed = F.broadcast(spark.createDataFrame([(int(x),) for x in before[v]], "x bigint"))
            fresh = pool.join(handed, F.col("h") == F.col("x"), "left_anti")
            k = max(1, round(settings.exchanged * (1 - good)))
            cases += [(v, 0, k, fresh.filter(F.col(name) <= -line)), (v, 1, max(1, settings.exchanged - k), fresh.filter(F.col(name) >= line))]
        chosen = None
        for v, label, k, sure in cases:
            picked = _fewest(sure, F.col("h"), sure.count(), k).select("h", F.lit(v).alias("view"), F.lit(float(label)).alias("quality"))
            chosen = picked if chosen is None else chosen.unionByName(picked)
        chosen = settle(chosen.distinct(), "chosen")
        met = settle(feats.join(F.broadcast(chosen), "h").withColumn("weight", F.lit(1.0)), "handed")
        return [_rows(met.filter(F.col("view") == v), settings.gain) for v in (0, 1)]

    return nominate


def fit(feats: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> QualityModel:
    """Co-train on a bounded sample of the labelled documents (Settings.max_labelled) and on all others, which are scored in every round.

    Several labels of a document count by majority (ties: good); labels
    without a document, and null ids and labels, teach nothing. Of documents
    with the same id the row with the least hash of its text teaches. Rare
    classes are sampled like frequent ones, and weighed by their true shares
    when the views are calibrated.
    """
    order = F.xxhash64("doc_id", F.lit(31))
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("q"))
    ids = feats.select("doc_id").filter("doc_id IS NOT NULL").distinct()
    known = settle(known.select("doc_id", (F.col("q") >= 0.5).cast("double").alias("quality")).join(ids, "doc_id", "left_semi"), "known")
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    total, half = sum(counts.values()), settings.max_labelled // 2
    taught = known.limit(0).withColumn("weight", F.lit(1.0))
    for c, n in sorted(counts.items()):
        taught = taught.unionByName(_fewest(known.filter(F.col("quality") == c), order, n, half).withColumn("weight", F.lit(n / min(n, half))))
    chosen = F.broadcast(settle(taught, "taught").withColumnRenamed("doc_id", "id"))
    met = feats.join(chosen, F.col("doc_id") == F.col("id")).drop("id")
    one = met.groupBy("doc_id").agg(F.min_by(F.struct("h", "slots", "shares", "metadata", "quality", "weight"), "h").alias("f")).select("f.*")
    rows = _rows(one, settings.gain)
    return co_train(rows, counts.get(1.0, 0) / total if total else 0.5, _nominator(feats, known, settings), settings)


def quality_scores(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Co-train, then score every whole document.

    The text view sees the words and the look of the text; the metadata view
    sees source, language and stated length, what the row says besides. What the
    views see of a document is written once; the rounds and the scores read
    that. Returns doc_id, score (0 to 1, calibrated), text_logit,
    metadata_logit and kept (score at least the threshold), a row for each
    row of docs, repeated ones included. Null texts have no words: their
    metadata counts. Null sources, languages and lengths are values of their
    own. Equal hashes are equal rows, so ties don't matter. Other columns of
    docs, whatever their names, don't matter. An empty table gives an empty
    result; without labels of both classes all scores are their share.
    """
    feats = settle(features(docs), "views")
    scored = _score(feats, fit(feats, labels, settings), settings)
    return scored.select("doc_id", "score", "text_logit", "metadata_logit", (F.col("score") >= settings.threshold).alias("kept"))
