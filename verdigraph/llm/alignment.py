"""Cross-tokenizer alignment: groups of tokens of two vocabularies that cover the same bytes, and how usual their pairs are."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigraph.llm.common import settle, slices
from verdigraph.llm.packing import PATTERN

#: Both vocabularies end a token before a single space between two characters that are none: no piece of either holds such a space inside.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Where it isn't so that every space may be cut at.
_UNCUT = re.compile(r" \s|\s |^ | \Z")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
#: Latin text without white space, which all versions of Unicode read alike.
_LATIN = re.compile(r"[!-~\xa1-\u024f]+")


#: What follows from a piece of text alone: its groups as text, and as the bytes of longs its COUNTS, its linked pairs (a << 32 | b) and their multiplicities.
Piece = tuple[bytes, bytes]
COUNTS = ["n_a", "n_b", "n_groups", "n_links", "n_pairs"]


def byte_level() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable ones stand for themselves, the others for 256 and on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _within(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys sorted, each once, and the sums of their values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[starts], np.add.reduceat(values[order], starts)


def pieces_of(text: str | None) -> list[str]:
    if not text:
        return []
    return _CUT.split(text) if _UNCUT.search(text) else text.split(" ")


class Aligner:
    """Two vocabularies made ready in one worker: byte-level BPE (a) and sentencepiece (b), which puts a space in front.

    A text is cut where both always end a token; pieces are aligned many at a
    time, and what is known of short ones is kept, for at most two times
    `held` of them (about 400 bytes each).
    """

    def __init__(self, path_a: str, path_b: str, held: int = 160_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        size = self.b.get_piece_size()
        names = [self.b.id_to_piece(i) for i in range(size)]
        if any("▁" in p.lstrip("▁") for p in names):
            raise ValueError(f"{path_b} has pieces of several words")
        codes, vocabulary = byte_level(), self.a.get_vocab(with_added_tokens=False)
        known = {i: bytes(map(codes.__getitem__, s)) for s, i in vocabulary.items() if codes.keys() >= set(s)}
        self.bytes_a = [known.get(i, b"") for i in range(max(vocabulary.values()) + 1)]
        self.bytes_b = [bytes([int(_BYTE.fullmatch(p)[1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.size_a, self.size_b = (np.array([*map(len, t)], dtype=np.int64) for t in (self.bytes_a, self.bytes_b))
        # A token as text, followed by what stands between it and the next one: within its side, after its side.
        self.said = [f"{i},".encode() for i in range(len(self.bytes_a))] + [f"{i}|".encode() for i in range(len(self.bytes_a))]
        self.said += [f"{i},".encode() for i in range(size)] + [f"{i};".encode() for i in range(size)]
        self.latin = self._ranked(path_a, known)
        self.held, self.new, self.old = held, {}, {}

    def _ranked(self, path: str, known: dict[int, bytes]):
        """The same vocabulary by ranks, several times as fast: where ids are in the order of the merges, they are the ranks. None where they aren't."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = [model["vocab"].get(x + y, -1) for x, y in pairs]
        single = [i for i, t in known.items() if len(t) == 1]
        if ids != sorted(ids) or not ids or len(single) != 256 or max(single) >= ids[0] or len(known) != len(ids) + 256:
            return None
        return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks={t: i for i, t in known.items()}, special_tokens={}).encode_ordinary

    def encoded(self, pieces: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides for each piece with a space in front."""
        out = [self.latin(f" {p}") if self.latin and _LATIN.fullmatch(p) else None for p in pieces]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, self.a.encode_batch_fast([f" {pieces[i]}" for i in rest], add_special_tokens=False)):
            out[i] = x.ids
        return out, self.b.encode(pieces, num_threads=1)

    def align(self, pieces: list[str]) -> list[Piece | None]:
        """What is kept of each piece; None if a side's tokens don't give the piece with a space in front."""
        ids_a, ids_b = self.encoded(pieces)
        whole = b"".join(b" " + p.encode() for p in pieces)
        flat_a, flat_b = list(chain.from_iterable(ids_a)), list(chain.from_iterable(ids_b))
        if any(b"".join(map(t.__getitem__, x)) != whole for t, x in ((self.bytes_a, flat_a), (self.bytes_b, flat_b))):
            if len(pieces) == 1:
                return [None]
            half = len(pieces) // 2
            return self.align(pieces[:half]) + self.align(pieces[half:])
        a, b = np.array(flat_a, dtype=np.int64), np.array(flat_b, dtype=np.int64)
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        in_a, in_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
        upto_a, upto_b = np.r_[0, np.cumsum(in_a)], np.r_[0, np.cumsum(in_b)]
        # Texts of tokens: a group's a, then its b; the last of a side has another sign after it.
        said = np.empty(len(a) + len(b), dtype=np.int64)
        last_a, last_b = ends_a == cuts[group_a], ends_b == cuts[group_b]
        said[np.arange(len(a)) + upto_b[group_a]] = a + len(self.bytes_a) * last_a
        said[np.arange(len(b)) + upto_a[group_b + 1]] = 2 * len(self.bytes_a) + b + len(self.bytes_b) * last_b
        texts = list(map(self.said.__getitem__, said.tolist()))
        n_a, n_b = [*map(len, ids_a)], [*map(len, ids_b)]
        to_a, to_b = np.r_[0, np.cumsum(n_a)], np.r_[0, np.cumsum(n_b)]
        to_group = np.r_[0, group_a[to_a[1:] - 1] + 1]
        links = np.r_[0, np.cumsum(in_a * in_b)][to_group]
        keys, times, starts = self._linked(a, b, group_a, upto_b, in_b, np.repeat(np.arange(len(pieces)), n_a))
        n_pairs = np.diff(np.searchsorted(starts, np.arange(len(pieces) + 1)))
        sizes = len(COUNTS) + 2 * n_pairs
        at = np.cumsum(sizes) - sizes
        flat = np.empty(sizes.sum(), dtype=np.int64)
        flat[at[:, None] + np.arange(len(COUNTS))] = np.stack([n_a, n_b, np.diff(to_group), np.diff(links), n_pairs], axis=1)
        to_pair = _within(at + len(COUNTS), n_pairs)
        flat[to_pair], flat[to_pair + np.repeat(n_pairs, n_pairs)] = keys, times
        numbers, to_text, to_number = flat.tobytes(), (to_a + to_b).tolist(), (8 * np.r_[at, len(flat)]).tolist()
        return [(b"".join(texts[i:j])[:-1], numbers[k:m]) for i, j, k, m in zip(to_text, to_text[1:], to_number, to_number[1:])]

    @staticmethod
    def _linked(a: np.ndarray, b: np.ndarray, group: np.ndarray, upto_b: np.ndarray, in_b: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of each piece, each once, in order of the pieces, how often, and their pieces; expanded in parts of a bounded number of links."""
        size = in_b[group]
        part = np.cumsum(size) // 4_000_000
        bounds = [*np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(a)]
        found = []
        for i, j in zip(bounds, bounds[1:]):
            n = size[i:j]
            key = np.repeat(a[i:j], n) << 32 | b[_within(upto_b[group[i:j]], n)]
            of = np.repeat(piece[i:j], n)
            order = np.lexsort((key, of))
            key, of = key[order], of[order]
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (of[1:] != of[:-1])])
            found.append((key[starts], np.diff(np.r_[starts, len(key)]), of[starts]))
        if len(found) == 1:
            return found[0]
        key, times, of = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((key, of))
        key, times, of = key[order], times[order], of[order]
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (of[1:] != of[:-1])])
        return key[starts], np.add.reduceat(times, starts), of[starts]

    def _learn(self, pieces: set[str]) -> list[str]:
        """Have all the pieces in self.new; the long ones among the fresh are returned, to be let go after use."""
        missing = pieces - self.new.keys()
        again = missing & self.old.keys()
        self.new.update(zip(again, map(self.old.__getitem__, again)))
        fresh = list(missing - again)
        if fresh:
            self.new.update(zip(fresh, self.align(fresh)))
        return [p for p in fresh if len(p) > 32]

    def __call__(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, str, np.ndarray, np.ndarray]]:
        """n_a, n_b, n_groups, n_links, groups_sha256, pairs (a << 32 | b, each once) and their multiplicities for each text."""
        cut = list(map(pieces_of, texts))
        counted = list(map(Counter, cut))
        long = self._learn(set().union(*counted))
        known, none = self.new, np.empty(0, dtype=np.int64)
        for pieces, times in zip(cut, counted):
            each = [*map(known.__getitem__, times)]
            if not pieces or None in each:
                yield 0, 0, 0, 0, "", none, none
                continue
            n = np.fromiter(times.values(), np.int64, len(times))
            groups, numbers = zip(*each)
            flat = np.frombuffer(b"".join(numbers), np.int64)
            sizes = np.fromiter(map(len, numbers), np.int64, len(numbers)) // 8
            at = np.cumsum(sizes) - sizes
            counts = flat[at[:, None] + np.arange(len(COUNTS))]
            n_pairs = counts[:, -1]
            to_pair = _within(at + len(COUNTS), n_pairs)
            text = dict(zip(times, groups))
            sha = hashlib.sha256(b";".join(map(text.__getitem__, pieces)))
            keys, sums = _summed(flat[to_pair], flat[to_pair + np.repeat(n_pairs, n_pairs)] * np.repeat(n, n_pairs))
            yield (*(n @ counts[:, :-1]).tolist(), sha.hexdigest(), keys, sums)
        for p in long:
            del known[p]
        if len(known) > self.held:
            self.old, self.new = known, {}


def token_pairs(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """uid, doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and pairs (array of a, b, m) of each row, written; uid numbers the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = Aligner(path_a, path_b)
        for batch in slices(batches, 128):
            *counts, sha, keys, times = zip(*align(batch.column(2).to_pylist()))
            ends = pa.array([0, *accumulate(map(len, keys))], pa.int32())
            flat = np.concatenate(keys)
            linked = pa.StructArray.from_arrays([pa.array((flat >> 32).astype(np.int32)), pa.array((flat & 0xFFFFFFFF).astype(np.int32)), pa.array(np.concatenate(times))], names=["a", "b", "m"])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, pa.int64()) for c in counts], pa.array(sha, pa.string()), pa.ListArray.from_arrays(ends, linked)], names=["uid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"])

    read = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return settle(read.mapInArrow(run, "uid bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<struct<a:int,b:int,m:bigint>>"), "pairs")


def _contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """uid, n_best and count_sum of the postings of one partition, sorted by their place: the counts of an id's pairs come right before its postings."""
    now, ids, counts, most = None, [], [], 0
    for batch in batches:
        place, b, x, m = (batch.column(i).to_numpy() for i in range(4))
        starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else np.empty(0, dtype=np.int64)
        uid, best, total = [], [], []
        for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(place)]):
            if place[i] >> 1 != now:
                now, ids, counts, most = place[i] >> 1, [], [], 0
            if not place[i] & 1:
                ids.append(b[i:j])
                counts.append(x[i:j])
                continue
            if not most:
                ids, counts = np.concatenate(ids), np.concatenate(counts)
                order = np.argsort(ids)
                ids, counts, most = ids[order], counts[order], counts.max()
            held = counts[np.searchsorted(ids, b[i:j])]
            uid.append(x[i:j])
            best.append(np.where(held == most, m[i:j], 0))
            total.append(held * m[i:j])
        if uid:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (uid, best, total)], names=["uid", "n_best", "count_sum"])


def pair_contributions(postings: DataFrame, parts: int = 1000) -> DataFrame:
    """(uid, n_best, count_sum): sums over the postings (uid, a, b, m) of a document, which has each (a, b) once.

    Postings are dealt by their a and sorted with the counts of a's pairs in
    front (how many documents hold each), so a task streams through them: it
    holds the counts of one id, at most as many as b has ids. An a of more
    than a parts-th of all postings (there are under `parts` such) is dealt
    to as many tasks as it has such parts, its counts to each of them.
    """
    counts = settle(postings.groupBy("a", "b").agg(F.count("*").alias("c")), "counts")
    whole = counts.agg(F.sum("c")).first()[0] or 0
    by_id = counts.groupBy("a").agg(F.sum("c").alias("n"))
    heavy = F.broadcast(by_id.filter(F.col("n") * parts > whole).select("a", F.ceil(F.col("n") * parts / F.lit(max(1, whole))).cast("int").alias("split")))
    split = F.coalesce("split", F.lit(1))
    # A place is an id of a, the part of it, and whether counts (0) or postings (1) stand there: one number to sort by.
    place = lambda part, kind: ((F.col("a").cast("long") * (parts + 1) + part) * 2 + kind).alias("place")
    each = postings.join(heavy, "a", "left").select(place(F.pmod(F.xxhash64("uid"), split), 1), "b", F.col("uid").alias("x"), "m")
    known = counts.join(heavy, "a", "left").withColumn("part", F.explode(F.sequence(F.lit(0), split - 1))).select(place(F.col("part"), 0), "b", F.col("c").alias("x"), F.lit(0).cast("long").alias("m"))
    dealt = known.unionByName(each).repartition(F.shiftright("place", 1)).sortWithinPartitions("place")
    found = dealt.mapInArrow(_contributions, "uid bigint, n_best bigint, count_sum bigint")
    return found.groupBy("uid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def token_alignment(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, one row for each row of docs.

    A is the byte-level vocabulary of path_a over a space and the text, B the
    sentencepiece vocabulary of path_b over the text; special tokens aren't
    added, and their strings are plain text. Byte offsets at which tokens of
    both end cut them into groups; all pairs within a group are links. The
    count of a pair is the number of rows of docs that have it linked.

    Null and empty texts, and those that either side doesn't give back byte
    for byte (U+2581 in a text), have no tokens: zeros and ''. Whole texts
    are aligned, of any length; a text without spaces is one piece. Repeated
    rows each count; an empty table gives an empty result; other columns
    don't matter.
    """
    rows = token_pairs(docs, path_a, path_b, key, text)
    sums = pair_contributions(rows.select("uid", F.explode("pairs").alias("p")).select("uid", "p.*"))
    zero = F.lit(0).cast("long")
    return rows.drop("pairs").join(sums, "uid", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
