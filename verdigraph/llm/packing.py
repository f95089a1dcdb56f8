"""Token-id output: documents packed into fixed rows by best-fit decreasing, written as binary id matrices."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigraph.llm.common import few_texts, slices

#: What a byte-level vocabulary's pre-tokenizer keeps together (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as the pre-tokenizer understands it (Unicode White_Space), and how long a run of it may be for the pattern to go over it (its matcher gives up at about a million).
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_RUN = 100_000


class CapacityTree:
    """Bins by remaining capacity: a segment tree over capacities tells the least one that is large enough."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, remaining: int, number: int) -> None:
        self.bins[remaining].append(number)
        at = self.leaves + remaining
        while at:
            self.count[at] += 1
            at >>= 1

    def best_fit(self, need: int) -> tuple[int, int] | None:
        """Take out a bin with the least remaining capacity of at least need: (remaining, number)."""
        at, count = self.leaves + need, self.count
        while not count[at]:
            # Up to the next subtree on the right.
            while at & 1:
                at >>= 1
            if at == 0:
                return None
            at |= 1
        while at < self.leaves:
            at *= 2
            if not count[at]:
                at += 1
        remaining = at - self.leaves
        number = self.bins[remaining].pop()
        while at:
            count[at] -= 1
            at >>= 1
        return remaining, number


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Items of each bin, largest items first, each put into the fullest bin that still has room (ties: item order)."""
    tree, bins = CapacityTree(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.best_fit(lengths[i])
        if found is None:
            bins.append([i])
            left, number = capacity - lengths[i], len(bins) - 1
        else:
            left, number = found[0] - lengths[i], found[1]
            bins[number].append(i)
        if left:
            tree.add(left, number)
    return bins


@dataclass(frozen=True)
class Vocabulary:
    """A byte-level vocabulary of base64 ranks, read through tiktoken; end is the id put after each document."""

    path: str
    end: int
    pattern: str = PATTERN

    @property
    def kind(self) -> str:
        """Little-endian unsigned integers that hold every id: of two bytes if that is enough, else of four."""
        return "<u2" if self.end < 1 << 16 else "<u4"

    def encoder(self) -> Encoder:
        if self not in _READY:
            _READY[self] = Encoder(self)
        return _READY[self]


class Encoder:
    """A vocabulary made ready in one worker, for texts with runs of white space of any length."""

    def __init__(self, vocabulary: Vocabulary, long_run: int = LONG_RUN):
        import tiktoken

        with open(vocabulary.path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = tiktoken.Encoding("packing", pat_str=vocabulary.pattern, mergeable_ranks=ranks, special_tokens={})
        self.kind, self.long_run = vocabulary.kind, long_run
        self.runs = re.compile(f"(?<![{_SPACE}])[{_SPACE}]{{{long_run},}}+")

    @cached_property
    def whole(self):
        """The vocabulary for a run that is one piece, whatever its characters: the pattern has no alternatives to go back to."""
        import tiktoken

        return tiktoken.Encoding("run", pat_str=r"(?s:.+)", mergeable_ranks=self.split._mergeable_ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        """Ids of a text. A long run of white space is one piece, but for its last character if something follows, as the pattern's lookahead has it."""
        if len(text) < self.long_run:
            return self.split.encode_to_numpy(text, disallowed_special=()).astype(self.kind)
        parts, at = [], 0
        for run in self.runs.finditer(text):
            end = run.end() - (run.end() < len(text))
            parts += [self.split.encode_to_numpy(text[at : run.start()], disallowed_special=()), self.whole.encode_to_numpy(text[run.start() : end], disallowed_special=())]
            at = end
        parts.append(self.split.encode_to_numpy(text[at:], disallowed_special=()))
        return np.concatenate(parts).astype(self.kind)

    def decode(self, ids: list[int]) -> str:
        return self.split.decode(ids)


_READY: dict[Vocabulary, Encoder] = {}

ROWS = "block string, row int, ids binary, used int, cu_seqlens array<int>, position_resets array<int>, doc_ids array<bigint>, starts array<bigint>, doc_numbers array<int>"


def _segments(tokens: list[np.ndarray], length: int) -> list[tuple[int, int, int]]:
    """(document, start, size) pieces of at most length tokens that together are all tokens, in order."""
    return [(d, a, min(length, len(t) - a)) for d, t in enumerate(tokens) for a in range(0, len(t), length)]


def _pack(block: str, ids: list, tokens: list[np.ndarray], length: int, pad: int, kind: str) -> pa.RecordBatch:
    pieces = _segments(tokens, length)
    bins = best_fit_decreasing([n for *_, n in pieces], length)
    matrix = np.full((len(bins), length), pad, dtype=kind)
    used, cuts, resets, owners, starts, numbers = [], [], [], [], [], []
    for r, members in enumerate(bins):
        at, ends = 0, [0]
        for m in members:
            d, a, n = pieces[m]
            matrix[r, at : at + n] = tokens[d][a : a + n]
            at += n
            ends.append(at)
        used.append(at)
        cuts.append(ends)
        resets.append(ends[:-1])
        owners.append([ids[pieces[m][0]] for m in members])
        starts.append([pieces[m][1] for m in members])
        numbers.append([pieces[m][0] for m in members])
    n = len(bins)
    return pa.RecordBatch.from_arrays(
        [pa.array([block] * n, pa.string()), pa.array(range(n), pa.int32()), pa.array([row.tobytes() for row in matrix], pa.binary()), pa.array(used, pa.int32()), pa.array(cuts, pa.list_(pa.int32())), pa.array(resets, pa.list_(pa.int32())), pa.array(owners, pa.list_(pa.int64())), pa.array(starts, pa.list_(pa.int64())), pa.array(numbers, pa.list_(pa.int32()))],
        names=["block", "row", "ids", "used", "cu_seqlens", "position_resets", "doc_ids", "starts", "doc_numbers"],
    )


def pack(docs: DataFrame, vocabulary: Vocabulary, length: int = 2048, block_tokens: int = 2_000_000) -> DataFrame:
    """Token ids of all docs (doc_id, text) in rows of `length`, as Vocabulary.kind; no shuffle.

    A row of the result is a row of a packed id matrix: `block` and `row`
    name it, `ids` are its bytes (padded with the end id after `used`
    tokens), `cu_seqlens` its cumulative segment lengths, `position_resets`
    the columns at which positions start again at 0, `doc_ids` and `starts`
    whose tokens a segment holds and from which on, and `doc_numbers` which
    document of the block that is (doc_ids may be null or repeated).

    Each document's tokens end with the vocabulary's end id, so a null or
    empty text is that id alone. Documents longer than a row fill rows of
    their own, and only the rest is packed with others: nothing is cut off
    or dropped. Texts of any length are encoded whole, in time and memory
    that grow with the text (about 30 bytes a token), runs of white space of
    any length included. Partitions are packed in blocks of about block_tokens tokens
    (a longer document is a block of its own), so memory is bounded by a
    block, and a lost task packs the same again. Best fit over a whole block
    leaves under 1 % padding; blocks never wait for each other. Items of
    equal length are packed in the order of the documents. Repeated rows are
    documents of their own; an empty table gives an empty result; other
    columns of docs don't matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        coder = vocabulary.encoder()
        ids, tokens, held = [], [], 0
        kind = vocabulary.kind
        end = np.array([vocabulary.end], dtype=kind)
        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.concatenate([coder(text), end]) if text else end
                if ids and held + len(own) > block_tokens:
                    yield _pack(f"{task}-{n}", ids, tokens, length, vocabulary.end, kind)
                    ids, tokens, held, n = [], [], 0, n + 1
                ids.append(doc_id)
                tokens.append(own)
                held += len(own)
        if ids:
            yield _pack(f"{task}-{n}", ids, tokens, length, vocabulary.end, kind)

    few_texts(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, ROWS)


def write_packed(packed: DataFrame, path: str) -> None:
    """The packed matrices as Parquet with binary id rows; np.frombuffer(ids, Vocabulary.kind) reads a row."""
    packed.write.mode("overwrite").parquet(path)


def position_ids(cu_seqlens: list[int], length: int) -> np.ndarray:
    """Positions of a row: 0, 1, ... in each segment, and 0 in the padding."""
    out = np.zeros(length, dtype=np.int32)
    for a, b in zip(cu_seqlens, cu_seqlens[1:]):
        out[a:b] = np.arange(b - a)
    return out


def unpack(rows: list, kind: str = "<u2") -> dict[tuple[str, int], tuple[int | None, np.ndarray]]:
    """doc_id and tokens, without the end id, of the documents in collected rows of the result, by block and number of the document."""
    owners: dict[tuple[str, int], int | None] = {}
    pieces: dict[tuple[str, int], list[tuple[int, np.ndarray]]] = {}
    for r in rows:
        ids = np.frombuffer(r["ids"], dtype=kind)
        for number, doc, start, a, b in zip(r["doc_numbers"], r["doc_ids"], r["starts"], r["cu_seqlens"], r["cu_seqlens"][1:]):
            owners[r["block"], number] = doc
            pieces.setdefault((r["block"], number), []).append((start, ids[a:b]))
    return {k: (owners[k], np.concatenate([p for _, p in sorted(v, key=lambda x: x[0])])[:-1]) for k, v in pieces.items()}
