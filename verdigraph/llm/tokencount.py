"""Exact token counts at every prefix of a text, built by dynamic programming over its chunks."""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigraph.llm.common import slices

#: What the pre-tokenizer of the word-end vocabulary keeps together (fixed values).
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
WORD_END_SHAPE = {"suffix": "</w>", "pattern": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
SHORT_ENDINGS, LONG_ENDINGS = {"s", "t", "m", "d"}, {"re", "ve", "ll"}
#: Longest chunk whose table is kept for the next time it occurs; longer ones are tabled anew.
KEPT = 48
LETTER, NUMBER, OTHER, SPACE = range(4)


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


@lru_cache(maxsize=1)
def _joiners() -> frozenset[str]:
    """Characters that normalisation may write together with the one before."""
    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(0x110000))
    return frozenset(chr(int(p[1], 16)) for p in pairs if len(p) == 2 and "<" not in p[0]) | {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}


class Run:
    """Token counts while a text grows by one normalised character after the other.

    A text is pre-tokens; of the last, which may still grow, the dynamic
    program holds for each length i the last token of its encoding and the
    number of tokens. BPE is local: tokens are an encoding just if each two
    neighbours are the encoding of their own characters. So the encoding of i
    symbols is that of i - len(t) symbols and t, for the one token t that
    ends there and agrees with the token before, and nothing is encoded again.
    The word end is a symbol of its own: counts of the text so far put the
    ending token in place of the last one.
    """

    def __init__(self, rules: "PrefixCounter"):
        self.rules, self.base, self.kind, self.short, self.short_base = rules, 0, None, False, 0
        self.open("")

    def open(self, symbols: str) -> None:
        self.chars, self.symbols, self.last, self.number = [], "", [""], [0]

    def mark(self) -> tuple:
        return self.base, self.kind, self.short, self.short_base, self.chars, len(self.chars), self.symbols, self.last, self.number, len(self.last)

    def back(self, mark: tuple) -> None:
        self.base, self.kind, self.short, self.short_base, self.chars, n, self.symbols, self.last, self.number, m = mark
        del self.chars[n:], self.last[m:], self.number[m:]

    def close(self) -> None:
        self.base, self.kind = self.total(), None
        self.open("")

    def total(self) -> int:
        """Tokens of the text so far."""
        if self.kind is None:
            return self.base
        s, n, rules = self.symbols, len(self.symbols), self.rules
        for size in range(1, min(n, rules.widest) + 1):
            if s[n - size :] in rules.ending and rules.agree(self.last[n - size], s[n - size :], True):
                return self.base + self.number[n - size] + 1
        raise ValueError("a symbol that the vocabulary lacks")

    def _extend(self, c: str) -> None:
        self.chars.append(c)
        rules = self.rules
        for x in rules.spell(c):
            s = self.symbols = self.symbols + x
            n = len(s)
            for size in range(1, min(n, rules.widest) + 1):
                if s[n - size :] in rules.inner and rules.agree(self.last[n - size], s[n - size :], False):
                    self.last.append(s[n - size :])
                    self.number.append(self.number[n - size] + 1)
                    break
            else:
                raise ValueError("a symbol that the vocabulary lacks")

    def push(self, c: str) -> None:
        kind = self.rules.kind(c)
        if kind == LETTER and self.kind == LETTER and self.short and len(self.chars) == 1 and self.chars[0] + c in LONG_ENDINGS:
            self.base, self.kind, self.short = self.short_base + self.rules.part("'" + self.chars[0] + c), None, False
            self.open("")
            return
        if kind == LETTER and self.kind == OTHER and self.chars == ["'"]:
            before = self.base
            if c in SHORT_ENDINGS:
                self.base, self.kind, self.short = before + self.rules.part("'" + c), None, False
                self.open("")
                return
            self.close()
            self.kind, self.short, self.short_base = LETTER, True, before
        elif kind != self.kind or kind == NUMBER:
            self.close()
            self.kind, self.short = None if kind == SPACE else kind, False
        elif len(self.chars) > 1:
            self.short = False
        if self.kind is not None:
            self._extend(c)


class PrefixCounter:
    """Counts of a lower-casing, white-space-dropping BPE vocabulary with word ends (tokenizers' .json).

    Tokens never cross ASCII white space, so the count at a prefix is the
    count at the start of its last chunk plus the count of the part of that
    chunk: dp[i] = dp[chunk start] + within[chunk][i - chunk start]. The
    table `within` is kept for each chunk of up to KEPT characters and each
    pre-token, at most `room` of either at a time. Chunks whose pre-tokens
    can't change as they grow are put together from the tables of these;
    all others are tabled by Run, in one pass whatever their length. Other
    vocabularies than of this shape are counted prefix by prefix.
    """

    def __init__(self, path: str, room: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model, self.room = self.library.model, room
        own = json.loads(self.library.to_str())
        suffix = WORD_END_SHAPE["suffix"]
        shape = json.dumps(own.get("pre_tokenizer")) + json.dumps(own.get("normalizer"))
        said = [json.dumps(x)[1:-1] for x in (WORD_END_SHAPE["pattern"], "NFC", "Lowercase", "ByteLevel")]
        self.plain = own["model"].get("end_of_word_suffix") == suffix and all(x in shape for x in said) and not any(own["model"].get(k) for k in ("dropout", "ignore_merges", "byte_fallback", "continuing_subword_prefix"))
        self.letters = _byte_letters()
        self.within: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.parts: dict[str, int] = {}
        self.agreed: dict[tuple[str, str, bool], bool] = {}
        self.kinds: dict[str, int] = {}
        added = sorted((t.content for t in self.library.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        if self.plain:
            merges = [m if isinstance(m, list) else m.split(" ") for m in own["model"]["merges"]]
            self.ranks = {tuple(m): i for i, m in enumerate(merges)}
            self.inner = {t for t in own["model"]["vocab"] if not t.endswith(suffix)}
            self.ending = {t.removesuffix(suffix) for t in own["model"]["vocab"] if t.endswith(suffix)}
            self.widest = max(map(len, self.inner | self.ending))

    def count(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False))

    def spell(self, piece: str) -> str:
        return piece if piece.isascii() and piece.isprintable() else "".join([self.letters[b] for b in piece.encode("utf-8", "replace")])

    def part(self, piece: str) -> int:
        """Tokens of a complete pre-token, by the library's own merges."""
        n = self.parts.get(piece)
        if n is None:
            if len(self.parts) >= self.room:
                self.parts.clear()
            self.parts[piece] = n = len(self.model.tokenize(self.spell(piece)))
        return n

    def kind(self, c: str) -> int:
        """What the pre-tokenizer takes a normalised character for."""
        k = self.kinds.get(c)
        if k is None:
            split = lambda x: self.library.pre_tokenizer.pre_tokenize_str(x)
            alone = split(c)
            k = SPACE if not alone else LETTER if len(split("a" + c)) == 1 else OTHER if len(split("!" + c)) == 1 else NUMBER
            self.kinds[c] = k
        return k

    def agree(self, a: str, b: str, ends: bool) -> bool:
        """True if merging the symbols of a and b gives these two tokens (of b alone, if a is empty)."""
        key = (a, b, ends)
        ok = self.agreed.get(key)
        if ok is None:
            if len(self.agreed) >= self.room:
                self.agreed.clear()
            now = [*a, *b]
            if ends:
                now[-1] += WORD_END_SHAPE["suffix"]
            want = [x for x in (a, b + WORD_END_SHAPE["suffix"] * ends) if x]
            while len(now) > 1:
                least, at = min((self.ranks.get(x, len(self.ranks)), i) for i, x in enumerate(zip(now, now[1:])))
                if least == len(self.ranks):
                    break
                now[at : at + 2] = [now[at] + now[at + 1]]
            self.agreed[key] = ok = now == want
        return ok

    def _piece(self, piece: str) -> bytes:
        """Counts at each character of a pre-token, of which every part is a pre-token too."""
        t = self.pieces.get(piece)
        if t is None:
            if len(self.pieces) >= self.room:
                self.pieces.clear()
            self.pieces[piece] = t = np.array([self.part(piece[:i]) for i in range(1, len(piece) + 1)], dtype=np.int32).tobytes()
        return t

    def _stable(self, chunk: str, low: str) -> bool:
        if "'" in chunk or "<|" in chunk or not chunk.isprintable():
            return False
        if chunk.isascii():
            return True
        return max(chunk) < "ɐ" and len(low) == len(chunk) and "İ" not in chunk and unicodedata.is_normalized("NFC", chunk)

    def _clusters(self, text: str) -> Iterator[tuple[int, int]]:
        """Cuts of a text that normalisation doesn't reach across."""
        start, joiners = 0, _joiners()
        for i in range(1, len(text)):
            if text[i] > "\x7f":
                first = unicodedata.normalize("NFD", text[i])[0]
                if unicodedata.combining(first):
                    continue
                if first in joiners:
                    before = unicodedata.normalize("NFC", text[start:i])
                    if unicodedata.combining(before[-1]) or unicodedata.normalize("NFC", before + text[i]) != before + unicodedata.normalize("NFC", text[i]):
                        continue
            yield start, i
            start = i
        if text:
            yield start, len(text)

    def _walk(self, text: str) -> list[int]:
        """Counts at each character of a text without white space or added tokens."""
        run, out = Run(self), []
        for a, b in self._clusters(text):
            mark, before = run.mark(), ""
            for i in range(a + 1, b + 1):
                norm = "".join([c.lower() for c in unicodedata.normalize("NFC", text[a:i])])
                if not norm.startswith(before):
                    run.back(mark)
                    before = ""
                for c in norm[len(before) :]:
                    run.push(c)
                before = norm
                out.append(run.total())
        return out

    def _table(self, chunk: str) -> bytes:
        if not self.plain:
            return np.array([self.count(chunk[:i]) for i in range(1, len(chunk) + 1)], dtype=np.int32).tobytes()
        low = chunk.lower()
        if len(chunk) <= KEPT and self._stable(chunk, low):
            if low.isalpha():
                return self._piece(low)
            out, base = [], 0
            for piece in PIECES.findall(low):
                out.append(np.frombuffer(self._piece(piece), dtype=np.int32) + base)
                base = int(out[-1][-1])
            return np.concatenate(out).astype(np.int32).tobytes()
        counts, base, at = [], 0, 0
        for m in self.added.finditer(chunk) if self.added else ():
            # Before an added token is complete its characters are text like any other.
            inside = self._walk(chunk[at : m.end()])
            counts += [base + n for n in inside[:-1]]
            base += (inside[m.start() - at - 1] if m.start() > at else 0) + 1
            counts.append(base)
            at = m.end()
        counts += [base + n for n in self._walk(chunk[at:])]
        return np.array(counts, dtype=np.int32).tobytes()

    def chunk(self, raw: bytes) -> bytes:
        """Counts at each character of a chunk, as int32."""
        t = self.within.get(raw)
        if t is None:
            text = raw.decode("utf-8", "replace")
            t = self._table(text)
            if len(text) <= KEPT:
                if len(self.within) >= self.room:
                    self.within.clear()
                self.within[raw] = t
        return t

    def ink(self, text: str) -> np.ndarray:
        """dp at each character that isn't ASCII white space."""
        get = self.within.get
        tables = [get(r) or self.chunk(r) for r in text.encode("utf-8", "replace").split()]
        flat = np.frombuffer(b"".join(tables), dtype=np.int32)
        if not len(flat):
            return flat
        sizes = np.fromiter(map(len, tables), dtype=np.int64, count=len(tables)) // 4
        last = flat[np.cumsum(sizes) - 1]
        return flat + np.repeat((np.cumsum(last, dtype=np.int64) - last).astype(np.int32), sizes)

    def prefixes(self, text: str | None) -> np.ndarray:
        """int32 table of len(text) + 1 exact counts: entry i is the count of text[:i]."""
        if not text:
            return np.zeros(1, np.int32)
        points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
        seen = np.cumsum((points != 32) & ((points < 9) | (points > 13)))
        return np.concatenate([np.zeros(1, np.int32), np.concatenate([np.zeros(1, np.int32), self.ink(text)])[seen]])


_READY: dict[str, PrefixCounter] = {}


def counter_for(path: str) -> PrefixCounter:
    """The worker's own counter, kept from task to task with its chunk tables."""
    if path not in _READY:
        _READY[path] = PrefixCounter(path)
    return _READY[path]


def fitting(table: np.ndarray, budget: int) -> int:
    """Length of the longest prefix with at most budget tokens (more characters may be fewer tokens)."""
    return int(np.flatnonzero(table <= budget)[-1])


def prefix_counts(docs: DataFrame, tokenizer: str, keep: list[str], budgets: list[int], text: str = "text", with_table: bool = False) -> DataFrame:
    """Exact counts of each whole text and the answers to budget questions, from one prefix table per text.

    Returns keep, n_bytes (UTF-8), n_tokens, for each budget over_<b>
    (boolean) and cut_<b> (characters of the longest prefix within b tokens),
    and with with_table `prefixes`, the table itself (see
    PrefixCounter.prefixes). Null texts count as empty: 0 bytes, 0 tokens.
    No shuffle; a row for each row of docs, repeated ones included; an empty
    table gives an empty result. Whatever else docs has doesn't matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_for(tokenizer)
        for batch in slices(batches):
            sizes, totals, tables = [], [], []
            over, cut = [[] for _ in budgets], [[] for _ in budgets]
            for t in batch.column(len(keep)).to_pylist():
                table = counter.prefixes(t)
                n = int(table[-1])
                sizes.append(len(t.encode("utf-8", "replace")) if t else 0)
                totals.append(n)
                for k, b in enumerate(budgets):
                    over[k].append(n > b)
                    cut[k].append(fitting(table, b))
                if with_table:
                    tables.append(table)
            cols = [*(batch.column(i) for i in range(len(keep))), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64())]
            for o, c in zip(over, cut):
                cols += [pa.array(o, pa.bool_()), pa.array(c, pa.int64())]
            if with_table:
                cols.append(pa.array(tables, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=names)

    slim = docs.select(*keep, F.col(text).alias("vg_text"))
    asked = [x for b in budgets for x in (f"over_{b} boolean", f"cut_{b} long")]
    kinds = [f"`{k}` {slim.schema[k].dataType.simpleString()}" for k in keep] + ["n_bytes long", "n_tokens long", *asked] + ["prefixes array<int>"] * with_table
    names = [k.split()[0].strip("`") for k in kinds]
    return slim.mapInArrow(run, ", ".join(kinds))
