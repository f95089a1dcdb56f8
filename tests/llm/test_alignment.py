"""Cross-tokenizer alignment against whole texts encoded at once and loops over all links."""

import collections
import hashlib
import random

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from verdigraph.llm.alignment import Aligner, byte_level, pair_contributions, token_alignment
from verdigraph.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def coders():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B)


def groups_of(coders, text):
    """Groups of ids, by the definition: tokens of the whole text, offsets of their bytes."""
    if not text:
        return []
    a, b, codes = *coders, byte_level()
    ids_a, ids_b = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)
    as_a = [bytes(codes[c] for c in a.id_to_token(i)) for i in ids_a]
    as_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    whole = f" {text}".encode()
    if b"".join(as_a) != whole or b"".join(as_b) != whole:
        return []
    owner_a = [i for i, s in zip(range(len(ids_a)), as_a) for _ in s]
    owner_b = [i for i, s in zip(range(len(ids_b)), as_b) for _ in s]
    out, last = [], (0, 0)
    for k in range(1, len(whole) + 1):
        end = k == len(whole)
        if end or owner_a[k] != owner_a[k - 1] and owner_b[k] != owner_b[k - 1]:
            upto = (owner_a[k - 1] + 1, owner_b[k - 1] + 1)
            out.append((ids_a[last[0] : upto[0]], ids_b[last[1] : upto[1]]))
            last = upto
    return out


def by_loop(coders, rows):
    each = [(i, groups_of(coders, t)) for i, t in rows]
    links = [[(x, y) for a, b in g for x in a for y in b] for _, g in each]
    held = collections.Counter(p for one in links for p in set(one))
    best = collections.defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for (i, g), one in zip(each, links):
        said = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        sha = hashlib.sha256(said.encode()).hexdigest() if g else ""
        out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(one), sum(held[p] == best[p[0]] for p in one), sum(held[p] for p in one), sha))
    return sorted(out, key=str)


PARTS = ["the ", " of", "word", " ", "  ", "\n", "\t", "\r\n", " ", "᠎", " ", "​", "\x1c", "\x85", "\0", "é", "é", "漢字", "한국", "\U0001f600", "'s", "'ll", "don't", "12345", "$9.50", "<|endoftext|>", "</s>", "<0x41>", "<unk>", "ß", "İ", "::", "---", "x" * 40, "ab" * 30, "̈", "؟سلام", "हिन्दी"]


def texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(30))) for _ in range(n)] + [None, "", " ", "a", "▁", "x ▁y", "a b"]


def test_pieces_are_whole_texts(coders):
    """What is found piece by piece, with what is kept of earlier pieces, is what whole texts give."""
    align = Aligner(A, B, held=300)
    data = texts(1, 4000)
    for at in range(0, len(data), 50):
        for text, got in zip(data[at : at + 50], align(data[at : at + 50])):
            g = groups_of(coders, text)
            said = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
            pairs = collections.Counter(x << 32 | y for a, b in g for x in a for y in b)
            got = (*got[:5], dict(zip(got[5].tolist(), got[6].tolist())))
            assert got == (sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(len(a) * len(b) for a, b in g), hashlib.sha256(said.encode()).hexdigest() if g else "", pairs), repr(text)


@pytest.mark.parametrize("seed", [2, 3])
def test_against_loops(spark, coders, seed):
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts(seed, 150) + ["the word the word"] * 40)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, uid string").repartition(5)
    assert sorted(map(tuple, token_alignment(docs, A, B).collect()), key=str) == by_loop(coders, rows)


def test_query_against_loops(spark, coders):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = QUERIES["op11_cross_tokenizer_alignment"](spark, SF).collect()
    assert sorted(map(tuple, got), key=str) == by_loop(coders, [(r["doc_id"], r["text"]) for r in docs])


def test_empty(spark):
    assert token_alignment(spark.createDataFrame([], "doc_id bigint, text string"), A, B).count() == 0


@pytest.mark.parametrize("parts", [1, 7, 1000])
def test_hot_ids_are_split(spark, parts):
    rng = random.Random(parts)
    rows = [(u, a, b, rng.randrange(1, 9)) for u in range(400) for a in ([5] if u % 3 else [5, 6, u]) for b in rng.sample(range(6), rng.randrange(1, 5))]
    held = collections.Counter((a, b) for _, a, b, _ in rows)
    best = {a: max(n for (x, _), n in held.items() if x == a) for _, a, _, _ in rows}
    want = collections.defaultdict(lambda: [0, 0])
    for u, a, b, m in rows:
        want[u][0] += m * (held[a, b] == best[a])
        want[u][1] += m * held[a, b]
    got = pair_contributions(spark.createDataFrame(rows, "uid bigint, a int, b int, m bigint"), parts=parts).collect()
    assert {r["uid"]: [r["n_best"], r["count_sum"]] for r in got} == dict(want)


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 1_500_000, "x" + "\t" * 1_500_000 + "y", "ab" * 400_000, "漢" * 200_000])
def test_long_runs(coders, text):
    align = Aligner(A, B)
    (got,) = align([text])
    a, b = coders
    assert got[:2] == (len(a.encode(f" {text}", add_special_tokens=False).ids), len(b.encode(text)))
