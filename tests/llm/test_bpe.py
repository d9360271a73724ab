"""Ids against a reference encoder, and against the definition on vocabularies where the order of merges is delicate."""

import base64
import random

import pytest

from ravelin.llm import bpe

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks, pattern = bpe.default_vocabulary()
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def test_random_texts(reference):
    enc, rnd = bpe.PairIndexEncoder(*bpe.default_vocabulary()), random.Random(2)
    texts = ["".join(rnd.choice(["the ", "a", "b", "\n", "  ", "é", "漢", "🙂", "'s", "1", "<|endoftext|>", "Ġ"]) for _ in range(rnd.randint(0, 60))) for _ in range(500)]
    offsets, ids = enc.run(texts)
    assert [list(ids[a:b]) for a, b in zip(offsets, offsets[1:])] == [reference.encode_ordinary(t) for t in texts]


def test_delicate_ranks():
    """A merge may make a pair of a lower rank: the word's own order decides, also when words share an index."""
    rnd = random.Random(4)
    for _ in range(60):
        tokens = {bytes([b]) for b in range(256)}
        while len(tokens) < 270:
            tokens.add(bytes(rnd.choice(b"abc") for _ in range(rnd.randint(2, 4))))
        order = [bytes([b]) for b in range(256)] + rnd.sample(sorted(t for t in tokens if len(t) > 1), 14)
        ranks = b"\n".join(base64.b64encode(t) + b" " + str(i).encode() for i, t in enumerate(order))
        enc = bpe.PairIndexEncoder(ranks, r"\S+")
        words = ["".join(rnd.choice("abc") for _ in range(rnd.randint(1, 12))) for _ in range(30)]
        assert [list(x) for x in enc.encode_words(words)] == [list(enc.encode_alone(w)) for w in words]


def test_rows(spark, reference):
    rows = [(1, "Hello  world"), (2, ""), (3, None), (None, " "), (1, "Hello  world"), (4, "a" * 50_000), (5, "x y " * 20_000)]
    df = spark.createDataFrame([(k, t, "z") for k, t in rows], "doc_id long, text string, ids string")
    got = sorted((str(r["doc_id"]), list(r["ids"])) for r in bpe.encode(df).collect())
    assert got == sorted((str(k), reference.encode_ordinary(t) if t else []) for k, t in rows)
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_memo_overflow(monkeypatch, reference):
    monkeypatch.setattr(bpe, "MEMO_WORDS", 5)
    enc = bpe.PairIndexEncoder(*bpe.default_vocabulary())
    for t in ("one two three four five six seven", "two eight nine one", "ten"):
        assert list(enc.run([t])[1]) == reference.encode_ordinary(t)


def test_long_words_alone_as_together():
    import random
    import time

    enc = bpe.PairIndexEncoder(*bpe.default_vocabulary())
    rnd = random.Random(2)
    for _ in range(300):
        w = "".join(rnd.choices("aeinrst tzäß", k=rnd.randrange(1, 40)))
        sym = [enc.byte[b] for b in w.encode()]
        while len(sym) > 1:  # the definition, pair by pair
            rank, i = min((r if (r := enc.merged(a, b)) >= 0 else 1 << 40, i) for i, (a, b) in enumerate(zip(sym, sym[1:], strict=False)))
            if rank == 1 << 40:
                break
            sym[i : i + 2] = [rank]
        assert list(enc.encode_alone(w)) == sym == list(enc.encode_words([w])[0])
    began = time.perf_counter()
    enc.encode_alone("".join(rnd.choices("abcdefgh", k=300_000)))
    assert time.perf_counter() - began < 60
