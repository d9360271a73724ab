"""Encoding a corpus with a public byte-level BPE vocabulary.

Method: a pair-occurrence index. The new words of a partition are laid out as one linked list of symbols; every
merge rank maps to all positions where its pair stands. Ranks are applied in ascending order from a heap, each to
all its positions at once, and the lists of the neighbouring pairs are updated. A word is encoded once for each
partition (a bounded memo), its ids are then only copied.

Texts are encoded whole. An empty and a null text both give the empty list. There is no shuffle but where the files
give fewer tasks than cores; the vocabulary (fixed size, about 1 MB) is broadcast.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.llm.common import spread

#: Words remembered for each partition; when full the memo starts anew (it only saves time).
MEMO_WORDS = 400_000
#: Longer words are encoded each time they occur.
MEMO_LENGTH = 80
#: An output batch is closed at this many ids.
BATCH_IDS = 1_000_000


def default_vocabulary() -> tuple[bytes, str]:
    """(rank file, split pattern) of byte_bpe_50k from the installed vocabularies."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


class PairIndexEncoder:
    """Byte-level BPE over a rank file: lines of base64 token and id."""

    def __init__(self, ranks: bytes, pattern: str):
        self.ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line.strip())}
        self.split = regex.compile(pattern).findall
        self.byte = [self.ids[bytes([b])] for b in range(256)]
        self.token = {i: t for t, i in self.ids.items()}
        self.pairs: dict[tuple[int, int], int] = {}
        self.memo: dict[str, array] = {}

    def merged(self, a: int, b: int) -> int:
        """Id of the token the pair makes, -1 if it makes none."""
        r = self.pairs.get((a, b))
        if r is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            r = self.pairs[(a, b)] = self.ids.get(self.token[a] + self.token[b], -1)
        return r

    def encode_words(self, words: list[str]) -> list[array]:
        """Ids of each word, by one index over all of them."""
        if not words:
            return []
        sym: list[int] = []
        starts: list[int] = []
        for w in words:
            starts.append(len(sym))
            sym.extend([self.byte[b] for b in w.encode("utf-8", "replace")])
        n = len(sym)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        for s, e in zip(starts, [*starts[1:], n], strict=True):
            if e > s:
                nxt[e - 1] = prv[s] = -1
        at: dict[int, list[int]] = {}
        merged, pairs = self.merged, self.pairs
        for i in range(n):
            j = nxt[i]
            if j >= 0:
                r = pairs.get((sym[i], sym[j]))
                if r is None:
                    r = merged(sym[i], sym[j])
                if r >= 0:
                    at.setdefault(r, []).append(i)
        active = list(at)
        heapify(active)
        late: list[int] = []
        while active:
            rank = heappop(active)
            places = at.pop(rank, None)
            if places is None:
                continue
            places.sort()
            for i in places:
                j = nxt[i]
                if sym[i] < 0 or j < 0 or merged(sym[i], sym[j]) != rank:
                    continue  # a neighbour's merge took one of the two
                sym[i], sym[j] = rank, -1
                k = nxt[i] = nxt[j]
                if k >= 0:
                    prv[k] = i
                    r = merged(rank, sym[k])
                    if r >= 0:
                        late.append(i) if r < rank else None
                        if r not in at:
                            at[r] = []
                            heappush(active, r)
                        at[r].append(i)
                h = prv[i]
                if h >= 0:
                    r = merged(sym[h], rank)
                    if r >= 0:
                        late.append(h) if r < rank else None
                        if r not in at:
                            at[r] = []
                            heappush(active, r)
                        at[r].append(h)
        out = [array("i", [x for x in sym[s:e] if x >= 0]) for s, e in zip(starts, [*starts[1:], n], strict=True)]
        if late:  # a merge made a pair of a lower rank: in such words the order within the word decides
            from bisect import bisect_right

            for w in {bisect_right(starts, i) - 1 for i in late}:
                out[w] = self.encode_alone(words[w])
        return out

    def encode_alone(self, word: str) -> array:
        """The definition: again and again the leftmost pair of the lowest rank, from a heap of the word's own pairs."""
        sym = [self.byte[b] for b in word.encode("utf-8", "replace")]
        n = len(sym)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := self.merged(sym[i], sym[i + 1])) >= 0]
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            j = nxt[i]
            if sym[i] < 0 or j >= n or self.merged(sym[i], sym[j]) != rank:
                continue  # a neighbour's merge took one of the two
            sym[i], sym[j], nxt[i] = rank, -1, nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
                if (r := self.merged(rank, sym[nxt[j]])) >= 0:
                    heappush(heap, (r, i))
            if prv[i] >= 0 and (r := self.merged(sym[prv[i]], rank)) >= 0:
                heappush(heap, (r, prv[i]))
        return array("i", [x for x in sym if x >= 0])

    def run(self, texts: list[str | None]) -> tuple[array, array]:
        """(offsets, ids) of the texts."""
        memo, split = self.memo, self.split
        words = [split(t) if t else () for t in texts]
        unknown = [w for w in set(chain.from_iterable(words)) if w not in memo]
        if len(memo) + len(unknown) > MEMO_WORDS:
            memo.clear()
            unknown = list(set(chain.from_iterable(words)))
        memo.update(zip(unknown, self.encode_words(unknown), strict=True))
        ids, offsets = array("i"), array("i", [0])
        for ws in words:
            ids.extend(chain.from_iterable(map(memo.__getitem__, ws)))
            offsets.append(len(ids))
        for w in unknown:
            if len(w) > MEMO_LENGTH:
                del memo[w]
        return offsets, ids


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: tuple[bytes, str] | None = None) -> DataFrame:
    """(<key>, ids ARRAY<INT>) of every row; repeated keys and rows stay repeated."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary or default_vocabulary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PairIndexEncoder(*shared.value)
        for batch in batches:
            first, chars, texts = 0, 0, batch.column(1).to_pylist()
            for i, t in enumerate(texts):
                chars += len(t or "")
                if chars >= BATCH_IDS or i + 1 == len(texts):
                    offsets, ids = encoder.run(texts[first : i + 1])
                    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, i + 1 - first), lists], names=[key, "ids"])
                    first, chars = i + 1, 0

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return spread(df.select(key, F.col(text)), key).mapInArrow(run, schema)
