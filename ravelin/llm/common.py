"""Helpers of the text operators."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.session import spread

__all__ = ["Bits", "spread", "table", "word_hash"]

#: Bits of a Bloom filter for each entry, and their bounds: 128 KB to 32 MB.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 28


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_hash(w: str) -> int:
    return xxhash.xxh3_64_intdigest(w)


class Bits:
    """A Bloom filter over 64-bit hashes with two probes (one for each half of a hash), its bits gathered by a mergeable aggregate.

    Its size is bounded whatever it holds; a crowded one lets more through, and misses nothing that is in it.
    """

    def __init__(self, table: np.ndarray | None = None):
        self.table = np.zeros(LEAST_BITS // 8, dtype=np.uint8) if table is None else table
        self.shift = np.uint64(65 - (len(self.table) * 8).bit_length())

    @staticmethod
    def gather(hashes: DataFrame, n: int) -> Bits:
        """Of the column ``h`` with about ``n`` values."""
        bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * n).bit_length()))
        by = 65 - bits.bit_length()
        places = F.array(F.shiftrightunsigned("h", by), F.shiftrightunsigned(F.shiftleft("h", 32), by))
        each = hashes.select(F.explode(places).alias("x")).select((F.col("x") + 1).alias("x"))
        rows = each.groupBy(F.bitmap_bucket_number("x").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("m"))
        table = np.zeros(bits // 8, dtype=np.uint8)
        for r in rows.collect():  # at most bits / 32768 rows of 4 KB
            table[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(r["m"], dtype=np.uint8)
        return Bits(table)

    def has(self, h: np.ndarray) -> np.ndarray:
        """The places in ``h`` (unsigned) of values that are likely in the filter."""
        at = h >> self.shift
        first = np.nonzero(self.table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1)[0]
        at = h[first] << np.uint64(32) >> self.shift
        return first[(self.table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1) > 0]

    def holds(self, word: str) -> bool:
        h = word_hash(word)
        for at in (h >> int(self.shift), (h << 32 & 0xFFFFFFFFFFFFFFFF) >> int(self.shift)):
            if not self.table[at >> 3] >> (at & 7) & 1:
                return False
        return True
