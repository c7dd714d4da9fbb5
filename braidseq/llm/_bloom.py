"""A blocked Bloom filter of a bounded size: one block of eight 64-bit words per key, one bit in each word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BLOCKS = 1 << 18  # 16 MB, whatever the number of keys; beyond it only the share of false hits grows
KEYS_PER_BLOCK = 32


def blocks_for(n_keys: int, max_blocks: int = MAX_BLOCKS) -> int:
    return min(max_blocks, 1 << max(4, (max(1, n_keys) // KEYS_PER_BLOCK).bit_length()))


class BlockedBloom:
    def __init__(self, words):
        self.words = words  # broadcast of an array (blocks, 8)

    @classmethod
    def of(cls, keys: DataFrame, h1: str, h2: str, max_blocks: int = MAX_BLOCKS) -> BlockedBloom:
        """Built from two hash columns; partial ORs per task, a row per block (max_blocks at most) to the driver."""
        n = blocks_for(keys.count(), max_blocks)
        bits = [F.bit_or(F.expr(f"shiftleft(1L, CAST(shiftrightunsigned({h2}, {6 * i}) & 63 AS INT))")).alias(f"w{i}") for i in range(8)]
        rows = keys.groupBy((F.col(h1).bitwiseAND(F.lit(n - 1))).alias("block")).agg(*bits).toArrow()
        words = np.zeros((n, 8), np.uint64)
        at = rows["block"].to_numpy()
        for i in range(8):
            words[at, i] = rows[f"w{i}"].to_numpy().view(np.uint64)
        return cls(keys.sparkSession.sparkContext.broadcast(words))

    def maybe(self, h1: Column, h2: Column) -> Column:
        """False only for keys that are not in it."""
        shared = self.words

        @F.arrow_udf("boolean")
        def probe(a: pa.Array, b: pa.Array) -> pa.Array:
            words = shared.value
            block = a.fill_null(0).to_numpy(zero_copy_only=False) & (len(words) - 1)
            bits, hit = b.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64), np.ones(len(a), bool)
            for i in range(8):
                hit &= (words[block, i] >> ((bits >> np.uint64(6 * i)) & np.uint64(63))) & np.uint64(1) == 1
            return pa.array(hit)

        return probe(h1, h2)
