"""MinHash sketches over Arrow batches: the same numbers as the column functions of sketches.py, many k-mers at a time.

Sequences are ASCII. A batch is worked through in slices that stay in the processor's cache, so memory
does not grow with the batch.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SLICE = 1 << 14
BLOCK = 64  # bytes of an md5 block; messages of up to BLOCK - 9 bytes fill one

_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))  # fixed values of RFC 1321
_SINES = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint64).astype(np.uint32)
_COMPLEMENT = np.arange(256, dtype=np.uint8)
_COMPLEMENT[np.frombuffer(b"ACGT", np.uint8)] = np.frombuffer(b"TGCA", np.uint8)


def md5_heads(block: np.ndarray, size: int) -> np.ndarray:
    """The first 32 bits of the md5 (RFC 1321) of the first `size` bytes of each row of an (n, 64) array, zeros beyond them."""
    block[:, size] = 0x80
    words: list = list(block.view("<u4").T.copy())
    for i in range(size // 4 + 1, 14):
        words[i] = np.uint32(0)
    words[14], words[15] = np.uint32(8 * size), np.uint32(0)
    begin = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(len(block), x, np.uint32) for x in begin)
    for i in range(64):
        turn = i // 16
        if turn == 0:
            f, g = d ^ (b & (c ^ d)), i
        elif turn == 1:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif turn == 2:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), (7 * i) % 16
        f += a
        f += words[g]
        f += _SINES[i]
        s = _SHIFTS[turn][i % 4]
        a, d, c, b = d, c, b, b + ((f << np.uint32(s)) | (f >> np.uint32(32 - s)))
    return (a + begin[0]).byteswap()


def canonical_hashes(raw: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """The hash (32 bits of an md5) of the canonical form of the k-mer at each start."""
    if k > BLOCK - 9:
        raise ValueError(f"k-mers of more than {BLOCK - 9} bases")
    there, back = np.zeros((len(starts), BLOCK), np.uint8), np.zeros((len(starts), BLOCK), np.uint8)
    there[:, :k] = np.lib.stride_tricks.sliding_window_view(raw, k)[starts]
    back[:, :k] = _COMPLEMENT[there[:, :k][:, ::-1]]
    smaller, open_ = np.zeros(len(starts), bool), np.ones(len(starts), bool)  # whether the reverse complement is the smaller one
    for x, y in zip(there.view(">u8").T[: -(-k // 8)], back.view(">u8").T):
        smaller |= open_ & (y < x)
        open_ &= x == y
    there[smaller] = back[smaller]
    return md5_heads(there, k)


def khf_sketches(raw: np.ndarray, offsets: np.ndarray, k: int, factors: list[tuple[int, int]], prime: int) -> tuple[np.ndarray, np.ndarray]:
    """(whether a sequence has a k-mer, a row of slots for each that has): per slot the least hash over the k-mers."""
    sizes = np.diff(offsets) - k + 1
    some = sizes > 0
    begins, sizes = offsets[:-1][some], sizes[some]
    out = np.full((len(sizes), len(factors)), prime, np.int64)
    p, bits = np.uint64(prime), np.uint64(31)  # prime is 2**31 - 1
    ends = np.cumsum(sizes)
    for at in range(0, int(ends[-1]) if len(ends) else 0, SLICE):
        to = min(at + SLICE, int(ends[-1]))
        first, last = int(np.searchsorted(ends, at, "right")), int(np.searchsorted(ends, to - 1, "right"))
        rows = np.arange(first, last + 1)
        low = np.maximum(ends[rows] - sizes[rows], at)
        place = np.arange(at, to) + np.repeat(begins[rows] - (ends[rows] - sizes[rows]), np.minimum(ends[rows], to) - low)
        h = canonical_hashes(raw, place, k).astype(np.uint64)
        for slot, (a, b) in enumerate(factors):
            x = h * np.uint64(a) + np.uint64(b)
            x = (x & p) + (x >> bits)
            x = (x & p) + (x >> bits)
            x[x == p] = 0
            least = np.minimum.reduceat(x, low - at).astype(np.int64)
            out[rows, slot] = np.minimum(out[rows, slot], least)
    return some, out


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


@cache
def _sketcher(k: int, factors: tuple[tuple[int, int], ...], prime: int):
    @F.arrow_udf("array<long>")
    def sketch(seq: pa.Array) -> pa.Array:
        some, slots = khf_sketches(*_bytes(seq), k, list(factors), prime)
        at = np.append(0, np.cumsum(some * len(factors))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(at), pa.array(slots.reshape(-1)), mask=pa.array(~some))

    return sketch


def khf_sketch_column(seq: Column, k: int, factors: list[tuple[int, int]], prime: int) -> Column:
    return _sketcher(k, tuple(factors), prime)(seq)
