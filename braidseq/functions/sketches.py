"""MinHash sketches and their comparisons, as column functions and as grouped aggregates.

Hashes are non-negative longs below 2**31 that other SQL engines can compute too: 32 bits of an md5 of the
canonical k-mer, and from it one affine hash per slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernels import BLOCK, khf_sketch_column
from .sequence import canonical, kmers, once

PRIME = 2147483647
BLOOM_BITS = 10000
LONGEST = BLOCK - 9  # bases of a k-mer in one block


def slot_factors(slots: int) -> list[tuple[int, int]]:
    """(a, b) of each slot's hash (a h + b) mod PRIME, from two linear rules."""
    return [(1 + (i * 1103515245 + 12345) % (PRIME - 1), (i * 69069 + 362437) % PRIME) for i in range(1, slots + 1)]


def kmer_hash(kmer: Column, fast: bool = False) -> Column:
    """32 bits of an md5; with fast 31 bits of xxhash64, which other engines cannot check."""
    if fast:
        return F.shiftrightunsigned(F.xxhash64(kmer), 33)
    return F.conv(F.substring(F.md5(kmer), 1, 8), 16, 10).cast("long")


def kmer_hashes(seq: Column, k: int, fast: bool = False) -> Column:
    return F.transform(kmers(seq, k), lambda x: kmer_hash(canonical(x), fast))


def slot_hash(h: Column, a: int, b: int) -> Column:
    return (h * F.lit(a).cast("long") + F.lit(b).cast("long")) % F.lit(PRIME).cast("long")


def least_of(hashes: Column, a: int, b: int) -> Column:
    return F.array_min(F.transform(hashes, lambda h: slot_hash(h, a, b)))


def khf_sketch(seq: Column, k: int, slots: int, fast: bool = False) -> Column:
    """Per slot the least hash over all k-mers; null for a sequence shorter than k. No shuffle.

    A numpy kernel over Arrow batches; k-mers too long for one, and fast hashes, stay in the JVM.
    """
    if fast or k > LONGEST:
        made = once(kmer_hashes(seq, k, fast), lambda hs: F.array(*(least_of(hs, a, b) for a, b in slot_factors(slots))))
        return F.when(F.length(seq) >= k, made)
    return khf_sketch_column(seq, k, slot_factors(slots), PRIME)


def kmv_sketch(seq: Column, k: int, size: int, fast: bool = False) -> Column:
    """The `size` least k-mer hashes, repeats kept, from large to small, padded with 0; null for a sequence shorter than k."""
    least = F.sort_array(F.slice(F.array_sort(kmer_hashes(seq, k, fast)), 1, size), False)
    made = once(least, lambda x: F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(size) - F.size(x))))
    return F.when(F.length(seq) >= k, made)


#: Sketches by name, as column functions of (seq, k, size).
SKETCHES = {"khf": khf_sketch, "kmv": kmv_sketch}


def sketch(kind: str, seq: Column, k: int, size: int, fast: bool = False) -> Column:
    """The sketch of a kind; an error for one that is not known, and for sizes below 1."""
    if kind not in SKETCHES:
        raise ValueError(f"not a kind of sketch: {kind}; known are {', '.join(SKETCHES)}")
    if k < 1 or size < 1:
        raise ValueError("k-mers and sketches hold one base and one slot at least")
    return SKETCHES[kind](seq, k, size, fast)


def equal_slots(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda n, x: n + x)


def khf_jaccard(a: Column, b: Column) -> Column:
    """Share of equal slots; an error for sketches of different lengths."""
    same = F.size(a) == F.size(b)
    return F.when(same, equal_slots(a, b) / F.size(a)).otherwise(F.raise_error(F.lit("sketches differ in length")).cast("double"))


def kmv_jaccard(a: Column, b: Column) -> Column:
    """Multiset intersection by the length, of two sketches of the same length."""
    times = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    both = F.aggregate(F.array_distinct(a), F.lit(0), lambda n, x: n + F.least(times(a, x), times(b, x)))
    return F.when(F.size(a) == F.size(b), both / F.size(a)).otherwise(F.raise_error(F.lit("sketches differ in length")).cast("double"))


def exact_jaccard(a: Column, b: Column) -> Column:
    """Shared distinct k-mers by a's distinct ones."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    return F.size(F.array_intersect(a, b)) / F.size(a)


def bloom_bits(bits: int = BLOOM_BITS) -> int:
    """The size is rounded down to whole 64-bit cells, one at least."""
    return max(64, bits // 64 * 64)


def bloom_membership(known: DataFrame, asked: DataFrame, column: str = "h", bits: int = BLOOM_BITS) -> DataFrame:
    """asked with `maybe`: whether some row of known has the same hash modulo the filter's size.

    The filter is a set of at most bloom_bits(bits) positions, whatever the number of rows.
    """
    size = bloom_bits(bits)
    cells = known.select(F.pmod(F.col(column), F.lit(size)).alias("bit__")).distinct().withColumn("maybe", F.lit(True))
    return asked.withColumn("bit__", F.pmod(F.col(column), F.lit(size))).join(F.broadcast(cells), "bit__", "left").withColumn("maybe", F.coalesce("maybe", F.lit(False))).drop("bit__")


def kmv_by_rows(rows: DataFrame, key: str, h: str, size: int) -> DataFrame:
    """(key, sketch) from one row per hash: a bottom-k per key by a ranked window, for sequences too long for one array."""
    ranked = rows.withColumn("k__", F.row_number().over(Window.partitionBy(key).orderBy(h))).where(F.col("k__") <= size)
    found = ranked.groupBy(key).agg(F.sort_array(F.collect_list(h), False).alias("sketch"))
    return found.withColumn("sketch", F.concat("sketch", F.array_repeat(F.lit(0).cast("long"), F.lit(size) - F.size("sketch"))))


