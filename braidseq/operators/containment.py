"""Containment similarity join of reads with windows.

A read's containment in a window is (x / q + 1) * j / (1 + j) with j the share of equal sketch slots, q and
x the numbers of k-mers. The bound `containment > t` asks for m* equal slots at least, so s - m* + 1
disjoint bands of slots must have one in common: an equi-join that loses nothing, then an exact check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sketches import equal_slots
from ..sources.staging import staged


def min_match(q: Column, x: Column | int, slots: int, threshold: float) -> Column:
    """The least number of equal slots that can pass, or null if none can."""
    ratio = F.lit(x) / q + 1
    need = F.floor(threshold / (ratio - threshold) * slots + 1e-9).cast("int") + 1
    return F.when((q > 0) & (ratio > threshold) & (need <= slots), need)


def containment(equal: Column, q: Column, x: Column | int, slots: int) -> Column:
    return (F.lit(x) / q + 1) * (equal / slots) / (1 + equal / slots)


def bands(sketch: Column, n: Column, slots: int) -> Column:
    """The n disjoint stretches of a sketch, hashed, with n and their number."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(n.alias("n"), i.alias("i"), F.xxhash64(F.slice(sketch, F.floor(i * slots / n).cast("int") + 1, (F.floor((i + 1) * slots / n) - F.floor(i * slots / n)).cast("int"))).alias("h")))


def band_index(windows: DataFrame, n_bands: int, slots: int) -> DataFrame:
    """(band, band_hash, win_key) of every window: one row a band."""
    return windows.select("win_key", F.explode(bands(F.col("sketch"), F.lit(n_bands), slots)).alias("b")).select(F.col("b.i").alias("band"), F.col("b.h").alias("band_hash"), "win_key")


def containment_join(reads: DataFrame, windows: DataFrame, slots: int, window_kmers: int, threshold: float, lengths: list[int] | None = None) -> DataFrame:
    """(read_key, win_key, equal, containment) of the pairs above the threshold (strictly), each once.

    reads: read_key, sketch, q and any other columns but win_key and w, which are passed on; windows: win_key,
    sketch. lengths: the values of q where they are known (reads of one length), else they are found by a pass
    over q alone. Reads are sketched and looked up in one pass; windows, which are few beside them, are put into the
    bands that those lengths ask for (`slots` kinds at most) and written, so that Spark knows how large they are
    and broadcasts them only if they are small. A whole-sketch equality needs a single band, so the usual case is one
    hash join.
    """
    n_bands = F.lit(slots) - min_match(F.col("q"), window_kmers, slots, threshold) + 1
    if lengths is None:
        used = reads.select("q").distinct().select(n_bands.alias("n")).where("n is not null").distinct()
    else:
        used = reads.sparkSession.createDataFrame([(q,) for q in sorted(set(lengths))], "q long").select(n_bands.alias("n")).where("n is not null").distinct()
    # one row for each number of bands, slots at most, so this product is bounded by slots times the windows
    targets = windows.select("win_key", F.col("sketch").alias("w")).join(F.broadcast(used)).select("win_key", "w", F.explode(bands(F.col("w"), F.col("n"), slots)).alias("b"))
    targets = staged(targets, "join-targets")
    asked = reads.withColumn("n__", n_bands).where("n__ is not null and sketch is not null")
    probes = asked.withColumn("b", F.explode(bands(F.col("sketch"), F.col("n__"), slots)))
    pairs = probes.join(targets, "b").withColumn("equal", equal_slots(F.col("sketch"), F.col("w")))
    # a pair that agrees in several bands counts in the first of them
    agree = F.exists(F.sequence(F.lit(1), F.col("b.i")), lambda i: F.get(bands(F.col("sketch"), F.col("n__"), slots), i - 1) == F.get(bands(F.col("w"), F.col("n__"), slots), i - 1))
    pairs = pairs.where(F.col("equal") >= F.lit(slots) - F.col("n__") + 1).where((F.col("b.i") == 0) | ~agree)
    found = pairs.withColumn("containment", containment(F.col("equal"), F.col("q"), window_kmers, slots)).where(F.col("containment") > threshold)
    return found.select(*(c for c in reads.columns if c not in ("sketch", "q")), "q", "win_key", "equal", "containment")
