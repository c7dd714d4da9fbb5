"""Column functions over sequences of bases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES, COMPLEMENTS = "ACGTN", "TGCAN"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
LETTER_BASES = "ACGTACGTACGTACGTACGTACGTAC"
PHRED = 33


def once(value: Column, use) -> Column:
    """use(value) with value evaluated once, even where use has lambdas of its own that mention it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def counted(n: Column) -> Column:
    """The array 0, 1, ..., n - 1; empty for n below 1 (sequence() would count down)."""
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def pieces(seq: Column, starts: Column, size: int) -> Column:
    """Array of struct(start, seq): the `size` bases from each start, cut before anything is exploded, so that no
    row carries the whole sequence. Bases are ASCII: bytes are cut, which costs the same anywhere in a sequence."""
    cut = lambda s, i: F.struct(i.alias("start"), F.substring(s, i + 1, F.lit(size)).cast("string").alias("seq"))
    return once(seq.cast("binary"), lambda s: F.transform(starts, lambda i: cut(s, i)))


def text_to_bases(text: Column) -> Column:
    """Any text as a sequence: its letters a-z, lower-cased, dealt over the four bases."""
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z]", ""), LETTERS, LETTER_BASES)


def base_check(seq: Column) -> Column:
    """Upper case, and N for everything that is not a base."""
    return F.regexp_replace(F.upper(seq), "[^ACGTN]", "N")


def revcomp(seq: Column) -> Column:
    return F.reverse(F.translate(seq, BASES, COMPLEMENTS))


def kmers(seq: Column, k: int) -> Column:
    """The overlapping k-mers in order; none if the sequence is shorter than k."""
    return once(seq.cast("binary"), lambda s: F.transform(counted(F.length(s) - k + 1), lambda i: F.substring(s, i + 1, F.lit(k)).cast("string")))


def canonical(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement."""
    return F.least(kmer, revcomp(kmer))


def qual_trim_bounds(qual: Column, min_qual: int) -> Column:
    """struct(start, end): what stays when low-quality ends are cut at the largest running sum of
    (min_qual - quality), seen from each end until that sum falls below 0; (0, 0) if nothing stays."""
    scores = once(qual, lambda q: F.transform(counted(F.length(q)), lambda i: F.ascii(F.substring(q, i + 1, F.lit(1))) - PHRED))

    def cut(values: Column) -> Column:
        zero = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("most"), F.lit(0).alias("cut"), F.lit(0).alias("at"), F.lit(False).alias("over"))

        def step(s: Column, q: Column) -> Column:
            total = s["sum"] + min_qual - q
            over = s["over"] | (total < 0)
            better = ~over & (total > s["most"])
            return F.struct(total.alias("sum"), F.when(better, total).otherwise(s["most"]).alias("most"), F.when(better, s["at"] + 1).otherwise(s["cut"]).alias("cut"), (s["at"] + 1).alias("at"), over.alias("over"))

        return F.aggregate(values, zero, step, lambda s: s["cut"])

    start, end = cut(scores), F.length(qual) - cut(F.reverse(scores))
    return F.when(start >= end, F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))).otherwise(F.struct(start.alias("start"), end.alias("end")))


def read_name_truth(name: Column) -> Column:
    """struct(start, ref) out of a simulated read's name: fields 2 and 9 of those between underscores, the
    latter up to a `$` or a space; nulls where there are fewer fields."""
    fields = F.split(name, "_")
    return F.struct(F.get(fields, F.lit(2)).try_cast("int").alias("start"), F.regexp_extract(F.get(fields, F.lit(9)), r"^[^$ ]*", 0).alias("ref"))
