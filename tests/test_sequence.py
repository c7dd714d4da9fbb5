import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidseq.functions import sequence as Q
from braidseq.functions import sketches as S


def value(spark, column, **row):
    return spark.createDataFrame([row]).select(column.alias("v")).first().v


def test_revcomp_and_bases(spark):
    assert value(spark, Q.revcomp(F.col("s")), s="ACGTN") == "NACGT"
    assert value(spark, Q.base_check(F.col("s")), s="acgx-N") == "ACGNNN"
    assert value(spark, Q.text_to_bases(F.col("s")), s="A b,c\nD") == "ACGT"


def test_kmers_of_short_sequences_are_none(spark):
    assert value(spark, Q.kmers(F.col("s"), 3), s="AC") == []
    assert value(spark, Q.kmers(F.col("s"), 3), s="ACGT") == ["ACG", "CGT"]
    assert value(spark, Q.canonical(F.col("s")), s="TTT") == "AAA"


def trim(qual, least):
    """Prefix sums of what a base falls short by, up to the first below 0: an end goes up to the first largest positive one."""
    lack = least - (np.frombuffer(qual.encode(), np.uint8).astype(int) - 33)
    gone = []
    for one_way in (lack, lack[::-1]):
        sums = np.concatenate([[0], np.cumsum(one_way)])
        below = np.flatnonzero(sums < 0)
        gone.append(int(sums[: below[0] if len(below) else None].argmax()))
    return (gone[0], len(qual) - gone[1]) if sum(gone) < len(qual) else (0, 0)


@pytest.mark.parametrize("qual", ["", "I", "#", "##IIII#", "IIII", "#I#I#I#", "55555", "?#IIII#I##"])
def test_quality_trim(spark, qual):
    got = value(spark, Q.qual_trim_bounds(F.col("q"), 30), q=qual)
    assert (got.start, got.end) == trim(qual, 30)


def test_read_names(spark):
    got = value(spark, Q.read_name_truth(F.col("s")), s="r_1_42_a_b_c_d_e_f_gene-1$x y")
    assert (got.start, got.ref) == (42, "gene-1")
    assert value(spark, Q.read_name_truth(F.col("s")), s="short").start is None


SEQ = "ACGTTGCATGCCGATAGGCATTACGGATAC"


def test_sketches_ignore_the_strand(spark):
    for sketch, jaccard in ((S.khf_sketch, S.khf_jaccard), (S.kmv_sketch, S.kmv_jaccard)):
        a, b = sketch(F.col("s"), 7, 10), sketch(Q.revcomp(F.col("s")), 7, 10)
        assert value(spark, jaccard(a, b), s=SEQ) == 1.0


def test_sketch_kernel_is_the_column_function(spark):
    """Per slot the least affine hash of the md5 of each k-mer or its reverse complement, in slices and in the JVM alike."""
    rng = random.Random(5)
    seqs = ["".join(rng.choice("ACGTN") for _ in range(rng.randint(0, 90))) for _ in range(40)] + [None]
    for k in (1, 8, 15, 31, 60):
        def by_hand(s):
            found = [s[i : i + k] for i in range(len(s or "") - k + 1)]
            both = [min(x, x[::-1].translate(str.maketrans("ACGT", "TGCA"))) for x in found]
            hashes = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in both]
            return [min((h * a + b) % S.PRIME for h in hashes) for a, b in S.slot_factors(6)] if hashes else None

        df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "i int, s string")
        got = {r.i: r.v for r in df.select("i", S.khf_sketch(F.col("s"), k, 6).alias("v")).collect()}
        assert got == {i: by_hand(s) for i, s in enumerate(seqs)}


def test_kinds_of_sketch(spark):
    assert value(spark, S.sketch("kmv", F.col("s"), 3, 4), s=SEQ) == value(spark, S.kmv_sketch(F.col("s"), 3, 4), s=SEQ)
    fast = value(spark, S.sketch("khf", F.col("s"), 7, 5, fast=True), s=SEQ)
    assert fast == value(spark, S.khf_sketch(Q.revcomp(F.col("s")), 7, 5, True), s=SEQ) and len(fast) == 5
    for kind, k in (("other", 3), ("khf", 0)):
        with pytest.raises(ValueError):
            S.sketch(kind, F.col("s"), k, 4)


def test_sketch_edges(spark):
    assert value(spark, S.khf_sketch(F.col("s"), 7, 10), s="ACG") is None
    kmv = value(spark, S.kmv_sketch(F.col("s"), 7, 10), s="ACGTACGT")
    assert len(kmv) == 10 and kmv[2:] == [0] * 8 and kmv[0] >= kmv[1] > 0
    # repeats stay: AAAA has two 3-mers, the same
    kmv = value(spark, S.kmv_sketch(F.col("s"), 3, 3), s="AAAA")
    assert kmv[0] == kmv[1] and kmv[2] == 0


def test_kmv_by_rows_is_the_same(spark):
    df = spark.createDataFrame([(1, SEQ), (2, SEQ[::-1])], "id int, s string")
    rows = S.kmv_by_rows(df.select("id", F.explode(S.kmer_hashes(F.col("s"), 7)).alias("h")), "id", "h", 8)
    want = {r.id: r.k for r in df.select("id", S.kmv_sketch(F.col("s"), 7, 8).alias("k")).collect()}
    assert {r.id: r.sketch for r in rows.collect()} == want


def test_bloom_has_no_false_negatives_and_modulo_positives(spark):
    known = spark.createDataFrame([(5,), (9984 + 7,)], "h long")
    asked = spark.createDataFrame([(5,), (7,), (8,), (5 + 9984,)], "h long")
    got = {r.h: r.maybe for r in S.bloom_membership(known, asked).collect()}
    assert got == {5: True, 7: True, 8: False, 5 + 9984: True}
    assert S.bloom_bits(10) == 64 and S.bloom_bits(10000) == 9984
