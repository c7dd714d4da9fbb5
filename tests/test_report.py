import os
import random

import pytest

from braidseq.operators import report as R
from braidseq.queries import registry
from tests.test_graph import coverage_string

DATA = "/root/testdata/sf0.001"
SIZE = {"a": 40, "*b": 1, "c": 25, "d": 300, "e": 12}


def samples(spark, seed=1):
    """Alignments of three samples: of equal starts, side by side, within each other, past the end, off it and unmapped."""
    rng = random.Random(seed)
    rows = [(s, name, rng.randrange(size), rng.choice([0, 1, 3, 8, size]), rng.choice([0, 0, 256, 4])) for s in range(3) for name, size in SIZE.items() for _ in range(rng.choice([1, 4, 9, 30]))]
    rows += [(0, "d", 5, 4, 0), (0, "d", 10, 4, 0), (0, "d", 5, 4, 0), (1, "c", 30, 4, 0), (1, "c", 33, 2, 0), (2, "gone", 0, 9, 0), (2, None, 0, 9, 0)]
    alignments = spark.createDataFrame(rows, "sample int, ref_name string, pos int, span int, flags int")
    return rows, alignments, spark.createDataFrame([*SIZE.items(), ("a", SIZE["a"])], "ref_name string, ref_len int")


def wanted(rows, cutoff, low=False):
    out = set()
    for s in range(3):
        for name, size in SIZE.items():
            own = [r for r in rows if r[:2] == (s, name) and r[4] != 4]
            hit = {p for r in own for p in range(r[2], r[2] + r[3] + 1) if p < size}
            text, gap = coverage_string(["M" if p in hit else "D" for p in range(size)])
            if hit and len(hit) / size >= cutoff and not (low and gap):
                out.add((s, name.lstrip("*"), len(own), size, text))
    return out


@pytest.mark.parametrize("cutoff, low", [(0.0, False), (0.5, False), (0.97, True)])
def test_reports_of_all_samples_at_once(spark, cutoff, low):
    for seed in (1, 2):
        rows, alignments, refs = samples(spark, seed)
        got = [tuple(r) for r in R.report(alignments, refs, cutoff, low, by=("sample",)).select("sample", "arg", "read_count", "gene_length", "coverage_cigar").collect()]
        assert set(got) == wanted(rows, cutoff, low) and len(got) == len(set(got))


def test_a_report_without_samples(spark):
    rows, alignments, refs = samples(spark, 3)
    got = {(0, *r) for r in R.report(alignments.drop("sample"), refs, 0.0).collect()}
    assert got == wanted([(0, *r[1:]) for r in rows], 0.0) and got


def test_stretches_are_where_pileup_has_depth(spark):
    _, alignments, refs = samples(spark, 4)
    refs = refs.distinct()
    parts = {}
    for r in R.stretches(alignments, refs).orderBy("ref_name", "nth").collect():
        parts.setdefault(r.ref_name, []).extend(["D"] * r.bare + ["M"] * r.covered)
    depths = {}
    for r in R.pileup(alignments, refs).orderBy("ref_name", "pos").collect():
        depths.setdefault(r.ref_name, []).append("M" if r.depth else "D")
    assert {k: v + ["D"] * (SIZE[k] - len(v)) for k, v in parts.items()} == depths


def shuffled(spark, df):
    """Rows that a query hands from one stage to another."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm
    written = lambda: sum(stages.apply(i).shuffleWriteRecords() for stages in [store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())] for i in range(stages.size()))
    before = written()
    df.collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return written() - before


@pytest.mark.parametrize("name", ["arg_proportion", "combined_profiles"])
def test_alignments_are_dealt_once(spark, name):
    """A row per base and sample would be 100 times the alignments, and all of them on disk."""
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    rows = sum(spark.read.parquet(f"{DATA}/{t}.parquet").count() for t in ("lineitem", "part"))
    assert shuffled(spark, registry.QUERIES[name](spark, DATA)) < 1.5 * rows
