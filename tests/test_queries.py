import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from braidseq.queries import registry

DATA = "/root/testdata/sf0.001"
CHEAP = ["scan_lines", "chunk_lines", "em_run", "arg_proportion", "parse_fastq", "base_check", "revcomp", "kmers", "khf_sketch", "kmv_jaccard", "bloom_membership", "qual_trim", "msa_to_graph", "graph2seqs", "min_matches", "containment_join_text", "em_step", "coverage_cigar", "report_lowcov", "combined_profiles", "dedup_seqs", "alleles_fasta", "validate_reads"]


@pytest.fixture(scope="module")
def tables():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", CHEAP)
def test_query_gives_the_rows_of_its_sql(spark, tables, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    clean = lambda v: round(v, 9) if isinstance(v, float) else v
    got = sorted((tuple(clean(v) for v in r) for r in df.select(*columns).collect()), key=repr)
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = sorted((tuple(clean(v) for v in r) for r in tables.execute(f"select {quoted} from ({registry.SQL[name]})").fetchall()), key=repr)
    assert got == want and got


def test_every_query_is_registered_with_what_it_needs():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 70
    assert {n for n in registry.QUERIES if n not in sql} == set()


def test_entry(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    assert entry.entry(spark).count() >= 0
