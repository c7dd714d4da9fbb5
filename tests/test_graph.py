import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from braidseq.operators import align as A
from braidseq.operators import em as E
from braidseq.operators import graph as G
from braidseq.operators import report as R
from braidseq.operators import windows as W
from braidseq.operators.containment import min_match
from braidseq.plans import pipelines as P
from braidseq.sources import formats as IO
from braidseq.sources.index_store import Params, load_index, save_index


def msa_rows(spark, *graphs):
    rows = [(g, i, f"g{g}-{i}", s) for g, seqs in enumerate(graphs) for i, s in enumerate(seqs)]
    return spark.createDataFrame(rows, "graph_id int, row_id int, name string, seq string")


@pytest.fixture(scope="module")
def alleles():
    rng = random.Random(5)
    base = [rng.choice("ACGT") for _ in range(120)]
    out = []
    for a in range(3):
        s = list(base)
        for p in range(10 + a, 120, 37):
            s[p] = {"A": "C", "C": "G", "G": "T", "T": "A"}[s[p]] if a else s[p]
        if a == 2:
            s[60] = s[61] = "-"
        out.append("".join(s))
    return out


def test_graph_gives_the_rows_back(spark, alleles):
    g = G.msa_to_graph(msa_rows(spark, alleles, ["ACGT", "AC-T"]))
    got = {(r.graph_id, r.path_id): r.seq for r in G.graph_to_sequences(g.path_nodes, g.nodes).collect()}
    assert got == {(0, i): s.replace("-", "") for i, s in enumerate(alleles)} | {(1, 0): "ACGT", (1, 1): "ACT"}
    nodes = {r.node_id: r.seq for r in g.nodes.where("graph_id = 1").collect()}
    assert nodes == {1: "AC", 2: "G", 3: "T"}
    order = {r.node_id: r.topo_ord for r in G.topo_order(g.nodes, g.edges).where("graph_id = 0").collect()}
    assert all(order[r.src] < order[r.dst] for r in g.edges.where("graph_id = 0").collect())


def test_consensus_is_left_out(spark):
    rows = spark.createDataFrame([(0, 0, "*a", "ACGT"), (0, 1, "consensus", "TTTT")], "graph_id int, row_id int, name string, seq string")
    g = G.msa_to_graph(rows)
    assert [r.name for r in g.paths.collect()] == ["a"] and g.nodes.count() == 1


def test_topological_order_of_unordered_ids_and_cycles(spark):
    nodes = spark.createDataFrame([(0, n) for n in (1, 2, 3)], "graph_id int, node_id long")
    edges = spark.createDataFrame([(0, 3, 1), (0, 1, 2)], "graph_id int, src long, dst long")
    assert [r.node_id for r in G.topo_order(nodes, edges).orderBy("topo_ord").collect()] == [3, 1, 2]
    with pytest.raises(Exception, match="cycle"):
        G.topo_order(nodes, edges.union(spark.createDataFrame([(0, 2, 3)], edges.schema))).collect()


def test_window_runs_and_the_last_one(spark):
    rows = [(0, 0, i, s) for i, s in enumerate([[1], [1], [2], [2], [2], [3]])] + [(0, 1, i, [9]) for i in range(3)]
    sketched = spark.createDataFrame(rows, "graph_id int, path_id int, start int, sketch array<long>")
    key = lambda df: sorted((r.path_id, r.start, r.merge_span) for r in df.collect())
    assert key(W.merge_runs(sketched, False)) == [(0, 0, 1), (0, 2, 2), (0, 5, 0), (1, 0, 2)]
    assert key(W.merge_runs(sketched)) == [(0, 0, 1), (0, 2, 2), (1, 0, 2)]


def test_windows_of_two_paths_meet(spark):
    g = G.msa_to_graph(msa_rows(spark, ["ACGTACGTTA" * 4, "ACGTACGTTA" * 4]))
    index = P.index_graph(g, Params(k=5, slots=4, window=20, threshold=0.9))
    assert {tuple(r.refs) for r in index.windows.collect()} == {(0, 1)}
    total = index.contents.agg(F.sum("n_bases")).first()[0]
    assert total == 2 * 20 * (index.windows.agg(F.sum(F.col("merge_span") + 1)).first()[0])


def test_min_match_values(spark):
    df = spark.createDataFrame([(n,) for n in (70, 90, 99, 100, 101, 102, 110)], "n int")
    need = df.select("n", min_match(F.col("n") - 30, 70, 21, 0.99).alias("m")).collect()
    assert {r.n: r.m for r in need} == {70: 12, 90: 18, 99: 21, 100: 21, 101: 21, 102: None, 110: None}


def all_walks(edges, node):
    """Every walk from a node, by length; the graph has no cycle."""
    walks = [[node]]
    for w in walks:
        walks += [[*w, n] for n in edges[w[-1]]]
    return walks


def spelled(nodes, walk, offset):
    return "".join(nodes[n] for n in walk)[offset:]


def matching_walks(nodes, edges, node, offset, read):
    """Of all walks those whose letters (N is any) agree with the read as far as both go, and that either are as
    short as can be to spell it or cannot be longer."""
    agree = lambda text: all(a in ("N", b) for a, b in zip(text, read))
    fits = lambda w: len(spelled(nodes, w[:-1], offset)) < len(read) and (len(spelled(nodes, w, offset)) >= len(read) or not edges[w[-1]])
    return sorted(w for w in all_walks(edges, node) if offset < len(nodes[node]) and fits(w) and agree(spelled(nodes, w, offset)))


def test_dfs_against_all_walks(spark):
    rng = random.Random(3)
    nodes = {i: "".join(rng.choice("ACN" if rng.random() < 0.1 else "AC") for _ in range(rng.randint(1, 3))) for i in range(1, 12)}
    edges = {i: sorted({j for j in (i + 1, i + 2, i + 3) if j < 12 and rng.random() < 0.8}) for i in nodes}
    g = G.Graph(
        spark.createDataFrame([(0, i, s, len(s)) for i, s in nodes.items()], "graph_id int, node_id long, seq string, seg_len int"),
        spark.createDataFrame([(0, i, j) for i, js in edges.items() for j in js], "graph_id int, src long, dst long"),
        None, None,
    )
    asked = [(k, 0, rng.randint(1, 11), rng.randint(0, 2), "".join(rng.choice("AC") for _ in range(rng.randint(1, 7)))) for k in range(60)]
    df = spark.createDataFrame(asked, "k int, graph_id int, node_id long, offset int, seq string")
    got = {}
    for r in A.dfs_align(df, g).collect():
        got.setdefault(r.k, []).append(list(r.trav))
    for k, _, node, offset, read in asked:
        assert sorted(got.get(k, [])) == matching_walks(nodes, edges, node, offset, read)


def test_index_align_report_end_to_end(spark, alleles, tmp_path):
    params = Params(k=11, slots=8, window=40, threshold=0.9, min_coverage=0.1)
    index = P.build_index(msa_rows(spark, alleles), params)
    save_index(index, str(tmp_path / "index"))
    index = load_index(spark, str(tmp_path / "index"))
    seq = alleles[1]
    reads = [(f"r{i}", seq[i : i + 40], "I" * 40) for i in range(0, len(seq) - 39, 5)]
    reads.append(("back", str(seq[20:60])[::-1].translate(str.maketrans("ACGT", "TGCA")), None))
    done = P.align_reads(spark.createDataFrame(reads, "read_id string, seq string, qual string"), index)
    records = done["records"]
    right = records.where("ref_name = 'g0-1' and cigar = '40M'").select("read_id", "pos", "flags").distinct().collect()
    assert {r.read_id: r.pos for r in right} == {f"r{i}": i for i in range(0, len(seq) - 39, 5)} | {"back": 20}
    assert all(r.flags & 16 for r in right if r.read_id == "back")
    refs = G.sam_references(index.graph.paths, G.path_lengths(index.graph.path_nodes, index.graph.nodes))
    rows = {r.arg: r for r in P.report_records(records, refs.select("ref_name", "ref_len"), 0.97).collect()}
    assert rows["g0-1"].coverage_cigar == "120M"
    totals = done["totals"].first().kmer_total
    em, called = P.haplotypes(done["graph"], done["paths"], done["weights"], done["totals"], totals, 0.05, 5, 200)
    assert "g0-1" in {r.name for r in called.collect()}
    skipped = P.align_reads(spark.createDataFrame(reads, "read_id string, seq string, qual string"), index, no_align=True)
    assert skipped["records"] is None and skipped["weights"].count() > 0


def test_fixed_em_keeps_the_mass(spark):
    ec = spark.createDataFrame([(0, 1, 0, 2.0), (0, 1, 1, 2.0), (0, 2, 0, 3.0), (0, 3, 1, 0.0)], "graph_id int, node_id long, path_id int, count double")
    paths = spark.createDataFrame([(0, 0), (0, 1), (0, 2)], "graph_id int, path_id int")
    rows = {r.path_id: r for r in E.em_run(ec, paths, 3, 500).collect()}
    assert abs(sum(r.alpha for r in rows.values()) - 5.0) < 1e-9 and rows[2].alpha == 0 and rows[0].alpha > 4.5
    with pytest.raises(ValueError):
        E.em_run(ec, paths, 10, 5)


def test_large_graphs_converge_alike(spark):
    """In rounds of joins or each in one task: the same shares and numbers of rounds."""
    rng = random.Random(8)
    rows = [(g, n, p, float(rng.randint(0, 9))) for g in range(4) for n in range(6) for p in rng.sample(range(5), 2)]
    ec = spark.createDataFrame(rows, "graph_id int, node_id long, path_id int, count double")
    paths = spark.createDataFrame([(g, p) for g in range(5) for p in range(5)], "graph_id int, path_id int")
    runs = [{(r.graph_id, r.path_id): (round(r.alpha, 9), r.iterations) for r in E.em_run(ec, paths, 2, 6, large).collect()} for large in (10**9, 0, 11)]
    assert runs[0] == runs[2] and len(runs[0]) == 25
    assert runs[1] == runs[0]


def coverage_string(ops):
    """(run-length string, internal gap) from the list of runs. What the gap rule looks at is the runs, of which a
    last one of a single base hides the one before it: a gap is internal if three or more are left, but for D M D."""
    runs = [(op, len(list(same))) for op, same in groupby(ops)]
    if len(ops) < 2:
        return "", False
    seen = [op for op, _ in runs]
    if runs[-1][1] == 1 and len(runs) > 1:
        del seen[-2]
    return "".join(f"{n}{op}" for op, n in runs), len(seen) > 2 and sorted(seen) != ["D", "D", "M"]


def test_coverage_strings(spark):
    cases = ["M", "D", "MM", "MD", "MDDM", "MDMD", "MMDDMM", "DMMD", "DDMMD", "MDMDM", "DMMDDMD"]
    rows = [(c, i, int(op == "M")) for c in cases for i, op in enumerate(c)]
    depths = spark.createDataFrame(rows, "ref_name string, pos int, depth long")
    got = {r.ref_name: (r.cigar, r.internal_gap) for r in R.coverage_cigar(R.coverage_runs(depths)).collect()}
    assert got == {c: coverage_string(c) for c in cases}


def test_pileup_ends(spark):
    al = spark.createDataFrame([("a", 0, 3, 0), ("a", 8, 5, 0), ("a", 1, 9, 4)], "ref_name string, pos int, span int, flags int")
    refs = spark.createDataFrame([("a", 10), ("b", 5)], "ref_name string, ref_len int")
    depth = lambda **k: [r.depth for r in R.pileup(al, refs, **k).orderBy("pos").collect()]
    assert depth() == [1, 1, 1, 1, 0, 0, 0, 0, 1, 1]
    assert depth(strict_interval=True) == [1, 1, 1, 0, 0, 0, 0, 0, 1, 1]


def lines(spark, text, file="f"):
    return spark.createDataFrame([(file, i, x) for i, x in enumerate(text.split("\n"))], "file string, line_no long, line string")


def test_readers(spark, tmp_path):
    reads = IO.parse_fastq(lines(spark, "@a\nAC\n+\nII\n\n@b\nGT\n+\nII\n@c\nA")).orderBy("nth").collect()
    assert [(r.read_id, r.seq) for r in reads] == [("@a", "AC"), ("@b", "GT")]
    rows = IO.parse_fasta(lines(spark, ">a\nAC\nGT\n>b\nA\n\n>c\nC")).orderBy("nth").collect()
    assert [(r.read_id, r.seq) for r in rows] == [("@a", "ACGT"), ("@b", "A")]
    assert IO.parse_fasta(lines(spark, ">a\nA\n\n>c\nC"), stop_at_blank=False).count() == 2
    with pytest.raises(Exception, match="not a read id"):
        IO.validate_reads(spark.createDataFrame([("x",)], "read_id string")).collect()
    with pytest.raises(Exception, match="no total number"):
        IO.gfa_total_kmers(lines(spark, "H\tVN:Z:1")).collect()
    import gzip

    (tmp_path / "r.fq.gz").write_bytes(gzip.compress(b"@a\nAC\n+\nII\n"))
    assert IO.parse_fastq(IO.scan_lines(spark, str(tmp_path / "r.fq.gz"))).first().seq == "AC"
    assert IO.check_extension("a.fq.gz") == "fq"
    with pytest.raises(ValueError):
        IO.check_extension("a.txt")


def test_gfa_round_trip(spark, alleles, tmp_path):
    g = G.msa_to_graph(msa_rows(spark, alleles))
    weights = g.nodes.select("graph_id", "node_id", F.lit(3.7).alias("kmer_freq"))
    IO.write_gfa(g, weights, str(tmp_path / "gfa"), ["over 1 graphs: 99)"])
    text = IO.scan_lines(spark, f"{tmp_path}/gfa/graph_id=0/*.txt")
    back, kc = IO.parse_gfa(text)
    assert sorted(r.seq for r in G.graph_to_sequences(back.path_nodes, back.nodes).collect()) == sorted(s.replace("-", "") for s in alleles)
    assert {r.kmer_freq for r in kc.collect()} == {3.0} and IO.gfa_total_kmers(text).first().total == 99
    none = IO.gfa_lines(g, weights.withColumn("kmer_freq", F.lit(0.0)))
    assert none.count() == 0


def test_streamed_weights_are_the_batch_ones(spark, alleles, tmp_path):
    from braidseq.streaming.weights import read_weights, stream_weights

    index = P.build_index(msa_rows(spark, alleles), Params(k=11, slots=8, window=40, threshold=0.9))
    reads = [(f"r{i}", alleles[1][i : i + 40]) for i in range(0, 80, 7)]
    df = spark.createDataFrame(reads, "read_id string, seq string")
    df.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream_weights(stream, index, str(tmp_path / "out")).awaitTermination()
    want, _ = A.subpath_weights(P.map_reads(df, index), index.contents, index.graph.nodes)
    rows = lambda x: {r.node_id: round(r.kmer_freq, 6) for r in x.collect()}
    assert rows(read_weights(spark, str(tmp_path / "out"))) == rows(want)


def test_streamed_alignments_are_the_batch_ones(spark, alleles, tmp_path):
    from braidseq.streaming.weights import stream_alignments

    index = P.build_index(msa_rows(spark, alleles), Params(k=11, slots=8, window=40, threshold=0.9))
    df = spark.createDataFrame([(f"r{i}", alleles[1][i : i + 40], "I" * 40) for i in range(0, 80, 11)], "read_id string, seq string, qual string")
    df.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream_alignments(stream, index, str(tmp_path / "out")).awaitTermination()
    want = P.align_reads(df, index)["records"]
    rows = lambda x: sorted(tuple(r) for r in x.select(*want.columns).collect())
    assert rows(spark.read.parquet(str(tmp_path / "out/records"))) == rows(want) and want.count() > 0


def test_parameters():
    with pytest.raises(ValueError):
        Params(k=200, window=100)
    with pytest.raises(ValueError):
        Params(threshold=1.5)
