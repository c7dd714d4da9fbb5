"""The three pipelines: index, align, report; and haplotypes from weighted graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sketches import khf_sketch
from ..operators import align as A
from ..operators import em as E
from ..operators import graph as G
from ..operators import report as R
from ..operators import windows as W
from ..operators.containment import containment_join
from ..sources.index_store import Index, Params


def build_index(msa: DataFrame, params: Params, drop_last_run: bool = True, drop_consensus: bool = True) -> Index:
    """Aligned rows to graphs, windows and their contents."""
    graph = G.msa_to_graph(msa, drop_consensus)
    return index_graph(graph, params, drop_last_run)


def index_graph(graph: G.Graph, params: Params, drop_last_run: bool = True) -> Index:
    """Windows of every graph whose paths are all as long as a window."""
    positions = G.path_positions(graph.path_nodes, graph.nodes)
    masked = G.mask_graphs(G.path_lengths(graph.path_nodes, graph.nodes), params.window).where("masked")
    sequences = G.graph_to_sequences(graph.path_nodes, graph.nodes).join(masked, "graph_id", "left_anti")
    windows = W.path_windows(sequences, params.window)
    runs = W.merge_runs(W.sketch_windows(windows, params.k, params.slots), drop_last_run)
    merged, contents = W.merge_paths(runs, W.path_base_map(positions), W.window_nodes(windows, positions, params.window))
    keyed = W.window_keys(merged)
    contents = contents.join(keyed.select("graph_id", "node_id", "offset", "sketch", "win_key"), ["graph_id", "node_id", "offset", "sketch"])
    return Index(params, graph, keyed.withColumn("window_size", F.lit(params.window)), contents.select("win_key", "graph_id", "inner_id", "n_bases"))


def map_reads(reads: DataFrame, index: Index, lengths: list[int] | None = None) -> DataFrame:
    """(read_id, graph_id, win_key, node_id, offset, merge_span, window_size, n_kmers) of every hit. reads: read_id, seq.

    lengths: the lengths of the reads, where they are known.
    """
    p = index.params
    asked = reads.select(F.col("read_id").alias("read_key"), khf_sketch(F.col("seq"), p.k, p.slots).alias("sketch"), (F.length("seq") - p.k + 1).alias("q"))
    known = None if lengths is None else [n - p.k + 1 for n in lengths]
    hits = containment_join(asked, index.windows.select("win_key", "sketch"), p.slots, p.window - p.k + 1, p.threshold, known)
    hits = hits.join(index.windows.select("win_key", "graph_id", "node_id", "offset", "merge_span", "window_size"), "win_key")
    return hits.select(F.col("read_key").alias("read_id"), "graph_id", "win_key", "node_id", "offset", "merge_span", "window_size", F.col("q").cast("double").alias("n_kmers"))


def align_reads(reads: DataFrame, index: Index, no_align: bool = False) -> dict[str, DataFrame]:
    """mappings, records (none with no_align), weights, totals, and the pruned graph's tables and path list.

    reads: read_id, seq, qual (null for reads without quality).
    """
    return align_mapped(reads, map_reads(reads, index), index, no_align)


def align_mapped(reads: DataFrame, mappings: DataFrame, index: Index, no_align: bool = False) -> dict[str, DataFrame]:
    """align_reads() from mappings at hand."""
    p, graph = index.params, index.graph
    records, aligned = None, None
    if not no_align:
        positions = G.path_positions(graph.path_nodes, graph.nodes)
        aligned = A.align(reads, mappings, index.contents, graph, positions)
        references = G.sam_references(graph.paths, G.path_lengths(graph.path_nodes, graph.nodes))
        tried = A.tried_mappings(mappings, aligned)
        records = A.sam_records(A.reported(aligned, tried), reads, references)
    else:
        tried = mappings
    weights, totals = A.subpath_weights(tried, index.contents, graph.nodes)
    kept, listed = G.prune(graph, weights, p.min_coverage)
    return {"mappings": mappings, "records": records, "weights": weights, "totals": totals, "graph": kept, "paths": listed}


def report_records(records: DataFrame, references: DataFrame, cutoff: float, low_coverage: bool = False) -> DataFrame:
    """SAM rows to a report. The span of a record is that of its M operations."""
    spans = F.aggregate(F.transform(F.regexp_extract_all("cigar", F.lit(r"(\d+)M"), F.lit(1)), lambda x: x.cast("int")), F.lit(0), lambda a, b: a + b)
    return R.report(records.select("ref_name", "pos", spans.alias("span"), "flags"), references, cutoff, low_coverage)


def haplotypes(graph: G.Graph, listed: DataFrame, weights: DataFrame, kmer_totals: DataFrame, total_kmers: float, cutoff: float, min_iterations: int = 50, max_iterations: int = 10000) -> tuple[DataFrame, DataFrame]:
    """(em, called paths with names and abundances)."""
    em = E.em_run(E.em_input(graph.path_nodes, graph.nodes, weights), listed, min_iterations, max_iterations)
    return em, E.em_paths(E.em_abundance(em, kmer_totals, total_kmers, cutoff), graph.paths)
