"""Variation graphs as tables: built from alignments of related sequences, ordered, linearised, pruned.

nodes(graph_id, node_id, seq, seg_len), edges(graph_id, src, dst), path_nodes(graph_id, path_id, ord,
node_id), paths(graph_id, path_id, name). Positions count from 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import base_check, counted, pieces


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    path_nodes: DataFrame
    paths: DataFrame


def msa_to_graph(msa: DataFrame, drop_consensus: bool = True) -> Graph:
    """A graph per graph_id from rows (graph_id, row_id, name, seq) of equal length with `-` for gaps.

    A vertex is a column and a base; rows walk over their non-gap columns. Neighbours with one way out, one
    way in and the same rows become one node. Node ids ascend by first column, then by the lowest row.
    """
    if drop_consensus:
        msa = msa.where(F.col("name") != "consensus")
    cells = msa.select("graph_id", "row_id", F.inline(pieces(F.col("seq"), counted(F.length("seq")), 1)))
    cells = cells.select("graph_id", "row_id", (F.col("start") + 1).alias("col"), F.col("seq").alias("base")).where("base <> '-'")
    vertex, walk = ["graph_id", "col", "base"], Window.partitionBy("graph_id", "row_id").orderBy("col")
    ahead = cells.withColumn("to", F.lead(F.struct("col", "base")).over(walk)).withColumn("back", F.lag(F.struct("col", "base")).over(walk))
    facts = ahead.groupBy(*vertex).agg(F.array_sort(F.collect_set("row_id")).alias("rows"), F.size(F.collect_set("to")).alias("n_out"), F.size(F.collect_set("back")).alias("n_in"))
    placed = cells.join(facts, vertex)
    joins = (F.lag("n_out").over(walk) == 1) & (F.col("n_in") == 1) & (F.lag("rows").over(walk) == F.col("rows"))
    placed = placed.withColumn("first", F.when(F.coalesce(joins, F.lit(False)), None).otherwise(F.struct("col", "base")))
    placed = placed.withColumn("first", F.last("first", True).over(walk))
    per_row = placed.groupBy("graph_id", "row_id", "first").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "base"))), lambda x: x["base"]), "").alias("seq"))
    nodes = per_row.groupBy("graph_id", "first").agg(F.min("row_id").alias("low"), F.min("seq").alias("seq"))
    nodes = nodes.withColumn("node_id", F.row_number().over(Window.partitionBy("graph_id").orderBy("first.col", "low")).cast("long"))
    steps = per_row.select("graph_id", "row_id", "first").join(nodes.select("graph_id", "first", "node_id"), ["graph_id", "first"])
    path_nodes = steps.select("graph_id", F.col("row_id").alias("path_id"), "node_id", (F.row_number().over(Window.partitionBy("graph_id", "row_id").orderBy("first.col")) - 1).cast("int").alias("ord"))
    return Graph(
        nodes.select("graph_id", "node_id", base_check(F.col("seq")).alias("seq"), F.length("seq").cast("int").alias("seg_len")),
        edges_of_paths(path_nodes),
        path_nodes.select("graph_id", "path_id", "ord", "node_id"),
        msa.select("graph_id", F.col("row_id").alias("path_id"), F.regexp_replace("name", r"^\*", "").alias("name")),
    )


def edges_of_paths(path_nodes: DataFrame) -> DataFrame:
    step = F.lead("node_id").over(Window.partitionBy("graph_id", "path_id").orderBy("ord"))
    return path_nodes.select("graph_id", F.col("node_id").alias("src"), step.alias("dst")).where("dst is not null").distinct()


def topo_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, node_id, topo_ord) from 0. Ids that ascend along every edge are the order already; a graph
    with another edge is ordered by itself in pandas, lowest id first. A cycle is an error."""
    odd = edges.where("src >= dst").select("graph_id").distinct()
    by_id = F.row_number().over(Window.partitionBy("graph_id").orderBy("node_id")) - 1
    easy = nodes.join(odd, "graph_id", "left_anti").select("graph_id", "node_id", by_id.cast("int").alias("topo_ord"))
    kind = nodes.schema["graph_id"].dataType.simpleString()

    def order(own: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        import heapq

        waits = dict.fromkeys(own["node_id"].tolist(), 0)
        ahead: dict[int, list[int]] = {n: [] for n in waits}
        for s, d in zip(links["src"], links["dst"]):
            ahead[s].append(d)
            waits[d] += 1
        ready, out = [n for n, w in waits.items() if not w], []
        heapq.heapify(ready)
        while ready:
            out.append(n := heapq.heappop(ready))
            for d in ahead[n]:
                waits[d] -= 1
                if not waits[d]:
                    heapq.heappush(ready, d)
        if len(out) < len(waits):
            raise ValueError("a graph has a cycle")
        graph = own["graph_id"].iloc[0] if len(own) else None
        return pd.DataFrame({"graph_id": [graph] * len(out), "node_id": out, "topo_ord": range(len(out))})

    rest = nodes.join(odd, "graph_id", "left_semi").select("graph_id", "node_id").toDF("graph_id", "node_id").groupBy("graph_id")
    links = edges.join(odd, "graph_id", "left_semi").toDF(*edges.columns)
    hard = rest.cogroup(links.groupBy("graph_id")).applyInPandas(order, f"graph_id {kind}, node_id long, topo_ord int")
    return easy.unionByName(hard)


def path_positions(path_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """path_nodes with seg_len and pos, where each node begins on the path."""
    before = Window.partitionBy("graph_id", "path_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    joined = path_nodes.join(nodes.select("graph_id", "node_id", "seg_len"), ["graph_id", "node_id"])
    return joined.withColumn("pos", F.coalesce(F.sum("seg_len").over(before), F.lit(0)).cast("int"))


def graph_to_sequences(path_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph_id, path_id, seq): the nodes of each path strung together."""
    joined = path_nodes.join(nodes.select("graph_id", "node_id", "seq"), ["graph_id", "node_id"])
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ord", "seq"))), lambda x: x["seq"])
    return joined.groupBy("graph_id", "path_id").agg(F.array_join(parts, "").alias("seq"))


def path_lengths(path_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    joined = path_nodes.join(nodes.select("graph_id", "node_id", "seg_len"), ["graph_id", "node_id"])
    return joined.groupBy("graph_id", "path_id").agg(F.sum("seg_len").cast("int").alias("length"))


def mask_graphs(lengths: DataFrame, window: int) -> DataFrame:
    """(graph_id, masked): a graph with a path shorter than a window is left out of sketching."""
    return lengths.groupBy("graph_id").agg((F.min("length") < window).alias("masked"))


def sam_references(paths: DataFrame, lengths: DataFrame) -> DataFrame:
    return paths.join(lengths, ["graph_id", "path_id"]).select("graph_id", "path_id", F.col("name").alias("ref_name"), F.col("length").alias("ref_len"))


def remove_dead_paths(paths: DataFrame, path_nodes: DataFrame) -> DataFrame:
    """The paths that still have nodes."""
    return paths.join(path_nodes.select("graph_id", "path_id").distinct(), ["graph_id", "path_id"], "left_semi")


def prune(graph: Graph, weights: DataFrame, min_coverage: float) -> tuple[Graph, DataFrame]:
    """The graph without the nodes of a k-mer coverage below min_coverage and all the paths they are on, and
    (graph_id, path_id, live) of every path of the graphs that are kept.

    weights: (graph_id, node_id, kmer_freq); a node without a row has none. A node on no path is never cut.
    A graph that loses every path is dropped. Paths that go stay listed with live = false.
    """
    on = graph.path_nodes.select("graph_id", "node_id").distinct()
    low = graph.nodes.join(weights, ["graph_id", "node_id"], "left").where(F.coalesce("kmer_freq", F.lit(0.0)) / F.col("seg_len") < min_coverage)
    low = low.join(on, ["graph_id", "node_id"], "left_semi").select("graph_id", "node_id")
    bad = graph.path_nodes.join(low, ["graph_id", "node_id"], "left_semi").select("graph_id", "path_id").distinct()
    every = graph.path_nodes.select("graph_id", "path_id").distinct()
    judged = every.join(bad.withColumn("bad", F.lit(True)), ["graph_id", "path_id"], "left").withColumn("live", F.col("bad").isNull()).drop("bad")
    kept = judged.groupBy("graph_id").agg(F.max("live").alias("any")).where("any").select("graph_id")
    stay = lambda df: df.join(kept, "graph_id", "left_semi")
    nodes = stay(graph.nodes).join(low, ["graph_id", "node_id"], "left_anti")
    edges = stay(graph.edges).join(low.select("graph_id", F.col("node_id").alias("dst")), ["graph_id", "dst"], "left_anti").join(low.select("graph_id", F.col("node_id").alias("src")), ["graph_id", "src"], "left_anti")
    path_nodes = stay(graph.path_nodes).join(bad, ["graph_id", "path_id"], "left_anti")
    return Graph(nodes, edges.select("graph_id", "src", "dst"), path_nodes, stay(graph.paths)), stay(judged)
