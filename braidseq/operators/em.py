"""Expectation-maximisation of path abundances, a graph at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged

CHANGE, SMALLEST, EPS = 1e-2, 1e-8, 2.0**-52
LARGE = 2_000_000


def em_input(path_nodes: DataFrame, nodes: DataFrame, weights: DataFrame) -> DataFrame:
    """(graph_id, node_id, path_id, count): each node's coverage, on each path it belongs to."""
    cover = nodes.join(weights, ["graph_id", "node_id"], "left").select("graph_id", "node_id", (F.coalesce("kmer_freq", F.lit(0.0)) / F.col("seg_len")).alias("count"))
    return path_nodes.select("graph_id", "node_id", "path_id").join(cover, ["graph_id", "node_id"])


def start(paths: DataFrame) -> DataFrame:
    """Equal shares over all listed paths of a graph, cut ones included."""
    return paths.select("graph_id", "path_id", (1.0 / F.count("*").over(Window.partitionBy("graph_id"))).alias("alpha"))


def em_step(ec: DataFrame, alpha: DataFrame) -> DataFrame:
    """One round as joins and sums: (graph_id, path_id, alpha)."""
    rows = ec.where("count > 0").join(alpha, ["graph_id", "path_id"])
    rows = rows.withColumn("all", F.sum("alpha").over(Window.partitionBy("graph_id", "node_id"))).where(F.col("all") >= EPS)
    new = rows.groupBy("graph_id", "path_id").agg(F.sum(F.col("alpha") * F.col("count") / F.col("all")).alias("new"))
    return alpha.join(new, ["graph_id", "path_id"], "left").select("graph_id", "path_id", F.coalesce("new", F.lit(0.0)).alias("alpha"))


def em_rounds(ec: DataFrame, paths: DataFrame, min_iterations: int, max_iterations: int) -> DataFrame:
    """What em_run() gives, with em_step() over all graphs at a time: for graphs too large for a task. Each round's
    shares are written, so that plans stay short; graphs leave as they converge."""
    ec, key = staged(ec.where("count > 0"), "em-classes"), ["graph_id", "path_id"]
    state = staged(start(paths.select(*key).distinct()).withColumn("last", F.lit(False)), "em-shares")
    done = []
    for i in range(max_iterations):
        new = em_step(ec, state.select(*key, "alpha")).withColumnRenamed("alpha", "new").join(state, key)
        moves = (F.col("new") > CHANGE) & (F.abs(F.col("new") - F.col("alpha")) / F.col("new") > CHANGE)
        rests = ~F.max(moves).over(Window.partitionBy("graph_id")) & F.lit(i > min_iterations)
        new = new.select(*key, "new", "last", (rests & ~F.col("last")).alias("rests"))
        small = F.when(F.col("rests") & (F.col("new") < SMALLEST), 0.0).otherwise(F.col("new"))
        new = staged(new.select(*key, small.alias("alpha"), F.col("rests"), F.col("last").alias("over")), "em-shares")
        done.append(new.where("over").select(*key, "alpha", F.lit(i).alias("iterations")))
        state = new.where("not over").select(*key, "alpha", F.col("rests").alias("last"))
        if state.isEmpty():
            break
    out = state.select(*key, "alpha", F.lit(max_iterations).alias("iterations"))
    for part in done:
        out = out if part.isEmpty() else out.unionByName(part)
    return out


def em_run(ec: DataFrame, paths: DataFrame, min_iterations: int = 50, max_iterations: int = 10000, large: int = LARGE) -> DataFrame:
    """(graph_id, path_id, alpha, iterations). Graphs of more than `large` rows go through em_rounds().

    A graph has converged when no path with a share above CHANGE moves by more than CHANGE of itself after
    min_iterations; shares below SMALLEST are then zeroed and one last round follows, whose number from 0
    is reported, or max_iterations where it never converged.
    """
    if max_iterations < min_iterations:
        raise ValueError("max_iterations is below min_iterations")
    kind = ec.schema["graph_id"].dataType.simpleString()

    def run(own: pd.DataFrame, listed: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(listed["path_id"].to_numpy())
        own = own[(own["count"] > 0) & own["path_id"].isin(ids)].sort_values(["node_id", "path_id"])
        path = np.searchsorted(ids, own["path_id"].to_numpy())
        node = np.unique(own["node_id"].to_numpy(), return_inverse=True)[1] if len(own) else np.zeros(0, int)
        count = own["count"].to_numpy()
        alpha = np.full(len(ids), 1.0 / max(1, len(ids)))
        last, rounds = False, max_iterations
        for i in range(max_iterations):
            total = np.bincount(node, alpha[path]) if len(node) else np.zeros(0)
            use = total[node] >= EPS
            new = np.bincount(path[use], alpha[path[use]] * count[use] / total[node[use]], len(ids))
            if last:
                alpha, rounds = new, i
                break
            with np.errstate(divide="ignore", invalid="ignore"):
                moved = (new > CHANGE) & (np.abs(new - alpha) / new > CHANGE)
            alpha = new
            if not moved.any() and i > min_iterations:
                last = True
                alpha = np.where(alpha < SMALLEST, 0.0, alpha)
        graph = listed["graph_id"].iloc[0] if len(listed) else own["graph_id"].iloc[0]
        return pd.DataFrame({"graph_id": graph, "path_id": ids, "alpha": alpha, "iterations": rounds})

    schema = f"graph_id {kind}, path_id int, alpha double, iterations int"
    ec, listed = ec.toDF(*ec.columns), paths.select("graph_id", "path_id").toDF("graph_id", "path_id")
    hot = staged(ec.groupBy("graph_id").count().where(F.col("count") > large).select("graph_id"), "em-large")
    small = lambda df: df.join(F.broadcast(hot), "graph_id", "left_anti") if some else df  # noqa: E731  one row per graph of over `large` rows
    some = not hot.isEmpty()
    found = small(ec).groupBy("graph_id").cogroup(small(listed).groupBy("graph_id")).applyInPandas(run, schema)
    if not some:
        return found
    return found.unionByName(em_rounds(ec.join(hot, "graph_id"), listed.join(hot, "graph_id"), min_iterations, max_iterations).selectExpr("graph_id", "CAST(path_id AS INT) path_id", "alpha", "iterations"))


def em_abundance(em: DataFrame, kmer_totals: DataFrame, total_kmers: float, cutoff: float) -> DataFrame:
    """(graph_id, path_id, abundance) of the paths whose share of all k-mers reaches the cutoff.

    kmer_totals: (graph_id, kmer_total), either k-mers projected or the sum of node weights.
    """
    share = F.col("alpha") / F.sum("alpha").over(Window.partitionBy("graph_id"))
    rows = em.join(kmer_totals, "graph_id").withColumn("abundance", share * F.col("kmer_total") / F.lit(float(total_kmers)))
    return rows.where(F.col("abundance") >= cutoff).select("graph_id", "path_id", "abundance")


def em_paths(abundance: DataFrame, paths: DataFrame) -> DataFrame:
    """Names by falling abundance; ties by path id."""
    nth = F.row_number().over(Window.partitionBy("graph_id").orderBy(F.desc("abundance"), "path_id"))
    return abundance.join(paths, ["graph_id", "path_id"]).select("graph_id", "path_id", "name", "abundance", nth.alias("nth"))


def haplotypes(em: DataFrame, called: DataFrame) -> DataFrame:
    """Graphs, mean iterations over them, and called alleles."""
    graphs = em.groupBy("graph_id").agg(F.max("iterations").alias("iterations")).agg(F.count("*").alias("n_graphs"), F.avg("iterations").alias("mean_iterations"))
    return graphs.join(F.broadcast(called.agg(F.count("*").alias("n_alleles"))))
