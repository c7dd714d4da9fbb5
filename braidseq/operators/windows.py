"""Sliding windows over graph paths, their sketches, and the index of distinct windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import counted, pieces
from ..functions.sketches import khf_sketch


def path_base_map(positions: DataFrame) -> DataFrame:
    """(graph_id, path_id, pos, node_id, offset) of every base of every path."""
    bases = positions.select("graph_id", "path_id", "node_id", F.col("pos").alias("at"), F.explode(counted(F.col("seg_len"))).alias("offset"))
    return bases.select("graph_id", "path_id", (F.col("at") + F.col("offset")).alias("pos"), "node_id", "offset")


def path_windows(sequences: DataFrame, window: int) -> DataFrame:
    """(graph_id, path_id, start, seq) of the length - window + 1 windows of each path; shorter paths have none."""
    cut = pieces(F.col("seq"), counted(F.length("seq") - window + 1), window)
    return sequences.select("graph_id", "path_id", F.inline(cut))


def window_nodes(windows: DataFrame, positions: DataFrame, window: int) -> DataFrame:
    """(graph_id, path_id, start, node_id, n_bases): how many bases of each node a window holds.

    Windows and nodes meet in stretches of `window` bases, so a long path is no cross product.
    """
    cell = lambda x: F.floor(x / window).cast("int")
    left = windows.select("graph_id", "path_id", "start", F.explode(F.sequence(cell(F.col("start")), cell(F.col("start") + window - 1))).alias("cell"))
    right = positions.select("graph_id", "path_id", "node_id", "pos", "seg_len", F.explode(F.sequence(cell(F.col("pos")), cell(F.col("pos") + F.col("seg_len") - 1))).alias("cell"))
    low = F.greatest("start", "pos", F.col("cell") * window)
    high = F.least(F.col("start") + window, F.col("pos") + F.col("seg_len"), (F.col("cell") + 1) * window)
    met = left.join(right, ["graph_id", "path_id", "cell"]).withColumn("n", high - low).where("n > 0")
    return met.groupBy("graph_id", "path_id", "start", "node_id").agg(F.sum("n").cast("long").alias("n_bases"))


def sketch_windows(windows: DataFrame, k: int, slots: int) -> DataFrame:
    if k < 1:
        raise ValueError("k must be positive")
    return windows.withColumn("sketch", khf_sketch(F.col("seq"), k, slots)).drop("seq")


def merge_runs(sketched: DataFrame, drop_last_run: bool = True) -> DataFrame:
    """(graph_id, path_id, run, start, last, merge_span, sketch): runs of neighbouring windows with one sketch.

    With drop_last_run the last run of a path is left out unless it is the only one.
    """
    walk = Window.partitionBy("graph_id", "path_id").orderBy("start")
    new = F.when(F.lag("sketch").over(walk) == F.col("sketch"), 0).otherwise(1)
    runs = sketched.withColumn("new", new).withColumn("run", F.sum("new").over(walk).cast("int"))
    runs = runs.groupBy("graph_id", "path_id", "run").agg(F.min("start").alias("start"), F.max("start").alias("last"), (F.count("*") - 1).cast("int").alias("merge_span"), F.first("sketch").alias("sketch"))
    if drop_last_run:
        runs = runs.withColumn("n", F.max("run").over(Window.partitionBy("graph_id", "path_id"))).where("run < n or n = 1").drop("n")
    return runs


def merge_paths(runs: DataFrame, base_map: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(windows, contents): runs that begin at the same node and offset with one sketch become one window.

    windows: graph_id, node_id, offset, sketch, refs (sorted path ids), merge_span (the largest);
    contents: graph_id, node_id, offset, sketch, inner_id, n_bases, summed over all windows of the runs.
    held: what window_nodes() returns.
    """
    begun = runs.join(base_map.withColumnRenamed("pos", "start"), ["graph_id", "path_id", "start"])
    key = ["graph_id", "node_id", "offset", "sketch"]
    windows = begun.groupBy(*key).agg(F.array_sort(F.collect_set("path_id")).alias("refs"), F.max("merge_span").alias("merge_span"))
    spans = begun.select(*key, "path_id", F.explode(F.sequence("start", "last")).alias("start"))
    inner = held.select("graph_id", "path_id", "start", F.col("node_id").alias("inner_id"), "n_bases")
    contents = spans.join(inner, ["graph_id", "path_id", "start"]).groupBy(*key, "inner_id").agg(F.sum("n_bases").alias("n_bases"))
    return windows, contents


def window_keys(windows: DataFrame) -> DataFrame:
    """windows with win_key: graph, node and offset, and an ordinal by lowest path among those that share them."""
    nth = F.row_number().over(Window.partitionBy("graph_id", "node_id", "offset").orderBy(F.element_at("refs", 1), "sketch")) - 1
    return windows.withColumn("win_key", F.format_string("g%dn%do%d-%d", "graph_id", "node_id", "offset", nth.cast("int")))


def check_keys(windows: DataFrame) -> None:
    """An error for an empty index or a repeated key."""
    n, kinds = windows.agg(F.count("*"), F.countDistinct("win_key")).first()
    if not n or n != kinds:
        raise ValueError("the index is empty" if not n else "window keys repeat")


def check_index_span(windows: DataFrame, most: int) -> None:
    """An error where a window of the index stands for a run of more than `most` others."""
    longest = windows.agg(F.max("merge_span")).first()[0] or 0
    if longest > most:
        raise ValueError(f"a run of {longest} windows has one sketch; {most} are allowed")


def sketch_stats(sketched: DataFrame) -> DataFrame:
    """Per graph: windows, distinct sketches, and the longest run of one sketch less one."""
    runs = merge_runs(sketched, False).groupBy("graph_id").agg(F.max("merge_span").alias("max_span"))
    return sketched.groupBy("graph_id").agg(F.count("*").alias("n_windows"), F.countDistinct("sketch").alias("n_distinct")).join(runs, "graph_id")


def check_span(stats: DataFrame, most: int) -> DataFrame:
    """stats, with an error where a run is longer than `most`."""
    too_long = F.raise_error(F.format_string("graph %d has a run of more than %d windows", "graph_id", F.lit(most))).cast("int")
    return stats.withColumn("max_span", F.when(F.col("max_span") <= most, F.col("max_span")).otherwise(too_long))
