"""The index on disk: a folder of Parquet tables and a table of its parameters."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators.graph import Graph

VERSION = "1"
TABLES = ("nodes", "edges", "path_nodes", "paths")


@dataclass(frozen=True)
class Params:
    """k-mer size, sketch slots, window, longest allowed run of one sketch, containment threshold, k-mer coverage and breadth."""

    k: int = 31
    slots: int = 21
    window: int = 100
    max_span: int = 30
    threshold: float = 0.99
    min_coverage: float = 1.0
    breadth: float = 0.97

    def __post_init__(self):
        if self.k > self.window:
            raise ValueError("k is larger than the window")
        if not 0 < self.threshold <= 1 or not 0 <= self.breadth <= 1:
            raise ValueError("thresholds must be between 0 and 1")


@dataclass(frozen=True)
class Index:
    params: Params
    graph: Graph
    windows: DataFrame
    contents: DataFrame


def save_index(index: Index, folder: str) -> None:
    """Refuses an existing folder."""
    for name in TABLES:
        getattr(index.graph, name).write.parquet(f"{folder}/{name}")
    index.windows.write.parquet(f"{folder}/windows")
    index.contents.write.parquet(f"{folder}/contents")
    spark = index.windows.sparkSession
    spark.createDataFrame([{**asdict(index.params), "version": VERSION}]).coalesce(1).write.parquet(f"{folder}/meta")


def load_index(spark: SparkSession, folder: str) -> Index:
    """Refuses an index of another version or an empty one."""
    meta = spark.read.parquet(f"{folder}/meta").first().asDict()
    if meta.pop("version") != VERSION:
        raise ValueError("the index was written by another version")
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    windows = read("windows")
    if windows.isEmpty():
        raise ValueError("the index is empty")
    return Index(Params(**meta), Graph(*map(read, TABLES)), windows, read("contents"))
