"""Reads as a stream: each micro-batch is sketched, joined with the static index and added to node weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.align import subpath_weights
from ..plans.pipelines import align_mapped, map_reads
from ..sources.index_store import Index
from ..sources.staging import staged


def stream_weights(reads: DataFrame, index: Index, folder: str):
    """Start a query over a stream of (read_id, seq) that adds each batch's node weights to folder, in a
    part named by the batch, so that a repeated batch replaces its own part; every available input is
    taken, then the query ends. Sums are order-free, so no other state is kept."""

    def add(batch: DataFrame, number: int) -> None:
        weights, totals = subpath_weights(map_reads(batch, index), index.contents, index.graph.nodes)
        weights.write.mode("overwrite").parquet(f"{folder}/weights/batch={number}")
        totals.write.mode("overwrite").parquet(f"{folder}/totals/batch={number}")

    return reads.writeStream.foreachBatch(add).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def stream_alignments(reads: DataFrame, index: Index, folder: str):
    """Start a query over a stream of (read_id, seq, qual) that aligns each batch and writes its records, and its node
    weights and totals beside them, each in a part named by the batch. Reads are aligned by themselves, so
    records of all batches are those of one run, and weights add up."""

    def add(batch: DataFrame, number: int) -> None:
        own = staged(batch, "stream-reads")
        done = align_mapped(own, staged(map_reads(own, index), "stream-mappings"), index)
        for name in ("records", "weights", "totals"):
            done[name].write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")

    return reads.writeStream.foreachBatch(add).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def read_weights(spark, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/weights").groupBy("graph_id", "node_id").agg(F.sum("kmer_freq").alias("kmer_freq"))
