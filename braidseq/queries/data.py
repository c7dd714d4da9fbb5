"""Sequences, alignments and weights derived from the driver's tables.

benchmark items become graphs of four alleles with substitutions and gaps, documents become reads cut at a
fixed stride, line items become alignments and equivalence classes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import counted, once, pieces, revcomp, text_to_bases
from ..operators import graph as G
from ..sources.index_store import TABLES, Index, Params
from ..sources.staging import shared_folder, staged

#: Reads of documents against windows of benchmark items.
TEXT_K, TEXT_SLOTS, TEXT_WINDOW, TEXT_STRIDE, TEXT_T = 15, 21, 50, 25, 0.99
#: Simulated reads against graphs.
GRAPH = Params(k=11, slots=8, window=40, threshold=0.9, min_coverage=1.0)
READ_STRIDE = 17
QUALITIES = "#(-26;=>@ABCDFGI"
LOW = 0.15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", text_to_bases(F.col("text")).alias("seq"))


def document_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text_to_bases(F.col("text")).alias("seq"))


def document_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, start, seq): windows of TEXT_WINDOW bases every TEXT_STRIDE, and the last one of each text."""
    docs = document_sequences(spark, sf_dir)
    starts = F.transform(counted(F.floor((F.length("seq") - TEXT_WINDOW) / TEXT_STRIDE) + 1), lambda i: i * TEXT_STRIDE)
    end = F.when(F.length("seq") >= TEXT_WINDOW, F.array(F.length("seq") - TEXT_WINDOW)).otherwise(F.array().cast("array<int>"))
    starts = F.array_union(starts, end)
    return docs.select("doc_id", F.inline(pieces(F.col("seq"), starts, TEXT_WINDOW)))


def item_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, start, seq): every window of TEXT_WINDOW bases."""
    return items(spark, sf_dir).select("item_id", F.inline(pieces(F.col("seq"), counted(F.length("seq") - TEXT_WINDOW + 1), TEXT_WINDOW)))


def _allele(seq: Column, a: Column) -> Column:
    def base(p: Column, s: Column) -> Column:
        b = F.substring(s, p, F.lit(1))
        return F.when((a > 0) & (p * a % 37 == 5), "-").when((a > 0) & ((p + 7 * a) % 29 == 0), F.translate(b, "ACGT", "CGTA")).otherwise(b)

    return once(seq, lambda s: F.array_join(F.transform(F.sequence(F.lit(1), F.length(s)), lambda p: base(p, s)), ""))


def msa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(graph_id, row_id, name, seq): four alleles and a consensus row per benchmark item."""
    rows = items(spark, sf_dir).where("length(seq) > 0").select(F.col("item_id").cast("int").alias("graph_id"), "seq", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("row_id"))
    name = F.when(F.col("row_id") == 4, "consensus").otherwise(F.format_string("item%d-a%d", "graph_id", "row_id"))
    seq = F.when(F.col("row_id") == 4, F.col("seq")).otherwise(_allele(F.col("seq"), F.col("row_id")))
    return rows.select("graph_id", "row_id", name.alias("name"), seq.alias("seq"))


def graph(spark: SparkSession, sf_dir: str) -> G.Graph:
    return G.msa_to_graph(msa(spark, sf_dir))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(graph_id, path_id, name, seq) without gaps."""
    return msa(spark, sf_dir).where("row_id < 4").select("graph_id", F.col("row_id").alias("path_id"), "name", F.replace("seq", F.lit("-"), F.lit("")).alias("seq"))


def simulated_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, seq, qual) off every allele: exact, one end changed, reversed, or changed in the middle."""
    w = GRAPH.window
    starts = F.transform(counted(F.floor((F.length("seq") - w) / READ_STRIDE) + 1), lambda i: i * READ_STRIDE)
    at = sequences(spark, sf_dir).select("graph_id", "path_id", "name", F.inline(pieces(F.col("seq"), starts, w))).withColumnRenamed("seq", "r")
    at = at.withColumn("m", (F.floor(F.col("start") / READ_STRIDE) + F.col("path_id")) % 6)
    swap = lambda p: F.concat(F.substring("r", 1, p - 1), F.translate(F.substring("r", p, 1), "ACGT", "CGTA"), F.substring("r", p + 1, w))
    seq = F.when(F.col("m") == 1, swap(1)).when(F.col("m") == 2, swap(w)).when(F.col("m") == 3, revcomp(F.col("r"))).when(F.col("m") == 4, swap(w // 2)).otherwise(F.col("r"))
    return at.select(F.format_string("r_%d_%d_x_x_x_x_x_x_%s$", "graph_id", "start", "name").alias("read_id"), seq.alias("seq"), F.concat(F.lit("5"), F.repeat(F.lit("I"), w - 1)).alias("qual"))


def text_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a text file of all documents of each language, in order of doc_id."""
    folder = f"{shared_folder(spark)}/text-files-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select("lang", "doc_id", "text")
    docs.repartition("lang").sortWithinPartitions("lang", "doc_id").select("lang", F.coalesce("text", F.lit("")).alias("text")).write.partitionBy("lang").text(folder)
    return folder


def qualities(read_id: Column, size: Column) -> Column:
    """A quality string off the md5 of a read's name."""
    digits = F.concat(F.md5(read_id), F.md5(F.concat(read_id, F.lit("x"))))
    return F.substring(F.translate(digits, "0123456789abcdef", QUALITIES), F.lit(1), size)


_built: dict[tuple[str, str], Index] = {}


def index(spark: SparkSession, sf_dir: str) -> Index:
    """Built once per application and folder, and kept as tables, as an index is."""
    from ..plans.pipelines import index_graph

    key = spark.sparkContext.applicationId, sf_dir
    if key not in _built:
        g = G.Graph(*(staged(getattr(graph(spark, sf_dir), name), f"index-{name}") for name in TABLES))
        made = index_graph(g, GRAPH)
        _built[key] = Index(GRAPH, g, staged(made.windows, "index-windows"), staged(made.contents, "index-contents"))
    return _built[key]


def line_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref_name, pos, span, flags) from line items."""
    li = table(spark, sf_dir, "lineitem")
    length = 200 + F.col("l_partkey") % 300
    flags = F.when(F.col("l_linenumber") == 7, 4).when(F.col("l_linenumber") == 6, 256).otherwise(0)
    return li.select(F.concat(F.when(F.col("l_partkey") % 5 == 0, "*").otherwise(""), F.lit("part"), F.col("l_partkey").cast("string")).alias("ref_name"), (F.col("l_orderkey") * 7 % length).cast("int").alias("pos"), (30 + F.col("l_linenumber") * 10).cast("int").alias("span"), flags.alias("flags"))


def line_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    return part.select(F.concat(F.when(F.col("k") % 5 == 0, "*").otherwise(""), F.lit("part"), F.col("k").cast("string")).alias("ref_name"), (200 + F.col("k") % 300).cast("int").alias("ref_len"))


def line_classes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(ec, paths): orders are nodes of 50 graphs, suppliers modulo 7 their paths."""
    li = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).cast("int").alias("graph_id"), F.col("l_orderkey").alias("node_id"), (F.col("l_suppkey") % 7).cast("int").alias("path_id"), "l_quantity")
    counts = li.groupBy("graph_id", "node_id").agg((F.sum("l_quantity") / 10).alias("count"))
    ec = li.select("graph_id", "node_id", "path_id").distinct().join(counts, ["graph_id", "node_id"])
    return ec, li.select("graph_id", "path_id").distinct()


def made_weights(g: G.Graph) -> DataFrame:
    """A weight for each node by a fixed rule; about one node in a hundred is below LOW per base."""
    return g.nodes.select("graph_id", "node_id", (((F.col("node_id") * 37 + F.col("graph_id") * 11) % 211) * F.col("seg_len") / 10.0).alias("kmer_freq"))
