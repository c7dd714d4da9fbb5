"""Readers and writers of sequence formats. Readers keep file order by a line number within each file."""

from __future__ import annotations

import os
import shutil
import stat
from typing import BinaryIO

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sequence import base_check
from ..operators.graph import Graph
from .staging import staged

READ_EXTENSIONS = ("fastq", "fq", "fasta", "fna", "fa")
STRETCH = 1 << 16


def scan_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, line_no, line) of text files, plain or gzipped, numbered from 0 within each file.

    Files are split among tasks (gzipped ones cannot be). A pass that reads no more than where lines are counts those
    of each split; what is broadcast or joined from it is a row per split. An empty file has no lines.
    """
    place = F.monotonically_increasing_id()
    rows = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), place.alias("place"), F.col("value").alias("line"))
    splits = rows.groupBy("file", "split").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("split")) - F.col("n")
    splits = staged(splits.select("file", "split", "first", before.alias("before")), "line-splits")
    return rows.join(splits, ["file", "split"]).select("file", (F.col("place") - F.col("first") + F.col("before")).alias("line_no"), "line")


def running(lines: DataFrame, flag: Column, name: str = "run") -> DataFrame:
    """lines with the number of lines of their file up to them, they included, for which flag holds.

    Files are counted in stretches of STRETCH lines, so that no task has to hold a whole file.
    """
    rows = lines.withColumn("flag__", F.when(flag, 1).otherwise(0).cast("long")).withColumn("stretch__", F.floor(F.col("line_no") / STRETCH))
    per = rows.groupBy("file", "stretch__").agg(F.sum("flag__").alias("n__"))
    before = F.sum("n__").over(Window.partitionBy("file").orderBy("stretch__")) - F.col("n__")
    rows = rows.join(per.select("file", "stretch__", before.alias("before__")), ["file", "stretch__"])
    inside = F.sum("flag__").over(Window.partitionBy("file", "stretch__").orderBy("line_no"))
    return rows.withColumn(name, F.col("before__") + inside).drop("flag__", "stretch__", "n__", "before__")


def spool(stream: BinaryIO, path: str, piped: bool = True) -> str:
    """Copy a pipe's bytes into a file that executors can read, and return its path; an error where stdin is no pipe."""
    if piped and not stat.S_ISFIFO(os.fstat(stream.fileno()).st_mode):
        raise ValueError("no files were given and standard input is not a pipe")
    with open(path, "wb") as out:
        shutil.copyfileobj(stream, out, 1 << 20)
    return path


def chunk_lines(chunks: DataFrame, keep_last: bool = True) -> DataFrame:
    """(file, line_no, line) out of (file, nth, chunk): text that came in pieces cut anywhere. Lines are trimmed,
    blank ones dropped. keep_last: whether what follows the last line feed of a file is a line too."""
    cut = chunks.select("file", "nth", F.posexplode(F.split("chunk", "\n")).alias("i", "part"), (F.size(F.split("chunk", "\n")) - 1).alias("last"))
    cut = cut.withColumn("line_no", F.col("nth") * (1 << 24) + F.col("i")).withColumn("fed", F.col("i") < F.col("last"))
    rows = running(cut, F.col("fed"), "fed_upto").withColumn("k", F.col("fed_upto") - F.when(F.col("fed"), 1).otherwise(0))
    whole = rows.groupBy("file", "k").agg(F.array_sort(F.collect_list(F.struct("line_no", "part"))).alias("parts"), F.max("fed").alias("fed"))
    lines = whole.select("file", F.col("k").alias("line_no"), F.trim(F.array_join(F.transform("parts", lambda x: x["part"]), "")).alias("line"), "fed")
    return lines.where("line <> ''" if keep_last else "line <> '' and fed").drop("fed")


def parse_fastq(lines: DataFrame) -> DataFrame:
    """(file, nth, read_id, seq, misc, qual) from (file, line_no, line). Blank lines are skipped, then every four
    lines are a read; fewer at the end are dropped."""
    rows = running(lines.where("line <> ''"), F.lit(True), "k").withColumn("k", F.col("k") - 1)
    nth = F.floor(F.col("k") / 4).cast("long")
    part = lambda i: F.max(F.when(F.col("k") % 4 == i, F.col("line")))
    reads = rows.groupBy("file", nth.alias("nth")).agg(F.count("*").alias("n"), part(0).alias("read_id"), part(1).alias("seq"), part(2).alias("misc"), part(3).alias("qual"))
    return reads.where("n = 4").drop("n")


def parse_fasta(lines: DataFrame, stop_at_blank: bool = True) -> DataFrame:
    """(file, nth, read_id, seq): a `>` line begins a record (its id begins with `@`), other lines are strung
    together. The first blank line ends a file, unless stop_at_blank is off."""
    if stop_at_blank:
        ends = lines.where("line = ''").groupBy("file").agg(F.min("line_no").alias("end__"))
        rows = lines.join(ends, "file", "left").where("end__ is null or line_no < end__").drop("end__")
    else:
        rows = lines.where("line <> ''")
    head = F.col("line").startswith(">")
    rows = running(rows, head, "nth").where("nth > 0")
    parts = F.transform(F.array_sort(F.collect_list(F.when(~head, F.struct("line_no", "line")))), lambda x: x["line"])
    made = rows.groupBy("file", "nth").agg(F.max(F.when(head, F.concat(F.lit("@"), F.substring("line", 2, 1 << 30)))).alias("read_id"), F.array_join(parts, "").alias("seq"))
    return made.withColumn("nth", (F.col("nth") - 1).cast("long"))


def validate_reads(reads: DataFrame, strict: bool = True) -> DataFrame:
    """reads whose id begins with `@`; with strict an error for any other, else they are marked by ok."""
    ok = F.coalesce(F.col("read_id").startswith("@"), F.lit(False))
    if not strict:
        return reads.withColumn("ok", ok)
    return reads.withColumn("read_id", F.when(ok, F.col("read_id")).otherwise(F.raise_error(F.concat(F.lit("not a read id: "), F.coalesce("read_id", F.lit("null")))).cast("string")))


def parse_msa(lines: DataFrame) -> DataFrame:
    """(graph_id, row_id, name, seq): aligned FASTA, a graph per file, numbered in order of the files' names."""
    order = F.dense_rank().over(Window.orderBy("file")) - 1
    ids = lines.select("file").distinct().withColumn("graph_id", order.cast("int"))
    rows = parse_fasta(lines).join(ids, "file")
    return rows.select("graph_id", F.col("nth").cast("int").alias("row_id"), F.substring("read_id", 2, 1 << 30).alias("name"), "seq")


def parse_gfa(lines: DataFrame) -> tuple[Graph, DataFrame]:
    """The graph of each file, and (graph_id, node_id, kmer_freq) from its `KC:i:` fields (0 without one).

    Segment names must be numbers; a path's steps end with `+`, and one that does not is an error.
    """
    order = F.dense_rank().over(Window.orderBy("file")) - 1
    ids = lines.select("file").distinct().withColumn("graph_id", order.cast("int"))
    rows = lines.join(ids, "file").withColumn("f", F.split("line", "\t"))
    field = lambda i: F.get("f", F.lit(i))
    # numbers are read of the rows that have them alone, wherever a filter is moved to
    number = lambda kind, i: F.when(field(0) == kind, field(i)).cast("long")
    s = rows.where(field(0) == "S").select("graph_id", number("S", 1).alias("node_id"), F.upper(field(2)).alias("seq"), F.coalesce(F.regexp_extract("line", r"\tKC:i:(\d+)", 1).try_cast("double"), F.lit(0.0)).alias("kmer_freq"))
    s = s.withColumn("seq", F.regexp_replace("seq", "[^ACGTN]", "N"))
    edges = rows.where(field(0) == "L").select("graph_id", number("L", 1).alias("src"), number("L", 3).alias("dst"))
    p = rows.where(field(0) == "P").withColumn("path_id", (F.row_number().over(Window.partitionBy("graph_id").orderBy("line_no")) - 1).cast("int"))
    steps = p.select("graph_id", "path_id", F.posexplode(F.split(field(2), ",")).alias("ord", "step"))
    node = F.when(F.col("step").endswith("+"), F.rtrim("step", F.lit("+"))).otherwise(F.raise_error(F.concat(F.lit("not a forward step: "), "step")).cast("string"))
    graph = Graph(s.select("graph_id", "node_id", "seq", F.length("seq").cast("int").alias("seg_len")), edges, steps.select("graph_id", "path_id", "ord", node.cast("long").alias("node_id")), p.select("graph_id", "path_id", field(1).alias("name")))
    return graph, s.select("graph_id", "node_id", "kmer_freq")


def gfa_total_kmers(lines: DataFrame) -> DataFrame:
    """(file, total) of the comment that tells the number of k-mers over all graphs; an error without one."""
    found = F.regexp_extract("line", r"graphs: (\d+)\)", 1).try_cast("long")
    per = lines.groupBy("file").agg(F.max(F.when(F.col("line").startswith("#"), found)).alias("total"))
    return per.withColumn("total", F.coalesce("total", F.raise_error(F.lit("no total number of k-mers in a comment")).cast("long")))


def gfa_lines(graph: Graph, weights: DataFrame, comments: list[str] | None = None) -> DataFrame:
    """(graph_id, section, k1, k2, line) of each graph with a weighted node: header, comments, segments with
    whole-number weights, links, and paths with a `<length>M` overlap per step. Graphs of no weight have no lines."""
    nodes = graph.nodes.join(weights, ["graph_id", "node_id"], "left").withColumn("kmer_freq", F.coalesce("kmer_freq", F.lit(0.0)))
    some = nodes.groupBy("graph_id").agg(F.max("kmer_freq").alias("most")).where("most > 0").select("graph_id")
    zero = F.lit(0).cast("long")
    out = some.select("graph_id", F.lit(0).alias("section"), zero.alias("k1"), zero.alias("k2"), F.lit("H\tVN:Z:1").alias("line"))
    for i, text in enumerate(comments or ()):
        out = out.unionByName(some.select("graph_id", F.lit(1).alias("section"), F.lit(i).cast("long").alias("k1"), zero.alias("k2"), F.lit(f"#\t{text}").alias("line")))
    s = nodes.join(some, "graph_id").select("graph_id", F.lit(2).alias("section"), F.col("node_id").alias("k1"), zero.alias("k2"), F.format_string("S\t%d\t%s\tLN:i:%d\tKC:i:%d", "node_id", "seq", "seg_len", F.floor("kmer_freq").cast("long")).alias("line"))
    links = graph.edges.join(some, "graph_id").select("graph_id", F.lit(3).alias("section"), F.col("src").alias("k1"), F.col("dst").alias("k2"), F.format_string("L\t%d\t+\t%d\t+\t0M", "src", "dst").alias("line"))
    steps = graph.path_nodes.join(graph.nodes, ["graph_id", "node_id"]).groupBy("graph_id", "path_id").agg(F.array_sort(F.collect_list(F.struct("ord", "node_id", "seg_len"))).alias("x"))
    steps = steps.join(graph.paths, ["graph_id", "path_id"]).join(some, "graph_id")
    line = F.concat_ws("\t", F.lit("P"), "name", F.array_join(F.transform("x", lambda x: F.concat(x["node_id"].cast("string"), F.lit("+"))), ","), F.array_join(F.transform("x", lambda x: F.concat(x["seg_len"].cast("string"), F.lit("M"))), ","))
    p = steps.select("graph_id", F.lit(4).alias("section"), F.col("path_id").cast("long").alias("k1"), zero.alias("k2"), line.alias("line"))
    return out.unionByName(s).unionByName(links).unionByName(p)


def write_gfa(graph: Graph, weights: DataFrame, folder: str, comments: list[str] | None = None) -> None:
    """One text folder per graph, graph_id=<n>, its lines in order."""
    lines = gfa_lines(graph, weights, comments)
    # by range: a hash repartition of this union can be taken for redundant, which leaves a part for each section
    lines.repartitionByRange("graph_id").sortWithinPartitions("graph_id", "section", "k1", "k2").select("graph_id", "line").write.partitionBy("graph_id").text(folder)


def fasta_lines(called: DataFrame, sequences: DataFrame) -> DataFrame:
    """(graph_id, path_id, line): called alleles as FASTA, the id and the sequence in one value."""
    rows = called.join(sequences, ["graph_id", "path_id"])
    return rows.select("graph_id", "path_id", F.concat(F.lit(">"), "name", F.lit("\n"), "seq").alias("line"))


def sam_lines(records: DataFrame, references: DataFrame) -> DataFrame:
    """(section, k, line) of a SAM text: header, then records. Positions count from 1; a null quality is `*`."""
    head = references.select(F.lit(0).alias("section"), F.concat_ws("_", "graph_id", "path_id").alias("k"), F.format_string("@SQ\tSN:%s\tLN:%d", "ref_name", "ref_len").alias("line"))
    body = records.select(F.lit(1).alias("section"), F.col("read_id").cast("string").alias("k"), F.concat_ws("\t", "read_id", F.col("flags").cast("string"), "ref_name", (F.col("pos") + 1).cast("string"), F.col("mapq").cast("string"), "cigar", F.lit("*"), F.lit("0"), F.lit("0"), "seq", F.coalesce("qual", F.lit("*"))).alias("line"))
    return head.unionByName(body)


def write_report(report: DataFrame, folder: str) -> None:
    """Tab-separated, no header."""
    report.orderBy("arg").write.csv(folder, sep="\t", header=False)


def normalised(reads: DataFrame) -> DataFrame:
    """reads with upper-case bases and N for all that is none."""
    return reads.withColumn("seq", base_check(F.col("seq")))


def write_sam(records: DataFrame, references: DataFrame, folder: str) -> None:
    """A folder of text parts, in order: header first."""
    sam_lines(records, references).orderBy("section", "k").select("line").write.text(folder)


def check_files(paths: list[str], allowed: tuple[str, ...] | None = None) -> None:
    """An error for a path that is missing, a directory or empty, or of an extension that is not allowed. Paths with a
    scheme or a pattern are left to Spark."""
    for path in paths:
        if allowed:
            check_extension(path, allowed)
        if "://" in path or any(c in path for c in "*?[{"):
            continue
        if not os.path.exists(path):
            raise ValueError(f"no such file: {path}")
        if os.path.isdir(path):
            raise ValueError(f"a directory, not a file: {path}")
        if not os.path.getsize(path):
            raise ValueError(f"an empty file: {path}")


def check_extension(path: str, allowed: tuple[str, ...] = READ_EXTENSIONS) -> str:
    """The extension of a file, .gz aside; an error for one that is not allowed."""
    name = path.removesuffix(".gz")
    extension = name.rpartition(".")[2].lower()
    if extension not in allowed:
        raise ValueError(f"not one of {', '.join(allowed)}: {path}")
    return extension
