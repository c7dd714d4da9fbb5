"""Command line: index, align, report, haplotype, version."""

from __future__ import annotations

import argparse
import logging
import resource
import sys
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .operators import align as A
from .operators import graph as G
from .operators import windows as W
from .plans import pipelines as P
from .sources import bam
from .sources import formats as IO
from .sources.index_store import Params, load_index, save_index
from .sources.staging import shared_folder

log = logging.getLogger("braidseq")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="braidseq")
    top.add_argument("--log", help="a file for messages; standard error without it")
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("version", help="the version of this program")
    a = sub.add_parser("index", help="aligned FASTA files to an index")
    a.add_argument("--msa", nargs="+", required=True)
    a.add_argument("--out", required=True)
    for name, kind, value in (("--kmer", int, 31), ("--slots", int, 21), ("--window", int, 100), ("--max-span", int, 30)):
        a.add_argument(name, type=kind, default=value)
    a = sub.add_parser("align", help="reads against an index")
    a.add_argument("--index", required=True)
    a.add_argument("--reads", nargs="+", help="standard input, which must be a pipe, without it")
    a.add_argument("--out", required=True)
    a.add_argument("--fasta", action="store_true")
    a.add_argument("--normalize-reads", action="store_true", help="upper case, and N for what is no base")
    a.add_argument("--bam", help="also write one BAM file; - for standard output")
    a.add_argument("--sam", help="also write SAM text into a folder")
    a.add_argument("--no-align", action="store_true")
    a.add_argument("--threshold", type=float, default=0.99)
    a.add_argument("--min-coverage", type=float, default=1.0)
    a = sub.add_parser("report", help="records of align to a table of covered references")
    a.add_argument("--index", help="not needed with --bam")
    a.add_argument("--aligned", help="the folder that align wrote")
    a.add_argument("--bam", nargs="+", help="BAM files instead; - for standard input")
    a.add_argument("--out", required=True)
    a.add_argument("--cutoff", type=float, default=0.97)
    a.add_argument("--low-coverage", action="store_true")
    a = sub.add_parser("haplotype", help="weighted graphs to called alleles")
    a.add_argument("--gfa", nargs="+", required=True)
    a.add_argument("--out", required=True)
    a.add_argument("--cutoff", type=float, default=0.001)
    a.add_argument("--min-iterations", type=int, default=50)
    a.add_argument("--max-iterations", type=int, default=10000)
    return top


def read_lines(spark: SparkSession, paths: list[str] | None) -> DataFrame:
    """The lines of checked files, or of standard input, which is copied into the shared folder first."""
    if paths:
        IO.check_files(paths, IO.READ_EXTENSIONS)
        return IO.scan_lines(spark, paths)
    return IO.scan_lines(spark, IO.spool(sys.stdin.buffer, f"{shared_folder(spark).removeprefix('file://')}/stdin-{uuid.uuid4().hex}.txt"))


def index(spark: SparkSession, args: argparse.Namespace) -> None:
    IO.check_files(args.msa)
    params = Params(k=args.kmer, slots=args.slots, window=args.window, max_span=args.max_span)
    save_index(P.build_index(IO.parse_msa(IO.scan_lines(spark, args.msa)), params), args.out)
    made = load_index(spark, args.out)
    W.check_keys(made.windows)
    W.check_index_span(made.windows, params.max_span)
    log.info("%d windows in %d graphs", made.windows.count(), made.graph.nodes.select("graph_id").distinct().count())


def align(spark: SparkSession, args: argparse.Namespace) -> None:
    made = load_index(spark, args.index)
    params = Params(**{**made.params.__dict__, "threshold": args.threshold, "min_coverage": args.min_coverage})
    made = type(made)(params, made.graph, made.windows, made.contents)
    lines = read_lines(spark, args.reads)
    reads = IO.parse_fasta(lines).withColumn("qual", F.lit(None).cast("string")) if args.fasta else IO.parse_fastq(lines)
    reads = IO.validate_reads(reads).withColumn("read_id", F.substring("read_id", 2, 1 << 30)).select("read_id", "seq", "qual")
    reads = IO.normalised(reads) if args.normalize_reads else reads
    reads.write.parquet(f"{args.out}/reads")
    reads = spark.read.parquet(f"{args.out}/reads")
    n, mean = A.checked_read_stats(reads)
    log.info("%d reads of %.1f bases on average", n, mean)
    # each table is written once, and what follows reads it back
    P.map_reads(reads, made).write.parquet(f"{args.out}/mappings")
    mappings = spark.read.parquet(f"{args.out}/mappings")
    stats = A.map_stats(reads, mappings).first()
    log.info("%d reads mapped, %d to several graphs", stats.n_mapped, stats.n_multimapped)
    done = P.align_mapped(reads, mappings, made, args.no_align)
    if done["records"] is not None:
        done["records"].write.parquet(f"{args.out}/records")
        records = spark.read.parquet(f"{args.out}/records")
        references = G.sam_references(made.graph.paths, G.path_lengths(made.graph.path_nodes, made.graph.nodes))
        if args.sam:
            IO.write_sam(records, references, args.sam)
        if args.bam == "-":
            bam.write_bam(records, references, sys.stdout.buffer)
        elif args.bam:
            with open(args.bam, "wb") as out:
                bam.write_bam(records, references, out)
    if not stats.n_mapped:
        log.warning("no read was mapped; no graphs are written")
        return
    done["weights"].write.parquet(f"{args.out}/weights")
    weights = spark.read.parquet(f"{args.out}/weights")
    kept, _ = G.prune(made.graph, weights, params.min_coverage)
    total = done["totals"].agg(F.sum("kmer_total")).first()[0] or 0
    IO.write_gfa(kept, weights, f"{args.out}/graphs", [f"k-mers projected onto all graphs: {int(total)})"])


def report(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.bam:
        if args.bam == ["-"]:
            args.bam = [IO.spool(sys.stdin.buffer, f"{shared_folder(spark).removeprefix('file://')}/stdin-{uuid.uuid4().hex}.bam")]
        IO.check_files(args.bam, ("bam",))
        records, refs = bam.read_bam(spark, args.bam)
    elif args.aligned and args.index:
        made = load_index(spark, args.index)
        refs = G.sam_references(made.graph.paths, G.path_lengths(made.graph.path_nodes, made.graph.nodes))
        records = spark.read.parquet(f"{args.aligned}/records")
    else:
        raise ValueError("report needs --bam, or --index and --aligned")
    IO.write_report(P.report_records(records, refs.select("ref_name", "ref_len"), args.cutoff, args.low_coverage), args.out)


def haplotype(spark: SparkSession, args: argparse.Namespace) -> None:
    IO.check_files(args.gfa)
    lines = IO.scan_lines(spark, args.gfa)
    graph, weights = IO.parse_gfa(lines)
    total = IO.gfa_total_kmers(lines).agg(F.max("total")).first()[0]
    own = weights.groupBy("graph_id").agg(F.sum("kmer_freq").alias("kmer_total"))
    _, called = P.haplotypes(graph, graph.paths, weights, own, total, args.cutoff, args.min_iterations, args.max_iterations)
    called.write.parquet(f"{args.out}/called")
    called = spark.read.parquet(f"{args.out}/called")
    IO.fasta_lines(called, G.graph_to_sequences(graph.path_nodes, graph.nodes)).select("line").write.text(f"{args.out}/alleles")


COMMANDS = {"index": index, "align": align, "report": report, "haplotype": haplotype}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    if args.command == "version":
        print(__version__)
        return
    logging.basicConfig(level=logging.INFO, filename=args.log, format="%(asctime)s %(message)s")
    spark = spark or SparkSession.builder.appName("braidseq").getOrCreate()
    began = time.time()
    log.info("%s: %s", args.command, " ".join(f"{k}={v}" for k, v in vars(args).items() if k != "command"))
    COMMANDS[args.command](spark, args)
    log.info("%s took %.1f s; the driver's Python held %.0f MB at most", args.command, time.time() - began, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1e3)


if __name__ == "__main__":
    main()
