"""Exact alignment of reads to graph paths, by successive extension of a frontier table.

Candidates of all four stages (seed offsets, contained nodes, one base clipped at the start, one at the
end) and both strands extend together, a round per node, each an equi-join with nodes and edges; the first
comparison removes nearly all of them. The first success in (strand, stage, rank) order then wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import counted, revcomp
from ..sources.staging import staged
from .graph import Graph

NODE_OFFSETS, MAPQ, SECONDARY, REVERSE = 10, 30, 256, 16


def both_strands(reads: DataFrame) -> DataFrame:
    """reads (read_id, seq, qual) with rc: as they are, then reverse-complemented. qual may be null."""
    there = reads.select("read_id", "seq", "qual", F.lit(False).alias("rc"))
    back = reads.select("read_id", revcomp(F.col("seq")).alias("seq"), F.reverse("qual").alias("qual"), F.lit(True).alias("rc"))
    return there.unionByName(back)


def align_candidates(reads: DataFrame, mappings: DataFrame, contents: DataFrame, nodes: DataFrame) -> DataFrame:
    """(read_id, rc, graph_id, win_key, stage, rank, node_id, offset, clip_start, clip_end) to try.

    reads: read_id, rc, seq; mappings: read_id, graph_id, win_key, node_id, offset, merge_span, window_size;
    contents: win_key, inner_id. Offsets stay inside the node, as nothing matches beyond it.
    """
    lengths = nodes.select("graph_id", "node_id", "seg_len")
    base = reads.select("read_id", "rc").join(mappings, "read_id")
    seed = base.join(lengths, ["graph_id", "node_id"])
    out = ["read_id", "rc", "graph_id", "win_key", "stage", "rank", "node_id", "offset", "clip_start", "clip_end"]
    tries = F.least(F.col("merge_span") + F.col("window_size") + 1, F.col("seg_len") - F.col("offset"))
    one = seed.select("*", F.explode(counted(tries)).alias("rank"), F.lit(1).alias("stage"), F.lit(0).alias("clip_start"), F.lit(0).alias("clip_end")).withColumn("offset", F.col("offset") + F.col("rank"))
    inner = base.drop("node_id", "offset").join(contents.select("win_key", F.col("inner_id").alias("node_id")), "win_key").join(lengths, ["graph_id", "node_id"])
    inner = inner.select("*", F.explode(counted(F.least(F.lit(NODE_OFFSETS + 1), F.col("seg_len")))).alias("offset"))
    nth = F.row_number().over(Window.partitionBy("read_id", "rc", "win_key").orderBy("node_id", "offset")) - 1
    two = inner.select("*", nth.cast("int").alias("rank"), F.lit(2).alias("stage"), F.lit(0).alias("clip_start"), F.lit(0).alias("clip_end"))
    clip = lambda stage, s, e: seed.select("*", F.lit(0).alias("rank"), F.lit(stage).alias("stage"), F.lit(s).alias("clip_start"), F.lit(e).alias("clip_end"))
    return one.select(*out).unionByName(two.select(*out)).unionByName(clip(3, 1, 0).select(*out)).unionByName(clip(4, 0, 1).select(*out))


def _agrees(read: Column, segment: Column) -> Column:
    """Base by base; an N of the segment agrees with any base."""
    return (read == segment) | (F.contains(segment, F.lit("N")) & F.regexp_like(read, F.concat(F.lit("^"), F.replace(segment, F.lit("N"), F.lit(".")), F.lit("$"))))


def dfs_align(candidates: DataFrame, graph: Graph) -> DataFrame:
    """candidates (any columns, with seq, graph_id, node_id and offset) that match along the graph, once per
    traversal, with trav: the node ids walked. A read that runs off a node without a way out counts."""
    nodes = graph.nodes.select("graph_id", F.col("node_id").alias("at"), "seq", "seg_len").withColumnRenamed("seq", "segment")
    closed = graph.nodes.select("graph_id", "node_id").join(graph.edges.select("graph_id", F.col("src").alias("node_id")), ["graph_id", "node_id"], "left_anti").select("graph_id", F.col("node_id").alias("at"), F.lit(True).alias("closed"))
    nodes = nodes.join(closed, ["graph_id", "at"], "left").withColumn("closed", F.coalesce("closed", F.lit(False)))
    nodes, edges = staged(nodes, "frontier-nodes"), staged(graph.edges.withColumnRenamed("src", "at"), "frontier-edges")
    keep = candidates.columns
    front = candidates.withColumn("at", F.col("node_id")).withColumn("skip", F.col("offset")).withColumn("done", F.lit(0)).withColumn("trav", F.array().cast("array<bigint>"))
    found = None
    while True:
        step = front.join(nodes, ["graph_id", "at"]).where("skip < seg_len")
        n = F.least(F.col("seg_len") - F.col("skip"), F.length("seq") - F.col("done"))
        step = step.where(_agrees(F.substring(F.col("seq"), F.col("done") + 1, n), F.substring(F.col("segment"), F.col("skip") + 1, n)))
        step = step.withColumn("done", F.col("done") + n).withColumn("trav", F.concat("trav", F.array("at"))).withColumn("ends", (F.col("done") == F.length("seq")) | F.col("closed"))
        step = staged(step.select(*keep, "at", "done", "trav", "ends"), "frontier")
        ended = step.where("ends").select(*keep, "trav")
        found = ended if found is None else found.unionByName(ended)
        going = step.where("not ends")
        if going.isEmpty():
            return found
        front = going.join(edges, ["graph_id", "at"]).select(*keep, F.col("dst").alias("at"), F.lit(0).alias("skip"), "done", "trav")


def traversal_refs(matches: DataFrame, key: list[str], path_nodes: DataFrame) -> DataFrame:
    """(key, trav, path_id, start): the paths that have every node of a traversal, wherever they have them;
    start is the first node's place plus offset. path_nodes needs pos."""
    steps = matches.select(*key, "graph_id", "offset", "trav", F.posexplode("trav").alias("i", "node_id")) if "graph_id" not in key else matches.select(*key, "offset", "trav", F.posexplode("trav").alias("i", "node_id"))
    on = steps.join(path_nodes.select("graph_id", "path_id", "node_id", "pos"), ["graph_id", "node_id"])
    whole = on.groupBy(*key, "trav", "path_id").agg(F.count("*").alias("n"), F.max(F.when(F.col("i") == 0, F.col("pos") + F.col("offset"))).alias("start"))
    return whole.where(F.col("n") == F.size("trav")).select(*key, "trav", "path_id", "start")


def align(reads: DataFrame, mappings: DataFrame, contents: DataFrame, graph: Graph, path_nodes: DataFrame) -> DataFrame:
    """(read_id, graph_id, win_key, rc, stage, rank, clip_start, clip_end, path_id, start, nth): the
    alignments of the first success of each read and mapping, forward strand before reverse. nth counts
    from 0 within a read and mapping, by traversal and path id; ids can repeat over traversals, each with
    the start of the first."""
    strands = both_strands(reads)
    tries = align_candidates(strands, mappings, contents, graph.nodes)
    clipped = F.substring(F.col("seq"), F.col("clip_start") + 1, F.length("seq") - F.col("clip_start") - F.col("clip_end"))
    tries = tries.join(strands.select("read_id", "rc", "seq"), ["read_id", "rc"]).withColumn("seq", clipped)
    key = ["read_id", "graph_id", "win_key", "rc", "stage", "rank", "clip_start", "clip_end"]
    refs = traversal_refs(dfs_align(tries, graph), key, path_nodes)
    order = F.struct("rc", "stage", "rank")
    best = refs.withColumn("best", F.min(order).over(Window.partitionBy("read_id", "graph_id", "win_key"))).where(order == F.col("best"))
    nth = F.row_number().over(Window.partitionBy("read_id", "graph_id", "win_key").orderBy("trav", "path_id")) - 1
    start = F.first("start").over(Window.partitionBy("read_id", "graph_id", "win_key", "path_id").orderBy("trav"))
    return best.select(*key, "path_id", start.alias("start"), nth.cast("int").alias("nth"))


def tried_mappings(mappings: DataFrame, aligned: DataFrame | None) -> DataFrame:
    """The mappings that are weighted: per read and graph in order of node, offset and key, up to and with the
    first one that has an alignment; all of them without alignments."""
    if aligned is None:
        return mappings
    hit = aligned.select("read_id", "graph_id", "win_key").distinct().withColumn("hit", F.lit(1))
    joined = mappings.join(hit, ["read_id", "graph_id", "win_key"], "left")
    before = Window.partitionBy("read_id", "graph_id").orderBy("node_id", "offset", "win_key").rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn("had", F.coalesce(F.max("hit").over(before), F.lit(0))).where("had = 0").drop("had", "hit")


def reported(aligned: DataFrame, tried: DataFrame) -> DataFrame:
    """The alignments that are written: those of tried mappings."""
    return aligned.join(tried.select("read_id", "graph_id", "win_key"), ["read_id", "graph_id", "win_key"], "left_semi")


def sam_records(aligned: DataFrame, reads: DataFrame, references: DataFrame, prefix_of_read: bool = True) -> DataFrame:
    """One SAM row per alignment. A start-clipped record keeps the first bases of the read unless
    prefix_of_read is off, when it keeps those that were aligned."""
    rows = aligned.join(both_strands(reads), ["read_id", "rc"]).join(references, ["graph_id", "path_id"])
    n = F.length("seq") - F.col("clip_start") - F.col("clip_end")
    first = F.lit(1) if prefix_of_read else F.col("clip_start") + 1
    hard = lambda c: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit("H"))).otherwise("")
    flags = F.when(F.col("nth") > 0, SECONDARY).otherwise(0) + F.when(F.col("rc"), REVERSE).otherwise(0)
    return rows.select(
        "read_id", "graph_id", "path_id", "ref_name", F.col("start").alias("pos"), F.concat(hard("clip_start"), n.cast("string"), F.lit("M"), hard("clip_end")).alias("cigar"),
        F.lit(MAPQ).alias("mapq"), flags.alias("flags"), F.substring(F.col("seq"), first, n).alias("seq"), F.substring(F.col("qual"), first, n).alias("qual"),
    )


def subpath_weights(tried: DataFrame, contents: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(weights, totals): k-mer weight per node, and k-mers projected per graph.

    tried: read_id, graph_id, win_key, n_kmers. A mapping with one node gives it all its k-mers and does not
    count in the total; with more nodes each gets its share by length, times its bases in the window.
    """
    rows = tried.select("read_id", "graph_id", "win_key", "n_kmers").join(contents.select("win_key", F.col("inner_id").alias("node_id"), "n_bases"), "win_key")
    rows = rows.join(nodes.select("graph_id", "node_id", "seg_len"), ["graph_id", "node_id"])
    own = Window.partitionBy("read_id", "graph_id", "win_key")
    rows = rows.withColumn("all", F.sum("seg_len").over(own)).withColumn("n", F.count("*").over(own))
    weight = F.when(F.col("n") == 1, F.col("n_kmers").cast("double")).otherwise(F.col("seg_len") / F.col("all") * F.col("n_kmers") * F.col("n_bases"))
    weights = rows.groupBy("graph_id", "node_id").agg(F.sum(weight).alias("kmer_freq"))
    several = rows.where("n > 1").select("read_id", "graph_id", "win_key", "n_kmers").distinct()
    return weights, several.groupBy("graph_id").agg(F.sum("n_kmers").alias("kmer_total"))


def read_stats(reads: DataFrame) -> DataFrame:
    return reads.agg(F.count("*").alias("n_reads"), F.avg(F.length("seq")).alias("mean_length"))


def checked_read_stats(reads: DataFrame) -> tuple[int, float]:
    """The number of reads and their mean length; an error for none."""
    n, mean = read_stats(reads).first()
    if not n:
        raise ValueError("no reads were received")
    return n, mean


def map_stats(reads: DataFrame, mapped: DataFrame) -> DataFrame:
    """Reads received, mapped to a graph or to several, and mappings."""
    per = mapped.groupBy("read_id").agg(F.countDistinct("graph_id").alias("g"), F.count("*").alias("n"))
    sums = per.agg(F.count("*").alias("n_mapped"), F.count_if(F.col("g") > 1).alias("n_multimapped"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_mappings"))
    return reads.agg(F.count("*").alias("n_reads")).join(F.broadcast(sums))
