"""Reports over alignments: depth, breadth, run-length cover strings, accuracy, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import once

CUTOFF = 0.97


def pileup(alignments: DataFrame, references: DataFrame, strict_interval: bool = False) -> DataFrame:
    """(ref_name, pos, depth) of every base of a reference with an alignment.

    alignments: ref_name, pos, span, flags (4: unmapped, left out); references: ref_name, ref_len. Depth is
    a running sum over +1 and -1 events, not a row per aligned base. An interval has both its ends, one
    base more than the span, unless strict_interval is set; it is cut at the reference's end.
    """
    rows = alignments.where("flags <> 4").join(references, "ref_name")
    end = F.least(F.col("pos") + F.col("span") - (1 if strict_interval else 0), F.col("ref_len") - 1)
    rows = rows.select("ref_name", "ref_len", "pos", end.alias("end")).where("end >= pos")
    events = rows.select("ref_name", F.explode(F.array(F.struct(F.col("pos").alias("at"), F.lit(1).alias("n")), F.struct((F.col("end") + 1).alias("at"), F.lit(-1).alias("n")))).alias("e"))
    events = events.groupBy("ref_name", F.col("e.at").alias("at")).agg(F.sum("e.n").alias("n"))
    bases = rows.select("ref_name", "ref_len").distinct().select("ref_name", F.explode(F.sequence(F.lit(0), F.col("ref_len") - 1)).alias("at"))
    walk = Window.partitionBy("ref_name").orderBy("at")
    return bases.join(events, ["ref_name", "at"], "left").select("ref_name", F.col("at").alias("pos"), F.coalesce(F.sum("n").over(walk), F.lit(0)).alias("depth"))


def breadth(depths: DataFrame) -> DataFrame:
    """(ref_name, covered, ref_len, share)."""
    per = depths.groupBy("ref_name").agg(F.count_if(F.col("depth") > 0).alias("covered"), F.count("*").alias("ref_len"))
    return per.withColumn("share", F.col("covered") / F.col("ref_len"))


def coverage_runs(depths: DataFrame) -> DataFrame:
    """(ref_name, run, op, n): stretches of covered (M) and bare (D) bases."""
    walk = Window.partitionBy("ref_name").orderBy("pos")
    rows = depths.withColumn("op", F.when(F.col("depth") > 0, "M").otherwise("D"))
    rows = rows.withColumn("run", F.sum(F.when(F.lag("op").over(walk) == F.col("op"), 0).otherwise(1)).over(walk))
    return rows.groupBy("ref_name", "run", "op").agg(F.count("*").alias("n"))


def _cover_string(runs: Column) -> tuple[Column, Column]:
    """(cigar, internal_gap) of an array of structs with n and op, the runs of a reference in order."""
    last = F.element_at(runs, -1)
    counted = F.when((F.size(runs) > 1) & (last["n"] == 1), F.concat(F.slice(runs, F.lit(1), F.size(runs) - 2), F.array(last))).otherwise(runs)
    bare = F.size(F.filter(counted, lambda x: x["op"] == "D"))
    inside = ~((F.size(counted) <= 2) | ((F.size(counted) == 3) & (bare == 2)))
    one = F.aggregate(runs, F.lit(0).cast("long"), lambda a, x: a + x["n"]) == 1
    text = F.array_join(F.transform(runs, lambda x: F.concat(x["n"].cast("string"), x["op"])), "")
    return F.when(one, "").otherwise(text), inside & ~one


def coverage_cigar(runs: DataFrame) -> DataFrame:
    """(ref_name, cigar, internal_gap). A reference of one base has an empty string.

    The gap test counts runs of D and M: none is internal if there are two runs or fewer, or two D around
    one M. A last run of one base adds itself and leaves out the run before it.
    """
    per = runs.groupBy("ref_name").agg(F.array_sort(F.collect_list(F.struct("run", "n", "op"))).alias("runs"))
    cigar, gap = _cover_string(F.col("runs"))
    return per.select("ref_name", cigar.alias("cigar"), gap.alias("internal_gap"))


def stretches(alignments: DataFrame, references: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, ref_name, ref_len, nth, bare, covered, reads): each covered stretch of a reference, the bare bases before
    it, and the alignments that start in it; they are what pileup() has depth at, without a row per base.

    A stretch starts where an alignment does that is beyond the end of all before it. References with one name are
    one. Alignments are dealt by reference once; those of one start are one row from there on, before anything is
    sorted, so that a reference has no more rows than bases. nth 0 has the alignments without a base before the first
    stretch.
    """
    keys = [*by, "ref_name"]
    lengths = references.groupBy("ref_name").agg(F.max("ref_len").alias("ref_len"))
    dealt = alignments.where("flags <> 4").select(*keys, "pos", "span").repartition("ref_name")
    last = F.coalesce(F.col("pos") + F.col("span"), F.lit(2**31 - 1))  # without a span: all that follows, as in pileup()
    starts = dealt.groupBy(*keys, "pos").agg(F.max(last).alias("last"), F.count("*").alias("reads")).join(lengths, "ref_name")
    end = F.least(F.col("last"), F.col("ref_len") - 1)
    starts = starts.withColumn("end", F.when((end >= F.col("pos")) & (end >= 0), end))
    walk = Window.partitionBy(*keys).orderBy("pos")
    starts = starts.withColumn("reach", F.coalesce(F.max("end").over(walk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)))
    first = F.col("end").isNotNull() & ((F.col("pos") > F.col("reach") + 1) | (F.col("reach") < 0))
    starts = starts.withColumn("first", first).withColumn("nth", F.count_if("first").over(walk.rowsBetween(Window.unboundedPreceding, 0)))
    of_first = lambda c: F.max(F.when(F.col("first"), c))
    pos = F.greatest("pos", F.lit(0))
    found = starts.groupBy(*keys, "ref_len", "nth").agg(of_first(pos).alias("pos"), of_first(pos - F.col("reach") - 1).alias("bare"), F.max("end").alias("end"), F.sum("reads").alias("reads"))
    long = lambda c: F.coalesce(c.cast("long"), F.lit(0).cast("long"))
    return found.select(*keys, F.col("ref_len").cast("long").alias("ref_len"), "nth", long(F.col("bare")).alias("bare"), long(F.col("end") - F.col("pos") + 1).alias("covered"), "reads")


def report(alignments: DataFrame, references: DataFrame, cutoff: float = CUTOFF, low_coverage: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, arg, read_count, gene_length, coverage_cigar) of the references covered well enough.

    low_coverage sets the cutoff to CUTOFF and drops references with an internal gap. A leading `*` of a
    name goes. References without alignments are not reported; those with one name are one. by: columns of
    the alignments, such as a sample, each of whose values gets a report of its own.
    """
    if not 0 <= cutoff <= 1:
        raise ValueError("cutoff must be between 0 and 1")
    found = stretches(alignments, references, by)
    total = lambda c: F.sum(c).alias(c)
    parts = F.array_sort(F.collect_list(F.struct("nth", "bare", "covered"))).alias("parts")
    per = found.groupBy(*by, "ref_name", "ref_len").agg(total("bare"), total("covered"), total("reads"), parts)
    rows = per.where(F.col("covered") > 0).where(F.col("covered") / F.col("ref_len") >= (CUTOFF if low_coverage else cutoff))
    run = lambda n, op: F.struct(n.alias("n"), F.lit(op).alias("op"))
    runs = F.flatten(F.transform("parts", lambda x: F.array(run(x["bare"], "D"), run(x["covered"], "M"))))
    runs = F.concat(runs, F.array(run(F.col("ref_len") - F.col("bare") - F.col("covered"), "D")))
    rows = rows.withColumn("text", once(F.filter(runs, lambda x: x["n"] > 0), lambda x: F.struct(*(c.alias(n) for n, c in zip(("cigar", "gap"), _cover_string(x), strict=True)))))
    if low_coverage:
        rows = rows.where("not text.gap")
    return rows.select(*by, F.regexp_replace("ref_name", r"^\*", "").alias("arg"), F.col("reads").alias("read_count"), F.col("ref_len").alias("gene_length"), F.col("text.cigar").alias("coverage_cigar"))


def reference_join(alignments: DataFrame, references: DataFrame) -> DataFrame:
    """Alignments with their reference's name and length; an inner join."""
    return alignments.join(references, ["graph_id", "path_id"])


def accuracy(reads: DataFrame, alignments: DataFrame) -> DataFrame:
    """Of simulated reads (read_id, true_ref, true_start): n_reads, n_aligned, n_multi, n_unaligned, n_misaligned
    (no alignment to the true reference), n_right_start and false_positives (records on other references)."""
    hits = alignments.select("read_id", "ref_name", "pos")
    rows = reads.join(hits, "read_id", "left")
    right = F.coalesce(F.col("ref_name") == F.col("true_ref"), F.lit(False))
    per = rows.groupBy("read_id").agg(F.count("ref_name").alias("n"), F.max(right).alias("right"), F.max(right & (F.col("pos") == F.col("true_start"))).alias("at_start"), F.count_if(F.col("ref_name").isNotNull() & ~right).alias("wrong"))
    yes = lambda c: F.count_if(c)
    return per.agg(F.count("*").alias("n_reads"), yes(F.col("n") > 0).alias("n_aligned"), yes(F.col("n") > 1).alias("n_multi"), yes(F.col("n") == 0).alias("n_unaligned"), yes((F.col("n") > 0) & ~F.col("right")).alias("n_misaligned"), yes(F.coalesce("at_start", F.lit(False))).alias("n_right_start"), F.coalesce(F.sum("wrong"), F.lit(0)).alias("false_positives"))


def proportions(reports: DataFrame, group: str, reads_per_sample: Column | int) -> DataFrame:
    """Mapped reads of each group by the reads of its samples."""
    per = reports.groupBy(group).agg(F.sum("read_count").alias("mapped"), F.countDistinct("sample").alias("n_samples"))
    return per.withColumn("share", F.col("mapped") / (F.lit(reads_per_sample) * F.col("n_samples")))


def combined_profiles(reports: list[DataFrame], group: str) -> DataFrame:
    """All samples' report rows, counted by group."""
    both = reports[0]
    for other in reports[1:]:
        both = both.unionByName(other)
    return both.groupBy(group).agg(F.count("*").alias("n_rows"), F.countDistinct("arg").alias("n_args"))


def dedup_sequences(seqs: DataFrame) -> DataFrame:
    """One row per sequence regardless of case: the least id, and how many there were."""
    return seqs.groupBy(F.upper("seq").alias("seq")).agg(F.min("id").alias("id"), F.count("*").alias("copies"))


def core_clusters(members: DataFrame, more_than: int = 3) -> DataFrame:
    """Clusters of more than so many members (compared as numbers)."""
    return members.groupBy("cluster").agg(F.count("*").alias("n")).where(F.col("n") > more_than)
