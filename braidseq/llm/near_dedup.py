"""MinHash near-dedup: consistent weighted sampling over TF-IDF shingles, banded, verified.

A shingle is five words (all of them in a shorter text), ASCII-lower-cased. Its weight is its count in the
text times its idf, the mean of the smoothed idf of its words; the words' document counts over the whole
corpus are kept in DF_CELLS hashed cells, so what is broadcast never grows. Improved consistent weighted
sampling (Ioffe, 2010) draws BANDS * ROWS samples; texts that agree on a band, or on two neighbouring ones,
share a bucket. Exact copies count once. All members of a bucket are compared with its first; then, where
they are not of one class yet, those of a bucket of at most SMALL with each other, and those of a larger
one with PIVOTS more members, chosen anew in each band. Larger buckets that are of several classes even
then are compared in full, block against block through an inverted index, except for two members of the
bucket's most frequent class. So any two texts that share a bucket are in one class or were compared. Rows
of that last step are members times blocks, not pairs; its CPU time still grows with the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import keep_only, materialise, mix64, ngram_hashes, small_batches, span_hashes, table, utf8, word_spans
from ._components import components

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 14, 3
DF_CELLS = 1 << 20
SMALL, PIVOTS, MEMBERS_PER_TASK_KEY = 16, 2, 256
BLOCK_WORDS = 1 << 20
GRID = 1 << 14


def words_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, document) of a batch's texts."""
    raw, offsets = utf8(batch.column("text"))
    lower = raw.copy()
    lower[(raw >= 65) & (raw <= 90)] += 32
    starts, ends, docs = word_spans(lower, offsets)
    return span_hashes(lower, starts, ends), docs


def document_counts(docs: DataFrame) -> np.ndarray:
    """In each hashed cell, the number of documents with a word of the cell. At most DF_CELLS rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("near_dedup")
        cells = np.zeros(DF_CELLS, np.int64)
        for batch in small_batches(batches):
            words, of = words_of(batch)
            seen = np.unique((of.astype(np.uint64) << np.uint64(20)) | (words & np.uint64(DF_CELLS - 1)))
            cells += np.bincount((seen & np.uint64(DF_CELLS - 1)).astype(np.int64), minlength=DF_CELLS)
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(cells[at])], names=["cell", "n"])

    parts = docs.select("text").mapInArrow(run, "cell long, n long")
    found = parts.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(DF_CELLS, np.int64)
    counts[found["cell"].to_numpy()] = found["n"].to_numpy()
    return counts


def idf_cells(docs: DataFrame) -> np.ndarray:
    return (np.log((docs.count() + 1) / (document_counts(docs) + 1.0)) + 1.0).astype(np.float32)


def shingles(words: np.ndarray, of: np.ndarray, n_docs: int, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, weight, first row of each document and the end) of distinct shingles, by document and hash."""
    n_words = np.bincount(of, minlength=n_docs)
    own = idf[(words & np.uint64(DF_CELLS - 1)).astype(np.int64)].astype(np.float64)
    sums = np.append(0.0, np.cumsum(own))
    keys, at = ngram_hashes(words, of, SHINGLE)
    weights = (sums[at + SHINGLE] - sums[at]) / SHINGLE
    docs = of[at]
    first = np.append(0, np.cumsum(n_words))
    short = np.flatnonzero((n_words > 0) & (n_words < SHINGLE))
    if len(short):
        extra = [np.bitwise_xor.reduce(mix64(words[first[d] : first[d + 1]] + np.arange(n_words[d], dtype=np.uint64))) for d in short]
        keys = np.concatenate([keys, np.array(extra, np.uint64)])
        weights = np.concatenate([weights, (sums[first[short + 1]] - sums[first[short]]) / n_words[short]])
        docs = np.concatenate([docs, short])
    order = np.lexsort((keys, docs))
    keys, weights, docs = keys[order], weights[order], docs[order]
    if not len(keys):
        return keys, weights, np.zeros(n_docs + 1, np.int64)
    new = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])))
    times = np.diff(np.append(new, len(keys)))
    return keys[new], np.round(weights[new], 6) * times, np.searchsorted(docs[new], np.arange(n_docs + 1))


def _gamma_grid() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1) and their logarithms at the midpoints of GRID equal steps."""
    x = np.linspace(0, 40, 400_001)
    q = np.interp((np.arange(GRID) + 0.5) / GRID, 1 - (1 + x) * np.exp(-x), x)
    return q.astype(np.float32), np.log(q).astype(np.float32)


def signatures(keys: np.ndarray, weights: np.ndarray, first: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit hash per document and band; documents without shingles get zeros."""
    out = np.zeros((len(first) - 1, bands), np.uint64)
    full = np.flatnonzero(np.diff(first))
    if not len(full):
        return out
    at = first[full]
    r_of, lnc_of = _gamma_grid()
    log_w = np.log(weights).astype(np.float32)
    sizes = np.diff(first)[full]
    for k in range(bands * rows):
        x = mix64(keys + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        r = r_of[(x & np.uint64(GRID - 1)).astype(np.int32)]
        beta = ((x >> np.uint64(14)) & np.uint64(0xFFFFFF)).astype(np.float32) * np.float32(2.0**-24)
        t = np.floor(log_w / r + beta)
        ln_a = lnc_of[(x >> np.uint64(50)).astype(np.int32)] - r * (t - beta + np.float32(1))
        least = np.minimum.reduceat(ln_a, at)
        hit = np.flatnonzero(ln_a == np.repeat(least, sizes))
        best = hit[np.searchsorted(hit, at)]
        sample = mix64(keys[best] + (t[best].astype(np.int64) + 1_000).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        band = k // rows
        out[full, band] = mix64(out[full, band] * np.uint64(0x9E3779B97F4A7C15) + sample + np.uint64(band + 1))
    return out


def sign(docs: DataFrame, idf) -> DataFrame:
    """(doc_id, d1, d2, n_words, bands): two hashes of the word sequence, its length and the band hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            words, of = words_of(batch)
            n = batch.num_rows
            bands = signatures(*shingles(words, of, n, idf.value))
            n_words = np.bincount(of, minlength=n)
            place = (np.arange(len(of)) - np.repeat(np.cumsum(n_words) - n_words, n_words)).astype(np.uint64)
            digests = []
            for salt in (1, 2):
                total = np.append(np.uint64(0), np.cumsum(mix64(words + (place + np.uint64(1)) * np.uint64(0xA24BAED4963EE407 + 2 * salt))))
                ends = np.cumsum(n_words)
                digests.append(mix64(total[ends] - total[ends - n_words] + n_words.astype(np.uint64)).view(np.int64))
            lists = pa.ListArray.from_arrays(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32), pa.array(bands.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(digests[0]), pa.array(digests[1]), pa.array(n_words), lists], names=["doc_id", "d1", "d2", "n_words", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, d1 long, d2 long, n_words long, bands array<long>")


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two texts' (sorted distinct shingles, weights)."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    if not len(a[0]):
        return float(len(b[0]) == 0)
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    same = b[0][at] == a[0]
    both = np.minimum(a[1][same], b[1][at[same]]).sum()
    return float(both / (a[1].sum() + b[1].sum() - both))


def verify(pairs: DataFrame, texts: DataFrame, idf, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough.

    The rows of a pivot a, its own text first, stream past one at a time; a pivot with many members is
    repeated for every MEMBERS_PER_TASK_KEY of them, so no task gets them all.
    """
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")))
    members = pairs.join(texts, pairs["b"] == texts["doc_id"]).select("a", "salt", F.lit(1).alias("role"), F.col("b").alias("other"), "text")
    pivots = pairs.select("a", "salt").distinct()
    heads = pivots.join(texts, pivots["a"] == texts["doc_id"]).select("a", "salt", F.lit(0).alias("role"), F.col("a").alias("other"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, of = None, None
        for batch in small_batches(batches):
            words, docs = words_of(batch)
            keys, weights, first = shingles(words, docs, batch.num_rows, idf.value)
            a, role, other = (batch.column(i).to_pylist() for i in (0, 2, 3))
            found = []
            for i in range(batch.num_rows):
                own = keys[first[i] : first[i + 1]], weights[first[i] : first[i + 1]]
                if role[i] == 0:
                    pivot, of = (own[0].copy(), own[1].copy()), a[i]
                elif of == a[i] and weighted_jaccard(pivot, own) >= similarity:
                    found.append((a[i], other[i]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["a", "b"])

    rows = heads.unionByName(members).repartition("a", "salt").sortWithinPartitions("a", "salt", "role")
    return rows.mapInArrow(run, "a long, b long")


def longer_bands(bands):
    """Each band together with the next: rows of twice the length, which tell the members of a dense family apart."""
    return F.transform(F.sequence(F.lit(0), F.size(bands) - 1), lambda i: F.xxhash64(F.get(bands, i), F.get(bands, (i + 1) % F.size(bands))))


def verified(pairs: DataFrame, texts: DataFrame, idf, similarity: float) -> DataFrame:
    """(u, v) of the pairs (a, b) that are similar enough."""
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS_PER_TASK_KEY).alias("salts"))
    pairs = materialise(pairs.join(salts, "a"), "near-pairs")
    return materialise(verify(pairs, texts, idf, similarity), "near-good").select(F.col("a").alias("u"), F.col("b").alias("v"))


class Block:
    """An inverted index over the shingles of some texts."""

    def __init__(self, texts: list[tuple[np.ndarray, np.ndarray]]):
        self.totals = np.array([w.sum() for _, w in texts])
        keys, self.weights = (np.concatenate([t[k] for t in texts]) for k in (0, 1))
        order = np.argsort(keys)
        self.keys, self.weights = keys[order], self.weights[order]
        self.of = np.repeat(np.arange(len(texts)), [len(k) for k, _ in texts])[order]

    def likeness(self, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The weighted Jaccard similarity of a text with shingles to each text of the block."""
        low = np.searchsorted(self.keys, keys)
        times = np.searchsorted(self.keys, keys, "right") - low
        at = np.arange(times.sum()) + np.repeat(low - (np.cumsum(times) - times), times)
        both = np.bincount(self.of[at], np.minimum(self.weights[at], np.repeat(weights, times)), len(self.totals))
        return both / (self.totals + weights.sum() - both)


def verify_all(members: DataFrame, texts: DataFrame, idf, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) of similar texts of different classes among all members (band, h, rep, c, n_words) of each bucket.

    Members that are not of the bucket's most frequent class are dealt into blocks of about BLOCK_WORDS by
    ranges of a hash, and each block is indexed. All members, dealt into stretches of that size, stream past
    the blocks one at a time; of two indexed members the one with the greater hash streams past the other.
    """
    classes = members.groupBy("band", "h", "c").agg(F.count("*").alias("n"), F.sum("n_words").alias("w"))
    buckets = classes.groupBy("band", "h").agg(F.max_by("c", F.struct("n", "c")).alias("top"), F.sum("w").alias("w"), F.max_by("w", F.struct("n", "c")).alias("top_w"))
    parts = lambda words: F.ceil(words / BLOCK_WORDS)
    buckets = buckets.select("band", "h", "top", parts(F.col("w") - F.col("top_w")).alias("blocks"), parts(F.col("w")).alias("stretches"))
    placed = members.join(buckets, ["band", "h"]).withColumn("o", F.pmod(F.xxhash64("rep"), F.lit(1 << 30)))
    placed = placed.withColumn("free", F.col("c") != F.col("top")).withColumn("block", F.floor(F.col("o") * F.col("blocks") / (1 << 30)))
    own = F.pmod(F.xxhash64("rep", F.lit(1)), "stretches")
    columns = ["band", "h", "rep", "c", "o", "free"]
    indexed = placed.where("free").select(*columns, F.lit(0).alias("role"), "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("stretches") - 1)).alias("stretch"))
    last = F.when(F.col("free"), F.col("block")).otherwise(F.col("blocks") - 1)
    streamed = placed.select(*columns, F.lit(1).alias("role"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"), own.alias("stretch"))
    rows = materialise(indexed.unionByName(streamed), "near-blocks")
    rows = rows.join(texts, rows["rep"] == texts["doc_id"]).select("band", "h", "block", "stretch", "role", "rep", "c", "o", "free", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, block, known = None, [], None, []
        for batch in small_batches(batches):
            words, docs = words_of(batch)
            keys, weights, first = shingles(words, docs, batch.num_rows, idf.value)
            places = list(zip(*(batch.column(i).to_pylist() for i in range(4))))
            role, rep, c, o, free = (batch.column(i).to_pylist() for i in range(4, 9))
            found = []
            for i in range(batch.num_rows):
                own = keys[first[i] : first[i + 1]], weights[first[i] : first[i + 1]]
                if places[i] != here:
                    here, held, block, known = places[i], [], None, []
                if role[i] == 0:
                    held.append((own[0].copy(), own[1].copy()))
                    known.append((rep[i], c[i], o[i]))
                    continue
                if not known:
                    continue
                if block is None:
                    block, held, (reps, cs, order) = Block(held), [], map(np.array, zip(*known))
                hit = (block.likeness(*own) >= similarity) & (cs != c[i])
                if free[i]:
                    hit &= (order < o[i]) | (order == o[i]) & (reps < rep[i])
                found += [(min(rep[i], a), max(rep[i], a)) for a in reps[hit].tolist()]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["a", "b"])

    rows = rows.repartition("band", "h", "block", "stretch").sortWithinPartitions("band", "h", "block", "stretch", "role")
    return rows.mapInArrow(run, "a long, b long").distinct()


def near_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, copy_of): class_id is the least doc_id among the documents that links of at least
    the given weighted Jaccard similarity connect, copy_of the least one with the same word sequence.

    Needs doc_id (integers) and text; other columns are not read. Rows that share a doc_id are taken for
    repeats of one row, and one of them is returned. Null and empty texts, and those without words, have
    the same (empty) word sequence and form one class. A null doc_id has no class: its row comes back with nulls.
    Texts of any length are compared whole, ties of similarity with the bound count as links, and an empty
    table gives an empty one.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    idf = docs.sparkSession.sparkContext.broadcast(idf_cells(docs))
    signed = materialise(sign(docs, idf), "near-signed")
    known = signed.where("doc_id is not null")
    kinds = materialise(known.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("n_words").alias("n_words"), F.first("bands").alias("bands")), "near-kinds")
    member = kinds.where("bands[0] <> 0").select("rep", "n_words", F.posexplode(F.concat("bands", longer_bands(F.col("bands")))).alias("band", "h"))
    order = lambda seed: F.xxhash64("rep", "band", F.lit(seed))
    size = member.groupBy("band", "h").agg(F.count("*").alias("n"), F.min("rep").alias("a"), F.array(*(F.min_by("rep", order(i)) for i in range(PIVOTS))).alias("more")).where("n > 1")
    size = materialise(size, "near-buckets")
    member = materialise(member.join(size.select("band", "h"), ["band", "h"], "left_semi"), "near-members")

    wanted = member.select(F.col("rep").alias("doc_id")).distinct()
    texts = materialise(docs.join(wanted, "doc_id").dropDuplicates(["doc_id"]), "near-texts")

    first = member.join(size.select("band", "h", "a"), ["band", "h"]).where("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    links = verified(first, texts, idf, similarity)
    of = materialise(components(links), "near-components")

    placed = member.join(of, member["rep"] == of["node"], "left").select("band", "h", "rep", F.coalesce("component", "rep").alias("c"))
    mixed = placed.groupBy("band", "h").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least <> most").select("band", "h")
    mixed = materialise(mixed.join(size, ["band", "h"]), "near-mixed")
    rest = placed.join(mixed.select("band", "h", "n", "more"), ["band", "h"])
    small = rest.where(F.col("n") <= SMALL).groupBy("band", "h").agg(F.collect_list(F.struct("rep", "c")).alias("x"))
    small = small.select("x", F.explode("x").alias("y")).select("y", F.explode("x").alias("z")).where("y.rep < z.rep and y.c <> z.c").select(F.col("y.rep").alias("a"), F.col("z.rep").alias("b"))
    large = rest.where(F.col("n") > SMALL).select("rep", "c", F.explode("more").alias("a")).where("rep <> a").select(F.least("rep", "a").alias("a"), F.greatest("rep", "a").alias("b"), "c")
    large = large.join(of.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left").join(of.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left")
    large = large.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    second = small.unionByName(large).distinct().join(first, ["a", "b"], "left_anti")
    links = verified(second, texts, idf, similarity).unionByName(of.select(F.col("node").alias("u"), F.col("component").alias("v")))  # a class stands for its links
    of = materialise(components(links), "near-components")

    # who shares a longer band shares its first half too, so the plain bands hold all pairs
    placed = member.where(F.col("band") < BANDS).join(size.where(F.col("n") > SMALL).select("band", "h"), ["band", "h"])
    placed = placed.join(of, placed["rep"] == of["node"], "left").select("band", "h", "rep", "n_words", F.coalesce("component", "rep").alias("c"))
    mixed = placed.groupBy("band", "h").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least <> most").select("band", "h")
    mixed = materialise(placed.join(mixed, ["band", "h"]), "near-mixed")
    if not mixed.isEmpty():
        links = materialise(verify_all(mixed, texts, idf, similarity), "near-good").select(F.col("a").alias("u"), F.col("b").alias("v"))
        if not links.isEmpty():
            of = materialise(components(links.unionByName(of.select(F.col("node").alias("u"), F.col("component").alias("v")))), "near-components")
    reps = kinds.select("d1", "d2", "rep")
    reps = reps.join(of, reps["rep"] == of["node"], "left").select("d1", "d2", "rep", F.coalesce("component", "rep").alias("class_id"))
    classed = known.select("doc_id", "d1", "d2").join(reps, ["d1", "d2"]).select("doc_id", "class_id", F.col("rep").alias("copy_of")).dropDuplicates(["doc_id"])
    nobody = F.lit(None).cast("long")
    return classed.unionByName(signed.where("doc_id is null").select("doc_id", nobody.alias("class_id"), nobody.alias("copy_of")))


def op3_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))


def stage_near_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each class stays, and rows without a doc_id; repeats of one row go.

    Null and empty texts are of one class, of which one stays. Texts of any length are compared whole. All columns
    that came in pass through, whatever their names. An empty table gives an empty one.
    """
    keep = near_classes(docs).where("doc_id = class_id").select("doc_id")
    kept = docs.join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id is null"))
