"""Suffix-array dedup: bytes inside a long string that starts anywhere else are removed.

Suffixes are sorted in shards, each by external induced sorting (_external_suffixes). What makes shards
independent is an anchor: of the k-symbol strings inside a window of `length` symbols, the one with the least
hash, the left-most on ties. Equal windows have equal anchors, so the windows of a text fall into regions,
one per anchor, and only regions of the same anchor can share a window. Regions whose anchor occurs once
are done; equal regions are counted and kept once; the rest goes to the shard of its anchor and is sorted
there. An anchor with more than HOT_KINDS different regions is dealt out again by a longer anchor inside
them, up to the whole window, so no group meets in one task.

Symbols are bytes, or whole words where passages shared by different documents are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bloom import BlockedBloom
from ._common import give_back, keep_only, materialise, mix64, small_batches, span_hashes, table, text_of, utf8, word_spans

LENGTH = 400
ANCHORS = (64, 368, 400)  # bytes; the last is the window itself
PASSAGE = 51
WORD_ANCHORS = (16, 44, 51)  # words
HOT_KINDS = 1024
SHARD_BYTES = 2_000_000
BORDER = 0xFF  # no byte of UTF-8
REGION = "u1 long, u2 long, owner long, key long, r long, lo long, size long, at long, bytes long, anchors long"


def regions(raw: np.ndarray, offsets: np.ndarray, k: int, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(text, key, content hash, start, size, anchors) of the regions of each text of a batch of symbols."""
    none = (np.zeros(0, np.int64),) * 6
    n_windows = len(raw) - length + 1
    if n_windows <= 0:
        return none
    h, width = mix64(raw.astype(np.uint64) + np.uint64(1)), 1
    rest, done = k - 1, 1  # hashes of `done` symbols; parts of a power of two are joined until they are k long
    grown = h
    while rest:
        if rest & width:
            grown = mix64(grown[: len(grown) - width] * np.uint64(0x9FB21C651E98DF25) + h[done : done + len(grown) - width])
            done += width
            rest -= width
        if rest:
            h = mix64(h[:-width] * np.uint64(0xD6E8FEB86659FD93) + h[width:])
            width *= 2
    ranked = (grown >> np.uint64(32) << np.uint64(32)) | np.arange(len(grown), dtype=np.uint64)
    span, have = length - k + 1, 1
    while have < span:
        step = min(have, span - have)
        ranked = np.minimum(ranked[: len(ranked) - step], ranked[step:])
        have += step
    at = np.searchsorted(offsets, np.arange(n_windows), "right") - 1
    window = np.flatnonzero(np.arange(n_windows) + length <= offsets[at + 1])
    if not len(window):
        return none
    of, anchor = at[window], (ranked[window] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    keys = grown[anchor]
    new = np.append(True, (of[1:] != of[:-1]) | (keys[1:] != keys[:-1]))
    moved = np.append(True, (of[1:] != of[:-1]) | (anchor[1:] != anchor[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(window)) - 1
    lo, hi = window[first], window[last] + length
    content = span_hashes(raw, lo, hi) ^ mix64((hi - lo).astype(np.uint64))
    return of[first], keys[first].view(np.int64), content.view(np.int64), lo - offsets[of[first]], hi - lo, np.add.reduceat(moved.astype(np.int64), first)


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, offsets of each text among them, first byte and end of each word)."""
    starts, ends, of = word_spans(raw, offsets)
    return span_hashes(raw, starts, ends), np.searchsorted(of, np.arange(len(offsets))), starts, ends


def region_rows(units: DataFrame, k: int, length: int, words: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("suffix_dedup")
        for batch in small_batches(batches, 250_000):
            raw, offsets = utf8(batch.column("text"))
            if words:
                symbols, first, starts, ends = words_of(raw, offsets)
                of, key, r, lo, size, anchors = regions(symbols, first, k, length)
                at = starts[first[of] + lo]
                n_bytes = ends[first[of] + lo + size - 1] - at
                at = at - offsets[of]
            else:
                of, key, r, lo, size, anchors = regions(raw, offsets, k, length)
                at, n_bytes = lo, size
            if len(of):
                ids = (batch.column(c).take(pa.array(of)) for c in ("u1", "u2", "owner"))
                yield pa.RecordBatch.from_arrays([*ids, *map(pa.array, (key, r, lo, size, at, n_bytes, anchors))], names=[x.split()[0] for x in REGION.split(", ")])

    return units.select("u1", "u2", "owner", "text").mapInArrow(run, REGION)


def sorted_repeats(parts: DataFrame, length: int, shards: int, words: bool) -> DataFrame:
    """(key, r, s, e): the window starts s..e of each region that occur elsewhere in its shard (words: in a region of another owner)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ._external_suffixes import Space, repeated_starts

        keep_only("suffix_dedup")
        space, size, ids, sizes = Space(), 0, [], []
        try:
            path = f"{space.folder.name}/text"
            with open(path, "wb") as file:
                for batch in batches:
                    raw, offsets = utf8(batch.column("text"))
                    if words:
                        raw, offsets, *_ = words_of(raw, offsets)
                    file.write(np.insert(raw, offsets[1:], 0 if words else BORDER).tobytes())
                    ids.append(batch.select(["key", "r", "owner"]))
                    sizes.append(np.diff(offsets))
                    size += len(raw) + batch.num_rows
            if not size:
                return
            if words:  # symbols are ranks of the words' hashes
                known, names = np.unique(np.fromfile(path, np.uint64), return_inverse=True)
                names.astype(np.int32).tofile(path)
                owners, ends = np.concatenate([b.column(2).to_numpy() for b in ids]), np.cumsum(np.concatenate(sizes) + 1)
                hits = repeated_starts(space.open(path, np.int32), len(known), length, space, lambda at: owners[np.searchsorted(ends, at, "right")])
            else:
                hits = repeated_starts(space.open(path, np.uint8), 256, length, space)
            start = 0
            for batch, lengths in zip(ids, sizes):
                ends = start + np.cumsum(lengths + 1)
                begins = ends - lengths - 1
                hit = np.array(hits[start : ends[-1]])
                valid = np.repeat(ends - length, lengths + 1) > np.arange(start, ends[-1])  # the window ends before the border
                on = np.flatnonzero(np.diff(np.concatenate([[0], (hit.astype(bool) & valid).astype(np.int8), [0]])))
                s, e = on[::2] + start, on[1::2] + start - 1
                of = np.searchsorted(ends, s, "right")
                if len(s):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), batch.column(1).take(pa.array(of)), pa.array(s - begins[of]), pa.array(e - begins[of])], names=["key", "r", "s", "e"])
                start = int(ends[-1])
        finally:
            space.close()
            give_back()

    return parts.select("key", "r", "owner", "text").repartition(shards, "key").mapInArrow(run, "key long, r long, s long, e long")


def repeats(units: DataFrame, length: int = LENGTH, anchors: tuple[int, ...] = ANCHORS, words: bool = False) -> DataFrame:
    """(u1, u2, s, e): window starts s..e of the unit (u1, u2) whose strings occur elsewhere too.

    Symbols are bytes and elsewhere is any unit, the same one included; with words, symbols are words and
    elsewhere is a unit of another owner. Units with the same (u1, u2) must have the same text; each row counts.
    """
    k, deeper = anchors[0], anchors[1:]
    whole = k == length  # the anchor is the window: an anchor that occurs again is a window that occurs again
    found = materialise(region_rows(units, k, length, words), "suffix-regions")
    again = F.min("owner") < F.max("owner") if words else F.sum("anchors") > 1
    often = found.groupBy("key").agg(again.alias("again")).where("again").select("key")
    found = materialise(found.join(materialise(often, "suffix-keys"), "key", "left_semi"), "suffix-candidates")
    counted = (F.count("*").alias("copies"), F.min("owner").alias("owner"), F.max("owner").alias("other"))
    kinds = found.groupBy("key", "r").agg(*counted, F.min(F.struct("u1", "u2", "lo", "size", "at", "bytes")).alias("first"))
    kinds = kinds.withColumn("known", F.lit(True) if whole else F.col("owner") < F.col("other") if words else F.col("copies") > 1)
    kinds = kinds.withColumn("owner", F.when(F.col("owner") < F.col("other"), F.xxhash64("key", "r")).otherwise(F.col("owner")))
    kinds = materialise(kinds.select("key", "r", "owner", "known", "first.*"), "suffix-kinds")
    per_key = materialise(kinds.groupBy("key").agg(F.count("*").alias("kinds")), "suffix-per-key")
    kinds = kinds.join(per_key, "key")
    out = kinds.where("known").select("key", "r", F.lit(0).cast("long").alias("s"), (F.col("size") - length).alias("e"))
    if not whole:
        compared = kinds.where("kinds > 1" if words else "kinds > 1 or not known")
        wanted = materialise(compared.select("key", "r", "owner", "kinds", "u1", "u2", "at", "bytes"), "suffix-wanted")
        total = wanted.agg(F.sum("bytes")).first()[0] or 0
        if total:
            sources = wanted.select(F.xxhash64("u1", "u2").alias("a"), F.xxhash64("u2", "u1").alias("b")).distinct()
            near = BlockedBloom.of(sources, "a", "b").maybe(F.xxhash64("u1", "u2"), F.xxhash64("u2", "u1"))
            part = F.substring(F.col("text").cast("binary"), F.col("at").cast("int") + 1, F.col("bytes").cast("int"))
            texts = units.where(near).select("u1", "u2", "text").join(wanted, ["u1", "u2"]).select("key", "r", "owner", "kinds", part.alias("text"))
            texts = materialise(texts.dropDuplicates(["key", "r"]), "suffix-texts")
            hot = F.col("kinds") > HOT_KINDS
            out = out.unionByName(sorted_repeats(texts.where(~hot), length, int(max(1, -(-total // SHARD_BYTES))), words))
            if not texts.where(hot).isEmpty():
                inner = repeats(texts.where(hot).select(F.col("key").alias("u1"), F.col("r").alias("u2"), "owner", "text"), length, deeper, words)
                out = out.unionByName(inner.select(F.col("u1").alias("key"), F.col("u2").alias("r"), "s", "e"))
    out = materialise(out, "suffix-repeats")
    return found.join(out, ["key", "r"]).select("u1", "u2", (F.col("lo") + F.col("s")).alias("s"), (F.col("lo") + F.col("e")).alias("e"))


def cut(docs: DataFrame, length: int) -> DataFrame:
    """From doc_id, text, hits (arrays of s and e) and passage to n_bytes, n_removed, spans, the bytes that stay and passage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 250_000):
            raw, offsets = utf8(batch.column("text"))
            kept, spans, n_bytes, removed = [], [], [], []
            for i, (s, e) in enumerate(zip(batch.column("s").to_pylist(), batch.column("e").to_pylist())):
                own, runs = raw[offsets[i] : offsets[i + 1]], []
                for a, b in sorted(zip(s or (), e or ())):
                    b += length
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(b, runs[-1][1])
                    else:
                        runs.append([a, b])
                at = [0, *(x for run in runs for x in run), len(own)]
                kept.append(b"".join(own[at[j] : at[j + 1]].tobytes() for j in range(0, len(at), 2)))
                spans.append([{"start": a, "end": b} for a, b in runs])
                n_bytes.append(len(own))
                removed.append(sum(b - a for a, b in runs))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()), batch.column("repeats")], names=["doc_id", "n_bytes", "n_removed", "spans", "kept", "repeats"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, spans array<struct<start:bigint,end:bigint>>, kept binary, repeats boolean")


def suffix_dedup(docs: DataFrame, length: int = LENGTH, anchors: tuple[int, ...] = ANCHORS, passage: int | None = PASSAGE, word_anchors: tuple[int, ...] = WORD_ANCHORS) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (removed runs, in bytes), kept (the other bytes) and repeats of every row.

    repeats: whether `passage` words in a row also stand in another document (white space between them is not
    compared); false throughout where passage is None. Needs doc_id and text; other columns are not read. Null
    and empty texts have no bytes. Texts shorter than length keep everything, very long ones are whole. Equal rows are
    each other's copies and lose all their windows, but are one document for repeats. Ties need no rule: all
    places of a repeated string lose it. Strings are judged on the input, not on what is left. An empty table
    gives an empty result. The last of anchors must be length, that of word_anchors passage.
    """
    docs = docs.select("doc_id", text_of().alias("text"))
    both = F.struct("doc_id", "text")
    units = docs.select("doc_id", "text", F.xxhash64(F.lit(1), "doc_id").alias("u1"), F.xxhash64(F.lit(2), both).alias("u2"))
    units = units.withColumn("owner", F.xxhash64("u1", "u2"))
    hits = repeats(units, length, anchors).select("u1", "u2", "s", "e", F.lit(False).alias("repeats"))
    if passage:
        none = F.lit(None).cast("long")
        hits = hits.unionByName(repeats(units, passage, word_anchors, True).select("u1", "u2", none.alias("s"), none.alias("e"), F.lit(True).alias("repeats")))
    hits = materialise(hits.distinct().groupBy("u1", "u2").agg(F.collect_list("s").alias("s"), F.collect_list("e").alias("e"), F.max("repeats").alias("repeats")), "suffix-hits")
    near = BlockedBloom.of(hits.select(F.xxhash64("u1", "u2").alias("a"), F.xxhash64("u2", "u1").alias("b")), "a", "b")
    units = units.withColumn("near__", near.maybe(F.xxhash64("u1", "u2"), F.xxhash64("u2", "u1")))
    none = F.array().cast("array<bigint>")
    clean = units.where("not near__").select("doc_id", "text", none.alias("s"), none.alias("e"), F.lit(False).alias("repeats"))
    touched = units.where("near__").join(hits, ["u1", "u2"], "left").select("doc_id", "text", "s", "e", F.coalesce("repeats", F.lit(False)).alias("repeats"))
    return cut(clean.unionByName(touched), length)


def op1_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    found = suffix_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "repeats")
