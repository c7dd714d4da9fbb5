"""Best-fit packing by hierarchical residual merging.

Each partition tokenises its documents and packs its pieces best-fit decreasing; full and nearly full bins
are final. Underfull bins go up a tree as items: each node merges the bins of FAN_IN nodes best-fit
decreasing, until one node is left. After a best-fit pass at most one bin is at most half full, and only
such a bin can still join another, so a node needs at most FAN_IN hosts of each residual from a child; the
rest are final too. That bounds a node's rows by FAN_IN * (1 + FAN_IN * capacity / 2) at any corpus size.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import keep_only, materialise, small_batches, table, worker_memory

CAPACITY, END_ID, FAN_IN, NEARLY_FULL = 4096, 1, 16, 8
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Words(dict):
    """Remembered words, and beside them those of the slice at hand."""

    beside: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        return self.beside[word]


class WordEncoder:
    """Token ids of whole texts as little-endian uint32 bytes.

    The vocabulary's rules never look across white space: text is split there, so a text's ids are those
    of its words in order, and a distinct word is encoded once. Words of ASCII and Latin-1 letters are lower-cased and cut
    as the vocabulary does, and those parts, which recur more often than the words, are encoded many at a
    time. The rest goes to the tokenizer as it is. Both memories stop growing at a fixed number of
    entries; what is not remembered is encoded again.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = Words()
        self.parts: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, k in vocabulary.items():
            self.last[k] = token.endswith("</w>")

    def _encode_parts(self, parts: list[str]) -> dict[str, bytes]:
        found = {}
        for at in range(0, len(parts), 2000):
            some = parts[at : at + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(some):
                raise ValueError("a part of a word is not one part to the tokenizer")
            raw, cuts = ids.tobytes(), (4 * np.append(0, ends)).tolist()
            found.update(zip(some, map(raw.__getitem__, map(slice, cuts, cuts[1:]))))
        return found

    def _encode_words(self, fresh: set[str]) -> dict[str, bytes]:
        cut, odd, plain = {}, [], PLAIN.fullmatch
        for word in fresh:
            if word.isalpha() and (word.isascii() or plain(word)):
                cut[word] = (word.lower(),)
            elif "<|" not in word and plain(word):
                lower = word.lower()
                cut[word] = (lower[:-1], lower[-1]) if lower[-1] in ".,;:!?" and lower[:-1].isalpha() else PART.findall(lower)
            else:
                odd.append(word)
        new = self._encode_parts(list({p for parts in cut.values() for p in parts} - self.parts.keys()))
        if len(self.parts) < REMEMBER_PARTS:
            self.parts.update(new)
            of = self.parts.__getitem__
        else:
            of = lambda p: self.parts.get(p) or new[p]
        out = {word: of(parts[0]) if len(parts) == 1 else b"".join(map(of, parts)) for word, parts in cut.items()}
        for at in range(0, len(odd), 2000):
            for word, found in zip(odd[at : at + 2000], self.tokenizer.encode_batch_fast(odd[at : at + 2000], add_special_tokens=False)):
                out[word] = np.array(found.ids, "<u4").tobytes()
        return out

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        split = [_split(_lower(t)) for t in texts]
        distinct = set().union(*split)
        new = self._encode_words(distinct - self.words.keys())
        if len(self.words) < REMEMBER_WORDS:
            self.words.update(new)
            new = {}
        self.words.beside = new
        for words in split:
            yield b"".join(map(self.words.__getitem__, words))
        self.words.beside = {}


def _lower(text: str) -> str:
    """Lower case, as the vocabulary has it, for texts of Latin-1 characters alone, whose letters lower one to one."""
    if "<|" in text:  # a special token's spelling counts only as it is
        return text
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
    return text.lower()


def _split(text: str) -> list[str]:
    """Split at white space that every rule of the vocabulary treats as a border."""
    if (text.isascii() or not WIDE.search(text)) and not CONTROL.search(text):
        return text.split()
    return text.translate(BORDERS).split(" ")


#: Words of these characters only are lower-cased and cut here: printable ASCII and the letters of Latin-1.
PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: How the vocabulary cuts them once they are lower case.
PART = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
#: What str.split() takes for white space and the vocabulary may not.
CONTROL = re.compile("[\x1c-\x1f]")
WIDE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
BORDERS = dict.fromkeys(range(9, 14), " ")
REMEMBER_WORDS, REMEMBER_PARTS = 250_000, 350_000
_encoders: dict[str, WordEncoder] = worker_memory.setdefault("packing", {})


def encoder_of(path: str) -> WordEncoder:
    """One encoder per Python worker, which lives through its tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def pieces_of(ids: bytes, capacity: int = CAPACITY) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids."""
    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
        part = ids[at : at + 4 * capacity]
        yield k, at // 4, len(part) // 4, zlib.crc32(part)


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Best-fit decreasing: (bin, offset) of each item, and the fill of each bin. Ties go to the earlier item."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    fills: list[int] = []
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    residuals = 0  # bit r: some bin has r left
    for i in np.argsort(-np.asarray(sizes), kind="stable").tolist():
        size = int(sizes[i])
        fitting = residuals >> size
        if fitting:
            left = size + ((fitting & -fitting).bit_length() - 1)
            b = open_bins[left].pop()
            if not open_bins[left]:
                residuals &= ~(1 << left)
        else:
            b, left = len(fills), capacity
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        left -= size
        open_bins[left].append(b)
        residuals |= 1 << left
    return bins, offsets, fills


def going_up(fills: list[int], capacity: int = CAPACITY, fan_in: int = FAN_IN, nearly_full: int = NEARLY_FULL) -> np.ndarray:
    """Which bins a later round can still use: every one at most half full, fan_in of each other residual."""
    out, hosts = np.zeros(len(fills), bool), {}
    for b, fill in enumerate(fills):
        left = capacity - fill
        if left < nearly_full:
            continue
        if 2 * fill > capacity:
            hosts[left] = hosts.get(left, 0) + 1
            if hosts[left] > fan_in:
                continue
        out[b] = True
    return out


def local_pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, fan_in: int = FAN_IN) -> DataFrame:
    """Tokenise, cut and pack each input partition by itself."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, at long, node long, up long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("packing")
        encoder, end, node = encoder_of(path), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        docs_of, rows = [], []
        for batch in small_batches(batches, 3_000_000):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts)):
                for row in pieces_of(ids + end, capacity):
                    docs_of.append(doc)
                    rows.append(row)
        if not rows:
            return
        piece, start, length, crc = (np.array(x, np.int64) for x in zip(*rows))
        bins, offsets, fills = best_fit(length, capacity)
        up = np.where(going_up(fills, capacity, fan_in), fills, 0)[bins]  # the fill, where the bin goes on
        whole = [pa.array(docs_of, pa.int64()), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc), pa.array(bins + (node << 32)), pa.array(offsets), pa.array(np.full(len(bins), node)), pa.array(up)]
        out = pa.RecordBatch.from_arrays(whole, names=[x.split()[0] for x in schema.split(", ")])
        for at in range(0, out.num_rows, 50_000):
            yield out.slice(at, 50_000)

    return source.mapInArrow(run, schema)


def merge_node(capacity: int, fan_in: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values("bin", ignore_index=True)
        bins, offsets, fills = best_fit(items["fill"].to_numpy(), capacity)
        first = pd.Series(np.where(offsets == 0, items["bin"], -1)).groupby(bins).max().to_numpy()
        up = np.where(going_up(fills, capacity, fan_in), fills, 0)[bins]
        return pd.DataFrame({"bin": items["bin"], "into": first[bins], "at": offsets, "node": items["node"], "up": up})

    return run


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, fan_in: int = FAN_IN) -> DataFrame:
    """Pieces of all documents with the sequence and place of each.

    Needs doc_id (integers) and text; other columns are not read. A null or empty text is the end id
    alone. Equal rows are packed each. An empty table gives an empty one. Only documents of more than
    capacity ids are cut, however long; of bins with equal room the one filled last is taken. sequence_id is the partition times 2**32 plus a number.
    """
    local = materialise(local_pack(docs, path or tokenizer_path(), capacity, end_id, fan_in), "pack-local")
    level = local.where("at = 0 and up > 0").select("bin", F.col("up").alias("fill"), F.floor(F.col("node") / fan_in).alias("node"))
    moved = None
    while True:
        top = level.agg(F.max("node")).first()[0]
        if top is None:
            break
        merged = level.groupBy("node").applyInPandas(merge_node(capacity, fan_in), "bin long, into long, at long, node long, up long")
        merged = materialise(merged, "pack-merge")
        step = merged.where("bin <> into").select("bin", "into", "at")
        if moved is None:
            moved = step
        else:  # what went into a bin that has now moved itself moves along
            later = step.select(F.col("bin").alias("into"), F.col("into").alias("into2"), F.col("at").alias("at2"))
            moved = moved.join(later, "into", "left").select("bin", F.coalesce("into2", "into").alias("into"), (F.col("at") + F.coalesce("at2", F.lit(0))).alias("at")).unionByName(step)
            moved = materialise(moved, "pack-moved")
        if top == 0:
            break
        level = merged.where("at = 0 and up > 0").select(F.col("into").alias("bin"), F.col("up").alias("fill"), F.floor(F.col("node") / fan_in).alias("node"))
    if moved is None:
        return local.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
    placed = local.join(moved.withColumnRenamed("at", "more"), "bin", "left")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("into", "bin").alias("sequence_id"), (F.col("at") + F.coalesce("more", F.lit(0))).alias("offset"))


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def stage_packing(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all that is left, with null and empty texts, repeats and long texts as pack() has them."""
    return pack(docs)
