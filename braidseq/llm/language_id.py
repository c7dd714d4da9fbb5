"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word
is the sum over all its segmentations into pieces, found by a forward pass; a text's score is the sum of
its words' log probabilities. Piece probabilities are fitted by expectation-maximisation with the same
passes, from a bounded number of labelled documents of each language, whole. Text is scored whole, and words of any
length over all their segmentations; a distinct word is scored once per worker as long as its bounded memory has room.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import BASE, keep_only, small_batches, table, worker_memory

PIECES = "piece_bpe_32k.model"
TRAIN_DOCS, ROUNDS = 400, 2
SMOOTH, UNKNOWN, REMEMBER, RESCALE = 0.05, 1e-8, 300_000, 8
RUN = re.compile(r"[^\W\d_]+")
SPLIT = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1C}-\x{1F}]+"


def vocabulary(path: str | None = None) -> dict[str, int]:
    """The pieces that letters can form, with or without the mark of a word's start, numbered from 0."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(PIECES))
    found = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    letters = sorted({p.lower() for p in found if p.strip("▁").isalpha()} | {"▁"})
    return {p: i for i, p in enumerate(letters)}


def runs_of(word: str) -> list[str]:
    """The letter runs of a word in lower case, each with the mark of a start. Letters are those of Unicode's
    category L: numerals such as ½ or Ⅷ are none."""
    found = []
    for run in RUN.findall(word.lower()):
        found += [run] if run.isalpha() else ["".join(part) for letters, part in groupby(run, str.isalpha) if letters]
    return ["▁" + run for run in found]


def lattice(run: str, pieces: dict[str, int], longest: int) -> list[list[tuple[int, int]]]:
    """For each end, the (start, piece) of the pieces that end there; a lone unknown letter is piece -1."""
    ends: list[list[tuple[int, int]]] = [[] for _ in range(len(run) + 1)]
    get = pieces.get
    for i in range(len(run)):
        for j in range(i + 1, min(len(run), i + longest) + 1):
            k = get(run[i:j])
            if k is not None:
                ends[j].append((i, k))
            elif j == i + 1:
                ends[j].append((i, -1))
    return ends


def forward(ends: list[list[tuple[int, int]]], p) -> tuple[list[float], list[float]]:
    """Probability of each prefix, summed over its segmentations, with each divided by the product of the scales
    up to it; the scales keep long runs from vanishing."""
    a, scale = [1.0], [1.0]
    for j in range(1, len(ends)):
        total, over, at = 0.0, 1.0, j
        for i, k in sorted(ends[j], reverse=True):
            while at > i + 1:
                at -= 1
                over *= scale[at]
            total += a[i] / over * (p[k] if k >= 0 else UNKNOWN)
        a.append(1.0)
        scale.append(total)
    return a, scale


def fit(counts: Counter, pieces: dict[str, int], rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities of a language from its word counts."""
    longest = max(map(len, pieces), default=1)
    runs = Counter()
    for word, n in counts.items():
        for run in runs_of(word):
            runs[run] += n
    lattices = {run: lattice(run, pieces, longest) for run in runs}
    p = [1.0 / len(pieces)] * len(pieces)
    for _ in range(rounds):
        expected = [SMOOTH] * len(pieces)
        for run, n in runs.items():
            ends = lattices[run]
            scale = forward(ends, p)[1]
            # with every prefix scaled to 1, b[j] is the probability of what follows j over that of the rest of the scales
            b = [0.0] * len(run) + [1.0]
            for j in range(len(run), 0, -1):
                over, at = scale[j], j
                for i, k in sorted(ends[j], reverse=True):
                    while at > i + 1:
                        at -= 1
                        over *= scale[at]
                    w = (p[k] if k >= 0 else UNKNOWN) / over * b[j]
                    b[i] += w
                    if k >= 0:
                        expected[k] += n * w
        total = sum(expected)
        p = [x / total for x in expected]
    return np.array(p)


def train(docs: DataFrame, docs_per_lang: int = TRAIN_DOCS, path: str | None = None) -> tuple[list[str], dict[str, int], np.ndarray]:
    """(languages, pieces, probabilities) from docs_per_lang whole documents of each language, the first by a hash of
    doc_id: a bound of the fit alone, at any corpus size. Every value of lang is learned. Executors count the
    words; the driver gets the distinct ones of the sample."""
    labelled = docs.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("doc_id").alias("h"))
    sizes = [(r[0], r[1]) for r in labelled.groupBy("lang").count().collect()]
    langs = sorted(lang for lang, _ in sizes)
    # most documents of a large language are left out by their hash alone, before anything is ranked
    shares = docs.sparkSession.createDataFrame([(lang, min(1.0, 4 * docs_per_lang / n)) for lang, n in sizes], "lang string, share double")
    near = labelled.join(F.broadcast(shares), "lang").where((F.col("h") / 2.0**64 + 0.5) <= F.col("share")).select("lang", "h", "text")
    sample = near.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= docs_per_lang)
    words = sample.select("lang", F.explode(F.split("text", SPLIT)).alias("word")).where("word <> ''").groupBy("lang", "word").count()
    counts: dict[str, Counter] = {lang: Counter() for lang in langs}
    for row in words.toLocalIterator():
        counts[row.lang][row.word] += row["count"]
    pieces = vocabulary(path)
    return langs, pieces, np.array([fit(counts[lang], pieces) for lang in langs]).reshape(len(langs), len(pieces))


class PieceTable:
    """Finds pieces by 64-bit hashes of their letters, many places at a time; what collides goes to a further table."""

    SLOTS = 1 << 18

    def __init__(self, pieces: dict[str, int]):
        names = sorted(pieces, key=pieces.__getitem__)
        text = np.frombuffer("".join(names).encode("utf-32-le"), "<u4")
        ends = np.cumsum([len(p) for p in names]) if names else np.zeros(0, np.int64)
        self.longest = max(map(len, names), default=1)
        keys = np.zeros(len(names), np.uint64)
        for k, (end, name) in enumerate(zip(ends, names)):
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for c in text[end - len(name) : end]:
                    h = h * np.uint64(BASE) + np.uint64(c) + np.uint64(1)
            keys[k] = h
        self.missing, self.tables = len(names), []
        left = np.arange(len(names))
        while len(left):
            slot = self._slot(keys[left], len(self.tables))
            _, first = np.unique(slot, return_index=True)
            table_keys, table_ids = np.zeros(self.SLOTS, np.uint64), np.full(self.SLOTS, self.missing, np.int32)
            table_keys[slot[first]], table_ids[slot[first]] = keys[left[first]], left[first]
            self.tables.append((table_keys, table_ids))
            left = np.delete(left, first)

    def _slot(self, keys: np.ndarray, nth: int) -> np.ndarray:
        return ((keys * np.uint64(0x9FB21C651E98DF25 + 2 * nth)) >> np.uint64(46)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), self.missing, np.int32)
        for nth, (table_keys, table_ids) in enumerate(self.tables):
            slot = self._slot(keys, nth)
            hit = (table_keys[slot] == keys) & (table_ids[slot] < self.missing)
            out[hit] = table_ids[slot[hit]]
        return out


class Scorer:
    """Log probabilities of words in every language. Its memory of words and runs stops growing at REMEMBER
    each; what is not remembered is scored again."""

    def __init__(self, langs: list[str], pieces: dict[str, int], p: np.ndarray):
        self.langs, self.pieces = langs, PieceTable(pieces)
        self.p = np.concatenate([p.T, np.zeros((1, len(langs))), np.full((1, len(langs)), UNKNOWN)])
        self.words: dict[str, int] = {}
        self.runs: dict[str, int] = {}
        self.word_rows, self.run_rows = np.zeros((0, len(langs))), np.zeros((0, len(langs)))

    def score_runs(self, runs: list[str]) -> np.ndarray:
        """The forward pass for many runs at a time: rows of log probabilities.

        Runs go from long to short, so that at each place those still going are the first rows; the last
        prefixes, as many as the longest piece has letters, are all that is kept, and are scaled now and then.
        """
        out = np.zeros((len(runs), len(self.langs)))
        if not runs:
            return out
        text = np.frombuffer("".join(runs).encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
        sizes = np.array(list(map(len, runs)))
        begins = np.cumsum(sizes) - sizes
        found, h = [], np.zeros(len(text), np.uint64)
        for width in range(1, self.pieces.longest + 1):
            if width > len(text):
                break
            h = h[: len(text) - width + 1] * np.uint64(BASE) + text[width - 1 :]
            ids = self.pieces.find(h)
            if width == 1:
                ids[ids == self.pieces.missing] = self.pieces.missing + 1  # a letter of its own
            found.append(ids)
        order = np.argsort(-sizes, kind="stable")
        begins, going = begins[order], np.searchsorted(-sizes[order], -np.arange(1, sizes.max() + 1), "right")
        ring = np.zeros((self.pieces.longest + 1, len(runs), len(self.langs)))
        ring[0] = 1
        scale = np.zeros((len(runs), len(self.langs)))
        for j in range(1, int(sizes.max()) + 1):
            n = int(going[j - 1])
            now = np.zeros((n, len(self.langs)))
            for width in range(1, min(j, len(found)) + 1):
                ids = found[width - 1][begins[:n] + j - width]
                hit = np.flatnonzero(ids != self.pieces.missing)
                if len(hit):
                    now[hit] += ring[(j - width) % len(ring), hit] * self.p[ids[hit]]
            ring[j % len(ring), :n] = now
            ended = int(going[j]) if j < len(going) else 0
            if ended < n:
                out[order[ended:n]] = np.log(np.maximum(now[ended:], 1e-300)) + scale[ended:n]
            if j % RESCALE == 0 and ended:
                most = np.maximum(ring[:, :ended].max(0), 1e-300)
                ring[:, :ended] /= most
                scale[:ended] += np.log(most)
        return out

    def _rows(self, fresh: list[str]) -> np.ndarray:
        split = [runs_of(w) for w in fresh]
        new = list({r for runs in split for r in runs} - self.runs.keys())
        rows = np.concatenate([self.run_rows, self.score_runs(new)])
        place = dict(zip(new, range(len(self.run_rows), len(rows))))
        if len(self.runs) < REMEMBER:
            self.runs.update(place)
            self.run_rows, place = rows, self.runs
        else:
            place = place | {r: self.runs[r] for runs in split for r in runs if r in self.runs}
        at = np.fromiter((place[r] for runs in split for r in runs), np.int64)
        of = np.repeat(np.arange(len(split)), list(map(len, split))) if split else np.zeros(0, np.int64)
        return np.stack([np.bincount(of, rows[at, k], len(fresh)) for k in range(len(self.langs))], 1) if self.langs else np.zeros((len(fresh), 0))

    def texts(self, texts: list[str]) -> Iterator[tuple[np.ndarray, bool]]:
        """(log probability per language, whether the text has a letter)."""
        split = [t.split() for t in texts]
        distinct = set().union(*split)
        fresh = list(distinct - self.words.keys())
        rows = np.concatenate([self.word_rows, self._rows(fresh)])
        place = dict(zip(fresh, range(len(self.word_rows), len(rows))))
        if len(self.words) < REMEMBER:
            self.words.update(place)
            self.word_rows, place = rows, self.words
        else:
            place |= {w: self.words[w] for w in distinct - place.keys()}
        for words, text in zip(split, texts):
            at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
            total = rows[at].sum(0)
            yield total, bool(total.any()) or any(c.isalpha() for c in text)


_scorers: dict[str, Scorer] = worker_memory.setdefault("language_id", {})


def identify(docs: DataFrame, model: tuple[list[str], dict[str, int], np.ndarray]) -> DataFrame:
    """doc_id, lang_pred and score of every row, from text alone.

    Needs doc_id and text; other columns are not read. Null texts and those without a letter are `und`
    with score 0. With no learned language every text is `und`. Equal rows are predicted each, very long texts and
    words are scored whole, and an empty table gives an empty result. score is the posterior of the
    predicted language under equal priors; ties go to the first language by name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind, key = docs.schema["doc_id"].dataType.simpleString(), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("language_id")
        if key not in _scorers:  # one scorer per Python worker, which lives through its tasks
            _scorers.clear()
            _scorers[key] = Scorer(*shared.value)
        scorer = _scorers[key]
        for batch in small_batches(batches, 2_000_000):
            pred, score = [], []
            for total, letters in scorer.texts([t or "" for t in batch.column("text").to_pylist()]):
                if not letters or not scorer.langs:
                    pred.append("und")
                    score.append(0.0)
                    continue
                best = int(total.argmax())
                pred.append(scorer.langs[best])
                score.append(float(1 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))  # a null id has no such remainder
    found = identify(docs, train(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
