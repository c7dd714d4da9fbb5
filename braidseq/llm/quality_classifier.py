"""A quality classifier by co-training.

Two logistic regressions see a document from two sides: what its text says (letters and hashed words), and its
page metadata (lang, source, length, and how the page is laid out in lines). In each round both score all
documents, and each hands the other, as labelled, those it is surer of than the other by the widest margins, a
row of features each. Such labels count by how much of the labels kept aside their view explains and the other
does not. Outputs are calibrated on labelled documents kept aside and combined to score all documents.
The labelled sample is bounded; rounds pass over all documents and keep the best so many of every
task, so that what reaches the driver is bounded and nothing is left out of the search.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import keep_only, materialise, mix64, ngram_hashes, repeated, small_batches, span_hashes, table, utf8, word_spans

LABELLED, ROUNDS, PER_ROUND = 4000, 2, 200
WORD_CELLS, META_CELLS, SHAPES, LINES = 256, 64, 12, 10
META = META_CELLS + 32 + LINES
KEEP_FROM, SHARDS = 0.5, 64


def text_features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Shape measures between 0 and 1 and shares of hashed words, a row per text."""
    n = len(offsets) - 1
    starts, ends, of = word_spans(raw, offsets)
    out = np.zeros((n, SHAPES + WORD_CELLS), np.float32)
    size = np.maximum(np.diff(offsets), 1)
    share = lambda mask: np.diff(np.append(0, np.cumsum(mask))[offsets]) / size
    words = np.bincount(of, minlength=n)
    many = np.maximum(words, 1)
    out[:, 0] = share((raw >= 65) & (raw <= 90))
    out[:, 1] = share((raw >= 97) & (raw <= 122))
    out[:, 2] = share((raw >= 48) & (raw <= 57))
    out[:, 3] = share(np.isin(raw, np.frombuffer(b"#*$%&|<>{}[]=~^\\/@", np.uint8)))
    out[:, 4] = share(np.isin(raw, np.frombuffer(b"!?", np.uint8)))
    out[:, 5] = share(np.isin(raw, np.frombuffer(b".,;:", np.uint8)))
    out[:, 6] = share(raw == 10)
    out[:, 7] = share(raw >= 128)
    out[:, 8] = np.minimum(1, np.bincount(of, ends - starts, n) / many / 20)
    out[:, 9] = np.minimum(1, np.log1p(words) / 12)
    hashes = span_hashes(raw, starts, ends)
    if len(hashes) > 1:
        out[:, 10] = np.bincount(of[1:][(hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])], minlength=n) / many
        keys, at = ngram_hashes(hashes, of, 3)
        again = at[repeated(keys ^ mix64(of[at].astype(np.uint64) + np.uint64(1)))]
        out[:, 11] = np.bincount(of[again], minlength=n) / many
    cells = np.bincount(of * WORD_CELLS + (hashes % np.uint64(WORD_CELLS)).astype(np.int64), minlength=n * WORD_CELLS).reshape(n, WORD_CELLS)
    out[:, SHAPES:] = np.sqrt(cells / many[:, None])
    return out


def line_features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How texts are laid out in lines, between 0 and 1, a row per text: number and mean length of lines, shares of
    empty, short, long and repeated ones and of those that end a sentence, evenness, and the longest one."""
    n = len(offsets) - 1
    out = np.zeros((n, LINES), np.float32)
    feeds = np.flatnonzero(raw == 10)
    ends = np.concatenate([feeds, offsets[1:]])
    of = np.concatenate([np.searchsorted(offsets, feeds, "right") - 1, np.arange(n)])
    order = np.lexsort((ends, of))
    ends, of = ends[order], of[order]
    first = np.append(True, of[1:] != of[:-1]) if len(of) else np.zeros(0, bool)
    starts = np.where(first, offsets[of], np.append(0, ends[:-1] + 1))
    size = ends - starts
    count = np.bincount(of, minlength=n)
    mean = np.bincount(of, size, n) / np.maximum(count, 1)
    share = lambda mask: np.bincount(of, mask, n) / np.maximum(count, 1)
    last = raw[np.maximum(ends - 1, 0)] if len(raw) else np.zeros(len(ends), np.uint8)
    keys = span_hashes(raw, starts, ends) ^ mix64(of.astype(np.uint64) + np.uint64(1))
    out[:, 0] = np.minimum(1, np.log1p(count) / 10)
    out[:, 1] = np.minimum(1, np.log1p(mean) / 12)
    out[:, 2] = share(size == 0)
    out[:, 3] = share((size > 0) & (size < 30))
    out[:, 4] = share(size > 200)
    out[:, 5] = share(repeated(keys) & (size > 0))
    out[:, 6] = share((size > 0) & np.isin(last, np.frombuffer(b".!?:", np.uint8)))
    out[:, 7] = np.minimum(1, np.sqrt(np.bincount(of, (size - mean[of]) ** 2, n) / np.maximum(count, 1)) / (mean + 1) / 4)
    longest = np.zeros(n)
    np.maximum.at(longest, of, size)
    out[:, 8] = np.minimum(1, np.log1p(longest) / 12)
    out[:, 9] = count == 1
    return out


def meta_features(lang: list, source: list, n_chars: list, lines: np.ndarray) -> np.ndarray:
    """Hashed lang and source, a one-hot of the length's magnitude, and the lines' layout; a null is a value of its own."""
    out = np.zeros((len(lang), META), np.float32)
    for i, (a, b, c) in enumerate(zip(lang, source, n_chars)):
        out[i, zlib.crc32(f"lang {a}".encode()) % META_CELLS] += 1
        out[i, zlib.crc32(f"source {b}".encode()) % META_CELLS] += 1
        out[i, META_CELLS + (31 if c is None else min(30, int(2 * np.log10(max(c, 0) + 1))))] = 1
    out[:, META_CELLS + 32 :] = lines
    return out


class Logistic:
    """L2 logistic regression by Newton steps on weighted rows, classes balanced."""

    def __init__(self, l2: float = 1.0):
        self.l2 = l2

    def fit(self, x: np.ndarray, y: np.ndarray, trust: np.ndarray, steps: int = 12) -> Logistic:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        z = np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))]).astype(np.float64)
        positive, total = max(1e-6, float(trust[y > 0].sum())), float(trust.sum())
        weight = trust * np.where(y > 0, total / (2 * positive), total / (2 * max(1e-6, total - positive)))
        self.w = np.zeros(z.shape[1])
        ridge = np.full(z.shape[1], self.l2)
        ridge[-1] = 1e-6
        for _ in range(steps):
            p = sigmoid(z @ self.w)
            gradient = z.T @ (weight * (p - y)) + ridge * self.w
            step = np.linalg.solve((z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(ridge), gradient)
            self.w -= step
            if np.abs(step).max() < 1e-4:
                break
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.w[:-1] + self.w[-1]


def calibrate(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's a, b with P(y) = 1 / (1 + exp(-(a raw + b))), by clipped Newton steps with a weak prior towards a = 1 / std."""
    scale = float(raw.std()) or 1.0
    x, a, b = raw / scale, 1.0, 0.0
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    for _ in range(60):
        p = sigmoid(a * x + b)
        g = np.array([((p - t) * x).sum() + 0.1 * (a - 1), (p - t).sum()])
        w = p * (1 - p)
        h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a / scale), float(b)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class CoTrained:
    """views: a pair of Logistic; platt: (a, b) of each; weights: the share of each in the combined logit."""

    def __init__(self, views: list[np.ndarray], y: np.ndarray):
        aside = np.arange(len(y)) % 5 == 4
        if len(set(y[aside])) < 2 or len(set(y[~aside])) < 2:
            aside = np.zeros(len(y), bool)
        held = aside if aside.any() else np.ones(len(y), bool)
        self.held, self.y = [v[held] for v in views], y[held]
        self.own, self.labels = [[v[~aside]] for v in views], [[y[~aside]], [y[~aside]]]
        self.trust = [[np.ones(int((~aside).sum()))] for _ in views]

    def fit(self) -> CoTrained:
        self.views = [Logistic().fit(*(np.concatenate(rows[k]) for rows in (self.own, self.labels, self.trust))) for k in (0, 1)]
        raws = [v.raw(x) for v, x in zip(self.views, self.held)]
        self.platt = [calibrate(r, self.y) for r in raws]
        # a view counts by how much of the labels' entropy it explains on the documents kept aside
        rate = min(max(self.y.mean(), 1e-3), 1 - 1e-3)
        base = -(rate * np.log(rate) + (1 - rate) * np.log(1 - rate))
        gains = []
        for r, (a, b) in zip(raws, self.platt):
            p = np.clip(sigmoid(a * r + b), 1e-6, 1 - 1e-6)
            gains.append(max(0.0, 1 + (self.y * np.log(p) + (1 - self.y) * np.log(1 - p)).mean() / base))
        self.gains, self.weights = gains, [g / sum(gains) if sum(gains) else 0.5 for g in gains]
        return self

    def learn(self, view: int, features: np.ndarray, y: np.ndarray) -> None:
        """Take documents that the other view has labelled; they count by how much that one explains and this does not."""
        self.own[view].append(features)
        self.labels[view].append(y)
        self.trust[view].append(np.full(len(y), max(self.gains[1 - view] * (1 - self.gains[view]), 1e-3)))

    def lean(self) -> CoTrained:
        """Without the training rows, to be sent to executors."""
        out = object.__new__(CoTrained)
        out.views, out.platt, out.weights = self.views, self.platt, self.weights
        return out

    def logits(self, views: list[np.ndarray]) -> list[np.ndarray]:
        return [np.clip(a * v.raw(x) + b, -30, 30) for v, x, (a, b) in zip(self.views, views, self.platt)]

    def scores(self, views: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        logits = self.logits(views)
        return sigmoid(logits[0]), sigmoid(logits[1]), sigmoid(sum(w * z for w, z in zip(self.weights, logits)))


def batch_views(batch: pa.RecordBatch) -> list[np.ndarray]:
    raw, offsets = utf8(batch.column("text"))
    return [text_features(raw, offsets), meta_features(*(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")), line_features(raw, offsets))]


def gather(docs: DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """Both views and the labels of a bounded sample, to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            a, b = batch_views(batch)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(a)), pa.array(list(b)), batch.column("quality").cast(pa.int32())], names=["doc_id", "a", "b", "y"])

    rows = docs.mapInArrow(run, "doc_id long, a array<float>, b array<float>, y int").toPandas().sort_values("doc_id")
    shape = lambda c, width: np.array(rows[c].tolist(), np.float32).reshape(len(rows), width)
    return [shape("a", SHAPES + WORD_CELLS), shape("b", META)], rows["y"].fillna(0).to_numpy(np.float64)


PICK = "kind int, rank double, doc_id long, features binary"


def surest(docs: DataFrame, model: CoTrained, taken, per_round: int) -> DataFrame:
    """(kind, rank, doc_id, features): the documents that either view is surer of than the other, by the widest
    margins, per_round of each kind at most.

    kind: twice the view that judges, and 1 for good; features: those of the other view. Every task keeps its best
    of a kind, shards of these are ranked next, and the best of all shards last; ties go by doc_id.
    taken: a broadcast of the ids that are labelled already; repeats of a doc_id count once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.lean())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("quality_classifier")
        best: list[dict[int, tuple[float, bytes]]] = [{} for _ in range(4)]
        for batch in small_batches(batches):
            views, ids = batch_views(batch), batch.column("doc_id").to_numpy()
            free = ~np.isin(ids, taken.value)
            logits = shared.value.logits(views)
            for view, z in enumerate(logits):
                for good in (0, 1):
                    ahead = (z if good else -z) - np.abs(logits[1 - view])  # calibrated, so the two can be compared
                    rank, kept = np.where(free & (ahead > 0), -ahead, np.inf), best[2 * view + good]
                    for i in np.lexsort((ids, rank))[:per_round]:
                        if np.isfinite(rank[i]) and (int(ids[i]) not in kept or kept[int(ids[i])][0] > rank[i]):
                            kept[int(ids[i])] = (float(rank[i]), views[1 - view][i].astype(np.float16).tobytes())
                    if len(kept) > 4 * per_round:
                        best[2 * view + good] = dict(sorted(kept.items(), key=lambda x: (x[1][0], x[0]))[:per_round])
        rows = [(k, r, d, f) for k, kept in enumerate(best) for d, (r, f) in sorted(kept.items(), key=lambda x: (x[1][0], x[0]))[:per_round]]
        if rows:
            kind, rank, ids, features = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(rank), pa.array(ids, pa.int64()), pa.array(features, pa.binary())], names=["kind", "rank", "doc_id", "features"])

    found = docs.where("doc_id is not null").select("doc_id", "text", "lang", "source", "n_chars").mapInArrow(run, PICK)
    by = ("rank", "doc_id")
    once = found.groupBy("kind", "doc_id").agg(F.min(F.struct("rank", "features")).alias("x")).select("kind", "doc_id", "x.*")
    once = once.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS)))
    once = once.withColumn("n", F.row_number().over(Window.partitionBy("kind", "shard").orderBy(*by))).where(F.col("n") <= per_round)
    return once.withColumn("n", F.row_number().over(Window.partitionBy("kind").orderBy(*by))).where(F.col("n") <= per_round).select("kind", "rank", "doc_id", "features")


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, per_round: int = PER_ROUND) -> CoTrained | None:
    """Fit on at most `labelled` labelled documents and, in each of `rounds` rounds, on per_round good and bad ones of
    all others that either view puts forward (fewer, where there are less than 20 times as many documents); None without both classes."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = materialise(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled), "quality-labels")
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    views, y = gather(docs.join(F.broadcast(chosen), "doc_id").select(*columns, "quality").dropDuplicates(["doc_id"]))
    if len(set(y)) < 2:
        return None
    model = CoTrained(views, y).fit()
    taken = np.array([r.doc_id for r in chosen.select("doc_id").collect()], np.int64)
    for _ in range(rounds):
        share = max(1, min(per_round, docs.count() // 20))
        picked = surest(docs, model, docs.sparkSession.sparkContext.broadcast(taken), share).orderBy("kind", "rank", "doc_id").toPandas()
        seen: set[int] = set()
        for kind, rows in picked.groupby("kind"):
            rows = rows[~rows["doc_id"].isin(seen)]  # what both views pick goes to the first of them alone
            seen |= set(rows["doc_id"])
            view, good = 1 - kind // 2, kind % 2
            if len(rows):
                model.learn(view, np.stack([np.frombuffer(f, np.float16).astype(np.float32) for f in rows["features"]]), np.full(len(rows), float(good)))
        taken = np.union1d(taken, np.array(sorted(seen), np.int64))
        model.fit()
    return model


def classify(docs: DataFrame, model: CoTrained | None, keep_from: float = KEEP_FROM) -> DataFrame:
    """doc_id, text_score, meta_score, score (probability of good quality) and kept of every row.

    Needs doc_id, text, lang, source and n_chars; other columns are not read. Nulls are an empty text or
    a value of their own. Without a model every score is 0.5. Equal rows are scored each and alike, very long texts
    whole; an empty table gives an empty result. A score of keep_from itself is kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model and model.lean())
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("quality_classifier")
        for batch in small_batches(batches):
            if shared.value is None:
                found = (np.full(batch.num_rows, 0.5),) * 3
            else:
                found = shared.value.scores(batch_views(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(np.asarray(x, np.float64)) for x in found), pa.array(np.asarray(found[2]) >= keep_from)], names=["doc_id", "text_score", "meta_score", "score", "kept"])

    return docs.select("doc_id", "text", "lang", "source", "n_chars").mapInArrow(run, f"doc_id {kind}, text_score double, meta_score double, score double, kept boolean")


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, train(docs, table(spark, sf_dir, "labels")))
