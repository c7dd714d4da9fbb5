import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from braidseq.llm import language_id as L
from braidseq.llm import quality_classifier as Q

from .helpers import SCHEMA, awkward, clash, documents

VOICES = {"en": "the of and ing tion ly er th", "de": "der und ung keit sch ein ge ver", "fr": "le de eau tion ment que ère ais"}


def voice(rng, lang, n):
    return " ".join("".join(rng.choice(VOICES[lang].split()) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_forward_pass_sums_all_segmentations():
    pieces = {"▁": 0, "▁a": 1, "a": 2, "ab": 3, "b": 4, "▁ab": 5}
    p = np.array([0.1, 0.2, 0.15, 0.25, 0.1, 0.2])

    def every(run):
        if not run:
            return 1.0
        return sum((p[pieces[run[:j]]] if run[:j] in pieces else L.UNKNOWN if j == 1 else 0) * every(run[j:]) for j in range(1, len(run) + 1))

    for run in ("▁ab", "▁aab", "▁abx", "▁"):
        assert abs(np.prod(L.forward(L.lattice(run, pieces, 3), p)[1]) - every(run)) < 1e-15
    scorer = L.Scorer(["x"], pieces, p[None])
    runs = ["▁ab", "▁aab", "▁abx", "▁bbb", "▁"]
    assert np.allclose(np.exp(scorer.score_runs(runs))[:, 0], [every(r) for r in runs])


def test_long_runs_do_not_vanish_and_sum_all_segmentations():
    """A run of thousands of letters against a plain sum in exact fractions, which needs no scales."""
    from fractions import Fraction

    pieces = {"▁": 0, "▁a": 1, "a": 2, "ab": 3, "b": 4, "abab": 5}
    p = np.array([0.1, 0.2, 0.15, 0.25, 0.1, 0.2])
    run = "▁" + "ab" * 300 + "x" * 9
    a = [Fraction(1)]
    for j in range(1, len(run) + 1):
        parts = [(run[i:j], a[i]) for i in range(max(0, j - 4), j)]
        a.append(sum(b * Fraction(p[pieces[t]]) if t in pieces else b * Fraction(L.UNKNOWN) if len(t) == 1 else 0 for t, b in parts))
    want = math.log(a[-1].numerator) - math.log(a[-1].denominator)
    scored = L.Scorer(["x"], pieces, p[None]).score_runs(["▁a", run, "▁abab"])
    assert abs(scored[1, 0] - want) < 1e-6 * abs(want)
    assert abs(np.log(L.forward(L.lattice(run, pieces, 4), p)[1]).sum() - want) < 1e-6 * abs(want)


def test_numerals_are_no_letters(spark):
    assert L.runs_of("a½bⅧ") == ["▁a", "▁b"]
    pieces = L.vocabulary()
    model = (["en"], pieces, np.array([L.fit(Counter({"the": 3}), pieces, 1)]))
    texts = ["½", "²", "Ⅷ", "①", "½ ² 12", "x½", "the " * 3, "w" * 70_000]
    rows = {r.doc_id: r for r in L.identify(documents(spark, texts + texts[-2:-1]), model).collect()}
    assert [rows[i].lang_pred for i in range(9)] == ["und"] * 5 + ["en"] * 4
    assert rows[6].score == rows[8].score == 1.0


def test_fit_raises_the_likelihood():
    pieces = L.vocabulary()
    counts = Counter(voice(random.Random(1), "de", 400).split())
    total = []
    for rounds in (1, 3):
        p = L.fit(counts, pieces, rounds)
        assert abs(p.sum() - 1) < 1e-9
        total.append(sum(n * np.log(L.forward(L.lattice(r, pieces, 16), p)[1]).sum() for w, n in counts.items() for r in L.runs_of(w)))
    assert total[1] > total[0]


def test_languages_are_told_apart_without_leaks(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    langs = {d: rng.choice(list(VOICES)) for d in range(240)}
    texts = {d: voice(rng, lang, 40) for d, lang in langs.items()}
    odd = {300 + i: t for i, t in enumerate([None, "", "12 34 !!", "日本"])}
    docs = clash(documents(spark, texts | odd, lang=langs | dict.fromkeys(odd, None)))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in L.op4_language_id(spark, str(tmp_path)).collect()}
    assert len(got) == 244
    held = [d for d in langs if zlib.crc32(str(d).encode()) % 4 == 2]
    assert all(got[d].held_out == (d in set(held)) for d in langs)
    assert np.mean([got[d].lang_pred == langs[d] for d in held]) > 0.95
    assert [got[d].lang_pred for d in (300, 301, 302)] == ["und"] * 3 and got[303].lang_pred in VOICES
    assert all(0 <= r.score <= 1 for r in got.values())
    # labels of held-out documents change nothing
    wrong = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, "zz").otherwise(F.col("lang")))
    wrong.write.parquet(str(tmp_path / "b" / "documents.parquet"))
    again = {r.doc_id: r.lang_pred for r in L.op4_language_id(spark, str(tmp_path / "b")).collect()}
    assert again == {d: r.lang_pred for d, r in got.items()}


def test_a_full_memory_changes_no_score(monkeypatch):
    rng = random.Random(3)
    pieces = L.vocabulary()
    p = np.array([L.fit(Counter(voice(rng, lang, 100).split()), pieces, 1) for lang in VOICES])
    texts = [voice(rng, lang, 30) for lang in VOICES for _ in range(4)]
    want = [t for t, _ in L.Scorer(list(VOICES), pieces, p).texts(texts)]
    monkeypatch.setattr(L, "REMEMBER", 5)
    small = L.Scorer(list(VOICES), pieces, p)
    for at in range(0, len(texts), 3):
        for (t, _), w in zip(small.texts(texts[at : at + 3]), want[at : at + 3]):
            assert np.allclose(t, w)


def test_every_language_is_learned_and_not_from_headers_alone(spark, monkeypatch):
    monkeypatch.setattr(L, "fit", lambda counts, pieces, *_: np.full(len(pieces), float(counts["body"])))
    texts = {d: "header " * 20 + "body " * 200 for d in range(120)}
    langs, _, p = L.train(documents(spark, texts, lang={d: f"l{d:03}" for d in texts}), 5)
    assert langs == [f"l{d:03}" for d in range(120)]
    assert (p[:, 0] == 200).all()  # whole texts


def test_no_labels_and_empty_tables(spark):
    docs = documents(spark, ["hello there"], lang={0: None})
    model = L.train(docs)
    assert model[0] == [] and L.identify(docs, model).first().lang_pred == "und"
    assert L.identify(spark.createDataFrame([], SCHEMA), model).count() == 0


def quality_table(rng, n):
    texts, labels = {}, {}
    for d in range(n):
        good = rng.random() < 0.7
        text = voice(rng, "en", 60) + "."
        texts[d] = text if good else rng.choice([text.upper() + "!!", text.replace(" ", " | "), "go go go go " * 30])
        labels[d] = int(good)
    return texts, labels


def test_quality_classifier_on_held_out_labels(spark):
    rng = random.Random(5)
    texts, labels = quality_table(rng, 400)
    source = {d: "blog" if labels[d] ^ (rng.random() < 0.1) else "forum" for d in texts}
    docs = clash(documents(spark, texts | {1000 + i: t for i, t in enumerate(awkward(rng))}, source=source))
    known = spark.createDataFrame([(d, q, 0) for d, q in labels.items() if d % 2] + [(1, labels[1], 0), (None, 1, 0), (5000, 1, 0)], "doc_id long, quality int, toxic int")
    model = Q.train(docs, known, 150, 2, 20)
    rows = {r.doc_id: r for r in Q.classify(docs, model).collect()}
    assert len(rows) == 412 and all(0 <= r.score <= 1 for r in rows.values())
    held = [d for d in labels if d % 2 == 0]
    assert np.mean([rows[d].kept == bool(labels[d]) for d in held]) > 0.95
    auc = lambda c: np.mean([rows[a][c] > rows[b][c] for a in held if labels[a] for b in held if not labels[b]])
    assert auc("text_score") > 0.97 and auc("meta_score") > 0.7 and auc("score") > 0.97


def test_the_exchange_changes_and_improves_the_result(spark):
    """Few labels, and two views that say the same by different means: what one is sure of teaches the other."""
    rng = random.Random(9)
    texts, source, truth = {}, {}, {}
    good, bad = ([f"{w}{i}" for i in range(60)] for w in ("fair", "foul"))
    for d in range(1600):
        truth[d] = int(rng.random() < 0.5)
        words = [rng.choice((good if truth[d] else bad) if rng.random() < 0.12 else ["and", "the", "of", "to"]) for _ in range(60)]
        texts[d] = " ".join(words)
        source[d] = f"{'a' if truth[d] ^ (rng.random() < 0.08) else 'b'}{rng.randrange(12)}"
    docs = documents(spark, texts, source=source)
    known = spark.createDataFrame([(d, truth[d]) for d in range(60)], "doc_id long, quality int")
    right = {}
    for rounds in (0, 4):
        rows = Q.classify(docs, Q.train(docs, known, 100, rounds, 60)).collect()
        right[rounds] = [(r.text_score >= 0.5) == truth[r.doc_id] for r in rows if r.doc_id >= 60], [(r.meta_score >= 0.5) == truth[r.doc_id] for r in rows if r.doc_id >= 60], [r.kept == truth[r.doc_id] for r in rows if r.doc_id >= 60]
    before, after = ([np.mean(x) for x in right[n]] for n in (0, 4))
    print(before, after)
    assert right[0][1] != right[4][1] and right[0][2] != right[4][2]
    assert after[1] > before[1] + 0.05 and after[0] >= before[0] and after[2] > 0.97


def test_surest_documents_by_hand(spark):
    rng = random.Random(10)
    texts, labels = quality_table(rng, 120)
    docs = documents(spark, texts).repartition(5)
    docs = docs.unionByName(docs.where("doc_id < 10"))
    model = Q.train(docs, spark.createDataFrame(list(labels.items()), "doc_id long, quality int"), 60, 0)
    rows = {r.doc_id: r for r in Q.classify(docs, model).collect()}
    taken = np.arange(0, 120, 7)
    got = Q.surest(docs, model, spark.sparkContext.broadcast(taken), 9).collect()
    logit = lambda p: np.log(p / (1 - p))
    for kind in range(4):
        own, other = ("text_score", "meta_score")[:: 1 if kind < 2 else -1]
        ahead = [(logit(r[own]) if kind % 2 else -logit(r[own])) - abs(logit(r[other])) for d, r in rows.items() if d not in set(taken)]
        want = sorted((x for x in ahead if x > 0), reverse=True)[:9]
        mine = sorted((-r.rank for r in got if r.kind == kind), reverse=True)
        assert np.allclose(mine, want, atol=1e-4) and len({r.doc_id for r in got if r.kind == kind}) == len(mine)
    assert len(got) > 9


def test_quality_classifier_without_labels(spark):
    docs = documents(spark, ["a b c", None])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert Q.train(docs, none) is None
    assert [r.score for r in Q.classify(docs, None).collect()] == [0.5, 0.5]
    one = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    assert Q.train(docs, one) is None
    assert Q.classify(spark.createDataFrame([], SCHEMA), None).count() == 0


def test_views_do_not_depend_on_the_batch():
    texts = awkward(random.Random(7))
    whole = Q.text_features(*Q.utf8(pa.array(texts)))
    each = np.concatenate([Q.text_features(*Q.utf8(pa.array([t], pa.string()))) for t in texts])
    assert np.allclose(whole, each)
