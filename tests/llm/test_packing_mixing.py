import random
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from braidseq.llm import mixing as M
from braidseq.llm import packing as K

from .helpers import SCHEMA, WORD, awkward, clash, documents, sentence


@pytest.fixture(scope="module")
def encoder():
    return K.WordEncoder(K.tokenizer_path())


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("aZ's.1 \n\t\x1c\x85é<|>ß"))))
def test_words_encode_as_whole_texts(encoder, text):
    got = np.frombuffer(next(encoder.encode([text])), "<u4").tolist()
    assert got == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_a_full_memory_changes_no_id(monkeypatch):
    monkeypatch.setattr(K, "REMEMBER_WORDS", 3)
    monkeypatch.setattr(K, "REMEMBER_PARTS", 3)
    e = K.WordEncoder(K.tokenizer_path())
    for text in ("one two three four", "five six one", "one ten, Twelve don't <|endoftext|>s", "one"):
        assert np.frombuffer(next(e.encode([text])), "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(sizes=st.lists(st.integers(1, 50), max_size=80))
def test_best_fit_bins(sizes):
    bins, offsets, fills = K.best_fit(np.array(sizes, np.int64), 50)
    used = {}
    for s, b, o in sorted(zip(sizes, bins.tolist(), offsets.tolist()), key=lambda x: x[2]):
        assert used.get(b, 0) == o
        used[b] = o + s
    assert all(f <= 50 for f in fills) and used == dict(enumerate(fills))
    assert sum(2 * f <= 50 for f in fills) <= 1  # any-fit: at most one bin is half empty


def check_packing(rows, lengths, capacity):
    per = {}
    for r in rows:
        per.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in per.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert sum(r.length for r in rows) == sum(lengths)
    return len(per)


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_packing_over_many_partitions(spark, encoder, parts):
    rng = random.Random(parts)
    texts = awkward(rng) + [sentence(rng, rng.choice([1, 10, 60, 150])) for _ in range(150)]
    docs = clash(documents(spark, texts)).repartition(parts)
    rows = K.pack(docs, capacity=256, fan_in=3).collect()
    ids = {i: encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}
    n = check_packing(rows, list(map(len, ids.values())), 256)
    assert n <= 1.03 * sum(map(len, ids.values())) / 256 + 1
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == 256 * r.piece and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    assert sorted((r.doc_id, r.piece) for r in rows) == [(i, k) for i in sorted(ids) for k in range(-(-len(ids[i]) // 256))]


def test_packing_of_large_items_and_empty_tables(spark):
    docs = documents(spark, [" ".join(["a"] * 150)] * 40).repartition(20)
    rows = K.pack(docs, capacity=256, fan_in=4).collect()
    assert check_packing(rows, [151] * 40, 256) == 40
    assert K.pack(spark.createDataFrame([], SCHEMA)).count() == 0
    twice = documents(spark, {1: "a"}).unionByName(documents(spark, {1: "a", None: "b"}))
    assert K.pack(twice).count() == 3


def test_bins_that_go_up_are_bounded():
    fills = [200] * 500 + [10, 256, 250]
    up = K.going_up(fills, 256, 4, 8)
    assert up.sum() == 5 and up[500] and not up[501] and not up[502]


def targets_by_hand(sizes, most=3):
    """Resharing the excess by weight, again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, free, left = {}, list(order), float(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if most * sizes[s] <= level * weight[s]]
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free = [s for s in free if s not in over]
    return target


def mixed_rows(spark, rng, n=200):
    texts = awkward(rng) + [sentence(rng, rng.randint(0, 300)) for _ in range(n)]
    names = ["a", "B", "é", None, "", "one"]
    source = {d: rng.choices(names, [60, 20, 10, 5, 4, 0])[0] for d in range(len(texts))} | {20: "one"}
    return texts, documents(spark, texts, source=source), source


@pytest.mark.parametrize(("block", "shard"), [(64, 1_000_000), (16, 2000), (1, 500), (5000, 10_000)])
def test_mixing_targets_and_bounds(spark, block, shard):
    texts, docs, source = mixed_rows(spark, random.Random(block))
    rows = M.mix(clash(docs), block, shard).collect()
    size = {d: len(WORD.findall(t or "")) for d, t in enumerate(texts)}
    totals = {}
    for d, s in source.items():
        totals[s] = totals.get(s, 0) + size[d]
    want = targets_by_hand(totals)
    taken = {}
    for r in rows:
        assert r.size == size[r.doc_id] and r.source_size == totals[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in taken.items():
        shards = -(-totals[s] // shard)
        assert abs(t - want[s]) <= block * (1 + shards) + 1
    again = {r.doc_id: r.taken for r in M.mix(docs.repartition(5), block, shard).collect()}
    assert again == {r.doc_id: r.taken for r in rows}


def test_apportionment_is_sainte_lague(spark):
    rng = random.Random(3)
    for seats in (0, 1, 7, 100):
        votes = {i: rng.choice([0, 1, 5, 53, 900, 2000]) for i in range(9)}
        df = spark.createDataFrame([(1, i, float(v), seats) for i, v in votes.items()], "g int, k int, v double, m long")
        got = {r.k: r.won for r in M.apportion(df, ["g"], "k", "v", "m", "won").collect()}
        quotients = sorted(((-v / (2 * j + 1), i, j) for i, v in votes.items() if v for j in range(seats + 1)))[:seats]
        assert got == {i: sum(q[1] == i for q in quotients) for i in votes}


def test_realised_mix_has_the_taken_words(spark):
    texts, docs, _ = mixed_rows(spark, random.Random(5), 60)
    plan = {r.doc_id: r for r in M.mix(docs, 16, 2000).collect()}
    out = {}
    for r in M.realise(M.mix(docs, 16, 2000), docs.columns, 16).collect():
        out[r.doc_id] = out.get(r.doc_id, 0) + len(WORD.findall(r.text))
        words, whole = WORD.findall(r.text), WORD.findall(texts[r.doc_id])
        it = iter(whole)
        assert all(w in it for w in words)
    assert out == {d: r.taken for d, r in plan.items() if r.taken}


def test_mixing_sql_ties_and_empty_tables(spark, tmp_path):
    _, docs, _ = mixed_rows(spark, random.Random(6), 80)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in M.op10_mixing(spark, str(tmp_path)).collect())
    assert got == sorted((a, b, c, round(d, 6), e) for a, b, c, d, e in con.execute(f"select doc_id, size, source_size, target, taken from ({M.SQL})").fetchall())
    twice = docs.unionByName(docs)
    assert M.mix(twice).count() == 2 * docs.count()
    assert M.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert M.mix(docs.where(F.col("text").isNull())).select("taken").distinct().collect()[0][0] == 0
