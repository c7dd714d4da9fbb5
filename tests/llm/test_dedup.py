import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidseq.llm import _external_suffixes as X
from braidseq.llm import fingerprints as P
from braidseq.llm import near_dedup as N
from braidseq.llm import suffix_dedup as D
from braidseq.llm._components import components

from .helpers import SCHEMA, WORD, awkward, clash, documents, sentence


def suffixes_by_hand(t, cap):
    order = sorted(range(len(t)), key=lambda i: t[i:])
    shared = [0] * len(t)
    for k in range(1, len(t)):
        a, b = order[k - 1], order[k]
        while shared[k] < cap and max(a, b) + shared[k] < len(t) and t[a + shared[k]] == t[b + shared[k]]:
            shared[k] += 1
    return order, shared


@pytest.mark.parametrize(("chunk", "small", "budget"), [(1 << 17, 1 << 12, 1 << 20), (7, 3, 0), (1 << 17, 2, 1 << 20), (40, 1, 0), (5, 1, 0)])
def test_suffix_arrays(monkeypatch, chunk, small, budget):
    """In memory and from disk, with deep recursion and with tiny chunks."""
    monkeypatch.setattr(X, "CHUNK", chunk)
    rng = random.Random(chunk + small)
    for _ in range(60):
        n, k = rng.randint(0, 90), rng.choice([1, 2, 3, 26, 200])
        t = [rng.randrange(k) for _ in range(n)]
        if n and rng.random() < 0.3:
            t = (t[: max(1, n // 5)] * 6)[:n]
        for carry in (True, False):
            space = X.Space(budget)
            order, shared = X.suffix_array(np.array(t, np.uint8), 256, 1000, space, small, carry)
            assert (list(order), list(shared)) == suffixes_by_hand(t, 1000)
            assert (space.on_disk > 0) == (budget == 0 and n > 0)
            space.close()


def test_suffix_sorter_reaches_disk_and_recursion_at_the_size_of_a_shard():
    """The query's own settings, against a set of the strings; mapped pages are given back meanwhile."""
    rng = np.random.default_rng(3)
    words = [bytes(rng.integers(97, 123, rng.integers(2, 9), np.uint8)) for _ in range(3000)]
    text = b" ".join(words[i] for i in rng.integers(0, 3000, D.SHARD_BYTES // 7))
    text += text[1000:31_000] + b"ab" * 3000
    space = X.Space()
    path = f"{space.folder.name}/text"
    with open(path, "wb") as file:
        file.write(text)
    hits = X.repeated_starts(space.open(path, np.uint8), 256, D.LENGTH, space)
    seen, want = {}, np.zeros(len(text), bool)
    for i in range(len(text) - D.LENGTH + 1):
        at = seen.setdefault(hash(text[i : i + D.LENGTH]), i)
        want[i] |= at != i
        want[at] |= at != i
    assert np.array_equal(np.array(hits, bool), want) and want.sum() > 60_000
    assert space.levels >= 2 and space.on_disk > 4 * len(text)
    space.close()


def removal_by_hand(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for d, t in enumerate(raw):
        for i in range(len(t) - length + 1):
            seen.setdefault(t[i : i + length], []).append((d, i))
    gone = [np.zeros(len(t), bool) for t in raw]
    for at in seen.values():
        if len(at) > 1:
            for d, i in at:
                gone[d][i : i + length] = True
    runs = [int((np.diff(np.concatenate([[0], g.astype(int), [0]])) == 1).sum()) for g in gone]
    return [(len(t), int(g.sum()), n, bytes(np.frombuffer(t, np.uint8)[~g])) for t, g, n in zip(raw, gone, runs)]


@pytest.mark.parametrize("hot", [4096, 1, 0])
def test_suffix_dedup_by_hand(spark, monkeypatch, hot):
    """hot: how many kinds of region an anchor may have before it is dealt out again."""
    monkeypatch.setattr(D, "HOT_KINDS", hot)
    rng = random.Random(hot)
    shared = [sentence(rng, 30) for _ in range(3)]
    texts = awkward(rng)[:7] + ["ab" * 200, "ab" * 150, "a" * 90, "é" * 100, sentence(rng, 300)]
    texts += [sentence(rng, rng.randint(0, 20)) + " " + rng.choice(shared) + " " + sentence(rng, rng.randint(0, 20)) for _ in range(25)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in D.suffix_dedup(clash(documents(spark, texts)), 60, (12, 50, 60)).collect()}
    want = removal_by_hand(texts, 60)
    assert [got[i] for i in range(len(texts))] == want
    assert sum(w[1] for w in want) > 1000


def passages_by_hand(texts, n):
    words = [WORD.findall(t or "") for t in texts]
    seen = {}
    for d, w in enumerate(words):
        for i in range(len(w) - n + 1):
            seen.setdefault(tuple(w[i : i + n]), set()).add(d)
    return [any(len(seen[tuple(w[i : i + n])]) > 1 for i in range(len(w) - n + 1)) for w in words]


@pytest.mark.parametrize("hot", [4096, 1, 0])
def test_passages_of_other_documents(spark, monkeypatch, hot):
    """A passage counts where another document has it, however its white space differs; one that repeats in its own document does not."""
    monkeypatch.setattr(D, "HOT_KINDS", hot)
    rng = random.Random(hot + 1)
    shared = [sentence(rng, 14) for _ in range(4)]
    inner = sentence(rng, 15)
    texts = awkward(rng)[:7] + [inner + " and " + inner, shared[0].replace(" ", " \n "), sentence(rng, 300)]
    texts += [sentence(rng, rng.randint(0, 20)) + " " + rng.choice(shared[1:]) + " " + sentence(rng, rng.randint(0, 20)) for _ in range(20)]
    texts += [shared[0] + " tail", sentence(rng, 40), sentence(rng, 11)]
    got = {r.doc_id: r.repeats for r in D.suffix_dedup(clash(documents(spark, texts)), 60, (12, 50, 60), 12, (4, 10, 12)).collect()}
    want = passages_by_hand(texts, 12)
    assert [got[i] for i in range(len(texts))] == want
    assert 20 < sum(want) < len(texts)


def test_suffix_dedup_of_repeated_rows_and_empty_tables(spark):
    docs = documents(spark, {1: "q" + "".join(map(str, range(100))), 2: None})
    twice = docs.unionByName(docs).unionByName(documents(spark, {None: "short"}))
    got = sorted((r.doc_id or 0, r.n_removed) for r in D.suffix_dedup(twice, 60, (12, 50, 60)).collect())
    assert got == [(0, 0), (1, 191), (1, 191), (2, 0), (2, 0)]
    assert D.suffix_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def jaccard(a, b):
    sets = []
    for t in (a, b):
        w = WORD.findall(t.lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return len(sets[0] & sets[1]) / max(1, len(sets[0] | sets[1]))


def test_near_dedup_finds_planted_copies(spark):
    rng = random.Random(4)
    texts, family = {}, {}
    for f in range(30):
        base = sentence(rng, 150, 5000).split()
        for c in range(rng.randint(1, 6)):
            words = list(base)
            for _ in range(c % 3):
                words[rng.randrange(len(words))] = f"new{rng.random()}"
            d = len(texts)
            texts[d], family[d] = " ".join(words), f
    got = {r.doc_id: (r.class_id, r.copy_of) for r in N.near_classes(clash(documents(spark, texts))).collect()}
    first = {f: min(d for d in family if family[d] == f) for f in set(family.values())}
    assert {d: c for d, (c, _) in got.items()} == {d: first[f] for d, f in family.items()}
    for d, (_, c) in got.items():
        assert c == min(e for e in texts if texts[e] == texts[d])


def classes_by_hand(texts, similarity=0.8):
    """Connected components of all pairs by the weighted Jaccard similarity of five-word shingles; a shingle weighs its
    count times the mean of ln((n + 1) / (df + 1)) + 1 over its words."""
    words = {d: WORD.findall("".join(c.lower() if c.isascii() else c for c in t or "")) for d, t in texts.items()}
    df = Counter(w for ws in words.values() for w in set(ws))
    idf = {w: np.log((len(texts) + 1) / (n + 1)) + 1 for w, n in df.items()}
    weights = {}
    for d, ws in words.items():
        grams = [tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))] if ws else []
        weights[d] = {g: n * np.mean([idf[w] for w in g]) for g, n in Counter(grams).items()}
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    close, ids = [], sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = weights[a], weights[b]
            both = sum(min(x[g], y[g]) for g in x.keys() & y.keys())
            like = both / (sum(x.values()) + sum(y.values()) - both) if x or y else 1.0
            close.append(abs(like - similarity) < 1e-4)
            if like >= similarity:
                a_, b_ = find(a), find(b)
                root[max(a_, b_)] = min(a_, b_)
    return {d: find(d) for d in texts}, any(close)


def test_near_dedup_against_all_pairs(spark):
    """Families edited more and more, on both sides of the threshold, in large buckets and small ones."""
    rng = random.Random(16)
    texts = {}
    for family in range(25):
        base = sentence(rng, rng.randint(4, 160), 300).split()
        for _ in range(rng.randint(1, 14)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                own[rng.randrange(len(own))] = f"edit{rng.randrange(10**6)}"
            texts[len(texts)] = " ".join(own)
    template = sentence(rng, 120, 300).split()
    for _ in range(40):  # half alike, with a few close pairs among them
        own = template[:60] + sentence(rng, 60, 10**6).split()
        texts[len(texts)] = " ".join(own)
        if rng.random() < 0.3:
            own[rng.randrange(120)] = "other"
            texts[len(texts)] = " ".join(own)
    texts |= {1000 + i: t for i, t in enumerate(awkward(rng))}
    want, unclear = classes_by_hand(texts)
    assert not unclear
    got = {r.doc_id: r.class_id for r in N.near_classes(documents(spark, texts)).collect()}
    assert got == want and 40 < len(set(want.values())) < len(texts) - 60


def test_near_dedup_large_family_and_awkward_rows(spark):
    rng = random.Random(6)
    base = sentence(rng, 200, 5000).split()
    texts = {0: " ".join(base)}
    for d in range(1, 60):  # more than a small bucket, each a little off the base
        words = list(base)
        words[rng.randrange(200)] = f"x{d}"
        texts[d] = " ".join(words)
    texts |= {100 + i: t for i, t in enumerate(awkward(rng))}
    docs = documents(spark, texts)
    both = docs.unionByName(docs.where("doc_id = 3")).unionByName(documents(spark, {None: "null id"}))
    rows = N.near_classes(both).collect()
    got = {r.doc_id: r.class_id for r in rows}
    assert len(rows) == len(texts) + 1 and got[None] is None
    assert {got[d] for d in range(60)} == {0}
    assert got[100] == got[101] == got[102] == got[109] == 100  # texts without words
    assert got[105] == got[106] == 105 and got[107] == 107
    kept = N.stage_near_dedup(spark, both, "")
    assert kept.columns == docs.columns and kept.where("doc_id < 60").count() == 1 and kept.where("doc_id is null").count() == 1
    assert N.near_classes(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("block_words", [1 << 20, 3000])
def test_near_dedup_hub_with_a_late_id(spark, monkeypatch, block_words):
    """Copies that are alike enough to their original but not to one another, the original last; and a lone pair among half-alike texts."""
    monkeypatch.setattr(N, "BLOCK_WORDS", block_words)
    rng = random.Random(9)
    base = sentence(rng, 200, 5000).split()

    def edited(words, n):
        words = list(words)
        for at in rng.sample(range(20), n):
            words[at * 10] = f"x{rng.random()}"
        return " ".join(words)

    half = [edited(base, 7) for _ in range(150)]
    texts = {d: edited(base, 3) for d in range(150)} | {1000 + d: t for d, t in enumerate(half)} | {5000: " ".join(base), 6000: half[149] + " end"}
    got = {r.doc_id: r.class_id for r in N.near_classes(documents(spark, texts)).collect()}
    assert {got[d] for d in (*range(150), 5000)} == {0}
    assert got[1149] == got[6000] == 1149
    assert all(got[d] == d for d in range(1000, 1149))


def test_block_index_equals_pairwise_similarity():
    rng = np.random.default_rng(1)
    texts = [(np.sort(rng.choice(60, n, replace=False)).astype(np.uint64), rng.uniform(0.5, 5, n)) for n in (1, 20, 50, 60)]
    for one in [*texts, (np.array([99], np.uint64), np.ones(1))]:
        assert np.allclose(N.Block(texts).likeness(*one), [N.weighted_jaccard(one, t) for t in texts])


def test_signatures_agree_as_often_as_texts_are_alike():
    rng = np.random.default_rng(0)
    keys = np.sort(rng.integers(1, 2**63, 3000).astype(np.uint64))
    weights = rng.uniform(0.5, 5, 3000)
    for share in (0.5, 0.8, 0.95):
        n = int(2000 * share)
        a, b = np.arange(2000), np.concatenate([np.arange(n), np.arange(2000, 4000 - n)])
        want = N.weighted_jaccard((keys[a], weights[a]), (keys[b], weights[b]))
        both = [N.signatures(keys[i], weights[i], np.array([0, len(i)]), 600, 1)[0] for i in (a, b)]
        assert abs((both[0] == both[1]).mean() - want) < 0.07


def test_components_of_chains_and_stars(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(i, 200) for i in range(190, 200)] + [(5, 5)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 150)} | {i: 190 for i in range(190, 201)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_fingerprints_by_hand(spark, tmp_path):
    import hashlib

    rng = random.Random(12)
    texts = awkward(rng) + [sentence(rng, 300) for _ in range(12)]
    ids = rng.sample(range(10_000), len(texts))
    table = dict(zip(ids, texts))
    clash(documents(spark, table)).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in P.op7_document_fingerprints(spark, str(tmp_path)).collect()}
    order = sorted(ids)
    prints = {}
    for i, d in enumerate(order):
        own, nxt = table[d] or "", table[order[(i + 1) % len(order)]] or ""
        m = len(own) // 4
        edited = own[: len(own) - m] + nxt[:m]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        assert prints.setdefault(own, r.fingerprint) == r.fingerprint
        if own == edited or r.fingerprint == r.edited_fingerprint:
            assert r.near_edited == 1.0
        if len(WORD.findall(own)) > 250:
            assert abs(r.near_edited - jaccard(own, edited)) < 0.2 and 0.3 < r.near_edited
            assert abs(r.near_next - jaccard(own, nxt)) < 0.1


def test_sketches_merge_and_contain(spark):
    rng = random.Random(13)
    a, b = sentence(rng, 2000, 10**6), sentence(rng, 500, 10**6)
    row = spark.createDataFrame([(a, b, a + "\n" + b)], "a string, b string, ab string")
    sk = {c: P.sketch(F.col(c)) for c in ("a", "b", "ab")}
    r = row.select(P.containment(sk["b"], sk["ab"]).alias("c"), P.likeness(P.merged(sk["a"], sk["b"]), sk["ab"]).alias("m")).first()
    assert r.c == 1.0 and r.m > 0.98


def test_next_of_ties_nulls_and_single_rows(spark):
    rows = spark.createDataFrame([(5, "b"), (5, "a"), (None, "n"), (900, "z")], "doc_id long, text string")
    got = sorted((r.text, r.next_text) for r in P.with_next(rows, "doc_id", "text").collect())
    assert got == [("a", "b"), ("b", "z"), ("n", "a"), ("z", "n")]
    assert [(r.text, r.next_text) for r in P.with_next(rows.where("text = 'z'"), "doc_id", "text").collect()] == [("z", "z")]
    assert P.with_next(rows.where("text = '?'"), "doc_id", "text").count() == 0


def test_next_of_any_spread_of_ids(spark, monkeypatch):
    """Ids over the whole range of a long, one far from all others, and many repeats, in small ranges of rows."""
    monkeypatch.setattr(P, "BUCKET_ROWS", 8)
    rng = random.Random(14)
    for ids in ([-(2**63), 2**63 - 1, 0], [*range(500), 9 * 10**18], [rng.randrange(-(2**62), 2**62) for _ in range(300)], [7] * 40 + list(range(60)), list("zyxabc")):
        kind = "string" if isinstance(ids[0], str) else "long"
        rows = [(d, f"t{i:04}") for i, d in enumerate(ids)]
        got = P.with_next(spark.createDataFrame(rows, f"doc_id {kind}, text string"), "doc_id", "text").collect()
        order = sorted(rows)
        want = {own: order[(i + 1) % len(order)][1] for i, (_, own) in enumerate(order)}
        assert {r.text: r.next_text for r in got} == want and len(got) == len(rows)
    ids = spark.range(2000).select(F.when(F.col("id") == 5, 9 * 10**18).otherwise(F.col("id")).alias("doc_id"))
    sizes = [r["count"] for r in ids.groupBy(P.bucket_of(F.col("doc_id"), P.bounds_of(ids, "doc_id"))).count().collect()]
    assert len(sizes) > 60 and max(sizes) < 200


def test_fingerprints_of_empty_tables_and_repeated_rows(spark):
    docs = documents(spark, {1: "one two", 2: None, 3: "", 4: "w " * 30_000})
    rows = P.edited_fingerprints(clash(docs.unionByName(docs))).collect()
    assert len(rows) == 8
    prints = {(r.doc_id, r.fingerprint) for r in rows}
    assert len(prints) == 4 and {f for d, f in prints if d in (2, 3)} == {""}
    assert all(f for d, f in prints if d in (1, 4))  # a text with words has a hash, however short
    assert all(r.near_next == 1.0 for r in rows if r.doc_id == 2)  # equal fingerprints
    assert P.edited_fingerprints(docs.where("doc_id < 0")).count() == 0
