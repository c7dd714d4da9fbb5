import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from braidseq.llm import line_dedup as L
from braidseq.llm import quality_rules as R
from braidseq.llm import url_filters as U

from .helpers import SCHEMA, WORD, awkward, clash, documents, sentence


def quality_by_hand(text, windows=(5, 8, 12)):
    text = text or ""
    words = WORD.findall(text)

    def covered(n):
        seen, hit = {}, set()
        for i in range(len(words) - n + 1):
            seen.setdefault(tuple(words[i : i + n]), []).append(i)
        for at in seen.values():
            if len(at) > 1:
                for i in at:
                    hit.update(range(i, i + n))
        return hit

    lines = [x for x in text.split("\n") if WORD.search(x)]
    later = [x for i, x in enumerate(lines) if x in lines[:i]] if len(lines) < 5000 else []
    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered(8))}
    out["dup_line_chars"] = sum(len(w) for x in later for w in WORD.findall(x))
    for n in windows:
        out[f"dup_chars_{n}"] = sum(len(words[i]) for i in covered(n))
    return out


def test_quality_measures_by_hand(spark):
    rng = random.Random(1)
    texts = awkward(rng) + [sentence(rng, 60, 4) + "\n" + sentence(rng, 60, 3) for _ in range(30)] + ["a b\na b\n a b\na b"]
    got = {r.doc_id: r.asDict() for r in R.quality_measures(clash(documents(spark, texts))).collect()}
    for i, text in enumerate(texts):
        want = quality_by_hand(text)
        assert {k: got[i][k] for k in want} == want, repr(text)[:80]


def test_quality_verdicts(spark):
    rng = random.Random(2)
    texts = [sentence(rng, 200), "one two", "spam ham " * 50, sentence(rng, 40).replace(" ", " # "), None]
    out = {r.doc_id: (r.base_failed, r.kept) for r in R.verdict(R.quality_measures(documents(spark, texts))).collect()}
    assert out == {0: (False, True), 1: (True, False), 2: (True, False), 3: (False, False), 4: (True, False)}
    docs = clash(documents(spark, texts))
    kept = R.stage_quality(spark, docs, "")
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [0]
    assert R.stage_quality(spark, spark.createDataFrame([], SCHEMA), "").count() == 0


def lines_by_hand(texts, threshold, least=1):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    seen = {}
    for i, t in enumerate(texts):
        for x in (t or "").split("\n"):
            seen.setdefault(key(x), set()).add(i)
    bad = {k for k, docs in seen.items() if len(k) >= least and len(docs) >= threshold}
    out = []
    for t in texts:
        parts = (t or "").split("\n")
        kept = [x for x in parts if key(x) not in bad]
        out.append((len(parts), len(parts) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("threshold", [1, 2, 4])
def test_line_dedup_by_hand(spark, threshold):
    rng = random.Random(threshold)
    pool = ["Buy Now", " buy now\t", "ÄPFEL", "äpfel", "", " ", "plain", "other line", "\x0bplain\x0c", "x" * 3000]
    texts = awkward(rng)[:7] + ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 9))) for _ in range(25)] + ["\n".join(["again"] * 3000)]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in L.line_dedup(clash(documents(spark, texts)), threshold).select("doc_id", "n_lines", "n_dropped", "text").collect()}
    assert [got[i] for i in range(len(texts))] == lines_by_hand(texts, threshold)


def test_line_dedup_of_repeated_rows_and_empty_tables(spark):
    docs = documents(spark, {1: "a\nb", 2: "a"})
    twice = docs.unionByName(docs).unionByName(documents(spark, {None: "a\nc"}))
    got = sorted((r.doc_id or -1, r.text) for r in L.line_dedup(twice, 4).collect())
    assert got == [(-1, "c"), (1, "b"), (1, "b"), (2, ""), (2, "")]
    assert L.line_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_line_dedup_sql(spark, tmp_path):
    rng = random.Random(9)
    texts = [None, ""] + ["\n".join(rng.choice(["A", "a ", "b", "Ä", ""]) for _ in range(4)) for _ in range(40)]
    documents(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(L.SQL).fetchall())
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in L.op2_line_dedup(spark, str(tmp_path)).collect())
    assert got == want
    assert got[0][3] == hashlib.sha256(b"").hexdigest()


def url_by_hand(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    return host, tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]


def test_urls_by_hand(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/1", "x://example.org/en/12?x#y", "x://sub.example.org/en/2", "x://badexample.org/es/", "x://org", "x://org?q=/es/",
            "x://a.com/de/x", "x://com/fr/", "x://a.com/fr", "x://a.net/p/", "y://a.net/p?utm_x=1#z", "x://u:80/p", "x://u/p", "x://ä.org/\n/a", "a://b://c/d"]
    rows = spark.createDataFrame([(i, u, "e") for i, u in enumerate(urls)] + [(5, urls[5], "e")], "page_id long, url string, canonical string")
    listed = spark.createDataFrame([("a.net/p",), ("u/p",), ("u/p",), (None,)], "canonical string")
    got = U.filter_urls(rows, listed).collect()
    assert len(got) == len(urls) + 1
    order = sorted(U.RULES, key=lambda r: -len(r[1] + r[2]))
    for r in got:
        host, path = url_by_hand(r.url)
        fit = next(((a, h + p) for a, h, p in order if (host == h or host.endswith("." + h)) and path.startswith(p)), (None, None))
        on = r.page_id in (13, 14, 15, 16)
        assert (r.host, r.path, r.rule, r.listed) == (host, path, fit[1], on), r
        assert r.verdict == (fit[0] or ("block" if on else "allow"))
    empty = U.filter_urls(rows, listed.where("canonical = ''"))
    assert empty.where("listed").count() == 0
    assert U.filter_urls(rows.where("page_id < 0"), listed).count() == 0


def test_many_rules_are_joined_and_give_the_same(spark, monkeypatch):
    """Rules as an expression, as a list beyond INLINE_RULES and as a table; very long urls and ties too."""
    rng = random.Random(21)
    hosts = ["a.com", "b.a.com", "c.b.a.com", "x.org", "org", "com", "ba.com", ""]
    paths = ["", "/", "/a", "/ab", "/abc/d", "/b/" + "z" * 3000]
    rules = sorted({(rng.choice(hosts[:6]), rng.choice(paths)): rng.choice(["allow", "block"]) for _ in range(30)}.items())
    rules = [(action, h, p) for (h, p), action in rules]
    rows = spark.createDataFrame([(i, f"http://{h}{p}?q") for i, (h, p) in enumerate((h, p + t) for h in hosts for p in paths for t in ("", "q"))], "page_id long, url string")
    listed = spark.createDataFrame([("x.org/a",)], "canonical string")
    got = []
    for as_table in (False, False, True):
        given = spark.createDataFrame(rules, "action string, host string, path string") if as_table else rules
        got.append(sorted((r.page_id, r.rule, r.verdict) for r in U.filter_urls(rows, listed, given).collect()))
        monkeypatch.setattr(U, "INLINE_RULES", 3)
    assert got[0] == got[1] == got[2] and len({r for _, r, _ in got[0]}) > 8


def test_the_list_is_no_match_of_hosts(spark):
    pages = spark.createDataFrame([(i, f"http://www.casino-win{i % 7}.net/p/{i}?utm_source=x") for i in range(200)] + [(500, "http://good.org/casino-win")], "page_id long, url string")
    listed = U.example_list(pages)
    rows = U.filter_urls(pages, listed).collect()
    on = {r.page_id for r in rows if r.listed}
    assert on == {i for i in range(200) if hashlib.md5(f"www.casino-win{i % 7}.net/p/{i}".encode()).hexdigest()[0] >= "4"}
    assert 100 < len(on) < 190 and listed.count() == 2 * len(on)


def test_bloom_false_hits_are_removed(spark):
    from braidseq.llm._bloom import BlockedBloom

    keys = spark.range(5000).select(F.xxhash64("id").alias("h1"), F.xxhash64(F.lit(1), "id").alias("h2"))
    bloom = BlockedBloom.of(keys, "h1", "h2")
    maybe = spark.range(20000).select("id", bloom.maybe(F.xxhash64("id"), F.xxhash64(F.lit(1), "id")).alias("m")).collect()
    assert all(r.m for r in maybe if r.id < 5000)
    assert sum(r.m for r in maybe if r.id >= 5000) < 300
    full = BlockedBloom.of(keys, "h1", "h2", max_blocks=16)  # far too small: many false hits, none missing
    assert all(r.m for r in spark.range(5000).select(full.maybe(F.xxhash64("id"), F.xxhash64(F.lit(1), "id")).alias("m")).collect())
