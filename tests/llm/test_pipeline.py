import random
import zlib

import numpy as np

import corpus_pipeline as C
from braidseq.llm._common import materialise
from braidseq.llm.line_dedup import THRESHOLD

from .helpers import WORD, clash, documents, sentence
from .test_filters import lines_by_hand, quality_by_hand


def test_stages_by_hand(spark, tmp_path):
    rng = random.Random(21)
    texts = [sentence(rng, rng.randint(30, 200), 3000) + "\nall rights reserved" for _ in range(40)]
    texts += [texts[3], texts[3] + " more", None, "few words", "go go go " * 40, sentence(rng, 6000, 3000)]
    source = {d: rng.choice(["a", "b", None]) for d in range(len(texts))}
    docs = documents(spark, texts, source=source)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert [name for name, _ in C.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mixing", "packing"]
    steps = {}
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in C.STAGES:
        at = materialise(stage(spark, at, str(tmp_path)), name)
        steps[name] = at.collect()
        if name != "packing":
            assert at.columns == docs.columns
    kept = [d for d, t in enumerate(texts) if quality_by_hand(t)["n_words"] >= 20 and t != texts[44]]
    assert sorted(r.doc_id for r in steps["quality_rules"]) == kept
    cut = {d: t for d, (_, _, t) in zip(kept, lines_by_hand([texts[d] for d in kept], THRESHOLD))}
    assert {r.doc_id: r.text for r in steps["line_dedup"]} == cut and all("reserved" not in t for d, t in cut.items() if d < 40)
    assert sorted(r.doc_id for r in steps["near_dedup"]) == [d for d in kept if d not in (40, 41)]
    total = sum(len(WORD.findall(r.text)) for r in steps["near_dedup"])
    mixed = sum(len(WORD.findall(r.text)) for r in steps["mixing"])
    assert abs(mixed - total) < 64 * 8
    assert all(r.n_chars == len(r.text) for r in steps["mixing"])
    from braidseq.llm.packing import WordEncoder, tokenizer_path

    tokenizer = WordEncoder(tokenizer_path()).tokenizer
    want = sorted((r.doc_id, zlib.crc32(np.array((tokenizer.encode(r.text, add_special_tokens=False).ids + [1])[:4096], "<u4").tobytes())) for r in steps["mixing"])
    assert sorted((r.doc_id, r.ids_crc32) for r in steps["packing"] if r.piece == 0) == want
    ran = C.run(spark, str(tmp_path)).select("doc_id", "piece", "ids_crc32").collect()
    assert sorted(map(tuple, ran)) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in steps["packing"])


def test_stages_take_extra_columns_and_no_rows(spark):
    docs = clash(documents(spark, ["some text"])).where("doc_id > 5")
    for _, stage in C.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
