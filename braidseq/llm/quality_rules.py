"""Quality rules by repetition coverage.

Rolling hashes of the word windows of several lengths, and of the lines, are compared inside each text
in numpy; the characters inside repeated windows and lines are measured. Narrow: no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import keep_only, mix64, ngram_hashes, repeated, small_batches, span_hashes, table, utf8, word_spans

SYMBOLS = b"#*$%&|<>"
#: Word windows whose repeats are measured, and the share of word characters from which a text fails.
COVERAGE = {5: 0.45, 8: 0.40, 12: 0.35}
LINE_COVERAGE = 0.45
SYMBOL_SHARE = 0.10
BASE_WINDOW, BASE_WORDS, BASE_PERCENT = 8, 20, 30

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars")


def measure(raw: np.ndarray, offsets: np.ndarray, windows=tuple(COVERAGE)) -> dict[str, np.ndarray]:
    """Counts of each text of a batch; dup_chars_<n> are word characters inside repeated n-word windows."""
    docs = len(offsets) - 1
    starts, ends, of = word_spans(raw, offsets)
    points = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=points[1:])
    chars = points[ends] - points[starts]
    total = lambda weights, at: np.bincount(at, weights, docs).astype(np.int64)
    out = {"n_words": np.bincount(of, minlength=docs).astype(np.int64), "word_chars": total(chars, of)}
    marks = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(np.isin(raw, np.frombuffer(SYMBOLS, np.uint8)), out=marks[1:])
    out["n_symbols"] = marks[offsets[1:]] - marks[offsets[:-1]]

    words = span_hashes(raw, starts, ends)
    salt = mix64(np.arange(1, docs + 1, dtype=np.uint64) << np.uint64(20))
    for n in sorted({BASE_WINDOW, *windows}):
        keys, at = ngram_hashes(words, of, n)
        hit = at[repeated(keys ^ salt[of[at]])]
        depth = np.zeros(len(words) + 1, np.int64)
        np.add.at(depth, hit, 1)
        np.add.at(depth, hit + n, -1)
        inside = np.cumsum(depth[:-1]) > 0
        if n == BASE_WINDOW:
            out["n_repeat_words"] = np.bincount(of[inside], minlength=docs).astype(np.int64)
        if n in windows:
            out[f"dup_chars_{n}"] = total(chars[inside], of[inside])

    breaks = np.flatnonzero(raw == 10)
    filled = offsets[:-1][np.diff(offsets) > 0]
    line_start = np.unique(np.concatenate([filled, breaks + 1]))
    line_start = line_start[line_start < len(raw)]
    line_of = np.searchsorted(offsets, line_start, "right") - 1
    ends_at = np.append(breaks, len(raw))
    line_end = np.minimum(ends_at[np.searchsorted(ends_at, line_start)] if len(line_start) else line_start, offsets[line_of + 1])
    count = np.searchsorted(starts, line_end) - np.searchsorted(starts, line_start)
    full = count > 0
    line_start, line_end, line_of = line_start[full], line_end[full], line_of[full]
    keys = span_hashes(raw, line_start, line_end) ^ salt[line_of] ^ mix64((line_end - line_start).astype(np.uint64))
    order = np.argsort(keys, kind="stable")
    later = np.zeros(len(keys), bool)
    later[order[1:]] = keys[order][1:] == keys[order][:-1]
    out["n_dup_lines"] = np.bincount(line_of[later], minlength=docs).astype(np.int64)
    reach = np.append(0, np.cumsum(chars))
    in_line = reach[np.searchsorted(starts, line_end)] - reach[np.searchsorted(starts, line_start)]
    out["dup_line_chars"] = total(in_line[later], line_of[later])
    return out


def quality_measures(docs: DataFrame, windows=tuple(COVERAGE), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns named in keep, then the counts of the column `text` of every row.

    A null text has no words and one empty line; an empty table gives an empty one. Other columns are not
    read, so extra ones with any name do no harm; a repeated row is measured again. A text of any length is
    measured whole.
    """
    names = [*COUNTS, *(f"dup_chars_{n}" for n in windows)]
    kept = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    source = docs.select(*kept, F.col("text").alias("text"))
    schema = ", ".join([*(f"k{i} {source.schema[i].dataType.simpleString()}" for i in range(len(keep))), *(f"{n} bigint" for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("quality_rules")
        for batch in small_batches(batches):
            found = measure(*utf8(batch.column("text")), windows)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *(pa.array(found[n]) for n in names)], names=[*(f"k{i}" for i in range(len(keep))), *names])

    return source.mapInArrow(run, schema).withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})


def verdict(measures: DataFrame, coverage: dict[int, float] | None = None) -> DataFrame:
    """Add base_failed and kept to what quality_measures() returns."""
    coverage = COVERAGE if coverage is None else coverage
    base = (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_PERCENT * F.col("n_words"))
    bad = (F.col("n_symbols") > SYMBOL_SHARE * F.col("word_chars")) | (F.col("dup_line_chars") > LINE_COVERAGE * F.col("word_chars"))
    for n, share in coverage.items():
        bad |= F.col(f"dup_chars_{n}") > share * F.col("word_chars")
    return measures.withColumn("base_failed", base).withColumn("kept", ~base & ~bad)


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    return verdict(quality_measures(table(spark, sf_dir, "documents"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *(f"dup_chars_{n}" for n in COVERAGE), "dup_line_chars"
    )


#: Columns of a document that stage_quality() gives back.
def stage_quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, with the columns that came in."""
    judged = verdict(quality_measures(docs, keep=tuple(dict.fromkeys([*docs.columns, "text"]))))
    return judged.where("kept").select(*docs.columns)


SQL = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), lengths AS (SELECT unnest([{', '.join(map(str, sorted({BASE_WINDOW, *COVERAGE})))}]) AS n
), windows AS (
  SELECT doc_id, n, i, md5(list_aggregate(words[i : i + n - 1], 'string_agg', ' ')) AS g
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM w, lengths)
), twice AS (
  SELECT doc_id, n, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, n, g) AS c FROM windows) WHERE c > 1
), covered AS (
  SELECT DISTINCT doc_id, n, unnest(range(i, i + n)) AS k FROM twice
), sums AS (
  SELECT c.doc_id, count(*) FILTER (n = {BASE_WINDOW}) AS n_repeat_words,
         {', '.join(f'sum(length(w.words[k])) FILTER (n = {n}) AS dup_chars_{n}' for n in COVERAGE)}
  FROM covered c JOIN w USING (doc_id) GROUP BY c.doc_id
), lines AS (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) > 1 AS later,
         length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), dup AS (
  SELECT doc_id, count(*) AS n_dup_lines, sum(chars) AS dup_line_chars FROM lines WHERE later GROUP BY doc_id
), m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, {', '.join(f'coalesce(dup_chars_{n}, 0)::BIGINT AS dup_chars_{n}' for n in COVERAGE)},
         coalesce(dup_line_chars, 0)::BIGINT AS dup_line_chars
  FROM w LEFT JOIN sums s ON w.doc_id = s.doc_id LEFT JOIN dup d ON w.doc_id = d.doc_id
), b AS (SELECT *, n_words < {BASE_WORDS} OR 100 * n_repeat_words > {BASE_PERCENT} * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND NOT (n_symbols > {SYMBOL_SHARE} * word_chars OR dup_line_chars > {LINE_COVERAGE} * word_chars
  OR {' OR '.join(f'dup_chars_{n} > {share} * word_chars' for n, share in COVERAGE.items())}) AS kept FROM b
"""
