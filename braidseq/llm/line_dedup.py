"""Line dedup over a whole corpus, with DataFrame functions only.

Lines are exploded with a 128-bit hash of their normalised key; the documents of a hash are counted with
partial sums, so one line in a third of all documents costs each task one row. What travels per line is a
document key, a position and the hash, never text. Texts are then cut by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SPACES, hash128, materialise, once, table, text_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
THRESHOLD, MIN_CHARS = 10, 1


def line_key(line: Column) -> Column:
    """White space stripped at both ends, A-Z lower-cased."""
    return F.translate(F.trim(line, F.lit(SPACES)), UPPER, LOWER)


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(d1, d2, pos, h1, h2) of each line whose key is long enough; d1, d2 tell documents apart."""
    lines = docs.select(*document_key(), F.posexplode(F.split(text_of(), "\n", -1)).alias("pos", "line")).select("d1", "d2", "pos", line_key(F.col("line")).alias("key"))
    return lines.where(F.char_length("key") >= min_chars).select("d1", "d2", "pos", *hash128(F.col("key")))


def document_key() -> list[Column]:
    whole = F.struct(F.col("doc_id"), text_of())
    return [F.xxhash64(whole).alias("d1"), F.xxhash64(F.lit(104729), whole).alias("d2")]


def common_lines(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, n_docs) of the line keys found in at least threshold documents; each row counts as a document."""
    lines = docs.select(F.explode(F.array_distinct(F.transform(F.split(text_of(), "\n", -1), lambda x: key_struct(x, min_chars)))).alias("k"))
    counts = lines.where("k is not null").select("k.h1", "k.h2").groupBy("h1", "h2").agg(F.count("*").alias("n_docs"))
    return counts.where(F.col("n_docs") >= threshold)


def key_struct(line: Column, min_chars: int) -> Column:
    key = line_key(line)
    return F.when(F.char_length(key) >= min_chars, F.struct(*hash128(key)))


def line_dedup(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """The rows and columns of docs with `text` replaced by its kept lines, plus n_lines and n_dropped.

    Needs doc_id and text. A null or empty text is one empty line and stays empty (null becomes ''). A text that loses all
    lines becomes ''. Equal rows (same doc_id and text) count as documents of their own and lose the same
    lines. Extra columns pass through, n_lines and n_dropped excepted, which are replaced. Texts and lines of any
    length are handled whole; a line in exactly `threshold` documents goes. An empty table gives an empty one. Keys are told
    apart by 128 bits of hash: two different ones of a trillion share them with a chance of about one in 10**15.
    """
    common = materialise(common_lines(docs, threshold, min_chars).select("h1", "h2"), "line-common")
    hits = line_hashes(docs, min_chars).join(common, ["h1", "h2"], "left_semi")
    drop = hits.groupBy("d1", "d2").agg(F.collect_set("pos").alias("drop__"))
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    lines = F.split(text_of(), "\n", -1)
    wide = docs.select(F.struct(*names).alias("row"), "text", *document_key()).join(drop, ["d1", "d2"], "left")
    kept_of = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("drop__"))
    cut = once(lines, lambda x: F.array_join(F.transform(kept_of(x), lambda i: F.get(x, i)), "\n"))
    text = F.when(F.col("drop__").isNull(), text_of()).otherwise(cut)
    n_dropped = F.when(F.col("drop__").isNull(), F.lit(0)).otherwise(F.size("drop__")).cast("long")
    return wide.select(*(text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in names), F.size(lines).cast("long").alias("n_lines"), n_dropped.alias("n_dropped"))


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), common AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), judged AS (
  SELECT k.*, c.key IS NOT NULL AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def stage_line_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with what line_dedup() leaves of their texts, which can be empty, and the columns that came in."""
    return line_dedup(docs).select(*docs.columns)
