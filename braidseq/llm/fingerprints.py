"""Document fingerprints by threshold-scaled sketches, with DataFrame functions only.

The hashes of a text's shingles (five words, all of them in a shorter text)
that lie below a fixed share of the hash range are its sketch. The share is the same for every document,
so sketches merge by union, and the overlap of two sketches estimates both Jaccard likeness and
containment, however unequal the documents are. A text with words none of whose hashes is that small keeps its
least one, so that only texts without words have an empty sketch.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD, materialise, once, table, text_of

SHINGLE, ONE_IN = 5, 8
BUCKET_ROWS, MAX_BUCKETS, SAMPLED = 512, 1 << 14, 16


def sketch(text: Column, one_in: int = ONE_IN, shingle: int = SHINGLE) -> Column:
    """Sorted distinct 64-bit hashes below 1/one_in of the range, or the least one if none is. No words, no hashes."""
    limit = -(1 << 63) + (1 << 64) // one_in
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))

    def hashes(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(w) - shingle, F.lit(0)))
        return F.transform(starts, lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(shingle))))

    def below(hs: Column) -> Column:
        small = F.array_sort(F.array_distinct(F.filter(hs, lambda h: h < F.lit(limit).cast("long"))))
        return once(small, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.array_min(hs))))

    kept = once(words, lambda w: F.when(F.size(w) > 0, once(hashes(w), below)))
    return F.coalesce(kept, F.array().cast("array<bigint>"))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of two sketches; that of two empty ones, as of all equal ones, is 1."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, 1.0).otherwise(both / union)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has too; null if a's sketch is empty."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def merged(a: Column, b: Column) -> Column:
    """The sketch of both texts' shingles together."""
    return F.array_sort(F.array_union(a, b))


def as_string(hashes: Column) -> Column:
    """16 hexadecimal digits a hash, in order."""
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def bounds_of(rows: DataFrame, order: str) -> list:
    """Values that cut rows into at most MAX_BUCKETS ranges of about BUCKET_ROWS rows or more each.

    Every SAMPLED-th of a sample drawn by hash, which holds SAMPLED times MAX_BUCKETS values at most on
    average: the bound is for where ranges end alone, and every row falls into one.
    """
    n = rows.count()
    buckets = min(MAX_BUCKETS, max(1, n // BUCKET_ROWS))
    share = min(1.0, SAMPLED * buckets / max(1, n))
    drawn = rows.select(order).where(F.col(order).isNotNull() & (F.xxhash64(order) / 2.0**64 + 0.5 <= share))
    found = drawn.distinct().orderBy(order).toArrow()[order].to_pylist()
    return found[SAMPLED::SAMPLED] if buckets > 1 else []


def bucket_of(value: Column, bounds: list, kind: str = "bigint") -> Column:
    """The number of bounds (of a type) that are not above value, by binary search; -1 for null."""
    if not bounds:
        return F.when(value.isNull(), -1).otherwise(0)
    known = F.from_json(F.lit(json.dumps(bounds)), f"array<{kind}>")  # folded into one literal
    steps = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]
    over = lambda at, step: F.coalesce(F.get(known, at + step - 1) <= value, F.lit(False))
    found = F.aggregate(F.lit(steps), F.lit(0), lambda at, step: at + F.when(over(at, step), step).otherwise(0))
    return F.when(value.isNull(), -1).otherwise(found)


def with_next(rows: DataFrame, order: str, column: str, made: dict[str, Column] | None = None) -> DataFrame:
    """rows (order and column of them) with made, further columns made of these, and next_<name> of column and made,
    as they are in the row that follows in ascending `order` (the first after the last).

    Ordered without one global window: rows fall into ranges of sampled bounds, however ids are spread, and the
    first row of each range is also put at the end of the range before it. What says which rows those are has one
    row per range, a fixed bound, and is broadcast; the rows are shuffled once, with what was made of them. Ties and
    null ids (first) are in order of the column; rows that repeat one id stay together.
    """
    made = made or {}
    rows = rows.select(order, column, bucket_of(F.col(order), bounds_of(rows, order), rows.schema[order].dataType.simpleString()).alias("bucket__"))
    heads = materialise(rows.groupBy("bucket__").agg(F.min(order).alias("head__")), "next-heads")
    chain = Window.orderBy("bucket__")
    last = F.first("bucket__").over(Window.orderBy(F.desc("bucket__")))
    heads = heads.select("head__", F.coalesce(F.lag("bucket__").over(chain), last).alias("before__"))
    again = rows.join(F.broadcast(heads), F.col(order).eqNullSafe(F.col("head__"))).select(order, column, F.col("before__").alias("bucket__"))
    both = rows.withColumn("again__", F.lit(False)).unionByName(again.withColumn("again__", F.lit(True))).withColumns(made)
    inside = Window.partitionBy("bucket__").orderBy("again__", order, column)
    return both.select("*", *(F.lead(c).over(inside).alias(f"next_{c}") for c in (column, *made))).where("not again__").drop("bucket__", "again__")


def fingerprints(docs: DataFrame, one_in: int = ONE_IN) -> DataFrame:
    """doc_id, text and sketch of every row. Needs doc_id and text; other columns are not read.

    Null and empty texts, and those without words, have an empty sketch; a text of less than five words has one
    hash, very long ones are sketched whole. Equal rows and texts have equal sketches. An empty table gives an empty result.
    """
    return docs.select("doc_id", text_of().alias("text")).withColumn("sketch", sketch(F.col("text"), one_in))


def op7_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def edited_fingerprints(docs: DataFrame, one_in: int = ONE_IN) -> DataFrame:
    """Fingerprints of all documents, of their edited texts, and how alike they are.

    Sketches are made once, before rows are put in order of doc_id, and go with the texts. Ids may be of any
    order type and spread; null ones come first. Rows of one id are in order of a hash of their texts.
    """
    rows = with_next(docs.select("doc_id", text_of().alias("text")), "doc_id", "text", {"sketch": sketch(F.col("text"), one_in)})
    n = F.char_length("text")
    swap = F.floor(n / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - swap), F.substring(F.col("next_text"), F.lit(1), swap)))
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited"), one_in))
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_string(F.col("sketch")).alias("fingerprint"),
        as_string(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
