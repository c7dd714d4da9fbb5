"""Mixing sources to target weights by Sainte-Lague apportionment, with DataFrame functions only.

Word totals per source give targets (weights, no source above max_epochs times its size). Blocks of equal
word counts are seats: they go to the sources, and inside a source to its shards, by the highest quotients
votes / (2 * seats + 1). A seeded permutation of a shard's blocks then says which blocks are read, and a
document's words are those of its span in them. Seats are found from a proven bracket around each ideal
share, so that no block becomes a row. A hot source has as many shards as its words need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD, materialise, table, text_of

BLOCK_WORDS, SHARD_WORDS, MAX_EPOCHS, SEED = 64, 1_000_000, 3, 17
MADE = ("size", "source_size", "target", "taken", "mix_plan")
STEP = 2147483629  # prime; b -> (b * STEP + shift) mod n permutes the blocks 0..n-1 of a shard


def md5_int(*parts: Column) -> Column:
    """60 bits of an md5 as a non-negative long."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: rank, weight, source_size, target.

    Water-filling in closed form: with sources by cap per weight, the level is the largest of
    (total - caps before) / (weights from here on), and a target is the smaller of cap and level * weight.
    The windows run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    per = per.withColumn("weight", ((F.col("rank") - 1) % 3 + 1).cast("double")).withColumn("cap", (max_epochs * F.col("source_size")).cast("double"))
    everything = Window.partitionBy(F.lit(1))
    by_cap = everything.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", (F.sum("source_size").over(everything).cast("double") - before) / onward)
    per = per.withColumn("target", F.least("cap", F.max("level").over(everything) * F.col("weight")))
    return per.select("source", "rank", "weight", "source_size", "target")


def apportion(parties: DataFrame, group: list[str], key: str, votes: str, seats: str, out: str) -> DataFrame:
    """Sainte-Lague seats for each row of parties: within a group, `seats` seats (equal in all its rows) go to
    the highest quotients votes / (2 j + 1), ties to the smaller key.

    With S parties and M seats an ideal share x is rounded within x * S / (2 M) + 1.5 of itself: the divisor
    moves by a factor of S / (2 M) at most. Seats below that bracket are certain, those above are out of
    reach, and only the quotients inside compete, S / 2 + 3 S rows a group.
    """
    per = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))
    x = parties.withColumn("n__", F.count("*").over(per)).withColumn("v__", F.sum(votes).over(per))
    share = F.when(F.col("v__") > 0, F.col(seats) * F.col(votes) / F.col("v__")).otherwise(0.0)
    slack = F.when(F.col(seats) > 0, share * F.col("n__") / (2.0 * F.col(seats)) + 2.5).otherwise(0.0)
    x = x.withColumn("low__", F.greatest(F.lit(0), F.floor(share - slack)).cast("long")).withColumn("high__", F.when(share > 0, F.ceil(share + slack)).otherwise(0).cast("long"))
    open_seats = F.col(seats) - F.sum("low__").over(per)
    x = x.withColumn("open__", open_seats)
    tried = x.where("high__ > low__").select(*group, key, votes, "open__", F.explode(F.sequence(F.col("low__"), F.col("high__") - 1)).alias("j__"))
    order = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))
    order = order.orderBy((F.col(votes) / (2 * F.col("j__") + 1)).desc(), key, "j__")
    won = tried.withColumn("r__", F.row_number().over(order)).where("r__ <= open__").groupBy(*group, key).agg(F.count("*").alias("won__"))
    joined = x.join(won, [*group, key], "left")
    return joined.withColumn(out, F.col("low__") + F.coalesce(F.col("won__"), F.lit(0))).drop("n__", "v__", "low__", "high__", "open__", "won__")


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """docs with size, source_size, target, taken and mix_plan of each document.

    Needs doc_id, source and text; columns of docs named like one of the new ones are replaced. A null text has size 0,
    a null source is a source of its own, ranked last; documents without words are taken 0 times. Equal
    rows are documents of their own. Texts of any length count with all their words; equal quotients go to the source
    that sorts first. An empty table gives an empty one. Reruns agree: the order inside a
    shard is by a seeded hash of doc_id, then by size and text hash.

    mix_plan: epochs__ whole passes over the shard, and of its n_blocks__ blocks of block_words words (the last
    may be shorter) those b with (b * STEP + shift__) % n_blocks__ < extra__; start__ is the document's
    first word in the shard.
    """
    names = [c for c in docs.columns if c not in MADE]
    plain = docs.select(F.struct(*names).alias("row"), "doc_id", "source", "text")
    sized = plain.withColumn("size", F.regexp_count(text_of(), F.lit(WORD)).cast("long"))
    sized = sized.withColumn("h__", md5_int(F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn("t__", F.xxhash64("text"))
    sizes = materialise(sized.select("source", "size", "h__"), "mix-sizes")

    per = targets(sizes, max_epochs).withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long"))
    total = F.sum("source_size").over(Window.partitionBy(F.lit(1)))
    per = per.withColumn("all__", F.ceil(total / block_words).cast("long"))
    per = materialise(apportion(per, [], "rank", "target", "all__", "quota").drop("all__"), "mix-sources")

    ranked = sizes.join(per.select(F.col("source").alias("s__"), "rank", "shards"), F.col("source").eqNullSafe(F.col("s__")))
    shards = ranked.groupBy("rank", F.pmod("h__", F.col("shards")).alias("shard")).agg(F.sum("size").alias("shard_size"))
    shards = shards.join(per.select("rank", "quota"), "rank")
    shards = apportion(shards, ["rank"], "shard", "shard_size", "quota", "shard_quota")
    words = F.least(F.col("shard_quota") * block_words, F.col("shard_size") * max_epochs)
    some = F.col("shard_size") > 0
    shards = shards.withColumn("epochs__", F.when(some, F.floor(words / F.when(some, F.col("shard_size")))).otherwise(0).cast("long"))
    shards = shards.withColumn("n_blocks__", F.greatest(F.lit(1), F.ceil(F.col("shard_size") / block_words)).cast("long"))
    shards = shards.withColumn("extra__", F.least(F.col("n_blocks__"), F.round((words - F.col("epochs__") * F.col("shard_size")) / block_words)).cast("long"))
    shift = md5_int(F.lit(str(seed)), F.col("rank").cast("string"), F.col("shard").cast("string"))
    shards = materialise(shards.select("rank", "shard", "epochs__", "n_blocks__", "extra__", F.pmod(shift, F.col("n_blocks__")).alias("shift__")), "mix-shards")

    laid = sized.join(per.select(F.col("source").alias("s__"), "rank", "source_size", "target", "shards"), F.col("source").eqNullSafe(F.col("s__")))
    laid = laid.withColumn("shard", F.pmod("h__", F.col("shards")))
    order = Window.partitionBy("rank", "shard").orderBy("h__", "size", "t__").rowsBetween(Window.unboundedPreceding, -1)
    laid = laid.withColumn("start__", F.coalesce(F.sum("size").over(order), F.lit(0)).cast("long"))
    laid = laid.join(shards, ["rank", "shard"])
    first, last = F.floor(F.col("start__") / block_words), F.floor((F.col("start__") + F.col("size") - 1) / block_words)
    part = lambda b: F.least(F.col("start__") + F.col("size"), (b + 1) * block_words) - F.greatest(F.col("start__"), b * block_words)
    read = F.aggregate(F.sequence(first, last), F.lit(0).cast("long"), lambda had, b: had + F.when(chosen(b), part(b)).otherwise(F.lit(0).cast("long")))
    taken = F.col("epochs__") * F.col("size") + F.when((F.col("size") > 0) & (F.col("extra__") > 0), read).otherwise(0)
    plan = F.struct("start__", "epochs__", "n_blocks__", "extra__", "shift__")
    laid = laid.select("row", F.struct("size", "source_size", "target", taken.cast("long").alias("taken"), plan.alias("mix_plan")).alias("made__"))
    return laid.select(*(F.col("row")[c].alias(c) for c in names), *(F.col("made__")[c].alias(c) for c in MADE))


def chosen(block: Column) -> Column:
    return (block * F.lit(STEP) + F.col("shift__")) % F.col("n_blocks__") < F.col("extra__")


def realise(mixed: DataFrame, columns: list[str], block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix as documents: a row per whole epoch, and one with the words of the chosen blocks, if any.

    A partial copy joins its words by single spaces; where the chosen blocks hold the whole document its
    text stays as it is.
    """
    rows = mixed.where(F.col("taken") > 0).select(F.struct(*columns).alias("row"), "text", "size", "taken", "mix_plan.*")
    rest = F.col("taken") - F.col("epochs__") * F.col("size")
    words = F.regexp_extract_all(text_of(), F.lit(f"({WORD})"), F.lit(1))
    cut = F.array_join(F.filter(words, lambda w, i: chosen(F.floor((F.col("start__") + i) / block_words))), " ")
    text = F.when(F.col("copy__") < F.col("epochs__"), F.col("text")).when(rest == F.col("size"), F.col("text")).otherwise(cut)
    copies = F.col("epochs__") + F.when(rest > 0, 1).otherwise(0)
    out = rows.withColumn("copy__", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)))
    return out.select(*(text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in columns))


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def stage_mixing(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies that the mix takes, whole or in part, with the columns that came in; n_chars follows the text of each.

    Null texts and those without words are taken 0 times; a null source is one of its own. Equal rows are taken
    each. Other columns pass through, whatever their names. An empty table gives an empty one.
    """
    whole = docs.withColumn("mix_row", F.struct(*docs.columns)).select("doc_id", "source", "text", "mix_row")
    out = realise(mix(whole), ["text", "mix_row"])
    out = out.select(*(F.col("text") if c == "text" else F.col("mix_row")[c].alias(c) for c in docs.columns))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sized GROUP BY source
), cap AS (
  SELECT *, (((rank - 1) % 3) + 1)::DOUBLE AS weight, ({MAX_EPOCHS} * source_size)::DOUBLE AS cap FROM src
), lev AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM cap
), tgt AS (
  SELECT source, rank, source_size, least(cap, max(level) OVER () * weight) AS target,
         greatest(1, ceil(source_size / {SHARD_WORDS}))::BIGINT AS shards,
         ceil((sum(source_size) OVER ())::DOUBLE / {BLOCK_WORDS})::BIGINT AS seats FROM lev
), q1 AS (
  SELECT rank, row_number() OVER (ORDER BY target / (2 * j + 1) DESC, rank, j) AS r, seats
  FROM (SELECT *, unnest(range(0, ceil({MAX_EPOCHS} * source_size / {BLOCK_WORDS})::BIGINT + 2)) AS j FROM tgt WHERE target > 0)
), quota AS (
  SELECT t.*, coalesce(w.n, 0) AS quota FROM tgt t LEFT JOIN (SELECT rank, count(*) AS n FROM q1 WHERE r <= seats GROUP BY rank) w USING (rank)
), doc AS (
  SELECT d.*, q.rank, q.source_size, q.target, q.quota, d.h % q.shards AS shard FROM sized d JOIN quota q ON d.source IS NOT DISTINCT FROM q.source
), shard AS (
  SELECT rank, shard, any_value(quota) AS quota, sum(size)::BIGINT AS shard_size FROM doc GROUP BY rank, shard
), q2 AS (
  SELECT rank, shard, quota, row_number() OVER (PARTITION BY rank ORDER BY shard_size / (2 * j + 1) DESC, shard, j) AS r
  FROM (SELECT *, unnest(range(0, ceil({MAX_EPOCHS} * shard_size / {BLOCK_WORDS})::BIGINT + 8)) AS j FROM shard WHERE shard_size > 0)
), plan AS (
  SELECT s.rank, s.shard, s.shard_size, least(coalesce(w.n, 0) * {BLOCK_WORDS}, s.shard_size * {MAX_EPOCHS})::BIGINT AS words,
         greatest(1, ceil(s.shard_size / {BLOCK_WORDS}))::BIGINT AS n_blocks
  FROM shard s LEFT JOIN (SELECT rank, shard, count(*) AS n FROM q2 WHERE r <= quota GROUP BY rank, shard) w USING (rank, shard)
), plan2 AS (
  SELECT *, CASE WHEN shard_size > 0 THEN words // shard_size ELSE 0 END AS epochs,
         ('0x' || substr(md5('{SEED}|' || rank || '|' || shard), 1, 15))::BIGINT % n_blocks AS shift FROM plan
), plan3 AS (
  SELECT *, least(n_blocks, round((words - epochs * shard_size) / {BLOCK_WORDS}))::BIGINT AS extra FROM plan2
), laid AS (
  SELECT d.*, p.epochs, p.n_blocks, p.extra, p.shift,
         coalesce(sum(size) OVER (PARTITION BY d.rank, d.shard ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM doc d JOIN plan3 p ON d.rank = p.rank AND d.shard = p.shard
)
SELECT doc_id, size, source_size, target,
       (epochs * size + CASE WHEN size > 0 AND extra > 0 THEN list_sum(list_transform(range(start // {BLOCK_WORDS}, (start + size - 1) // {BLOCK_WORDS} + 1),
         lambda b: CASE WHEN (b * {STEP} + shift) % n_blocks < extra THEN least(start + size, (b + 1) * {BLOCK_WORDS}) - greatest(start, b * {BLOCK_WORDS}) ELSE 0 END)) ELSE 0 END)::BIGINT AS taken
FROM laid
"""
