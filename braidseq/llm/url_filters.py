"""URL filters: rules by host and path, and a list of canonical URLs.

The listed URLs are put into a blocked Bloom filter of bounded size. Pages it says no to are done without a
shuffle; the possible hits go to an exact hash join with the list, which removes the false ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bloom import BlockedBloom
from ._common import hash128, materialise, table
from .line_dedup import LOWER, UPPER

#: (action, host, path). The longest that fits wins.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Up to so many rules are one expression; more are a table that pages are joined with.
INLINE_RULES = 200
#: Words in the names of the hosts whose pages the query's list is drawn from.
LISTED_HOSTS = ("spam-farm", "cheap-pills", "adult-x", "ads-track", "casino-win", "free-bets")


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.translate(F.coalesce(F.regexp_extract(rest, "^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host and path without scheme, default port, fragment, `utm_` parameters and closing slashes; null without `://`."""
    query = F.regexp_replace(F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1), r"(?<=[?&])utm_[^&]*&?", "")
    whole = F.concat(F.regexp_replace(host_of(url), ":(80|443)$", ""), F.regexp_replace(path_of(url), "/+$", ""), F.regexp_replace(query, "[?&]+$", ""))
    return F.when(F.instr(url, "://") > 0, whole)


def rule_verdict(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits, or nulls. Equally long ones: the smaller text."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2], r[0]), reverse=True):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        rule, action = F.when(fits, rule_host + rule_path).otherwise(rule), F.when(fits, what).otherwise(action)
    return rule, action


def judged(rows: DataFrame, rules) -> DataFrame:
    """rows (host, path) with rule and action, for rules of any number, a list or a table (action, host, path).

    Many rules are joined on every suffix of a host that is whole labels and every start of a path that is as
    long as some rule's path. Each different host and path is looked up once.
    """
    if not isinstance(rules, DataFrame):
        if len(rules) <= INLINE_RULES:
            rule, action = rule_verdict(F.col("host"), F.col("path"), rules)
            return rows.withColumn("rule", rule).withColumn("action", action)
        rules = rows.sparkSession.createDataFrame(list(rules), "action string, host string, path string")
    rules = materialise(rules.groupBy(F.col("host").alias("on_host"), F.col("path").alias("on_path")).agg(F.min("action").alias("action")), "url-rules")
    sizes = rules.agg(F.collect_set(F.length("on_path")).alias("sizes"))  # as many as there are lengths of a path
    kinds = rows.select("host", "path").distinct().join(F.broadcast(sizes))
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.transform(F.filter("sizes", lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    asked = kinds.select("host", "path", F.explode(hosts).alias("on_host"), starts.alias("starts")).select("host", "path", "on_host", F.explode("starts").alias("on_path"))
    text = F.concat("on_host", "on_path")
    fits = asked.join(rules, ["on_host", "on_path"]).groupBy("host", "path").agg(F.min(F.struct((-F.length(text)).alias("size"), text.alias("rule"), "action")).alias("best"))
    fits = fits.select(F.col("host").alias("host__"), F.col("path").alias("path__"), "best.rule", "best.action")
    return rows.join(fits, (F.col("host") == F.col("host__")) & (F.col("path") == F.col("path__")), "left").drop("host__", "path__")


def filter_urls(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """page_id, url, host, path, rule, listed and verdict of every row of pages.

    Needs page_id and url of pages, and the column `canonical` of listed (repeats and nulls do no harm); other
    columns, whatever their names, are not read. rules: a list or table of (action, host, path). A null url or
    one without `://` has an empty host and path, fits no rule, is not listed and is allowed. Equal rows are
    judged each, urls of any length whole. Of rules that are equally long the smaller text wins, and of
    equal ones allow. Empty tables give an empty result or an empty list.
    """
    keys = materialise(listed.select("canonical").where("canonical is not null").distinct(), "url-list")
    bloom = BlockedBloom.of(keys.select(*hash128(F.col("canonical"))), "h1", "h2")
    rows = pages.select("page_id", "url").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))).withColumn("canonical", canonical(F.col("url")))
    rows = judged(rows, rules).select("*", *hash128(F.col("canonical")))
    rows = rows.withColumn("maybe", F.col("canonical").isNotNull() & bloom.maybe(F.col("h1"), F.col("h2"))).drop("h1", "h2")
    sure = rows.where("not maybe").withColumn("listed", F.lit(False))
    hits = rows.where("maybe").join(keys.withColumn("on__", F.lit(True)), "canonical", "left")
    both = sure.unionByName(hits.withColumn("listed", F.coalesce("on__", F.lit(False))).drop("on__"))
    verdict = F.coalesce("action", F.when(F.col("listed"), "block").otherwise("allow"))
    return both.select("page_id", "url", "host", "path", "rule", "listed", verdict.alias("verdict"))


def example_list(pages: DataFrame) -> DataFrame:
    """The list that the query takes, as the tables hold none: of the canonical URLs on hosts with one of the words of
    LISTED_HOSTS in their name those whose md5 begins with 4 to f (a list that does not know them all), and
    beside each of these an older address of the page, which no page has any more."""
    own = pages.where(host_of(F.col("url")).rlike("|".join(LISTED_HOSTS))).select(canonical(F.col("url")).alias("canonical")).where("substring(md5(canonical), 1, 1) >= '4'")
    return own.unionByName(own.select(F.concat("canonical", F.lit("/index.php")).alias("canonical")))


def op5_url_filters(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, example_list(pages)).select("page_id", "host", "path", "rule", "listed", "verdict")


def _case(pick: int) -> str:
    order = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    when = " ".join(f"WHEN (host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(a, h + p)[pick]}'" for a, h, p in order)
    return f"CASE {when} END"


SQL = rf"""
WITH p AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), q AS (
  SELECT page_id, url, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
         regexp_replace(regexp_replace(regexp_extract(url, '^[^?#]*(\?[^#]*)', 1), '([?&])utm_[^&]*(&|$)', '\1', 'g'), '([?&])utm_[^&]*(&|$)', '\1', 'g') AS query FROM p
), r AS (
  SELECT *, CASE WHEN contains(url, '://') THEN regexp_replace(host, ':(80|443)$', '') || regexp_replace(path, '/+$', '') || regexp_replace(query, '[?&]+$', '') END AS canonical FROM q
), known AS (SELECT DISTINCT canonical FROM r WHERE regexp_matches(host, '{"|".join(LISTED_HOSTS)}') AND substr(md5(canonical), 1, 1) >= '4'
), listed AS (SELECT canonical FROM known UNION SELECT canonical || '/index.php' FROM known
), v AS (
  SELECT page_id, host, path, {_case(1)} AS rule, {_case(0)} AS action, canonical IS NOT NULL AND canonical IN (SELECT canonical FROM listed WHERE canonical IS NOT NULL) AS listed FROM r
)
SELECT page_id, host, path, rule, listed, coalesce(action, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict FROM v
"""
