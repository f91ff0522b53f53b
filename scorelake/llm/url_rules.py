"""URL filtering: each URL is expanded into host-suffix and path-prefix expressions, which meet the rules' on short hash prefixes; full
digests confirm, and the longest rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hexadecimal digits of a digest that rules and expressions are joined on.
PREFIX = 8


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; null or no ://: empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _digest(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """id_col, host, path, rule (host and path of the longest rule that fits, else null) and verdict (the rule's, else `default`) of every
    row. rules: host, path (starting with /), verdict.

    A rule fits its host and all subdomains if the URL's path starts with the rule's. The longest host and path together win; of equal
    rules `block`, the later verdict by name. Null URLs and those without :// have an empty host and path, and get `default`. Repeated rows and
    null ids are each judged, an empty table gives none. Other columns aren't read, so their names can't clash.

    Each distinct URL is judged once. Only as many host suffixes and path prefixes are made as rules have numbers of labels and path lengths,
    so a long host or path costs in proportion. Verdicts are joined back to rows with a host by the URL alone; a URL with a third of all rows is
    a large partition of the left side, which Spark's adaptive execution splits (spark.sql.adaptive.skewJoin). Spark broadcasts the rules only
    below its size threshold. The driver gets those numbers and lengths, no more than the longest rule has characters.
    """
    listed = rules.select(F.concat("host", "path").alias("rule"), F.col("verdict").alias("ruled"), F.length("path").alias("n"), F.size(F.split("host", r"\.", -1)).alias("labels")).where("rule is not null")
    sizes, depths = (sorted(r[0] for r in listed.select(c).distinct().collect()) for c in ("n", "labels"))
    keyed = listed.groupBy("rule").agg(F.max("ruled").alias("ruled")).select("rule", "ruled", _digest(F.col("rule")).alias("rule_digest")).withColumn("key", F.substring("rule_digest", 1, PREFIX))
    own = pages.select(F.col(id_col).alias("own_id"), F.coalesce(F.col(url_col), F.lit("")).alias("own_url")).select("own_id", "own_url", host_of(F.col("own_url")).alias("host"), path_of(F.col("own_url")).alias("path"))
    urls = own.where("host != ''").select(F.col("own_url").alias("url"), "host", "path").distinct()
    dots = F.length("host") - F.length(F.replace("host", F.lit("."), F.lit("")))
    suffixes = F.transform(F.filter(F.array(*map(F.lit, depths)).cast("array<int>"), lambda n: n <= dots + 1), lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n))
    prefixes = F.transform(F.filter(F.array(*map(F.lit, sizes)).cast("array<int>"), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    spread = urls.select("url", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes")).select("url", "suffix", F.explode("prefixes").alias("prefix"))
    expressions = spread.select("url", _digest(F.concat("suffix", "prefix")).alias("digest"))
    hits = expressions.withColumn("key", F.substring("digest", 1, PREFIX)).join(keyed, "key").where(F.col("digest") == F.col("rule_digest"))
    best = hits.groupBy("url").agg(F.max_by(F.struct("rule", "ruled"), F.struct(F.length("rule"), "ruled", "rule")).alias("best")).select(F.col("url").alias("judged"), "best")
    found = own.where("host != ''").join(best, F.col("own_url") == F.col("judged"), "left").select("own_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.ruled", F.lit(default)).alias("verdict"))
    rest = own.where("host = ''").select("own_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    return found.union(rest).withColumnRenamed("own_id", id_col)
