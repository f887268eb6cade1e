"""URL filters: host-suffix and path-prefix expressions, equality-joined on short hash prefixes.

Only DataFrame functions run here. Each distinct url is expanded into the expressions that a rule could
have (as many host labels and as long a path prefix as some rule has), each expression's SHA-256 is joined
with the rules on its first 32 bits alone, and the full digest then confirms the match. The longest rule wins.
A url's verdict is joined back to its rows; urls that a thousandth of the rows have are joined by broadcast.

Null urls, and urls without "://", have an empty host and an empty path, and no rule fits them; they are in no
join. Repeated rows and repeated urls each get a row of the result. An empty table gives an empty result. Other
columns of the input, whatever their names, are not read unless named. Urls of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kvloom.llm.shared import checkpointed, joined_by

RULE_SCHEMA = "rule_host string, rule_path string, action string"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules as (host, path, action)."""
    return spark.createDataFrame(rules, RULE_SCHEMA)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for a url without "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    before = F.regexp_extract(rest, r"\A([^?#]*)", 1)
    host = F.translate(F.substring_index(before, "/", 1), UPPER, LOWER)
    path = F.substring(before, F.length(F.substring_index(before, "/", 1)) + 1, F.length(before))
    return host, path


def _expression(host: Column, path: Column) -> Column:
    """Host and path as one text, which no other host and path have."""
    return F.concat(F.length(host).cast("string"), F.lit(":"), host, path)


def _short(digest: Column) -> Column:
    return F.substring(digest, 1, 8)


def filter_urls(
    pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """id, host, path, rule, verdict for every row of pages.

    A rule fits its host and all its subdomains if the url's path starts with the rule's path. The longest
    rule (host and path together) wins; among equally long ones the one with the longer host, then "block".
    Without a rule the verdict is `default`. Rules with a null host, path or action are ignored, and of
    equal rules with different actions "block" holds.
    """
    rules = (
        rules.where("rule_host IS NOT NULL AND rule_path IS NOT NULL AND action IS NOT NULL")
        .groupBy(F.translate("rule_host", UPPER, LOWER).alias("rule_host"), "rule_path")
        .agg(F.max(F.struct((F.col("action") == "block").alias("b"), "action"))["action"].alias("action"))
        .withColumn("rule_digest", F.sha2(_expression(F.col("rule_host"), F.col("rule_path")), 256))
        .withColumn("rule_short", _short(F.col("rule_digest")))
    )
    # The shapes that rules have bound the expressions of a url; there are few, however many rules there are.
    shapes = [
        (r["labels"], r["chars"])
        for r in rules.select(
            F.size(F.split("rule_host", r"\.")).alias("labels"), F.length("rule_path").alias("chars")
        ).distinct().collect()
    ]
    own = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
    host, path = url_parts(F.col("_url"))
    if not shapes:
        return own.select(
            F.col("_id").alias(id_col), host.alias("host"), path.alias("path"),
            F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"),
        )
    has = F.coalesce(F.instr("_url", "://") > 0, F.lit(False))
    found = own.where(has).groupBy("_url").agg(F.count("*").alias("_n")).select("_url", "_n", host.alias("h"), path.alias("p"))
    labels = F.size(F.split("h", r"\."))
    tried = F.array_compact(F.array(*[
        F.when((labels >= n) & (F.length("p") >= k), _expression(F.substring_index("h", ".", -n), F.substring("p", 1, k)))
        for n, k in shapes
    ]))
    found = found.select("_url", "_n", F.explode_outer(F.array_distinct(tried)).alias("tried"))
    found = found.select("_url", "_n", F.sha2("tried", 256).alias("digest"))
    rank = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("h"),
        (F.col("action") == "block").alias("b"), F.concat("rule_host", "rule_path").alias("rule"), "action",
    )
    # The join is on the short prefixes; the digest is compared in a form that makes no join key of it.
    confirmed = (F.col("digest") >= F.col("rule_digest")) & (F.col("digest") <= F.col("rule_digest"))
    best = (
        found.join(rules, (_short(F.col("digest")) == F.col("rule_short")) & confirmed, "left")
        .groupBy("_url", "_n")
        .agg(F.max(F.when(F.col("action").isNotNull(), rank)).alias("best"))
        .select("_url", "_n", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
    )
    best = checkpointed(best)
    rows = best.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    judged = joined_by(own.where(has), best, "_url", "_n", rows)
    other = own.where(~has).select("_url", "_id", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    return judged.select("_url", "_id", "rule", "verdict").union(other).select(F.col("_id").alias(id_col), host.alias("host"), path.alias("path"), "rule", "verdict")
