"""URL filter: host-suffix and path-prefix expressions meet rules on short hash prefixes.

Each distinct (host, path) is expanded into all its host suffixes (at label borders) joined
with those path prefixes whose length some rule has. An expression and a rule meet on the
first bytes of their SHA-256, then the full digests are compared, then the longest rule
wins (of rules with one text, block wins).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

RULE_SCHEMA = "verdict string, host string, path string"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty for null and for urls without it."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_and_path(url: Column | str) -> tuple[Column, Column]:
    rest = F.coalesce(_rest(F.col(url) if isinstance(url, str) else url), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def _expressions(urls: DataFrame, lengths: list[int]) -> DataFrame:
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size("labels")),
        lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."),
    )
    prefixes = F.transform(
        F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path")),
        lambda n: F.substring("path", F.lit(1), n),
    )
    return (
        urls.withColumn("labels", labels)
        .select("host", "path", F.explode(suffixes).alias("suffix"))
        .select("host", "path", "suffix", F.explode(prefixes).alias("prefix"))
        .select("host", "path", F.sha2(F.concat("suffix", "prefix"), 256).alias("digest"))
    )


def filter_urls(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    hash_bytes: int = 4,
) -> DataFrame:
    """``id_col, host, path, rule, verdict`` of every row of ``pages``.

    ``rules`` has ``verdict, host, path``. A url that no rule fits gets ``default`` and a null
    rule. Null urls and urls without ``://`` have empty host and path, so only a rule with
    both empty would fit them. Repeated rows and null ids stay as they are; other columns are
    not carried. Rules with a null host or path are never fitted; with no rules all rows get the
    default.

    Only distinct (host, path) pairs are expanded, so a url that a third of all rows share is
    expanded once. The rules' distinct path lengths (at most the longest url's length) are
    the only thing that is collected. The joins are plain equi-joins: Spark broadcasts the rules where
    its size check allows, and shuffles otherwise.
    """
    rules = rules.where("host is not null and path is not null").select(
        "verdict", F.concat("host", "path").alias("rule"), F.length("path").alias("n")
    )
    lengths = sorted(r.n for r in rules.select("n").distinct().collect())
    keyed = rules.select(
        "verdict", "rule", F.sha2("rule", 256).alias("rule_digest")
    ).withColumn("short", F.substring("rule_digest", 1, 2 * hash_bytes))
    host, path = host_and_path(url_col)
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    if not lengths:
        return rows.select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    made = _expressions(rows.select("host", "path").distinct(), lengths).withColumn(
        "short", F.substring("digest", 1, 2 * hash_bytes)
    )
    best = F.max(F.struct(F.length("rule").alias("n"), (F.col("verdict") == "block").alias("b"), "rule", "verdict"))
    fitted = (
        made.join(keyed, "short")
        .where("digest = rule_digest")
        .groupBy("host", "path")
        .agg(best.alias("best"))
        .select("host", "path", "best.rule", "best.verdict")
    )
    return rows.join(fitted, ["host", "path"], "left").select(
        id_col, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, RULE_SCHEMA)
