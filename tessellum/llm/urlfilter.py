"""URL rules by host suffix and path prefix, found by hash equality.

A URL's host and path are expanded into expressions: every suffix of the host at a dot, and every
prefix of the path, as far as some rule has that many labels and that path length. The expressions
meet the rules in an equi-join on the first PREFIX hex digits of their SHA-256; full digests confirm
a match; the longest rule wins (then the longer host; then block before allow). DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellum.llm.common import written

PREFIX = 8


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z in lower case; else empty."""
    host = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """urls with host, path, rule (host and path of the rule that wins, or null) and verdict.

    rules: (action, host, path), in lower-case hosts. Every row stays, also repeated ones. A null URL,
    or one without ://, has an empty host and path, so no rule fits and the default holds. Columns of
    urls that are named like the new ones are replaced. An empty table of urls stays empty; without
    rules the default holds for all."""
    ours = ["host", "path", "rule", "verdict"]
    expression = F.concat("host", "path")
    rules = rules.select(
        "action", expression.alias("rule"), F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("path_length"), F.length("host").alias("host_length"),
        F.sha2(expression, 256).alias("digest"),
    ).filter("rule is not null and action is not null")
    rules = rules.withColumn("short", F.substring("digest", 1, PREFIX))
    #: Pairs of label count and path length: bounded by the longest rule, whatever the number of rules.
    shapes = [(r[0], r[1]) for r in rules.select("labels", "path_length").distinct().collect()]
    judged = urls.drop(*ours).withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    labels, length = F.size(F.split("host", r"\.")), F.length("path")
    expressions = [F.when((F.col("host") != "") & (labels >= n) & (length >= m), F.concat(F.substring_index("host", ".", -n), F.substring("path", 1, m))) for n, m in shapes]
    expanded = (
        judged.select("host", "path", F.explode(F.array_distinct(F.array_compact(F.array(*expressions) if expressions else F.array().cast("array<string>")))).alias("expression"))
        .withColumn("full", F.sha2("expression", 256))
        .withColumn("short", F.substring("full", 1, PREFIX))
    )
    order = F.struct(F.length("rule"), "host_length", (F.col("action") == "block").cast("int"), "action", "rule")
    won = (
        expanded.join(rules, "short")
        .filter("full = digest")
        .groupBy("host", "path")
        .agg(F.max_by(F.struct("rule", "action"), order).alias("won"))
        .select(F.col("host").alias("__host"), F.col("path").alias("__path"), F.col("won.rule").alias("rule"), F.col("won.action").alias("verdict"))
    )
    won = written(won, "verdicts").hint("merge")  # grows with the URLs, so it is never broadcast; Spark can split a host or page that many rows share
    kept = [F.col(f"`{c}`") for c in judged.columns]
    return judged.join(won, (judged["host"] == won["__host"]) & (judged["path"] == won["__path"]), "left").select(*kept, "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
