"""Rows of conversations in order, without one task for a long conversation.

Rows are dealt by ranges of (conversation, turn, role, text), sorted within each part and written; a row's
place is then (part, seq), whatever it takes to read the table again. A conversation of any length lies in
consecutive parts, and only the first and the last conversation of a part can go on in another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellum.llm.common import Scratch

#: Bits of monotonically_increasing_id that count rows within a partition.
SEQ = (1 << 33) - 1


def in_order(rows: DataFrame, order: list[str | Column], keep: list[str | Column], scratch: Scratch, name: str) -> DataFrame:
    """The columns `keep` of rows with part (int) and seq (long): rows sorted by `order` have ascending (part, seq).

    Equal rows take any order among themselves; they are told apart by where they come from, so that parts
    stay even when a great many rows are equal."""
    tagged = rows.withColumn("__from", F.monotonically_increasing_id())
    dealt = tagged.repartitionByRange(*order, "__from").sortWithinPartitions(*order, "__from")
    return scratch(dealt.select(*keep, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit(SEQ)).alias("seq")), name)


def positions(rows: DataFrame, key: str) -> DataFrame:
    """rows of in_order, sorted by `key` first, with pos: the number of the row within its key, from 1 on.

    What lies before a part is known for each key that spans several parts. A part shares its first and last
    key at most with others, so this table has at most two rows for each part and is broadcast."""
    parts = rows.groupBy(key, "part").agg(F.count("*").alias("n"))
    by_key = Window.partitionBy(key)
    spread = rows.groupBy("part").agg(F.min_by(key, "seq").alias("first"), F.max_by(key, "seq").alias("last")).select(F.explode(F.array_distinct(F.array("first", "last"))).alias(key)).distinct()
    spans = parts.join(F.broadcast(spread), key, "left_semi").withColumn("before", F.sum("n").over(by_key.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.filter("before is not null").select(F.col(key).alias("__key"), F.col("part").alias("__part"), "before")
    local = F.row_number().over(Window.partitionBy(key, "part").orderBy("seq"))
    numbered = rows.withColumn("local", local).join(F.broadcast(spans), F.col(key).eqNullSafe(F.col("__key")) & (F.col("part") == F.col("__part")), "left")
    return numbered.withColumn("pos", F.col("local") + F.coalesce("before", F.lit(0))).drop("local", "before", "__key", "__part")
