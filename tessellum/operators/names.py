"""A stored positional index of the character grams of names, for substring search.

Postings (gram, id, places) of grams of 1 to GRAM characters lie in folders by gram, names in a table of their
own. A pattern takes the lists of its two rarest grams, which have to stand at the right distance, and then
meets the names of the ids that are left; a pattern of GRAM characters or less is a gram and needs no names."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessellum.functions.text import GRAM

FOLDERS, SALTS = 32, 4
POSTINGS, COUNTS = "gram string, id string, places array<int>, part string, folder int", "gram string, n long, part string"


@dataclass
class NameIndex:
    """An index under a folder that driver and executors share."""

    spark: SparkSession
    path: str

    def read(self, table: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{table}")


def _folder_of(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(FOLDERS)).cast("int")


def add_names(index: NameIndex, names: DataFrame, name: str | None = None) -> None:
    """Add names (id, text); nothing that is stored is written again. Ids are strings and new.

    name: of the addition; one that comes again under its name takes its own place. Null and empty names have no grams."""
    part = f"part=p-{name or uuid.uuid4().hex}"
    names.select("id", "text").write.mode("overwrite").parquet(f"{index.path}/names/{part}")
    kept = index.spark.read.schema("id string, text string").parquet(f"{index.path}/names/{part}")
    none = F.array().cast("array<struct<gram:string,place:int>>")

    def of(n: int) -> Column:
        at = F.sequence(F.lit(1), F.length("text") - n + 1)
        return F.when(F.length("text") >= n, F.transform(at, lambda i: F.struct(F.substring("text", i, F.lit(n)).alias("gram"), i.alias("place")))).otherwise(none)

    places = F.concat(*[of(n) for n in range(1, GRAM + 1)])
    grams = kept.filter("length(text) > 0").select("id", F.explode(places).alias("g"))
    # a place is a posting: no shuffle puts the places of a gram and a name together, as a search takes them apart again
    lists = grams.select("g.gram", "id", F.array("g.place").alias("places")).withColumn("folder", _folder_of(F.col("gram")))
    dealt = lists.repartition("folder", F.pmod(F.xxhash64("id"), F.lit(SALTS))).sortWithinPartitions("folder", "gram", "id")
    dealt.write.mode("overwrite").partitionBy("folder").parquet(f"{index.path}/postings/{part}")
    stored = index.spark.read.schema("gram string, id string").parquet(f"{index.path}/postings/{part}")
    stored.groupBy("gram").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{index.path}/counts/{part}")


def search_substring(index: NameIndex, patterns: DataFrame) -> DataFrame:
    """Rows (pattern, id): each pattern with every name that contains it. Null and empty patterns are in no name."""
    asked = patterns.select("pattern").filter("length(pattern) > 0").distinct()
    wide = F.least(F.length("pattern"), F.lit(GRAM))
    grams = asked.select("pattern", F.explode(F.transform(F.sequence(F.lit(0), F.length("pattern") - wide), lambda i: F.struct(i.alias("at"), F.substring(F.col("pattern"), i + 1, wide).alias("gram")))).alias("g")).select("pattern", "g.at", "g.gram")
    counts = index.read("counts", COUNTS).groupBy("gram").agg(F.sum("n").alias("n"))
    counted = grams.join(counts, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    ranked = counted.withColumn("rank", F.row_number().over(W.partitionBy("pattern").orderBy("n", "at"))).filter("rank <= 2").withColumn("folder", _folder_of(F.col("gram")))
    postings = index.read("postings", POSTINGS)

    def begins(rank: int) -> DataFrame:
        """Where patterns would begin in each name by one of their grams: a row for each place and gram, however many patterns have it there."""
        own = ranked.filter(F.col("rank") == rank).select("folder", "gram", "at").distinct()
        met = postings.join(own, ["folder", "gram"]).select("id", F.explode("places").alias("place"), "at", "gram")
        return met.select("id", (F.col("place") - F.col("at")).alias("begin"), F.struct("at", "gram").alias(f"g{rank}")).filter("begin > 0")

    pairs = ranked.groupBy("pattern").agg(*[F.max(F.when(F.col("rank") == r, F.struct("at", "gram"))).alias(f"g{r}") for r in (1, 2)])
    short = ranked.filter((F.col("rank") == 1) & (F.length("pattern") <= GRAM)).select("folder", "gram", "pattern").join(postings, ["folder", "gram"]).select("pattern", "id").distinct()
    both = begins(1).join(begins(2), ["id", "begin"]).join(pairs, ["g1", "g2"]).select("pattern", "id").distinct()
    whole = both.join(index.read("names", "id string, text string"), "id").filter(F.contains("text", F.col("pattern")))
    return short.unionByName(whole.select("pattern", "id"))
