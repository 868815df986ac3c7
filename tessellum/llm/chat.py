"""Dialogues of several parties, rendered once from the perspective of each.

For each participant: the dialogue with that speaker as the assistant, all others as named users, and
masks that mark what the assistant says. DataFrame functions only. A dialogue comes in blocks of at
most BLOCK turn numbers, in the order of `block`, so that no task holds a whole dialogue of any length;
the blocks' texts, one after the other, are the whole rendering. A block of more than MOST rows, which
takes turn numbers that repeat, is cut further, in the order of `part`: each turn number by itself, one of
too many rows by a hash of its messages, and a message that is repeated too often by its repetitions.

Nothing that a speaker says can end a turn or begin one: in texts the opening of a mark is doubled
(`<|` becomes `<||`, which can be undone), and names lose their bars and line ends.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellum.llm.common import written

BLOCK = 64
#: Rows of a block that are rendered together; whole blocks have fewer unless turn numbers repeat.
MOST = 4096
END = "<|end|>\n"


def parts(rows: DataFrame, most: int) -> DataFrame:
    """Rows (conv, turn, speaker, text, block, part, times): part is empty, or [turn, piece, hash, copy] within blocks of too many rows."""
    none = F.array().cast("array<bigint>")
    rows = rows.withColumn("block", F.floor(F.col("turn") / BLOCK))
    full = written(rows.groupBy("conv", "block").agg(F.count("*").alias("n")).filter(F.col("n") > most).select(F.col("conv").alias("__conv"), F.col("block").alias("__block")), "full-blocks").hint("merge")
    plain = lambda df: df.withColumn("part", none).withColumn("times", F.lit(1).cast("bigint"))
    if full.isEmpty():
        return plain(rows)
    inside = F.col("conv").eqNullSafe(F.col("__conv")) & F.col("block").eqNullSafe(F.col("__block"))
    counted = rows.join(full, inside, "left_semi").groupBy("conv", "block", "turn", "speaker", "text").agg(F.count("*").alias("times"))
    turns = counted.groupBy(F.col("conv").alias("__conv"), F.col("block").alias("__block"), F.col("turn").alias("__turn")).agg(F.sum("times").alias("n")).hint("merge")
    joined = counted.join(turns, inside & F.col("turn").eqNullSafe(F.col("__turn")))
    hashed = F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce("speaker", F.lit("")), "text")), 1, 8), 16, 10).cast("bigint")
    pieces = F.ceil(F.col("n") / most)
    piece = F.floor(hashed * pieces / (1 << 32))
    copies = F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("times") / most) - 1)
    cut = joined.withColumn("hash", F.when(F.col("times") > most, hashed).otherwise(F.lit(0))).withColumn("piece", piece).select("*", F.explode(copies).alias("copy"))
    cut = cut.withColumn("part", F.array(F.coalesce("turn", F.lit(-1)).cast("bigint"), F.col("piece").cast("bigint"), F.col("hash"), F.col("copy"))).withColumn("times", F.least(F.lit(most), F.col("times") - F.col("copy") * most))
    columns = ["conv", "turn", "speaker", "text", "block", "part", "times"]
    return plain(rows.join(full, inside, "left_anti")).select(columns).unionByName(cut.select(columns))


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", fixed: Sequence[str] = ("system",), most: int = MOST) -> DataFrame:
    """Rows (conv, perspective, block, part, n_turns, n_trained, rendered, mask).

    fixed: speakers that are no participants; their turns keep their role. mask: [start, end) in
    characters of `rendered` for each of the perspective's own messages with its end mark. A null
    text is empty, a null speaker is the user `unknown` and has no perspective; a null turn number
    sorts first, in a block of its own; ties go by speaker, then text; repeated rows stay. A dialogue
    without participants gives no rows, nor does an empty table; other columns are left out."""
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(speaker).alias("speaker"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parties = rows.filter(F.col("speaker").isNotNull() & ~F.col("speaker").isin(*fixed)).select(F.col("conv").alias("of"), F.col("speaker").alias("perspective")).distinct()
    own = F.col("speaker").eqNullSafe(F.col("perspective"))
    name = F.translate(F.coalesce("speaker", F.lit("unknown")), "|\n\r", "/  ")
    head = F.when(own, F.lit("<|assistant|>\n")).when(F.col("speaker").isin(*fixed), F.concat(F.lit("<|"), "speaker", F.lit("|>\n"))).otherwise(F.concat(F.lit("<|user name="), name, F.lit("|>\n")))
    body = F.concat(F.replace("text", F.lit("<|"), F.lit("<||")), F.lit(END))
    message = F.struct("turn", "speaker", "text", own.alias("own"), head.alias("head"), body.alias("body"), "times")
    repeated = F.flatten(F.transform(F.array_sort(F.collect_list(message)), lambda m: F.array_repeat(m, m["times"].cast("int"))))
    grouped = parts(rows, most).join(parties, F.col("conv").eqNullSafe(F.col("of"))).groupBy("conv", "perspective", "block", "part").agg(repeated.alias("m"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(done, x):
        begin = done["at"] + F.length(x["head"])
        end = begin + F.length(x["body"])
        return F.struct(end.alias("at"), F.when(x["own"], F.concat(done["spans"], F.array(F.struct(begin.alias("start"), end.alias("end"))))).otherwise(done["spans"]).alias("spans"))

    return grouped.select(
        F.col("conv").alias(conv), "perspective", "block", "part", F.size("m").alias("n_turns"), F.size(F.filter("m", lambda x: x["own"])).alias("n_trained"),
        F.array_join(F.transform("m", lambda x: F.concat(x["head"], x["body"])), "").alias("rendered"),
        F.aggregate("m", start, step, lambda x: x["spans"]).alias("mask"),
    )
