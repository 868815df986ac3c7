"""Cheapest repair of the turns of a conversation, by a fold in Spark SQL.

A repaired conversation has role initials `(s?(ua)+)?`. A row is kept (cost 0), given another role (2) or
deleted (3; blank rows and repetitions have to be), an empty turn inserted (2); a truncated row that stays
adds 1. The automaton of the pattern has four states: before anything, after s, after u, after a. For each,
the fold carries the least (cost, audit), so `aggregate` over sorted turn structs with `least` of structs
finds the cheapest edits, and among equals the ASCII-least initials: of two audits of one cost over the
same rows neither is the beginning of the other (what follows would be insertions, which cost), so a least
one stays least whatever is appended to both.

Flags come before: blank, repeated (by the first place of each role and text), truncated, illegal pairs
by `lag`. A conversation of any length is cut into blocks of BLOCK rows; a block that may be one of
several is folded from each of the four states, and such 4 x 4 tables of (cost, audit) are chained, which
gives what one fold over all rows would."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellum.llm.common import Scratch, turn_to
from tessellum.llm.turns import in_order

#: Rows of a block: seq >> BLOCK_BITS.
BLOCK_BITS = 8
#: Blocks chained at a time.
CHAIN_BITS = 6
#: The cost of a state that can't be reached.
FAR = 1 << 40
STATES = ("start", "system", "user", "assistant")
PAIR = "struct<cost:bigint,audit:string>"
WORD = r"[^\x20\x09-\x0D]"
EMPTY = hashlib.sha256(b"").hexdigest()
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def pair(cost: Column | int, audit: Column | str) -> Column:
    return F.struct(F.lit(cost).cast("long").alias("cost"), F.lit(audit).cast("string").alias("audit"))


def then(one: Column, cost: Column | int, letters: Column | str) -> Column:
    """(cost, audit) with further edits."""
    return pair(one["cost"] + F.lit(cost).cast("long"), F.concat(one["audit"], F.lit(letters).cast("string")))


def state(**of: Column) -> Column:
    return F.struct(*[of[name].cast(PAIR).alias(name) for name in STATES])


def closed(x: Column) -> Column:
    """With the turns inserted that lead from state to state."""
    user = F.least(x["user"], then(x["start"], 2, "I"), then(x["system"], 2, "I"), then(x["assistant"], 2, "I"))
    assistant = F.least(x["assistant"], then(x["user"], 2, "I"), then(x["start"], 4, "II"), then(x["system"], 4, "II"))
    return state(start=x["start"], system=x["system"], user=user, assistant=assistant)


def step(x: Column, row: Column) -> Column:
    """The states after one more row (initial, dead, cut): cut is 1 where a row that stays is truncated."""
    gone = {name: then(x[name], 3, "D") for name in STATES}

    def stays(before: Column, initial: str) -> Column:
        same = row["initial"] == initial
        return F.when(~row["dead"], then(before, row["cut"] + F.when(same, 0).otherwise(2), F.when(same, "K").otherwise("R")))

    system = F.when(~row["dead"] & (row["initial"] == "s"), then(x["start"], row["cut"], "K"))
    user = stays(F.least(x["start"], x["system"], x["assistant"]), "u")
    assistant = stays(x["user"], "a")
    moved = state(start=gone["start"], system=F.least(gone["system"], system), user=F.least(gone["user"], user), assistant=F.least(gone["assistant"], assistant))
    return let(moved, closed)


def begun(name: str) -> Column:
    """The states where only the named one is reached."""
    return state(**{s: pair(0 if s == name else FAR, "") for s in STATES})


def fold(turns: Column, start: Column) -> Column:
    return F.aggregate(turns, start, step)


def table_of(turns: Column) -> Column:
    """For each first state, in order, the four last states: 16 pairs."""
    starts = F.array(*[begun(s) for s in STATES])
    return F.flatten(F.transform(starts, lambda start: let(fold(turns, start), lambda x: F.array(*[x[s] for s in STATES]))))


def chained(a: Column, b: Column) -> Column:
    """Two tables of 16 pairs, one after the other."""

    def cell(c: Column) -> Column:
        i, j = F.floor(c / 4).cast("int") * 4, c % 4
        return F.array_min(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: let(a[i + k], lambda x: let(b[k * 4 + j], lambda y: then(x, y["cost"], y["audit"])))))

    return F.transform(F.sequence(F.lit(0), F.lit(15)), cell)


LEGAL = ("su", "ua", "au")


def illegal(before: Column, after: Column) -> Column:
    return F.coalesce((~F.concat(before, after).isin(*LEGAL)).cast("long"), F.lit(0).cast("long"))


SUMS = ("blank", "duplicate", "truncated", "illegal", "n_turns")


def merged(a: Column, b: Column) -> Column:
    """What is known of two neighbouring runs of rows."""
    sums = [(a[c] + b[c]).alias(c) for c in SUMS if c not in ("illegal", "n_turns")]
    sums.append((a["illegal"] + b["illegal"] + illegal(a["last"], b["first"])).alias("illegal"))
    sums.append((a["n_turns"] + b["n_turns"] - F.coalesce((a["high"] == b["low"]).cast("long"), F.lit(0).cast("long"))).alias("n_turns"))
    return F.struct(
        *sums, F.coalesce(a["low"], b["low"]).alias("low"), F.coalesce(b["high"], a["high"]).alias("high"), a["first"].alias("first"), b["last"].alias("last"),
        F.concat(a["sizes"], b["sizes"]).alias("sizes"), chained(a["paths"], b["paths"]).alias("paths"),
    )


def chain(runs: DataFrame, by: list[str]) -> DataFrame:
    """The runs (…, part, block, run) of equal `by`, in order, as one run."""
    listed = runs.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("part", "block", "run"))).alias("runs"), F.min("part").alias("first_part"), F.min("block").alias("first_block"))
    joined = F.aggregate(F.slice("runs", 2, 1 << 30), F.element_at("runs", 1)["run"], lambda x, y: merged(x, y["run"]))
    rest = [F.col(c) for c in by if c != "wide"]
    placed = [F.col("first_part").alias("part")] if "part" not in by else []
    return listed.select(*rest, *placed, F.col("first_block").alias("block"), joined.alias("run"))


def lines(turns: Column, audit: Column, before: Column, odd: Column) -> Column:
    """The repaired `role:text` of sorted turns by their part of an audit. before: repaired turns so far; odd: 1 if
    the whole result has an odd number of turns, so that a system turn leads it."""

    def line(i: Column) -> Column:
        so_far = audit.substr(F.lit(1), i - 1)
        letter = audit.substr(i, F.lit(1))
        nth = before + F.length(F.replace(so_far, F.lit("D"), F.lit("")))
        role = F.when((nth - odd) % 2 == 0, "user").otherwise("assistant")
        row = F.get(turns, F.length(F.replace(so_far, F.lit("I"), F.lit(""))))
        return F.when(letter == "I", F.concat(role, F.lit(":"))).when(letter == "K", F.concat(row["role"], F.lit(":"), row["text"])).when(letter == "R", F.concat(role, F.lit(":"), row["text"]))

    n = F.length(audit)
    return F.array_compact(F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), line))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with planted faults by crc32(`conv_id:turn`) % 20: 0 drops the row, 1 empties
    its text, 2 takes its `.!?`, 3 repeats it, 4 makes it the user's. Nulls of id and turn count as one space there."""
    number = F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])) % 20
    text = F.when(F.col("__fault") == 1, "").when(F.col("__fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("__fault") == 4, "user").otherwise(F.col("role"))
    hit = rows.withColumn("__fault", number).filter("__fault <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), "__fault")
    return hit.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.when(F.col("__fault") == 3, 2).otherwise(1)))).drop("__fault", "__copy")


def spaced(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with null roles and texts as one space; other columns go."""
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])


def flagged(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The ordered rows with their texts, and without them but with their faults."""
    word = F.regexp_extract("text", rf"(?s)^.*({WORD})", 1)  # the last one
    looks = F.when(word == "", "blank").when(~word.isin(".", "!", "?"), "truncated").alias("looks")
    kept = ["conv_id", "turn", "role", "text", F.substring("role", 1, 1).alias("initial"), looks, F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("same")]
    ordered = in_order(rows, [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], kept, scratch, "ordered")
    first = ordered.groupBy("conv_id", "same").agg(F.min(F.struct("part", "seq")).alias("at")).select("at.*", F.lit(True).alias("is_first"))
    block = F.shiftright("seq", BLOCK_BITS).alias("block")
    thin = ordered.select("conv_id", "turn", "initial", "looks", "part", "seq", block).join(first, ["part", "seq"], "left")
    fault = F.when(F.col("looks") == "blank", "blank").when(F.col("is_first").isNull(), "duplicate").otherwise(F.col("looks"))
    return ordered.select("conv_id", "role", "text", "part", "seq", block), thin.select("conv_id", "turn", "initial", "part", "seq", "block", fault.alias("fault"))


def blocks(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """Runs of rows of one conversation in one block: counts, sorted turn structs, and whether the run may go on beyond it."""
    keys = ["conv_id", "part", "block"]
    before = F.lag("initial").over(Window.partitionBy(*keys).orderBy("seq"))
    row = F.struct("seq", "initial", F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False)).alias("dead"), F.coalesce((F.col("fault") == "truncated").cast("int"), F.lit(0)).alias("cut"))
    found = (
        rows.withColumn("off", illegal(before, F.col("initial")))
        .groupBy(*keys)
        .agg(
            *[F.coalesce(F.count_if(F.col("fault") == f), F.lit(0)).alias(f) for f in ("blank", "duplicate", "truncated")], F.sum("off").alias("illegal"), F.size(F.collect_set("turn")).cast("long").alias("n_turns"),
            F.min("turn").alias("low"), F.max("turn").alias("high"), F.min_by("initial", "seq").alias("first"), F.max_by("initial", "seq").alias("last"), F.count("*").alias("n"),
            F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.array_sort(F.collect_list(row)).alias("turns"),
        )
    )
    edge = (F.shiftright("last_seq", BLOCK_BITS) != F.shiftright(F.col("last_seq") + 1, BLOCK_BITS)) | (F.col("first_seq") % (1 << BLOCK_BITS) == 0) | (F.col("last_seq") == F.col("end"))
    return found.join(F.broadcast(ends), "part").withColumn("edge", edge).drop("end", "first_seq", "last_seq")


def digests(texts: DataFrame, kind: str) -> DataFrame:
    """The SHA-256 of the blocks (conv_id, part, block, body) of each conversation, newline-joined. Texts go by one
    after the other; no task holds a conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        turn_to("")
        now, sha = None, None
        for batch in batches:
            ids, bodies = batch.column("conv_id"), batch.column("body")
            done, names = [], []
            for i in range(batch.num_rows):
                key = (ids[i].as_py(),)
                if key != now:
                    if now:
                        names.append(now[0]), done.append(sha.hexdigest())
                    now, sha, apart = key, hashlib.sha256(), b""
                sha.update(apart + bodies[i].as_py().encode())
                apart = b"\n"
            yield pa.RecordBatch.from_arrays([pa.array(names, batch.schema.field("conv_id").type), pa.array(done, pa.string())], ["conv_id", "repaired_sha256"])
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([now[0]], batch.schema.field("conv_id").type), pa.array([sha.hexdigest()])], ["conv_id", "repaired_sha256"])

    dealt = texts.select("conv_id", "part", "block", "body").repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")
    return dealt.select("conv_id", "body").mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def repair(conversations: DataFrame, rows: DataFrame | None = None, scratch: Scratch | None = None) -> DataFrame:
    """A row for each conv_id of conversations: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    rows: what is to be repaired, where it isn't the conversations themselves; an id without rows has zeros,
    an empty audit and the hash of nothing. Rows are taken by turn (nulls first), equal turns by role and
    text; null roles and texts count as one space; a null conv_id is a conversation of its own; repeated rows
    are duplicates; other columns are not read. Without any conversations there are no rows."""
    scratch = scratch or Scratch(conversations.sparkSession)
    kind = conversations.schema["conv_id"].dataType.simpleString()
    full, thin = flagged(spaced(conversations if rows is None else rows), scratch)
    ends = full.groupBy("part").agg(F.max("seq").alias("end"))  # a row for each partition
    found = scratch(blocks(thin, ends), "blocks")

    # conversations of one block: one fold; else a table of folds for each block, chained block by block
    run = [*SUMS, "low", "high", "first", "last"]
    end = lambda x: F.least(x["start"], x["assistant"])
    alone = found.filter("not edge").withColumn("best", let(fold(F.col("turns"), closed(begun("start"))), end))
    sizes = F.array(F.struct("part", "block", "n")).alias("sizes")
    runs = found.filter("edge").select("conv_id", "part", "block", F.struct(*run, sizes, table_of(F.col("turns")).alias("paths")).alias("run"))
    wide = chain(runs.withColumn("wide", F.shiftright("block", CHAIN_BITS)), ["conv_id", "part", "wide"])
    whole = scratch(chain(chain(wide, ["conv_id", "part"]), ["conv_id"]), "chained")

    def way(i: str, cost: int, audit: str, j: str) -> Column:
        return let(F.col("run.paths")[STATES.index(i) * 4 + STATES.index(j)], lambda x: pair(x["cost"] + cost, F.concat(F.lit(audit), x["audit"])))

    ways = [way(*first, j) for first in (("start", 0, ""), ("user", 2, "I"), ("assistant", 4, "II")) for j in ("start", "assistant")]
    whole = whole.withColumn("best", F.least(*ways))
    gaps = F.when(F.col("low").isNull(), F.lit(0)).otherwise(F.col("high") - F.col("low") + 1 - F.col("n_turns")).cast("long").alias("gaps")
    def judged(df: DataFrame, blocks_of: Column) -> DataFrame:
        return df.select("conv_id", gaps, "blank", "duplicate", "truncated", "illegal", "best.cost", "best.audit", blocks_of.alias("sizes"))

    verdicts = scratch(judged(alone, sizes).unionByName(judged(whole.select("conv_id", "run.*", "best"), F.col("sizes"))), "verdicts")
    scratch.drop("blocks")

    # the edits of each block: its rows' letters, each with the insertions before it
    odd = F.length(F.replace("audit", F.lit("D"), F.lit(""))) % 2
    single = verdicts.filter(F.size("sizes") == 1).select("conv_id", "sizes", F.col("audit").alias("edits"), F.lit(0).alias("before"), odd.alias("odd"))
    single = single.select("conv_id", F.col("sizes")[0]["part"].alias("part"), F.col("sizes")[0]["block"].alias("block"), "edits", "before", "odd", F.lit(True).alias("only"))
    pieces = verdicts.filter(F.size("sizes") > 1).select("conv_id", "sizes", odd.alias("odd"), F.regexp_extract_all("audit", F.lit("I*[KRD]"), F.lit(0)).alias("pieces"), F.regexp_extract("audit", "I*$", 0).alias("tail"))
    starts = F.aggregate("sizes", F.array(F.lit(1).cast("long")), lambda a, s: F.concat(a, F.array(F.element_at(a, -1) + s["n"])))
    last = F.size("sizes") - 1

    def share(at: Column, i: Column) -> Column:
        letters = F.array_join(F.slice("pieces", F.get("starts", i).cast("int"), at["n"].cast("int")), "")
        return F.struct(at["part"].alias("part"), at["block"].alias("block"), F.concat(letters, F.when(i == last, F.col("tail")).otherwise("")).alias("edits"))

    pieces = pieces.withColumn("starts", starts).select("conv_id", "odd", F.explode(F.transform("sizes", share)).alias("at")).select("conv_id", "odd", "at.*")
    so_far = F.sum(F.length(F.replace("edits", F.lit("D"), F.lit("")))).over(Window.partitionBy("conv_id").orderBy("part", "block").rowsBetween(Window.unboundedPreceding, -1))
    several = pieces.select("conv_id", "part", "block", "edits", F.coalesce(so_far, F.lit(0)).cast("int").alias("before"), "odd", F.lit(False).alias("only"))
    todo = single.unionByName(several).withColumnRenamed("conv_id", "__id")

    texts = full.groupBy("conv_id", "part", "block").agg(F.array_sort(F.collect_list(F.struct("seq", "role", "text"))).alias("turns"))
    met = texts.join(todo, (texts["conv_id"].eqNullSafe(todo["__id"])) & (texts["part"] == todo["part"]) & (texts["block"] == todo["block"])).select("conv_id", texts["part"], texts["block"], "turns", "edits", "before", "odd", "only")
    made = met.select("conv_id", "part", "block", "only", lines(F.col("turns"), F.col("edits"), F.col("before"), F.col("odd")).alias("lines"))
    made = scratch(made.select("conv_id", "part", "block", F.array_join("lines", "\n").alias("body"), (F.size("lines") > 0).alias("any"), "only"), "bodies")
    hashed = made.filter("only").select("conv_id", F.sha2("body", 256).alias("repaired_sha256")).unionByName(digests(made.filter("not only and any"), kind))

    ids = conversations.select("conv_id").distinct()
    hashed, verdicts = hashed.withColumnRenamed("conv_id", "__h"), verdicts.withColumnRenamed("conv_id", "__v")
    out = ids.join(verdicts, ids["conv_id"].eqNullSafe(verdicts["__v"]), "left")
    out = out.join(hashed, out["conv_id"].eqNullSafe(hashed["__h"]), "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in (*COUNTS, "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY)).alias("repaired_sha256"))
