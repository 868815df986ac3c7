"""Joins of intervals [start, end) of one key that overlap, as equi-joins on bins.

An interval lies on the first level whose bins are no shorter than it is, so in two bins there at most.
A pair meets on the higher of its two levels: each side is laid out on its own level and on those above
it, tags let only such meet of which one is on its own level, and the pair counts in the one bin where the
later of the two begins. So no key's rows are compared all with all: those that a bin compares with others
are about as long as it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins of each level have 2^shift places; the last level has one bin.
SHIFTS = (6, 12, 18, 24, 62)


def _laid_out(rows: DataFrame, start: Column, end: Column, own_tags: list[int], other_tags: list[int]) -> DataFrame:
    """rows for each level from their own on, each bin and each tag there: __level, __bin, __tag."""
    last = F.greatest(end - 1, start)
    own = F.lit(0)
    for i, shift in enumerate(SHIFTS[:-1]):
        own = F.when(last - start >= F.lit(1 << shift), F.lit(i + 1)).otherwise(own)

    def places(level: int, tag: int, at_own: bool) -> Column:
        a, b = F.shiftright(start, SHIFTS[level]), F.shiftright(last, SHIFTS[level])
        here = own == level if at_own else own < level
        return F.when(here, F.transform(F.sequence(a, b), lambda x: F.struct(F.lit(level).alias("__level"), x.alias("__bin"), F.lit(tag).alias("__tag"))))

    every = [places(level, tag, at_own) for level in range(len(SHIFTS)) for at_own, tags in ((True, own_tags), (False, other_tags)) for tag in tags]
    return rows.select("*", F.explode(F.flatten(F.array_compact(F.array(*every)))).alias("__at")).select("*", "__at.*").drop("__at")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str] = ("start", "end"), right_span: tuple[str, str] = ("start", "end")) -> DataFrame:
    """Pairs of left and right rows of equal keys where left.start < right.end and left.end > right.start.

    Columns are left's, and right's but for the keys; apart from the keys no name may stand on both sides.
    Rows with a null key, start or end meet nothing; an empty interval meets those that it lies inside of;
    repeated rows meet each by itself."""
    ls, le, rs, re = (F.col(c).cast("long") for c in (*left_span, *right_span))
    # tags: 0 both on their own level, 1 the left one alone, 2 the right one alone
    a = _laid_out(left, ls, le, [0, 1], [2])
    b = _laid_out(right.withColumnsRenamed({k: f"__{k}" for k in keys}), rs, re, [0, 2], [1]).withColumnsRenamed({c: f"{c}_right" for c in ("__level", "__bin", "__tag")})
    same = (F.col("__level") == F.col("__level_right")) & (F.col("__bin") == F.col("__bin_right")) & (F.col("__tag") == F.col("__tag_right"))
    for k in keys:
        same &= F.col(k) == F.col(f"__{k}")
    meet = (ls < re) & (le > rs)
    shift = F.element_at(F.array(*[F.lit(s) for s in SHIFTS]), F.col("__level") + 1)
    once = F.col("__bin") == F.call_function("shiftright", F.greatest(ls, rs), shift)
    rest = [c for c in right.columns if c not in keys]
    return a.join(b, same).filter(meet & once).select(*left.columns, *rest)


def containing_point(points: DataFrame, intervals: DataFrame, keys: list[str], point: str = "at", span: tuple[str, str] = ("start", "end")) -> DataFrame:
    """Rows of points (keys, point, ...) with each interval of their keys that has start <= point < end."""
    rows = points.withColumn("__after", F.col(point).cast("long") + 1)
    return overlapping(rows, intervals, keys, (point, "__after"), span).drop("__after")
