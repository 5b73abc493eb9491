"""SimHash near-duplicates by multi-index hashing.

Two fingerprints that differ in at most four bits differ, in three segments of them, in at most 1, 1 and 0 bits of some
segment (more would be five bits); in two segments, in at most 2 or 1. So each distinct fingerprint is entered in a table under its three segment values,
and looked up under all values in the small Hamming balls of these radii around its own. Matches are verified on
all 64 bits inside the join, so only true links leave it.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretrace.llm.common import cut_lineage, table
from foretrace.llm.components import connected_components
from foretrace.llm.fingerprint import fingerprint
from foretrace.llm.registry import query

DISTANCE = 4
#: Segment widths and radii for up to so many fingerprints: wider segments keep table entries short when there are more, at
#: the price of larger balls. Either finds all links.
SEGMENTS = ((1 << 26, (22, 21, 21), (1, 1, 0)), (1 << 63, (32, 32), (2, 1)))
#: Table entries with more fingerprints than this are not compared pair by pair but through their midpoints.
HEAVY = 1000


def _ball(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _segments(value: Column, widths: Sequence[int]) -> list[Column]:
    """The segments of a fingerprint, lowest bits first."""
    out, at = [], 0
    for width in widths:
        out.append(F.shiftrightunsigned(value, at).bitwiseAND(F.lit((1 << width) - 1)))
        at += width
    return out


def _keys(value: Column, widths: Sequence[int], radii: Sequence[int]) -> Column:
    """(segment number, value) as one number for all values in the balls of the given radii."""
    balls = []
    for number, (segment, width, radius) in enumerate(zip(_segments(value, widths), widths, radii)):
        masks = F.array(*[F.lit(mask) for mask in _ball(width, radius)])
        keyed = lambda m, s=segment, n=number: s.bitwiseXOR(m) + F.lit(n << 40)
        balls.append(F.transform(masks.cast("array<bigint>"), _one_argument(keyed)))
    return F.concat(*balls)


def _one_argument(function):
    """Spark counts a lambda's arguments, also those with defaults."""
    return lambda x: function(x)


def linked_pairs(
    prints: DataFrame,
    column: str,
    *,
    distance: int = DISTANCE,
    widths: Sequence[int] | None = None,
    radii: Sequence[int] | None = None,
    heavy: int = HEAVY,
) -> DataFrame:
    """(a, b), a < b: pairs of distinct values of ``column`` that differ in at most ``distance`` bits, but within
    crowded parts only as many of them as connect the same values.

    Where more than ``heavy`` fingerprints share a segment value, their pairs would be too many. Those fingerprints, and
    all that look them up, instead meet at midpoints: two values within ``distance`` share a value within half of it
    from both, and at most a ball of values can meet at a midpoint, where all are linked to the least.
    """
    values = prints.select(F.col(column).alias("f")).where(F.col("f").isNotNull()).distinct()
    values = cut_lineage(values)
    if widths is None:
        count = values.count()
        _, widths, radii = next(s for s in SEGMENTS if count <= s[0])
    if sum(widths) != 64 or sum(r + 1 for r in radii) <= distance:
        raise ValueError("the segments must cover 64 bits, and the radii every way to spread the distance")
    entries = values.select("f", F.explode(_keys(F.col("f"), widths, [0] * len(widths))).alias("key"))
    looked = values.select(F.col("f").alias("x"), F.explode(_keys(F.col("f"), widths, radii)).alias("key"))
    crowded = cut_lineage(entries.groupBy("key").count().where(F.col("count") > heavy).select("key"))
    near = F.bit_count(F.col("x").bitwiseXOR(F.col("f"))) <= distance
    light = entries.join(crowded, "key", "left_anti").withColumnRenamed("key", "at")
    pairs = looked.join(light, (F.col("key") == F.col("at")) & (F.col("x") != F.col("f")) & near)
    pairs = pairs.select(F.least("x", "f").alias("a"), F.greatest("x", "f").alias("b"))
    if not crowded.isEmpty():
        pairs = pairs.union(_through_midpoints(looked.join(crowded, "key", "left_semi").select("x").distinct(), distance))
    return pairs.distinct()


def _through_midpoints(values: DataFrame, distance: int) -> DataFrame:
    """Pairs of a crowded set: every value is sent to all values within half the distance, at each of which the values
    that arrived are pairwise within the whole distance by the triangle inequality, and so are linked to their least."""
    masks = F.array(*[F.lit(_signed(m)) for m in _ball(64, distance // 2)])
    if distance % 2:
        raise ValueError("midpoints need an even distance")
    sent = values.select("x", F.explode(F.transform(masks, lambda m: F.col("x").bitwiseXOR(m))).alias("z"))
    met = sent.groupBy("z").agg(F.min("x").alias("a"), F.collect_list("x").alias("xs")).where(F.size("xs") > 1)
    return met.select("a", F.explode("xs").alias("b")).where("a < b")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", heavy: int = HEAVY) -> DataFrame:
    """One row for each row of ``docs``: its id, ``fp`` (signed) and ``component_id``, the smallest id that is reachable
    over links of at most four differing bits.

    Texts without words (null, empty) have fingerprint zero and are linked like any other; rows with equal texts always
    share a component; repeated rows stay. A null id is never a component id unless the component has no other. Other
    columns are not carried. An empty table gives no rows.
    """
    prints = cut_lineage(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text)).alias("fp")))
    least = prints.groupBy("fp").agg(F.min("id").alias("least_id"))
    roots = connected_components(linked_pairs(least, "fp", heavy=heavy), "a", "b")
    joined = least.join(roots, least.fp == roots.node, "left")
    rooted = cut_lineage(joined.select("fp", "least_id", F.coalesce("root", "fp").alias("root")))
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_print = rooted.join(named, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


@query("op9_simhash_near_dup")
def op9_simhash_near_dup(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


__all__ = ["linked_pairs", "near_duplicates"]
