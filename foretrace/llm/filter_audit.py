"""Filter interaction audit: what each filter removes at every place of every order of the filters.

A document's failures are bits. One filter looks at the document alone, another asks whether its text stands under a
smaller id: an existential self-join. Rows whose text hash stands under several ids are semi-joined on hash, exact text
and smaller id; what that join keeps fails. Its ids are united with those of the other failures, and rows are counted by
part and combination of bits. All orders are then read from these counts, of which a part has at most 2^filters.

Texts that very many rows share are dealt over ``SALTS`` tasks; their other side is one row for each text, which is
combined before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretrace.llm.common import cut_lineage, table
from foretrace.llm.registry import query

#: A hash with more rows than both is hot: so many rows, and this share of all, so that there are few such hashes.
HOT_ROWS, HOT_SHARE, SALTS = 10_000, 1000, 64
#: Filters of the registered query, with the conditions under which a text fails them; COPIES is the self-join.
COPIES = "E"
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 50, 65, 5


def text_failures(text: Column) -> dict[str, Column]:
    """Filters A to D: few words, few different words, many capitals, a sign of ``#$%&*|``."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    words = F.split(trimmed, r"[\x20\x09-\x0D]+")
    count = F.when(trimmed == "", 0).otherwise(F.size(words))
    different = F.when(trimmed == "", 0).otherwise(F.size(F.array_distinct(words)))
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", "")).cast("bigint")
    return {
        "A": count < MIN_WORDS,
        "B": 100 * different.cast("bigint") < DISTINCT_PERCENT * count.cast("bigint"),
        "C": 100 * capitals > CAPITAL_PERCENT * F.char_length(text).cast("bigint"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def later_copies(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of ``texts`` (id, part, text, hash, more) whose text also stands under a smaller id, without their texts.

    ``rows`` has (id, hash) of the same rows. Rows with a null id have no smaller id and are none to others.
    """
    hot_rows = max(HOT_ROWS, rows.count() // HOT_SHARE)
    shared = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))
    shared = cut_lineage(shared.where("low < high").select("hash", (F.col("n") > hot_rows).alias("hot")))
    salts = F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt")
    hot = F.broadcast(shared.where("hot"))  # at most HOT_SHARE hashes
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).otherwise(0)
    dealt = texts.join(hot, "hash", "left").withColumn("salt", salt)
    met = dealt.join(shared.select("hash", salts), ["hash", "salt"], "left_semi")
    least = met.groupBy("hash", "text", F.coalesce("hot", F.lit(False)).alias("hot")).agg(F.min("id").alias("low"))
    first = least.select(F.col("hash").alias("h"), salts.alias("s"), F.col("text").alias("t"), "low")
    same = (F.col("hash") == F.col("h")) & (F.col("salt") == F.col("s")) & (F.col("text") == F.col("t"))
    return met.join(first, same & (F.col("low") < F.col("id")), "left_semi").drop("text", "salt", "hot")


def failure_counts(
    docs: DataFrame,
    labels: DataFrame,
    failures: Mapping[str, Column] | None = None,
    *,
    copies: str = COPIES,
    id_col: str = "doc_id",
    text: str = "text",
    part: str = "source",
) -> DataFrame:
    """(part, failed, n, good, toxic): rows of ``docs`` by part and combination of failure bits.

    ``failures`` has a condition on the column ``text`` for each filter, by default ``text_failures``; ``copies`` names the
    filter of the self-join, whose bit is the last. A null text is empty, a null part the empty string. ``good`` and
    ``toxic`` count rows whose id has a label with quality 1, with toxic 1; several labels of an id count once. Repeated
    rows are rows of their own; the same text under the same id is no copy; other columns are not looked at.
    """
    failures = failures or text_failures(F.col("text"))
    taken = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    texts = taken.withColumns({"hash": F.xxhash64("text"), "more": F.xxhash64(F.lit(1), "text")})
    bits = [F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(failures.values())]
    key = ["id", "part", "hash", "more"]
    rows = cut_lineage(texts.select(*key, sum(bits[1:], bits[0]).alias("bits")))
    marked = later_copies(texts, rows).select(*key, F.lit(1 << len(bits)).alias("bits"), F.lit(0).alias("one"))
    united = rows.select("*", F.lit(1).alias("one")).union(marked)
    each = united.groupBy(*key).agg(F.bit_or("bits").alias("failed"), F.sum("one").alias("n"))
    flags = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id"))
    flags = flags.agg(*[F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c) for c in ("quality", "toxic")])
    judged = each.join(flags, "id", "left")
    weighed = lambda c: F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0)))
    return judged.groupBy("part", "failed").agg(F.sum("n").alias("n"), weighed("quality").alias("good"), weighed("toxic").alias("toxic"))


def order_report(counts: DataFrame, letters: str) -> DataFrame:
    """One row for each part, order of the filters ``letters`` and step, from ``failure_counts``.

    The filter of a step sees what the earlier ones left. A row that fails k filters is removed by each of them in the
    same share of all orders, so ``shapley`` adds orders / k for it.
    """
    size, orders = len(letters), ["".join(p) for p in permutations(letters)]
    bit = [1 << letters.index(order[i]) for order in orders for i in range(size)]
    before = [sum(1 << letters.index(c) for c in order[:i]) for order in orders for i in range(size)]
    at = lambda values, dtype: F.element_at(F.lit(values), F.col("place") + 1).cast(dtype)
    spread = counts.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(len(bit) - 1))))
    spread = spread.withColumns({"bit": at(bit, "int"), "before": at(before, "int")})
    hits, passed = F.col("failed").bitwiseAND(F.col("bit")) != 0, F.col("failed").bitwiseAND(F.col("before")) == 0
    total = lambda when, value, name: F.sum(F.when(when, F.col(value)).otherwise(0)).cast("bigint").alias(name)
    share = F.expr(f"n * ({factorial(size)} div bit_count(failed))")
    found = spread.groupBy("part", "place").agg(
        total(passed & ~hits, "n", "kept"),
        total(passed & hits, "n", "removed"),
        total(~passed & hits, "n", "redundant"),
        total(F.col("failed") == F.col("bit"), "n", "unique_fails"),
        total(passed & hits, "good", "good_lost"),
        total(passed & hits, "toxic", "toxic_lost"),
        F.sum(F.when(hits, share).otherwise(0)).cast("bigint").alias("shapley"),
    )
    order = F.element_at(F.lit(orders), F.expr(f"CAST(place div {size} AS int)") + 1).alias("filter_order")
    facts = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return found.select("part", order, (F.col("place") % size + 1).cast("int").alias("step"), *facts)


def audit_filters(docs: DataFrame, labels: DataFrame, failures: Mapping[str, Column] | None = None, *, copies: str = COPIES, **names) -> DataFrame:
    """``order_report`` over ``failure_counts``; an empty table has no parts and so no rows."""
    letters = "".join(failures or text_failures(F.col("text"))) + copies
    return order_report(failure_counts(docs, labels, failures, copies=copies, **names), letters)


SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), flagged AS (
  SELECT doc_id, part, (len(words) < {MIN_WORDS})::INT
    + 2 * (100 * len(list_distinct(words)) < {DISTINCT_PERCENT} * len(words))::INT
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {CAPITAL_PERCENT} * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), FALSE)::INT AS failed
  FROM d
), lab AS (
  SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1
), counts AS (
  SELECT part, failed, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM flagged LEFT JOIN lab USING (doc_id) GROUP BY 1, 2
), l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 4, 8, 16]) AS b
), orders AS (
  SELECT l1.c || l2.c || l3.c || l4.c || l5.c AS filter_order, [l1.b, l2.b, l3.b, l4.b, l5.b] AS bits
  FROM l l1, l l2, l l3, l l4, l l5 WHERE l1.b + l2.b + l3.b + l4.b + l5.b = 31 AND (l1.b | l2.b | l3.b | l4.b | l5.b) = 31
), steps AS (
  SELECT filter_order, step::INT AS step, bits[step] AS bit, coalesce(list_sum(bits[1 : step - 1]), 0)::INT AS earlier
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
)
SELECT part, filter_order, step,
  coalesce(sum(n) FILTER (failed & (bit | earlier) = 0), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (failed & bit <> 0 AND failed & earlier = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (failed & bit <> 0 AND failed & earlier <> 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (failed = bit), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (failed & bit <> 0 AND failed & earlier = 0), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (failed & bit <> 0 AND failed & earlier = 0), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * (120 // greatest(bit_count(failed), 1))) FILTER (failed & bit <> 0), 0)::BIGINT AS shapley
FROM counts, steps GROUP BY 1, 2, 3
"""


@query("op11_filter_interaction_audit", SQL)
def op11_filter_interaction_audit(spark, sf_dir):
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


__all__ = ["audit_filters", "failure_counts", "later_copies", "order_report", "text_failures"]
