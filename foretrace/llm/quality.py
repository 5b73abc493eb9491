"""Quality rules: a hashed n-gram log-likelihood ratio between trusted and raw text, and counted base rules.

Words and word pairs of every document fall into ``buckets`` hash buckets. Two multinomials over the buckets are
counted, one over all documents and one over the trusted ones; a document's score is the mean over its n-grams of
log p(trusted) - log p(raw). The verdict compares that mean with a fixed threshold, so that equal documents always
get equal verdicts: no draw is involved.

Weights are whole numbers (units of 2^-20), so sums do not depend on the order of addition.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretrace.llm.common import WHITE, BoundedCache, struct_udf, table
from foretrace.llm.registry import query

BUCKETS = 1 << 16
#: Mean log ratio per n-gram below which a text reads unlike the trusted ones.
THRESHOLD = -0.1
UNIT = 1 << 20
SMOOTHING = 32.0
PAIR = 1_000_003
MIN_WORDS = 50
REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
FACTS = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "n_grams bigint, score bigint"
)

_words: BoundedCache | None = None


def _word_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.md5(word).digest()[:8], "big")


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64 leading bits of each word's MD5; words seen before in this worker are looked up."""
    global _words
    if _words is None:
        _words = BoundedCache(_word_hash)
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def gram_buckets(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of all words, then of all pairs of neighbours, from the upper 32 bits of the words' hashes."""
    h = hashes >> np.uint64(32)
    pairs = h[:-1] * np.uint64(PAIR) + h[1:]
    return (np.concatenate([h, pairs]) % np.uint64(buckets)).astype(np.int64)


def repeated_words(hashes: np.ndarray) -> int:
    """Words inside three-word windows that occur at least twice."""
    n = len(hashes) - 2
    if n < 2:
        return 0
    keys = (hashes[:-2] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[2:]
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    equal = ordered[1:] == ordered[:-1]
    if not equal.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    covered = np.zeros(n + 2, bool)
    for shift in range(3):
        covered[shift : shift + n] |= twice
    return int(covered.sum())


def text_facts(text: str | None) -> tuple[int, int, int, int, int, np.ndarray]:
    """The counts of the base rules and the words' hashes."""
    if not text:
        return 0, 0, 0, 0, 0, np.empty(0, np.uint64)
    raw = text.encode()
    words = raw.split()
    hashes = word_hashes(words)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return (
        len(words),
        len(text) - (len(raw) - len(raw.translate(None, WHITE))),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(hashes),
        hashes,
    )


def gram_counts(docs: DataFrame, text: str, trusted: str, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, raw, trusted): n-grams of all documents and of the trusted ones.

    Each task adds up its own rows first, so at most ``buckets`` rows leave it.
    """

    def count(batches):
        raw, good = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for value, flag in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if value:
                    grams = np.bincount(gram_buckets(word_hashes(value.encode().split()), buckets), minlength=0)
                    raw[: len(grams)] += grams
                    if flag:
                        good[: len(grams)] += grams
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(raw[used]), pa.array(good[used])], names=["bucket", "raw", "trusted"]
        )

    counted = docs.select(F.col(text), F.col(trusted)).mapInArrow(count, "bucket bigint, raw bigint, trusted bigint")
    return counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))


def fit_weights(counts: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> np.ndarray:
    """The log ratio of each bucket in units of 2^-20; all zero where nothing is trusted.

    Every bucket of the raw multinomial gets ``smoothing`` further n-grams, and of the trusted one as many as is its
    share of the corpus, so that rare n-grams count little either way and the normalisers cancel.
    The model has one number per bucket, whatever the corpus; that is what reaches the driver.
    """
    raw, good = np.zeros(buckets), np.zeros(buckets)
    rows = counts.toPandas()
    raw[rows["bucket"]], good[rows["bucket"]] = rows["raw"], rows["trusted"]
    if not good.sum():
        return np.zeros(buckets, np.int64)
    share = good.sum() / raw.sum()
    ratio = np.log((good + smoothing * share) / (raw + smoothing)) - np.log(share)
    return np.floor(ratio * UNIT + 0.5).astype(np.int64)


def facts_column(text: Column, weights: np.ndarray) -> Column:
    """A struct of the base counts, the number of n-grams and their summed weight."""
    shared = weights

    def row(state, value):
        *counts, hashes = text_facts(value)
        if not len(hashes):
            return (*counts, 0, 0)
        grams = gram_buckets(hashes, len(state))
        return (*counts, len(grams), int(state[grams].sum()))

    return struct_udf(FACTS, lambda: shared, row)(text)


def with_trust(docs: DataFrame, labels: DataFrame, *, id_col: str, text: str) -> DataFrame:
    """(text, trusted): trusted if any label of the document says good quality and none says toxic.

    Labels grow with the documents, so both are shuffled by id at every size; a small table is not broadcast.
    """
    verdicts = (
        labels.where(F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").alias("label_id"))
        .agg((F.max(F.coalesce("quality", F.lit(0))) * (1 - F.max(F.coalesce("toxic", F.lit(0))))).alias("trusted"))
    )
    plain = docs.select(F.col(id_col).alias("text_id"), F.col(text).alias("text"))
    joined = plain.join(verdicts.hint("merge"), plain.text_id == verdicts.label_id, "left")
    return joined.select("text", (F.coalesce("trusted", F.lit(0)) > 0).alias("trusted"))


def judge(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text: str = "text",
    buckets: int = BUCKETS,
    threshold: float = THRESHOLD,
    into: str = "quality",
) -> DataFrame:
    """``docs`` with a struct column ``into``: base counts, ``base_failed``, ``llr`` and ``kept``.

    Every row stays, repeated rows too; null and empty texts have no words and fail the base rules. Without any
    trusted document all weights are zero, and the base rules alone decide. A column named as ``into`` is replaced.
    The model is counted over all rows when this is called; only its ``buckets`` numbers are kept.
    """
    weights = fit_weights(gram_counts(with_trust(docs, labels, id_col=id_col, text=text), "text", "trusted", buckets), buckets)
    facts = facts_column(F.col(text), weights)
    out = docs.withColumn(into, facts)
    f = lambda name: F.col(f"{into}.{name}")
    failed = (f("n_words") < MIN_WORDS) | (100 * f("n_repeat_words") > REPEAT_PERCENT * f("n_words"))
    floor = F.lit(int(threshold * UNIT)) * f("n_grams")
    return out.withColumn(
        into,
        F.struct(
            *[f(n).alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_grams", "score")],
            failed.alias("base_failed"),
            F.when(f("n_grams") > 0, f("score") / (f("n_grams") * UNIT)).alias("llr"),
            (~failed & (f("score") >= floor)).alias("kept"),
        ),
    )


#: The same in SQL, for one pass over small tables.
SQL = rf"""
WITH labelled AS (
  SELECT doc_id, max(coalesce(quality, 0)) * (1 - max(coalesce(toxic, 0))) AS trusted FROM labels WHERE doc_id IS NOT NULL GROUP BY 1
), split AS (
  SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), word AS (
  SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM split
), coded AS (
  SELECT doc_id, i, w, ('0x' || substr(md5(w), 1, 8))::BIGINT AS h FROM word
), near AS (
  SELECT doc_id, i, w, h,
    lead(h) OVER t AS h1, lead(w) OVER t AS w1, lead(w, 2) OVER t AS w2 FROM coded WINDOW t AS (PARTITION BY doc_id ORDER BY i)
), grams AS (
  SELECT doc_id, h % {BUCKETS} AS bucket FROM near
  UNION ALL SELECT doc_id, (h * {PAIR} + h1) % {BUCKETS} FROM near WHERE h1 IS NOT NULL
), counted AS (
  SELECT bucket, count(*) AS raw, count(*) FILTER (coalesce(trusted, 0) > 0) AS good
  FROM grams LEFT JOIN labelled USING (doc_id) GROUP BY 1
), total AS (SELECT sum(raw)::DOUBLE AS raw, sum(good)::DOUBLE AS good FROM counted),
weights AS (
  SELECT bucket, CASE WHEN t.good = 0 THEN 0 ELSE floor((ln((c.good + {SMOOTHING} * (t.good / t.raw)) / (c.raw + {SMOOTHING})) - ln(t.good / t.raw)) * {UNIT} + 0.5) END::BIGINT AS weight
  FROM counted c, total t
), scores AS (
  SELECT doc_id, sum(weight)::BIGINT AS score, count(*) AS n_grams FROM grams JOIN weights USING (bucket) GROUP BY 1
), windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w, w1, w2) > 1 AS twice FROM near WHERE w2 IS NOT NULL
), repeats AS (
  SELECT doc_id, count(DISTINCT i + s.k) AS n FROM windows, (SELECT unnest([0, 1, 2]) AS k) s WHERE twice GROUP BY 1
), line AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l FROM documents
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM line WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1
), facts AS (
  SELECT s.doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words,
    coalesce(score, 0) AS score, coalesce(n_grams, 0)::BIGINT AS n_grams
  FROM split s LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id) LEFT JOIN scores USING (doc_id)
), based AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM facts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND score >= {int(THRESHOLD * UNIT)} * n_grams AS kept,
  CASE WHEN n_grams > 0 THEN round(score::DOUBLE / (n_grams * {UNIT}), 6) END AS llr
FROM based
"""


@query("op1_quality_rules", SQL)
def op1_quality_rules(spark, sf_dir):
    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select("doc_id", *[F.col(f"quality.{n}").alias(n) for n in names], F.round("quality.llr", 6).alias("llr"))


__all__ = ["judge", "gram_counts", "fit_weights", "op1_quality_rules"]
