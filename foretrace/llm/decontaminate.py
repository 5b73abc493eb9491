"""Benchmark decontamination: one Aho-Corasick automaton over the normalised items, each text scanned once.

Text is normalised by bytes: A-Z become small, and every other ASCII character that is no letter or digit separates
words. The words of the items are numbered, a pattern is a window of their numbers, and a text is the sequence of the
numbers of its words, so an occurrence always covers whole words. Matches are mapped back to words and to code points of
the original text.

The automaton is made by a task and written to the shared folder, from where each Python worker loads it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretrace.llm.common import build_parts, load_part, table
from foretrace.llm.registry import query

WINDOW = 13
#: Contaminated from one hit word in this many.
SHARE = 20
#: An automaton has up to 13 nodes for each word of the items, about 200 MB for this many bytes of items. Of a larger
#: benchmark several are made, and a batch of texts goes through one after the other.
PART_BYTES = 1_000_000
FACTS = "n_words bigint, hits array<int>, spans array<struct<start:int,stop:int>>, items array<string>"

_KEEP = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in _KEEP else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


class Scanner:
    """The automaton over all windows of (item id, text) pairs, and the numbers of their words."""

    def __init__(self, items: list[tuple[str, str]], size: int = WINDOW):
        self.numbers: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            words = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text))
            for i in range(max(1, len(words) - size + 1)) if words else ():
                owners.setdefault(words[i : i + size], set()).add(item)
        self.automaton = None
        if owners:
            self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for window, names in owners.items():
                self.automaton.add_word(window, (len(window), sorted(names)))
            self.automaton.make_automaton()

    def hits(self, words: list[bytes]) -> list[tuple[int, int, list[str]]]:
        """(first word, word behind the last, items) of every occurrence."""
        if self.automaton is None or not words:
            return []
        numbers = tuple(map(self.numbers.get, words, repeat(0)))
        return [(end - size + 1, end + 1, names) for end, (size, names) in self.automaton.iter(numbers)]


def original_spans(text: str, first: list[int], last: list[int]) -> list[tuple[int, int]]:
    """Code point ranges of word ranges in the unchanged text."""
    raw = text.encode()
    inside = np.frombuffer(raw.translate(_FOLD), np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    points = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return [(int(points[edges[2 * a]]), int(points[edges[2 * b + 1]])) for a, b in zip(first, last)]


def facts(text: str | None, words: list[bytes], found: list[tuple[int, int, list[str]]]) -> tuple:
    """(words, hit word numbers, merged spans in the original, items) of one text."""
    if not found:
        return len(words), [], [], []
    hit = np.zeros(len(words) + 1, np.int32)
    first, stop = (np.array(x) for x in list(zip(*found))[:2])
    np.add.at(hit, first, 1)
    np.add.at(hit, stop, -1)
    covered = np.cumsum(hit[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
    spans = original_spans(text, edges[::2].tolist(), (edges[1::2] - 1).tolist())
    return len(words), np.flatnonzero(covered).tolist(), spans, sorted({name for _, _, names in found for name in names})


def scanners(items: DataFrame, *, item_col: str, text: str, window: int, part_bytes: int) -> list[str]:
    """Paths of the automata over the items, in parts of bounded size; an empty benchmark has none."""
    rows = items.where(F.col(text).isNotNull()).select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text")
    )
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    part = F.pmod(F.xxhash64("item", "text"), F.lit(max(1, -(-int(total) // part_bytes))))

    def make(found: pa.Table) -> Scanner:
        return Scanner(list(zip(found["item"].to_pylist(), found["text"].to_pylist())), window)

    return build_parts(rows.select("item", "text", part.alias("part")), "part", make, "automata")


def contamination(text: Column, paths: list[str]) -> Column:
    """A struct of word count, hit words, spans and items by the automata at ``paths``."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            words = [words_of(t) for t in texts]
            found: list[list] = [[] for _ in words]
            for path in paths:
                scanner = load_part(path)
                for held, split in zip(found, words):
                    held += scanner.hits(split)
            yield pd.DataFrame.from_records([facts(*row) for row in zip(texts, words, found)], columns=["n_words", "hits", "spans", "items"])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, FACTS)(text)


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    *,
    text: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    part_bytes: int = PART_BYTES,
    into: str = "overlap",
) -> DataFrame:
    """``docs`` with a struct column ``into``: n_words, n_hit, spans, items, contaminated. No shuffle takes place.

    Every row stays, repeated rows too. Null and empty texts have no words and are clean; null item texts have no
    windows; a null item id counts as the empty string; repeated items count once. An empty benchmark marks nothing.
    A column named as ``into`` is replaced. The hits of a benchmark beyond ``part_bytes`` are united before words and
    spans are taken from them, so the result does not depend on the limit.
    """
    paths = scanners(items, item_col=item_col, text=item_text, window=window, part_bytes=part_bytes)
    out = docs.withColumn(into, contamination(F.col(text), paths))
    n_hit = F.size(f"{into}.hits").cast("bigint")
    n_words = F.col(f"{into}.n_words")
    return out.withColumn(
        into,
        F.struct(
            n_words.alias("n_words"),
            n_hit.alias("n_hit"),
            F.col(f"{into}.spans").alias("spans"),
            F.col(f"{into}.items").alias("items"),
            ((n_hit > 0) & (SHARE * n_hit >= n_words)).alias("contaminated"),
        ),
    )


#: Windows of both sides, joined on their words.
SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT DISTINCT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bi AS (
  SELECT item_id, w, unnest(range(1, greatest(1, len(w) - {WINDOW - 1}) + 1)) AS i FROM b WHERE len(w) > 0
), bw AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS size, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS win FROM bi
), sizes AS (SELECT DISTINCT size FROM bw
), di AS (
  SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size
), hits AS (
  SELECT doc_id, i, di.size, item_id FROM di JOIN bw ON bw.size = di.size AND array_to_string(di.w[i : i + di.size - 1], ' ') = bw.win
), hp AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS p FROM hits
), hw AS (SELECT doc_id, count(*) AS n FROM hp GROUP BY 1
), runs AS (
  SELECT doc_id, min(p) AS a, max(p) AS b FROM (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS r FROM hp) GROUP BY doc_id, r
), gaps AS (
  SELECT doc_id, w, string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS g
  FROM d JOIN documents USING (doc_id) WHERE doc_id IN (SELECT doc_id FROM hp)
), sp AS (
  SELECT doc_id, string_agg(start || ':' || stop, ',' ORDER BY start) AS spans FROM (
    SELECT doc_id, (list_sum(list_transform(g[1:a], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:a - 1], lambda x: length(x))), 0))::BIGINT AS start,
      (list_sum(list_transform(g[1:b], lambda x: length(x))) + list_sum(list_transform(w[1:b], lambda x: length(x))))::BIGINT AS stop
    FROM runs JOIN gaps USING (doc_id)
  ) GROUP BY 1
), hi AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY 1
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(hw.n, 0)::BIGINT AS n_hit, coalesce(hi.n, 0)::BIGINT AS n_items,
  sha256(coalesce(hi.items, '')) AS items_sha256, coalesce(hw.n, 0) > 0 AND {SHARE} * coalesce(hw.n, 0) >= len(w) AS contaminated,
  coalesce(spans, '') AS spans
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id) LEFT JOIN sp USING (doc_id)
"""


@query("op2_benchmark_decontamination", SQL)
def op2_benchmark_decontamination(spark, sf_dir):
    marked = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return marked.select(
        "doc_id",
        "overlap.n_words",
        "overlap.n_hit",
        F.size("overlap.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("overlap.items", ","), 256).alias("items_sha256"),
        "overlap.contaminated",
        F.array_join(F.transform("overlap.spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["stop"].cast("string"))), ",").alias("spans"),
    )


__all__ = ["Scanner", "decontaminate"]
