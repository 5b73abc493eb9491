"""Exact substring de-duplication over all texts with sharded suffix arrays.

A byte goes if a string of ``window`` bytes covers it that also starts anywhere else. To bring all occurrences of such
a string together without pairing texts, each text is cut into segments, runs of windows with the same least gram hash
(see ``minimizers``): equal windows have equal keys. Keys that occur once hold no repeated window and are done with.
Equal segments are counted and kept once; where a key has just one, all is known. The different segments of each
remaining key go into one shard, where a suffix array with its permuted common prefixes tells the windows that start
twice or more. What they cover is joined back to all occurrences of the segment.

A key whose different segments are together longer than ``group_bytes``, such as one beside a passage that very many
texts share, would not fit a shard. Its segments are dealt anew, by what stands around the gram of their key, at ever
finer distances until no key is crowded; what a key then holds is searched like any other.

Passages of ``PASSAGE`` words that stand elsewhere too, whatever white space is between the words, go the same way as
segments of words. Nothing is removed for them; they are counted, as they may be shorter than a window.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretrace.llm.common import cut_lineage, table
from foretrace.llm.minimizers import (
    GRAM,
    PASSAGE,
    STEP,
    WINDOW,
    anchored,
    chunk_segments,
    chunk_word_segments,
    core_hashes,
    gram_hashes,
    segments,
    word_hashes,
    word_segments,
    words,
)
from foretrace.llm.registry import query
from foretrace.llm.suffixes import permuted_common_prefixes, suffix_array

#: Segments are gathered into shards of about this many bytes; the segments of a key beyond the second are dealt anew.
SHARD_BYTES, GROUP_BYTES = 400_000, 2_000_000
#: Texts are cut into segments this many bytes at a time, longer ones by themselves.
CHUNK = 1 << 17
OCCURRENCE = "id bigint, hash bigint, first int, size int, key bigint, d1 bigint, d2 bigint, inner boolean"
SEGMENT = "key bigint, d1 bigint, d2 bigint, weight bigint, raw binary"
PART = "gram bigint, k0 bigint, d01 bigint, d02 bigint, first int, size int, key bigint, d1 bigint, d2 bigint, weight bigint, raw binary"
#: By so many distances of their gram the segments of a crowded key are dealt, one width after the other.
WIDTHS = (84, 21, 5, 1)
RANGES = "array<struct<start:int,stop:int>>"
FOUND = f"key bigint, d1 bigint, d2 bigint, ranges {RANGES}"
FACTS = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_passage_words bigint, kept binary"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    ranges = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds.get(k, ranges)) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields]
    )


def _digest(raw: bytes) -> tuple[int, int]:
    pair = np.frombuffer(hashlib.blake2b(raw, digest_size=16).digest(), "<i8")
    return int(pair[0]), int(pair[1])


def _occurrences(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """Every segment of every text, of bytes and of words, without its bytes; ``inner`` if its key's gram is in it more
    than once."""
    plain = [f.split()[0] for f in OCCURRENCE.split(", ")]

    def several(ids, hashes, raws):
        for own, key, first, end, d1, d2, inner in (chunk_segments(raws, window, gram), chunk_word_segments(raws)):
            size, own = pa.array((end - first).astype(np.int32)), pa.array(own)
            columns = [pa.array(ids, pa.int64()).take(own), pa.array(hashes, pa.int64()).take(own), pa.array(first.astype(np.int32)), size]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(key), pa.array(d1), pa.array(d2), pa.array(inner.astype(bool))], names=plain)

    def cut(batches):
        for batch in batches:
            held, size, rows = [], 0, []
            for id_, hash_, text in zip(*(c.to_pylist() for c in batch.columns)):
                raw = text.encode()
                if len(raw) > STEP:
                    for key, first, end, inner in (*segments(raw, window, gram), *word_segments(raw)):
                        rows.append((id_, hash_, first, end - first, key, *_digest(raw[first:end]), inner))
                        if len(rows) > 50_000:
                            yield _batch(rows, OCCURRENCE)
                            rows = []
                    continue
                held.append((id_, hash_, raw))
                size += len(raw)
                if size > CHUNK:
                    yield from several(*zip(*held))
                    held, size = [], 0
            if held:
                yield from several(*zip(*held))
            yield _batch(rows, OCCURRENCE)

    return texts.mapInArrow(cut, OCCURRENCE)


def _cut_out(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """The bytes of the wanted segments: one row of places for each text meets the text once."""
    lists = wanted.groupBy("id", "hash").agg(F.collect_list(F.struct("key", "d1", "d2", "weight", "first", "size")).alias("places"))
    lists = lists.select(F.col("id").alias("id_"), F.col("hash").alias("hash_"), "places")
    met = texts.join(lists, texts.id.eqNullSafe(lists.id_) & (texts.hash == lists.hash_)).select("text", "places")

    def cut(batches):
        for batch in batches:
            rows, held = [], 0
            for text, places in zip(*(c.to_pylist() for c in batch.columns)):
                raw = text.encode()
                for p in places:
                    rows.append((p["key"], p["d1"], p["d2"], p["weight"], raw[p["first"] : p["first"] + p["size"]]))
                    held += p["size"]
                    if held > 8_000_000:
                        yield _batch(rows, SEGMENT)
                        rows, held = [], 0
            yield _batch(rows, SEGMENT)

    return met.mapInArrow(cut, SEGMENT)


def _runs(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Byte ranges that windows at ascending ``starts`` cover; ranges that touch or overlap are one."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > window)
    return list(zip(starts[np.concatenate([[0], cut + 1])].tolist(), (starts[np.concatenate([cut, [len(starts) - 1]])] + window).tolist()))


def repeated_ranges(segments_: list[tuple[int, bytes]], window: int = WINDOW) -> list[list[tuple[int, int]]]:
    """For (weight, bytes) of different segments, what windows cover that start at least twice, counted with weights."""
    lengths = np.array([len(raw) + 1 for _, raw in segments_])
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    text = np.zeros(int(lengths.sum()), np.int64)
    plain = np.frombuffer(b"\0".join(raw for _, raw in segments_) + b"\0", np.uint8)
    text[:] = plain
    text += 1
    text[begins + lengths - 1] = 0  # an end is no byte; windows that reach one are not asked about
    array = suffix_array(text)
    before, common = permuted_common_prefixes(text, array)
    twice = common >= window
    twice[before[twice]] = True
    out = []
    for begin, (weight, raw) in zip(begins.tolist(), segments_):
        count = len(raw) - window + 1
        starts = np.arange(count) if weight > 1 else np.flatnonzero(twice[begin : begin + count])
        out.append(_runs(starts, window))
    return out


def repeated_passages(segments_: list[tuple[int, bytes]], count: int = PASSAGE) -> list[list[tuple[int, int]]]:
    """The same for windows of ``count`` words: the bytes from their first word to their last."""
    data = np.frombuffer(b" ".join(raw for _, raw in segments_), np.uint8)
    lengths = np.array([len(raw) + 1 for _, raw in segments_])
    begins = np.cumsum(lengths) - lengths
    starts, ends = words(data)
    own = np.searchsorted(begins, starts, "right") - 1
    inside = own[: len(own) - count + 1] == own[count - 1 :]
    _, number = np.unique(gram_hashes(word_hashes(data, starts, ends), count), return_inverse=True)
    weight = np.array([w for w, _ in segments_])[own[: len(inside)]]
    totals = np.bincount(number[inside], weight[inside], len(number))
    found = np.flatnonzero(inside & (totals[number] > 1))
    out: list[list[tuple[int, int]]] = [[] for _ in segments_]
    cuts = np.concatenate([[0], np.flatnonzero((np.diff(found) > 1) | (np.diff(own[found]) > 0)) + 1, [len(found)]]).tolist()
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            owner = int(own[found[a]])
            out[owner].append((int(starts[found[a]] - begins[owner]), int(ends[found[b - 1] + count - 1] - begins[owner])))
    return out


def _may_repeat(keys: np.ndarray, raws: list[bytes], window: int, gram: int) -> np.ndarray:
    """Whether a segment may share a window with another of its key, or have one twice: with a gram alone in both,
    they share a core around it."""
    data = np.frombuffer(b"\0".join(raws), np.uint8)
    lengths = np.array([len(raw) + 1 for raw in raws])
    starts = np.cumsum(lengths) - lengths
    who, cores, more = core_hashes(data, starts, starts + lengths - 1, keys, window=window, gram=gram)
    _, number, times = np.unique(cores, return_inverse=True, return_counts=True)
    more[who[times[number] > 1]] = True
    # a segment with its gram alone may meet one that has it more often
    several = np.isin(keys, keys[more])
    crossed = np.zeros(len(keys), bool)
    crossed[np.bincount(who, minlength=len(keys)) == 0] = True
    return more | (crossed & several)


def _search(shards: DataFrame, window: int, gram: int, shard_bytes: int) -> DataFrame:
    """(key, d1, d2, ranges) of segments with repeated windows. Rows of a key stand together in their partition.

    Whole keys are taken until they have about ``shard_bytes``. Segments of words are answered from them; segments of bytes
    that may share a window wait until they fill a shard.
    """

    def search(batches):
        held, size, last, waiting, kept = [], 0, None, [], 0

        def sifted():
            nonlocal kept
            odd, even = [r for r in held if r[0] & 1], [r for r in held if not r[0] & 1]
            out = []
            if odd:
                found = repeated_passages([(r[3], r[4]) for r in odd])
                out += [(*r[:3], ranges) for r, ranges in zip(odd, found) if ranges]
            if even:
                may = _may_repeat(np.array([r[0] for r in even], np.int64), [r[4] for r in even], window, gram).tolist()
                waiting.extend(r for r, m in zip(even, may) if m)
                kept += sum(len(r[4]) for r, m in zip(even, may) if m)
                out += [(*r[:3], [(0, len(r[4]))]) for r, m in zip(even, may) if not m and r[3] > 1]
            return _batch(out, FOUND)

        def searched():
            found = repeated_ranges([(r[3], r[4]) for r in waiting], window)
            return _batch([(*r[:3], ranges) for r, ranges in zip(waiting, found) if ranges], FOUND)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= shard_bytes and row[0] != last:
                    yield sifted()
                    held, size = [], 0
                    if kept >= shard_bytes:
                        yield searched()
                        waiting, kept = [], 0
                held.append(row)
                size += len(row[4])
                last = row[0]
        if held:
            yield sifted()
        if waiting:
            yield searched()

    return shards.mapInArrow(search, FOUND)


def _dealt_anew(units: DataFrame, width: int, window: int, gram: int) -> DataFrame:
    """Segments of crowded keys, cut by what stands around their gram, those of words into their windows; k0, d01, d02
    name the segment that a part is of, ``gram`` the key it first had."""

    def cut(batches):
        for batch in batches:
            rows, held = [], 0
            for first_key, key, d1, d2, weight, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if first_key & 1:
                    data = np.frombuffer(raw, np.uint8)
                    starts, ends = (x.tolist() for x in words(data))
                    split = raw.split()
                    for i in range(len(split) - PASSAGE + 1):
                        said = _digest(b" ".join(split[i : i + PASSAGE]))
                        rows.append((first_key, key, d1, d2, starts[i], ends[i + PASSAGE - 1] - starts[i], said[0] | 1, *said, weight, b""))
                    held += 100 * len(split)
                else:
                    for key_, first, end in anchored(raw, first_key, width, window, gram):
                        part = raw[first:end]
                        rows.append((first_key, key, d1, d2, first, end - first, key_, *_digest(part), weight, part))
                        held += len(part)
                if held > 8_000_000:
                    yield _batch(rows, PART)
                    rows, held = [], 0
            yield _batch(rows, PART)

    return units.mapInArrow(cut, PART)


def _moved(ranges: str, by: str):
    return F.transform(ranges, lambda r: F.struct((r["start"] + F.col(by)).alias("start"), (r["stop"] + F.col(by)).alias("stop")))


def _shards(segments_: DataFrame) -> DataFrame:
    partitions = int(segments_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return segments_.select("key", "d1", "d2", "weight", "raw").repartition(partitions, "key").sortWithinPartitions("key")


def _crowded(units: DataFrame, window: int, gram: int, group_bytes: int, shard_bytes: int, widths: tuple[int, ...]) -> DataFrame:
    """What ``_search`` gives, for units of crowded keys. With the last width, 1, a key is that of one window, so no two
    different parts have it and none is crowded."""
    names = ["key", "d1", "d2"]
    parts = cut_lineage(_dealt_anew(units, widths[0], window, gram))
    different = parts.groupBy("gram", *names).agg(F.sum("weight").alias("weight"), F.max("raw").alias("raw"))
    keys = different.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("total"), F.sum(F.length("raw")).alias("bytes"))
    several = cut_lineage(different.join(keys.where("total > 1 AND n > 1"), "key"))
    found = _search(_shards(several.where(F.col("bytes") <= group_bytes)), window, gram, shard_bytes)
    again = several.where(F.col("bytes") > group_bytes).select("gram", *names, "weight", "raw")
    if not again.isEmpty():
        found = found.union(_crowded(again, window, gram, group_bytes, shard_bytes, widths[1:]))
    parents, whole = ["k0", "d01", "d02"], F.array(F.struct(F.col("first").alias("start"), (F.col("first") + F.col("size")).alias("stop")))
    alone = parts.join(keys.where("total > 1 AND n = 1").select("key"), "key", "left_semi").select(*parents, whole.cast(RANGES).alias("ranges"))
    placed = parts.drop("raw").join(found, names).select(*parents, _moved("ranges", "first").cast(RANGES).alias("ranges"))
    gathered = alone.union(placed).groupBy(*parents).agg(F.flatten(F.collect_list("ranges")).alias("ranges"))
    return gathered.toDF(*names, "ranges")


def repeated_bytes(
    texts: DataFrame, *, window: int = WINDOW, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, group_bytes: int = GROUP_BYTES
) -> DataFrame:
    """(id, hash, ranges, passages): byte ranges of repeated windows, and of repeated passages, for each text (id, hash,
    text) that has any."""
    names = ["key", "d1", "d2"]
    seen = cut_lineage(_occurrences(texts, window, gram))
    keys = seen.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("inner").alias("any_inner"))
    repeated = cut_lineage(seen.join(keys.where("n > 1 OR any_inner").select("key"), "key", "left_semi"))
    distinct = cut_lineage(
        repeated.groupBy(*names)
        .agg(F.count(F.lit(1)).alias("weight"), F.max("inner").alias("inner"), F.min(F.struct("id", "hash", "first", "size")).alias("one"))
        .select(*names, "weight", "inner", "one.*")
    )
    groups = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("inner").alias("any_inner"), F.sum("size").alias("bytes"))
    known = cut_lineage(distinct.join(groups, "key"))
    single = (F.col("n") == 1) & ~F.col("any_inner")  # its windows are all different, so they repeat as the segment does
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("size").alias("stop"))).cast(RANGES)
    cut = _cut_out(known.where(~single), texts)
    crowded = cut_lineage(known.where(~single & (F.col("bytes") > group_bytes)).select("key").distinct())
    some = not crowded.isEmpty()
    light = cut.join(crowded, "key", "left_anti") if some else cut
    found = known.where(single).select(*names, whole.alias("ranges")).union(_search(_shards(light), window, gram, shard_bytes))
    if some:
        units = cut.join(crowded, "key", "left_semi").select(F.col("key").alias("gram"), *names, "weight", "raw")
        span = window - gram + 1
        found = found.union(_crowded(units, window, gram, group_bytes, shard_bytes, tuple(w for w in WIDTHS if w < span) or (1,)))
    placed = repeated.join(found, names).withColumn("moved", _moved("ranges", "first"))
    odd = F.col("key").bitwiseAND(F.lit(1)) == 1
    gathered = [F.flatten(F.collect_list(F.when(kind, F.col("moved")))).alias(name) for kind, name in ((~odd, "ranges"), (odd, "passages"))]
    return placed.groupBy("id", "hash").agg(*gathered)


def _merged(ranges) -> list[list[int]]:
    """Ranges in any order, overlapping as they may, as maximal ones."""
    merged: list[list[int]] = []
    for start, stop in sorted(ranges):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], stop)
        else:
            merged.append([start, stop])
    return merged


def _facts(raw: bytes, ranges, passages) -> tuple:
    """Counts and the kept bytes of one text."""
    merged = _merged(ranges)
    kept, at = [], 0
    for start, stop in merged:
        kept.append(raw[at:start])
        at = stop
    kept.append(raw[at:])
    rest = b"".join(kept)
    told = sum(len(raw[start:stop].split()) for start, stop in _merged(passages))
    return len(raw), len(raw) - len(rest), len(merged), hashlib.sha256(rest).hexdigest(), told, rest


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", with_kept: bool = False, **limits) -> DataFrame:
    """One row for each row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_words, and ``kept`` (bytes)
    if asked for. n_passage_words counts words inside 50 consecutive words that also stand anywhere else.

    Texts are taken as UTF-8 bytes, null as empty; texts under the window length keep all. Repeated rows are documents of
    their own, so they remove each other. Ids must be whole numbers or null and may repeat. Other columns are not carried.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(content).alias("hash"), content.alias("text"))
    found = repeated_bytes(texts, **limits)
    found = found.select(F.col("id").alias("id_"), F.col("hash").alias("hash_"), "ranges", "passages")
    joined = texts.join(found, texts.id.eqNullSafe(found.id_) & (texts.hash == found.hash_), "left")

    ranges, passages = (F.coalesce(c, F.array().cast(RANGES)) for c in ("ranges", "passages"))
    facts = _facts_udf(with_kept)(F.col("text"), ranges, passages)
    out = joined.select(F.col("id").alias(id_col), facts.alias("facts")).select(id_col, "facts.*")
    return out if with_kept else out.drop("kept")


def _facts_udf(with_kept: bool):
    def run(texts: pd.Series, ranges: pd.Series, passages: pd.Series) -> pd.DataFrame:
        pairs = lambda found: [(r["start"], r["stop"]) for r in found]
        rows = []
        for text, found, told in zip(texts, ranges, passages):
            made = _facts(text.encode(), pairs(found), pairs(told))
            rows.append(made if with_kept else (*made[:-1], None))
        return pd.DataFrame.from_records(rows, columns=[f.split()[0] for f in FACTS.split(", ")])

    run.__annotations__ = {"texts": pd.Series, "ranges": pd.Series, "passages": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, FACTS)


SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS n, doc_id, encode(coalesce(text, '')) AS raw FROM documents
), w AS (
  SELECT n, i, md5(raw[i + 1 : i + {WINDOW}]) AS h FROM (SELECT n, raw, unnest(range(0, octet_length(raw) - {WINDOW - 1})) AS i FROM d WHERE octet_length(raw) >= {WINDOW})
), twice AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1
), hit AS (SELECT n, i FROM w SEMI JOIN twice USING (h)
), marked AS (SELECT *, coalesce(i > lag(i) OVER (PARTITION BY n ORDER BY i) + {WINDOW}, TRUE) AS fresh FROM hit
), numbered AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY n ORDER BY i) AS span FROM marked
), spans AS (SELECT n, span, min(i) AS start, max(i) + {WINDOW} AS stop FROM numbered GROUP BY n, span
), gaps AS (
  SELECT n, coalesce(lag(stop) OVER (PARTITION BY n ORDER BY start), 0) AS a, start AS b, stop - start AS size, stop FROM spans
), per AS (
  SELECT g.n, sum(size) AS removed, count(*) AS spans, string_agg(hex(raw[a + 1 : b]), '' ORDER BY a) || hex(any_value(raw)[max(stop) + 1 : octet_length(any_value(raw))]) AS kept
  FROM gaps g JOIN d USING (n) GROUP BY g.n
), word AS (
  SELECT n, unnest(words) AS w, generate_subscripts(words, 1) AS i
  FROM (SELECT row_number() OVER () AS n, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents)
), started AS (
  SELECT n, i, string_agg(w, ' ') OVER here AS said, count(*) OVER here AS many FROM word
  WINDOW here AS (PARTITION BY n ORDER BY i ROWS BETWEEN CURRENT ROW AND {PASSAGE - 1} FOLLOWING)
), passage AS (
  SELECT n, i, many = {PASSAGE} AND count(*) OVER (PARTITION BY md5(said)) > 1 AS again FROM started
), told AS (
  SELECT n, count(*) FILTER (near) AS n_words FROM (
    SELECT n, bool_or(again) OVER (PARTITION BY n ORDER BY i ROWS BETWEEN {PASSAGE - 1} PRECEDING AND CURRENT ROW) AS near FROM passage
  ) GROUP BY n
)
SELECT doc_id, octet_length(raw)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(CASE WHEN kept IS NULL THEN raw ELSE unhex(kept) END) AS kept_sha256, coalesce(n_words, 0)::BIGINT AS n_passage_words
FROM d LEFT JOIN per USING (n) LEFT JOIN told USING (n)
"""


@query("op10_suffix_array_dedup", SQL)
def op10_suffix_array_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"))


__all__ = ["remove_repeats", "repeated_bytes", "repeated_passages", "repeated_ranges"]
