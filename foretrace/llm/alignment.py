"""Alignment of two tokenizers' ids, weighed by how often pairs of ids meet in the whole corpus.

Both encodings of a text cover the same bytes. Ends that they share cut the text into groups; every stretch between two
neighbouring ends, of either side, is one link between the two tokens that cover it.

Counting is external. A task packs its links as (pair, document) records, pairs ordered by the id of side B first, and
when its buffer is full writes them as a sorted run, cut by radix of that id into zstd blocks. The blocks of some runs
and one radix are merged with a heap of block ends, which counts every pair with one block for each run in memory.
Spark adds the counts of the groups of runs; their order by side B gives the greatest count of each of its ids. The counts
that a group needs are then brought back to it, and its runs, streamed once more, hand them to the documents.

A frequent id fills many blocks, but no task has more of them than its group of runs, whatever the ids are.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretrace.llm.common import cut_lineage, table
from foretrace.llm.pieces import MARK, default_model
from foretrace.llm.registry import query
from foretrace.llm.token_file import Encoder, default_tokenizer

#: Parts that side B's ids are dealt over; links in a run; records in a block; runs that are merged together.
RADIX, RUN_LINKS, BLOCK_RECORDS, GROUP_RUNS = 16, 4_000_000, 1 << 16, 16
#: Characters of text that are aligned at a time, and documents that a run can number.
CHUNK, DOC_BITS = 2_000_000, 20
FACTS = "run bigint, idx int, id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
BLOCKS = "radix int, first bigint, last bigint, raw binary"
_KINDS = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
_SCHEMA = pa.schema([(f.split()[0], _KINDS[f.split()[1]]) for f in f"{FACTS}, {BLOCKS}".split(", ")])

_sides: dict[tuple[str, str], Sides] = {}

# -- tokens ---------------------------------------------------------------------------------------------------------


class Sides:
    """Both tokenizers, with the byte lengths of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.encoder = Encoder(path_a, specials=False)
        made = json.loads(self.encoder.library.to_str())
        if made["normalizer"] or made["pre_tokenizer"]["type"] != "ByteLevel" or made["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("side A must keep every byte of the text")
        self.pieces = lib = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.size_a, self.size_b = len(self.encoder.lengths), lib.get_piece_size()
        names = [lib.id_to_piece(i) for i in range(self.size_b)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if lib.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
        self.lengths_a = self.encoder.lengths
        self.lengths_b = np.array([len(b) for b in self.bytes_b], np.int64)
        self.said = [b"%d%s" % (i, end) for size, ends in ((self.size_a, b",|"), (self.size_b, b",;")) for end in (ends[:1], ends[1:]) for i in range(size)]
        self.bits_a = self.size_a.bit_length()
        self.part = -(-self.size_b // RADIX)

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[list[int]]]:
        """Ids of both sides; none where a text's bytes differ from those of either side's tokens."""
        a = [ids[:-1] for ids in self.encoder.encode([" " + t if t else None for t in texts])]
        b = self.pieces.encode(texts, num_threads=1)
        for i, text in enumerate(texts):
            raw = b" " + text.encode()
            if not text or b"".join(map(self.bytes_b.__getitem__, b[i])) != raw or int(self.lengths_a[a[i]].sum()) != len(raw):
                a[i], b[i] = a[i][:0], []
        return a, b


def sides(path_a: str, path_b: str) -> Sides:
    if (path_a, path_b) not in _sides:
        _sides[path_a, path_b] = Sides(path_a, path_b)
    return _sides[path_a, path_b]


def _places(common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each token's group, and where each group ends."""
    return np.cumsum(common) - common, np.flatnonzero(common) + 1


def align(tools: Sides, a: list[np.ndarray], b: list[list[int]]) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
    """(n_a, n_b, n_groups, n_links, digest) of each text, and of every link its document, id A and id B.

    All texts lie behind one another; both sides end together in each, so the last end of a text is a common one.
    """
    n_a, n_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    ids_a = np.concatenate(a).astype(np.int64)
    ids_b = np.fromiter((i for x in b for i in x), np.int64, int(n_b.sum()))
    ends_a, ends_b = np.cumsum(tools.lengths_a[ids_a]), np.cumsum(tools.lengths_b[ids_b])
    in_a, in_b = np.searchsorted(ends_a, ends_b), np.searchsorted(ends_b, ends_a)  # the token in which the other ends
    common_b = ends_a[in_a] == ends_b if len(ends_a) else np.zeros(0, bool)
    common_a = np.zeros(len(ids_a), bool)
    common_a[in_a[common_b]] = True
    group_a, stops_a = _places(common_a)
    group_b, stops_b = _places(common_b)
    said = np.empty(len(ids_a) + len(ids_b), np.int64)
    said[np.arange(len(ids_a)) + np.concatenate([[0], stops_b])[group_a]] = ids_a + tools.size_a * common_a
    said[np.arange(len(ids_b)) + stops_a[group_b]] = ids_b + tools.size_b * common_b + 2 * tools.size_a
    ends = np.cumsum(n_a + n_b).tolist()
    counts = np.concatenate([[0], np.cumsum(common_a)])[np.concatenate([[0], np.cumsum(n_a)])]
    n_groups = np.diff(counts)
    rows, begin = [], 0
    for end, facts in zip(ends, zip(n_a.tolist(), n_b.tolist(), n_groups.tolist(), (n_a + n_b - n_groups).tolist())):
        text = b"".join(map(tools.said.__getitem__, said[begin:end].tolist()))[:-1]
        rows.append((*facts, hashlib.sha256(text).hexdigest() if text else ""))
        begin = end
    alone = ~common_b
    docs = np.concatenate([np.repeat(np.arange(len(a)), n_a), np.repeat(np.arange(len(b)), n_b)[alone]])
    return rows, docs, np.concatenate([ids_a, ids_a[in_a[alone]]]), np.concatenate([ids_b[in_b], ids_b[alone]])


# -- runs -----------------------------------------------------------------------------------------------------------


def _planes(values: np.ndarray, kind: str) -> bytes:
    """The bytes of numbers, all first bytes before all second ones."""
    raw = values.astype(kind)
    return raw.view(np.uint8).reshape(len(raw), raw.itemsize).T.tobytes()


def _unplanes(raw: bytes, kind: str, at: int, count: int) -> tuple[np.ndarray, int]:
    width = np.dtype(kind).itemsize
    values = np.frombuffer(raw, np.uint8, count * width, at).reshape(width, count)
    return np.ascontiguousarray(values.T).view(kind).reshape(-1).astype(np.int64), at + count * width


def pack(pairs: np.ndarray, docs: np.ndarray, times: np.ndarray) -> bytes:
    """A block of records in ascending order of pair and document: gaps of pairs, records for each, gaps of documents, times."""
    starts = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
    gaps = np.diff(docs, prepend=0)
    gaps[starts] = docs[starts]
    head = np.array([len(starts), len(docs)], "<u4").tobytes()
    parts = (np.diff(pairs[starts], prepend=0), "<u8"), (np.diff(starts, append=len(docs)), "<u4"), (gaps, "<u4"), (times, "<u4")
    return zstandard.compress(head + b"".join(_planes(v, k) for v, k in parts), 3)


def unpack(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, records of each, documents, times)"""
    raw = zstandard.decompress(block)
    n_pairs, n = (int(x) for x in np.frombuffer(raw, "<u4", 2))
    gaps, at = _unplanes(raw, "<u8", 8, n_pairs)
    each, at = _unplanes(raw, "<u4", at, n_pairs)
    docs, at = _unplanes(raw, "<u4", at, n)
    times, at = _unplanes(raw, "<u4", at, n)
    docs = np.cumsum(docs)
    starts = np.cumsum(each) - each
    before = np.where(starts > 0, docs[starts - 1], 0)
    return np.cumsum(gaps), each, docs - np.repeat(before, each), times


class Run:
    """Links of consecutive documents of one task, until they fill a run."""

    def __init__(self, tools: Sides):
        self.tools, self.keys, self.held, self.docs = tools, [], 0, 0

    def add(self, docs: np.ndarray, a: np.ndarray, b: np.ndarray, count: int) -> None:
        dealt = b % RADIX * self.tools.part + b // RADIX
        self.keys.append((dealt << self.tools.bits_a | a) << DOC_BITS | (docs + self.docs))
        self.held += len(docs)
        self.docs += count

    def blocks(self) -> Iterator[tuple[int, int, int, bytes]]:
        """(radix, first pair, last pair, block) in ascending order."""
        keys = np.sort(np.concatenate(self.keys)) if self.keys else np.empty(0, np.int64)
        self.keys = []
        fresh = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else keys
        times, keys = np.diff(fresh, append=len(keys)), keys[fresh]
        docs, dealt = keys & ((1 << DOC_BITS) - 1), keys >> (DOC_BITS + self.tools.bits_a)
        a = keys >> DOC_BITS & ((1 << self.tools.bits_a) - 1)
        b = dealt % self.tools.part * RADIX + dealt // self.tools.part
        pairs = b << self.tools.bits_a | a
        cuts = np.searchsorted(dealt, np.arange(RADIX + 1) * self.tools.part).tolist()
        for radix in range(RADIX):
            for i in range(cuts[radix], cuts[radix + 1], BLOCK_RECORDS):
                j = min(i + BLOCK_RECORDS, cuts[radix + 1])
                yield radix, int(pairs[i]), int(pairs[j - 1]), pack(pairs[i:j], docs[i:j], times[i:j])


def merged_counts(blocks: Iterator[tuple[int, int, bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs with their counts, ascending and each once, from (first, last, block) in ascending order of first.

    The heap has the last pair of every open block. Up to the least of these all blocks are known, so their pairs are
    complete; a run's next block is opened when the merge comes to its first pair.
    """
    heap: list[tuple] = []
    ready, serial = next(blocks, None), 0
    while heap or ready:
        while ready and (not heap or ready[0] <= heap[0][0]):
            pairs, each, _, times = unpack(ready[2])
            heapq.heappush(heap, (ready[1], serial, pairs, np.add.reduceat(times, np.cumsum(each) - each)))
            ready, serial = next(blocks, None), serial + 1
        bound, taken, left = heap[0][0], [], []
        for last, number, pairs, counts in heap:
            k = int(np.searchsorted(pairs, bound, "right"))
            taken.append((pairs[:k], counts[:k]))
            if k < len(pairs):
                left.append((last, number, pairs[k:], counts[k:]))
        heapq.heapify(left)
        heap = left
        pairs, counts = (np.concatenate(x) for x in zip(*taken))
        order = np.argsort(pairs, kind="stable")
        pairs, counts = pairs[order], counts[order]
        starts = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
        yield pairs[starts], np.add.reduceat(counts, starts)


# -- tables ---------------------------------------------------------------------------------------------------------


def _batch(columns: dict[str, list]) -> pa.RecordBatch:
    count = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(count, f.type) for f in _SCHEMA], schema=_SCHEMA
    )


def _encoded(texts: DataFrame, path_a: str, path_b: str, run_links: int) -> DataFrame:
    """Facts of every (id, text), numbered within the runs of their tasks, and the blocks of these runs."""
    fact_names, block_names = ([f.split()[0] for f in s.split(", ")] for s in (FACTS, BLOCKS))

    def encode(batches):
        tools = sides(path_a, path_b)
        run, number = Run(tools), TaskContext.get().partitionId() << 20

        def finish():
            held = 0
            rows: list[tuple] = []
            for row in run.blocks():
                rows.append((number, *row))
                held += len(row[3])
                if held > 16_000_000:
                    yield _batch(dict(zip(["run", *block_names], zip(*rows))))
                    rows, held = [], 0
            if rows:
                yield _batch(dict(zip(["run", *block_names], zip(*rows))))

        for batch in batches:
            ids, texts_ = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            i = 0
            while i < len(ids):
                j, size = i, 0
                while j < len(ids) and (j == i or (size < CHUNK and j - i < 1 << (DOC_BITS - 2))):
                    size += len(texts_[j] or "")
                    j += 1
                a, b = tools.encode([t or "" for t in texts_[i:j]])
                rows, docs, left, right = align(tools, a, b)
                first = run.docs
                run.add(docs, left, right, j - i)
                facts = [(number, first + k, ids[i + k], *row) for k, row in enumerate(rows)]
                yield _batch(dict(zip(fact_names, zip(*facts))))
                if run.held >= run_links or run.docs >= 1 << (DOC_BITS - 1):
                    yield from finish()
                    run, number = Run(tools), number + 1
                i = j
        yield from finish()

    return texts.mapInArrow(encode, f"{FACTS}, {BLOCKS}")


def _count(key: tuple[pa.Scalar, ...], found: pa.Table) -> pa.Table:
    rows = sorted(zip(found["first"].to_pylist(), found["last"].to_pylist(), found["raw"].to_pylist()), key=lambda r: r[:2])
    made = list(merged_counts(iter(rows)))
    pairs, counts = (np.concatenate(x) for x in zip(*made))
    group, radix = (np.full(len(pairs), k.as_py()) for k in key)
    return pa.table({"grp": pa.array(group, pa.int32()), "radix": pa.array(radix, pa.int32()), "pair": pairs, "n": counts})


def _hand_back(key: tuple[pa.Scalar, ...], counts: pa.Table, found: pa.Table) -> pa.Table:
    order = np.argsort(counts["pair"].to_numpy())
    pairs, n, best = (counts[c].to_numpy()[order] for c in ("pair", "n", "best"))
    sums: dict[int, list[np.ndarray]] = {}
    for run, raw in zip(found["run"].to_pylist(), found["raw"].to_pylist()):
        own, each, docs, times = unpack(raw)
        at = np.searchsorted(pairs, own)
        held = sums.setdefault(run, [np.zeros(0, np.int64)] * 2)
        short = int(docs.max()) + 1 - len(held[0])
        if short > 0:
            held[:] = [np.concatenate([h, np.zeros(short, np.int64)]) for h in held]
        np.add.at(held[0], docs, times * np.repeat(best[at], each))
        np.add.at(held[1], docs, times * np.repeat(n[at], each))
    rows = [(run, np.flatnonzero(total), top, total) for run, (top, total) in sums.items()]
    return pa.table(
        {
            "run": np.concatenate([np.full(len(i), run) for run, i, _, _ in rows] or [np.empty(0, np.int64)]),
            "idx": pa.array(np.concatenate([i for _, i, _, _ in rows] or [np.empty(0, np.int64)]), pa.int32()),
            "n_best": np.concatenate([top[i] for _, i, top, _ in rows] or [np.empty(0, np.int64)]),
            "count_sum": np.concatenate([total[i] for _, i, _, total in rows] or [np.empty(0, np.int64)]),
        }
    )


def align_documents(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text: str = "text",
    path_a: str | None = None,
    path_b: str | None = None,
    run_links: int = RUN_LINKS,
    group_runs: int = GROUP_RUNS,
) -> tuple[DataFrame, DataFrame]:
    """One row for each row of ``docs`` (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), and the counts
    of all linked pairs (a_id, b_id, n, best: whether no other pair of b_id has more).

    Null and empty texts, and texts whose bytes a side does not give back, have zeros and an empty digest. Ids must be
    whole numbers or null and may repeat: rows are told apart by their run and place. Other columns are not carried. An
    empty table gives no rows. Results do not depend on ``run_links`` and ``group_runs``, the bounds of memory.
    """
    a, b = path_a or default_tokenizer(), path_b or default_model()
    bits = sides(a, b).bits_a
    made = cut_lineage(_encoded(docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text")), a, b, run_links))
    facts = made.where("idx IS NOT NULL").select("run", "idx", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    blocks = made.where("raw IS NOT NULL")
    groups = max(1, -(-blocks.select("run").distinct().count() // group_runs))
    blocks = blocks.select(F.pmod(F.xxhash64("run"), F.lit(groups)).cast("int").alias("grp"), "radix", "run", "first", "last", "raw")
    partial = cut_lineage(blocks.groupBy("grp", "radix").applyInArrow(_count, "grp int, radix int, pair bigint, n bigint"))
    totals = partial.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("b_id", F.shiftright("pair", bits))
    totals = cut_lineage(totals)
    most = totals.groupBy("b_id").agg(F.max("n").alias("most"))
    totals = totals.join(most, "b_id").select("pair", "b_id", "n", (F.col("n") == F.col("most")).cast("bigint").alias("best"))
    needed = partial.select("grp", "radix", "pair").join(totals.drop("b_id"), "pair")
    given = needed.groupBy("grp", "radix").cogroup(blocks.groupBy("grp", "radix")).applyInArrow(
        _hand_back, "run bigint, idx int, n_best bigint, count_sum bigint"
    )
    sums = given.groupBy("run", "idx").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    out = facts.join(sums, ["run", "idx"], "left").select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"
    )
    linked = totals.select(F.col("pair").bitwiseAND((1 << bits) - 1).alias("a_id"), "b_id", "n", (F.col("best") == 1).alias("best"))
    return out, linked


@query("op13_cross_tokenizer_alignment")
def op13_cross_tokenizer_alignment(spark, sf_dir):
    return align_documents(table(spark, sf_dir, "documents"))[0]


__all__ = ["Run", "Sides", "align", "align_documents", "merged_counts", "pack", "unpack"]
