"""Token ids as patched frame-of-reference files.

A file holds the ids of consecutive documents. Ids stand in blocks of ``BLOCK``; from each id the block's minimum is
subtracted, and the rests are packed at the width that ``PERCENT`` of them need. The others are exceptions: their
places and upper bits follow the packed part. The footer has where each block starts, so that any range of ids is read
from its blocks alone, and where each document starts.

Layout, little endian: magic; blocks; document ids (int64); document validity (uint8); document ends (uint64, in ids);
block starts (uint64, in bytes); documents, ids, blocks, footer position (uint64 each); magic.
A block: minimum uint32, width uint8, exceptions uint8, packed rests, exception places uint8, exception upper bits uint32.
The last block is filled up with its last id.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foretrace.llm.common import cut_lineage, table
from foretrace.llm.registry import query
from foretrace.sources.writers import scratch_path

MAGIC = b"FTPFOR01"
BLOCK, PERCENT, HEAD = 128, 90, 6
#: A task begins a new file after this many ids.
FILE_IDS = 4_000_000
END_ID = 2
#: Remembered segments in each Python worker.
SEGMENTS = 800_000
MANIFEST = "part int, seq int, path string, n_docs bigint, n_ids bigint, n_bytes bigint"

# -- blocks ---------------------------------------------------------------------------------------------------------


def _narrow(values: np.ndarray, width: int) -> np.ndarray:
    """The bytes of the lower 16 or 32 bits, whichever ``width`` fits in."""
    return np.ascontiguousarray(values.astype("<u2" if width <= 16 else "<u4")).view(np.uint8)


def pack_blocks(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The blocks of ``ids`` (uint32) and where each starts."""
    count = -(-len(ids) // BLOCK)
    if not count:
        return b"", np.empty(0, np.uint64)
    full = np.empty(count * BLOCK, np.uint32)
    full[: len(ids)] = ids
    full[len(ids) :] = ids[-1]
    blocks = full.reshape(count, BLOCK)
    low = blocks.min(axis=1)
    rest = blocks - low[:, None]
    place = min(BLOCK - 1, -(-BLOCK * PERCENT // 100) - 1)
    typical = np.partition(rest, place, axis=1)[:, place]
    width = np.ceil(np.log2(typical.astype(np.float64) + 1)).astype(np.int64)
    upper = rest >> np.minimum(width, 31).astype(np.uint32)[:, None]
    upper[width == 32] = 0
    patched = upper > 0
    patches = patched.sum(axis=1)
    packed = BLOCK // 8 * width
    size = HEAD + packed + 5 * patches
    starts = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(starts[-1], np.uint8)
    starts, head = starts[:-1], np.zeros((count, HEAD), np.uint8)
    head[:, :4] = low.astype("<u4").view(np.uint8).reshape(count, 4)
    head[:, 4], head[:, 5] = width, patches
    out[starts[:, None] + np.arange(HEAD)] = head
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            bits = np.unpackbits(_narrow(rest[rows], w), bitorder="little").reshape(len(rows), BLOCK, -1)[:, :, :w]
            raw = np.packbits(bits.reshape(len(rows), BLOCK * int(w)), axis=1, bitorder="little")
            out[starts[rows][:, None] + HEAD + np.arange(raw.shape[1])] = raw
    row, column = np.nonzero(patched)
    if len(row):
        nth = np.arange(len(row)) - np.repeat(np.cumsum(patches) - patches, patches)
        at = starts[row] + HEAD + packed[row]
        out[at + nth] = column
        raw = upper[row, column].astype("<u4").view(np.uint8).reshape(-1, 4)
        out[(at + patches[row] + 4 * nth)[:, None] + np.arange(4)] = raw
    return out.tobytes(), starts.astype(np.uint64)


def unpack_blocks(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The ids of whole blocks that start at ``starts`` within ``data`` (uint8)."""
    starts = starts.astype(np.int64)
    head = data[starts[:, None] + np.arange(HEAD)]
    low = np.ascontiguousarray(head[:, :4]).view("<u4").reshape(-1)
    width, patches = head[:, 4].astype(np.int64), head[:, 5].astype(np.int64)
    packed = BLOCK // 8 * width
    rest = np.zeros((len(starts), BLOCK), np.uint32)
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            raw = data[starts[rows][:, None] + HEAD + np.arange(BLOCK // 8 * w)]
            bits = np.zeros((len(rows), BLOCK, 16 if w <= 16 else 32), np.uint8)
            bits[:, :, :w] = np.unpackbits(raw, axis=1, bitorder="little").reshape(len(rows), BLOCK, int(w))
            rest[rows] = np.packbits(bits, bitorder="little").view("<u2" if w <= 16 else "<u4").reshape(len(rows), BLOCK)
    row = np.repeat(np.arange(len(starts)), patches)
    if len(row):
        nth = np.arange(len(row)) - np.repeat(np.cumsum(patches) - patches, patches)
        at = starts[row] + HEAD + packed[row]
        column = data[at + nth]
        raw = np.ascontiguousarray(data[(at + patches[row] + 4 * nth)[:, None] + np.arange(4)])
        rest[row, column] |= raw.view("<u4").reshape(-1) << width[row].astype(np.uint32)
    return (rest + low[:, None]).reshape(-1)


class Writer:
    """One file, written block by block; at most ``step`` ids wait for their blocks."""

    def __init__(self, path: str, step: int = 8192 * BLOCK):
        self.path, self.step, self.at = path, step, len(MAGIC)
        system, inner = fs.FileSystem.from_uri(path)
        system.create_dir(os.path.dirname(inner), recursive=True)
        self.out = system.open_output_stream(inner, compression=None)
        self.out.write(MAGIC)
        self.waiting, self.held, self.ids = [], 0, 0
        self.docs, self.ends, self.starts = [], [], []

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.held += len(ids)
        self.ids += len(ids)
        self.docs.append(doc)
        self.ends.append(self.ids)
        if self.held >= self.step:
            self._flush(self.held - self.held % BLOCK)

    def _flush(self, count: int) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.empty(0, np.uint32)
        data, starts = pack_blocks(ids[:count])
        self.out.write(data)
        self.starts.append(starts + np.uint64(self.at))
        self.at += len(data)
        self.waiting, self.held = [ids[count:]], len(ids) - count

    def close(self) -> tuple[int, int, int]:
        self._flush(self.held)
        starts = np.concatenate(self.starts) if self.starts else np.empty(0, np.uint64)
        foot = [
            np.array([d or 0 for d in self.docs], "<i8").tobytes(),
            np.array([d is not None for d in self.docs], np.uint8).tobytes(),
            np.array(self.ends, "<u8").tobytes(),
            starts.astype("<u8").tobytes(),
            np.array([len(self.docs), self.ids, len(starts), self.at], "<u8").tobytes(),
            MAGIC,
        ]
        for part in foot:
            self.out.write(part)
        self.out.close()
        return len(self.docs), self.ids, self.at + sum(map(len, foot))


class Reader:
    """A file's documents and, block by block, its ids."""

    def __init__(self, path: str):
        system, inner = fs.FileSystem.from_uri(path)
        self.file = system.open_input_file(inner)
        tail = len(MAGIC) + 32
        size = self.file.size()
        raw = self.file.read_at(tail, size - tail) if size >= tail + len(MAGIC) else b""
        if raw[-len(MAGIC) :] != MAGIC:
            raise ValueError(f"{path} is no complete token file")
        docs, self.n_ids, blocks, self.foot = (int(x) for x in np.frombuffer(raw[:32], "<u8"))
        foot = self.file.read_at(size - tail - self.foot, self.foot)
        ids = np.frombuffer(foot, "<i8", docs)
        valid = np.frombuffer(foot, np.uint8, docs, 8 * docs)
        self.docs = [int(d) if v else None for d, v in zip(ids, valid)]
        self.ends = np.frombuffer(foot, "<u8", docs, 9 * docs).astype(np.int64)
        self.starts = np.frombuffer(foot, "<u8", blocks, 17 * docs).astype(np.int64)

    def ids(self, first: int, count: int) -> np.ndarray:
        """``count`` ids from number ``first``, from the blocks that hold them."""
        if not count:
            return np.empty(0, np.uint32)
        a, b = first // BLOCK, (first + count - 1) // BLOCK + 1
        begin = int(self.starts[a])
        end = int(self.starts[b]) if b < len(self.starts) else self.foot
        data = np.frombuffer(self.file.read_at(end - begin, begin), np.uint8)
        found = unpack_blocks(data, self.starts[a:b] - begin)
        return found[first - a * BLOCK : first - a * BLOCK + count]

    def documents(self, step: int = 1 << 20):
        """(doc id, first id number, ids), decoding about ``step`` ids at a time."""
        i = 0
        while i < len(self.docs):
            first = int(self.ends[i - 1]) if i else 0
            j = max(i + 1, int(np.searchsorted(self.ends, first + step, "right")))
            ids, begin = self.ids(first, int(self.ends[j - 1]) - first), first
            for k in range(i, j):
                end = int(self.ends[k])
                yield self.docs[k], begin, ids[begin - first : end - first]
                begin = end
            i = j

    def close(self) -> None:
        self.file.close()


# -- tokens ---------------------------------------------------------------------------------------------------------

#: White space as the tokenizer's pattern knows it.
_SPACE = "\t-\r \x85\xa0  -     　"
#: Places where the pattern always cuts: before a word with its one space, behind letters that an ASCII sign follows,
#: and inside runs of white space.
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
_SEGMENT = re.compile(rf" ?[{_LETTER}]+(?=[\x00-@\[-`{{-\x7f]|\Z)| ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]")

_encoders: dict[str, Encoder] = {}


class Encoder:
    """Ids of texts by the tokenizers library; segments seen before in this worker are looked up.

    The byte-level tokenizer cuts text by a pattern before it merges, and ``_SEGMENT`` cuts only where that pattern does,
    so the ids of a text are those of its segments. New segments are encoded together and told apart by their bytes.
    Without ``specials`` their strings in a text are plain text.
    """

    def __init__(self, path: str, specials: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not specials
        resize = getattr(self.library.model, "_resize_cache", None)
        if resize:  # every segment comes once, so the library's own memo of words only costs time
            resize(0)
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.lengths = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.lengths[i] = len(token)  # one character for each byte
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()] if specials else []
        self.known: dict[str, bytes] = {}

    def plain(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, segments: list[str]) -> None:
        words = [s for s in segments if s[0] == " " and len(s) > 1 and s[1] not in "\t\n\r\x0b\x0c \x85\xa0"]
        others = list(set(segments).difference(words))
        for other, made in zip(others, self.library.encode_batch_fast(others, add_special_tokens=False)):
            self.known[other] = np.array(made.ids, "<u4").tobytes()
        if words:
            ids = np.array(self.library.encode_batch_fast(["".join(words)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.cumsum(self.lengths[ids])
            wanted = np.cumsum([len(w.encode()) for w in words])
            cuts = np.searchsorted(ends, wanted)
            if not np.array_equal(ends[cuts], wanted):
                raise ValueError("the tokenizer does not cut before words")
            first = 0
            for word, cut in zip(words, (cuts + 1).tolist()):
                self.known[word] = ids[first:cut].tobytes()
                first = cut

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, as the library gives them for the whole text, and the end id."""
        end = np.array([END_ID], "<u4").tobytes()
        split = [
            None if not t or any(s in t for s in self.special) else _SEGMENT.findall(t) for t in texts
        ]
        every = [s for s in split if s]
        if len(self.known) > SEGMENTS:  # what these texts have, which frequent segments are among, stays
            used = set(chain.from_iterable(every))
            self.known = {s: self.known[s] for s in used if s in self.known}
        new = set(filterfalse(self.known.__contains__, chain.from_iterable(every)))
        if new:
            self.learn(list(new))
        known = self.known.__getitem__
        out = []
        for text, segments in zip(texts, split):
            ids = b"".join(map(known, segments)) if segments else self.plain(text) if text else b""
            out.append(np.frombuffer(ids + end, "<u4"))
        return out


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# -- tables ---------------------------------------------------------------------------------------------------------


def write_token_files(
    docs: DataFrame, root: str, *, id_col: str = "doc_id", text: str = "text", tokenizer: str | None = None, file_ids: int = FILE_IDS
) -> DataFrame:
    """Encode every text and write the ids below ``root`` in ascending order of ``id_col``; returns the manifest.

    ``root`` must be a folder that all executors share. Null ids come first, equal ids stand in the order of their texts' hashes;
    a null or empty text has its end id alone; other columns are not carried; an empty table makes no file.
    A file is named after the task attempt that wrote it, and counts only if the manifest lists it: an attempt that
    was lost leaves a file that nobody reads. The manifest is itself written as a table.
    """
    path = tokenizer or default_tokenizer()
    ordered = (
        docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("hash"))
        .repartitionByRange("id", "hash")
        .sortWithinPartitions("id", "hash")
        .select("id", "text")
    )

    def write(batches):
        part, attempt, writer, seq, rows = TaskContext.get().partitionId(), uuid.uuid4().hex[:12], None, 0, []

        def finish():
            n_docs, n_ids, n_bytes = writer.close()
            rows.append((part, seq, writer.path, n_docs, n_ids, n_bytes))

        for batch in batches:
            columns = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i in range(0, batch.num_rows, 512):
                for doc, ids in zip(columns[0][i : i + 512], encoder(path).encode(columns[1][i : i + 512])):
                    if writer is None:
                        writer = Writer(f"{root}/{part:06d}-{seq:06d}-{attempt}.pfor")
                    writer.add(doc, ids)
                    if writer.ids >= file_ids:
                        finish()
                        writer, seq = None, seq + 1
        if writer is not None:
            finish()
        names = [c.split()[0] for c in MANIFEST.split(", ")]
        types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    return cut_lineage(ordered.mapInArrow(write, MANIFEST))


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with the number of ids in all files before each: totals of parts first, then within a part."""
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("part_ids").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("file_start", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
    return files.join(parts, "part").withColumn("start", F.col("part_start") + F.col("file_start"))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files."""

    def read(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader = Reader(path)
                rows = [(d, start + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for d, at, ids in reader.documents()]
                reader.close()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    files = with_starts(manifest).select("path", "start")
    partitions = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = files.repartition(partitions, "path")
    return spread.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


@query("op4_token_files")
def op4_token_files(spark, sf_dir):
    root = scratch_path(spark, "tokens")
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), root))


__all__ = ["Encoder", "Reader", "Writer", "pack_blocks", "read_token_files", "unpack_blocks", "write_token_files"]
