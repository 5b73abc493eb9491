"""Filter audit, sharding and tokenizer alignment against brute force."""

import hashlib
import random
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from foretrace.llm import alignment as A
from foretrace.llm import filter_audit as Q
from foretrace.llm import sharding as S

WHITE = " \t\n\x0b\x0c\r"

# -- filter audit -----------------------------------------------------------------------------------------------------


def brute_masks(rows):
    out = []
    for doc, text, _ in rows:
        text = text or ""
        words, at = [], ""
        for c in text + " ":
            if c in WHITE:
                words += [at] if at else []
                at = ""
            else:
                at += c
        fails = [
            len(words) < 50,
            100 * len(set(words)) < 65 * len(words),
            100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
            any(c in "#$%&*|" for c in text),
            doc is not None and any(d is not None and d < doc and (t or "") == text for d, t, _ in rows),
        ]
        out.append(sum(f << i for i, f in enumerate(fails)))
    return out


def brute_report(rows, good, toxic):
    masks, out = brute_masks(rows), {}
    orders = ["".join(p) for p in permutations("ABCDE")]
    for part in {r[2] or "" for r in rows}:
        here = [(m, r[0]) for m, r in zip(masks, rows) if (r[2] or "") == part]
        removed_by = Counter()
        found = {}
        for order in orders:
            left = list(here)
            for step, c in enumerate(order, 1):
                bit = 1 << "ABCDE".index(c)
                gone = [x for x in left if x[0] & bit]
                left = [x for x in left if not x[0] & bit]
                failing = [x for x in here if x[0] & bit]
                removed_by[c] += len(gone)
                found[order, step] = [
                    len(left), len(gone), len(failing) - len(gone), sum(m == bit for m, _ in here),
                    sum(d in good for _, d in gone), sum(d in toxic for _, d in gone), c,
                ]
        for key, row in found.items():
            out[part, *key] = (*row[:-1], removed_by[row[-1]])
    return out


def audit_rows():
    rnd = random.Random(5)
    words = ["Alpha", "beta", "gamma", "delta", "Ä", "x#y", "zeta", "50%", "日本"]
    texts = [None, "", " \t\n", "ONE", " ".join(words * 8), " ".join(f"w{i}" for i in range(60)), "plain text here"]
    texts += [rnd.choice(WHITE).join(rnd.choice(words) for _ in range(rnd.choice([3, 49, 50, 51, 80]))) for _ in range(40)]
    texts += [rnd.choice(texts) for _ in range(40)]
    rows = [(i, t, rnd.choice(["a", "b", None, ""])) for i, t in enumerate(texts)]
    rows += [(None, texts[4], "a"), (None, texts[4], "b"), rows[10], rows[10]]
    rnd.shuffle(rows)
    return rows


def labelled(spark, good, toxic):
    ids = sorted(good | toxic)
    return spark.createDataFrame([(i, int(i in good), int(i in toxic)) for i in ids] + [(None, 1, 1)] + [(min(ids), 0, None)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("hot", [(10_000, 1000), (3, 1000)])
def test_every_order_of_the_filters(spark, monkeypatch, hot):
    monkeypatch.setattr(Q, "HOT_ROWS", hot[0])
    rows, good, toxic = audit_rows(), {1, 4, 5, 9, 33}, {4, 6, 50}
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, source string, hash string, part string")
    got = Q.audit_filters(docs, labelled(spark, good, toxic)).collect()
    facts = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in facts) for r in got} == brute_report(rows, good, toxic)
    assert len(got) == 600 * len({r[2] or "" for r in rows})


def test_combinations_with_other_filters(spark):
    docs = spark.createDataFrame([(1, "a", "s"), (2, "bb", "s"), (3, "a", "s"), (4, "bb", "t")], "doc_id long, text string, source string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    counts = Q.failure_counts(docs, none, {"X": F.col("text") == "a"}, copies="Y")
    assert sorted(map(tuple, counts.collect())) == [("s", 0, 1, 0, 0), ("s", 1, 1, 0, 0), ("s", 3, 1, 0, 0), ("t", 2, 1, 0, 0)]
    report = {(r["part"], r["filter_order"], r["step"]): r for r in Q.order_report(counts, "XY").collect()}
    assert report["s", "XY", 1]["removed"] == 2 and report["s", "YX", 2]["removed"] == 1 and report["s", "XY", 2]["redundant"] == 1
    assert report["s", "XY", 1]["shapley"] == 3


def test_audit_of_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert Q.audit_filters(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


# -- shards ---------------------------------------------------------------------------------------------------------


def shard_docs(spark, n=500):
    rnd = random.Random(3)
    rows = [(i, rnd.choice([None, "", "same text", "ü" * rnd.randrange(40), f"text {i}"]), "s", i) for i in range(n)]
    rows += [(None, "no id", "s", 1), (None, None, "t", 2), (7, "twice", "s", 3), (7, "twice", "s", 3), (8, "long " * 50_000, "s", 4)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, shard string, slot int")


@pytest.mark.parametrize("bucket_bytes", [1 << 24, 2000])
def test_shards_hold_every_row_once(spark, tmp_path, bucket_bytes):
    rows, docs = shard_docs(spark)
    made = S.write_shards(docs, f"{tmp_path}/a", shards=7, bucket_bytes=bucket_bytes).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "", r[2], r[3])
    assert sorted((tuple(r["record"]) for r in made), key=key) == sorted(rows, key=key)
    counts = Counter(r["shard"] for r in made)
    assert set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    for shard, n in counts.items():
        assert sorted(r["slot"] for r in made if r["shard"] == shard) == list(range(n))


def test_shards_are_the_same_again_and_differ_by_seed(spark, tmp_path):
    _, docs = shard_docs(spark, 300)
    place = lambda path, **kw: {
        (r["record"]["doc_id"], r["record"]["slot"]): (r["shard"], r["slot"])
        for r in S.write_shards(docs.where("doc_id < 300 AND doc_id <> 7 AND doc_id <> 8"), f"{tmp_path}/{path}", shards=5, bucket_bytes=900, **kw).collect()
    }
    first = place("a")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert place("b") == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    other = place("c", seed=1)
    assert other != first and set(other) == set(first)


def test_order_is_uniform(spark, tmp_path):
    docs = spark.range(4000).selectExpr("id AS doc_id", "'t' AS text")
    made = S.write_shards(docs, f"{tmp_path}/u", shards=4, bucket_bytes=4000).collect()
    rank = np.array([r["shard"] * 1000 + r["slot"] for r in sorted(made, key=lambda r: r["record"]["doc_id"])])
    assert sorted(rank) == list(range(4000))
    assert abs(np.corrcoef(np.arange(4000), rank)[0, 1]) < 0.06
    table = np.zeros((8, 8))
    np.add.at(table, (np.arange(4000) // 500, rank // 500), 1)
    assert ((table - 62.5) ** 2 / 62.5).sum() < 110  # chi-square of 49 degrees of freedom
    assert abs((np.diff(rank) > 0).mean() - 0.5) < 0.05


def test_shards_of_no_rows_and_of_nulls(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.write_shards(docs, f"{tmp_path}/none").count() == 0
    nulls = spark.createDataFrame([(None, None)] * 3, "doc_id long, text string")
    assert sorted((r["shard"], r["slot"]) for r in S.write_shards(nulls, f"{tmp_path}/nulls", shards=2).collect()) == [(0, 0), (0, 1), (1, 0)]


def test_registered_shards(spark, tmp_path):
    rows = [(1, "äb"), (2, None), (3, "äb")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in S.op12_external_shuffle_shards(spark, str(tmp_path)).collect()}
    assert {d: (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for d, r in got.items()} == {
        d: (16 + len((t or "").encode()), zlib.crc32((t or "").encode()), "rows", None) for d, t in rows
    }


# -- alignment --------------------------------------------------------------------------------------------------------


def token_bytes(tools):
    """Bytes of every token of both sides, from the byte alphabet of byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown}
    letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    names = {i: t for t, i in tools.encoder.library.get_vocab(True).items()}
    lib = tools.pieces
    b = lambda i: bytes([int(lib.id_to_piece(i)[3:5], 16)]) if lib.is_byte(i) else lib.id_to_piece(i).replace("▁", " ").encode()
    return lambda i: bytes(letters[c] for c in names[i]), b


def brute_alignment(rows):
    tools = A.sides(A.default_tokenizer(), A.default_model())
    bytes_a, bytes_b = token_bytes(tools)
    library = type(tools.encoder.library).from_file(A.default_tokenizer())
    library.encode_special_tokens = True
    made, total = [], Counter()
    for doc, text in rows:
        a = library.encode(" " + text, add_special_tokens=False).ids if text else []
        b = tools.pieces.encode(text) if text else []
        raw = b" " + (text or "").encode()
        if not text or b"".join(map(bytes_a, a)) != raw or b"".join(map(bytes_b, b)) != raw:
            made.append((doc, 0, 0, 0, [], ""))
            continue
        owners = [[k for k, i in enumerate(ids) for _ in of(i)] for ids, of in ((a, bytes_a), (b, bytes_b))]
        links = sorted(set(zip(*owners)))
        ends = [{sum(len(of(i)) for i in ids[: k + 1]) for k in range(len(ids))} for ids, of in ((a, bytes_a), (b, bytes_b))] if len(raw) < 400 else [
            {p + 1 for p in range(len(raw)) if p + 1 == len(raw) or own[p + 1] != own[p]} for own in owners
        ]
        groups, begin = [], 0
        for end in sorted(ends[0] & ends[1]):
            inside = [sorted({own[p] for p in range(begin, end)}) for own in owners]
            groups.append(",".join(str(a[k]) for k in inside[0]) + "|" + ",".join(str(b[k]) for k in inside[1]))
            begin = end
        pairs = [(a[i], b[j]) for i, j in links]
        total.update(pairs)
        made.append((doc, len(a), len(b), len(groups), pairs, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = Counter()
    for (_, y), n in total.items():
        best[y] = max(best[y], n)
    facts = [(d, x, y, g, len(p), sum(total[q] == best[q[1]] for q in p), sum(total[q] for q in p), h) for d, x, y, g, p, h in made]
    return facts, {(x, y): (n, n == best[y]) for (x, y), n in total.items()}


def alignment_rows():
    rnd = random.Random(11)
    words = ["the", "Zürich", "naïve", "日本語", "<|endoftext|>", "don't", "1234567", "😀", "\t", "\n\n", "  ", "x=1;", "A_b", "ﬁ", " ", "</s>", "<unk>"]
    texts = [None, "", " ", "\n", "▁", "a▁b", "\x00", "plain words", "<|endoftext|>", "é", "é ", "  two  spaces  "]
    texts += [rnd.choice(["", " "]).join(rnd.choice(words) for _ in range(rnd.randrange(1, 40))) for _ in range(60)]
    texts += ["".join(chr(rnd.choice([rnd.randrange(1, 128), rnd.randrange(160, 0x3000), rnd.randrange(0x1F300, 0x1F600)])) for _ in range(30)) for _ in range(30)]
    texts += ["the same text"] * 5 + [" ".join(rnd.choice(words) for _ in range(3000))]
    ids = [*range(len(texts) - 3), None, 4, 4]
    return list(zip(ids, texts))


def order(row):
    return (row[0] is not None, row[0] or 0, *row[1:])


@pytest.mark.parametrize("limits", [{}, {"run_links": 50, "group_runs": 2}])
def test_alignment_against_brute_force(spark, limits):
    rows = alignment_rows()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, run int, radix string").repartition(3)
    facts, pairs = A.align_documents(docs, **limits)
    expected, counts = brute_alignment(rows)
    assert sorted(map(tuple, facts.collect()), key=order) == sorted(expected, key=order)
    assert {(r["a_id"], r["b_id"]): (r["n"], r["best"]) for r in pairs.collect()} == counts


def test_blocks_are_merged_over_their_borders(monkeypatch):
    monkeypatch.setattr(A, "BLOCK_RECORDS", 7)
    tools = A.sides(A.default_tokenizer(), A.default_model())
    rnd = np.random.default_rng(2)
    blocks, total = [], Counter()
    for _ in range(5):
        run = A.Run(tools)
        docs, a, b = rnd.integers(0, 9, 400), rnd.integers(0, 4, 400), rnd.integers(0, 5, 400) * A.RADIX
        run.add(docs, a, b, 9)
        total.update((y << tools.bits_a | x) for x, y in zip(a.tolist(), b.tolist()))
        blocks += [row[1:] for row in run.blocks()]
    made = list(A.merged_counts(iter(sorted(blocks, key=lambda r: r[:2]))))
    pairs = np.concatenate([p for p, _ in made]).tolist()
    assert pairs == sorted(total) and np.concatenate([n for _, n in made]).tolist() == [total[p] for p in pairs]


def test_packed_blocks_round_trip():
    pairs = np.array([5, 5, 5, 1 << 40, 1 << 40, (1 << 45) + 3])
    docs, times = np.array([0, 7, 9, 0, 1000, 5]), np.array([1, 70000, 1, 2, 3, 1])
    own, each, back, n = A.unpack(A.pack(pairs, docs, times))
    assert np.repeat(own, each).tolist() == pairs.tolist() and back.tolist() == docs.tolist() and n.tolist() == times.tolist()


def test_alignment_of_no_rows(spark):
    facts, pairs = A.align_documents(spark.createDataFrame([], "doc_id long, text string"))
    assert facts.count() == 0 and pairs.count() == 0
