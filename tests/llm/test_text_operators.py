"""Quality rules, decontamination, pieces, token files: brute force, round trips and edge rows."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from foretrace.llm import decontaminate as D
from foretrace.llm import pieces as P
from foretrace.llm import quality as Q
from foretrace.llm import token_file as K

WORDS = "alpha beta gamma delta the of and in a foo bar baz Überall naïve 日本 x1 y2".split()
EDGE = [None, "", "   \n\t", "one", "a" * 30_000, "word " * 6000, "\x00 \x1c odd", "▁▁ <s> </s> <|endoftext|>", "é́ 🎉", " lead", "trail "]


def sentences(rnd, count, size=80):
    return [" ".join(rnd.choice(WORDS) + rnd.choice(["", "", ".", ",\n"]) for _ in range(rnd.randint(1, size))) for _ in range(count)]


def split(text):
    out, word = [], ""
    for c in text or "":
        if c in " \t\n\x0b\x0c\r":
            out, word = out + [word] * bool(word), ""
        else:
            word += c
    return out + [word] * bool(word)


def facts(text):
    words = split(text)
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for places in windows.values() if len(places) > 1 for i in places for k in range(3)}
    lines, seen, again = (text or "").split("\n"), set(), 0
    for line in lines:
        if split(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), again, len(covered)


def grams(text, buckets):
    h = [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in split(text)]
    return [x % buckets for x in h] + [(x * Q.PAIR + y) % buckets for x, y in zip(h, h[1:])]


def test_quality_equals_brute_force(spark, make_docs):
    rnd = random.Random(1)
    texts = sentences(rnd, 60, 120) + EDGE + ["foo bar baz " * 40, "x\nx\n\n x\nx", "| # a$b |"]
    texts += texts[:3]
    labels = [(i, int(i % 2), int(i % 7 == 0)) for i in range(0, 50)] + [(3, 0, 0), (3, 1, 0), (None, 1, 0), (900, 1, 0)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = Q.judge(make_docs(texts), labels, buckets=512).select("doc_id", "quality.*").collect()
    assert sorted(r.doc_id for r in got) == list(range(len(texts)))
    trusted = {i for i in range(50) if (i % 2 or i == 3) and i % 7}
    raw, good = [0] * 512, [0] * 512
    for i, t in enumerate(texts):
        for g in grams(t, 512):
            raw[g] += 1
            good[g] += i in trusted
    share = sum(good) / sum(raw)
    weight = [math.floor((math.log((g + 32 * share) / (r + 32)) - math.log(share)) * Q.UNIT + 0.5) for g, r in zip(good, raw)]
    for r in got:
        text = texts[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == facts(text), text
        score, n = sum(weight[g] for g in grams(text, 512)), len(grams(text, 512))
        assert (r.score, r.n_grams) == (score, n)
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and r.kept == (not failed and score >= int(Q.THRESHOLD * Q.UNIT) * n)


def test_quality_without_trust_and_without_rows(spark, make_docs):
    labels = spark.createDataFrame([(0, 0, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    long = " ".join(f"w{i}" for i in range(60))
    got = {r.doc_id: r.quality for r in Q.judge(make_docs([long, "short", None]), labels).collect()}
    assert got[0].kept and got[0].llr == 0 and not got[1].kept and not got[2].kept
    assert Q.judge(make_docs([]), labels).count() == 0


def words_of(text):
    return [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c if ord(c) > 127 or c.isalnum() else " " for c in text or "").split(" ") if w]


def overlap(text, items):
    words, hit, owners = words_of(text), set(), set()
    for item, body in items:
        w = words_of(body)
        size = min(len(w), 13)
        for i in range(len(w) - size + 1 if w else 0):
            for j in range(len(words) - size + 1):
                if words[j : j + size] == w[i : i + size]:
                    hit |= set(range(j, j + size))
                    owners.add("" if item is None else str(item))
    return len(words), len(hit), sorted(owners), bool(hit) and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("part_bytes", [D.PART_BYTES, 200])
def test_decontamination_equals_brute_force(spark, make_docs, part_bytes):
    rnd = random.Random(2)
    items = [(i, t) for i, t in enumerate(sentences(rnd, 12, 30))] + [(20, None), (21, "!?"), (22, "Gamma DELTA"), (22, "gamma delta"), (None, "naïve 日本"), (2, "foo")]
    texts = sentences(rnd, 30) + EDGE
    for i, t in items[:8]:
        texts.append(f"{rnd.choice(texts[:20])} -- {t.upper() if i % 2 else t} !! {rnd.choice(texts[:20])}")
        texts.append(" ".join(words_of(t)[1:14]) + " x " * 300)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.decontaminate(make_docs(texts), bench, part_bytes=part_bytes).select("doc_id", "overlap.*").collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r.doc_id]
        assert (r.n_words, r.n_hit, r["items"], r.contaminated) == overlap(text, items), text
        assert sum(len(words_of(text[s.start : s.stop])) for s in r.spans) == r.n_hit
        assert all(a.stop < b.start for a, b in zip(r.spans, r.spans[1:]))


@pytest.mark.parametrize("part_bytes", [D.PART_BYTES, 1])
def test_spans_of_items_in_several_parts_are_one(spark, make_docs, part_bytes):
    bench = spark.createDataFrame([(1, "q w e r t y u"), (2, "t y u i o p")], "item_id long, text string")
    docs = make_docs(["a b Q w e r T-y u i o p z", "q w e r t y"])
    got = {r.doc_id: ([tuple(s) for s in r.spans], r.n_hit, r["items"]) for r in D.decontaminate(docs, bench, part_bytes=part_bytes).select("doc_id", "overlap.*").collect()}
    assert got == {0: ([(4, 23)], 10, ["1", "2"]), 1: ([], 0, [])}


def test_decontamination_without_benchmark(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    rows = D.decontaminate(make_docs(["a b", None]), none).select("overlap.*").collect()
    assert [(r.n_hit, r.contaminated) for r in rows] == [(0, False)] * 2


@pytest.fixture(scope="module")
def piece_model():
    return P.model(P.default_model())


def test_pieces_equal_the_library(piece_model):
    rnd = random.Random(3)
    letters = "abcdefghijklmnoprstuwxyzéß \n▁日ЖABTH.,1290-_()"
    texts = [t or "" for t in EDGE] + sentences(rnd, 40) + ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 80))) for _ in range(800)]
    for text in texts:
        assert piece_model.encode(text) == piece_model.library.encode(text, add_eos=True), text[:80]


def test_piece_table(spark, make_docs, piece_model):
    texts = EDGE + sentences(random.Random(4), 10) + ["same", "same"]
    rows = {r.doc_id: r for r in P.encode_documents(make_docs(texts)).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        ids = piece_model.library.encode(text or "", add_eos=True)
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(piece_model.library.decode(ids).encode()).hexdigest()
    assert P.encode_documents(make_docs([])).count() == 0


@pytest.mark.parametrize("size", [0, 1, 127, 128, 129, 1000])
def test_blocks_round_trip(size):
    rnd = np.random.default_rng(size)
    for top in (1, 2, 300, 50_000, 2**32):
        ids = rnd.integers(0, top, size, dtype=np.uint64).astype(np.uint32)
        data, starts = K.pack_blocks(ids)
        assert (K.unpack_blocks(np.frombuffer(data, np.uint8), starts)[:size] == ids).all()


def test_outliers_become_exceptions():
    ids = np.full(1280, 7, np.uint32)
    ids[::100] = 4_000_000_000
    data, starts = K.pack_blocks(ids)
    assert len(data) < 300 and (K.unpack_blocks(np.frombuffer(data, np.uint8), starts) == ids).all()


def test_any_range_is_read_from_its_blocks(tmp_path):
    rnd = np.random.default_rng(5)
    parts = [rnd.integers(0, 60_000, n).astype(np.uint32) for n in (5, 0, 400, 1, 3000)]
    writer = K.Writer(f"{tmp_path}/x.pfor", step=256)
    for i, ids in enumerate(parts):
        writer.add(None if i == 3 else i, ids)
    writer.close()
    reader, whole = K.Reader(f"{tmp_path}/x.pfor"), np.concatenate(parts)
    for a, n in ((0, 3406), (127, 2), (128, 128), (3400, 6), (10, 0)):
        assert (reader.ids(a, n) == whole[a : a + n]).all()
    assert [(d, len(i)) for d, _, i in reader.documents(step=100)] == [(0, 5), (1, 0), (2, 400), (None, 1), (4, 3000)]
    (tmp_path / "cut.pfor").write_bytes((tmp_path / "x.pfor").read_bytes()[:-9])
    with pytest.raises(ValueError, match="complete"):
        K.Reader(f"{tmp_path}/cut.pfor")


def test_token_files_equal_the_library(spark, make_docs, tmp_path):
    rnd = random.Random(6)
    letters = "abcTH.,' \n\t\x1c\x85 é日1'st-"
    texts = EDGE + sentences(rnd, 30) + ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 50))) for _ in range(400)]
    ids = [3 * i for i in range(len(texts))]
    ids[5] = None
    manifest = K.write_token_files(make_docs(texts, ids), f"{tmp_path}/t", file_ids=500)
    got = {r.doc_id: r for r in K.read_token_files(manifest).collect()}
    assert len(got) == len(texts) and manifest.count() > 3
    library, start = K.encoder(K.default_tokenizer()).library, 0
    for i in sorted(range(len(texts)), key=lambda i: (ids[i] is not None, ids[i] or 0)):
        want = np.array(library.encode(texts[i] or "", add_special_tokens=False).ids + [2], "<u4")
        r = got[ids[i]]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want), zlib.crc32(want.tobytes())), texts[i]
        start += len(want)
    assert K.read_token_files(K.write_token_files(make_docs([]), f"{tmp_path}/none")).count() == 0
