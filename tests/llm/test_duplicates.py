"""Near-duplicates, components, suffix arrays and substring removal against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from foretrace.llm import near_dup as N
from foretrace.llm import substrings as B
from foretrace.llm import suffixes as X
from foretrace.llm.components import connected_components


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def flipped(rnd, value, bits):
    for b in rnd.sample(range(64), bits):
        value ^= 1 << b
    return value


@pytest.mark.parametrize("heavy, segments", [(N.HEAVY, 0), (2, 0), (N.HEAVY, 1), (2, 1)])
def test_links_equal_brute_force(spark, heavy, segments):
    rnd = random.Random(1)
    values = [0]
    for _ in range(25):
        base = rnd.getrandbits(64)
        values += [flipped(rnd, base, rnd.randint(0, 6)) for _ in range(6)]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    frame = spark.createDataFrame([(signed(v),) for v in values] + [(None,)], "f long")
    _, widths, radii = N.SEGMENTS[segments]
    pairs = {(r.a, r.b) for r in N.linked_pairs(frame, "f", widths=widths, radii=radii, heavy=heavy).collect()}
    nodes = sorted({signed(v) for v in values})
    want = {(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
    assert pairs <= want if heavy == 2 else pairs == want
    assert brute_components(nodes, pairs) == brute_components(nodes, want)


def test_radii_must_cover_the_distance(spark):
    with pytest.raises(ValueError, match="radii"):
        N.linked_pairs(spark.createDataFrame([(1,)], "f long"), "f", widths=(22, 21, 21), radii=(1, 0, 0))


@pytest.mark.parametrize("heavy", [N.HEAVY, 2])
def test_near_duplicates_equal_brute_force(spark, make_docs, heavy):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(500)]
    texts = [None, "", " \n", "one", "ONE", "one two", "x " * 9000]
    for _ in range(12):
        base = [rnd.choice(words) for _ in range(rnd.choice([30, 400]))]
        for k in range(5):
            copy = list(base)
            for _ in range(k):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            texts.append(" ".join(copy))
    texts += texts[5:10]
    ids = [1000 - 2 * i for i in range(len(texts))]
    ids[10], ids[-1] = None, ids[20]
    rows = N.near_duplicates(make_docs(texts, ids), heavy=heavy).collect()
    assert len(rows) == len(texts)
    prints = [brute_print(t) for t in texts]
    nodes = sorted(set(prints))
    linked = [(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1 :] if (a ^ b).bit_count() <= 4]
    root = brute_components(nodes, linked)
    least = {}
    for i, p in zip(ids, prints):
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    want = sorted((str(i), p, least.get(root[p])) for i, p in zip(ids, prints))
    assert sorted((str(r.doc_id), r.fp % (1 << 64), r.component_id) for r in rows) == want
    assert N.near_duplicates(make_docs([])).count() == 0


def test_components_of_chains_stars_and_nulls(spark):
    rnd = random.Random(3)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(200, 200), (7, 7), (None, 3), (3, None), (300, 299), (299, 300)]
    rnd.shuffle(pairs)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    real = [p for p in pairs if None not in p and p[0] != p[1]]
    want = brute_components({n for p in real for n in p}, real)
    assert got == {n: r for n, r in want.items() if n != r}


@pytest.mark.parametrize("small", [X.SMALL, 0])
def test_suffix_arrays(monkeypatch, small):
    monkeypatch.setattr(X, "SMALL", small)
    rnd = random.Random(4)
    texts = [[rnd.randrange(k) for _ in range(rnd.randint(1, 60))] for k in (1, 2, 3, 30) for _ in range(60)] + [[5] * 500, [1, 2] * 200]
    for text in texts:
        data = np.array(text, np.uint8)
        array = X.suffix_array(data)
        want = sorted(range(len(text)), key=lambda i: text[i:])
        assert array.tolist() == want
        before, common = X.permuted_common_prefixes(data, array)
        for a, b in zip(want, want[1:]):
            n = 0
            while max(a, b) + n < len(text) and text[a + n] == text[b + n]:
                n += 1
            assert (before[b], common[b]) == (a, n)


def brute_removed(raws, window):
    places = {}
    for n, raw in enumerate(raws):
        for i in range(len(raw) - window + 1):
            places.setdefault(raw[i : i + window], []).append((n, i))
    covered = [bytearray(len(raw)) for raw in raws]
    for found in places.values():
        if len(found) > 1:
            for n, i in found:
                covered[n][i : i + window] = b"\1" * window
    out = []
    for raw, mask in zip(raws, covered):
        spans = sum(1 for i, m in enumerate(mask) if m and not (i and mask[i - 1]))
        kept = bytes(b for b, m in zip(raw, mask) if not m)
        out.append((len(raw), sum(mask), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("group_bytes", [B.GROUP_BYTES, 300])
def test_removal_equals_brute_force(spark, make_docs, group_bytes):
    rnd = random.Random(5)
    letters = "abcdé日 \n"
    noise = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    passages = [noise(rnd.randint(20, 200)) for _ in range(6)] + ["a" * 90, "ab" * 60]
    texts = [None, "", "x", "y" * 500, "pq" * 300, noise(39), noise(5000)]
    texts += ["".join(rnd.choice([noise(rnd.randint(0, 60)), rnd.choice(passages)]) for _ in range(rnd.randint(1, 8))) for _ in range(60)]
    texts += texts[8:14] + [passages[0]] * 3
    ids = list(range(len(texts)))
    ids[9], ids[10], ids[-1] = None, None, ids[-2]
    got = B.remove_repeats(make_docs(texts, ids), window=40, gram=8, shard_bytes=900, group_bytes=group_bytes).collect()
    want = [(str(i), *f) for i, f in zip(ids, brute_removed([(t or "").encode() for t in texts], 40))]
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want)


def brute_passages(texts, count):
    split = [(t or "").encode().split() for t in texts]
    times = {}
    for ws in split:
        for i in range(len(ws) - count + 1):
            times[tuple(ws[i : i + count])] = times.get(tuple(ws[i : i + count]), 0) + 1
    out = []
    for ws in split:
        told = set()
        for i in range(len(ws) - count + 1):
            if times[tuple(ws[i : i + count])] > 1:
                told |= set(range(i, i + count))
        out.append(len(told))
    return out


@pytest.mark.parametrize("group_bytes", [B.GROUP_BYTES, 300])
def test_passages_are_counted_whatever_stands_between_the_words(spark, make_docs, group_bytes):
    rnd = random.Random(9)
    noise = lambda n: [rnd.choice("abcdefghij") + str(rnd.randrange(300)) for _ in range(n)]
    shared, lines = noise(60), noise(51)
    gaps = [" ", "\n", "\t  "]
    texts = [None, "", "one", " ".join(noise(49)), "\xa0".join(noise(60)), " ".join(["same"] * 120), " ".join(lines + lines)]
    for _ in range(40):
        parts = noise(rnd.randrange(30)) + shared[: rnd.choice([49, 50, 60])] + noise(rnd.randrange(30))
        texts.append("".join(w + rnd.choice(gaps) for w in parts))
    texts += [texts[9], texts[9], "x" * 9000 + " " + " ".join(noise(70))]
    got = B.remove_repeats(make_docs(texts), group_bytes=group_bytes).collect()
    assert {r.doc_id: r.n_passage_words for r in got} == dict(enumerate(brute_passages(texts, 50)))
    want = brute_removed([(t or "").encode() for t in texts], 400)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == dict(enumerate(want))


def test_crowded_keys_are_dealt_by_what_stands_around_their_gram():
    from foretrace.llm.minimizers import anchored, segments

    rnd = np.random.default_rng(3)
    raw = rnd.integers(0, 3, 3000).astype(np.uint8).tobytes() + b"z" * 200
    for key, a, b, _ in segments(raw, 60, 8):
        part = raw[a:b]
        for width in (84, 21, 5, 1):
            cuts = anchored(part, key, width, 60, 8)
            assert [i for _, x, y in cuts for i in range(x, y - 59)] == list(range(len(part) - 59))
            if width == 1:
                assert all(y - x == 60 for _, x, y in cuts)
    same = {}
    for key, a, b, _ in segments(raw * 2, 60, 8):
        for key_, x, y in anchored((raw * 2)[a:b], key, 1, 60, 8):
            same.setdefault((raw * 2)[a + x : a + y], set()).add(key_)
    assert all(len(keys) == 1 for keys in same.values())


def test_kept_bytes_and_empty_table(spark, make_docs):
    rows = B.remove_repeats(make_docs(["z" * 39 + "é", "12345" + "q" * 50, "67" + "q" * 50]), with_kept=True, window=40, gram=8).collect()
    assert {r.doc_id: bytes(r.kept) for r in rows} == {0: ("z" * 39 + "é").encode(), 1: b"12345", 2: b"67"}
    assert B.remove_repeats(make_docs([])).count() == 0


def test_segments_do_not_depend_on_the_step():
    from foretrace.llm.minimizers import segments

    rnd = np.random.default_rng(6)
    raw = rnd.integers(0, 4, 5000).astype(np.uint8).tobytes()
    windows = lambda step: {(k, i) for k, a, b, _ in segments(raw, 60, 8, step) for i in range(a, b - 59)}
    assert windows(1 << 20) == windows(333) and len(windows(333)) == 5000 - 59
