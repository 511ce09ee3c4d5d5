import random
import re

import numpy as np

from lectern.llm import minhash, textkit
from lectern.llm.components import components

from .conftest import frame, prose


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """{doc_id: (n, component)} over rows with an id."""
    sets = {i: shingles(t) for i, t, _ in rows if i is not None}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def changed(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def test_equals_brute_force(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(12):
        base = prose(rng, rng.randrange(6, 200))
        texts.append(base)
        texts += [changed(rng, base, rng.randrange(1, 8)) for _ in range(rng.randrange(8))]
    star = prose(rng, 150)  # copies that are near the middle one only
    texts += [star] + [changed(rng, star, 4) for _ in range(60)]
    texts += ["", None, "a b", "A  b", "a b c d e", "a b c d e f"]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = [(i, t, "en") for i, t in zip(ids, texts)]
    wanted = brute(rows)
    for parts in (1, 5):
        found = minhash.near_duplicates(frame(spark, rows).repartition(parts)).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == wanted
        assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_crowded_regions_are_settled(spark, monkeypatch):
    """With tiny blocks and packs nearly everything is left to the exact completion."""
    rng = random.Random(4)
    base = prose(rng, 100)
    rows = [(i, changed(rng, base, rng.randrange(5)), "en") for i in range(70)]
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "PACK_BYTES", 4000)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame(spark, rows)).collect()} == brute(rows)


def test_depth_follows_the_region():
    deep = np.array([[0, 0]] * 3 + [[0, 1]] * 2 + [[1, 0]] * 6 + [[2, 5]] * 2 + [[3, 0]], np.uint8)
    assert minhash.depth_parts(deep, 5) == [(0, 5), (5, 10), (10, 14)]
    assert minhash.depth_parts(deep[:3], 5) == [(0, 3)] and minhash.depth_parts(deep[:0], 5) == [(0, 0)]
    rng = np.random.default_rng(1)
    rows = np.sort(rng.integers(0, 4, (500, 1)) * 64 + rng.integers(0, 3, (500, 1)), axis=0).astype(np.uint8)
    parts = minhash.depth_parts(rows, 60)
    assert [a for a, _ in parts[1:]] == [b for _, b in parts[:-1]] and parts[-1][1] == 500 and all(b - a <= 60 for a, b in parts)


def test_first_shingles_meet():
    """Sets that link share a first shingle, whatever the counters; sets that share only what many hold do not."""
    rng = np.random.default_rng(2)
    heavy = rng.integers(0, 3, 1 << minhash.BUCKET_BITS).astype(np.uint8)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * 2)
        b = np.unique(np.concatenate((a[: len(a) - int(rng.integers(0, len(a) // 5 + 1))], rng.integers(0, 2**63, int(rng.integers(0, n // 6 + 1)), dtype=np.uint64))))
        if len(a) and len(b) and minhash.linked(a, b):
            assert len(np.intersect1d(minhash.first_shingles(a, heavy), minhash.first_shingles(b, heavy)))
    common = np.unique(rng.integers(0, 2**63, 96, dtype=np.uint64) * 2)
    heavy = np.zeros(1 << minhash.BUCKET_BITS, np.uint8)
    heavy[(common >> np.uint64(64 - minhash.BUCKET_BITS)).astype(np.int64)] = 12
    one, two = (np.unique(np.concatenate((common, rng.integers(0, 2**63, 60, dtype=np.uint64)))) for _ in range(2))
    assert not len(np.intersect1d(minhash.first_shingles(one, heavy), minhash.first_shingles(two, heavy)))


def test_boilerplate_leaves_nothing_to_compare(spark, monkeypatch):
    """Documents that share most of their words, but too few to link, meet in crowded regions and need no pair of packs."""
    rng = random.Random(6)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    seen = []
    monkeypatch.setattr(minhash, "_open_members", lambda m, s, real=minhash._open_members: seen.append(real(m, s)) or seen[-1])
    boiler = prose(rng, 100)
    rows = [(i, f"{boiler} {' '.join(f'w{rng.randrange(10**7)}' for _ in range(60))}", "en") for i in range(300)]
    rows += [(1000 + i, changed(rng, t, 2), x) for i, t, x in rows[:20]]
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert found == {i: i % 1000 for i, *_ in rows} and seen[0].count() <= 20


def test_recall_at_the_threshold(spark):
    """Pairs whose similarity is just over 0.75, measured."""
    rng = random.Random(8)
    rows, wanted = [], 0
    for k in range(1500):
        words = [f"v{rng.randrange(10**8)}" for _ in range(104)]
        other = words[:-14] + [f"u{rng.randrange(10**8)}" for _ in range(14)]  # 86 of 114 shingles: 0.754
        rows += [(2 * k, " ".join(words), "en"), (2 * k + 1, " ".join(other), "en")]
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert sum(found[2 * k + 1] == 2 * k for k in range(1500)) == 1500


def test_awkward(spark, awkward, empty):
    found = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in minhash.near_duplicates(awkward).collect()}
    assert found[2, 116] == (1, False) and found[1, 116] == (1, True) and found[3, 117] == (1, False)
    assert found[4, 0] == (4, True) and found[5, 0] == (5, True) and found[6, 0] == (6, True) and found[7, 1] == (7, True)
    assert found[None, 116] == (None, True)
    assert minhash.near_duplicates(awkward).count() == awkward.count()
    left = minhash.drop_near_duplicates(awkward)
    assert left.columns == awkward.columns and left.where("doc_id IN (2, 3)").count() == 0 and left.where("doc_id IN (1, 4, 5)").count() == 3
    assert minhash.near_duplicates(empty).count() == 0


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (5, 5), (20, 4), *((100, k) for k in range(101, 140))]
    found = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert found == {1: 1, 2: 1, 3: 1, 4: 1, 20: 1, 7: 7, 8: 7, 9: 7, **{k: 100 for k in range(100, 140)}}


def test_words_are_those_of_the_pattern():
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab \t\n\x0b\x1c\x85é漢 ") for _ in range(rng.randrange(60))) for _ in range(200)]
    seen = {}
    for lo, hashes, first in textkit.word_hashes([t.encode() for t in texts]):
        for i in range(len(first) - 1):
            words = re.findall(r"[^\x20\x09-\x0D]+", texts[lo + i])
            assert len(words) == first[i + 1] - first[i]
            for w, h in zip(words, hashes[first[i] : first[i + 1]]):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
