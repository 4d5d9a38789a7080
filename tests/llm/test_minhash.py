import random
import re

import numpy as np

from veilspark.llm import minhash


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def brute(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = words_of(t)
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    group = {i: i for i in sets}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                group[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def corpus():
    r = random.Random(3)
    lexicon = ["".join(r.choice("abcdeinorst") for _ in range(r.randint(2, 7))) for _ in range(400)]
    rows, base = [], [r.choice(lexicon) for _ in range(120)]
    for i in range(60):  # a large group whose members differ in a few places, some beyond the limit
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = r.choice(lexicon)
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(base).upper()) for i in range(5)]
    rows += [(200 + i, " ".join(r.choice(lexicon) for _ in range(r.choice([1, 2, 3, 8, 60])))) for i in range(60)]
    rows += [(300, "two words"), (301, "Two  WORDS\n"), (302, "two"), (303, ""), (304, " \n\t"), (305, None), (306, "É é"), (307, "é é"), (308, "x" * 20000)]
    return rows


def test_groups_are_those_of_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, component_id string, print string")
    for width, percent in ((3, 85), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, width=width, percent=percent).collect()}
        assert got == brute(rows, width, percent)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    text = "the same five words again and again"
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text), (None, None)], "doc_id long, text string")
    got = sorted(map(str, map(tuple, minhash.near_duplicates(docs).collect())))
    assert got == sorted(["(1, 3, 1, True)", "(1, 3, 1, True)", "(2, 3, 1, False)", "(None, 3, None, True)", "(None, 0, None, True)"])
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_signature_is_that_of_whole_permutations():
    r = np.random.default_rng(1)
    sets = [r.integers(0, 2**63, n).astype(np.uint64) for n in (1, 3, 40, 700)]
    owner = np.repeat(np.arange(4, dtype=np.int32), [len(s) for s in sets])
    together = minhash.super_minhash(np.concatenate(sets), owner, 4)
    for i, s in enumerate(sets):
        alone = minhash.super_minhash(s, np.zeros(len(s), np.int32), 1)[0]
        halves = [minhash.super_minhash(h, np.zeros(len(h), np.int32), 1)[0] for h in np.array_split(s, min(3, len(s)))]
        assert (together[i] == alone).all() and (np.minimum.reduce(halves) == alone).all()
        assert (alone < np.uint64(minhash.SLOTS << 32)).all()
    a, b = r.integers(0, 2**63, 1000).astype(np.uint64), r.integers(0, 2**63, 1000).astype(np.uint64)
    shared = np.concatenate([a[:800], b[:100]])  # 800 of 1000 + 900 - 800
    x, y = (minhash.super_minhash(s, np.zeros(len(s), np.int32), 1)[0] for s in (a, shared))
    assert abs((x == y).mean() - 800 / 1100) < 0.1


def test_bands_follow_the_limit():
    assert minhash.banding(85) == (32, 8) and minhash.slots_alike(85) == 178 and minhash.banding(80) == (42, 6)
    for percent in (50, 70, 80, 85, 90, 100):
        bands, width = minhash.banding(percent)
        assert bands * width <= minhash.SLOTS and minhash.missed(percent, bands, width) <= 4e-5
        p = percent / 100
        assert minhash.slots_alike(percent) <= 256 * p - 6.9 * (256 * p * (1 - p)) ** 0.5
    sets = [np.arange(1, 50, dtype=np.uint64)] * 2
    keys, sketch = minhash._signed(np.array([49, 49]), sets, 256, *minhash.banding(80))
    assert keys.shape == (2, 42) and (keys[0] == keys[1]).all() and len(set(keys[0].tolist())) == 42 and sketch.shape == (2, 256)
