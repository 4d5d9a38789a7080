import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veilspark.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def random_texts(rng, n):
    words = ["don't", "It's", "x!'s", "naïve", "ÉTÉ", "İstanbul", "ΣΑΣ", "漢字かな", "a\u0301b", "\u0301", "...", "3,14", "²x", "C++", "'", "\x1c", "\x85", "\u00a0k", "🙂🙂", "<|endoftext|>", "<|", "the", "Über", "ß", "ǅ", "\u212a", "\u1e9e", "ﬁ", "x\u200dy", "º", "A\u030a", "e\u0338="]
    gaps = [" ", "  ", "\n", "\t", "\x0b", "\x0c", "\r\n", "\u2003", ""]
    return ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(12))) for _ in range(n)]


def test_ids_are_those_of_the_library():
    texts = random_texts(random.Random(1), 1500) + ["", " ", "a" * 30_000, "é" * 5000, "word " * 20_000]
    whole = Tokenizer.from_file(PATH)
    got = packing.WordTokenizer(PATH).texts(pa.array(texts))
    for text, ids in zip(texts, got, strict=True):
        assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def best_fit_decreasing(lengths, capacity):
    bins = []
    for length in sorted(lengths, reverse=True):
        fits = [i for i, free in enumerate(bins) if free >= length]
        if fits:
            bins[min(fits, key=lambda i: bins[i])] -= length
        else:
            bins.append(capacity - length)
    return len(bins)


def laid_out(plan, counts, capacity):
    """The plan's pieces by sequence; every piece once, no gaps, nothing too long."""
    numbers, rows = defaultdict(list), defaultdict(list)
    for length, first, last, sequence, per, offset in plan.runs:
        numbers[length].append((first, last))
        for r in range(last - first):
            rows[sequence + r // per].append((offset + r % per * length, length))
    for length, n in counts.items():
        runs = sorted(numbers[length])
        assert runs[0][0] == 0 and runs[-1][1] == n and all(a[1] == b[0] for a, b in zip(runs, runs[1:]))
    assert set(rows) == set(range(plan.sequences))
    for parts in rows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity


def test_plans():
    rng = random.Random(2)
    cases = [Counter(rng.choice([rng.randint(1, 100), rng.randint(1, 30), 100, 51, 34]) for _ in range(n)) for n in (1, 2, 5, 50, 800)]
    cases += [Counter({51: 400}), Counter({100: 70, 1: 1}), Counter({34: 300, 33: 300, 32: 1}), Counter({60: 300, 41: 200, 40: 300}), Counter(rng.randint(30, 70) for _ in range(900))]
    for counts in cases:
        plan = packing.packing_plan(dict(counts), 100, groups=16)
        laid_out(plan, counts, 100)
        least = -(-sum(k * n for k, n in counts.items()) // 100)
        assert least <= plan.sequences <= best_fit_decreasing(counts.elements(), 100) * 1.02 + 1, counts
    groups = packing.equal_groups([(9, 5), (8, 3), (7, 4)], 3)
    assert groups == [[(9, 4)], [(9, 1), (8, 3)], [(7, 4)]]


def test_configurations_are_optimal():
    sizes, demand = np.array([50, 33, 26]), np.array([30.0, 40.0, 50.0])
    used = packing.configurations(sizes, demand, 100)
    assert all(pattern @ sizes <= 100 for pattern, _ in used)
    assert np.allclose(sum(pattern * use for pattern, use in used), demand)
    assert abs(sum(use for _, use in used) - (15 + 40 / 3 + 50 / 3)) < 1 + 1e-6


def test_pack(spark):
    rng = random.Random(4)
    texts = random_texts(rng, 300) + [None, "", "word " * 9000, "x" * 4000, "the " * 2047, "the " * 2046, "the " * 2048] + ["same text"] * 50
    rows = [(i, t, "clash", 1, 2) for i, t in enumerate(texts)] + [(3, texts[3], "clash", 1, 2), (None, "no id", "clash", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string, length int, number int").repartition(5)
    packed = packing.pack(docs, PATH).cache()
    whole = Tokenizer.from_file(PATH)
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 0]
        want.update((doc_id, at // 2048, at, tuple(ids[at : at + 2048])) for at in range(0, len(ids), 2048))
    got = packed.collect()
    assert Counter((r.doc_id, r.piece, r.start, tuple(r.ids)) for r in got) == want
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) for r in got)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r)
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(sequences) <= -(-sum(r.length for r in got) // 2048) + 1
    written = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    for key, parts in sequences.items():
        parts.sort(key=lambda r: r.offset)
        assert written[key].ids == [i for r in parts for i in r.ids]
        assert [s.doc_id for s in written[key].spans] == [r.doc_id for r in parts]
    assert packing.pack(docs.limit(0), PATH, ids=False).count() == 0
    assert packing.pack(docs, PATH, ids=False).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert packed.where(F.col("doc_id").isNull()).count() == 1
