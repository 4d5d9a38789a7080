import random
import re

from veilspark.llm import decontaminate


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, n=10):
    out = []
    for i, text in docs:
        w, hit, found = words_of(text), set(), set()
        for item, t in items:
            v = words_of(t)
            windows = [v[k : k + n] for k in range(max(len(v) - n + 1, 1))] if v else []
            for x in windows:
                for at in range(len(w) - len(x) + 1):
                    if w[at : at + len(x)] == x:
                        hit |= set(range(at, at + len(x)))
                        found.add(item)
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, sorted(r.items)) for r in df.collect()), key=str)


def test_hits_are_those_of_every_position(spark):
    r = random.Random(11)
    lexicon = ["a", "the", "of", "Über", "naïve", "x7", "rare", "漢字", "word", "end", "Start", "zz"]
    text = lambda n: " ".join(r.choice(lexicon) for _ in range(n))
    items = [(i, text(r.choice([3, 5, 9, 10, 11, 25, 40]))) for i in range(25)] + [(30, None), (31, " -- "), (32, "naïve"), (5, text(12))]
    items.append((33, items[4][1].upper()))
    docs = [(i, text(r.choice([0, 4, 30, 80]))) for i in range(40)]
    for i in range(40):  # whole items, parts of them, and passages that many rows share
        t = (r.choice(items)[1] or "").split()
        docs.append((100 + i, f"{text(3)}, {' -- '.join(t[r.randrange(3):])}! {text(4)}"))
    docs += [(200 + i, f"before {items[6][1]} after") for i in range(30)] + [(300, None), (301, ""), (101, docs[41][1]), (None, items[3][1])]
    left = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, items string")
    right = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    assert result(decontaminate.contamination(left, right)) == brute(docs, items)
    assert result(decontaminate.contamination(left, right, filter_bits=15)) == brute(docs, items)  # a table that passes more
    assert decontaminate.contamination(left.limit(0), right).count() == 0
    assert all(r.n_hit == 0 and not r.items for r in decontaminate.contamination(left, right.limit(0)).collect())


def test_digests(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "nothing")], "doc_id long, text string")
    items = spark.createDataFrame([(10, "one two"), (9, "THREE")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.digests(decontaminate.contamination(docs, items)).collect()}
    import hashlib

    assert got[1].items_sha256 == hashlib.sha256(b"10,9").hexdigest() and got[1].n_hit == 3 and got[1].contaminated
    assert got[2].items_sha256 == hashlib.sha256(b"").hexdigest() and not got[2].contaminated
