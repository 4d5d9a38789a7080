import hashlib
import random
import zlib
from collections import defaultdict

from veilspark.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, k int, depth string, parent string"


def brute(rows, family=5, reach=9):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn, role or "", text or ""))
    turns = {c: [x[1:] for x in sorted(v, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))] for c, v in own.items()}
    full = {}
    for c, v in turns.items():
        h = zlib.crc32(str(c).encode()) % reach
        start = c - (c % family if c >= 0 else -(-c % family))
        full[c] = turns.get(start, [])[:h] + v[h:]
    members = defaultdict(list)
    for c, v in full.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out, totals = [], {}
    for p in sorted(members, key=len, reverse=True):
        own_saved = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        leaves = sum(totals[x][0] for x in kids[p]) if kids[p] else 1
        totals[p] = (leaves, own_saved + sum(totals[x][1] for x in kids[p]))
        ends = ",".join(map(str, sorted(c for c in members[p] if len(full[c]) == len(p))))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(members[p]), len(p), parent, len(members[p]), len(kids[p]), *totals[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def check(spark, rows):
    table = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)
    got = trie.prefix_trie(table, trie.Forks())
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert {t for c, t in got.dtypes if c != "ends_sha256"} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == brute(rows)


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for c in [*range(-12, 60), 10**15, 2**63 - 1, -(2**63)]:
        for t in range(rng.choice([0, 1, 2, 3, 4, 5, 8, 9, 12, 13])):
            text = rng.choice(["a", "b", "é", None, ""]) if rng.random() < 0.3 else f"t{t}"
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]) if rng.random() < 0.1 else "user", text))
    rows += rows[:5]  # repeated rows
    rows += [(None, 0, "user", "no id")]
    check(spark, rows)


def test_copies_long_and_deep_branches(spark):
    rows = [(c, t, "user", f"{t}" * 50) for c in range(1000, 1100) for t in range(3)]  # copies
    rows += [(7, t, "user", str(t)) for t in range(300)]
    rows += [(c, t, "user", str(t) if t < c - 20 else f"own {c}") for c in range(25, 60, 5) for t in range(c - 19)]  # a branch at each depth
    rows += [(100, 0, "user", "x" * 300_000), (105, 0, "user", "x" * 299_999 + "y")]  # alike but for the end
    rows += [(110, 3, "user", "x" * 70 + "b"), (110, 3, "user", "c"), (110, 3, "assistant", "z")]  # ties
    check(spark, rows)


def test_empty_and_without_forks(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert trie.prefix_trie(empty, trie.Forks()).count() == 0
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "user", "c")]
    table = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)
    got = {(r.conv_id, r.depth): r for r in trie.prefix_trie(table).collect()}
    assert set(got) == {(1, 0), (1, 1), (1, 2), (3, 2)}
    assert (got[1, 1].n_convs, got[1, 1].n_children, got[1, 1].n_leaves, got[1, 1].saved_tokens) == (3, 2, 2, 2)
    assert got[1, 1].ends_sha256 == hashlib.sha256(b"2").hexdigest() and got[3, 2].parent_conv_id == 1
