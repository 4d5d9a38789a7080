import hashlib
import random
import zlib
from collections import defaultdict
from itertools import product

from pyspark.sql import functions as F

from veilspark.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, gone string, cost int, _fault int"


def cheapest_by_trial(turns: list[tuple[str, bool, bool]]) -> tuple[int, str]:
    """Cost and audit of the cheapest repair of a few turns (initial, must go, truncated) by trying all edits."""

    def fits(roles: str) -> bool:
        rest = roles[1:] if roles[:1] == "s" else roles
        return roles == "" or (rest != "" and len(rest) % 2 == 0 and rest == "ua" * (len(rest) // 2))

    found = []
    gaps = ["", "u", "a", "ua", "au"]
    for edits in product(*([*("D" if go else "DKua")] for _, go, _ in turns)):
        for added in product(gaps, repeat=len(turns) + 1):
            roles, audit, cost = added[0], "I" * len(added[0]), repair.INSERT * len(added[0])
            for (initial, _, short), edit, more in zip(turns, edits, added[1:], strict=True):
                roles += "" if edit == "D" else initial or "?" if edit == "K" else edit
                audit += edit if edit in "DK" else "R"
                cost += (repair.DELETE if edit == "D" else (repair.KEEP if edit == "K" else repair.REROLE) + repair.CUT_SHORT * short) + repair.INSERT * len(more)
                roles, audit = roles + more, audit + "I" * len(more)
            if fits(roles):
                found.append((cost, audit))
    return min(found)


def test_against_all_edits():
    rng, parser = random.Random(5), repair.Parser()
    for size in (0, 1, 2, 3):
        for _ in range({0: 1, 1: 20, 2: 40, 3: 25}[size]):
            turns = [(rng.choice(["s", "u", "u", "a", "a", "t", ""]), rng.random() < 0.25, rng.random() < 0.3) for _ in range(size)]
            one = repair.Repair(parser)
            for initial, go, short in turns:
                one.read(initial, b"x", initial.encode(), go, short)
            assert one.result()[:2] == cheapest_by_trial(turns), turns


def by_states(turns):
    """The cheapest (cost, audit, repaired) by a table over the four places of the grammar."""
    go_on = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    names = {"u": "user", "a": "assistant"}

    def insert(best):
        for _ in range(2):
            for state in list(best):
                cost, audit, rows = best[state]
                for symbol, goal in go_on[state].items():
                    if symbol in names:
                        new = (cost + 2, audit + "I", (*rows, names[symbol] + ":"))
                        best[goal] = min(best.get(goal, new), new)
        return best

    best = insert({0: (0, "", ())})
    for role, text, fault in turns:
        new = defaultdict(list)
        for state, (cost, audit, rows) in best.items():
            new[state].append((cost + 3, audit + "D", rows))
            if fault not in (1, 2):
                extra = cost + (fault == 3)
                if role[:1] in go_on[state]:
                    new[go_on[state][role[:1]]].append((extra, audit + "K", (*rows, f"{role}:{text}")))
                for symbol in set(names) & set(go_on[state]):
                    new[go_on[state][symbol]].append((extra + 2, audit + "R", (*rows, f"{names[symbol]}:{text}")))
        best = insert({state: min(found) for state, found in new.items()})
    return min(best[state] for state in (0, 3) if state in best)


def expected(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
        convs[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, counts, turns = set(), [0] * 4, []
        for _, role, text in own:
            bare = text.rstrip(repair.SPACES)
            fault = 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0
            seen.add((role, text))
            counts[fault] += 1
            turns.append((role, text, fault))
        numbers = {t for t, _, _ in own if t is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, repaired = by_states(turns)
        out[conv] = (gaps, *counts[1:], illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest())
    return out


def run(spark, rows):
    table = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    return {r[0]: tuple(r[1:]) for r in repair.repair_conversations(repair.damaged(table)).collect()}


def test_rows(spark):
    rng, rows = random.Random(9), []
    texts = ["One. ", "Two!", "three", "", " \t\n", "Who? \r\n", "a.b", "é?", None]
    for conv in [None, *range(-5, 150)]:
        for turn in range(rng.randrange(0, 9)):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            role = rng.choice(["system", "tool", "", None, "s"]) if rng.random() < 0.1 else role
            number = rng.choice([None, turn, turn * 3]) if rng.random() < 0.2 else turn
            rows.append((conv, number, role, rng.choice(texts) if rng.random() < 0.5 else f"text {rng.random()}."))
    rows += rows[::7] + [(999, t, "user", None) for t in (None, 4)]
    rows += [(998, t, "user", "x.") for t in (-(2**63), 5)]
    want = expected(rows)
    want[998] = (want[998][0] - 2**64, *want[998][1:])  # wraps as 64-bit numbers do
    assert run(spark, rows) == want
    gone = next(i for i in range(1000) if zlib.crc32(f"5000:{i}".encode()) % 20 == 0)
    assert run(spark, [(5000, gone, "user", "x.")]) == {5000: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert run(spark, []) == {}


def test_a_long_conversation(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"{t}" if t % 11 == 0 else f"{t}.") for t in range(3000)] + [(2, 0, "user", "y" * 3_000_000)]
    assert run(spark, rows) == expected(rows)


def test_one_exchange(spark):
    table = spark.createDataFrame([], SCHEMA)
    plan = repair.repair_conversations(repair.damaged(table.repartition(3)))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1
    assert plan.groupBy().agg(F.count("*")).first()[0] == 0
