"""Repairs against every edit script of short conversations, and against a table of all nodes for long ones."""

import hashlib
import random
import re
import zlib
from itertools import groupby, product

from corpusloom.llm import conversations as M

TURNS = "conv_id long, turn long, role string, text string"


def order(r):
    turn, role, text = r
    return (turn is not None, turn or 0, role.encode(), text.encode())


def faults(rows):
    out = []
    for i, (_, role, text) in enumerate(rows):
        marks = re.findall(r"[^\x20\x09-\x0D]", text)
        if not marks:
            out.append("blank")
        elif any(r[1:] == (role, text) for r in rows[:i]):
            out.append("duplicate")
        else:
            out.append("" if marks[-1] in ".!?" else "truncated")
    return out


def counts(rows):
    turns, f = [r[0] for r in rows if r[0] is not None], faults(rows)
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, f.count("blank"), f.count("duplicate"), f.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs)


def every_script(rows, most=3):
    """The cheapest (cost, audit, repaired) of all scripts with up to ``most`` insertions in each gap."""
    f, best = faults(rows), None
    inserts = ["".join(p) for n in range(most + 1) for p in product("ua", repeat=n)]
    choices = [["D"] if f[i] in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for i in range(len(rows))]
    for script in product(*choices):
        for gaps in product(inserts, repeat=len(rows) + 1):
            cost, audit, turns = 0, "", []
            for i in range(len(rows) + 1):
                for c in gaps[i]:
                    cost, audit = cost + 5, audit + "I"
                    turns.append(({"u": "user", "a": "assistant"}[c], ""))
                if i < len(rows):
                    how = script[i]
                    cost += {"D": 2, "K": 0, "Ru": 1, "Ra": 1}[how] + (5 if how != "D" and f[i] == "truncated" else 0)
                    audit += how[0]
                    if how != "D":
                        turns.append(({"K": rows[i][1], "Ru": "user", "Ra": "assistant"}[how], rows[i][2]))
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in turns)) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, "\n".join(f"{r}:{t}" for r, t in turns)
    return best


def by_table(rows):
    """The same by a table over (row, state), each entry the least (cost, audit, repaired) of its ways."""
    f = faults(rows)
    follow = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    full = {"u": "user", "a": "assistant"}

    def inserted(layer):
        for _ in range(4):
            for state, (cost, audit, turns) in list(layer.items()):
                for c in "ua":
                    if (state, c) in follow:
                        new = (cost + 5, audit + "I", (turns, full[c] + ":"))
                        if c not in layer or new[:2] < layer[c][:2]:
                            layer[c] = new
        return layer

    layer = inserted({"": (0, "", None)})
    for (_, role, text), fault in zip(rows, f):
        new = {}
        for state, (cost, audit, turns) in layer.items():
            ways = [(state, cost + 2, "D", turns)]
            if fault in ("", "truncated"):
                more = cost + (5 if fault else 0)
                if (state, role[:1]) in follow:
                    ways.append((role[:1], more, "K", (turns, f"{role}:{text}")))
                ways += [(c, more + 1, "R", (turns, f"{full[c]}:{text}")) for c in "ua" if (state, c) in follow]
            for to, c, letter, t in ways:
                if to not in new or (c, audit + letter) < new[to][:2]:
                    new[to] = (c, audit + letter, t)
        layer = inserted(new)
    cost, audit, turns = min((layer[s] for s in ("", "a") if s in layer), key=lambda x: x[:2])
    out = []
    while turns:
        turns, piece = turns
        out.append(piece)
    return cost, audit, "\n".join(out[::-1])


def repaired(rows):
    out = []
    conv = M.Conversation(1, lambda _, t: out.append(t))
    for r in rows:
        conv.add(*r)
    *numbers, cost, audit = conv.end()
    return tuple(numbers), (cost, audit, "\n".join(f"{r}:{t}" for e, r, t in out if e != "D")), "".join(t[0] for t in out)


def some_rows(rng, n):
    texts = ["One. ", "Two!", "Three?\n", "no end", "", " \t\v", "same.", "same.", "é…", "x. "]
    return sorted(((rng.choice([None, *range(n)]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", "anyone"]), rng.choice(texts) + rng.choice(["", "", str(rng.randint(0, 3)) + "."])) for _ in range(n)), key=order)


def test_every_script():
    rng = random.Random(1)
    for n in (0, 1, 2, 3):
        for _ in range(25 if n < 3 else 5):
            rows = some_rows(rng, n)
            want = every_script(rows, 2 if n == 3 else 3)
            assert by_table(rows) == want
            assert repaired(rows) == (counts(rows), want, want[1])


def test_blocks_change_nothing(monkeypatch):
    rng = random.Random(2)
    for block in (1, 2, 5, 64):
        monkeypatch.setattr(M, "BLOCK_ROWS", block)
        for _ in range(60):
            rows = some_rows(rng, rng.randint(0, 40))
            want = by_table(rows)
            assert repaired(rows) == (counts(rows), want, want[1])


def test_long_conversation_is_not_held():
    """Ways soon agree: what is kept at a time stays small."""
    most, out = 0, []
    conv = M.Conversation(1, lambda _, t: out.append(t))
    for i in range(20_000):
        conv.add(i, "user" if i % 2 == 0 or i % 17 == 0 else "assistant", f"turn {i}" + ("." if i % 13 else ""))
        most = max(most, *(len(w[2]) for w in conv.ways.values()))
    conv.end()
    assert most < 200 and len(out) >= 20_000


def by_hand(rows):
    """Expected result rows from input rows (conv_id, turn, role, text), damage included."""
    out = []
    for conv_id, group in groupby(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), key=lambda r: r[0]):
        left = []
        for _, turn, role, text in group:
            role, text = " " if role is None else role, " " if text is None else text
            k = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            left += [(turn, "user" if k == 4 else role, text)] * {0: 0, 3: 2}.get(k, 1)
        left.sort(key=order)
        cost, audit, text = by_table(left)
        out.append((conv_id, *counts(left), cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def held(spark, rows, schema=TURNS + ", copies int, gaps string", extra=(9, "x")):
    df = spark.createDataFrame([(*r, *extra) for r in rows], schema)
    got = sorted((tuple(r) for r in M.conversation_repairs(M.damaged(df), M.F.col("copies")).collect()), key=str)
    assert got == by_hand(rows)
    return got


def test_query_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(c, turn, rng.choice([None, role]) if rng.random() < 0.1 else role, rng.choice([None, text]) if rng.random() < 0.1 else text) for c in [None, *range(200)] for turn, role, text in some_rows(rng, rng.randint(1, 9))]
    rows += rows[:40]
    got = held(spark, rows)
    assert any(r[7] == "" for r in got) and any(len(r[7]) > 9 for r in got)


def test_edge_cases(spark):
    held(spark, [(1, None, None, None), (2, 5, "user", "x." * 800_000), (2, 6, "assistant", "y" * 1_500_000), (3, 0, "user", "a.\r\n"), (3, 0, "user", "a.\r\n")])
    assert M.conversation_repairs(spark.createDataFrame([], TURNS)).count() == 0
    far = spark.createDataFrame([(1, -(2**63), "user", "a."), (1, 2**63 - 1, "assistant", "b.")], TURNS)
    assert M.conversation_repairs(far).first().gaps == 2**63 - 1


def test_turns(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "There."), (1, 2, "assistant", " "), (2, 0, "assistant", "Lone.")], TURNS)
    got = sorted(map(tuple, M.repaired_turns(df).collect()))
    assert got == [(1, 0, "K", "user", "Hi."), (1, 1, "R", "assistant", "There."), (1, 2, "D", "assistant", " "), (2, 0, "D", "assistant", "Lone.")]
