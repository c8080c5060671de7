import hashlib
import itertools
import random
import re
import zlib

import pytest
from helpers import clashing

from claimspark.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string"
SHAPE = re.compile(r"(s?(ua)+)?")
COLUMNS = ["conv_id", *conversations.SUMMARY.names]


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        sp = lambda x: " " if x is None else str(x)
        way, role, text = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20, sp(role), sp(text)
        if way == 0:
            continue
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        out += [(conv, turn, "user" if way == 4 else role, text)] * (2 if way == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        body = text.strip(" \t\n\x0b\f\r")
        out.append(1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def cheapest(rows, marks):
    """(cost, audit, repaired) by trying every sequence of edits in order of cost, then of letters."""
    roles = {"u": "user", "a": "assistant"}
    best = None

    def go(i, audit, cost, made):
        nonlocal best
        if best is not None and (cost, audit) >= best[:2] and cost >= best[0]:
            return
        shape = "".join(r[:1] for r, _ in made)
        if i == len(rows) and SHAPE.fullmatch(shape) and (best is None or (cost, audit) < best[:2]):
            best = cost, audit, list(made)
        if not any(SHAPE.fullmatch(shape + t) for t in ("", "a", "ua")):
            return
        if audit[-2:] != "II":
            for c in "ua":
                go(i, audit + "I", cost + 2, [*made, (roles[c], "")])
        if i < len(rows):
            _, _, role, text = rows[i]
            go(i + 1, audit + "D", cost + 3, made)
            if marks[i] not in (1, 2):
                extra = marks[i] == 3
                if role[:1] in ("s", "u", "a"):
                    go(i + 1, audit + "K", cost + extra, [*made, (role, text)])
                for c in "ua":
                    go(i + 1, audit + "R", cost + 2 + extra, [*made, (roles[c], text)])

    go(0, "", 0, [])
    return best


def brute(rows, damaged=True):
    out = []
    after = damage(rows) if damaged else [tuple(" " if x is None and k > 1 else x for k, x in enumerate(r)) for r in rows]
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        marks, turns = faults(mine), {r[1] for r in mine if r[1] is not None}
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        cost, audit, made = cheapest(mine, marks)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, marks.count(1), marks.count(2), marks.count(3), illegal, cost, audit, sha))
    return sorted(out, key=str)


def cases(n=150, seed=5):
    r, rows = random.Random(seed), []
    for conv in range(n):
        for _ in range(r.randint(1, 5)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "User", "", None])
            rows.append((conv, r.choice([None, *range(8)]), role, r.choice(["Ok.", "yes!", "no", "é?", " \t", None, "", "fine. \n"])))
    return [*rows, (None, 0, "user", "hi."), (None, None, None, None), *[(900, t, "user" if t % 2 == 0 else "assistant", f"t{t}.") for t in range(6)]]


def collected(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


@pytest.mark.parametrize("damaged", [True, False])
def test_against_brute_force(spark, damaged):
    rows = cases()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    df = conversations.damaged(df) if damaged else df
    assert collected(conversations.summaries(df)) == brute(rows, damaged)


def test_giant_conversations_give_the_same(spark):
    """No texts held and tiny blocks: the three passes give what one does."""
    r = random.Random(3)
    rows = [*cases(30, 8), *[(5000, t // 2, r.choice(["user", "assistant", "x", "system"]), r.choice(["a.", "b", f"c{t}.", ""])) for t in range(3000)]]
    df = conversations.damaged(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert collected(conversations.summaries(df, held_bytes=0, block_rows=2)) == collected(conversations.summaries(df))


def test_repaired_rows(spark):
    rows = cases(60, 9)
    df = conversations.damaged(clashing(spark.createDataFrame(rows, SCHEMA)))
    edits = conversations.summaries(df)
    made = {}
    for x in sorted(conversations.repaired(df, edits).collect(), key=lambda x: (str(x["conv_id"]), x["position"])):
        made.setdefault(x["conv_id"], []).append((x["role"], x["text"], x["edit"]))
    for conv, *_, audit, sha in brute(rows):
        mine = made.get(conv, [])
        assert hashlib.sha256("\n".join(f"{a}:{b}" for a, b, _ in mine).encode()).hexdigest() == sha
        assert "".join(e for *_, e in mine) == audit.replace("D", "")


def test_a_state_given_up_never_wins():
    """Costs with and without the bound, over random rows."""
    r = random.Random(2)
    for _ in range(200):
        kinds = [(r.choice(["s", "u", "a", ""]), r.random() < 0.3, r.random() < 0.3) for _ in range(40)]
        full, best = [0, None, None, None], None
        for k in kinds:
            full = [min((full[b] + c for b, c, _ in ways if full[b] is not None), default=None) for ways in conversations._moves(*k)]
        costs, ranks, total = (0, conversations.FAR, conversations.FAR, conversations.FAR), (0, 4, 4, 4), 0
        for k in kinds:
            costs, ranks, more, _ = conversations._step(costs, ranks, *k)
            total += more
        best = min(c + x for c, x in zip(full, (0, 4, 2, 0), strict=True) if c is not None)
        assert total + conversations._last(costs, ranks)[0] == best


def test_empty(spark):
    assert conversations.summaries(conversations.damaged(spark.createDataFrame([], SCHEMA))).count() == 0
