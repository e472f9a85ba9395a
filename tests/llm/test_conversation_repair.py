"""Conversation repair against a search over all edit sequences."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest
from tessellar.llm import conversation_repair as cr

SPACE = " \t\n\x0b\x0c\r"
RULE = re.compile(r"(s?(ua)+)?")


def damage(rows):
    out = defaultdict(list)
    for c, t, r, x in rows:
        out[c]
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if k == 0:
            continue
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        out[c] += [(t, "user" if k == 4 else r, x)] * (2 if k == 3 else 1)
    for c in out:
        out[c].sort(key=lambda y: (y[0] is not None, y[0] or 0, y[1], hashlib.md5(y[2].encode()).digest()))
    return out


def faults(turns):
    seen, out = set(), []
    for _, r, x in turns:
        out.append("blank" if not x.strip(SPACE) else "duplicate" if (r, x) in seen else "truncated" if x.strip(SPACE)[-1] not in ".!?" else None)
        seen.add((r, x))
    return out


def search(turns):
    """Uniform-cost search over edit strings, the roles checked by the rule itself on every prefix that can still grow."""
    marks = faults(turns)
    alive = re.compile(r"s?(ua)*u?")
    heap, closed = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, lines = heapq.heappop(heap)
        if i == len(turns) and RULE.fullmatch(roles):
            return cost, audit, lines
        tail = roles[-1:]
        if (i, tail) in closed:
            continue
        closed.add((i, tail))
        moves = [(2, "I", i, "u", ("user:",)), (2, "I", i, "a", ("assistant:",))]
        if i < len(turns):
            _, r, x = turns[i]
            moves.append((3, "D", i + 1, "", ()))
            if marks[i] not in ("blank", "duplicate"):
                late = marks[i] == "truncated"
                if r:
                    moves.append((late, "K", i + 1, r[0], (f"{r}:{x}",)))
                moves += [(2 + late, "R", i + 1, n[0], (f"{n}:{x}",)) for n in ("user", "assistant")]
        for c, e, j, r, line in moves:
            if alive.fullmatch(roles + r):
                grown = roles + r
                if len(grown) > 8:  # whole pairs may go
                    grown = grown[-3:] if grown[-1] == "u" else grown[-2:]
                heapq.heappush(heap, (cost + c, audit + e, j, grown, lines + line))


def plain(rows):
    out = []
    for c, turns in damage(rows).items():
        marks, known = faults(turns), [t for t, _, _ in turns if t is not None]
        cost, audit, lines = search(turns)
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        out.append((c, gaps, *[marks.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id bigint, turn bigint, role string, text string, kind int, audit string, h int"


def rows_of(seed, n_conversations=60, most=7):
    rng, rows = random.Random(seed), []
    for c in range(n_conversations):
        for _ in range(rng.randint(1, most)):
            turn = rng.choice([None, *range(9)])
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None, "User"])
            text = rng.choice(["Yes.", "No!", "cut off", "", " \t", None, "Why?\n", "…", "Yes.", f"own {rng.random()}."])
            rows.append((None if c == 5 else c, turn, role, text))
    return rows + rows[:9]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_search(spark, seed):
    rows = rows_of(seed)
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    out = cr.report(df)
    assert out.columns == COLUMNS
    assert sorted(map(tuple, out.collect()), key=str) == plain(rows)


def test_long_conversation_over_many_ranges(spark, monkeypatch):
    """One conversation crosses all ranges; partial results meet in several rounds."""
    rng = random.Random(3)
    rows = [(7, t, rng.choice(["user", "assistant", "assistant"]), rng.choice([f"t{t}.", f"t{t}", "Again."])) for t in range(600)]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"{c} {t}.") for c in (1, 9) for t in range(3)]
    monkeypatch.setattr(cr, "FAN_IN", 2)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(map(tuple, cr.report(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == plain(rows)


def test_repaired_rows(spark):
    rows = rows_of(4, 20)
    turns = cr.damaged(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    found = defaultdict(list)
    for r in cr.repair(turns).orderBy("conv_id", "position").collect():
        found[r.conv_id].append((r.role, r.text, r.edit))
    for c, lines in found.items():
        assert RULE.fullmatch("".join(r[:1] for r, _, _ in lines))
    digests = {c: hashlib.sha256("\n".join(f"{r}:{x}" for r, x, _ in lines).encode()).hexdigest() for c, lines in found.items()}
    assert all(digests.get(row[0], hashlib.sha256(b"").hexdigest()) == row[-1] for row in plain(rows))


def test_fold_is_associative():
    rng = random.Random(5)
    turns = [rng.choice(list(cr.TURNS.values())) for _ in range(40)]
    left = cr.ONE
    for m in turns:
        left = cr.product(left, m)
    fold = cr.Fold()
    for m in turns:
        fold.add(m)
    assert fold.result() == left


def test_empty(spark):
    assert cr.report(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0
