"""Structure repair against a search over all edits, whole rows against a plain model."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from plumbline.llm import repair

LAW = re.compile(r"(s?(ua)+)?")


def cheapest(symbols):
    """(cost, audit, made) by a best-first search over edit sequences; audits of one cost come in ASCII order."""
    heap, seen = [(0, "", 0, "", "")], set()
    while heap:
        cost, audit, i, roles, made = heapq.heappop(heap)
        if i == len(symbols) and LAW.fullmatch(roles):
            return cost, audit, made
        state = (i, roles[-1:])
        if (state, cost, audit) in seen:
            continue
        seen.add((state, cost, audit))
        grown = [("I", 2, i, r) for r in "ua"]
        if i < len(symbols):
            initial, mark = symbols[i]
            grown.append(("D", 3, i + 1, ""))
            if mark != "d":
                grown += [("K", mark == "t", i + 1, initial), *(("R", 2 + (mark == "t"), i + 1, r) for r in "ua")]
        for letter, price, j, role in grown:
            if cost + price <= 3 * len(symbols) and (not role or re.fullmatch(r"s?(ua)*u?", roles + role)):
                heapq.heappush(heap, (cost + price, audit + letter, j, roles + role, made + ("" if letter == "D" else role)))
    raise AssertionError("no repair")


@pytest.mark.parametrize("size", [0, 1, 2, 3])
def test_all_short(size):
    for symbols in itertools.product(repair.SYMBOLS, repeat=size):
        held(list(symbols))


def held(symbols):
    cost, audit, _ = cheapest(symbols)
    found, state = repair.edits(symbols)
    assert "".join(x for x, _ in found) == audit, symbols
    assert state in (0, 3) and repair.costs(repair.runs(symbols), repair.CLOSE)[0][0] == cost


def test_random_runs():
    draw = random.Random(5)
    for _ in range(60):
        held([s for _ in range(draw.randint(1, 3)) for s in [draw.choice(repair.SYMBOLS)] * draw.randint(1, 4)][:8])


def test_long_run_is_its_chunks():
    symbols = ["u."] * 1000 + ["at"] * 777 + ["xd"] * 130 + ["s."] * 5
    whole, _ = repair.edits(symbols)
    vector, state, got = repair.CLOSE, 0, []
    cuts = [0, 13, 900, 1500, 1800, len(symbols)]
    ends = [vector]
    for lo, hi in zip(cuts[-2:0:-1], cuts[:1:-1], strict=True):
        vector = repair.apply(repair.product(repair.runs(symbols[lo:hi])), vector)
        ends.append(vector)
    for (lo, hi), end in zip(itertools.pairwise(cuts), ends[::-1], strict=True):
        part, state = repair.edits(symbols[lo:hi], state, None if hi == cuts[-1] else end)
        got += part
    assert got == whole


def model(rows):
    """The contract's rows, one conversation at a time, in plain Python."""
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if d == 0:
            continue
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        convs[conv] += [(turn is not None, turn or 0, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    out = []
    for conv, kept in convs.items():
        kept, seen, symbols, count = sorted(kept), set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, _, role, text in kept:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                count[fault] += 1
            symbols.append("xd" if fault in ("blank", "duplicate") else (role[:1] if role[:1] in tuple("sua") else "x") + ("t" if fault else "."))
        turns = [t for ok, t, *_ in kept if ok]
        found, _ = repair.edits(symbols)
        lines = [("user" if m == "u" else "assistant" if m == "a" else role) + ":" + ("" if x == "I" else text) for (letters, made), (_, _, role, text) in zip(found, kept, strict=True) for x, m in zip(letters, made, strict=True) if x != "D"]
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(kept))
        cost = repair.costs(repair.runs(symbols), repair.CLOSE)[0][0]
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *count.values(), illegal, cost, "".join(x for x, _ in found), hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


NAMES = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def answer(df):
    return sorted((tuple(r[n] for n in NAMES) for r in df.collect()), key=repr)


def test_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert answer(repair.op13_repair(spark, sf)) == model(rows)


def test_edges(spark):
    """Nulls, ties, repeats, other roles, a conversation that vanishes and one that fills several ranges."""
    draw = random.Random(1)
    rows = [(c, t, draw.choice(["user", "assistant", "system", "tool", "", None, "Sys"]), draw.choice(["A.", "b", "", None, " \t", "C! ", "d?\n", " ", "long " * 3000])) for c in [None, 1, 2, 3] for t in [None, None, 0, 1, 1, 2, 9, *range(20, 40)]]
    gone = next(c for c in range(10, 999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows += [(gone, 0, "user", "x")] + [(5, t // 2, draw.choice(["user", "assistant", "user", "system"]), f"{t % 700}" + draw.choice([".", ""])) for t in range(1500)]
    schema = "conv_id long, turn long, role string, text string, at string, part string"
    table = spark.createDataFrame([(*r, "clash", None) for r in rows], schema)
    assert answer(repair.report(repair.damaged(table), table)) == model(rows)
    assert repair.report(repair.damaged(table.limit(0)), table.limit(0)).collect() == []
