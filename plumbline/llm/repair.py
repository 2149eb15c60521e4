"""Conversation structure repair: the cheapest edits that make role initials read ``(s?(ua)+)?``.

A row is a symbol: its role initial and its fault.  States say what the repaired
roles so far end with: nothing, a system row, a user row, an assistant row.  A
symbol's transition is a 4 x 4 matrix of costs under (min, +); equal neighbours
are one run, which is advanced through cached binary powers of its matrix.  Costs
go from the end to the start; then the edits are unrolled from the start, halving
runs, and at every step the least letter of D, I, K and R that keeps the cost is
taken.  Comparing letters from the left this way gives the ASCII-least audit, and
an audit names one repair: what Insert and Rerole make follows from the state.

Distribution: rows are dealt by ranges of (conv_id, turn, role, text), so a long
conversation is cut into chunks of neighbouring rows.  A chunk's product of
matrices gives the cost vectors at the ends of the chunks before it; its edits are
unrolled for each of the four states it may begin in, and the right one is picked.
Only conversations that lie in several ranges need this; their chunks number at
most twice the partitions, so the driver may hold their matrices.

Nulls in role or text are one space; a null conv_id is a conversation of its own.
Null turns come first; rows of one turn follow by role, then text, so equal rows
stand together.  Texts are taken whole.  Only conv_id, turn, role and text are
read, so other columns cannot clash.  Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

FAR = 1 << 60
#: Costs of the edits; an undeleted truncated row adds one.
INSERT, REROLE, DELETE, CUT = 2, 2, 3, 1
#: States: nothing yet, after s, after u, after a.  Where Insert and Rerole lead, and what they make.
NEXT, MADE = (2, 2, 3, 2), "uuau"
KEEP = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None), "x": (None,) * 4}
#: Cost of closing a conversation in each state.
CLOSE = (0, 4, 2, 0)
#: Symbols: role initial (x: another), then whether the row may stay (.), is truncated (t) or has to go (d).
SYMBOLS = [a + b for a in "suax" for b in ".t"] + ["xd"]

Vector = tuple[int, int, int, int]
Matrix = tuple[Vector, Vector, Vector, Vector]

#: Cheapest insertions from state to state.
_GROW: Matrix = ((0, FAR, 2, 4), (FAR, 0, 2, 4), (FAR, FAR, 0, 2), (FAR, FAR, 2, 0))


def _consume(symbol: str, state: int) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits of one row, in ASCII order."""
    yield "D", DELETE, state
    if symbol[1] == "d":
        return
    cut = CUT * (symbol[1] == "t")
    if (kept := KEEP[symbol[0]][state]) is not None:
        yield "K", cut, kept
    yield "R", REROLE + cut, NEXT[state]


def times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(min(x + b[k][j] for k, x in enumerate(row)), FAR) for j in range(4)) for row in a)


def apply(m: Matrix, v: Vector) -> Vector:
    return tuple(min(min(x + y for x, y in zip(row, v, strict=True)), FAR) for row in m)


@lru_cache(maxsize=None)
def power(symbol: str, bit: int) -> Matrix:
    """The transition of 2 to the ``bit`` rows of one symbol."""
    if bit:
        return times(power(symbol, bit - 1), power(symbol, bit - 1))
    out = [[FAR] * 4 for _ in range(4)]
    for i in range(4):
        for k in range(4):
            for _, cost, j in _consume(symbol, k):
                out[i][j] = min(out[i][j], _GROW[i][k] + cost)
    return tuple(map(tuple, out))


def bits(n: int) -> list[int]:
    return [b for b in range(n.bit_length()) if n >> b & 1]


def runs(symbols: list[str]) -> list[tuple[str, int]]:
    return [(s, len(list(g))) for s, g in groupby(symbols)]


def product(rows: list[tuple[str, int]]) -> Matrix:
    """The transition of all runs, one after the other."""
    out: Matrix = ((0, FAR, FAR, FAR), (FAR, 0, FAR, FAR), (FAR, FAR, 0, FAR), (FAR, FAR, FAR, 0))
    for symbol, n in rows:
        for b in bits(n):
            out = times(out, power(symbol, b))
    return out


def costs(rows: list[tuple[str, int]], end: Vector) -> list[Vector]:
    """Cost vectors before every run, and ``end``."""
    out = [end]
    for symbol, n in reversed(rows):
        v = out[-1]
        for b in bits(n):
            v = apply(power(symbol, b), v)
        out.append(v)
    return out[::-1]


def _one(symbol: str, state: int, end: Vector) -> tuple[str, str, int]:
    """(letters, made roles, next state) of one row: what Insert makes goes before the row's own letter."""
    letters = made = ""
    now = apply(power(symbol, 0), end)
    while True:
        here = {letter: (cost, after) for letter, cost, after in _consume(symbol, state)}
        here["I"] = (INSERT, NEXT[state])
        for letter in "DIKR":
            if letter not in here:
                continue
            cost, after = here[letter]
            if cost + (now if letter == "I" else end)[after] == now[state]:
                break
        made += MADE[state] if letter in "IR" else "-"
        letters, state = letters + letter, after
        if letter != "I":
            return letters, made, state


def unroll(symbol: str, n: int, state: int, end: Vector, out: list[tuple[str, str]]) -> int:
    """Append the edits of a run of ``n`` rows to ``out``; the state after it."""
    if n == 1:
        letters, made, state = _one(symbol, state, end)
        out.append((letters, made))
        return state
    half = 1 << (n - 1).bit_length() - 1
    middle = end
    for b in bits(n - half):
        middle = apply(power(symbol, b), middle)
    state = unroll(symbol, half, state, middle, out)
    return unroll(symbol, n - half, state, end, out)


def edits(symbols: list[str], state: int = 0, end: Vector | None = None) -> tuple[list[tuple[str, str]], int]:
    """((letters, made roles) of every row, the state after them); with no ``end`` the last row's edits close the conversation."""
    rows, out = runs(symbols), []
    before = costs(rows, end or CLOSE)
    for (symbol, n), after in zip(rows, before[1:], strict=True):
        state = unroll(symbol, n, state, after, out)
    while end is None and out and state not in (0, 3):
        letters, made = out[-1]
        out[-1] = (letters + "I", made + MADE[state])
        state = NEXT[state]
    return out, state


def _sorted_by(df: DataFrame, key: list[Column | str]) -> DataFrame:
    return df.repartition(*key).sortWithinPartitions("at")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that the checksum of ``conv_id:turn`` decides."""
    space = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("_d")).filter("_d <> 0")
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("_d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("_d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


#: White space of the contract: the blank and the controls from tab to carriage return.
SPACE = r"\x20\x09-\x0D"


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) written in order: at grows over the whole table, part is its range."""
    row = F.monotonically_increasing_id()
    order = ["conv_id", "turn", "role", "text", "row"]
    dealt = rows.withColumn("row", row).repartitionByRange(shared.partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    last = F.regexp_extract("text", rf"([^{SPACE}])[{SPACE}]*\z", 1)
    table = dealt.select("conv_id", "turn", "role", "text", blank.alias("blank"), (~last.isin(".", "!", "?")).alias("cut"), F.monotonically_increasing_id().alias("at"))
    return shared.written(table.withColumn("part", F.shiftright("at", 33).cast("int")), "repair-rows")


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, at, part, turn, initial and fault of ``numbered`` rows; the first row of equal ones is found by aggregation, marked by a join on its number."""
    first = rows.groupBy("conv_id", "role", F.sha2("text", 256)).agg(F.min("at").alias("at")).select("at", F.lit(True).alias("_first"))
    fault = F.when(F.col("blank"), "blank").when(F.col("_first").isNull(), "duplicate").when(F.col("cut"), "truncated")
    light = rows.select("conv_id", "at", "part", "turn", F.substring("role", 1, 1).alias("initial"), "blank", "cut")
    return light.join(first, "at", "left").select("conv_id", "at", "part", "turn", "initial", fault.alias("fault"))


def _symbol(initial: str, fault: str | None) -> str:
    if fault in ("blank", "duplicate"):
        return "xd"
    return (initial if initial in "sua" and initial else "x") + ("t" if fault else ".")


def _chunks(batches: Iterator[pa.RecordBatch], extra: tuple[str, ...] = ()) -> Iterator[tuple[tuple, list[int], list[str], list[str]]]:
    """(key, ats, initials, symbols) of every chunk of rows that come sorted by at."""
    key, ats, initials, symbols = None, [], [], []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "part", *extra)]
        rows = zip(zip(*columns, strict=True), *(batch.column(c).to_pylist() for c in ("at", "initial", "fault")), strict=True)
        for k, at, initial, fault in rows:
            # A task may hold several ranges; at and the key grow together.
            if ats and k[:2] != key[:2]:
                yield key, ats, initials, symbols
                ats, initials, symbols = [], [], []
            key = k
            ats.append(at)
            initials.append(initial)
            symbols.append(_symbol(initial, fault))
    if ats:
        yield key, ats, initials, symbols


def _spanning(table: DataFrame) -> tuple[DataFrame, dict]:
    """The (conv_id, part) of conversations in several ranges, and those ranges by conversation: two for each partition at most."""
    ranges = table.groupBy("conv_id").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo < hi")
    rows = [(r.conv_id, p) for r in ranges.collect() for p in range(r.lo, r.hi + 1)]
    return table.sparkSession.createDataFrame(rows, "conv_id long, part int"), {c: sorted(p for q, p in rows if q == c) for c in {c for c, _ in rows}}


def row_edits(table: DataFrame) -> DataFrame:
    """conv_id, at, letters, made, cost and illegal (against the row before) of every row of ``faults``."""
    spark = table.sparkSession
    pairs, ranges = _spanning(table)
    key = lambda a, b: F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id")) & (F.col(f"{a}.part") == F.col(f"{b}.part"))

    def measure(batches):
        for (conv, part), _, initials, symbols in _chunks(batches):
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "part": part, "first": initials[0], "last": initials[-1], "m": [x for row in product(runs(symbols)) for x in row]}], pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("first", pa.string()), ("last", pa.string()), ("m", pa.list_(pa.int64()))]))

    known: dict = {}
    if ranges:
        chunks = table.alias("t").join(F.broadcast(pairs).alias("p"), key("t", "p"), "left_semi")
        for r in _sorted_by(chunks, ["conv_id", "part"]).mapInArrow(measure, "conv_id long, part int, first string, last string, m array<long>").collect():
            known[r.conv_id, r.part] = (r.first, r.last, tuple(tuple(r.m[i : i + 4]) for i in range(0, 16, 4)))
    ends = []
    for conv, parts in ranges.items():
        parts, vector, final = [p for p in parts if (conv, p) in known], CLOSE, True
        for i in range(len(parts) - 1, -1, -1):
            ends.append((conv, parts[i], i == 0, final, list(vector), known[conv, parts[i - 1]][1] if i else None))
            vector, final = apply(known[conv, parts[i]][2], vector), False
    bounds = spark.createDataFrame(ends, "conv_id long, part int, opens boolean, closes boolean, end array<long>, previous string")
    joined = table.alias("t").join(F.broadcast(bounds).alias("b"), key("t", "b"), "left").select("t.conv_id", "t.part", "at", "initial", "fault", "opens", "closes", "end", "previous")

    def unrolled(batches):
        names, types = ["conv_id", "part", "at", "begin", "after", "letters", "made", "cost", "illegal"], [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        held: list[list] = [[] for _ in names]

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(held, types, strict=True)], names=names)
            for x in held:
                x.clear()
            return out

        for (conv, part, opens, closes, end, previous), ats, initials, symbols in _chunks(batches, ("opens", "closes", "end", "previous")):
            for begin in (0,) if opens is None or opens else range(4):
                found, after = edits(symbols, begin, None if closes is None or closes else tuple(end))
                before = previous if opens is False else None
                for at, initial, symbol, (letters, made) in zip(ats, initials, symbols, found, strict=True):
                    cost = sum({"D": DELETE, "I": INSERT, "K": 0, "R": REROLE}[x] for x in letters) + CUT * (symbol[1] == "t" and "D" not in letters)
                    row = (conv, part, at, begin, after, letters, made, cost, int(before is not None and before + initial not in ("su", "ua", "au")))
                    before = initial
                    for x, y in zip(held, row, strict=True):
                        x.append(y)
                    if len(held[0]) >= 20_000:
                        yield batch()
        if held[0]:
            yield batch()

    done = shared.written(_sorted_by(joined, ["conv_id", "part"]).mapInArrow(unrolled, "conv_id long, part int, at long, begin int, after int, letters string, made string, cost long, illegal long"), "repair-edits")
    # The state in which each later chunk of a conversation begins.
    chosen = []
    if ranges:
        spans = done.alias("d").join(F.broadcast(pairs).alias("p"), key("d", "p"), "left_semi")
        after = {(r.conv_id, r.part, r.begin): r.after for r in spans.groupBy("conv_id", "part", "begin").agg(F.max("after").alias("after")).collect()}
        for conv, parts in ranges.items():
            state = 0
            for p in (p for p in parts if (conv, p) in known):
                chosen.append((conv, p, state))
                state = after[conv, p, state]
    right = spark.createDataFrame(chosen, "conv_id long, part int, state int")
    picked = done.alias("d").join(F.broadcast(right).alias("r"), key("d", "r"), "left").filter("coalesce(state, 0) = begin")
    return picked.select("d.conv_id", "at", "letters", "made", "cost", "illegal")


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, audit and repaired_sha256 of every conversation.

    Edits and rows meet in the order of at; a task streams them and holds one
    batch, the letters of one conversation and its open hash.
    """
    left = found.select("conv_id", "at", F.lit(0).alias("kind"), "letters", "made")
    right = rows.select("conv_id", "at", F.lit(1).alias("kind"), F.col("role").alias("letters"), F.col("text").alias("made"))
    ordered = left.unionByName(right).repartition("conv_id").sortWithinPartitions("conv_id", "at", "kind")
    role_of = {"u": "user", "a": "assistant"}

    def run(batches):
        schema = pa.schema([("conv_id", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
        open_, conv, audit, sha, rows_out = False, None, [], None, 0
        letters = made = ""
        for batch in batches:
            done = []
            for c, kind, a, b in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "kind", "letters", "made")), strict=True):
                if not open_ or c != conv:
                    if open_:
                        done.append({"conv_id": conv, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()})
                    open_, conv, audit, sha, rows_out = True, c, [], hashlib.sha256(), 0
                if not kind:
                    letters, made = a, b
                    continue
                audit.append(letters)
                for letter, role in zip(letters, made, strict=True):
                    if letter != "D":
                        line = f"{role_of[role] if role != '-' else a}:{'' if letter == 'I' else b}"
                        sha.update((line if not rows_out else "\n" + line).encode())
                        rows_out += 1
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if open_:
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}], schema)

    return ordered.mapInArrow(run, "conv_id long, audit string, repaired_sha256 string")


def report(rows: DataFrame, every: DataFrame) -> DataFrame:
    """One row for each conv_id of ``every``: gaps, faults, cost, audit and hash of ``rows`` (conv_id, turn, role, text)."""
    table = numbered(rows)
    marked = shared.written(faults(table), "repair-faults")
    found = row_edits(marked)
    count = lambda name: F.sum((F.col("fault") == name).cast("long")).alias(name)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0))
    shape = marked.groupBy("conv_id").agg(gaps.alias("gaps"), *(F.coalesce(count(x), F.lit(0)).alias(x) for x in ("blank", "duplicate", "truncated")))
    price = found.groupBy("conv_id").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"))
    out = every.select("conv_id").distinct().alias("e")
    for name, side in (("s", shape), ("p", price), ("r", repaired(table, found))):
        out = out.join(side.alias(name), F.col("e.conv_id").eqNullSafe(F.col(f"{name}.conv_id")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return out.select("e.conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = shared.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return report(damaged(conversations), conversations)
