"""The resolver against a plain loop over made tables: group words, two header rows, prefixes, misses, tables without header."""

import random
import re

import pytest

from plumbline.operators import schema_resolver as R


def norm(text):
    return re.sub("[^a-z0-9]+", " ", (text or "").lower()).strip()


def plain(grid, schema):
    """(data_start, coverage, {col: (label, field)}) of one table, row by row."""
    kinds = []
    for row in grid:
        cells = [norm(c) for c in row if norm(c)]
        hits = sum(len(c) >= 2 and any(c.startswith(w) or w.startswith(c) for w in schema.words) for c in cells)
        kinds.append("title" if len(cells) <= 1 or all("schedule" in c for c in cells) else "header" if hits >= 2 else "data")
    start = kinds.index("data") if "data" in kinds else len(grid)
    band = [r for r in range(start) if kinds[r] == "header"]
    out, taken = {}, set()
    for col in range(max((len(r) for r in grid), default=0)):
        filled = [r for r in band if norm(grid[r][col])]
        if not filled:
            continue
        low = filled[-1]
        label = norm(grid[low][col])
        if label in schema.ambiguous:
            over = [[c for c in range(col + 1) if norm(grid[r][c]) in schema.groups] for r in band if r < low]
            first = next(((r, cs[-1]) for r, cs in zip([r for r in band if r < low], over, strict=True) if cs), None)
            label = f"{norm(grid[first[0]][first[1]])} {label}" if first else label
        said = schema.ordered_synonyms()
        field = next((f for _, f, s in said if s == label), None)
        if field is None and len(label) >= 3:
            field = next((f for _, f, s in said if label.startswith(s) or s.startswith(label)), None)
        out[col] = (label, None if field in taken else field)
        taken.add(field)
    mapped = {f for _, f in out.values() if f}
    return start, round(len(mapped & set(schema.core)) / len(schema.core), 3), out


def grids(draw, schema, n):
    words = [*schema.words, "COLOUR", "Sill", "x", "", "", "notes!", "Door\nNumber", "hei", "DOOR SCHEDULE", "materials used"]
    for _ in range(n):
        width = draw.randint(1, 6)
        yield [[draw.choice([draw.choice(words), draw.choice(words).upper(), None if draw.random() < 0.1 else "N101"][: 2 if r < draw.randint(0, 3) else 3]) for _ in range(width)] for r in range(draw.randint(1, 5))]


@pytest.mark.parametrize("schema", [R.DOOR, R.FINISH, R.CAMERA], ids=lambda s: s.name)
def test_any_table(spark, schema):
    draw = random.Random(schema.name)
    made = list(grids(draw, schema, 120))
    made += [[["DOOR", "", "FRAME", ""], ["MATERIAL", "FINISH", "Material", "finish"], ["WD", "P", "HM", "P"]], [["a", "b"]], [["MARK"]]]
    rows = [(t, r, c, x) for t, grid in enumerate(made) for r, row in enumerate(grid) for c, x in enumerate(row)]
    mapping, tables = R.resolve(spark.createDataFrame(rows, "t int, row_ord int, col_ord int, text string"), schema, ["t"])
    got = {r.t: (r.data_start, r.coverage, {}) for r in tables.collect()}
    for r in mapping.collect():
        got[r.t][2][r.col_ord] = (r.label, r.field)
    for t, grid in enumerate(made):
        assert got[t] == plain(grid, schema), grid
