"""The closest names against a plain search over all pairs."""

import difflib
import random

from plumbline.operators import names


def test_closest(spark):
    draw = random.Random(7)
    known = sorted({"".join(draw.choices("abcdeé_", k=draw.randint(1, 9))) for _ in range(150)} | {"calculator", "count_fixtures", "read_page", ""})
    asked = sorted({"calc", "page_read", "fixture_count", "zzzz", "", *known[::9], *("".join(draw.choices("abcdeé_x", k=draw.randint(1, 10))) for _ in range(120))})
    want = []
    for name in asked:
        found = difflib.get_close_matches(name, known, n=1, cutoff=0.5)
        want += [(name, found[0], difflib.SequenceMatcher(None, found[0], name).ratio())] if found else []
    frame = lambda rows: spark.createDataFrame([(r,) for r in [*rows, None, *rows[:3]]], "name string")
    got = sorted(tuple(r) for r in names.closest(frame(asked), frame(known)).collect())
    assert got == sorted(want)
    assert names.closest(frame(asked), frame(known).limit(0)).collect() == []
