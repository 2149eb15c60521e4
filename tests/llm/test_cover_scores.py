"""Scores of any size keep their order: near ties, components of 2^18 and more, sums beyond doubles."""

import math
import random

import pytest
from pyspark.sql import functions as F

from plumbline.llm import cover_tree


def brute(rows, k=5):
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    out = []
    for i, q in whole:
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in whole if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def found(spark, rows):
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in cover_tree.top_k(df, F.col("vec_id") % 50 == 0).collect())


def test_near_ties(spark):
    """Eight candidates whose scores differ by one, beyond what doubles tell apart."""
    top = float((1 << 18) - 1)
    rows = [(0, [top] * 4 + [1 / 256])] + [(10 + i, [top] * 4 + [i / 256]) for i in range(1, 9)]
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("size", [1 << 20, 1 << 29])
def test_large_components(spark, size):
    draw = random.Random(size)
    rows = [(i, [draw.choice([-1, 1]) * (size + draw.randint(0, 3) / 256) if draw.random() < 0.6 else draw.random() for _ in range(2)] + [0.0]) for i in range(120)]
    want = brute(rows)
    if any(abs(s) >= 1 << 63 for *_, s in want):
        with pytest.raises(Exception, match="long"):
            found(spark, rows)
    else:
        assert found(spark, rows) == want


def test_wide_sums(spark):
    """Products pass a long, their sums do not."""
    big = float(1 << 40)
    rows = [(i, [big, big, float(i % 7)]) if i % 50 == 0 else (i, [big, -big, float(i)]) for i in range(1, 120)]
    assert found(spark, rows[49:50] + [r for r in rows if r[0] % 50]) == brute(rows[49:50] + [r for r in rows if r[0] % 50])
