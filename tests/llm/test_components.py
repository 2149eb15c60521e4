"""Components against a plain union-find, with hubs broadcast and not; the ring of buckets against a sorted list."""

import random

import pytest

from plumbline.llm import components, weighted_prints


@pytest.mark.parametrize("few", [True, False])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(components, "HUB", 4)
    if not few:
        monkeypatch.setattr(components, "BROADCAST_ROWS", 0)
    draw = random.Random(6)
    edges = [(draw.randrange(80), draw.randrange(80)) for _ in range(50)] + [(200, 201 + i) for i in range(20)] + [(i + 1, i) for i in range(300, 330)] + [(7, 7), (1, 2), (2, 1)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_ring(spark):
    buckets = random.Random(2).sample(range(-(10**12), 10**12), 300)
    got = {r["_bucket"]: (r["_top"], r["_before"]) for r in weighted_prints.ring(spark.createDataFrame([(b, b + k) for b in buckets for k in (0, 5)], "_bucket long, _key long")).collect()}
    down = sorted(buckets, reverse=True)
    assert got == {b: (b + 5, down[i - 1]) for i, b in enumerate(down)}
