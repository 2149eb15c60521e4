"""Lines that share a passage are compared where they meet; nothing but links is written of their pairs."""

import random

from pyspark.sql import functions as F

from plumbline.llm import lines


def test_shared_passages_write_links_only(spark, monkeypatch):
    """Tables grow with the forms, not with their pairs; each pair is compared once, in parts too, and by the plain distance."""
    draw = random.Random(4)
    word = lambda: "".join(draw.choices("etaoinshr", k=draw.randint(2, 7)))
    passage = [word() for _ in range(44)]
    said = [" ".join([*(word() for _ in range(draw.randint(3, 7))), *passage, *(word() for _ in range(draw.randint(2, 4)))]) for _ in range(150)]
    own = lines.occurrences(spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")).cache()
    rows, seen, linked, write, held = [], [], [], lines.shared.written, lines.verified

    def counted(df, name):
        table = write(df, name)
        rows.append((table.count(), name))
        return table

    def spied(pairs, *more):
        seen.append([tuple(sorted((r.a, r.b))) for r in pairs.select("a", "b").collect()])
        links = held(pairs, *more)
        linked.append({tuple(sorted((r.a, r.b))) for r in links.collect()})
        return links

    monkeypatch.setattr(lines, "SPREAD", 40)
    monkeypatch.setattr(lines.shared, "written", counted)
    monkeypatch.setattr(lines, "verified", spied)
    lines.groups(lines.signed_forms(lines.distinct_forms(own), []), own).collect()
    assert len(seen) == 3 and len(seen[2]) == len(set(seen[2])) > 15 * len(said)
    assert max(rows)[0] <= 15 * len(said)
    text = {r.form: r["_norm"] for r in own.collect()}
    pairs = spark.createDataFrame([(*p, text[p[0]], text[p[1]]) for p in seen[2]], "a long, b long, x string, y string")
    near = pairs.filter(F.levenshtein("x", "y") <= F.floor(0.15 * F.greatest(F.length("x"), F.length("y")) + 1e-9)).collect()
    assert linked[2] == {(r.a, r.b) for r in near} and linked[2]
