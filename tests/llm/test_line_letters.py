"""Letters shut out pairs before their texts are gathered, and never a near one."""

import random

from pyspark.sql import functions as F

from plumbline.llm import lines


LETTERS = "etaoinshrdlucmfwypvbgkz "


def _bound(a: str, b: str) -> tuple[int, int]:
    """The edits that the counted letters show at least, and those allowed."""
    over = [a.count(c) - b.count(c) for c in LETTERS]
    return max(sum(d for d in over if d > 0), -sum(d for d in over if d < 0)), int(0.15 * max(len(a), len(b)) + 1e-9)


def test_letters_lose_no_near_pair(spark):
    """Pairs that the letters shut out are those of which the plain count says so; none of them is near."""
    draw = random.Random(3)
    rows = []
    for i in range(300):
        a = "".join(draw.choices(LETTERS + "é9", k=draw.randint(1, 80) if i else 70_000))
        b = list(a)
        for _ in range(draw.randint(0, max(1, len(a) // 4)) if i else 10):
            b[draw.randrange(len(b))] = draw.choice(["", "e", "zz"])
        rows.append((a, "".join(b)))
    side = lambda x: [F.col(x).alias("_norm")]
    pairs = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i long, a string, b string")
    counted = lambda x: pairs.select("i", *side(x)).select("i", *(c.alias(f"{x}{n}") for c, n in zip(lines.letter_counts(), [*(f"_l{k}" for k in range(len(LETTERS) // 4)), "_letters"], strict=True)), F.char_length("_norm").alias(f"{x}size"))
    out = pairs.join(counted("a"), "i").join(counted("b"), "i").select("a", "b", lines.letters_allow("a", "b", 0.85).alias("got"), F.levenshtein("a", "b", 12_000).alias("edits")).collect()
    for r in out:
        least, most = _bound(r.a, r.b)
        # The first is beyond what a counter holds, so only the side that loses nothing is asked for.
        assert r.got == (least <= most) or len(r.a) == 70_000 and r.got
        assert r.got or not 0 <= r.edits <= most
    assert 40 < sum(r.got for r in out) < 260


def test_common_words_make_few_pairs(spark, monkeypatch):
    """Short lines that share a common pair of words are compared only if their letters allow it."""
    draw = random.Random(8)
    word = lambda: "".join(draw.choices("abcdefghijklmnop", k=draw.randint(2, 7)))
    said = [" ".join([*["of the"] * draw.randint(3, 5), word(), word(), word()]) for _ in range(400)]
    text, held, seen = {}, lines.verified, []

    def spied(pairs, *more):
        seen.append([_bound(text[r.a], text[r.b]) for r in pairs.collect()])
        return held(pairs, *more)

    own = lines.occurrences(spark.createDataFrame(list(enumerate(said)), "doc_id long, text string"))
    text.update((r.form, r["_norm"]) for r in own.collect())
    monkeypatch.setattr(lines, "verified", spied)
    lines.groups(lines.signed_forms(lines.distinct_forms(own), []), own).collect()
    # The last round holds all pairs of a bucket against each other.
    assert len(seen) == 3 and seen[2] and all(least <= most for least, most in seen[2])
