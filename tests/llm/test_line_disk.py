"""What line dedup puts beside each other at once stays in proportion to the lines, whatever their buckets and pairs are."""

import random

from pyspark.sql import functions as F

from plumbline.llm import lines


def _forms(spark, said):
    own = lines.occurrences(spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")).cache()
    return lines.signed_forms(lines.distinct_forms(own), []), own


def _words(draw, n):
    return ["".join(draw.choices("etaoinshr", k=draw.randint(2, 7))) for _ in range(n)]


def test_crowded_bucket_has_few_parts(spark, monkeypatch):
    """A form is dealt to some PARTS parts of a bucket at most, where it was one for each SPREAD forms of it."""
    draw, seen, held = random.Random(6), [], lines.across
    passage = _words(draw, 44)
    said = [" ".join([*_words(draw, draw.randint(3, 7)), *passage, *_words(draw, draw.randint(2, 4))]) for _ in range(120)]

    def spied(labels, *more):
        seen.append(labels.agg(F.max("_ones"), F.max("_others")).first())
        return held(labels, *more)

    monkeypatch.setattr(lines, "SPREAD", 3)
    monkeypatch.setattr(lines, "across", spied)
    lines.groups(*_forms(spark, said)).collect()
    assert seen and all(n <= 18 for row in seen for n in row) and max(max(row) for row in seen) > 2


def test_texts_beside_pairs_in_parts(spark, monkeypatch):
    """Pairs get their texts some at a time, and no link is lost."""
    draw, rows, write = random.Random(7), [], lines.shared.written
    stock = _words(draw, 60)
    said = [" ".join([*stock[:k], "".join(draw.choices("bcdfgm", k=5)), *stock[k + 1 :]]) for k in range(60)]

    def counted(df, name):
        table = write(df, name)
        rows.append((name, table.count()))
        return table

    signed, own = _forms(spark, said)
    monkeypatch.setattr(lines.shared, "written", counted)
    monkeypatch.setattr(lines, "AT_ONCE", 1 << 10, raising=False)
    found = lines.groups(signed, own).collect()
    both = [n for name, n in rows if name == "line-both"]
    assert sum(both) >= 59 and max(both) <= 30
    assert len(found) == 60 and len({r.root for r in found}) == 1


def test_texts_of_forms_that_meet_only(spark, monkeypatch):
    """Forms that share a run but are of quite different lengths are not gathered for the last round."""
    draw, seen, held = random.Random(9), [], lines.across

    def spied(labels, *more):
        seen.append({r.form for r in labels.select("form").collect()})
        return held(labels, *more)

    # The least word pair of lines of one word over and over is the same, and so are those of the two near ones.
    said = ["the same " * k + "end" for k in (2, 4, 7, 11, 17, 26, 40, 61)]
    stock = _words(draw, 12)
    near = [" ".join([*stock[:6], x, *stock[6:]]) for x in ("uv", "uw", "the same the same the same the same the same the same the same vv")]
    monkeypatch.setattr(lines, "across", spied)
    signed, own = _forms(spark, said + near)
    form = {r["_d"]: r.form for r in own.collect()}
    assert len({r.root for r in lines.groups(signed, own).collect() if r.form in (form[8], form[9])}) == 1
    assert not any(found & {form[i] for i in range(len(said))} for found in seen)


def test_slices_change_nothing(spark):
    """Lines in slices by their forms give the same documents as lines that are one slice."""
    draw = random.Random(10)
    stock = [" ".join(_words(draw, 14)) for _ in range(30)]
    docs = [(i, "\n".join(draw.choice(stock) + draw.choice(["", " x", " zz"]) for _ in range(4))) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    own = lines.occurrences(df)
    root = {r.form: r.root for r in lines.groups(*_forms(spark, [t for _, t in docs])).collect()}
    first, kept = set(), {}
    for r in sorted(own.collect(), key=lambda r: (r["_d"], r.line)):
        g = root.get(r.form, r.form)
        kept[r["_d"]] = kept.get(r["_d"], 0) + (g not in first)
        first.add(g)
    assert {r.doc_id: r.n_kept for r in lines.dedup(df).collect()} == kept
