"""Which lines meet does not depend on how many others share their buckets."""

import random

from plumbline.llm import lines


def test_crowded_buckets_lose_no_pair(spark):
    """Near lines are linked whether or not hundreds of other lines share all of their least word pairs."""
    draw = random.Random(5)
    word = lambda k: "".join(draw.choices("abcdefghijklmnop", k=k))
    shared = [word(8) for _ in range(14)]
    texts = [" ".join([*shared, *(word(3) for _ in range(4))]) for _ in range(8)]
    # These hold all that the others share, and a word of their own that keeps them apart.
    crowd = [" ".join([*shared, "".join(draw.choices("qrstuvwxyz", k=150))]) for _ in range(360)]

    def linked(said: list[str]) -> list[int | None]:
        own = lines.occurrences(spark.createDataFrame(list(enumerate(said)), "doc_id long, text string"))
        form = {r["_d"]: r.form for r in own.collect()}
        root = {r.form: r.root for r in lines.groups(lines.signed_forms(lines.distinct_forms(own), []), own).collect()}
        found = [root.get(form[i]) for i in range(len(texts))]
        return [found.index(r) if r is not None else None for r in found]

    alone = linked(texts)
    assert None not in alone and linked(texts + crowd) == alone
