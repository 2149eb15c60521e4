"""Spelling variants against all pairs: the composition, crowded states, words of the contract, forms and roots."""

import random
import re
import zlib
from collections import Counter

from plumbline.llm import variants


def one_edit(a, b):
    """Whether exactly one inserted, deleted or replaced code point tells a from b."""
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a != b and len(b) - len(a) <= 1 and a[i + (len(a) == len(b)) :] == b[i + 1 :]


def made(draw, n, letters="aé", lengths=(7, 8, 9, 10)):
    return sorted({"".join(draw.choices(letters, k=draw.choice(lengths))) for _ in range(n)})


def test_acceptor_is_minimal():
    own = variants.Acceptor(["abcx", "abdx", "bbcx", "bbdx"])
    assert len(own.arcs) == 5 and sorted(own.rests(own.root, 4)) == ["abcx", "abdx", "bbcx", "bbdx"]


def test_composition_is_all_pairs():
    """Every pair of n and n or n + 1 letters comes once, repeated letters, prefixes and empty rests too."""
    draw = random.Random(3)
    for _ in range(60):
        members = sorted({"".join(draw.choices("ab", k=draw.choice([3, 4]))) for _ in range(draw.randint(2, 20))})
        got = Counter(frozenset(p) for p in variants.pairs_of(members, 3, 0, 4))
        want = {frozenset((a, b)) for a in members for b in members if one_edit(a, b) and min(len(a), len(b)) == 3}
        assert set(got) == want and set(got.values()) <= {1}


def links(spark, words, limit):
    vocabulary = spark.createDataFrame([(w, i + 2) for i, w in enumerate(words)], "word string, n long")
    return vocabulary, sorted((r.word, r.other, r.n, r.other_n) for r in variants.near(vocabulary, limit).collect())


def test_near(spark):
    """The same links whether no state is cut or all crowded ones are; long words that share most are among them."""
    draw = random.Random(4)
    long_ = "ab" * 3000
    short = sorted({*made(draw, 250), *made(draw, 60, "abcdefgé😀")})
    for limit, words in ((variants.LIMIT, sorted({*short, *(long_[:i] + "x" + long_[i:] for i in (5, 2999, 5000)), long_})), (5, short)):
        want = sorted((a, b, i + 2, j + 2) for i, a in enumerate(words) for j, b in enumerate(words) if one_edit(a, b))
        assert want and links(spark, words, limit)[1] == want


def plain(documents):
    """Rows of the contract from (doc_id, text)."""
    count = Counter()
    for doc, text in documents:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(variants.UPPER, variants.LOWER))
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    n = {w: c for w, c in count.items() if len(w) >= 7 and c >= 2}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def test_forms(spark):
    """Chains of forms, ties, nulls, repeats and other letters' cases."""
    chain = [("straßenlicht", 3), ("straßenlichtx", 50), ("straßenlichtxy", 900), ("ÀPFELBAUM", 30), ("àpfelbaum", 3), ("Xpfelbaum", 30)]
    rows = [(i, " ".join(f"{w}. {w.upper() if i % 2 and w.isascii() else w}!" for w, k in chain if i < k), "clash") for i in range(900)]
    rows += [(None, "straßenlichtx\tstraßenlichtx", None), (5, None, None), (6, "", None)] + [(7, "repeated words " * 40, None)] * 3
    table = spark.createDataFrame(rows, "doc_id long, text string, word string")
    vocabulary = variants.words(table)
    got = sorted(tuple(r) for r in variants.forms(vocabulary, variants.near(vocabulary)).collect())
    assert got == plain([r[:2] for r in rows])
    assert any(form and root != form for _, form, root, *_ in got)
    empty = variants.words(table.limit(0))
    assert variants.forms(empty, variants.near(empty)).collect() == []
