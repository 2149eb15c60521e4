"""Spelling variants: V o E o V, the vocabulary acceptor composed with a one-edit transducer and the acceptor again.

Words that differ by one inserted, deleted or replaced code point, the shorter of
n code points, share their first floor(n/2) code points or their last ones.  So
the composition is cut by initial state: the state of the acceptor that such a
shared beginning leads to (forward), or the state of the mirrored acceptor that a
shared ending leads to (backward).  A partition holds the words behind one state,
of n and n + 1 code points, as a minimised acceptor of their rests.  E keeps the
diagonal until its one edit, then both tapes have to read the same; accepted pairs
are enumerated with memoised intersections of residual languages.  The edit is the
first mismatch, so a pair is accepted once; a backward pair whose beginnings agree
is left to the forward side.

A state with more than LIMIT words is cut further, exactly: pairs that agree on two
more code points go to the states behind it, the others, which agree on all that
comes after these two, to partitions by beginning and ending.

Nulls in text are no words; a null doc_id counts as an empty string in the
checksum.  Texts are taken whole, repeated rows count each.  Only doc_id and text
are read, so other columns cannot clash.  Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Least code points and least occurrences of a word; how many times as frequent a form has to be.
SHORTEST, SEEN, TIMES = 7, 2, 10
#: Words behind one initial state beyond which it is cut further.
LIMIT = 20_000
#: Crowded states are broadcast up to this many; beyond, the join shuffles.
BROADCAST_ROWS = 100_000
RUN = "[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(documents: DataFrame) -> DataFrame:
    """word, n of the vocabulary: runs of letters, some of them with one code point deleted by their checksum."""
    # A run below SHORTEST is no word, damaged or not; the pattern finds whole runs only, as it takes all a run has.
    found = documents.select("doc_id", F.explode(F.expr(f"regexp_extract_all(text, '{RUN}{{{SHORTEST},}}', 0)")).alias("run"))
    found = found.select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    check = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    hit = F.pmod(check, F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), hit), F.substring("run", hit + 2, F.char_length("run")))
    word = F.when(check % 31 == 0, cut).otherwise(F.col("run"))
    counts = found.select(word.alias("word")).filter(F.char_length("word") >= SHORTEST).groupBy("word").agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") >= SEEN)


class Acceptor:
    """The minimised acceptor of sorted distinct words: equal residual languages are one state."""

    def __init__(self, members: list[str]):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self._known: dict[tuple, int] = {}
        self._shared: dict[tuple[int, int, int], tuple[str, ...]] = {}
        self._whole: dict[tuple[int, int], tuple[str, ...]] = {}
        self.root = self._state(members, 0, len(members), 0)

    def _state(self, members: list[str], lo: int, hi: int, depth: int) -> int:
        """The state of the words lo to hi, which agree on their first ``depth`` code points."""
        # What all of them share from here is a chain; sorted words share what the first and the last share.
        chain = self._agreed(members[lo], members[hi - 1], depth)
        state = self._branching(members, lo, hi, depth + len(chain))
        for c in reversed(chain):
            state = self._intern(False, ((c, state),))
        return state

    @staticmethod
    def _agreed(a: str, b: str, depth: int) -> str:
        end = depth
        while end < len(a) and a[end] == b[end]:
            end += 1
        return a[depth:end]

    def _branching(self, members: list[str], lo: int, hi: int, depth: int) -> int:
        final = len(members[lo]) == depth
        lo += final
        arcs = []
        while lo < hi:
            c, end = members[lo][depth], lo + 1
            while end < hi and members[end][depth] == c:
                end += 1
            arcs.append((c, self._state(members, lo, end, depth + 1)))
            lo = end
        return self._intern(final, tuple(arcs))

    def _intern(self, final: bool, arcs: tuple) -> int:
        key = (final, arcs)
        state = self._known.get(key)
        if state is None:
            state = self._known[key] = len(self.arcs)
            self.arcs.append(dict(arcs))
            self.final.append(final)
        return state

    def rests(self, state: int, length: int) -> tuple[str, ...]:
        """What leads from ``state`` to a final state in ``length`` steps."""
        found = self._whole.get((state, length))
        if found is None:
            at, left, chain = state, length, []
            while left and len(self.arcs[at]) == 1:
                (c, at), left = *self.arcs[at].items(), left - 1
                chain.append(c)
            head = "".join(chain)
            if not left:
                found = (head,) if self.final[at] else ()
            else:
                found = tuple(head + c + rest for c, to in self.arcs[at].items() for rest in self.rests(to, left - 1))
            self._whole[state, length] = found
        return found

    def both(self, a: int, b: int, length: int) -> tuple[str, ...]:
        """What both states accept in ``length`` steps."""
        if a == b:
            return self.rests(a, length)
        key = (a, b, length) if a < b else (b, a, length)
        found = self._shared.get(key)
        if found is None:
            left, chain = length, []
            while a != b and left and len(letters := self.arcs[a].keys() & self.arcs[b].keys()) == 1:
                (c,) = letters
                a, b, left = self.arcs[a][c], self.arcs[b][c], left - 1
                chain.append(c)
            head = "".join(chain)
            if a == b:
                found = tuple(head + rest for rest in self.rests(a, left))
            elif not left:
                found = (head,) if self.final[a] and self.final[b] else ()
            else:
                found = tuple(head + c + rest for c in self.arcs[a].keys() & self.arcs[b].keys() for rest in self.both(self.arcs[a][c], self.arcs[b][c], left - 1))
            self._shared[key] = found
        return found

    def near(self, n: int, free: int) -> Iterator[tuple[str, str]]:
        """Pairs (w, v) of V o E o V whose first mismatch is among the first ``free`` places: w has n code points, v n by a replacement or n + 1 by an insertion."""
        open_ = [(self.root, "")]
        while open_:
            state, head = open_.pop()
            left = n - len(head)
            arcs = list(self.arcs[state].items())
            for i, (c, to) in enumerate(arcs):
                if left:
                    # Replacement: both tapes move, by different letters.
                    for d, other in arcs[:i]:
                        for rest in self.both(to, other, left - 1):
                            yield head + c + rest, head + d + rest
                # Insertion: the second tape moves alone; the first goes on by another letter, or ends.
                for rest in self.both(state, to, left):
                    if not rest.startswith(c):
                        yield head + rest, head + c + rest
            if len(head) + 1 < free and left:
                open_ += [(to, head + c) for c, to in arcs]


def pairs_of(members: list[str], n: int, skip: int, free: int) -> Iterator[tuple[str, str]]:
    """Near pairs of sorted words that agree on their first ``skip`` code points, with a first mismatch among the next ``free``."""
    if members[0][:skip] != members[-1][:skip]:
        raise ValueError("words of one partition have different beginnings")
    head = members[0][:skip]
    for a, b in Acceptor([w[skip:] for w in members]).near(n - skip, free):
        yield head + a, head + b


NEAR = "word string, other string, n long, other_n long"


def _beginning(extra: int) -> Column:
    """The code points that lead to the initial state, ``extra`` more than half of the shorter word."""
    return F.substring("body", F.lit(1), F.floor(F.col("size") / 2).cast("int") + extra)


def _enumerate(members: DataFrame, extra: int, tail: bool) -> DataFrame:
    """NEAR rows of all partitions of ``members`` (side, size, body, n), by beginning and, where ``tail``, by ending."""
    rest = F.expr(f"right(body, greatest(size - cast(floor(size / 2) AS int) - {extra} - 2, 0))") if tail else F.lit("")
    held = members.select("side", "size", "body", "n", rest.alias("rest"))
    dealt = held.repartition("side", "size", _beginning(extra), "rest").sortWithinPartitions("side", "size", *([_beginning(extra)] if tail else []), "rest", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list, list, list] = ([], [], [], [])

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())], names=["word", "other", "n", "other_n"])
            for x in out:
                x.clear()
            return batch

        def group(key: tuple, bodies: list[str], counts: list[int]) -> None:
            side, size, _, head = key
            count = dict(zip(bodies, counts, strict=True))
            half = size // 2
            for w, v in pairs_of(bodies, size, len(head), 2 if tail else size + 1):
                if side:
                    # Words whose beginnings agree meet on the forward side.
                    if w[-half:] == v[-half:]:
                        continue
                    a, b = w[::-1], v[::-1]
                else:
                    a, b = w, v
                for x, y, p, q in ((a, b, w, v), (b, a, v, w)):
                    out[0].append(x)
                    out[1].append(y)
                    out[2].append(count[p])
                    out[3].append(count[q])

        key, bodies, counts = None, [], []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("side", "size", "rest", "body", "n")]
            for side, size, end, body, n in zip(*columns, strict=True):
                new = (side, size, end, body[: size // 2 + extra])
                if new != key:
                    if len(bodies) > 1:
                        group(key, bodies, counts)
                    key, bodies, counts = new, [], []
                    if len(out[0]) > 50_000:
                        yield flush()
                bodies.append(body)
                counts.append(n)
        if len(bodies) > 1:
            group(key, bodies, counts)
        if out[0]:
            yield flush()

    return dealt.select("side", "size", "rest", "body", "n").mapInArrow(run, NEAR)


def near(vocabulary: DataFrame, limit: int = LIMIT) -> DataFrame:
    """word, other, n, other_n of all ordered pairs of words of ``vocabulary`` (word, n) that are one edit apart."""
    length = F.char_length("word")
    ways = F.array(*(F.struct(F.lit(side).alias("side"), (length - shorter).alias("size")) for side in (0, 1) for shorter in (0, 1)))
    members = vocabulary.select("word", "n", F.explode(ways).alias("way")).filter(F.col("way.size") >= SHORTEST)
    body = F.when(F.col("way.side") == 0, F.col("word")).otherwise(F.reverse("word"))
    members = members.select("way.side", "way.size", body.alias("body"), "n")
    found, extra = None, 0
    while True:
        crowded = members.groupBy("side", "size", _beginning(extra).alias("head")).agg(F.count("*").alias("k"))
        crowded = crowded.filter((F.col("k") > limit) & (F.col("size") - F.floor(F.col("size") / 2) > extra + 2)).select("side", "size", "head")
        crowded = shared.written(crowded, "variants-crowded")
        some = crowded.count()
        if some <= BROADCAST_ROWS:
            crowded = F.broadcast(crowded)
        keyed = members.withColumn("head", _beginning(extra))
        calm = keyed.join(crowded, ["side", "size", "head"], "left_anti") if some else keyed
        step = _enumerate(calm, extra, False)
        found = step if found is None else found.unionByName(step)
        if not some:
            return found
        members = shared.written(keyed.join(crowded, ["side", "size", "head"], "left_semi").drop("head"), "variants-deeper")
        found = found.unionByName(_enumerate(members, extra, True))
        extra += 2


def forms(vocabulary: DataFrame, links: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``vocabulary``."""
    best = links.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best"))
    best = best.select("word", "n_near", "best.form", (-F.col("best.less")).alias("form_n"))
    joined = vocabulary.join(best, "word", "left")
    holds = F.col("form_n") >= TIMES * F.col("n")
    table = shared.written(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(holds, F.col("form")).alias("form"), F.when(holds, F.col("form_n")).alias("form_n")), "variants-forms")
    # Every step multiplies n by ten or more, so chains are short; their steps are doubled until none leads on.
    steps = table.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        steps = shared.written(steps, "variants-roots")
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if not steps.join(onward, "root", "left_semi").limit(1).count():
            break
        steps = steps.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return table.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The checksum is spelt out: DuckDB has none.  Pairs meet on equal halves and are compared whole.
SQL = rf"""
WITH RECURSIVE
bits AS (SELECT range AS b, CAST(range AS BIGINT) AS c FROM range(256)),
steps(b, c, k) AS (SELECT b, c, 0 FROM bits UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
tab AS (SELECT list(c ORDER BY b) AS t FROM steps WHERE k = 8),
found AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '{RUN}{{{SHORTEST},}}')), '{UPPER}', '{LOWER}') AS run FROM documents),
hexed AS (SELECT run, hex(encode(concat(doc_id, ':', run))) AS h FROM found),
summed AS (
  SELECT run, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS BIGINT) + 1])), CAST(4294967295 AS BIGINT)) AS crc
  FROM hexed, tab),
cut AS (SELECT CASE WHEN crc % 31 = 0 THEN substr(run, 1, CAST(crc % length(run) AS BIGINT)) || substr(run, CAST(crc % length(run) AS BIGINT) + 2) ELSE run END AS word FROM summed),
vocabulary AS (SELECT word, count(*) AS n FROM cut WHERE length(word) >= {SHORTEST} GROUP BY word HAVING count(*) >= {SEEN}),
halves AS (
  SELECT word, n, unnest([left(word, length(word) // 2), left(word, (length(word) - 1) // 2), '|' || right(word, length(word) // 2), '|' || right(word, (length(word) - 1) // 2)]) AS half FROM vocabulary),
links AS (
  SELECT DISTINCT a.word, b.word AS other, a.n, b.n AS other_n FROM halves a JOIN halves b ON a.half = b.half
  WHERE a.word <> b.word AND abs(length(a.word) - length(b.word)) <= 1
    AND CASE WHEN length(a.word) = length(b.word) THEN len(list_filter(range(1, length(a.word) + 1), lambda i: substr(a.word, i, 1) <> substr(b.word, i, 1))) = 1
      ELSE list_contains(list_transform(range(1, greatest(length(a.word), length(b.word)) + 1), lambda i: CASE WHEN length(a.word) > length(b.word)
        THEN substr(a.word, 1, i - 1) || substr(a.word, i + 1) ELSE substr(b.word, 1, i - 1) || substr(b.word, i + 1) END),
        CASE WHEN length(a.word) > length(b.word) THEN b.word ELSE a.word END) END),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS form, max(other_n) AS form_n FROM links GROUP BY word),
chosen AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {TIMES} * v.n THEN form END AS form, CASE WHEN form_n >= {TIMES} * v.n THEN form_n END AS form_n
  FROM vocabulary v LEFT JOIN best b ON v.word = b.word),
walk(word, here, depth) AS (SELECT word, word, 0 FROM chosen UNION ALL SELECT w.word, c.form, w.depth + 1 FROM walk w JOIN chosen c ON c.word = w.here WHERE c.form IS NOT NULL)
SELECT c.word, form, r.root, n, n_near, form_n FROM chosen c JOIN (SELECT word, last(here ORDER BY depth) AS root FROM walk GROUP BY word) r ON r.word = c.word
"""


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = shared.written(words(shared.table(spark, sf_dir, "documents").select("doc_id", "text")), "variants-words")
    return forms(vocabulary, near(vocabulary))
