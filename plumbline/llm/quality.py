"""Ordinal cumulative-link quality classifier over hashed text.

Grades are ordered: 0 toxic, 1 poor, 2 good.  P(grade <= j) is
sigmoid(theta_j - w.x) with one weight vector for all grades and increasing
thresholds theta, so a text has an expected grade and a tail probability
P(grade >= 2).  x tells which hashed features occur in the text (lower-case words,
their first four and five letters, and the marks and capitals that words carry),
and has a few dense measures (length, repetition, marks, capitals).  Only
features whose share differs between grades by ``least_z`` standard errors have a
weight; the others' weights are zero and are not stored.

Fitting takes at most ``sample_rows`` labelled rows (those with the least hash of
their id), a documented bound; scoring reads every row and whole texts.  Nulls: a
null text scores as the empty one; a row with a null label or id is not fitted.
With one grade only, every text gets the prior grade; without rows to fit, the best.
Repeated rows are scored each; of several labels of one id the lowest grade counts.
Empty tables give no rows.  Columns are read by name, and results have names of
their own, which the input must not use.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared, tokens

#: Labelled rows that are fitted at most.  The driver gets their distinct feature hashes.
SAMPLE_ROWS = 8_000
GRADES = 3
DENSE = 8
#: A document goes when its expected grade is under this.
LEAST_GRADE = 1.3


@dataclass(frozen=True)
class Model:
    features: np.ndarray  # hashes that have a weight, ascending
    weights: np.ndarray  # of those, then of the dense measures
    thresholds: np.ndarray

    def grades(self, margin: np.ndarray) -> np.ndarray:
        """P(grade = j) by row."""
        below = 1 / (1 + np.exp(np.clip(margin[:, None] - self.thresholds[None, :], -500, 500)))
        below = np.concatenate([np.zeros((len(margin), 1)), below, np.ones((len(margin), 1))], axis=1)
        return np.maximum(np.diff(below, axis=1), 0)

    def margin(self, rows: np.ndarray, hashes: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """w.x by row, for (row, hash) pairs without repetition."""
        n = len(self.features)
        out = dense @ self.weights[n:]
        if n and len(rows):
            at = np.minimum(np.searchsorted(self.features, hashes), n - 1)
            hit = self.features[at] == hashes
            out = out + np.bincount(rows[hit], self.weights[at[hit]], minlength=len(dense))
        return out


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, number of hashes of each word)."""
    import xxhash

    digest = xxhash.xxh32_intdigest
    flat, counts = [], []
    for word in words:
        letters = word if word.isalpha() else "".join([c for c in word if c.isalpha()])
        low = letters.lower()
        n = len(flat)
        if low:
            flat.append(digest(low))
            if len(low) > 4:
                flat.append(digest(low[:4] + "*"))
                flat.append(digest(low[:5] + "*"))
            if len(low) > 1 and letters.isupper():
                flat.append(digest("^"))
        if len(letters) < len(word):
            flat += [digest(c + "|") for c in {"9" if c.isdigit() else c for c in word if not c.isalpha()}]
        counts.append(len(flat) - n)
    return np.array(flat, np.uint32), np.array(counts, np.int64)


def features(texts: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash) pairs of the distinct features of every text, of ``wanted`` ones only if given, and the dense measures."""
    codes, words, offsets = tokens.split_words(texts)
    flat, counts = word_features(words.to_pylist())
    if wanted is not None:
        keep = np.isin(flat, wanted)
        counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[keep], minlength=len(counts))
        flat = flat[keep]
    hashes, bounds = tokens.gather(codes, np.cumsum(counts) - counts, counts, flat, offsets)
    n = len(offsets) - 1
    key = np.unique(np.repeat(np.arange(n, dtype=np.uint64), np.diff(bounds)) << np.uint64(32) | hashes.astype(np.uint64))
    size = np.diff(offsets)
    some = np.maximum(size, 1)
    of_row = np.repeat(np.arange(n), size)
    mean = lambda x: np.bincount(of_row, np.asarray(x).astype(float)[codes], minlength=n) / some
    kinds = max(len(words), 1)
    pair = of_row * kinds + codes
    pair.sort()
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    row, times = pair[first] // kinds, np.diff(np.append(first, len(pair)))
    top = np.zeros(n)
    np.maximum.at(top, row, times)
    dense = [
        np.log1p(size) / 10,
        np.bincount(row, minlength=n) / some,
        mean(np.minimum(np.asarray(pc.utf8_length(words)), 40) / 10),
        mean(pc.invert(pc.utf8_is_alnum(pc.utf8_rtrim(words, ".,")))),
        mean(pc.and_(pc.utf8_is_upper(words), pc.greater(pc.utf8_length(words), 2))),
        mean(pc.match_substring_regex(words, "[0-9]")),
        top / some,
        (size == 0).astype(float),
    ]
    return (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.stack(dense, axis=1)


def select(rows: np.ndarray, hashes: np.ndarray, grades: np.ndarray, least_z: float) -> np.ndarray:
    """Hashes whose share of texts differs between toxic and other texts, or between poor and good ones."""
    # Hash and grade are sorted together, in place: the place of each hash would take several times the driver's memory.
    key = hashes.astype(np.uint64)
    key <<= np.uint64(8)
    key |= grades.astype(np.uint8)[rows]
    key.sort()
    own, grade = (key >> np.uint64(8)).astype(np.uint32), key.astype(np.uint8)
    del key
    first = np.flatnonzero(np.concatenate([np.ones(min(len(own), 1), bool), own[1:] != own[:-1]]))
    own = own[first]
    n = np.bincount(grades, minlength=GRADES).astype(float)
    seen = np.stack([np.add.reduceat(grade == g, first, dtype=np.int64) if len(first) else np.zeros(0) for g in range(GRADES)], axis=1).astype(float)

    def z(a: np.ndarray, of_a: float, b: np.ndarray, of_b: float) -> np.ndarray:
        if not of_a or not of_b:
            return np.zeros(len(a))
        share = (a + b + 1) / (of_a + of_b + 2)
        return np.abs(a / of_a - b / of_b) / np.sqrt(share * (1 - share) * (1 / of_a + 1 / of_b))

    best = np.maximum(z(seen[:, 0], n[0], seen[:, 1] + seen[:, 2], n[1] + n[2]), z(seen[:, 1], n[1], seen[:, 2], n[2]))
    best[seen.sum(1) < 3] = 0
    return own[best >= least_z]


def found(own: np.ndarray, rows: np.ndarray, hashes: np.ndarray, step: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """The rows of those of ``hashes`` that are in ``own`` (ascending), and their places there; some at a time."""
    kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for k in range(0, len(hashes) if len(own) else 0, step):
        some = hashes[k : k + step]
        at = np.minimum(np.searchsorted(own, some), len(own) - 1)
        hit = own[at] == some
        kept.append((rows[k : k + step][hit].astype(np.int64), at[hit]))
    return np.concatenate([r for r, _ in kept]), np.concatenate([a for _, a in kept])


def fit_arrays(rows: np.ndarray, hashes: np.ndarray, dense: np.ndarray, grades: np.ndarray, least_z: float = 4.5, rounds: int = 400, rate: float = 0.1, decay: float = 3e-4) -> Model:
    """Maximum likelihood with Adam over all given texts; rare grades weigh more, by the root of their rarity."""
    shares = np.bincount(grades, minlength=GRADES)
    total = np.cumsum((shares + 0.5) / (shares.sum() + 0.5 * GRADES))[:-1]
    theta = np.log(total / (1 - total))
    if (shares > 0).sum() < 2:
        return Model(np.zeros(0, np.uint32), np.zeros(DENSE), theta if len(grades) else np.array([-40.0, -39.0]))
    own = select(rows, hashes, grades, least_z)
    rows, at = found(own, rows, hashes)
    v = np.zeros(len(own) + DENSE)
    steps = np.concatenate([theta[:1], np.log(np.maximum(np.diff(theta), 1e-3))])
    weight = (len(grades) / np.maximum(shares, 1)) ** 0.5
    weight = weight[grades] / weight[grades].sum()
    m, s = np.zeros(len(v) + len(steps)), np.zeros(len(v) + len(steps))
    for t in range(1, rounds + 1):
        theta = np.cumsum(np.concatenate([steps[:1], np.exp(steps[1:])]))
        x = np.bincount(rows, v[at], minlength=len(dense)) + dense @ v[len(own) :]
        high, low = np.append(theta, 50.0)[grades], np.concatenate([[-50.0], theta])[grades]
        a, b = 1 / (1 + np.exp(np.clip(x - high, -50, 50))), 1 / (1 + np.exp(np.clip(x - low, -50, 50)))
        p = np.maximum(a - b, 1e-9)
        d_high, d_low = a * (1 - a) / p * weight, b * (1 - b) / p * weight
        slope = d_high - d_low  # of minus log p, by x
        d_theta = np.array([d_low[grades == j + 1].sum() - d_high[grades == j].sum() for j in range(GRADES - 1)])
        back = np.cumsum(d_theta[::-1])[::-1]
        grad = np.concatenate([np.bincount(at, slope[rows], minlength=len(own)), dense.T @ slope, back * np.concatenate([[1.0], np.exp(steps[1:])])])
        grad[: len(v)] += decay * v
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad**2
        change = rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8) * min(1.0, 2 - 2 * t / rounds)
        v -= change[: len(v)]
        steps -= change[len(v) :]
    return Model(own, v, np.cumsum(np.concatenate([steps[:1], np.exp(steps[1:])])))


def fit(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on the ``sample_rows`` labelled rows whose id has the least hash; the features are taken by tasks."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    graded = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.min(grade).alias("grade"))
    chosen = graded.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(sample_rows)

    def take(batches):
        for batch in tokens.text_batches(batches, 8 << 20):
            rows, hashes, dense = features(tokens.column(batch, "text"))
            counts = np.bincount(rows, minlength=batch.num_rows)
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            yield pa.RecordBatch.from_pydict({"doc_id": tokens.column(batch, "doc_id"), "grade": tokens.column(batch, "grade"), "hashes": pa.ListArray.from_arrays(offsets, pa.array(hashes.view(np.int32))), "dense": pa.array(list(dense), pa.list_(pa.float64()))})

    # The broadcast side has sample_rows rows of two numbers at most.
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInArrow(take, "doc_id long, grade int, hashes array<int>, dense array<double>")
    got = rows.orderBy("doc_id", F.size("hashes")).limit(sample_rows).toArrow().combine_chunks()
    if not got.num_rows:
        return fit_arrays(np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros((0, DENSE)), np.zeros(0, np.int64))
    lists = tokens.column(got, "hashes")
    return fit_arrays(np.repeat(np.arange(got.num_rows, dtype=np.int32), np.diff(np.asarray(lists.offsets))), np.asarray(lists.flatten()).view(np.uint32), np.stack(got["dense"].to_pylist()), np.asarray(got["grade"]).astype(np.int64))


def score(documents: DataFrame, model: Model, into: tuple[str, str] = ("expected_grade", "tail_probability")) -> DataFrame:
    """All columns of ``documents``, with the expected grade and the tail probability (of the best grade) as ``into``."""
    names = documents.columns
    if set(into) & set(names):
        raise ValueError(f"{' and '.join(into)} are names of results")

    def run(batches):
        for batch in tokens.text_batches(batches, 8 << 20):
            p = model.grades(model.margin(*features(tokens.column(batch, "text"), model.features)))
            new = [pa.array(p @ np.arange(GRADES)), pa.array(p[:, -1])]
            yield pa.RecordBatch.from_arrays([tokens.column(batch, c) for c in names] + new, names=[*names, *into])

    schema = T.StructType([*documents.schema.fields, *(T.StructField(c, T.DoubleType()) for c in into)])
    return documents.mapInArrow(run, schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = shared.table(spark, sf_dir, "documents")
    model = fit(documents, shared.table(spark, sf_dir, "labels"))
    scored = score(documents.select("doc_id", "text"), model)
    return scored.select("doc_id", F.round("expected_grade", 6).alias("expected_grade"), F.round("tail_probability", 6).alias("tail_probability"), (F.col("expected_grade") >= LEAST_GRADE).alias("keep"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected grade is not under ``LEAST_GRADE``, with their columns as they are.

    Null and empty texts are scored as the empty text; result columns have names of their own and are dropped, whatever
    the input's names are.  The model is that of the whole ``documents`` table, so a stage before this one changes nothing.
    """
    model = fit(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "labels"))
    grade, tail = shared.free_names(docs, "expected_grade", "tail_probability")
    return score(docs, model, (grade, tail)).filter(F.col(grade) >= LEAST_GRADE).select(*docs.columns)
