"""N-gram Jaccard join: MinHash banding finds candidates, full n-gram sets decide.

A document is the set of its five-word shingles (words cut at white space; a text
of fewer words is one shingle).  Documents with the same set are one
representative.  Band and row counts follow from the target recall at the least
similarity; representatives that share a band hash meet in that band's bucket.

* In a bucket of up to ``BUCKET`` rows, pairs whose MinHash signatures agree in
  ``LEAST_AGREEMENT`` of their places (six standard errors under the least
  similarity) are linked; only a spanning forest of those links leaves the task.
* A larger bucket is never gathered: its rows are linked to its least row without
  looking at the signatures, which can only add candidates.

The components of these links are candidate groups.  A group's documents are
brought together with their full n-gram sets, in blocks of ``BLOCK`` rows and pairs
of blocks, and every pair of the group is compared exactly.  A task gives counts
of links and a spanning forest, not pairs.  Classes are the components of the
verified links, named by their least document id.

Results: doc_id, class_id, n_links (other rows linked directly, copies included).
Null and blank texts have no shingles and no links, and are classes of their own.
Rows that repeat an id are taken as one document, that of one of their texts.
Null ids are dropped from the result of ``join``: nothing can refer to them.
Empty tables give no rows.  Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, tokens
from .components import components

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.9999
ROWS = 5
BUCKET = 256
BLOCK = 256
LEAST_AGREEMENT = 0.58


def band_count(rows: int = ROWS, similarity: float = SIMILARITY, recall: float = RECALL) -> int:
    """Bands that find a pair at the least similarity with the target recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


BANDS = band_count()


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: pa.Array, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the distinct shingles of every text, ascending by text; offsets of the texts)."""
    import xxhash

    codes, words, offsets = tokens.split_words(texts)
    ids = np.array([xxhash.xxh64_intdigest(w) for w in words.to_pylist()], np.uint64)
    h = ids[codes] if len(codes) else np.zeros(0, np.uint64)
    full = np.asarray(pc.not_equal(words, ""))[codes] if len(codes) else np.zeros(0, bool)
    if not full.all():
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
        h = h[full]
    count = np.diff(offsets)
    out = np.zeros(len(h), np.uint64)
    for k in range(n):
        # Word k of a shingle; past the text's end (short texts only) a fixed filler.
        at = np.arange(len(h)) + k
        inside = at < np.repeat(offsets[1:], count)
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, h[np.minimum(at, max(len(h) - 1, 0))], np.uint64(1)))
    row = np.repeat(np.arange(len(count)), count)
    keep = np.arange(len(h)) - np.repeat(offsets[:-1], count) < np.maximum(np.repeat(count, count) - n + 1, 1)
    row, out = row[keep], out[keep]
    order = np.lexsort((out, row))
    row, out = row[order], out[order]
    first = np.ones(len(out), bool)
    first[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    row, out = row[first], out[first]
    return out, np.searchsorted(row, np.arange(len(count) + 1))


def minhash(values: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """Signatures (texts x size, 32-bit) of non-empty shingle sets; empty ones get zeros."""
    rng = np.random.default_rng(20240229)
    a = rng.integers(1, 1 << 63, size, dtype=np.uint64) | np.uint64(1)
    b = rng.integers(0, 1 << 63, size, dtype=np.uint64)
    n = len(offsets) - 1
    out = np.zeros((n, size), np.uint32)
    some = np.flatnonzero(np.diff(offsets) > 0)
    if not len(some):
        return out
    starts = offsets[:-1][some]
    for k in range(size):
        x = (values * a[k] + b[k]) >> np.uint64(32)
        out[some, k] = np.minimum.reduceat(x, starts).astype(np.uint32)
    return out


def set_hashes(values: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of every shingle set, as signed numbers."""
    out = []
    for salt in (0, 0x5851F42D4C957F2D):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(values ^ np.uint64(salt)), dtype=np.uint64)])
        out.append((total[offsets[1:]] - total[offsets[:-1]]).view(np.int64))
    return out


def signatures(documents: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, set_hash (two longs; null without shingles), signature (binary) of every row."""

    def run(batches):
        for batch in tokens.text_batches(batches, 12 << 20):
            values, offsets = shingles(tokens.column(batch, "text"))
            sig = minhash(values, offsets, bands * rows)
            none = np.diff(offsets) == 0
            h1, h2 = (pa.array(h, mask=none) for h in set_hashes(values, offsets))
            yield pa.RecordBatch.from_pydict({"doc_id": tokens.column(batch, "doc_id").cast(pa.int64()), "h1": h1, "h2": h2, "signature": pa.array([x.tobytes() for x in sig], pa.binary())})

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, h1 long, h2 long, signature binary")


def _forest(adjacent: np.ndarray) -> np.ndarray:
    """Edges of a spanning forest of a boolean matrix."""
    n = len(adjacent)
    seen, edges = np.zeros(n, bool), []
    for root in range(n):
        if seen[root]:
            continue
        seen[root] = True
        front = [root]
        while front:
            i = front.pop()
            near = np.flatnonzero(adjacent[i] & ~seen)
            seen[near] = True
            front += near.tolist()
            edges += [(i, j) for j in near.tolist()]
    return np.array(edges, np.int64).reshape(-1, 2)


def candidate_links(signed: DataFrame, bands: int, rows: int, agreement: float = LEAST_AGREEMENT) -> DataFrame:
    """(a, b): links between representatives (rep, signature) that the bands find."""
    size = 4 * rows
    hashed = signed.select("rep", "signature", F.posexplode(F.array(*(F.xxhash64(F.substring("signature", i * size + 1, size)) for i in range(bands)))).alias("band", "h"))
    keys = hashed.select("rep", "band", "h")
    buckets = keys.groupBy("band", "h").agg(F.count("*").alias("n"), F.min("rep").alias("least")).filter("n > 1")
    loose = keys.join(buckets.filter(F.col("n") > BUCKET), ["band", "h"]).filter("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b"))

    # Buckets of BUCKET rows at most are gathered, and each set of rows that several bands gather once.
    small = keys.join(buckets.filter(F.col("n") <= BUCKET).select("band", "h"), ["band", "h"]).groupBy("band", "h").agg(F.array_sort(F.collect_list("rep")).alias("reps"))
    small = small.select(F.xxhash64("reps").alias("g1"), F.xxhash64(F.lit(1), "reps").alias("g2"), "reps").dropDuplicates(["g1", "g2"])
    small = small.select("g1", "g2", F.explode("reps").alias("rep")).join(signed, "rep").groupBy("g1", "g2").agg(F.collect_list("rep").alias("reps"), F.collect_list("signature").alias("signatures"))

    def near(batches):
        for batch in batches:
            out = []
            for reps, group in zip(batch.column("reps").to_pylist(), batch.column("signatures").to_pylist(), strict=True):
                sig = np.frombuffer(b"".join(group), np.uint32).reshape(len(reps), -1)
                equal = np.stack([(sig == row).sum(1) for row in sig])
                out.append(np.array(reps, np.int64)[_forest(equal >= agreement * sig.shape[1])])
            pairs = np.concatenate([np.zeros((0, 2), np.int64), *out])
            yield pa.RecordBatch.from_pydict({"a": pairs[:, 0], "b": pairs[:, 1]})

    tight = small.select("reps", "signatures").mapInArrow(near, "a long, b long")
    return loose.unionByName(tight)


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of two lists of sets, by products of occurrence matrices."""
    a, b = np.concatenate(left), np.concatenate(right)
    ra, rb = np.repeat(np.arange(len(left)), [len(x) for x in left]), np.repeat(np.arange(len(right)), [len(x) for x in right])
    own = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), np.float32)
    ka, kb = np.isin(a, own), np.isin(b, own)
    ca, cb = np.searchsorted(own, a[ka]), np.searchsorted(own, b[kb])
    ra, rb = ra[ka], rb[kb]
    step = 4096
    oa, ob = np.argsort(ca, kind="stable"), np.argsort(cb, kind="stable")
    ca, ra, cb, rb = ca[oa], ra[oa], cb[ob], rb[ob]
    for lo in range(0, len(own), step):
        x, y = np.zeros((len(left), step), np.float32), np.zeros((len(right), step), np.float32)
        i, j = np.searchsorted(ca, [lo, lo + step]), np.searchsorted(cb, [lo, lo + step])
        x[ra[i[0] : i[1]], ca[i[0] : i[1]] - lo] = 1
        y[rb[j[0] : j[1]], cb[j[0] : j[1]] - lo] = 1
        out += x @ y.T
    return out


def verify(sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b, links) for rows (rep, copies, root, blocks, block, shingles).

    Rows with b are verified links that span the group; rows without give a's links in one block pair.
    """
    # Every block meets itself and each other block of its group once, in a task of two blocks at most.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = sets.select("*", other.alias("o")).select("*", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        pdf = pdf.drop_duplicates("rep")
        left = pdf[pdf["block"] == i]
        right = left if i == j else pdf[pdf["block"] == j]
        one, two = ([np.frombuffer(x, np.uint64) for x in p["shingles"]] for p in (left, right))
        if not one or not two:
            return pd.DataFrame({"a": [], "b": [], "links": []})
        common = _overlaps(one, two)
        total = np.array([len(x) for x in one])[:, None] + np.array([len(x) for x in two])[None, :] - common
        near = common >= similarity * total - 1e-6
        if i == j:
            np.fill_diagonal(near, False)
        a, b = left["rep"].to_numpy(), right["rep"].to_numpy()
        ca, cb = left["copies"].to_numpy(), right["copies"].to_numpy()
        out = [(a, near @ cb)] + ([] if i == j else [(b, near.T @ ca)])
        if i == j:
            edges = a[_forest(near)]
        else:
            n = len(a)
            whole = np.zeros((n + len(b),) * 2, bool)
            whole[:n, n:], whole[n:, :n] = near, near.T
            edges = np.concatenate([a, b])[_forest(whole)]
        counts = pd.DataFrame({"a": np.concatenate([x for x, _ in out]), "b": pd.array([pd.NA] * sum(len(x) for x, _ in out), "Int64"), "links": np.concatenate([y for _, y in out])})
        links = pd.DataFrame({"a": edges[:, 0], "b": pd.array(edges[:, 1], "Int64"), "links": 0})
        return pd.concat([counts[counts["links"] > 0], links])

    return dealt.groupBy("root", "i", "j").applyInPandas(compare, "a long, b long, links long")


def join(documents: DataFrame, similarity: float = SIMILARITY, rows: int = ROWS, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links of every document of ``documents`` (doc_id, text)."""
    bands = band_count(rows, similarity, recall)
    rows_of = documents.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = shared.written(signatures(rows_of, bands, rows), "ngram-signatures")
    once = signed.groupBy("doc_id").agg(F.min(F.struct("h1", "h2")).alias("h")).select("doc_id", "h.h1", "h.h2")
    reps = once.filter("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    # Which row of a repeated id counts follows from its set, so both sides agree.
    rep_sets = shared.checkpoint(reps)
    rep_signed = signed.select(F.col("doc_id").alias("rep"), "h1", "h2", "signature").join(rep_sets, ["rep", "h1", "h2"]).dropDuplicates(["rep"]).select("rep", "signature")
    groups = shared.checkpoint(components(candidate_links(rep_signed, bands, rows)))
    members = groups.join(groups.groupBy("root").agg(F.count("*").alias("members")), "root").withColumnRenamed("node", "rep").join(rep_sets, "rep")
    members = members.select("rep", "root", "copies", "h1", "h2", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks")).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))

    names = ["rep", "root", "copies", "blocks", "block"]

    def sets(batches):
        for batch in tokens.text_batches(batches, 8 << 20):
            values, offsets = shingles(tokens.column(batch, "text"))
            h1, h2 = set_hashes(values, offsets)
            # Of rows that repeat an id, those with the counted set.
            same = pa.array((h1 == np.asarray(tokens.column(batch, "h1"))) & (h2 == np.asarray(tokens.column(batch, "h2"))))
            lists = pa.array([values[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([tokens.column(batch, c).filter(same) for c in names] + [lists.filter(same)], names=[*names, "shingles"])

    texts = rows_of.withColumnRenamed("doc_id", "rep").join(members, "rep")
    found = texts.select("text", "h1", "h2", *names).mapInArrow(sets, "rep long, root long, copies long, blocks int, block int, shingles binary")
    checked = shared.written(verify(found, similarity), "ngram-links")
    classes = components(checked.filter("b IS NOT NULL").select("a", "b"))
    links = checked.filter("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    by_rep = rep_sets.join(classes.withColumnRenamed("node", "rep"), "rep", "left").join(links, "rep", "left")
    by_rep = by_rep.select("h1", "h2", F.coalesce("root", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    near = once.join(by_rep, ["h1", "h2"], "left")
    return near.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(shared.table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: the one with the least id (rows without an id stay)."""
    kept = join(docs).filter("doc_id = class_id").select("doc_id")
    return docs.filter("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi").unionByName(docs.filter("doc_id IS NULL"))
