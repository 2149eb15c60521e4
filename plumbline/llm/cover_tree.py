"""Exact top-k inner products by dual-tree search over cover trees.

Vectors are turned into whole numbers floor(256 x).  All rows, queries and
candidates together, are dealt to cells around pivots (a bounded set of vectors
chosen by the hash of their contents); a cell of more than ``CHUNK`` rows is cut
into chunks by a hash of the id, so a hot vector or cell is spread.  Every chunk is
indexed by a cover tree (levels, covering and separation as ``Tree`` says).

Search is in two steps.  Each query first meets the chunk it lies in; the worst
kth score there bounds what it still needs.  Then blocks of queries, indexed by a
tree of their own, meet every other chunk: pairs of nodes are pruned when the
largest inner product that their points and radii allow is below the worst kth
score of all queries under the query node.  The chunk as a whole is the first node
tested, before any row is sent to it.  The best of all chunks are merged.

A stated query set is held against all rows, in blocks of ``QUERY_BLOCK`` queries.
Vectors that are null or hold a null or non-finite component take no part; rows
of several lengths are compared within their length.  A null id takes no part.
Rows that repeat an id are candidates each, but for a query of that id; queries that repeat an id are answered as one,
by the best of all their rows' scores, in which a candidate may come once for each.  Ties go to the smaller id.
Scores are compared as whole numbers; where products may pass a long, they are Python's integers.  A component of
2^54 or more, or a score among the best that does not fit a long, is an error.  Empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import shared

PIVOTS = 32
CHUNK = 2048
QUERY_BLOCK = 1024
LEAF = 16
#: Leaves whose points are scored at once.
BATCH = 64
#: Bytes of chunks' balls that are broadcast at most.
BROADCAST_BYTES = 64 << 20
SALTS = 32
#: Whole components are smaller than this; numpy multiplies as long as no sum of products can reach LONG.
LARGEST, LONG = float(1 << 62), 1 << 63
#: No score is below this.
NONE = -LONG


class Tree:
    """A cover tree over the rows of an integer matrix; nodes hold slices of ``order``.

    A node of level i covers its points within 2^i of its own point.  Its children are of lower levels, the first has
    its point, any two are more than 2^(i - 1) apart, and each point is in the nearest child, which is within 2^(i - 1).
    A node's level is the least that covers its points, so chains of single children are left out; ``LEAF`` points
    or equal ones are not divided.  Radii are the true largest distances.
    """

    def __init__(self, points: np.ndarray):
        self.points = points.astype(np.float64)
        self.norms = np.linalg.norm(self.points, axis=1)
        self.order = np.arange(len(points))
        self.nodes: list[tuple[int, int, int, float, int, np.ndarray]] = []  # point, start, end, radius, level, children
        if len(points):
            self._build(0, len(points), 0)

    def _build(self, lo: int, hi: int, centre: int) -> int:
        own = self.order[lo:hi]
        distance = np.linalg.norm(self.points[own] - self.points[centre], axis=1)
        radius, me = float(distance.max()), len(self.nodes)
        level = math.ceil(math.log2(radius)) if radius else -1
        self.nodes.append((centre, lo, hi, radius, level, np.zeros(0, np.int64)))
        if hi - lo <= LEAF or not radius:
            return me
        # Every point that no child covers yet becomes one, the farthest first.
        reach, centres, best, nearest = 2.0 ** (level - 1), [centre], distance.copy(), np.zeros(hi - lo, np.int64)
        while best.max() > reach:
            far = int(best.argmax())
            d = np.linalg.norm(self.points[own] - self.points[own[far]], axis=1)
            closer = d < best
            nearest[closer], best = len(centres), np.minimum(best, d)
            centres.append(int(own[far]))
        self.order[lo:hi] = own[np.argsort(nearest, kind="stable")]
        cuts = np.concatenate([[0], np.cumsum(np.bincount(nearest, minlength=len(centres)))]) + lo
        children = [self._build(x, y, c) for c, x, y in zip(centres, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if y > x]
        self.nodes[me] = (centre, lo, hi, radius, level, np.array(children, np.int64))
        return me

    def rows(self, node: int) -> np.ndarray:
        return self.order[self.nodes[node][1] : self.nodes[node][2]]


def upper(q: np.ndarray, q_radius: float, centres: np.ndarray, norms: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """The largest inner products of a point near q and points near each of the centres, rounded up."""
    size = np.linalg.norm(q)
    bound = centres @ q + size * radii + norms * q_radius + q_radius * radii
    return bound + ((size + q_radius) * (norms + radii)) * 1e-12 + 1e-6


class Best:
    """The k best (score, id) of every query, ties to the smaller id; scores are whole numbers throughout."""

    def __init__(self, ids: np.ndarray, k: int, floor: np.ndarray):
        self.ids, self.k = ids, k
        self.score = np.full((len(ids), k), np.iinfo(np.int64).min)
        self.other = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.floor = floor  # what a candidate must reach, from elsewhere

    def need(self, rows: np.ndarray) -> float:
        """The least score that any of ``rows`` still needs; bounds are rounded up by more than this is."""
        return float(np.maximum(self.score[rows, -1], self.floor[rows]).min())

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        score = np.concatenate([self.score[rows], np.where(self.ids[rows][:, None] == ids[None, :], np.iinfo(np.int64).min, scores)], axis=1)
        other = np.concatenate([self.other[rows], np.broadcast_to(ids, (len(rows), len(ids)))], axis=1)
        other = np.where(score == np.iinfo(np.int64).min, np.iinfo(np.int64).max, other)
        # The complement turns the order around, and every long has one.
        order = np.lexsort((other, ~score), axis=1)[:, : self.k]
        self.score[rows], self.other[rows] = np.take_along_axis(score, order, 1), np.take_along_axis(other, order, 1)

    def filled(self) -> np.ndarray:
        return self.score > np.iinfo(np.int64).min


class WideBest(Best):
    """The same for scores of any size, as Python's integers; None stands for no candidate yet."""

    def __init__(self, ids: np.ndarray, k: int, floor: np.ndarray):
        super().__init__(ids, k, floor)
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]

    def need(self, rows: np.ndarray) -> float:
        return min(max(float(-self.best[r][-1][0]) if len(self.best[r]) == self.k else -math.inf, -math.inf if self.floor[r] == NONE else float(self.floor[r])) for r in rows.tolist())

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        for r, line in zip(rows.tolist(), scores.tolist(), strict=True):
            own = self.ids[r]
            self.best[r] = sorted([*self.best[r], *((-s, i) for s, i in zip(line, ids.tolist(), strict=True) if i != own)])[: self.k]

    def filled(self) -> np.ndarray:
        for r, found in enumerate(self.best):
            if any(not -LONG <= -s < LONG for s, _ in found):
                raise OverflowError("a score does not fit a long")
            for j, (s, i) in enumerate(found):
                self.score[r, j], self.other[r, j] = -s, i
        return np.arange(self.k)[None, :] < np.array([len(x) for x in self.best], np.int64)[:, None]


def search(queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray) -> Best:
    """Dual-tree search of all queries among all points."""
    if not len(queries) or not len(points):
        return Best(query_ids, k, floor)
    most = int(np.abs(queries).max(initial=0)) * int(np.abs(points).max(initial=0)) * queries.shape[1]
    wide = most >= LONG
    best = (WideBest if wide else Best)(query_ids, k, floor)
    a, b = Tree(queries), Tree(points)
    exact_q, exact_p = (x.astype(object if wide else np.int64) for x in (queries, points))
    point, radius = (np.array([n[k] for n in b.nodes]) for k in (0, 3))
    leaf = np.array([not len(n[5]) for n in b.nodes])
    bounds = lambda x, ys: upper(a.points[a.nodes[x][0]], a.nodes[x][3], b.points[point[ys]], b.norms[point[ys]], radius[ys])
    stack = [(0, np.zeros(1, np.int64))]
    while stack:
        # A query node meets a set of data nodes; those that no query under it needs go.
        x, ys = stack.pop()
        bound, rows = bounds(x, ys), a.rows(x)
        ys = ys[np.argsort(-bound, kind="stable")][: int((bound >= best.need(rows)).sum())]
        if not len(ys):
            continue
        inner = ys[~leaf[ys]]
        if len(a.nodes[x][5]) and (not len(inner) or a.nodes[x][3] > radius[inner].max()):
            stack += [(int(c), ys) for c in a.nodes[x][5]]
            continue
        if len(inner):
            # Leaves wait below the children of the widest nodes, which are looked at first.
            if leaf[ys].any():
                stack.append((x, ys[leaf[ys]]))
            stack.append((x, np.concatenate([b.nodes[y][5] for y in inner.tolist()])))
            continue
        for at in range(0, len(ys), BATCH):
            cols = np.concatenate([b.rows(y) for y in ys[at : at + BATCH].tolist()])
            best.add(rows, exact_q[rows] @ exact_p[cols].T, ids[cols])
    return best


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, np.int64) for v in column]) if len(column) else np.zeros((0, 1), np.int64)


_FOUND = "query_id long, vec_id long, score long"


def _rows(best: Best) -> pd.DataFrame:
    keep = best.filled()
    return pd.DataFrame({"query_id": np.repeat(best.ids, best.k)[keep.ravel()], "vec_id": best.other[keep], "score": best.score[keep]})


def top_k(vectors: DataFrame, is_query, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score for rows (vec_id, embedding) for which ``is_query`` holds, among all other rows."""
    clean = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(
        ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    )
    # A larger component is an error, not a wrong score.
    small = lambda x: F.when(F.abs(x) < LARGEST, F.floor(x)).otherwise(F.raise_error(F.lit("a component is too large for whole-number scores")).cast("long"))
    whole = clean.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: small(x.cast("double") * 256.0)).alias("v"), is_query.alias("is_query")).withColumn("dim", F.size("v"))
    pivots = [(r["dim"], r["v"]) for r in whole.select("dim", "v", F.xxhash64("v", F.lit(3)).alias("h")).distinct().orderBy("h").limit(PIVOTS).collect()]
    held = {d: np.array([v for e, v in pivots if e == d], np.float64) for d in {d for d, _ in pivots}}

    def cells(batches):
        for batch in batches:
            m = batch.column("v").to_pylist()
            out = []
            for v, d in zip(m, batch.column("dim").to_pylist(), strict=True):
                p = held.get(d)
                out.append(-1 if p is None or not d else int(((p - np.asarray(v)) ** 2).sum(1).argmin()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], names=[*batch.schema.names, "cell"])

    placed = shared.written(whole.mapInArrow(cells, "vec_id long, v array<long>, is_query boolean, dim int, cell int"), "cover-cells")
    counts = placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    chunked = placed.join(counts, ["dim", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int"))
    chunked = shared.written(chunked.select("vec_id", "v", "is_query", "dim", "cell", "chunk"), "cover-chunks")
    key = ["dim", "cell", "chunk"]

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        points, ids, q = _matrix(pdf["v"]), pdf["vec_id"].to_numpy(), pdf["is_query"].to_numpy(dtype=bool)
        return _rows(search(points[q], ids[q], points, ids, k, np.full(int(q.sum()), NONE)))

    def about(pdf: pd.DataFrame) -> pd.DataFrame:
        points = _matrix(pdf["v"]).astype(np.float64)
        centre = points.mean(0)
        return pd.DataFrame([{"dim": pdf["dim"].iloc[0], "cell": pdf["cell"].iloc[0], "chunk": pdf["chunk"].iloc[0], "centre": centre.tolist(), "radius": float(np.linalg.norm(points - centre, axis=1).max())}])

    first = shared.written(chunked.groupBy(*key).applyInPandas(own, _FOUND), "cover-first")
    worst = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    chunks = shared.written(chunked.groupBy(*key).applyInPandas(about, "dim int, cell int, chunk int, centre array<double>, radius double"), "cover-balls")
    queries = chunked.filter("is_query").join(worst, chunked["vec_id"] == worst["query_id"], "left").select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv"), "dim", F.col("cell").alias("qcell"), F.col("chunk").alias("qchunk"), F.coalesce("floor", F.lit(NONE)).alias("floor"))
    # Cells that lie beside each other share a block while they have few queries; a cell of many has several.
    blocks_of = queries.groupBy("dim", "qcell").agg(F.count("*").alias("_q"))
    before = F.sum("_q").over(Window.partitionBy("dim").orderBy("qcell")) - F.col("_q")
    blocks_of = blocks_of.select("dim", "qcell", F.ceil(F.col("_q") / QUERY_BLOCK).cast("int").alias("qblocks"), F.floor(before / QUERY_BLOCK).alias("qgroup"))
    queries = shared.written(queries.join(F.broadcast(blocks_of), ["dim", "qcell"]), "cover-queries")  # a row for each pivot at most
    # The stated query set against all chunks: the bound of the chunk's ball is tested before a query is sent there.
    dot = F.aggregate(F.zip_with("qv", "centre", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    # What doubles lose in the sum is in proportion to the lengths, not to the bound.
    bound = dot + norm("qv") * F.col("radius") + norm("qv") * (norm("centre") + F.col("radius")) * 1e-12 + 1e-6
    # Balls are one row for CHUNK vectors: broadcast if counted small enough, else queries are dealt over salts.
    dims = 8 * (whole.agg(F.max("dim")).first()[0] or 0) + 48
    if chunks.count() * dims <= BROADCAST_BYTES:
        met = queries.repartition(shared.partitions(vectors.sparkSession), "query_id").join(F.broadcast(chunks), "dim")
    else:
        copies = chunks.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        met = queries.withColumn("salt", F.pmod(F.xxhash64("query_id"), F.lit(SALTS))).join(copies, ["dim", "salt"])
    sent = met.filter((F.col("cell") != F.col("qcell")) | (F.col("chunk") != F.col("qchunk"))).filter(bound >= F.col("floor"))
    # A task gets one block of queries of one cell and one chunk, so its rows stay bounded; a chunk goes to the blocks that need it.
    sent = sent.select(F.col("dim").alias("d"), F.col("cell").alias("c"), F.col("chunk").alias("h"), "qgroup", F.pmod(F.xxhash64("query_id", F.lit(11)), F.col("qblocks")).cast("int").alias("b"), "query_id", "qv", "floor")
    sent = shared.written(sent, "cover-sent")
    needed = sent.select(F.col("d").alias("dim"), F.col("c").alias("cell"), F.col("h").alias("chunk"), F.col("qgroup").alias("qg"), F.col("b").alias("block")).distinct()
    dealt = chunked.select(*key, "vec_id", "v").join(needed, key)

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        points, ids = _matrix(right["v"]), right["vec_id"].to_numpy()
        return _rows(search(_matrix(left["qv"]), left["query_id"].to_numpy(), points, ids, k, left["floor"].to_numpy(np.int64)))

    second = sent.groupBy("d", "c", "h", "qgroup", "b").cogroup(dealt.groupBy(*key, "qg", "block")).applyInPandas(meet, _FOUND)
    both = first.unionByName(second)
    best = both.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int"))
    return best.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(shared.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


#: Brute force in SQL, over the whole table.
SQL = """WITH v AS (SELECT vec_id, [CAST(floor(256 * x::DOUBLE) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
 WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([a * b FOR a, b IN list_zip(q.e, c.e)]) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""
SQL = SQL.replace("list_sum([a * b FOR a, b IN list_zip(q.e, c.e)])", "list_dot_product(q.e::DOUBLE[], c.e::DOUBLE[])")
