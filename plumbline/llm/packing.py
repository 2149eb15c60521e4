"""Lexical retrieval packing: windows filled with the seed's nearest unused documents.

Documents are encoded once, in the order in which the scan gives them, and cut
into shards of at most ``SHARD_TOKENS`` ids (a longer document lies in several), each
a row of a table in the shared folder.  Document frequencies and the mean length
are summed over all shards, a document's later pieces by the terms that its earlier ones
lack; the vocabulary bounds that table.  Then every shard has
its own BM25 inverted index.  A window begins with the rest of the last document, or
else the next unused one, as seed; all its terms are looked up,
and the best unused documents follow until the window is full.  The last one is
cut, and its rest is the next seed.  What is left at a shard's end becomes windows of
powers of two, so that no place is padded.

A null text is empty and has the end id only.  Null ids stay null.  Repeated rows are
documents of their own.  Empty tables give no rows.  Only doc_id and text are read,
so other columns cannot clash.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, tokens

WINDOW = 2048
SHARD_TOKENS = 1 << 20
K1, B = 1.2, 0.75
END_ID = 1

SHARDS = "part int, shard int, doc_id array<long>, start array<long>, doc_tokens array<long>, sizes array<int>, terms array<int>, df array<int>, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def term_counts(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, document, count) of every distinct pair, by term."""
    documents = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
    key = ids.astype(np.int64) * max(len(sizes), 1) + documents
    key.sort()
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first] // max(len(sizes), 1), key[first] % max(len(sizes), 1), np.diff(np.append(first, len(key)))


def shards(documents: DataFrame, vocabulary: str, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode all documents; a row for every shard."""
    schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("doc_id", pa.list_(pa.int64())), ("start", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("terms", pa.list_(pa.int32())), ("df", pa.list_(pa.int32())), ("ids", pa.binary())])

    def cut(batches):
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        encode = tokens.encoder(vocabulary).encode
        held, about, n = [], [], 0
        # Terms of the earlier pieces of the document that crosses into this shard.
        before = np.zeros(0, np.int64)
        end = np.array([END_ID], np.uint32)

        def row() -> pa.RecordBatch:
            nonlocal before
            ids = np.concatenate(held)
            sizes = np.array([len(x) for x in held], np.int64)
            terms, documents, _ = term_counts(ids, sizes)
            starts = np.array([a[1] for a in about])
            # Of a document that goes on from the last shard, only terms that are new in this piece count.
            fresh = (starts[documents] == 0) | ~np.isin(terms, before)
            own, df = np.unique(terms[fresh], return_counts=True)
            # Only the last document can go on; in the shard's first place it may have gone on before, too.
            last = terms[documents == len(held) - 1]
            before = np.union1d(before, last) if starts[-1] else last
            doc, start, total = zip(*about, strict=True)
            return pa.RecordBatch.from_pylist([{"part": part, "shard": number, "doc_id": list(doc), "start": list(start), "doc_tokens": list(total), "sizes": sizes.tolist(), "terms": own.tolist(), "df": df.tolist(), "ids": ids.astype("<u4").tobytes() if ids.max() > 65535 else ids.astype("<u2").tobytes()}], schema)

        for batch in tokens.text_batches(batches):
            ids, offsets = encode(tokens.column(batch, "text"))
            for i, doc_id in enumerate(tokens.column(batch, "doc_id").to_pylist()):
                own, at = np.concatenate([ids[offsets[i] : offsets[i + 1]], end]), 0
                while at < len(own):
                    take = min(len(own) - at, shard_tokens - n)
                    held.append(own[at : at + take])
                    about.append((doc_id, at, len(own)))
                    n, at = n + take, at + take
                    if n == shard_tokens:
                        yield row()
                        number, n = number + 1, 0
                        held.clear()
                        about.clear()
        if n:
            yield row()

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, SHARDS)


class Index:
    """BM25 over the documents of one shard."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, idf: np.ndarray, mean: float):
        terms, documents, counts = term_counts(ids, sizes)
        scale = K1 * (1 - B + B * sizes / mean)
        self.n = len(sizes)
        self.documents = documents
        self.weights = idf[terms] * counts * (K1 + 1) / (counts + scale[documents])
        self.starts = np.searchsorted(terms, np.arange(len(idf) + 1))
        # Every document's terms are its query.
        by = np.argsort(documents, kind="stable")
        self.query_terms = terms[by]
        self.query_at = np.searchsorted(documents[by], np.arange(self.n + 1))

    def neighbours(self, seed: int, used: np.ndarray) -> np.ndarray:
        """Unused documents that share a query term with the seed, the best first; ties in document order."""
        query = self.query_terms[self.query_at[seed] : self.query_at[seed + 1]]
        runs = [slice(self.starts[t], self.starts[t + 1]) for t in query.tolist()]
        scores = np.bincount(np.concatenate([self.documents[r] for r in runs]), np.concatenate([self.weights[r] for r in runs]), minlength=self.n)
        scores[used] = 0
        found = np.flatnonzero(scores)
        return found[np.argsort(-scores[found], kind="stable")]


def pack(ids: np.ndarray, sizes: np.ndarray, idf: np.ndarray, mean: float, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(document, place in it, length, sequence, offset) of every piece of one shard."""
    index = Index(ids, sizes, idf, mean)
    used = np.zeros(len(sizes), bool)
    out: list[tuple[int, int, int, int, int]] = []
    left, following = int(sizes.sum()), 0
    seed, place, sequence = -1, 0, 0
    listed = sizes.tolist()
    while left:
        # The last tokens of a shard make windows of powers of two.
        room = window if left >= window else 1 << left.bit_length() - 1
        offset = 0
        if seed < 0:
            while used[following]:
                following += 1
            seed, place = following, 0
            used[seed] = True
        first, near = seed, None
        while offset < room:
            take = min(listed[seed] - place, room - offset)
            if take:
                out.append((seed, place, take, sequence, offset))
            offset, place = offset + take, place + take
            if place < listed[seed]:
                break
            seed = -1
            if offset < room:
                if near is None:
                    near = iter(index.neighbours(first, used).tolist())
                seed = next((x for x in near if not used[x]), -1)
                while seed < 0:
                    while used[following]:
                        following += 1
                    seed = following
                used[seed], place = True, 0
        left -= offset
        sequence += 1
    return out


def packed(documents: DataFrame, vocabulary: str, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The pieces of all documents (doc_id, text); see the contract of the query for the columns."""
    spark = documents.sparkSession
    table = shared.written(shards(documents, vocabulary, shard_tokens), "packing-shards")
    # One row for each id of the vocabulary at most.
    found = table.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy("x.terms").agg(F.sum("x.df").alias("df")).toArrow()
    total = table.select(F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x).alias("n"), F.size(F.filter("start", lambda x: x == 0)).alias("d")).agg(F.sum("n"), F.sum("d")).first()
    ids_seen, count = np.asarray(found["terms"]), max(total[1] or 0, 1)
    df = np.zeros(int(ids_seen.max()) + 1 if len(ids_seen) else 1)
    df[ids_seen] = np.asarray(found["df"])
    idf = np.log1p((count - df + 0.5) / (df + 0.5))
    held = spark.sparkContext.broadcast((idf, (total[0] or 1) / count))

    def pieces(batches):
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.array(row["sizes"], np.int64)
                ids = np.frombuffer(row["ids"], "<u2" if len(row["ids"]) == 2 * sizes.sum() else "<u4").astype("<u4")
                raw, ends = memoryview(ids.tobytes()), np.cumsum(sizes)
                begins = (ends - sizes).tolist()
                base = (row["part"] << 40) + (row["shard"] << 16)
                got = pack(ids, sizes, *held.value, window)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array([row["doc_id"][d] for d, *_ in got], pa.int64()),
                        "start": pa.array([row["start"][d] + p for d, p, *_ in got], pa.int64()),
                        "length": pa.array([n for _, _, n, _, _ in got], pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(raw[4 * (begins[d] + p) : 4 * (begins[d] + p + n)]) for d, p, n, _, _ in got], pa.int64()),
                        "doc_tokens": pa.array([row["doc_tokens"][d] for d, *_ in got], pa.int64()),
                        "sequence_id": pa.array([base + s for _, _, _, s, _ in got], pa.int64()),
                        "offset": pa.array([o for *_, o in got], pa.int64()),
                    }
                )

    return table.select("part", "shard", "doc_id", "start", "doc_tokens", "sizes", "ids").mapInArrow(pieces, PIECES)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(shared.table(spark, sf_dir, "documents"), tokens.vocabulary_path())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all ``docs``, in place of them: null texts are empty, null ids stay null, other columns are not read."""
    return packed(docs, tokens.vocabulary_path())
