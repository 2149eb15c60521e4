"""Token-id output: one wavelet matrix file per shard, written in document order and read back.

``write`` encodes every text, range-partitions the documents by id and cuts each
partition's stream of ids into shards of at most ``shard_ids`` ids; a document
longer than a shard lies in several.  A shard is one row (directory columns and
the file's bytes), so Spark's own writers and readers carry it on any store.
``read`` decodes the files and gives a row per document.

Nulls: a null text is empty and has only the end id; a null id sorts first.
Ties and repeated rows: each row is a document of its own, in order of its text.
Empty tables give no shards and no rows.  Other columns are not read, so their
names cannot clash.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import shared, tokens
from .wavelet import WaveletMatrix, build

#: Ids in a shard at most; it bounds a task's memory.
SHARD_IDS = 1 << 20

SHARDS = "part int, shard int, first_document long, ids long, doc_id array<long>, null_id array<boolean>, pieces array<long>, continued boolean, ends boolean, file binary"


class _Cutter:
    """Cuts one partition's stream of documents into shards."""

    def __init__(self, part: int, shard_ids: int):
        self.part, self.size, self.shard, self.document = part, shard_ids, 0, 0
        self._clear(False)

    def _clear(self, continued: bool) -> None:
        self.held, self.doc, self.pieces, self.n, self.first, self.continued = [], [], [], 0, self.document, continued

    def row(self, ends: bool) -> dict:
        ids = np.concatenate(self.held)
        row = {"part": self.part, "shard": self.shard, "first_document": self.first, "ids": len(ids), "doc_id": [x or 0 for x in self.doc], "null_id": [x is None for x in self.doc], "pieces": self.pieces, "continued": self.continued, "ends": ends, "file": build(ids)}
        self.shard += 1
        return row

    def add(self, doc_id, ids: np.ndarray):
        at = 0
        while True:
            take = min(len(ids) - at, self.size - self.n)
            self.held.append(ids[at : at + take])
            self.doc.append(doc_id)
            self.pieces.append(take)
            self.n += take
            at += take
            if self.n == self.size:
                yield self.row(at == len(ids))
                self.document += at == len(ids)
                self._clear(at < len(ids))
                if at == len(ids):
                    return
            elif at == len(ids):
                self.document += 1
                return


def write(documents: DataFrame, path: str, vocabulary: str, end_id: int = 2, shard_ids: int = SHARD_IDS) -> None:
    """Encode ``documents`` (doc_id, text) and write the shards as a table at ``path``, in ascending doc_id order."""
    schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("first_document", pa.int64()), ("ids", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("null_id", pa.list_(pa.bool_())), ("pieces", pa.list_(pa.int64())), ("continued", pa.bool_()), ("ends", pa.bool_()), ("file", pa.binary())])

    def cut(batches):
        from pyspark import TaskContext

        cutter = _Cutter(TaskContext.get().partitionId(), shard_ids)
        encode = tokens.encoder(vocabulary).encode
        end = np.array([end_id], np.uint32)
        for held in tokens.text_batches(batches):
            ids, offsets = encode(tokens.column(held, "text"))
            for i, doc_id in enumerate(tokens.column(held, "doc_id").to_pylist()):
                for row in cutter.add(doc_id, np.concatenate([ids[offsets[i] : offsets[i + 1]], end])):
                    yield pa.RecordBatch.from_pylist([row], schema)
        if cutter.n:
            yield pa.RecordBatch.from_pylist([cutter.row(True)], schema)

    ordered = documents.select(F.col("doc_id").cast("long"), "text").repartitionByRange(shared.partitions(documents.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(cut, SHARDS).write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the files at ``path``."""
    schema = "part int, shard int, document long, doc_id long, place long, n_tokens long, crc long, whole boolean"

    def pieces(batches):
        for batch in batches:
            for row in batch.to_pylist():
                raw = memoryview(WaveletMatrix(row["file"]).decode().astype("<u4").tobytes())
                n, last = len(row["pieces"]), len(row["pieces"]) - 1
                ends = np.cumsum(row["pieces"]).tolist()
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array([row["part"]] * n, pa.int32()),
                        "shard": pa.array([row["shard"]] * n, pa.int32()),
                        "document": pa.array(range(row["first_document"], row["first_document"] + n), pa.int64()),
                        "doc_id": pa.array([None if z else x for x, z in zip(row["doc_id"], row["null_id"], strict=True)], pa.int64()),
                        "place": pa.array([e - p for e, p in zip(ends, row["pieces"], strict=True)], pa.int64()),
                        "n_tokens": pa.array(row["pieces"], pa.int64()),
                        "crc": pa.array([zlib.crc32(raw[4 * (e - p) : 4 * e]) for e, p in zip(ends, row["pieces"], strict=True)], pa.int64()),
                        "whole": pa.array([not (i == 0 and row["continued"]) and (i < last or row["ends"]) for i in range(n)], pa.bool_()),
                    }
                )

    @F.pandas_udf(T.LongType())
    def joined(found):
        out = []
        for parts in found:
            crc = 0
            for p in sorted(parts, key=lambda x: x["shard"]):
                crc = shared.crc_join(crc, p["crc"], 4 * p["n_tokens"])
            out.append(crc)
        import pandas as pd

        return pd.Series(out, dtype="int64")

    shards = spark.read.schema(SHARDS).parquet(path)
    # Ids before every shard: over the parts (one row each), then within a part.
    parts = shards.groupBy("part").agg(F.sum("ids").alias("all"))
    parts = parts.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("before_part"))
    starts = shards.select("part", "shard", (F.sum("ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("ids")).alias("before")).join(parts, "part")
    rows = shards.mapInArrow(pieces, schema).join(starts.select("part", "shard", (F.col("before") + F.col("before_part")).alias("before")), ["part", "shard"])
    rows = rows.withColumn("start", F.col("before") + F.col("place"))
    whole = rows.filter("whole").select("doc_id", "start", "n_tokens", F.col("crc").alias("ids_crc32"))
    split = rows.filter("not whole").groupBy("part", "document").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n_tokens").alias("n"), F.collect_list(F.struct("shard", "n_tokens", "crc")).alias("found"))
    return whole.unionByName(split.select("doc_id", "start", F.col("n").alias("n_tokens"), joined("found").alias("ids_crc32")))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{shared.shared_dir(spark)}/op8-{uuid.uuid4().hex}"
    write(shared.table(spark, sf_dir, "documents"), path, tokens.vocabulary_path())
    return read(spark, path)
