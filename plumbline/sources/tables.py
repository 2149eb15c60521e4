"""Reading tables and files with their order columns, and the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local folder only where it is unset on one machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def files(spark: SparkSession, path: str) -> DataFrame:
    """file_id (name without ending), path, checksum_sha256, size, is_pdf of every file at ``path``."""
    raw = spark.read.format("binaryFile").load(path)
    name = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    return raw.select(name.alias("file_id"), "path", F.sha2("content", 256).alias("checksum_sha256"), F.col("length").alias("size"), (F.substring("content", 1, 5) == F.lit(b"%PDF-")).alias("is_pdf"))


def lines(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, line_ord, line of every line."""
    return df.select(*keys, F.posexplode(F.split(text, "\n")).alias("line_ord", "line"))


def words(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, pos, word of every word between white space."""
    return df.select(*keys, F.posexplode(F.filter(F.split(text, r"\s+"), lambda w: w != "")).alias("pos", "word"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to a fresh table in the shared folder and read it again: what is used several times is made once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, most: int, keys: list[str]) -> DataFrame:
    """``df`` dealt by ``keys`` over tasks of some ``most`` rows: where bytes are few, Spark would leave too few tasks by bytes."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // most)), *keys)
