"""Reading, shared folders and checksums used by the operators of this subpackage."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each behind as many underscores as it takes to be no column of ``df``."""
    used, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; a local one where it is unset on one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Spark's setting that deletes the shuffle files of a query when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def setting(spark: SparkSession, name: str, value: str, default: str) -> Iterator[None]:
    """One of the session's settings inside; what it was (``default``, if unset) comes back."""
    before = spark.conf.get(name, default)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _shuffles_dropped(spark: SparkSession) -> AbstractContextManager[None]:
    """What is written or checkpointed inside needs its shuffle files no more once it is."""
    return setting(spark, CLEANUP, "true", "false")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    with _shuffles_dropped(df.sparkSession):
        # The setting is read where a DataFrame is made.
        return df.select("*").checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to a fresh table in the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.folder = path
    return table


def divided(df: DataFrame, name: str, by: str, most: int) -> DataFrame:
    """As ``written``, with a folder for each value of the whole number ``by``, of which there are at most ``most``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    # With a file open for each value, rows need no sorting.
    with _shuffles_dropped(spark), setting(spark, "spark.sql.maxConcurrentOutputFileWriters", str(most), "0"):
        df.write.partitionBy(by).option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.folder = path
    return table


def appended(df: DataFrame, table: DataFrame) -> DataFrame:
    """``table`` of ``written``, read again with the rows of ``df`` added; ``df`` does not read it."""
    spark = df.sparkSession
    with _shuffles_dropped(spark):
        df.select(*table.columns).write.mode("append").option("compression", "zstd").parquet(table.folder)
    whole = spark.read.schema(table.schema).parquet(table.folder)
    whole.folder = table.folder
    return whole


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more: what was made of them is a written table itself."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        path = jvm.org.apache.hadoop.fs.Path(df.folder)
        path.getFileSystem(conf).delete(path, True)


def tidied(spark: SparkSession) -> None:
    """Give back what the driver's heap has grown to in many queries, and let Spark drop broadcasts and shuffles that no one holds."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def multiply(a: int, b: int, poly: int = 0xEDB88320) -> int:
    """Product of two polynomials modulo the CRC-32 polynomial (bit 31 is x to the 0)."""
    product = 0
    while b:
        if b & 0x80000000:
            product ^= a
        b = b << 1 & 0xFFFFFFFF
        a = a >> 1 ^ (poly if a & 1 else 0)
    return product


def crc_join(first: int, second: int, second_bytes: int) -> int:
    """The CRC-32 of two byte strings put together, from theirs and the second's length."""
    shift, square, n = 0x80000000, 0x40000000, second_bytes * 8
    while n:
        if n & 1:
            shift = multiply(shift, square)
        square = multiply(square, square)
        n >>= 1
    return multiply(first, shift) ^ second
