"""Operators in which the order of rows is data; every one takes explicit order columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _rank(df: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    at = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(at)).filter(F.col("_rn") <= most).drop("_rn")


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key in ``order``; Spark limits groups before the shuffle."""
    return _rank(df, keys, order, 1)


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Upsert: the last row of every key."""
    return _rank(df, keys, [F.desc(c) for c in order], 1)


def top(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of every key."""
    return _rank(df, keys, order, k)


def runs(df: DataFrame, by: list[str], order: str, kind: str) -> DataFrame:
    """Run-length encoding: by, run, kind, first, last, n for consecutive rows of one kind."""
    at = Window.partitionBy(*by).orderBy(order)
    new = F.when(F.lag(kind).over(at).eqNullSafe(F.col(kind)) & (F.row_number().over(at) > 1), 0).otherwise(1)
    numbered = df.withColumn("_new", new).withColumn("run", F.sum("_new").over(at) - 1)
    return numbered.groupBy(*by, "run").agg(F.first(kind).alias(kind), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def absorb(kinds: Column, least: int) -> Column:
    """Relabel short interior runs whose neighbours agree, in an array of (kind, first, last, n) of two kinds.

    One fold from the left with the finished runs as state: a run that is neither first
    nor last and shorter than ``least`` joins its neighbours into one.
    """
    item = "struct<kind:string,first:bigint,last:bigint,n:bigint>"
    size = F.size(kinds)
    start = F.struct(F.array().cast(f"array<{item}>").alias("done"), F.lit(False).alias("skip"))

    def step(state: Column, x: Column) -> Column:
        run, i = x["run"], x["i"]
        done, before = state["done"], F.element_at(state["done"], -1)
        following = F.get(kinds, i + 1)
        short = (i > 0) & (i < size - 1) & (run["n"] < least)
        join = F.struct(before["kind"].alias("kind"), before["first"].alias("first"), following["last"].alias("last"), (before["n"] + run["n"] + following["n"]).alias("n"))
        merged = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(join.cast(item)))
        return (
            F.when(state["skip"], F.struct(done.alias("done"), F.lit(False).alias("skip")))
            .when(short, F.struct(merged.alias("done"), F.lit(True).alias("skip")))
            .otherwise(F.struct(F.concat(done, F.array(run.cast(item))).alias("done"), F.lit(False).alias("skip")))
        )

    indexed = F.transform(kinds, lambda r, i: F.struct(r.alias("run"), i.alias("i")))
    # element_at fails on an empty array, so the first run is put in before the fold.
    first = F.struct(F.slice(kinds, 1, 1).cast(f"array<{item}>").alias("done"), F.lit(False).alias("skip"))
    return F.when(size == 0, F.array().cast(f"array<{item}>")).otherwise(F.aggregate(F.slice(indexed, 2, F.greatest(size, F.lit(1))), F.when(size == 0, start).otherwise(first), step, lambda s: s["done"]))


def regions(df: DataFrame, by: list[str], order: str, kind: str, least: int = 3) -> DataFrame:
    """by, kind, page_start, page_end, pages of every region after short strays are absorbed.

    A file's runs are gathered (a file has a bounded number of pages).
    """
    encoded = runs(df, by, order, kind).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("run", F.col(kind).alias("kind"), "first", "last", "n"))).alias("_r"))
    listed = F.transform("_r", lambda r: F.struct(r["kind"].alias("kind"), r["first"].cast("long").alias("first"), r["last"].cast("long").alias("last"), r["n"].cast("long").alias("n")))
    out = encoded.select(*by, F.explode(absorb(listed, least)).alias("x"))
    return out.select(*by, F.col("x.kind").alias("kind"), F.col("x.first").alias("page_start"), F.col("x.last").alias("page_end"), F.col("x.n").alias("pages"))


def longest_run(df: DataFrame, by: list[str], page: str, weight: str) -> DataFrame:
    """The longest run of consecutive pages of each key, then the heaviest, then the first."""
    at = Window.partitionBy(*by).orderBy(page)
    islands = df.withColumn("_island", F.col(page) - F.row_number().over(at)).groupBy(*by, "_island").agg(F.min(page).alias("page_start"), F.max(page).alias("page_end"), F.count("*").alias("n"), F.sum(weight).alias("weight"))
    return first_wins(islands, by, [F.desc("n"), F.desc("weight"), F.asc("page_start")]).drop("_island")


def carry(df: DataFrame, by: list[str], order: str, value: str, into: str) -> DataFrame:
    """Carry the last value that is not null down the rows."""
    at = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(into, F.last(value, ignorenulls=True).over(at))


def windows(candidates: DataFrame, page: str, low: int, high: int, cap: int) -> DataFrame:
    """Contiguous half-open windows over low..high, cut right after every cap-th candidate: index, start, end, n.

    Duplicates and candidates outside the range do not count; without candidates one window covers the range.
    """
    if cap < 1 or high < 0 or low < 0:
        raise ValueError("cap must be 1 or more, and the range not negative")
    spark = candidates.sparkSession
    if high <= low:
        return spark.createDataFrame([], "index long, start long, end long, candidates long")
    inside = candidates.select(F.col(page).cast("long").alias("p")).filter((F.col("p") >= low) & (F.col("p") < high)).distinct()
    # Ranks over all candidates: counts of blocks, and of blocks of blocks, of which only the last are ordered as a whole.
    block, upper = F.floor(F.col("p") / 4096), F.floor(F.col("b") / 4096)
    counted = inside.groupBy(block.alias("b")).agg(F.count("*").alias("n")).withColumn("u", upper)
    uppers = counted.groupBy("u").agg(F.sum("n").alias("_n")).select("u", (F.sum("_n").over(Window.orderBy("u")) - F.col("_n")).alias("_before"))
    within = F.sum("n").over(Window.partitionBy("u").orderBy("b")) - F.col("n")
    before = counted.withColumn("_within", within).join(uppers, "u").select("b", (F.col("_within") + F.col("_before")).alias("before"))
    ranked = inside.withColumn("b", block).join(before, "b").withColumn("i", F.col("before") + F.row_number().over(Window.partitionBy("b").orderBy("p")) - 1)
    cut = ranked.groupBy(F.floor(F.col("i") / cap).alias("index")).agg(F.max("p").alias("last"), F.count("*").alias("candidates"))
    # A window begins behind the one before it; the neighbours are found by their numbers.
    earlier = cut.select((F.col("index") + 1).alias("index"), (F.col("last") + 1).alias("start"))
    later = cut.select((F.col("index") - 1).alias("index"), F.lit(True).alias("_later"))
    end = F.when(F.col("_later").isNull(), F.lit(high)).otherwise(F.col("last") + 1)
    edges = cut.join(earlier, "index", "left").join(later, "index", "left").select("index", F.coalesce("start", F.lit(low)).alias("start"), end.alias("end"), "candidates")
    none = spark.createDataFrame([(0, low, high, 0)], "index long, start long, end long, candidates long").join(inside.limit(1).select(F.lit(1).alias("x")), F.lit(True), "left_anti")
    return edges.unionByName(none)


def page_of(df: DataFrame, order: list[str], page: int, size: int) -> DataFrame:
    """One page of a sorted result; pages count from 1, and sizes are 1 to 500."""
    if page < 1 or not 1 <= size <= 500:
        raise ValueError("page must be 1 or more and size 1 to 500")
    return df.orderBy(*order).offset((page - 1) * size).limit(size)
