"""The closest known name for each asked one, by the ratio of matching blocks, as an exact similarity join.

The ratio of two names is twice the length of their matching blocks over the sum of their lengths.  No name reaches
a ratio t with another unless their multisets of letters share t/2 of that sum, so candidates come from prefix-filtered
postings of (letter, how many of it so far), the rarest first.  Thresholds go down in steps: a name whose best match
reaches a step is settled there, with short postings, and only the others are looked up again with longer ones.

Null names take no part.  Of several best names the greatest wins, as a ranked list of (ratio, name) would have it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.sources.tables import stored

STEPS = (0.9, 0.8, 0.65, 0.5)


def letters(name: Column) -> Column:
    """Every letter with its number among equal ones: a multiset as a set."""
    chars = F.split(name, "")
    numbered = F.transform(F.array_distinct(chars), lambda c: F.transform(F.sequence(F.lit(1), F.size(F.filter(chars, lambda x: x == c))), lambda i: F.concat(c, i.cast("string"))))
    return F.when(F.length(name) > 0, F.flatten(numbered)).otherwise(F.array().cast("array<string>"))


def _postings(names: DataFrame, frequency: DataFrame, least: float) -> DataFrame:
    """name, size, tokens, token: the rarest letters of every name, one of which each partner at ``least`` has among its own."""
    # A partner of n letters is least * n / (2 - least) long or longer, so that many letters at least are shared.
    shared = F.ceil(F.col("size") * F.lit(least / (2 - least)) - 1e-9)
    ranked = names.select("name", "size", F.explode("tokens").alias("token")).join(frequency, "token")
    ranked = ranked.withColumn("at", F.row_number().over(Window.partitionBy("name").orderBy("n", "token")))
    return ranked.filter(F.col("at") <= F.col("size") - shared + 1).select("name", "size", "token")


def _ratios(pairs: DataFrame) -> DataFrame:
    """``pairs`` (asked, known) with their ratio."""

    def run(batches: Iterator) -> Iterator:
        from difflib import SequenceMatcher

        import pyarrow as pa

        matcher = SequenceMatcher()
        for batch in batches:
            out = []
            for asked, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if matcher.b != asked:
                    matcher.set_seq2(asked)
                matcher.set_seq1(known)
                out.append(matcher.ratio())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["asked", "known", "ratio"])

    return pairs.select("asked", "known").mapInArrow(run, "asked string, known string, ratio double")


def closest(asked: DataFrame, known: DataFrame, least: float = 0.5) -> DataFrame:
    """asked, known, ratio: for each distinct name of ``asked`` (name) the closest of ``known`` (name); none under ``least``."""
    both = [stored(df.select("name").filter("name IS NOT NULL").distinct().select("name", F.length("name").alias("size"), letters(F.col("name")).alias("tokens")), "names") for df in (asked, known)]
    frequency = stored(both[0].unionByName(both[1]).select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")), "letters")
    same = both[0].select("name").join(both[1].select("name"), "name", "left_semi")
    done = [same.select(F.col("name").alias("asked"), F.col("name").alias("known"), F.lit(1.0).alias("ratio"))]
    rest = both[0].join(same, "name", "left_anti")
    for step in [*(s for s in STEPS if s > least), least]:
        rest = stored(rest, "asked")
        left, right = _postings(rest, frequency, step), _postings(both[1], frequency, step)
        met = left.select(F.col("name").alias("asked"), F.col("size").alias("a"), "token").join(right.select(F.col("name").alias("known"), F.col("size").alias("b"), "token"), "token")
        sum_ = F.col("a") + F.col("b")
        met = met.filter(2 * F.least("a", "b") >= step * sum_ - 1e-9).select("asked", "known").distinct()
        met = met.join(rest.select(F.col("name").alias("asked"), F.col("tokens").alias("s")), "asked").join(both[1].select(F.col("name").alias("known"), F.col("tokens").alias("t")), "known")
        bound = 2 * F.size(F.array_intersect("s", "t")) >= step * (F.size("s") + F.size("t")) - 1e-9
        scored = _ratios(met.filter(bound).select("asked", "known").sortWithinPartitions("asked")).filter(F.col("ratio") >= step)
        best = scored.groupBy("asked").agg(F.max(F.struct("ratio", "known")).alias("best")).select("asked", "best.known", "best.ratio")
        best = stored(best, "closest")
        done.append(best)
        rest = rest.join(best.select(F.col("asked").alias("name")), "name", "left_anti")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out
