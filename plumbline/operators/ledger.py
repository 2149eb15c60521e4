"""Extraction that degrades: one pass gives values and a ledger of failures, and every attempt is one of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.sources.tables import stored


@dataclass(frozen=True)
class Operation:
    """A value of a page, and what is wrong where the value is null; without a message a null value is a value."""

    name: str
    value: Column
    problem: Column


def window(pages: DataFrame, page: str, start: int | None = None, stop: int | None = None) -> DataFrame:
    """Pages from ``start`` to before ``stop``; a bound that is None does not filter, and both reach the scan."""
    if start is not None:
        pages = pages.filter(F.col(page) >= start)
    return pages if stop is None else pages.filter(F.col(page) < stop)


def attempted(pages: DataFrame, keys: list[str], load: Column, operations: list[Operation]) -> tuple[DataFrame, DataFrame]:
    """(keys, op, value) and (keys, op, error) of all operations on all pages, from one pass that is written once.

    ``load`` is the message of a page that cannot be read: it is recorded once as ``load``, and the page skipped.
    """
    tries = F.array(*(F.struct(F.lit(o.name).alias("op"), o.value.cast("string").alias("value"), F.when(o.value.isNull(), o.problem).alias("error")) for o in operations))
    lost = F.array(F.struct(F.lit("load").alias("op"), F.lit(None).cast("string").alias("value"), load.alias("error")))
    done = stored(pages.select(*keys, F.explode(F.when(load.isNotNull(), lost).otherwise(tries)).alias("_t")).select(*keys, "_t.*"), "attempts")
    return done.filter("error IS NULL").drop("error"), done.filter("error IS NOT NULL").drop("value")
