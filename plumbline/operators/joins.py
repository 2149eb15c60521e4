"""Joins: ranges, nearest neighbours within a distance, scored matches and conditional updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.ordered import first_wins


def in_ranges(pages: DataFrame, ranges: DataFrame, key: str, page: str, span: int = 256) -> DataFrame:
    """Pages that lie in any range (key, page_start, page_end, both inside) of their key.

    Ranges are cut at multiples of ``span``, so the join is on (key, bin) and not a product.
    """
    bins = ranges.select(F.col(key), "page_start", "page_end", F.explode(F.sequence(F.floor(F.col("page_start") / span), F.floor(F.col("page_end") / span))).alias("_bin"))
    inside = (pages[key] == bins[key]) & (F.floor(pages[page] / span) == bins["_bin"]) & pages[page].between(bins["page_start"], bins["page_end"])
    return pages.join(bins, inside, "left_semi")


def nearest_within(labels: DataFrame, rooms: DataFrame, by: list[str], most: float) -> DataFrame:
    """by, label_ord, room_ord, distance: each label's nearest room within ``most``, then each room's nearest label.

    Both have x, y and an order column (label_ord, room_ord) that breaks ties.  A grid of cells of size ``most``
    with the neighbouring cells makes it an equi-join.
    """
    cell = lambda c: F.floor(F.col(c) / most)
    near = F.explode(F.array(*(F.struct((cell("x") + i).alias("gx"), (cell("y") + j).alias("gy")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    a = labels.select(*by, "label_ord", F.col("x").alias("lx"), F.col("y").alias("ly"), cell("x").alias("gx"), cell("y").alias("gy"))
    b = rooms.select(*by, "room_ord", F.col("x").alias("rx"), F.col("y").alias("ry"), near.alias("g")).select(*by, "room_ord", "rx", "ry", "g.gx", "g.gy")
    pairs = a.join(b, [*by, "gx", "gy"]).withColumn("distance", F.hypot(F.col("lx") - F.col("rx"), F.col("ly") - F.col("ry"))).filter(F.col("distance") <= most)
    bound = first_wins(pairs, [*by, "label_ord"], [F.col("distance"), F.col("room_ord")])
    return first_wins(bound, [*by, "room_ord"], [F.col("distance"), F.col("label_ord")]).select(*by, "label_ord", "room_ord", "distance")


def token_score(query: Column, title: Column, least: int = 4) -> Column:
    """Share of query tokens with a title token that equals it or shares a prefix of ``least`` or more letters."""
    shorter = lambda a, b: F.least(F.length(a), F.length(b))
    match = lambda a, b: (a == b) | ((shorter(a, b) >= least) & (F.startswith(a, b) | F.startswith(b, a)))
    return F.when(F.size(query) > 0, F.size(F.filter(query, lambda q: F.exists(title, lambda t: match(q, t)))) / F.size(query)).otherwise(0.0)


def best_title(queries: DataFrame, titles: DataFrame, threshold: float, least: int = 4) -> DataFrame:
    """query_id, title_id, score: the best title over the threshold, the first on ties.

    queries (query_id, tokens), titles (title_id, tokens).  Tokens that match share their first ``least`` letters,
    or are equal, so candidates come from an equi-join on those letters.
    """
    # Equal token lists are scored once: many rows may share few of them, and of equal titles the first is best.
    asked = queries.select(F.col("tokens").alias("_q")).filter(F.size("_q") > 0).distinct()
    named = titles.filter(F.size("tokens") > 0).groupBy(F.col("tokens").alias("_t")).agg(F.min("title_id").alias("title_id"))
    stems = lambda t: F.explode(F.array_distinct(F.transform(t, lambda x: F.substring(x, 1, least)))).alias("_stem")
    q = asked.select("_q", stems("_q"))
    t = named.select("_t", "title_id", stems("_t"))
    # A pair with several stems in common is scored for each: no pair is gathered before only the best are left.
    scored = q.join(t, "_stem").select("_q", "title_id", token_score(F.col("_q"), F.col("_t"), least).alias("score")).filter(F.col("score") > threshold)
    found = first_wins(scored, ["_q"], [F.desc("score"), F.asc("title_id")])
    every = queries.join(found, queries["tokens"] == found["_q"]).select("query_id", "title_id", "score")
    return first_wins(every, ["query_id"], [F.desc("score"), F.asc("title_id")])


def flip(items: DataFrame, counts: DataFrame) -> DataFrame:
    """Items of unknown plan count take the verified total of their mark; all others stay."""
    good = counts.filter("verified").select(F.col("symbol_id").alias("_s"), F.col("building_total").alias("_total"))
    joined = items.join(good, items["mark"] == good["_s"], "left")
    hit = (F.col("quantity_basis") == "unknown_plan_count") & F.col("_total").isNotNull()
    return joined.withColumn("quantity", F.when(hit, F.col("_total").cast("double")).otherwise(F.col("quantity"))).withColumn("unit", F.when(hit, "EA").otherwise(F.col("unit"))).withColumn("quantity_basis", F.when(hit, "plan_count").otherwise(F.col("quantity_basis"))).drop("_s", "_total")


def merge_verdicts(counts: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Confidence after verification: the greater one where both agree, half the lesser where not; counts stay."""
    v = verdicts.select(*keys, F.col("verified").alias("_v"), F.col("agrees").alias("_a"), F.col("confidence").alias("_c"))
    joined = counts.join(v, keys, "left")
    confidence = F.when(~F.coalesce("_v", F.lit(False)), F.col("confidence")).when(F.col("_a"), F.greatest("confidence", "_c")).otherwise(F.round(F.least("confidence", "_c") * 0.5, 3))
    return joined.withColumn("confidence", confidence).withColumn("verified", F.coalesce("_v", F.lit(False))).drop("_v", "_a", "_c")
