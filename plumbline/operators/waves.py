"""Two waves over page windows: schedule items by shard, merged in shard order; then areas for the rooms found.

The first wave needs no other window; what it finds in all of them goes back as a filter to the second.  Neither the
merge, which keeps the first item of each (schedule, mark) in page order, nor the second wave depends on how pages are
cut into windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import sheets
from plumbline.operators.joins import nearest_within
from plumbline.operators.ordered import first_wins

#: Rooms beyond which the second wave shuffles words by room instead of broadcasting the rooms.
BROADCAST_ROWS = 200_000
# How far from a room its area is written, and the greatest area that is a room's.
MOST_DISTANCE, MOST_AREA = 100.0, 20000.0


def map_shards(items: DataFrame, windows: DataFrame) -> DataFrame:
    """``items`` (page, row_ord, schedule, mark, ..) with their shard: first of each (schedule, mark) in its window (index, start, end)."""
    width = 1024
    bins = windows.select(F.col("index").alias("shard"), "start", "end", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))).alias("_bin"))
    inside = items.withColumn("_bin", F.floor(F.col("page") / width)).join(bins, "_bin").filter((F.col("page") >= F.col("start")) & (F.col("page") < F.col("end")))
    return first_wins(inside.drop("_bin", "start", "end"), ["shard", "schedule", "mark"], [F.asc("page"), F.asc("row_ord")])


def merge_shards(partials: DataFrame) -> DataFrame:
    """The first item of each (schedule, mark) in shard order."""
    return first_wins(partials, ["schedule", "mark"], [F.asc("shard"), F.asc("page"), F.asc("row_ord")])


def room_areas(words: DataFrame, rooms: DataFrame, least: int = 3) -> DataFrame:
    """room_number, area, confidence, page: of every known room on area plans the nearest label, the first plan wins.

    words (page, pos, text, x, y), rooms (room_number).  A label over MOST_AREA is a building's total.  Each label goes
    to its nearest room, each room to the closest of its labels; confidence falls with the distance.
    """
    labels = sheets.area_labels(words, ["page"])
    known = rooms.select(F.col("room_number").alias("text")).distinct()
    known = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
    at = words.join(known, "text", "left_semi")
    counted = at.groupBy("page").agg(F.count("*").alias("_rooms")).filter(F.col("_rooms") >= least)
    plans = labels.groupBy("page").agg(F.count("*").alias("_labels")).filter(F.col("_labels") >= least).join(counted, "page").select("page")
    small = labels.filter(F.col("area") <= MOST_AREA).join(plans, "page", "left_semi").withColumnRenamed("pos", "label_ord")
    there = at.join(plans, "page", "left_semi").withColumnRenamed("pos", "room_ord")
    # One room may be written several times on a page: of all its places the closest binding wins.
    bound = nearest_within(small, there, ["page"], MOST_DISTANCE)
    named = bound.join(there.select("page", "room_ord", F.col("text").alias("room_number")), ["page", "room_ord"]).join(small.select("page", "label_ord", "area"), ["page", "label_ord"])
    first = first_wins(named, ["room_number"], [F.asc("page"), F.asc("distance"), F.asc("label_ord")])
    return first.select("room_number", "area", F.greatest(F.round(1 - F.col("distance") / MOST_DISTANCE, 3), F.lit(0.0)).alias("confidence"), "page")


def two_waves(items: DataFrame, words: DataFrame, windows: DataFrame, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """The merged items of all shards, and the areas of the rooms that their finish schedules name."""
    merged = merge_shards(map_shards(items, windows))
    rooms = merged.filter("schedule = 'finish'").select(F.col("mark").alias("room_number"))
    return merged, room_areas(words, rooms, least)
