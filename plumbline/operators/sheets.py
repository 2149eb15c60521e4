"""Drawing sheets as tables of positioned words and primitives: labels, counts, scales, title blocks, geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.text import SCALE, number, scale_factor, snap_rotation, strip, token_kind
from plumbline.operators.ordered import first_wins


def positioned(words: DataFrame) -> DataFrame:
    """Words (.., x0, y0, x1, y1, text) with their centres x, y; blank ones go."""
    return words.withColumn("text", strip(F.col("text"))).filter("text <> ''").withColumn("x", (F.col("x0") + F.col("x1")) / 2).withColumn("y", (F.col("y0") + F.col("y1")) / 2)


def area_labels(words: DataFrame, by: list[str]) -> DataFrame:
    """by, pos, area, x, y: a number before an SF word, or one word such as 816SF; the place is the number's."""
    following = F.lead("text").over(Window.partitionBy(*by).orderBy("pos"))
    plain = F.regexp_replace("text", ",", "")
    split = plain.rlike(r"^\d+(\.\d+)?$") & F.upper("_next").rlike(r"^S\.?F\.?$")
    joined = F.upper(plain).rlike(r"^\d+(\.\d+)?S\.?F\.?$")
    rows = words.withColumn("_next", following).withColumn("area", F.when(split | joined, number(plain)))
    return rows.filter("area is not null").select(*by, "pos", "area", "x", "y")


def area_plans(labels: DataFrame, words: DataFrame, rooms: DataFrame, by: list[str], least: int = 3) -> DataFrame:
    """Pages with at least ``least`` area labels and ``least`` words that are known rooms."""
    known = words.join(rooms.select(F.col("room_number").alias("text")).distinct(), "text", "left_semi").groupBy(*by).agg(F.count("*").alias("rooms"))
    return labels.groupBy(*by).agg(F.count("*").alias("labels")).join(known, by).filter((F.col("labels") >= least) & (F.col("rooms") >= least))


def fixture_counts(words: DataFrame, tags: DataFrame, pages: DataFrame, by: list[str], exclude: DataFrame | None = None, spread: float = 0.35, least: int = 3) -> DataFrame:
    """by, tag, count, points of catalog tags on instance plans.

    words (by, text, x, y), tags (tag), pages (by, width, height).  A page whose tags lie closer than ``spread`` of its
    width and height is a legend, one with fewer than ``least`` is sparse; neither counts, nor does an excluded page.
    """
    hits = words.join(tags.select("tag").distinct(), words["text"] == F.col("tag"))
    if exclude is not None:
        hits = hits.join(exclude, by, "left_anti")
    per = hits.groupBy(*by).agg(F.count("*").alias("_n"), (F.max("x") - F.min("x")).alias("_dx"), (F.max("y") - F.min("y")).alias("_dy")).join(pages, by)
    plans = per.filter((F.col("_n") >= least) & (F.greatest(F.col("_dx") / F.col("width"), F.col("_dy") / F.col("height")) >= spread)).select(*by)
    return hits.join(plans, by).groupBy(*by, "tag").agg(F.count("*").alias("count"), F.array_sort(F.collect_list(F.struct("x", "y"))).alias("points"))


def sheet_scales(texts: DataFrame, by: list[str], order: str, text: str = "text") -> DataFrame:
    """by, factor, confidence, ambiguous, all_scales: no scale, one (1.0) or several (0.4) distinct scales of a sheet."""
    said = texts.select(*by, order, F.posexplode(F.regexp_extract_all(text, F.lit(SCALE), 0)).alias("_i", "_s"))
    said = said.withColumn("_c", F.regexp_replace("_s", r"\s+", ""))
    first = said.groupBy(*by, "_c").agg(F.min(F.struct(order, "_i", F.col("_s"))).alias("_f"))
    found = first.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_f", "_c"))).alias("_l"))
    joined = texts.select(*by).distinct().join(found, by, "left")
    n = F.coalesce(F.size("_l"), F.lit(0))
    factor = scale_factor(F.get(F.col("_l"), 0)["_f"]["_s"])
    return joined.select(*by, F.when(n > 0, factor).alias("factor"), F.when(n == 0, 0.0).when(n == 1, 1.0).otherwise(0.4).alias("confidence"), (n > 1).alias("ambiguous"), F.coalesce(F.transform("_l", lambda x: x["_c"]), F.array().cast("array<string>")).alias("all_scales"))


def title_blocks(words: DataFrame, by: list[str], pattern: str = r"^[A-Z]{1,3}\d+(\.\d+)*[A-Z]?$", gap: float = 60.0) -> DataFrame:
    """by, sheet_number, title: the tallest word that looks like a sheet number, and the words above it up to a gap.

    words (by, pos, text, x0, top, bottom).
    """
    height = F.col("bottom") - F.col("top")
    number_ = first_wins(words.filter(F.col("text").rlike(pattern)), by, [F.desc(height), F.asc("pos")]).select(*by, F.col("text").alias("sheet_number"), F.col("top").alias("_t"), F.col("pos").alias("_p"), height.alias("_h"))
    above = words.join(number_, by).filter((F.col("top") < F.col("_t")) & (height < F.col("_h")) & (F.col("pos") != F.col("_p")))
    up = Window.partitionBy(*by).orderBy(F.desc("top"), F.desc("x0"))
    far = F.coalesce(F.lag("top").over(up), F.col("_t")) - F.col("top") > gap
    near = above.withColumn("_far", F.sum(F.when(far, 1).otherwise(0)).over(up.rowsBetween(Window.unboundedPreceding, Window.currentRow))).filter("_far = 0")
    titles = near.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.bround(F.col("top") / 8).alias("band"), "x0", "text"))), lambda w: w["text"]), " ").alias("title"))
    return number_.select(*by, "sheet_number").join(titles, by, "left")


def geometry(primitives: DataFrame, pages: DataFrame, by: list[str]) -> DataFrame:
    """Per page: counts by kind, long and axis-parallel lines, and whether a border rectangle is there.

    primitives (by, kind, x0, y0, x1, y1), pages (by, width, height).
    """
    p = primitives.join(pages, by)
    w, h = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))
    line = F.col("kind") == "line"
    is_ = lambda k: F.count_if(F.col("kind") == k)
    return p.groupBy(*by).agg(is_("line").alias("lines"), is_("rect").alias("rects"), is_("curve").alias("curves"), F.count_if(line & (F.hypot(w, h) > 0.6 * F.least("width", "height"))).alias("long_lines"), F.count_if(line & (F.least(w, h) < 1)).alias("axis_lines"), F.coalesce(F.max((F.col("kind") == "rect") & (w * h > 0.6 * F.col("width") * F.col("height"))), F.lit(False)).alias("border"))


def boxes(points: Column) -> Column:
    """The bounding box (x0, y0, x1, y1) of an array of (x, y)."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def text_objects(pages: DataFrame, by: list[str], blocks: str = "blocks") -> DataFrame:
    """by, block, line, span, text, kind, rotation of the text of nested pages (blocks of lines of spans); images and blank spans are left out.

    ``blocks`` is array<struct<type, lines: array<struct<dx, dy, spans: array<struct<text>>>>>>; a null type is text.
    """
    b = pages.select(*by, F.posexplode(blocks).alias("block", "_b")).filter(F.coalesce(F.col("_b.type"), F.lit(0)) == 0)
    lines = b.select(*by, "block", F.posexplode("_b.lines").alias("line", "_l"))
    spans = lines.select(*by, "block", "line", snap_rotation(F.coalesce("_l.dx", F.lit(1.0)), F.coalesce("_l.dy", F.lit(0.0))).alias("rotation"), F.posexplode("_l.spans").alias("span", "_s"))
    text = strip(F.coalesce("_s.text", F.lit("")))
    return spans.select(*by, "block", "line", "span", text.alias("text"), token_kind(text).alias("kind"), "rotation").filter("text <> ''")
