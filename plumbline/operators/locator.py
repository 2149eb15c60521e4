"""Locating artifacts in packages of page files, in two stages.

The cheap stage looks at page profiles only: the anchors a spec asks for, and whether the page lies in a region of
the spec's kind.  Text and tables are read for the pages that are left, to confirm them.  Confirmed pages become the
longest run of consecutive pages of one file, or the best page, and the status comes from these pages.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.text import abbreviation_score, strip
from plumbline.operators import joins, manuals, schema_resolver
from plumbline.operators.ordered import first_wins
from plumbline.sources.tables import stored


@dataclass(frozen=True)
class Spec:
    """What an artifact is recognised by: ``confirm`` names the score of a candidate page."""

    name: str
    region: str
    anchors: tuple[str, ...]
    every: bool
    confirm: str
    run: bool
    least: float = 0.6

    def fits(self, hits: Column) -> Column:
        """All of the anchors occur, or any of them."""
        found = [F.map_contains_key(hits, F.lit(a)) for a in self.anchors]
        out = found[0]
        for one in found[1:]:
            out = (out & one) if self.every else (out | one)
        return out


# The artifacts of a bid package, the anchors of their pages, and how sure a page has to be.
SPECS = (
    Spec("spec_toc", "manual", ("TABLE OF CONTENTS",), False, "contents", True),
    Spec("drawing_index", "drawings", ("SHEET NUMBER", "SHEET NAME"), True, "sheets", False),
    Spec("door_schedule", "drawings", ("DOOR SCHEDULE", "FIRE RATING"), True, "doors", True),
    Spec("finish_schedule", "drawings", ("ROOM FINISH SCHEDULE", "FINISH SCHEDULE"), False, "finishes", True),
    Spec("abbreviations", "drawings", ("ABBREVIATION",), False, "abbreviations", False, 0.5),
)
# Anchors that keep a page in the manual; the least lines, columns and coverage of contents and schedules.
MANUAL_ANCHORS = ("DIVISION", "SECTION", "TABLE OF CONTENTS")
TOC_LINES, DOOR_COLUMNS, DOOR_COVERAGE, FINISH_COLUMNS = 3, 6, 0.75, 7

# Kinds of regions that are known by name; others are allowed.
KNOWN_REGIONS = ("manual", "drawings", "front_matter", "unknown")

PAGE = ["package", "file_id", "page_index"]


def front_matter(regions: DataFrame, profiles: DataFrame, least: int = 3) -> DataFrame:
    """``regions`` (file_id, kind, page_start, page_end, pages): a short manual region that begins or ends a file and has none of the manual's anchors is front matter.

    First and last are ranks from both ends of the file; anchors are asked for in these regions only.
    """
    up = F.row_number().over(Window.partitionBy("file_id").orderBy("page_start"))
    down = F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("page_start")))
    ranked = regions.withColumn("_edge", (up == 1) | (down == 1)).withColumn("_short", F.col("_edge") & (F.col("kind") == "manual") & (F.col("pages") < least))
    any_anchor = F.arrays_overlap(F.map_keys("anchor_hits"), F.array(*map(F.lit, MANUAL_ANCHORS)))
    named = profiles.filter(any_anchor).select(F.col("file_id").alias("_f"), "page_index")
    held = ranked.filter("_short").join(named, (F.col("file_id") == F.col("_f")) & F.col("page_index").between(F.col("page_start"), F.col("page_end")), "left_semi").select("file_id", "page_start", F.lit(True).alias("_held"))
    marked = ranked.join(held, ["file_id", "page_start"], "left")
    return marked.withColumn("kind", F.when(F.col("_short") & F.col("_held").isNull(), "front_matter").otherwise(F.col("kind"))).drop("_edge", "_short", "_held")


def candidates(profiles: DataFrame, regions: DataFrame, specs: tuple[Spec, ...] = SPECS) -> DataFrame:
    """PAGE, artifact, short_token_count of the pages that have a spec's anchors and lie in a region of its kind."""
    fits = F.array_compact(F.array(*(F.when(s.fits(F.col("anchor_hits")), F.struct(F.lit(s.name).alias("artifact"), F.lit(s.region).alias("kind"))) for s in specs)))
    named = profiles.select(*PAGE, "short_token_count", F.explode(fits).alias("_s"))
    place = lambda kind: F.struct(F.col("file_id").alias("file_id"), kind.alias("kind"))
    inside = joins.in_ranges(named.withColumn("_at", place(F.col("_s.kind"))), regions.withColumn("_at", place(F.col("kind"))), "_at", "page_index")
    return inside.select(*PAGE, "short_token_count", F.col("_s.artifact").alias("artifact"))


def table_scores(cells: DataFrame) -> DataFrame:
    """PAGE, table_ord, width, sheets, doors, finishes of every table of ``cells`` (PAGE, table_ord, row_ord, col_ord, text)."""
    by = [*PAGE, "table_ord"]
    text = F.coalesce("text", F.lit(""))
    clean = F.regexp_replace(strip(text), r"\s*\n\s*", " ")
    listed = (F.col("col_ord") == 0) & F.contains(text, F.lit("SHEET")) & F.contains(text, F.lit("NUMBER"))
    top = F.array_sort(F.collect_list(F.when(F.col("row_ord") < 3, F.struct("row_ord", "col_ord", clean.alias("t")))))
    # The width is that of the first row.
    width = F.max(F.when(F.col("row_ord") == 0, F.col("col_ord"))) + 1
    shape = cells.groupBy(*by).agg(width.alias("width"), F.max(listed).alias("listed"), F.upper(F.array_join(F.transform(top, lambda x: x["t"]), " ")).alias("header"))
    surfaces = F.contains("header", F.lit("FLOOR")) & F.contains("header", F.lit("BASE")) & F.contains("header", F.lit("WALL")) & F.contains("header", F.lit("CEILING"))
    finish = F.when(F.col("width") != FINISH_COLUMNS, None).when(F.contains("header", F.lit("ROOM FINISH SCHEDULE")), 1.0).when(surfaces, 0.7)
    wide = cells.join(shape.filter(F.col("width") >= DOOR_COLUMNS).select(*by), by, "left_semi")
    _, covered = schema_resolver.resolve(wide, schema_resolver.DOOR, by)
    return shape.select(*by, "width", F.when(F.col("listed"), 1.0).alias("sheets"), finish.alias("finishes")).join(covered.select(*by, F.col("coverage").alias("doors")), by, "left")


def confirmed(found: DataFrame, texts: DataFrame, cells: DataFrame, specs: tuple[Spec, ...] = SPECS) -> DataFrame:
    """PAGE, artifact, confidence of the candidate pages that their text or tables confirm.

    texts (PAGE, text) and cells are joined with candidates only, each once for all specs that need it.
    """
    of = lambda *kinds: found.filter(F.col("artifact").isin([s.name for s in specs if s.confirm in kinds]))
    kind = {s.confirm: s.name for s in specs}
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(manuals.DIVISION) | x.rlike(manuals.SECTION))
    contents = texts.join(of("contents").select(*PAGE), PAGE).select(*PAGE, F.lit(kind.get("contents")).alias("artifact"), F.when(F.size(lines) >= TOC_LINES, 1.0).alias("confidence"))
    tabled = of("sheets", "doors", "finishes")
    scores = table_scores(cells.join(tabled.select(*PAGE).distinct(), PAGE, "left_semi"))
    # Finishes: the first table that is one decides; sheets: any; doors: the best.
    doors = F.max("doors")
    per = scores.groupBy(*PAGE).agg(F.max("sheets").alias("sheets"), F.when(doors >= DOOR_COVERAGE, doors).alias("doors"), F.min_by("finishes", F.when(F.col("finishes").isNotNull(), F.col("table_ord"))).alias("finishes"))
    score = F.coalesce(*(F.when(F.col("artifact") == kind[k], F.col(k)) for k in ("sheets", "doors", "finishes") if k in kind), F.lit(None).cast("double"))
    in_tables = tabled.join(per, PAGE).select(*PAGE, "artifact", score.alias("confidence"))
    short = of("abbreviations").select(*PAGE, "artifact", abbreviation_score(F.col("short_token_count")).alias("confidence"))
    out = contents.unionByName(in_tables).unionByName(short)
    return out.filter("confidence > 0").withColumn("confidence", F.round("confidence", 3))


def chosen(pages: DataFrame, specs: tuple[Spec, ...] = SPECS) -> DataFrame:
    """The pages of every artifact of a package: its longest run (then the surest, then the first), or its surest page."""
    runs = [s.name for s in specs if s.run]
    at = Window.partitionBy("package", "artifact", "file_id").orderBy("page_index")
    islands = pages.filter(F.col("artifact").isin(runs)).withColumn("_island", F.col("page_index") - F.row_number().over(at))
    per = islands.groupBy("package", "artifact", "file_id", "_island").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 6).alias("sum"), F.min("page_index").alias("first"))
    longest = first_wins(per, ["package", "artifact"], [F.desc("n"), F.desc("sum"), F.asc("file_id"), F.asc("first")])
    in_run = islands.join(longest.select("package", "artifact", "file_id", "_island"), ["package", "artifact", "file_id", "_island"], "left_semi").drop("_island")
    one = first_wins(pages.filter(~F.col("artifact").isin(runs)), ["package", "artifact"], [F.desc("confidence"), F.asc("file_id"), F.asc("page_index")])
    return in_run.unionByName(one)


def locate(packages: DataFrame, profiles: DataFrame, regions: DataFrame, texts: DataFrame, cells: DataFrame, specs: tuple[Spec, ...] = SPECS) -> DataFrame:
    """package, artifact, status, confidence, pages (file_id, page_index, in order) of every spec for every one of ``packages`` (package).

    profiles (PAGE, anchor_hits, short_token_count), regions (package, file_id, kind, page_start, page_end).  An artifact
    without a region of its kind is not_applicable, one without a confirmed page absent; the others are found or, under
    the spec's least confidence, low_confidence.
    """
    found = stored(candidates(profiles, regions, specs), "candidates")
    pages = chosen(stored(confirmed(found, texts, cells, specs), "confirmed"), specs)
    place = F.transform(F.array_sort(F.collect_list(F.struct("file_id", "page_index"))), lambda x: x)
    located = pages.groupBy("package", "artifact").agg(F.max("confidence").alias("confidence"), place.alias("pages"))
    wanted = packages.select("package", F.explode(F.array(*(F.struct(F.lit(s.name).alias("artifact"), F.lit(s.region).alias("kind"), F.lit(s.least).alias("least")) for s in specs))).alias("_s")).select("package", "_s.*")
    present = regions.select("package", "kind", F.lit(True).alias("_present")).distinct()
    joined = wanted.join(present, ["package", "kind"], "left").join(located, ["package", "artifact"], "left")
    status = F.when(F.col("_present").isNull(), "not_applicable").when(F.col("confidence").isNull(), "absent").when(F.col("confidence") >= F.col("least"), "found").otherwise("low_confidence")
    return joined.select("package", "artifact", status.alias("status"), "confidence", "pages")


def page_hints(located: DataFrame) -> DataFrame:
    """package and, for the parsers, the first page of each artifact and the page behind the contents (0 without contents)."""
    first = F.get("pages", 0)["page_index"]
    last = F.element_at("pages", -1)["page_index"]
    of = lambda name, page: F.max(F.when((F.col("artifact") == name) & F.col("pages").isNotNull(), page))
    names = ("drawing_index", "door_schedule", "finish_schedule", "abbreviations")
    return located.groupBy("package").agg(of("spec_toc", first).alias("toc_start"), F.coalesce(of("spec_toc", last + 1), F.lit(0)).alias("section_start_hint"), *(of(n, first).alias(n) for n in names))
