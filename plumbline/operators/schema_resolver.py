"""Header-driven column resolution: which column of a table means which canonical field.

``cells`` is (table keys, row_ord, col_ord, text); ``schema`` is a Schema.  Title rows are skipped, header
rows form the band, the first other row starts the data.  A column's label is its lowest filled band cell; an
ambiguous label is put behind the nearest group word above it, on its left.  Labels match synonyms exactly, or
else by prefix, in the schema's order; the first column to claim a field wins.  Tables of all kinds are read in
one pass: their rows are aggregated once, and a header band is small and matched as arrays, once for all its tables.  Null cells count
as empty, and a table without header has no mapping.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.text import is_door_mark, is_room, looks_like_mark, looks_like_tag, normalize, strip
from plumbline.operators.ordered import first_wins
from plumbline.sources.tables import dealt, stored


@dataclass(frozen=True)
class Schema:
    """A kind of schedule, as data."""

    name: str
    synonyms: dict[str, tuple[str, ...]]
    core: tuple[str, ...]
    groups: tuple[str, ...] = ()
    ambiguous: tuple[str, ...] = ()
    shape: str = "instance"
    key: str = ""
    grammar: str = "mark"
    quantity: str | None = None
    signature: tuple[str, ...] = ()
    words: tuple[str, ...] = field(init=False, default=())

    def __post_init__(self):
        object.__setattr__(self, "words", tuple(dict.fromkeys([*(s for v in self.synonyms.values() for s in v), *self.groups, *self.ambiguous])))

    def ordered_synonyms(self) -> list[tuple[int, str, str]]:
        return [(i, f, s) for i, (f, s) in enumerate((f, s) for f, v in self.synonyms.items() for s in v)]


# Fields and synonyms that header labels must match.
DOOR = Schema(
    "door",
    {
        "door_mark": ("number", "mark", "door number", "door no"), "fire_rating_minutes": ("fire rating", "fire rating minutes", "fire rating min", "rating"), "width": ("width",), "height": ("height",),
        "door_elevation_type": ("door elevation",), "door_material": ("door material",), "door_finish": ("door finish",), "frame_elevation_type": ("frame elevation",), "frame_material": ("frame material",),
        "frame_finish": ("frame finish",), "hardware_set": ("hardware set", "hardware", "hw set", "hw"), "glass_film": ("glass film", "film"), "glass_type": ("glass type", "glazing", "glass"),
        "special_notes": ("special notes and comments", "special notes", "notes", "comments", "remarks"), "location": ("location", "room"),
    },
    ("door_mark", "width", "height", "door_material"), ("door", "frame", "size"), ("material", "finish", "elevation"), "instance", "door_mark", "mark", None, ("door", "schedule"),
)
FINISH = Schema(
    "finish",
    {
        "room_number": ("number", "room number", "room no", "room"), "room_name": ("name", "room name"), "floor_finish": ("floor", "flooring"), "base_finish": ("base",), "wall_finish": ("wall", "walls"),
        "ceiling_finish": ("ceiling",), "comments": ("special notes and comments", "special notes", "notes", "comments", "remarks"),
    },
    ("room_number", "floor_finish", "base_finish", "wall_finish", "ceiling_finish"), (), (), "instance", "room_number", "mark", None, ("finish", "schedule"),
)
PLUMBING = Schema(
    "plumbing_fixture",
    {
        "fixture_tag": ("fixture tag", "tag", "mark", "fixture"), "description": ("description", "fixture description"), "fixture_type": ("type",), "manufacturer": ("manufacturer", "mfr", "manufacture"),
        "model": ("model", "model no", "model number"), "quantity": ("quantity", "qty", "count"), "remarks": ("plumbing remarks", "remarks", "notes", "comments"),
    },
    ("fixture_tag", "description"), (), (), "catalog", "fixture_tag", "mark", "quantity", ("plumbing", "fixture"),
)

WINDOW = Schema(
    "window",
    {
        "mark": ("mark", "window mark", "window", "type mark"), "window_type": ("type", "window type"), "size": ("size", "size width x height", "dimensions"), "daylight_area": ("daylight area", "glass area", "glazing area"),
        "ventilation_area": ("ventilation area", "vent area", "operable area"), "notes": ("notes", "remarks", "comments"),
    },
    ("mark", "window_type", "size"), (), (), "catalog", "mark", "mark", None, ("window", "schedule"),
)
LIGHTING = Schema(
    "lighting_fixture",
    {
        "fixture_tag": ("type", "fixture type", "tag", "mark", "symbol", "fixture"), "description": ("description", "fixture description", "luminaire"), "manufacturer": ("manufacturer", "mfr", "manufacture"),
        "model": ("model", "catalog", "catalog number", "catalog no"), "lamp": ("lamp", "lamps", "lamp type", "load"), "driver": ("driver", "ballast"), "remarks": ("remarks", "notes", "comments"),
    },
    ("fixture_tag", "description"), (), (), "catalog", "fixture_tag", "mark", None, ("lighting", "fixture"),
)
CAMERA = Schema(
    "camera",
    {
        "device_number": ("device number", "camera number", "number"), "room_number": ("room number", "room"), "room_name": ("room name", "name"), "camera_type": ("camera type",),
        "make_model": ("make model", "make & model", "make"), "reference": ("reference detail", "reference"),
    },
    ("device_number", "camera_type"), (), (), "instance", "device_number", "free", None, ("camera", "schedule"),
)
SECURITY = Schema(
    "security_device",
    {
        "device_number": ("device number", "number"), "room_number": ("room number", "room"), "room_name": ("room name", "name"), "device_type": ("device type",), "make": ("make", "model"),
        "reference": ("reference detail", "reference"),
    },
    ("device_number", "device_type"), (), (), "instance", "device_number", "free", None, ("security", "device"),
)
SCHEMAS = (DOOR, FINISH, PLUMBING, WINDOW, LIGHTING, CAMERA, SECURITY)
#: Cells, and rows of tables, that a task sorts at most, but for one larger table.
CELLS, ROWS = 400_000, 60_000
#: Different header bands that are broadcast at most.
BANDS = 20_000



def _of_kind(values: dict[str, list[str]]) -> Column:
    """The list of the row's kind of schedule, from one literal map."""
    return F.coalesce(F.try_element_at(F.create_map(*(x for k, v in values.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>")))), F.col("kind")), F.array().cast("array<string>"))


def table_rows(cells: DataFrame, by: list[str], schemas: tuple[Schema, ...] = SCHEMAS) -> DataFrame:
    """by, kind, row_ord, cells, class, data_start: the rows of tables (by, kind, row_ord, col_ord, text), each a title, header or data.

    ``kind`` names the schema that a table is read by.  This is the only pass over the cells, and their only shuffle.
    """
    cell = F.struct("col_ord", F.coalesce("text", F.lit("")).alias("text"), normalize(F.col("text")).alias("cell"))
    rows = dealt(cells, CELLS, [*by, "kind"]).groupBy(*by, "kind", "row_ord").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    words = _of_kind({s.name: list(s.words) for s in schemas})
    filled = F.filter("cells", lambda c: c["cell"] != "")
    known = F.filter(filled, lambda c: (F.length(c["cell"]) >= 2) & F.exists(words, lambda w: F.startswith(c["cell"], w) | F.startswith(w, c["cell"])))
    named = F.filter(filled, lambda c: F.contains(c["cell"], F.lit("schedule")))
    kind = F.when((F.size(filled) <= 1) | (F.size(filled) == F.size(named)), "title").when(F.size(known) >= 2, "header").otherwise("data")
    marked = rows.withColumn("class", kind)
    whole = Window.partitionBy(*by, "kind")
    start = F.coalesce(F.min(F.when(F.col("class") == "data", F.col("row_ord"))).over(whole), F.max("row_ord").over(whole) + 1)
    return marked.withColumn("data_start", start)


def resolved(rows: DataFrame, by: list[str], schemas: tuple[Schema, ...] = SCHEMAS) -> DataFrame:
    """by, kind, data_start, columns (col_ord, label, field), coverage of every table of ``table_rows``.

    Only header rows above the data are gathered.  A band is matched as arrays, and once for all tables that have it.
    """
    band = (F.col("class") == "header") & (F.col("row_ord") < F.col("data_start"))
    placed = F.transform(F.filter("cells", lambda c: c["cell"] != ""), lambda c: F.struct("row_ord", c["col_ord"].alias("col_ord"), c["cell"].alias("cell")))
    tables = rows.groupBy(*by, "kind").agg(F.first("data_start").alias("data_start"), F.array_sort(F.flatten(F.collect_list(F.when(band, placed)))).alias("_h"))
    tables = stored(tables, "schedule-bands")
    bands = tables.select("kind", "_h").distinct()
    groups, vague = _of_kind({s.name: list(s.groups) for s in schemas}), _of_kind({s.name: list(s.ambiguous) for s in schemas})
    synonyms = _of_kind({s.name: [x for _, f, x in s.ordered_synonyms()] for s in schemas})
    fields = _of_kind({s.name: [f for _, f, x in s.ordered_synonyms()] for s in schemas})

    def labelled(col: Column) -> Column:
        """The lowest filled cell of a column, behind its group word if it is ambiguous."""
        low = F.array_max(F.transform(F.filter("_h", lambda x: x["col_ord"] == col), lambda x: F.struct(x["row_ord"].alias("r"), x["cell"].alias("cell"))))
        above = F.filter("_h", lambda x: (x["row_ord"] < low["r"]) & (x["col_ord"] <= col) & F.array_contains(groups, x["cell"]))
        nearest = F.array_min(F.transform(above, lambda x: F.struct(x["row_ord"].alias("r"), (-x["col_ord"]).alias("c"), x["cell"].alias("cell"))))
        group = F.when(F.array_contains(vague, low["cell"]), nearest["cell"])
        return F.struct(col.alias("col_ord"), F.concat_ws(" ", group, low["cell"]).alias("label"))

    def matched(x: Column) -> Column:
        """The first field with a synonym that is the label, or else begins it or is begun by it."""
        label = x["label"]
        fits = lambda s: (label == s) | ((F.length(label) >= 3) & (F.startswith(label, s) | F.startswith(s, label)))
        found = F.filter(F.transform(F.arrays_zip(synonyms.alias("s"), fields.alias("f")), lambda z, i: F.struct((label != z["s"]).alias("o"), i.alias("i"), z["s"].alias("s"), z["f"].alias("f"))), lambda z: fits(z["s"]))
        return F.struct(x["col_ord"].alias("col_ord"), label.alias("label"), F.array_min(found)["f"].alias("field"))

    columns = bands.withColumn("_c", F.transform(F.array_sort(F.array_distinct(F.transform("_h", lambda x: x["col_ord"]))), labelled))
    columns = columns.withColumn("_c", F.transform("_c", matched))
    # The first column to claim a field has it.
    taken = lambda x, i: F.exists(F.slice("_c", F.lit(1), i), lambda y: y["field"] == x["field"])
    claimed = F.transform("_c", lambda x, i: F.struct(x["col_ord"].alias("col_ord"), x["label"].alias("label"), F.when(~F.coalesce(taken(x, i), F.lit(False)), x["field"]).alias("field")))
    columns = columns.withColumn("columns", claimed)
    core = _of_kind({s.name: list(s.core) for s in schemas})
    share = F.size(F.array_intersect(core, F.transform("columns", lambda x: x["field"]))) / F.size(core)
    matched_ = stored(columns.select("kind", "_h", "columns", F.when(F.size(core) > 0, F.round(share, 3)).otherwise(0.0).alias("coverage")), "schedule-matched")
    few = matched_.count() <= BANDS
    return tables.join(F.broadcast(matched_) if few else matched_, ["kind", "_h"]).select(*by, "kind", "data_start", "columns", "coverage")


def resolve(cells: DataFrame, schema: Schema, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(by, col_ord, label, field) of every labelled column (field null if unmapped), and (by, data_start, coverage)."""
    tables = resolved(table_rows(cells.withColumn("kind", F.lit(schema.name)), by, (schema,)), by, (schema,))
    return tables.select(*by, F.inline("columns")), tables.select(*by, "data_start", "coverage")


def best_table(tables: DataFrame, by: list[str], table: str, least: float = 0.75) -> DataFrame:
    """Of each group of tables the one with most coverage, the first on ties; none under ``least``."""
    return first_wins(tables.filter(F.col("coverage") >= least), by, [F.desc("coverage"), F.asc(table)])


def select_rows(rows: DataFrame, by: list[str], schemas: tuple[Schema, ...] = SCHEMAS, least_built_in: int = 5) -> DataFrame:
    """The data rows of resolved tables (by, kind, row_ord, data_start, mark, filled) by the shape of their schema.

    A catalog takes the first row of each tag with two filled cells or more, the cells being tested before the first is
    taken.  Free keys take every row behind the header with a key.  Others take the built-in grammar of marks if five
    rows of the table fit it, else any short word with a digit.
    """
    key = strip(F.col("mark"))
    of = lambda test: F.col("kind").isin([s.name for s in schemas if test(s)])
    catalog, free = of(lambda s: s.shape == "catalog"), of(lambda s: s.shape != "catalog" and s.grammar == "free")
    built_in = F.when(of(lambda s: s.key == "door_mark"), is_door_mark(key)).otherwise(is_room(key))
    table = Window.partitionBy(*by, "kind")
    rows = rows.withColumn("_b", F.count_if(built_in & ~catalog & ~free).over(table) >= least_built_in)
    good = F.when(catalog, looks_like_tag(key) & (F.col("filled") >= 2)).when(free, (F.col("row_ord") >= F.col("data_start")) & (key != "")).when(F.col("_b"), built_in).otherwise(looks_like_mark(key))
    once = Window.partitionBy(*by, "kind", F.when(catalog, F.col("mark")).otherwise(F.col("row_ord").cast("string"))).orderBy("row_ord")
    return rows.filter(good).withColumn("_n", F.row_number().over(once)).filter("_n = 1").drop("_b", "_n")


def table_items(cells: DataFrame, by: list[str], schemas: tuple[Schema, ...] = SCHEMAS, least: float = 0.75) -> DataFrame:
    """by, kind, row_ord, mark, attributes, quantity, unit, quantity_basis of the rows that ``select_rows`` takes from every table that fits its schema.

    Rows are made from cells once, for all schemas, and stored; the tables' columns come back to them as one row a table.
    """
    rows = dealt(stored(table_rows(cells, by, schemas), "schedule-rows"), ROWS, [*by, "kind"])
    fit = resolved(rows, by, schemas).filter(F.col("coverage") >= least).select(*by, "kind", "columns")
    named = rows.select(*by, "kind", "row_ord", "cells", "data_start").join(fit, [*by, "kind"])
    text = F.transform("cells", lambda c: F.struct(c["col_ord"].alias("col_ord"), strip(c["text"]).alias("text")))
    field = lambda c: F.get(F.filter("columns", lambda x: x["col_ord"] == c["col_ord"]), 0)["field"]
    entries = F.filter(F.transform("_t", lambda c: F.struct(field(c).alias("field"), c["text"].alias("text"))), lambda e: e["field"].isNotNull())
    key = F.element_at(F.create_map(*(F.lit(x) for s in schemas for x in (s.name, s.key or s.core[0]))), F.col("kind"))
    made = named.withColumn("_t", text).withColumn("attributes", F.map_from_entries(F.array_sort(entries)))
    made = made.select(*by, "kind", "row_ord", "data_start", "attributes", F.size(F.filter("_t", lambda c: c["text"] != "")).alias("filled"), F.coalesce(F.try_element_at("attributes", key), F.lit("")).alias("mark"))
    counted = F.element_at(F.create_map(*(F.lit(x) for s in schemas for x in (s.name, s.quantity or ""))), F.col("kind"))
    number_ = F.nullif(F.regexp_extract(F.coalesce(F.try_element_at("attributes", counted), F.lit("")), r"-?\d+(\.\d+)?", 0), F.lit("")).try_cast("double")
    instance = F.col("kind").isin([s.name for s in schemas if s.shape == "instance"])
    basis = F.when(number_.isNotNull(), "qty_column").when(instance, "row_count").otherwise("unknown_plan_count")
    out = select_rows(made, by, schemas).withColumn("quantity", F.coalesce(number_, F.when(instance, 1.0)))
    return out.select(*by, "kind", "row_ord", "mark", "attributes", "quantity", F.when(F.col("quantity").isNotNull(), "EA").alias("unit"), basis.alias("quantity_basis"))


def expand_merged(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A row whose key has n words is n rows: cells whose words divide by n are dealt evenly, others go to the first."""
    parts = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")
    n = F.size(parts(F.col(key)))
    out = df.select("*", F.posexplode(parts(F.col(key))).alias("_i", "_k"))
    for c in columns:
        k = F.size(parts(F.col(c)))
        dealt = F.array_join(F.slice(parts(F.col(c)), (F.col("_i") * (k / n) + 1).cast("int"), F.greatest((k / n).cast("int"), F.lit(1))), " ")
        out = out.withColumn(f"_{c}", F.when((k > 0) & (k % n == 0), dealt).when(F.col("_i") == 0, F.col(c)).otherwise(""))
    return out.drop(*columns, key, "_i").withColumnsRenamed({f"_{c}": c for c in columns} | {"_k": key})
