"""Project manuals as tables: bid items, tables of contents, section starts, and abbreviation lists.

Pages are rows with an order; lines carry (page, line).  A file has a bounded number of pages, so windows by file stay
bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.text import dedouble, head, squeeze, strip

# The grammar of division and section lines, with every kind of dash.
DASH = "[-‒–—―−]"
DIVISION = rf"^\s*DIVISION\s+(\d{{2}})\s*{DASH}\s*(.+?)\s*$"
SECTION = rf"^\s*(?:SECTION\s+)?(\d{{2}}\s?\d{{2}}\s?\d{{2}}(?:\.\d{{2}})?)\s*{DASH}?\s*(.+?)\s*$"
# The words that begin each kind of numbered item, and the line that describes it.
KINDS = {"alternate": ("Alternate", "Base Bid"), "unit_price": ("Unit Price", "Description"), "allowance": ("Allowance", "Description")}


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


# Words that tell an alternate's basis, the unit of a price, and how much of a description is kept.
DEDUCT, ADD, UNIT = r"(?i)Deductive\s+Alternate", r"(?i)Add(itive)?\s+Alternate", r"(?i)Unit of Measurement\s*:\s*([^\n]+)"
MOST_DESCRIPTION = 300
# Lines of manuals that say nothing.
NOISE = ("BID SET", "TABLE OF CONTENTS", "END OF TABLE OF CONTENTS", "PROJECT MANUAL COVER")
NOISE_PATTERNS = (r"^\d{1,2}\s+[A-Za-z]+\s+\d{4}$", r"^TABLE OF CONTENTS\s+TOC-\d+$")
# Where the columns of an abbreviation list begin, and the band of the page that they lie in.
ANCHORS, BAND = (169, 440, 712), (150, 900)


def bid_items(df: DataFrame, kind: str, keys: list[str], text: str = "text", most: int = MOST_DESCRIPTION) -> DataFrame:
    """keys, ordinal, number, title, basis, description, unit of the items "<word> No. <n>: <title>" in a text.

    A description is a line of at most ``most`` characters.
    Each item's body reaches to the next item; an alternate's basis is deduct, add or unknown, by its body.
    """
    word, described = KINDS[kind]
    mark = rf"(?i){word}\s+No\.?\s*\d+\s*:\s*[^\n]+"
    bodies = F.slice(F.split(text, mark, -1), 2, F.size(F.split(text, mark, -1)))
    heads = F.regexp_extract_all(text, F.lit(mark), 0)
    rows = df.select(*keys, F.posexplode(F.arrays_zip(heads.alias("head"), bodies.alias("body"))).alias("ordinal", "x"))
    said, body = F.col("x.head"), F.col("x.body")
    basis = {"alternate": F.when(body.rlike(DEDUCT), "deduct").when(body.rlike(ADD), "add").otherwise("unknown"), "unit_price": F.lit("unit"), "allowance": F.lit("lump_sum")}[kind]
    unit = F.rtrim(squeeze(_found(body, UNIT)), F.lit(".")) if kind == "unit_price" else F.lit(None).cast("string")
    return rows.select(
        *keys, "ordinal", _found(said, rf"(?i)No\.?\s*(\d+)").alias("number"), F.rtrim(strip(_found(said, r":\s*([^\n]+)")), F.lit(".")).alias("title"), basis.alias("basis"),
        F.coalesce(F.substring(squeeze(_found(body, rf"(?i){described}\s*:\s*([^\n]+)")), 1, most), F.lit("")).alias("description"), unit.alias("unit"),
    )


def toc_pages(pages: DataFrame, by: list[str], page: str = "page_index", text: str = "text") -> DataFrame:
    """The first contiguous pages of a table of contents: pages with a division line or the closing words."""
    toc = F.col(text).rlike("(?m)" + DIVISION) | F.contains(text, F.lit("END OF TABLE OF CONTENTS"))
    whole = Window.partitionBy(*by)
    flagged = pages.withColumn("_toc", F.coalesce(toc, F.lit(False))).withColumn("_first", F.min(F.when(F.col("_toc"), F.col(page))).over(whole))
    gap = F.min(F.when(~F.col("_toc") & (F.col(page) > F.col("_first")), F.col(page))).over(whole)
    return flagged.withColumn("_gap", gap).filter((F.col(page) >= F.col("_first")) & (F.col("_gap").isNull() | (F.col(page) < F.col("_gap")))).drop("_toc", "_first", "_gap")


def is_noise(line: Column, firm: str | None = None) -> Column:
    """Blank lines, running heads (of ``firm``, if given), dates and footers."""
    s = strip(line)
    of_firm = F.startswith(s, F.lit(firm)) if firm else F.lit(False)
    return (s == "") | of_firm | s.isin(*NOISE) | s.rlike(NOISE_PATTERNS[0]) | s.rlike(NOISE_PATTERNS[1])


def toc(lines: DataFrame, by: list[str], order: list[str], line: str = "line", firm: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(by, ord, division, title, applicable) and (by, ord, division, section, title) of a table of contents.

    The division carries down.  A line that is no header goes on the title before it, but for division 00;
    a title that ends in a hyphen takes it without a blank.
    """
    rows = lines.filter(~is_noise(F.col(line), firm))
    at = Window.partitionBy(*by).orderBy(*order)
    rows = rows.withColumn("ord", F.row_number().over(at)).withColumn("_div", _found(F.col(line), DIVISION)).withColumn("_na", F.upper(strip(F.col(line))) == "NOT APPLICABLE")
    run = Window.partitionBy(*by).orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_d_ord", F.last(F.when(F.col("_div").isNotNull(), F.col("ord")), ignorenulls=True).over(run)).filter("_d_ord is not null").withColumn("division", F.last("_div", ignorenulls=True).over(run))
    number = F.when(F.col("_div").isNull() & ~F.col("_na"), F.replace(_found(F.col(line), SECTION), F.lit(" "), F.lit("")))
    rows = rows.withColumn("_num", number)
    inside = Window.partitionBy(*by, "_d_ord").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_s_ord", F.last(F.when(F.col("_num").isNotNull(), F.col("ord")), ignorenulls=True).over(inside))
    divisions = rows.groupBy(*by, "_d_ord").agg(F.max("_div").alias("division"), F.max(F.when(F.col("_div").isNotNull(), _found(F.col(line), DIVISION, 2))).alias("title"), (~F.max("_na")).alias("applicable")).withColumnRenamed("_d_ord", "ord")
    goes_on = F.col("_num").isNull() & F.col("_div").isNull() & ~F.col("_na") & (F.col("division") != "00")
    piece = F.when(F.col("_num").isNotNull(), _found(F.col(line), SECTION, 2)).when(goes_on, strip(F.col(line)))
    parts = rows.filter("_s_ord is not null").withColumn("_p", piece).filter("_p is not null").groupBy(*by, "division", "_s_ord").agg(F.max("_num").alias("section"), F.array_sort(F.collect_list(F.struct("ord", "_p"))).alias("_parts"))
    joined = F.aggregate(F.col("_parts"), F.lit(""), lambda s, p: F.when(s == "", p["_p"]).when(F.endswith(s, F.lit("-")), F.concat(s, p["_p"])).otherwise(F.concat(s, F.lit(" "), p["_p"])))
    return divisions, parts.select(*by, F.col("_s_ord").alias("ord"), "division", "section", F.trim(joined).alias("title"))


def section_starts(pages: DataFrame, by: list[str], page: str = "page_index", text: str = "text") -> DataFrame:
    """by, section, page: the first page whose head names the section, without pages of contents."""
    h = head(F.col(text))
    named = pages.withColumn("section", _found(h, r"SECTION\s+(\d{6})\s*[-–]")).filter(F.col("section").isNotNull() & ~F.contains(h, F.lit("TABLE OF CONTENTS")))
    return named.groupBy(*by, "section").agg(F.min(page).alias(page))


def clustered_rows(words: DataFrame, by: list[str], tolerance: float = 5.0) -> DataFrame:
    """Add row: words (by, pos, top) belong to one row while their top is within the tolerance of the row's first word.

    The anchor is the row's first word, so a fold over the ordered words of a page decides.
    """
    listed = words.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col("top").cast("double").alias("top"), F.col("pos").cast("long").alias("pos")))).alias("_w"))
    state = F.struct(F.lit(None).cast("double").alias("ref"), F.lit(-1).alias("n"), F.array().cast("array<struct<pos:bigint,row:int>>").alias("out"))

    def step(s: Column, w: Column) -> Column:
        new = s["ref"].isNull() | (F.abs(w["top"] - s["ref"]) > tolerance)
        n = s["n"] + F.when(new, 1).otherwise(0)
        return F.struct(F.when(new, w["top"]).otherwise(s["ref"]).alias("ref"), n.alias("n"), F.concat(s["out"], F.array(F.struct(w["pos"].alias("pos"), n.alias("row")))).alias("out"))

    rows = listed.select(*by, F.explode(F.aggregate("_w", state, step, lambda s: s["out"])).alias("x")).select(*by, F.col("x.pos").alias("pos"), F.col("x.row").alias("row"))
    return words.join(rows, [*by, "pos"])


def abbreviations(words: DataFrame, by: list[str], anchors: tuple[float, ...] = ANCHORS, band: tuple[float, float] = BAND, tolerance: float = 5.0) -> DataFrame:
    """by, ord, abbreviation, definition of a list in columns; words are (by, pos, text, x0, top).

    In each row and column the first word is the abbreviation and the others its meaning; distinct pairs, in order.
    """
    inside = words.filter((F.col("x0") >= band[0]) & (F.col("x0") < band[1]))
    column = F.lit(None).cast("int")
    for i, a in enumerate(anchors):
        column = F.when(F.col("x0") >= a - 20, i).otherwise(column)
    rows = clustered_rows(inside, by, tolerance).withColumn("col", column).filter("col is not null")
    cells = rows.groupBy(*by, "row", "col").agg(F.array_sort(F.collect_list(F.struct("x0", "pos", dedouble(F.col("text")).alias("t")))).alias("_w"))
    t = F.transform("_w", lambda w: w["t"])
    pairs = cells.filter(F.size("_w") >= 2).select(*by, "row", "col", F.get(t, 0).alias("abbreviation"), F.array_join(F.slice(t, 2, F.size(t)), " ").alias("definition")).filter(F.col("abbreviation").rlike(r"^[A-Z0-9/&.\-]{1,7}$"))
    return pairs.groupBy(*by, "abbreviation", "definition").agg(F.min(F.struct("row", "col")).alias("ord"))


# Headers of parts and clauses, bodies that issue standards, and fields of a finish list.
PART = rf"^\s*PART\s+([1-3])\s*{DASH}\s*(.+?)\s*$"
CLAUSE = r"^\s*(\d\.\d{2})\s+(.+?)\s*$"
STANDARD = r"(?:ASTM|NFPA|ANSI|UL)\s+[A-Z]?\d+"
FINISH_CODE = r"\b([A-Z]{1,4}-\d+[A-Z]?)\s+TYPE:"
FINISH_FIELD = r"(?i)\b(?:TYPE|STYLE|MANUFACTURE|MANUFACTURER|LOCATION|COLOR|INSTALL|NOTES|GRID|PROFILE|CONTENT|ELEVATION|CONTACT)\s*:"


def section_bounds(lines: DataFrame, by: list[str], page: str = "page", line: str = "line", most: int = 60) -> DataFrame:
    """by, section, start, stop: from the first page with the section's header to the page that closes it.

    A page with END OF SECTION is the last; else the one before the next page with a section's header; else the last
    of ``most`` pages.  The closing words of a page count before its header.
    """
    head, number = F.col(line).rlike(r"^\s*SECTION\s+\d{6}"), _found(F.col(line), rf"^\s*SECTION\s+(\d{{6}})\s*{DASH}")
    per = lines.groupBy(*by, page).agg(F.max(F.contains(line, F.lit("END OF SECTION"))).alias("_ends"), F.max(head).alias("_head"))
    starts = lines.withColumn("section", number).filter("section is not null").groupBy(*by, "section").agg(F.min(page).alias("start"))
    # Starts and pages of one file meet; a file has a bounded number of pages.
    inside = starts.join(per, by).filter((F.col(page) >= F.col("start")) & (F.col(page) < F.col("start") + most))
    stop = F.when(F.col("_ends"), F.col(page)).when(F.col("_head") & (F.col(page) > F.col("start")), F.col(page) - 1)
    return inside.groupBy(*by, "section", "start").agg(F.coalesce(F.min(stop), F.max(page)).alias("stop"))


def clauses(lines: DataFrame, by: list[str], order: list[str], line: str = "line") -> DataFrame:
    """by, part, clause, title, ord, n_lines, body, standards (distinct, in order) of the clauses of every part.

    A clause's header counts only where its major number is that of the part it is in.
    """
    rows = lines.withColumn("ord", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).withColumn("_p", _found(F.col(line), PART).cast("int"))
    run = Window.partitionBy(*by).orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("part", F.last("_p", ignorenulls=True).over(run)).withColumn("_p_ord", F.last(F.when(F.col("_p").isNotNull(), F.col("ord")), ignorenulls=True).over(run)).filter("part is not null")
    number = _found(F.col(line), CLAUSE)
    own = F.col("_p").isNull() & (F.substring(number, 1, 1) == F.col("part").cast("string"))
    inside = Window.partitionBy(*by, "_p_ord").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_c", F.last(F.when(own, F.col("ord")), ignorenulls=True).over(inside)).filter("_c is not null")
    first = F.col("ord") == F.col("_c")
    found = rows.groupBy(*by, "part", "_c").agg(F.max(F.when(first, number)).alias("clause"), F.max(F.when(first, _found(F.col(line), CLAUSE, 2))).alias("title"), (F.count("*") - 1).alias("n_lines"), F.array_sort(F.collect_list(F.struct("ord", F.col(line).alias("x")))).alias("_l"))
    text = F.transform("_l", lambda x: x["x"])
    return found.select(*by, "part", "clause", "title", F.col("_c").alias("ord"), "n_lines", F.array_join(F.slice(text, 2, F.size(text)), "\n").alias("body"), F.array_distinct(F.regexp_extract_all(F.array_join(text, " "), F.lit(STANDARD), 0)).alias("standards"))


def finish_codes(df: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """by, code, definition, described: the first definition of each code, to the next code; described is its TYPE up to the next field."""
    heads = F.regexp_extract_all(text, F.lit(FINISH_CODE), 1)
    bodies = F.slice(F.split(text, FINISH_CODE, -1), 2, F.size(F.split(text, FINISH_CODE, -1)))
    rows = df.select(*by, F.posexplode(F.arrays_zip(heads.alias("code"), bodies.alias("body"))).alias("_i", "x"))
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "x.code").orderBy("_i"))).filter("_n = 1")
    return first.select(*by, F.col("x.code").alias("code"), strip(F.concat(F.col("x.code"), F.lit(" TYPE:"), F.col("x.body"))).alias("definition"), strip(F.get(F.split("x.body", FINISH_FIELD, 2), 0)).alias("described"))


def expansions(codes: DataFrame, abbreviations_: DataFrame, finishes: DataFrame) -> DataFrame:
    """``codes`` with as_material and as_finish: what a code means, empty if nothing is known.

    abbreviations_ (code, definition) is asked for the code, then for its letters; finishes (code, described, ord) for
    the shortest text of all codes with the same letters, the first on ties.
    """
    prefix = lambda c: F.upper(F.regexp_extract(c, "^[A-Za-z]+", 0))
    short = finishes.filter("described <> ''").groupBy(prefix(F.col("code")).alias("_p")).agg(F.min_by("described", F.struct(F.length("described"), "ord")).alias("_f"))
    exact = abbreviations_.select(F.col("code"), F.col("definition").alias("_a"))
    loose = abbreviations_.select(F.col("code").alias("_p"), F.col("definition").alias("_b"))
    j = codes.withColumn("_p", prefix(F.col("code"))).join(exact, "code", "left").join(loose, "_p", "left").join(short, "_p", "left")
    material, finish = F.coalesce(F.nullif("_a", F.lit("")), F.nullif("_b", F.lit(""))), F.col("_f")
    return j.withColumn("as_material", F.coalesce(material, finish, F.lit(""))).withColumn("as_finish", F.coalesce(finish, material, F.lit(""))).drop("_p", "_a", "_b", "_f")
