"""The building's graph on the driver's tables: doors, rooms, sections and sheets, their domain edges, rules and reports.

Orders are doors (mark, material, hardware), customers are rooms, nations are sections, suppliers are sheets.
The expressions that make them are the same text for Spark and for SQL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.ordered import first_wins, top


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_MARK = "CASE WHEN o_custkey % 11 = 0 THEN 'X' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'N' ELSE 'S' END || lpad(CAST(o_custkey % 1000 AS STRING), 3, '0') END || chr(CAST(65 + o_orderkey % 3 AS INTEGER))"
_DOOR = {
    "door": "o_orderkey", "mark": _MARK, "material": "CASE o_custkey % 6 WHEN 0 THEN 'WD' WHEN 1 THEN 'HM' WHEN 2 THEN 'AL' WHEN 3 THEN '(E)' WHEN 4 THEN '' ELSE 'ZZ' END", "frame": "CASE WHEN o_orderkey % 12 = 0 THEN '' ELSE 'HM' END",
    "hardware": "CASE WHEN o_orderkey % 13 = 0 THEN 'N/A' ELSE 'HW-' || CAST(o_custkey % 9 AS STRING) END", "confidence": "CAST(o_custkey % 100 AS DOUBLE) / 100",
}
_ROOM = {"room": "'N' || lpad(CAST(c_custkey % 1000 AS STRING), 3, '0')", "name": "c_name", "floor": "CASE WHEN c_custkey % 25 = 0 THEN '' ELSE 'CPT-' || CAST(c_custkey % 4 AS STRING) || ' / VCT-1' END", "area": "c_acctbal"}
_SECTION = {"section": "'08' || lpad(CAST(n_nationkey * 7 AS STRING), 4, '0')", "title": "n_name", "refs": "'See 08' || lpad(CAST(n_nationkey * 7 % 100 AS STRING), 4, '0') || ' and 08' || lpad(CAST((n_nationkey + 1) * 7 AS STRING), 4, '0') || ', 099999.'"}
#: Artifacts that every file is asked for.
ARTIFACTS = ("de", "en", "es", "fr")
# Which section specifies which material, and finishes by the letters of their codes.
MATERIALS = {"WD": "080007", "HM": "080014", "AL": "089999"}
FINISHES = {"CPT": "080021", "VCT": "080028"}


def _made(df: DataFrame, of: dict[str, str]) -> DataFrame:
    return df.select(*(F.expr(e).alias(n) for n, e in of.items()))


def _sql(of: dict[str, str], table: str) -> str:
    return "(SELECT " + ", ".join(f"{e} AS {n}" for n, e in of.items()) + f" FROM {table})"


def doors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(_t(spark, sf_dir, "orders"), _DOOR)


def rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rooms, the first customer of each number."""
    return first_wins(_made(_t(spark, sf_dir, "customer"), {**_ROOM, "k": "c_custkey"}), ["room"], [F.asc("k")]).drop("k")


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(_t(spark, sf_dir, "nation"), _SECTION)


_DOORS, _SECTIONS = _sql(_DOOR, "orders"), _sql(_SECTION, "nation")
_ROOMS = f"(SELECT room, name, floor, area FROM (SELECT *, row_number() OVER (PARTITION BY room ORDER BY k) AS r FROM {_sql({**_ROOM, 'k': 'c_custkey'}, 'customer')}) WHERE r = 1)"


def _codes(spark: SparkSession, links: dict[str, str]) -> DataFrame:
    return F.broadcast(spark.createDataFrame(list(links.items()), "code string, section string"))  # a fixed list


def room_of(mark):
    """The room that a door's mark begins with, or the mark itself."""
    found = F.regexp_extract(mark, r"^[NS]\d{3}", 0)
    return F.when(found != "", found).otherwise(mark)


def material_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """door, section, relationship: what specifies each door's leaf and frame, where the code has a section that exists."""
    known = _codes(spark, MATERIALS).join(F.broadcast(sections(spark, sf_dir).select("section")), "section", "left_semi")
    of = lambda c, r: doors(spark, sf_dir).select("door", F.col(c).alias("code")).join(F.broadcast(known), "code").select("door", "section", F.lit(r).alias("relationship"))
    return of("material", "DOOR_SPECIFIED_IN").unionByName(of("frame", "FRAME_SPECIFIED_IN"))


_LINKS = "(VALUES ('WD', '080007'), ('HM', '080014'), ('AL', '089999')) m(code, section)"
_KNOWN = f"(SELECT code, section FROM {_LINKS} WHERE section IN (SELECT section FROM {_SECTIONS}))"
MATERIAL_SQL = f"SELECT door, section, 'DOOR_SPECIFIED_IN' AS relationship FROM {_DOORS} JOIN {_KNOWN} ON code = material UNION ALL SELECT door, section, 'FRAME_SPECIFIED_IN' FROM {_DOORS} JOIN {_KNOWN} ON code = frame"


def unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of each door that no existing section specifies; empty ones and (E) do not count."""
    known = _codes(spark, MATERIALS).join(F.broadcast(sections(spark, sf_dir).select("section")), "section", "left_semi").select("code")
    named = doors(spark, sf_dir).select("door", F.posexplode(F.array("material", "frame")).alias("i", "code")).filter(~F.col("code").isin("", "(E)"))
    missing = named.join(F.broadcast(known), "code", "left_anti")
    return missing.groupBy("door").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("i", "code"))), lambda x: x["code"])).alias("codes"))


UNRESOLVED_SQL = f"SELECT door, string_agg(code, ',' ORDER BY i) AS codes FROM (SELECT door, 0 AS i, material AS code FROM {_DOORS} UNION ALL SELECT door, 1, frame FROM {_DOORS}) WHERE code NOT IN ('', '(E)') AND code NOT IN (SELECT code FROM {_KNOWN}) GROUP BY door"


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """door, room, derived: the room a mark names; a room that no schedule has is made and marked as derived."""
    d = doors(spark, sf_dir).select("door", room_of(F.col("mark")).alias("room"))
    return d.join(rooms(spark, sf_dir).select("room", F.lit(True).alias("_k")), "room", "left").select("door", "room", F.col("_k").isNull().alias("derived"))


LOCATED_SQL = f"SELECT door, room, room NOT IN (SELECT room FROM {_ROOMS}) AS derived FROM (SELECT door, CASE WHEN regexp_matches(mark, '^[NS]\\d{{3}}') THEN substr(mark, 1, 4) ELSE mark END AS room FROM {_DOORS})"


def finish_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """room, section: every distinct code in a room's finish, by its letters, where the section exists."""
    known = _codes(spark, FINISHES).join(F.broadcast(sections(spark, sf_dir).select("section")), "section", "left_semi")
    codes = F.explode(F.array_distinct(F.regexp_extract_all("floor", F.lit(r"([A-Z]{1,4})-\d+"), 1)))
    return rooms(spark, sf_dir).select("room", codes.alias("code")).join(F.broadcast(known), "code").select("room", "section").distinct()


FINISH_SQL = f"SELECT room, '080021' AS section FROM {_ROOMS} WHERE contains(floor, 'CPT-') AND '080021' IN (SELECT section FROM {_SECTIONS}) UNION SELECT room, '080028' FROM {_ROOMS} WHERE contains(floor, 'VCT-') AND '080028' IN (SELECT section FROM {_SECTIONS})"


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """section, target: sections that a section's text names, other than itself, that exist."""
    s = sections(spark, sf_dir)
    named = s.select("section", F.explode(F.array_distinct(F.regexp_extract_all("refs", F.lit(r"\b\d{6}\b"), 0))).alias("target")).filter("section <> target")
    return named.join(s.select(F.col("section").alias("target")), "target", "left_semi").select("section", "target")


REFERENCES_SQL = f"SELECT DISTINCT section, target FROM (SELECT section, unnest(regexp_extract_all(refs, '\\d{{6}}')) AS target FROM {_SECTIONS}) WHERE section <> target AND target IN (SELECT section FROM {_SECTIONS})"


def appears_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many doors appear on the schedule sheet and on the overall plan, if these sheets exist."""
    wanted = ("A9", "A21", "A5000000")
    sheets = _t(spark, sf_dir, "supplier").select(F.expr("'A' || CAST(s_suppkey AS STRING)").alias("sheet")).filter(F.col("sheet").isin(*wanted))
    drawn = doors(spark, sf_dir).select("door", F.explode(F.array(*map(F.lit, wanted))).alias("sheet"))
    return drawn.join(F.broadcast(sheets), "sheet", "left_semi").groupBy("sheet").agg(F.count("*").alias("doors"))  # three sheets at most


APPEARS_SQL = "SELECT sheet, count(*) AS doors FROM orders, (SELECT 'A' || s_suppkey AS sheet FROM supplier) WHERE sheet IN ('A9', 'A21', 'A5000000') GROUP BY sheet"


def room_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scheduled room with its doors and the sections of its finishes."""
    d = located(spark, sf_dir).filter("not derived").groupBy("room").agg(F.count("*").alias("doors"), F.min("door").alias("first_door"))
    f = finish_edges(spark, sf_dir).groupBy("room").agg(F.concat_ws(",", F.array_sort(F.collect_list("section"))).alias("sections"))
    return rooms(spark, sf_dir).select("room", "name").join(d, "room", "left").join(f, "room", "left").select("room", "name", F.coalesce("doors", F.lit(0)).alias("doors"), "first_door", F.coalesce("sections", F.lit("")).alias("sections"))


SPECS_SQL = f"SELECT room, name, coalesce(doors, 0) AS doors, first_door, coalesce(sections, '') AS sections FROM {_ROOMS} LEFT JOIN (SELECT room, count(*) AS doors, min(door) AS first_door FROM ({LOCATED_SQL}) WHERE NOT derived GROUP BY room) USING (room) LEFT JOIN (SELECT room, string_agg(section, ',' ORDER BY section) AS sections FROM ({FINISH_SQL}) GROUP BY room) USING (room)"


def missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with connections that could not be made: doors with unresolved codes or a derived room, rooms without a finish's section."""
    u = unresolved(spark, sf_dir).select(F.col("door").cast("string").alias("id"), F.lit("unresolved_code").alias("what"))
    r = located(spark, sf_dir).filter("derived").select(F.col("door").cast("string").alias("id"), F.lit("derived_room").alias("what"))
    n = rooms(spark, sf_dir).select("room").join(finish_edges(spark, sf_dir), "room", "left_anti").select(F.col("room").alias("id"), F.lit("no_finish").alias("what"))
    return reduce(DataFrame.unionByName, [u, r, n])


MISSING_SQL = f"SELECT CAST(door AS VARCHAR) AS id, 'unresolved_code' AS what FROM ({UNRESOLVED_SQL}) UNION ALL SELECT CAST(door AS VARCHAR), 'derived_room' FROM ({LOCATED_SQL}) WHERE derived UNION ALL SELECT room, 'no_finish' FROM {_ROOMS} WHERE room NOT IN (SELECT room FROM ({FINISH_SQL}))"


def domain_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, passed, metric: shares of at least 0.9; a rule without rows is left out."""
    has = lambda c: F.avg(c.cast("double"))
    d = doors(spark, sf_dir).agg(F.count("*").alias("n"), has((F.col("hardware") != "") & (F.upper("hardware") != "N/A")).alias("doors_have_hardware_set"), has(F.col("frame") != "").alias("doors_have_frame_material"))
    r = rooms(spark, sf_dir).agg(F.count("*").alias("n"), has(F.col("floor") != "").alias("rooms_have_floor_finish"))
    rules = lambda df: df.filter("n > 0").select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("rate")) for c in df.columns[1:]))).alias("x")).select("x.*")
    return rules(d).unionByName(rules(r)).select("name", (F.col("rate") >= 0.9).alias("passed"), F.round("rate", 3).alias("metric"))


RULES_SQL = f"""WITH r AS (SELECT 'doors_have_hardware_set' AS name, avg(CASE WHEN hardware <> 'N/A' THEN 1.0::DOUBLE ELSE 0 END) AS rate FROM {_DOORS} UNION ALL SELECT 'doors_have_frame_material', avg(CASE WHEN frame <> '' THEN 1.0::DOUBLE ELSE 0 END) FROM {_DOORS}
 UNION ALL SELECT 'rooms_have_floor_finish', avg(CASE WHEN floor <> '' THEN 1.0::DOUBLE ELSE 0 END) FROM {_ROOMS}) SELECT name, rate >= 0.9 AS passed, round(rate, 3) AS metric FROM r WHERE rate IS NOT NULL"""


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The validation report as rows: every rule, node and edge totals, and how often each code is unresolved."""
    rules = domain_rules(spark, sf_dir).select(F.concat(F.lit("rule/"), "name").alias("item"), F.col("metric").alias("value"))
    count = lambda df, name: df.agg(F.count("*").cast("double").alias("value")).select(F.lit(name).alias("item"), "value")
    codes = unresolved(spark, sf_dir).select(F.explode(F.split("codes", ",")).alias("c")).groupBy("c").agg(F.count("*").cast("double").alias("value")).select(F.concat(F.lit("unresolved/"), "c").alias("item"), "value")
    parts = [rules, count(doors(spark, sf_dir), "nodes/door"), count(rooms(spark, sf_dir), "nodes/room"), count(material_edges(spark, sf_dir), "edges/material"), count(references(spark, sf_dir), "edges/reference"), codes]
    return reduce(DataFrame.unionByName, parts)


REPORT_SQL = f"""SELECT 'rule/' || name AS item, metric AS value FROM ({RULES_SQL}) UNION ALL SELECT 'nodes/door', count(*)::DOUBLE FROM {_DOORS} UNION ALL SELECT 'nodes/room', count(*)::DOUBLE FROM {_ROOMS} UNION ALL SELECT 'edges/material', count(*)::DOUBLE FROM ({MATERIAL_SQL})
 UNION ALL SELECT 'edges/reference', count(*)::DOUBLE FROM ({REFERENCES_SQL}) UNION ALL SELECT 'unresolved/' || c, count(*)::DOUBLE FROM (SELECT unnest(string_split(codes, ',')) AS c FROM ({UNRESOLVED_SQL})) GROUP BY c"""


def escalations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escalations (lines returned) whose mark is no door and whose schedule is no section: an anti-join for each, with its message."""
    e = _t(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", F.expr("l_orderkey * 2").alias("mark"), F.expr("'08' || lpad(CAST(l_suppkey AS STRING), 4, '0')").alias("schedule")).distinct()
    no_mark = e.join(doors(spark, sf_dir).select(F.col("door").alias("mark")), "mark", "left_anti").withColumn("error", F.concat(F.lit("unknown mark "), F.col("mark").cast("string")))
    no_schedule = e.join(F.broadcast(sections(spark, sf_dir).select(F.col("section").alias("schedule"))), "schedule", "left_anti").withColumn("error", F.concat(F.lit("unknown schedule "), "schedule"))
    return no_mark.unionByName(no_schedule).groupBy("error").agg(F.count("*").alias("n"))


ESCALATIONS_SQL = f"""WITH e AS (SELECT DISTINCT l_orderkey, l_linenumber, l_orderkey * 2 AS mark, '08' || lpad(CAST(l_suppkey AS STRING), 4, '0') AS schedule FROM lineitem WHERE l_returnflag = 'R')
SELECT error, count(*) AS n FROM (SELECT 'unknown mark ' || mark AS error FROM e WHERE mark NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'unknown schedule ' || schedule FROM e WHERE schedule NOT IN (SELECT section FROM {_SECTIONS})) GROUP BY error"""


def reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Across tiers, for each part kind: marks with and without counts, symbols on two or more rows, and whether there are gaps."""
    counts = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("rows"))
    j = _t(spark, sf_dir, "part").filter("p_size % 3 <> 0").join(counts, "p_partkey", "left").groupBy("p_type").agg(F.count("*").alias("marks"), F.count("rows").alias("with_counts"), F.count_if(F.col("rows") >= 2).alias("double_counted"))
    return j.withColumn("has_gaps", F.col("with_counts") < F.col("marks"))


RECONCILED_SQL = "SELECT p_type, count(*) AS marks, count(n) AS with_counts, count(*) FILTER (n >= 2) AS double_counted, count(n) < count(*) AS has_gaps FROM (SELECT * FROM part WHERE p_size % 3 <> 0) LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey GROUP BY p_type"


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job's summary for each customer: items, known quantity, and what is not verified yet, from orders and their lines."""
    lines = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("items"), F.sum("l_quantity").alias("quantity"), F.count_if(F.col("l_returnflag") == "R").alias("unverified"))
    j = _t(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_custkey").agg(F.sum(F.coalesce("items", F.lit(0))).alias("items"), F.round(F.sum(F.coalesce("quantity", F.lit(0.0))), 2).alias("quantity"), F.sum(F.coalesce("unverified", F.lit(0))).alias("unverified"))
    return j.withColumn("exact", F.col("unverified") == 0)


SUMMARY_SQL = "SELECT o_custkey, CAST(sum(coalesce(items, 0)) AS BIGINT) AS items, round(sum(coalesce(quantity, 0)), 2) AS quantity, CAST(sum(coalesce(unverified, 0)) AS BIGINT) AS unverified, sum(coalesce(unverified, 0)) = 0 AS exact FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS items, sum(l_quantity) AS quantity, count(*) FILTER (l_returnflag = 'R') AS unverified FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey GROUP BY o_custkey"


def located_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each artifact is in each file: its longest run of pages (or best page), found or of low confidence, absent, or not applicable.

    Files are blocks of 50 documents; a page's artifact is its language, its confidence the share of short words.
    """
    from plumbline.operators.ordered import longest_run

    d = _t(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 50).alias("file"), F.col("doc_id").alias("page"), F.col("lang").alias("artifact"), F.round(F.col("n_chars") / (F.col("n_chars") + 400.0), 3).alias("conf"))
    run = longest_run(d, ["file", "artifact"], "page", "conf").select("file", "artifact", "page_start", "page_end", "n")
    best = d.groupBy("file", "artifact").agg(F.max("conf").alias("best"))
    expected = d.select("file").distinct().select("file", F.explode(F.array(*map(F.lit, ARTIFACTS))).alias("artifact"))
    j = expected.join(run, ["file", "artifact"], "left").join(best, ["file", "artifact"], "left")
    status = F.when((F.col("artifact") == "en") & (F.col("file") % 5 == 4), "not_applicable").when(F.col("best").isNull(), "absent").when(F.col("best") >= 0.95, "found").otherwise("low_confidence")
    return j.select("file", "artifact", status.alias("status"), "page_start", "page_end", "n")


ARTIFACTS_SQL = """WITH d AS (SELECT doc_id // 50 AS file, doc_id AS page, lang AS artifact, round(n_chars / (n_chars + 400.0::DOUBLE), 3) AS conf FROM documents), i AS (SELECT *, page - row_number() OVER (PARTITION BY file, artifact ORDER BY page) AS island FROM d),
g AS (SELECT file, artifact, min(page) AS page_start, max(page) AS page_end, count(*) AS n, sum(conf) AS w FROM i GROUP BY file, artifact, island), r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file, artifact ORDER BY n DESC, w DESC, page_start) AS k FROM g) WHERE k = 1),
b AS (SELECT file, artifact, max(conf) AS best FROM d GROUP BY 1, 2), e AS (SELECT DISTINCT file, unnest(['de', 'en', 'es', 'fr']) AS artifact FROM d)
SELECT file, artifact, CASE WHEN artifact = 'en' AND file % 5 = 4 THEN 'not_applicable' WHEN best IS NULL THEN 'absent' WHEN best >= 0.95 THEN 'found' ELSE 'low_confidence' END AS status, page_start, page_end, n FROM e LEFT JOIN r USING (file, artifact) LEFT JOIN b USING (file, artifact)"""


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads checked in order: too large, empty, not of the format (here: pages that begin with a doctype); counted by result."""
    p = _t(spark, sf_dir, "pages").select(F.when(F.col("page_id") % 9 == 0, "").otherwise(F.col("html")).alias("c"), "page_id")
    size = F.octet_length("c")
    return p.groupBy(F.when(size > 2400, "413").when(size == 0, "400").when(~F.startswith("c", F.lit("<!DOCTYPE")) | (F.col("page_id") % 10 == 1), "415").otherwise("ok").alias("result")).agg(F.count("*").alias("n"))


UPLOADS_SQL = "SELECT CASE WHEN octet_length(encode(c)) > 2400 THEN '413' WHEN c = '' THEN '400' WHEN NOT starts_with(c, '<!DOCTYPE') OR page_id % 10 = 1 THEN '415' ELSE 'ok' END AS result, count(*) AS n FROM (SELECT page_id, CASE WHEN page_id % 9 = 0 THEN '' ELSE html END AS c FROM pages) GROUP BY 1"


def json_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dot path into each event's JSON, and the key that names a request with its configuration."""
    e = _t(spark, sf_dir, "events")
    key = F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), "event_type", "props"), 256)
    return e.groupBy("user_id").agg(F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("k"), F.count_if(F.get_json_object("props", "$.none.of").isNull()).alias("absent"), F.countDistinct(key).alias("requests"))


JSON_SQL = "SELECT user_id, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k, count(*) FILTER (json_extract_string(props, '$.none.of') IS NULL) AS absent, count(DISTINCT user_id || '|' || event_type || '|' || props) AS requests FROM events GROUP BY user_id"


def truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long texts as their head and tail with a count of what is between, and the view of ten lines from the third on."""
    t, n, lines = F.col("text"), F.char_length("text"), F.split("text", "\n")
    short = F.when(n <= 200, t).otherwise(F.concat(F.substring(t, 1, 150), F.lit(" ...["), (n - 200).cast("string"), F.lit("]... "), F.substring(t, -50, 50)))
    return _t(spark, sf_dir, "documents").select("doc_id", short.alias("short"), F.array_join(F.slice(lines, 3, 10), "\n").alias("view"), F.greatest(F.size(lines) - 12, F.lit(0)).alias("below"))


TRUNCATED_SQL = "SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE substr(text, 1, 150) || ' ...[' || (length(text) - 200) || ']... ' || right(text, 50) END AS short, array_to_string(string_split(text, chr(10))[3:12], chr(10)) AS view, CAST(greatest(len(string_split(text, chr(10))) - 12, 0) AS INTEGER) AS below FROM documents"


def first_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each user the first event, the event of the greatest value, and the types of events in the order of their first use."""
    e = _t(spark, sf_dir, "events")
    kinds = e.groupBy("user_id", "event_type").agg(F.min("event_id").alias("i")).groupBy("user_id").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("i", "event_type"))), lambda x: x["event_type"])).alias("kinds"))
    best = top(e, ["user_id"], [F.desc("value"), F.asc("event_id")], 1).select("user_id", F.col("event_id").alias("best_event"))
    first = first_wins(e, ["user_id"], [F.asc("event_id")]).select("user_id", F.col("event_id").alias("first_event"))
    return kinds.join(best, "user_id").join(first, "user_id")


FIRST_SQL = "SELECT user_id, (SELECT string_agg(event_type, ',' ORDER BY i) FROM (SELECT event_type, min(event_id) AS i FROM events e WHERE e.user_id = u.user_id GROUP BY 1)) AS kinds, arg_max(event_id, value * 1000000000 - event_id) AS best_event, min(event_id) AS first_event FROM events u GROUP BY user_id"


def merged_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of keys with the right side's value winning: suppliers' names, over by the segments of customers of even numbers, and which side gave it."""
    left = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("l"))
    right = _t(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("r"))
    return left.join(right, "k", "full").select("k", F.coalesce("r", "l").alias("value"), F.col("r").isNotNull().alias("replaced"))


SETTINGS_SQL = "SELECT coalesce(s_suppkey, c_custkey) AS k, coalesce(c_mktsegment, s_name) AS value, c_mktsegment IS NOT NULL AS replaced FROM supplier FULL JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) ON s_suppkey = c_custkey"


def close_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closest known name for each misspelt one, by edit distance, among names that share a beginning or an ending."""
    known = _t(spark, sf_dir, "part").select("p_name").distinct()
    asked = known.select(F.col("p_name").alias("asked"), F.concat(F.substring("p_name", 1, 3), F.lit("x"), F.substring("p_name", 4, 40)).alias("said"))
    keys = lambda c: F.explode(F.array(F.concat(F.lit("^"), F.substring(c, 1, 3)), F.concat(F.lit("$"), F.substring(c, -3, 3))))
    pairs = asked.select("said", keys("said").alias("key")).join(known.select("p_name", keys("p_name").alias("key")), "key").select("said", "p_name").distinct()
    near = pairs.withColumn("d", F.levenshtein("said", "p_name", 3)).filter("d >= 0")
    return first_wins(near, ["said"], [F.asc("d"), F.asc("p_name")])


CLOSE_SQL = """WITH k AS (SELECT DISTINCT p_name FROM part), a AS (SELECT substr(p_name, 1, 3) || 'x' || substr(p_name, 4, 40) AS said FROM k), p AS (SELECT said, p_name, CAST(levenshtein(said, p_name) AS INTEGER) AS d FROM a, k WHERE substr(said, 1, 3) = substr(p_name, 1, 3) OR right(said, 3) = right(p_name, 3))
SELECT said, p_name, d FROM (SELECT *, row_number() OVER (PARTITION BY said ORDER BY d, p_name) AS r FROM p WHERE d <= 3) WHERE r = 1"""

QUERIES = {
    "j9_material_edges": material_edges, "g6_unresolved": unresolved, "j10_located_doors": located, "j12_finish_edges": finish_edges, "j13_references": references, "j11_appears_on": appears_on, "g3_room_specs": room_specs, "g6_missing": missing,
    "a12_domain_rules": domain_rules, "a14_report": report, "j19_escalations": escalations, "a19_reconciled": reconciled, "a21_summary": summary, "w7_located": located_artifacts, "f35_uploads": uploads, "r16_json_paths": json_paths, "d14_truncated": truncated,
    "d4_first_and_best": first_plans, "u5_merged_settings": merged_settings, "r19_close_matches": close_matches,
}
ORACLE_SQL = {
    "j9_material_edges": MATERIAL_SQL, "g6_unresolved": UNRESOLVED_SQL, "j10_located_doors": LOCATED_SQL, "j12_finish_edges": FINISH_SQL, "j13_references": REFERENCES_SQL, "j11_appears_on": APPEARS_SQL, "g3_room_specs": SPECS_SQL, "g6_missing": MISSING_SQL,
    "a12_domain_rules": RULES_SQL, "a14_report": REPORT_SQL, "j19_escalations": ESCALATIONS_SQL, "a19_reconciled": RECONCILED_SQL, "a21_summary": SUMMARY_SQL, "w7_located": ARTIFACTS_SQL, "f35_uploads": UPLOADS_SQL, "r16_json_paths": JSON_SQL, "d14_truncated": TRUNCATED_SQL,
    "d4_first_and_best": FIRST_SQL, "u5_merged_settings": SETTINGS_SQL, "r19_close_matches": CLOSE_SQL,
}
