"""Secret scan: fixed patterns, and sliding-window entropy over candidate strings.

Patterns give the base spans.  A candidate is a run of 20 or more characters of
``[A-Za-z0-9+/_=-]`` that has a letter and a digit, matches no allow-list entry
and overlaps no base span.  Its class (hex, alnum, base64) sets a threshold; a
window of 20 characters slides over it, with counts and the sum of c log2 c
updated for the character that enters and the one that leaves.  The span runs
from the first window at or over the threshold to the end of the last one.

Positions are code points, ends excluded.  Null and empty texts have no spans.
Every input row gives one row; other columns pass through, and the results lie in
one new column whose name the caller gives.  Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# A run shorter than these bounds never matches, and no match can begin inside a longer one.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Candidates that are no secrets: UUIDs, dates and times, paths of plain words, runs of one character.
ALLOW = (
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T_-][0-9-]+)?$",
    r"^/?[A-Za-z_-]+(/[A-Za-z_-]+)+(/[0-9]+)?$",
    r"^(.)\1+$",
    r"(?i)example|placeholder|changeme|abcdefghij|0123456789",
)
WINDOW = 20
THRESHOLDS = {"hex": 3.05, "alnum": 3.72, "base64": 3.92}
ORDER = ("assign", "access", "hex", "entropy_hex", "entropy_alnum", "entropy_base64")

SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"


def quoted(s: str) -> str:
    """A SQL string literal of ``s``."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches(text: str, pattern: str, group: int = 0) -> str:
    """SQL for array<struct<start,value>> of all matches: the gaps between them and their lengths give the starts."""
    p = quoted(pattern)
    return f"""IF({text} RLIKE {p}, aggregate(
      arrays_zip(transform(split({text}, {p}, -1), g -> char_length(g)), regexp_extract_all({text}, {p}, 0), regexp_extract_all({text}, {p}, {group})),
      named_struct('at', 0, 'found', cast(array() AS array<struct<start:int,whole:string,part:string>>)),
      (a, m) -> named_struct('at', a.at + m.`0` + coalesce(char_length(m.`1`), 0),
        'found', IF(m.`1` IS NULL, a.found, concat(a.found, array(named_struct('start', a.at + m.`0`, 'whole', m.`1`, 'part', m.`2`)))))).found,
      cast(array() AS array<struct<start:int,whole:string,part:string>>))"""


def spans_of(found: str, kind: str, keep: str = "true") -> str:
    return f"transform(filter({found}, m -> {keep}), m -> named_struct('start', m.start, 'rank', {ORDER.index(kind)}, 'kind', '{kind}', 'end', m.start + char_length(m.whole)))"


def window_entropy(text: str, threshold: str) -> str:
    """SQL for struct<first,last>: starts of the first and last window of ``text`` at or over ``threshold``; -1 if none."""
    w = WINDOW
    logs = "array(" + ",".join(f"{k}D*log2({max(k, 1)}D)" for k in range(w + 2)) + ")"
    code = f"ascii(substring({text}, i + 1, 1))"
    gone = f"IF(i >= {w}, ascii(substring({text}, i + 1 - {w}, 1)), -1)"
    # Every position comes with the character that enters the window and the one that leaves it (-1: none).
    moves = f"transform(sequence(0, char_length({text}) - 1), i -> named_struct('i', i, 'e', {code}, 'l', {gone}))"
    f = lambda x: f"element_at({logs}, {x} + 1)"
    more, less = "element_at(a.n, m.e + 1)", "element_at(a.n, greatest(m.l, 0) + 1)"
    step = f"IF(m.e = m.l, 0D, {f(more + ' + 1')} - {f(more)} + IF(m.l < 0, 0D, {f(f'greatest({less} - 1, 0)')} - {f(less)}))"
    total = f"(a.s + {step})"
    hot = f"(m.i >= {w - 1} AND log2({w}D) - {total} / {w} >= {threshold})"
    return f"""aggregate({moves},
      named_struct('n', array_repeat(0, 128), 's', 0D, 'first', -1, 'last', -1),
      (a, m) -> named_struct('n', transform(a.n, (c, j) -> c + IF(j = m.e, 1, 0) - IF(j = m.l, 1, 0)), 's', {total},
        'first', IF({hot} AND a.first < 0, m.i - {w - 1}, a.first), 'last', IF({hot}, m.i - {w - 1}, a.last)),
      a -> named_struct('first', a.first, 'last', a.last))"""


def _entropy_spans(text: str, base: str) -> str:
    """SQL for the entropy spans of a text, given its base spans."""
    allowed = " OR ".join(f"m.whole RLIKE {quoted(p)}" for p in ALLOW)
    free = f"NOT exists({base}, b -> b.start < m.start + char_length(m.whole) AND m.start < b.end)"
    candidates = f"filter({matches(text, CANDIDATE)}, m -> m.whole RLIKE '[0-9]' AND m.whole RLIKE '[A-Za-z]' AND NOT ({allowed}) AND {free})"
    kind = "CASE WHEN m.whole RLIKE '^[0-9a-fA-F]+$' THEN 'hex' WHEN m.whole RLIKE '^[A-Za-z0-9]+$' THEN 'alnum' ELSE 'base64' END"
    threshold = f"CASE m.kind WHEN 'hex' THEN {THRESHOLDS['hex']}D WHEN 'alnum' THEN {THRESHOLDS['alnum']}D ELSE {THRESHOLDS['base64']}D END"
    classed = f"transform({candidates}, m -> named_struct('start', m.start, 'whole', m.whole, 'kind', {kind}))"
    windows = f"transform({classed}, k -> named_struct('start', k.start, 'kind', k.kind, 'w', {window_entropy('k.whole', threshold.replace('m.kind', 'k.kind'))}))"
    rank = f"{ORDER.index('entropy_hex')} + CASE k.kind WHEN 'hex' THEN 0 WHEN 'alnum' THEN 1 ELSE 2 END"
    return f"transform(filter({windows}, k -> k.w.first >= 0), k -> named_struct('start', k.start + k.w.first, 'rank', {rank}, 'kind', concat('entropy_', k.kind), 'end', k.start + k.w.last + {WINDOW}))"


def find(df: DataFrame, text: str = "text", into: str = "spans") -> DataFrame:
    """Add ``into``: array of (start, rank, kind, end), by start, then kind in the order of ``ORDER``."""
    t = f"coalesce(`{text}`, '')"
    base = f"""array_sort(concat({spans_of(matches(t, ASSIGN, 2), 'assign', 'char_length(m.part) >= 6')},
      {spans_of(matches(t, ACCESS), 'access')}, {spans_of(matches(t, HEX), 'hex')}))"""
    found = df.withColumn(into, F.expr(base).cast(SPAN))
    return found.withColumn(into, F.expr(f"array_sort(concat(`{into}`, {_entropy_spans(t, f'`{into}`')}))").cast(SPAN))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def mask(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace every span of ``text`` by its kind in brackets; overlapping spans become one mask."""
    (spans,) = shared.free_names(df, "_spans")
    out = find(df, text, spans)
    t = f"`{text}`"
    cut = f"""aggregate(`{spans}`, named_struct('at', 0, 'out', cast(array() AS array<string>)),
      (a, s) -> named_struct('at', greatest(a.at, s.end), 'out', IF(s.start < a.at, a.out, concat(a.out, array(substring({t}, a.at + 1, s.start - a.at), concat('[', s.kind, ']'))))),
      a -> concat(array_join(a.out, ''), substring({t}, a.at + 1)))"""
    return out.withColumn(text, F.expr(f"IF(size(`{spans}`) = 0, {t}, {cut})")).drop(spans)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(shared.table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "found")
    n = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("found", lambda s: s["rank"] < 3)
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def _duck_matches(pattern: str, name: str, group: int = 0) -> str:
    p = "'" + pattern.replace("'", "''") + "'"
    return f"""{name} AS (SELECT doc_id, i, w[i] AS whole, p[i] AS part,
      list_sum([length(x) FOR x IN g[1:i]]) + coalesce(list_sum([length(x) FOR x IN w[1:i-1]]), 0) AS start
      FROM (SELECT doc_id, w, p, g, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, {p}, 0) AS w,
      regexp_extract_all(text, {p}, {group}) AS p, string_split_regex(text, {p}) AS g FROM docs WHERE regexp_matches(text, {p}))))"""


_DUCK_ALLOW = " OR ".join(f"regexp_matches(whole, '{p}')" for p in ALLOW if "\\1" not in p) + " OR replace(whole, whole[1], '') = ''"

SQL = f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
{_duck_matches(ASSIGN, 'a', 2)}, {_duck_matches(ACCESS, 'k')}, {_duck_matches(HEX, 'h')}, {_duck_matches(CANDIDATE, 'c')},
base AS (SELECT doc_id, start, start + length(whole) AS stop, 0 AS rank, 'assign' AS kind FROM a WHERE length(part) >= 6
  UNION ALL SELECT doc_id, start, start + length(whole), 1, 'access' FROM k UNION ALL SELECT doc_id, start, start + length(whole), 2, 'hex' FROM h),
cand AS (SELECT doc_id, start, whole, CASE WHEN regexp_full_match(whole, '[0-9a-fA-F]+') THEN 'hex' WHEN regexp_full_match(whole, '[A-Za-z0-9]+') THEN 'alnum' ELSE 'base64' END AS kind
  FROM c WHERE regexp_matches(whole, '[0-9]') AND regexp_matches(whole, '[A-Za-z]') AND NOT ({_DUCK_ALLOW})
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = c.doc_id AND b.start < c.start + length(c.whole) AND c.start < b.stop)),
win AS (SELECT doc_id, start, kind, i, list_aggregate(string_split(substr(whole, i + 1, {WINDOW}), ''), 'entropy') AS h
  FROM (SELECT *, unnest(range(0, length(whole) - {WINDOW} + 1)) AS i FROM cand)),
ent AS (SELECT doc_id, start + min(i) AS start, start + max(i) + {WINDOW} AS stop, CASE kind WHEN 'hex' THEN 3 WHEN 'alnum' THEN 4 ELSE 5 END AS rank, 'entropy_' || kind AS kind
  FROM win WHERE h >= CASE kind WHEN 'hex' THEN {THRESHOLDS['hex']} WHEN 'alnum' THEN {THRESHOLDS['alnum']} ELSE {THRESHOLDS['base64']} END GROUP BY doc_id, win.start, win.kind),
every AS (SELECT *, kind || ':' || start || ':' || stop AS said FROM (SELECT * FROM base UNION ALL SELECT doc_id, start, stop, rank, kind FROM ent)),
by_doc AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(said, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(said, ',' ORDER BY start, rank) AS spans FROM every GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs d LEFT JOIN by_doc USING (doc_id)"""
