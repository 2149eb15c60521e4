"""Column-valued text functions: predicates, grammars and parsers; no Python runs in tasks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tokens whose hits a page profile counts.
ANCHORS = ("DIVISION", "SECTION", "TABLE OF CONTENTS", "SHEET NUMBER", "SHEET NAME", "DOOR SCHEDULE", "FIRE RATING", "HARDWARE SET", "ROOM FINISH SCHEDULE", "FINISH SCHEDULE", "ABBREVIATION")


def strip(s: Column) -> Column:
    """Without white space at both ends (SQL's trim knows blanks only)."""
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def normalize(s: Column) -> Column:
    """Lower case, everything but ASCII letters and digits one blank, trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), "[^a-z0-9]+", " "))


def squeeze(s: Column) -> Column:
    return strip(F.regexp_replace(s, r"\s+", " "))


def occurrences(text: Column, token: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(token), F.lit("")))) / len(token)).cast("int")


def anchor_hits(text: Column, tokens: tuple[str, ...] = ANCHORS) -> Column:
    """Map of the tokens that occur in the upper-case text to their counts."""
    # The upper-case text is bound once, and only tokens that occur are counted.
    found = lambda u: F.array_compact(F.array(*(F.when(F.contains(u, F.lit(t)), F.struct(F.lit(t).alias("k"), occurrences(u, t).alias("v"))) for t in tokens)))
    hits = F.get(F.transform(F.array(F.upper(text)), lambda u: F.map_from_entries(found(u))), 0)
    return F.when(text.isNotNull(), hits)


def size_class(width: Column, height: Column) -> Column:
    """letter under 1000 points of the longest edge, large from 1500 on, else other."""
    edge = F.greatest(width, height)
    return F.when(edge < 1000, "letter").when(edge >= 1500, "large").otherwise("other")


def short_tokens(text: Column) -> Column:
    """Words of one to four capitals, counted without splitting the text into words."""
    return F.regexp_count(text, F.lit(r"(?:^|[^\p{L}\p{N}_])[A-Z]{1,4}(?![\p{L}\p{N}_])"))


def has_all(text: Column, signature: Column) -> Column:
    """All of the signature's tokens occur in the lower-case text; an empty signature never matches."""
    return (F.size(signature) > 0) & F.forall(signature, lambda t: F.contains(F.lower(text), t))


def number(s: Column) -> Column:
    """The first decimal number anywhere, or null."""
    return F.nullif(F.regexp_extract(s, r"-?\d+(\.\d+)?", 0), F.lit("")).try_cast("double")


def first_digits(s: Column) -> Column:
    return F.nullif(F.regexp_extract(s, r"\d+", 0), F.lit("")).try_cast("int")


# What keys of schedule rows and kinds of positioned words look like.
TAG = r"^[A-Z]$|^[A-Z]{1,4}-?\d+[A-Z]?$"
DOOR_MARK = r"^[NS][A-Z]?\d{2,}[A-Z]{0,2}$"
ROOM = r"^[NS]\d{3}[A-Z]?$"
GRID = r"^([NS]-[A-Z0-9]{1,2}|[A-K]|[1-8])$"
SHEET_REFERENCE = r"^(SHEET\s+)?[A-Z]{1,3}\d+\.\d+(\.\d+)*$"
ROOM_NAME = r"^[A-Z][A-Z0-9 &/().\-]{2,}$"
SCALE = r"""(\d{1,2})(?:\s*/\s*(\d{1,3}))?\s*"\s*=\s*(\d{1,3})\s*['′]"""
SHEET_NUMBER = r"^[A-Z]{1,3}\d[A-Za-z0-9_.]*$"
# Disciplines by the letters of a sheet number, and drawing types by the first word found in a title.
DISCIPLINES = {
    "G": "General", "S": "Structural", "A": "Architectural", "AD": "Architectural", "AF": "Architectural", "FP": "Fire Protection", "P": "Plumbing", "PD": "Plumbing",
    "M": "Mechanical", "MD": "Mechanical", "E": "Electrical", "ED": "Electrical", "EMP": "Electrical", "T": "Technology", "Y": "Security",
}
DRAWING_TYPES = (
    ("REFLECTED CEILING PLAN", "Reflected Ceiling Plan"), ("SCHEDULE", "Schedule"), ("DEMOLITION", "Demolition Plan"), ("ENLARGED", "Enlarged Plan"), ("FLOOR PLAN", "Floor Plan"),
    ("ELEVATION", "Elevation"), ("SECTION", "Section"), ("DETAIL", "Detail"), ("ABBREVIATIONS", "Reference"), ("SYMBOLS", "Reference"),
)


def looks_like_tag(s: Column) -> Column:
    """A catalog tag: one capital, or up to four and a number of any length, a hyphen between, a letter behind."""
    return strip(s).rlike(TAG)


def looks_like_mark(s: Column) -> Column:
    """Two to eight letters or digits, one digit at least."""
    return s.rlike(r"^(?=.*\d)[A-Za-z0-9]{2,8}$")


def is_door_mark(s: Column) -> Column:
    return s.rlike(DOOR_MARK)


def is_room(s: Column) -> Column:
    return s.rlike(ROOM)


def discipline(sheet_number: Column) -> Column:
    """By the capitals that begin the number; Unknown else."""
    prefix = F.regexp_extract(sheet_number, "^[A-Z]+", 0)
    known = F.create_map(*(F.lit(x) for kv in DISCIPLINES.items() for x in kv))
    return F.coalesce(F.try_element_at(known, prefix), F.lit("Unknown"))


def drawing_type(title: Column) -> Column:
    """By the first of the rules whose word the title has; null if none."""
    upper, out = F.upper(title), F.lit(None).cast("string")
    for word, kind in reversed(DRAWING_TYPES):
        out = F.when(F.contains(upper, F.lit(word)), kind).otherwise(out)
    return out


def abbreviation_score(short_tokens_: Column) -> Column:
    """Rises with the number of short capital words and never reaches one."""
    return short_tokens_ / (short_tokens_ + 400.0)


def dedouble(s: Column) -> Column:
    """AABBCC is ABC: an even length of four or more whose even and odd letters agree."""
    half = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1)), F.lit(2)), lambda i: F.substring(s, i.cast("int"), F.lit(1)))
    odd = F.transform(F.sequence(F.lit(2), F.greatest(F.length(s), F.lit(2)), F.lit(2)), lambda i: F.substring(s, i.cast("int"), F.lit(1)))
    return F.when((F.length(s) >= 4) & (F.length(s) % 2 == 0) & (half == odd), F.array_join(half, "")).otherwise(s)


def scale_factor(s: Column) -> Column:
    """``N/M" = D'`` (or ``N" = D'``, with either mark for feet) as real size over drawn size, to four places; null if none or zero."""
    g = lambda i: F.nullif(F.regexp_extract(s, SCALE, i), F.lit("")).cast("double")
    drawn = g(1) / F.coalesce(F.nullif(g(2), F.lit(0.0)), F.when(g(2).isNull(), 1.0))
    return F.when(drawn > 0, F.round(g(3) * 12 / drawn, 4))


def snap_rotation(dx: Column, dy: Column) -> Column:
    """The direction's angle to the next quarter turn, 0 to 270."""
    return F.pmod((F.bround(F.degrees(F.atan2(dy, dx)) / 90) * 90).cast("int"), F.lit(360))


def head(text: Column, n: int = 8) -> Column:
    """The first n lines with text, joined, upper case."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: strip(x)), lambda x: x != "")
    return F.upper(F.array_join(F.slice(lines, 1, n), " "))


def token_kind(s: Column) -> Column:
    """What a positioned text is: the first that fits."""
    t = strip(s)
    return (
        F.when(t == "", "blank")
        .when(t.rlike(GRID), "grid_label")
        .when(t.rlike(ROOM), "door_mark")
        .when(t.rlike(SHEET_REFERENCE), "sheet_reference")
        .when(t.rlike(r"\d+'"), "dimension")
        .when(t.rlike(ROOM_NAME), "room_name")
        .otherwise("unknown")
    )
