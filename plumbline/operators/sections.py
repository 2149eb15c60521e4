"""Sections of a manual: which section a code leads to, the text of a section, its products, standards and clauses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import head, normalize, strip
from plumbline.operators.joins import best_title
from plumbline.operators.manuals import section_starts

# Words that say nothing about a section, the least score of a match, how many pages a section's text has.
STOP = ("and", "of", "the", "for", "a", "to", "with", "or", "in", "at")
LEAST_SCORE, MOST_PAGES = 0.5, 6


def tokens(text: Column) -> Column:
    """Words of two letters and more that are no stop words."""
    return F.filter(F.split(normalize(text), " "), lambda t: (F.length(t) > 1) & ~t.isin(*STOP))


def section_map(codes: DataFrame, titles: DataFrame, seed: DataFrame, division: str | None = None) -> DataFrame:
    """code, section, method, confidence, suggestion, disputed of ``codes`` (code, expansion), derived or overridden.

    titles (section, title), of one division if given; seed (code, section) is the hand-made map.  The best title by the
    share of the expansion's words in it, the first on ties, is derived from LEAST_SCORE on.  Where it differs from the
    seed, or there is none, the seed overrides it and keeps it as a suggestion; without a seed the code is unresolved.
    """
    inside = titles if division is None else titles.filter(F.startswith("section", F.lit(division)))
    asked = codes.select(F.col("code").alias("query_id"), tokens(F.col("expansion")).alias("tokens"))
    best = best_title(asked, inside.select(F.col("section").alias("title_id"), tokens(F.col("title")).alias("tokens")), 0.0)
    found = codes.select("code").join(best.select(F.col("query_id").alias("code"), F.col("title_id").alias("_best"), "score"), "code", "left").join(seed.select("code", F.col("section").alias("_seed")), "code", "left")
    score = F.round(F.coalesce("score", F.lit(0.0)), 3)
    got = F.when(F.coalesce("score", F.lit(0.0)) >= LEAST_SCORE, F.col("_best"))
    derived = got.isNotNull() & (F.col("_seed").isNull() | (got == F.col("_seed")))
    override = F.col("_seed").isNotNull() & ~derived
    return found.select(
        "code", F.when(derived, got).otherwise(F.col("_seed")).alias("section"), F.when(derived, "derived_lexical").when(override, "override").otherwise("unresolved").alias("method"), score.alias("confidence"),
        F.when(override, got).alias("suggestion"), (override & got.isNotNull()).alias("disputed"),
    )


def section_texts(pages: DataFrame, by: list[str], page: str = "page", text: str = "text", most: int = MOST_PAGES) -> DataFrame:
    """by, section, start, pages, body: a section's pages, from the first that its head names to before another section's.

    At most ``most`` pages are a section's; a page of contents begins none, but its head may end one.
    """
    starts = section_starts(pages, by, page, text).withColumnRenamed(page, "start")
    named = F.nullif(F.regexp_extract(head(F.col(text)), r"SECTION\s+(\d{6})\s*[-–]", 1), F.lit(""))
    heads = pages.select(*by, F.col(page).alias("_p"), named.alias("_named"))
    near = starts.join(heads, by).filter((F.col("_p") > F.col("start")) & (F.col("_p") < F.col("start") + most) & (F.col("_named") != F.col("section")))
    stops = near.groupBy(*by, "section").agg(F.min("_p").alias("_stop"))
    spans = starts.join(stops, [*by, "section"], "left").withColumn("_stop", F.coalesce("_stop", F.col("start") + most))
    inside = spans.join(pages.select(*by, F.col(page).alias("_p"), F.col(text).alias("_t")), by).filter((F.col("_p") >= F.col("start")) & (F.col("_p") < F.col("_stop")))
    listed = inside.groupBy(*by, "section", "start").agg(F.array_sort(F.collect_list(F.struct("_p", F.coalesce("_t", F.lit("")).alias("_t")))).alias("_l"))
    return listed.select(*by, "section", "start", F.size("_l").alias("pages"), F.array_join(F.transform("_l", lambda x: x["_t"]), "\n").alias("body"))


def products(title: Column, body: Column) -> Column:
    """Names in the lists of a clause on manufacturers, distinct, in order: what stands between semicolons behind a list's marker.

    A name has 2 to 60 characters, begins with a capital and is no sentence on requirements.
    """
    items = F.filter(F.transform(F.split(body, "\n"), lambda x: F.regexp_extract(x, r"^\s*[a-z0-9]{1,2}[.)]\s+(.*)$", 1)), lambda x: x != "")
    pieces = F.flatten(F.transform(items, lambda x: F.split(x, ";")))
    names = F.transform(pieces, lambda x: strip(F.regexp_replace(strip(x), r"\.+$", "")))
    good = F.filter(names, lambda n: F.length(n).between(2, 60) & n.rlike(r"^\p{Lu}") & ~F.contains(F.lower(n), F.lit(" requirements")))
    return F.when(F.contains(title, F.lit("MANUFACTURER")), F.array_distinct(good)).otherwise(F.array().cast("array<string>"))


def clause(clauses: DataFrame, by: list[str], number: str) -> DataFrame:
    """Of every file the first clause of a number, over all parts."""
    from plumbline.operators.ordered import first_wins

    return first_wins(clauses.filter(F.col("clause") == number), by, [F.asc("ord")])


def all_standards(clauses: DataFrame, by: list[str]) -> DataFrame:
    """by, standards: the distinct standards of all clauses of all parts, in order of first mention."""
    said = clauses.select(*by, "ord", F.posexplode("standards").alias("_i", "standard"))
    first = said.groupBy(*by, "standard").agg(F.min(F.struct("ord", "_i")).alias("_at"))
    listed = first.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_at", "standard"))).alias("_l"))
    return listed.select(*by, F.transform("_l", lambda x: x["standard"]).alias("standards"))
