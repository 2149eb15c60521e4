"""Document fingerprints by consistent weighted sampling, in DataFrame functions.

A text is its words (cut at white space) with their counts as weights.  For every
sample k and word, two hashes of the word give r and c, each the negative logarithm
of a product of two uniform numbers (a gamma variate of shape 2), and a uniform
beta.  With t = floor(ln(weight) / r + beta), the word's value is
ln c - r (t - beta + 1); the least value's (word, t) is the sample.  Two texts share
a sample with the probability of their generalised Jaccard similarity, so the share
of equal samples estimates it.

The fingerprint is eight hex digits for every sample; a text without words (null,
empty or blank) has the empty one, which is like itself (1) and unlike any other (0).
Repeated rows are rows of their own; null ids come last.  Empty tables give no rows.
Only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import shared

SAMPLES = 32
#: Rows of a bucket of ids in the next-document step, and parts that one cut makes at most.
BUCKET = 64
MOST_BUCKETS = 16_384
#: Cuts of a range at most; each makes a part at least a hundredth as wide where it is crowded.
MOST_CUTS = 12
#: Rows of three numbers that are broadcast at most.
BROADCAST_ROWS = 1_000_000


def _part(h: Column, at: int, bits: int) -> Column:
    """``bits`` bits of a hash as a number between 0 and 1."""
    return (F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << bits) - 1)) + 0.5) / float(1 << bits)


def sample(word: Column, weight_log: Column, k: int) -> Column:
    """One word's value (high 31 bits and sign) and the hash of (word, t) (low 32 bits), for sample ``k``."""
    a, b = F.xxhash64(word, F.lit(2 * k)), F.xxhash64(word, F.lit(2 * k + 1))
    r = -F.ln(_part(a, 0, 21) * _part(a, 21, 21))
    c = F.ln(-F.ln(_part(b, 0, 32) * _part(b, 32, 32)))
    t = F.floor(weight_log / r + _part(a, 42, 22))
    value = F.floor((c - r * (t - _part(a, 42, 22) + 1)) * float(1 << 20))
    return F.shiftleft(value, 32).bitwiseOR(a.bitwiseXOR(F.shiftleft(t, 7)).bitwiseAND(F.lit(0xFFFFFFFF)))


def blanks(text: Column) -> Column:
    """The text with every kind of ASCII white space turned into blanks."""
    return F.translate(text, "\n\t\r\f\x0b", "     ")


def fingerprints(df: DataFrame, key: list[str], segments: list[tuple[Column, tuple[int, ...]]], samples: int = SAMPLES) -> DataFrame:
    """``key`` and print0, print1 ...: fingerprints of several texts for each row.

    A segment is an array of words and the numbers of the texts that it is part of,
    so what texts share is hashed once.  If ``df`` is partitioned by some of
    ``key``, nothing is shuffled.
    """
    texts = sorted({t for _, of in segments for t in of})
    # The empty word stands for a text without words; it has no value.
    rows = df.select(*key, F.posexplode(F.array(*(F.concat(w, F.array(F.lit(""))) for w, _ in segments))).alias("_seg", "_words"))
    terms = rows.select(*key, "_seg", F.explode("_words").alias("_w")).select(*key, "_seg", F.when(F.col("_w") != "", F.xxhash64("_w")).alias("_h"))
    inside = lambda t: F.col("_seg").isin([i for i, (_, of) in enumerate(segments) if t in of])
    terms = terms.groupBy(*key, "_h").agg(*(F.sum(F.when(inside(t), 1).otherwise(0)).alias(f"_n{t}") for t in texts))
    logs = (F.when(F.col("_h").isNotNull() & (F.col(f"_n{t}") > 0), F.ln(f"_n{t}")).alias(f"_l{t}") for t in texts)
    least = terms.select(*key, "_h", *logs).groupBy(*key).agg(*(F.min(sample(F.col("_h"), F.col(f"_l{t}"), k)).alias(f"_s{t}_{k}") for k in range(samples) for t in texts))

    def digits(t: int) -> Column:
        return F.coalesce(F.lower(F.concat(*(F.lpad(F.hex(F.col(f"_s{t}_{k}").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0") for k in range(samples)))), F.lit(""))

    return least.select(*key, *(digits(t).alias(f"print{t}") for t in texts))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples of two fingerprints."""
    place = F.sequence(F.lit(0), F.lit(samples - 1))
    same = F.size(F.filter(place, lambda k: F.substring(a, k * 8 + 1, F.lit(8)) == F.substring(b, k * 8 + 1, F.lit(8))))
    return F.when((a == "") | (b == ""), F.when(a == b, 1.0).otherwise(0.0)).otherwise(same / float(samples))


def in_buckets(df: DataFrame, id_column: str) -> DataFrame:
    """Add _key (the id, nulls least) and _bucket, the least id that a range of ids may have, for windows over neighbouring ids.

    The ids' whole range is cut into equal parts; a part of more than ``4 * BUCKET`` rows is cut again between its own least
    and greatest id, and so on, so far-off ids change nothing.  Rows that repeat one id stay together.
    """
    key = F.coalesce(F.col(id_column).cast("long"), F.lit(-(1 << 63)))
    # One bucket to begin with; a number that depends on the row, so that the first cut is an equi-join like the others.
    out = df.withColumn("_key", key).withColumn("_bucket", F.col("_key").bitwiseAND(F.lit(0).cast("long")))
    ids = out.filter(F.col(id_column).isNotNull()).select("_key", "_bucket")
    cuts = []
    for _ in range(MOST_CUTS):
        per = ids.groupBy("_bucket").agg(F.count("*").alias("n"), F.min("_key").alias("low"), F.max("_key").alias("high")).filter((F.col("n") > 4 * BUCKET) & (F.col("low") < F.col("high")))
        step = F.ceil((F.col("high").cast("decimal(20,0)") - F.col("low") + 1) / F.least(F.floor(F.col("n") / BUCKET), F.lit(MOST_BUCKETS))).cast("decimal(20,0)")
        cut = shared.written(per.select(F.col("_bucket").alias("_old"), "low", step.alias("step")), "print-cuts")
        if not cut.limit(1).count():
            break
        cuts.append(cut)
        ids = _cut_again(ids, cut)
    nulls = out.filter(F.col(id_column).isNull()).withColumn("_bucket", F.col("_key"))
    rows = out.filter(F.col(id_column).isNotNull())
    for cut in cuts:
        rows = _cut_again(rows, cut)
    return rows.unionByName(nulls)


def _cut_again(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """``rows`` with their _bucket replaced by the part of it they lie in; ``cut`` has a row for 4 * BUCKET rows at most."""
    part = (F.col("low") + F.floor((F.col("_key").cast("decimal(20,0)") - F.col("low")) / F.col("step")) * F.col("step")).cast("long")
    near = rows.join(F.broadcast(cut) if cut.count() <= BROADCAST_ROWS else cut, rows["_bucket"] == cut["_old"], "left")
    return near.withColumn("_bucket", F.coalesce(part, F.col("_bucket"))).drop("_old", "low", "step")


def ring(df: DataFrame) -> DataFrame:
    """_bucket, _top (its greatest _key) and _before: the bucket whose last row the top row follows.

    ``df`` has _bucket and _key; the result has a row of three numbers for each bucket.
    """
    tops = df.select("_bucket", "_key").groupBy("_bucket").agg(F.max("_key").alias("_top"))
    ranges = tops.repartitionByRange(shared.partitions(df.sparkSession), F.desc("_bucket")).select("_bucket", "_top", F.spark_partition_id().alias("_range"))
    ranges = shared.written(ranges, "print-ring")
    # Neighbours are found inside ranges, then over ranges, which are as many as shuffle partitions at most.
    over = Window.orderBy("_range")
    last = F.last("_low").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ends = ranges.groupBy("_range").agg(F.min("_bucket").alias("_low")).select("_range", F.coalesce(F.lag("_low").over(over), last).alias("_outside"))
    inside = F.lag("_bucket").over(Window.partitionBy("_range").orderBy(F.desc("_bucket")))
    return shared.written(ranges.withColumn("_inside", inside).join(F.broadcast(ends), "_range").select("_bucket", "_top", F.coalesce("_inside", "_outside").alias("_before")), "print-tops")


def with_next(df: DataFrame, tops: DataFrame, value: str, into: str, order: list[Column]) -> DataFrame:
    """Add ``into``: ``value`` of the next row by falling _key, then ``order``; after the last row comes the first.

    ``df`` has _bucket, _key; ``tops`` is its ring().  The top rows of a bucket also go, as guests, behind the
    rows of the bucket before it; so one shuffle by _bucket serves all.  The result
    is partitioned by _bucket and has _rn, a row's number in its bucket.
    """
    guest = F.array(F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("g")), F.when(F.col("_key") == F.col("_top"), F.struct(F.col("_before").alias("b"), F.lit(True).alias("g"))))
    dealt = df.join(F.broadcast(tops) if tops.count() <= BROADCAST_ROWS else tops, "_bucket").withColumn("_to", F.explode(F.filter(guest, lambda x: x.isNotNull())))
    dealt = dealt.withColumn("_bucket", F.col("_to.b")).withColumn("_guest", F.col("_to.g")).drop("_to", "_top", "_before")
    at = Window.partitionBy("_bucket").orderBy("_guest", F.desc("_key"), *order)
    return dealt.withColumn(into, F.lead(value).over(at)).withColumn("_rn", F.row_number().over(at)).filter("not _guest").drop("_guest")


def op5_weighted_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = shared.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = in_buckets(documents, "doc_id")
    tops = ring(docs)
    pair = with_next(docs, tops, "text", "_next", [F.col("text")])
    size = F.char_length("text")
    half = F.floor(size / 2).cast("int")
    # Both texts begin alike; the last word before the cut may go on in either.
    kept = F.substring("text", F.lit(1), (size - half).cast("int"))
    pair = pair.withColumn("_kept", kept).withColumn("_new", F.substring("_next", F.lit(1), half)).withColumn("_old", F.substring("text", (size - half + 1).cast("int"), half))
    open_word = F.substring_index(blanks(F.col("_kept")), " ", -1)
    begin = F.substring("_kept", F.lit(1), F.char_length("_kept") - F.char_length(open_word))
    words = lambda x: F.split(blanks(x), " ")
    segments = [(words(begin), (0, 1)), (words(F.concat(open_word, "_old")), (0,)), (words(F.concat(open_word, "_new")), (1,))]
    prints = fingerprints(pair, ["_bucket", "_rn", "_key", "doc_id"], segments)
    about = pair.select("_bucket", "_rn", "_key", "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.concat("_kept", "_new"), 256).alias("edited_sha256"))
    both = about.join(prints.drop("_key", "doc_id"), ["_bucket", "_rn"]).withColumnRenamed("print0", "fingerprint").withColumnRenamed("print1", "edited_fingerprint")
    out = with_next(both.withColumn("_place", F.col("_rn")).drop("_rn"), tops, "fingerprint", "_next_print", [F.col("_place")])
    return out.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("_next_print")).alias("near_next"),
    )
