"""Fuzzy line dedup in DataFrame functions: SimHash, pigeonhole blocks, edit similarity, connected groups.

A line is what stands between line feeds; it is compared by its normal form (lower case, without ASCII marks,
trimmed) and named by that form's 64-bit hash, so equal forms are one node.  Every distinct form is signed once: its
SimHash sums the bits of the hashes of its word pairs (a word and the one after it), and each of its ``RUNS`` run
hashes is the least of one view of the hashes of its runs of ``RUN`` words (of its word pairs, if it has fewer than
``SHORT`` words).  Several blanks count as one there.

Forms meet in buckets.  The 64 bits are five blocks; forms that agree in two of them meet (every pair within three
bits does), and so do forms with an equal run hash (lines with a few words changed share some of these).  A bucket is
never cut nor refined, however many forms it has: whether two forms meet depends on these two only.

Candidates are verified in three rounds, and links that hold are joined to groups after each.  First each form is held
against the nearest of its buckets' least forms, then against those of them that are in another group, and at last all
forms of a bucket that are in different groups are held against each other.  So every pair of a bucket is either verified or already in one group, and a bucket full of near copies costs
as many pairs as it has rows.  A large bucket of many groups is held against itself inside a join, forms of about
one length outside its largest group against all others, in parts of some ``SPREAD`` forms on either side, or some
``PARTS`` parts if that is fewer, so that what is shuffled does not grow with the square of a bucket.  A pair is
compared in the first bucket that both share, if its letters, counted once for each form, allow the edit distance (this
loses no near pair), and only links leave the join.  A pair holds if its SimHashes differ in at most ``most_bits`` bits and the edit distance
of the normal forms is at most (1 - ``similarity``) of the longer one.  Words that both have at their ends are cut
off before the distance is taken, and a pair of which a coarser distance already bounds it needs no other.

Of each connected group the first occurrence, by (doc_id, line number), stays.
Lines without letters or digits are never repeats and stay.  A null text stays null.
Rows that repeat both id and text are one document and are all answered alike; null
ids come first.  Empty tables give no rows.  Other columns pass through whatever their names are, but
``n_lines`` and ``n_kept`` of ``dedup`` take the place of columns of these names.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .components import components

SIMILARITY = 0.85
#: Word pairs change faster than words: a line with one word in seven changed is some 16 bits away, any other line 32.
MOST_BITS = 22
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Words in a run, and run hashes of a form.
RUN, RUNS = 4, 4
#: Words below which a form's run hashes are those of its word pairs.
SHORT = 20
#: Forms of a bucket that one part of it has on each side, about, in the last round; and parts that it has on a side at most,
#: as each form is dealt to so many.
SPREAD, PARTS = 512, 16
#: Slices that the lines are dealt to by their form; what shuffles texts takes them one after the other.
SLICES = 2
#: Characters of texts that are put beside pairs, or dealt to parts of buckets, at once; a quarter of all, if that is more.
AT_ONCE = 128 << 20
#: Spark's setting that leaves what follows an AND or an OR to the rows that it is needed for.
LAZILY = "spark.sql.subexpressionElimination.skipForShortcutExpr"
#: What a normal form is without: all ASCII marks, tabs and carriage returns.
MARKS = r"[\p{Punct}\t\r]+"
#: Characters that are counted: edits change the counts of two near lines by so many at most.  Four to a number.
LETTERS = "etaoinshrdlucmfwypvbgkz "
#: Bytes of a broadcast side at most, as the driver holds it several times over; beyond it the sides are joined by a salted shuffle.
BROADCAST_BYTES = 4 << 20
SALTS = 16
#: Characters from which a line's distance is bounded by that of its pieces first; it saves work and changes no result.
LONG = 2_000
#: Words that 8-bit counters can sum without touching the sign.
CHUNK = 127
_ONES8 = 0x0101010101010101


def occurrences(docs: DataFrame) -> DataFrame:
    """_d, _t (id and text hash), line, form, _norm of every line that has a normal form."""
    text = F.lower(F.regexp_replace("text", MARKS, ""))
    rows = docs.select(F.col("doc_id").alias("_d"), F.xxhash64("text").alias("_t"), F.posexplode(F.split(text, "\n")).alias("line", "_raw"))
    return rows.select("_d", "_t", "line", F.trim("_raw").alias("_norm")).filter("_norm <> ''").withColumn("form", F.xxhash64("_norm"))


def sliced(lines: DataFrame) -> list[DataFrame]:
    """The slices of lines that have a number of theirs (_slice); others are one."""
    return [lines.filter(F.col("_slice") == i) for i in range(SLICES)] if "_slice" in lines.columns else [lines]


def slice_of(form: str) -> Column:
    return F.pmod(F.col(form), F.lit(SLICES)).cast("int")


def added(df: DataFrame, name: str, table: DataFrame | None) -> DataFrame:
    """``table`` with the rows of ``df``, or a new table of them."""
    return shared.written(df, name) if table is None else shared.appended(df, table)


def words_of(text: str) -> Column:
    """What stands between blanks; only a text with several in a row needs a pattern."""
    return F.when(F.contains(text, F.lit("  ")), F.split(text, " +")).otherwise(F.split(text, " "))


def distinct_forms(lines: DataFrame) -> DataFrame:
    """form, _norm, _d, _t, line (its first occurrence), n (its occurrences)."""
    found = lines.groupBy("form").agg(F.first("_norm").alias("_norm"), F.min(F.struct("_d", "_t", "line")).alias("f"), F.count("*").alias("n"))
    return found.select("form", "_norm", "f.*", "n")


def letter_counts() -> list[Column]:
    """_l0 ...: how often _norm has each of ``LETTERS``, in 16 bits each, at most 32,767; and _letters, their sum."""
    found = [F.least(F.char_length("_norm") - F.char_length(F.replace("_norm", F.lit(c), F.lit(""))), F.lit(32_767)).cast("long") for c in LETTERS]
    packed = [reduce(Column.bitwiseOR, (F.shiftleft(n, 16 * j) for j, n in enumerate(found[k : k + 4]))) for k in range(0, len(LETTERS), 4)]
    return [*(x.alias(f"_l{k}") for k, x in enumerate(packed)), reduce(Column.__add__, found).alias("_letters")]


def letters_allow(a: str, b: str, similarity: float) -> Column:
    """Whether the letters of two forms, by prefix, differ by no more than their edit distance may be; loses no near pair."""
    return letters_apart(a, b) <= F.lit(2 * (1 - similarity)) * F.greatest(f"{a}size", f"{b}size") + 1e-6


def letters_apart(a: str, b: str) -> Column:
    """Twice the edits that the letters of two forms, by prefix, show at least.

    An edit adds one letter at most and takes one away at most, so neither the letters that one has over the other nor
    those that it lacks are more than the edits.  Other characters, and letters beyond the counter, are left out of both.
    The greater of the two is half of all differences and of that of the sums.
    """
    one = lambda side, k: F.shiftrightunsigned(f"{side}_l{k // 4}", 16 * (k % 4)).bitwiseAND(F.lit(0xFFFF))
    apart = reduce(Column.__add__, (F.abs(one(a, k) - one(b, k)) for k in range(len(LETTERS))))
    return apart + F.abs(F.col(f"{a}_letters") - F.col(f"{b}_letters"))


def _rotated(h: str, by: int) -> Column:
    return F.col(h) if not by else F.shiftleft(h, by).bitwiseOR(F.shiftrightunsigned(h, 64 - by))


def _counted(forms: DataFrame, keep: list[str]) -> DataFrame:
    """form, ``keep``, size, _n (words), _least, _c0 ..., run0 ... of every chunk of ``CHUNK`` words of ``forms`` (form, _norm).

    Counter byte j of _ci holds bit 8 j + i.  If ``forms`` is partitioned by form, nothing is shuffled.
    """
    words = forms.select("form", *keep, F.char_length("_norm").alias("size"), words_of("_norm").alias("_w"))
    word = words.select("form", *keep, "size", "_w", F.posexplode("_w").alias("_at", "_word"))
    nth = lambda k: F.get("_w", F.col("_at") + k)
    word = word.withColumn("_h", F.xxhash64("_word", F.coalesce(nth(1), F.lit(""))))
    # A short line has few longer runs that a changed word leaves as they are.
    run = F.when(F.size("_w") < SHORT, F.col("_h")).when(F.col("_at") + RUN <= F.size("_w"), F.xxhash64("_h", *(nth(k) for k in range(2, RUN))))
    word = word.select("form", *keep, F.size("_w").alias("words"), "size", F.expr(f"_at div {CHUNK}").alias("_chunk"), "_h", run.alias("_r"))
    byte = [F.sum(F.shiftrightunsigned("_h", i).bitwiseAND(F.lit(_ONES8))).alias(f"_c{i}") for i in range(8)]
    runs = [F.min(_rotated("_r", 64 // RUNS * k)).alias(f"run{k}") for k in range(RUNS)]
    return word.groupBy("form", "_chunk").agg(*(F.first(c).alias(c) for c in keep), F.max("words").alias("_n"), F.max("size").alias("size"), F.min("_h").alias("_least"), *byte, *runs)


def _simhash_short() -> Column:
    """The SimHash from the counters of one chunk: each is compared with half of _n inside its own 16 bits."""
    ones, tie, n = F.lit(0x0001000100010001), F.xxhash64("_least"), F.col("_n")
    out = F.lit(0).cast("long")
    for i in range(8):
        for half in (0, 8):
            count = F.shiftrightunsigned(f"_c{i}", half).bitwiseAND(F.lit(0x00FF00FF00FF00FF))
            over = F.shiftrightunsigned(count + (CHUNK - F.floor(n / 2)) * ones, 7).bitwiseAND(ones)
            half_or_over = F.shiftrightunsigned(count + (CHUNK + 1 - F.ceil(n / 2)) * ones, 7).bitwiseAND(ones)
            out = out.bitwiseOR(F.shiftleft(over, i + half)).bitwiseOR(F.shiftleft(half_or_over, i + half).bitwiseAND(tie))
    return out


def _whole(chunks: DataFrame, keep: list[str]) -> DataFrame:
    """The chunks of longer lines summed by form in counters of 32 bits, and their SimHash."""
    wide = []
    for k in range(32):
        low, high = (F.shiftrightunsigned(f"_c{k % 8}", 8 * (b // 8)).bitwiseAND(F.lit(255)) for b in (k, 32 + k))
        wide.append(F.sum(low.bitwiseOR(F.shiftleft(high, 32))).alias(f"_s{k}"))
    kept = [F.first(c).alias(c) for c in keep]
    whole = chunks.groupBy("form").agg(*kept, F.max("size").alias("size"), F.max("_n").alias("_n"), F.min("_least").alias("_least"), *wide, *(F.min(f"run{k}").alias(f"run{k}") for k in range(RUNS)))
    simhash, tie = F.lit(0).cast("long"), F.xxhash64("_least")
    for k in range(32):
        low, high = F.col(f"_s{k}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"_s{k}", 32)
        for bit, count in ((k, low), (32 + k, high)):
            own = F.shiftleft(F.lit(1).cast("long"), bit)
            simhash = simhash.bitwiseOR(F.when(count * 2 > F.col("_n"), own).when(count * 2 == F.col("_n"), tie.bitwiseAND(own)).otherwise(F.lit(0).cast("long")))
    return whole.withColumn("simhash", simhash)


def signed_forms(forms: DataFrame, keep: list[str], onto: DataFrame | None = None) -> DataFrame:
    """form, ``keep``, size (characters), simhash, pair0 ..., run0 ...: one row for each of ``forms`` (form, _norm), added ``onto`` others.

    Bit i of a SimHash is set where over half of the hashes have it.  Where just half have it, the hash of the least
    hash decides: it depends on the line and seldom changes with an edit.
    """
    chunks = shared.written(_counted(forms, keep), "line-chunks")
    # The least hashes of a form without runs are those of its word pairs, and are named so.
    few = F.col("_n") < RUN
    runs = [F.when(few, F.col(f"run{k}")).alias(f"pair{k}") for k in range(RUNS)] + [F.when(~few, F.col(f"run{k}")).alias(f"run{k}") for k in range(RUNS)]
    out = ["form", *keep, "size", "simhash", *runs]
    short = chunks.filter(F.col("_n") <= CHUNK).withColumn("simhash", _simhash_short()).select(*out)
    signed = added(short.unionByName(_whole(chunks.filter(F.col("_n") > CHUNK), keep).select(*out)), "line-forms", onto)
    shared.discard(chunks)
    return signed


def block_keys(simhash: Column) -> list[Column]:
    """One number for each pair of blocks: the blocks' bits, then the pair's number; none is below zero."""
    keys = []
    for n, (a, b) in enumerate(combinations(BLOCKS, 2)):
        one, two = (F.shiftrightunsigned(simhash, at).bitwiseAND(F.lit((1 << w) - 1)) for at, w in (a, b))
        keys.append(F.shiftleft(one, 20).bitwiseOR(F.shiftleft(two, 4)).bitwiseOR(F.lit(n)))
    return keys


def run_keys() -> list[Column]:
    """One number below zero for each run hash, or for each hash of word pairs of a form without runs."""
    return [F.xxhash64(F.coalesce(f"run{k}", f"pair{k}"), F.lit(k)).bitwiseOR(F.lit(-(1 << 63))) for k in range(RUNS)]


def alike(a: str, b: str, similarity: float, most_bits: int) -> Column:
    """Whether two (simhash, size) columns, by prefix, may belong to lines near enough."""
    bits = F.bit_count(F.col(f"{a}simhash").bitwiseXOR(F.col(f"{b}simhash"))) <= most_bits
    return bits & (F.least(f"{a}size", f"{b}size") >= similarity * F.greatest(f"{a}size", f"{b}size"))


def joined(large: DataFrame, small: DataFrame, key: str, spread: str, row_bytes: int, how: str = "inner") -> DataFrame:
    """Join on ``key``: ``small`` is broadcast if counted small enough, else ``large`` is dealt over salts by ``spread``."""
    if small.count() * row_bytes <= BROADCAST_BYTES:
        return large.join(F.broadcast(small), key, how)
    salted = large.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies, [key, "_salt"], how).drop("_salt")


def near_text(a: str, b: str, similarity: float, least: str | None = None) -> Column:
    """Whether the edit distance of two different normal forms is at most (1 - ``similarity``) of the longer one.

    ``least``: a column that the distance is known not to be below.
    """
    wa, wb = F.split(a, " "), F.split(b, " ")
    most = F.floor(F.lit(1 - similarity) * F.greatest(F.char_length(a), F.char_length(b)) + 1e-9).cast("int")
    # Words differ at these places only: putting one for the other costs the longer one's letters at most.
    cost = F.zip_with(wa, wb, lambda x, y: F.when(x == y, 0).otherwise(F.greatest(F.char_length(x), F.char_length(y))))
    few = (F.size(wa) == F.size(wb)) & (F.aggregate(cost, F.lit(0), lambda s, x: s + x) <= most)
    # Long lines: an edit of pieces, three letters at most and cut anew at every word, costs three letters at most.  A
    # piece is a character, by its hash; one edit more than found is allowed for, should a changed one have its old hash.
    code = lambda w: F.lpad(F.hex(F.pmod(F.xxhash64(w), F.lit(0xC000)) + 0x100), 4, "0")
    coded = lambda x: F.decode(F.unhex(F.array_join(F.transform(F.regexp_extract_all(x, F.lit(" [^ ]{0,2}|[^ ]{1,3}"), 0), code), "")), "UTF-16BE")
    edits = F.floor(most / 3).cast("int") - 1
    by_piece = (F.char_length(a) > LONG) & (F.call_function("levenshtein", coded(a), coded(b), F.greatest(edits, F.lit(0))) >= 0)
    head = F.array_position(F.zip_with(wa, wb, lambda x, y: x.eqNullSafe(y)), False).cast("int") - 1
    tail = F.array_position(F.zip_with(F.reverse(wa), F.reverse(wb), lambda x, y: x.eqNullSafe(y)), False).cast("int") - 1
    # Bound once as lambda variables, so that nothing is taken twice.
    ends = F.transform(F.array(F.struct(head.alias("h"), F.least(tail, F.least(F.size(wa), F.size(wb)) - head).alias("t"))), lambda e: e)
    middle = lambda w, e: F.array_join(F.slice(w, e["h"] + 1, F.size(w) - e["h"] - e["t"]), " ")
    cut = F.transform(ends, lambda e: F.struct(middle(wa, e).alias("a"), middle(wb, e).alias("b")))

    # The work grows with the bound, and many pairs stay far below it.
    within = lambda m, bound: F.call_function("levenshtein", m["a"], m["b"], bound) >= 0

    def close(m: Column) -> Column:
        # With nothing left on one side, the other side's blank goes, too.
        gap = F.char_length(F.concat(m["a"], m["b"])) + 1
        low = F.floor(most / 4).cast("int")
        soon = within(m, low) if least is None else (F.col(least) <= low) & within(m, low)
        return F.when((m["a"] == "") | (m["b"] == ""), gap <= most).otherwise(soon | within(m, most))

    return F.when(few, True).when(by_piece, True).otherwise(F.exists(cut, close))


def texts_of(forms: DataFrame, lines: DataFrame, *more: Column) -> DataFrame:
    """form, _norm, ``more`` of every one of ``forms`` (form, repeated or not); texts are those of ``lines``."""
    wanted, texts, parts = shared.written(forms.select("form").distinct(), "line-wanted"), None, sliced(lines)
    for i, part in enumerate(parts):
        own = wanted if len(parts) == 1 else wanted.filter(slice_of("form") == i)
        found = joined(part.select("form", "_norm", "_t"), own, "form", "_t", 16, "left_semi").groupBy("form").agg(F.first("_norm").alias("_norm"))
        texts = added(found.select("form", "_norm", *more), "line-texts", texts)
    shared.discard(wanted)
    return texts


def verified(pairs: DataFrame, texts: DataFrame | None, similarity: float, at_once: int = AT_ONCE, onto: DataFrame | None = None) -> DataFrame:
    """Those of ``pairs`` (a, b), without repetition, whose forms' edit distance is small enough, added ``onto`` others; all are in ``texts`` (form, _norm).

    Pairs have their characters beside them (_chars), and about ``at_once`` of these are put beside pairs at a time.
    Without ``texts`` the pairs have both texts beside them (_xa, _xb) and the least distance (_least); they are
    compared in the join that makes them and never written.
    """
    spark, links = pairs.sparkSession, onto
    if texts is None:
        with shared.setting(spark, LAZILY, "true", "false"):
            return added(pairs.filter(near_text("_xa", "_xb", similarity, "_least")).select("a", "b"), "line-links", links)
    parts = 1 + (pairs.agg(F.sum("_chars")).first()[0] or 0) // at_once
    for i in range(parts):
        some, said = pairs.select("a", "b"), texts.select("form", "_norm")
        if parts > 1:
            some = some.filter(F.pmod(F.xxhash64("a", "b"), F.lit(parts)) == i)
            own = shared.written(some.select(F.explode(F.array("a", "b")).alias("form")).distinct(), "line-wanted")
            said = joined(said, own, "form", "form", 16, "left_semi")
        text = lambda x: said.select(F.col("form").alias(x), F.col("_norm").alias(f"_x{x}"))  # noqa: B023, E731
        # Long lines cost most, so pairs are written with both texts, dealt evenly over many files, before they are compared.
        both = some.join(text("a"), "a").join(text("b"), "b").repartition(4 * shared.partitions(spark), F.xxhash64("a", "b"))
        both = shared.written(both, "line-both")
        with shared.setting(spark, LAZILY, "true", "false"):
            links = added(both.filter(near_text("_xa", "_xb", similarity)).select("a", "b"), "line-links", links)
        shared.discard(both, *([own] if parts > 1 else []))
    return links


def first_shared(a: str, b: str) -> Column:
    """What names the first bucket that two forms, by prefix, share: a run key (below zero) or the number of a pair of blocks."""
    runs = (F.when(F.col(f"{a}_r{k}") == F.col(f"{b}_r{k}"), F.col(f"{a}_r{k}")) for k in range(RUNS))
    differ = F.col(f"{a}simhash").bitwiseXOR(F.col(f"{b}simhash"))
    bits = lambda block: ((1 << block[1]) - 1) << block[0]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    blocks = (F.when(differ.bitwiseAND(F.lit(signed(bits(x) | bits(y)))) == 0, F.lit(n).cast("long")) for n, (x, y) in enumerate(combinations(BLOCKS, 2)))
    return F.coalesce(*runs, *blocks)


def across(labels: DataFrame, similarity: float, most_bits: int) -> DataFrame:
    """Pairs (a, b, _xa, _xb, _least) of forms of one bucket and of different groups, each in the first bucket that both share.

    ``labels`` has a row for each bucket and form: key, least, form, simhash, size, _r0 ..., label, _norm, the letters, and
    of the bucket its largest group and the parts that its forms are dealt to.  Both sides are dealt, so that a task holds
    and compares a bounded part of a bucket.  What a caller asks of the pairs is asked inside the join.
    """
    wide = -math.log(max(similarity, 0.01) * 0.999)
    band = lambda reach: F.floor((F.log(F.col("size").cast("double")) + reach) / (4 * wide))
    part = lambda n: F.pmod(F.xxhash64("form"), F.col(n))
    parts = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    forms = [c for c in labels.columns if c not in ("key", "least", "_main", "_ones", "_others")]
    one = labels.filter("label <> _main").select("key", "least", *forms, band(0).alias("_band"), part("_ones").alias("_part"), parts("_others").alias("_piece"))
    other = labels.select("key", *(F.col(c).alias(f"_{c}") for c in forms), "_main", "_ones", part("_others").alias("_piece"), F.explode(F.sequence(band(-wide), band(wide))).alias("_band"))
    other = other.withColumn("_part", parts("_ones")).drop("_ones")
    at = ["key", "_band", "_part", "_piece"]
    # As many partitions however few bytes there are: what costs are the comparisons.
    dealt = lambda side: side.repartition(4 * shared.partitions(side.sparkSession), *at)
    once = F.expr("label < _label OR (label > _label AND _label = _main)") & F.expr("form <> least AND _form <> least")
    same = F.when(F.col("key") < 0, F.col("key")).otherwise(F.col("key").bitwiseAND(F.lit(15)))
    maybe = once & alike("", "_", similarity, most_bits) & (first_shared("", "_") == same) & letters_allow("", "_", similarity)
    both = dealt(one).join(dealt(other).hint("merge"), at).filter(maybe)
    return both.select(F.col("form").alias("a"), F.col("_form").alias("b"), F.col("_norm").alias("_xa"), F.col("__norm").alias("_xb"), F.ceil(letters_apart("", "_") / 2).alias("_least"))


def meeting(labels: DataFrame, similarity: float, most_bits: int) -> DataFrame:
    """``labels`` without forms of buckets of one part that may be linked to no other form there; most of a large table's are such."""
    few = labels.filter("_others = 1")
    others = few.filter("form <> least").select("key", *(F.col(c).alias(f"_{c}") for c in ("form", "label", "simhash", "size", *(f"_r{k}" for k in range(RUNS)))))
    same = F.when(F.col("key") < 0, F.col("key")).otherwise(F.col("key").bitwiseAND(F.lit(15)))
    maybe = F.expr("form <> least AND label <> _label") & alike("", "_", similarity, most_bits) & (first_shared("", "_") == same)
    there = others.withColumnRenamed("key", "_key")
    met = few.join(there.hint("merge"), (F.col("key") == F.col("_key")) & maybe, "left_semi")
    return met.unionByName(labels.filter("_others > 1"))


def buckets_of(keyed: DataFrame, keep: list[str]) -> DataFrame:
    """key, ``keep``, n, least, most of every bucket of two or more forms."""
    return keyed.groupBy("key", *keep).agg(F.count("*").alias("n"), F.min("form").alias("least"), F.max("form").alias("most")).filter("n > 1")


def bucketed(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """a, b: every form of a bucket and the bucket's least form; and key, least, form of buckets of more than two, written.

    Some of the keys at a time, as they take more room than the texts.
    """
    blocks, pairs, members = block_keys(F.col("simhash")), [], None
    half = len(blocks) // 2
    for keys in (blocks[:half], blocks[half:], run_keys()):
        keyed = signed.select("form", F.explode(F.array(*keys)).alias("key"))
        buckets = shared.written(buckets_of(keyed, []), "line-buckets")
        # Buckets of two are pairs already; the forms of others are looked up.
        members = added(joined(keyed, buckets.filter("n > 2").select("key", "least"), "key", "form", 16), "line-members", members)
        pairs.append(shared.written(buckets.filter("n = 2").select(F.col("least").alias("a"), F.col("most").alias("b")), "line-twos"))
        shared.discard(buckets)
    pairs.append(members.filter("form <> least").select(F.col("least").alias("a"), F.col("form").alias("b")))
    shared.tidied(signed.sparkSession)
    return reduce(DataFrame.unionByName, pairs).distinct(), members


def groups(signed: DataFrame, lines: DataFrame, similarity: float = SIMILARITY, most_bits: int = MOST_BITS) -> DataFrame:
    """(form, root) of every form that is linked to another one."""
    own = signed.select("form", "simhash", "size")
    at_once = max(AT_ONCE, (own.agg(F.sum("size")).first()[0] or 0) // 4)
    pairs, members = bucketed(signed)
    about = lambda x: own.select(F.col("form").alias(x), F.col("simhash").alias(f"{x}simhash"), F.col("size").alias(f"{x}size"))
    bits = F.bit_count(F.col("asimhash").bitwiseXOR(F.col("bsimhash")))
    pairs = pairs.join(about("a"), "a").join(about("b"), "b").filter(alike("a", "b", similarity, most_bits))
    pairs = shared.written(pairs.select("a", "b", bits.alias("bits"), "asize", "bsize"), "line-pairs")
    texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("form")), lines, *letter_counts())
    letters = [c for c in texts.columns if c.startswith("_l")]
    spelt = lambda x: texts.select(F.col("form").alias(x), *(F.col(c).alias(f"{x}{c}") for c in letters))
    likely = pairs.join(spelt("a"), "a").join(spelt("b"), "b").filter(letters_allow("a", "b", similarity))
    likely = shared.written(likely.select("a", "b", "bits", (F.col("asize") + F.col("bsize")).alias("_chars")), "line-likely")
    shared.discard(pairs)
    shared.tidied(lines.sparkSession)
    # First round: each form and the nearest form that it may be linked to.
    nearest = shared.written(likely.groupBy("b").agg(F.min(F.struct("bits", "a", "_chars")).alias("x")).select(F.col("x.a").alias("a"), "b", "x._chars"), "line-nearest")
    first = verified(nearest, texts, similarity, at_once)
    rooted = shared.written(components(first), "line-first")
    # Second round: what met the least form of a bucket and is not yet in its group.
    label = lambda x: rooted.select(F.col("node").alias(x), F.col("root").alias(f"_{x}"))
    apart = F.coalesce("_a", "a") != F.coalesce("_b", "b")
    rest = likely.join(label("a"), "a", "left").join(label("b"), "b", "left").filter(apart).select("a", "b", "_chars").join(nearest, ["a", "b"], "left_anti")
    rest = shared.written(rest, "line-rest")
    second = verified(rest, texts, similarity, at_once)
    shared.discard(texts, likely, nearest, rest, first)
    # A group so far is a star around its root.
    star = lambda: rooted.select(F.col("node").alias("a"), F.col("root").alias("b"))
    rooted = shared.written(components(star().unionByName(second)), "line-second")
    shared.discard(second)
    shared.tidied(lines.sparkSession)
    # Third round: forms of one bucket and of different groups.  One of a pair is not in the bucket's largest group, and
    # their lengths are in one band (a form stands in all bands that its bound on lengths, made a bit wider, reaches).
    labels = members.join(rooted.withColumnRenamed("node", "form"), "form", "left").select("key", "least", "form", F.coalesce("root", "form").alias("label"))
    slim = shared.written(labels, "line-labels")
    sizes = slim.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "label")).alias("x"), F.sum("n").alias("n"))
    spread = f"greatest({SPREAD}, n div {PARTS})"
    mixed = sizes.filter("x.n < n").select("key", F.col("x.label").alias("_main"), F.expr(f"1 + (n - x.n) div {spread}").alias("_ones"), F.expr(f"1 + n div {spread}").alias("_others"))
    named = signed.select("form", "simhash", "size", *(k.alias(f"_r{i}") for i, k in enumerate(run_keys())))
    wide = shared.written(slim.join(mixed, "key").join(named, "form"), "line-mixed")
    shared.discard(members, slim)
    labels = shared.written(meeting(wide, similarity, most_bits), "line-meeting")
    shared.discard(wide)
    # Texts of all that may meet and their letters beside each of them.
    texts = texts_of(labels, lines, *letter_counts())
    lettered = shared.written(labels.join(texts, "form"), "line-lettered")
    shared.discard(texts, labels)
    shared.tidied(lines.sparkSession)
    # Some buckets at a time, as many as deal out so many bytes.
    dealt = (F.col("size") + 150) * (F.expr("if(label <> _main, _others, 0)") + 1.5 * F.col("_ones"))
    parts, third = 1 + int(lettered.agg(F.sum(dealt)).first()[0] or 0) // at_once, None
    for i in range(parts):
        some = lettered if parts == 1 else lettered.filter(F.pmod(F.xxhash64("key"), F.lit(parts)) == i)
        third = verified(across(some, similarity, most_bits), None, similarity, at_once, third)
    shared.discard(lettered)
    return components(star().unionByName(third)).withColumnRenamed("node", "form")


def removals(docs: DataFrame, similarity: float = SIMILARITY, most_bits: int = MOST_BITS) -> DataFrame:
    """_d, _t, _gone: the numbers of the lines that go, of every document (id and text hash) that loses any."""
    lines, signed = shared.divided(occurrences(docs).withColumn("_slice", slice_of("form")), "lines", "_slice", SLICES), None
    for part in sliced(lines):
        signed = signed_forms(distinct_forms(part), ["_d", "_t", "line", "n"], signed)
    shared.tidied(docs.sparkSession)
    rooted = groups(signed, lines, similarity, most_bits)
    own = signed.select("form", F.struct("_d", "_t", "line").alias("first"), "n").join(rooted, "form", "left").filter("n > 1 OR root IS NOT NULL").withColumn("_g", F.coalesce("root", "form"))
    own = shared.written(own.select("form", "first", "_g"), "line-repeats")
    first = own.groupBy("_g").agg(F.min("first").alias("_f"))
    stays = shared.written(own.join(first, "_g").select("form", F.col("_f._d").alias("_fd"), F.col("_f._t").alias("_ft"), F.col("_f.line").alias("_fl")), "line-firsts")
    found = joined(lines.select("_d", "_t", "line", "form"), stays, "form", "_t", 40)
    gone = found.filter(~(F.col("_d").eqNullSafe(F.col("_fd")) & (F.col("_t") == F.col("_ft")) & (F.col("line") == F.col("_fl"))))
    gone = shared.written(gone.groupBy("_d", "_t").agg(F.collect_set("line").alias("_gone")), "line-changes")
    shared.discard(lines, signed, own, stays)
    shared.tidied(docs.sparkSession)
    return gone


def _without_repeats(docs: DataFrame, n_lines: str, n_kept: str, similarity: float, most_bits: int) -> DataFrame:
    gone = removals(docs.select("doc_id", "text"), similarity, most_bits)
    # Names that the input does not use.
    key, at, lost = shared.free_names(docs, "line_key", "line_text", "line_gone")
    gone = gone.select(F.col("_d").alias(key), F.col("_t").alias(at), F.col("_gone").alias(lost))
    listed = gone.agg(F.count("*"), F.sum(F.size(lost))).first()
    if listed[0] * 48 + (listed[1] or 0) * 4 <= BROADCAST_BYTES:
        gone = F.broadcast(gone)
    rows = docs.join(gone, docs["doc_id"].eqNullSafe(gone[key]) & (F.xxhash64(docs["text"]) == gone[at]), "left").drop(key, at)
    split = F.split("text", "\n")
    total = F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    places = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(lost))
    # The split text is bound once, and each kept place looked up in it.
    stay = F.get(F.transform(F.array(split), lambda ls: F.array_join(F.transform(places, lambda i: F.coalesce(F.get(ls, i), F.lit(""))), "\n")), 0)
    rows = rows.withColumn(n_lines, total.cast("long")).withColumn(n_kept, (total - F.coalesce(F.size(lost), F.lit(0))).cast("long"))
    return rows.withColumn("text", F.when(F.col(lost).isNull(), F.col("text")).otherwise(stay)).drop(lost)


def dedup(docs: DataFrame, similarity: float = SIMILARITY, most_bits: int = MOST_BITS) -> DataFrame:
    """``docs`` with text without repeated lines, and n_lines, n_kept (null for a null text)."""
    return _without_repeats(docs.drop("n_lines", "n_kept"), "n_lines", "n_kept", similarity, most_bits)


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(shared.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_kept", F.char_length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; a document of which no line is left goes (null and empty texts stay)."""
    lines, kept = shared.free_names(docs, "n_lines", "n_kept")
    return _without_repeats(docs, lines, kept, SIMILARITY, MOST_BITS).filter(F.col("text").isNull() | (F.col(kept) > 0)).select(*docs.columns)
