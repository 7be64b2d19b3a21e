r"""Line dedup: later copies of repeated runs of lines are deleted.

Lines are what stands between \n. A run is consecutive lines of one document; it repeats if the same lines stand
elsewhere, in another document or in the same. A line is deleted if any run of `min_words` words or more that holds it has an
earlier copy (by doc_id, then text hash, then line): all lines of maximal repeated runs go, but for the first copy, so no content is lost.

Method, with DataFrame operations alone. Lines that occur once can't be in a repeated run, so only islands of consecutive
lines that occur twice or more are sorted. Suffixes of islands get ranks by prefix doubling: rank k of a position is
the number of suffixes whose first 2^k lines sort before its own; rank k + 1 comes from the pairs of rank k at the
position and 2^k lines further. Equal ranks are intervals of the suffix array with a common prefix of 2^k lines
or more. Maximal runs are unions of minimal ones: every line of a run of enough words is in the shortest run of enough words
from the run's start, or is the end of a shortest one inside the run. So each position asks for the shortest run that starts
and the shortest that ends there; a run of l lines, 2^k <= l < 2^(k+1), has its interval (common prefix of l lines or
more) in the positions equal in rank k at both ends of the run. All but the first of an interval are later copies, and
what they cover, as merged intervals, is what maximal runs cover. Sorting ends at the depth that the longest of these asks
for. Positions alone in their rank, or with too few lines left in the island, leave early.

Ranks are prefix sums of pre-aggregated counts, split by hash or by rank ranges, so neither a hot line nor a hot pair
meets in one task. Every round is a table in the shared folder, deleted once the next one stands.

A null text has no lines and stays null; rows equal in doc_id and text are one document and get the same result; a
null doc_id sorts first; an empty table gives an empty table; other columns, of any name, pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_of, discard, fresh, materialize, named

MIN_WORDS = 50
#: Keys that one window sums over, and the parts of a group that one does, as a power of two.
WINDOW = 50_000
PARTS = 12
WORD = r"[^\x20\x09-\x0D]+"
DOC = ["doc", "th"]


def _doc() -> Column:
    return F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))


def _before(keys: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """keys and before: the sum of n over the group's keys that sort before. Column sub is monotone in the order and
    cuts a group into parts of bounded size; the parts of the group of all keys are summed in parts again."""
    part, ahead = [*group, "sub"], (Window.unboundedPreceding, -1)
    parts = keys.groupBy(*part).agg(F.sum("n").alias("part_n"))
    so_far = lambda x, by, of: F.coalesce(F.sum(x).over(Window.partitionBy(*by).orderBy(of).rowsBetween(*ahead)), F.lit(0))
    if group:
        parts = parts.select(*part, so_far("part_n", group, "sub").alias("part_before"))
    else:
        parts = parts.withColumn("sup", F.shiftright("sub", PARTS))
        tops = parts.groupBy("sup").agg(F.sum("part_n").alias("top_n")).select("sup", so_far("top_n", [F.lit(0)], "sup").alias("top_before"))
        parts = parts.withColumn("inside", so_far("part_n", ["sup"], "sub")).join(tops, "sup").select("sub", (F.col("inside") + F.col("top_before")).alias("part_before"))
    within = Window.partitionBy(*part).orderBy(*order).rowsBetween(*ahead)
    out = keys.withColumn("within", F.coalesce(F.sum("n").over(within), F.lit(0))).join(parts, part)
    return out.withColumn("before", F.col("within") + F.col("part_before")).drop("within", "part_before", "sub")


def _repeated_lines(docs: DataFrame) -> DataFrame:
    """doc, th, ln, words, h1, h2 of every line that stands in two places or more."""
    lines = docs.where(F.col("text").isNotNull()).select(_doc().alias("doc"), F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n", -1)).alias("ln", "line"))
    lines = lines.select(*DOC, "ln", F.regexp_count("line", F.lit(WORD)).alias("words"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"))
    lines = materialize(lines, "lines")
    place = F.xxhash64(*DOC, "ln")
    often = lines.groupBy("h1", "h2").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a != b").select("h1", "h2")
    out = materialize(lines.join(often, ["h1", "h2"]).select(*DOC, "ln", "words", "h1", "h2").distinct(), "repeated")
    discard(lines)
    return out


def _with_needs(places: DataFrame, min_words: int) -> DataFrame:
    """places (doc, th, ln, h1, h2) and needs: the lengths of the runs from here on that are the shortest with min_words words
    that start here or that end at some line of the island."""
    by = Window.partitionBy(*DOC).orderBy("ln")
    out = places.withColumn("island", F.col("ln") - F.row_number().over(by))
    island = [*DOC, "island"]
    inside, all_of = Window.partitionBy(*island).orderBy("ln"), Window.partitionBy(*island)
    out = out.withColumn("c", F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn("a", F.col("c") - F.col("words"))
    onward = Window.partitionBy(*island).orderBy("a").rangeBetween(min_words, Window.unboundedFollowing)
    back = Window.partitionBy(*island).orderBy("c").rangeBetween(Window.unboundedPreceding, -min_words)
    stop = F.coalesce(F.min("ln").over(onward), F.when(F.max("c").over(all_of) - F.col("a") >= min_words, F.max("ln").over(all_of) + 1))
    start = F.coalesce(F.max("ln").over(back) + 1, F.when(F.col("c") >= min_words, F.min("ln").over(all_of)))
    out = out.withColumn("stop", stop).withColumn("start", start)
    none = F.lit(None).cast("long")
    rows = F.array(F.struct("ln", (F.col("stop") - F.col("ln")).alias("need"), "h1", "h2"), F.struct(F.col("start").alias("ln"), (F.col("ln") - F.col("start") + 1).alias("need"), none.alias("h1"), none.alias("h2")))
    rows = out.select(*DOC, F.explode(rows).alias("x")).select(*DOC, "x.*").where("ln is not null")
    return rows.groupBy(*DOC, "ln").agg(F.collect_set("need").alias("needs"), F.max("h1").alias("h1"), F.max("h2").alias("h2"))


def _first_ranks(places: DataFrame) -> DataFrame:
    """places with r: rank of the line among all lines' copies."""
    keys = places.groupBy("h1", "h2").agg(F.count("*").alias("n"))
    keys = materialize(keys, "keys")
    bits = max(0, (keys.count() // WINDOW).bit_length())
    sub = F.shiftrightunsigned("h1", 64 - bits).cast("long") if bits else F.lit(0).cast("long")
    ranks = _before(keys.withColumn("sub", sub), [], ["h1", "h2"]).select("h1", "h2", F.col("before").alias("r"))
    return places.join(ranks, ["h1", "h2"]).select(*DOC, "ln", "needs", "r")


def _next_ranks(places: DataFrame, h: int) -> DataFrame:
    """places whose first 2 * h lines stand elsewhere too, with the ranks of that depth."""
    at = Window.partitionBy(*DOC).orderBy("ln").rangeBetween(h, h)
    both = places.withColumn("s", F.max("r").over(at)).where("s is not null")
    pairs = both.groupBy("r", "s").agg(F.count("*").alias("n")).withColumn("sub", F.floor(F.col("s") / WINDOW))
    ranks = _before(pairs, ["r"], ["s"]).where("n > 1").select("r", "s", (F.col("r") + F.col("before")).alias("next"))
    longer = F.filter("needs", lambda n: n >= 2 * h)
    return both.join(ranks, ["r", "s"]).select(*DOC, "ln", longer.alias("needs"), F.col("next").alias("r"))


def _later_copies(places: DataFrame, h: int) -> DataFrame:
    """doc, th, ln, need of runs of h to 2 * h - 1 lines that have an earlier copy."""
    runs = places.select(*DOC, "ln", "r", F.explode(F.filter("needs", lambda n: n < 2 * h)).alias("need"))
    if h == 1:
        runs = runs.withColumn("q", F.col("r"))
    else:
        tail = places.select(*DOC, (F.col("ln") + h).alias("end"), F.col("r").alias("q"))
        runs = runs.withColumn("end", F.col("ln") + F.col("need")).join(tail, [*DOC, "end"])
    key, place = ["need", "r", "q"], F.struct(*DOC, "ln")
    first = runs.groupBy(*key).agg(F.min(place).alias("first"))
    return runs.join(first, key).where(place != F.col("first")).select(*DOC, "ln", "need")


def later_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc, th, ln, need: the shortest runs of enough words, by start and by end, that have an earlier copy, from line ln for need lines."""
    repeated = _repeated_lines(docs)
    places = materialize(_first_ranks(_with_needs(repeated, min_words)), "ranks")
    discard(repeated)
    h, found = 1, None
    while True:
        more = materialize(_later_copies(places, h), "later")
        found = more if found is None else found.unionByName(more)
        if places.where(F.array_max("needs") >= 2 * h).isEmpty():
            return found
        after = materialize(_next_ranks(places, h), "ranks")
        discard(places)
        places, h = after, 2 * h


def _deleted(docs: DataFrame, min_words: int) -> DataFrame:
    """doc, th and gone: the deleted lines as disjoint intervals (a, b), b exclusive, in order."""
    runs = later_runs(docs, min_words).groupBy(*DOC, F.col("ln").alias("a")).agg(F.max(F.col("ln") + F.col("need")).alias("b"))
    by = Window.partitionBy(*DOC).orderBy("a")
    reach = F.max("b").over(by.rowsBetween(Window.unboundedPreceding, -1))
    parts = runs.withColumn("new", F.coalesce((F.col("a") > reach).cast("long"), F.lit(1))).withColumn("part", F.sum("new").over(by))
    merged = parts.groupBy(*DOC, "part").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return merged.groupBy(*DOC).agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("gone"))


def _dedup(docs: DataFrame, min_words: int) -> tuple[DataFrame, str, str]:
    """docs with later copies deleted from text and two columns more, whose names are also given: lines before, and deleted."""
    doc, th, gone, count, removed = fresh(docs, "__doc", "__th", "__gone", "__lines", "__removed")
    cuts = _deleted(docs, min_words).toDF(doc, th, gone)
    joined = docs.join(cuts, (_doc() == F.col(doc)) & (F.xxhash64("text") == F.col(th)), "left")
    lines, iv = F.split("text", "\n", -1), F.col(gone)
    gaps = F.arrays_zip(F.concat(F.array(F.lit(0)), F.transform(iv, lambda x: x["b"])).alias("a"), F.concat(F.transform(iv, lambda x: x["a"]), F.array(F.size(lines))).alias("b"))
    stay = F.flatten(F.transform(gaps, lambda g: F.slice(lines, g["a"] + 1, g["b"] - g["a"])))
    text = F.when(iv.isNull(), F.col("text")).otherwise(F.array_join(stay, "\n"))
    before = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    less = F.coalesce(F.aggregate(iv, F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"]), F.lit(0)).cast("long")
    return joined.select(*(text.alias("text") if c == "text" else named(c) for c in docs.columns), before.alias(count), less.alias(removed)), count, removed


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with later copies deleted from text, and columns __lines and __removed (with more underscores where docs has such
    names), the lines before and those deleted."""
    return _dedup(docs, min_words)[0]


def line_report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed, n_chars and text_md5 of what stays."""
    out, count, removed = _dedup(docs.select("doc_id", "text"), min_words)
    return out.select("doc_id", F.col(count).alias("n_lines"), F.col(removed).alias("n_removed"), F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def filter_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with later copies deleted and n_chars, where there is one, counted anew; documents that lost all their lines go."""
    out, count, removed = _dedup(docs, min_words)
    out = out.where((F.col(removed) == 0) | (F.col(removed) < F.col(count)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(removed) == 0, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*columns_of(docs))
