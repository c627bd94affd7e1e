"""Repeated line runs, found with a suffix array over line ids built by distributed prefix doubling.

The sequence of a document are its lines that hold a word; blank lines belong to the run around them. A
run of lines with at least ``min_words`` words that also occurs earlier (in an earlier document by id,
or earlier in the same one) is a later copy, and its lines are deleted. The first copy stays.

- Line ids are 128-bit hashes. A line that occurs once breaks every repeated run, so only stretches of
  repeated lines with enough words go on; they are what the suffix array is built over.
- A rank is the left border of a suffix's interval in the suffix array: the number of suffixes with a
  smaller prefix. Round k takes prefixes of 2^k lines to 2^(k+1): a rank grows by the number of suffixes
  of its interval whose following 2^k lines rank lower. Ranks come from sums over counts of different
  (rank, following rank) pairs, in two levels, so that no interval is ever sorted in one task.
- Suffixes share a prefix of m lines just when they share the ranks of the two runs of 2^k lines that
  cover it: these are the longest-common-prefix intervals of length m. Every maximal repeated run of
  enough words is the union of the shortest runs of enough words that begin or end at its lines, and
  those have at most ``min_words`` lines; so 2^k stays below ``min_words``, however long the repeated
  run is. In each interval all but the first position are later copies.

Everything is DataFrame operations. A frequent line or passage is counted before it is shuffled, and
joins back to the positions are plain equi-joins that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, parts_for

MIN_WORDS = 50
WORD = r"[^\x20\x09-\x0D]+"
_LAST = (1 << 63) - 1
_BUCKETS = 1024
_DOC = ["d", "h"]


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """A document is its id (null ones last) and its text; repeated rows are one document."""
    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)).alias("d"), F.xxhash64(F.col(text)).alias("h"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text).alias("text"))


def _lines(keyed: DataFrame) -> DataFrame:
    """d, h, seq (among lines with words), idx (among all), w (words) and the line's id a, b."""
    numbered = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("idx"), F.regexp_count(x, F.lit(WORD)).alias("w"), x.alias("line")))
    rows = keyed.select("d", "h", F.posexplode(F.filter(numbered, lambda s: s.w > 0)).alias("seq", "at"))
    return rows.select("d", "h", "seq", "at.idx", "at.w", F.xxhash64("at.line").alias("a"), F.xxhash64(F.lit(1), "at.line").alias("b"))


def _running(counts: DataFrame, within: list[str], coarse: Column, order: list[str], size: str) -> DataFrame:
    """``before``: the sum of ``size`` over the smaller rows of the same ``within``, by way of coarse buckets."""
    counts = counts.withColumn("coarse", coarse)
    sums = counts.groupBy(*within, "coarse").agg(F.sum(size).alias("s"))
    earlier = Window.partitionBy(*within).orderBy("coarse").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*within, "coarse", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy(*within, "coarse").orderBy(*(F.col(c).asc_nulls_first() for c in order)).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("own", F.coalesce(F.sum(size).over(inside), F.lit(0))).join(sums, [*within, "coarse"]).withColumn("before", F.col("base") + F.col("own")).drop("coarse", "own", "base")


def _shortest(frame: Column, min_words: int) -> Column:
    """How many of the first elements (with words w) make at least ``min_words``; null if all don't."""
    zero = F.struct(F.lit(0).alias("s"), F.lit(0).alias("n"))
    step = lambda acc, x: F.when(acc.s >= min_words, acc).otherwise(F.struct((acc.s + x.w).alias("s"), (acc.n + 1).alias("n")))
    return F.aggregate(frame, zero, step, lambda acc: F.when(acc.s >= min_words, acc.n))


def _repeated(lines: DataFrame, min_words: int) -> DataFrame:
    """Positions of repeated lines in stretches of enough words, with stretch and rank r0."""
    counts = checkpoint(lines.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    # bucket totals: at most _BUCKETS rows
    ranked = _running(counts.withColumn("all", F.lit(0)), ["all"], F.shiftright("a", 54), ["a", "b"], "n").select("a", "b", F.col("before").alias("r0"))
    active = lines.join(ranked, ["a", "b"]).select("d", "h", "seq", "idx", "w", "r0").dropDuplicates([*_DOC, "seq"])
    by_doc = Window.partitionBy(*_DOC)
    active = active.withColumn("stretch", F.col("seq") - F.row_number().over(by_doc.orderBy("seq")))
    words = F.sum("w").over(Window.partitionBy(*_DOC, "stretch"))
    return checkpoint(active.withColumn("words", words).filter(F.col("words") >= min_words).drop("words"))


def _runs(active: DataFrame, min_words: int) -> DataFrame:
    """The shortest runs of enough words that begin or end at each position: d, h, start, m, from, to (line indexes)."""
    stretch = Window.partitionBy(*_DOC, "stretch").orderBy("seq")
    at = F.struct("w", "idx")
    seen = active.select("d", "h", "seq", "idx", F.collect_list(at).over(stretch.rowsBetween(0, min_words - 1)).alias("ahead"), F.reverse(F.collect_list(at).over(stretch.rowsBetween(1 - min_words, 0))).alias("behind"))
    seen = seen.withColumn("fm", _shortest(F.col("ahead"), min_words)).withColumn("bm", _shortest(F.col("behind"), min_words))
    forward = seen.filter("fm is not null").select("d", "h", F.col("seq").alias("start"), F.col("fm").alias("m"), F.col("idx").alias("from"), F.element_at("ahead", F.col("fm")).idx.alias("to"))
    backward = seen.filter("bm is not null").select("d", "h", (F.col("seq") - F.col("bm") + 1).alias("start"), F.col("bm").alias("m"), F.element_at("behind", F.col("bm")).idx.alias("from"), F.col("idx").alias("to"))
    return forward.unionByName(backward).distinct()


def _doubled(active: DataFrame, rounds: int) -> DataFrame:
    """Adds ranks r1, r2, ... of runs of 2, 4, ... lines; null where such a run is unique or leaves the stretch."""
    n = active.count()
    coarse, parts = max(1, n // _BUCKETS), parts_for(n)
    for k in range(rounds):
        r, new = f"r{k}", f"r{k + 1}"
        following = F.lead(r, 1 << k).over(Window.partitionBy(*_DOC, "stretch").orderBy("seq"))
        active = checkpoint(active.withColumn("next", following).coalesce(parts))
        counts = active.filter(F.col(r).isNotNull()).groupBy(r, "next").agg(F.count(F.lit(1)).alias("n"))
        ranks = _running(counts, [r], F.coalesce(F.floor(F.col("next") / coarse), F.lit(-1)), ["next"], "n")
        ranks = ranks.filter("next is not null and n > 1").select(r, "next", (F.col(r) + F.col("before")).alias(new))
        active = active.join(ranks, [r, "next"], "left").drop("next")
    return checkpoint(active.coalesce(parts))


def _later_copies(active: DataFrame, runs: DataFrame, rounds: int) -> DataFrame:
    """Runs that have an earlier copy: d, h, from, to."""
    k = sum((F.col("m") >= (1 << j)).cast("int") for j in range(1, rounds + 1))
    runs = runs.withColumn("k", k if rounds else F.lit(0)).withColumn("last", F.col("start") + F.col("m") - F.expr("shiftleft(1, k)"))
    ranks = active.select("d", "h", F.col("seq"), F.array(*(f"r{j}" for j in range(rounds + 1))).alias("ranks"))
    head = ranks.select("d", "h", F.col("seq").alias("start"), F.col("ranks").alias("head"))
    tail = ranks.select("d", "h", F.col("seq").alias("last"), F.col("ranks").alias("tail"))
    joined = runs.join(head, [*_DOC, "start"]).join(tail, [*_DOC, "last"])
    interval = checkpoint(joined.select("d", "h", "start", "m", "from", "to", F.element_at("head", F.col("k") + 1).alias("x"), F.element_at("tail", F.col("k") + 1).alias("y")).filter("x is not null and y is not null"))
    # cut off here, so that the join has shuffles of its own, which adaptive execution can split at a frequent run
    first = checkpoint(interval.groupBy("m", "x", "y").agg(F.min(F.struct("d", "h", "start")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    return interval.join(first, ["m", "x", "y"]).filter(F.struct("d", "h", "start") != F.col("first")).select("d", "h", "from", "to")


def _merged(copies: DataFrame) -> DataFrame:
    """For each document, its deleted ranges of line indexes [from, to), in order and without overlap."""
    by = Window.partitionBy(*_DOC).orderBy("from", "to")
    before = F.max("to").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = copies.withColumn("new", (F.coalesce(before, F.lit(-1)) + 1 < F.col("from")).cast("int"))
    numbered = marked.withColumn("range", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    ranges = numbered.groupBy(*_DOC, "range").agg(F.min("from").alias("from"), (F.max("to") + 1).alias("to"))
    return ranges.groupBy(*_DOC).agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("gone"))


def _without(text: Column, gone: Column) -> Column:
    """The text without the given ranges of its lines."""
    lines = F.split(text, "\n", -1)
    starts = F.concat(F.array(F.lit(0)), F.transform(gone, lambda r: r["to"]))
    ends = F.concat(F.transform(gone, lambda r: r["from"]), F.array(F.size(lines)))
    kept = F.zip_with(starts, ends, lambda s, e: F.slice(lines, s + 1, e - s))
    return F.array_join(F.flatten(kept), "\n")


def drop_repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` with all its columns, the text without later copies of line runs; ``count`` names a further column with the lines taken out.

    Null and empty texts stay as they are. Rows with equal id and text are one document and are
    treated alike; a null id comes after all others. A text may become empty. An empty table gives
    none. No other column is looked at.
    """
    keyed = _keyed(docs, doc_id, text)
    lines = checkpoint(_lines(keyed))
    active = _repeated(lines, min_words)
    runs = checkpoint(_runs(active, min_words))
    longest = runs.agg(F.max("m")).first()[0] or 1
    rounds = longest.bit_length() - 1
    copies = _later_copies(_doubled(active, rounds), runs, rounds)
    gone = checkpoint(_merged(copies))
    joined = keyed.drop("text").join(gone, _DOC, "left")
    body = F.col(f"row.`{text}`")
    new = F.when(F.col("gone").isNull(), body).otherwise(_without(body, F.col("gone")))
    taken = F.coalesce(F.aggregate("gone", F.lit(0), lambda n, r: n + r["to"] - r["from"]), F.lit(0)).cast("long")
    columns = [new.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return joined.select(*columns, *([taken.alias(count)] if count else []))
