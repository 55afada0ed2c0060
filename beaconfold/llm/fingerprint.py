"""Document fingerprints: threshold-scaled sketches of word shingles.

Everything here is DataFrame and SQL functions.

A text's shingles are its runs of five lower-case words (all its words, if there
are fewer).  The sketch keeps every shingle hash below a fixed fraction of the
hash range, and apart from these the least hash of all, which stands for a short
text that has no hash below.  Sketches merge: the hashes of a whole are the union
of its parts', its least hash is the least of theirs (parts that overlap by all
but one word of a shingle).  The share of the smaller sketch found in the larger
one estimates containment, however unequal the texts are.  Two texts without
words are alike (1), a text without words and another one aren't (0).  Null texts
count as empty; equal texts have equal sketches.  Repeated rows give a row each;
rows of one id (null ids too) are ordered by text and stand in one range, which
spills where it is large.  Texts may be as long as a row may.  An empty table gives
an empty one.  Other columns than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .words_sql import hashes, windows, words

SHINGLE = 5
SCALE = 8  #: one hash in so many is kept
RANGE_BYTES = 32 << 20  #: text in a range of ids
MOST_RANGES = 100_000  #: bounds of ranges that the driver and every task hold; ranges of more than 3 TB grow beyond RANGE_BYTES


def with_sketch(df: DataFrame, text: str, name: str, shingle: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """``df`` with column ``name``, the sketch of column ``text``: its ``hashes`` below the threshold, sorted, and its ``least`` hash."""
    below = -(1 << 63) + (1 << 64) // scale
    h, s = f"{name}__h", f"{name}__s"
    all_of_it = f"if(size({h}) = 0, array(), array(xxhash64({h})))"
    return (
        df.withColumn(h, F.expr(hashes(words(f"lower({text})"))))
        .withColumn(s, F.expr(f"if(size({h}) < {shingle}, {all_of_it}, {windows(h, shingle)})"))
        .withColumn(name, F.expr(f"struct(sort_array(array_distinct(filter({s}, x -> x < {below}L))) as hashes, array_min({s}) as least)"))
        .drop(h, s)
    )


def merged(a: str, b: str) -> Column:
    """The sketch of a whole from those of two parts; null where both are."""
    return F.expr(
        f"case when {a} is null then {b} when {b} is null then {a}"
        f" else struct(sort_array(array_union({a}.hashes, {b}.hashes)) as hashes, least({a}.least, {b}.least) as least) end"
    )


def compared(sketch: str) -> str:
    """The hashes by which a sketch is compared: those below the threshold, or the least one of a short text."""
    return f"if(size({sketch}.hashes) > 0 or {sketch}.least is null, {sketch}.hashes, array({sketch}.least))"


def as_text(sketch: str) -> Column:
    """The fingerprint as text: its hashes in hexadecimal, the least one of a short text after a ``~``."""
    return F.expr(f"if(size({sketch}.hashes) = 0 and {sketch}.least is not null, concat('~', hex({sketch}.least)), array_join(transform({sketch}.hashes, x -> hex(x)), ' '))")


def containment(a: str, b: str) -> Column:
    """Share of the smaller sketch that the larger one has."""
    a, b = compared(a), compared(b)
    return F.expr(f"case when size({a}) = 0 and size({b}) = 0 then 1.0D when size({a}) = 0 or size({b}) = 0 then 0.0D else cast(size(array_intersect({a}, {b})) as double) / least(size({a}), size({b})) end")


def resemblance(a: str, b: str) -> Column:
    """Jaccard estimate of two sketches."""
    a, b = compared(a), compared(b)
    return F.expr(f"case when size({a}) = 0 and size({b}) = 0 then 1.0D else cast(size(array_intersect({a}, {b})) as double) / size(array_union({a}, {b})) end")


def _bounds_up_to(bounds: np.ndarray, at: Column) -> Column:
    """How many of the sorted ``bounds`` are at most ``at``, by halving."""
    if not len(bounds):
        return F.lit(0)
    values, steps = F.lit(bounds), [1 << k for k in reversed(range(len(bounds).bit_length()))]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda n, step: F.when(F.get(values, n + step - 1) <= at, n + step).otherwise(n))


def with_next(df: DataFrame, key: str, carried: list[str], buckets: int) -> DataFrame:
    """Each row with ``next_<c>`` of the row that follows in descending ``key``; the first follows the last.

    Rows are dealt into ranges of keys, so no task gets all of them.  The first
    rows of a range are dealt a second time, to the end of the range before, to
    which they are next.  The driver gets the ranges' bounds and largest keys
    only.  Null keys come last; rows of equal keys are in order of ``carried``.
    """
    least = -(1 << 63)
    at = F.coalesce(F.col(key), F.lit(least))
    ids = df.select(at.alias("__at"))
    shares = F.lit(np.arange(1, buckets) / buckets)
    found = ids.agg(F.percentile_approx("__at", shares, max(10_000, 10 * buckets)).alias("p")).first().p if buckets > 1 else None
    bounds = np.array(sorted(set(found or [])), np.int64)
    bucket = _bounds_up_to(bounds, F.col("__at"))
    tops = {r.b: r.top for r in ids.groupBy(bucket.alias("b")).agg(F.max("__at").alias("top")).collect()}
    # The range that a range's first rows are next to: the one above, or the lowest for the highest.
    used = sorted(tops, reverse=True)
    before = {b: used[i - 1] for i, b in enumerate(used)}
    top = F.lit(np.array([tops.get(b, least) for b in range(len(bounds) + 1)], np.int64))
    above = F.lit(np.array([before.get(b, 0) for b in range(len(bounds) + 1)], np.int32))
    dealt = df.withColumn("__at", at).withColumn("__own", bucket)
    own = F.struct(F.col("__own").alias("bucket"), F.lit(0).alias("copy"))
    copy = F.struct(F.get(above, F.col("__own")).alias("bucket"), F.lit(1).alias("copy"))
    places = F.when(F.col("__at") == F.get(top, F.col("__own")), F.array(own, copy)).otherwise(F.array(own))
    dealt = dealt.withColumn("__place", F.explode(places)).withColumn("__bucket", F.col("__place.bucket")).withColumn("__copy", F.col("__place.copy"))
    w = Window.partitionBy("__bucket").orderBy("__copy", F.desc("__at"), *carried)
    followed = dealt.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in carried))
    return followed.where("__copy = 0").drop("__at", "__own", "__place", "__bucket", "__copy")


def fingerprint_neighbours(docs: DataFrame, shingle: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has its last half (rounded down) replaced by as many first
    code points of the next document in descending ``doc_id``.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    held = texts.agg(F.sum(F.octet_length("text").cast("long")).alias("b")).first().b or 0
    # Ranges follow the data; for little of it, there is one for each task at least.
    buckets = min(MOST_RANGES, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-held // RANGE_BYTES)))
    followed = with_next(with_sketch(texts, "text", "sketch", shingle, scale), "doc_id", ["text", "sketch"], buckets)
    edited = followed.withColumn("n_chars", F.length("text").cast("long")).withColumn(
        "edited", F.expr("concat(left(text, n_chars - n_chars div 2), left(next_text, cast(n_chars div 2 as int)))")
    )
    sketched = with_sketch(edited, "edited", "edited_sketch", shingle, scale)
    return sketched.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text("sketch").alias("fingerprint"),
        as_text("edited_sketch").alias("edited_fingerprint"),
        containment("sketch", "edited_sketch").alias("near_edited"),
        containment("sketch", "next_sketch").alias("near_next"),
        resemblance("sketch", "edited_sketch").alias("jaccard_edited"),
        resemblance("sketch", "next_sketch").alias("jaccard_next"),
    )
