"""Quality rules: base rules, then a hashed n-gram log-likelihood ratio.

Everything here is DataFrame and SQL functions.

*Base measures* of each text's words (runs of anything but ASCII white space):
``n_words``; ``word_chars``, their code points; ``n_symbols``, characters of
``#*$%&|<>``; ``n_dup_lines``, lines with a word that equal an earlier line;
``n_repeat_words``, words inside 8-word windows that occur twice or more in the
text.  ``base_failed`` is true below 20 words or when over 30 % of the words
repeat.

*Verdict.*  Word 1- and 2-grams are hashed into ``BUCKETS`` buckets for each
order.  Two multinomials are counted: one over trusted texts, one over the raw
corpus, the latter scaled to the size of the former.  Both get ``SMOOTHING``
counts for each bucket, so that n-grams of a few documents, which the trusted
texts may lack by chance, say little.  A document's score is the mean log ratio of its n-grams; it is
kept if the score is at least ``THRESHOLD``.  The raw counts cover all rows, the
trusted ones all rows with a trusted id.

Null texts count as empty: no words, so they fail the base rules (score 0).
Repeated rows give a row each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .words_sql import hashes, windows, words

BUCKETS = 1 << 16
SMOOTHING = 8.0
THRESHOLD = -0.15
WINDOW = 8
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def with_hashes(docs: DataFrame) -> DataFrame:
    """``docs`` with arrays ``w`` of words and ``h`` of their hashes."""
    return docs.withColumn("w", F.expr(words("text"))).withColumn("h", F.expr(hashes("w")))


def grams(hash_column: str = "h", buckets: int = BUCKETS) -> str:
    """Buckets of all 1-grams, then of all 2-grams (above ``buckets``)."""
    return (
        f"concat(transform({hash_column}, x -> cast(pmod(x, {buckets}) as int)),"
        f" transform({windows(hash_column, 2)}, x -> cast(pmod(x, {buckets}) as int) + {buckets}))"
    )


def repeated_words(windows_column: str, window: int = WINDOW) -> str:
    """Words covered by windows whose hash occurs twice or more.

    Windows are sorted by hash only in texts that have a repeated one; the
    starts of repeated windows, in order, each cover up to the next start.
    """
    pairs = f"array_sort(transform({windows_column}, (x, i) -> struct(x, i)))"
    twice = f"transform(array({pairs}), s -> filter(s, (e, k) -> get(s, k - 1).x <=> e.x or get(s, k + 1).x <=> e.x))[0]"
    starts = f"sort_array(transform({twice}, e -> e.i))"
    covered = f"transform(array({starts}), p -> aggregate(transform(p, (s, k) -> least({window}, coalesce(get(p, k + 1) - s, {window}))), 0, (a, x) -> a + x))[0]"
    return f"if(size(array_distinct({windows_column})) = size({windows_column}), 0, {covered})"


def base_measures(hashed: DataFrame) -> DataFrame:
    """Adds the base measures (long) and ``base_failed`` to a frame with ``text``, ``w`` and ``h``."""
    lines = "filter(split(coalesce(text, ''), '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')"
    measured = (
        hashed.withColumn("win", F.expr(windows("h", WINDOW)))
        .withColumn("lines", F.expr(lines))
        .withColumn("n_words", F.size("w").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("w", "")).cast("long"))
        .withColumn("n_symbols", F.expr("cast(length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '')) as long)"))
        .withColumn("n_dup_lines", F.expr("cast(size(lines) - size(array_distinct(lines)) as long)"))
        .withColumn("n_repeat_words", F.expr(f"cast({repeated_words('win')} as long)"))
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return measured.withColumn("base_failed", failed).drop("win", "lines")


def gram_ratios(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """``bucket, llr``: log of the trusted over the raw share of each bucket's n-grams.

    ``trusted(doc_id)`` names trusted rows, in any number: ids and documents are
    shuffled at any size, and tasks keep only their share of the ids.  Rows
    without an id meet no trusted one and stay out of that join.  Counts are summed before the shuffle; the table has at
    most two rows for each bucket number.
    """
    rows = docs.select("doc_id", "text")
    ids = trusted.where("doc_id is not null").select("doc_id").distinct().withColumn("trusted", F.lit(1)).hint("shuffle_hash")
    named = rows.where("doc_id is not null").join(ids, "doc_id", "left")
    marked = named.unionByName(rows.where("doc_id is null").withColumn("trusted", F.lit(None).cast("int")))
    exploded = with_hashes(marked).select(F.coalesce("trusted", F.lit(0)).alias("trusted"), F.explode(F.expr(grams())).alias("bucket"))
    counts = stored(exploded.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("trusted").alias("good")), "gram-counts")
    order = F.floor(F.col("bucket") / BUCKETS).cast("int")
    totals = {r.o: (r.raw, r.good) for r in counts.groupBy(order.alias("o")).agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect()}

    scale = [good / max(1, raw) for raw, good in (totals.get(o, (0, 0)) for o in (0, 1))]
    expected = F.col("raw") * F.when(order == 0, F.lit(float(scale[0]))).otherwise(F.lit(float(scale[1])))
    return counts.select("bucket", F.log((F.col("good") + SMOOTHING) / (expected + SMOOTHING)).alias("llr"))


def quality_rules(docs: DataFrame, ratios: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, the base measures, ``base_failed``, ``kept`` and ``score`` of every row.

    N-grams meet the table of ratios by a broadcast join (it is bounded by the
    buckets); a row's ratios are summed in the task that read it.
    """
    rows = base_measures(with_hashes(docs.select("doc_id", "text"))).withColumn("row", F.monotonically_increasing_id())
    keys = ["row", "doc_id", *MEASURES, "base_failed"]
    exploded = rows.select(*keys, F.explode_outer(F.expr(grams())).alias("bucket"))
    scored = exploded.join(F.broadcast(ratios), "bucket", "left").groupBy(*keys).agg(F.coalesce(F.avg(F.when(F.col("bucket").isNotNull(), F.coalesce("llr", F.lit(0.0)))), F.lit(0.0)).alias("score"))
    kept = ~F.col("base_failed") & (F.col("score") >= threshold)
    return scored.select("doc_id", *MEASURES, "base_failed", kept.alias("kept"), "score")
