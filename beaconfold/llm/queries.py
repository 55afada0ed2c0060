"""Queries that apply each operation to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .tokens import vocabulary_path
from .words_sql import words


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import BpeCodec, build_lexicon

    docs, vocabulary = table(spark, sf_dir, "documents"), vocabulary_path()
    codec = BpeCodec(spark, vocabulary, build_lexicon(docs, vocabulary))
    return codec.encode(docs, decode=True).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


def held_out():
    """Documents whose crc32 of the id leaves remainder 1 by 3 are never learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit_language_model, predict_language

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_language_model(docs, ~held_out())
    return predict_language(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def graded_ratings(labels: DataFrame) -> DataFrame:
    """Three ordered grades: low quality, good but toxic, good and clean."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    return labels.where("quality is not null").select("doc_id", grade.alias("grade"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit_quality, predict_quality

    docs = table(spark, sf_dir, "documents")
    return predict_quality(docs, fit_quality(graded_ratings(table(spark, sf_dir, "labels")), docs), tail=1)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .llr_rules import gram_ratios, quality_rules

    docs = table(spark, sf_dir, "documents")
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality_rules(docs, gram_ratios(docs, trusted))


def text_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op5 that SQL can express: the base measures and the verdict on them."""
    from .llr_rules import MEASURES, base_measures, with_hashes

    return base_measures(with_hashes(table(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id", *MEASURES, "base_failed")


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op7 that SQL can express: lengths and edited texts."""
    return op7_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import fingerprint_neighbours

    return fingerprint_neighbours(table(spark, sf_dir, "documents"))


def toxicity_categories(labels: DataFrame) -> DataFrame:
    """The chain's categories from the two labels: low quality, toxic, and both."""
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic", (F.col("toxic") * (1 - F.col("quality"))).alias("toxic_low_quality"))


def op6_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit_toxicity, predict_toxicity

    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(toxicity_categories(table(spark, sf_dir, "labels")), docs, ["low_quality", "toxic", "toxic_low_quality"])
    return predict_toxicity(docs, model, "toxic")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import cut_documents, pack_pieces

    pieces = cut_documents(table(spark, sf_dir, "documents"), vocabulary_path())
    digests = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return pack_pieces(stored(digests, "pieces"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import NearDupParameters, near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), NearDupParameters(shingle=3, percent=85))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_bin import read_token_files, write_token_files

    files = write_token_files(table(spark, sf_dir, "documents"), vocabulary_path())
    return read_token_files(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import mine_hard_negatives

    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    relabelled = rows.select("vec_id", "embedding", label.alias("label"))
    return mine_hard_negatives(relabelled, F.col("vec_id") % 100 == 0)


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: for one id in ten the words from a place on repeat with a period, as the contract of op12 says."""
    place, length = "(g % size(w))", "size(w)"
    period = f"(1 + ({length} - {place}) div (3 + g % 8))"
    edited = f"array_join(transform(sequence(0, {length} - 1), i -> get(w, cast(if(i < {place}, i, {place} + (i - {place}) % {period}) as int))), ' ')"
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.expr(words())).alias("w"))
    return rows.select("doc_id", F.when(F.size("w") > 0, F.expr(edited)).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .runs import periodic_runs

    found = periodic_runs(with_planted_periods(table(spark, sf_dir, "documents")))
    longest = "array_max(transform(runs, r -> struct(r.length as length, -r.start as start, -r.period as period)))"
    listed = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')"
    top = found.withColumn("top", F.expr(longest))
    return top.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.start")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.period")).alias("period"),
        F.expr("1000 * top.length div -top.period").alias("exponent_milli"),
        F.sha2(F.expr(listed), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )


def op13_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mtree import build_index, search

    rows = table(spark, sf_dir, "embeddings")
    return search(build_index(rows), rows.where(F.col("vec_id") % 50 == 0), 5)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_quality_classifier,
            op2_bpe_codec,
            op3_html_extraction,
            op4_language_id,
            op5_quality_rules,
            op6_toxicity_chain,
            op7_fingerprints,
            op8_packing,
            op9_near_duplicates,
            op10_token_files,
            op11_hard_negatives,
            op12_periodic_runs,
            op13_top_products,
            text_measures,
            edited_texts,
        )
    }


_VECTORS = """q AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""

_TOP_PRODUCTS = f"""WITH {_VECTORS},
 s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
 r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
 SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

_HARD_NEGATIVES = f"""WITH {_VECTORS},
 l AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, q FROM q WHERE label IS NOT NULL),
 s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM l a JOIN l b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
 p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
 n AS (SELECT p.anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
 CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
 FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
 SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""


_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_NEAR_DUPLICATES = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
 s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
 ELSE list_transform(range(len(w) - 2), lambda i: w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS s FROM w),
 x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
 e AS (SELECT a.doc_id AS u, b.doc_id AS v FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
 GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (min(a.n) + min(b.n) - count(*))),
 c AS (SELECT doc_id, doc_id AS r FROM s UNION SELECT c.doc_id, e.v FROM c JOIN e ON e.u = c.r),
 m AS (SELECT doc_id, min(r) AS component_id FROM c GROUP BY doc_id)
 SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN m USING (doc_id)"""

_TEXT_MEASURES = f"""WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
 g AS (SELECT doc_id, unnest(range(len(w) - 7)) AS i, unnest(list_transform(range(len(w) - 7), lambda i: array_to_string(list_slice(w, i + 1, i + 8), ' '))) AS g FROM w WHERE len(w) > 7),
 d AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g),
 p AS (SELECT DISTINCT doc_id, i + k AS at FROM d, range(8) r(k) WHERE n > 1),
 r AS (SELECT doc_id, count(*) AS repeated FROM p GROUP BY doc_id),
 m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
 CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
 list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{_WORD}')) AS lines, CAST(coalesce(repeated, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN r USING (doc_id))
 SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_repeat_words,
 n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m"""

_EDITED_TEXTS = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
 n AS (SELECT doc_id, t, length(t) AS n, coalesce(lead(t) OVER w, first_value(t) OVER w) AS other FROM d WINDOW w AS (ORDER BY doc_id DESC))
 SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(left(t, n - n // 2) || left(other, n // 2)) AS edited_sha256 FROM n"""


def oracle_sql() -> dict[str, str]:
    return {
        "op9_near_duplicates": _NEAR_DUPLICATES,
        "op11_hard_negatives": _HARD_NEGATIVES,
        "op13_top_products": _TOP_PRODUCTS,
        "text_measures": _TEXT_MEASURES,
        "edited_texts": _EDITED_TEXTS,
    }
