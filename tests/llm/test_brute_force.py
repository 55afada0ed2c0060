"""Scores and sketches against plain loops, and every operation on awkward ids, rows and columns."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from beaconfold.llm import bpe, fingerprint, hashed_text, langid, llr_rules, neardup, packing, quality, queries, token_bin, toxicity
from beaconfold.llm.tokens import vocabulary_path

SF = "/root/testdata/sf0.001"
W = re.compile(r"[^\x20\x09-\x0D]+")


def chained(values):
    """Spark's xxhash64 of strings and longs: each value's hash seeds the next."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else int(v).to_bytes(8, "little", signed=True), h)
    return h - (1 << 64) if h >= 1 << 63 else h


def sketch(text, shingle=5, scale=8):
    h = [chained([w]) for w in W.findall((text or "").lower())]
    runs = [chained(h[i : i + shingle]) for i in range(len(h) - shingle + 1)] if len(h) >= shingle else [chained(h)] if h else []
    return sorted({x for x in runs if x < -(1 << 63) + (1 << 64) // scale}), min(runs, default=None)


def compared(s):
    return s[0] or ([] if s[1] is None else [s[1]])


def contained(a, b):
    return 1.0 if not a and not b else 0.0 if not a or not b else len({*a} & {*b}) / min(len(a), len(b))


def test_sketches_and_likeness(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(-1, None), (-2, ""), (-3, "a b"), (-4, "a B")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in fingerprint.fingerprint_neighbours(docs).collect()}
    ordered = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    for i, (k, t) in enumerate(ordered):
        t, following = t or "", ordered[(i + 1) % len(rows)][1] or ""
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        own, other, after = sketch(t), sketch(edited), sketch(following)
        as_text = lambda s: ("" if s[0] or s[1] is None else "~") + " ".join(f"{x & (1 << 64) - 1:X}" for x in compared(s))
        assert (got[k].fingerprint, got[k].edited_fingerprint) == (as_text(own), as_text(other))
        own, other, after = map(compared, (own, other, after))
        assert (got[k].near_edited, got[k].near_next) == pytest.approx((contained(own, other), contained(own, after)))


def test_sketches_merge(spark):
    """The sketches of two parts that overlap by a shingle less one word are that of the whole, for 200 texts and any length."""
    rnd, rows = random.Random(3), []
    for i in range(200):
        words = [f"w{rnd.randint(0, 900)}" for _ in range(rnd.choice([9, 10, 14, 30, 120, 600]))]
        cut = rnd.randint(5, len(words) - 4)
        rows.append((i, " ".join(words), " ".join(words[: cut + 2]), " ".join(words[cut - 2 :])))
    df = spark.createDataFrame(rows, "doc_id long, whole string, a string, b string")
    for name in ("whole", "a", "b"):
        df = fingerprint.with_sketch(df, name, f"s_{name}")
    both = df.withColumn("m", fingerprint.merged("s_a", "s_b"))
    assert both.where("not m <=> s_whole").count() == 0
    assert both.where("size(s_whole.hashes) = 0").count() > 5  # short texts as well
    assert both.where(fingerprint.containment("m", "s_whole") < 1).count() == 0


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_the_next_document_whatever_the_ranges(spark, partitions):
    rnd = random.Random(partitions)
    keys = rnd.sample(range(-500, 500), 120) + [None]
    docs = spark.createDataFrame([(k, f"t{k}") for k in keys], "doc_id long, text string")
    got = {r.doc_id: r.next_text for r in fingerprint.with_next(docs, "doc_id", ["text"], 4 * partitions).collect()}
    ordered = sorted((k for k in keys if k is not None), reverse=True) + [None]
    assert got == {k: f"t{ordered[(i + 1) % len(ordered)]}" for i, k in enumerate(ordered)}


def test_ratio_scores_and_verdicts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    trusted = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").select("doc_id")
    rows, good = [(r.doc_id, r.text or "") for r in docs.collect()], {r.doc_id for r in trusted.collect()}
    size, smooth, grams = llr_rules.BUCKETS, llr_rules.SMOOTHING, {}
    raw, wanted = [Counter(), Counter()], [Counter(), Counter()]
    for k, t in rows:
        h = [chained([w]) for w in W.findall(t)]
        grams[k] = [(0, x % size) for x in h] + [(1, chained(h[i : i + 2]) % size) for i in range(len(h) - 1)]
        for order, x in grams[k]:
            raw[order][x] += 1
            wanted[order][x] += k in good
    scale = [sum(w.values()) / max(1, sum(r.values())) for w, r in zip(wanted, raw)]
    llr = lambda o, x: math.log((wanted[o][x] + smooth) / (raw[o][x] * scale[o] + smooth))
    got = {r.doc_id: r for r in queries.op5_quality_rules(spark, SF).collect()}
    for k, _ in rows:
        score = sum(llr(o, x) for o, x in grams[k]) / len(grams[k]) if grams[k] else 0.0
        assert got[k].score == pytest.approx(score, abs=1e-9)
        assert got[k].kept == (not got[k].base_failed and got[k].score >= llr_rules.THRESHOLD)


TEXTS = ["The cat sat on the mat. The CAT!", "", None, "x1 x1 x1 &&& ##a", "é 字 Straße " * 40, "one two three four five six seven"]


def test_ordinal_scorer(spark):
    rnd = np.random.default_rng(2)
    model = quality.OrdinalModel([0, 1, 2], rnd.normal(size=quality.BUCKETS + quality.STYLE), np.array([-0.3, 0.4]))
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in quality.predict_quality(docs, model, 1).collect():
        tokens = (TEXTS[r.doc_id] or "").encode().split()
        n = max(1, len(tokens))
        z = sum(model.weights[f] for t in tokens for f in hashed_text.token_and_shape(t, quality.BUCKETS)) / n
        style = [1, sum(a == b for a, b in zip(tokens, tokens[1:])) / n, len(set(tokens)) / n, math.log1p(len(tokens)) / 10]
        z += float(np.dot(style, model.weights[quality.BUCKETS :]))
        above = [1 / (1 + math.exp(t - z)) for t in model.thresholds]  # P(grade > k) by the cumulative link
        assert (r.expected_grade, r.p_tail, r.kept) == (pytest.approx(sum(above)), pytest.approx(above[0]), above[0] >= 0.5)


def test_chain_scorer(spark):
    rnd = np.random.default_rng(3)
    names = ["a", "b", "c"]
    model = toxicity.ChainModel(names, rnd.normal(size=(toxicity.BUCKETS, 3)).astype(np.float32), rnd.normal(size=3), np.triu(rnd.normal(size=(3, 3)), 1))
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in toxicity.predict_toxicity(docs, model, "b").collect():
        words = {w for w in (TEXTS[r.doc_id] or "").lower().encode().translate(hashed_text.WORDS_ONLY).split()}
        p = []
        for j in range(3):
            z = sum(float(model.weights[f, j]) for w in words for f in hashed_text.word_features(w, toxicity.BUCKETS)) / math.sqrt(max(1, len(words)))
            z += model.bias[j] + sum(p[i] * model.links[i, j] for i in range(j))
            p.append(1 / (1 + math.exp(-z)))
        assert [r[f"p_{c}"] for c in names] == pytest.approx(p, abs=1e-5) and r.flagged == (r.p_b >= 0.5)


def test_language_scorer(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null")
    model = langid.fit_language_model(docs, F.lit(True), per_language=40, landmarks=16)
    some = [t for t in TEXTS if t] + [r.text for r in docs.limit(30).collect()]
    got = langid.predict_language(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string"), model).collect()
    for r in got:
        has = set()
        data = b" " + b" ".join(some[r.doc_id].lower().encode().translate(langid.LETTERS_ONLY).split()) + b" "
        for n in langid.ORDERS:
            for i in range(len(data) - n + 1):
                code = 0
                for b in data[i : i + n]:
                    code = (code * 0x01000193 + b + 1) % (1 << 32)
                has.add((code * 0x9E3779B1) % (1 << 32) >> 18)
        kernel = sum(model.landmarks[x] for x in has) / math.sqrt(len(has))
        z = np.exp(langid.SHARPNESS * (kernel @ model.regression + model.bias))
        assert r.lang_pred == model.languages[int(z.argmax())] and r.score == pytest.approx(z.max() / z.sum(), abs=1e-3)


# -- awkward tables ---------------------------------------------------------------------------

BIG = (1 << 53) + 1
AWKWARD = [(BIG, "a b c d e f g " * 5), (None, "a b c d e f g " * 5), (None, None), (BIG, "a b c d e f g " * 5), (2, ""), (None, "a b c d e f g " * 5), (3, "word " * 30_000)]


def models(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    ratings, chain = queries.graded_ratings(labels), ["low_quality", "toxic", "toxic_low_quality"]
    return {
        "op1": lambda d: quality.predict_quality(d, quality.fit_quality(ratings, docs), 1),
        "op2": lambda d: bpe.BpeCodec(spark, vocabulary_path(), bpe.build_lexicon(d, vocabulary_path())).encode(d, decode=True),
        "op4": lambda d: langid.predict_language(d, langid.fit_language_model(docs, F.lit(True))),
        "op5": lambda d: llr_rules.quality_rules(d, llr_rules.gram_ratios(d, d.select("doc_id"))),
        "op6": lambda d: toxicity.predict_toxicity(d, toxicity.fit_toxicity(queries.toxicity_categories(labels), docs, chain), "toxic"),
        "op7": fingerprint.fingerprint_neighbours,
        "op8": lambda d: packing.pack_pieces(packing.cut_documents(d, vocabulary_path())).where("start = 0"),
        "op9": lambda d: neardup.near_duplicates(d, neardup.NearDupParameters(shingle=3, percent=85)),
        "op10": lambda d: token_bin.read_token_files(token_bin.write_token_files(d, vocabulary_path())),
    }


@pytest.mark.parametrize("name", ["op1", "op2", "op4", "op5", "op6", "op7", "op8", "op9", "op10"])
def test_awkward_rows(spark, name):
    op = models(spark)[name]
    clash = ["node", "key", "ids", "score", "kept", "sketch", "__at", "h", "w", "row", "bucket", "at", "first", "start"]
    docs = spark.createDataFrame([(*r, *clash) for r in AWKWARD], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in clash)).coalesce(1)
    got = op(docs)
    key = lambda k: (k is None, k or 0)
    assert sorted((r.doc_id for r in got.select("doc_id").collect()), key=key) == sorted((k for k, _ in AWKWARD), key=key)
    assert op(docs.where("false")).count() == 0


def test_links_of_rows_without_an_id(spark):
    """A row without an id takes part in chains: 1 - null - 2, and in the kept row of a group without any id."""
    base = [f"w{i}" for i in range(60)]
    near = lambda k: " ".join([*(f"x{i}" for i in range(k)), *base[k:]])
    p = neardup.NearDupParameters(shingle=3, percent=85)
    docs = spark.createDataFrame([(1, near(0)), (None, near(4)), (2, near(6)), (None, "p q r s t"), (None, "p q r s t")], "doc_id long, text string").coalesce(1)
    got = neardup.near_duplicates(docs, p).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == sorted([("1", "1", True), ("None", "1", False), ("2", "1", False), ("None", "None", True), ("None", "None", True)])
    assert sorted(r.text for r in neardup.without_near_duplicates(docs, p).collect()) == sorted([near(0), "p q r s t"])
    many = docs.union(spark.createDataFrame([(1, near(0))] * 60 + [(2, near(6))] * 60, "doc_id long, text string"))
    assert neardup.near_duplicates(many, p).where("component_id = 1").count() == 123


def test_rated_samples_are_bounded_by_rows(spark):
    ratings = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "doc_id long, grade int")
    docs = spark.range(5000).selectExpr("1 + id % 2 as doc_id", "concat('text ', id) as text")
    assert hashed_text.sampled_rows(ratings, docs, ["grade"], 2).count() <= 2


def test_lexicon_of_chunks_that_tie(spark):
    docs = spark.createDataFrame([(i, f"tie{i % 300} tie{i % 300}") for i in range(600)], "doc_id long, text string")
    some = bpe.frequent_chunks(docs, 100)
    assert 20 < len(some) <= 150 and some == bpe.frequent_chunks(docs.repartition(3), 100)
