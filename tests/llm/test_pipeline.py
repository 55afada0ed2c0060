import pytest

import corpus_pipeline
from beaconfold.llm.common import stored
from test_neardup import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        got = stored(stage(spark, docs, SF), "stage")
        out.append((docs, got))
        docs = got
    return out


def test_all_but_the_last_stage_keep_columns_and_rows(outputs):
    for before, after in outputs[:-1]:
        assert after.columns == before.columns
        assert after.exceptAll(before).isEmpty()


def test_quality_follows_the_ratings(spark, outputs):
    before, after = outputs[1]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    seen = [r.doc_id for r in before.collect() if r.doc_id in labels]
    kept = {r.doc_id for r in after.collect()}
    assert sum((k in kept) == (labels[k] == 1) for k in seen) > 0.95 * len(seen)


def test_one_document_of_each_group_stays(outputs):
    before, after = outputs[2]
    want = brute([(r.doc_id, r.text) for r in before.collect()], 5, 80)
    assert sorted(r.doc_id for r in after.collect()) == sorted({c for _, c in want.values()})


def test_run_packs_everything(spark, outputs):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in outputs[2][1].collect()}
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows) == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in outputs[3][1].collect())


def test_awkward_tables(spark, tmp_path):
    """Nulls, letterless and very long texts, repeated rows, rows without an id and clashing columns pass through; nothing comes of an empty table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = docs.join(spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 and toxic = 0").select("doc_id"), "doc_id", "left_semi").where("length(text) > 300").orderBy("doc_id").first()
    odd = [(-1, None), (-2, ""), (-3, "12 34 !"), (None, clean.text), (-4, clean.text), (-4, clean.text), (-5, (clean.text + " ") * 200)]
    extra = spark.createDataFrame(odd, "doc_id long, text string")
    rows = docs.unionByName(extra, allowMissingColumns=True)
    for c in ("start", "length", "ids", "node", "score", "key", "at"):
        rows = rows.selectExpr("*", f"'x' as {c}")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = [r.doc_id for r in got if r.start == 0]
    assert not {-1, -2, -3} & set(ids)
    # The text over and over has the shingles of the text, so all of these are one group.
    assert [k for k in ids if k in (clean.doc_id, None, -4, -5)] in ([-5], [-4])
    (tmp_path / "none").mkdir()
    rows.where("false").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "none" / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
