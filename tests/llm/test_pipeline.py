"""The corpus pipeline, stage by stage, against plain implementations."""

import pytest

import corpus_pipeline
from test_brute_force import components_by_hand, substring_by_hand

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = {"input": docs}
    for name, f in corpus_pipeline.STAGES:
        f(spark, docs, DATA).write.parquet(str(base / name))
        docs = out[name] = spark.read.parquet(str(base / name))
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "mixing", "packing"]
    for name in ("language_id", "near_dedup", "substring_dedup", "mixing"):
        assert stages[name].columns == stages["input"].columns


def test_language_keeps_clean_documents(stages):
    assert stages["language_id"].count() == stages["input"].count()


def test_one_document_of_each_group(stages):
    rows = [(r.doc_id, r.text) for r in stages["language_id"].collect()]
    roots = {root for _, root in components_by_hand(rows, 5, 80).values()}
    assert {r.doc_id for r in stages["near_dedup"].collect()} == roots


def test_passages_go(stages):
    rows = [(r.doc_id, r.text) for r in stages["near_dedup"].collect()]
    want = {k: n - gone for k, (n, gone, _) in substring_by_hand(rows, 20).items() if gone < n or not n}
    got = {r.doc_id: len((r.text or "").encode().split()) for r in stages["substring_dedup"].collect()}
    assert got == want


def test_mix_repeats_documents(stages):
    before = {r.doc_id for r in stages["substring_dedup"].collect()}
    after = [r.doc_id for r in stages["mixing"].collect()]
    assert set(after) <= before and max(after.count(k) for k in set(after)) <= 2


def test_sequences(stages):
    found = stages["packing"].toPandas()
    assert found.groupby("sequence_id").length.sum().max() <= 2048
    assert found[found.piece == 0].shape[0] == stages["mixing"].count()


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, DATA).count() == stages["packing"].count()


ODD = [
    (1, "the quick brown fox and the lazy dog went to the old market in the town to buy a loaf of bread for all of their friends", "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, " \n ", "fr", "b"),
    (5, " ".join(f"word{i % 997} of" for i in range(30_000)), "de", "a"), (6, "der alte Mann und das Meer sind in dem Haus von der Frau und sie sind auf dem Weg zu der Stadt", "de", "b"),
    (6, "der alte Mann und das Meer sind in dem Haus von der Frau und sie sind auf dem Weg zu der Stadt", "de", "b"), (None, "a text without any id that is in the same language as the first of them and of some length too", "en", None),
]
CLASH = ["rid", "part", "spans", "factors", "kept_sha256", "score", "rejected", "lang_pred", "n_words", "n_removed", "key", "times", "nth", "size", "id", "other", "body", "class", "check", "top", "first", "stage_x", "__rid", "__key", "n_chars"]


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_keep_clashing_columns_and_odd_rows(spark, stage):
    from pyspark.sql import functions as F

    f = dict(corpus_pipeline.STAGES)[stage]
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string").withColumns({c: F.lit(7).cast("long") if c == "n_chars" else F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id"), F.lit(0))) for c in CLASH}).repartition(2)
    found = f(spark, docs, DATA)
    assert f(spark, docs.limit(0), DATA).count() == 0
    if stage == "packing":
        assert found.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048 and found.where("piece = 0").count() == len(ODD)
        return
    assert found.columns == docs.columns
    rows = found.collect()
    assert rows and all(r[c] == f"{c} {r.doc_id or 0}" for r in rows for c in CLASH if c != "n_chars")
    kept = [r.doc_id for r in rows]
    if stage == "language_id":
        assert not {2, 3, 4} & set(kept) and kept.count(6) in (0, 2)
    if stage == "near_dedup":
        assert {1, 2, 3, 4, 5} <= set(kept) and kept.count(6) == 1
    if stage == "substring_dedup":
        assert {1, 2, 3, 4} <= set(kept)
