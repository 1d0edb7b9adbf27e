"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import pytest
from pyspark.sql import functions as F

from tablewright.llm.language_id import language_id
from tablewright.llm.lm_scoring import lm_score
from tablewright.llm.mixing import mix_sources, mixed_documents
from tablewright.llm.near_dedup import drop_near_duplicates, near_dedup
from tablewright.llm.packing import pack
from tablewright.llm.quality_classifier import quality_classifier
from tablewright.llm.quality_rules import quality_rules
from tablewright.llm.substring_dedup import substring_dedup
from tablewright.llm.token_counts import document_token_counts
from tablewright.llm.topk import top_k

PROSE = "the quick brown fox and the lazy dog went to the old market in the town to buy a loaf of bread for all of their friends"
LONG = " ".join(f"word{i % 997} of" for i in range(60_000))
ROWS = [
    (1, PROSE, "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, " \n\t ", "fr", "b"), (5, LONG, "de", "a"),
    (6, PROSE, "en", "b"), (6, PROSE, "en", "b"), (None, PROSE, "en", "a"), (None, None, None, None), (7, "é" * 5000, "fr", "ü"), (8, "x", "en", "a"),
]
CLASH = ["rid", "part", "tie", "size", "word", "class", "bucket", "score", "key", "slot", "rank", "n", "top", "ord", "block", "seq", "lang_pred", "kept"]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (6, 1), (8, 0), (None, 1), (2, None), (7, 0)], "doc_id long, quality int")


PER_ROW = {
    "mixing": mix_sources, "rules": quality_rules, "language": lambda d: language_id(d, per_language=5), "lm": lm_score, "near": near_dedup,
    "substring": substring_dedup, "digest": lambda d: substring_dedup(d, keep_columns=False, digest=True), "tokens": document_token_counts,
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_per_input_row(name, odd, none):
    found = PER_ROW[name](odd).toPandas()
    assert len(found) == len(ROWS)
    assert sorted(x for x in found.doc_id.dropna()) == [1, 2, 3, 4, 5, 6, 6, 7, 8]
    assert PER_ROW[name](none).count() == 0


def test_classifier(odd, none, labels):
    found = quality_classifier(odd, labels).toPandas()
    assert len(found) == len(ROWS) and found.score.between(0, 1).all()
    assert quality_classifier(none, labels).count() == 0
    assert quality_classifier(odd, labels.limit(0)).where("score <> 0.5").count() == 0


def test_packing(odd, none):
    found = pack(odd).toPandas()
    assert found.groupby("sequence_id").length.sum().max() <= 2048
    assert (found[found.doc_id == 2].length == 1).all() and (found[found.doc_id == 3].length == 1).all()
    assert pack(none).count() == 0


def test_near_dedup_labels(odd):
    found = near_dedup(odd).toPandas()
    assert (found[found.doc_id == 6].component_id == 1).all() and not found[found.doc_id == 6].kept.any()
    assert found[found.doc_id.isna() & (found.n_shingles > 0)].component_id.tolist() == [1]
    for empty in (2, 3, 4):
        assert found[found.doc_id == empty].component_id.tolist() == [empty]


def test_pipeline_forms_keep_columns(odd, none):
    stays = drop_near_duplicates(odd, shingle=5)
    assert stays.columns == odd.columns
    assert stays.where("text is not null and length(trim(text)) > 20").count() == 3
    mixed = mixed_documents(odd)
    assert mixed.columns == odd.columns
    assert drop_near_duplicates(none).count() == mixed_documents(none).count() == 0


def test_mix_takes_what_it_says(odd):
    taken = mix_sources(odd).agg(F.sum("taken")).first()[0]
    words = mixed_documents(odd).select(F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).alias("n")).agg(F.sum("n")).first()[0]
    assert words == taken


def test_top_k(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.5]), (20, [1.0, 0.5]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [nan, 1.0]), (5, [None, 1.0]), (None, [9.0, 9.0]), (6, []), (7, [-1.0]), (1, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"q": F.lit(1), "cb": F.lit(2)})
    found = top_k(df, k=4).orderBy("query_id", "rank").toPandas()
    assert found[found.query_id == 0].vec_id.tolist() == [20, 1, 1, 2]
    assert found[found.query_id == 20].vec_id.tolist() == [0, 1, 1, 2]
    assert top_k(df.limit(0)).count() == 0
