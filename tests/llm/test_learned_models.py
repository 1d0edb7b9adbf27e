"""The learned operators against plain computations on small corpora."""

import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablewright.llm import language_id as language
from tablewright.llm import quality_classifier as quality
from tablewright.llm import quality_rules as rules
from tablewright.llm.mixing import letter_share, word_count
from tablewright.llm.token_counts import count_tokens

fold = lambda k: zlib.crc32(str(k).encode()) % 5


def test_classifier_equals_a_plain_learner(spark):
    """Follow-the-regularised-leader over dictionaries, one feature at a time."""
    rng = random.Random(5)
    texts = {i: " ".join(rng.choice(["good", "text", "here", "and"] if i % 2 else ["buy", "$$$", "now", "now"]) for _ in range(rng.randrange(0, 30))) for i in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 60, 2)] + [(i, 1) for i in range(1, 60, 2)], "doc_id long, quality int")
    draws = {r.doc_id: r.draw for r in labels.select("doc_id", F.xxhash64(F.lit(11), "doc_id").alias("draw")).collect()}

    def vector(text):
        out = collections.defaultdict(float)
        for index, begin in quality.features(pa.array([text])):
            mine = index[begin[0] : begin[1]].tolist()
            for f in mine:
                out[f] += quality.SCALE / len(mine)
        out["bias"] = 1.0
        return out

    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(f):
        if abs(z[f]) <= 0.02:
            return 0.0
        return -(z[f] - math.copysign(0.02, z[f])) / ((1.0 + math.sqrt(n[f])) / 0.3 + 0.1)

    vectors = {k: vector(t) for k, t in texts.items()}
    for _ in range(3):
        for k in sorted((k for k in texts if fold(k)), key=draws.get):
            x = vectors[k]
            p = 1 / (1 + math.exp(-sum(weight(f) * v for f, v in x.items())))
            for f, v in x.items():
                g = (p - k % 2) * v
                sigma = (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / 0.3
                z[f] += g - sigma * weight(f)
                n[f] += g * g
    found = {r.doc_id: r for r in quality.quality_classifier(docs, labels).collect()}
    for k, x in vectors.items():
        want = 1 / (1 + math.exp(-sum(weight(f) * v for f, v in x.items())))
        assert found[k].score == pytest.approx(want, rel=1e-3, abs=1e-4) and found[k].held_out == (fold(k) == 0)


def test_language_equals_plain_cosines(spark):
    """TF-IDF of n-grams by dictionaries, against the centroids that were learned; frequencies counted by hand."""
    rng = random.Random(8)
    vocabulary = {"en": "the of and to in is that for".split(), "fr": "le de la et les des en une".split(), "xx": "zu ba ko mi ra te lo pa".split()}
    rows = [(i, " ".join(rng.choice(vocabulary[lang]) for _ in range(rng.randrange(1, 25))), lang) for i, lang in enumerate(["en", "fr", "xx"] * 25)] + [(90, None, "en"), (91, "12 !", None), (92, "The THE the", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = language.train(docs.where("lang is not null"), per_language=10**6)
    frequency, n = collections.Counter(), 0
    for _, text, lang in rows:
        if lang and any(c.isalpha() for c in text or ""):
            n += 1
            frequency.update(language.grams(text)[0].tolist())
    assert model.languages == sorted(model.languages) and collections.Counter(model.languages) == {"en": 4, "fr": 4, "xx": 4}
    assert all(model.idf[b] == pytest.approx(math.log((1 + n) / (1 + frequency[b])), rel=1e-5, abs=1e-6) for b in frequency)
    found = {r.doc_id: r for r in language.identify(docs, model).collect()}
    for k, text, _ in rows:
        index, counts, letters = language.grams(text)
        if not letters:
            assert (found[k].lang_pred, found[k].score, found[k].rejected) == ("und", 0.0, True)
            continue
        x = {b: math.log1p(c) * float(model.idf[b]) for b, c in zip(index.tolist(), counts.tolist(), strict=True)}
        norm = math.sqrt(sum(v * v for v in x.values()))
        cosines = [sum(v * float(model.by_bucket[b, j]) for b, v in x.items()) / norm for j in range(len(model.languages))]
        assert found[k].score == pytest.approx(max(0.0, min(1.0, max(cosines))), abs=1e-4)
        close = {lang for lang, c in zip(model.languages, cosines, strict=True) if c > max(cosines) - 1e-4}
        assert found[k].lang_pred in close


def test_languages_are_bounded(spark):
    docs = spark.createDataFrame([(i, "some words here", f"l{i % 7}") for i in range(60)] + [(100 + i, "more words there", "l1") for i in range(9)], "doc_id long, text string, lang string")
    assert set(language.train(docs, most_languages=2).languages) == {"l0", "l1"}


def test_features_of_native_operators_run_no_python(spark):
    """The plans that read the texts, not only those that read what was staged."""
    docs = spark.createDataFrame([(1, "a b", "en", "s")], "doc_id long, text string, lang string, source string")
    plans = [rules._features(docs, "doc_id", "text", "lang"), docs.select(word_count(F.col("text")), letter_share(F.col("text")))]
    for df in plans:
        assert not any(x in df._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Pandas", "Arrow"))


def test_token_counts_of_odd_blocks(spark):
    block = lambda *ids: np.array(ids, "<u2").tobytes()
    rows = [("a", 0, block(1, 2)), ("a", 1, None), ("a", 2, b""), ("a", 3, block(3, 9, 4)), ("b", 0, None), ("c", 0, block(9))]
    found = count_tokens(spark.createDataFrame(rows, "file_id string, block_no long, tokens binary").withColumn("n", F.lit(1)), separator=9)
    assert sorted((r.file_id, r.doc_index, r.start, r.n_tokens, r.terminated) for r in found.collect()) == [("a", 0, 0, 3, True), ("a", 1, 4, 1, False), ("c", 0, 0, 0, True)]
    assert count_tokens(spark.createDataFrame([], "file_id string, block_no long, tokens binary")).count() == 0
