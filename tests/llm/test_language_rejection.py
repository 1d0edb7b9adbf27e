"""Texts in no learned language are rejected at any length."""

import random

import pytest
from pyspark.sql import functions as F

from tablewright.llm.language_id import LEAST_LETTERS, language_id

ALPHABETS = {
    "cyrillic": "".join(map(chr, range(0x430, 0x450))),
    "han": "".join(map(chr, range(0x4E00, 0x4E00 + 3000))),
    "latin": "abcdefghijklmnopqrstuvwxyz",
}
SHORT = ["it was the house", "und das ist nicht", "que el libro", "le chat est"]


def unrelated(alphabet: str, n: int) -> str:
    rng = random.Random(n)
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def verdicts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    more = {10**6 + i: text for i, text in enumerate([unrelated(a, n) for a in ALPHABETS.values() for n in (12, 50, 1000, 5000)] + SHORT)}
    added = spark.createDataFrame([*more.items()], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    found = {r.doc_id: r.rejected for r in language_id(docs.unionByName(added)).collect()}
    return {text: found[k] for k, text in more.items()}, [found[k] for k in found if k < 10**6]


@pytest.mark.parametrize("n", [12, 50, 1000, 5000])
@pytest.mark.parametrize("name", ALPHABETS)
def test_unrelated_text_is_rejected(verdicts, name, n):
    assert verdicts[0][unrelated(ALPHABETS[name], n)]


def test_documents_and_short_clean_texts_stay(verdicts):
    assert not any(verdicts[1])
    assert all(sum(map(str.isalpha, text)) < LEAST_LETTERS and not verdicts[0][text] for text in SHORT)
