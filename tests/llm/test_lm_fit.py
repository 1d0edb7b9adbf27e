"""The first weights of the language model are fitted to all training documents."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tablewright.llm import lm_scoring as lm


@pytest.mark.parametrize("documents", [1, 4, 1000])
def test_lm_fit_takes_every_training_document(spark, monkeypatch, documents):
    rng = random.Random(5)
    texts = [(i, " ".join(rng.choice(["the", "of", "and", f"w{rng.randrange(60)}"]) for _ in range(rng.choice((1, 10, 80))))) for i in range(40)]
    learned = {i: t for i, t in texts if zlib.crc32(str(i).encode()) % 5 != 1}
    df = spark.createDataFrame(texts, "doc_id long, text string")
    sent, broadcast = [], spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda x: sent.append(x) or broadcast(x))
    lm.lm_score(df, slot_bits=10, fit_documents=documents)
    lexicon, odds, mixer = sent
    rows = df.selectExpr("doc_id", "xxhash64(doc_id, text) AS rid").selectExpr("doc_id", "rid", "shiftrightunsigned(xxhash64(rid, 5), 11) AS draw").collect()
    key = {r.doc_id: (r.draw, r.rid) for r in rows}
    parts = [[(key[r.doc_id], r.text) for r in p if r.doc_id in learned] for p in df.rdd.glom().collect()]
    parts = [sum(parts, [])] if documents >= len(learned) else parts
    total = sum(lm.fit_run(pa.array([t for _, t in sorted(p[k : k + documents])]), lexicon, odds) for p in parts for k in range(0, len(p), documents))
    units, _ = lm.units_of(lm.tokens_of(pa.array(list(learned.values()))), lexicon)
    bits = np.diff(lexicon.code.first)[units.symbols].sum()
    assert total[lm._GATES * (lm.TABLES + 1) :].sum() == bits  # the map counts every bit of every training document
    want = lm.Mixer.of(total)
    assert mixer.weights == pytest.approx(want.weights, rel=1e-9) and mixer.refined == pytest.approx(want.refined, rel=1e-9)


def test_lm_fit_runs_hold_every_row_once():
    texts = ["x" * n for n in (10, 3 << 20, 5 << 20, 1, 0, 2, 2 << 20, 7)]
    rows = pa.RecordBatch.from_arrays([pa.array([*range(8, 0, -1)]), pa.array([*range(8)]), pa.array(texts)], ["draw", "rid", "text"])
    found = [r.to_pylist() for r in lm.runs(iter([rows.slice(0, 3), rows.slice(3)]), 3)]
    assert sorted(map(len, (t for r in found for t in r))) == sorted(map(len, texts))
    assert all(len(r) <= 3 for r in found) and sum(map(len, found[-1])) < 4 << 20
