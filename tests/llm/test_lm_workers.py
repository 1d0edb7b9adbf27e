"""What the language model asks of an executor: one Python worker a task, and tables in memory of a worker's own."""

import pickle

import numpy as np
import pytest

from tablewright.llm import lm_scoring as lm
from tablewright.llm.folds import sum_vectors
from tablewright.llm.textcore import span_hashes, split_words


def test_lm_tasks_need_one_worker_and_tables_are_laid_out(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"the word w{i % 7} and w{i % 3}") for i in range(60)], "doc_id long, text string")
    plans, sent, broadcast, collect = [], [], spark.sparkContext.broadcast, type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: plans.append(self._jdf.queryExecution().executedPlan().toString()) or collect(self))
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda x: sent.append(x) or broadcast(x))
    lm.lm_score(df, slot_bits=10)
    # workers of one task wait on each other, and all hold memory
    runs = [part for plan in plans for part in plan.split("== Initial Plan ==")[-1].split("Exchange")]
    assert len(plans) >= 2 and max(part.count("MapInArrow") for part in runs) == 1
    lexicon, odds, _ = sent
    for table in (lexicon.code.path, odds):
        found = pickle.loads(pickle.dumps(table, pickle.HIGHEST_PROTOCOL))
        assert type(found) is np.ndarray and found.flags.owndata and found.dtype == table.dtype and (found == table).all()


@pytest.mark.parametrize("partitions", [3, 200])
def test_sums_of_one_vector_a_partition(spark, partitions):
    parts = spark.range(partitions, numPartitions=partitions).selectExpr("CAST(CAST(CONCAT(CHAR(1 + id % 2), REPEAT(CHAR(0), 7)) AS STRING) AS BINARY) AS v")
    want = sum(1 + i % 2 for i in range(partitions))
    assert sum_vectors(parts, "v", "<i8", summed=True).tolist() == sum_vectors(parts, "v", "<i8").tolist() == [want]


def test_lookup_tells_words_of_one_prefix_apart():
    rng = np.random.default_rng(3)
    crowd = (np.uint64(77) << np.uint64(45)) + rng.integers(0, 1 << 40, 9).astype(np.uint64)  # one prefix
    last = np.uint64(2**64 - 1) - np.arange(3, dtype=np.uint64)
    hashes = np.unique(np.concatenate([crowd, last, rng.integers(0, 2**63, 500).astype(np.uint64)]))
    lexicon = lm.Lexicon.build(hashes, np.arange(1, len(hashes) + 1), 1, 1, np.ones(256, np.int64), 1)
    asked = np.concatenate([hashes[::-1], crowd + np.uint64(1), last - np.uint64(9), np.zeros(1, np.uint64)])
    place = {int(h): i for i, h in enumerate(hashes)}
    assert lexicon.lookup(asked).tolist() == [place.get(int(h), -1) for h in asked]


def test_words_in_blocks_are_those_of_one_piece():
    data = np.frombuffer("Ab\tÄ x\x0b\x1fY z  end".encode() * 5, np.uint8)
    offsets = np.array([0, 0, 3, 20, len(data)])
    words = split_words(data, offsets, lower=True)
    got = [words.data[a:b].tobytes() for a, b in zip(words.starts, words.ends, strict=True)]
    assert got == [w for a, b in zip(offsets[:-1], offsets[1:], strict=True) for w in bytes(data[a:b]).lower().split()]
    assert (span_hashes(words.data, words.starts, words.ends, 4) == span_hashes(words.data, words.starts, words.ends)).all()
