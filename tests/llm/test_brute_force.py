"""Operators against plain implementations on small data."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import lm_scoring as lm
from tablewright.llm.components import connected_components
from tablewright.llm.language_id import language_id
from tablewright.llm.mixing import mix_sources
from tablewright.llm.near_dedup import near_dedup
from tablewright.llm.packing import best_fit_plan, pack
from tablewright.llm.quality_classifier import quality_classifier
from tablewright.llm.quality_rules import quality_rules
from tablewright.llm.staging import Staged
from tablewright.llm.substring_dedup import substring_dedup
from tablewright.llm.token_counts import count_tokens, document_token_counts, read_flat_files
from tablewright.llm.tokens import JSON_FILE, encode, vocabulary_path
from tablewright.llm.topk import top_k

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").repartition(5).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


@pytest.fixture(scope="module")
def copies(spark):
    """Families of near copies: originals, variants of variants, shared passages, plain copies."""
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, passage = [], [rng.choice(vocabulary) for _ in range(60)]
    for family in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((6, 30, 120, 300)))]
        for v in range(25):
            words = list(base)
            for _ in range(rng.randrange(0, max(2, len(words) // 12))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if v % 5 == 0:
                words += passage
            rows.append((len(rows) * 7 % 1009, " ".join(words)))
    rows += [(2000 + i, rows[i][1]) for i in range(30)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(6)


def components_by_hand(rows, n, percent):
    sets, parent = {}, {}
    for k, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
        parent[k] = k

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in sets}


@pytest.mark.parametrize("block", [16, 1024])
def test_near_dedup(copies, block):
    rows = [(r.doc_id, r.text) for r in copies.collect()]
    want = components_by_hand(rows, 4, 80)
    found = near_dedup(copies, block=block, chunk=8).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def substring_by_hand(rows, window):
    first, words = {}, {k: WORD.findall(t or "") for k, t in rows}
    for k in sorted(words):
        for i in range(len(words[k]) - window + 1):
            first.setdefault(tuple(words[k][i : i + window]), (k, i))
    out = {}
    for k, w in words.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (k, i):
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[k] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_substring_dedup(copies):
    rows = [(r.doc_id, r.text) for r in copies.collect()] + [(5000, "a b " * 40), (5001, "x " * 19), (5002, "x " * 21)]
    df = copies.sparkSession.createDataFrame(rows, "doc_id long, text string").repartition(7)
    found = substring_dedup(df, keep_columns=False, digest=True).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found} == substring_by_hand(rows, 20)
    kept = {r.doc_id: r for r in substring_dedup(df).collect()}
    for k, (_, removed, digest) in substring_by_hand(rows, 20).items():
        if removed:
            assert hashlib.sha256(kept[k].text.encode()).hexdigest() == digest
        assert sum(s.end - s.start for s in kept[k].spans) == removed


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 400)] + [(1000, 2000), (2000, 1500), (7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    found = {r.node: r.root for r in connected_components(df, Staged(spark, "test"), "cc").collect()}
    assert all(found[i] == 0 for i in range(401)) and found[1500] == found[2000] == found[1000] == 1000


def test_mixing(docs):
    found = mix_sources(docs).join(docs.select("doc_id", "source"), "doc_id").toPandas()
    sizes = found.groupby("source")["size"].sum().to_dict()
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
    target, capped = {}, set()
    while True:  # share, cap, share the excess again
        free = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in capped)
        open_ = sum(w for s, w in weights.items() if s not in capped)
        target = {s: 2 * sizes[s] if s in capped else free * weights[s] / open_ for s in sizes}
        over = {s for s in sizes if target[s] > 2 * sizes[s]}
        if not over:
            break
        capped |= over
    assert found.groupby("source").target.first().to_dict() == pytest.approx(target)
    taken = found.groupby("source").taken.sum().to_dict()
    biggest = found.groupby("source")["size"].max().to_dict()
    assert all(abs(taken[s] - target[s]) <= biggest[s] / 2 for s in sizes)
    assert (found.taken <= 2 * found["size"]).all()
    again = mix_sources(docs.repartition(3)).select("doc_id", "taken").toPandas().set_index("doc_id").taken
    assert (again.sort_index() == found.set_index("doc_id").taken.sort_index()).all()


def test_mixing_prefers_quality(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.lit("s").alias("source"), (F.col("id") % 2).alias("good"))
    found = mix_sources(df, share=0.5, quality=F.when(F.col("good") == 1, 3.0).otherwise(1.0)).join(df, "doc_id")
    share = {r.good: r.m for r in found.groupBy("good").agg(F.avg(F.col("taken") / 2).alias("m")).collect()}
    assert share[1] > 0.6 > 0.4 > share[0]


@pytest.mark.parametrize("operator", [mix_sources, quality_rules])
def test_native_operators_run_no_python(docs, operator):
    plan = operator(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_quality_rules(docs, texts):
    for r in quality_rules(docs).collect():
        text = texts[r.doc_id]
        w = WORD.findall(text)
        windows = collections.Counter(zip(w, w[1:], w[2:]))
        repeated = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)


def test_quality_rules_verdict(spark, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    found = quality_rules(docs).where("not base_failed").join(labels, "doc_id").toPandas()
    assert found[found.quality == 1].kept.mean() > 0.99 and found[found.quality == 0].kept.mean() < 0.15


def test_best_fit_plan_equals_plain_best_fit():
    rng = random.Random(1)
    for capacity, n in ((10, 40), (100, 300), (2048, 500)):
        lengths = [rng.randint(1, capacity) for _ in range(n)]
        bins = []
        for x in sorted(lengths, reverse=True):
            fits = [i for i, left in enumerate(bins) if left >= x]
            if fits:
                bins[min(fits, key=lambda i: bins[i])] -= x
            else:
                bins.append(capacity - x)
        plan = best_fit_plan(dict(collections.Counter(lengths)), capacity)
        used, counts = collections.defaultdict(int), collections.Counter(lengths)
        for k, (length, rank, first, per, offset) in enumerate(plan.tolist()):
            end = plan[k + 1][1] if k + 1 < len(plan) and plan[k + 1][0] == length else counts[length]
            for i in range(end - rank):
                assert offset + i % per * length + length <= capacity
                used[first + i // per] += length
        assert len(used) == len(bins) and sum(used.values()) == sum(lengths)


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path(JSON_FILE))
    tokenizer.encode_special_tokens = True
    ids = {k: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4") for k, t in texts.items()}
    found = pack(docs, keep_ids=True).toPandas()
    for k, mine in found.sort_values("piece").groupby("doc_id"):
        assert b"".join(mine.ids) == ids[k].tobytes()
        assert all(zlib.crc32(x) == c for x, c in zip(mine.ids, mine.ids_crc32, strict=True))
        assert mine.start.tolist() == [0, *mine.length.cumsum()[:-1]] and (mine.length.iloc[1:] == 2048).all()
    for _, mine in found.sort_values("offset").groupby("sequence_id"):
        assert mine.offset.tolist() == [0, *mine.length.cumsum()[:-1]] and mine.length.sum() <= 2048
    assert found.sequence_id.nunique() <= math.ceil(found.length.sum() / 2048) + 2


def test_encode_special_and_long():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path(JSON_FILE))
    tokenizer.encode_special_tokens = True
    for text in ("a <|endoftext|> b", "x" * 9000, " " * 5000 + "y", "naïve 漢字 🙂\r\n\t tabs", "don't 1234"):
        assert encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_token_counts(docs, texts):
    found = document_token_counts(docs, block_tokens=777).collect()
    assert {r.doc_id: r.n_tokens for r in found} == {k: len(encode(t)) for k, t in texts.items()}


def test_flat_files(spark, tmp_path):
    streams = {"a": [5, 9, 9, 1, 2, 3, 4, 9], "b": [1, 2], "c": [9], "d": list(range(1, 8)) * 3}
    for name, ids in streams.items():
        (tmp_path / f"{name}.bin").write_bytes(np.array(ids, "<u2").tobytes())
    rows = count_tokens(read_flat_files(spark, str(tmp_path), block_tokens=3), separator=9).collect()
    by_file = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: r.doc_index):
        by_file[r.file_id.rsplit("/", 1)[1][0]].append((r.start, r.n_tokens, r.terminated))
    assert by_file == {"a": [(0, 1, True), (2, 0, True), (3, 4, True)], "b": [(0, 2, False)], "c": [(0, 0, True)], "d": [(0, 21, False)]}


def test_language_id(docs):
    found = language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = found[found.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97 and not found.rejected.any()
    foreign = docs.sparkSession.createDataFrame([(1, "Привет, как дела? Это русский текст о погоде и природе."), (2, "12 34 !!")], "doc_id long, text string")
    both = docs.select("doc_id", "text", "lang").unionByName(foreign.withColumn("lang", F.lit(None).cast("string")).withColumn("doc_id", F.col("doc_id") + 10**6))
    got = {r.doc_id: r for r in language_id(both).where("doc_id > 1000000").collect()}
    assert got[10**6 + 1].rejected and got[10**6 + 2].lang_pred == "und"


def test_quality_classifier(spark, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    found = quality_classifier(docs, labels).join(labels, "doc_id").toPandas()
    held = found[found.held_out]
    assert (held.quality == held.predicted).mean() > 0.9
    assert held[held.quality == 1].score.mean() > held[held.quality == 0].score.mean() + 0.5


def test_top_k(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(0, 0.2, (900, 24))
    vectors[100:180] = vectors[20]  # many ties at every boundary
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(5)
    q = np.floor(64 * vectors).astype(int)
    found = collections.defaultdict(list)
    for r in top_k(df, block_rows=256, query_rows=16, cells=4).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    for i in range(0, 900, 20):
        scores = q @ q[i]
        order = sorted((j for j in range(900) if j != i), key=lambda j: (-scores[j], j))[:20]
        assert found[i] == [(j, scores[j]) for j in order]


def test_top_k_of_large_components(spark):
    rows = [(0, [4e7, 1.0]), (1, [3.3e7] * 2), (2, [-4e7, 2.0]), (20, [1.0, -1.0])]
    found = {(r.query_id, r.vec_id): r.score for r in top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    whole = {k: [math.floor(64 * x) for x in v] for k, v in rows}
    assert found == {(a, b): sum(x * y for x, y in zip(whole[a], whole[b], strict=True)) for a in (0, 20) for b in whole if a != b}
    wide = spark.createDataFrame([(0, [1e15] * 2), (1, [1e15] * 2)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="does not fit a long"):
        top_k(wide).collect()


def test_index_rows_are_made_for_present_blocks_only():
    """One slice of texts against 300,000 blocks: as many rows as blocks that get something, in bounded time."""
    import time

    import pyarrow as pa

    from tablewright.llm import substring_dedup as dedup

    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(50_000)}" for _ in range(400)) for _ in range(1500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1500), pa.int64()), pa.array(range(1500), pa.int64()), pa.array(texts)], ["ord", "rid", "text"])
    found = dedup.Windows(batch, 20, 8)
    began = time.process_time()
    rows = dedup._index_rows(found, 300_000)
    assert time.process_time() - began < 1.5 and rows.num_rows == len(set(rows.column(0).to_pylist()))


def test_a_common_phrase_does_not_fill_one_block(spark, monkeypatch):
    """An anchor that stands in a third of all documents, in ever new surroundings, is split over blocks."""
    import pyarrow as pa

    from tablewright.llm import substring_dedup as dedup

    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**6)}"
    hashed = lambda text: int(dedup.gram_hashes(dedup.span_hashes(*dedup.split_words(*dedup.buffers(pa.array([text])))[:3]), 8)[0])
    phrase = min((" ".join(word() for _ in range(8)) for _ in range(200)), key=hashed)  # one that is the anchor wherever it stands
    rows = []
    for i in range(1500):
        middle = phrase if i % 3 == 0 else " ".join(word() for _ in range(8))
        rows.append((i, " ".join(word() for _ in range(12)) + " " + middle + " " + " ".join(word() for _ in range(12))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    source = df.select(F.col("doc_id").alias("ord"), F.col("doc_id").alias("rid"), "text")
    monkeypatch.setattr(dedup, "_MOST_ANCHORS", 100)
    heavy = dedup.heavy_anchors(source, 20, 8)
    batch = source.toArrow().combine_chunks().to_batches()[0]
    most = {}
    for use in (heavy[:0], heavy):
        found = dedup.Windows(batch, 20, 8)
        found.split(use)
        _, counts = np.unique(found.anchors[found.at], return_counts=True)
        most[len(use) > 0] = counts.max() / len(found.at)
    assert len(heavy) and most[True] < 0.02 < most[False]
    digests = substring_dedup(df, keep_columns=False, digest=True).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in digests} == substring_by_hand(rows, 20)


def test_factors_are_greedy_and_refer_to_earlier_words(copies):
    rows = {r.doc_id: WORD.findall(r.text) for r in copies.collect()}
    some = 0
    for r in substring_dedup(copies).collect():
        for f in r.factors:
            some += 1
            assert f.words >= 20 and (f.source, f.source_start) < (r.doc_id, f.start)
            assert rows[r.doc_id][f.start : f.start + f.words] == rows[f.source][f.source_start : f.source_start + f.words]
        assert all(a.start < b.start for a, b in itertools.pairwise(r.factors))
        covered = {i for f in r.factors for i in range(f.start, f.start + f.words)}
        assert len(covered) == r.n_removed
    assert some > 20


def test_near_dedup_of_short_texts(spark):
    """Sets of few shingles, where signatures say little: every link counts."""
    rng = random.Random(6)
    rows = []
    for _ in range(40):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(8, 26))]
        for _ in range(6):
            words = list(base)
            if rng.random() < 0.8:
                words[rng.choice((0, -1))] = f"w{rng.randrange(300)}"
            rows.append((len(rows), " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup(df).collect()} == components_by_hand(rows, 4, 80)


def test_quality_rules_repeats_with_colliding_hashes(spark, monkeypatch):
    """Windows with equal hashes and other words are told apart by their words."""
    from tablewright.llm import quality_rules as rules

    monkeypatch.setattr(rules.F, "xxhash64", lambda *c: F.length(F.concat(*c)).cast("long"))
    rng = random.Random(1)
    texts = [(i, " ".join(rng.choice("abcdef") for _ in range(60))) for i in range(10)]
    found = {r.doc_id: r.n_repeat_words for r in quality_rules(spark.createDataFrame(texts, "doc_id long, text string").withColumn("lang", F.lit("en"))).collect()}
    for k, text in texts:
        w = text.split()
        windows = collections.Counter(zip(w, w[1:], w[2:]))
        assert found[k] == len({j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)})


def test_mixing_takes_the_smallest_keys(spark):
    """Plain exponential keys sorted within the source: the mix takes those up to the budget, also for tiny weights."""
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b "), F.col("id")).alias("text"), F.when(F.col("id") % 3 == 0, "s").otherwise("t").alias("source"))
    for weight in (0.001, 1.0):
        found = mix_sources(df, share=0.4, quality=F.lit(weight)).join(df, "doc_id").toPandas()
        for _, mine in found.groupby("source"):
            u = ((mine.key.to_numpy().astype("int64").view("uint64") >> np.uint64(12)).astype(float) + 0.5) / 2**52
            key = -np.log(u) / weight
            mine = mine.assign(exp=key).sort_values("exp")
            rest = mine.target.iloc[0] % mine.source_size.iloc[0]
            so_far = mine["size"].cumsum()
            epochs = mine.target.iloc[0] // mine.source_size.iloc[0]
            assert ((so_far - mine["size"] / 2 <= rest) == (mine.repeats > epochs)).all()


def test_lm_base_scores(docs, texts):
    found = lm.lm_score(docs).collect()
    tokens = {k: [*WORD.findall(t.translate(LOWER)), None] for k, t in texts.items()}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in tokens}
    counts = collections.Counter(w for k, ws in tokens.items() if not held[k] for w in ws)
    total, kinds = sum(counts.values()), len(counts)
    for r in found:
        mine = tokens[r.doc_id]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in mine)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(mine), sum(w in counts for w in mine), total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score < 0 and 0 < r.bits_per_byte < 8


def plain_lm(texts, held, vocabulary, bits):
    """The model's log10 probabilities, one bit at a time, without arrays over bits."""
    words = {k: [w.encode() for w in WORD.findall((t or "").translate(LOWER))] for k, t in texts.items()}
    mask = 2**64 - 1

    def mix(x):
        x ^= x >> 32
        x = x * 0xD6E8FEB86659FD93 & mask
        x ^= x >> 32
        x = x * 0xD6E8FEB86659FD93 & mask
        return x ^ x >> 32

    def spelled_hash(data, extra):
        return (sum((c + 1) * pow(0x9E3779B97F4A7C15, i, 2**64) for i, c in enumerate(data)) + extra) & mask

    def salted(k, *values):
        total = k * 0x9E3779B97F4A7C15 & mask
        for i, v in enumerate(values):
            total = (total + v) * (0xC2B2AE3D27D4EB4F + 2 * i) & mask
        return total >> 32

    word_hash = lambda w: mix(spelled_hash(w, len(w)))
    learned = [k for k in words if k not in held]
    counts = collections.Counter(w for k in learned for w in words[k])
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    top = sorted((w for w, n in counts.items() if n > 3), key=lambda w: (-counts[w], signed(word_hash(w))))[:vocabulary]
    by_hash = sorted(top, key=word_hash)
    place = {w: i for i, w in enumerate(by_hash)}
    very = set(sorted(top, key=lambda w: (-counts[w], word_hash(w)))[:64])
    escapes, n_words = sum(n for w, n in counts.items() if w not in place), sum(counts.values())
    by_byte = np.bincount(np.frombuffer(b"".join(w for k in learned for w in words[k]), np.uint8), minlength=256)
    code = lm.Lexicon.build(np.array([word_hash(w) for w in top], np.uint64), np.array([counts[w] for w in top], np.int64), escapes, len(learned), by_byte, n_words).code
    paths = [code.path[code.first[i] : code.first[i + 1]].tolist() for i in range(len(code.first) - 1)]

    def coded(k):
        """(token, spelled, contexts, path) of every coded symbol."""
        ws, frequent = words[k], [0, 0]
        for i, w in enumerate([*ws, None]):
            before = word_hash(ws[i - 1]) if i else 0x52DCE729DA3ED6A5
            cs = [salted(1, before), salted(2, frequent[0]), salted(3, frequent[1])]
            yield i, False, cs, paths[1 if w is None else place[w] + 2 if w in place else 0]
            if w is not None and w not in place:
                lead = ((ws[i - 1][-3:] if i else b"").rjust(3, b"\0") + b" ")
                for j in range(len(w) + 1):
                    b = (lead + w[:j])[-4:]
                    three = b[3] + (b[2] << 8) + (b[1] << 16)
                    cs = [salted(11, spelled_hash(w[:j], j)), salted(12, three, frequent[0]), salted(13, three + (b[0] << 24))]
                    yield i, True, cs, paths[len(place) + 2 + (w[j] if j < len(w) else 256)]
            if w in very:
                frequent = [place[w] + 1, frequent[0]]

    def slot(context, step):
        x = (context + (step >> 1) * 0x9E3779B1) * 0x85EBCA6B & 0xFFFFFFFF
        x = (x ^ x >> 15) * 0x2C1B3C6D & 0xFFFFFFFF
        return x >> (32 - bits)

    seen = np.zeros((lm.TABLES, 2, 1 << bits), np.int64)
    for k in learned:
        for _, _, cs, path in coded(k):
            for step in path:
                for t, c in enumerate(cs):
                    seen[t, step & 1, slot(c, step)] += 1

    def inputs(cs, step, left_out):
        x = []
        for t, c in enumerate(cs):
            n = seen[t, :, slot(c, step)].copy()
            if left_out:
                n[step & 1] = max(n[step & 1] - 1, 0)
            x.append(np.rint(np.clip(np.log((n[1] + 0.15) / (n[0] + 0.15)), -12, 12) * 10) / 10)
        return x

    def gate(spelled, x):
        sure = lambda v: sum(bool(abs(v) > x) for x in (0.05, 1.55, 3.05))
        return spelled * 16 + sure(x[0]) * 4 + sure(x[2])

    def cell(spelled, mixed):
        return spelled * 33 + int(np.rint((np.clip(mixed, -8, 8) + 8) * 2))

    def learn(weights, doubt, group):
        g, h = np.zeros((32, 3)), np.zeros(32)
        for row, x, p, bit in group:
            g[row] += (bit - p) * np.array(x)
            h[row] += p * (1 - p)
        doubt += h
        weights += 0.3 / (10 + doubt[:, None]) * g

    # first weights: over all training documents in order of their draw, 512 symbols at a time
    squash = lambda v: 1 / (1 + math.exp(-v))
    centre = [squash(v) for v in np.linspace(-8, 8, 33)] * 2
    weights, doubt, hits = np.full((32, 3), 0.4), np.zeros(32), np.zeros((2, 66))
    return words, counts, place, escapes, learned, coded, inputs, gate, cell, learn, squash, centre, weights, doubt, hits


def test_lm_model(spark):
    """Scores equal a plain computation, bit by bit."""
    rng = random.Random(9)
    vocabulary = ["the", "of", "and", "é", "wordy", *(f"w{i}" for i in range(30))]
    texts = {i: " ".join(rng.choice(vocabulary[: 5 + i % 30]) + rng.choice(["", "", "", "x" * (i % 4)]) for _ in range(rng.choice((0, 1, 20, 90)))) for i in range(24)}
    texts[24], texts[25] = texts[3], None
    held = {k for k in texts if zlib.crc32(str(k).encode()) % 5 == 1}
    bits, size = 10, 12
    words, counts, place, escapes, learned, coded, inputs, gate, cell, learn, squash, centre, weights, doubt, hits = plain_lm(texts, held, size, bits)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rid = df.select("doc_id", F.xxhash64("doc_id", "text").alias("rid")).withColumn("draw", F.shiftrightunsigned(F.xxhash64("rid", F.lit(5)), 11))
    order = [r.doc_id for r in rid.orderBy("draw", "rid").collect() if r.doc_id in set(learned)]
    units = [u for k in order for u in coded(k)]
    for low in range(0, len(units), 512):
        group = []
        for _, spelled, cs, path in units[low : low + 512]:
            for step in path:
                x = inputs(cs, step, True)
                row = gate(spelled, x)
                mixed = float(np.clip(weights[row] @ x, -12, 12))
                hits[step & 1, cell(spelled, mixed)] += 1
                group.append((row, x, squash(mixed), step & 1))
        learn(weights, doubt, group)
        doubt *= 0.999
    refined = (hits[1] + 16 * np.array(centre)) / (hits.sum(axis=0) + 16)
    once, twice = (sum(n == m for n in counts.values()) for m in (1, 2))
    discount = once / (once + 2 * twice) if once and twice else 0.5
    cold = len(counts) - len(place)
    want = {}
    for k in texts:
        mine, unsure, own = weights.copy(), np.zeros(32), np.zeros((2, 66))
        total, spelling, now, group, learned_here = 0.0, collections.defaultdict(float), 0, [], k not in held

        def settle():
            learn(mine, unsure, [g[:4] for g in group])
            for _, _, _, bit, c in group:
                own[bit, c] += 1
            group.clear()

        for token, spelled, cs, path in coded(k):
            step_of = int(lm.steps(np.array([token]))[0])
            if step_of != now:
                settle()
                now = step_of
            for step in path:
                bit, x = step & 1, inputs(cs, step, learned_here)
                row = gate(spelled, x)
                mixed = float(np.clip(mine[row] @ x, -12, 12))
                c = cell(spelled, mixed)
                p = squash(mixed)
                q = float(np.clip((p + (own[1, c] + 32 * refined[c]) / (own[:, c].sum() + 32)) / 2, 1e-6, 1 - 1e-6))
                lp = math.log10(q if bit else 1 - q)
                if spelled:
                    spelling[token] += lp
                else:
                    total += lp
                group.append((row, x, p, bit, c))
        for token, lp in spelling.items():
            n = counts[words[k][token]] - learned_here
            total += math.log10(max(n - discount, 0) / escapes + discount * cold / escapes * 10**lp) if escapes else lp
        want[k] = total
    found = {r.doc_id: r.score for r in lm.lm_score(df, vocabulary=size, slot_bits=bits).collect()}
    assert found == {k: pytest.approx(v, rel=2e-5, abs=2e-5) for k, v in want.items()}


def test_lm_beats_the_unigram_on_held_out_documents(docs):
    held = lm.lm_score(docs).where("held_out").agg(F.sum("score").alias("score"), F.sum("base_score").alias("base")).first()
    assert held.score > held.base


def test_lm_knows_word_order(docs):
    """The same words in another order have another probability."""
    some = docs.where("doc_id < 400 and length(text) > 200").select("doc_id", "text")
    turned = some.select((F.col("doc_id") + 10**6).alias("doc_id"), F.array_join(F.reverse(F.split("text", r"\s+")), " ").alias("text"))
    found = lm.lm_score(some.unionByName(turned)).where("held_out").select((F.col("doc_id") % 10**6).alias("k"), "n_tokens", "score").toPandas()
    both = found.groupby("k").filter(lambda g: len(g) == 2).groupby("k").score
    assert len(both) > 3 and (both.max() - both.min() > 1e-3).all()


def test_prefix_codes():
    """Huffman codes are complete, prefix-free and as short as their weights allow."""
    for weights in ([5, 1], [1] * 7, [100, 50, 20, 3, 3, 1, 1, 1]):
        code = lm.huffman(np.array(weights))
        paths = ["".join(str(int(s) & 1) for s in code.path[a:b]) for a, b in itertools.pairwise(code.first)]
        assert sum(2.0 ** -len(p) for p in paths) == 1 and not any(a != b and b.startswith(a) for a in paths for b in paths)
        heap = sorted(weights)
        cost = 0
        while len(heap) > 1:
            a, b, *heap = sorted(heap)
            cost += a + b
            heap.append(a + b)
        assert sum(w * len(p) for w, p in zip(weights, paths, strict=True)) == cost
