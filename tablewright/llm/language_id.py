"""Language identification by nearest clustered centroids of TF-IDF character n-grams.

Texts are lower-cased; everything but letters separates words. Character pairs
and triples are hashed into a fixed number of buckets. Document frequencies come
from all training documents; the centroids (several per language, spherical
k-means) from a bounded sample of each language. A document gets the language of
the centroid with the largest cosine. Cosines grow with a text's length, through
bucket collisions even for foreign letters, so a text of some length is rejected by
a mean that does not: the log probability of its n-grams in each language. Only very short
texts, whose means say little, are rejected by their cosine.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import remainder, sum_vectors
from .staging import bounded_batches, fresh
from .textcore import column

BUCKETS = 1 << 14
UNDETERMINED = "und"
LEAST_LETTERS = 40


@functools.cache
def _letters() -> np.ndarray:
    """Code point of every letter, and 32 for all else."""
    table = np.full(sys.maxunicode + 1, 32, dtype=np.uint32)
    letters = np.fromiter((i for i in range(sys.maxunicode + 1) if chr(i).isalpha()), dtype=np.int64)
    table[letters] = letters
    return table


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Buckets of a text's n-grams with their counts, and the number of letters."""
    text = (text or "").lower()
    counts = np.zeros(BUCKETS, dtype=np.int64)
    letters = 0
    table, shift, step = _letters(), np.uint64(64 - (BUCKETS.bit_length() - 1)), 1 << 20
    for low in range(0, len(text), step):  # very long texts: pieces that overlap by one character
        piece = " " * (low == 0) + text[max(low - 1, 0) : low + step + 1] + " " * (low + step >= len(text))
        c = table[np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        mid = np.flatnonzero(c[1:-1] != 32) + 1
        letters += len(mid)
        a, b, d = c[mid - 1], c[mid], c[mid + 1]
        pair = b * np.uint64(0x9E3779B97F4A7C15) + d * np.uint64(0xC2B2AE3D27D4EB4F)
        triple = (pair ^ (pair >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + a * np.uint64(0x94D049BB133111EB)
        pair = (pair ^ (pair >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        counts += np.bincount((np.concatenate([pair, triple]) >> shift).astype(np.int64), minlength=BUCKETS)
    index = np.flatnonzero(counts)
    return index, counts[index], letters


def _values(index: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF values of a text's buckets."""
    x = np.log1p(counts).astype(np.float32) * idf[index]
    return x / max(float(np.sqrt(x @ x)), 1e-12)


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS + 1, dtype=np.int64)  # the last counts documents
    for batch in batches:
        for text in column(batch, "text"):
            index, _, letters = grams(text.as_py())
            total[index] += 1
            total[-1] += letters > 0
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])


def clusters(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means with farthest-first seeds; deterministic for a given order of rows."""
    mean = x.mean(axis=0)
    seeds = [int(np.argmax(x @ mean))]
    nearest = x @ x[seeds[0]]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, x @ x[seeds[-1]])
    centres = x[seeds]
    for _ in range(rounds):
        of = np.argmax(x @ centres.T, axis=1)
        sums = np.stack([x[of == j].sum(axis=0) if (of == j).any() else centres[j] for j in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1), 1e-12)[:, None]
    return centres.astype(np.float32)


def profile(found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """log2 probability of each bucket in a language, less the limit: half-way from its own texts' mean to unrelated n-grams."""
    share = np.zeros(BUCKETS)
    for index, counts in found:
        share[index] += counts / counts.sum() / len(found)
    bits = np.log2(0.9 * share + 0.1 / BUCKETS)
    return (bits - (share @ bits + bits.mean()) / 2).astype(np.float32)


class Model:
    """Centroids with their languages, inverse document frequencies, and a profile per language."""

    def __init__(self, languages: list[str], centroids: np.ndarray, idf: np.ndarray, profiles: np.ndarray):
        self.languages, self.idf = languages, idf
        self.by_bucket, self.profiles = np.ascontiguousarray(centroids.T), np.ascontiguousarray(profiles.T)

    def predict(self, text: str | None) -> tuple[str, float, float | None]:
        """Language of the nearest centroid, the cosine to it, and the margin above the limit of the likeliest language.

        The margin is a mean over n-grams, whatever their number; it is null for fewer than ``LEAST_LETTERS`` letters.
        """
        index, counts, letters = grams(text)
        if not letters or not self.languages:
            return UNDETERMINED, 0.0, None
        cosines = _values(index, counts, self.idf) @ self.by_bucket[index]
        best = int(np.argmax(cosines))
        margin = float((counts @ self.profiles[index]).max() / counts.sum()) if letters >= LEAST_LETTERS else None
        return self.languages[best], float(np.clip(cosines[best], 0.0, 1.0)), margin


def train(docs: DataFrame, *, per_language: int = 600, centroids: int = 4, seed: int = 3, most_languages: int = 512) -> Model:
    """Learn from doc_id, text and non-null lang. ``per_language`` bounds the expected sample that centroids see;
    ``most_languages`` bounds the model: only so many values of lang, those of most documents, are learned."""
    bounded_batches(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull())
    frequencies = sum_vectors(known.select("text").mapInArrow(_document_frequencies, "v binary"), "v", "<i8")
    if frequencies is None or not frequencies[-1]:
        none = np.zeros((0, BUCKETS), np.float32)
        return Model([], none, np.ones(BUCKETS, np.float32), none)
    idf = np.log((1.0 + frequencies[-1]) / (1.0 + frequencies[:-1])).astype(np.float32)
    # a share of each language by hash, so that no task gets all rows of a common language; one row per
    # learned language is broadcast
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages)
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 11).cast("double") / F.lit(float(2**53))
    sample = known.join(F.broadcast(sizes), "lang").where(draw * F.col("n") < per_language).select("lang", "doc_id", "text")

    def cluster(group: pa.Table) -> pa.Table:
        texts = group["text"].to_pylist()
        order = sorted(range(len(texts)), key=lambda i: (str(group["doc_id"][i]), texts[i] or ""))  # ids of any type
        rows = np.zeros((len(order), BUCKETS), dtype=np.float32)
        found = []
        for i in order:
            index, counts, letters = grams(texts[i])
            if letters:
                rows[len(found), index] = _values(index, counts, idf)
                found.append((index, counts))
        rows = rows[: len(found)]
        made = [*clusters(rows, centroids), profile(found)] if found else []
        kinds = ["centroid"] * (len(made) - 1) + ["profile"] if found else []
        lang = [group["lang"][0].as_py()] * len(made)
        return pa.table({"lang": pa.array(lang, pa.string()), "kind": pa.array(kinds, pa.string()), "v": pa.array([v.tobytes() for v in made], pa.binary())})

    rows = sorted(sample.groupBy("lang").applyInArrow(cluster, "lang string, kind string, v binary").collect())
    of = {kind: [np.frombuffer(r["v"], dtype=np.float32) for r in rows if r["kind"] == kind] for kind in ("centroid", "profile")}
    stacked = {kind: np.stack(v) if v else np.zeros((0, BUCKETS), np.float32) for kind, v in of.items()}
    return Model([r["lang"] for r in rows if r["kind"] == "centroid"], stacked["centroid"], idf, stacked["profile"])


def identify(
    docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text", reject_below: float = 0.025, keep_columns: bool = False, prefix: str = "",
) -> DataFrame:
    """lang_pred, score and rejected of every document, after its doc_id or, with ``keep_columns``, all its columns.

    score is the cosine to the nearest centroid, clipped to [0, 1]. Null, empty and
    letterless texts are ``und`` with score 0 and rejected. Texts of ``LEAST_LETTERS`` letters
    or more are rejected where their n-grams are less likely than the limit of every
    language, shorter ones with a score under ``reject_below``; both keep their nearest
    language. Ties go to the first centroid in the order of languages; repeated rows get equal results, an empty
    table an empty one, and texts of any length are read whole. Names of results get ``prefix``; input columns named like the
    results are replaced by them.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: languages x centroids x buckets
    made = [prefix + x for x in ("lang_pred", "score", "rejected")]
    (body_name,) = fresh(docs, "body")
    kept = [c for c in docs.columns if c not in made] if keep_columns else [doc_id]
    own = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text).alias(body_name))
    names = [*kept, *made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(body.as_py()) for body in batch.columns[-1]]
            rejected = [lang == UNDETERMINED or (score < reject_below if margin is None else margin < 0) for lang, score, margin in found]
            values = pa.array([x for x, _, _ in found], pa.string()), pa.array([x for _, x, _ in found], pa.float64()), pa.array(rejected, pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *values], names)

    kinds = ", ".join(f"`{c}` {t}" for c, t in own.dtypes[:-1])
    return own.mapInArrow(run, f"{kinds}, `{made[0]}` string, `{made[1]}` double, `{made[2]}` boolean")


def language_id(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 5, held_out: int = 0, **options) -> DataFrame:
    """Train on the documents outside the held-out fold and predict all documents.

    Returns doc_id, held_out, lang_pred, score, rejected; one row per input row.
    Null ids are neither held out nor learned from; null languages are not learned
    from; without any training document all are ``und``. Repeated rows get equal
    results. Other columns of ``docs`` are not read.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    reject = {k: options.pop(k) for k in ("reject_below",) if k in options}
    model = train(own.where(remainder(F.col("doc_id"), folds) != held_out), **options)
    found = identify(own, model, **reject)
    fold = F.coalesce(remainder(F.col("doc_id"), folds) == held_out, F.lit(False))
    return found.select("doc_id", fold.alias("held_out"), "lang_pred", "score", "rejected")
