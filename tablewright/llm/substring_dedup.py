"""Substring deduplication by relative Lempel-Ziv parsing against an index of the corpus.

Every document is parsed greedily into factors. A factor begins where the next
``window`` words occur earlier in the corpus, its reference being the earliest such place, and goes on as long
as the reference goes on equally. Where it ends, the window at the next word is looked up again,
also where that window begins inside the factor just found: so no factor boundary
hides a repeat. The words of all factors are the duplicate spans.

The index is dealt into blocks. A window's block follows from its anchor, the
smallest hash among the shorter word runs inside the window: equal windows have
equal anchors, neighbouring windows mostly share one, and so a document sends short
runs of windows to the blocks that can hold them, a few bytes each, instead of being read against every
block. Each task first resolves the repeats within its own documents and sends only the earliest of equal
windows: a passage that a third of the corpus shares costs each block one entry per
task. Anchors that stand in very many different windows (a common phrase in ever new
surroundings) are found beforehand and split by the window's largest hash. Windows are compared by 96 bits of hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import Staged, bounded_batches, buckets_for, fresh
from .textcore import buffers, column, gram_hashes, mix64, pack, slices, span_hashes, split_words, starts_of, trim, unpack

_NULL_LAST = np.iinfo(np.int64).max
_MOST_ANCHORS = 20_000  # an anchor with at least this part of all windows is split, so there are no more of them
_SEEN = 16  # occurrences in a slice of texts from which on an anchor may be that frequent
_SLICE = 4 << 20


def _runs(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs; ``same[i]`` tells whether item ``i`` continues item ``i - 1``."""
    starts = np.flatnonzero(~same)
    return starts, np.diff(np.append(starts, len(same)))


def _within(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``start, start + 1, ...`` for every run."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)


def _least_over(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum over every ``n`` neighbours."""
    span = 1
    while span * 2 <= n:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (n - span)], x[n - span :]) if n > span else x


class Windows:
    """The windows of some documents: hash and anchors of each, and those that are the first of their kind here."""

    def __init__(self, batch: pa.RecordBatch, window: int, gram: int):
        order = column(batch, "ord").to_numpy()
        by_id = np.argsort(order, kind="stable")
        batch = batch.take(pa.array(by_id))
        self.order, self.rid = order[by_id], column(batch, "rid").to_numpy()
        data, offsets = buffers(column(batch, "text"))
        words = split_words(data, offsets)
        h = span_hashes(words.data, words.starts, words.ends)
        n = max(len(h) - window + 1, 0)
        self.doc = np.repeat(np.arange(batch.num_rows), words.counts())
        self.place = np.arange(len(h)) - words.first[self.doc]
        self.hashes = gram_hashes(h, window)
        grams = gram_hashes(h, gram)
        self.anchors = _least_over(grams, window - gram + 1) if n else np.empty(0, np.uint64)
        self._grams, self._width = grams, window - gram + 1
        at = np.flatnonzero(self.doc[:n] == self.doc[window - 1 :]) if n else np.empty(0, np.int64)
        self.again = self.source = np.empty(0, np.int64)
        distinct = not (len(self.order) > 1 and (self.order[1:] == self.order[:-1]).any())  # rows with one id have no order among them here
        if distinct and len(at):
            ranked = at[np.argsort(self.hashes[at], kind="stable")]
            starts = starts_of(self.hashes[ranked])
            first = np.repeat(ranked[starts], np.diff(np.append(starts, len(ranked))))
            later = ranked != first
            of = np.argsort(ranked[later])
            self.again, self.source = ranked[later][of], first[later][of]
            new = np.ones(n, dtype=bool)
            new[self.again] = False
            at = at[new[at]]
        self.at = at

    def split(self, heavy: np.ndarray) -> None:
        """Join the largest hash to anchors that are heavy."""
        if len(heavy) and len(self.at):
            spot = np.minimum(np.searchsorted(heavy, self.anchors[self.at]), len(heavy) - 1)
            mine = self.at[heavy[spot] == self.anchors[self.at]]
            largest = ~_least_over(~self._grams, self._width)
            self.anchors[mine] = mix64(self.anchors[mine] + largest[mine] * np.uint64(0x9E3779B97F4A7C15))


def _heavy_here(window: int, gram: int):
    """Anchors that are frequent among the distinct windows of a slice, and how many windows there are (anchor 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in slices(batches, "text", _SLICE):
            w = Windows(batch, window, gram)
            total += len(w.at)
            ranked = np.sort(w.anchors[w.at])
            starts = starts_of(ranked)
            n = np.diff(np.append(starts, len(ranked)))
            many = (n >= _SEEN) & (n * (2 * _MOST_ANCHORS) >= len(ranked))
            if many.any():
                yield pa.RecordBatch.from_arrays([pa.array(ranked[starts[many]].view(np.int64)), pa.array(n[many])], ["anchor", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([total], pa.int64())], ["anchor", "n"])

    return run


def heavy_anchors(source: DataFrame, window: int, gram: int) -> np.ndarray:
    """Sorted anchors with at least one in ``_MOST_ANCHORS`` of all windows."""
    staged = Staged(source.sparkSession, "anchors")
    counts = source.mapInArrow(_heavy_here(window, gram), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    counts = staged.write(counts, "counts")
    total = counts.where("anchor = 0").agg(F.sum("n")).first()[0] or 0
    found = counts.where((F.col("anchor") != 0) & (F.col("n") * _MOST_ANCHORS >= total)).select("anchor").toArrow()
    staged.drop("counts")
    return np.sort(found["anchor"].to_numpy().astype("<i8").view(np.uint64))


def _index_rows(w: Windows, blocks: int) -> pa.RecordBatch | None:
    """One row per block that gets windows, and one that passes on the repeats found here."""
    at, doc = w.at, w.doc
    same = np.concatenate([[False], (np.diff(at) == 1) & (w.anchors[at[1:]] == w.anchors[at[:-1]]) & (np.diff(doc[at]) == 0)]) if len(at) else np.zeros(0, bool)
    s, size = _runs(same)
    first = at[s]
    block = (mix64(w.anchors[first]) % np.uint64(blocks)).astype(np.int64)
    by = np.argsort(block, kind="stable")
    first, size, block = first[by], size[by], block[by]
    begin = starts_of(block)
    cuts = np.append(begin, len(block))
    # repeats in runs whose sources run along
    again, source = w.again, w.source
    same = np.concatenate([[False], (np.diff(again) == 1) & (np.diff(source) == 1) & (np.diff(doc[again]) == 0) & (np.diff(doc[source]) == 0)]) if len(again) else np.zeros(0, bool)
    r, r_size = _runs(same)
    if not len(begin):
        if not len(r):
            return None
        begin, cuts, block = np.zeros(1, np.int64), np.zeros(2, np.int64), np.zeros(1, np.int64)
    n = len(begin)
    carrier = int(mix64(w.rid[:1].view(np.uint64))[0] % np.uint64(n))
    row = np.concatenate([np.repeat(np.arange(n), np.diff(cuts)), np.full(2 * len(r), carrier)])
    pair = row * len(w.order) + np.concatenate([doc[first], doc[again[r]], doc[source[r]]])
    used, index = np.unique(pair, return_inverse=True)
    doc_cuts = np.searchsorted(used // len(w.order), np.arange(n + 1))
    index = index - doc_cuts[row]
    used = used % len(w.order)
    m = len(first)
    places = np.stack([index[:m], w.place[first]], axis=1).astype("<u4")
    repeats = np.stack([index[m : m + len(r)], w.place[again[r]], r_size, index[m + len(r) :], w.place[source[r]]], axis=1).astype("<u4")
    passed = np.zeros(n + 1, np.int64)
    passed[carrier + 1 :] = len(r)
    windows = (w.hashes[_within(first, size)] >> np.uint64(32)).astype("<u4")
    window_cuts = np.concatenate([[0], np.cumsum(size)])[cuts]
    return pa.RecordBatch.from_arrays([
        pa.array(block[begin], pa.int32()), pack(np.stack([w.order[used], w.rid[used]], axis=1).astype("<i8"), doc_cuts), pack(w.anchors[first].astype("<u8"), cuts),
        pack(places, cuts), pack(size.astype("<u4"), cuts), pack(windows, window_cuts), pack(repeats, passed)], _INDEX)


_INDEX = ["block", "docs", "anchors", "places", "lengths", "windows", "repeats"]
_FOUND = "part int, docs binary, factors binary, sources binary"


def _resolve(group: pa.Table, parts: int) -> pa.Table:
    """Runs of windows of one index block that occur earlier, with their references, as one row per part."""
    docs, per_row = unpack(group["docs"], "<i8")
    docs, per_row = docs.reshape(-1, 2), per_row // 2
    base = np.cumsum(per_row) - per_row
    anchors, runs = unpack(group["anchors"], "<u8")
    place = unpack(group["places"], "<u4")[0].astype(np.int64).reshape(-1, 2)
    size = unpack(group["lengths"], "<u4")[0].astype(np.int64)
    windows, _ = unpack(group["windows"], "<u4")
    repeats, passed = unpack(group["repeats"], "<u4")
    repeats = repeats.astype(np.int64).reshape(-1, 5)
    shift = np.repeat(base, passed // 5)
    # document, place, windows; document and place of the reference
    out = [np.stack([repeats[:, 0] + shift, repeats[:, 1], repeats[:, 2], repeats[:, 3] + shift, repeats[:, 4]])]
    if len(windows):
        trim()
        doc = place[:, 0] + np.repeat(base, runs)
        by_order = np.argsort(docs[:, 0], kind="stable")
        rank = np.empty(len(docs), np.int64)
        rank[by_order] = np.cumsum(np.concatenate([[False], np.diff(docs[by_order, 0]) != 0])) if len(docs) else 0
        owner = np.repeat(doc, size)
        spot = _within(place[:, 1], size)
        key = mix64(np.repeat(anchors, size) + windows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        at = (rank[owner].astype(np.uint64) << np.uint64(32)) | spot.astype(np.uint64)
        order = np.argsort(key)
        starts = starts_of(key[order])
        lengths = np.diff(np.append(starts, len(key)))
        first = np.minimum.reduceat(at[order], starts)
        least = np.empty(len(key), dtype=np.uint64)
        least[order] = np.repeat(first, lengths)
        hit = np.flatnonzero(at > least)
        del key, order
        if len(hit):
            source_rank, source_at = (least[hit] >> np.uint64(32)).astype(np.int64), (least[hit] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            of_rank = by_order[np.searchsorted(rank[by_order], np.arange(int(rank.max()) + 1))]
            same = np.concatenate([[False], (np.diff(spot[hit]) == 1) & (np.diff(owner[hit]) == 0) & (np.diff(source_rank) == 0) & (np.diff(source_at) == 1)])
            s, n = _runs(same)
            out.append(np.stack([owner[hit[s]], spot[hit[s]], n, of_rank[source_rank[s]], source_at[s]]))
        del at, least, owner, spot
    found = np.concatenate(out, axis=1)
    trim()
    owner = docs[found[0]]
    part = np.mod(owner[:, 1], parts)
    order = np.argsort(part, kind="stable")
    begin = starts_of(part[order])
    cuts = np.append(begin, len(order)) if len(begin) else np.zeros(1, np.int64)
    sources = np.stack([docs[found[3], 0], found[4]], axis=1)
    return pa.table({
        "part": pa.array(part[order[begin]], pa.int32()), "docs": pack(owner[order].astype("<i8"), cuts), "factors": pack(found[1:3].T[order].astype("<u4"), cuts),
        "sources": pack(sources[order].astype("<i8"), cuts)})


def _spans(first: np.ndarray, n: np.ndarray, window: int, n_words: int) -> np.ndarray:
    """Which words the windows ``first .. first + n - 1`` cover."""
    edge = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + n - 1 + window, -1)
    return np.cumsum(edge[:-1]) > 0


def joined_factors(first: np.ndarray, n: np.ndarray, source: np.ndarray, source_first: np.ndarray) -> tuple[np.ndarray, ...]:
    """One document's runs in order, those joined that blocks cut: neighbours whose references run on."""
    order = np.lexsort((n, first))
    first, n, source, source_first = first[order], n[order], source[order], source_first[order]
    on = np.concatenate([[False], (first[1:] == first[:-1] + n[:-1]) & (source[1:] == source[:-1]) & (source_first[1:] == source_first[:-1] + n[:-1])]) if len(first) else np.zeros(0, bool)
    s = np.flatnonzero(~on)
    return first[s], np.add.reduceat(n, s) if len(s) else n, source[s], source_first[s]


def substring_dedup(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = 20, gram: int = 8, keep_columns: bool = True, digest: bool = False,
    factors: bool = True, block_mb: float = 3.5, prefix: str = "",
) -> DataFrame:
    """Remove words covered by a window of ``window`` words that also starts earlier.

    Earlier means a smaller id, or the same id and an earlier start; all windows are
    judged on the input. Returns doc_id, n_words, n_removed, spans (start and end of
    the removed word ranges), factors (start, words, and the id and start of the reference) and, with ``keep_columns``, the other input columns; in
    the text column the kept words are joined by one space where any word went, and
    the text is unchanged elsewhere. With ``digest`` also kept_sha256, of the kept words joined by one space,
    and then no text. ``factors=False`` leaves spans and factors out.

    Ids are whole numbers. Null texts have no words and stay null; null ids come last in the order and
    count as one id; rows with equal id are not earlier than each other at the same
    start, so repeated rows keep their first occurrence each. Texts shorter than a window lose
    nothing; a very long text is indexed by itself. An empty table gives an empty result. Names of results get ``prefix``; input columns named
    like results are replaced by them. ``block_mb`` is the input per index block:
    more needs more memory per task and sends fewer, longer rows.
    """
    if dict(docs.dtypes)[doc_id] not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{doc_id} orders the documents and must be a whole number")
    bounded_batches(docs.sparkSession)
    names = [prefix + x for x in ("n_words", "n_removed", *(["spans", "factors"] if factors else []), *(["kept_sha256"] if digest else []))]
    other = [c for c in docs.columns if keep_columns and c not in {doc_id, text, *names}]
    rid_name, part_name = fresh(docs, "rid", "part")
    rid = F.xxhash64(F.col(doc_id), F.col(text))
    blocks = parts = buckets_for(docs, text, block_mb, 24)

    order = F.coalesce(F.col(doc_id).cast("long"), F.lit(_NULL_LAST)).alias("ord")
    source = docs.select(order, rid.alias("rid"), F.col(text).alias("text"))
    heavy = heavy_anchors(source, window, gram)  # at most _MOST_ANCHORS

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", _SLICE):
            found = Windows(batch, window, gram)
            found.split(heavy)
            rows = _index_rows(found, blocks)
            if rows is not None:
                yield rows

    indexed = source.mapInArrow(index, "block int, " + ", ".join(f"{c} binary" for c in _INDEX[1:]))
    found = indexed.groupBy("block").applyInArrow(lambda g: _resolve(g, parts), _FOUND)

    own = docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`"), *[F.col(f"`{c}`") for c in other], rid.alias(rid_name))
    kinds = dict(own.dtypes)
    dealt = own.withColumn(part_name, F.pmod(F.col(rid_name), F.lit(parts)).cast("int"))
    kept = [c for c in docs.columns if c in {doc_id, *other} or (c == text and not digest)]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in kept) + f", `{prefix}n_words` bigint, `{prefix}n_removed` bigint"
    if factors:
        schema += f", `{prefix}spans` array<struct<start:bigint,end:bigint>>, `{prefix}factors` array<struct<start:bigint,words:bigint,source:bigint,source_start:bigint>>"
    schema += f", `{prefix}kept_sha256` string" * digest

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        of = unpack(right["docs"], "<i8")[0].reshape(-1, 2)
        runs = unpack(right["factors"], "<u4")[0].astype(np.int64).reshape(-1, 2)
        sources = unpack(right["sources"], "<i8")[0].reshape(-1, 2)
        by = np.argsort(of[:, 1], kind="stable")
        of, runs, sources = of[by], runs[by], sources[by]
        mine = left[rid_name].to_numpy()
        ids = left[doc_id].cast(pa.int64()).fill_null(_NULL_LAST).to_numpy()
        low, high = np.searchsorted(of[:, 1], mine, "left"), np.searchsorted(of[:, 1], mine, "right")
        texts, n_words, n_removed, ranges, parsed, digests = [], [], [], [], [], []
        for k, body in enumerate(left[text]):
            whole = body.as_py()
            words = (whole or "").encode().split()
            n_words.append(len(words))
            pick = np.arange(low[k], high[k])
            # the hash stands for id and text: rows of another id, and what does not fit the text, are not this row's
            pick = pick[(of[pick, 0] == ids[k]) & (runs[pick].sum(axis=1) + window - 1 <= len(words))]
            gone, mine_ranges, mine_factors = 0, [], []
            if len(pick):
                first, n, source_id, source_first = joined_factors(runs[pick, 0], runs[pick, 1], sources[pick, 0], sources[pick, 1])
                covered = _spans(first, n, window, len(words))
                gone = int(covered.sum())
                if factors:
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
                    mine_ranges = [{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)]
                    mine_factors = [
                        {"start": int(a), "words": int(m) + window - 1, "source": None if s == _NULL_LAST else int(s), "source_start": int(b)}
                        for a, m, s, b in zip(first, n, source_id, source_first, strict=True)]
                words = [w for w, c in zip(words, covered, strict=True) if not c]
            n_removed.append(gone)
            ranges.append(mine_ranges)
            parsed.append(mine_factors)
            if digest:
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            else:
                texts.append(b" ".join(words).decode() if gone else whole)
        out = {c: pa.array(texts, pa.string()) if c == text else left[c] for c in kept}
        out |= {prefix + "n_words": pa.array(n_words, pa.int64()), prefix + "n_removed": pa.array(n_removed, pa.int64())}
        if factors:
            factor = pa.struct([(c, pa.int64()) for c in ("start", "words", "source", "source_start")])
            out[prefix + "spans"] = pa.array(ranges, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            out[prefix + "factors"] = pa.array(parsed, pa.list_(factor))
        if digest:
            out[prefix + "kept_sha256"] = pa.array(digests, pa.string())
        trim()
        return pa.table(out)

    return dealt.groupBy(part_name).cogroup(found.groupBy("part")).applyInArrow(apply, schema)
