"""Language-model scoring by online logistic context mixing.

A text is coded as bits, word after word: a frequent word is a path in a Huffman
tree of words; any other word is the path of an escape and then its bytes, each a path in a
Huffman tree of bytes, up to a terminator. The end of the text is a symbol of the word tree.
Every bit is predicted from several hashed contexts, which cross words: the word before, and
each of the last two very frequent words; inside a spelled word the beginning of the word, its last
three bytes with the last very frequent word, and its last four bytes (both into the word before). The predictions are mixed in the logistic domain
with weights that a gate selects (kind of bit, how sure the longer contexts are), and refined by an
adaptive map of the mixed probability. Weights and map start from a fit to all training documents and are
updated, document by document, while the text is scored.

What the model gathers: counts of every hashed context's bits over all training documents (a
fixed number of slots, a parameter), and the count of every distinct word of them, however many there
are. The word counts back the spelling up: spelled words meet their exact counts in
hash buckets, where an absolute discount shares the escape's probability between counted words and
the spelling. A training document's own occurrence is left out of both.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import remainder, sum_vectors
from .staging import Staged, buckets_for, input_gigabytes
from .substring_dedup import _within
from .textcore import _SPACE, _powers, buffers, column, mix64, pack, slices, span_hashes, split_words, starts_of, trim, unpack

TABLES = 3
_CHUNK = 1 << 16
_PAIRS = 1 << 20
_AT_ONCE = 1 << 13  # units whose inputs are gathered at once
_STEP = 512  # units between updates in the fit
_ESCAPE, _END = 0, 1
_TERMINATOR = 256
_GATES, _BINS, _LEAD = 32, 33, 4
_VERY_FREQUENT = 64
_PREFIX = 19
_LEAST_SEEN = 4  # rarer words are spelled, and backed by their counts
_PRIOR, _STEPS, _MOST = 0.15, 10, 12.0
_END_HASH, _BEGIN_HASH = 0x1B873593CC9E2D51, 0x52DCE729DA3ED6A5
# words after which the weights are brought up to date, then every _EDGES[-1] words
_EDGES = np.array([0, 16, 32, 64, 128, 256])
_RATE, _INERTIA, _MAP_INERTIA = 0.3, 10.0, 32.0


class Laid(np.ndarray):
    """An array that a worker unpickles into memory of its own: large ones get huge pages there, which random reads need."""

    def __reduce_ex__(self, protocol):
        return _laid, (self.tobytes(), self.dtype.str, self.shape)


def _laid(data: bytes, dtype: str, shape: tuple[int, ...]) -> np.ndarray:
    return np.frombuffer(data, dtype=dtype).reshape(shape).copy()


class Code(NamedTuple):
    """A prefix code: the paths of all symbols, one after another, each step twice its tree node and its bit."""

    path: np.ndarray
    first: np.ndarray  # of each symbol; one more at the end


def huffman(weights: np.ndarray, first_node: int = 0) -> Code:
    """The Huffman code of two or more symbols; ties go to smaller symbols and older nodes."""
    n = len(weights)
    up, side = np.full(2 * n - 1, -1, dtype=np.int64), np.zeros(2 * n - 1, dtype=np.uint8)
    heap = [(int(w), k) for k, w in enumerate(weights)]
    heapq.heapify(heap)
    for node in range(n, 2 * n - 1):
        for bit in (0, 1):
            w, child = heapq.heappop(heap)
            up[child], side[child] = node, bit
            total = w if not bit else total + w  # noqa: F821
        heapq.heappush(heap, (total, node))
    at = np.arange(n)
    levels = []  # from the leaves up
    while (up[at] >= 0).any():
        levels.append((up[at], side[at]))
        at = np.where(up[at] >= 0, up[at], at)
    depth = sum((parents >= 0).astype(np.int64) for parents, _ in levels)
    first = np.concatenate([[0], np.cumsum(depth)])
    nodes, bits = np.zeros(first[-1], dtype=np.uint32), np.zeros(first[-1], dtype=np.uint8)
    for k, (parents, sides) in enumerate(levels):
        deep = np.flatnonzero(parents >= 0)
        spot = first[deep] + depth[deep] - 1 - k
        nodes[spot], bits[spot] = parents[deep] - n + first_node, sides[deep]
    return Code(nodes * np.uint32(2) + bits, first)


class Lexicon(NamedTuple):
    """The words with a symbol of their own, by hash, and the joint code of words (escape and end first) and bytes."""

    hashes: np.ndarray
    counts: np.ndarray
    very_frequent: np.ndarray
    code: Code
    near: np.ndarray  # first word of each prefix of hashes; one more at the end

    @staticmethod
    def build(hashes: np.ndarray, counts: np.ndarray, escapes: int, ends: int, by_byte: np.ndarray, words: int) -> Lexicon:
        """From the frequent words, the counts of all escapes, ends, bytes and words."""
        order = np.argsort(hashes)
        hashes, counts = hashes[order], counts[order]
        of_words = huffman(np.concatenate([[escapes + 1, ends + 1], counts]))
        of_bytes = huffman(np.concatenate([by_byte + 1, [words + 1]]), first_node=len(counts) + 1)
        first = np.concatenate([of_words.first, of_words.first[-1] + of_bytes.first[1:]])
        code = Code(np.concatenate([of_words.path, of_bytes.path]), first)
        very = np.zeros(len(counts), dtype=bool)
        very[np.lexsort((hashes, -counts))[:_VERY_FREQUENT]] = True
        near = np.searchsorted(hashes >> np.uint64(64 - _PREFIX), np.arange((1 << _PREFIX) + 1, dtype=np.uint64)).astype(np.int32)
        return Lexicon(hashes, counts, very, code, near)

    @property
    def byte_base(self) -> int:
        return len(self.counts) + 2

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash among the words, or -1."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        prefix = (h >> np.uint64(64 - _PREFIX)).astype(np.int64)
        at = self.near.take(prefix, mode="clip").astype(np.int64)
        same = self.hashes.take(at, mode="clip") == h
        found = np.where(same, at, -1)
        left = np.flatnonzero(~same & (self.near.take(prefix + 1, mode="clip") - at > 1))
        k = 0
        while len(left):  # a few words have one prefix
            k += 1
            near = at[left] + k
            same = self.hashes.take(near, mode="clip") == h[left]
            found[left[same]] = near[same]
            left = left[~same & (near + 1 < self.near.take(prefix[left] + 1, mode="clip"))]
        return found


class Tokens(NamedTuple):
    """All words and ends of some documents, in order."""

    hashes: np.ndarray
    doc: np.ndarray
    at: np.ndarray  # place in the document
    starts: np.ndarray  # bytes; empty for ends
    ends: np.ndarray
    data: np.ndarray
    is_word: np.ndarray


def tokens_of(texts: pa.Array) -> Tokens:
    data, offsets = buffers(texts)
    words = split_words(data, offsets, lower=True)
    h = span_hashes(words.data, words.starts, words.ends, 1 << 15)
    counts = words.counts()
    n_docs, n = len(counts), len(h) + len(counts)
    first = words.first[:-1] + np.arange(n_docs)
    doc = np.repeat(np.arange(n_docs), counts + 1)
    place = np.arange(len(h)) + np.repeat(np.arange(n_docs), counts)
    is_word = np.zeros(n, dtype=bool)
    is_word[place] = True
    hashes = np.full(n, _END_HASH, dtype=np.uint64)
    starts = ends = np.zeros(n, dtype=np.int64)
    starts, ends = starts.copy(), ends.copy()
    hashes[place], starts[place], ends[place] = h, words.starts, words.ends
    return Tokens(hashes, doc, np.arange(n) - np.repeat(first, counts + 1), starts, ends, words.data, is_word)


class Units(NamedTuple):
    """Coded symbols in order: one for each token, and those of a spelled word after its escape."""

    symbols: np.ndarray
    contexts: np.ndarray  # table x unit
    token: np.ndarray
    spelled: np.ndarray


def _salted(k: int, *values: np.ndarray) -> np.ndarray:
    total = np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
    for i, v in enumerate(values):
        total = (total + v) * np.uint64((0xC2B2AE3D27D4EB4F + 2 * i) % 2**64)
    return (total >> np.uint64(32)).astype(np.uint32)


def units_of(t: Tokens, lexicon: Lexicon) -> tuple[Units, np.ndarray]:
    """The units of tokens, and each token's place in the lexicon (-1: spelled or an end)."""
    n = len(t.hashes)
    known = np.where(t.is_word, lexicon.lookup(t.hashes), -1)
    symbol = np.where(t.is_word, _ESCAPE, _END)
    symbol[known >= 0] = known[known >= 0] + 2
    one = np.full(n, _BEGIN_HASH, dtype=np.uint64)
    has = np.flatnonzero(t.at >= 1)
    one[has] = t.hashes[has - 1]
    # the last two very frequent words before each token of a document
    very = np.flatnonzero(lexicon.very_frequent[known] & (known >= 0)) if len(lexicon.counts) else np.empty(0, np.int64)
    is_very = np.zeros(n, dtype=np.int64)
    is_very[very] = 1
    spot = np.cumsum(is_very) - is_very - 1
    frequent = []
    for back in (0, 1):
        source = very[np.maximum(spot - back, 0)] if len(very) else np.zeros(n, np.int64)
        ok = (spot >= back) & (t.doc[source] == t.doc) & (len(very) > 0)
        frequent.append(np.where(ok, known[source] + 1, 0).astype(np.uint64))

    cold = np.flatnonzero(t.is_word & (known < 0))
    size = (t.ends - t.starts)[cold]
    count = np.ones(n, dtype=np.int64)
    count[cold] += size + 1
    first = np.cumsum(count) - count
    total = int(count.sum())
    symbols, token, spelled = np.empty(total, np.int64), np.repeat(np.arange(n), count), np.ones(total, dtype=bool)
    contexts = np.empty((TABLES, total), dtype=np.uint32)
    spelled[first] = False
    symbols[first] = symbol
    for k, c in enumerate(((one,), (frequent[0],), (frequent[1],))):
        contexts[k, first] = _salted(k + 1, *c)
    if len(cold):
        # each spelled word behind the end of the word before it and a space
        begin = np.concatenate([[0], np.cumsum(size + 1 + _LEAD)])
        text = np.zeros(begin[-1], dtype=np.uint8)
        text[_within(begin[:-1] + _LEAD, size)] = t.data[_within(t.starts[cold], size)]
        text[begin[:-1] + _LEAD - 1] = 0x20
        had = t.at[cold] > 0
        for back in (1, 2, 3):
            source = t.ends[np.maximum(cold - 1, 0)] - back
            ok = had & (source >= t.starts[np.maximum(cold - 1, 0)])
            text[begin[:-1][ok] + _LEAD - 1 - back] = t.data[source[ok]]
        q = _within(begin[:-1] + _LEAD, size + 1)
        mine = _within(first[cold] + 1, size + 1)
        byte = text[np.minimum(q, len(text) - 1)].astype(np.int64)
        ends = np.cumsum(size + 1) - 1
        byte[ends] = _TERMINATOR
        symbols[mine] = lexicon.byte_base + byte
        b = [text[q - back].astype(np.uint64) for back in (1, 2, 3, 4)]
        three = b[0] + (b[1] << np.uint64(8)) + (b[2] << np.uint64(16))
        four = three + (b[3] << np.uint64(24))
        up, down = _powers(len(text) + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[: len(text)], dtype=np.uint64)])
        start = np.repeat(begin[:-1] + _LEAD, size + 1)
        prefix = (sums[q] - sums[start]) * down[start] + (q - start).astype(np.uint64)
        near = np.repeat(frequent[0][cold], size + 1)
        for k, c in enumerate(((prefix,), (three, near), (four,))):
            contexts[k, mine] = _salted(k + 11, *c)
    return Units(symbols, contexts, token, spelled), known


def _expand(symbols: np.ndarray, code: Code) -> tuple[np.ndarray, ...]:
    """Per bit of the symbols: its symbol's place, a mark of its node, and its value; then where each symbol's bits begin, and their number."""
    low = code.first.take(symbols)
    size = code.first.take(symbols + 1) - low
    begin = np.zeros(len(size) + 1, dtype=np.int64)
    np.cumsum(size, out=begin[1:])
    of = np.repeat(np.arange(len(size)), size)
    at = (low - begin[:-1]).take(of, mode="clip")
    at += np.arange(len(at))
    path = code.path.take(at, mode="clip")
    bit = path & np.uint32(1)
    path >>= np.uint32(1)
    path *= np.uint32(0x9E3779B1 * 0x85EBCA6B % 2**32)
    return of, path, bit, begin


def _slots(context: np.ndarray, of: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    mixed = (context * np.uint32(0x85EBCA6B)).take(of, mode="clip")
    mixed += node
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    mixed >>= np.uint32(32 - bits)
    return mixed


class Tally:
    """How often each context slot saw a 0 and a 1 (table x (2 * slots), the ones last).

    Equal pairs of a context and a symbol are counted first, so that each pair's bits are added once.
    """

    def __init__(self, lexicon: Lexicon, bits: int):
        self.lexicon, self.bits = lexicon, bits
        self.seen = np.zeros((TABLES, 2 << bits), dtype=np.uint32)
        self.held: list[np.ndarray] = []

    def add(self, texts: pa.Array) -> None:
        units, _ = units_of(tokens_of(texts), self.lexicon)
        self.held.append((units.contexts.astype(np.uint64) << np.uint64(32)) | units.symbols.astype(np.uint64))
        if sum(pairs.shape[1] for pairs in self.held) >= _PAIRS:
            self.flush()

    def flush(self) -> None:
        for t in range(TABLES if self.held else 0):
            pairs = np.concatenate([p[t] for p in self.held])
            pairs.sort()
            first = starts_of(pairs)
            times = np.diff(np.append(first, len(pairs))).astype(np.uint32)
            pairs = pairs[first]
            for low in range(0, len(pairs), 1 << 13):
                some = pairs[low : low + (1 << 13)]
                of, node, bit, _ = _expand((some & np.uint64(2**32 - 1)).astype(np.int64), self.lexicon.code)
                at = _slots((some >> np.uint64(32)).astype(np.uint32), of, node, self.bits)
                at += bit << np.uint32(self.bits)
                np.add.at(self.seen[t], at.astype(np.int64), times[low : low + (1 << 13)].take(of, mode="clip"))
        self.held.clear()


def stretched(seen: np.ndarray, bits: int) -> np.ndarray:
    """log odds of each slot in fixed point, as it is, less one 0, and less one 1 (table x slot x 3)."""
    out = np.empty((len(seen), 1 << bits, 3), dtype=np.int8)
    for t, counts in enumerate(seen):
        for low in range(0, 1 << bits, 1 << 16):
            some = slice(low, min(low + (1 << 16), 1 << bits))
            n0, n1 = counts[: 1 << bits][some].astype(np.float64), counts[1 << bits :][some].astype(np.float64)
            for k, (a, b) in enumerate(((n0, n1), (np.maximum(n0 - 1, 0), n1), (n0, np.maximum(n1 - 1, 0)))):
                out[t, some, k] = np.rint(np.clip(np.log((b + _PRIOR) / (a + _PRIOR)), -_MOST, _MOST) * _STEPS)
    return out


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Mixer(NamedTuple):
    """Where every document starts: weights by gate and the refinement map."""

    weights: np.ndarray  # gate x table
    refined: np.ndarray  # probability by kind and mixed probability

    @staticmethod
    def blank() -> Mixer:
        centre = _squash(np.linspace(-8, 8, _BINS))
        return Mixer(np.full((_GATES, TABLES), 0.4), np.concatenate([centre, centre]))

    @staticmethod
    def of(sums: np.ndarray) -> Mixer:
        """From the sums of all runs of the fit."""
        start = Mixer.blank()
        weighted, evidence, counts = np.split(sums, [_GATES * TABLES, _GATES * (TABLES + 1)])
        counts = counts.reshape(2, -1)
        weights = np.where(evidence > 0, weighted.reshape(TABLES, -1) / np.where(evidence > 0, evidence, 1), start.weights.T)
        return Mixer(np.ascontiguousarray(weights.T), (counts[1] + 16 * start.refined) / (counts.sum(axis=0) + 16))


def _some(values: np.ndarray, pick: np.ndarray | slice) -> np.ndarray:
    return values[pick] if isinstance(pick, slice) else values.take(pick)


def _inputs(units: Units, code: Code, pick: np.ndarray | slice, odds: np.ndarray, doc: np.ndarray | int, learned: np.ndarray | bool):
    """Per bit: stretched predictions in steps, its document and gate as one row number, and value; then where each unit's bits begin, and their number."""
    of, node, bit, begin = _expand(_some(units.symbols, pick), code)
    variant = bit + np.uint32(1)  # without a learned text's own bit
    if learned is not True:
        variant *= learned.astype(np.uint32).take(of, mode="clip")
    width = odds.shape[1].bit_length() - 1
    x = np.empty((TABLES, len(node)), dtype=np.float32)
    gate = np.zeros(len(node), dtype=np.uint8)
    for t, weight in enumerate((4, 0, 1)):
        at = _slots(_some(units.contexts[t], pick), of, node, width)
        at *= np.uint32(3)
        at += variant
        found = odds[t].reshape(-1).take(at.astype(np.int64), mode="clip")
        x[t] = found
        if weight:
            sure = np.abs(found)
            gate += ((sure > 0).view(np.uint8) + (sure > 15).view(np.uint8) + (sure > 30).view(np.uint8)) * np.uint8(weight)
    row = (doc * _GATES + _some(units.spelled, pick) * 16).take(of, mode="clip")
    row += gate
    return x, row, bit.astype(np.float32), begin


def _mixed(x: np.ndarray, weights: np.ndarray, row: np.ndarray) -> np.ndarray:
    weights = (weights / _STEPS).astype(np.float32)
    total = weights[0].take(row, mode="clip")
    total *= x[0]
    for t in range(1, TABLES):
        part = weights[t].take(row, mode="clip")
        part *= x[t]
        total += part
    np.minimum(total, np.float32(_MOST), out=total)
    return np.maximum(total, np.float32(-_MOST), out=total)


def _cells(row: np.ndarray, mixed: np.ndarray) -> np.ndarray:
    """Cell of the refinement maps: document and kind of bit, then mixed probability."""
    near = np.minimum(mixed, np.float32(8))
    np.maximum(near, np.float32(-8), out=near)
    near += np.float32(8)
    near *= np.float32(2)
    cell = row >> 4
    cell *= _BINS
    cell += np.rint(near, out=near).astype(np.int64)
    return cell


def _update(weights: np.ndarray, seen: np.ndarray, x: np.ndarray, row: np.ndarray, p: np.ndarray, bit: np.ndarray) -> None:
    """One step on ``weights`` (table x row); ``seen`` holds the uncertainty so far, which shortens the steps."""
    n = weights.shape[1]
    seen += np.bincount(row, p * (1 - p), n)
    error, step = bit - p, _RATE / _STEPS / (_INERTIA + seen)
    for t in range(TABLES):
        weights[t] += step * np.bincount(row, error * x[t], n)


def _hits(cell: np.ndarray, bit: np.ndarray, cells: int) -> np.ndarray:
    """Zeros and ones of each cell."""
    return np.bincount(cell + bit.astype(np.int64) * cells, minlength=2 * cells).reshape(2, cells)


def _in_steps(texts: pa.Array, lexicon: Lexicon) -> Iterator[Units]:
    """The units of texts, some texts at a time, in whole steps of the fit; the last may be shorter."""
    left = None
    for batch in slices(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), "text", 1 << 17):
        units, _ = units_of(tokens_of(column(batch, "text")), lexicon)
        if left is not None:
            units = Units(*(np.concatenate(pair, axis=-1) for pair in zip(left, units, strict=True)))
        whole = len(units.symbols) // _STEP * _STEP
        yield Units(*(part[..., :whole] for part in units))
        left = Units(*(part[..., whole:] for part in units))
    if left is not None:
        yield left


def fit_run(texts: pa.Array, lexicon: Lexicon, odds: np.ndarray) -> np.ndarray:
    """Weights and map learned online over a run of training documents in the given order, their own occurrences left out.

    As sums that add up over runs: weights times the evidence for them, evidence by gate, and the map's counts of zeros and ones.
    """
    start = Mixer.blank()
    weights, seen, evidence = np.ascontiguousarray(start.weights.T), np.zeros(_GATES), np.zeros(_GATES)
    counts = np.zeros((2, 2 * _BINS))
    for units in _in_steps(texts, lexicon):
        for low in range(0, len(units.symbols), _AT_ONCE):
            all_x, gates, all_bits, begin = _inputs(units, lexicon.code, slice(low, low + _AT_ONCE), odds, 0, True)
            every = np.empty(len(all_bits), dtype=np.float32)
            for k in range(0, len(begin) - 1, _STEP):
                some = slice(begin[k], begin[min(k + _STEP, len(begin) - 1)])
                x, gate, bit = all_x[:, some], gates[some], all_bits[some]
                every[some] = mixed = _mixed(x, weights, gate)
                evidence -= seen
                _update(weights, seen, x, gate, _squash(mixed), bit)
                evidence += seen
                seen *= 0.999  # later documents keep a say
            counts += _hits(_cells(gates, every), all_bits, 2 * _BINS)
    return np.concatenate([(weights * evidence).reshape(-1), evidence, counts.reshape(-1)])


def runs(batches: Iterator[pa.RecordBatch], documents: int) -> Iterator[pa.Array]:
    """Texts of successive rows in the order of their draw, at most ``documents`` and about 4 MB at once."""

    def ordered(held: list[pa.RecordBatch]) -> pa.Array:
        return pa.Table.from_batches(held).sort_by([("draw", "ascending"), ("rid", "ascending")])["text"].combine_chunks()

    held, rows, size = [], 0, 0
    for batch in slices(batches, "text", 1 << 20):
        while batch.num_rows:
            part = batch.slice(0, documents - rows)
            batch = batch.slice(part.num_rows)
            _, offsets = buffers(column(part, "text"))
            held, rows, size = [*held, part], rows + part.num_rows, size + int(offsets[-1] - offsets[0])
            if rows >= documents or size >= 4 << 20:
                yield ordered(held)
                held, rows, size = [], 0, 0
    if held:
        yield ordered(held)


def steps(at: np.ndarray) -> np.ndarray:
    """Which update step a word's place in its document belongs to."""
    return np.searchsorted(_EDGES, np.minimum(at, _EDGES[-1]), side="right") - 1 + np.maximum(at - _EDGES[-1], 0) // _EDGES[-1]


def score_units(t: Tokens, units: Units, lexicon: Lexicon, odds: np.ndarray, mixer: Mixer, learned: np.ndarray) -> np.ndarray:
    """log10 probability of each unit. Each document starts from ``mixer`` and updates weights and map as it goes.

    ``learned`` tells per document whether it was learned from. Documents share steps, never state.
    """
    n_docs = len(learned)
    weights = np.ascontiguousarray(np.tile(mixer.weights, (n_docs, 1)).T)
    curvature = np.zeros(n_docs * _GATES)
    seen = np.zeros((2, n_docs * 2 * _BINS))
    start = np.tile(mixer.refined, n_docs) * _MAP_INERTIA
    doc = t.doc[units.token]
    step = steps(t.at)[units.token]
    order = np.argsort(step.astype(np.int32), kind="stable")
    cuts = np.append(starts_of(step[order]), len(order))
    out = np.empty(len(order))
    k = 0
    while k < len(cuts) - 1:
        # as many steps as have their inputs gathered at once, or one
        last = max(k + 1, int(np.searchsorted(cuts, cuts[k] + _AT_ONCE, side="right")) - 1)
        pick = order[cuts[k] : cuts[last]]
        mine = doc.take(pick)
        all_x, rows, bits, begin = _inputs(units, lexicon.code, pick, odds, mine, learned.take(mine))
        final = np.empty(len(bits), dtype=np.float32)
        for low, high in zip(begin[cuts[k:last] - cuts[k]], begin[cuts[k + 1 : last + 1] - cuts[k]], strict=True):
            x, row, bit = all_x[:, low:high], rows[low:high], bits[low:high]
            mixed = _mixed(x, weights, row)
            p = _squash(mixed)
            cell = _cells(row, mixed)
            refined = ((seen[1] + start) / (seen[0] + seen[1] + _MAP_INERTIA)).astype(np.float32)
            final[low:high] = refined.take(cell, mode="clip")
            final[low:high] += p
            _update(weights, curvature, x, row, p, bit)
            seen += _hits(cell, bit, seen.shape[1])
        final /= 2
        np.clip(final, 1e-6, 1 - 1e-6, out=final)
        final -= 1 - bits  # of the bit that came, up to its sign
        out[pick] = np.add.reduceat(np.log(np.abs(final, out=final)).astype(np.float64), begin[:-1]) / math.log(10)
        k = last
    return out


class Backing(NamedTuple):
    """How counted words and the spelling share the probability of an escape."""

    discount: float
    cold_tokens: int
    cold_words: int

    def log10(self, counts: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        """log10 probability of escaped words from their counts and the log10 probability of their spelling."""
        if not self.cold_tokens:
            return spelled
        share = self.discount * self.cold_words / self.cold_tokens
        return np.log10(np.maximum(counts - self.discount, 0) / self.cold_tokens + share * 10.0 ** np.maximum(spelled, -290.0))


def _words_sent(buckets: int):
    """Distinct words of each slice with their counts in learned documents, and one histogram of learned words' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            data, offsets = buffers(column(batch, "text"))
            words = split_words(data, offsets, lower=True)
            h = span_hashes(words.data, words.starts, words.ends, 1 << 15)
            if not len(h):
                continue
            learned = column(batch, "learned").to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(batch.num_rows), words.counts())
            inside = words.data if learned.all() else words.data[np.repeat(learned, np.diff(offsets))]
            once = np.sort(h[learned[doc]])
            first = starts_of(once)
            times = np.diff(np.append(first, len(once)))
            once = once[first]
            h.sort()
            h = h[starts_of(h)]
            counts = np.zeros(len(h), np.int64)
            counts[np.searchsorted(h, once)] = times
            bucket = (mix64(h) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            begin = starts_of(bucket[by])
            cuts = np.append(begin, len(by))
            n = len(begin)
            histogram = np.where(_SPACE, 0, np.bincount(inside, minlength=256)).astype("<i8")
            with_bytes = np.zeros(n + 1, np.int64)
            with_bytes[int(h[0] % np.uint64(n)) + 1 :] = 256
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[by[begin]], pa.int32()), pack(h[by].astype("<u8"), cuts), pack(counts[by].astype("<u4"), cuts), pack(histogram, with_bytes)],
                ["bucket", "hashes", "counts", "bytes"])

    return run


def _words_merged(group: pa.Table) -> pa.Table:
    """One row per bucket: its distinct words by hash with their training counts, and the bytes' histogram."""
    h, _ = unpack(group["hashes"], "<u8")
    counts, _ = unpack(group["counts"], "<u4")
    by_byte, _ = unpack(group["bytes"], "<i8")
    order = np.argsort(h)
    first = starts_of(h[order])
    total = np.add.reduceat(counts[order].astype(np.int64), first)
    return pa.table({
        "bucket": group["bucket"][:1], "hashes": [h[order[first]].tobytes()], "counts": [total.astype("<i8").tobytes()],
        "bytes": [by_byte.reshape(-1, 256).sum(axis=0).astype("<i8").tobytes()]})


_SENT = "bucket int, rids binary, learned binary, hashes binary, entries binary, docs binary, spelled binary, own_rids binary, own binary"
_KINDS = [pa.int32(), *[pa.binary()] * 8]


def _entries(rid: np.ndarray, learned: np.ndarray, h: np.ndarray, doc: np.ndarray, spelled: np.ndarray, own: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Spelled words as rows per bucket: the documents they occur in, and each occurrence; the documents' own sums ride with one row."""
    bucket = (mix64(h) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort((bucket.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))  # by bucket; equal words meet
    bucket, h, doc, spelled = bucket[order], h[order], doc[order], spelled[order]
    begin = starts_of(bucket)
    carrier = int(mix64(rid[:1].view(np.uint64))[0] % np.uint64(buckets))
    if not len(begin):  # no spelled word: the sums alone
        begin, bucket = np.zeros(1, np.int64), np.array([carrier])
    cuts = np.append(begin, len(h))
    n = len(begin)
    row = np.repeat(np.arange(n), np.diff(cuts))
    # the documents of each row, and each occurrence's place among them
    pair = row * len(rid) + doc
    used, index = np.unique(pair, return_inverse=True)
    doc_cuts = np.searchsorted(used // len(rid), np.arange(n + 1))
    place = index - doc_cuts[row]
    new = np.zeros(len(h), dtype=bool)
    new[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    word = np.flatnonzero(~new)
    word_cuts = np.searchsorted(word, cuts)
    own_cuts = np.zeros(n + 1, np.int64)
    own_cuts[carrier % n + 1 :] = len(rid)
    of = used % len(rid)
    return pa.RecordBatch.from_arrays([
        pa.array(bucket[begin], pa.int32()), pack(rid[of].astype("<i8"), doc_cuts), pack(learned[of].astype("u1"), doc_cuts), pack(h[word].astype("<u8"), word_cuts),
        pack(np.diff(np.append(word, len(h))).astype("<u4"), word_cuts), pack(place.astype("<u4"), cuts), pack(spelled.astype("<f8"), cuts),
        pack(rid.astype("<i8"), own_cuts), pack(np.ascontiguousarray(own.T).astype("<f8"), own_cuts)],
        [f.split()[0] for f in _SENT.split(", ")])


def _scored(buckets: int, known, tables, start, divisor: float):
    """Score documents; send what their spelled words need to meet their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, odds, mixer = known.value, tables.value, start.value
        with np.errstate(divide="ignore"):
            base_of = np.log10((lexicon.counts + 0.5) / divisor)
        for batch in slices(batches, "text", 4 << 20):
            held: list[list[np.ndarray]] = [[np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0)]]
            own = np.zeros((5, batch.num_rows))  # documents, tokens, known tokens, base, score
            own[0] = 1
            low = 0
            for part in slices(iter([batch]), "text", 1 << 17):
                t = tokens_of(column(part, "text"))
                units, place = units_of(t, lexicon)
                learned = column(part, "learned").to_numpy(zero_copy_only=False)
                lp = score_units(t, units, lexicon, odds, mixer, learned)
                n = part.num_rows
                mine = own[:, low : low + n]
                mine[1] += np.bincount(t.doc, minlength=n)
                hot = np.flatnonzero(place >= 0)
                mine[2] += np.bincount(t.doc[hot], minlength=n)
                mine[3] += np.bincount(t.doc[hot], base_of[place[hot]], n)
                plain = ~units.spelled
                mine[4] += np.bincount(t.doc[units.token[plain]], lp[plain], n)
                cold = np.flatnonzero(t.is_word & (place < 0))
                of_word = np.bincount(units.token[~plain], lp[~plain], len(t.doc))
                for to, x in zip(held, (t.hashes[cold], t.doc[cold] + low, of_word[cold]), strict=True):
                    to.append(x)
                low += n
            rid = column(batch, "rid").to_numpy()
            yield _entries(rid, column(batch, "learned").to_numpy(zero_copy_only=False), *(np.concatenate(x) for x in held), own, buckets)
            trim()

    return run


def _sums_rows(rid: np.ndarray, sums: np.ndarray, parts: int) -> pa.Table:
    """Sums per document as one row per part."""
    part = (mix64(rid.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    begin = starts_of(part[order])
    cuts = np.append(begin, len(order)) if len(begin) else np.zeros(1, np.int64)
    return pa.table({
        "part": pa.array(part[order[begin]], pa.int32()), "rids": pack(rid[order].astype("<i8"), cuts), "sums": pack(np.ascontiguousarray(sums.T[order]).astype("<f8"), cuts)})


def _added(rid: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    one, at = np.unique(rid, return_inverse=True)
    return one, np.stack([np.bincount(at, s, len(one)) for s in sums]) if len(one) else sums


def _met(parts: int, divisor: float, backing: Backing):
    """Sums per document over the words of one bucket, whose exact counts are on the left."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        hashes, _ = unpack(left["hashes"], "<u8")
        counts, _ = unpack(left["counts"], "<i8")
        rids, per_row = unpack(right["rids"], "<i8")
        learned, _ = unpack(right["learned"], "u1")
        h, _ = unpack(right["hashes"], "<u8")
        entries, _ = unpack(right["entries"], "<u4")
        docs, in_row = unpack(right["docs"], "<u4")
        spelled, _ = unpack(right["spelled"], "<f8")
        own_rids, _ = unpack(right["own_rids"], "<i8")
        own, _ = unpack(right["own"], "<f8")
        doc = docs.astype(np.int64) + np.repeat(np.cumsum(per_row) - per_row, in_row)
        sums = np.zeros((5, len(rids)))
        if len(h):
            count = np.repeat(counts[np.searchsorted(hashes, h)], entries)  # every word was counted before
            sums[2] = np.bincount(doc, count > 0, len(rids))
            sums[3] = np.bincount(doc, np.log10((count + 0.5) / divisor), len(rids))
            sums[4] = np.bincount(doc, backing.log10(count - learned[doc], spelled), len(rids))
        rids, sums = np.concatenate([rids, own_rids]), np.concatenate([sums, own.reshape(-1, 5).T], axis=1)
        out = _sums_rows(*_added(rids, sums), parts)
        trim()
        return out

    return run


def lm_score(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", folds: int = 5, held_out: int = 1, vocabulary: int = 1 << 17, slot_bits: int = 22, fit_documents: int = 1000,
) -> DataFrame:
    """Unigram and model log10 probabilities of every whole text, learned outside the held-out fold.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    bits_per_byte; one row per input row. Tokens are the words, A-Z lower-cased, and one end.
    ``base_score`` is the smoothed unigram score, ``score`` the model's. A document that was learned
    from is scored without its own occurrences: each of its bits and words is taken out
    of the counts once.

    Null and empty texts are an end alone. Null ids are neither held out nor learned from.
    Repeated rows count as often as they occur and get equal scores; words with equal counts
    enter the vocabulary by hash. Texts of any length are scored whole. Without any training
    document every bit starts at probability one half. An empty table gives an empty result. Other columns of
    ``docs`` are not read. ``vocabulary`` words have symbols of their own, each table
    of contexts has ``2 ** slot_bits`` slots, and the first weights are fitted to all training documents: online in
    runs of at most ``fit_documents`` successive rows of a partition, whose weights are averaged by their evidence and whose map counts are
    added. So how rows lie in partitions moves scores a little, unless one run holds them. All counts are of all training documents.
    """
    spark = docs.sparkSession
    staged = Staged(spark, "lm")
    buckets = buckets_for(docs, text, 40.0, 12)
    rid = F.xxhash64(F.col(doc_id), F.col(text)).alias("rid")
    learned = F.coalesce(remainder(F.col(doc_id), folds) != held_out, F.lit(False))
    own = docs.select(rid, learned.alias("learned"), F.col(text).alias("text"))

    sent = own.select("learned", "text").mapInArrow(_words_sent(buckets), "bucket int, hashes binary, counts binary, bytes binary")
    words = staged.write(sent.groupBy("bucket").applyInArrow(_words_merged, "bucket int, hashes binary, counts binary, bytes binary"), "words")
    ends = docs.where(learned).count()

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(260, "<i8")
        for batch in batches:
            counts, _ = unpack(column(batch, "counts"), "<i8")
            by_byte, _ = unpack(column(batch, "bytes"), "<i8")
            out += np.concatenate([[counts.sum(), (counts > 0).sum(), (counts == 1).sum(), (counts == 2).sum()], by_byte.reshape(-1, 256).sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["v"])

    total = sum_vectors(words.mapInArrow(totals, "v binary"), "v", "<i8", summed=True)
    total = np.zeros(260, np.int64) if total is None else total
    n_words, n_distinct, once, twice = map(int, total[:4])
    tokens, distinct = n_words + ends, n_distinct + (ends > 0)
    divisor = tokens + 0.5 * (distinct + 1)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, counts = unpack(column(batch, "hashes"), "<i8")[0], unpack(column(batch, "counts"), "<i8")[0]
            top = np.lexsort((h, -counts))[:vocabulary]
            top = top[counts[top] >= _LEAST_SEEN]
            yield pa.RecordBatch.from_arrays([pa.array(h[top]), pa.array(counts[top])], ["h", "n"])

    rows = words.mapInArrow(candidates, "h long, n long").orderBy(F.desc("n"), "h").limit(vocabulary).toArrow()  # at most `vocabulary` rows
    h, counts = rows["h"].to_numpy().astype("<i8").view(np.uint64), rows["n"].to_numpy().astype(np.int64)
    escapes = n_words - int(counts.sum())
    lexicon = Lexicon.build(h, counts, escapes, ends, total[4:], n_words)
    backing = Backing(once / (once + 2 * twice) if once and twice else 0.5, escapes, n_distinct - len(counts))
    known = spark.sparkContext.broadcast(lexicon._replace(code=lexicon.code._replace(path=lexicon.code.path.view(Laid))))

    def tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Tally(known.value, slot_bits)
        for batch in slices(batches, "text", 1 << 17):
            found.add(column(batch, "text"))
        found.flush()
        flat = found.seen.reshape(-1)
        for k in range(0, len(flat), _CHUNK):
            part = flat[k : k + _CHUNK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k // _CHUNK], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["chunk", "v"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, v in zip(column(batch, "chunk").to_pylist(), column(batch, "v"), strict=True):
                part = np.frombuffer(v.as_buffer(), "<u4").astype(np.int64)
                found[chunk] = found[chunk] + part if chunk in found else part
        small = [np.minimum(v, 2**32 - 1).astype("<u4").tobytes() for v in found.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(small, pa.binary())], ["chunk", "v"])

    # a task per 256 MB: each sends one set of tables, whatever it read
    training = own.where("learned").select("text")
    tasks = max(spark.sparkContext.defaultParallelism, int(input_gigabytes(docs, text) * 1000 / 256))
    seen = np.zeros(TABLES * (2 << slot_bits), dtype="<u4")
    for r in training.coalesce(tasks).mapInArrow(tallied, "chunk int, v binary").repartition("chunk").mapInArrow(summed, "chunk int, v binary").toLocalIterator():
        part = np.frombuffer(r["v"], "<u4")
        seen[r["chunk"] * _CHUNK : r["chunk"] * _CHUNK + len(part)] = part
    odds = stretched(seen.reshape(TABLES, -1), slot_bits)
    del seen
    tables = spark.sparkContext.broadcast(odds.view(Laid))  # a fixed number of slots
    del odds

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for texts in runs(batches, fit_documents):
            found = fit_run(texts, known.value, tables.value)
            total = found if total is None else total + found
            trim()
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f8").tobytes()], pa.binary())], ["v"])

    fit = own.where("learned").select(F.shiftrightunsigned(F.xxhash64("rid", F.lit(5)), 11).alias("draw"), "rid", "text")
    if ends <= fit_documents:
        fit = fit.coalesce(1)  # one run
    sums = sum_vectors(fit.mapInArrow(fitted, "v binary"), "v", "<f8", summed=True)
    mixer = Mixer.blank() if sums is None else Mixer.of(sums)
    start = spark.sparkContext.broadcast(mixer)

    entries = own.mapInArrow(_scored(buckets, known, tables, start, divisor), _SENT)
    met = words.select("bucket", "hashes", "counts").groupBy("bucket").cogroup(entries.groupBy("bucket")).applyInArrow(_met(buckets, divisor, backing), "part int, rids binary, sums binary")

    def together(group: pa.Table) -> pa.Table:
        rid, sums = unpack(group["rids"], "<i8")[0], unpack(group["sums"], "<f8")[0].reshape(-1, 5).T
        rid, (m, n, known_, base, score) = _added(rid, sums)
        return pa.table({
            "rid": rid, "n": np.rint(n / m).astype(np.int64), "known": np.rint(known_ / m).astype(np.int64), "base": base / m, "own": score / m})

    sums = met.groupBy("part").applyInArrow(together, "rid long, n long, known long, base double, own double")
    n_bytes = F.octet_length(F.coalesce(F.col(text), F.lit("")))
    mine = docs.select(F.col(doc_id).alias("doc_id"), rid, F.coalesce(remainder(F.col(doc_id), folds) == held_out, F.lit(False)).alias("held_out"), n_bytes.alias("bytes"))
    end_base = math.log10((ends + 0.5) / divisor)
    found = mine.join(sums, "rid")
    score = F.col("own")
    return found.select(
        "doc_id", "held_out", F.col("n").alias("n_tokens"), (F.col("known") + int(ends > 0)).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + end_base).alias("base_score"), score.alias("score"), (-score * float(np.log2(10)) / (F.col("bytes") + 1)).alias("bits_per_byte"))
