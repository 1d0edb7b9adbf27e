"""Near-duplicate components by one-permutation MinHash, banded buckets and star-shaped candidates.

1. Every text becomes its set of hashed word shingles. One hash pass fills the bins
   of a one-permutation signature; empty bins borrow by optimal densification.
   Texts with equal sets (128 bits of fingerprints) form a class; only one representative of each goes on.
2. Bands of the signature name buckets. A bucket of m classes gives m - 1 edges to
   its smallest member (a star), first within each task and then across tasks.
3. Every class is compared on full sets with the centre that it shares most
   buckets with. Confirmed edges are contracted into components.
4. A star can hide a link between two members that are both unlike the centre. Any
   such link lies between components that candidate edges still join; the members
   of these are compared with each other, block by block: an inverted index of the block's
   shingles gives the exact overlaps of each member, without a filter before it.

Components are labelled with the smallest document id. Texts that are compared
travel once per block; links and components stay in distributed tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .membership import maybe_in
from .staging import Staged, buckets_for, fresh
from .substring_dedup import _within
from .textcore import buffers, column, gram_hashes, mix64, pack, slices, span_hashes, split_words, starts_of, unpack

BANDS, ROWS = 48, 5
BINS = BANDS * ROWS
_PROBES = 256


def _probe_table() -> np.ndarray:
    """For every bin, the bins that it borrows from in turn."""
    cells = np.arange(BINS * _PROBES, dtype=np.uint64) + np.uint64(1)
    return (mix64(cells * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(BINS)).astype(np.int64).reshape(BINS, _PROBES)


_PROBE = _probe_table()


def signature(shingles: np.ndarray) -> np.ndarray:
    """One value per bin from a sorted, non-empty array of distinct hashes."""
    bins = ((shingles >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
    values = np.zeros(BINS, dtype=np.uint64)
    full = np.zeros(BINS, dtype=bool)
    at = bins[first].astype(np.int64)
    values[at], full[at] = shingles[first], True
    empty = np.flatnonzero(~full)
    for low, high in ((0, 16), (16, _PROBES)):
        if len(empty):
            hit = full[_PROBE[empty, low:high]]
            found = hit.any(axis=1)
            values[empty[found]] = values[_PROBE[empty[found], low + hit[found].argmax(axis=1)]]
            empty = empty[~found]
    if len(empty):  # very few full bins: borrow by rank
        values[empty] = values[at[_PROBE[empty, 0] % len(at)]]
    return values


def band_keys(values: np.ndarray) -> np.ndarray:
    """One bucket key per band."""
    rows = values.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    for k in range(ROWS):
        key = mix64(key ^ rows[:, k]) + np.uint64(k)
    return key


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; a shorter text is one shingle, a wordless one has none."""
    data, offsets = buffers(texts)
    words = split_words(data, offsets, lower=True)
    h = span_hashes(words.data, words.starts, words.ends)
    grams = gram_hashes(h, n)
    out = []
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        if b - a >= n:
            mine = np.sort(grams[a : b - n + 1])
            out.append(mine[np.concatenate([[True], mine[1:] != mine[:-1]])])
        elif b > a:
            out.append(mix64(gram_hashes(h[a:b], int(b - a)) + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


_SIGNED = "rid long, doc_id {kind}, n_shingles long, class long, check long, bands binary"


def _fingerprint(s: np.ndarray, salt: int) -> int:
    """Order-free: equal for equal sets."""
    return int(mix64(np.array([mix64(s * np.uint64(salt)).sum() + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def _sign(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            size, of, check, bands = [], [], [], []
            for s in shingle_sets(column(batch, "text"), shingle):
                size.append(len(s))
                of.append(_fingerprint(s, 0xBF58476D1CE4E5B9) if len(s) else None)
                check.append(_fingerprint(s, 0x94D049BB133111EB) if len(s) else None)
                bands.append(band_keys(signature(s)).astype("<u8").tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "rid"), column(batch, "doc_id"), *[pa.array(x, pa.int64()) for x in (size, of, check)], pa.array(bands, pa.binary())],
                ["rid", "doc_id", "n_shingles", "class", "check", "bands"])

    return run


def _stars(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys with their smallest node, and the edges (node, smallest) of all others."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    centre = nodes[np.flatnonzero(new)]
    of = centre[np.cumsum(new) - 1] if len(keys) else nodes
    other = ~new & (nodes != of)
    return keys[new], centre, nodes[other], of[other]


def _star_edges(classes: DataFrame, buckets: int) -> DataFrame:
    """Star edges (a, b) of all buckets, b being the centre; repeated once for each shared bucket."""
    names = ["bucket", "keys", "nodes", "a", "b"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node = column(batch, "class").to_numpy()
            keys, _ = unpack(column(batch, "bands"), "<u8")
            keys, centre, a, b = _stars(keys, np.repeat(node, BANDS))
            # buckets and edges go to numbered rows; only rows that hold something are made
            of = np.concatenate([(keys >> np.uint64(40)) % np.uint64(buckets), mix64(a.view(np.uint64)) % np.uint64(buckets)]).astype(np.int64)
            present, row = np.unique(of, return_inverse=True)
            places = np.arange(len(present) + 1)
            by_key, by_way = np.argsort(row[: len(keys)], kind="stable"), np.argsort(row[len(keys) :], kind="stable")
            cuts, way_cuts = np.searchsorted(row[: len(keys)][by_key], places), np.searchsorted(row[len(keys) :][by_way], places)
            yield pa.RecordBatch.from_arrays(
                [pa.array(present, pa.int32()), pack(keys[by_key], cuts), pack(centre[by_key], cuts), pack(a[by_way], way_cuts), pack(b[by_way], way_cuts)], names)

    def join(group: pa.Table) -> pa.Table:
        keys, nodes, a, b = (unpack(group[c], t)[0] for c, t in (("keys", "<u8"), ("nodes", "<i8"), ("a", "<i8"), ("b", "<i8")))
        _, _, more, centre = _stars(keys, nodes)
        a, b = np.concatenate([a, more]), np.concatenate([b, centre])
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
        return pa.table({"a": a[new], "b": b[new], "n": np.diff(np.append(new, len(a)))})

    sent = classes.select("class", "bands").mapInArrow(send, "bucket int, keys binary, nodes binary, a binary, b binary")
    return sent.groupBy("bucket").applyInArrow(join, "a long, b long, n long")


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def overlaps(sets: list[np.ndarray], rows: np.ndarray, others: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """For each of ``rows``: the exact sizes of its intersections, itself, and the members of ``others`` that it meets."""
    values = np.concatenate([sets[i] for i in others] or [np.empty(0, np.uint64)])
    owner = np.repeat(np.arange(len(others)), [len(sets[i]) for i in others])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    for x in rows:
        low, high = np.searchsorted(values, sets[x], "left"), np.searchsorted(values, sets[x], "right")
        n = np.bincount(owner[_within(low, high - low)], minlength=len(others))
        met = np.flatnonzero(n)
        yield n[met], int(x), others[met]


def _with_texts(need: DataFrame, rids: DataFrame, bodies: DataFrame) -> DataFrame:
    """Add the text of a representative of each ``class``. Texts that nothing needs aren't shuffled."""
    wanted = need.join(rids, "class")
    return maybe_in(bodies, "rid", need.select("class").distinct().join(rids, "class"), "rid").join(wanted, "rid")


def _confirm_stars(edges: DataFrame, rids: DataFrame, bodies: DataFrame, staged: Staged, shingle: int, percent: int, chunk: int) -> DataFrame:
    """The edges (a, b) whose full sets are similar; a centre's members are compared in chunks."""
    sizes = staged.write(edges.groupBy("b").agg(F.count("*").alias("m")), "star-sizes")  # apart, so that a large star's rows can be split
    salted = edges.join(sizes, "b").select("a", "b", F.pmod(F.xxhash64("a", F.lit(9)), F.ceil(F.col("m") / chunk)).cast("int").alias("salt"))
    centres = salted.select("b", "salt").distinct().select(F.col("b").alias("class"), "b", "salt")
    need = salted.select(F.col("a").alias("class"), "b", "salt").unionByName(centres)
    rows = _with_texts(need, rids, bodies).select("class", "b", "salt", "text")

    def compare(group: pa.Table) -> pa.Table:
        node = group["class"].to_numpy()
        centre = group["b"][0].as_py()
        at = np.flatnonzero(node == centre)
        found = []
        if len(at):
            base = shingle_sets(group["text"].slice(int(at[0]), 1), shingle)[0]
            for low in range(0, len(node), 64):
                for c, s in zip(node[low : low + 64], shingle_sets(group["text"].slice(low, 64), shingle), strict=True):
                    if c != centre and _similar(s, base, percent):
                        found.append(int(c))
        return pa.table({"a": pa.array(found, pa.int64()), "b": pa.array([centre] * len(found), pa.int64())})

    return rows.groupBy("b", "salt").applyInArrow(compare, "a long, b long")


def _confirm_blocks(members: DataFrame, rids: DataFrame, bodies: DataFrame, staged: Staged, shingle: int, percent: int, block: int) -> DataFrame:
    """Links between components inside clusters: edges (a, b) of component roots.

    ``members`` has cluster, class and root. A cluster is cut into blocks of about
    ``block`` members; every two blocks meet once, so each text is sent once per block.
    """
    sizes = staged.write(members.groupBy("cluster").agg(F.count("*").alias("m")), "cluster-sizes")
    dealt = members.join(sizes, "cluster").withColumn("blocks", F.ceil(F.col("m") / block).cast("int"))
    dealt = dealt.withColumn("i", F.pmod(F.xxhash64("class", F.lit(13)), F.col("blocks")).cast("int"))
    meets = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meets = meets.select("cluster", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "i", "class", "root")
    rows = _with_texts(meets, rids, bodies).select("cluster", "lo", "hi", "i", "class", "root", "text")

    def compare(group: pa.Table) -> pa.Table:
        lo, hi = group["lo"][0].as_py(), group["hi"][0].as_py()
        side, root = group["i"].to_numpy(), group["root"].to_numpy()
        sets: list[np.ndarray] = []
        for low in range(0, group.num_rows, 64):
            sets += shingle_sets(group["text"].slice(low, 64), shingle)
        parent = {int(r): int(r) for r in np.unique(root)}

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        edges = []
        others = np.flatnonzero(side == hi)
        for k, x, y in overlaps(sets, np.flatnonzero(side == lo), others):
            keep = (root[y] != root[x]) & (100 * k >= percent * (len(sets[x]) + np.array([len(sets[i]) for i in y], dtype=np.int64) - k))
            for j in y[keep]:
                a, b = find(int(root[x])), find(int(root[j]))
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    edges.append((max(a, b), min(a, b)))
        return pa.table({"a": pa.array([a for a, _ in edges], pa.int64()), "b": pa.array([b for _, b in edges], pa.int64())})

    return rows.groupBy("cluster", "lo", "hi").applyInArrow(compare, "a long, b long")


def _labelled(docs: DataFrame, doc_id: str, text: str, shingle: int, percent: int, chunk: int, block: int) -> DataFrame:
    """doc_id and n_shingles of every row, the component's root class ``top`` (null for no shingles) and its ``first`` row.

    ``first`` has no_id, doc_id and rid, a hash of id and text. Everything between
    the signatures and the last join is one row per class or fewer.
    """
    spark = docs.sparkSession
    staged = Staged(spark, "near-dedup")
    own = docs.select(F.xxhash64(F.col(doc_id), F.col(text)).alias("rid"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    signed = staged.write(own.mapInArrow(_sign(shingle), _SIGNED.format(kind=dict(own.dtypes)["doc_id"])), "signed")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")
    tag = "signed"

    def grouped() -> DataFrame:
        each = signed.where(F.col("class").isNotNull()).groupBy("class").agg(
            F.min(F.struct("rid", "bands")).alias("one"), F.min(row).alias("first"), F.min("check").alias("low"), F.max("check").alias("high"))
        return staged.write(each.select("class", "one.rid", "one.bands", "first", "low", "high"), f"classes-{tag}")

    classes = grouped()
    while classes.where("low <> high").limit(1).count():  # different sets with equal fingerprints: those of a larger check get a class of their own
        shared = classes.where("low <> high").select("class", "low")
        apart = F.when(F.col("low").isNotNull() & (F.col("check") != F.col("low")), F.xxhash64("class", "check")).otherwise(F.col("class"))
        tag += "-again"
        signed = staged.write(signed.join(shared, "class", "left").withColumn("class", apart).drop("low"), tag)
        classes = grouped()
    classes = classes.drop("low", "high")
    rids, bodies = classes.select("class", "rid"), own.select("rid", "text")

    buckets = buckets_for(docs, text, 24.0, 24)
    stars = _star_edges(classes, buckets).groupBy("a", "b").agg(F.sum("n").alias("n"))
    stars = staged.write(stars, "stars")
    best = stars.groupBy("a").agg(F.max(F.struct("n", (-F.col("b")).alias("c"))).alias("x")).select("a", (-F.col("x.c")).alias("b"))
    best = staged.write(best, "best")
    links = staged.write(_confirm_stars(best, rids, bodies, staged, shingle, percent, chunk), "links")
    roots = staged.write(connected_components(links, staged, "first"), "roots")

    # candidate edges that still join two components, and the clusters of components that they form
    root_of = lambda df, c: df.join(roots.withColumnRenamed("node", c), c, "left").withColumn(c, F.coalesce("root", c)).drop("root")
    open_ = root_of(root_of(stars.select("a", "b"), "a"), "b").where(F.col("a") != F.col("b"))
    clusters = connected_components(open_, staged, "open").select(F.col("node").alias("root"), F.col("root").alias("cluster"))
    member = classes.select("class", "first").join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    members = staged.write(member.join(clusters, "root").select("cluster", "class", "root"), "members")
    more = staged.write(_confirm_blocks(members, rids, bodies, staged, shingle, percent, block), "more-links")

    merged = connected_components(more, staged, "second").select(F.col("node").alias("root"), F.col("root").alias("top"))
    final = member.join(merged, "root", "left").select("class", F.coalesce("top", "root").alias("top"), "first")
    labels = final.groupBy("top").agg(F.min("first").alias("first"))
    final = staged.write(final.select("class", "top").join(labels, "top"), "final")
    staged.drop(*[t for t in staged.paths if t not in (tag, "final")])
    found = signed.select("doc_id", "n_shingles", "class")
    # rows without shingles apart: they would all meet in one task of the join
    none = found.where(F.col("class").isNull()).select("*", *[F.lit(None).cast(final.schema[c].dataType).alias(c) for c in ("top", "first")])
    return found.where(F.col("class").isNotNull()).join(final, "class").unionByName(none)


def near_dedup(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, percent: int = 80, chunk: int = 256, block: int = 512,
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    Two documents are linked when ``100 * |A and B| >= percent * |A or B|`` for their
    sets of distinct ``shingle``-word shingles of the text with A-Z lower-cased; a text with
    fewer words is one shingle. Components are the transitive closure; component_id
    is their smallest id and ``kept`` marks the document that has it.

    Null, empty and wordless texts have no shingles and are components of their own.
    Rows with a null id link like others but give no label: a component of null ids
    alone has component_id null, and null ids are never kept. Repeated rows share a component; each row
    that has the component's id is kept. An empty table gives an empty
    result. Other columns of ``docs`` are not read. ``chunk`` and ``block`` size the
    comparisons and never change the result.
    """
    of = _labelled(docs, doc_id, text, shingle, percent, chunk, block)
    label = F.when(F.col("top").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    return of.select("doc_id", "n_shingles", label.alias("component_id"), F.coalesce(F.col("doc_id") == label, F.lit(False)).alias("kept"))


def drop_near_duplicates(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80, chunk: int = 256, block: int = 512,
) -> DataFrame:
    """The rows of ``docs`` with one document of each component, that of the smallest id (null last).

    All columns are kept as they are, whatever their names. Rows with null, empty or wordless texts belong to no component and all stay. Of
    repeated rows (equal id and text) one stays, whatever their other columns; texts of any length are compared whole. An empty table gives an empty one.
    """
    of = _labelled(docs, doc_id, text, shingle, percent, chunk, block).where(F.col("top").isNotNull())
    rid, size = fresh(docs, "rid", "size")
    kept = of.select(F.col("first.rid").alias(rid)).distinct()
    keyed = docs.withColumns({rid: F.xxhash64(F.col(doc_id), F.col(text)), size: F.octet_length(F.col(text))})
    wordless = ~F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    stay = keyed.where(~wordless).join(kept, rid, "left_semi").dropDuplicates([rid, doc_id, size])
    return stay.unionByName(keyed.where(wordless)).drop(rid, size)
