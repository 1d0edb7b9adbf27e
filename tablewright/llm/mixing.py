"""Mixing sources to target weights by Efraimidis-Spirakis sampling (SQL functions only).

Every document draws an exponential key ``-ln(u) / weight``. Within a source the
documents are ordered by key and their sizes prefix-summed up to the source's
budget. A budget of ``q`` times the source takes ``floor(q)`` complete epochs
and samples only the fractional rest.

The order is never materialised: a radix search on the key's logarithm finds, per source,
the narrow key range in which the budget ends, by summing sizes per digit
(pre-aggregated before the shuffle). The range spans two parts in a hundred million of the key, whatever the
weights. Only the documents of that range are sorted, so a source that holds most of the corpus needs no large task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import Staged, fresh

WORD = r"[^\x20\x09-\x0D]+"
DIGIT = 256
LEVELS = 4


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def letter_share(text: Column) -> Column:
    """Quality weight in [0.05, 1]: the share of letters among visible characters."""
    visible = F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    return F.coalesce(F.greatest(F.lit(0.05), letters / F.when(visible > 0, visible)), F.lit(0.05))


def source_targets(totals: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Targets per source: ``share`` of all sizes dealt by weight, none above ``cap`` times its source.

    ``totals`` has ``source`` and ``source_size``, one row per source. Sources
    take ``weights`` in turn, ordered by code point with null last. What a capped
    source cannot take goes to the others by weight until none exceeds its cap;
    the capped sources are a prefix in the order of size per weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    w = totals.withColumn("w", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    before = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    limit = F.col("source_size") * float(cap)
    w = w.withColumn("limit", limit).withColumns({
        "free": F.sum("source_size").over(everything) * float(share) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)),
        "open": F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)),
    })
    w = w.withColumn("capped", F.col("limit") * F.col("open") <= F.col("free") * F.col("w"))
    free = F.sum("source_size").over(everything) * float(share) - F.sum(F.when(F.col("capped"), F.col("limit")).otherwise(0.0)).over(everything)
    open_ = F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("w"))).over(everything)
    target = F.when(F.col("capped"), F.col("limit")).otherwise(free * F.col("w") / open_)
    return w.select("source", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 17,
    quality: Column | None = None,
) -> DataFrame:
    """How many words of each document the mix takes.

    Returns doc_id, size, source_size, target, taken, repeats (how often the
    document enters the mix) and key (a hash of id and text), one row per input row. ``quality`` gives positive
    sampling weights (default: ``letter_share``). A source's taken words differ
    from its target by at most half of the document at which its budget ends.

    Null text has size 0; null source is a source of its own, ordered last; null
    doc_id is an id like any other. Repeated rows draw the same key and are
    taken together or split at the budget; equal keys are ordered by id. An
    empty table gives an empty result. Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    staged = Staged(spark, "mixing")
    t = F.col(text)
    drawn = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        word_count(t).alias("size"),
        F.greatest((letter_share(t) if quality is None else quality).cast("double"), F.lit(1e-9)).alias("weight"),
        F.xxhash64(F.lit(seed), F.col(doc_id), t).alias("tie"),
    )
    # u in (0, 1) from 52 bits of the hash; x in [0, 1) rises with the key -ln(u) / weight, which lies within 2**-64 and 2**64
    u = (F.shiftrightunsigned(F.col("tie"), 12).cast("double") + 0.5) / F.lit(float(2**52))
    drawn = drawn.withColumn("key", -F.log(u) / F.col("weight"))
    drawn = drawn.withColumn("x", F.least(F.greatest((F.log2("key") + 64.0) / 128.0, F.lit(0.0)), F.lit(1.0 - 2.0**-50))).drop("weight")
    rows = staged.write(drawn, "sizes")

    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(totals, weights, share, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = targets.select(
        "source", "source_size", "target", epochs.alias("epochs"),
        (F.col("target") - epochs * F.col("source_size")).alias("rest"), F.lit(0).cast("long").alias("prefix"),
    )
    for level in range(1, LEVELS + 1):
        state = _narrow(rows, state, level)
    state = staged.write(state, "state")

    found = _with_state(rows, state)
    mine = F.floor(F.col("x") * float(DIGIT**LEVELS)).cast("long")
    edge = found.where((mine == F.col("prefix")) & (F.col("rest") > 0))
    inner = found.where((mine != F.col("prefix")) | (F.col("rest") <= 0)).withColumn(
        "chosen", (F.col("rest") > 0) & (mine < F.col("prefix")))
    so_far = F.sum("size").over(Window.partitionBy("source").orderBy("key", "tie", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    edge = edge.withColumn("so_far", so_far).withColumn("chosen", F.col("so_far") - F.col("size") / 2 <= F.col("rest"))
    both = edge.drop("so_far").unionByName(inner)
    repeats = F.col("epochs") + F.col("chosen").cast("long")
    return both.select("doc_id", "size", "source_size", "target", (repeats * F.col("size")).alias("taken"), repeats.alias("repeats"), F.col("tie").alias("key"))


def mixed_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", seed: int = 17, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as ``mix_sources`` takes it, with all columns.

    Rows of equal id and text are one document here: it comes with the columns of one of them, as often as all are taken
    together. Null ids, texts and sources are values like others; equal keys are told apart by id. An empty table gives an empty one.
    """
    found = mix_sources(docs, doc_id=doc_id, text=text, seed=seed, **options)
    key, times, nth, id_, other, size = fresh(docs, "key", "times", "nth", "id", "other", "size")
    taken = found.groupBy(F.col("key").alias(other), F.col("doc_id").alias(id_)).agg(F.sum("repeats").alias(times)).where(F.col(times) > 0)
    keyed = docs.withColumns({key: F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)), size: F.octet_length(F.col(text))})
    rows = keyed.join(taken, (F.col(key) == F.col(other)) & F.col(doc_id).eqNullSafe(F.col(id_))).dropDuplicates([key, doc_id, size])
    return rows.withColumn(nth, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).drop(key, times, nth, id_, other, size)


def _with_state(rows: DataFrame, state: DataFrame) -> DataFrame:
    s = state.withColumnRenamed("source", "of")
    return rows.join(s, F.col("source").eqNullSafe(F.col("of"))).drop("of")


def _narrow(rows: DataFrame, state: DataFrame, level: int) -> DataFrame:
    """One radix step: per source, the digit at which the rest of the budget ends."""
    found = _with_state(rows, state)
    mine = F.floor(F.col("x") * float(DIGIT**level)).cast("long")
    # a source whose rest is used up keeps one digit, so that it stays in the state
    inside = F.floor(mine / DIGIT) == F.col("prefix")
    fixed = ["source", "source_size", "target", "epochs", "rest", "prefix"]
    sums = found.groupBy(*fixed, F.when(inside, mine).alias("digit")).agg(F.sum("size").alias("words"))
    order = Window.partitionBy("source").orderBy(F.col("digit").asc_nulls_last())
    sums = sums.withColumn("words", F.when(F.col("digit").isNull(), 0).otherwise(F.col("words")))
    before = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumns({"before": before, "nth": F.row_number().over(order)})
    # the last digit that begins before the budget ends
    begun = F.col("digit").isNotNull() & (F.col("before") < F.col("rest"))
    last = F.max_by(F.struct("digit", "before"), F.when(begun, F.col("nth")))
    picked = sums.groupBy("source", "source_size", "target", "epochs", "rest", "prefix").agg(last.alias("last"))
    return picked.select(
        "source", "source_size", "target", "epochs",
        (F.col("rest") - F.coalesce(F.col("last.before"), F.lit(0))).alias("rest"),
        F.coalesce(F.col("last.digit"), F.col("prefix") * DIGIT).alias("prefix"),
    )
