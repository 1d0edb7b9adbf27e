"""Quality rules by distribution divergence (SQL functions only).

Character-class and common-word histograms of every document are compared with
references of its language by Jensen-Shannon distance. The references are the
pooled histograms of all documents of the language. Short documents are not
judged by a histogram (minimum-length guards).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mixing import WORD
from .staging import Staged

# The most common function words of each language.
COMMON = {
    "en": "the of and to in is that for it as was with".split(),
    "fr": "de la le et les des en un une que est pour".split(),
    "de": "der die und in den von zu das mit sich auf nicht".split(),
    "es": "de la que el en y los se del las un por".split(),
}
OTHER = "*"
CLASSES = {
    "c_lower": r"[^\p{Ll}]+",
    "c_upper": r"[^\p{Lu}]+",
    "c_letter": r"[\p{Ll}\p{Lu}]+|[^\p{L}]+",
    "c_digit": r"[^\p{N}]+",
    "c_stop": r"[^.,;:?'\"()-]+",
}
CLASS_COLUMNS = [*CLASSES, "c_rest"]
WORD_COLUMNS = [f"w_{i}" for i in range(12)]
SYMBOLS = r"[^#*$%&|<>]+"


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def _repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur at least twice in the text.

    Each window becomes one long: its hash, with the low bits replaced by its
    position. Sorted, equal windows are neighbours. Neighbours with equal hashes are compared
    word by word; where one pair differs, the text's windows are sorted by their words instead.
    """

    def body(w: Column) -> Column:
        n = F.size(w)
        bits = F.length(F.bin(n))

        def packed(i: Column) -> Column:
            h = F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
            return F.call_function("shiftleft", h, bits).bitwiseOR(i.cast("long"))

        windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), packed)).otherwise(F.array().cast("array<long>"))
        low = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1

        def word(i: Column, k: int) -> Column:
            return F.get(w, (i + k).cast("int"))

        def exact(_: Column) -> Column:
            each = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(word(i, 0).alias("a"), word(i, 1).alias("b"), word(i, 2).alias("c"), i.cast("long").alias("i")))

            def repeated(s: Column) -> Column:
                same = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
                twin = lambda x, i: same(x, F.get(s, i + 1)) | ((i > 0) & same(x, F.get(s, i - 1)))
                return F.sort_array(F.transform(F.filter(s, lambda x, i: F.coalesce(twin(x, i), F.lit(False))), lambda x: x["i"]))

            return _let(F.sort_array(each), repeated)

        def starts(s: Column) -> Column:
            top = lambda x: F.call_function("shiftright", x, bits)
            twin = lambda x, i: (top(x) == top(F.get(s, i + 1))) | ((i > 0) & (top(x) == top(F.get(s, i - 1))))
            kept = F.filter(s, lambda x, i: F.coalesce(twin(x, i), F.lit(False)))

            def checked(t: Column) -> Column:
                place = lambda x: x.bitwiseAND(low)
                differ = lambda x, y: ~((word(place(x), 0) == word(place(y), 0)) & (word(place(x), 1) == word(place(y), 1)) & (word(place(x), 2) == word(place(y), 2)))
                pairs = F.transform(t, lambda x, i: F.coalesce((top(x) == top(F.get(t, i + 1))) & differ(x, F.get(t, i + 1)), F.lit(False)))
                return F.when(F.exists(pairs, lambda x: x), exact(t)).otherwise(F.sort_array(F.transform(t, place)))

            return _let(kept, checked)

        def covered(p: Column) -> Column:
            each = F.transform(p, lambda x, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(p, i + 1) - x, F.lit(3).cast("long"))))
            return F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)

        return _let(_let(F.sort_array(windows), starts), covered)

    return _let(words, body)


def _features(docs: DataFrame, doc_id: str, text: str, lang: str) -> DataFrame:
    t = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeated_words(w).alias("n_repeat_words"),
        )

    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    spaced = F.concat(F.lit(" "), F.regexp_replace(F.lower(t), r"[^\p{L}]+", "  "), F.lit(" "))

    def counts(of: list[str]):
        one = lambda x, w: (F.octet_length(x) - F.octet_length(F.replace(x, F.lit(f" {w} "), F.lit("")))) / len(f" {w} ".encode())
        return lambda x: F.array(*[F.round(one(x, w)).cast("long") for w in of])

    none = F.array(*[F.lit(0).cast("long")] * len(WORD_COLUMNS))
    common = F.when(F.lit(False), none)
    for name, of in COMMON.items():
        common = common.when(F.col("lang") == name, _let(spaced, counts(of)))
    left = own.select(
        "doc_id",
        F.when(F.col("lang").isin(*COMMON), F.col("lang")).otherwise(OTHER).alias("ref"),
        _let(words, of_words).alias("of"),
        F.length(F.regexp_replace(t, SYMBOLS, "")).cast("long").alias("n_symbols"),
        _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        common.otherwise(none).alias("common"),
        *[F.length(F.regexp_replace(t, pattern, "")).cast("long").alias(name) for name, pattern in CLASSES.items()],
    )
    known = sum((F.col(c) for c in CLASSES), F.lit(0))
    return left.select(
        "doc_id", "ref", "of.*", "n_symbols", "n_dup_lines", *CLASSES,
        F.greatest(F.col("of.word_chars") - known, F.lit(0)).alias("c_rest"),
        *[F.col("common")[i].alias(c) for i, c in enumerate(WORD_COLUMNS)],
    )


def _distance(counts: Column, total: Column, ref: Column) -> Column:
    """Jensen-Shannon distance (base 2) of an array of counts over their total and a reference distribution."""

    def term(n: Column, q: Column) -> Column:
        p = n / total
        m = (p + q) / 2
        return F.when(n > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)

    divergence = F.aggregate(F.zip_with(counts, ref, term), F.lit(0.0), lambda a, x: a + x) / 2
    return F.sqrt(F.greatest(divergence, F.lit(0.0)))


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)


def _other_words() -> Column:
    return F.greatest(F.col("n_words") - sum((F.col(c) for c in WORD_COLUMNS), F.lit(0)), F.lit(0))


def quality_rules(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    min_class_chars: int = 200,
    max_class_distance: float = 0.3,
    max_word_distance: float = 0.26,
) -> DataFrame:
    """Counts, base rules and the verdict of every document.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, class_distance, word_distance; one row per input row. A
    distance is null where a guard says that the text is too short for it, and a
    null distance keeps the document. Languages without a word list (and null)
    are compared by character classes only, with a reference pooled over their
    documents. Null and empty texts have no words and fail the base rules; very long texts are counted whole and exactly.
    Repeated rows get equal results; an empty table gives an empty one. Other columns of ``docs`` are not read.
    """
    staged = Staged(docs.sparkSession, "quality-rules")
    found = staged.write(_features(docs, doc_id, text, lang), "features")

    # one row per language list and one for all other languages: five rows at most
    found = found.select(
        "doc_id", "ref", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.array(*CLASS_COLUMNS).alias("classes"), F.array(*WORD_COLUMNS, _other_words()).alias("words"))
    totals = lambda c, n: F.array(*[F.sum(F.col(c)[i]) for i in range(n)])
    share = lambda c, n: F.transform(c, lambda x: (x + 1) / (_sum(F.col(c)) + n))
    n_classes, n_words = len(CLASS_COLUMNS), len(WORD_COLUMNS) + 1
    sums = found.groupBy("ref").agg(totals("classes", n_classes).alias("c"), totals("words", n_words).alias("w"))
    refs = sums.select(F.col("ref").alias("r"), share("c", n_classes).alias("r_classes"), share("w", n_words).alias("r_words"))
    judged = found.join(F.broadcast(refs), F.col("ref") == F.col("r"))
    n_chars = _sum(F.col("classes"))
    n_tokens = F.greatest(F.col("n_words"), _sum(F.slice("words", 1, len(WORD_COLUMNS))))
    judged = judged.withColumns({"n_chars": n_chars, "n_tokens": n_tokens}).withColumns({
        "class_distance": F.when(F.col("n_chars") >= min_class_chars, _distance(F.col("classes"), F.col("n_chars"), F.col("r_classes"))),
        "word_distance": F.when((F.col("n_words") >= min_words) & (F.col("ref") != OTHER), _distance(F.col("words"), F.col("n_tokens"), F.col("r_words"))),
    })
    class_distance, word_distance = F.col("class_distance"), F.col("word_distance")
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    good = (F.coalesce(class_distance, F.lit(0.0)) <= max_class_distance) & (F.coalesce(word_distance, F.lit(0.0)) <= max_word_distance)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & good).alias("kept"),
        "class_distance", "word_distance",
    )
