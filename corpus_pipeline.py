"""From raw documents to packed training sequences, in five stages.

Each stage takes the documents that its predecessor kept and returns documents with the same
columns; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import language_id as language
from tablewright.llm.mixing import mixed_documents
from tablewright.llm.near_dedup import drop_near_duplicates
from tablewright.llm.packing import pack
from tablewright.llm.staging import Staged
from tablewright.llm.substring_dedup import substring_dedup


def _unlike(docs: DataFrame) -> str:
    """A prefix that no column has, for columns that come and go within a stage."""
    prefix = "stage_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    return prefix


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no learned language go; a missing language is filled in.

    Null, empty and letterless texts are in no language and go; repeated rows stay or go together; very
    long texts are judged whole; an empty table stays empty. Other columns are passed on whatever their names.
    """
    p = _unlike(docs)
    model = language.train(docs.select("doc_id", "text", "lang"))
    found = language.identify(docs, model, keep_columns=True, prefix=p).where(~F.col(f"{p}rejected"))
    return found.withColumn("lang", F.coalesce("lang", f"{p}lang_pred")).select([F.col(f"`{c}`") for c in docs.columns])


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest id.

    Null, empty and wordless texts are near nothing and stay; of repeated rows one stays; a null id
    comes last; an empty table stays empty. Other columns are passed on whatever their names.
    """
    return drop_near_duplicates(docs, shingle=5, percent=80).select([F.col(f"`{c}`") for c in docs.columns])


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words or more that occur earlier go; a document of which nothing is left goes too.

    Earlier means a smaller id (null last) or place. Texts without words have nothing to lose and stay; n_chars follows
    the text; an empty table stays empty. Other columns are passed on whatever their names.
    """
    p = _unlike(docs)
    found = substring_dedup(docs, factors=False, prefix=p)
    left = found.where((F.col(f"{p}n_removed") < F.col(f"{p}n_words")) | (F.col(f"{p}n_words") == 0))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("n_chars").isNotNull() | (F.col(f"{p}n_removed") > 0), F.length("text")).cast("long"))
    return left.select([F.col(f"`{c}`") for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    Texts without words weigh nothing and are taken with their source's complete epochs and wherever the
    sample takes them; a null source is a source; repeated rows are taken as
    often as all of them together; an empty table stays empty. Other columns are passed on whatever their names.
    """
    return mixed_documents(docs).select([F.col(f"`{c}`") for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences: each row's ids and an end, longer ones cut.

    Null and empty texts are one end; null ids and repeated rows are packed like any other; other columns are
    not read; an empty table gives no piece.
    """
    return pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", remove_near_duplicates),
    ("substring_dedup", remove_repeated_passages),
    ("mixing", mix),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # hashes, clusters and token ids are beyond SQL; the tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of a folder's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    staged = Staged(spark, "pipeline")
    before = None
    for name, stage in STAGES[:-1]:
        docs = staged.write(stage(spark, docs, sf_dir), name)
        if before:
            staged.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
