"""The corpus pipeline: documents in, packed training sequences out.

Five stages, each a call of one operator of ``lumenveil.llm``; every stage's rows
are written as Parquet and read again as the next stage's documents.

Defined cases: null and empty texts go in the language stage, which finds no letter
in them; rows with a null id go through every stage but are no copy of another; of
a row that is repeated one stays; of equal ids with different texts both stay
unless they are near copies; very long texts are never cut but for packing; an
empty table gives no rows; extra columns, whatever their names, stay to the last
stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenveil.llm import language, lines, nearcopies, packing, tiling
from lumenveil.session import discard, materialize, table, temporary_tables


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the others go.

    Rejected are texts without a letter and texts whose two best languages lie too
    close. The classifiers learn from labelled rows as the query op2 does.
    """
    model = language.train(docs.filter(~language.held_out()))
    rows = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))
    told = language.identify(rows, model, name="told")
    return told.filter((F.col("told.lang_pred") != language.UNDETERMINED) & ~F.col("told.ambiguous")).select("row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that many sources share, however short."""
    return _counted(lines.without_widespread(docs, min_chars=1))


def dedup_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies: that of the least id.

    Near copies share 0.8 or more of their five-word shingles. Of rows with the same
    id and text one stays; a null id is no copy.
    """
    return nearcopies.without_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not cover a benchmark item."""
    return tiling.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents and their places in sequences."""
    return packing.pack_documents(docs)


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES = [
    ("language", identify_language),
    ("lines", dedup_lines),
    ("near_copies", dedup_near_copies),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Language codes, classes of near copies and packing are beyond SQL; the tests hold
#: run() against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents`` below ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        with temporary_tables(spark):
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
