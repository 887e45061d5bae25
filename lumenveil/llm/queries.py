"""The registered queries of this subpackage: thin digests over its operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenveil.llm import alignment, ann, debruijn, html, language, lines, minmax, packing, quotes, repair, secrets, simhash, tiling
from lumenveil.session import table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every row of ``pages``."""
    found = html.extract_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "removed")


def op2_ecoc_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every row of ``documents``, learnt from the rest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", language.held_out())
    model = language.train(docs.filter("not held_out"))
    return language.identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "language.*")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` without lines that many sources share."""
    left = lines.without_widespread(table(spark, sf_dir, "documents"), counts=True)
    return left.select("doc_id", "n_lines", "n_removed", F.md5(F.col("text").cast("binary")).alias("kept_md5"))


def op4_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``conversations`` without quotes, with its reply order."""
    return quotes.conversations(table(spark, sf_dir, "conversations"))


def op5_one_bit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 rows of ``embeddings`` nearest to every twentieth one."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of ``documents`` and its place in a 1024-token sequence."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op7_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every row of ``documents`` without repeated windows."""
    left = debruijn.without_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of ``documents`` that cover a benchmark item, with the coverage."""
    return tiling.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every row of ``documents``."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every row of ``documents``."""
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    return found.select(
        "doc_id", number("assign"), number("access"), number("hex"),
        F.sha2(secrets.written(base), 256).alias("base_sha256"), secrets.written(F.col("spans")).alias("spans"), number("entropy"),
    )


def op11_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and component of the shingle set of every row of ``documents``."""
    found = minmax.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.coalesce(F.col("id") == F.col("component"), F.lit(True))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), kept.alias("kept"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation of ``conversations``, damaged and repaired."""
    rows, copies = repair.damaged(table(spark, sf_dir, "conversations"))
    return repair.repaired(rows, copies=copies)


def op13_postings_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` aligned between two tokenizers."""
    return alignment.aligned(table(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extraction": op1_html_extraction,
        "op2_ecoc_language": op2_ecoc_language,
        "op3_line_dedup": op3_line_dedup,
        "op4_quotation_linking": op4_quotation_linking,
        "op8_string_tiling": op8_string_tiling,
        "op5_one_bit_neighbours": op5_one_bit_neighbours,
        "op10_secret_scan": op10_secret_scan,
        "op7_debruijn_dedup": op7_debruijn_dedup,
        "op9_simhash_near_dedup": op9_simhash_near_dedup,
        "op6_best_fit_packing": op6_best_fit_packing,
        "op11_minmax_near_dedup": op11_minmax_near_dedup,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_postings_alignment": op13_postings_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_line_dedup": lines.ORACLE_SQL,
        "op5_one_bit_neighbours": ann.ORACLE_SQL,
        "op7_debruijn_dedup": debruijn.ORACLE_SQL,
        "op11_minmax_near_dedup": minmax.ORACLE_SQL,
        "op12_conversation_repair": repair.ORACLE_SQL,
    }
