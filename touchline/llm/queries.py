"""The registered query of each operator, and its DuckDB SQL where SQL can
express it. Each reads whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from touchline.llm import language
from touchline.llm.collocations import collocations
from touchline.llm.conversation_repair import damage, repair_report
from touchline.llm.exact_dedup import exact_dedup
from touchline.llm.fingerprints import fingerprint_report
from touchline.llm.jaccard_join import jaccard_components
from touchline.llm.line_dedup import line_dedup
from touchline.llm.mixing import entropy_mix
from touchline.llm.packing import pack
from touchline.llm.simhash_pivots import simhash_components
from touchline.llm.suffix_dedup import suffix_dedup
from touchline.llm.token_counts import token_counts
from touchline.llm.token_files import TokenFiles


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_documents(spark, sf_dir), digest="all")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: declared language from `lang`, host from `source`."""
    docs = _documents(spark, sf_dir)
    return language.identify(docs, language.train(docs))


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pages: declared language from the markup, host, domain and suffix
    from the address; text models from the labelled documents."""
    rows = language.page_rows(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return language.identify(
        rows, language.train(_documents(spark, sf_dir)), id_col="page_id", declared_col="declared",
        host_col="host", domain_col="domain", suffix_col="suffix",
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(_documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", "text")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_documents(spark, sf_dir), k=4, threshold=(85, 100))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    files = TokenFiles(spark).write(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return files.read_back(docs).withColumnRenamed("id", "doc_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy_mix(_documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies"
    )


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_report(_documents(spark, sf_dir))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_documents(spark, sf_dir)).drop("kept")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_documents(spark, sf_dir))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_documents(spark, sf_dir), k=4, most=4)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_language_id": op3_language_id,
    "op4_packing": op4_packing,
    "op5_line_dedup": op5_line_dedup,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_token_files": op7_token_files,
    "op8_mixing": op8_mixing,
    "op9_fingerprints": op9_fingerprints,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_collocations": op11_collocations,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_simhash": op13_simhash,
    "language_id_pages": language_id_pages,
}

ORACLES: dict[str, str] = {"op1_exact_dedup": OP1_SQL}
