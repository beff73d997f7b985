"""The queries of this subpackage: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodespar.llm.common import table


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodespar.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodespar.llm.chunks import remove_repeated_chunks

    return remove_repeated_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodespar.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodespar.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodespar.llm.pii import find_personal_data

    return find_personal_data(table(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodespar.llm.language import identify_languages

    return identify_languages(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", "margin")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodespar.llm.simhash import simhash_components

    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodespar.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodespar.llm.html import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodespar.llm.rans import token_files

    return token_files(table(spark, sf_dir, "documents")).select("doc_id", "start", "n_tokens", "ids_crc32")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_personal_data, op2_language, op3_simhash, op4_top_k, op5_main_text, op6_token_files, op7_decontaminate, op8_line_dedup, op9_toxicity, op10_packing)}


OP4_SQL = """
WITH v AS (SELECT vec_id, [floor(CAST(x AS DOUBLE) * 256) FOR x IN embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
       FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
 r AS (SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_top_k": OP4_SQL}
