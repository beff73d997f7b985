"""The corpus pipeline: documents in, packed sequences out.

Each stage takes the session, its predecessor's documents and the folder of the tables, and works on all it is given.
Between stages the documents are written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodespar.llm.chunks import dedup_lines
from lodespar.llm.common import new_folder, table
from lodespar.llm.decontaminate import drop_contaminated
from lodespar.llm.language import keep_known_languages
from lodespar.llm.packing import pack_documents
from lodespar.llm.simhash import near_dedup


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no known language go: no letters, or too few of any language's n-grams."""
    return keep_known_languages(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines leave ``text``, and ``n_chars`` follows it. Documents stay."""
    return dedup_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least doc_id stays."""
    return near_dedup(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a copy of a test item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rest, in windows of 2048 tokens: a row for each piece."""
    return pack_documents(docs)


STAGES = [("language ID", language), ("line dedup", lines), ("near dedup", near_copies), ("decontamination", benchmark), ("packing", packing)]

#: Language scores, fingerprint links, alignments and tokens aren't SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; all but the last write their rows to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = new_folder(spark, f"pipeline-{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
