"""The corpus pipeline: documents to packed token sequences.

Defined results, for every stage: an empty table gives no rows (and the stages after it run on none); other columns than
those named, whatever their names, stay as they are; texts of any length are taken whole; rows that repeat id and text are
one document from the second stage on. Each stage's own are said at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loamline.llm.common import discard, materialize, tables_written
from loamline.llm.exact_dedup import drop_repeats
from loamline.llm.near_dup import one_of_each
from loamline.llm.packing import pack
from loamline.llm.pii import redact
from loamline.llm.quality import reject_rows
from loamline.llm.queries import vocabulary
from loamline.session import with_package


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned decision list rejects go. Null and empty texts have no words and go; a null id
    is no reason; with no or one-sided labels only the base rule rejects; repeated rows are each judged, alike."""
    return reject_rows(docs, with_package(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays, any id before none; of rows that repeat both, one. Null equals empty."""
    with_package(spark)
    return drop_repeats(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of at least 0.8 connect, the one with the largest doc_id stays; of two texts with that id, one.
    Documents without an id or without words have no links and stay."""
    with_package(spark)
    return one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked; no row goes. Null texts stay null, and n_chars follows the text."""
    with_package(spark)
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences, a row for each piece of a document in them, with its ids. A null text is the end token alone, a null
    source is a source of its own."""
    with_package(spark)
    return pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("personal_data", personal_data), ("packing", packing)]

#: Learned rules, similarity links, spans and tokens aren't expressible; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; what each keeps is written to the shared folder and read again by the next. What a stage
    wrote on its way, and what it read, is deleted as soon as its result is written."""
    docs, read = with_package(spark).read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with tables_written() as own:
            docs = materialize(stage(spark, docs, sf_dir), name)
        discard(*read, *(t for t in own if t is not docs))
        read = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
