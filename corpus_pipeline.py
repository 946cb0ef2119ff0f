"""The corpus pipeline: documents in, batches of a deduplicated, mixed corpus out.

Each stage is (name, function); a function takes (spark, docs, sf_dir), works on all rows that
its predecessor kept and returns a DataFrame. All but the last return the columns of
``documents``, and their decisions are in the rows and texts they return.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from questora.llm import mixing, packing, simhash, site_lines, toxicity
from questora.llm.common import stored, table

#: A line on more than this share of a source's documents is boilerplate.
LINE_RATIO = 0.1
#: Near copies: sets of five-word shingles that are so similar.
WORDS, SIMILARITY = 5, simhash.SIMILARITY


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labelled documents.

    Null and empty texts are scored like any other; rows that are repeated are judged each; without a labelled row all stay.
    """
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their source's boilerplate lines; no document goes.

    A null text stays null, an empty one empty; null sources are one source; rows that are repeated count as documents each.
    """
    return site_lines.dedup_texts(docs, F.col("source"), ratio=LINE_RATIO)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of smallest doc_id, of each group of near copies.

    Texts without a word, null ones included, are copies of each other. Of rows of one doc_id those go whose own text has a link to one that stays; rows without a doc_id stay.
    """
    return simhash.keep_one(docs, words=WORDS, least=SIMILARITY)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, whole or in part, as their source's target weight has it.

    Null and empty texts have no words: they count nothing and stay as often as their source's documents do. A null source is a source; rows that are repeated are drawn each.
    """
    return mixing.repeated(docs)


def batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in batches of one padded length: doc_id, seq, start, n_tokens, bucket_len, batch_id, slot.

    A document without words is one piece of length 0; rows that are repeated are pieces each.
    """
    return packing.pack(docs)


STAGES = [("toxicity", toxic), ("line_dedup", lines), ("simhash", near_copies), ("mixing", mix), ("packing", batches)]

#: SQL cannot express the trained classifier or the hash-based groups; tests/llm/test_pipeline.py holds each stage against a plain loop.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{name}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
