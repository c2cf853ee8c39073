"""A corpus pipeline: five operators of ``leafmill.llm`` in a row, from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``, which the stage
before it wrote. All but the last return the columns of ``documents``, others that ``docs`` has
included. In every stage an empty table gives an empty result; nulls, ties and repeated rows
have the results that the stage's docstring states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import _tokens
from leafmill.llm._common import materialize, read_table
from leafmill.llm.decontamination import decontaminated
from leafmill.llm.line_dedup import dedup_lines
from leafmill.llm.near_text import keep_one_of_similar
from leafmill.llm.packing import pack
from leafmill.llm.quality_rules import quality_filter


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the fences of their (lang, source) keep.

    A null or empty text has no words and goes; null lang and source are groups of their own;
    rows are judged one by one, so repeated rows stay or go together.
    """
    return quality_filter(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs; one that had nothing else goes.

    The copy with the least doc_id (null first) and place stays. A null text has no lines and
    stays; rows that repeat both doc_id and text count as one document and get the same result.
    """
    done = dedup_lines(docs).where("not (_lm_deleted > 0 and text = '')")
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose five-word shingles have a Jaccard similarity of 0.8 or more.

    The least doc_id of a group stays, a null one only where there is no other; null and empty
    texts are equal; rows that repeat both doc_id and shingles are one.
    """
    return keep_one_of_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates.

    Null and empty texts stay; items without enough words contaminate nothing; repeated rows stay
    or go together; an empty benchmark removes nothing.
    """
    return decontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document, with its sequence and its place there.

    A null or empty text is its end id alone; repeated rows are packed each; null doc_ids stay null.
    """
    return pack(docs, _tokens.tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL cannot express the near-duplicate, tiling and packing stages; tests compare the rows of every
#: stage with plain Python on the stage's own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
