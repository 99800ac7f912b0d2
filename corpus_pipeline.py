"""A corpus pipeline: every stage works on all that its predecessor kept.

Defined results, in every stage: a null text is an empty one; a null id is an id
like any other, but that nothing is learned from its rows; rows that repeat id and
text are one document for the dedup stages, which keep one, and rows of their own for
the others; of equal ids with different texts each is a document; an empty table
gives no rows; other columns, of any name, pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skymatch.llm import line_dedup, mixing, packing, quality, simhash
from skymatch.llm.common import materialise, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.accepted(docs, model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines seen before, in this or an earlier document, go; every document stays."""
    return line_dedup.clean(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose sets of 5-word shingles have a similarity of 0.8 or more, directly or by steps, one stays."""
    return simhash.keep_one(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rare domains are repeated up to their target weights; every document stays at least once."""
    return mixing.mixed(docs, table(spark, sf_dir, "labels"), least=1.0)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens, each with the corpus's mixture of sources."""
    return packing.pack(docs, "byte_bpe_50k.json")


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_domains),
    ("packing", pack_sequences),
]

#: Learned scores, edit distances and tokenizers have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", F.col("n_chars"))
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
