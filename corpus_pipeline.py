"""The corpus pipeline: five operators in a row, each over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm import langid, linededup, ngramjoin, packing, toxicity
from postloom.llm.common import read_table, stored

#: Words of the lines that the pipeline compares within one edit.
SHORTEST_LINE = 8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows without a letter (null and empty texts too), and long ones that need more bits a character than texts of a learned language.

    Repeated rows stay or go together; without any label, and in an empty table, no row stays.
    """
    return langid.keep_identified(docs, langid.train(docs))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows predicted toxic; null and empty texts have nothing toxic and stay, repeated rows stay or go together, without a toxic label all rows stay."""
    return toxicity.keep_clean(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes later duplicates of lines; rows of which no line stays go, for earlier rows hold all they said.  n_chars follows the text.

    Lines of fewer than eight words go only if they are equal to an earlier one: one replaced word of few makes another text, and short clean documents stay.
    Rows without a line (null, empty or blank texts) stay; repeated (doc_id, text) rows keep the same lines.
    """
    lines_, left = ("_" * (1 + max(map(len, docs.columns))) + x for x in ("lines", "kept"))
    found = linededup.dedup(docs, shortest=SHORTEST_LINE, counts=(lines_, left))
    changed = F.col(left) < F.col(lines_)
    kept = found.where((F.col(left) > 0) | (F.col(lines_) == 0))
    return kept.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five words, 0.8) stays: that of the smallest doc_id.

    Rows without a word (null, empty and blank texts) are near copies only of rows equal to them in doc_id and text; of repeated rows one stays.
    Rows with a null doc_id stay; an empty table gives no rows.
    """
    return ngramjoin.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each row goes: doc_id, piece, size, shard, bin_id, bin_pos.  Null and empty texts take one token, repeated rows are packed each; an empty table gives no rows."""
    return packing.packed_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("toxicity", toxic),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("packing", packed),
]

#: The classifiers, the automata and the packing are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
