"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept
and returns a DataFrame that is written as Parquet and read again.

In every stage an empty table gives an empty one, rows are decided each by their
own text (ids may repeat or be null, repeated rows share their fate), very long
texts are read whole, and columns beyond the five of ``documents`` are dropped by
name before any other is added, so that clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.llm import decontaminate, linededup, packing, queries, simhash, toxicity
from shardloom.llm.common import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score 0.5 or more; the model is fitted on the labelled documents given.

    Null and empty texts score as texts without features. Without labels of both
    classes the only class known decides (none: every document stays).
    """
    model = toxicity.fit(docs.where(~queries.held_out(5, 0)), table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs.select(COLUMNS), model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated chunks of lines from texts; every document stays.

    The first occurrence (least id, null before all, then place) keeps its text; rows that repeat
    id and text are one occurrence. Null texts stay null; n_chars is counted anew (null for null).
    """
    out = linededup.deduplicate(docs.select(COLUMNS)).drop("removed")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of similar texts (five-word shingles, 0.8 or more).

    Null and empty texts are one group. A row without an id stays only where its whole group has
    none; of rows that share the least id all whose text is of the group stay.
    """
    return simhash.deduplicate(docs.select(COLUMNS), similarity=0.8, shingle=5)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a window of a benchmark item; null and empty texts hold none."""
    return decontaminate.drop_contaminated(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 ids; null texts count as empty (one closing id)."""
    return packing.pack(docs, queries.vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL can express neither the fitted model nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``; each step is written to the shared checkpoint folder and deleted once the next is."""
    docs, forget = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs, done = stored(stage(spark, docs, sf_dir))
        if forget:
            forget()
        forget = done
    return docs
