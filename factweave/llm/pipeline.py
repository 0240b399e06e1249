"""The stages of the corpus pipeline. Each takes (spark, docs, sf_dir) and returns
a DataFrame; all columns of documents stay, whatever else is among them, until the
last one. An empty table goes through all of them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, lines, neardup, packing, toxicity
from .common import discard, remove, shared_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.5 by a model of the labelled documents; all of them
    where the labels give no model (none, or all alike). A null text is scored as
    an empty one; repeated rows share their fate."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    if model.crf is None:
        return docs
    return toxicity.score(docs, model).where("toxicity < 0.5").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that stand earlier in the corpus, equal or
    (lines of five or more words) within one edited word. Null texts stay null; a
    text may become empty; rows that repeat doc_id and text stay alike."""
    return lines.dedup_lines(docs, short_copies=True).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of 0.8 or more similar ones (five-word shingles),
    that of the least doc_id. Null and empty texts are such a group; rows that
    repeat doc_id and text stay together."""
    return neardup.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth stand in benchmark windows.
    Null and empty texts stay; rows of a null doc_id are judged as one."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of what is left, with their sequences and offsets; a null or
    empty text is its end id, and repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the last one's rows. A stage's
    table is removed when the next one's is written, the last one's stays."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        discard(spark)
        if k:
            remove(spark, f"{folder}/{k - 1}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
