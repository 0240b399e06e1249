"""Counts over entities and facts. Ties are broken by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import json_string, value_to_string


def entity_counts(entities: DataFrame) -> DataFrame:
    return entities.groupBy("entity_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity_type")


def predicate_counts(facts: DataFrame, entities: DataFrame, entity_type: str | None = None) -> DataFrame:
    f = facts
    if entity_type is not None:
        f = facts.join(entities.where(F.col("entity_type") == entity_type).select(F.col("id").alias("subject")), "subject", "left_semi")
    return f.groupBy("predicate").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "predicate")


def top_values(facts: DataFrame, predicate: str, limit: int = 20) -> DataFrame:
    return facts.where(F.col("predicate") == predicate).groupBy("object_json").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "object_json").limit(limit)


def matches(value: str):
    """Object equal to ``value`` as a JSON string or as bare text."""
    return (F.col("object_json") == json_string(F.lit(value))) | (F.col("object_json") == value)


def count_with_object(facts: DataFrame, predicate: str, value: str) -> DataFrame:
    return facts.where((F.col("predicate") == predicate) & matches(value)).agg(F.count("*").alias("n"))


def count_predicate(facts: DataFrame, predicate: str, value: str) -> DataFrame:
    """(n): of a reference the rows that point at ``value``, else
    ``count_with_object``."""
    if predicate.startswith("ref:"):
        return facts.where((F.col("predicate") == predicate) & (value_to_string(F.col("object_json")) == value)).agg(F.count("*").alias("n"))
    return count_with_object(facts, predicate, value)


def summary(**tables: DataFrame) -> DataFrame:
    """(name, n) of every table given."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


def source_counts(facts: DataFrame) -> DataFrame:
    """Distinct adapters by entity."""
    return facts.groupBy("subject").agg(F.countDistinct("adapter").alias("source_count"))
