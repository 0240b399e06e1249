"""Records to entities and facts, and scans over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import json_string

FACT_COLUMNS = ["subject", "predicate", "object_json", "adapter", "confidence", "observed_at"]


def to_object(df: DataFrame, column: str) -> Column:
    """A typed column as canonical JSON text. Decimals keep their digits."""
    kind, c = df.schema[column].dataType, F.col(column)
    if isinstance(kind, T.StringType):
        return json_string(c)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return json_string(c.cast("string"))
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.coalesce(F.to_json(c), F.lit("null"))
    return F.coalesce(c.cast("string"), F.lit("null"))


def emit_facts(df: DataFrame, entity_type: str, id_column: str, fks: dict[str, str] | None = None, adapter: str = "json", observed_at: int = 0) -> DataFrame:
    """One fact per record and non-id column, in column order; a foreign-key
    column becomes ``ref:<target type>``. Null values are facts with object null;
    rows without an id are left out. One pass, no shuffle. Of a single column the
    predicate is a literal, so that a filter by it reads that column or nothing."""
    named = [(i, f"ref:{(fks or {})[c]}" if c in (fks or {}) else c, to_object(df, c)) for i, c in enumerate(x for x in df.columns if x != id_column)]
    if len(named) == 1:
        # Exploded all the same: filters are then worked out on the text and not each time from its column.
        ordinal, predicate, values = F.lit(named[0][0]).alias("ord"), F.lit(named[0][1]).alias("predicate"), F.array(named[0][2])
        obj = F.col("x").alias("object_json")
    else:
        ordinal, predicate, obj = F.col("x.ord"), F.col("x.predicate"), F.col("x.object_json")
        values = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(p).alias("predicate"), o.alias("object_json")) for i, p, o in named])
    return df.where(F.col(id_column).isNotNull()).select(
        F.col(id_column).cast("string").alias("subject"), F.lit(entity_type).alias("entity_type"), F.explode(values).alias("x")
    ).select(
        "subject", "entity_type", predicate, obj, F.lit(adapter).alias("adapter"), F.lit(1.0).alias("confidence"),
        F.lit(observed_at).cast("long").alias("observed_at"), ordinal,
    )


def facts_for_subject(facts: DataFrame, subject: str) -> DataFrame:
    return facts.where(F.col("subject") == subject).orderBy("predicate", "id")


def fact_meta(facts: DataFrame, fact_id: int) -> DataFrame:
    return facts.where(F.col("id") == fact_id).select("id", "adapter", "confidence", "observed_at")


def ref_facts(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("predicate").startswith("ref:")).select("subject", "predicate", "object_json")


def long_text_fields(cells: DataFrame, min_chars: int = 200, min_ratio: float = 0.5) -> DataFrame:
    """Fields of ``cells(field, value)`` whose non-empty values are long texts in
    at least ``min_ratio`` of the cases."""
    v = F.trim("value")
    known = cells.where(v != "")
    ratio = F.avg((F.length(v) >= min_chars).cast("double"))
    return known.groupBy("field").agg(ratio.alias("ratio")).where(F.col("ratio") >= min_ratio).select("field").orderBy("field")


def text_jobs(records: DataFrame, id_column: str, entity_type: str, fields: list[str], min_chars: int = 200) -> DataFrame:
    """(parent_subject, parent_type, field, text, locator) for each long value."""
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields])
    return records.select(F.col(id_column).cast("string").alias("parent_subject"), F.explode(cells).alias("x")).where(
        F.length(F.trim("x.text")) >= min_chars
    ).select(
        "parent_subject", F.lit(entity_type).alias("parent_type"), "x.field", "x.text",
        F.concat(F.lit(f"{id_column}="), "parent_subject", F.lit("/"), F.col("x.field")).alias("locator"),
    )


def section_jobs(sections: DataFrame) -> DataFrame:
    """Jobs of text sections under a synthetic ``document`` parent."""
    return sections.select(
        F.col("path").alias("parent_subject"), F.lit("document").alias("parent_type"), F.coalesce("locator", F.lit("body")).alias("field"), "text", "locator"
    )
