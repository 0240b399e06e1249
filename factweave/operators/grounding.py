"""What a model returned about a text, checked against the text and the aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import f32, json_string, normalize_alias

RESULT = "section string, entity_id string, evidence_span string, confidence double"


def ground_refs(found: DataFrame, sections: DataFrame, entities: DataFrame, aliases: DataFrame, observed_at: int = 0) -> DataFrame:
    """Reference facts from ``found(section, entity_id, evidence_span, confidence)``
    and ``sections(section, parent_subject, text)``: the entity is known and not
    the parent, the span stands in the text and holds an alias of the entity."""
    span = F.trim("evidence_span")
    j = found.join(sections, "section").join(entities.select(F.col("id").alias("entity_id"), "entity_type"), "entity_id")
    j = j.where((F.col("entity_id") != F.col("parent_subject")) & (span != "") & F.contains(F.lower("text"), F.lower(span)))
    j = j.withColumn("span_norm", normalize_alias(span))
    # Aliases of one entity only: the join is on the entity, and any that the span holds will do.
    known = aliases.select(F.col("entity_id").alias("owner"), "alias_norm")
    ok = j.join(known, (F.col("entity_id") == F.col("owner")) & F.contains("span_norm", "alias_norm"), "left_semi")
    raw = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence")))
    conf = F.when(raw >= 0.9, f32(raw)).otherwise(f32(raw.cast("float") * F.lit(0.9).cast("float")))
    return ok.select(
        "section", F.col("parent_subject").alias("subject"), F.concat(F.lit("ref:"), "entity_type").alias("predicate"), json_string(F.col("entity_id")).alias("object_json"),
        F.lit("llm-resolve").alias("adapter"), conf.alias("confidence"), F.lit(observed_at).cast("long").alias("observed_at"), F.col("evidence_span").alias("locator"),
        "entity_id", F.col("confidence").alias("raw_confidence"),
    )


def learned_aliases(grounded: DataFrame) -> DataFrame:
    """Aliases that confident spans teach."""
    span = F.trim("locator")
    g = grounded.where((F.col("raw_confidence") >= 0.8) & (F.length(span) <= 60)).withColumn("alias_norm", normalize_alias(span))
    g = g.where((F.octet_length("alias_norm") >= 2) & (F.lower("alias_norm") != F.lower("entity_id")))
    return g.select("entity_id", span.alias("alias"), "alias_norm", F.lit("derived").alias("source"), F.when(F.col("raw_confidence") >= 0.9, 1.0).otherwise(0.7).alias("confidence"))


def uncached(sections: DataFrame, cache: DataFrame, most: int | None = None) -> DataFrame:
    """Sections still to be worked on: the first ``most`` by id, less those known
    by their hash (known ones use up the number too)."""
    s = sections.orderBy("section").limit(most) if most is not None else sections
    return s.withColumn("section_hash", F.sha2("text", 256)).join(cache.select("section_hash"), "section_hash", "left_anti")
