"""The reference graph: edges, neighbours, expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import string_only, value_to_string
from ..sources.shared import checkpointed


def graph_edges(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """(src, dst): references between known entities; parallel ones collapse,
    loops stay."""
    e = facts.where(F.col("predicate").startswith("ref:")).select(F.col("subject").alias("src"), string_only(F.col("object_json")).alias("dst"))
    e = e.where("dst IS NOT NULL").distinct()
    ids = entities.select("id")
    return e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


def expand(edges: DataFrame, entities: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(id, distance) of all entities within ``hops`` of a seed, either way.

    One join per hop on the frontier only; each hop's lineage is cut, and the
    search ends early when nothing new is found."""
    seen = checkpointed(seeds.select("id").distinct().join(entities.select("id"), "id", "left_semi").withColumn("distance", F.lit(0)))
    both = edges.select(F.col("src").alias("id"), F.col("dst").alias("next")).union(edges.select(F.col("dst").alias("id"), F.col("src").alias("next")))
    front = seen.select("id")
    for hop in range(1, hops + 1):
        found = both.join(front, "id", "left_semi").select(F.col("next").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        found = checkpointed(found.withColumn("distance", F.lit(hop)))
        if found.isEmpty():
            break
        seen, front = seen.unionByName(found), found.select("id")
    return seen.orderBy("distance", "id")


def incoming_refs(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """(target, subject, predicate, subject_type, adapter, confidence) of every
    reference, an unknown subject's type being empty; objects may be quoted or bare."""
    f = facts.where(F.col("predicate").startswith("ref:")).select(value_to_string(F.col("object_json")).alias("target"), "subject", "predicate", "adapter", "confidence")
    t = entities.select(F.col("id").alias("subject"), "entity_type")
    return f.join(t, "subject", "left").select("target", "subject", "predicate", F.coalesce("entity_type", F.lit("")).alias("subject_type"), "adapter", "confidence")


def incoming_of(facts: DataFrame, entities: DataFrame, target: str) -> DataFrame:
    return incoming_refs(facts, entities).where(F.col("target") == target).orderBy("predicate", "subject")


def neighbours_of(facts: DataFrame, ids: list[str]) -> DataFrame:
    """(of, id): ``neighbours`` of each of a few ids, in one pass."""
    refs = facts.where(F.col("predicate").startswith("ref:")).select("subject", value_to_string(F.col("object_json")).alias("target"))
    out = refs.where(F.col("subject").isin(ids)).select(F.col("subject").alias("of"), F.col("target").alias("id"))
    return out.union(refs.where(F.col("target").isin(ids)).select(F.col("target").alias("of"), F.col("subject").alias("id"))).where("id <> of").distinct()


def neighbours(facts: DataFrame, entity_id: str) -> DataFrame:
    """Targets and sources of an entity's references, without itself."""
    refs = facts.where(F.col("predicate").startswith("ref:")).select("subject", value_to_string(F.col("object_json")).alias("target"))
    out = refs.where(F.col("subject") == entity_id).select(F.col("target").alias("id"))
    return out.union(refs.where(F.col("target") == entity_id).select(F.col("subject").alias("id"))).where(F.col("id") != entity_id).distinct()
