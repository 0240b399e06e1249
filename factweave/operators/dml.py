"""Changes to a store's tables, each as a function from tables to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import json_string
from ..sources.shared import checkpointed
from .keyed import few


def delta_status(incoming: DataFrame, documents: DataFrame) -> DataFrame:
    """(path, content_hash, status): cached where path and hash are known, stale
    where only the path is, else fresh."""
    per = documents.groupBy("path").agg(F.collect_set("content_hash").alias("hashes"))
    status = F.when(F.col("hashes").isNull(), "fresh").when(F.array_contains("hashes", F.col("content_hash")), "cached").otherwise("stale")
    return incoming.join(per, "path", "left").select("path", "content_hash", status.alias("status"))


def removals(tables: dict[str, DataFrame], paths: DataFrame) -> dict[str, DataFrame]:
    """What goes with the documents of ``paths``, as the store removes it: their ids
    from documents and facts, and the ids of conflicts that touch those facts."""
    docs = few(tables["documents"].join(paths.select("path"), "path", "left_semi").select("id").distinct())
    facts = tables["facts"].join(docs.select(F.col("id").alias("document_id")), "document_id").select("id")
    touched = [tables["conflicts"].join(facts.select(F.col("id").alias(c)), c, "left_semi").select("id") for c in ("fact_a_id", "fact_b_id")]
    return {"documents": docs, "facts": docs.select(F.col("id").alias("document_id")), "conflicts": touched[0].unionByName(touched[1])}


def cascade_delete(tables: dict[str, DataFrame], paths: DataFrame) -> dict[str, DataFrame]:
    """documents, facts and conflicts without what comes from ``paths``."""
    gone_docs = few(tables["documents"].join(paths.select("path"), "path", "left_semi").select(F.col("id").alias("document_id")).distinct())
    gone = tables["facts"].join(gone_docs, "document_id").select("id")
    return tables | {
        "documents": tables["documents"].join(paths.select("path"), "path", "left_anti").select(*tables["documents"].columns),
        "facts": tables["facts"].join(gone_docs, "document_id", "left_anti").select(*tables["facts"].columns),
        "conflicts": without_facts(tables["conflicts"], gone),
    }


def without_facts(conflicts: DataFrame, gone: DataFrame) -> DataFrame:
    """Conflicts that touch none of the facts ``gone(id)``."""
    a, b = gone.select(F.col("id").alias("fact_a_id")), gone.select(F.col("id").alias("fact_b_id"))
    return conflicts.join(a, "fact_a_id", "left_anti").join(b, "fact_b_id", "left_anti").select(*conflicts.columns)


def new_rows(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """The rows of ``new`` whose key ``old`` lacks, each key's first by ``order``
    only (without one, the least row). First rows are found by a partial
    aggregation, so repeats of a key don't travel."""
    rest = [c for c in old.columns if c not in keys and c in new.columns]
    fresh = new.join(old.select(*keys), keys, "left_anti")
    if not order and not rest:
        return fresh.select(*keys).distinct()
    first = F.min(F.struct(*([F.col(order).alias("_o")] if order else []), *rest)).alias("_x")
    return fresh.groupBy(*keys).agg(first).select(*keys, *[F.col(f"_x.{c}").alias(c) for c in rest])


def insert_new(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """``old`` and the ``new_rows``."""
    return old.unionByName(new_rows(old, new, keys, order), allowMissingColumns=True)


def keep_latest(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of ``old`` replaced by those of ``new`` with the same key, last by
    ``order``, ties by the largest other values."""
    rest = [c for c in old.columns if c not in keys]
    top = F.max(F.struct(F.col(order).alias("_o"), *rest)).alias("_x")
    last = new.groupBy(*keys).agg(top).select(*keys, *[F.col(f"_x.{c}").alias(c) for c in rest]).select(*old.columns)
    return old.join(new.select(*keys).distinct(), keys, "left_anti").select(*old.columns).unionByName(last)


def number_on(new: DataFrame, order: list[str], top: int) -> DataFrame:
    """``new`` with ids from ``top`` + 1 on, in ``order``; a column ``id`` is replaced.

    Ranges are drawn anew whenever a plan runs, so the ranged rows are written
    once, each with its range and its place there; the ranges' sizes are counted
    on what was written, and no row passes through one sorted task."""
    ranged = new.drop("id").repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    fixed = checkpointed(ranged.withColumns({"_range": F.spark_partition_id(), "_place": place}))
    sizes = {r["_range"]: r["n"] for r in fixed.groupBy("_range").agg(F.count("*").alias("n")).collect()}  # a row for each range
    base, starts = int(top), []
    for p in sorted(sizes):
        starts.append((p, base))
        base += sizes[p]
    at = fixed.sparkSession.createDataFrame(starts, "_range int, _start long")
    ided = fixed.join(F.broadcast(at), "_range")  # as many rows as ranges
    return ided.withColumn("id", (F.col("_start") + F.col("_place") + 1).cast("long")).drop("_range", "_place", "_start")


def top_id(df: DataFrame) -> int:
    return df.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]


def numbered(facts: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """``new`` in the columns of ``facts``, with ids that go on from the largest
    one; columns that it lacks are null."""
    ided = number_on(new, order, top_id(facts))
    have = set(ided.columns)
    return ided.select(*[F.col(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in facts.dtypes])


def append_facts(facts: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """``facts`` and ``new`` with ids that go on from the largest one."""
    return facts.unionByName(numbered(facts, new, order))


def clear_llm(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Without everything that models said: facts, their conflicts, the section
    cache, derived aliases."""
    gone = tables["facts"].where(F.col("adapter").isin("llm", "llm-resolve")).select("id")
    return tables | {
        "facts": tables["facts"].where(~F.col("adapter").isin("llm", "llm-resolve")), "conflicts": without_facts(tables["conflicts"], gone),
        "section_cache": tables["section_cache"].where(F.lit(False)), "entity_aliases": tables["entity_aliases"].where("source <> 'derived'"),
    }


def clear_reconciled(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    gone = tables["facts"].where("adapter = 'alias-reconcile'").select("id")
    return tables | {"facts": tables["facts"].where("adapter <> 'alias-reconcile'"), "conflicts": without_facts(tables["conflicts"], gone)}


def clear_cardinality(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Before predicates are classified again: no cardinalities, and only the
    conflicts that have been resolved."""
    return tables | {
        "predicate_cardinality": tables["predicate_cardinality"].where(F.lit(False)), "conflicts": tables["conflicts"].where("resolved_at IS NOT NULL"),
    }


def suppress_fact(facts: DataFrame, subject: str, predicate: str, target: str) -> DataFrame:
    """Confidence 0 for a model's link; the row stays."""
    hit = (F.col("adapter") == "llm-resolve") & (F.col("subject") == subject) & (F.col("predicate") == predicate) & (F.col("object_json") == json_string(F.lit(target)))
    return facts.withColumn("confidence", F.when(hit, F.lit(0.0)).otherwise(F.col("confidence")))


def resolve_conflict(conflicts: DataFrame, conflict_id: int, resolution: str, at: int) -> DataFrame:
    hit = F.col("id") == conflict_id
    return conflicts.withColumn("resolved_at", F.when(hit, F.lit(at)).otherwise(F.col("resolved_at"))).withColumn("resolution", F.when(hit, F.lit(resolution)).otherwise(F.col("resolution")))


def entity_page(entities: DataFrame, entity_type: str, q: str | None = None, offset: int = 0, limit: int = 100) -> DataFrame:
    """A page of ``entities_like`` in order, of at most 1,000 ids."""
    return entities_like(entities, entity_type, q).orderBy("id").offset(offset).limit(min(limit, 1000))


def entities_like(entities: DataFrame, entity_type: str, q: str | None = None) -> DataFrame:
    """A type's ids; ``q`` is a LIKE pattern's middle."""
    e = entities.where(F.col("entity_type") == entity_type)
    return (e.where(F.col("id").like(f"%{q}%")) if q else e).select("id")


def entities_holding(entities: DataFrame, entity_type: str, contains: str | None = None) -> DataFrame:
    """Ids of a type that hold ``contains`` literally, in any case."""
    e = entities.where(F.col("entity_type") == entity_type)
    return (e.where(F.contains(F.lower("id"), F.lower(F.lit(contains)))) if contains else e).select("id")
