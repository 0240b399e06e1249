"""Values that contradict one another: evidence, detection, decisions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keyed import few, named

@dataclass(frozen=True)
class ResolverConfig:
    """Fixed defaults: how far each kind of source is trusted, and the least
    confidence that counts."""

    source_priority: dict[str, int] = field(default_factory=lambda: {"csv": 100, "json": 100, "pdf": 50, "txt": 50, "llm": 20})
    min_confidence: float = 0.7


def _typed(rows: DataFrame, entities: DataFrame) -> DataFrame:
    return rows.join(entities.select(F.col("id").alias("subject"), "entity_type"), "subject")


def multivalue_evidence(facts: DataFrame, entities: DataFrame, cardinality: DataFrame, subjects: int = 5, values: int = 5) -> DataFrame:
    """(entity_type, predicate, samples): value lists of the first subjects that
    have several values, for pairs that aren't classified yet."""
    new = facts.where(~F.col("predicate").startswith("ref:"))
    distinct = new.select("predicate", "subject", "object_json").distinct()
    # Ranks come before lists: no list is longer than it has to be.
    nth = F.row_number().over(Window.partitionBy("predicate", "subject").orderBy("object_json"))
    ranked = distinct.withColumn("rn", nth).where(F.col("rn") <= max(values, 2))
    per = ranked.groupBy("predicate", "subject").agg(F.max("rn").alias("n"), F.sort_array(F.collect_list(F.when(F.col("rn") <= values, F.col("object_json")))).alias("vals")).where("n >= 2")
    per = _typed(per, entities).join(few(cardinality.select("predicate", "entity_type").distinct()), ["predicate", "entity_type"], "left_anti")
    which = F.row_number().over(Window.partitionBy("entity_type", "predicate").orderBy("subject"))
    first = per.withColumn("rn", which).where(F.col("rn") <= subjects)
    return first.groupBy("entity_type", "predicate").agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "vals"))), lambda x: x["vals"]).alias("samples"))


def detect_conflicts(facts: DataFrame, entities: DataFrame, cardinality: DataFrame, recorded: DataFrame | None = None) -> DataFrame:
    """(subject, predicate, fact_a_id, fact_b_id), a before b, of unlike values
    under scalar predicates. Only groups with several values are joined, and only
    their subjects' types are looked up."""
    scalar = few(cardinality.where("cardinality = 'scalar'").select("predicate", "entity_type").distinct())
    f = named(facts.where(~F.col("predicate").startswith("ref:")), "predicate", scalar).select("id", "subject", "predicate", "object_json")
    groups = f.groupBy("subject", "predicate").agg(F.min("object_json").alias("x"), F.max("object_json").alias("y")).where("x <> y").select("subject", "predicate")
    groups = _typed(groups, entities).join(scalar, ["predicate", "entity_type"], "left_semi").select("subject", "predicate").distinct()
    f = f.join(groups, ["subject", "predicate"])
    a = f.select(F.col("id").alias("fact_a_id"), "subject", "predicate", F.col("object_json").alias("oa"))
    b = f.select(F.col("id").alias("fact_b_id"), "subject", "predicate", F.col("object_json").alias("ob"))
    pairs = a.join(b, ["subject", "predicate"]).where("fact_a_id < fact_b_id AND oa <> ob").select("subject", "predicate", "fact_a_id", "fact_b_id")
    if recorded is not None:
        pairs = pairs.join(recorded.select("fact_a_id", "fact_b_id"), ["fact_a_id", "fact_b_id"], "left_anti")
    return pairs.select("subject", "predicate", "fact_a_id", "fact_b_id")


def _priority(adapter: str, cfg: ResolverConfig) -> Column:
    out = F.lit(0)
    for name, p in sorted(cfg.source_priority.items()):
        out = F.when(F.col(adapter) == name, p).otherwise(out)
    return out


def decide(cfg: ResolverConfig = ResolverConfig()) -> Column:
    """a, b or inbox from adapter_a, conf_a, at_a and the same of b: the better
    source, else the only confident one, else the newer."""
    pa, pb = _priority("adapter_a", cfg), _priority("adapter_b", cfg)
    oa, ob = F.col("conf_a") >= cfg.min_confidence, F.col("conf_b") >= cfg.min_confidence
    pick = lambda c: F.when(c, "a").otherwise("b")
    return (
        F.when(pa != pb, pick(pa > pb)).when(oa != ob, pick(oa)).when(F.col("at_a") != F.col("at_b"), pick(F.col("at_a") > F.col("at_b"))).otherwise("inbox")
    )


def conflict_sides(conflicts: DataFrame, facts: DataFrame) -> DataFrame:
    side = lambda s: facts.select(
        F.col("id").alias(f"fact_{s}_id"), F.col("object_json").alias(f"object_{s}"), F.col("adapter").alias(f"adapter_{s}"),
        F.col("confidence").alias(f"conf_{s}"), F.col("observed_at").alias(f"at_{s}"),
    )
    return conflicts.join(side("a"), "fact_a_id").join(side("b"), "fact_b_id")


def resolve(conflicts: DataFrame, facts: DataFrame, cfg: ResolverConfig = ResolverConfig()) -> DataFrame:
    """``conflicts`` decided: decision, and prefer:<fact id> where it isn't inbox."""
    d = conflict_sides(conflicts, facts).withColumn("decision", decide(cfg))
    keep = F.when(F.col("decision") == "a", F.col("fact_a_id")).when(F.col("decision") == "b", F.col("fact_b_id"))
    return d.select(*conflicts.columns, "decision", F.concat(F.lit("prefer:"), keep.cast("string")).alias("preferred"))


def recommended_side() -> Column:
    """What a reviewer is shown as the better side: confidence, then recency."""
    return (
        F.when(F.col("conf_a") != F.col("conf_b"), F.when(F.col("conf_a") > F.col("conf_b"), "a").otherwise("b"))
        .when(F.col("at_a") > F.col("at_b"), "a").when(F.col("at_a") < F.col("at_b"), "b")
    )


def unresolved(conflicts: DataFrame) -> DataFrame:
    return conflicts.where("resolved_at IS NULL").orderBy("id")


def recent_resolutions(facts: DataFrame, since: int | None = None, limit: int = 100, below: float = 0.9) -> DataFrame:
    """The newest grounded links still to be looked at. The limit comes before
    the confidence filter, and confidences are compared in single precision."""
    f = facts.where("adapter = 'llm-resolve'")
    if since is not None:
        f = f.where(F.col("observed_at") >= since)
    newest = f.orderBy(F.desc("observed_at"), F.desc("id")).limit(limit)
    c = F.col("confidence").cast("float").cast("double")
    return newest.where((c > 0) & (c < below))
