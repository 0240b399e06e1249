"""Alias derivation, labels and alias upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import email_local, humanize_email_local, looks_like_alias, normalize_alias, string_or_number
from .keyed import few, named


def alias_field_stats(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity_type, predicate, total, uniq, avg_len, fk_hits) of attribute values.

    Counted in two steps, by value and then by field, so no value set is ever
    held in one place."""
    f = facts.where(~F.col("predicate").startswith("ref:")).select("subject", "predicate", F.trim(string_or_number(F.col("object_json"))).alias("v")).where("v <> ''")
    typed = f.join(entities.select(F.col("id").alias("subject"), "entity_type"), "subject")
    by_value = typed.groupBy("entity_type", "predicate", "v").agg(F.count("*").alias("n"))
    known = entities.select(F.col("id").alias("v"), F.lit(1).alias("hit"))
    return by_value.join(known, "v", "left").groupBy("entity_type", "predicate").agg(
        F.sum("n").alias("total"), F.count("*").alias("uniq"), (F.sum(F.col("n") * F.length("v")) / F.sum("n")).alias("avg_len"), F.count("hit").alias("fk_hits")
    )


def alias_fields(stats: DataFrame) -> DataFrame:
    """Fields whose values are distinct, of name length, and no foreign keys."""
    ratio = lambda a, b: F.col(a).cast("float") / F.col(b).cast("float")
    ok = (
        (F.col("total") >= 2) & (ratio("uniq", "total").cast("float") >= F.lit(0.8).cast("float")) & F.col("avg_len").between(3, 60)
        & (ratio("fk_hits", "uniq").cast("float") <= F.lit(0.3).cast("float"))
    )
    return stats.where(ok).select("entity_type", "predicate")


def derive_aliases(facts: DataFrame, entities: DataFrame, blocklist: DataFrame | None = None, fields: DataFrame | None = None) -> DataFrame:
    """(entity_id, alias, alias_norm, source, confidence): ids, values of alias
    fields, and what e-mail addresses tell; the first in that order, then by
    fact id, wins for each entity and normal form. ``fields`` are the alias fields
    where they are known already."""
    if fields is None:
        fields = few(alias_fields(alias_field_stats(facts, entities)))
    owner = entities.select(F.col("id").alias("entity_id"), "entity_type")
    vals = named(facts, "predicate", fields).select("id", "subject", "predicate", F.trim(string_or_number(F.col("object_json"))).alias("v")).where("v <> ''")
    # One join by entity: it brings an entity's values beside its id, and what follows is dealt by entity already.
    rows = owner.join(vals, owner["entity_id"] == vals["subject"], "left").join(fields.select("entity_type", "predicate", F.lit(True).alias("is_field")), ["entity_type", "predicate"], "left")
    rows = rows.withColumn("local", F.when(F.col("is_field"), email_local(F.col("v"))))

    def alias(of: Column, source: Column, confidence: float, fid: Column, rank: int) -> Column:
        return F.struct(of.alias("alias"), normalize_alias(of).alias("alias_norm"), source.alias("source"), F.lit(confidence).alias("confidence"), fid.alias("fid"), F.lit(rank).alias("rank"))

    mail, fid = F.lit("email_local"), F.col("id")
    by_id = alias(F.col("entity_id"), F.lit("id"), 1.0, F.lit(-1).cast("long"), 0)
    by_field = alias(F.col("v"), F.concat(F.lit("field:"), "predicate"), 1.0, fid, 0)
    by_mail = alias(humanize_email_local(F.col("local")), mail, 0.7, fid, 1), alias(F.col("local"), mail, 0.9, fid, 2)
    rows = rows.select("entity_id", F.explode(F.when(F.col("is_field"), F.array(by_id, by_field, *by_mail)).otherwise(F.array(by_id))).alias("x")).select("entity_id", "x.*")
    rows = rows.where((F.octet_length("alias_norm") >= 2) & ((F.col("source") == "id") | looks_like_alias(F.col("alias_norm"))))
    if blocklist is not None:
        rows = rows.join(blocklist.select("alias_norm", "entity_id"), ["alias_norm", "entity_id"], "left_anti")
    first = F.row_number().over(Window.partitionBy("entity_id", "alias_norm").orderBy("fid", "rank"))
    return rows.withColumn("rn", first).where("rn = 1").select("entity_id", "alias", "alias_norm", "source", "confidence")


def upsert_aliases(old: DataFrame, new: DataFrame, seq: str = "seq") -> DataFrame:
    """By entity and normal form the last alias and source, the highest confidence."""
    cols = ["entity_id", "alias", "alias_norm", "source", "confidence"]
    both = old.select(*cols, F.lit(-1).cast("long").alias("seq")).unionByName(new.select(*cols, F.col(seq).cast("long").alias("seq")))
    last = F.max_by(F.struct("alias", "source"), "seq")
    return both.groupBy("entity_id", "alias_norm").agg(last.alias("x"), F.max("confidence").alias("confidence")).select("entity_id", "x.alias", "alias_norm", "x.source", "confidence")


def entity_labels(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, label): the best field alias, else the best other, else the id."""
    order = Window.partitionBy("entity_id").orderBy(F.desc(F.col("source").startswith("field:")), F.desc("confidence"), "alias")
    best = aliases.where("source <> 'id'").withColumn("rn", F.row_number().over(order)).where("rn = 1").select(F.col("entity_id").alias("id"), "alias")
    return entities.select("id").join(best, "id", "left").select("id", F.coalesce("alias", "id").alias("label"))


def aliases_for(aliases: DataFrame, entity_id: str) -> DataFrame:
    return aliases.where(F.col("entity_id") == entity_id).orderBy(F.desc("confidence"), "alias")


def with_type(aliases: DataFrame, entities: DataFrame) -> DataFrame:
    return aliases.join(entities.select(F.col("id").alias("entity_id"), "entity_type"), "entity_id")
