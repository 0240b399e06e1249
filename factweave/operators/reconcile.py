"""References that values and texts imply, by the alias index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import f32, json_string, normalize_alias, string_only
from ..sources.shared import checkpointed
from .aliases import with_type
from .keyed import few
from .mentions import spotted

LONG = 60


def _strings(facts: DataFrame) -> DataFrame:
    return facts.where(~F.col("predicate").startswith("ref:")).select("id", "subject", "predicate", F.trim(string_only(F.col("object_json"))).alias("v")).where("v <> ''")


def _known(rows: DataFrame, entities: DataFrame) -> DataFrame:
    return rows.join(entities.select(F.col("id").alias("subject")), "subject")


def _values(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """String attribute values of known subjects."""
    return _known(_strings(facts), entities)


def alias_owners(aliases: DataFrame, entities: DataFrame) -> DataFrame:
    """(norm, entity_type, owners, one, two): by normal form and type how many have
    it, and the two owners of least id with their confidence. However many own a
    name, it is one row."""
    owner = F.struct("entity_id", "confidence")
    index = with_type(aliases, entities).groupBy(F.col("alias_norm").alias("norm"), "entity_type")
    both = index.agg(F.count("*").alias("owners"), F.min(owner).alias("one"), F.max(owner).alias("last"))
    return both.select("norm", "entity_type", "owners", "one", F.when(F.col("owners") == 2, F.col("last")).alias("two"))


def _named_values(facts: DataFrame) -> DataFrame:
    """Short values of facts, by the normal form under which a name may meet them."""
    return _strings(facts).where(F.length("v") < LONG).select("id", "subject", "predicate", normalize_alias(F.col("v")).alias("norm")).where(F.octet_length("norm") >= 2)


def whole_value_hits(facts: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """By short value: winners (types hit once), their least target, and whether
    it is ambiguous. A type with several hits doesn't veto one with a single hit.

    A value meets one row for each type that knows its name. A subject is no hit
    of its own value, so a type is hit once if it has one owner that isn't the
    subject, or two of which one is."""
    return _hits(_named_values(facts), entities, aliases)


def _hits(short: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    hits = short.join(alias_owners(aliases, entities), "norm")
    mine = (F.col("one.entity_id") == F.col("subject")).cast("int"), (F.col("two.entity_id") == F.col("subject")).cast("int")
    single = F.when((F.col("owners") == 1) & (mine[0] == 0), F.col("one")).when((F.col("owners") == 2) & (mine[0] == 1), F.col("two")).when((F.col("owners") == 2) & (mine[1] == 1), F.col("one"))
    hits = _known(hits.where((F.col("owners") > 1) | (mine[0] == 0)), entities)  # only of hits, most values have none
    won = F.when(single.isNotNull(), F.struct("entity_type", single.getField("entity_id").alias("target"), single.getField("confidence").alias("c")))
    return hits.select("id", "subject", "predicate", won.alias("won")).groupBy("id", "subject", "predicate").agg(F.count("won").alias("winners"), F.min("won").alias("w"))


def ambiguous_values(facts: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, subject, predicate) of short values that name entities, but not one of one type.

    A name with one owner in all is hit once by any value, or by its owner's own
    never. So only names with several owners are met, and where these are few they
    are broadcast and the values dealt by nothing."""
    aliases = checkpointed(aliases.select("entity_id", "alias_norm", "confidence"))  # met twice
    keys = aliases.groupBy("alias_norm").agg(F.count("*").alias("n")).where("n > 1").select("alias_norm")
    shared, short = few(keys), _named_values(facts)
    if shared is not keys:  # else the join with the names is enough
        short = short.join(shared.withColumnRenamed("alias_norm", "norm"), "norm", "left_semi")
    return _hits(short, entities, aliases.join(shared, "alias_norm", "left_semi")).where("winners <> 1").select("id", "subject", "predicate")


def whole_value_refs(facts: DataFrame, entities: DataFrame, aliases: DataFrame, discount: float = 0.9) -> DataFrame:
    return _whole_refs(whole_value_hits(facts, entities, aliases), discount)


def _whole_refs(hits: DataFrame, discount: float) -> DataFrame:
    return hits.where("winners = 1").select("id", "subject", F.concat(F.lit("ref:"), "w.entity_type").alias("predicate"), json_string(F.col("w.target")).alias("object_json"), f32(F.col("w.c").cast("float") * F.lit(discount).cast("float")).alias("confidence"), F.lit(None).cast("string").alias("locator"))


def mention_refs(facts: DataFrame, entities: DataFrame, aliases: DataFrame, discount: float = 0.9, least_conf: float = 0.9, least_chars: int = 5) -> DataFrame:
    """Entities that long values name without ambiguity, longest mention first."""
    index = with_type(aliases, entities)
    sole = index.groupBy(F.col("alias_norm").alias("norm")).agg(F.count("*").alias("n"), F.min(F.struct("entity_id", "entity_type", "confidence")).alias("h")).where("n = 1")
    sole = checkpointed(sole.where((F.col("h.confidence") >= least_conf) & (F.length("norm") >= least_chars)).select("norm", "h.entity_id", "h.entity_type", "h.confidence"))
    texts = _values(facts, entities).where(F.length("v") >= LONG).select("id", "subject", "predicate", F.col("v").alias("text"))
    hits = spotted(texts, sole, ["id", "subject", "predicate"]).join(sole, "norm").where("entity_id <> subject")
    first = F.row_number().over(Window.partitionBy("id", "entity_type", "entity_id").orderBy(F.desc("n"), "pos"))
    return hits.withColumn("rn", first).where("rn = 1").select(
        "id", "subject", F.concat(F.lit("ref:"), "entity_type").alias("predicate"), json_string(F.col("entity_id")).alias("object_json"),
        f32(F.col("confidence").cast("float") * F.lit(discount).cast("float")).alias("confidence"), F.concat(F.lit("mention:"), "predicate").alias("locator"),
    )


def reconcile(facts: DataFrame, entities: DataFrame, aliases: DataFrame, discount: float = 0.9, observed_at: int = 0) -> DataFrame:
    """New reference facts: found, not yet known, each once (by least fact id)."""
    aliases = checkpointed(aliases.select("entity_id", "alias_norm", "confidence"))  # met twice
    found = whole_value_refs(facts, entities, aliases, discount).unionByName(mention_refs(facts, entities, aliases, discount))
    return _fresh(found, facts, observed_at)


def _fresh(found: DataFrame, facts: DataFrame, observed_at: int = 0) -> DataFrame:
    keys = ["subject", "predicate", "object_json"]
    fresh = found.join(facts.where(F.col("predicate").startswith("ref:")).select(*keys).distinct(), keys, "left_anti")
    once = F.row_number().over(Window.partitionBy(*keys).orderBy("id", "locator"))
    return fresh.withColumn("rn", once).where("rn = 1").select(
        *keys, F.lit("alias-reconcile").alias("adapter"), "confidence", F.lit(observed_at).cast("long").alias("observed_at"), "locator"
    )


def reconcile_stats(facts: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """scanned, refs, ambiguous and mentions (both counted before repeats go)."""
    aliases = checkpointed(aliases.select("entity_id", "alias_norm", "confidence"))
    hits, said = checkpointed(whole_value_hits(facts, entities, aliases)), checkpointed(mention_refs(facts, entities, aliases))
    parts = {
        "scanned": _values(facts, entities), "ambiguous": hits.where("winners <> 1"), "mentions": said,
        "emitted": _fresh(_whole_refs(hits, 0.9).unionByName(said), facts),
    }
    out = None
    for name, df in parts.items():
        row = df.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


def text_candidates(sections: DataFrame, entities: DataFrame, aliases: DataFrame, most: int = 200) -> DataFrame:
    """Entities that each text of ``sections(section, text)`` may name: all owners
    of a matching n-gram, longest first, then by place, at most ``most``.

    Of a name's owners only the first ``most`` by type and id can be among a text's:
    each of them stands at that place or before it."""
    owner = F.row_number().over(Window.partitionBy("norm").orderBy("entity_type", "entity_id"))
    index = with_type(aliases, entities).where(F.octet_length("alias_norm") >= 2).select(F.col("alias_norm").alias("norm"), "entity_id", "entity_type", "confidence")
    index = checkpointed(index.withColumn("owner", owner).where(F.col("owner") <= most).drop("owner"))
    hits = spotted(sections.select("section", "text"), index, ["section"]).join(index, "norm")
    first = F.row_number().over(Window.partitionBy("section", "entity_type", "entity_id").orderBy(F.desc("n"), "pos"))
    once = hits.withColumn("rn", first).where("rn = 1")
    place = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("n"), "pos", "entity_type", "entity_id"))
    return once.withColumn("place", place).where(F.col("place") <= most).select("section", "entity_id", "entity_type", "surface", "confidence", "place")
