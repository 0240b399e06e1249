"""Small tables of keys: joins that deal nothing by them."""

from pyspark.sql import functions as F

from factweave.operators import conflicts, discovery, dml, keyed


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def dealt_by(df, *columns):
    """Whether a shuffle goes by just these columns."""
    import re

    return [h for h in re.findall(r"hashpartitioning\(([^)]*)\)", plan(df)) if [c.split("#")[0].strip() for c in h.split(",")[:-1]] == list(columns)]


def tables(spark):
    facts = spark.range(400).select(
        "id", F.concat(F.lit("e"), F.col("id") % 100).alias("subject"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("predicate"),
        F.concat(F.lit('"'), F.floor(F.col("id") / 200), F.lit('"')).alias("object_json"), (F.col("id") % 4).alias("document_id"),
    )
    entities = spark.range(90).select(F.concat(F.lit("e"), "id").alias("id"), F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("entity_type"))
    kinds = spark.createDataFrame([("a", "x", "scalar"), ("b", "y", "list")], "predicate string, entity_type string, cardinality string")
    return facts, entities, kinds


def test_few_looks_at_the_size(spark):
    keys = spark.range(5).select(F.col("id").alias("k"))
    assert sorted(r.k for r in keyed.few(keys, 5).collect()) == sorted(r.k for r in keyed.few(keys, 4).collect()) == [0, 1, 2, 3, 4]
    assert keyed.few(keys, 4) is keys
    df = spark.createDataFrame([("a",), ("b",), (None,)], "p string")
    assert [r.p for r in keyed.named(df, "p", spark.createDataFrame([("b",), (None,)], "p string")).collect()] == ["b"]
    assert keyed.named(df, "p", df, 1) is df


def test_facts_are_not_dealt_by_predicate(spark):
    facts, entities, kinds = tables(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = conflicts.detect_conflicts(facts, entities, kinds)
        rows = facts.toPandas().merge(entities.toPandas(), left_on="subject", right_on="id", suffixes=("", "_e")).query("predicate == 'a' and entity_type == 'x'")
        pairs = rows.merge(rows, on=["subject", "predicate"]).query("id_x < id_y and object_json_x != object_json_y")
        assert sorted((r.fact_a_id, r.fact_b_id) for r in found.collect()) == sorted(zip(pairs.id_x, pairs.id_y, strict=True)) != []
        assert not dealt_by(found, "predicate", "entity_type")
        samples = conflicts.multivalue_evidence(facts, entities, kinds)
        assert {(r.entity_type, r.predicate) for r in samples.collect()} == {("x", "b"), ("y", "a")}
        store = {"documents": spark.range(4).select("id", F.concat(F.lit("f"), "id").alias("path")), "facts": facts, "conflicts": found}
        left = dml.cascade_delete(store, spark.createDataFrame([("f3",)], "path string"))["facts"]
        assert left.count() == 300 and not dealt_by(left, "document_id")
        assert discovery.discover_id(facts.select("id", F.col("document_id").alias("other_id")), "t") == "id"
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
