"""The relational sample tables as entities and facts.

Ids get a prefix by type. A fact's id follows from its record's key, its type
and its column, so no global numbering pass is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.facts import emit_facts

# Type: (code, id prefix, key column, columns by predicate, references by predicate).
TYPES = {
    "regions": (0, "REG-", "r_regionkey", {"name": "r_name"}, {}),
    "nations": (1, "NAT-", "n_nationkey", {"name": "n_name", "region": "concat('REG-', n_regionkey)"}, {"region": "regions"}),
    "customers": (2, "CUST-", "c_custkey", {
        "name": "c_name", "segment": "c_mktsegment", "balance": "cast(c_acctbal AS decimal(18,2))",
        "email": "concat('team.customer', c_custkey, '@example.com')", "nation": "concat('NAT-', c_nationkey)",
    }, {"nation": "nations"}),
    "suppliers": (3, "SUPP-", "s_suppkey", {"name": "s_name", "balance": "cast(s_acctbal AS decimal(18,2))", "nation": "concat('NAT-', s_nationkey)"}, {"nation": "nations"}),
    "parts": (4, "PART-", "p_partkey", {"name": "p_name", "brand": "p_brand", "type": "p_type", "size": "p_size"}, {}),
    "orders": (5, "ORD-", "o_orderkey", {
        "status": "o_orderstatus", "priority": "o_orderpriority", "total": "cast(o_totalprice AS decimal(18,2))",
        "contact": "concat('Supplier#', lpad(cast(o_orderkey % 120 AS string), 9, '0'))",
        "note": "concat('Please send this together with what cust-', o_custkey % 1000, ' ordered before, and let supp-', o_orderkey % 100, ' know of it in time.')",
        "customer": "concat('CUST-', o_custkey)",
    }, {"customer": "customers"}),
}
TABLES = {"regions": "region", "nations": "nation", "customers": "customer", "suppliers": "supplier", "parts": "part", "orders": "orders"}
#: Stated, so that a plan needs no look at the files.
SCHEMAS = {
    "region": "r_regionkey int, r_name string", "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string",
}
AT = 1_700_000_000


def records(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """(key, id and the predicate columns) of one type."""
    _, prefix, key, columns, _ = TYPES[kind]
    df = spark.read.schema(SCHEMAS[TABLES[kind]]).parquet(f"{sf_dir}/{TABLES[kind]}.parquet")
    return df.select(F.expr(f"concat('{prefix}', {key})").alias("id"), *[F.expr(x).alias(p) for p, x in columns.items()])


def facts(spark: SparkSession, sf_dir: str, kinds: list[str] | None = None) -> DataFrame:
    """A branch for each column, so that of a filter by predicate only its columns are read."""
    out = None
    for kind in kinds or list(TYPES):
        code, prefix, _, columns, refs = TYPES[kind]
        rows = records(spark, sf_dir, kind)
        key = F.substr("subject", F.lit(len(prefix) + 1)).cast("long")
        for i, p in enumerate(columns):
            f = emit_facts(rows.select("id", p), kind, "id", refs, "json", AT).select(
                ((key * 8 + code) * 8 + i).alias("id"), "subject", "predicate", "object_json", F.lit(None).cast("long").alias("document_id"),
                "adapter", "confidence", "observed_at", F.lit(None).cast("string").alias("locator"),
            )
            out = f if out is None else out.unionByName(f)
    return out


def entities(spark: SparkSession, sf_dir: str, kinds: list[str] | None = None) -> DataFrame:
    out = None
    for kind in kinds or list(TYPES):
        e = records(spark, sf_dir, kind).select("id", F.lit(kind).alias("entity_type"))
        out = e if out is None else out.unionByName(e)
    return out


def disputed(base: DataFrame) -> DataFrame:
    """``base`` and contradicting facts from other sources, by the subject's number."""
    n = F.regexp_extract("subject", "([0-9]+)$", 1).cast("long")
    extra = base.where(F.col("predicate").isin("segment", "status") & (n % 7 == 0)).select(
        (-F.col("id") - 1).alias("id"), "subject", "predicate", F.lit('"DISPUTED"').alias("object_json"), "document_id",
        F.when(n % 3 == 0, "llm").when(n % 3 == 1, "csv").otherwise("txt").alias("adapter"), F.when(n % 2 == 0, 0.9).otherwise(0.5).alias("confidence"),
        (F.col("observed_at") + n % 5 - 2).alias("observed_at"), "locator",
    )
    return base.unionByName(extra)
