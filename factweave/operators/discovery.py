"""What records' fields are: identifiers and references, from the data alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import json_string, value_to_string
from .keyed import few


def discover_schemas(records: DataFrame) -> DataFrame:
    """(path, schema, id_column) of ``records(path, schema, pos, fields)``: the
    first candidate key of a file's first record that is present, non-empty and
    distinct in all its records.

    Candidates, best first: id, <schema>_id, <one>_id, <schema>Id, <one>Id in any
    case (<one> being the schema without its last letters s), then any key that
    ends in id; ties go to the least name. Values are counted by key before they
    are compared, so the pass has a map-side combine and no record travels."""
    r = records.select("path", "schema", "pos", "fields")
    n = r.groupBy("path", "schema").agg(F.count("*").alias("n"), F.map_keys(F.min_by("fields", "pos")).alias("first"))
    one = F.regexp_replace(F.lower("schema"), "s+$", "")
    low, s = F.lower("key"), F.lower("schema")
    rank = (
        F.when(low == "id", 0).when(low == F.concat(s, F.lit("_id")), 1).when(low == F.concat(one, F.lit("_id")), 2)
        .when(low == F.concat(s, F.lit("id")), 3).when(low == F.concat(one, F.lit("id")), 4).when(low.endswith("id"), 5)
    )
    keys = n.select("path", "schema", "n", F.explode("first").alias("key")).withColumn("rank", rank).where("rank IS NOT NULL")
    keys = few(keys)
    cells = r.select("path", F.explode("fields").alias("key", "obj")).join(keys.select("path", "key"), ["path", "key"], "left_semi")
    vals = cells.select("path", "key", value_to_string(F.col("obj")).alias("v")).where("v <> ''").groupBy("path", "key", "v").agg(F.count("*").alias("c"))
    good = vals.groupBy("path", "key").agg(F.sum("c").alias("total"), F.max("c").alias("most")).where("most = 1")
    picked = keys.join(good, ["path", "key"]).where("total = n").groupBy("path").agg(F.min_by("key", F.struct("rank", "key")).alias("id_column"))
    return n.select("path", "schema").join(picked, "path", "left")


def discover_id(df: DataFrame, schema: str) -> str | None:
    """The id column of a table, or None: ``discover_schemas`` with its rows as
    records. Only columns that can be candidates are read."""
    columns = [c for c in df.columns if c.lower().endswith("id")]
    if not columns:
        return None
    fields = F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[json_string(F.col(f"`{c}`").cast("string")) for c in columns]))
    found = discover_schemas(df.select(F.lit("").alias("path"), F.lit(schema).alias("schema"), F.monotonically_increasing_id().alias("pos"), fields.alias("fields"))).first()
    return found["id_column"] if found else None


def id_index(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(schema, id) of all tables with an id column."""
    parts = [df.select(F.lit(s).alias("schema"), F.col(c).cast("string").alias("id")).where("id <> ''") for s, (df, c) in sorted(tables.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def fk_columns(cells: DataFrame, ids: DataFrame, sample: int = 20) -> DataFrame:
    """(path, key, target, hits) of ``cells(path, schema, key, pos, v)``: the schema
    whose ``ids(schema, id)`` at least half of a key's first ``sample`` non-empty
    values (by pos) hit, most hits first, then by name; the own schema is no
    target. The rank limit is applied before the shuffle, so a long column brings
    ``sample`` rows a task."""
    first = cells.where("v <> ''").withColumn("rn", F.row_number().over(Window.partitionBy("path", "key").orderBy("pos"))).where(F.col("rn") <= sample)
    size = first.groupBy("path", "key").agg(F.count("*").alias("n"))
    targets = ids.select(F.col("schema").alias("target"), F.col("id").alias("v")).distinct()
    hits = first.join(targets, "v").where("target <> schema").groupBy("path", "key", "target").agg(F.count("*").alias("hits"))
    best = F.row_number().over(Window.partitionBy("path", "key").orderBy(F.desc("hits"), "target"))
    good = hits.join(size, ["path", "key"]).where("hits * 2 >= n")
    return good.withColumn("rn", best).where("rn = 1").select("path", "key", "target", "hits")


def detect_fks(df: DataFrame, own: str, ids: DataFrame, order: str, sample: int = 20) -> DataFrame:
    """(column, target, hits) of a table: ``fk_columns`` with its rows by ``order``."""
    columns = [c for c in df.columns if c != order]
    cell = F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns]))
    cells = df.select(F.col(order).alias("pos"), cell.alias("x")).select(F.lit("").alias("path"), F.lit(own).alias("schema"), "x.key", "pos", "x.v")
    return fk_columns(cells, ids, sample).select(F.col("key").alias("column"), "target", "hits")
