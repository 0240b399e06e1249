"""Shared helpers of the corpus operators: table access, ASCII folding,
checkpointing in the shared folder, and distributed connected components."""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; every other code point stays as it is."""
    return F.translate(col, _UPPER, _UPPER.lower())


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished plans now, not at
    the driver's next own collection: they are dead once a plan has been cut."""
    for _ in range(2):  # the first round lets the driver's two sides let go of each other
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and forget its lineage."""
    spark = df.sparkSession
    shared_dir(spark)
    # A frame of its own runs the plan: with it the plan's shuffles can go.
    out = df.select("*").checkpoint(eager=True)
    release(spark)
    return out


_STORED: list[str] = []


def stored(df: DataFrame) -> DataFrame:
    """As ``cut``, as a Parquet table: smaller for wide tables. It stays until
    ``discard``, since what was made of it may not have been computed yet."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STORED.append(path)
    release(df.sparkSession)
    return df.sparkSession.read.parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder, wherever Spark keeps it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(spark: SparkSession) -> None:
    """Remove the tables of ``stored``: for callers that have written all results."""
    while _STORED:
        remove(spark, _STORED.pop())


def spare(df: DataFrame, *names: str) -> list[str]:
    """``names``, each changed until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        n = f"_{n}"
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def lots(texts: list, rows: int = 1_000, chars: int = 4_000_000):
    """(start, stop) of runs of ``texts`` of so many rows and characters at most;
    a longer text is a run of its own."""
    start = held = 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if i > start and (i - start >= rows or held + n > chars):
            yield start, i
            start, held = i, 0
        held += n
    if len(texts) > start:
        yield start, len(texts)


def join_hot(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """``rows`` joined with ``groups``, one row for each key, whose ``count`` says
    how many of the ``total`` rows have that key (it isn't returned).

    Keys of more than a quarter of an average task's rows would fill a task: there
    are at most four times as many of them as tasks, so they are broadcast and
    their rows stay where they are; all other rows are dealt by key."""
    spark = rows.sparkSession
    most = max(1_000, total // (4 * partitions(spark)))
    hot = groups.where(F.col(count) > most).drop(count)
    cold = groups.where(F.col(count) <= most).drop(count)
    if not hot.limit(1).count():
        return rows.join(cold, keys)
    few = F.broadcast(hot)  # bounded by the number of tasks
    return rows.join(few, keys).unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys))


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def connected_components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Components of the undirected graph in ``edges(src, dst)`` (bigint ids).

    Alternating large-star and small-star passes (Kiveris et al., 2014): every
    pass is one partial aggregation and one join on the node, so a hub's edges
    are combined before the shuffle and can be split by the skew join. Returns
    ``(node, root)`` for each node with an edge, ``root`` being the least id of
    the component. Self-loops and nulls are ignored; repeated edges are merged.
    """
    e = edges.where("src is not null and dst is not null and src <> dst").select(
        F.greatest("src", "dst").cast("long").alias("u"), F.least("src", "dst").cast("long").alias("v")
    ).distinct()
    e = cut(e)
    for _ in range(rounds):
        # large star: every larger neighbour of u is linked to u's least neighbour
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u's smaller neighbours, and u, are linked to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = (
            joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .where("u <> v").distinct()
        )
        new = cut(small)
        # stars only: no root has a parent of its own, and no node two parents
        roots = new.select(F.col("v").alias("u")).distinct()
        broken = new.join(roots, "u", "left_semi").limit(1).count() or (
            new.groupBy("u").count().where("count > 1").limit(1).count()
        )
        e = new
        if not broken:
            break
    else:
        raise RuntimeError("connected_components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
