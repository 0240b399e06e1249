"""Vectors in blocks: a stated query set against a table, without a row per pair."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sizes(n: int, size: int, least: int) -> tuple[int, int]:
    """(rows a block, blocks) for ``n`` rows: at most ``size`` rows a block, fewer
    where that would make fewer than ``least`` blocks."""
    rows = max(64, min(size, -(-n // max(1, least))))
    return rows, max(1, -(-n * 10 // (rows * 9)))  # hash shares differ: a tenth of room


def packed(rows: DataFrame, size: int, parts: int) -> DataFrame:
    """``rows(id, vec, ...)`` in blocks of at most ``size`` rows: (block, vecs, lens,
    and each other column as the array of its values).

    Rows are dealt in ``parts`` by the hash of id and vector and sorted by all
    columns, so a task that runs again cuts the same blocks; blocks are numbered
    from the parts on. ``vecs`` holds all components in a row, in single precision
    where that is exact; a null vector has length -1."""
    others = [c for c in rows.columns if c != "vec"]
    types = {c: rows.schema[c].dataType.simpleString() for c in others}
    schema = ", ".join(["block long", "vecs binary", "lens array<int>", *[f"`{c}` array<{t}>" for c, t in types.items()]])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, count = TaskContext.get().partitionId(), [], 0

        def block() -> pa.RecordBatch:
            nonlocal number
            t = pa.Table.from_batches(held).combine_chunks()
            one = lambda c: c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
            v = one(t.column("vec"))
            lens = np.where(v.is_null().to_numpy(zero_copy_only=False), -1, np.diff(v.offsets.to_numpy()))
            flat = v.flatten().to_numpy(zero_copy_only=False)
            single = flat.astype("<f4")
            exact = np.array_equal(single.astype(np.float64), flat.astype(np.float64), equal_nan=True)
            arrays = [pa.array([number], pa.int64()), pa.array([(single if exact else flat.astype("<f8")).tobytes()]), pa.array([lens.astype(np.int32)], pa.list_(pa.int32()))]
            for c in others:
                arrays.append(pa.ListArray.from_arrays(pa.array([0, len(t)], pa.int32()), one(t.column(c))))
            number += parts
            return pa.RecordBatch.from_arrays(arrays, names=["block", "vecs", "lens", *others])

        for b in batches:
            at = 0
            while at < b.num_rows:
                held.append(b.slice(at, size - count))
                count += held[-1].num_rows
                at += held[-1].num_rows
                if count >= size:
                    yield block()
                    held, count = [], 0
        if count:
            yield block()

    dealt = rows.repartition(parts, F.xxhash64("id", "vec")).sortWithinPartitions("id", "vec", *[c for c in others if c != "id"])
    return dealt.mapInArrow(build, schema)


def matrix(vecs: bytes, lens: np.ndarray) -> np.ndarray:
    """The rows of a block, shorter vectors padded with zeros."""
    n = np.maximum(lens, 0)
    flat = np.frombuffer(vecs, "<f4" if len(vecs) == 4 * int(n.sum()) else "<f8").astype(np.float64)
    wide = int(n.max(initial=0))
    if len(flat) == wide * len(n):
        return flat.reshape(len(n), wide)
    out = np.zeros((len(n), wide))
    out[np.arange(wide)[None, :] < n[:, None]] = flat
    return out


def widened(m: np.ndarray, d: int) -> np.ndarray:
    return np.pad(m, ((0, 0), (0, d - m.shape[1]))) if m.shape[1] < d else m


def paired(left: DataFrame, right: DataFrame, n_left: int, n_right: int, cells: int) -> DataFrame:
    """Each block of ``left`` beside each of ``right``, whose columns other than
    ``block`` get a ``_`` in front. ``n_left`` and ``n_right`` are their numbers of
    parts.

    The blocks are dealt in a grid of about ``cells`` cells, so that a left block is
    copied once for each column and a right one once for each row of the grid: about
    as often as the root of ``cells``, not as there are blocks on the other side.
    Within a cell left blocks come one after another, each with all right ones."""
    down = min(n_left, max(1, round(math.sqrt(cells * n_left / n_right))))
    across = min(n_right, max(1, -(-cells // down)))
    down = min(n_left, max(1, -(-cells // across)))
    cell = (F.col("_down") * across + F.col("_across")).cast("int").alias("cell")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    one = left.withColumn("_down", (F.col("block") % down).cast("int")).withColumn("_across", every(across)).select(cell, *left.columns)
    two = right.withColumn("_across", (F.col("block") % across).cast("int")).withColumn("_down", every(down))
    two = two.select(cell, F.col("block").alias("_block"), *[F.col(c).alias(f"_{c}") for c in right.columns if c != "block"])
    n = down * across
    return one.repartition(n, "cell").join(two.repartition(n, "cell").hint("merge"), "cell").drop("cell")


def best(held: tuple | None, owner: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple:
    """The ``k`` best (owner, id, score) of each owner among those held and new
    ones, by falling score and then id."""
    if held is not None:
        owner, ids, scores = (np.concatenate([a, b]) for a, b in zip(held, (owner, ids, scores), strict=True))
    order = np.lexsort((np.unique(ids, return_inverse=True)[1], -scores, owner))
    owner, ids, scores = owner[order], ids[order], scores[order]
    keep = np.arange(len(owner)) - np.searchsorted(owner, owner) < k
    return owner[keep], ids[keep], scores[keep]
