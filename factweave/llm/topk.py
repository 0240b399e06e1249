"""Exact top-k inner-product search with pivot-table elimination."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import blocks
from .common import table

#: Rows that pivots are chosen from and that give each query its first threshold.
SEEDS = 2_048
#: Largest magnitude of a sum of products that doubles hold exactly.
EXACT = 2.0**53
TILE = "block long, ids binary, vecs binary, least binary, dims int"


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, x): whole components floor(scale * c) as doubles. Rows with a null
    id, a null vector, or null, NaN or infinite components are left out."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", finite)

    def whole(c):
        v = c.cast("double") * scale
        return F.when(F.abs(v) < EXACT, F.floor(v).cast("double")).otherwise(v)  # beyond, a double is whole already

    return vectors.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", whole).alias("x"))


def _matrix(col: pa.Array) -> np.ndarray:
    """A list column as a float64 matrix; shorter vectors are padded with zeros."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = np.diff(col.offsets.to_numpy())
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(n), int(n.max(initial=0))))
    out[np.arange(out.shape[1])[None, :] < n[:, None]] = flat
    return out


def _wide(m: np.ndarray, d: int) -> np.ndarray:
    return np.pad(m, ((0, 0), (0, d - m.shape[1]))) if m.shape[1] < d else m


def dots(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All inner products: in doubles where those are exact, else in whole numbers,
    those beyond 64 bits as the largest or least of them."""
    top = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1])
    if top < EXACT:
        return (q @ x.T).astype(np.int64)
    whole = lambda m: np.array([[int(c) for c in r] for r in m], dtype=object).reshape(m.shape)
    got = np.dot(whole(q), whole(x).T) if q.shape[1] else np.zeros((len(q), len(x)), object)
    return np.clip(got, -(2**63), 2**63 - 1).astype(np.int64)


def spread(sample: np.ndarray, n: int) -> np.ndarray:
    """At most ``n`` rows far from each other: each the farthest from those chosen."""
    if not len(sample):
        return sample
    picked, near = [0], np.full(len(sample), np.inf)
    while len(picked) < min(n, len(sample)):
        near = np.minimum(near, ((sample - sample[picked[-1]]) ** 2).sum(1))
        if near.max() <= 0:
            break
        picked.append(int(near.argmax()))
    return sample[picked]


@dataclass
class Pivots:
    """The pivots, and an orthonormal basis of the span of the first of them. A
    vector's distances to those pivots and to the origin fix its coordinates there
    and its distance from the span, so the basis holds what the table says of all
    of them together."""

    points: np.ndarray
    basis: np.ndarray

    @classmethod
    def of(cls, sample: np.ndarray, n: int, joint: float = 0.95) -> Pivots:
        points = spread(sample, n)
        m = min(len(points), int(joint * points.shape[1])) if len(points) else 0
        basis, r = np.linalg.qr(points[:m].T) if m else (np.zeros((sample.shape[1], 0)), np.zeros((0, 0)))
        return cls(points, basis[:, np.abs(np.diag(r)) > 1e-9 * max(1.0, np.abs(r).max(initial=0))])

    def table(self, m: np.ndarray) -> np.ndarray:
        """Distances of each row to each pivot."""
        square = (m**2).sum(1)[:, None] + (self.points**2).sum(1)[None, :] - 2 * m @ self.points.T
        return np.sqrt(np.maximum(square, 0))

    def place(self, m: np.ndarray) -> np.ndarray:
        """Coordinates in the span, and the distance from it."""
        c = m @ self.basis
        return np.column_stack([c, np.sqrt(np.maximum((m**2).sum(1) - (c**2).sum(1), 0))])


def _merge(best: list, q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int, n: int) -> tuple[list, np.ndarray]:
    """The k best of each query from those so far and new ones, and the k-th score."""
    row, cid, got = (np.concatenate([x, y]) for x, y in zip(best, (q, ids, scores), strict=True))
    order = np.lexsort((cid, ~got, row))  # not -got: the least whole number has no negative
    row, cid, got = row[order], cid[order], got[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    keep = place < k
    least = np.full(n, -np.inf)
    last = place == k - 1
    least[row[last]] = got[last]
    return [row[keep], cid[keep], got[keep]], least


class Tile:
    """Candidates by nearest pivot, with their pivot table: distances' range by
    group, place of each in the pivots' span."""

    def __init__(self, x: np.ndarray, xid: np.ndarray, pivots: Pivots):
        self.pivots, self.norm = pivots, np.sqrt((x**2).sum(1))
        self.x, self.xid, self.starts = x, xid, np.zeros(min(1, len(x)), np.int64)
        self.usable = bool(len(pivots.points) and len(x) and self.norm.max() < 1e15)
        if not self.usable:  # without pivots, or beyond the range of their arithmetic
            return
        table = pivots.table(x)
        group = table.argmin(1)
        order = np.argsort(group, kind="stable")
        self.x, self.xid, self.norm, table, group = x[order], xid[order], self.norm[order], table[order], group[order]
        self.starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        self.low, self.high = np.minimum.reduceat(table, self.starts), np.maximum.reduceat(table, self.starts)
        self.longest = np.maximum.reduceat(self.norm, self.starts)
        self.place = pivots.place(self.x).astype(np.float32)

    def reach(self, q: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """For each query and group the most that a score can be."""
        dq, gap = self.pivots.table(q), np.zeros((len(q), len(self.starts)))
        for p in range(dq.shape[1]):
            np.maximum(gap, np.maximum(dq[:, p, None] - self.high[None, :, p], self.low[None, :, p] - dq[:, p, None]), out=gap)
        size = norm[:, None] ** 2 + self.longest[None, :] ** 2
        # a distance is a root of a difference: its error goes with the norms
        error = 2e-7 * (norm[:, None] + self.longest[None, :] + 2 * np.sqrt((self.pivots.points**2).sum(1).max()))
        return (size - np.maximum(gap - error, 0) ** 2) / 2 * (1 + 1e-9) + 1


def search_tile(q: np.ndarray, qid: np.ndarray, tile: Tile, k: int, least: np.ndarray | None = None, lot: int = 4_096):
    """(query ids, ids, scores, evaluated): of the tile's rows those that may be
    among the k best of each row of ``q`` (its own id is no candidate), and how
    many pairs were evaluated. ``least`` is a score that each query's k-th is
    known to reach.

    2 q.x = |q|^2 + |x|^2 - d(q, x)^2, so a lower bound of the distance bounds the
    score from above. For a group of candidates with the same nearest pivot the
    bound is the largest gap, over all pivots, between d(q, p) and the group's
    range of d(x, p); groups are taken in falling order of the score's bound, in
    rounds of about ``lot`` candidates, until no query's bound reaches its k-th
    score. Within a round each pair is bounded by the least distance that two
    vectors of such pivot distances can have, which no single pivot's gap exceeds,
    and what still reaches the k-th score is evaluated exactly.
    """
    n, evaluated, x, xid, nx, starts = len(q), 0, tile.x, tile.xid, tile.norm, tile.starts
    least = np.full(n, -np.inf) if least is None else least.astype(np.float64).copy()
    best = [np.zeros(0, np.int64)] * 3
    if not n or not len(x):
        return qid[:0], xid[:0], np.zeros(0, np.int64), 0
    nq = np.sqrt((q**2).sum(1))
    if tile.usable and nq.max() < 1e15:
        reach, placed_q, placed_x = tile.reach(q, nq), tile.pivots.place(q).astype(np.float32), tile.place
    else:
        reach, placed_q = np.full((n, len(starts)), np.inf), None
    ends = np.append(starts[1:], len(x))
    todo = np.argsort(-reach.max(0), kind="stable").tolist()
    while todo:
        round_, count = [], 0
        while todo and count < lot:
            g = todo.pop(0)
            if (reach[:, g] >= least).any():
                round_.append(g)
                count += ends[g] - starts[g]
        if not round_:
            break
        at = np.concatenate([np.arange(starts[g], ends[g]) for g in round_])
        ask = np.flatnonzero((reach[:, round_] >= least[:, None]).any(1))
        may = np.repeat(reach[np.ix_(ask, round_)] >= least[ask, None], [ends[g] - starts[g] for g in round_], axis=1) & (xid[at][None, :] != qid[ask][:, None])
        if placed_q is not None:
            bound = placed_q[ask] @ placed_x[at].T
            # single precision: a rounding for each coordinate of the product, and of the places
            room = np.float32(2.5e-7 * (placed_x.shape[1] + 16))
            bound += (room * nq[ask].astype(np.float32))[:, None] * nx[at].astype(np.float32)[None, :] + np.float32(1)
            may &= bound >= least[ask, None]
            if not np.isfinite(least[ask]).all():  # nothing to compare with yet: the highest bounds first
                first = np.argpartition(np.where(may, -bound, np.inf), min(4 * k, len(at) - 1), axis=1)[:, : 4 * k]
                ahead = np.zeros_like(may)
                np.put_along_axis(ahead, first, True, axis=1)
                row, col = np.nonzero(may & ahead)
                scores = _pairs(q, x, ask[row], at[col])
                evaluated += len(row)
                best, new = _merge(best, ask[row], xid[at[col]], scores, k, n)
                least = np.maximum(least, new)
                may &= ~ahead & (bound >= least[ask, None])
        row, col = np.nonzero(may)
        evaluated += len(row)
        if len(row) > may.size // 8:
            cols, back = np.unique(col, return_inverse=True)
            scores = dots(q[ask], x[at[cols]])[row, back]
        else:
            scores = _pairs(q, x, ask[row], at[col])
        keep = scores >= least[ask[row]]
        best, new = _merge(best, ask[row[keep]], xid[at[col[keep]]], scores[keep], k, n)
        least = np.maximum(least, new)
    return qid[best[0]], best[1], best[2], evaluated


def _pairs(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the named pairs."""
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1]) >= EXACT:
        return np.array([dots(q[a : a + 1], x[b : b + 1])[0, 0] for a, b in zip(i.tolist(), j.tolist(), strict=True)], dtype=np.int64)
    return np.concatenate([np.einsum("md,md->m", q[i[a : a + 65_536]], x[j[a : a + 65_536]]) for a in range(0, len(i), 65_536)] or [np.zeros(0)]).astype(np.int64)


def _tiles(rows: DataFrame, most: int, n: int, seeds: tuple[np.ndarray, np.ndarray] | None = None, k: int = 0) -> DataFrame:
    """(block, ids, vecs, least, dims): the vectors in blocks of at most ``most``, in
    ``n`` parts by hash and sorted, so that a task that runs again cuts the same ones.
    With ``seeds`` (ids, vectors) each row gets the k-th best of its scores among them."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: list[tuple] = []
        number = TaskContext.get().partitionId() - n

        def block(parts: list[tuple]) -> pa.RecordBatch:
            nonlocal number
            number += n
            ids, d = np.concatenate([i for i, _ in parts]), max(m.shape[1] for _, m in parts)
            m, least = np.vstack([_wide(m, d) for _, m in parts]), np.zeros(0)
            if seeds is not None:
                d2 = max(d, seeds[1].shape[1])
                s = dots(_wide(m, d2), _wide(seeds[1], d2)).astype(np.float64)
                s[ids[:, None] == seeds[0][None, :]] = -np.inf
                least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] >= k else np.full(len(m), -np.inf)
                least = np.where(np.abs(least) < EXACT, least, -np.inf)  # a rounded one might be too high
            return pa.RecordBatch.from_pydict({
                "block": pa.array([number], pa.int64()), "ids": [ids.astype("<i8").tobytes()],
                "vecs": [m.astype("<f4" if np.abs(m).max(initial=0) < 2**24 else "<f8").tobytes()], "least": [least.astype("<f8").tobytes()], "dims": pa.array([d], pa.int32()),
            })

        for b in batches:
            ids, m = b.column("vec_id").to_numpy(), _matrix(b.column("x"))
            for a in range(0, len(ids), most):
                held.append((ids[a : a + most], m[a : a + most]))
                if sum(len(i) for i, _ in held) >= most:
                    yield block(held)
                    held = []
        if held:
            yield block(held)

    return rows.select("vec_id", "x").repartition(n, F.xxhash64("vec_id", "x")).sortWithinPartitions("vec_id", "x").mapInArrow(build, TILE)


def _load(ids: bytes, vecs: bytes, dims: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, "<i8")
    kind = "<f4" if len(vecs) == 4 * len(i) * dims else "<f8"
    return i, np.frombuffer(vecs, kind).reshape(len(i), dims).astype(np.float64)


def exact_topk(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, pivots: int = 256, tile: int = 8_192, query_tile: int = 2_048) -> DataFrame:
    """The ``k`` largest inner products of each query among all other rows.

    ``vectors(vec_id, embedding)``; queries are the rows whose id ``every``
    divides. Result: query_id, rank (from 1), vec_id, score; ties go to the
    smaller vec_id. Left out are rows that ``quantised`` leaves out; vectors of
    unequal length count as padded with zeros; a query meets no row of its own
    id; a repeated query id counts once (with its least vector), repeated
    candidates stay; scores beyond 64 bits count as the largest or least of them.
    An empty table gives no rows; other columns are ignored.

    The stated query set meets all rows in blocks: candidates and queries are
    packed in tiles of bounded size, which meet in a grid of four cells a core, and
    a pair of tiles brings at most k rows per query to the final ranking. A query's first threshold comes from at
    most SEEDS rows and travels with it.
    """
    spark = vectors.sparkSession
    v = quantised(vectors, scale)
    q = v.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("x").alias("x"))
    total, asked = v.count(), q.count()
    # Pivots and first thresholds: a bounded sample of the rows, by hash.
    seeds = v.orderBy(F.xxhash64("vec_id"), "x").limit(SEEDS).collect()
    d = max((len(r["x"]) for r in seeds), default=0)
    seed_ids, sample = np.array([r["vec_id"] for r in seeds], np.int64), np.array([[*r["x"], *[0.0] * (d - len(r["x"]))] for r in seeds]).reshape(len(seeds), d)
    # a row of an id that stands twice may be the query's own copy: each id once
    once = np.unique(seed_ids, return_index=True)[1]
    table_of_pivots = Pivots.of(np.clip(sample, -1e15, 1e15), pivots)

    cells = 4 * spark.sparkContext.defaultParallelism
    # a tile's rows share their bounds and thresholds, so small tiles cost more than they spread
    (rows, parts), (lot, q_parts) = blocks.sizes(total, tile, min(cells, total // 8_192)), blocks.sizes(asked, query_tile, 1)
    qt = _tiles(q, lot, q_parts, (seed_ids[once], sample[once]), k)
    pairs = blocks.paired(qt, _tiles(v, rows, parts), q_parts, parts, cells)

    def search(parts_: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts_:
            for r in p.itertuples():
                (xid, x), (qid, qv), least = _load(r.their_ids, r.their_vecs, r.their_dims), _load(r.ids, r.vecs, r.dims), np.frombuffer(r.least, "<f8")
                wide = max(x.shape[1], qv.shape[1], table_of_pivots.points.shape[1])
                pv = Pivots(_wide(table_of_pivots.points, wide), np.pad(table_of_pivots.basis, ((0, wide - table_of_pivots.basis.shape[0]), (0, 0))))
                qv, table_ = _wide(qv, wide), Tile(_wide(x, wide), xid, pv)
                for a in range(0, len(qid), 256):
                    got = search_tile(qv[a : a + 256], qid[a : a + 256], table_, k, least[a : a + 256])
                    yield pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), got[:3], strict=True)))

    # names without a leading underscore, as itertuples() needs them
    pairs = pairs.select("ids", "vecs", "least", "dims", *[F.col(f"_{c}").alias(f"their_{c}") for c in ("ids", "vecs", "dims")])
    local = pairs.mapInPandas(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of every twentieth vector."""
    return exact_topk(table(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: floor(64 * c::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) WHERE rank <= 20
"""
