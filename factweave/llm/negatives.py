"""Hard negatives for anchors: rows of another label scored just under a positive."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import blocks
from .common import table
from .topk import EXACT, dots

#: Rows in a tree, anchors in a block, rows in a leaf, at most.
TREE, ANCHORS, LEAF = 8_192, 2_048, 256
FOUND = pa.schema([("anchor_id", pa.int64()), ("slot", pa.int32()), ("positive_id", pa.int64()), ("positive_score", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])


def usable(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(id, vec, label): whole components floor(scale * c) as doubles. Rows with a
    null id, label or vector, or null, NaN or infinite components are left out."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))

    def whole(c):
        v = c.cast("double") * scale
        return F.when(F.abs(v) < EXACT, F.floor(v).cast("double")).otherwise(v)  # beyond, a double is whole already

    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", finite)
    return vectors.where(ok).select(F.col("vec_id").cast("long").alias("id"), F.transform("embedding", whole).alias("vec"), F.col("label").cast("long").alias("label"))


@dataclass
class VpTree:
    """A vantage-point tree over rows augmented by the root of M^2 - |x|^2, M being
    the largest norm: with a zero added to q, d(q, x)^2 = |q|^2 + M^2 - 2 q.x, so a
    score is a distance and a window of scores an annulus.

    Rows are in the order of the leaves, which begin at ``starts``. Node j's children
    are 2j+1 (the half nearer to its vantage point) and 2j+2, the last nodes being the
    leaves, whose vantage point is the row nearest to their middle; ``low`` and
    ``high`` hold for each leaf the range of its rows' distances to the vantage points
    from the root on to its own: narrower than the halves that nodes were cut in."""

    x: np.ndarray
    top: float
    vantage: np.ndarray
    low: np.ndarray
    high: np.ndarray
    starts: np.ndarray
    order: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, leaf: int = LEAF) -> VpTree:
        square = np.einsum("ij,ij->i", x, x)
        top = float(square.max(initial=0))
        far = np.column_stack([x, np.sqrt(np.maximum(top - square, 0))])
        depth = max(0, int(np.ceil(np.log2(max(1, len(x)) / leaf))))
        inner = 2**depth - 1
        vantage, parts = np.zeros(2 * inner + 1, np.int64), [np.arange(len(x))]
        for j in range(2 * inner + 1):
            rows, by = parts[j], np.zeros(0, np.int64)
            if len(rows):
                off = ((far[rows] - far[rows].mean(0)) ** 2).sum(1)
                vantage[j] = rows[np.argmax(off) if j < inner else np.argmin(off)]  # the outermost row parts the others well
                by = np.argsort(((far[rows] - far[vantage[j]]) ** 2).sum(1), kind="stable")
            if j < inner:
                parts += [rows[by[: (len(by) + 1) // 2]], rows[by[(len(by) + 1) // 2 :]]]
        leaves = parts[inner:]
        low, high = np.full((len(leaves), depth + 1), np.inf), np.full((len(leaves), depth + 1), -np.inf)
        for n, rows in enumerate(leaves):
            for t, j in enumerate(_above(depth)[n]):
                d = np.sqrt(((far[rows] - far[vantage[j]]) ** 2).sum(1))
                low[n, t], high[n, t] = d.min(initial=np.inf), d.max(initial=-np.inf)
        order = np.concatenate(leaves)
        return cls(x[order], top, np.argsort(order)[vantage], low, high, np.cumsum([0, *map(len, leaves)]), order)

    def reach(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of ``q`` and leaf the least and the most that a score can be;
        anything beyond the arithmetic's range."""
        size = np.einsum("ij,ij->i", q, q) + self.top
        leaves, depth = self.low.shape
        near, far = np.zeros((len(q), leaves)), np.full((len(q), leaves), np.inf)
        d = np.sqrt(np.maximum(size[:, None] - 2 * q @ self.x[self.vantage].T, 0)) if len(self.x) else near
        error = 1e-7 * np.sqrt(size)[:, None]  # of a root of a difference
        for t in range(depth):
            dt = d[:, _above(depth - 1)[:, t]]
            near = np.maximum(near, np.maximum(self.low[:, t] - dt, dt - self.high[:, t]) - error)
            far = np.minimum(far, dt + self.high[:, t] + error)
        room = 1e-9 * size[:, None] + 1
        with np.errstate(invalid="ignore"):
            least, most = (size[:, None] - far**2) / 2 - room, (size[:, None] - near**2) / 2 + room
        wild = ~(size < 1e30)
        least[wild], most[wild] = -np.inf, np.inf
        return least, most


def _above(depth: int) -> np.ndarray:
    """The nodes from the root to each leaf."""
    leaf = np.arange(2**depth)[:, None] + 2**depth
    return (leaf >> np.arange(depth, -1, -1)[None, :]) - 1


class Search:
    """Incremental nearest-first traversals for the rows of ``q``; a leaf's scores
    are computed once for each row, however many windows look at it."""

    def __init__(self, tree: VpTree, q: np.ndarray, ids: np.ndarray):
        self.tree, self.q, self.ids = tree, q, ids
        self.least, self.most = tree.reach(q)
        self.order = np.argsort(-self.most, axis=1, kind="stable")
        self.opened, self.seen = 0, {}

    def start(self, i: int) -> None:
        self.i, self.seen = i, {}

    def _leaf(self, leaf: int) -> tuple[np.ndarray, np.ndarray]:
        if leaf not in self.seen:
            a, b = self.tree.starts[leaf], self.tree.starts[leaf + 1]
            self.opened += b - a
            self.seen[leaf] = dots(self.q[self.i : self.i + 1], self.tree.x[a:b])[0], np.arange(a, b)
        return self.seen[leaf]

    def nearest(self, take: np.ndarray, k: int, low: int | None = None, high: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the first ``k`` of the rows marked in ``take`` that score
        from ``low`` to ``high``: leaves are opened by falling bound, those wholly
        inside or outside the annulus never, until no leaf left can hold a better
        row than the k-th."""
        ids, scores, cut = np.zeros(0, np.int64), np.zeros(0, np.int64), -np.inf if low is None else low
        for leaf in self.order[self.i]:
            if self.most[self.i, leaf] < cut:
                break
            if high is not None and self.least[self.i, leaf] > high:
                continue
            s, at = self._leaf(leaf)
            keep = take[at] & (s >= cut)
            if high is not None:
                keep &= s <= high
            if not keep.any():
                continue
            ids, scores = np.concatenate([ids, self.ids[at[keep]]]), np.concatenate([scores, s[keep]])
            first = np.lexsort((ids, ~scores))[:k]
            ids, scores = ids[first], scores[first]
            if len(scores) == k:
                cut = max(cut, scores[-1])
        return ids, scores


def _window(positive: int, share: tuple[int, int]) -> tuple[int, int]:
    """The least and largest whole score s with a * p <= b * s <= b * p."""
    a, b = share
    return -(-a * positive // b), positive


def _trees(rows: DataFrame, size: int, parts: int) -> DataFrame:
    """Blocks of rows as trees: their rows in the order of the leaves."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                lens = row.column("lens").flatten().to_numpy()
                t = VpTree.of(blocks.matrix(row.column("vecs")[0].as_py(), lens))
                take = lambda c: pa.array([row.column(c).flatten().to_numpy()[t.order]], pa.list_(pa.int64()))  # noqa: B023, E731
                kind = "<f4" if np.abs(t.x).max(initial=0) < 2**24 else "<f8"
                yield pa.RecordBatch.from_pydict({
                    "block": row.column("block"), "x": [t.x.astype(kind).tobytes()], "dims": pa.array([t.x.shape[1]], pa.int32()), "top": [t.top],
                    "id": take("id"), "label": take("label"), "vantage": pa.array([t.vantage]), "low": pa.array([t.low.ravel()]), "high": pa.array([t.high.ravel()]), "starts": pa.array([t.starts]),
                })

    schema = "block long, x binary, dims int, top double, id array<long>, label array<long>, vantage array<long>, low array<double>, high array<double>, starts array<long>"
    return blocks.packed(rows, size, parts).mapInArrow(build, schema)


def _search(anchors: DataFrame, trees: DataFrame, n: tuple[int, int], cells: int, k: int, share: tuple[int, int] | None) -> DataFrame:
    """The ``k`` best rows of each anchor that have its label; or with ``share`` the
    ``k`` best of other labels in the window of each of its positives (``wins``,
    their places being the slots). ``place`` counts them."""
    pairs = blocks.paired(anchors, trees, *n, cells)

    def found(row: pa.RecordBatch) -> Iterator[tuple]:
        flat = lambda c: row.column(c).flatten().to_numpy()
        q, qid, qlabel, ids, labels = blocks.matrix(row.column("vecs")[0].as_py(), flat("lens")), flat("id"), flat("label"), flat("_id"), flat("_label")
        x, dims = row.column("_x")[0].as_py(), row.column("_dims")[0].as_py()
        x = np.frombuffer(x, "<f4" if len(x) == 4 * len(ids) * dims else "<f8").astype(np.float64).reshape(len(ids), dims)
        wide = max(q.shape[1], dims)
        starts = flat("_starts")
        low, high = (flat(c).reshape(len(starts) - 1, -1) for c in ("_low", "_high"))
        tree = VpTree(blocks.widened(x, wide), row.column("_top")[0].as_py(), flat("_vantage"), low, high, starts, np.arange(len(ids)))
        search = Search(tree, blocks.widened(q, wide), ids)
        wins = row.column("wins")[0].as_py() if share else None
        for j in range(len(q)):
            search.start(j)
            if share is None:
                for at in zip(*search.nearest((labels == qlabel[j]) & (ids != qid[j]), k), strict=True):
                    yield qid[j], 0, None, None, *at
            else:
                other = (labels != qlabel[j]) & (ids != qid[j])
                for w in wins[j]:
                    for at in zip(*search.nearest(other, k, *_window(w["score"], share)), strict=True):
                        yield qid[j], w["place"], w["id"], w["score"], *at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                columns = list(zip(*found(b.slice(i, 1)), strict=True)) or [()] * len(FOUND)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FOUND, strict=True)], schema=FOUND)

    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "id")
    rows = pairs.mapInArrow(run, "anchor_id long, slot int, positive_id long, positive_score long, id long, score long")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100), scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of
    ``vectors(vec_id, embedding, label)``, for the rows where ``anchor`` (of vec_id)
    holds.

    A score is the whole inner product with the anchor; higher ones come first, ties
    go to the smaller id. Positives are an anchor's first rows of its label; each gets
    the first rows of other labels that score at most as high as it and at least
    ``share`` of that. Left out are the rows that ``usable`` leaves out. An id that
    stands twice is one anchor (its least vector and label), no row of the anchor's
    own id is taken, repeated rows are each taken; shorter vectors count as padded
    with zeros, scores beyond 64 bits as the largest or least of them. An empty table
    and anchors without positives give no rows; other columns are ignored.

    Rows are packed once, in trees of bounded size, and meet blocks of anchors dealt
    in a grid; a tree and anchor bring at most ``negatives`` rows for each positive to
    the ranking."""
    v = usable(vectors, scale)
    asked = v.where(anchor).groupBy("id").agg(F.min(F.struct("vec", "label")).alias("a")).select("id", "a.vec", "a.label")
    cells = 4 * v.sparkSession.sparkContext.defaultParallelism
    total, n = v.count(), asked.count()
    (size, parts), (rows, lots) = blocks.sizes(total, TREE, cells), blocks.sizes(n, ANCHORS, 1)
    trees = _trees(v, size, parts)
    first = _search(blocks.packed(asked, rows, lots), trees, (lots, parts), cells, positives, None)
    wins = first.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("wins"))  # ``positives`` at most
    again = asked.join(wins, asked["id"] == wins["anchor_id"]).select("id", "vec", "label", "wins")
    second = _search(blocks.packed(again, rows, lots), trees, (lots, parts), cells, negatives, share)
    return second.select("anchor_id", "positive_id", F.col("place").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The negatives of every hundredth vector; every seventh vector's label is moved on."""
    v = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(v.withColumn("label", moved), F.col("id") % 100 == 0)


OP11_SQL = """
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.x, c.x)::BIGINT AS score FROM v a JOIN v c ON c.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score QUALIFY rank <= 5
"""
