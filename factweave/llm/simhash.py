"""SimHash near-duplicates through a segment-popcount embedding.

A fingerprint is mapped to the bit counts of its two-bit segments, an integer
vector of 32 coordinates 0, 1 or 2 whose Manhattan distance is a lower bound of
the fingerprints' Hamming distance. A grid range join under that distance proposes
pairs, the bound drops some, and the Hamming distance decides.

The range join needs no neighbouring cells. Let the coordinates be dealt into
d + 3 blocks. Vectors within Manhattan distance d differ in at most d coordinates,
for each that differs adds at least 1, and so in at most d blocks; on the other 3
or more they agree entirely. So of the grids that look at 3 blocks each, in cells
of width 1, at least one has both vectors in the same cell: the pairs that share a
cell of some grid hold all pairs within the range, with no cell beside it to be
searched. With blocks fewer (cells wider), neighbours would have to be joined; the
choice of 3 makes cells of about 14 coordinates, which keeps them small.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, cut, join_hot, partitions, table

SEEDS = (42, 43)
_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_EVEN = 0x5555555555555555
#: Runs with more links than this for each member get a spanning forest instead.
DENSE = 32


def shingles(text: str | None, words: int) -> list[bytes]:
    """Shingles of ``words`` words, A-Z in lower case, repeats included; fewer
    words give the whole sequence, none give nothing."""
    w = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    if len(w) <= words:
        return [b" ".join(w)] if w else []
    whole, at = b" ".join(w), 0
    starts, ends = [], []
    for x in w:
        starts.append(at)
        at += len(x)
        ends.append(at)
        at += 1
    return [whole[s:e] for s, e in zip(starts, ends[words - 1 :], strict=False)]


def _majority(h: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for a in range(0, len(h), 65_536):
        part = h[a : a + 65_536]
        counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * counts > len(h)).tolist())


def fingerprint(text: str | None, words: int = 4, seed: int = SEEDS[0]) -> int:
    h = np.array([xxhash.xxh64_intdigest(s, seed) for s in shingles(text, words)], dtype=np.uint64)
    return _majority(h)


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint of each whole text as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in b.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def exact_masks(distance: int, free: int = 3) -> list[list[int]]:
    """Coordinate subsets such that vectors within Manhattan ``distance`` agree on
    at least one: the 32 segments in ``distance + free`` blocks, any ``free``."""
    n = distance + free
    blocks = [sum(3 << 2 * s for s in range(32) if s * n // 32 == b) for b in range(n)]
    return [[sum(c)] for c in combinations(blocks, free)]


def sampled_masks(tables: int, segments: int, longs: int = 2, seed: int = 7) -> list[list[int]]:
    """``tables`` random subsets of ``segments`` coordinates."""
    rng = random.Random(seed)
    out = []
    for _ in range(tables):
        m = [0] * longs
        for s in rng.sample(range(32 * longs), segments):
            m[s // 32] |= 3 << 2 * (s % 32)
        out.append(m)
    return out


def _embed(x: np.ndarray) -> np.ndarray:
    """Bit counts of the two-bit segments, each in its own two bits."""
    return (x & np.uint64(_EVEN)) + ((x >> np.uint64(1)) & np.uint64(_EVEN))


def _manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of packed coordinates 0, 1, 2: |a - b| as the bits of a
    unary code, 0 -> 00, 1 -> 01, 2 -> 11."""
    unary = lambda e: (e | (e >> np.uint64(1))) & np.uint64(_EVEN) | (e & np.uint64(_EVEN << 1))
    return np.bitwise_count(unary(a) ^ unary(b))


def _near(fps: np.ndarray, emb: np.ndarray, i, j, limit: int) -> np.ndarray:
    """Which of the index pairs are within ``limit``: bound first, then exactly."""
    low = sum(_manhattan(emb[i, w], emb[j, w]).astype(np.int16) for w in range(fps.shape[1]))
    ok = low <= limit
    d = sum(np.bitwise_count(fps[i, w] ^ fps[j, w]).astype(np.int16) for w in range(fps.shape[1]))
    return ok & (d <= limit)


def _forest(fps: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the graph on one run."""
    left, a, b = np.arange(len(fps)), [], []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            v = front.pop()
            d = sum(np.bitwise_count(fps[left, w] ^ fps[v, w]).astype(np.int16) for w in range(fps.shape[1]))
            new = left[d <= limit]
            left = left[d > limit]
            front += new.tolist()
            a.append(np.full(len(new), v))
            b.append(new)
    z = [np.empty(0, np.int64)]
    return np.concatenate(a or z), np.concatenate(b or z)


def run_links(fps: np.ndarray, limit: int, apart: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, bool]:
    """(i, j, thinned) for one run of a cell. Where more than DENSE links fall to
    each member, a spanning forest stands for them and ``thinned`` is true; with
    ``apart`` (labels) all links between members of unequal label are given."""
    n, emb, a, b, many = len(fps), _embed(fps), [], [], 0
    step = max(1, 1_000_000 // n)
    for s in range(0, n, step):
        i, j = np.arange(s, min(n, s + step))[:, None], np.arange(s, n)[None, :]
        ok = _near(fps, emb, i, j, limit) & (i < j)
        if apart is not None:
            ok &= apart[i] != apart[j]
        x, y = np.nonzero(ok)
        a.append(x + s)
        b.append(y + s)
        many += len(x)
        if apart is None and many > DENSE * n:
            return *_forest(fps, limit), True
    return np.concatenate(a), np.concatenate(b), False


def cell_rows(points: DataFrame, masks: list[list[int]], keep: list[str]) -> DataFrame:
    """One row for each point and grid table: cell (hash of the table and of the
    coordinates it looks at) beside the columns in ``keep``. ``points`` has the
    fingerprint's longs as f0, f1, ..."""
    longs = len(masks[0])
    even = f"{_EVEN}L"
    emb = {f"_e{w}": F.expr(f"((f{w} ^ shiftrightunsigned(f{w}, 1)) & {even}) | shiftleft(f{w} & shiftrightunsigned(f{w}, 1) & {even}, 1)") for w in range(longs)}
    cells = ", ".join(f"xxhash64({t}, {', '.join(f'_e{w} & {_long(m[w])}' for w in range(longs))})" for t, m in enumerate(masks))
    return points.withColumns(emb).select(F.explode(F.expr(f"array({cells})")).alias("cell"), *keep)


def _long(m: int) -> str:
    m = _signed(m)
    return f"({m + 1}L - 1L)" if m == -(1 << 63) else f"({m}L)"


def grid_links(points: DataFrame, masks: list[list[int]], limit: int, label: str | None = None, only: DataFrame | None = None) -> DataFrame:
    """Links (a, b, cell) of points(id, f0, ...) within ``limit``; a row with null
    a and b names a cell whose links have been thinned to a forest. With ``label``
    all links between unlike labels in the cells ``only`` are given."""
    longs, spark = len(masks[0]), points.sparkSession
    fields = ["id", *[f"f{w}" for w in range(longs)], *([label] if label else [])]
    rows = cell_rows(points, masks, fields)
    if only is not None:
        rows = rows.join(only, "cell", "left_semi")
    dealt = rows.repartition(partitions(spark), "cell").sortWithinPartitions("cell", *fields)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def links(m: np.ndarray) -> pa.RecordBatch | None:
            cell = m[:, 0]
            edge = np.flatnonzero(np.diff(cell)) + 1
            starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(m)]])
            size = ends - starts
            ids, fps = m[:, 1], m[:, 2 : 2 + longs].view(np.uint64)
            emb, labels = _embed(fps), m[:, 2 + longs] if label else None
            a, b, c, thin = [], [], [], []
            # short runs all together, by the distance of their members' places
            run = np.repeat(size, size)
            place = np.arange(len(m)) - np.repeat(starts, size)
            short = run <= 32
            for d in range(1, min(32, int(size.max()))):
                i = np.flatnonzero(short & (place + d < run))
                if not len(i):
                    break
                i = i[_near(fps, emb, i, i + d, limit)]
                if labels is not None:
                    i = i[labels[i] != labels[i + d]]
                a.append(ids[i]), b.append(ids[i + d]), c.append(cell[i])
            for s, e in zip(starts[size > 32], ends[size > 32], strict=True):
                i, j, thinned = run_links(fps[s:e], limit, labels[s:e] if label else None)
                a.append(ids[s:e][i]), b.append(ids[s:e][j]), c.append(np.full(len(i), cell[s]))
                thin += [cell[s]] * thinned
            a, b, c = (np.concatenate(x or [np.empty(0, np.int64)]) for x in (a, b, c))
            if not len(a) and not thin:
                return None
            none = np.zeros(len(thin), np.int64)
            mask = np.concatenate([np.zeros(len(a), bool), np.ones(len(thin), bool)])
            return pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([np.minimum(a, b), none]), mask=mask), pa.array(np.concatenate([np.maximum(a, b), none]), mask=mask),
                pa.array(np.concatenate([c, np.array(thin, np.int64)])),
            ], ["a", "b", "cell"])

        for batch in batches:
            m = np.column_stack([np.asarray(x).astype(np.int64, copy=False) for x in (c.to_numpy(zero_copy_only=False) for c in batch.columns)])
            if not len(m):
                continue
            # the last run may go on in the next batch
            last = int(np.searchsorted(m[:, 0], m[-1, 0]))
            if last or not held:
                whole = np.concatenate([*held, m[:last]])
                if held and last == 0:
                    held.append(m)
                    continue
                if len(whole) > 1 and (out := links(whole)):
                    yield out
                held = [m[last:]]
            elif held[-1][-1, 0] == m[0, 0]:
                held.append(m)
            else:
                if (out := links(np.concatenate(held))):
                    yield out
                held = [m]
        if held and sum(map(len, held)) > 1 and (out := links(np.concatenate(held))):
            yield out

    return dealt.mapInArrow(search, "a long, b long, cell long")


def components(docs: DataFrame, words: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs(doc_id, text)``.

    Fingerprints link at ``distance`` or fewer differing bits; component_id is the
    least doc_id that can be reached. Exact: the grid tables cover every pair
    within the distance. Null and empty texts have fingerprint zero, linked like
    any other; a null doc_id takes part and gets its component, but is no
    component's least id unless all are null; repeated rows stay; an empty table
    gives no rows. Equal fingerprints are merged before the search, so groups of
    copies cost one point, and a dense run gives a spanning forest, not all pairs.
    """
    found = cut(fingerprints(docs, words))
    points = cut(found.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies")))
    links = grid_links(points.select(F.col("fp").alias("id"), F.col("fp").alias("f0")), exact_masks(distance), distance)
    roots = connected_components(links.where("a is not null").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    placed = points.join(roots, points["fp"] == roots["node"], "left").select("fp", "low", "copies", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("members"))
    # A component or a fingerprint may hold a third of all rows.
    of = join_hot(placed.select("fp", "copies", "root"), least, ["root"], "members", points.count()).select("fp", "copies", "component_id")
    return join_hot(found, of, ["fp"], "copies", found.count()).select("doc_id", "fp", "component_id")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    c = components(table(spark, sf_dir, "documents"))
    return c.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
