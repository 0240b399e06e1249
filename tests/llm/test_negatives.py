"""Hard negatives against scores of all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from factweave.llm import negatives, topk
from factweave.operators import blocks


def brute(rows, every=100, scale=256, move=False):
    """rows: (vec_id, vector, label)."""
    v = []
    for i, x, y in rows:
        if i is None or x is None or y is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        v.append((i, [math.floor(scale * float(c)) for c in x], (y + 1) % 10 if move and i % 7 == 0 else y))
    out, seen = [], set()
    for i, x, y in sorted(v):
        if i % every or i in seen:
            continue
        seen.add(i)
        order = sorted((-sum(a * b for a, b in zip(x, z, strict=False)), j, label) for j, z, label in v if j != i)
        for slot, (p, j, _) in enumerate([o for o in order if o[2] == y][:5]):
            ok = [o for o in order if o[2] != y and 80 * -p <= 100 * -o[0] <= 100 * -p][:5]
            out += [(i, j, slot, r, k, -p, -s) for r, (s, k, _) in enumerate(ok, 1)]
    return sorted((a, j, r, k, p, s) for a, j, _, r, k, p, s in out)


def found(df):
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in df.collect())


def vectors(n=700, d=8, seed=2, groups=6):
    g = np.random.default_rng(seed)
    middles = g.normal(size=(groups, d))
    rows = [(i, [float(np.float32(c)) for c in middles[i % groups] + 0.4 * g.normal(size=d)], int(g.integers(4))) for i in range(n)]
    for i in (11, 12, 13, 14, 200):
        rows[i] = (i, rows[10][1], i % 4)  # ties
    rows[20] = (20, None, 1)
    rows[21] = (21, [None, *rows[21][1][1:]], 1)
    rows[22] = (22, [math.nan, *rows[22][1][1:]], 1)
    rows[23] = (23, rows[23][1], None)
    rows[300] = (300, [0.0] * d, 2)
    rows[24] = (24, rows[24][1][:5], 2)  # shorter
    return [*rows, rows[50], (None, rows[3][1], 1), (400, rows[400][1], rows[400][2])]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, id int, vec string").repartition(3)


@pytest.mark.parametrize("tree, anchors", [(8_192, 2_048), (100, 3)])
def test_matches_brute_force(spark, monkeypatch, tree, anchors):
    """In one block and in many, of leaves of any size."""
    monkeypatch.setattr(negatives, "TREE", tree)
    monkeypatch.setattr(negatives, "ANCHORS", anchors)
    rows = vectors()
    df = frame(spark, rows).drop("id", "vec")
    got = found(negatives.hard_negatives(df, F.col("id") % 50 == 0))
    assert got == brute(rows, every=50) and len(got) > 60


def test_op11_and_its_sql(spark, tmp_path):
    import duckdb

    rows = [(i, x, y) for i, x, y in vectors(n=600, seed=5)[:600] if i != 24]
    frame(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = negatives.op11(spark, str(tmp_path))
    assert dict(got.dtypes) == {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"}
    d = duckdb.connect()
    d.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    names = "anchor_id, positive_id, rank, negative_id, positive_score, negative_score"
    want = sorted(d.execute(f"SELECT {names} FROM ({negatives.OP11_SQL})").fetchall())
    assert found(got) == want == brute(rows, move=True)


def test_few_and_none(spark):
    ask = F.col("id") % 100 == 0
    assert found(negatives.hard_negatives(frame(spark, []), ask)) == []
    one = [(0, [1.0, 0.0], 1)]
    assert found(negatives.hard_negatives(frame(spark, one), ask)) == []
    assert found(negatives.hard_negatives(frame(spark, [*one, (1, [1.0, 0.0], 1)]), ask)) == []
    huge = [(0, [3e38, 3e38], 1), (1, [3e38, -1e38], 1), (2, [2.5e38, -1e38], 2), (3, [-3e38, 1.0], 2)]
    assert found(negatives.hard_negatives(frame(spark, huge), ask)) == [(0, 1, 1, 2, 2**63 - 1, 2**63 - 1)]


def test_tree_bounds_hold_and_leave_rows_out():
    g = np.random.default_rng(1)
    middles = 100 * g.normal(size=(60, 4))
    x = np.floor(middles[g.integers(60, size=6_000)] + 4 * g.normal(size=(6_000, 4)))
    tree = negatives.VpTree.of(x, leaf=64)
    assert sorted(tree.order) == list(range(6_000)) and (tree.x == x[tree.order]).all()
    q = x[::97]
    least, most = tree.reach(q)
    scores = topk.dots(q, tree.x)
    for leaf in range(len(tree.starts) - 1):
        s = scores[:, tree.starts[leaf] : tree.starts[leaf + 1]]
        assert (s >= least[:, leaf : leaf + 1]).all() and (s <= most[:, leaf : leaf + 1]).all()
    search = negatives.Search(tree, q, np.arange(6_000))
    every = np.ones(6_000, bool)
    for i in range(len(q)):
        search.start(i)
        top = np.sort(scores[i])[::-1]
        low, high = int(top[400]), int(top[200])
        ids, got = search.nearest(every, 5, low, high)
        assert got.tolist() == [int(s) for s in top if s <= high][:5] and (scores[i, ids] == got).all()
    assert search.opened < 0.6 * len(q) * 6_000


def test_packed_blocks_are_cut_alike(spark):
    rows = frame(spark, vectors()).selectExpr("vec_id AS id", "embedding AS vec", "label")
    a = {r["block"]: (r["id"], bytes(r["vecs"]), r["label"], r["lens"]) for r in blocks.packed(rows, 64, 5).collect()}
    b = {r["block"]: (r["id"], bytes(r["vecs"]), r["label"], r["lens"]) for r in blocks.packed(rows.repartition(7), 64, 5).collect()}
    assert a == b and all(len(x[0]) <= 64 for x in a.values()) and sum(len(x[0]) for x in a.values()) == 703
