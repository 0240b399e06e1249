"""Cosine top-k by blocks, against all pairs."""

import math
import random

import pytest

from factweave.operators import blocks, vectors


def cosine(a, b):
    if not a or not b or len(a) != len(b) or None in a or None in b or not any(a) or not any(b):
        return 0.0
    na, nb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / na / nb if na * nb > 0 else 0.0


def brute(queries, rows, k):
    out = []
    for q, qv in queries:
        s = sorted((-round(cosine(qv, v), 6), i) for i, v in rows if not (v and qv and len(v) == len(qv) and any(v) and any(qv) and any(x is not None and not math.isfinite(x) for x in [*v, *qv])))
        out += [(q, i, -score + 0.0, r) for r, (score, i) in enumerate(s[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block, asked", [(16_384, 2_048), (64, 64)])
def test_top_of_all_pairs(spark, monkeypatch, block, asked):
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "QUERIES", asked)
    rng = random.Random(5)
    rows = [(f"é{i:03d}" if i % 2 else f"v{i:03d}", [float(rng.randint(-8, 8)) for _ in range(6)]) for i in range(400)]
    for i in range(20, 60):
        rows[i] = (rows[i][0], rows[19][1])  # ties
    rows[1], rows[2], rows[3], rows[4] = ("n1", None), ("n2", []), ("n3", [0.0] * 6), ("n4", [1.0, None] + [1.0] * 4)
    rows[5], rows[6] = ("n5", [1.0, 2.0]), ("n6", [float("nan")] + [1.0] * 5)
    queries = [(q, v) for q, v in rows[::3] if v and len(v) == 6 and None not in v and all(map(math.isfinite, v))] + [("short", [1.0, 2.0]), ("none", None)]
    frame = lambda x: spark.createDataFrame(x, "id string, vec array<float>").repartition(3)
    got = sorted((r["query_id"], r["id"], r["score"] + 0.0, r["rank"]) for r in vectors.cosine_topk(frame(queries), frame(rows), 7).collect())
    assert got == brute(queries, rows, 7)


def test_few_and_none(spark):
    schema = "id long, vec array<float>"
    none, one = spark.createDataFrame([], schema), spark.createDataFrame([(1, [1.0, 0.0])], schema)
    assert vectors.cosine_topk(none, one, 3).count() == vectors.cosine_topk(one, none, 3).count() == 0
    assert [tuple(r) for r in vectors.cosine_topk(one, one, 3).collect()] == [(1, 1, 1.0, 1)]


def test_every_block_meets_every_other_once(spark):
    """However the grid is cut, and about the root of its cells times copied."""
    for n_left, n_right, cells in [(1, 9, 16), (5, 5, 16), (7, 2, 4), (3, 30, 8)]:
        left = spark.createDataFrame([(i, f"l{i}") for i in range(n_left)], "block long, x string")
        right = spark.createDataFrame([(i, f"r{i}") for i in range(n_right)], "block long, x string")
        got = sorted((r["x"], r["_x"]) for r in blocks.paired(left, right, n_left, n_right, cells).collect())
        assert got == sorted((f"l{i}", f"r{j}") for i in range(n_left) for j in range(n_right))
