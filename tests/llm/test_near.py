"""Fingerprints, components and near-duplicate groups against brute force."""

import re

import numpy as np
import xxhash

from factweave.llm import neardup, simhash
from factweave.llm.common import connected_components

from .helpers import corpus, frame


def fingerprint(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall("[^\x20\x09-\x0d]+", t)
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components_match_brute_force(spark):
    rows = corpus()
    got = simhash.components(frame(spark)).collect()
    assert len(got) == len(rows)
    fp = {d: fingerprint(t) for d, t, _ in rows}
    want = groups(fp, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 4])
    for r in got:
        assert r["fp"] % 2**64 == fp[r["doc_id"]]
        assert r["component_id"] == want[r["doc_id"]]


def test_dense_runs_lose_no_link(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 3, dtype=np.uint64)
    fps = np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64)) for b in base]))
    points = spark.createDataFrame([(int(x.view(np.int64)), int(x.view(np.int64))) for x in fps], "id long, f0 long")
    links = simhash.grid_links(points, simhash.exact_masks(4), 4).where("a is not null")
    roots = connected_components(links.selectExpr("a AS src", "b AS dst")).collect()
    ids = [int(x.view(np.int64)) for x in fps]
    near = [(ids[i], ids[j]) for i in range(len(ids)) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= 4]
    want = groups(ids, near)
    assert {r["node"]: r["root"] for r in roots} == {k: v for k, v in want.items() if any(k in p for p in near)}
    assert links.count() < len(near) * 5


def test_manhattan_is_a_lower_bound():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 2**64, (2, 1000), dtype=np.uint64)
    d = simhash._manhattan(simhash._embed(a), simhash._embed(b))
    exact = [sum(abs((int(x) >> s & 3).bit_count() - (int(y) >> s & 3).bit_count()) for s in range(0, 64, 2)) for x, y in zip(a, b)]
    assert d.tolist() == exact
    assert (d <= np.bitwise_count(a ^ b)).all()


def test_near_groups_match_brute_force(spark):
    rows = corpus(seed=4)
    got = {r["dk"]: r["first_dk"] for r in neardup.near_groups(frame(spark, rows)).collect()}
    sets = {}
    for d, t, _ in rows:
        sets[d] = set(neardup.shingle_set(t, 5)[0].tolist())

    def jaccard(a, b):
        return 1.0 if not a | b else len(a & b) / len(a | b)

    want = groups(sets, [(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.8])
    assert got == want
    kept = {r["doc_id"] for r in neardup.drop_near_duplicates(frame(spark, rows)).collect()}
    assert kept == set(want.values())


def test_empty_and_null(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.components(none).count() == 0
    assert neardup.near_groups(none).count() == 0
    odd = spark.createDataFrame([(None, None), (None, "a b"), (7, ""), (9, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash.components(odd).collect()}
    assert got[(7, 0)] == got[(9, 0)] == got[(None, 0)] == 7
    assert neardup.drop_near_duplicates(odd).count() == 2


def test_near_groups_find_every_pair_at_the_limit(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(300):
        # five words replaced apart from each other: 25 unlike shingles on each side
        w = [f"w{x}" for x in rng.integers(0, 10**6, 229 + i % 60)]
        v = list(w)
        for x in range(5):
            v[20 + 40 * x] = f"edit{i}x{x}"
        rows += [(2 * i, " ".join(w), "x"), (2 * i + 1, " ".join(v), "x")]
    similarity = lambda a, b: len(a & b) / len(a | b)
    sets = [set(neardup.shingle_set(t, 5)[0].tolist()) for _, t, _ in rows]
    assert all(0.8 <= similarity(sets[2 * i], sets[2 * i + 1]) <= 0.85 for i in range(300))
    got = {r["dk"]: r["first_dk"] for r in neardup.near_groups(frame(spark, rows)).collect()}
    assert got == {d: d - d % 2 for d, _, _ in rows}


def test_prefix_join_alone_matches_brute_force(spark):
    # a passage that all texts share and a grid that finds nothing
    rng = np.random.default_rng(12)
    shared = " ".join(f"s{x}" for x in range(40))
    rows = [(i, shared + " " + " ".join(f"w{x}" for x in rng.integers(0, 50, rng.integers(0, 30))), "x") for i in range(120)]
    sets = [set(neardup.shingle_set(t, 5)[0].tolist()) for _, t, _ in rows]
    near = [(a, b) for a in range(120) for b in range(a + 1, 120) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = groups(range(120), near)
    got = {r["dk"]: r["first_dk"] for r in neardup.near_groups(frame(spark, rows), tables=1, limit=0).collect()}
    assert got == want and 1 < len(set(want.values())) < 120
