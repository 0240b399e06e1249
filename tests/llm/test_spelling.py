"""Spelling variants against a direct reading of the rule."""

import random
import re
import zlib
from collections import Counter

import numpy as np

from factweave.llm import oracles, spelling


def brute_words(rows):
    n = Counter()
    for d, text in rows:
        if d is None:
            continue
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute(rows):
    n, out = brute_words(rows), {}
    for w in n:
        by = sorted((x for x in n if near(w, x)), key=lambda x: (-n[x], x))
        form = by[0] if by and n[by[0]] >= 10 * n[w] else None
        out[w] = [form, n[w], len(by), n[form] if form else None]
    roots = {}
    for w in out:
        roots[w] = w
        while out[roots[w]][0]:
            roots[w] = out[roots[w]][0]
    return sorted((w, f or "", roots[w], *map(str, rest)) for w, (f, *rest) in out.items())


def found(df):
    return sorted((r["word"], r["form"] or "", r["root"], str(r["n"]), str(r["n_near"]), str(r["form_n"])) for r in df.collect())


def spelt(seed=3):
    """Few letters, so that near words abound; chains of forms; accents; odd rows."""
    rng, rows = random.Random(seed), []
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(7, 9))) for _ in range(40)]
    for i in range(300):
        words = [rng.choice(base[:8] if rng.random() < 0.6 else base) for _ in range(rng.randint(1, 20))]
        rows.append((i, " ".join(w.upper() if rng.random() < 0.1 else w for w in words)))
    rows += [(300, " ".join(["spelling"] * 2000 + ["speling"] * 150 + ["spelinng"] * 12 + ["spelinnk"] * 2)), (301, None), (302, ""), (None, "spelling " * 30), (5, rows[5][1]), (5, rows[5][1]), (303, "a" * 3000 + " " + "a" * 2999 + "b"), (304, "a" * 3000 + " " + "a" * 2999 + "b")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, n int, word string").repartition(3)


def test_variants_match_brute_force(spark):
    rows = spelt()
    got = found(spelling.variants(frame(spark, rows)))
    assert got == brute(rows)
    by = {r[0]: r for r in got}
    assert by["spelinng"][1:3] == ("speling", "spelling") and sum(r[1] != r[2] and r[1] != "" for r in got) > 0
    assert by["a" * 2999 + "b"][4] == "1"


def test_few_and_none(spark):
    assert found(spelling.variants(frame(spark, []))) == []
    assert found(spelling.variants(frame(spark, [(1, None), (2, "short words only"), (3, "oncealone")]))) == []


def test_keys_name_the_word_without_a_place():
    """A key is equal exactly where the letters without the place are."""
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abc") for _ in range(7)) for _ in range(300)})
    points = np.array([[ord(c) for c in w] for w in words], np.int64)
    whole, without = spelling.wildcards(points)
    keys = {}
    for i, w in enumerate(words):
        assert keys.setdefault(tuple(int(h[i]) for h in whole), w) == w
        for j in range(7):
            assert keys.setdefault(tuple(int(h[i, j]) for h in without), w[:j] + w[j + 1 :]) == w[:j] + w[j + 1 :]
    assert len(set(keys.values())) == len(keys)


def test_query_matches_sql(spark, tmp_path):
    import duckdb

    rows = spelt(seed=9)
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    want = duckdb.connect()
    want.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted((w, f or "", r, str(n), str(k), str(m)) for w, f, r, n, k, m in want.execute(oracles.OP13_SQL).fetchall())
    got = spelling.op13(spark, str(tmp_path))
    assert dict(got.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
    assert found(got) == want == brute(rows)
