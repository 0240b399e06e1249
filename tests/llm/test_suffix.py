"""Repeated byte strings against brute force."""

import hashlib

import pytest

from factweave.llm import suffix

from .helpers import corpus, frame


def brute(rows, length=100):
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        hit = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                hit[s : s + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, h in zip(b, hit) if not h)
        runs = sum(1 for i, h in enumerate(hit) if h and (i == 0 or not hit[i - 1]))
        out[d] = (len(b), sum(hit), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [2, 1024])
def test_matches_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    rows = [r for r in corpus(seed=9)[:-1]]
    rows.append((99, "ab" * 400, "x"))  # repeats within one text
    rows.append((100, "zz" + rows[5][1] if rows[5][1] else "", "x"))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.remove_repeats(frame(spark, rows)).collect()}
    assert got == brute([(d, t) for d, t, _ in rows])


def test_chunks_make_no_difference(spark, monkeypatch):
    monkeypatch.setattr(suffix, "CHUNK", 97)
    rows = corpus(seed=2)[:25]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.remove_repeats(frame(spark, rows)).collect()}
    assert got == brute([(d, t) for d, t, _ in rows])


def test_one_passage_in_many_contexts(spark, monkeypatch):
    # a gram under which nearly all anchors fall, each in a context of its own
    import random

    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh") for _ in range(104))
    rows = [(i, "".join(rng.choice("0123456789") for _ in range(rng.randint(0, 90))) + passage + "".join(rng.choice("0123456789") for _ in range(rng.randint(0, 90))), "x") for i in range(400)]
    rows += rows[5:7]
    for most, lot in ((10**9, 100_000), (0, 100_000), (0, 7)):
        found = suffix._hot_keys
        monkeypatch.setattr(suffix, "LOT", lot)
        if not most:
            monkeypatch.setattr(suffix, "_hot_keys", lambda base, length, tasks: found(base, length, tasks * 1000))
        got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.remove_repeats(frame(spark, rows)).collect())
        want = brute(sorted({(d, t) for d, t, _ in rows}))
        assert got == sorted((d, *want[d]) for d, _, _ in rows)
        monkeypatch.undo()


def test_odd_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert suffix.remove_repeats(none).count() == 0
    text = "".join(chr(97 + i % 23) for i in range(150))
    odd = spark.createDataFrame([(None, text), (1, text), (2, text), (2, text), (3, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["n_removed"], bytes(r["kept"])) for r in suffix.remove_repeats(odd).collect())
    first = brute([(0, text)])[0][1]
    assert [g[:2] for g in got] == [(-1, first), (1, 150), (2, 150), (2, 150), (3, 0)]


@pytest.mark.parametrize("hot", [2, 1024])
def test_repeated_row_that_comes_first(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    rows = corpus(seed=6)  # its last row is a repeat, its text stands nowhere before
    rows += [(200, "more " + rows[-1][1][:900] + " end", "x")] * 2
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.remove_repeats(frame(spark, rows)).collect())
    want = brute(sorted({(d, t or "") for d, t, _ in rows}))
    assert want[60][1] < want[60][0]
    assert got == sorted((d, *want[d]) for d, _, _ in rows)
