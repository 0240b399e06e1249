"""WARC archives, packing and exact search."""

import zlib

import numpy as np
import pytest

from factweave.llm import packing, topk, warc

from .helpers import corpus, frame


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, None, "x"), (2, "u\r\nX: y", "x"), (3, "u", None), (4, "u", ""), (None, "u", "x"), (5, "v", "é" * 9), (2, "u2", "x"), (6, "w", "<p>" * 90_000)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, refers_to string")
    warc.write_archives(warc.mark_revisits(pages), str(tmp_path / "a"), b"some dictionary content, long enough to be one" * 4)
    got = warc.read_archives(spark, str(tmp_path / "a")).collect()
    assert len(got) == len(rows)
    for r in got:
        html = next((h or "").encode() for i, _, h in rows if i == r["page_id"])
        assert (r["payload_bytes"], r["payload_digest"]) == (len(html), warc.payload_digest(html))
        assert r["payload"] is None if r["record_type"] == "revisit" else bytes(r["payload"]) == html
    kinds = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in got)
    assert kinds == [(0, "revisit", 2), (1, "revisit", 2), (2, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None), (5, "response", None), (6, "response", None)]


def test_warc_empty(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(warc.mark_revisits(none), str(tmp_path / "b"))
    assert warc.read_archives(spark, str(tmp_path / "b")).count() == 0
    assert warc.train_dictionary(none) == b""


def test_warc_damage():
    import zstandard

    good = warc.record_bytes(1, "u", b"body", None)
    assert warc.parse_record(good)["payload"] == b"body"
    for bad in (good[:-1], good.replace(b"body", b"bodx"), good.replace(b"WARC/1.1", b"WORC/1.1"), good.replace(b"WARC-Date", b"WARC-Dote"), good.replace(b"Content-Length: 4", b"Content-Length: 5"), b""):
        with pytest.raises(warc.BadArchive):
            warc.parse_record(bad)
    frame_ = zstandard.ZstdCompressor(write_checksum=True).compress(good)
    assert list(warc.iter_records(frame_ + frame_)) == [good, good]
    for bad in (frame_[:-2], frame_ + b"xx", frame_ + b"\x50\x2a\x4d\x18\x09\x00\x00\x00ab", frame_[:-1] + b"?"):
        with pytest.raises(warc.BadArchive):
            list(warc.iter_records(bad))


def test_packing(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    rows = corpus(seed=6)
    ids = [(d, [*t.encode(x or "", add_special_tokens=False).ids, 0]) for d, x, _ in rows]
    got = packing.pack(frame(spark, rows)).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for d, want in ids:
        copies = sum(x[0] == d for x in ids)
        pieces = sorted(by_doc[d], key=lambda r: r["start"])[::copies]
        assert [r["start"] for r in pieces] == list(np.cumsum([0, *(r["length"] for r in pieces[:-1])]))
        assert sum(r["length"] for r in pieces) == len(want) == pieces[0]["doc_tokens"]
        for r in pieces:
            assert r["ids_crc32"] == zlib.crc32(np.array(want[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024
    odd = spark.createDataFrame([(None, None), (1, "")], "doc_id long, text string")
    assert sorted(((r["doc_id"] or 0), r["length"]) for r in packing.pack(odd).collect()) == [(0, 1), (1, 1)]
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_best_fit_takes_the_tightest_window():
    rng = np.random.default_rng(1)
    lengths = sorted(rng.integers(1, 1025, 2000).tolist(), reverse=True)
    left: list[int] = []
    for n, (sequence, offset) in zip(lengths, packing.best_fit(iter(lengths))):
        fitting = [x for x in left if x >= n]
        if fitting:
            assert left[sequence] == min(fitting) and offset == 1024 - left[sequence]
        else:
            assert sequence == len(left) and offset == 0
            left.append(1024)
        left[sequence] -= n
    assert sum(left) / (1024 * len(left)) < 0.01


def brute_topk(vecs, k=20, every=20):
    """{query: [(score, id)]} in whole numbers."""
    x = {i: [int(np.floor(64 * np.float64(c))) if abs(64 * float(c)) < 2**53 else int(64 * float(c)) for c in v] for i, v in vecs}
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    out = {}
    for q in x:
        if q % every == 0:
            s = sorted((-clip(sum(a * b for a, b in zip(x[q], x[i]))), i) for i in x if i != q)[:k]
            out[q] = [(-a, i) for a, i in s]
    return out


def found_topk(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["score"], r["vec_id"]))
    return out


def test_exact_search(spark):
    rng = np.random.default_rng(2)
    vecs = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(300)]
    vecs[7] = (7, vecs[8][1])
    bad = [(1000, None), (1020, [float("nan")] * 16), (1040, [1.0, None] + [0.0] * 14), (1060, [float("inf")] + [0.0] * 15), (None, vecs[1][1])]
    df = spark.createDataFrame([(*v, 0) for v in vecs + bad], "vec_id long, embedding array<float>, rank int")
    assert found_topk(topk.exact_topk(df, tile=64, query_tile=4).collect()) == brute_topk(vecs)
    few = spark.createDataFrame(vecs[:5], "vec_id long, embedding array<float>")
    assert topk.exact_topk(few).count() == 4
    assert topk.exact_topk(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_exact_search_of_huge_components(spark):
    rng = np.random.default_rng(4)
    vecs = [(i, [float(np.float32(c)) for c in rng.normal(size=4) * 10.0 ** rng.integers(0, 38)]) for i in range(60)]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<float>")
    assert found_topk(topk.exact_topk(df, tile=16).collect()) == brute_topk(vecs)


@pytest.mark.parametrize("kind", ["clusters", "spread"])
def test_pivots_eliminate(kind):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(20_000, 64)) * 8
    if kind == "clusters":
        x += (rng.normal(size=(200, 64)) * 64)[rng.integers(0, 200, len(x))]
    x, ids = np.floor(x), np.arange(len(x))
    pivots = topk.Pivots.of(x[:2048], 256)
    q, i, score, evaluated = topk.search_tile(x[:200], ids[:200], topk.Tile(x, ids, pivots), 20)
    s = x[:200] @ x.T
    s[np.arange(200), np.arange(200)] = -np.inf
    want = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :20]
    assert (i.reshape(200, 20) == want).all() and (score.reshape(200, 20) == np.take_along_axis(s, want, 1)).all()
    assert evaluated < {"clusters": 0.15, "spread": 0.25}[kind] * 200 * len(x)
    # the bound of the pivots together is no looser than the best single one's
    a, b = pivots.place(x[:50]), pivots.place(x[50:100])
    joint = np.sqrt(((a - b) ** 2).sum(1))
    m = pivots.basis.shape[1]
    gaps = np.abs(pivots.table(x[:50])[:, :m] - pivots.table(x[50:100])[:, :m]).max(1)
    assert (joint >= gaps - 1e-3).all() and (joint <= np.sqrt(((x[:50] - x[50:100]) ** 2).sum(1)) + 1e-6).all()


@pytest.mark.parametrize("dims", [768, 1536])
def test_bounds_of_wide_vectors_hold(dims):
    """The single-precision bound is no less than the score, whatever the width."""
    rng = np.random.default_rng(dims)
    x = np.floor(64 * rng.normal(size=(3_000, dims)) + 400 * rng.normal(size=(30, dims))[rng.integers(0, 30, 3_000)])
    ids, pivots = np.arange(len(x)), topk.Pivots.of(x[:2048], 256)
    tile = topk.Tile(x, ids, pivots)
    q = x[::50]
    placed = pivots.place(q).astype(np.float32)
    bound = placed @ tile.place.T
    room = np.float32(2.5e-7 * (tile.place.shape[1] + 16))
    norm = np.sqrt((q**2).sum(1)).astype(np.float32)
    bound += (room * norm)[:, None] * tile.norm.astype(np.float32)[None, :] + np.float32(1)
    assert (bound >= q @ tile.x.T).all()
    at, i, score, _ = topk.search_tile(q, ids[::50], tile, 20)
    s = q @ x.T
    s[np.arange(len(q)), ids[::50]] = -np.inf
    want = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :20]
    assert (i.reshape(len(q), 20) == want).all() and (score.reshape(len(q), 20) == np.take_along_axis(s, want, 1)).all()
