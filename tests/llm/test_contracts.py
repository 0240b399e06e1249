"""The registered corpus queries on small whole tables: columns, types, values."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from factweave.llm import decontaminate, lines, packing, pii, quality, simhash, suffix, topk, toxicity, warc

from .helpers import corpus, prose
from .test_near import fingerprint, groups
from .test_records import brute_topk, found_topk
from .test_suffix import brute as brute_suffix
from .test_text_ops import TEXTS, kept_lines, overlap, spans


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with copies, nulls, odd texts and labels; and the other tables."""
    rng = random.Random(21)
    rows = [(d, t) for d, t, _ in corpus(seed=21)[:-1]]
    rows += [(100 + i, t) for i, t in enumerate(TEXTS)]
    labels = []
    for i in range(200, 440):
        text, bad, toxic = [prose(rng, 12) for _ in range(4)], i % 4 == 0, i % 5 == 1
        if bad:
            text = [x.upper().replace(" ", "!! ") for x in text]
        if toxic:
            text[1] += " " + rng.choice(["moronic", "rotten"]) + " and " + rng.choice(["scummy", "vile"])
        rows.append((i, "\n".join(text)))
        labels.append((i, int(not bad), int(toxic)))
    items = [(1, rows[0][1]), (2, "Tiny"), (3, None), (10, rows[5][1])]
    pages = [(1, "u", None), (2, "u", "<p>a</p>"), (3, "v", "<p>a</p>"), (4, "w", ""), (5, "x", "é" * 40)]
    g = np.random.default_rng(5)
    vecs = [(i, [float(np.float32(c)) for c in g.normal(size=8)]) for i in range(90)]
    d = str(tmp_path_factory.mktemp("contract"))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    spark.createDataFrame([(*v, 0) for v in vecs], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return {"dir": d, "rows": rows, "labels": labels, "items": items, "pages": pages, "vecs": vecs}


def run(spark, op, tables, types):
    """Rows by their first column, after a look at names and types."""
    df = op(spark, tables["dir"])
    assert {c: t for c, t in df.dtypes if c in types} == types
    return df.collect()


def fold(i, of):
    return zlib.crc32(str(i).encode()) % of


def test_op1(spark, tables):
    got = run(spark, simhash.op1, tables, {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"})
    fp = {d: fingerprint(t) for d, t in tables["rows"]}
    want = groups(fp, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 4])
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {d: (f"{fp[d]:016x}", want[d]) for d in fp} and len(got) == len(fp)


def test_op2(spark, tables):
    got = run(spark, suffix.op2, tables, {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"})
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == brute_suffix(tables["rows"])


@pytest.mark.parametrize("op, label, of, out, limit", [(quality.op3, 1, 4, 2, 0.7), (toxicity.op9, 2, 5, 0, 0.5)])
def test_op3_and_op9(spark, tables, op, label, of, out, limit):
    got = run(spark, op, tables, {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"})
    assert sorted(r["doc_id"] for r in got) == sorted(d for d, _ in tables["rows"])
    assert all(r["held_out"] == (fold(r["doc_id"], of) == out) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= limit) for r in got)
    truth = {x[0]: x[label] for x in tables["labels"]}
    held = [r["predicted"] == truth[r["doc_id"]] for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 30 and np.mean(held) > 0.95
    if op is toxicity.op9:
        text = dict(tables["rows"])
        words = {text[r["doc_id"]][int(a) : int(b)] for r in got if r["toxic_spans"] and r["doc_id"] in truth for a, b in (s.split(":") for s in r["toxic_spans"].split(","))}
        assert words and words <= {"moronic", "rotten", "scummy", "vile"}


def test_op4(spark, tables):
    got = run(spark, decontaminate.op4, tables, {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"})
    want = {d: (n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), c) for d, n, h, i, c in overlap(tables["rows"], tables["items"])}
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == want and any(w[4] for w in want.values())


def test_op5(spark, tables):
    got = run(spark, lines.op5, tables, {"doc_id": "bigint", "n_removed_lines": "bigint", "kept_chars": "bigint", "kept_sha256": "string"})
    near, first, want = kept_lines(tables["rows"]), set(), {}
    words = lambda x: tuple(w for w in re.split(r"[\x20\t\r\x0b\f]+", x) if w)
    for d, _ in sorted(tables["rows"]):
        left = []
        for x in (near[d] or "").split("\n"):
            short = 0 < len(words(x)) < lines.MIN_WORDS
            if not short or words(x) not in first:
                left.append(x)
            if short:
                first.add(words(x))
        kept = "\n".join(left)
        want[d] = (len(kept), hashlib.sha256(kept.encode()).hexdigest())
    assert {r["doc_id"]: (r["kept_chars"], r["kept_sha256"]) for r in got} == want
    assert sum(r["n_removed_lines"] for r in got) > 0


def test_op6(spark, tables):
    got = run(spark, topk.op6, tables, {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"})
    assert found_topk(got) == brute_topk(tables["vecs"])


def test_op7(spark, tables):
    got = run(spark, pii.op7, tables, {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"})
    text = dict(tables["rows"])
    for r in got:
        base = [f"{k}:{a}:{b}" for k, a, b in spans(text[r["doc_id"]])]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(x.startswith(f"{k}:") for x in base) for k in ("email", "ip", "card", "phone")]
        found = r["spans"].split(",") if r["spans"] else []
        assert found[: len(base)] == base and r["n_pii"] == len(found)
    assert len(got) == len(text)


def test_op8(spark, tables):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    got = run(spark, packing.op8, tables, {k: "bigint" for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")})
    by, at = {}, {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d, x in tables["rows"]:
        ids, n = [*t.encode(x or "", add_special_tokens=False).ids, 0], 0
        for r in sorted(by.pop(d), key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (n, len(ids)) and r["ids_crc32"] == zlib.crc32(np.array(ids[n : n + r["length"]], "<u4").tobytes())
            n += r["length"]
        assert n == len(ids)
    assert not by
    for places in at.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [o for o, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 1024


def test_op10(spark, tables):
    got = run(spark, warc.op10, tables, {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"})
    want = {}
    for i, _, html in tables["pages"]:
        b = (html or "").encode()
        last = max(j for j, _, h in tables["pages"] if (h or "").encode() == b)
        want[i] = (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if i == last else "revisit", None if i == last else last)
    assert {r["page_id"]: tuple(r)[1:] for r in got} == want


def test_clashing_columns_stay(spark):
    """Columns whose names the operators use inside come through untouched."""
    docs = spark.createDataFrame([(1, "one two three four five six\nx@y.org", 1, 2, "a", "b", "c"), (2, "one two three four five six", 3, 4, "d", "e", "f")], "doc_id long, text string, _dk int, _th int, _bad string, _pii_base string, _rated string")
    given = {r["doc_id"]: tuple(r)[2:] for r in docs.collect()}
    items = spark.createDataFrame([(1, "nothing of it")], "item_id long, text string")
    from factweave.llm import neardup

    for out in (
        lines.dedup_lines(docs), neardup.drop_near_duplicates(docs), decontaminate.drop_contaminated(docs, items), pii.find_pii(docs),
        toxicity.score(docs, toxicity.ToxicityModel([]), spans=True),
    ):
        rows = out.select(docs.columns).collect()
        assert len(rows) == 2 and {r["doc_id"]: tuple(r)[2:] for r in rows} == given


def test_keys_that_collide_lose_no_link(spark):
    """Anagrams of a line share the key of its words' sum; each still meets its own."""
    w = "alpha beta gamma delta epsilon zeta".split()
    rows, rng = [], random.Random(2)
    for i in range(40):
        rng.shuffle(w)
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([*w[:3], "extra", *w[3:]]))]
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == kept_lines(rows)
