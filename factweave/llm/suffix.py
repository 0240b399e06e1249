"""Repeated byte strings across a corpus: depth-limited radix sort of suffixes.

The suffixes of all texts are ordered through their first ``length`` bytes only,
by most-significant-digit passes that drop a suffix as soon as it is alone in
its class; the classes left at the end are the repeated windows. The first digit
is taken at a place that the window's own bytes determine (its least 24-byte
gram), so that neighbouring windows share one row in the shuffle and rows whose
first digit is unique go before any text moves. Runs of windows whose covered
bytes agree in 128 bits of hash count as equal without further passes.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, partitions, table

GRAM = 24
#: Windows that are looked at together; bounds a task's memory, not the result.
CHUNK = 1 << 20
#: Contexts under one first digit beyond which its windows are dealt out singly.
HOT = 1024
#: Bytes of the digest that stands for a single window.
DIGEST = 16
NO_ID = -(2**63)
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _words(buf: np.ndarray) -> np.ndarray:
    """The little-endian 64-bit word at each byte of ``buf`` (7 spare bytes)."""
    return np.ndarray((len(buf) - 7,), "<u8", buffer=buf, strides=(1,))


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * _C[1]
    return h ^ (h >> np.uint64(32))


def _gram_hash(v: np.ndarray, at, seed: int = 0) -> np.ndarray:
    """Hash of the 24 bytes at ``at`` (a slice start/stop pair or indices)."""
    if isinstance(at, tuple):
        a, b = at
        parts = (v[a:b], v[a + 8 : b + 8], v[a + 16 : b + 16])
    else:
        parts = (v[at], v[at + 8], v[at + 16])
    h = (parts[0] ^ np.uint64(seed)) * _C[0]
    h = _mix(h ^ (h >> np.uint64(31))) + parts[1]
    h = _mix(h * _C[2]) + parts[2]
    return _mix(h * _C[3])


def _window_hash(v: np.ndarray, at: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """Hash of the ``length`` bytes at each of ``at``."""
    h = np.full(len(at), seed, np.uint64)
    for d in [*range(0, length - GRAM, GRAM), length - GRAM]:
        h = _mix((h * _C[0]) ^ _gram_hash(v, at + d, seed))
    return h


def anchors(buf: np.ndarray, length: int):
    """For the windows of one text (``buf`` has 8 spare bytes at the end): anchor
    place, least and greatest start of the windows it stands for, hash of its
    gram, 128 bits of hash of all bytes that those windows cover."""
    n = len(buf) - 8
    windows, span = n - length + 1, length - GRAM + 1
    v = _words(buf)
    h = _gram_hash(v, (0, n - GRAM + 1))
    best = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while 2 * width <= span:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if span > width:
        best = np.minimum(best[: windows], best[span - width : span - width + windows])
    place = (best[:windows] & np.uint64(0xFFFFFF)).astype(np.int64)
    edge = np.flatnonzero(np.diff(place)) + 1
    low, high = np.concatenate([[0], edge]), np.concatenate([edge, [windows]]) - 1
    p = place[low]
    shape = ((p - low) * 256 + high - low).astype(np.uint64)
    ctx, more = (_mix(_window_hash(v, low, length, seed) * _C[2] ^ _window_hash(v, high, length, seed)) + shape for seed in (0, 0x5851F42D4C957F2D))
    return p, low, high, h[p], ctx, more


def _rows_in(batch: pa.RecordBatch):
    """(dk, th, bytes) of each row."""
    yield from zip(batch.column("dk").to_pylist(), batch.column("th").to_pylist(), batch.column("text").to_pylist(), strict=True)


def _padded(text: bytes) -> np.ndarray:
    return np.frombuffer(text + b"\0" * 8, np.uint8)


def _hot_keys(base: DataFrame, length: int, tasks: int, docs: int = 5_000) -> np.ndarray:
    """Hashes of grams that hold more than an eighth of a task's share of a sample's
    anchors: eight times as many as tasks at most. They decide how the work is
    dealt, not the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, text in _rows_in(b):
                for a in range(0, max(0, len(text) - length + 1), CHUNK):
                    key = anchors(_padded(text[a : a + CHUNK + length - 1]), length)[3]
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], ["key"])

    some = base.where(F.pmod("th", F.lit(max(1, base.count() // docs))) == 0).select("dk", "th", "text")
    times = cut(some.mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("n")))
    total = times.agg(F.sum("n")).first()[0] or 0
    got = times.where(F.col("n") > max(64, total // (8 * tasks))).select("key").collect()
    return np.sort(np.array([r["key"] for r in got], dtype=np.int64).view(np.uint64))


def _first_digit(length: int, tasks: int, hot: np.ndarray):
    """Extraction: for each task of the next step one packed row of anchors. Those
    of ``hot`` grams are dealt by their context; those whose context came before
    in the same lot are covered, go anywhere and are marked."""
    kinds = [("key", "<u8"), ("ctx", "<u8"), ("ctx2", "<u8"), ("doc", "<u4"), ("pos", "<i8"), ("back", "u1"), ("more", "u1")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        docs: list[tuple[int, int]] = []
        held: list[np.ndarray] = []
        count = 0

        def flush():
            rows = np.concatenate(held)
            ids = np.array(docs, dtype=np.int64)
            rank = np.unique(ids, axis=0, return_inverse=True)[1].reshape(-1)
            of = rank[rows["doc"]]
            order = np.lexsort((rows["pos"], of, rows["ctx2"], rows["ctx"], rows["key"]))
            rows, of = rows[order], of[order]
            same = np.concatenate([[False], np.logical_and.reduce([rows[k][1:] == rows[k][:-1] for k in ("key", "ctx", "ctx2")])])
            # a repeated row is the same document: its anchors count once
            once = ~(same & np.concatenate([[False], (of[1:] == of[:-1]) & (rows["pos"][1:] == rows["pos"][:-1])]))
            rows, again = rows[once], same[once]
            key = np.where(np.isin(rows["key"], hot), rows["ctx2"], rows["key"]) if len(hot) else rows["key"]
            key = np.where(again, rows["ctx"] * _C[1] + rows["pos"].astype(np.uint64) * _C[2] + rows["doc"] * _C[3], key)
            task = (key >> np.uint64(20)) % np.uint64(tasks)
            by = np.argsort(task, kind="stable")
            ends = np.searchsorted(task[by], np.arange(tasks), side="right")
            out, start = {"task": [], "blob": []}, 0
            for t, end in enumerate(ends.tolist()):
                if end > start:
                    mine, seen = rows[by[start:end]], again[by[start:end]]
                    used, inv = np.unique(mine["doc"], return_inverse=True)
                    mine = mine.copy()
                    mine["doc"] = inv
                    parts = [ids[used].astype("<i8").tobytes(), *(np.ascontiguousarray(mine[k]).tobytes() for k, _ in kinds), np.packbits(seen).tobytes()]
                    out["task"].append(t)
                    out["blob"].append(struct.pack("<II", len(used), len(mine)) + squeeze.compress(b"".join(parts)))
                start = end
            docs.clear(), held.clear()
            return pa.RecordBatch.from_pydict({"task": pa.array(out["task"], pa.int32()), "blob": pa.array(out["blob"], pa.binary())})

        for b in batches:
            for dk, th, text in _rows_in(b):
                if text is None or len(text) < length:
                    continue
                docs.append((dk, th))
                for a in range(0, len(text) - length + 1, CHUNK):
                    p, low, high, key, ctx, ctx2 = anchors(_padded(text[a : a + CHUNK + length - 1]), length)
                    r = np.empty(len(p), kinds)
                    r["key"], r["ctx"], r["ctx2"], r["doc"], r["pos"] = key, ctx, ctx2, len(docs) - 1, p + a
                    r["back"], r["more"] = p - low, high - low
                    held.append(r)
                    count += len(r)
                if count >= 1_000_000:
                    yield flush()
                    count = 0
        if held:
            yield flush()

    def unpack(blob: bytes):
        n_docs, n = struct.unpack("<II", blob[:8])
        data, at = zstandard.ZstdDecompressor().decompress(blob[8:]), 16 * n_docs
        ids = np.frombuffer(data[:at], "<i8").reshape(n_docs, 2)
        cols = {}
        for k, kind in kinds:
            size = np.dtype(kind).itemsize * n
            cols[k] = np.frombuffer(data[at : at + size], kind)
            at += size
        cols["again"] = np.unpackbits(np.frombuffer(data[at:], np.uint8), count=n).astype(bool)
        doc = cols.pop("doc")
        cols["dk"], cols["th"] = ids[doc, 0], ids[doc, 1]
        return cols

    return run, unpack


FOUND = "dk long, th long, start long, stop long, key long, pos long, hot boolean"


def _group_first_digit(unpack, length: int, hot: np.ndarray):
    """Anchors by first digit: those alone go; of equal contexts all but the
    first are covered (key null); first ones beside other contexts go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [unpack(x) for b in batches for x in b.column("blob").to_pylist()]
        if not blobs:
            return
        c = {k: np.concatenate([x[k] for x in blobs]) for k in blobs[0]}
        del blobs
        order = np.lexsort((c["pos"], c["th"], c["dk"], c["ctx2"], c["ctx"], c["key"], c["again"]))
        c = {k: x[order] for k, x in c.items()}
        # a repeated row is the same document: its anchors count once
        twice = np.logical_and.reduce([c[k][1:] == c[k][:-1] for k in ("key", "ctx", "ctx2", "dk", "th", "pos", "again")])
        c = {k: x[np.concatenate([[True], ~twice])] for k, x in c.items()}
        again = c["again"]
        same_key = np.concatenate([[False], (c["key"][1:] == c["key"][:-1]) & ~again[1:]])
        same = same_key & np.concatenate([[False], (c["ctx"][1:] == c["ctx"][:-1]) & (c["ctx2"][1:] == c["ctx2"][:-1])])
        group = np.cumsum(~same_key) - 1
        contexts = np.bincount(group, weights=~same).astype(np.int64)[group]
        if len(hot):  # their contexts are in several tasks
            contexts = np.where(np.isin(c["key"], hot), HOT + 1, contexts)
        ask, same = ~same & ~again & (contexts > 1), same | again
        start = c["pos"] - c["back"]
        stop = start + c["more"] + length
        for pick, on in ((same, False), (ask, True)):
            at = np.flatnonzero(pick)
            for a in range(0, len(at), 50_000):
                i = at[a : a + 50_000]
                none = np.full(len(i), not on)
                yield pa.RecordBatch.from_arrays([
                    pa.array(c["dk"][i]), pa.array(c["th"][i]), pa.array(start[i]), pa.array(stop[i]),
                    pa.array(c["key"][i].view(np.int64), mask=none), pa.array(c["pos"][i], mask=none), pa.array(contexts[i] > HOT, mask=none),
                ], [x.split()[0] for x in FOUND.split(", ")])

    return run


#: Rows of windows that are combined before they are dealt out.
LOT = 100_000
ASKED = "key long, rel int, dk long, th long, start long, bytes binary, n int"


def _contexts(length: int):
    """The bytes behind each open anchor; windows under a hot digit one by one, as
    digests (``n`` is 0), dealt out by them. Of equal ones in a lot the first goes
    on; the others are covered (``n`` is -1) and go anywhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in ASKED.split(", ")]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32()]
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            out, last = [r for r in rows if r[6]], None
            for r in sorted((r for r in rows if not r[6]), key=lambda r: (r[5], r[1], r[2], r[3], r[4])):
                if last is not None and r[5] == last[5] and r[1] == last[1]:
                    if r[2:5] != last[2:5]:  # else a repeated row
                        out.append(((r[3] ^ r[4] * 2654435761) & (2**63 - 1), 0, *r[2:5], b"", -1))
                else:
                    out.append(r)
                last = r
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)

        for b in batches:
            for (dk, th, text), asks in zip(_rows_in(b), b.column("asks").to_pylist(), strict=True):
                text = bytes(text)
                for x in asks:
                    start, stop, pos = x["start"], x["stop"], x["pos"]
                    if not x["hot"]:
                        rows.append((x["key"], pos - start, dk, th, start, text[start:stop], stop - start - length + 1))
                        held += stop - start
                        if held >= 8 << 20:
                            yield flush()
                            rows, held = [], 0
                        continue
                    for s in range(start, stop - length + 1):
                        w = hashlib.blake2b(text[s : s + length], digest_size=DIGEST).digest()
                        rows.append((int.from_bytes(w[:8], "little", signed=True), pos - s, dk, th, s, w, 0))
                    if len(rows) >= LOT:
                        yield flush()
                        rows = []
        if rows:
            yield flush()

    return run


def repeated(buf: np.ndarray, at: np.ndarray, group: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Of the windows at ``at`` those equal to one of smaller ``order`` in their
    group: radix passes of eight bytes, most significant first; after each pass
    windows that are alone are dropped."""
    v = _words(buf)
    live, cls = np.arange(len(at)), group
    for d in [*range(0, length - 8, 8), length - 8]:
        digit = v[at[live] + d]
        by = np.lexsort((digit, cls))
        live, cls, digit = live[by], cls[by], digit[by]
        new = np.concatenate([[True], (cls[1:] != cls[:-1]) | (digit[1:] != digit[:-1])])
        cls = np.cumsum(new) - 1
        keep = np.bincount(cls)[cls] > 1
        live, cls = live[keep], cls[keep]
        if not len(live):
            return live
    by = np.lexsort((order[live], cls))
    live, cls = live[by], cls[by]
    return live[np.concatenate([[False], cls[1:] == cls[:-1]])]


def _judge(length: int):
    """Later digits: covered runs of windows of the rows under each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        windows = 0

        def covered(lots: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(lots).combine_chunks()
            yield from (x for single in (False, True) if (x := covered_part(t.filter(pc.equal(pc.equal(t.column("n"), 0), single)), single)))

        def covered_part(t: pa.Table, single: bool) -> pa.RecordBatch | None:
            if not len(t):
                return None
            t = t.combine_chunks()
            col = {k: t.column(k).to_numpy() for k in ("key", "rel", "dk", "th", "start", "n")}
            # repeated rows have asked once each; their windows count once
            by = np.lexsort(tuple(col.values()))
            twice = by[1:][np.logical_and.reduce([x[by[1:]] == x[by[:-1]] for x in col.values()])]
            if len(twice):
                t = t.take(pa.array(np.setdiff1d(by, twice)))
                col = {k: t.column(k).to_numpy() for k in col}
            text = t.column("bytes").to_pylist()
            size = np.maximum(col["n"], 1).astype(np.int64)
            row = np.repeat(np.arange(len(size)), size)
            step = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            base = np.cumsum([0, *map(len, text[:-1])]) if text else np.zeros(0, np.int64)
            buf = np.frombuffer(b"".join(text) + b"\0" * 8, np.uint8)
            start, rel = col["start"][row] + step, col["rel"][row] - step
            # equal windows have their anchor at the same place
            by = np.lexsort((rel, col["key"][row]))
            k, r = col["key"][row][by], rel[by]
            group = np.empty(len(by), np.int64)
            group[by] = np.cumsum(np.concatenate([[0], ((k[1:] != k[:-1]) | (r[1:] != r[:-1])).astype(np.int64)]))
            place = np.empty(len(row), np.int64)
            place[np.lexsort((start, col["th"][row], col["dk"][row]))] = np.arange(len(row))
            hit = np.zeros(len(row), bool)
            hit[repeated(buf, base[row] + step, group, place, DIGEST if single else length)] = True
            # runs of neighbouring windows of one row
            prior = np.concatenate([[False], hit[:-1] & (row[1:] == row[:-1])])
            follow = np.concatenate([hit[1:] & (row[1:] == row[:-1]), [False]])
            a, z = np.flatnonzero(hit & ~prior), np.flatnonzero(hit & ~follow)
            return pa.RecordBatch.from_arrays(
                [pa.array(col["dk"][row[a]]), pa.array(col["th"][row[a]]), pa.array(start[a]), pa.array(start[z] + length)], ["dk", "th", "start", "stop"]
            )

        for b in batches:
            done = pc.equal(b.column("n"), -1)
            if (known := b.filter(done)).num_rows:
                yield pa.RecordBatch.from_arrays([known.column("dk"), known.column("th"), known.column("start"), pc.add(known.column("start"), length)], ["dk", "th", "start", "stop"])
                b = b.filter(pc.invert(done))
            while len(b):
                if windows < 200_000:
                    held.append(b)
                    windows += int(np.maximum(b.column("n").to_numpy(), 1).sum())
                    b = b.slice(len(b))
                    continue
                # go on to the end of the last key
                last = held[-1].column("key")[-1].as_py()
                end = int(np.searchsorted(b.column("key").to_numpy() != last, True))
                if end:
                    held.append(b.slice(0, end))
                    b = b.slice(end)
                if len(b):
                    yield from covered(held)
                    held, windows = [], 0
        if held:
            yield from covered(held)

    return run


REST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"


def _cut_out(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for (dk, _, text), spans, known in zip(_rows_in(b), b.column("spans").to_pylist(), b.column("known").to_pylist(), strict=True):
                text, kept, end, removed, n = bytes(text), [], 0, 0, 0
                last = None
                for s in sorted((x["start"], x["stop"]) for x in spans or ()):
                    if last is None or s[0] > last:
                        kept.append(text[end if last is None else last : s[0]])
                        n, removed, last = n + 1, removed + s[1] - s[0], s[1]
                    elif s[1] > last:
                        removed, last = removed + s[1] - last, s[1]
                kept = b"".join([*kept, text[last or 0 :]])
                out.append((dk if known else None, len(text), removed, n, kept if keep_text else None, hashlib.sha256(kept).hexdigest()))
            types = [pa.int64()] * 4 + [pa.binary(), pa.string()]
            cols = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], [x.split()[0] for x in REST.split(", ")])

    return run


def remove_repeats(docs: DataFrame, length: int = 100, keep_text: bool = True) -> DataFrame:
    """Remove from each text every byte that a ``length``-byte string covers which
    also starts earlier in the corpus: in a document of smaller doc_id, or in the
    same document at an earlier byte. Matches don't cross documents, overlaps
    count, and strings are judged on the input.

    ``docs(doc_id, text)``; result: doc_id, n_bytes, n_removed, n_spans (maximal
    removed runs), kept (the bytes left; null without ``keep_text``) and
    kept_sha256, one row for each input row. Texts are UTF-8 bytes; a null text is
    empty; texts under ``length`` bytes lose nothing; a null doc_id counts as
    smaller than all; rows of equal doc_id and unequal text are ordered by a hash
    of the text, rows that repeat both are one document and get one result each.
    """
    if length < 2 * GRAM or length > GRAM + 255:
        raise ValueError(f"length must be {2 * GRAM} to {GRAM + 255}")
    spark = docs.sparkSession
    tasks = partitions(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("dk"), F.xxhash64(text).alias("th"),
        text.cast("binary").alias("text"), F.col("doc_id").isNotNull().alias("known"),
    )
    hot = _hot_keys(base, length, tasks)
    extract, unpack = _first_digit(length, tasks, hot)
    packed = base.mapInArrow(extract, "task int, blob binary").repartition(tasks, "task")
    found = cut(packed.mapInArrow(_group_first_digit(unpack, length, hot), FOUND))

    asks = found.where("key is not null").groupBy("dk", "th").agg(F.collect_list(F.struct("start", "stop", "key", "pos", "hot")).alias("asks"))
    # Both joins read the same columns, so that one exchange of the texts serves both.
    rows = base.join(asks, ["dk", "th"]).select("dk", "th", "text", "known", "asks").mapInArrow(_contexts(length), ASKED)
    rows = rows.repartition(tasks, "key").sortWithinPartitions("key")
    later = rows.mapInArrow(_judge(length), "dk long, th long, start long, stop long")

    spans = found.where("key is null").select("dk", "th", "start", "stop").union(later)
    spans = spans.groupBy("dk", "th").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    whole = base.join(spans, ["dk", "th"], "left").select("dk", "th", "text", "known", "spans")
    return whole.mapInArrow(_cut_out(keep_text), REST)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, spans and the digest of what is left of every document."""
    return remove_repeats(table(spark, sf_dir, "documents"), keep_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
