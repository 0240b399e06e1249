"""Near-duplicate documents by the Jaccard similarity of their shingle sets.

A SimHash grid finds most links and with them the large groups; a prefix-filter
join on the sets finds every link that is left between unlike groups.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, join_hot, partitions, spare
from .simhash import SEEDS, _majority, grid_links, sampled_masks, shingles

NO_ID = -(2**63)
#: Grid tables, least two-bit segments that each looks at, bits that may differ,
#: texts that a cell should hold. They decide how much is left to the prefix join,
#: not the result.
TABLES, SEGMENTS, LIMIT, CELL = 60, 9, 32, 16
#: Documents in which common shingles are counted and the most that are told
#: apart; these, too, decide the work only: any order of the shingles is exact.
COUNTED, COMMON = 2_000, 100_000
#: Buckets of a set's hashes whose counts bound what two sets share: of those kept
#: for each set, and of those that travel with each shingle.
BUCKETS, FEW = 128, 16


def segments_for(classes: int) -> int:
    """Segments such that a table's cells grow with the number of texts: one of
    three counts, of chances 1/4, 1/2, 1/4, has an entropy of 1.5 bits."""
    return max(SEGMENTS, math.ceil(math.log2(max(1, classes) / CELL) / 1.5)) if classes > CELL else SEGMENTS


def shingle_set(text: str | None, words: int) -> tuple[np.ndarray, list[bytes]]:
    """Sorted hashes of the distinct shingles, and one shingle for each."""
    s = shingles(text, words)
    h, first = np.unique(np.array([xxhash.xxh64_intdigest(x, SEEDS[0]) for x in s], dtype=np.uint64), return_index=True)
    return h, [s[i] for i in first.tolist()]


def sketch(h: np.ndarray) -> bytes | None:
    """How many of the hashes fall in each bucket; none where a byte can't hold it."""
    c = np.bincount((h % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
    return c.astype(np.uint8).tobytes() if c.max() < 256 else None


def may_share(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """The (a, b) of ``pairs`` without those whose sketches rule the similarity out:
    two sets share at most the lesser count in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("ka").to_pylist(), b.column("kb").to_pylist(), strict=True):
                if x is None or y is None:
                    keep.append(True)
                    continue
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                most = int(np.minimum(x, y).sum(dtype=np.int64))
                keep.append((1 + similarity) * most >= similarity * (int(x.sum(dtype=np.int64)) + int(y.sum(dtype=np.int64))) - 1e-6)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    beside = pairs.join(classes.select(F.col("id").alias("a"), F.col("sk").alias("ka")), "a").join(classes.select(F.col("id").alias("b"), F.col("sk").alias("kb")), "b")
    return beside.select("a", "b", "ka", "kb").mapInArrow(run, "a long, b long")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("dk"), F.xxhash64(text).alias("th"), text.alias("text"))


def signatures(keyed: DataFrame, words: int) -> DataFrame:
    """(dk, th, id, f0, f1, sk): a digest of the shingle set, its 128-bit SimHash and its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, sk = np.empty((b.num_rows, 3), np.uint64), []
            for i, t in enumerate(b.column("text").to_pylist()):
                h, s = shingle_set(t, words)
                more = np.array([xxhash.xxh64_intdigest(x, SEEDS[1]) for x in s], dtype=np.uint64)
                digest = hashlib.blake2b(h.astype("<u8").tobytes(), digest_size=8).digest()
                out[i] = int.from_bytes(digest, "little"), _majority(h), _majority(more)
                sk.append(sketch(h))
            cols = [pa.array(out[:, k].copy().view(np.int64)) for k in range(3)]
            yield pa.RecordBatch.from_arrays([b.column("dk"), b.column("th"), *cols, pa.array(sk, pa.binary())], ["dk", "th", "id", "f0", "f1", "sk"])

    return keyed.mapInArrow(run, "dk long, th long, id long, f0 long, f1 long, sk binary")


def verified(pairs: DataFrame, keyed: DataFrame, classes: DataFrame, words: int, similarity: float) -> DataFrame:
    """The (a, b) of ``pairs`` whose shingle sets have that Jaccard similarity."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    wanted = classes.join(ids, "id", "left_semi").select("id", "rep.dk", "rep.th")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = [shingle_set(t, words)[0].astype("<u8").tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(h, pa.binary())], ["id", "h"])

    bags = keyed.join(wanted, ["dk", "th"]).select("id", "text").dropDuplicates(["id"]).mapInArrow(sets, "id long, h binary")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("ha").to_pylist(), b.column("hb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                n = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(n >= similarity * (len(x) + len(y) - n) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    beside = pairs.join(bags.select(F.col("id").alias("a"), F.col("h").alias("ha")), "a").join(bags.select(F.col("id").alias("b"), F.col("h").alias("hb")), "b")
    return beside.select("a", "b", "ha", "hb").mapInArrow(compare, "a long, b long")


def _common(keyed: DataFrame, words: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, of shingles that several of about COUNTED documents have, and in how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column("text").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t, words)[0].view(np.int64))], ["h"])

    some = keyed.where(F.pmod("th", F.lit(max(1, rows // COUNTED))) == 0).select("text")
    got = some.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("c")).where("c > 2").orderBy(F.desc("c"), "h").limit(COMMON).toPandas().sort_values("h")
    return got["h"].to_numpy(np.int64), got["c"].to_numpy(np.int64)


def meetings(n):
    """Of how many shingles at the front two sets are asked to share."""
    return 1 + n // 20


def prefix_pairs(named: DataFrame, keyed: DataFrame, words: int, similarity: float) -> DataFrame:
    """(a, b), a < b: among them every pair of ``named(id, dk, th, label)`` of unlike
    labels whose sets have that similarity.

    Of n shingles a partner shares ``similarity * n`` or more, so in any one order
    of all shingles the first n - ceil(similarity * n) + m of two such sets have m
    in common, for every m. With m = ``meetings(n)``, a twentieth of the set, most texts
    that share no more than a passage aren't proposed; the smaller set's m is what
    a pair needs. Common shingles come last in the order. Sizes and the places of a
    shared shingle bound the overlap, too, and so do the counts of all of a set's
    hashes in FEW buckets, which travel with them; pairs under a bound go at once.
    """
    spark = keyed.sparkSession
    common, times = _common(keyed, words, named.count())
    kinds = [("h", pa.int64()), ("n", pa.int32()), ("id", pa.int64()), ("label", pa.int64()), ("pos", pa.int32()), ("s0", pa.int64()), ("s1", pa.int64())]

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, label, t in zip(*(b.column(x).to_pylist() for x in ("id", "label", "text")), strict=True):
                h = shingle_set(t, words)[0].view(np.int64)
                n = len(h)
                if not n:
                    continue
                c = np.zeros(n, np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                    c = np.where(common[at] == h, times[at], 0)
                few = np.bincount((h >> 32) & (FEW - 1), minlength=FEW)
                # a byte holds up to 254; beyond, nothing is known of the set
                few = np.full(FEW, 255, np.uint8) if few.max() > 254 else few.astype(np.uint8)
                h = h[np.lexsort((h, c))[: n - math.ceil(similarity * n - 1e-6) + meetings(n)]]
                k = len(h)
                cols = [h, np.full(k, n), np.full(k, i), np.full(k, label), np.arange(k), *(np.full(k, v) for v in few.view(np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(cols, kinds, strict=True)], [x for x, _ in kinds])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fits(m: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
            x, y = m[i, 1], m[j, 1]
            most = np.minimum(m[i, 4], m[j, 4]) + 1 + np.minimum(x - m[i, 4], y - m[j, 4]) - 1
            enough = (1 + similarity) * most >= similarity * (x + y) - 1e-6
            return (m[i, 3] != m[j, 3]) & enough & (np.minimum(x, y) >= similarity * np.maximum(x, y) - 1e-6)

        def alike(m: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
            few = np.ascontiguousarray(m[:, 5:7]).view(np.uint8)
            most = np.concatenate([np.minimum(few[i[a : a + 65_536]], few[j[a : a + 65_536]]).sum(1, dtype=np.int64) for a in range(0, len(i), 65_536)] or [np.zeros(0, np.int64)])
            return (few[i, 0] == 255) | (few[j, 0] == 255) | ((1 + similarity) * most >= similarity * (m[i, 1] + m[j, 1]) - 1e-6)

        def out(m: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
            pair = np.stack([np.minimum(m[i, 2], m[j, 2]), np.maximum(m[i, 2], m[j, 2]), meetings(np.minimum(m[i, 1], m[j, 1]))], axis=1)
            p, times = np.unique(pair, axis=0, return_counts=True)
            return pa.RecordBatch.from_arrays([*(pa.array(p[:, k].copy()) for k in range(3)), pa.array(times.astype(np.int64))], ["a", "b", "need", "times"])

        def pairs(m: np.ndarray) -> Iterator[pa.RecordBatch]:
            edge = np.flatnonzero(np.diff(m[:, 0])) + 1
            starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(m)]])
            size = ends - starts
            run, place = np.repeat(size, size), np.arange(len(m)) - np.repeat(starts, size)
            short, a, b = run <= 32, [], []
            for d in range(1, min(32, int(size.max()))):
                i = np.flatnonzero(short & (place + d < run))
                if not len(i):
                    break
                i = i[fits(m, i, i + d)]
                i = i[alike(m, i, i + d)]
                a.append(i), b.append(i + d)
            if sum(map(len, a)):
                yield out(m, np.concatenate(a), np.concatenate(b))
            for s, e in zip(starts[size > 32], ends[size > 32], strict=True):
                part = m[s:e]
                labels, which, many = np.unique(part[:, 3], return_inverse=True, return_counts=True)
                # one of each pair is outside the most frequent label
                major = which == many.argmax()
                few, step = np.flatnonzero(~major), max(1, 1_000_000 // len(part))
                for f in range(0, len(few), step):
                    i, j = few[f : f + step][:, None], np.arange(len(part))[None, :]
                    x, y = np.nonzero(fits(part, i, j) & (major[j] | (i < j)))
                    x = few[f : f + step][x]
                    keep = alike(part, x, y)
                    if keep.any():
                        yield out(part, x[keep], y[keep])

        held: list[np.ndarray] = []
        for batch in batches:
            if not len(batch):
                continue
            m = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for c in batch.columns])
            if held and held[-1][-1, 0] == m[-1, 0]:
                held.append(m)
                continue
            # the last run may go on in the next batch
            last = int(np.searchsorted(m[:, 0], m[-1, 0]))
            whole, held = np.concatenate([*held, m[:last]]), [m[last:]]
            if len(whole) > 1:
                yield from pairs(whole)
        if held:
            yield from pairs(np.concatenate(held))

    texts = keyed.join(named, ["dk", "th"]).select("id", "label", "text")
    rows = texts.mapInArrow(prefixes, "h long, n int, id long, label long, pos int, s0 long, s1 long")
    dealt = rows.repartition(partitions(spark), "h").sortWithinPartitions("h")
    found = dealt.mapInArrow(search, "a long, b long, need long, times long")
    return found.groupBy("a", "b").agg(F.sum("times").alias("times"), F.min("need").alias("need")).where("times >= need").select("a", "b")


def near_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, tables: int = TABLES, segments: int | None = None, limit: int = LIMIT) -> DataFrame:
    """(dk, th, first_dk, first_th): for every row of ``docs(doc_id, text)`` its key
    (doc_id, null as the least long; hash of the text) and the least key of its
    group. Groups are the components of the links of Jaccard similarity
    ``similarity`` or more between the texts' sets of ``words``-word shingles.

    Texts of equal shingle sets are one class, linked whatever their number;
    texts without words (null, empty) are such a class. Between classes the grid
    over the popcounts of the fingerprints' segments proposes pairs within
    ``limit`` bits, or a forest of them where a cell is dense; the prefix join
    then proposes every link between what the grid has left apart. All pairs are
    verified on the sets themselves, so the groups are exact. Rows that repeat
    doc_id and text have one key. An empty table gives no rows.
    """
    keyed = _keyed(docs)
    sig = cut(signatures(keyed, words))
    classes = cut(sig.groupBy("id").agg(F.min(F.struct("dk", "th")).alias("rep"), F.min("f0").alias("f0"), F.min("f1").alias("f1"), F.first("sk").alias("sk"), F.count("*").alias("copies")))
    points, masks = classes.select("id", "f0", "f1"), sampled_masks(tables, min(64, segments or segments_for(classes.count())))
    links = cut(grid_links(points, masks, limit))
    pairs = links.where("a is not null").select("a", "b").distinct()
    linked = cut(verified(pairs, keyed, classes, words, similarity))
    roots = connected_components(linked.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    named = cut(classes.join(roots, classes["id"] == roots["node"], "left").select("id", "rep.dk", "rep.th", F.coalesce("root", "id").alias("label")))
    rest = cut(prefix_pairs(named, keyed, words, similarity).join(pairs, ["a", "b"], "left_anti"))
    rest = cut(may_share(rest, classes, similarity))
    more = cut(verified(rest, keyed, classes, words, similarity))
    if more.limit(1).count():
        roots = connected_components(linked.union(more).select(F.col("a").alias("src"), F.col("b").alias("dst")))
    placed = classes.join(roots, classes["id"] == roots["node"], "left").select("id", "rep", "copies", F.coalesce("root", "id").alias("root"))
    least = placed.groupBy("root").agg(F.min("rep").alias("first"), F.count("*").alias("members"))
    # A group or a set of shingles may hold a third of all rows.
    of = join_hot(placed.select("id", "copies", "root"), least, ["root"], "members", classes.count()).select("id", "copies", "first")
    return join_hot(sig.select("dk", "th", "id"), of, ["id"], "copies", sig.count()).select("dk", "th", F.col("first.dk").alias("first_dk"), F.col("first.th").alias("first_th"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group, that of the least doc_id (then
    hash of the text); all columns stay. A null doc_id is less than any other;
    rows that repeat doc_id and text stay together."""
    g = near_groups(docs, words, similarity)
    dk, th = spare(docs, "dk", "th")
    gone = g.where("dk <> first_dk OR th <> first_th").select(F.col("dk").alias(dk), F.col("th").alias(th)).distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.withColumns({dk: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), th: F.xxhash64(text)})
    return keyed.join(gone, [dk, th], "left_anti").select(*docs.columns)
