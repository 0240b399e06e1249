"""Spelling variants of a corpus' words: each word's most frequent neighbour
within one inserted, deleted or replaced code point, by wildcard groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut, table

#: Least code points and occurrences of a word, and how many times as frequent its form is.
LEAST, TIMES, RATIO = 7, 2, 10
LETTER = "[A-Za-z\\u00C0-\\u00FF]"
#: Primes under 2^31 and bases of the four hashes that make a key of 124 bits.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1000003, 1299709, 15485863, 32452843)
KEYS = "k1 long, k2 long, pos int, lead boolean, r long"


def words(docs: DataFrame, least: int = LEAST, times: int = TIMES, every: int = 31) -> DataFrame:
    """(word, n): the texts' maximal runs of letters, A-Z lower-cased, of at least
    ``least`` code points that stand at least ``times`` times.

    Where ``every`` divides the crc32 of "<doc_id>:<run>", the run's code point at
    that number modulo its length is left out first. Null texts and texts of a null
    doc_id have no words. Runs too short for a word are never rows; the rest is
    counted before it is shuffled."""
    run = F.explode(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(f"({LETTER}{{{least},}})"), 1))
    runs = docs.where("doc_id is not null").select(F.col("doc_id").cast("string").alias("d"), run.alias("run"))
    h = F.crc32(F.concat("d", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    whole = F.when(F.col("h") % every == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    kept = runs.withColumn("h", h).select(whole.alias("word")).where(F.length("word") >= least)
    return kept.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= times)


def ranked(counted: DataFrame) -> DataFrame:
    """(r, word, n): ``r`` grows with falling n, ties by code points, so that the
    least ``r`` is the best form. Written once: ranges are drawn anew otherwise."""
    return cut(counted.orderBy(F.desc("n"), "word").withColumn("r", F.monotonically_increasing_id()).select("r", "word", "n"))


def wildcards(points: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For words of one length (a row of code points each): per prime the hash of
    each word, and of each word without each of its code points.

    A hash is a polynomial in the base, so that the hash without code point i comes
    from those of the prefix and the rest: the time is linear in the word."""
    m, size = points.shape
    whole, without = [], []
    for p, b in zip(PRIMES, BASES, strict=True):
        prefix, power = np.zeros((m, size + 1), np.int64), np.ones(size, np.int64)
        for i in range(size):
            prefix[:, i + 1] = (prefix[:, i] * b + points[:, i]) % p
        for i in range(1, size):
            power[i] = power[i - 1] * b % p
        behind = power[::-1]
        rest = (prefix[:, -1:] - prefix[:, 1:] * behind % p) % p
        whole.append(prefix[:, -1])
        without.append((prefix[:, :-1] * behind + rest) % p)
    return whole, without


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The key of each word (pos -1) and of each place left out (pos from 0; ``lead``
    unless the place before gives the same letters), with the word's rank."""
    for batch in batches:
        ranks, texts = batch.column("r").to_numpy(), batch.column("word").to_pylist()
        sizes = np.array([len(t) for t in texts], np.int64)
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            lot = max(1, 500_000 // (int(size) + 1))
            for a in range(0, len(at), lot):
                part = at[a : a + lot]
                points = np.frombuffer("".join(texts[i] for i in part).encode("utf-32-le"), "<u4").reshape(len(part), size).astype(np.int64)
                whole, without = wildcards(points)
                k = [np.column_stack([w, x]) for w, x in zip(whole, without, strict=True)]
                lead = np.ones((len(part), size + 1), bool)
                lead[:, 2:] = points[:, 1:] != points[:, :-1]
                yield pa.RecordBatch.from_pydict({
                    "k1": (k[0] << 31 | k[1]).ravel(), "k2": (k[2] << 31 | k[3]).ravel(), "pos": np.tile(np.arange(-1, size, dtype=np.int32), len(part)),
                    "lead": lead.ravel(), "r": np.repeat(ranks[part], size + 1),
                })


def neighbours(ranks: DataFrame) -> DataFrame:
    """(r, n_near, best): of each ranked word with near words their number and least
    rank.

    A place's key holds the word without it. Words with equal key and place differ
    in that place alone: such a group keeps its size and its two least ranks, which
    give each member all others' number and the best other. Words of an equal key
    of any place are one code point longer than the word that has the key itself:
    it gets their number and least rank, and they get it. No pairs are made. Letters
    are 90 code points, so a group holds that many at most, and a key that
    many for each place in a word, however large the corpus. All is dealt once, by
    key; only members of groups of two or more go on. Keys of 124 bits count as
    equal if their words without the place are."""
    keys = ranks.select("r", "word").mapInArrow(_keyed, KEYS).repartition("k1", "k2")
    group = Window.partitionBy("k1", "k2", "pos").orderBy("r").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    key = Window.partitionBy("k1", "k2")
    longer = F.col("lead") & (F.col("pos") >= 0)
    seen = keys.select("*", F.count("*").over(group).alias("size"), F.min("r").over(group).alias("first"), F.nth_value("r", 2).over(group).alias("second")).select(
        "*", F.max(F.when(F.col("pos") < 0, F.col("r"))).over(key).alias("own"), F.count(F.when(longer, 1)).over(key).alias("n_longer"), F.min(F.when(longer, F.col("r"))).over(key).alias("longer"))
    other = F.when(F.col("r") == F.col("first"), F.col("second")).otherwise(F.col("first"))
    shorter = F.when(F.col("lead"), F.col("own"))
    found = seen.select("r", F.when(F.col("pos") < 0, F.col("n_longer")).otherwise(F.col("size") - 1 + shorter.isNotNull().cast("long")).alias("near"),
                        F.when(F.col("pos") < 0, F.col("longer")).otherwise(F.least(other, shorter)).alias("best"))
    return found.where("near > 0").groupBy("r").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(r, root) from (r, f): where the forms of forms end. Every step at least
    multiplies n, so chains are short; each round doubles the steps taken."""
    now = cut(forms.select("r", F.col("f").alias("root")))
    while True:
        onward = now.select(F.col("r").alias("root"), F.col("root").alias("_next"))
        now = cut(now.join(onward, "root", "left").select("r", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        if not now.where("moved").limit(1).count():
            return now.select("r", "root")
        now = now.select("r", "root")


def variants(docs: DataFrame, least: int = LEAST, times: int = TIMES, ratio: int = RATIO, every: int = 31) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of ``docs(doc_id, text)``.

    ``words`` says what a word is. Two are near if one inserted, deleted or replaced
    code point makes one of the other; the form is the near word of largest n (ties:
    the smallest in code-point order) if that is at least ``ratio`` times the word's,
    else null; the root is where forms end, the word itself without one. An empty
    table, null and empty texts give no words, repeated rows count as often as they
    stand, words may be of any length, and other columns are ignored."""
    ranks = ranked(words(docs, least, times, every))
    near = cut(neighbours(ranks))
    best = ranks.select(F.col("r").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    forms = cut(near.join(ranks, "r").join(best, "best").where(F.col("form_n") >= ratio * F.col("n")).select("r", F.col("best").alias("f"), "form", "form_n"))
    ends = roots(forms).join(ranks.select(F.col("r").alias("root"), F.col("word").alias("root_word")), "root").select("r", "root_word")
    out = ranks.join(near.select("r", "n_near"), "r", "left").join(forms.join(ends, "r").select("r", "form", "form_n", "root_word"), "r", "left")
    return out.select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variants of all words of the documents."""
    return variants(table(spark, sf_dir, "documents"))
