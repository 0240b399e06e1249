"""Packing documents into fixed training windows: best-fit decreasing with a
segment tree over the remaining capacities of the open windows."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, table

WINDOW = 1024
END_ID = 0
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECE + ", sequence_id long, offset long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def encoder(path: str):
    """text -> ids. For a byte-level BPE whose ranks lie beside its JSON file
    (same vocabulary, same ids) those are used, at about six times the speed;
    otherwise the JSON file itself. Special tokens' strings are plain text."""
    import os

    if os.path.exists(ranks_path := path.removesuffix(".json") + ".tiktoken"):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def cut_pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Token pieces of every document: full windows first, then what is left.
    A null text is empty and has the end id only."""

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer)
        names = [x.split()[0] for x in PIECE.split(", ")]
        for p in parts:
            rows = []
            for doc_id, text in zip(p["doc_id"], p["text"], strict=True):
                ids = np.array([*encode(text or ""), end_id], dtype=np.uint32)
                rows += [(doc_id, s, min(window, len(ids) - s), crc(ids[s : s + window]), len(ids)) for s in range(0, len(ids), window)]
            yield pd.DataFrame(rows, columns=names)

    # Ids as strings: whole numbers stay exact beside nulls.
    pieces = docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(cut, PIECE.replace("doc_id long", "doc_id string"))
    return pieces.withColumn("doc_id", F.col("doc_id").cast("long"))


class OpenWindows:
    """Open windows by remaining capacity. ``tree`` is a segment tree over the
    capacities 0..size-1, each node telling whether any window lies below it."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.tree = bytearray(2 * self.size)
        self.at: list[list] = [[] for _ in range(self.size)]

    def put(self, capacity: int, item) -> None:
        self.at[capacity].append(item)
        i = capacity + self.size
        while i and not self.tree[i]:
            self.tree[i] = 1
            i >>= 1

    def tightest(self, need: int):
        """(capacity, window) with the least capacity >= need, taken out; None
        where no open window has room."""
        tree, i = self.tree, need + self.size
        if not tree[i]:
            while i & 1 or not tree[i + 1]:  # up, until something is used on the right
                i >>= 1
                if not i:
                    return None
            i += 1
        while i < self.size:
            i = 2 * i if tree[2 * i] else 2 * i + 1
        capacity = i - self.size
        item = self.at[capacity].pop()
        if not self.at[capacity]:
            tree[i] = 0
            i >>= 1
            while i and not (tree[2 * i] or tree[2 * i + 1]):
                tree[i] = 0
                i >>= 1
        return capacity, item


def best_fit(lengths: Iterator[int], window: int = WINDOW) -> Iterator[tuple[int, int]]:
    """(sequence, offset) for each of ``lengths``, which must not increase."""
    free, made = OpenWindows(window), 0
    for n in lengths:
        if (found := free.tightest(n)) is None:
            capacity, sequence, made = window, made, made + 1
        else:
            capacity, sequence = found
        yield sequence, window - capacity
        if capacity > n:
            free.put(capacity - n, sequence)


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """``docs(doc_id, text)`` cut and packed into windows of ``window`` tokens.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens (with the
    end id), sequence_id, offset. Every document has at least its end id, so
    null and empty texts are packed too; repeated rows are packed as often as
    they occur; a null doc_id stays null; an empty table gives no rows.

    Only the pieces' lengths are shuffled, spread by hash; each task packs its
    own share, largest piece first, so tasks are independent and repeatable. A
    task keeps its open windows only.
    """
    spark = docs.sparkSession
    pieces = cut_pieces(docs, tokenizer or default_tokenizer(), window, end_id)
    dealt = pieces.repartition(partitions(spark), "doc_id", "start", "ids_crc32").sortWithinPartitions(F.desc("length"), "doc_id", "start", "ids_crc32")

    def fill(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = TaskContext.get().partitionId() << 40
        lengths: list[int] = []

        def feed():
            while True:
                yield lengths.pop()

        places = best_fit(feed(), window)
        for p in parts:
            got = []
            for n in p["length"].tolist():
                lengths.append(n)
                got.append(next(places))
            at = np.array(got, dtype=np.int64).reshape(-1, 2)
            yield p.assign(sequence_id=at[:, 0] + first, offset=at[:, 1])

    named = dealt.select(F.col("doc_id").cast("string"), *[x.split()[0] for x in PIECE.split(", ")[1:]])
    return named.mapInPandas(fill, PACKED.replace("doc_id long", "doc_id string")).withColumn("doc_id", F.col("doc_id").cast("long"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places."""
    return pack(table(spark, sf_dir, "documents"))
