"""The bounded labelled sample that the two chain classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Characters that a sample may hold.
CHARS = 24_000_000


def fold(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; null ids are in no fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % of


def sample(docs: DataFrame, labels: DataFrame, label: str, of: int, held_out: int, rows: int, chars: int = CHARS) -> DataFrame | None:
    """(doc_id, text, y): at most ``rows`` labelled texts outside the held-out fold,
    by hash of the id, of ``chars`` characters together at most; None if there are none.

    Texts of any length are examples: where the characters would run out the sample
    has fewer rows, the first by hash (only a text of more than ``chars`` by itself
    is passed over). Sizes are looked at first, so only the sample's texts are
    brought together. Null labels and ids are no examples; an id labelled twice counts
    once, with the smaller label, and one of several texts with the shortest."""
    known = labels.where(F.col(label).isNotNull() & (fold(F.col("doc_id"), of) != held_out)).groupBy("doc_id").agg(F.min(label).alias("y"))
    text = F.coalesce("text", F.lit(""))
    sized = docs.select("doc_id", F.struct(F.length(text).alias("n"), text.alias("text")).alias("t"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sizes = sized.select("doc_id", "t.n").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("n").alias("n"), F.min("y").alias("y"), F.min(F.xxhash64("doc_id")).alias("h")).collect()  # ``rows`` at most
    got, held = {}, 0
    for r in sorted(sizes, key=lambda r: (r["h"], r["doc_id"])):
        if r["n"] > chars:
            continue
        held += r["n"]
        if held > chars:
            break
        got[r["doc_id"]] = int(r["y"])
    if not got:
        return None
    ids = docs.sparkSession.createDataFrame(list(got.items()), docs.select("doc_id").schema.add("y", "long"))
    return sized.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("t").alias("t"), F.min("y").alias("y")).select("doc_id", "t.text", "y")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, of: int, held_out: int, rows: int, chars: int = CHARS) -> list[tuple[str, int]]:
    """The (text, label) pairs of ``sample``, in the driver."""
    texts = sample(docs, labels, label, of, held_out, rows, chars)
    return [] if texts is None else in_order(texts.collect())


def in_order(texts: list) -> list[tuple[str, int]]:
    """(text, label) pairs of (doc_id, text, y), by id: the order that a fit sees."""
    return [(t, y) for _, t, y in sorted(texts)]
