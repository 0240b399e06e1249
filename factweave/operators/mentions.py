"""Names found in texts, by an automaton over tokens that goes where the texts are."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ACCENTED, FOLDED, mention_tokens
from ..sources.shared import checkpointed
from .keyed import few

#: Tokens of a name, and characters of the names that an automaton holds, at most.
LONGEST, SHARD = 5, 16_000_000


class Automaton:
    """The names, and every way in which one of several tokens begins: from each
    token of a text a walk goes on while what it has read begins a name."""

    def __init__(self, names: list[str]):
        self.names, self.begun = set(names), set()
        for name in names:
            at = name.find(" ")
            while at >= 0:
                self.begun.add(name[:at])
                at = name.find(" ", at + 1)

    def find(self, tokens: list[str]) -> dict[str, int]:
        """Where each name that stands in ``tokens`` does so first."""
        names, begun, found = self.names, self.begun, {}
        for i, read in enumerate(tokens):
            j = i
            while True:
                if read in names and read not in found:
                    found[read] = i
                if read not in begun:
                    break
                j += 1
                if j == len(tokens):
                    break
                read = f"{read} {tokens[j]}"
        return found


def sayable(said: DataFrame, names: DataFrame) -> DataFrame:
    """Those of ``names(norm)``, which are distinct, whose tokens all stand somewhere
    in ``said(folded)``. Any other stands nowhere, so what the automata hold goes by
    what texts say and not by how many names there are."""
    split = lambda c: F.array_distinct(F.split(c, " "))
    words = few(checkpointed(said.select(F.explode(split("folded")).alias("token")).distinct()))
    parts = names.select("norm", split("norm").alias("tokens")).select("norm", F.size("tokens").alias("size"), F.explode("tokens").alias("token"))
    return parts.join(words, "token").groupBy("norm", "size").agg(F.count("*").alias("held")).where("held = size").select("norm")


def spotted(texts: DataFrame, names: DataFrame, keys: list[str], shard: int = SHARD) -> DataFrame:
    """(keys, norm, n, pos, surface): for each row of ``texts(keys, text)`` the names
    of ``names(norm)`` that it holds as runs of at most five tokens, and of each its
    tokens, its first place and what is written there.

    Texts stay where they are; only hits leave. Names with tokens that no text holds
    are left out first. Names of more than ``shard`` characters are dealt by hash into shards of about that size; each is collected
    and broadcast by itself and met by all texts in turn, its hits being written
    before the next comes. Names need not be distinct; a null text has none."""
    spark, kinds = texts.sparkSession, {f.name: f.dataType for f in texts.schema.fields}
    said = F.array_join(mention_tokens(F.col("text")), " ")
    read = texts.where("text IS NOT NULL").select(*keys, said.alias("said"), F.translate(said, ACCENTED, FOLDED).alias("folded"))
    schema = ", ".join([*[f"`{k}` {kinds[k].simpleString()}" for k in keys], "norm string, n int, pos int, surface string"])
    usable = names.select("norm").where(F.col("norm").isNotNull() & (F.size(F.split("norm", " ")) <= LONGEST)).distinct()
    usable = checkpointed(sayable(read, usable))
    shards = max(1, -(-(usable.agg(F.sum(F.length("norm"))).first()[0] or 0) // shard))
    out = None
    for k in range(shards):
        mine = usable.where(F.pmod(F.xxhash64("norm"), F.lit(shards)) == k) if shards > 1 else usable
        held = spark.sparkContext.broadcast([r["norm"] for r in mine.collect()])  # about ``shard`` characters
        hits = read.mapInArrow(_finder(held, keys), schema)
        if shards > 1:
            hits = checkpointed(hits)
            held.destroy()
        out = hits if out is None else out.unionByName(hits)
    return out


def _finder(held, keys: list[str]):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(held.value)
        for b in batches:
            rows, hits = [], []
            for i, (said, folded) in enumerate(zip(b.column("said").to_pylist(), b.column("folded").to_pylist(), strict=True)):
                found = automaton.find(folded.split(" "))
                if not found:
                    continue
                words = said.split(" ")
                for norm, at in found.items():
                    n = norm.count(" ") + 1
                    rows.append(i)
                    hits.append((norm, n, at + 1, " ".join(words[at : at + n])))
            if rows:
                norm, n, pos, surface = zip(*hits, strict=True)
                own = b.select(keys).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(norm), pa.array(n, pa.int32()), pa.array(pos, pa.int32()), pa.array(surface)], names=[*keys, "norm", "n", "pos", "surface"])

    return find
