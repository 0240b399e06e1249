"""Entity cards, embeddings and candidates by vector and by alias."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import display, truncate
from . import blocks


def _first_five(rows: DataFrame, key: str, order: list[Column], column: str) -> DataFrame:
    """(key, five): the first five of ``column`` by ``order``; null where there are
    fewer. They are read off the sorted rows, nothing is collected or sorted again."""
    w = Window.partitionBy(key).orderBy(*order)
    five = F.array(F.col(column), *[F.lead(column, i).over(w) for i in range(1, 5)])
    return rows.select(key, five.alias("five"), F.row_number().over(w).alias("rn")).where("rn = 1").select(key, "five")


def card_text(facts: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, entity_type, card, card_hash): type and id, up to five aliases by
    confidence, up to five facts by the length of their value."""
    a = aliases.where(F.lower("alias") != F.lower("entity_id"))
    best = F.row_number().over(Window.partitionBy("entity_id", F.lower("alias")).orderBy(F.desc("confidence"), "alias"))
    a = a.withColumn("rn", best).where("rn = 1").drop("rn")
    a = _first_five(a, "entity_id", [F.desc("confidence"), F.col("alias")], "alias").select("entity_id", F.concat_ws(", ", "five").alias("names"))
    v = display(F.col("object_json"))
    f = facts.select("subject", "id", "predicate", v.alias("v")).where("v IS NOT NULL")
    # Only what a card shows of a value is dealt, with the length of the whole.
    f = f.select("subject", "id", F.length("v").alias("n"), F.concat(F.lit("\n"), "predicate", F.lit(": "), truncate(F.col("v"), 200)).alias("line"))
    f = _first_five(f, "subject", [F.col("n"), F.col("id")], "line").select("subject", F.concat_ws("", "five").alias("lines"))
    e = entities.join(a, entities["id"] == a["entity_id"], "left").join(f, entities["id"] == f["subject"], "left")
    named = F.when(F.col("names").isNotNull(), F.concat(F.lit("\naliases: "), "names")).otherwise("")
    facts_part = F.coalesce("lines", F.lit(""))
    card = truncate(F.concat("entity_type", F.lit(" "), "id", named, facts_part), 2048)
    return e.select("id", "entity_type", card.alias("card")).withColumn("card_hash", F.sha2("card", 256))


def stale_cards(cards: DataFrame, embeddings: DataFrame, model: str, force: bool = False, limit: int | None = None) -> DataFrame:
    """Cards without an embedding of their text by that model."""
    old = embeddings.select(F.col("entity_id").alias("id"), F.col("card_hash").alias("old_hash"), F.col("model").alias("old_model"))
    j = cards.join(old, "id", "left")
    if not force:
        j = j.where(F.col("old_hash").isNull() | (F.col("old_hash") != F.col("card_hash")) | (F.col("old_model") != model))
    out = j.select(*cards.columns)
    return out.orderBy("id").limit(limit) if limit is not None else out


def embed_cards(cards: DataFrame, client, model: str, created_at: int, batch: int = 64) -> DataFrame:
    """Embeddings of card texts, ``batch`` texts a call. An answer of another
    size than the question is an error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for s in range(0, len(p), batch):
                q = p.iloc[s : s + batch]
                got = client.embed(q["card"].tolist())
                if len(got) != len(q):
                    raise ValueError(f"{len(q)} texts, {len(got)} vectors")
                yield pd.DataFrame({"entity_id": q["id"], "embedding": [list(map(float, v)) for v in got], "model": model, "card_hash": q["card_hash"], "created_at": created_at})

    return cards.select("id", "card", "card_hash").mapInPandas(run, "entity_id string, embedding array<float>, model string, card_hash string, created_at long")


def from_blob(blob: Column) -> Column:
    """A vector from little-endian single-precision bytes; null for null."""

    @F.pandas_udf("array<float>")
    def read(b: pd.Series) -> pd.Series:
        return b.map(lambda x: None if x is None else np.frombuffer(x, "<f4"))

    return read(blob)


def to_blob(vec: Column) -> Column:
    """The bytes that ``from_blob`` reads."""

    @F.pandas_udf("binary")
    def write(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    return write(vec)


def embed_new_sections(sections: DataFrame, cache: DataFrame, client, model: str, created_at: int, batch: int = 64) -> DataFrame:
    """Rows of ``section_embeddings`` for the texts of ``sections(section, text)``
    that it lacks for that model; equal texts are embedded once."""
    texts = sections.select(F.sha2("text", 256).alias("id"), F.col("text").alias("card")).where("id IS NOT NULL").dropDuplicates(["id"])
    known = cache.where(F.col("model") == model).select(F.col("section_hash").alias("id"))
    new = texts.join(known, "id", "left_anti").withColumn("card_hash", F.col("id"))
    return embed_cards(new, client, model, created_at, batch).select(F.col("entity_id").alias("section_hash"), "embedding", "model", "created_at")


def section_vectors(sections: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """(section, embedding) by the text's hash and the model."""
    known = cache.where(F.col("model") == model).groupBy("section_hash").agg(F.max_by("embedding", "created_at").alias("embedding"))
    return sections.select("section", F.sha2("text", 256).alias("section_hash")).join(known, "section_hash").select("section", "embedding")


def entity_vectors(embeddings: DataFrame, entities: DataFrame, model: str) -> DataFrame:
    """(id, entity_type, vec) of the stored embeddings of one model whose entity
    is known."""
    v = embeddings.where(F.col("model") == model).select(F.col("entity_id").alias("id"), F.col("embedding").alias("vec"))
    return v.join(entities.select("id", "entity_type"), "id").select("id", "entity_type", "vec")


#: Rows in a block of vectors and in one of queries, at most.
BLOCK, QUERIES = 16_384, 2_048


def _units(rows: list, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors over their lengths, and the lengths of those that have any."""
    m = blocks.matrix(rows, lens)
    norm = np.sqrt(np.einsum("ij,ij->i", m, m))
    with np.errstate(invalid="ignore"):
        m /= np.where(norm > 0, norm, 1)[:, None]
    return m, np.where(norm != 0, lens, -1)


def cosine_topk(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank) by cosine, for a stated query set against all
    ``vectors(id, vec)``; scores are rounded to six places, ties go to the smaller
    id, scores that aren't finite are dropped. Vectors of unequal length have score
    0, and so have null, empty and zero ones and those with null components.

    Queries and vectors meet in blocks dealt in a grid of four cells a core, as
    matrix products; a block of queries keeps its ``k`` best through a cell, and
    only those go to the final ranking."""
    whole = lambda c: F.when(F.col(c).isNotNull() & ~F.exists(c, lambda x: x.isNull()), F.col(c))
    q, v = queries.select(F.col("id"), whole("vec").alias("vec")), vectors.select(F.col("id"), whole("vec").alias("vec"))
    cells = 4 * v.sparkSession.sparkContext.defaultParallelism
    n_q, n_v = q.count(), v.count()
    (rows_q, parts_q), (rows_v, parts_v) = blocks.sizes(n_q, QUERIES, 1), blocks.sizes(n_v, BLOCK, min(cells, -(-n_q * n_v // 1_000_000)))
    pairs = blocks.paired(blocks.packed(q, rows_q, parts_q), blocks.packed(v, rows_v, parts_v), parts_q, parts_v, cells)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([qid.take(pa.array(held[0])), pa.array(held[1], kind), pa.array(held[2])], names=["query_id", "id", "score"])

        for b in batches:
            kind = b.schema.field("_id").type.value_type
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                block = row.column("block")[0].as_py()
                if block != at:
                    if held is not None:
                        yield done()
                    at, held, qid = block, None, row.column("id").flatten()
                    uq, nq = _units(row.column("vecs")[0].as_py(), row.column("lens").flatten().to_numpy())
                uv, nv = _units(row.column("_vecs")[0].as_py(), row.column("_lens").flatten().to_numpy())
                wide = max(uq.shape[1], uv.shape[1])
                s = np.where((nq[:, None] == nv[None, :]) & (nq > 0)[:, None], np.round(blocks.widened(uq, wide) @ blocks.widened(uv, wide).T, 6), 0.0)
                s[~np.isfinite(s)] = -np.inf
                # all that tie with the k-th may be among the best
                least = np.partition(s, max(0, s.shape[1] - k), axis=1)[:, max(0, s.shape[1] - k)] if s.shape[1] else np.zeros(len(s))
                owner, col = np.nonzero((s >= least[:, None]) & (s > -np.inf))
                ids = row.column("_id").flatten().to_numpy(zero_copy_only=False)
                held = blocks.best(held, owner, ids[col], s[owner, col], k)
        if held is not None:
            yield done()

    kinds = (queries.schema["id"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString())
    found = pairs.mapInArrow(rank, f"query_id {kinds[0]}, id {kinds[1]}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "id", "score", "rank")


def hybrid_candidates(by_alias: DataFrame, by_vector: DataFrame, entities: DataFrame, most: int) -> DataFrame:
    """Alias hits, then vector hits, each entity once, at most ``most`` a section.
    by_alias(section, entity_id, confidence, place); by_vector(section, entity_id,
    score, rank). A vector hit's confidence is its score between 0 and 1."""
    one = by_alias.select("section", "entity_id", "confidence", F.lit(0).alias("src"), F.col("place").alias("at"))
    two = by_vector.select("section", "entity_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))).alias("confidence"), F.lit(1).alias("src"), F.col("rank").alias("at"))
    both = one.unionByName(two).join(entities.select(F.col("id").alias("entity_id"), "entity_type"), "entity_id")
    first = F.row_number().over(Window.partitionBy("section", "entity_type", "entity_id").orderBy("src", "at"))
    once = both.withColumn("rn", first).where("rn = 1")
    place = F.row_number().over(Window.partitionBy("section").orderBy("src", "at", "entity_id"))
    return once.withColumn("place", place).where(F.col("place") <= most).select("section", "entity_id", "entity_type", "confidence", "src", "place")


def id_candidates_in_text(sections: DataFrame, entities: DataFrame, most: int = 200) -> DataFrame:
    """Entities whose id, of three bytes or more, stands anywhere in a text.

    A substring test can't be hashed; the id's length sorts ids into as many
    lookups as there are lengths, each an equality join on the text's windows."""
    e = entities.where(F.octet_length("id") >= 3).select(F.lower("id").alias("low"), F.length("id").alias("n"), F.col("id").alias("entity_id"), "entity_type")
    sizes = e.agg(F.sort_array(F.collect_set("n")).alias("ns"))  # one short list
    t = sections.select("section", F.lower("text").alias("t")).join(F.broadcast(sizes))
    spots = t.select("section", F.explode(F.expr("flatten(transform(ns, n -> if(length(t) >= n, transform(sequence(1, length(t) - n + 1), i -> struct(substring(t, i, n) AS low, i AS pos)), array())))")).alias("s"))
    hits = spots.select("section", "s.low", "s.pos").join(e, "low").groupBy("section", "entity_id", "entity_type").agg(F.min("pos").alias("pos"))
    place = F.row_number().over(Window.partitionBy("section").orderBy("entity_id"))
    return hits.withColumn("place", place).where(F.col("place") <= most)
