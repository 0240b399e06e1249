"""Benchmark decontamination: a hash set of normalised test n-grams, scanned
against every document's windows with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, cut, spare, table

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Most bytes of a block of the hash set; the benchmark is dealt into as many
#: blocks as that takes, and a block is broadcast.
BLOCK = 64 << 20
#: Most bits of a hash that are looked up before a window is taken to the set. They
#: decide the work only: 2 ** BITS bytes at most go into the plan.
BITS = 17


def words_of(text: Column) -> Column:
    """Runs outside the separators; what is empty stands before the first or after
    the last separator only."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def window_hashes(w: Column, k: int) -> Column:
    """array<long>: for each window of ``k`` words a hash made of its words' hashes,
    by doubling: a hash of 2m words from two of m words, the last step with two
    that overlap."""
    def joined(by: int):
        def of(a: Column) -> Column:
            n = F.greatest(F.size(a) - by, F.lit(0))
            return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(by + 1), n), lambda x, y: F.xxhash64(x, y))

        return of

    h, m = F.transform(w, lambda x: F.xxhash64(x)), 1
    while m < k:
        by = min(m, k - m)
        # the array is bound once: what it is made of isn't computed again for each element
        h, m = F.element_at(F.transform(F.array(h), joined(by)), 1), m + by
    return h


def ngrams(items: DataFrame, n: int) -> DataFrame:
    """(item_id, k, h, win) for every window; k < n only for whole short items."""
    w = items.select("item_id", words_of(F.col("text")).alias("w"))
    lengths = {r["k"] for r in w.select(F.least(F.size("w"), F.lit(n)).alias("k")).distinct().collect()} - {0}  # at most n
    out = None
    for k in sorted(lengths) or [n]:
        mine = w.where(F.size("w") == k) if k < n else w.where(F.size("w") >= n)
        grams = mine.select("item_id", F.lit(k).alias("k"), F.posexplode(window_hashes(F.col("w"), k)).alias("i", "h"), "w")
        grams = grams.select("item_id", "k", "h", F.array_join(F.slice("w", F.col("i") + 1, k), " ").alias("win"))
        out = grams if out is None else out.unionByName(grams)
    return out.distinct()


def decontaminate(docs: DataFrame, items: DataFrame, n: int = 13, share: int = 20, block: int = BLOCK) -> DataFrame:
    """Benchmark overlap of every document, one output row for each input row.

    ``docs(doc_id, text)``, ``items(item_id, text)``; other columns of either
    are ignored. Result: doc_id, n_words, spans (array of merged hit word ranges
    ``start, end``, end exclusive), n_hit, items (sorted string ids) and
    contaminated (``n_hit > 0 and share * n_hit >= n_words``).

    A null text has no words and is clean; a null item has no window; an empty
    benchmark leaves all documents clean; a null item_id is matched but not
    listed; repeated documents get a row each, repeated items count once by id;
    an empty table gives no rows.

    Texts aren't shuffled: each window's hash is made of its words' hashes where
    the text is, looked up in the broadcast hash set, and verified by its words at
    once, so that a hash collision can't count. What is shuffled is one row for
    each document, and its hits. A benchmark too large for one set of ``block``
    bytes is dealt by hash into several, each of which meets all windows in turn.
    """
    grams = ngrams(items, n)
    sets = grams.groupBy("h", "k", "win").agg(F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    sets = cut(sets.groupBy("h").agg(F.collect_list(F.struct("k", "win", "ids")).alias("grams")))  # unlike windows of one hash: as good as none
    size = sets.select(F.explode("grams").alias("g")).agg(
        F.sum(F.octet_length("g.win") + 96 + 40 * F.size("g.ids")).alias("bytes"), F.sort_array(F.collect_set("g.k")).alias("ks")
    ).first()
    blocks, ks = max(1, -(-(size["bytes"] or 0) // block)), size["ks"] or []

    def hits(b: int) -> DataFrame:
        mine = sets.where(F.pmod("h", F.lit(blocks)) == b) if blocks > 1 else sets
        # Which hash prefixes occur: some eight slots for an entry, in a table of bounded size.
        bits = min(BITS, max(10, (8 * mine.count()).bit_length()))
        slots = bytearray(1 << bits)
        for r in mine.select(F.expr(f"shiftrightunsigned(h, {64 - bits})").alias("p")).distinct().collect():
            slots[r["p"]] = 1
        seen = F.lit(slots)

        def windows(k: int) -> Column:
            def known(h: Column) -> Column:
                at = F.shiftrightunsigned(h, 64 - bits) + 1
                return F.substr(seen, at.cast("int"), F.lit(1)) == F.lit(bytearray(b"\1"))

            def found_in(hs: Column) -> Column:
                at = F.array_compact(F.transform(hs, lambda h, i: F.when(known(h), i + 1)))
                return F.transform(at, lambda i: F.struct(i.alias("at"), F.lit(k).alias("k"), F.get(hs, i - 1).alias("h"), F.array_join(F.slice("w", i, k), " ").alias("win")))

            return F.element_at(F.transform(F.array(window_hashes(F.col("w"), k)), found_in), 1)

        # Place 0, in the first block's set, stands for the document itself.
        itself = F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("k"), F.lit(0).cast("long").alias("h"), F.lit("").alias("win")))
        found = F.concat(*([itself] if b == 0 else []), *map(windows, ks))
        at = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), words_of(F.col("text")).alias("w"))
        at = at.select("doc_id", "th", F.size("w").cast("long").alias("n_words"), F.explode(found).alias("x")).select("doc_id", "th", "n_words", "x.*")
        if b == 0:
            mine = mine.union(docs.sparkSession.range(1).select(F.lit(0).cast("long"), F.lit(None).cast(sets.schema["grams"].dataType)))
        same = F.expr("filter(grams, g -> g.k = k AND g.win = win)")
        hit = at.join(F.broadcast(mine), "h").withColumn("same", same)  # of at most ``block`` bytes
        return hit.select("doc_id", "th", "n_words", "at", "k", "same").where("at = 0 OR size(same) > 0")

    rows = hits(0)
    for b in range(1, blocks):
        rows = rows.unionByName(hits(b))
    per = rows.groupBy("doc_id", "th").agg(
        F.max("n_words").alias("n_words"), F.count(F.when(F.col("at") == 0, 1)).alias("times"),
        F.sort_array(F.collect_set(F.when(F.col("at") > 0, F.struct("at", "k")))).alias("ps"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("at") > 0, F.col("same")[0]["ids"]))))).alias("items"),
    )
    # A window reaches n words at most: a hit begins a span if none of the n + 1
    # before it, in order of place, comes up to it.
    starts = f"filter(sequence(1, size(ps)), i -> i = 1 OR array_max(transform(slice(ps, greatest(i - {n + 1}, 1), i - greatest(i - {n + 1}, 1)), p -> p.at + p.k)) < ps[i - 1].at)"
    # of the windows of one place the longest
    out = per.withColumn("ps", F.expr("filter(ps, (p, i) -> i + 1 = size(ps) OR ps[i + 1].at <> p.at)"))
    out = out.withColumn("first", F.expr(f"if(size(ps) > 0, {starts}, cast(array() AS array<int>))"))
    end = f"array_max(transform(slice(ps, greatest(z - {n}, s), z - greatest(z - {n}, s) + 1), p -> p.at + p.k)) - 1"
    spans = f"transform(first, (s, j) -> element_at(transform(array(if(j + 1 < size(first), first[j + 1] - 1, size(ps))), z -> struct(ps[s - 1].at - 1 AS start, {end} AS end)), 1))"
    out = out.withColumn("spans", F.expr(spans)).withColumn("n_hit", F.expr("aggregate(spans, 0L, (a, s) -> a + s.end - s.start)"))
    out = out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
    return out.select("doc_id", "n_words", "spans", "n_hit", "items", "contaminated", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("col")


def drop_contaminated(docs: DataFrame, items: DataFrame, n: int = 13, share: int = 20) -> DataFrame:
    """``docs`` without the contaminated ones, all columns kept. Rows of a null
    doc_id are judged as one: all go if one is contaminated."""
    name = spare(docs, "bad")[0]
    bad = decontaminate(docs, items, n, share).where("contaminated").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad[name]), "left_anti")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of ``decontaminate`` over documents and benchmark."""
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


OP4_SQL = r"""
WITH fold AS (SELECT item_id AS id, true AS bench, text FROM benchmark UNION ALL SELECT doc_id, false, text FROM documents),
w AS (SELECT id, bench, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM fold),
grams AS (SELECT DISTINCT id AS item_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 13 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 11), lambda i: array_to_string(ws[i:i + 12], ' ')) END) AS win, least(len(ws), 13) AS k FROM w WHERE bench),
ks AS (SELECT DISTINCT k FROM grams),
spots AS (SELECT id AS doc_id, k, unnest(range(1, len(ws) - k + 2)) AS pos, ws FROM w, ks WHERE NOT bench AND len(ws) >= k),
hits AS (SELECT s.doc_id, s.pos, s.k, g.item_id FROM (SELECT doc_id, k, pos, array_to_string(ws[pos:pos + k - 1], ' ') AS win FROM spots) s JOIN grams g USING (k, win)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + k)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id)
SELECT w.id AS doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN hit_words h ON h.doc_id = w.id LEFT JOIN hit_items i ON i.doc_id = w.id WHERE NOT bench
"""
