"""Line deduplication by deletion neighbourhoods, with built-in functions only.

Lines are compared as word sequences; two are near if one word inserted, deleted
or replaced makes them equal. Every line that may have a near one emits the
hashes of its one-word deletions; equal hashes join, the edit is verified on the
words, and of near lines only the earliest stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, join_hot, spare, stored, table

NO_ID = -(2**63)
#: Lines with fewer words have no near ones: one edit would be more than a fifth of them.
MIN_WORDS = 5


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _words(line: Column) -> Column:
    return F.filter(F.split(line, r"[\x20\t\r\x0B\f]+"), lambda w: w != "")


# Lengths of the front and end that are looked at: half a line at most, the same
# for a line and one a word longer; longer lines share lengths in steps of four.
_SIDE = "if({n} < 16, ({n}) div 2, ({n}) div 2 - ({n}) div 2 % 4)"
_HALVES = (
    f"flatten(transform(array_distinct(array({_SIDE.format(n='n')}, {_SIDE.format(n='n - 1')})), "
    "k -> array(xxhash64('p', k, slice(w, 1, k)), xxhash64('s', k, slice(w, n - k + 1, k)))))"
)
_M = "1099511627775L"  # 40 bits: sums of them over a line can't overflow


def mark_lines(docs: DataFrame, min_words: int = MIN_WORDS, short_copies: bool = False) -> DataFrame:
    """(dk, th, gone): by document key the 0-based numbers of the lines that go."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("dk"), F.xxhash64(text).alias("th"), text.alias("text"),
    )
    split = base.select("dk", "th", F.posexplode(_lines(F.col("text"))).alias("ln", "line")).select("dk", "th", "ln", _words(F.col("line")).alias("w"))
    split = split.withColumn("n", F.size("w")).where(F.col("n") >= (1 if short_copies else min_words))
    # Short lines have no halves: they meet their copies only.
    halves = F.when(F.col("n") >= min_words, F.expr(_HALVES))
    seen = stored(split.select("dk", "th", "ln", F.xxhash64("w").alias("a"), F.xxhash64(F.lit("b"), "w").alias("b"), halves.alias("halves")))

    # Distinct lines with their first place, which names them from here on; copies
    # are combined before the shuffle.
    first = cut(seen.groupBy("a", "b").agg(F.min(F.struct("dk", "th", "ln")).alias("f"), F.count("*").alias("c")))
    # One edit leaves a line's front or its end as it was: lines that share
    # neither with an unlike line have no near one and emit nothing.
    half = seen.select("a", F.explode("halves").alias("half"))
    shared = half.groupBy("half").agg(F.min("a").alias("x"), F.max("a").alias("y")).where("x <> y").select("half")
    # Each step is cut, so that its shuffles can go before the next one's are written.
    may = cut(half.distinct().join(shared, "half", "left_semi").select("a").distinct())
    open_ = first.join(may, "a", "left_semi")

    wanted = open_.select("f.dk", "f.th", "f.ln").groupBy("dk", "th").agg(F.collect_list("ln").alias("want"))
    got = base.join(wanted, ["dk", "th"]).select("dk", "th", _lines(F.col("text")).alias("ls"), "want")
    pick = F.transform("want", lambda ln: F.struct(ln.alias("ln"), F.element_at(F.col("ls"), ln + 1).alias("line")))
    got = got.select("dk", "th", F.explode(pick).alias("x"))
    lines = got.select(F.struct("dk", "th", F.col("x.ln").alias("ln")).alias("f"), _words(F.col("x.line")).alias("w")).dropDuplicates(["f"])
    lines = cut(lines.withColumn("n", F.size("w")))

    # A word replaced: all words with their places but one, as two sums without
    # carry, 128 bits in all. Under such a key all lines are near one another.
    placed = lines.select(
        "f", "n", F.expr("transform(w, (x, i) -> struct(xxhash64(x, i) AS u, xxhash64('b', x, i) AS v))").alias("p"),
    ).select("f", "n", "p", F.expr("aggregate(p, 0L, (s, x) -> s ^ x.u)").alias("u"), F.expr("aggregate(p, 0L, (s, x) -> s ^ x.v)").alias("v"))
    replaced = placed.select("f", F.explode(F.expr("transform(p, (x, i) -> struct(xxhash64(n, i, u ^ x.u) AS u, xxhash64(i, n, v ^ x.v) AS v))")).alias("key")).select("f", "key.u", "key.v")
    least = replaced.groupBy("u", "v").agg(F.min("f").alias("e"), F.count("*").alias("c")).where("c > 1")
    total = replaced.count()
    pairs = cut(join_hot(replaced, least, ["u", "v"], "c", total).where("f > e").select("f", "e").distinct())
    # A word deleted: the other words' sum is that of a whole line one word shorter.
    # Here nothing stands for the others, so unlike lines of one key lose no link.
    summed = lines.select("f", "n", "w", F.expr(f"transform(w, x -> xxhash64(x) & {_M})").alias("g")).select("f", "n", "w", "g", F.expr("aggregate(g, 0L, (s, x) -> s + x)").alias("sg"))
    longer = summed.select("f", F.explode(F.expr("filter(transform(g, (x, i) -> if(i = 0 OR w[i - 1] <> w[i], xxhash64(n - 1, sg - x), NULL)), x -> x IS NOT NULL)")).alias("key"))
    whole = summed.select(F.col("f").alias("wf"), F.xxhash64("n", "sg").alias("key"))
    pairs = pairs.union(cut(longer.join(whole, "key").select(F.greatest("f", "wf").alias("f"), F.least("f", "wf").alias("e")).distinct()))
    # Verify on the words. Two lines within one edit agree up to a place and, one
    # word on in one or both, after it.
    early = lines.select(F.col("f").alias("e"), F.col("w").alias("ew"))
    times = pairs.groupBy("e").agg(F.count("*").alias("c"))
    checked = join_hot(pairs, early.join(times, "e"), ["e"], "c", total).join(lines.select("f", "w"), "f")
    near = cut(checked.where(within_one_edit("w", "ew")).select("f").distinct())

    # Only lines that have copies or a near one can go.
    state = first.join(near.withColumn("near", F.lit(True)), "f", "left").where("near OR c > 1")
    gone = join_hot(seen.select("a", "b", "dk", "th", "ln"), state, ["a", "b"], "c", seen.count()).where(F.col("near") | (F.struct("dk", "th", "ln") != F.col("f")))
    return gone.groupBy("dk", "th").agg(F.collect_set("ln").alias("gone"))


def within_one_edit(x: str, y: str) -> Column:
    """Whether two word arrays are at most one inserted, deleted or replaced word
    apart: past the common front, all but at most one word each is common end."""
    front = f"coalesce(array_position(transform(arrays_zip({x}, {y}), z -> z['{x}'] <=> z['{y}']), false), size({x}) + 1) - 1"
    tail = lambda v, k: f"slice({v}, cast({k} AS int), greatest(size({v}) - cast({k} AS int) + 1, 0))"
    f1, f2 = f"(nullif({front}, -1)) + 1", f"(nullif({front}, -1)) + 2"
    return F.expr(
        f"{x} = {y} OR (abs(size({x}) - size({y})) <= 1 AND CASE "
        f"WHEN size({x}) = size({y}) THEN {tail(x, f2)} = {tail(y, f2)} "
        f"WHEN size({x}) > size({y}) THEN {tail(x, f2)} = {tail(y, f1)} ELSE {tail(x, f1)} = {tail(y, f2)} END)"
    )


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, short_copies: bool = False) -> DataFrame:
    """``docs`` with text less the repeated lines; other columns stay, n_chars is
    set to the new length and n_removed_lines is added.

    Lines end at LF; words are runs without ASCII white space. A line of at least
    ``min_words`` words goes if an equal line, or one within a single word's
    insertion, deletion or replacement, stands earlier in the corpus (smaller
    doc_id, then hash of the text, then line number). Lines are judged on the
    input, not on what is left, so the result doesn't depend on order of work.
    Shorter lines stay; with ``short_copies`` those of at least one word go if an
    equal line stands earlier. A line that goes is judged by the input alone, so a
    line may go for an earlier one that goes itself. A null text stays null; a text all of whose lines go
    becomes empty; a null doc_id counts as smaller than all; rows that repeat both
    doc_id and text are one document; an empty table gives no rows.
    """
    dropped = mark_lines(docs, min_words, short_copies)
    kept_cols = [c for c in docs.columns if c != "n_removed_lines"]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    dk, th, gone, n = spare(docs, "dk", "th", "gone", "n")
    keyed = docs.select(*kept_cols, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias(dk), F.xxhash64(text).alias(th))
    d = dropped.select(F.col("dk").alias(dk), F.col("th").alias(th), F.map_from_arrays("gone", "gone").alias(gone), F.size("gone").alias(n))
    out = keyed.join(d, [dk, th], "left")
    rest = F.array_join(F.filter(_lines(F.col("text")), lambda x, i: ~F.map_contains_key(F.col(gone), i)), "\n")
    new = F.when(F.col(n).isNull(), F.col("text")).otherwise(rest)
    cols = {c: F.col(c) for c in kept_cols} | {"text": new}
    if "n_chars" in cols:
        cols["n_chars"] = F.when(F.col(n).isNull(), F.col("n_chars")).otherwise(F.length(new).cast("long"))
    return out.select(*[v.alias(c) for c, v in cols.items()], F.coalesce(n, F.lit(0)).cast("long").alias("n_removed_lines"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removed lines, and length and digest of what is left, of each document. Equal
    lines of any length of one word or more go, near ones from MIN_WORDS on."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), short_copies=True)
    kept = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_removed_lines", F.length(kept).cast("long").alias("kept_chars"), F.sha2(kept, 256).alias("kept_sha256"))
