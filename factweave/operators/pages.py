"""Pages that a model writes: the whole surroundings of an entity as a prompt,
the order of work, and the pages' folder."""

from __future__ import annotations

import json
import os
import time
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import shorten, string_only, value_to_string
from .aliases import entity_labels
from .views import put_file, safe_name

#: Facts listed of a neighbour, and its aliases.
NEIGHBOUR_FACTS, NEIGHBOUR_ALIASES = 40, 6
TASK = "Rewrite the following entity and all of its surroundings as Markdown. Leave nothing out and add nothing; give every neighbour a section of its own."
SYSTEM = "You format entities of a knowledge graph as Markdown, faithfully and completely."
RANKER = "You rank entity types for a reader: records of weight first, bulk such as messages and logs last. Answer with JSON only: {\"order\": [types]}."


def _listed(df: DataFrame, by: list[str], line: str) -> DataFrame:
    """(id, n, body): lines by id in order."""
    return df.groupBy("id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*by, line))), lambda x: x[line]), "").alias("body"))


def full_context(facts: DataFrame, entities: DataFrame, aliases: DataFrame, work: DataFrame) -> DataFrame:
    """``work(id, entity_type, ...)`` with ``context``: label, aliases, facts,
    backlinks and, for each neighbour either way, its first NEIGHBOUR_FACTS facts.

    A neighbour's block is written once and joined to all who are next to it. A
    prompt holds everything by its purpose, so a hub's is as long as its
    surroundings."""
    mine = work.select("id").distinct()
    labels = entity_labels(entities, aliases)
    conf = F.format_string("%.2f", F.col("confidence").cast("double"))
    names = aliases.select(F.col("entity_id").alias("id"), (-F.col("confidence")).alias("less"), "alias", F.concat(F.lit("- `"), "alias", F.lit("` (source="), "source", F.lit(", conf="), conf, F.lit(")\n")).alias("line"))
    shown = shorten(F.col("object_json"))
    where = F.coalesce(F.concat(F.lit(" loc="), "locator"), F.lit(""))
    own = facts.select(
        F.col("subject").alias("id"), "predicate", F.col("id").alias("number"), F.concat(F.lit("- `"), "predicate", F.lit("` = "), shown, F.lit("\n")).alias("short"),
        F.concat(F.lit("- `"), "predicate", F.lit("` = "), shown, F.lit(" [adapter="), "adapter", F.lit(" conf="), conf, where, F.lit("]\n")).alias("line"),
    )
    refs = facts.where(F.col("predicate").startswith("ref:")).select(
        "subject", "predicate", string_only(F.col("object_json")).alias("to"), value_to_string(F.col("object_json")).alias("target"), "adapter", conf.alias("conf")
    )
    kinds = entities.select(F.col("id").alias("subject"), "entity_type").join(labels.withColumnRenamed("id", "subject"), "subject", "left")
    named = F.when(F.col("label") != F.col("subject"), F.concat(F.lit(" — "), "label")).otherwise("")
    back = refs.join(mine.withColumnRenamed("id", "target"), "target", "left_semi").join(kinds, "subject", "left").select(
        F.col("target").alias("id"), "predicate", "subject",
        F.concat(F.lit("- `"), "predicate", F.lit("` ← "), F.coalesce("entity_type", F.lit("")), F.lit("/"), "subject", F.coalesce(named, F.lit("")), F.lit("  [adapter="), "adapter", F.lit(" conf="), "conf", F.lit("]\n")).alias("line"),
    )
    beside = refs.select(F.col("subject").alias("id"), F.col("to").alias("next")).union(refs.select(F.col("target").alias("id"), F.col("subject").alias("next")))
    beside = beside.where("next IS NOT NULL AND next <> id").join(mine, "id", "left_semi").distinct()

    near = beside.select(F.col("next").alias("id")).distinct()
    nth = F.row_number().over(Window.partitionBy("id").orderBy("predicate", "number"))
    many = own.join(near, "id", "left_semi").groupBy("id").agg(F.count("*").alias("total"))
    first = _listed(own.join(near, "id", "left_semi").withColumn("rn", nth).where(F.col("rn") <= NEIGHBOUR_FACTS), ["rn"], "short").select("id", "body")
    best = F.row_number().over(Window.partitionBy("id").orderBy("less", "alias"))
    few = names.join(near, "id", "left_semi").withColumn("rn", best).where(F.col("rn") <= NEIGHBOUR_ALIASES).groupBy("id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "alias"))), lambda x: x["alias"]), ", ").alias("called")
    )
    blocks = near.join(kinds.withColumnRenamed("subject", "id"), "id", "left").join(first, "id", "left").join(many, "id", "left").join(few, "id", "left")
    over = F.when(F.col("total") > NEIGHBOUR_FACTS, F.concat(F.lit("- … and "), (F.col("total") - NEIGHBOUR_FACTS).cast("string"), F.lit(" more facts\n"))).otherwise("")
    title = F.concat(F.lit("\n### "), F.coalesce("entity_type", F.lit("")), F.lit("/"), "id", F.coalesce(F.when(F.col("label") != F.col("id"), F.concat(F.lit(" — "), "label")), F.lit("")), F.lit("\n"))
    block = F.concat(title, F.coalesce(F.concat(F.lit("aliases: "), "called", F.lit("\n")), F.lit("")), F.coalesce("body", F.lit("(no facts)\n")), over)
    around = _listed(beside.join(blocks.select(F.col("id").alias("next"), block.alias("line")), "next"), ["next"], "line")

    parts = {"aliases": _listed(names, ["less", "alias"], "line"), "facts": _listed(own, ["predicate", "number"], "line"), "back": _listed(back, ["predicate", "subject"], "line"), "around": around}
    out = work.join(labels, "id", "left")
    text = F.concat(F.lit(f"{TASK}\n\n# SUBJECT\nentity_type: "), "entity_type", F.lit("\nid: "), "id", F.coalesce(F.when(F.col("label") != F.col("id"), F.concat(F.lit("\nlabel: "), "label")), F.lit("")), F.lit("\n"))
    for name, title_ in (("aliases", "ALIASES"), ("facts", "FACTS"), ("back", "INCOMING REFERENCES"), ("around", "NEIGHBOURS")):
        part = parts[name].join(mine, "id", "left_semi").select("id", F.col("n").alias(f"n_{name}"), F.col("body").alias(f"b_{name}"))
        out = out.join(part, "id", "left")
        text = F.concat(text, F.lit(f"\n## {title_} ("), F.coalesce(f"n_{name}", F.lit(0)).cast("string"), F.lit(")\n"), F.coalesce(f"b_{name}", F.lit("")))
    return out.select(*work.columns, text.alias("context"))


def rank_types(counts: list[tuple[str, int]], client) -> list[str]:
    """Types in the order that the model gives; those it leaves out, and all where
    the answer fails, follow by falling count, then name. One entry for a type."""
    rest = [t for t, _ in sorted(counts, key=lambda x: (-x[1], x[0]))]
    try:
        from .extraction import strip_fences

        said = json.loads(strip_fences(client.chat(RANKER, "\n".join(f"- {t} ({n} rows)" for t, n in counts))))["order"]
        first = list(dict.fromkeys(t for t in said if t in rest)) if isinstance(said, list) else []
    except Exception:  # any failure leaves the order by count
        first = []
    return [*first, *(t for t in rest if t not in first)]


def work_order(entities: DataFrame, order: list[str]) -> DataFrame:
    """``entities`` with ``rank``, the place of their type (unknown ones last)."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(t) for t in order]), F.col("entity_type")) - 1, F.lit(len(order))) if order else F.lit(0)
    return entities.withColumn("rank", F.when(rank < 0, len(order)).otherwise(rank).cast("int"))


def page_path(root: str, entity_type: str, entity_id: str) -> str:
    return os.path.join(root, safe_name(entity_type), f"{safe_name(entity_id)}.md")


def read_page(root: str, entity_type: str, entity_id: str) -> str | None:
    path = page_path(root, entity_type, entity_id)
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        return f.read()


def without_page(work: DataFrame, root: str) -> DataFrame:
    """``work(id, entity_type, ...)`` less those that have a page under ``root``, a
    folder that all executors see."""

    @F.pandas_udf("boolean")
    def there(kind: pd.Series, i: pd.Series) -> pd.Series:
        return pd.Series([os.path.exists(page_path(root, a, b)) for a, b in zip(kind, i, strict=True)], dtype=bool)

    return work.where(~there("entity_type", "id"))


def wait(entity_id: str, attempt: int) -> float:
    """Seconds before another try: doubling from one to sixty, varied by a fifth
    either way, alike for an entity and attempt."""
    spread = zlib.crc32(f"{entity_id}\n{attempt}".encode()) % 401
    return min(60.0, 2.0 ** min(attempt, 6)) * (800 + spread) / 1000


def write_page(client, root: str | None, entity_type: str, entity_id: str, context: str, force: bool = False) -> str:
    """The page of one entity: that in ``root`` if there is one, else the model's,
    which is put there. An empty answer is an error."""
    if root is not None and not force and (known := read_page(root, entity_type, entity_id)) is not None:
        return known
    said = client.chat(SYSTEM, context).strip()
    if not said:
        raise ValueError(f"no page for {entity_type}/{entity_id}")
    if root is not None:
        put_file(page_path(root, entity_type, entity_id), said)
    return said


def write_pages(context: DataFrame, client, root: str, retries: int = 3, force: bool = False, sleep: Callable[[float], None] = time.sleep) -> dict[str, int]:
    """Write the pages of ``context(id, entity_type, rank, context)`` in order of
    rank and id; {ok, failed}. Tasks write on their own: ``root`` is shared. A
    task that is run again finds the pages it wrote."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            state = []
            for i, kind, text in zip(p["id"], p["entity_type"], p["context"], strict=True):
                for attempt in range(retries + 1):
                    try:
                        write_page(client, root, kind, i, text, force)
                        state.append("ok")
                        break
                    except Exception:  # one page's failure is no reason to stop
                        if attempt == retries:
                            state.append("failed")
                        else:
                            sleep(wait(i, attempt))
            yield pd.DataFrame({"state": state}, dtype=str)

    dealt = context.repartition("id").sortWithinPartitions("rank", "id").select("id", "entity_type", "context")
    got = {r["state"]: r["n"] for r in dealt.mapInPandas(run, "state string").groupBy("state").agg(F.count("*").alias("n")).collect()}
    return {"ok": got.get("ok", 0), "failed": got.get("failed", 0)}
