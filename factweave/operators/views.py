"""Entities as Markdown."""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import display, ref_target, sanitize, string_only

MANUAL = ("<!-- manual:start -->", "<!-- manual:end -->")
TEMPLATE = "---\nid: {id}\ntype: {type}\nsources: {sources}\n---\n\n# {label}\n\n{attributes}{outgoing}{incoming}{aliases}\n{manual}\n"


def render_context(facts: DataFrame, entities: DataFrame, aliases: DataFrame, labels: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row per entity: label, source count, and its attributes with their
    origin, references both ways and aliases as sorted lists. ``known`` are the
    entities that may refer to them (all of ``entities`` by default)."""
    attr = facts.where(~F.col("predicate").startswith("ref:")).select("subject", "predicate", display(F.col("object_json")).alias("v"), "adapter", F.col("confidence").cast("double").alias("confidence"), "locator")
    attr = attr.groupBy("subject").agg(F.sort_array(F.collect_list(F.struct("predicate", "v", "adapter", "confidence", "locator"))).alias("attributes"))
    refs = facts.where(F.col("predicate").startswith("ref:")).select("subject", ref_target(F.col("predicate")).alias("kind"), string_only(F.col("object_json")).alias("target"))
    out = refs.groupBy("subject").agg(F.sort_array(F.collect_set(F.struct("kind", "target"))).alias("outgoing"))
    back = refs.join((entities if known is None else known).select(F.col("id").alias("subject"), "entity_type"), "subject").groupBy(F.col("target").alias("subject")).agg(F.sort_array(F.collect_set(F.struct(F.col("entity_type").alias("kind"), F.col("subject").alias("target")))).alias("incoming"))
    names = aliases.groupBy(F.col("entity_id").alias("subject")).agg(F.sort_array(F.collect_set("alias")).alias("aliases"))
    src = facts.groupBy("subject").agg(F.countDistinct("adapter").alias("sources"))
    e = entities.join(labels, "id").withColumn("subject", F.col("id"))
    for part in (attr, out, back, names, src):
        e = e.join(part, "subject", "left")
    return e.drop("subject").withColumn("path", F.concat(sanitize(F.col("entity_type")), F.lit("/"), sanitize(F.col("id")), F.lit(".md")))


def render(row: dict, template: str = TEMPLATE, manual: str = "") -> str:
    link = lambda x: f"- [{x['target']}](../{re.sub('[^A-Za-z0-9_-]', '_', x['kind'])}/{re.sub('[^A-Za-z0-9_-]', '_', x['target'])}.md)\n"
    part = lambda title, lines: f"## {title}\n\n{''.join(lines)}\n" if lines else ""
    origin = lambda x: f"{x['adapter']}, {x['confidence']:.2f}" + (f", {x['locator']}" if x["locator"] else "")
    seq = lambda k: [] if row.get(k) is None else list(row[k])
    return template.format(
        id=row["id"], type=row["entity_type"], sources=int(row.get("sources") or 0), label=row["label"],
        attributes=part("Attributes", [f"- **{x['predicate']}**: {x['v']} ({origin(x)})\n" for x in seq("attributes") if x["v"] is not None]),
        outgoing=part("References", [link(x) for x in seq("outgoing")]), incoming=part("Referenced by", [link(x) for x in seq("incoming")]),
        aliases=part("Also known as", [f"- {x}\n" for x in seq("aliases")]), manual="\n".join([MANUAL[0], manual.strip("\n"), MANUAL[1]]),
    )


def rendered(context: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(id, path, markdown) with a template per type where one is given."""
    given = templates or {}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = p.to_dict("records")
            yield pd.DataFrame({"id": p["id"], "path": p["path"], "markdown": [render(r, given.get(r["entity_type"], TEMPLATE)) for r in rows]})

    return context.mapInPandas(run, "id string, path string, markdown string")


def manual_block(text: str) -> str:
    a, b = text.find(MANUAL[0]), text.find(MANUAL[1])
    return text[a + len(MANUAL[0]) : b].strip("\n") if 0 <= a < b else ""


def put_file(target: str, text: str) -> None:
    """Written beside and renamed: readers see the old text or the new one."""
    os.makedirs(os.path.dirname(target), exist_ok=True)
    beside = f"{target}.{uuid.uuid4().hex}.tmp"
    with open(beside, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(beside, target)


def put_page(target: str, text: str) -> str:
    """Write a page, keeping the manual block that is there; written or unchanged."""
    old = ""
    if os.path.exists(target):
        with open(target, encoding="utf-8") as f:
            old = f.read()
    new = text.replace("\n".join([MANUAL[0], "", MANUAL[1]]), "\n".join([MANUAL[0], manual_block(old), MANUAL[1]]))
    if new == old:
        return "unchanged"
    put_file(target, new)
    return "written"


def write_tree(pages: DataFrame, root: str) -> dict[str, int]:
    """Write pages (path, markdown) under ``root``, a folder that the executors
    share: each task writes its own, and a task that is run again finds equal
    files and leaves them alone."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"state": [put_page(os.path.join(root, path), text) for path, text in zip(p["path"], p["markdown"], strict=True)]}, dtype=str)

    got = {r["state"]: r["n"] for r in pages.select("path", "markdown").mapInPandas(run, "state string").groupBy("state").agg(F.count("*").alias("n")).collect()}
    return {"written": got.get("written", 0), "unchanged": got.get("unchanged", 0)}


def load_templates(folder: str) -> dict[str, str]:
    """Template by type from a folder's <type>.md files."""
    out = {}
    for name in sorted(os.listdir(folder)):
        if name.endswith(".md"):
            with open(os.path.join(folder, name), encoding="utf-8") as f:
                out[name.removesuffix(".md")] = f.read()
    return out


def as_json(shown: dict) -> str:
    """An entity as JSON, objects parsed."""
    facts = [{k: v for k, v in f.items() if k in ("predicate", "adapter", "confidence", "locator")} | {"object": json.loads(f["object_json"])} for f in shown["facts"]]
    return json.dumps({"id": shown["id"], "entity_type": shown["type"], "fact_count": len(facts), "facts": facts}, ensure_ascii=False, indent=2)


def as_text(shown: dict) -> str:
    """An entity's attributes, then its references, a line each."""
    def line(f: dict) -> str:
        value = json.loads(f["object_json"])
        return f"  {f['predicate']:30} {value if isinstance(value, str) else f['object_json']}  [{f['adapter']}@{f['confidence']:.2f}]"

    refs = [line(f) for f in shown["facts"] if f["predicate"].startswith("ref:")]
    head = [f"# {shown['type']}/{shown['id']}  ({len(shown['facts'])} facts)", *(line(f) for f in shown["facts"] if not f["predicate"].startswith("ref:"))]
    return "\n".join([*head, *(["", "## related", *refs] if refs else [])])


def safe_name(s: str) -> str:
    """A cache file's name part: no separators, no leading dot, never empty."""
    kept = re.sub("[^A-Za-z0-9_.@+=~-]", "_", s)
    return "_" if not kept else f"_{kept}" if kept.startswith(".") else kept
