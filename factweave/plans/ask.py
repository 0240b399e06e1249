"""Questions answered by a model that calls the engine's own queries."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any, Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import value_to_string
from ..models import ChatClient
from ..operators import aggregates, graph
from ..operators.extraction import strip_fences
from .engine import Engine

MAX_TURNS = 12


class ToolClient(Protocol):
    """Given the talk so far and the tools' names: {"text": answer} or
    {"calls": [{"name", "args"}]}."""

    def turn(self, messages: list[dict], tools: list[str]) -> dict: ...


class ChatTools:
    """Turns by a model that only chats: it is told the tools' names and shown the
    talk as JSON, and answers in JSON; anything else is its answer."""

    def __init__(self, chat: ChatClient):
        self.chat = chat

    def turn(self, messages: list[dict], tools: list[str]) -> dict:
        asked = f'Answer the question by these tools: {", ".join(tools)}. Reply with JSON only, {{"calls": [{{"name", "args"}}]}} to use them or {{"text": answer}}.'
        said = self.chat.chat(asked, json.dumps(messages, ensure_ascii=False, default=str))
        try:
            got = json.loads(strip_fences(said))
        except ValueError:
            return {"text": said}
        return got if isinstance(got, dict) and got.keys() & {"calls", "text"} else {"text": said}


def wanted_ids(args: dict) -> list[str]:
    """ids, or a single id."""
    ids = args.get("ids")
    if isinstance(ids, list):
        return [str(x) for x in ids]
    return [str(args["id"])] if args.get("id") not in (None, "") else []


def _rows(df, limit: int) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.limit(limit).collect()]


class Tools:
    def __init__(self, engine: Engine, index: str | None = None):
        self.engine, self.index = engine, index
        self.table: dict[str, Callable[[dict], Any]] = {
            "neighbors": self.neighbors, "get_facts": self.get_facts, "get_incoming": self.get_incoming, "get_aliases": self.get_aliases,
            "list_entity_types": lambda a: _rows(engine.entity_counts(), 1000), "list_entities_of_type": self.list_entities,
            "count_predicate": self.count_predicate, "top_values_by_subject": self.top_values,
        }
        if index is not None:
            self.table["search"] = lambda a: _rows(engine.search(str(a.get("query", "")), min(int(a.get("k") or 10), 50), 0, index), 50)

    def call(self, name: str, args: dict) -> Any:
        if name not in self.table:
            return {"error": f"no tool {name}"}
        try:
            return self.table[name](args)
        except (KeyError, TypeError, ValueError) as e:
            return {"error": f"{type(e).__name__}: {e}"}

    def _t(self, name: str):
        return self.engine.store.table(name)

    def neighbors(self, a: dict) -> list[dict]:
        near = graph.neighbours_of(self._t("facts"), wanted_ids(a)).join(self._t("entities"), "id")
        return [r for rows in self._of(near, wanted_ids(a), "of", ["id"], 300).values() for r in rows]

    @staticmethod
    def _of(df: DataFrame, ids: list[str], key: str, order: list[str], most: int) -> dict[str, list[dict]]:
        """At most ``most`` rows for each id, all ids in one query."""
        nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
        out: dict[str, list[dict]] = {i: [] for i in ids}
        for r in df.where(F.col(key).isin(ids)).withColumn("_n", nth).where(F.col("_n") <= most).orderBy(key, "_n").drop("_n").collect():
            out[r[key]].append(r.asDict(recursive=True))
        return out

    def get_facts(self, a: dict) -> dict:
        f = self._t("facts").select("subject", "id", "predicate", value_to_string(F.col("object_json")).alias("value"), "confidence")
        got = self._of(f, wanted_ids(a), "subject", ["predicate", "id"], 200)
        return {i: [{k: r[k] for k in ("predicate", "value", "confidence")} for r in rows] for i, rows in got.items()}

    def get_incoming(self, a: dict) -> dict:
        ids = wanted_ids(a)
        refs = graph.incoming_refs(self._t("facts"), self._t("entities")).where(F.col("target").isin(ids)).select("target", "predicate", "subject", "subject_type")
        total = {r["target"]: r["n"] for r in refs.groupBy("target").agg(F.count("*").alias("n")).collect()}
        return {i: {"total": total.get(i, 0), "rows": [{k: r[k] for k in ("predicate", "subject", "subject_type")} for r in rows]} for i, rows in self._of(refs, ids, "target", ["predicate", "subject"], 100).items()}

    def get_aliases(self, a: dict) -> dict:
        got = self._of(self._t("entity_aliases").withColumn("less", -F.col("confidence")), wanted_ids(a), "entity_id", ["less", "alias"], 100)
        return {i: [{k: r[k] for k in ("alias", "source", "confidence")} for r in rows] for i, rows in got.items()}

    def list_entities(self, a: dict) -> list[dict]:
        e = self._t("entities").where(F.col("entity_type") == str(a["type"])).orderBy("id")
        return _rows(e, min(int(a.get("limit") or 50), 500))

    def count_predicate(self, a: dict) -> dict:
        f, p, v = self._t("facts"), str(a["predicate"]), str(a["value"])
        n = aggregates.count_predicate(f, p, v).first()["n"]
        return {"count": n, "type": p[4:]} if p.startswith("ref:") else {"count": n}

    def top_values(self, a: dict) -> list[dict]:
        return _rows(self.engine.top_values(str(a["predicate"]), min(int(a.get("limit") or 10), 100)), 100)


def ask(engine: Engine, client: ToolClient, question: str, index: str | None = None) -> str:
    """The model's answer after at most MAX_TURNS turns of tool calls; RuntimeError
    where it still calls tools then."""
    tools = Tools(engine, index)
    talk: list[dict] = [{"role": "user", "text": question}]
    for _ in range(MAX_TURNS):
        said = client.turn(talk, sorted(tools.table))
        if not said.get("calls"):
            return said.get("text", "")
        talk.append({"role": "model", "calls": said["calls"]})
        for c in said["calls"]:
            talk.append({"role": "tool", "name": c["name"], "result": json.dumps(tools.call(c["name"], c.get("args") or {}), default=str, ensure_ascii=False)})
    raise RuntimeError(f"no answer within {MAX_TURNS} turns")
