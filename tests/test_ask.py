"""The tool loop and the HTTP answers over one small store."""

import pytest
from pyspark.sql import functions as F

from factweave import server
from factweave.plans import ask
from factweave.plans.engine import Engine


class Script:
    """Calls each tool in turn, then answers with what it saw."""

    def __init__(self, calls):
        self.calls = list(calls)

    def turn(self, messages, tools):
        if self.calls:
            return {"calls": [self.calls.pop(0)]}
        return {"text": " | ".join(m["result"] for m in messages if m["role"] == "tool")}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("ask") / "s"))
    facts = spark.createDataFrame(
        [(1, "t1", "ref:people", '"a"'), (2, "t2", "ref:people", '"a"'), (3, "a", "city", '"Rome"')], "id long, subject string, predicate string, object_json string"
    ).withColumns({"document_id": F.lit(None).cast("long"), "adapter": F.lit("csv"), "confidence": F.lit(1.0), "observed_at": F.lit(1).cast("long"), "locator": F.lit(None).cast("string")})
    e.store.commit(facts=facts, entities=spark.createDataFrame([("a", "people"), ("t1", "tickets"), ("t2", "tickets")], "id string, entity_type string"))
    return e


def test_tools(engine):
    calls = [
        {"name": "neighbors", "args": {"id": "a"}}, {"name": "count_predicate", "args": {"predicate": "ref:people", "value": "a"}},
        {"name": "count_predicate", "args": {"predicate": "city", "value": "Rome"}}, {"name": "get_incoming", "args": {"ids": ["a"]}}, {"name": "nope"}, {"name": "list_entities_of_type", "args": {}},
    ]
    got = ask.ask(engine, Script(calls), "?").split(" | ")
    assert '"t1"' in got[0] and '"t2"' in got[0] and '"count": 2' in got[1] and '"count": 1' in got[2] and '"total": 2' in got[3]
    assert "no tool" in got[4] and "KeyError" in got[5]
    with pytest.raises(RuntimeError):
        ask.ask(engine, Script([{"name": "list_entity_types"}] * 99), "?")
    assert ask.wanted_ids({"ids": [1, "b"]}) == ["1", "b"] and ask.wanted_ids({"id": "x"}) == ["x"] and ask.wanted_ids({}) == []


def test_http_answers(engine):
    assert server.answer(engine, "GET", "/health", {}) == {"status": "ok"}
    assert server.answer(engine, "GET", "/entities/tickets?limit=1", {}) == {"total": 2, "ids": ["t1"]}
    assert server.answer(engine, "GET", "/entities/people/a", {})["type"] == "people"
    assert [r["id"] for r in server.answer(engine, "POST", "/retrieve", {"query": "rome"})] == ["a"]
    for url in ("/nope", "/entities/tickets/a", "/conflicts/9"):
        with pytest.raises(server.NotFound):
            server.answer(engine, "GET", url, {})
