"""Commands and the small things that they lead to."""

import json

import pytest

from factweave import cli, server
from factweave.models import FakeChat
from factweave.operators.extraction import prompt
from factweave.plans.ask import ChatTools, ask
from factweave.plans.engine import Engine


@pytest.fixture
def folder(tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "people.json").write_text(json.dumps([{"people_id": f"p{i}", "name": f"Ann Number{i}", "bio": f"Ann Number{i} met Ann Number{(i + 1) % 4}. " * 12} for i in range(4)]))
    return src


def run(capsys, store, *argv):
    cli.main(["--store", str(store), "--offline", *map(str, argv)])
    return capsys.readouterr().out


def test_commands(spark, tmp_path, folder, capsys):
    store = tmp_path / "s"
    run(capsys, store, "ingest", folder)
    run(capsys, store, "alias-index")
    assert json.loads(run(capsys, store, "ingest", folder, "--extract", "--max", "2").splitlines()[-1]) == {"facts": 0, "usage": {}}
    assert run(capsys, store, "embed", "--limit", "3").strip() == "3"
    templates = tmp_path / "templates"
    templates.mkdir()
    (templates / "people.md").write_text("Person {{id}}")
    assert json.loads(run(capsys, store, "build", tmp_path / "pages", "--templates", templates))["written"] == 4
    assert "Person" in next((tmp_path / "pages").rglob("p1.md")).read_text()
    assert run(capsys, store, "ask", "who is p1?").strip() == "{}"


def test_total_counts_what_the_page_shows(spark, tmp_path, folder):
    e = Engine(spark, str(tmp_path / "s"))
    e.ingest(str(folder))
    assert server.answer(e, "GET", "/entities/people?q=p1", {}) == {"total": 1, "ids": ["p1"]}
    assert server.answer(e, "GET", "/entities/people?limit=2&offset=1", {}) == {"total": 4, "ids": ["p1", "p2"]}


def test_prompt_names_parent_type_and_field(spark, tmp_path, folder):
    first = lambda t: t.split("\n", 1)[0]
    assert first(prompt("t", [], "p1", "people", "bio")) == "Parent: p1 (people) field bio"
    assert first(prompt("t", [], "p1")) == "Parent: p1" and first(prompt("t", [], None)) == "Parent: none"
    e = Engine(spark, str(tmp_path / "s"))
    e.ingest(str(folder))
    e.alias_index()
    answer = lambda s, u: json.dumps({"facts": [{"subject": "p0", "predicate": "asked", "object": u.split("\n", 1)[0]}], "refs": []})
    e.extract(e.sections(str(folder)), FakeChat(answer))
    asked = {r["object_json"] for r in e.store.table("facts").where("predicate = 'asked'").collect()}
    assert asked == {f'"Parent: p{i} (people) field bio"' for i in range(4)}


def test_a_chat_model_uses_tools(spark, tmp_path, folder):
    e = Engine(spark, str(tmp_path / "s"))
    e.ingest(str(folder))
    said = iter(['```json\n{"calls": [{"name": "entity_counts", "args": {}}]}\n```', '{"text": "four people"}'])
    assert ask(e, ChatTools(FakeChat(lambda s, u: next(said))), "how many?") == "four people"
    assert ChatTools(FakeChat(lambda s, u: "plain words")).turn([], []) == {"text": "plain words"}
    assert ChatTools(FakeChat(lambda s, u: "[1]")).turn([], []) == {"text": "[1]"}


def test_pages_of_pdf_text():
    from factweave.sources import files

    pages = lambda text: [(x[1][2], x[1][1]) for x in files.pdf_reader(lambda b: text)(b"", "x.pdf")]
    assert pages("one") == [("page:1", "one")] and pages("\fb\f ") == [("page:2", "b")] and pages(" \f\n") == [(None, " \f\n")]
