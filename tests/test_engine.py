"""The engine from files to answers, and again."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from factweave import models
from factweave.plans.engine import Engine
from factweave.sources import files
from factweave.sources.store import StaleVersion
from factweave.streaming.ingest import ingest_stream


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "employees.json").write_text(json.dumps([{"emp_id": f"emp_{i}", "name": n, "zmail": f"{n.lower().replace(' ', '.')}@x.com", "level": 1.0, "team": None} for i, n in enumerate(["Ravi Kumar", "Ana Lopez", "Bo Chen"])]))
    (d / "tickets.csv").write_text("ticket_id,assignee,reporter,body\nT-1,emp_0,Ana Lopez,\nT-2,emp_1,Bo Chen,\"a long text that speaks of Ravi Kumar at some length, beyond sixty characters\"\n")
    (d / "notes.txt").write_bytes(b"Hi Ravi Kumar, please review. \xff")
    (d / "lines.jsonl").write_text('{"id": "L1", "v": 1.50}\n\n{"id": "L2", "v": {"b": 1, "a": 2}}\n')
    (d / "bad.json").write_text("{nope")
    (d / "ragged.csv").write_text("a,b\n1\n")
    return d


def test_sources(spark, folder):
    items = files.walk(spark, str(folder)).persist()
    assert {r["path"].rsplit("/", 1)[1] for r in files.errors(items).collect()} == {"bad.json", "ragged.csv"}
    assert files.sections(items).first()["text"].endswith("review. �")
    fields = {r["fields"]["id"]: r["fields"]["v"] for r in files.records(items).where("schema = 'lines'").collect()}
    assert fields == {'"L1"': "1.50", '"L2"': '{"a":2,"b":1}'}
    (folder / ".ignore").write_text("# no\n*.csv\n")
    (folder / ".hidden").mkdir()
    (folder / ".hidden" / "h.txt").write_text("h")
    names = {r["path"].rsplit("/", 1)[1] for r in files.listed(spark, str(folder)).select("path").collect()}
    assert names == {"employees.json", "notes.txt", "lines.jsonl", "bad.json"}
    assert files.listed(spark, str(folder), files.WalkOptions(glob="*.csv", ignore_files=False, ignore=("/ragged*",))).count() == 1
    (folder / ".ignore").unlink()
    table = files.read_table(spark, str(folder / "tickets.csv")).collect()
    assert table[0]["body"] == ""


def test_ingest_to_answers(spark, folder, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    found = {r["schema"]: r["id_column"] for r in e.ingest(str(folder), 100).collect()}
    assert found == {"employees": "emp_id", "tickets": "ticket_id", "lines": "id"}
    facts = {(r["subject"], r["predicate"]): r["object_json"] for r in e.store.table("facts").collect()}
    assert facts[("T-1", "ref:employees")] == '"emp_0"' and facts[("emp_0", "level")] == "1.0" and facts[("emp_0", "team")] == "null" and facts[("T-1", "body")] == '""'
    assert {r["entity_type"]: r["n"] for r in e.entity_counts().collect()} == {"employees": 3, "tickets": 2, "lines": 2}
    assert e.stats == {"fresh": 3}
    n = e.store.table("facts").count()
    before = e.store.versions()
    e.ingest(str(folder), 200)
    assert e.stats == {"cached": 3}
    assert e.store.versions() == before and e.store.table("facts").count() == n

    assert e.alias_index() > 0
    assert e.reconcile_refs() == 5  # reporters and names, both ways, and one mention
    assert e.reconcile_refs() == 0
    assert [r["id"] for r in e.search("chen").collect()] == ["T-2", "emp_2"] or {r["id"] for r in e.search("chen").collect()} == {"T-2", "emp_2"}
    assert {r["id"] for r in e.search("kumar", 10, 1).collect()} >= {"emp_0", "T-1", "T-2"}
    e.index(str(tmp_path / "index"))
    assert {r["id"] for r in e.search("chen", path=str(tmp_path / "index")).collect()} == {"T-2", "emp_2"}
    shown = e.show("emp_0")
    assert shown["label"] and shown["type"] == "employees" and ("ref:employees", "T-1") in shown["incoming"]

    assert e.list_entities("employees", "P_1") == {"total": 1, "ids": ["emp_1"]} and e.list_entities("employees", limit=2) == {"total": 3, "ids": ["emp_0", "emp_1"]}
    assert '"object": "Ravi Kumar"' in e.shown("emp_0", "json") and "Ravi Kumar  [json@1.00]" in e.shown("emp_0") and "## Referenced by" in e.shown("emp_0", "md")
    assert {f["target_label"] for f in e.show("T-1")["facts"] if f["predicate"] == "ref:employees"} == {"Ravi Kumar", "Ana Lopez"}
    asked = []
    chat = models.FakeChat(lambda s, u: asked.append(u) or "# page")
    assert e.page(chat, "employees", "emp_0", str(tmp_path / "gen")) == "# page" == e.page(chat, "employees", "emp_0", str(tmp_path / "gen")) and len(asked) == 1
    assert "### tickets/T-1" in asked[0] and "`name` = \"Ravi Kumar\" [adapter=json conf=1.00]" in asked[0]
    assert e.generate_pages(models.FakeChat(lambda s, u: "# p"), str(tmp_path / "gen")) == {"ok": 6, "failed": 0}
    assert e.generate_pages(models.FakeChat(lambda s, u: ""), str(tmp_path / "gen"), "tickets", 1, 0, force=True) == {"ok": 0, "failed": 1}
    assert e.embed(models.HashEmbeddings(), "m") == 7 and e.embed(models.HashEmbeddings(), "m") == 0
    done = e.build(str(tmp_path / "md"))
    assert done == {"written": 7, "unchanged": 0}
    page = tmp_path / "md" / "employees" / "emp_0.md"
    page.write_text(page.read_text().replace("<!-- manual:start -->\n", "<!-- manual:start -->\nmine"))
    assert e.build(str(tmp_path / "md")) == {"written": 0, "unchanged": 7} and "mine" in page.read_text()

    sections = spark.createDataFrame([("s1", "employees emp_1 Ana Lopez"), ("s2", "employees emp_1 Ana Lopez"), ("s3", None)], "section string, text string")
    near = e.nearest_entities(sections, models.HashEmbeddings(), "m", 2).collect()
    assert {r["section"] for r in near} == {"s1", "s2"} and len(near) == 4
    vecs = {r["entity_id"]: np.array(r["embedding"]) for r in e.store.table("entity_embeddings").collect()}
    q = np.array(models.HashEmbeddings().embed(["employees emp_1 Ana Lopez"])[0])
    best = max(vecs, key=lambda i: (round(float(vecs[i] @ q / np.linalg.norm(vecs[i]) / np.linalg.norm(q)), 6), i))
    assert {r["entity_id"] for r in near if r["rank"] == 1} == {best}
    assert e.store.table("section_embeddings").count() == 1
    version = e.store.version()
    assert e.embed_sections(sections, models.HashEmbeddings(), "m").count() == 2 and e.store.version() == version
    assert e.graph() is e.graph()
    e.clear_reconciled()
    assert e.reconcile_refs() == 5
    e.clear_aliases()
    assert e.store.table("entity_aliases").count() == 0

    # a changed file replaces what came from it
    (folder / "lines.jsonl").write_text('{"id": "L1", "v": 2}\n')
    e.ingest(str(folder), 300)
    assert [r["object_json"] for r in e.store.table("facts").where("subject LIKE 'L%'").collect()] == ["2"]
    ids = e.store.table("facts").selectExpr("count(*)", "count(DISTINCT id)").first()
    assert ids[0] == ids[1] and e.store.table("documents").where("id IS NULL").count() == 0


class Counting:
    def __init__(self, answer):
        self.answer, self.usage = answer, {"calls": 0}

    def chat(self, system, user):
        self.usage["calls"] += 1
        return self.answer


def test_sections_to_extract(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "notes.json").write_text(json.dumps([{"id": "n1", "body": "x" * 300, "tag": "a"}, {"id": "n2", "body": "y" * 250, "tag": "b"}, {"id": "n3", "body": "short", "tag": "c"}]))
    (d / "plain.txt").write_text("a text")
    e = Engine(spark, str(tmp_path / "s"))
    got = {(r["parent_type"], r["parent_subject"].rsplit("/", 1)[-1], r["field"], r["locator"], len(r["text"])) for r in e.sections(str(d)).collect()}
    assert got == {("notes", "n1", "body", "id=n1/body", 300), ("notes", "n2", "body", "id=n2/body", 250), ("document", "plain.txt", "body", None, 6)}


def test_conflicts_and_review(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"))
    facts = spark.createDataFrame(
        [(1, "a", "boss", '"x"', "csv", 1.0, 1), (2, "a", "boss", '"y"', "llm", 0.9, 2), (3, "a", "tag", '"p"', "csv", 1.0, 1), (4, "a", "tag", '"q"', "csv", 1.0, 1), (5, "b", "boss", '"x"', "csv", 1.0, 5), (6, "b", "boss", '"z"', "csv", 1.0, 5)],
        "id long, subject string, predicate string, object_json string, adapter string, confidence double, observed_at long",
    ).withColumns({"document_id": F.lit(None).cast("long"), "locator": F.lit(None).cast("string")})
    entities = spark.createDataFrame([("a", "people"), ("b", "people")], "id string, entity_type string")
    e.store.commit(facts=facts, entities=entities)
    chat = models.FakeChat(lambda s, u: '{"cardinality": "scalar", "confidence": 1}' if "boss" in u else "what?")
    assert e.cleanup_conflicts(chat) == 2
    assert {r["predicate"]: (r["cardinality"], r["confidence"]) for r in e.store.table("predicate_cardinality").collect()} == {"boss": ("scalar", 1.0), "tag": ("list", 0.0)}
    assert {r["decision"]: r["n"] for r in e.resolve(9).collect()} == {"a": 1, "inbox": 1}
    left = e.store.table("conflicts").where("resolved_at IS NULL").first()
    assert left["subject"] == "b"
    e.resolve_one(left["id"], "b", 10)
    assert e.resolve(11).count() == 0
    assert {r["resolution"] for r in e.store.table("conflicts").collect()} == {"prefer:1", "prefer:6"}

    sections = spark.createDataFrame([("s1", "b", "Ask Big A about it"), ("s2", "b", "nobody")], "section string, parent_subject string, text string")
    e.approve("a", "Big A")
    answer = '{"refs": [{"entity_id": "a", "evidence_span": "big a", "confidence": 0.95}, {"entity_id": "a", "evidence_span": "made up", "confidence": 1}], "facts": [{"subject": "b", "predicate": "asks", "object": "a"}]}'
    def failing(s, u):
        raise OSError("down")

    assert e.extract(sections, models.FakeChat(failing)) == 0
    assert e.store.table("section_cache").count() == 1  # the one that had no candidates
    assert e.extract(sections, Counting(answer), lots=2, concurrency=2) == 2 and e.usage == {"calls": 1}
    assert e.extract(sections, models.FakeChat(lambda s, u: answer)) == 0
    e.reject("b", "ref:people", "a", "Big A")
    assert e.store.table("facts").where("adapter = 'llm-resolve'").first()["confidence"] == 0
    assert e.store.table("resolution_blocklist").first()["alias_norm"] == "big a"
    e.clear_llm()
    assert e.store.table("facts").where("adapter LIKE 'llm-%'").count() == 0


def test_stream(spark, folder, tmp_path):
    e = Engine(spark, str(tmp_path / "s"))
    ingest_stream(spark, e, str(folder), str(tmp_path / "cp")).awaitTermination(120)
    n = e.store.table("facts").count()
    assert n > 0
    ingest_stream(spark, e, str(folder), str(tmp_path / "cp2")).awaitTermination(120)
    assert e.store.table("facts").count() == n


def test_only_one_writer_wins(spark, tmp_path):
    a, b = Engine(spark, str(tmp_path / "s")).store, Engine(spark, str(tmp_path / "s")).store
    one = spark.createDataFrame([("x", "t")], "id string, entity_type string")
    assert a.commit(entities=one) == 1
    with pytest.raises(StaleVersion):
        b.commit(0, entities=one)  # the tables were read before a's commit
    b.version = lambda: 0  # as if a had committed while b was writing
    with pytest.raises(StaleVersion):
        b.commit(0, entities=one)
    two = spark.createDataFrame([("y", "t")], "id string, entity_type string")
    assert a.commit(1, {"entities": two}) == 2
    assert {r["id"] for r in a.table("entities").collect()} == {"x", "y"} and a.table("entities", 1).count() == 1
    assert len(a.manifest()["entities"]) == 2 and a.manifest()["entities"][:1] == a.manifest(1)["entities"]
    a.compact("entities")
    assert len(a.manifest()["entities"]) == 1 and a.table("entities").count() == 2
    a.commit(entities=one.limit(0))
    a.vacuum()
    assert a.table("entities").count() == 0
