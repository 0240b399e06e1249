"""How often tables are read and dealt, and the same results by it."""

import pytest
from pyspark.sql import functions as F

from factweave.functions import text as fx
from factweave.operators import aliases, grounding, search, vectors

from .test_keyed import dealt_by, plan


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_plain_strings_are_not_parsed(spark):
    cases = ['"a b"', '""', '"é"', '"a\\nb"', '"\\u0041"', '"\\""', '"', '"a', "null", "true", "-1.5", '{"a":1}', "[1]", "", ' "a"', None]
    df = spark.createDataFrame([(c,) for c in cases], "o string")
    got = df.select(fx.unquote(F.col("o")).alias("got"), F.get_json_object("o", "$").alias("want"), F.col("o")).collect()
    assert [r.got for r in got] == [r.want for r in got] and got[0].got == "a b" and got[4].got == "A"
    # Most strings are cut out; the parser is for the rest only.
    assert "substring_index" in df.select(fx.unquote(F.col("o")))._jdf.queryExecution().optimizedPlan().toString()
    folded = [r.n for r in spark.createDataFrame([("A-b",), (" É \t X y ",), ("",), (None,)], "s string").select(fx.normalize_alias(F.col("s")).alias("n")).collect()]
    assert folded == ["a-b", "e x y", "", None]


def facts_of(spark):
    rows = [(1, "e1", "name", '"Ann Lee"'), (2, "e2", "name", '"Bob"'), (3, "e1", "mail", '"ann.lee@x.org"'), (4, "e2", "mail", '"bob@x.org"'), (5, "e9", "name", '"Nobody"'), (6, "e1", "kind", '"x"'), (7, "e2", "kind", '"x"'), (8, "e3", "name", "null")]
    return spark.createDataFrame(rows, "id long, subject string, predicate string, object_json string")


def entities_of(spark):
    return spark.createDataFrame([("e1", "t"), ("e2", "t"), ("e3", "t"), ("E 4", "u")], "id string, entity_type string")


def test_aliases_are_dealt_by_entity_once(spark, no_broadcast):
    block = spark.createDataFrame([("bob", "e2")], "alias_norm string, entity_id string")
    found = aliases.derive_aliases(facts_of(spark), entities_of(spark))
    want = {("e1", "e1", "id", 1.0), ("e2", "e2", "id", 1.0), ("e3", "e3", "id", 1.0), ("E 4", "e 4", "id", 1.0), ("e1", "ann lee", "field:name", 1.0), ("e2", "bob", "field:name", 1.0), ("e1", "ann.lee@x.org", "field:mail", 1.0), ("e2", "bob@x.org", "field:mail", 1.0), ("e1", "ann.lee", "email_local", 0.9)}
    rows = lambda df: [(r.entity_id, r.alias_norm, r.source, r.confidence) for r in df.collect()]
    assert len(rows(found)) == len(want) and set(rows(found)) == want
    assert not dealt_by(found, "entity_id", "alias_norm")
    assert set(rows(aliases.derive_aliases(facts_of(spark), entities_of(spark), block))) == want - {("e2", "bob", "field:name", 1.0)}


def test_cards_collect_nothing(spark, no_broadcast):
    rows = [(i, "e1", f"p{i}", f'"{"v" * (9 - i % 7)}"') for i in range(9)] + [(20, "e2", "p", "null"), (21, "e3", "q", "5")]
    f = spark.createDataFrame(rows, "id long, subject string, predicate string, object_json string")
    names = spark.createDataFrame([("e1", f"n{i % 6}" if i < 6 else f"N{i % 6}", i / 10) for i in range(8)], "entity_id string, alias string, confidence double")
    cards = vectors.card_text(f, entities_of(spark), names)
    assert "ObjectHashAggregate" not in plan(cards)
    got = {r.id: r.card for r in cards.collect()}
    assert got["e1"] == "t e1\naliases: N1, N0, n5, n4, n3\np6: vvv\np5: vvvv\np4: vvvvv\np3: vvvvvv\np2: vvvvvvv"
    assert (got["e2"], got["e3"], got["E 4"]) == ("t e2", "t e3\nq: 5", "u E 4")


def test_answers_are_met_once(spark, no_broadcast):
    found = spark.createDataFrame([("s", "e1", " Ann LEE ", 0.9), ("s", "e1", "so", 0.9), ("s", "e2", "Ann Lee", 0.9), ("s", "e1", "never", 1.0), ("s", "e1", "ann", None)], grounding.RESULT)
    sections = spark.createDataFrame([("s", "e2", "so ann lee said")], "section string, parent_subject string, text string")
    known = spark.createDataFrame([("e1", "ann lee"), ("e1", "ann"), ("e1", "lee"), ("e2", "bob")], "entity_id string, alias_norm string")
    got = grounding.ground_refs(found, sections, entities_of(spark), known)
    assert [r.locator for r in got.orderBy("locator").collect()] == [" Ann LEE ", "ann"]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD [section") == 2  # one of the answers, one of the sections


def test_payloads_are_counted_by_fact(spark):
    rows = [(1, "e1", "name", '"Ann-Ann, xΣ"'), (2, "e1", "note", '"Σ ann 3"'), (3, "e2", "name", "null"), (4, "e3", "n", "3"), (5, "e9", "name", '"ann"'), (6, "e2", None, '"T"'), (7, "e3", "o", '{"ann": 3}')]
    f = spark.createDataFrame(rows, "id long, subject string, predicate string, object_json string")
    e = entities_of(spark)
    for query in ("ann 3", "t", "E1 xς", "unknown", "", "ann ann unknown"):
        want = search.bm25(*search.index(search.payloads(f, e)), query, 2).collect()
        assert [tuple(r) for r in search.best_payloads(f, e, query, 2).collect()] == [tuple(r) for r in want]
    docs = search.index(search.payloads(f, e))[0].select("id", "dl").distinct().collect()
    assert {(r.id, r.dl) for r in search.counted(f, e, []).collect()} == {tuple(r) for r in docs}
