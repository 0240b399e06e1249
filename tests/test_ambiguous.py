"""Values that name several entities: only names with several owners are met."""

import random
import re
from collections import Counter

import pytest

from factweave.operators import keyed, reconcile
from factweave.plans import queries

from .test_keyed import plan
from .test_queries import DIR


def tables(spark, seed):
    rnd = random.Random(seed)
    entities = [(f"e{i}", f"t{i % 3}") for i in range(30)]
    names = sorted({(rnd.choice(entities)[0], f"name {rnd.randrange(25)}", rnd.choice([0.7, 1.0])) for _ in range(60)} | {("gone", "name 3", 1.0), ("e1", "sole", 1.0), ("e2", "x", 1.0), ("e3", "x", 1.0)})
    names = list({n[:2]: n for n in names}.values())
    facts = [(i, f"e{rnd.randrange(33)}", rnd.choice(["p", "q", "ref:t0"]), rnd.choice([f'" NAME  {rnd.randrange(28)} "', f'"náme {rnd.randrange(25)}"', '"Sole"', '"x"', "7", "null"])) for i in range(400)]
    made = lambda rows, schema: spark.createDataFrame(rows, schema)
    return (facts, entities, names), (
        made(facts, "id long, subject string, predicate string, object_json string"), made(entities, "id string, entity_type string"),
        made(names, "entity_id string, alias_norm string, confidence double"),
    )


def brute(facts, entities, names):
    kind, got = dict(entities), set()
    for i, subject, predicate, text in facts:
        norm = " ".join(text.strip('"').lower().replace("á", "a").split())
        if subject in kind and not predicate.startswith("ref:") and text.startswith('"') and len(norm) >= 2:
            hits = Counter(kind[e] for e, a, _ in names if a == norm and e in kind and e != subject)
            if hits and sum(n == 1 for n in hits.values()) != 1:
                got.add((i, subject, predicate))
    return got


@pytest.mark.parametrize("most", [keyed.FEW, 2])
def test_ambiguous_values(spark, monkeypatch, most):
    monkeypatch.setattr(reconcile, "few", lambda keys: keyed.few(keys, most))
    for seed in range(2):
        plain, given = tables(spark, seed)
        want = brute(*plain)
        got = [tuple(r) for r in reconcile.ambiguous_values(*given).collect()]
        assert len(want) > 20 and len(got) == len(want) and set(got) == want
        assert set(got) == {tuple(r) for r in reconcile.whole_value_hits(*given).where("winners <> 1").select("id", "subject", "predicate").collect()}


def test_only_shared_names_are_met(spark):
    # The sample tables share no name: then their facts aren't read for a second time.
    assert "FileScan parquet" not in plan(queries.QUERIES["ambiguous_values"](spark, DIR))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        final = plan(reconcile.ambiguous_values(*tables(spark, 0)[1])).split("Initial Plan")[0]
        assert re.findall(r"BroadcastHashJoin \[(\w+)#\d+L?\], \[\w+#\d+L?\], LeftSemi", final) == ["norm", "alias_norm"]  # values and aliases, where they are
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
