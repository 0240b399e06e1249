"""Changed files: what they said goes without the rest being written again."""

import json
import os
import random

import pytest

from factweave.plans.engine import Engine
from factweave.sources.store import REMOVED, StaleVersion, Store


def size(root):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet"))


def write(folder, name, rows):
    with open(f"{folder}/{name}.json", "w") as f:
        json.dump(rows, f)


def facts(e):
    docs = {r["id"]: os.path.basename(r["path"]) for r in e.store.table("documents").collect()}
    return sorted((docs[r["document_id"]], r["subject"], r["predicate"], r["object_json"]) for r in e.store.table("facts").collect())


def test_rounds_of_changes_leave_the_last_state(spark, tmp_path):
    """Files change, stay and come back as they were; a new store of the last state
    holds the same facts."""
    rng, src = random.Random(3), tmp_path / "in"
    src.mkdir()
    state = {k: [{f"{k}_id": f"{k}{i}", "name": f"{k} {i}", "n": i} for i in range(12)] for k in ("aa", "bb", "cc")}
    e = Engine(spark, str(tmp_path / "s"))
    for step in range(4):
        for k in rng.sample(sorted(state), 2) if step else sorted(state):
            state[k][rng.randrange(12)]["n"] = 100 * step + 7
            write(src, k, state[k])
        e.ingest(str(src))
        assert e.stats == ({"stale": 2, "cached": 1} if step else {"fresh": 3})
    fresh = Engine(spark, str(tmp_path / "t"))
    fresh.ingest(str(src))
    assert facts(e) == facts(fresh) and len(facts(e)) == 72
    removed = e.store.manifest()[REMOVED]
    assert len(removed["facts"]) == 3 and [r["column"] for r in removed["documents"]] == ["id"] * 3
    for name in ("facts", "documents", "conflicts"):
        e.store.compact(name)
    assert facts(e) == facts(fresh) and not {"facts", "documents"} & e.store.manifest().get(REMOVED, {}).keys()
    e.store.vacuum()
    assert facts(e) == facts(fresh)


def test_bytes_written_follow_the_change(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    write(src, "big", [{"big_id": f"b{i}", "text": f"{i * i} words of row {i}", "n": i} for i in range(20_000)])
    write(src, "small", [{"small_id": f"s{i}", "n": i} for i in range(5)])
    e = Engine(spark, str(tmp_path / "s"))
    e.ingest(str(src))
    before = size(tmp_path / "s")
    write(src, "small", [{"small_id": f"s{i}", "n": i + 1} for i in range(5)])
    e.ingest(str(src))
    assert size(tmp_path / "s") - before < before / 10
    assert [f[3] for f in facts(e) if f[0] == "small.json"] == ["1", "2", "3", "4", "5"]


def test_removals_hold_for_the_rows_before_them(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    rows = lambda *ids: spark.createDataFrame([(i, "t") for i in ids], "id string, entity_type string")
    ids = lambda version=None: sorted(r["id"] for r in s.table("entities", version).collect())
    gone = lambda *x: {"entities": spark.createDataFrame([(i,) for i in x], "id string")}
    s.commit(entities=rows("a", "b", "c"))
    s.commit(1, {"entities": rows("a", "d")}, gone("a", "x", None))  # an appended row of the same id stays
    assert ids() == ["a", "b", "c", "d"] and ids(1) == ["a", "b", "c"]
    s.commit(2, None, gone("a", "b"))
    assert ids() == ["c", "d"]
    with pytest.raises(StaleVersion):
        s.commit(2, None, gone("c"))
    s.commit(3, {"entities": rows("b")})
    assert ids() == ["b", "c", "d"]
    s.compact("entities")
    assert ids() == ["b", "c", "d"] and REMOVED not in s.manifest()
    s.commit(None, None, gone("b", "c", "d"))
    assert ids() == []
    s.commit(entities=rows("b"))  # a replaced table starts anew
    assert ids() == ["b"]
    s.commit(None, None, {"facts": spark.createDataFrame([(1,)], "document_id long")})
    assert s.table("facts").count() == 0
