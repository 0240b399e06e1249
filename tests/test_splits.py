"""Large files read in ranges give what they give whole."""

import csv
import json
import os
import random

import pytest

from factweave.plans.engine import Engine
from factweave.sources import files, splits

WORDS = ["a", "b c", "x,y", '"q"', "line\nbreak", "é", "{", "}", "[]", "\\", "1.50", "", " ", "tab\there", "\r\n"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Files whose fields and strings hold every separator; broken ones; one value."""
    d, rng = str(tmp_path_factory.mktemp("large")), random.Random(1)
    word = lambda: rng.choice(WORDS)
    with open(f"{d}/t.csv", "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(["id", "na\nme", "c"])
        for i in range(3_000):
            w.writerow([i, word() + word(), "z" * rng.randint(0, 60) + word()])
            if i % 97 == 0:
                f.write("\r\n")
    with open(f"{d}/long.csv", "w", newline="") as f:
        csv.writer(f).writerows([["id", "t"], *[[i, ("x\n" * 20_000 if i % 30 == 7 else word())] for i in range(100)]])
    with open(f"{d}/u.tsv", "w", newline="") as f:
        f.write("﻿id\tx\n" + "".join(f"{i}\t{'q' * (i % 50)}\n" for i in range(2_000)))
    with open(f"{d}/l.jsonl", "w") as f:
        for i in range(2_000):
            f.write(json.dumps({"id": i, "t": word() + " ", "n": [1, {"a": word()}]}, ensure_ascii=i % 2 == 0) + ("\n\n" if i % 50 == 0 else "\n"))
    with open(f"{d}/a.json", "w") as f:
        json.dump([{"id": i, "t": word() * 3, "n": {"k": [1, 2.50, {"z": word()}]}} for i in range(2_500)], f, indent=1)
    with open(f"{d}/v.json", "w") as f:
        json.dump([rng.choice([1, "x,y", None, [1, [2, 3]], {"a": "}{"}, "long " * 200]) for i in range(2_500)], f)
    texts = {
        "bad.csv": "a,b\n" + "1,2\n" * 9_000 + "1,2,3\n" + "1,2\n" * 9_000, "open.json": "[" + '{"a":1},' * 9_000 + '{"a":2}', "comma.json": "[" + '{"a":1},' * 9_000 + "]",
        "two.json": "[" + '{"a":1},' * 9_000 + '{"a":2}] []', "behind.json": "[" + "1," * 9_000 + "2],", "obj.json": '{"a":"' + "y" * 80_000 + '"}', "quote.csv": "a,b\n" + "1,2\n" * 9_000 + '1,"2\n' + "1,2\n" * 9_000,
        "mac.csv": "a,b\r" + "1,2\r" * 9_000, "blank.jsonl": "\n" * 20_000, "none.json": "[" + " " * 20_000 + "]",
    }
    for name, text in texts.items():
        with open(f"{d}/{name}", "w", newline="") as f:
            f.write(text)
    with open(f"{d}/latin.csv", "wb") as f:
        f.write(b"a,b\n" + b"1,2\n" * 9_000 + b"1,\xe9\n")
    return d


@pytest.fixture
def ranges(spark):
    """Sets how many bytes a range has."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")
    yield lambda size: [spark.conf.set(n, v) for n, v in zip(names, (size, "1", "37"), strict=True)]
    for n in names:
        spark.conf.unset(n)


def items(spark, d, over):
    rows = files.walk(spark, d, options=files.WalkOptions(split_over=over)).collect()
    return sorted((os.path.basename(r["path"]), r["adapter"], r["kind"], r["pos"], r["fields"] or "", bool(r["error"])) for r in rows), {os.path.basename(r["path"]): r["content_hash"] for r in rows}


def test_any_ranges_give_the_same(spark, folder, ranges):
    want, _ = items(spark, folder, 1 << 40)
    assert len(want) > 12_000 and sum(w[-1] for w in want) == 7
    hashes = set()
    for size in ("3000", "20k"):
        ranges(size)
        got, found = items(spark, folder, 10_000)
        assert got == want
        hashes.add(tuple(sorted(found.items())))
    assert len(hashes) == 1


def test_a_large_file_is_read_by_many_tasks(spark, folder, ranges):
    ranges("20k")
    name = f"{folder}/a.json"
    lines = spark.read.option("lineSep", "}").text(name)
    assert lines.rdd.getNumPartitions() > 8
    starts = lines.selectExpr("_metadata.file_block_start AS s").distinct().count()
    assert starts > 8


def test_ingest_reads_large_files(spark, tmp_path, ranges):
    """The engine's ingest gives the same facts, and knows the file again."""
    src = tmp_path / "in"
    src.mkdir()
    (src / "people.json").write_text(json.dumps([{"people_id": f"p{i}", "name": f"Name {i}", "age": i % 90} for i in range(900)]))
    facts = lambda e: sorted(map(tuple, e.store.table("facts").select("subject", "predicate", "object_json").collect()))
    whole = Engine(spark, str(tmp_path / "a"))
    whole.ingest(str(src))
    ranges("9000")
    options = files.WalkOptions(split_over=1_000)
    ranged = Engine(spark, str(tmp_path / "b"))
    ranged.ingest(str(src), options=options)
    assert facts(ranged) == facts(whole) and len(facts(whole)) == 1_800
    ranged.ingest(str(src), options=options)
    assert ranged.stats == {"cached": 1}


def test_forms():
    assert [splits.form_of(p, h) for p, h in [("a.CSV", b""), ("a.tsv", b""), ("a.ndjson", b"{"), ("a.json", b'\xef\xbb\xbf [ {"'), ("a.json", b"[1"), ("a.json", b'{"a"'), ("a", b"[{")]] == ["csv", "tsv", "lines", "array", "values", None, "array"]


@pytest.mark.parametrize("line, before, after", [('a,"b', False, True), ('a,"b"', False, False), ('a"b,c', False, False), ('x",y', True, False), ('x"",y', True, True), ('x"",""",z"', True, False), ('"",""', False, False), ("plain", True, True)])
def test_open_fields(line, before, after):
    assert splits.inside_after(line + "\n", before, ",") == after
