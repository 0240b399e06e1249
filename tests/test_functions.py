"""Scalar functions and small operators by example."""

import pytest
from pyspark.sql import functions as F

from factweave import models
from factweave.functions import text as fx
from factweave.operators import aliases, conflicts, discovery, dml, extraction, graph, pages, vectors, views
from factweave.sources import files


def one(spark, col, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(col).first()[0]


def test_normalize(spark):
    for s, want in [("  Élan  Vital ", "elan vital"), ("ÀÉÎÕÜ Ñ", "aeiou n"), ("a\t\nb", "a b"), ("", "")]:
        assert one(spark, fx.normalize_alias(F.col("s")), s=s) == want


def test_alias_shapes(spark):
    for s, want in [("ravi kumar", True), ("2024-01-02", False), ("a/b", False), ("x12345678", False), ("1234", False), ("12:30:45-a1", False), ("emp-2", True)]:
        assert one(spark, fx.looks_like_alias(F.col("s")), s=s) is want
    for s, local, name in [("ravi.kumar@x.com", "ravi.kumar", "Ravi Kumar"), ("bob@x", None, None), ("bobby@x", "bobby", None), ("@x", None, None), ("a_1@x", "a_1", None), ("none", None, None)]:
        assert one(spark, fx.email_local(F.col("s")), s=s) == local
        assert one(spark, fx.humanize_email_local(fx.email_local(F.col("s"))), s=s) == name


def test_object_text(spark):
    for s, kind, text in [('"a\\"b"', "string", 'a"b'), ("1.0", "number", "1.0"), ("null", "null", ""), ("true", "bool", "true"), ('{"a":1}', "object", '{"a":1}'), ("[1]", "array", "[1]")]:
        assert one(spark, fx.object_kind(F.col("s")), s=s) == kind
        assert one(spark, fx.value_to_string(F.col("s")), s=s) == text
    assert one(spark, fx.json_string(F.col("s")), s='é"\\') == '"é\\"\\\\"'


def test_names_and_cuts(spark):
    for s, want in [("../etc/passwd", "_.._etc_passwd"), ("a/b\\c", "a_b_c"), (".hidden", "_.hidden"), ("", "_"), ("foo@bar.com", "foo@bar.com")]:
        assert one(spark, fx.sanitize_id(F.col("s")), s=s) == want == views.safe_name(s)
    assert one(spark, fx.shorten(F.col("s")), s="x" * 600) == "x" * 250 + "…[100 chars elided]…" + "x" * 250
    assert one(spark, fx.truncate(F.col("s"), 3), s="abcd") == "abc…"
    assert one(spark, fx.truncate_bytes(F.col("s"), 4), s="aéé") == "aé"
    assert one(spark, fx.strip_fences(F.col("s")), s="```json\n{}\n```") == "{}" == extraction.strip_fences("```json\n{}\n```")


def test_cosine(spark):
    def cos(a, b):
        return spark.createDataFrame([(a, b)], "a array<float>, b array<float>").select(fx.cosine(F.col("a"), F.col("b"))).first()[0]

    assert cos([1.0, 0.0], [1.0, 0.0]) == 1 and cos([1.0, 0.0], [0.0, 1.0]) == 0
    assert abs(cos([1.0, 0.0], [1.0, 1.0]) - 0.7071068) < 1e-6
    assert cos([1.0], [1.0, 0.0]) == 0 == cos([0.0], [0.0]) == cos([], [])


def test_single_precision_confidence(spark):
    r = spark.sql("SELECT 1").select((fx.f32(F.lit(0.7)) >= 0.7).alias("a"), (fx.f32(F.lit(0.9)) < 0.9).alias("b")).first()
    assert (r["a"], r["b"]) == (False, True)


def test_decisions(spark):
    cases = [
        (("csv", 0.1, 1), ("llm", 1.0, 9), "a"), (("llm", 0.9, 1), ("json", 0.1, 0), "b"), (("pdf", 0.9, 1), ("txt", 0.5, 9), "a"),
        (("csv", 0.9, 1), ("json", 0.8, 2), "b"), (("csv", 0.9, 2), ("json", 0.8, 2), "inbox"), (("x", 0.7, 1), ("y", 0.69, 2), "a"),
    ]
    df = spark.createDataFrame([(*a, *b, w) for a, b, w in cases], "adapter_a string, conf_a double, at_a long, adapter_b string, conf_b double, at_b long, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", conflicts.decide()).collect())


def test_id_discovery(spark):
    df = spark.createDataFrame([("1", "a", "x"), ("2", "b", "x")], "Customer_ID string, grid string, uuid string")
    assert discovery.discover_id(df, "customers") == "Customer_ID"
    assert discovery.discover_id(df.drop("Customer_ID"), "customers") == "grid"
    assert discovery.discover_id(df.select("uuid"), "customers") is None
    assert discovery.discover_id(df.limit(0), "customers") is None


def test_upserts(spark):
    old = spark.createDataFrame([("e", "A", "a", "id", 1.0)], "entity_id string, alias string, alias_norm string, source string, confidence double")
    new = spark.createDataFrame([("e", "a!", "a", "derived", 0.5, 1), ("e", "a?", "a", "field:x", 0.7, 2), ("f", "b", "b", "id", 1.0, 3)], "entity_id string, alias string, alias_norm string, source string, confidence double, seq long")
    got = {tuple(r) for r in aliases.upsert_aliases(old, new).collect()}
    assert got == {("e", "a?", "a", "field:x", 1.0), ("f", "b", "b", "id", 1.0)}


def test_append_numbers_on(spark):
    facts = spark.createDataFrame([(7, "a", "p")], "id long, subject string, predicate string")
    new = spark.range(50).select(F.format_string("s%02d", "id").alias("subject"), F.lit("q").alias("predicate"))
    got = [tuple(r) for r in dml.append_facts(facts, new, ["subject"]).orderBy("id").collect()]
    assert [g[0] for g in got] == list(range(7, 58)) and [g[1] for g in got[1:]] == sorted(g[1] for g in got[1:])
    assert dml.append_facts(facts, new.limit(0), ["subject"]).count() == 1


def test_expand_ends_early(spark):
    e = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    edges = spark.createDataFrame([("a", "b"), ("c", "b"), ("d", "d")], "src string, dst string")
    got = {r["id"]: r["distance"] for r in graph.expand(edges, e, spark.createDataFrame([("a",), ("zz",)], "id string"), 9).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}


def test_card(spark):
    e = spark.createDataFrame([("emp_42", "employees")], "id string, entity_type string")
    a = spark.createDataFrame([("emp_42", "Bob", 0.6), ("emp_42", "Robert Tables", 1.0), ("emp_42", "rtables", 0.8), ("emp_42", "EMP_42", 1.0)], "entity_id string, alias string, confidence double")
    f = spark.createDataFrame([(1, "emp_42", "title", '"Engineer"'), (2, "emp_42", "bio", '"' + "x" * 500 + '"'), (3, "emp_42", "dept", '"IT"'), (4, "emp_42", "gone", "null")], "id long, subject string, predicate string, object_json string")
    card = vectors.card_text(f, e, a).first()["card"]
    assert card == "employees emp_42\naliases: Robert Tables, rtables, Bob\ndept: IT\ntitle: Engineer\nbio: " + "x" * 200 + "…"


def test_id_substrings(spark):
    s = spark.createDataFrame([(1, "see EMP_42 and emp_7"), (2, "none")], "section long, text string")
    e = spark.createDataFrame([("emp_4", "t"), ("emp_42", "t"), ("ab", "t")], "id string, entity_type string")
    assert {(r["section"], r["entity_id"]) for r in vectors.id_candidates_in_text(s, e).collect()} == {(1, "emp_4"), (1, "emp_42")}


def test_answers():
    facts, refs = extraction.parse_answer('```json\n{"facts": [{"subject": "a", "predicate": "p", "object": 1}, {"subject": "a"}], "refs": [{"entity_id": "x"}, 3]}\n```')
    assert len(facts) == 1 and len(refs) == 1
    assert extraction.parse_answer("sorry") == ([], []) == extraction.parse_answer("[1]")


def test_clients():
    assert models.backoff(30, retry_after=90) == 60 and 0 <= models.backoff(3) <= 8
    v = models.HashEmbeddings(8).embed(["a b", "a b", ""])
    assert v[0] == v[1] and v[2] == [0.0] * 8
    c = models.ModelConfig.load(None, {"FACTWEAVE_MODEL": "m"})
    assert (c.model, c.provider, c.base_url, c.concurrency) == ("m", "lmstudio", "http://127.0.0.1:1234/v1", 4) and c.key()
    c = models.ModelConfig.load(None, {"FACTWEAVE_PROVIDER": "gemini", "GEMINI_API_KEY": "k", "FACTWEAVE_RETRIES": "2"})
    assert (c.key(), c.retries) == ("k", 2) and c.base_url.endswith("v1beta")
    assert models.ModelConfig.load(None, {"FACTWEAVE_PROVIDER": "gemini", "GEMINI_API_KEY": "k", "FACTWEAVE_API_KEY": "own"}).key() == "own"
    with pytest.raises(ValueError):
        models.ModelConfig.load(None, {"FACTWEAVE_PROVIDER": "openai"}).key()


def test_ignore_patterns():
    import re

    hit = lambda p, path: bool(re.search(files.ignore_regex(p), path))
    assert hit("*.log", "a/b.log") and not hit("*.log", "a/b.log2") and hit("/top", "top/x") and not hit("/top", "a/top")
    assert hit("build/", "x/build/y") and hit("a/**/z", "a/b/c/z") and hit("a/**/z", "a/z") and not hit("a/*/z", "a/b/c/z")
    assert files.ignore_regex("# no") is None is files.ignore_regex("") is files.ignore_regex("!x")


def test_line_separators_inside_json():
    text = '{"id": "a\u2028b"}\r\n\n{"id": "c\x85"}\n'
    assert [r["id"] for _, r in files.read_json(text.encode(), "x.jsonl")] == ["a\u2028b", "c\x85"]


def test_numbers_are_dense_written_and_kept(spark, tmp_path):
    new = spark.range(1_200_000).select(F.format_string("s%03d", F.col("id") % 997).alias("subject"), (F.col("id") * 7919 % 1_200_000).alias("x"))
    got = dml.number_on(new, ["subject", "x"], 5)
    got.write.parquet(str(tmp_path / "n"))
    for df in (spark.read.parquet(str(tmp_path / "n")), got.persist()):
        assert tuple(df.selectExpr("count(*)", "count(id)", "count(DISTINCT id)", "min(id)", "max(id)").first()) == (1_200_000, 1_200_000, 1_200_000, 6, 1_200_005)
    a, b = got.orderBy("id").select("subject", "x").limit(2000).collect(), got.orderBy("subject", "x").select("subject", "x").limit(2000).collect()
    assert a == b
    got.unpersist()


def test_first_type_wins(spark):
    old = spark.createDataFrame([("a", "t0")], "id string, entity_type string")
    new = spark.createDataFrame([("a", "t1", 1), ("b", "t2", 5), ("b", "t3", 2), ("b", "t1", 9)], "id string, entity_type string, seq int")
    assert sorted(map(tuple, dml.insert_new(old, new, ["id"], "seq").collect())) == [("a", "t0"), ("b", "t3")]


def test_type_ranks():
    counts = [("logs", 90), ("people", 3), ("orders", 40)]
    assert pages.rank_types(counts, models.FakeChat(lambda s, u: '```json\n{"order": ["people", "nope", "people"]}\n```')) == ["people", "logs", "orders"]
    for bad in ("no", '{"order": "people"}', "[]"):
        assert pages.rank_types(counts, models.FakeChat(lambda s, u, bad=bad: bad)) == ["logs", "orders", "people"]
    assert all(0.8 * 2**k <= pages.wait("x", k) <= 1.2 * 2**k for k in range(6)) and pages.wait("x", 99) <= 72 and pages.wait("x", 1) == pages.wait("x", 1)


def test_adapters():
    r = files.default_registry()
    assert r.pick("a/b.CSV", b"").name == "csv" and r.pick("x", b"  {").name == "json" and r.pick("x.bin", b"%PDF-1").name == "pdf" and r.pick("x.bin", b"zz") is None
    assert list(files.read_json(b'[{"b": 1.0, "a": null}, 3]', "x.json")) == [("r", {"b": "1.0", "a": None}), ("r", {"value": "3"})]
    assert files.canonical({"b": files.Raw("1.0"), "a": [None, True, "é"]}) == '{"a":[null,true,"é"],"b":1.0}'
    pages = files.pdf_reader(lambda b: "one\f \fthree")
    assert [x[1][2] for x in pages(b"", "x.pdf")] == ["page:1", "page:3"]


def test_vectors_as_bytes(spark):
    v = [0.0, 1.5, -2.25, 1.0000000116860974e-07]
    df = spark.createDataFrame([(v,), (None,)], "v array<float>").withColumn("b", vectors.to_blob(F.col("v"))).withColumn("w", vectors.from_blob(F.col("b")))
    rows = df.collect()
    assert rows[0]["w"] == rows[0]["v"] and bytes(rows[0]["b"])[4:8] == b"\0\0\xc0?" and rows[1]["w"] is None
