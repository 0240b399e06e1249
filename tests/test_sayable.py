"""Names narrowed by what the texts say."""

from pyspark.sql import functions as F

from factweave.operators import mentions


def test_names_that_no_text_can_hold_stay_out(spark):
    said = spark.createDataFrame([("ann lee",), ("de la cruz",), ("",)], "folded string")
    names = spark.createDataFrame([("ann",), ("ann cruz",), ("ann lee bob",), ("bob",), ("la la",), ("lee ann",)], "norm string")
    assert sorted(r.norm for r in mentions.sayable(said, names).collect()) == ["ann", "ann cruz", "la la", "lee ann"]


def test_one_automaton_for_many_names(spark, monkeypatch):
    """Texts are passed over once however many names they don't hold."""
    passes = []
    monkeypatch.setattr(mentions, "_finder", lambda held, keys, f=mentions._finder: passes.append(len(held.value)) or f(held, keys))
    names = spark.range(5000).select(F.concat(F.lit("name"), "id").alias("norm"))
    texts = spark.createDataFrame([(1, "so name7 said"), (2, "name9, too")], "section long, text string")
    assert sorted(r.norm for r in mentions.spotted(texts, names, ["section"], 100).collect()) == ["name7", "name9"]
    assert passes == [2]
