"""Names in texts, against all n-grams."""

import random

from factweave.operators import mentions, reconcile


def brute(text, names):
    """(norm, n, pos, surface) of each name at its first place."""
    import re
    import unicodedata

    fold = lambda s: "".join(unicodedata.normalize("NFD", c)[0] if "à" <= c <= "ÿ" else c for c in s)
    raw = [t for t in re.split(r"[^\w'-]+", (text or "").lower()) if t]
    tokens, out = [fold(t) for t in raw], {}
    for n in range(1, 6):
        for i in range(len(tokens) - n + 1):
            norm = " ".join(tokens[i : i + n])
            if norm in names and norm not in out:
                out[norm] = (norm, n, i + 1, " ".join(raw[i : i + n]))
    return set(out.values())


def texts(seed=1):
    rng = random.Random(seed)
    words = ["ann", "lee", "ann-lee", "o'neil", "José", "de", "la", "Cruz", "zoë", "x9", "und", "von", "der"]
    rows = [(i, " ".join(rng.choice(words) + rng.choice(["", ",", ".", "!"]) for _ in range(rng.randint(1, 60)))) for i in range(80)]
    return [*rows, (80, None), (81, ""), (82, "..."), (82, "ann lee"), (83, "de la cruz von der lee")]


NAMES = ["ann", "ann lee", "ann-lee", "jose de la cruz", "de la cruz von der", "de la cruz von der lee", "o'neil", "zoe x9", "und", "cruz", "missing name", "a/b", "ann", None, "lee ann lee ann lee"]


def test_spotted_matches_all_ngrams(spark):
    rows = texts()
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "section long, text string, norm string").repartition(3)
    names = spark.createDataFrame([(n,) for n in NAMES], "norm string")
    want = sorted((i, *x) for i, t in rows for x in brute(t, {n for n in NAMES if n and n.count(" ") < 5}))
    for shard in (1_000, 20):  # one automaton, and one for every few names
        got = mentions.spotted(df.drop("norm"), names, ["section"], shard)
        assert sorted(map(tuple, got.select("section", "norm", "n", "pos", "surface").collect())) == want
    assert mentions.spotted(df.drop("norm"), names.limit(0), ["section"]).count() == 0
    assert mentions.spotted(df.drop("norm").limit(0), names, ["section"]).count() == 0


def test_texts_are_not_shuffled(spark):
    df = spark.createDataFrame(texts(), "section long, text string")
    found = mentions.spotted(df, spark.createDataFrame([("ann",)], "norm string"), ["section"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_candidates_keep_the_first_owners(spark):
    """A name of many owners brings the most that a text can have, in order."""
    entities = spark.createDataFrame([(f"e{i:04d}", "people" if i % 3 else "places") for i in range(900)], "id string, entity_type string")
    alias = [(f"e{i:04d}", "Ann", "ann", "x", 1.0) for i in range(900)] + [("e0899", "Ann Lee", "ann lee", "x", 0.9), ("e0001", "Lee", "lee", "x", 0.5)]
    aliases = spark.createDataFrame(alias, "entity_id string, alias string, alias_norm string, source string, confidence double")
    sections = spark.createDataFrame([("s", "Lee, ann lee, Ann"), ("t", "lee")], "section string, text string")
    got = {}
    for r in reconcile.text_candidates(sections, entities, aliases, 20).orderBy("section", "place").collect():
        got.setdefault(r["section"], []).append((r["entity_id"], r["surface"]))
    assert got["t"] == [("e0001", "lee")]
    owners = sorted((("people" if i % 3 else "places"), f"e{i:04d}") for i in range(900) if i not in (899, 1))
    assert got["s"] == [("e0899", "ann lee"), ("e0001", "lee"), *[(e, "ann") for _, e in owners[:18]]]
