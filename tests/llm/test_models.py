"""The chain model, quality and toxicity, and the pipeline."""

import itertools
import random

import numpy as np

import corpus_pipeline
from factweave.llm import crf, quality, toxicity

from .helpers import frame, prose


def test_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    e, t, lengths = rng.normal(size=9), rng.normal(size=(2, 2)), np.array([5, 1, 3])
    a, b, _ = crf.passes(e, lengths, t)
    at = 0
    for n in lengths:
        weights = np.zeros(n)
        total = 0.0
        for y in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(e[at + i] * y[i] for i in range(n)) + sum(t[y[i], y[i + 1]] for i in range(n - 1)))
            total += w
            weights += w * np.array(y)
        assert np.allclose(crf.sigmoid(a + b)[at : at + n], weights / total)
        at += n


def test_training_learns_neighbours():
    rng = np.random.default_rng(1)
    lengths = np.full(60, 30)
    y = np.concatenate([np.repeat(rng.integers(0, 2, 6), 5) for _ in range(60)])
    x = y[:, None] + rng.normal(scale=1.2, size=(len(y), 1))
    m = crf.train(x, y, lengths)
    chain = ((m.marginals(x, lengths) > 0.5) == y).mean()
    alone = ((x[:, 0] > 0.5) == y).mean()
    assert chain > alone + 0.05


def _labelled(rng, n=300):
    out = []
    for i in range(n):
        lines = [prose(rng, 12) for _ in range(4)]
        bad, toxic = i % 4 == 0, i % 5 == 1
        if bad:
            lines = [x.upper().replace(" ", "!! ") for x in lines]
        if toxic:
            w = lines[1].split(" ")
            w[3], w[8] = rng.choice(["moronic", "rotten"]), rng.choice(["scummy", "vile"])
            lines[1] = " ".join(w)
        out.append((i, "\n".join(lines), int(not bad), int(toxic)))
    return out


def test_classifiers_on_held_out_documents(spark):
    rows = _labelled(random.Random(3))
    docs = frame(spark, [(i, t, "x") for i, t, _, _ in rows])
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows] + [(5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    q = quality.score(docs, quality.fit(docs, labels)).collect()
    assert np.mean([(r["score"] >= 0.7) == rows[r["doc_id"]][2] for r in q]) > 0.97
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model, spans=True).collect()
    assert np.mean([(r["toxicity"] >= 0.5) == rows[r["doc_id"]][3] for r in got]) > 0.97
    words = {r["text"][s["start"] : s["end"]] for r in got for s in r["toxic_spans"]}
    assert words and words <= {"moronic", "rotten", "scummy", "vile"}
    assert set(got[0].asDict()) >= {"tag", "key", "spans"}


def test_scores_without_labels_and_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, None), (None, ""), (2, "a\n" * 2000), (2, "a\n" * 2000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in quality.score(docs, quality.fit(docs, none)).collect()] == [0.5] * 4
    assert [r["toxicity"] for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()] == [0.5] * 4
    rows = _labelled(random.Random(4), 60)
    m = quality.QualityModel([(t, q) for _, t, q, _ in rows])
    got = quality.score(docs, m).collect()
    assert len(got) == 4 and all(0 <= r["score"] <= 1 for r in got)
    t = toxicity.ToxicityModel([(t, x) for _, t, _, x in rows])
    assert all(0 <= r["toxicity"] <= 1 for r in toxicity.score(docs, t).collect())
    assert toxicity.score(docs.limit(0), t).count() == 0 and quality.score(docs.limit(0), m).count() == 0


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(8)
    rows = _labelled(rng, 240)
    docs = [(i, t, "en", "s", len(t)) for i, t, _, _ in rows]
    item = prose(rng, 30)
    docs[7] = (7, item + "\n" + docs[7][1][:50], "en", "s", 0)
    docs[12] = (12, docs[10][1], "en", "s", 0)
    docs.append((500, None, None, None, None))
    d = str(tmp_path / "t")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, q, x) for i, _, q, x in rows], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "SimHash near-dedup", "benchmark decontamination", "packing"]
    now, kept = spark.read.parquet(f"{d}/documents.parquet"), []
    columns = now.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, d).persist()
        assert now.columns == columns
        kept.append({r["doc_id"] for r in now.collect()})
    toxic = {i for i, _, _, x in rows if x}
    assert not kept[0] & toxic and len(kept[0]) >= len(docs) - len(toxic) - 1
    assert kept[1] == kept[0]
    assert 7 in kept[2] and 7 not in kept[3] and kept[2] - kept[3] == {7}
    final = {r["doc_id"] for r in corpus_pipeline.run(spark, d).collect()}
    assert final == kept[3]


def test_non_ascii_late_in_a_line():
    line = "a" * 300 + "é" * 100
    x = quality.line_features([line, "é" * 4, ""])
    assert x[:, quality.OWN - 2].tolist() == [0.25, 1.0, 0.0]


def test_pipeline_without_a_toxicity_model(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (None, "c")], "doc_id long, text string")
    for name, labels in (("none", []), ("toxic", [(1, 1), (2, 1)])):
        d = str(tmp_path / name)
        docs.write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
        got = corpus_pipeline.drop_toxic(spark, docs, d)
        assert got.columns == docs.columns and sorted(map(str, got.collect())) == sorted(map(str, docs.collect()))


def test_unseen_forms_of_toxic_tokens():
    rows = _labelled(random.Random(5), 400)
    m = toxicity.ToxicityModel([(t, x) for _, t, _, x in rows])
    clean = next(t for _, t, _, x in rows if not x)
    plain, hidden, other = (clean + f"\nyou are {w} and {v} indeed" for w, v in (("moronic", "vile"), ("m0ronic", "sccummmy"), ("bucolic", "tile")))
    scores, spans = m.rate([plain, hidden, other, None])
    assert scores[0] > 0.5 and scores[1] > 0.5 and scores[2] < 0.5 and scores[3] < 0.5
    assert [hidden[s["start"] : s["end"]] for s in spans[1]] == ["m0ronic", "sccummmy"] and spans[2] == spans[3] == []


def test_sample_is_bounded_in_characters(spark):
    from factweave.llm.training import labelled_sample

    docs = spark.createDataFrame([(i, "x" * (10 if i else 5000)) for i in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(100)], "doc_id long, quality int")
    got = labelled_sample(docs, labels, "quality", 4, 2, 50, 250)
    assert 0 < len(got) <= 25 and {len(t) for t, _ in got} == {10}


def test_long_texts_are_examples(spark):
    """No text is passed over for its length, if the sample can hold it; where the
    characters run out there are fewer rows."""
    from factweave.llm.training import labelled_sample

    docs = spark.createDataFrame([(i, "x" * (900 if i % 3 == 0 else 10)) for i in range(100)] + [(1, "twice"), (5, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(7, 0), (None, 1), (300, 1)], "doc_id long, quality int")
    got = labelled_sample(docs, labels, "quality", 4, 2, 60)
    assert 20 <= sum(len(t) == 900 for t, _ in got) and len(got) <= 60
    few = labelled_sample(docs, labels, "quality", 4, 2, 60, 3_000)
    assert 0 < sum(len(t) for t, _ in few) <= 3_000 and any(len(t) == 900 for t, _ in few) and set(few) <= set(got)
    assert labelled_sample(docs.limit(0), labels, "quality", 4, 2, 60) == [] == labelled_sample(docs, labels.limit(0), "quality", 4, 2, 60)


def test_toxicity_is_fitted_in_a_task(spark, monkeypatch):
    from factweave.llm.training import labelled_sample

    rng, rows = random.Random(5), []
    for i in range(300):
        words = prose(rng, 30).split()
        if i % 3 == 0:
            words[7:7] = ["vilewort", "grubmoss"]
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    here = toxicity.ToxicityModel(labelled_sample(docs, labels, "toxic", 5, 0, toxicity.SAMPLE))

    def no(*_, **__):
        raise AssertionError("fitted in the driver")

    monkeypatch.setattr(toxicity, "train", no)
    model = toxicity.fit(docs, labels)
    texts = [t for _, t, _ in rows] + ["", None]
    assert here.crf is not None
    assert np.array_equal(model.score(texts), here.score(texts))
    assert toxicity.fit(docs, labels.limit(0)).crf is None
