"""Document quality by a linear-chain conditional random field over lines."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lots, table
from .crf import Crf, logistic, sigmoid, train
from .training import fold, labelled_sample

#: Labelled documents that the model is fitted on, at most.
SAMPLE = 6_000
_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?", b"#$%&*@^~=_", b"|<>{}[]\\/", b".,;:'\"()-", b" \t"]
OWN = len(_CLASSES) + 8


def line_features(lines: list[str]) -> np.ndarray:
    """Features of each line of one document, its own and its neighbours'."""
    times = Counter(lines)
    rows = []
    for line in lines:
        b = line.encode("utf-8", "replace")
        n, words = max(1, len(b)), line.split()
        k = max(1, len(words))
        rows.append([
            *((len(b) - len(b.translate(None, c))) / n for c in _CLASSES), math.log1p(len(b)), math.log1p(len(words)), len(set(words)) / k,
            sum(map(eq, words, words[1:])) / k, min(20.0, len(line) / k), times[line] > 1, (len(line) - len(line.encode("ascii", "ignore"))) / max(1, len(line)), not words,
        ])
    own = np.array(rows, dtype=np.float64).reshape(len(lines), OWN)
    out = np.zeros((len(lines), 3 * OWN))
    out[:, :OWN] = own
    out[1:, OWN : 2 * OWN] = own[:-1]
    out[:-1, 2 * OWN :] = own[1:]
    return out


def _lines(text: str | None) -> list[str]:
    return (text or "").split("\n")


def _aggregate(p: np.ndarray, sizes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the lines' marginals, as log-odds, by document."""
    starts = np.cumsum(lengths) - lengths
    mean = np.add.reduceat(p * sizes, starts) / np.add.reduceat(sizes, starts)
    mean = np.clip(mean, 1e-6, 1 - 1e-6)
    return np.log(mean / (1 - mean))


def _batch(texts: list[str | None]):
    lines = [_lines(t) for t in texts]
    x = np.vstack([line_features(ls) for ls in lines])
    return x, np.array([len(s) + 1.0 for ls in lines for s in ls]), np.array([len(ls) for ls in lines])


class QualityModel:
    """Chain over a document's lines; each line takes its document's label in
    training. ``base`` is the score of everything where one class has no example."""

    def __init__(self, sample: list[tuple[str, int]]):
        y = np.array([v for _, v in sample])
        self.base = float(y.mean()) if len(y) else 0.5
        self.crf: Crf | None = None
        if len(y) and 0 < self.base < 1:
            x, sizes, lengths = _batch([t for t, _ in sample])
            self.crf = train(x, np.repeat(y, lengths), lengths)
            z = _aggregate(self.crf.marginals(x, lengths), sizes, lengths)
            self.final = logistic(z[:, None], y)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.crf is None or not texts:
            return np.full(len(texts), self.base)
        x, sizes, lengths = _batch(texts)
        z = _aggregate(self.crf.marginals(x, lengths), sizes, lengths)
        return sigmoid(self.final[0] + self.final[1] * z)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> QualityModel:
    return QualityModel(labelled_sample(docs, labels, "quality", 4, 2, rows))


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score) of every whole text; 0 to 1, higher is better.

    A null text is empty; an empty text is one empty line and has a score; null
    ids and repeated rows are scored like any other; an empty table gives no
    rows. Nothing is shuffled.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for a, z in lots(p["text"].tolist()):
                q = p.iloc[a:z]
                yield pd.DataFrame({"doc_id": q["doc_id"], "score": model.score(q["text"].tolist())})

    out = docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(run, "doc_id string, score double")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document; held_out is false for a null doc_id."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )
