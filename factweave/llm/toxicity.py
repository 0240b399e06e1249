"""Toxic spans and document toxicity by a linear-chain conditional random field."""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lots, spare, table
from .crf import Crf, logistic, sigmoid, train
from .training import fold, in_order, sample

#: Labelled documents that the model is fitted on, at most.
SAMPLE = 4_000
#: Of these so many, at most, give token chains.
CHAINS = 1_000
#: Least log-likelihood ratio and log-odds of a candidate token.
EVIDENCE, ODDS = 16.0, 1.5
TOKEN = re.compile(r"\n|[^\W_]+")
FEATURES = 5


def tokens(text: str | None) -> list[str]:
    """Words in lower case, and line ends."""
    return TOKEN.findall((text or "").lower())


# Signs that stand for letters in disguised words.
_SIGNS = str.maketrans("01345789", "oieastbg")
#: What an unseen token that looks like a candidate is worth of its log-odds.
ALIKE = 0.75


def folded(token: str) -> str:
    """Letters for signs, and runs of a letter as one: how disguised forms of a
    word agree."""
    return _RUN.sub(r"\1", token.translate(_SIGNS))


_RUN = re.compile(r"(.)\1+")


class Odds(dict):
    """Log-odds by token, looked up as a dict is. A token that training never saw
    counts as the candidate whose folded form it shares, at ALIKE; all else is 0.
    What has been looked up is kept, up to a bound."""

    def __init__(self, known: dict[str, float], seen: frozenset[str], most: int = 200_000):
        super().__init__(known)
        self.known, self.seen, self.most = known, seen, most
        self.alike: dict[str, float] = {}
        for t, v in known.items():
            k = folded(t)
            if len(k) >= 4:
                self.alike[k] = max(self.alike.get(k, 0.0), ALIKE * v)

    def __missing__(self, token: str) -> float:
        v = self.alike.get(folded(token), 0.0) if len(token) < 40 and token not in self.seen else 0.0
        if len(self) >= self.most:
            self.clear()
            self.update(self.known)
        self[token] = v
        return v

    def __reduce__(self):
        return Odds, (self.known, self.seen, self.most)


class Words:
    """Numbers for tokens: a text is held as an array, not as strings."""

    def __init__(self):
        self.ids = {"\n": 0}

    def __call__(self, text: str | None) -> np.ndarray:
        return np.array([self.ids.setdefault(t, len(self.ids)) for t in tokens(text) or ["\n"]], dtype=np.int32)


def candidates(texts: list[np.ndarray], y: np.ndarray, size: int) -> np.ndarray:
    """By token number the log-odds of tokens that labelled toxic texts use far
    more than others, else 0. A token counts once for each pair of neighbours, so
    copies add nothing."""
    counts = []
    for want in (False, True):
        w = np.concatenate([np.concatenate([[0], t, [0]]) for t, v in zip(texts, y > 0, strict=True) if v == want]).astype(np.uint64)
        key = (w[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ w[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) ^ w[2:]
        counts.append(np.bincount(w[1:-1][np.unique(key, return_index=True)[1]].astype(np.int64), minlength=size))
    clean, toxic = (c.astype(np.float64) for c in counts)
    all_clean, all_toxic = max(1.0, clean.sum()), max(1.0, toxic.sum())
    rate, k = all_toxic / (all_toxic + all_clean), np.maximum(clean + toxic, 1)
    part = lambda n, p: np.where(n > 0, n * np.log(np.maximum(n, 1) / (k * p)), 0)
    g = 2 * (part(toxic, rate) + part(clean, 1 - rate))
    s = np.log((toxic + 0.5) / all_toxic) - np.log((clean + 0.5) / all_clean)
    # so much that of all tokens tested about one would pass by chance
    chance = 2 * np.log(max(1, np.count_nonzero(toxic)))
    good = (g >= max(EVIDENCE, chance)) & (s >= ODDS) & (toxic > 0)
    good[0] = False
    return np.where(good, np.minimum(s, 8.0), 0.0)


def _features(own: np.ndarray, end: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of the tokens of all texts end to end: own and neighbours' log-odds, and
    whether it is a line end. A text's first token has no left neighbour, its
    last no right one."""
    x = np.zeros((len(own), FEATURES))
    x[:, 0], x[:, 1] = own, own > 0
    x[1:, 2], x[:-1, 3] = own[:-1], own[1:]
    x[:, 4] = end
    starts = np.cumsum(lengths) - lengths
    x[starts, 2] = 0
    x[starts + lengths - 1, 3] = 0
    return x


def _chains(texts: list[str | None], odds: Odds):
    """Features of texts, and their lengths; an empty text is one line end."""
    words = [tokens(t) or ["\n"] for t in texts]
    lengths = np.array([len(w) for w in words])
    n = int(lengths.sum())
    own = np.fromiter((odds[t] for w in words for t in w), dtype=np.float64, count=n)
    end = np.fromiter((t == "\n" for w in words for t in w), dtype=np.float64, count=n)
    return _features(own, end, lengths), lengths


def _summary(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """By document: log of the expected number of toxic tokens, and the largest
    marginal but one, so that a chance hit alone doesn't settle the matter."""
    starts = np.cumsum(lengths) - lengths
    top = p == np.repeat(np.maximum.reduceat(p, starts), lengths)
    nth = np.cumsum(top)
    nth -= np.repeat(nth[starts] - top[starts], lengths)
    rest = np.where(top & (nth == 1), 0.0, p)
    return np.column_stack([np.log1p(np.add.reduceat(p, starts)), np.maximum.reduceat(rest, starts)])


class ToxicityModel:
    """Token chain: a candidate token in a toxic text is labelled toxic, all else
    is not. ``base`` is the score of everything where one class has no example."""

    def __init__(self, sample: list[tuple[str, int]]):
        y = np.array([v for _, v in sample])
        self.base = float(y.mean()) if len(y) else 0.5
        self.crf: Crf | None = None
        self.odds = Odds({}, frozenset())
        if not len(y) or not 0 < self.base < 1:
            return
        words = Words()
        ids = [words(t) for t, _ in sample]
        odds = candidates(ids, y, len(words.ids))
        known = {t: float(odds[i]) for t, i in words.ids.items() if odds[i] > 0}
        # of the tokens seen only those matter that look like a candidate
        like = {folded(t) for t in known}
        self.odds = Odds(known, frozenset(t for t in words.ids if t not in known and folded(t) in like))
        del words
        if not known:
            return
        # Toxic texts first, then others, whole, up to CHAINS.
        order, toxic = np.argsort(y == 0, kind="stable"), int((y > 0).sum())
        half = min(toxic, CHAINS // 2)
        picked = np.sort(np.concatenate([order[:half], order[toxic:][: CHAINS - half]]))
        x, lengths = self._of([ids[i] for i in picked], odds)
        tags = ((x[:, 0] > 0) & (np.repeat(y[picked], lengths) > 0)).astype(int)
        self.crf = train(x, tags, lengths, iterations=60)
        z = []
        for a in range(0, len(ids), 500):
            x, lengths = self._of(ids[a : a + 500], odds)
            z.append(_summary(self.crf.marginals(x, lengths), lengths))
        self.final = logistic(np.vstack(z), y)

    @staticmethod
    def _of(ids: list[np.ndarray], odds: np.ndarray):
        flat, lengths = np.concatenate(ids), np.array([len(t) for t in ids])
        return _features(odds[flat], (flat == 0).astype(np.float64), lengths), lengths

    def tag(self, texts: list[str | None]):
        x, lengths = _chains(texts, self.odds)
        p = self.crf.marginals(x, lengths)
        z = _summary(p, lengths)
        return p, lengths, sigmoid(self.final[0] + z @ self.final[1:])

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.crf is None or not texts:
            return np.full(len(texts), self.base)
        return self.tag(texts)[2]

    def rate(self, texts: list[str | None], least: float = 0.5) -> tuple[np.ndarray, list[list[dict]]]:
        """Scores, and offending code-point ranges (end exclusive), runs of toxic
        tokens merged."""
        if self.crf is None or not texts:
            return np.full(len(texts), self.base), [[] for _ in texts]
        p, lengths, scores = self.tag(texts)
        out, at = [], 0
        for text, n in zip(texts, lengths.tolist(), strict=True):
            hit = np.flatnonzero(p[at : at + n] >= least).tolist()
            at += n
            found: list[dict] = []
            if hit:
                # lower() may change a text's length: offsets are taken where it doesn't
                low = (text or "").lower()
                src = low if len(low) == len(text or "") else "".join(c.lower() if len(c.lower()) == 1 else c for c in text or "")
                places = [m.span() for m in TOKEN.finditer(src)]
                last = -2
                for i in hit:
                    if i >= len(places):
                        continue
                    if i == last + 1:
                        found[-1]["end"] = places[i][1]
                    else:
                        found.append({"start": places[i][0], "end": places[i][1]})
                    last = i
            out.append(found)
        return scores, out


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> ToxicityModel:
    """Fitted in a task of its own: the sample's texts and the chains' features, both
    bounded by the sample, never come to the driver, only the model does."""
    texts = sample(docs, labels, "toxic", 5, 0, rows)
    if texts is None:
        return ToxicityModel([])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [r for b in batches for r in zip(*(b.column(x).to_pylist() for x in ("doc_id", "text", "y")), strict=True)]
        if got:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(ToxicityModel(in_order(got)))], pa.binary())], ["model"])

    model = texts.repartition(1).mapInArrow(run, "model binary").collect()  # one row
    return pickle.loads(model[0]["model"]) if model else ToxicityModel([])


def score(docs: DataFrame, model: ToxicityModel, spans: bool = False) -> DataFrame:
    """``docs`` with toxicity (0 to 1) and, if asked for, toxic_spans
    (array<struct<start, end>>) of every whole text, all columns kept.

    A null text is empty; an empty text has a score and no spans; null ids and
    repeated rows are scored like any other; columns of those two names are
    replaced; an empty table gives no rows. Nothing is shuffled.
    """
    kept = docs.drop("toxicity", "toxic_spans")
    schema = "score double, spans array<struct<start:int,end:int>>"

    @F.pandas_udf(schema)
    def rate(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for p in parts:
            got = []
            for a, z in lots(p.tolist()):
                t = p.iloc[a:z].tolist()
                both = model.rate(t) if spans else (model.score(t), [None] * len(t))
                got.append(pd.DataFrame(dict(zip(("score", "spans"), both, strict=True))))
            yield pd.concat(got, ignore_index=True) if got else pd.DataFrame({"score": pd.Series(dtype=float), "spans": pd.Series(dtype=object)})

    rated = spare(kept, "rated")[0]
    out = kept.withColumn(rated, rate(F.col("text").cast("string"))).withColumn("toxicity", F.col(f"{rated}.score"))
    return (out.withColumn("toxic_spans", F.col(f"{rated}.spans")) if spans else out).drop(rated)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document, and its offending offsets as start:end in code
    points, comma-joined; held_out is false for a null doc_id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    offsets = F.array_join(F.transform("toxic_spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return score(docs, model, spans=True).select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"), offsets.alias("toxic_spans"),
    )
