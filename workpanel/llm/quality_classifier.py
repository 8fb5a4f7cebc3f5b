"""A quality classifier from positive and unlabelled texts.

Trusted positives and unlabelled web text are all it learns from; negative
labels are never read.  The class prior, the share of good texts among the
unlabelled, is estimated from the two samples: over the thresholds of a first
classifier of labelled against unlabelled texts, the smallest ratio of
unlabelled to positive texts above the threshold (an upper bound of the prior
that is tight where positives are pure).  Then the non-negative unbiased risk

    prior * R(positives, +) + max(0, R(unlabelled, -) - prior * R(positives, -))

is minimised: when the second term turns negative the model has begun to fit
the unlabelled texts as negatives, and that step is reversed instead.  The model is
additive: every shape statistic of a text is cut at the sample's quantiles.

Defined cases: null and empty texts have statistics of zero and are scored like
any; repeated rows get equal scores; other columns stay; without positives or
unlabelled texts every score is 0.5; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that fit the classifier, at most: positives, unlabelled.
POSITIVES, UNLABELLED = 8_000, 16_000
BINS = 12

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>~^={}\\_"]] = True
UPPER, LOWER, DIGIT = (np.isin(np.arange(256), [ord(c) for c in cs]) for cs in
                       ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"))
HIGH = np.arange(256) >= 128
MARKUP = re.compile(r"[!?]{2,}")
NAMES = ("log_words", "word_length", "upper", "digits", "symbols", "bars", "bangs", "stops", "commas", "high",
         "distinct", "top_word", "distinct_pairs", "line_length", "repeated_lines", "ended_lines", "short_lines", "longest_word")


def statistics(text) -> list[float]:
    """Shape statistics of a whole text, in the order of ``NAMES``."""
    if not isinstance(text, str) or not text:
        return [0.0] * len(NAMES)
    raw = text.encode("utf-8", "replace")
    hist = np.bincount(np.frombuffer(raw, "u1"), minlength=256)
    n = len(raw)
    words = text.split()
    k = max(len(words), 1)
    seen = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in text.split("\n") if x.strip()]
    m = max(len(lines), 1)
    letters = max(int(hist[UPPER].sum() + hist[LOWER].sum() + hist[HIGH].sum()), 1)
    return [
        np.log1p(len(words)), n / k, hist[UPPER].sum() / letters, hist[DIGIT].sum() / n, hist[SYMBOLS].sum() / n,
        hist[ord("|")] / k, len(MARKUP.findall(text)) / k, hist[ord(".")] / k, hist[ord(",")] / k, hist[HIGH].sum() / n,
        len(seen) / k ** 0.8, max(seen.values(), default=0) / k, pairs / max(k - 1, 1), np.log1p(n / m),
        1 - len(set(lines)) / m if lines else 0.0, sum(x.rstrip()[-1:] in ".!?:;\"'" for x in lines) / m,
        sum(len(x) < 30 for x in lines) / m, np.log1p(max(map(len, seen), default=0)),
    ]


class Additive:
    """One weight for each statistic's bin: cuts at the sample's quantiles."""

    def __init__(self, x: np.ndarray):
        q = np.linspace(0, 1, BINS + 1)[1:-1]
        self.cuts = [np.unique(np.quantile(x[:, j], q)) for j in range(x.shape[1])]
        sizes = [len(c) + 1 for c in self.cuts]
        self.first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        self.weights = np.zeros(sum(sizes) + 1)

    def places(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "left") + f for j, (c, f) in enumerate(zip(self.cuts, self.first))], 1)

    def margin(self, places: np.ndarray) -> np.ndarray:
        return self.weights[places].sum(1) + self.weights[-1]

    def gradient(self, places: np.ndarray, error: np.ndarray) -> np.ndarray:
        g = np.bincount(places.ravel(), np.repeat(error, places.shape[1]), len(self.weights))
        g[-1] = error.sum()
        return g

    def descend(self, step, rounds: int, rate: float = 0.05, l2: float = 1e-3) -> None:
        m = v = np.zeros_like(self.weights)
        for k in range(1, rounds + 1):
            g = step() + l2 * np.append(self.weights[:-1], 0)
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            self.weights = self.weights - rate * m / (1 - 0.9 ** k) / (np.sqrt(v / (1 - 0.999 ** k)) + 1e-6)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """The share of positives among the unlabelled, from scores of texts the scorer
    has not been fitted to: the smallest upper bound over all thresholds."""
    cuts = np.unique(np.quantile(positive, np.linspace(0, 0.9, 91)))
    above = lambda s: 1 - np.searchsorted(np.sort(s), cuts, "left") / len(s)
    slack = np.sqrt(np.log(4 / delta) / 2 / len(positive)) + np.sqrt(np.log(4 / delta) / 2 / len(unlabelled))
    p, u = above(positive), above(unlabelled)
    best = int(np.argmin((u + slack) / np.maximum(p, 1e-9)))
    return float(np.clip(u[best] / max(p[best], 1e-9), 0.05, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, rounds: int = 400) -> tuple[Additive, float]:
    """The classifier of least non-negative risk, and the prior it used."""
    every = np.concatenate([positive, unlabelled])
    first = Additive(every)
    half = lambda x: (x[0::2], x[1::2])
    (p, p_out), (u, u_out) = half(first.places(positive)), half(first.places(unlabelled))
    first.descend(lambda: first.gradient(p, (sigmoid(first.margin(p)) - 1) / len(p))
                  + first.gradient(u, sigmoid(first.margin(u)) / len(u)), 150)
    prior = class_prior(first.margin(p_out), first.margin(u_out)) if min(len(p_out), len(u_out)) else 0.5

    model = Additive(every)
    p, u = model.places(positive), model.places(unlabelled)

    def step() -> np.ndarray:
        zp, zu = model.margin(p), model.margin(u)
        loss_minus = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        negative = (model.gradient(u, sigmoid(zu) / len(u)) - prior * model.gradient(p, sigmoid(zp) / len(p)))
        if loss_minus < 0:
            return -negative
        return prior * model.gradient(p, (sigmoid(zp) - 1) / len(p)) + negative

    model.descend(step, rounds)
    return model, prior


def sampled(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` different texts of ``rows`` (``_text``), those with the smallest hashes: the same
    at every run, and however many rows an id or a text has."""
    share = 0.9 * most / max(1, rows.count())  # what is chosen varies a little around its mean
    part = F.pmod(F.xxhash64("_text", F.lit(5)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, share))
    return rows.select("_text").filter(part).distinct().limit(most)


def quality_scores(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "quality", out: str = "score") -> DataFrame:
    """``docs`` with ``out``, 0 to 1.  ``learn``: the rows that may be learned
    from; of ``labels`` only positive ones are used."""
    spark = docs.sparkSession
    own = docs.filter(learn).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter("_id is not null")
    trusted = labels.filter(F.col(label_col) == 1).select(F.col(id_col).alias("_id")).distinct()
    texts = (sampled(own.join(trusted, "_id", "left_semi"), POSITIVES).withColumn("_positive", F.lit(True))
             .unionAll(sampled(own, UNLABELLED).withColumn("_positive", F.lit(False))))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            yield pd.DataFrame({"positive": f["_positive"], "x": [statistics(t) for t in f["_text"]]})

    rows = texts.select("_positive", "_text").mapInPandas(measure, "positive boolean, x array<double>").toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(-1, len(NAMES))
    mark = rows["positive"].to_numpy(bool)
    if not mark.any() or mark.all():
        return docs.withColumn(out, F.lit(0.5))
    order = np.lexsort(x.T[::-1])  # the order rows came in must not matter
    x, mark = x[order], mark[order]
    model, _ = fit(x[mark], x[~mark])
    shared = spark.sparkContext.broadcast(model)

    def score(batch: pd.Series) -> pd.Series:
        own = np.array([statistics(t) for t in batch], float).reshape(-1, len(NAMES))
        m = shared.value
        return pd.Series(sigmoid(m.margin(m.places(own))))

    return docs.withColumn(out, F.pandas_udf(score, "double")(F.col(text_col)))
