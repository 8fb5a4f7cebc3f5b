"""Language identification by a small convolutional network over bytes.

A text is cut into windows of ``WINDOW`` bytes, the last one filled up with an
empty byte.  Each byte has a learned vector; filters of several widths slide over a
window, the largest answer of each filter (0 at least) is kept, and a softmax layer
turns these into log-probabilities of the languages.  A text's log-probabilities are
the mean of its windows', weighted by their bytes, and its score is the
probability of the best language among the normalised ones.

The network is trained here, in numpy, on a bounded sample: at most ``PER_LANG``
labelled texts of each of the ``LANGS`` most frequent languages, chosen by a hash,
one window of each.  It is applied to every window of every text.

Defined cases: null texts and texts without a letter (Unicode class L) are ``und`` with
score 0; without a labelled row every text is; rows with a null language, and rows
that may not be learned from, are not learned from; repeated rows are learned once and
scored each time; texts of any length are read whole; of equally likely languages
the alphabetically first is taken; extra columns are kept, and the two new ones
replace columns of their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a window; windows that a worker scores at a time.
WINDOW, BATCH = 256, 128
#: Numbers that stand for a byte; filters by width.
DEPTH, FILTERS = 8, {2: 16, 3: 24, 4: 24}
#: Texts of a language, and languages, that the network is fitted to; steps of the fit and rows of a step.
PER_LANG, LANGS = 3000, 100
STEPS, STEP, RATE = 700, 64, 0.004
EMPTY = 256
UNKNOWN = "und"


class ByteNet:
    """Byte vectors, filters of several widths, maxima over positions, softmax."""

    def __init__(self, langs: list[str], seed: int = 7):
        r = np.random.default_rng(seed)
        self.langs = langs
        n = sum(FILTERS.values())
        self.p = {"bytes": r.normal(0, 0.5, (EMPTY + 1, DEPTH)), "out": r.normal(0, 0.1, (n, len(langs))), "bias": np.zeros(len(langs))}
        for width, k in FILTERS.items():
            self.p[f"filter{width}"] = r.normal(0, (width * DEPTH) ** -0.5, (width * DEPTH, k))
            self.p[f"shift{width}"] = np.zeros(k)
        self.p = {k: v.astype("f4") for k, v in self.p.items()}
        self.p["bytes"][EMPTY] = 0

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's largest answer in each window, and where it stands."""
        x = self.p["bytes"][windows]
        best, where = [], []
        for width in FILTERS:
            n = windows.shape[1] - width + 1
            spans = np.concatenate([x[:, j:j + n] for j in range(width)], axis=2)
            answer = spans.reshape(-1, width * DEPTH) @ self.p[f"filter{width}"]
            answer = answer.reshape(len(windows), n, -1)
            at = answer.argmax(axis=1)
            best.append(np.take_along_axis(answer, at[:, None], axis=1)[:, 0] + self.p[f"shift{width}"])
            where.append(at)
        return np.maximum(np.concatenate(best, 1), 0), np.concatenate(where, 1)

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        return log_softmax(self.pooled(windows)[0] @ self.p["out"] + self.p["bias"])

    def gradients(self, windows: np.ndarray, truth: np.ndarray) -> dict[str, np.ndarray]:
        pooled, where = self.pooled(windows)
        error = np.exp(log_softmax(pooled @ self.p["out"] + self.p["bias"]))
        error[np.arange(len(truth)), truth] -= 1
        error /= len(truth)
        g = {"out": pooled.T @ error, "bias": error.sum(0), "bytes": np.zeros_like(self.p["bytes"])}
        back = (error @ self.p["out"].T) * (pooled > 0)
        first = 0
        for width, k in FILTERS.items():
            own, at = back[:, first:first + k], where[:, first:first + k]
            # only the span with the largest answer has a part in it
            ids = windows[np.arange(len(windows))[:, None, None], at[:, :, None] + np.arange(width)]
            spans = self.p["bytes"][ids].reshape(len(windows), k, width * DEPTH)
            g[f"filter{width}"] = np.einsum("nk,nkd->dk", own, spans)
            g[f"shift{width}"] = own.sum(0)
            part = (own[:, :, None] * self.p[f"filter{width}"].T).reshape(-1, DEPTH)
            for d in range(DEPTH):
                g["bytes"][:, d] += np.bincount(ids.ravel(), part[:, d], EMPTY + 1)
            first += k
        g["bytes"][EMPTY] = 0
        return g

    def fit(self, texts: list[bytes], truth: np.ndarray, seed: int = 7) -> None:
        """Adam over shuffled rows; half of the windows are cut short, so that short texts are learned too."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(v) for k, v in self.p.items()}
        k, rounds = 0, math.ceil(STEPS * STEP / len(texts))
        for turn in range(rounds):
            order = r.permutation(len(texts))
            rate = RATE * (1 - turn / rounds)
            for at in range(0, len(order), STEP):
                rows = order[at:at + STEP]
                ends = np.where(r.random(len(rows)) < 0.5, WINDOW, r.integers(8, WINDOW, len(rows)))
                g = self.gradients(window_table([texts[i][:e] for i, e in zip(rows, ends)]), truth[rows])
                k += 1
                for name, value in g.items():
                    m[name] = 0.9 * m[name] + 0.1 * value
                    v[name] = 0.99 * v[name] + 0.01 * value * value
                    self.p[name] -= (rate * m[name] / (1 - 0.9 ** k) / (np.sqrt(v[name] / (1 - 0.99 ** k)) + 1e-8)).astype("f4")

    def predicted(self, texts: Iterable[str | None]) -> tuple[list[str], list[float]]:
        """The language and score of each text, from all its windows.

        Scores have six digits: how windows fall into batches moves the last bits of a float.
        """
        texts = list(texts)
        total, weight = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        tables, owners, held = [], [], 0

        def flush() -> None:
            nonlocal held
            if not held:
                return
            windows, owner = np.concatenate(tables), np.concatenate(owners)
            for at in range(0, len(windows), BATCH):
                part, own = windows[at:at + BATCH], owner[at:at + BATCH]
                n = (part != EMPTY).sum(1)
                np.add.at(total, own, self.log_probabilities(part) * n[:, None])
                np.add.at(weight, own, n)
            tables.clear()
            owners.clear()
            held = 0

        for i, text in enumerate(texts):
            raw = text.encode("utf-8", "replace") if text else b""
            for at in range(0, len(raw), WINDOW * BATCH):
                part = raw[at:at + WINDOW * BATCH]
                table = window_table([part[k:k + WINDOW] for k in range(0, len(part), WINDOW)])
                tables.append(table)
                owners.append(np.full(len(table), i))
                held += len(table)
                if held >= BATCH:
                    flush()
        flush()
        share = np.exp(log_softmax(total / np.maximum(weight, 1)[:, None]))
        best = share.argmax(1)
        return [self.langs[b] for b in best], np.round(share[np.arange(len(texts)), best], 6).tolist()


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def window_table(parts: list[bytes]) -> np.ndarray:
    out = np.full((len(parts), WINDOW), EMPTY, "i4")
    for row, part in zip(out, parts):
        row[:len(part)] = np.frombuffer(part, "u1")
    return out


def labelled_sample(docs: DataFrame, learn: Column, lang_col: str, text_col: str) -> DataFrame:
    """``lang, part``: for each frequent language at most about ``PER_LANG`` texts, those with the
    smallest hashes, and of each one window of characters from a place that the hash chooses."""
    rows = (docs.filter(learn).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
            .filter("lang is not null and text rlike '\\\\p{L}'"))
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGS).collect()
    if not sizes:
        return rows.select("lang", F.col("text").alias("part")).limit(0)
    space = 1 << 30
    share = F.coalesce(*[F.when(F.col("lang") == r["lang"], int(space * min(1.0, PER_LANG / r["count"]))) for r in sizes], F.lit(0))
    start = F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1).cast("int") + 1
    # copies of a text have one hash: they count once, and a bound on the rows holds in any case
    return (rows.filter(F.pmod(F.xxhash64("text"), F.lit(space)) < share)
            .select("lang", F.col("text").substr(start, F.lit(WINDOW)).alias("part")).distinct()
            .orderBy(F.xxhash64("part"), "lang", "part").limit(PER_LANG * len(sizes)))


def languages(docs: DataFrame, learn: Column, lang_col: str = "lang", text_col: str = "text", out: str = "lang_pred",
              score: str = "score") -> DataFrame:
    """``docs`` with ``out`` and ``score``; ``learn``: the rows whose language may be learned."""
    rows = sorted((r["lang"], r["part"].encode("utf-8", "replace")) for r in labelled_sample(docs, learn, lang_col, text_col).collect())
    if not rows:
        return docs.withColumns({out: F.lit(UNKNOWN), score: F.lit(0.0)})
    langs = sorted({lang for lang, _ in rows})
    net = ByteNet(langs)
    if len(langs) > 1:
        net.fit([part for _, part in rows], np.array([langs.index(lang) for lang, _ in rows]))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        lang, own = shared.value.predicted(texts)
        return pd.DataFrame({"lang": lang, "score": own})

    known = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    guess = predict(F.col(text_col))
    return docs.withColumns({out: F.when(known, guess["lang"]).otherwise(F.lit(UNKNOWN)),
                             score: F.when(known, guess["score"]).otherwise(F.lit(0.0))})
