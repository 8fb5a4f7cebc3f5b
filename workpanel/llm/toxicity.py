"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

1. *Voters* look at a text's words and patterns; each votes "toxic" or abstains.
   Two of them have a lexicon mined from a bounded number of labelled rows
   (``LABELLED``): words that few clean documents have.
2. Their votes over all documents are counted by pattern (at most 2^voters
   rows).  The *label model* is a two-class mixture fitted to these counts by
   expectation maximisation: each voter's rates in either class are its
   accuracy.  Pairs that vote together more often than the fitted model says
   are correlated; such voters are joined into cliques, whose votes are
   modelled together, and the model is fitted again.
3. Its posteriors label a bounded sample of training documents (``SAMPLE``),
   on which a *linear classifier* over hashed words and votes is trained.  It
   also learns words that no lexicon has.
4. The classifier scores every whole text.

Only rows with ``learn`` true take part in 2 and 3; given labels, known rows
tell the label model its share of toxic documents.

Defined cases: null and empty texts have no words and get the classifier's
base score; repeated rows get equal scores; other columns stay; an empty table,
or one without a single vote, scores 0 everywhere.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documents that train the classifier, at most; words are hashed to this many weights.
SAMPLE, WEIGHTS = 12_000, 1 << 18
#: Labelled rows that words are mined from, at most; toxic rows a word must be in; words, at most.
LABELLED, SUPPORT, MINED = 20_000, 6, 5_000
#: The share of toxic rows among a word's that puts it into either mined lexicon.
SHARES = {"mined": 0.75, "mined_sure": 0.9}
#: Voters that vote together this many times as often as the model says form cliques of at most CLIQUE.
LIFT, CLIQUE = 1.5, 4

# Lexicons, as text.
LEXICONS = {
    "mind": "idiot idiots idiotic moron morons moronic imbecile imbeciles cretin dimwit halfwit fool fools dumb dumbass brainless",
    "stupid": "stupid stupidity retarded senseless clueless",
    "worth": "worthless useless pathetic miserable hopeless",
    "loser": "loser losers failure nobody weakling coward",
    "filth": "scum scumbag vermin filth filthy trash garbage rubbish dirtbag",
    "disgust": "disgusting disgust revolting repulsive",
    "ugly": "gross vile nasty ugly",
    "mock": "clown clowns buffoon freak weirdo creep jackass crybaby",
    "swear": "damn crap shit bullshit fuck fucking fucked bastard bastards bitch bitches asshole arse dick prick",
    "romance": "imbécile crétin connard connards salaud ordure minable idiota idiotas estúpido estúpida imbécil escoria patético asqueroso payaso basura",
    "german": "dummkopf trottel vollidiot abschaum versager arschloch widerlich erbärmlich dreckig schwachkopf",
}
PATTERNS = {
    "you_are": r"\byou(?:'re| are| r)? (?:just |such |all |nothing but )?(?:a |an )?(?:complete |total |real )?(?:idiot|moron|loser|clown|fool|joke|disgrace|waste|pathetic|stupid|worthless|disgusting|scum|trash)",
    "dismiss": r"\b(?:shut up|go to hell|drop dead|kill yourself|get lost|go die|screw you|piss off|hate you|nobody likes you)\b",
    "masked": r"\b(?:id[1!]ot|m[0o]r[0o]n(?<!moron)|st[u*]p[1!*]d|f[*@#u]ck(?<!fuck)|sh[1!*]t|b[1!*]tch|l[0]ser|tr[@4]sh|[@4]ssh[o0]le)\b",
}
#: What a text must have for a pattern to match: one of the words or of the characters.
NEEDED = {"you_are": ({"you"}, ""), "dismiss": ({"shut", "hell", "drop", "yourself", "lost", "die", "you", "piss"}, ""),
          "masked": (set(), "10!*@#4")}
WORDS = re.compile(r"[^\W\d_]+")
NAMES = (*LEXICONS, *PATTERNS, *SHARES, "several")


def words_of(text) -> set[str]:
    return set(WORDS.findall(text.lower())) if isinstance(text, str) else set()


class Voters:
    """All voters; ``mined``: words to their share of toxic rows."""

    def __init__(self, mined: dict[str, float]):
        self.bits = {w: 1 << k for k, words in enumerate(LEXICONS.values()) for w in words.split()}
        for w, share in mined.items():
            for name, least in SHARES.items():
                if share >= least:
                    self.bits[w] = self.bits.get(w, 0) | 1 << NAMES.index(name)
        self.patterns = [(1 << NAMES.index(name), re.compile(p), *NEEDED[name]) for name, p in PATTERNS.items()]

    def votes(self, text: str, own: set[str]) -> int:
        """The voters that call the text toxic, as bits in the order of ``NAMES``."""
        hits, found = own & self.bits.keys(), 0
        for w in hits:
            found |= self.bits[w]
        low = None
        for bit, p, needed, marks in self.patterns:
            if not own.isdisjoint(needed) or any(c in text for c in marks):
                low = text.lower() if low is None else low
                if p.search(low):
                    found |= bit
        return found | (1 << (len(NAMES) - 1) if len(hits) >= 2 else 0)

    def features(self, text) -> list[int]:
        """Hashed words, and a place for each vote behind them."""
        own = words_of(text)
        found = self.votes(text, own) if own else 0
        return [*{zlib.crc32(w.encode("utf-8", "replace")) & (WEIGHTS - 1) for w in own},
                *(WEIGHTS + k for k in range(len(NAMES)) if found >> k & 1)]


class LabelModel:
    """A mixture of a toxic and a clean class over cliques of voters."""

    def __init__(self, counts: dict[int, int], prior: float = 0.1):
        self.patterns = np.array(sorted(counts), "int64")
        self.n = np.array([counts[p] for p in self.patterns.tolist()], float)
        self.votes = (self.patterns[:, None] >> np.arange(len(NAMES))) & 1
        self.cliques = [(k,) for k in range(len(NAMES))]
        self.prior = prior
        self.fit()
        self.cliques = self.correlated()
        self.fit()

    def states(self, votes: np.ndarray) -> list[np.ndarray]:
        return [sum(votes[:, v] << i for i, v in enumerate(c)) for c in self.cliques]

    def fit(self, rounds: int = 60) -> None:
        states = self.states(self.votes)
        any_vote = self.votes.any(axis=1)
        toxic = np.where(any_vote, 0.9, 1e-3)
        prior = self.prior
        for _ in range(rounds):
            self.tables = []
            for s, c in zip(states, self.cliques):
                each = [np.bincount(s, self.n * w, 1 << len(c)) for w in (toxic, 1 - toxic)]
                # a vote counts for the toxic class until the counts say otherwise
                base = np.full(1 << len(c), 0.05)
                each[0] += base * np.where(np.arange(1 << len(c)) > 0, 4, 1)
                each[1] += base + np.where(np.arange(1 << len(c)) > 0, 0, 20)
                self.tables.append([e / e.sum() for e in each])
            toxic = self.posterior(self.votes, prior)
            prior = float(np.clip((self.n * toxic).sum() / max(self.n.sum(), 1), 1e-4, 0.5))
        self.prior = prior

    def posterior(self, votes: np.ndarray, prior: float | None = None) -> np.ndarray:
        prior = self.prior if prior is None else prior
        z = np.full(len(votes), math.log(prior / (1 - prior)))
        for s, (t, c) in zip(self.states(votes), self.tables):
            z += np.log(t[s] / c[s])
        z[~votes.any(axis=1)] = np.minimum(z[~votes.any(axis=1)], math.log(0.01 / 0.99))  # no vote is no evidence for toxicity
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def correlated(self) -> list[tuple[int, ...]]:
        """Voters joined where a pair's joint votes exceed what the classes explain."""
        toxic = self.posterior(self.votes)
        total, excess = self.n.sum(), []
        for a, b in combinations(range(len(NAMES)), 2):
            seen = (self.n * self.votes[:, a] * self.votes[:, b]).sum()
            expected = sum((self.n * w).sum() * self.tables[a][k][1] * self.tables[b][k][1] for k, w in enumerate((toxic, 1 - toxic)))
            if seen >= 10 and seen > LIFT * expected:
                excess.append((seen * math.log(seen / max(expected, 1e-9)) / total, a, b))
        group = {k: {k} for k in range(len(NAMES))}
        for _, a, b in sorted(excess, reverse=True):
            if group[a] is not group[b] and len(group[a] | group[b]) <= CLIQUE:
                merged = group[a] | group[b]
                for k in merged:
                    group[k] = merged
        return sorted({tuple(sorted(g)) for g in group.values()})

    def accuracies(self) -> dict[str, float]:
        """For each voter, how likely a document it votes for is toxic."""
        toxic = self.posterior(self.votes)
        return {name: float((self.n * toxic * self.votes[:, k]).sum() / max((self.n * self.votes[:, k]).sum(), 1e-9))
                for k, name in enumerate(NAMES)}


def mined_words(rows: DataFrame, known: DataFrame) -> dict[str, float]:
    """Words of toxic rows that few clean rows have, with their share of toxic ones.
    ``rows``: ``_id, _text``; ``known``: ``_id, toxic``, at most ``LABELLED`` of them."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, toxic = Counter(), Counter()
        for f in batches:
            for text, label in zip(f["_text"], f["toxic"]):
                own = words_of(text)
                n.update(own)
                if label == 1:
                    toxic.update(own)
        every = list(n)
        for at in range(0, len(every), 10_000):
            part = every[at:at + 10_000]
            yield pd.DataFrame({"word": part, "n": [n[w] for w in part], "t": [toxic[w] for w in part]})

    found = (rows.join(F.broadcast(known), "_id").mapInPandas(count, "word string, n long, t long")
             .groupBy("word").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).filter(F.col("t") >= SUPPORT)
             .withColumn("share", (F.col("t") + 0.2) / (F.col("n") + 1)).filter(F.col("share") >= min(SHARES.values()))
             .orderBy(F.desc("t"), "word").limit(MINED))
    return {r["word"]: r["share"] for r in found.collect()}


def train(rows: list[np.ndarray], soft: np.ndarray, rounds: int = 120, l2: float = 2e-3) -> np.ndarray:
    """Weights and, last, the base of a logistic regression on posteriors (Adam on the whole sample)."""
    size = WEIGHTS + len(NAMES)
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    at = np.concatenate(rows) if rows else np.zeros(0, "int32")
    used, at = np.unique(at, return_inverse=True)
    scale = np.where(used >= WEIGHTS, 2.0, 0.5)  # votes are few and strong, words many and weak
    w, base = np.zeros(len(used)), 0.0
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for k in range(1, rounds + 1):
        z = np.bincount(doc, (w * scale)[at], len(rows)) + base
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - soft) / len(rows)
        g, gb = np.bincount(at, error[doc], len(used)) * scale + l2 / max(len(rows), 1) * w * 50, error.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.15 / (1 - 0.9 ** k) * math.sqrt(1 - 0.999 ** k)
        w -= rate * m / (np.sqrt(v) + 1e-8 * math.sqrt(len(rows)))
        base -= rate * mb / (math.sqrt(vb) + 1e-8)
    out = np.zeros(size + 1, "float32")
    out[used] = w * scale
    out[-1] = base
    return out


def chosen(rows: DataFrame, hashed: Column, total: int, most: int) -> DataFrame:
    """At most ``most`` of ``total`` rows, those with the smallest hashes: the same at every run."""
    if total <= most:
        return rows
    return rows.filter(F.pmod(hashed, F.lit(1 << 30)) < int((1 << 30) * 0.97 * most / total)).limit(most)


def toxicity_scores(docs: DataFrame, learn: Column, known: DataFrame | None = None, id_col: str = "doc_id",
                    text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with ``out``, 0 to 1.  ``learn``: the rows to learn from.
    ``known``: ``id_col, toxic`` of labelled rows, for the share of toxic ones."""
    spark = docs.sparkSession
    rows = docs.filter(learn).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    prior, mined = 0.1, {}
    if known is not None:
        marked = known.select(F.col(id_col).alias("_id"), "toxic").filter("_id is not null and toxic is not null").distinct()
        total, share = marked.join(rows.select("_id").distinct(), "_id", "left_semi").agg(F.count("*"), F.avg("toxic")).first()
        if total:
            prior = min(0.5, max(0.001, share))
            mined = mined_words(rows, chosen(marked, F.xxhash64("_id"), total, LABELLED))
    voters = spark.sparkContext.broadcast(Voters(mined))

    def vote(texts: pd.Series) -> pd.Series:
        v = voters.value
        return pd.Series([v.votes(t, words_of(t)) if isinstance(t, str) else 0 for t in texts], dtype="int64")

    counts = {r["v"]: r["count"] for r in rows.select(F.pandas_udf(vote, "long")("_text").alias("v")).groupBy("v").count().collect()}
    if not any(counts):
        return docs.withColumn(out, F.lit(0.0))
    model = LabelModel(counts, prior)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            yield pd.DataFrame({"x": [np.sort(np.array(voters.value.features(t), "int32")).tobytes() for t in f["_text"]]})

    total = sum(counts.values())
    part = chosen(rows, F.xxhash64("_id", "_text"), total, SAMPLE)
    sample = sorted(bytes(r["x"]) for r in part.mapInPandas(encode, "x binary").collect())
    sample = [np.frombuffer(x, "int32") for x in sample]
    seen = np.array([np.isin(np.arange(WEIGHTS, WEIGHTS + len(NAMES)), x) for x in sample], "int64").reshape(-1, len(NAMES))
    weights = spark.sparkContext.broadcast(train(sample, model.posterior(seen)))

    def score(texts: pd.Series) -> pd.Series:
        w = weights.value
        z = np.array([w[-1] + w[voters.value.features(t)].sum() if isinstance(t, str) else w[-1] for t in texts], float)
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return docs.withColumn(out, F.pandas_udf(score, "double")(F.col(text_col)))
