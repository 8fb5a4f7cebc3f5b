"""Token counts of whole texts: a map-side look-up of pre-token lengths in two tiers.

A text's token count is the sum of its pre-tokens' counts.  Tier one is a
table of the corpus' frequent pre-tokens with their lengths in tokens,
broadcast once (at most ``FREQUENT`` rows).  Tier two is a cache in each
Python worker for everything else; a pre-token found in neither goes to the
tokenizer's model once for each worker.  No pre-token is shuffled: to find
the frequent ones, every task counts all of its own texts and hands on at
most ``PER_TASK`` of its leaders.  The tiers decide speed, never results.

Defined cases: a null or empty text has 0 bytes and 0 tokens; repeated rows,
null ids and an empty table go through row by row; other columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the broadcast table, leaders handed on by a task, entries a task counts at once.
FREQUENT, PER_TASK, COUNTED = 32_768, 4_096, 400_000
#: Entries of a worker's cache beside the broadcast ones; then it starts anew.
CACHED = 700_000

# Fixed value: the tokenizer's own pattern ('s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+|
#  ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+), its classes written out for Latin-1.
LATIN = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d"
    "| ?[A-Za-zªµºÀ-ÖØ-öø-ÿ]+"
    "| ?[0-9²³¹¼-¾]+"
    "| ?[^\t-\r \x85\xa0A-Za-zªµºÀ-ÖØ-öø-ÿ0-9²³¹¼-¾]+"
    "|[\t-\r \x85\xa0]+(?![^\t-\r \x85\xa0])|[\t-\r \x85\xa0]+")


class Lengths(dict):
    """Pre-tokens of one tokenizer to their number of tokens; unknown ones are looked up."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))) or r"(?!)")
        self.frequent: dict[str, int] = {}

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHED + len(self.frequent):
            self.clear()
            self.update(self.frequent)
        self[piece] = n = len(self.model.tokenize(self.to_bytes.pre_tokenize_str(piece)[0][0]))
        return n

    def seed(self, frequent: dict[str, int]) -> Lengths:
        if self.frequent is not frequent and self.frequent != frequent:
            self.frequent = frequent
            self.update(frequent)
        return self

    def pieces(self, text: str) -> list[str] | None:
        """The text's pre-tokens; None when it has letters beyond Latin-1."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        return LATIN.findall(text)

    def count(self, text: str) -> int:
        if "<" in text and (n := len(self.special.findall(text))):
            return n + sum(self.count(part) for part in self.special.split(text) if part)
        own = self.pieces(text)
        if own is None:
            # letters of any script: the tokenizer itself splits line by line
            return sum(map(self.of_line, _lines(text)))
        return sum(map(self.__getitem__, own))

    def of_line(self, line: str) -> int:
        own = self.pieces(line)
        return sum(map(self.__getitem__, own)) if own is not None else len(
            self.tokenizer.encode(line, add_special_tokens=False))


#: A break that no pre-token of this kind crosses: a newline between two marks that are not white space.
BREAK = re.compile("(?<=[!-~])(?=\n[!-~])")


def _lines(text: str) -> list[str]:
    """Parts that can be counted apart; each after the first begins with its newline."""
    return BREAK.split(text)


@functools.lru_cache(maxsize=2)
def lengths(path: str) -> Lengths:
    """One table for each worker process, kept from task to task."""
    return Lengths(path)


def leaders(path: str, text_col: str) -> Callable:
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, seen = lengths(path), Counter()
        for frame in batches:
            for text in frame[text_col]:
                if isinstance(text, str):
                    seen.update(own.pieces(text) or ())
                    if len(seen) > COUNTED:  # rare ones go; they can return
                        seen = Counter(dict(seen.most_common(COUNTED // 4)))
        top = seen.most_common(PER_TASK)
        yield pd.DataFrame({"piece": [p for p, _ in top], "n": [n for _, n in top]}).astype({"n": "int64"})

    return find


def frequent_lengths(docs: DataFrame, path: str, text_col: str = "text") -> dict[str, int]:
    """At most ``FREQUENT`` pre-tokens of the corpus with their lengths in tokens."""
    top = (docs.select(text_col).mapInPandas(leaders(path, text_col), "piece string, n long")
           .groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(FREQUENT).collect())
    own = Lengths(path)
    return {r["piece"]: own[r["piece"]] for r in top}


def token_counts(docs: DataFrame, path: str, text_col: str = "text", out: str = "n_tokens",
                 frequent: dict[str, int] | None = None) -> DataFrame:
    """``docs`` with ``out``, the number of tokens of each whole text."""
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(frequent_lengths(docs, path, text_col) if frequent is None else frequent)

    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = lengths(path).seed(table.value)
        for texts in batches:
            yield pd.Series([own.count(t) if isinstance(t, str) else 0 for t in texts], dtype="int64")

    return docs.withColumn(out, F.pandas_udf(counted, "long")(F.col(text_col)))
