"""Packing documents into token sequences: shortest-pack-first over the length histogram.

1. Every task encodes its documents and cuts each into pieces of at most
   ``max_tokens`` ids; the pieces are written once.
2. The histogram of piece lengths (at most ``max_tokens`` rows, whatever the
   corpus) goes to the driver.  Lengths are placed longest first, each into
   the packs with the most room; a *pattern* is a list of lengths and the
   number of packs that have it, and placing a length only changes patterns
   and their counts, never single documents.
3. Pieces of one length are ranked without gaps; the pattern table says which
   ranks go to which sequence, and at what offset.

Defined cases: a null or empty text is the end id alone; repeated rows and
repeated or null ``doc_id`` values are packed row by row; other columns are
ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import functools
import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workpanel.llm.common import numbered, staged

#: Entries of a worker's word cache; when it is full the worker starts a new one.
CACHE_WORDS = 800_000
#: Letters whose lower case and normal form are single and the same in every library.
LETTERS = "a-zß-öø-ÿ"

PIECES = "uid_in long, doc_id {id_type}, start long, length int, doc_tokens long, ids binary"


class WordIds(dict):
    """Words (no white space inside) to the bytes of their ids, little-endian and 32 bits each.

    The tokenizer drops white space and splits at it, so a text's ids are
    those of its words in order.  A word of plain letters is one pre-token
    and goes straight to the tokenizer's model; anything else is encoded whole.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def __missing__(self, word: str) -> bytes:
        if PLAIN(word):
            form = word if word.isascii() else self.to_bytes.pre_tokenize_str(word)[0][0]
            ids = [t.id for t in self.model.tokenize(form)]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = found = array("I", ids).tobytes()
        return found


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One cache for each worker process, kept from task to task."""
    return WordIds(path)


#: A word, or the marks around one, of a text that has only letters as above in words.
PLAIN = re.compile(rf"[{LETTERS}]+").fullmatch
SPLIT = re.compile(rf"[{LETTERS}]+|[^{LETTERS}\x09-\x0D\x20]+")


def text_words(text: str) -> list[str]:
    """Units to encode by themselves: words and the marks between them for
    texts in Latin-1 (lower-cased, as the tokenizer does), else what stands
    between blanks, as it is."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return re.findall(r"[^\x09-\x0D\x20]+", text)
    if "<|" in text or "'" in text or "\xaa" in text or "\xb5" in text or "\xba" in text:
        return re.findall(r"[^\x09-\x0D\x20]+", text)
    return SPLIT.findall(text.lower())


def encoder(path: str, max_tokens: int, end_id: int, id_col: str, text_col: str):
    end = array("I", [end_id]).tobytes()

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = word_ids(path).__getitem__
        for frame in batches:
            for at in range(0, len(frame), 500):
                part = frame.iloc[at:at + 500]
                rows = []
                for uid, doc, text in zip(part["_uid"], part[id_col], part[text_col]):
                    ids = b"".join(map(known, text_words(text) if isinstance(text, str) else ())) + end
                    n = len(ids) // 4
                    rows += [(uid, doc, s, min(max_tokens, n - s), n, ids[4 * s:4 * (s + max_tokens)])
                             for s in range(0, n, max_tokens)]
                out = pd.DataFrame(rows, columns=["uid_in", "doc_id", "start", "length", "doc_tokens", "ids"])
                out["doc_id"] = out["doc_id"].astype(frame[id_col].dtype)
                yield out

    return encode


def pack_lengths(histogram: dict[int, int], max_tokens: int) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns ``(count, lengths)``: how many packs hold exactly these lengths.

    Lengths go longest first, each into the packs with the most room that
    fit it.  Lengths that fit no pack open new ones, filled with that length.
    """
    done: list[tuple[int, tuple[int, ...]]] = []
    heap: list[tuple[int, int, int, tuple[int, ...]]] = []  # (-room, order, count, lengths)
    order = 0

    def keep(room: int, count: int, lengths: tuple[int, ...]) -> None:
        nonlocal order
        order += 1
        if count and room:
            heapq.heappush(heap, (-room, order, count, lengths))
        elif count:
            done.append((count, lengths))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and heap and -heap[0][0] >= length:
            room, _, count, lengths = heapq.heappop(heap)
            used = min(left, count)
            left -= used
            keep(-room - length, used, (*lengths, length))
            keep(-room, count - used, lengths)
        if left:
            fit = max_tokens // length
            keep(max_tokens - fit * length, left // fit, (length,) * fit)
            keep(max_tokens - left % fit * length, int(left % fit > 0), (length,) * (left % fit))
    return done + [(count, lengths) for _, _, count, lengths in heap]


def slot_table(patterns: list[tuple[int, tuple[int, ...]]]) -> pd.DataFrame:
    """``length, low, sequence, offset``: pieces of ``length`` with ranks from
    ``low`` on go to ``sequence`` and those after it, at ``offset``."""
    low: dict[int, int] = {}
    rows, sequence = [], 0
    for count, lengths in patterns:
        offset = 0
        for length in lengths:
            rows.append((length, low.get(length, 0), sequence, offset))
            low[length] = low.get(length, 0) + count
            offset += length
        sequence += count
    return pd.DataFrame(rows, columns=["length", "low", "sequence", "offset"], dtype="int64")


def placer(slots: pd.DataFrame):
    """Ranks to slots; the table is bounded by ``max_tokens`` squared, not by the corpus."""
    slots = slots.sort_values(["length", "low"])
    key = (slots["length"].to_numpy() << 44) + slots["low"].to_numpy()
    low, sequence, offset = (slots[c].to_numpy() for c in ("low", "sequence", "offset"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            rank = f["rank"].to_numpy("int64")
            at = np.searchsorted(key, (f["length"].to_numpy("int64") << 44) + rank, "right") - 1
            yield pd.DataFrame({"uid": f["uid"], "sequence_id": sequence[at] + rank - low[at], "offset": offset[at]})

    return place


def pack_documents(docs: DataFrame, tokenizer_path: str, max_tokens: int = 4096, end_id: int = 2,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with their place: ``doc_id, start, length, doc_tokens, ids,
    sequence_id, offset``.  ``ids`` are the piece's token ids as little-endian
    32-bit numbers, ready to be written into a sequence at ``offset``."""
    id_type = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.monotonically_increasing_id().alias("_uid"), id_col, text_col)
    pieces = staged(
        source.mapInPandas(encoder(tokenizer_path, max_tokens, end_id, id_col, text_col),
                           PIECES.format(id_type=id_type))
        .withColumn("uid", F.monotonically_increasing_id()).drop("uid_in"), "pack-pieces")
    # at most max_tokens rows
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = slot_table(pack_lengths(histogram, max_tokens))
    ranked = numbered(pieces.select("uid", "length"), ["length"], "uid", sum(histogram.values()))
    placed = ranked.mapInPandas(placer(slots), "uid long, sequence_id long, offset long")
    return pieces.join(placed, "uid").select("doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset")
