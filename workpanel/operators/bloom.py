"""A Bloom filter as a table, to drop rows before a semi-join shuffles them.

Each key sets one bit of ``n_bits``; 64 bits make a word, and the filter is the table
``word, bits`` of the words that are not 0.  Its rows are at most ``n_bits / 64``, whatever the
number of keys, so it can be broadcast: ``MAX_BITS`` bits are two million words.  Rows look
up the word of their key and test its bit: built-in functions and one look-up join.

The filter never drops a row whose key is in the table; of the others it lets through
about ``keys / n_bits``, so the exact semi-join still has to follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The largest filter, and the bits a key gets where that is enough.
MAX_BITS, BITS_A_KEY = 1 << 27, 16


def bits_for(n_keys: int) -> int:
    """A power of two, 64 at least: ``BITS_A_KEY`` bits a key, or ``MAX_BITS``."""
    return min(MAX_BITS, max(64, 1 << (max(1, n_keys) * BITS_A_KEY - 1).bit_length()))


def _bit(key: str, n_bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_bits))


def bloom_words(keys: DataFrame, key: str, n_bits: int, word: str = "word", bits: str = "bits") -> DataFrame:
    """``word, bits``: the filter of the non-null ``key`` values of ``keys``."""
    places = keys.filter(F.col(key).isNotNull()).select(_bit(key, n_bits).alias("bit"))
    return (places.groupBy(F.shiftright("bit", 6).alias(word))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias(bits)))


def _unused(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name


def may_be_in(rows: DataFrame, keys: DataFrame, key: str, n_keys: int) -> DataFrame:
    """The rows whose ``key`` may be among ``keys`` (``n_keys`` of them, about): all that
    are, and a few others; none with a null key.  With so many keys that the
    largest filter would let most rows through, ``rows`` unchanged."""
    n_bits = bits_for(n_keys)
    if 2 * n_keys > n_bits:
        return rows
    bit, word, bits = (_unused(rows, c) for c in ("_bit", "_word", "_bits"))
    words = F.broadcast(bloom_words(keys, key, n_bits, word, bits))
    looked = rows.withColumn(bit, _bit(key, n_bits)).withColumn(word, F.shiftright(bit, 6)).join(words, word)
    is_set = F.expr(f"shiftright(`{bits}`, cast(`{bit}` % 64 as int)) & 1") == 1
    return looked.filter(F.col(key).isNotNull() & is_set).select(*rows.columns)
