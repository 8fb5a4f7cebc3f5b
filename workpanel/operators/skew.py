"""Joins of many rows to a one-row-per-key table that stay even when one key
holds a large share of the rows.

AQE splits a skewed sort-merge join only when both sides arrive through
their own shuffle.  A per-person table produced by an aggregate is already
partitioned by person, so it has none, and AQE cannot split the join; all
of a hot person's rows would meet in one task.  Here the hot keys are named
explicitly instead: a key with ``n`` rows, ``n > threshold``, is hot; its
rows are spread over ``ceil(n / threshold)`` buckets by a hash of a row
column (so a bucket holds about ``threshold`` rows, however large the key),
and its table row is repeated once per bucket.  Other keys keep bucket 0,
so for them the join is the plain equi-join.

Size bounds: every hot key has more than ``threshold`` rows, so the hot list
has at most ``total rows / threshold`` entries (10^5 for 10^12 rows at the
default), and the repeated table rows number at most ``2 * total rows /
threshold``.  The joins to the hot list carry no hint: Spark broadcasts it only
when its size (known once the list is written, as the jobs do) is under the
session's threshold, so a low ``threshold`` cannot overload anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Without a sketch: a key with more rows than this is hot; its rows are spread
# so that each bucket holds about this many.
HOT_ROWS = 10_000_000

# With a sketch the data decide: hot is a key with more than 1 / HOT_SHARE of all
# rows, so there are fewer than HOT_SHARE of them at every size; keys under
# HOT_LEAST rows are no burden to any task.
AUTO = "auto"
HOT_SHARE, HOT_LEAST = 1000, 100_000
# Keys that the sketch keeps.  It counts a key too high by at most 3.5 / SKETCH_KEYS
# of all rows, which is well below 1 / HOT_SHARE: no hot key is missed.
SKETCH_KEYS = 16_384

BUCKETS = "_buckets"
SALT = "_salt"


def sketch(key: str, share: int = HOT_SHARE) -> list[Column]:
    """Aggregates ``n_rows, top`` for one pass over a table: its rows, and its most
    frequent keys by a mergeable frequent-items sketch of fixed size."""
    return [F.count(F.lit(1)).alias("n_rows"), F.expr(f"approx_top_k(`{key}`, {2 * share}, {SKETCH_KEYS})").alias("top")]


def hot_by_sketch(df: DataFrame, key: str, n_rows: int, top: list, share: int = HOT_SHARE,
                  least: int = HOT_LEAST) -> DataFrame | None:
    """``key, _buckets`` of the keys with more than ``max(least, n_rows / share)`` rows
    of ``df``, or ``None`` if there is none.  Only keys that the sketch
    names are counted (at most about ``share``), and exactly."""
    limit = max(least, n_rows // share)
    named = [item for item, count in top if item is not None and count > limit]
    if not named:
        return None
    counts = df.filter(F.col(key).isin(named)).groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    return hot_keys(counts, key, threshold=limit)


def hot_keys(counts: DataFrame, key: str, n_rows: str = "n_rows",
             threshold: int = HOT_ROWS) -> DataFrame:
    """``key, _buckets`` for keys whose row count ``n_rows`` exceeds
    ``threshold``: ``ceil(n_rows / threshold)`` buckets, at least 2."""
    per = max(int(threshold), 1)
    n = F.col(n_rows)
    return (counts.filter(n > threshold)
            .select(key, F.greatest(F.ceil(n / F.lit(per)), F.lit(2)).cast("int").alias(BUCKETS)))


def _flag(hot: DataFrame, key: str) -> DataFrame:
    return hot.select(key, BUCKETS)


def salt_rows(rows: DataFrame, key: str, hot: DataFrame, spread: str) -> DataFrame:
    """Add the bucket ``_salt``: a hash of ``spread`` modulo the key's bucket
    count for rows of hot keys, 0 for all others.  ``hot``: ``hot_keys``."""
    b = F.col(BUCKETS)
    return (rows.join(_flag(hot, key), key, "left")
            .withColumn(SALT, F.when(b.isNotNull(), F.pmod(F.xxhash64(spread), b).cast("int"))
                        .otherwise(F.lit(0)))
            .drop(BUCKETS))


def salt_table(table: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Repeat the row of each hot key once per bucket; others get bucket 0."""
    b = F.col(BUCKETS)
    return (table.join(_flag(hot, key), key, "left")
            .withColumn(SALT, F.explode(F.when(b.isNotNull(), F.sequence(F.lit(0), b - 1))
                                        .otherwise(F.array(F.lit(0)))))
            .drop(BUCKETS))


def spread_join(rows: DataFrame, table: DataFrame, key: str, how: str,
                hot: DataFrame | None) -> DataFrame:
    """``rows.join(table, key, how)`` for ``rows`` already carrying ``_salt``
    (``salt_rows``; kept in the output) and ``table`` with at most one row
    per key.  ``how``: ``left``, ``inner`` or ``left_semi``; null keys never
    match, as in the plain join.  Without ``hot`` it is the plain join."""
    if hot is None:
        return rows.join(table, key, how)
    return rows.join(salt_table(table, key, hot), [key, SALT], how)
