"""City look-up: merge look-up parts, attach cities to raw locations, split
located from unlocated rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workpanel.functions.codes import is_filled


def union_parts(parts: list[DataFrame]) -> DataFrame:
    """Stack look-up parts by column name; a column missing from a part is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def merge_city_mapper(parts: list[DataFrame]) -> DataFrame:
    """Union of the parts without duplicate rows (over all columns, nulls
    equal).  Two cities for one key both survive; see ``mapper_conflicts``."""
    return union_parts(parts).distinct()


def mapper_conflicts(mapper: DataFrame, keys: tuple[str, ...] = ("location", "metro_area"),
                     count: str = "n_rows") -> DataFrame:
    """Look-up keys (nulls grouped together) that hold more than one row;
    each such key multiplies the positions that match it."""
    return (mapper.groupBy(*keys).agg(F.count(F.lit(1)).alias(count))
            .filter(F.col(count) > 1))


def attach_city(positions: DataFrame, mapper: DataFrame,
                left_on: tuple[str, str] = ("location_raw", "metro_area"),
                right_on: tuple[str, str] = ("location", "metro_area"),
                null_safe: bool = True) -> DataFrame:
    """Left join positions to the look-up on two keys.

    ``null_safe=True`` matches a null key to a null key, as a pandas merge
    does; it stays an equi-join (hashed on value and null-ness).  Output:
    every positions column, then the look-up columns; a key pair with the
    same name on both sides is kept once (the positions side), other shared
    names get ``_pos`` / ``_map`` suffixes.  Join strategy is left to AQE:
    the look-up is broadcast when its measured size is under the broadcast
    threshold, else both sides are shuffled on the keys (skewed keys split).
    """
    shared_keys = {l for l, r in zip(left_on, right_on) if l == r}
    clash = (set(positions.columns) & set(mapper.columns)) - shared_keys
    p = positions.select(*[F.col(c).alias(f"{c}_pos" if c in clash else c)
                           for c in positions.columns])
    tmp = {c: f"_map_{c}" for c in shared_keys}
    m = mapper.select(*[F.col(c).alias(tmp.get(c, f"{c}_map" if c in clash else c))
                        for c in mapper.columns])
    lname = {c: f"{c}_pos" if c in clash else c for c in left_on}
    rname = {c: tmp.get(c, f"{c}_map" if c in clash else c) for c in right_on}
    conds = []
    for l, r in zip(left_on, right_on):
        lc, rc = F.col(lname[l]), F.col(rname[r])
        conds.append(lc.eqNullSafe(rc) if null_safe else lc == rc)
    j = p.join(m, reduce(lambda a, b: a & b, conds), "left")
    return j.drop(*tmp.values())


def located_predicate(location: str = "location", city: str = "city"):
    """True when both the matched location and the city are present and not
    'empty'; never null, so every row is on exactly one side."""
    return is_filled(location) & is_filled(city)


def split_located(df: DataFrame, location: str = "location",
                  city: str = "city") -> tuple[DataFrame, DataFrame]:
    p = located_predicate(location, city)
    return df.filter(p), df.filter(~p)


def unlocated_users(df: DataFrame, key: str = "user_id", location: str = "location",
                    city: str = "city") -> DataFrame:
    """The key of every unlocated row (a person appears once per such row)."""
    return split_located(df, location, city)[1].select(key)
