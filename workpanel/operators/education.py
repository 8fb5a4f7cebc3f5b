"""Education long -> wide: one row per person with the school of each level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workpanel.functions.codes import education_level
from workpanel.functions.dates import parse_date
from workpanel.operators.clean import blank_sentinel
from workpanel.operators.topk import order_key

LEVEL = "Educ_Level"

# Output column prefix per education level and the source
# column behind each suffix, in output order.
_FOUR = [("location_raw", "university_location"), ("country", "university_country"),
         ("name", "university_name"), ("enddate", "enddate")]
_FIVE = [("location_raw", "university_location"), ("country", "university_country"),
         ("field", "field"), ("name", "university_name"), ("enddate", "enddate")]
WIDE_LAYOUT = [
    ("High School", "high_school", _FOUR),
    ("Associate", "associates", _FOUR),
    ("Bachelor", "college", _FIVE),
    ("Post Graduate", "post_grad", _FIVE),
]
WIDE_COLUMNS = [f"{prefix}_{suffix}" for _, prefix, parts in WIDE_LAYOUT for suffix, _ in parts]


def with_level(df: DataFrame, degree: str = "degree") -> DataFrame:
    return df.withColumn(LEVEL, education_level(degree))


def education_marked(df: DataFrame, key: str = "user_id", degree: str = "degree",
                     keep: tuple[str, ...] = ("education_id", "enddate")) -> DataFrame:
    """Level plus one column per (level, attribute), null outside its level."""
    d = with_level(df, degree)
    lvl = F.col(LEVEL)
    marked = {f"{prefix}_{suffix}": F.when(lvl == F.lit(level), F.col(src))
              for level, prefix, parts in WIDE_LAYOUT for suffix, src in parts}
    extra = [c for c in keep if c in df.columns]
    return d.select(key, *extra, LEVEL, *[e.alias(n) for n, e in marked.items()])


def education_wide(df: DataFrame, key: str = "user_id", degree: str = "degree",
                   date: str = "enddate", tie: str = "education_id",
                   order: str = "latest", clean_first: bool = False, raw: bool = False,
                   hot: DataFrame | None = None) -> DataFrame:
    """One row per person with the 18 ``WIDE_COLUMNS``.

    A person has few rows, so combining them before the shuffle sends about as many
    rows, each 18 values and their order keys wide.  ``raw=True`` sends the rows as they
    are and combines them after the shuffle.  ``hot`` (``key`` and more): people with so
    many rows that these must not meet in one task; they are combined before the shuffle.

    ``order="latest"``: each column takes its value from the person's latest
    degree (by parsed ``date``, nulls last, ties by ``tie``) among the
    degrees where that column is not null.  ``order="any"`` is the
    order-free ``first(ignorenulls)`` (not deterministic).  The text
    ``'empty'`` becomes null after the collapse, in string columns only
    (``clean_first=True``: before, so it can no longer win).
    """
    if raw:
        kw = dict(key=key, degree=degree, date=date, tie=tie, order=order, clean_first=clean_first)
        used = dict.fromkeys([key, degree, date, tie, *(src for _, _, parts in WIDE_LAYOUT for _, src in parts)])
        rows = df.select(*[c for c in used if c in df.columns])
        if hot is None:
            return education_wide(rows.repartition(key), **kw)
        hot = F.broadcast(hot.select(key))  # fewer than one in HOT_SHARE rows, and written
        # people without an id are one group, which an anti-join keeps whole: they are combined with the hot
        few = rows.filter(F.col(key).isNotNull()).join(hot, key, "left_anti").repartition(key)
        many = rows.join(hot, key, "left_semi").unionByName(rows.filter(F.col(key).isNull()))
        return education_wide(few, **kw).unionByName(education_wide(many, **kw))
    m = education_marked(df, key, degree, keep=(tie, date))
    if clean_first:
        m = blank_sentinel(m, cols=WIDE_COLUMNS)
    if order == "latest":
        m = m.withColumn("_d", parse_date(date))
        # the order key is built once per row, then shared by the 18 aggregates
        pick, key_expr = order_key(m, [("_d", "desc", "last"), (tie, "asc", "last")])
        m = m.withColumn("_k", key_expr)
        k = F.col("_k")
        aggs = [pick(F.col(c), F.when(F.col(c).isNotNull(), k)).alias(c) for c in WIDE_COLUMNS]
    elif order == "any":
        aggs = [F.first(c, ignorenulls=True).alias(c) for c in WIDE_COLUMNS]
    else:
        raise ValueError(f"order must be 'latest' or 'any', got {order!r}")
    wide = m.groupBy(key).agg(*aggs)
    if not clean_first:
        wide = blank_sentinel(wide)
    return wide
