"""Code and label column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from workpanel.functions.dates import col_

# Degree labels kept as their own education level; every other
# degree (including null and 'empty') is 'Post Graduate'.  Exact,
# case-sensitive match.
KEPT_DEGREES = ["High School", "Associate", "Bachelor"]
OTHER_LEVEL = "Post Graduate"

# Fixed value: the text that stands for a missing value in the source tables.
BLANK_TOKEN = "empty"


def occupation_major(c: Column | str) -> Column:
    """Major occupation group: the part of the code before the first '-'."""
    return F.split_part(col_(c), F.lit("-"), F.lit(1))


def education_level(c: Column | str) -> Column:
    c = col_(c)
    return F.when(c.isin(*KEPT_DEGREES), c).otherwise(F.lit(OTHER_LEVEL))


def blank_to_null(c: Column | str, token: str = BLANK_TOKEN) -> Column:
    return F.nullif(col_(c), F.lit(token))


def is_filled(c: Column | str, token: str = BLANK_TOKEN) -> Column:
    """Non-null and not the blank token; never null itself."""
    c = col_(c)
    return F.coalesce(c.isNotNull() & (c != F.lit(token)), F.lit(False))
