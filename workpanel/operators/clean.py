"""Sentinel cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from workpanel.functions.codes import BLANK_TOKEN, blank_to_null


def blank_sentinel(df: DataFrame, token: str = BLANK_TOKEN,
                   cols: list[str] | None = None) -> DataFrame:
    """Replace ``token`` by null in string columns (all of them, or ``cols``).

    Only string columns are compared: comparing a number or a date with the
    token is an error under ANSI mode and never true otherwise.
    """
    strings = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    targets = set(strings if cols is None else [c for c in cols if c in strings])
    return df.select(*[blank_to_null(c, token).alias(c) if c in targets else F.col(c)
                       for c in df.columns])
