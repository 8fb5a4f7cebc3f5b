"""Readers for the three input tables.

Directories are read with ``pathGlobFilter`` (only ``*.parquet`` / ``*.csv``
files), which works the same on local disks and object stores; the listing
is Spark's.  Known columns are checked, extra columns are carried through.
"""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from workpanel.operators.places import union_parts

S, L, D, I = T.StringType(), T.LongType(), T.DoubleType(), T.IntegerType()

POSITIONS_SCHEMA = T.StructType([
    T.StructField("user_id", L), T.StructField("position_id", S),
    T.StructField("startdate", S), T.StructField("enddate", S),
    T.StructField("country", S), T.StructField("state", S),
    T.StructField("metro_area", S), T.StructField("location_raw", S),
    T.StructField("onet_code", S), T.StructField("salary", D),
])

EDUCATION_SCHEMA = T.StructType([
    T.StructField("user_id", L), T.StructField("education_id", L),
    T.StructField("degree", S), T.StructField("enddate", S),
    T.StructField("university_name", S), T.StructField("university_country", S),
    T.StructField("university_location", S), T.StructField("field", S),
])

CITY_KEYS = ("location", "metro_area", "city")


def require_columns(df: DataFrame, needed, what: str) -> DataFrame:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks columns {missing}; has {df.columns}")
    return df


def require_types(df: DataFrame, schema: T.StructType, what: str) -> DataFrame:
    """Known columns must have a type their job can use: numbers for numbers
    that are summed, text for text (dates may also be dates or timestamps);
    ids may be any plain type."""
    wrong = []
    for f in schema:
        if f.name not in df.columns:
            continue
        found = df.schema[f.name].dataType
        if f.name.endswith("_id"):
            ok = not isinstance(found, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))
        elif isinstance(f.dataType, T.NumericType):
            ok = isinstance(found, T.NumericType)
        else:
            dates = (T.DateType, T.TimestampType, T.TimestampNTZType) if f.name.endswith("date") else ()
            ok = isinstance(found, (T.StringType, *dates))
        if not ok:
            wrong.append(f"{f.name}: {found.simpleString()}")
    if wrong:
        raise ValueError(f"{what} has columns of unusable types: {', '.join(wrong)}")
    return df


SOURCE_FILE = "source_file"


def with_source_file(df: DataFrame, name: str = SOURCE_FILE) -> DataFrame:
    """Add the path of the file each row was read from (file sources only);
    with ``partitionBy(name)`` on write, outputs keep one folder per input
    file."""
    return df.withColumn(name, F.col("_metadata.file_path"))


def _parquet(spark: SparkSession, path: str | list[str], schema: T.StructType | None,
             rebase: bool) -> DataFrame:
    r = spark.read.option("pathGlobFilter", "*.parquet")
    if rebase:
        # Dates before 1582 as written (proleptic Gregorian), no rebasing.
        r = r.option("datetimeRebaseMode", "CORRECTED").option("int96RebaseMode", "CORRECTED")
    if schema is not None:
        r = r.schema(schema)
    paths = [path] if isinstance(path, str) else list(path)
    return r.parquet(*paths)


def read_positions(spark: SparkSession, path: str | list[str],
                   schema: T.StructType | None = None, rebase: bool = True,
                   needed=("user_id", "startdate", "enddate", "country")) -> DataFrame:
    df = require_columns(_parquet(spark, path, schema, rebase), needed, "positions")
    return require_types(df, POSITIONS_SCHEMA, "positions")


def read_education(spark: SparkSession, path: str | list[str],
                   schema: T.StructType | None = None, rebase: bool = True,
                   needed=("user_id", "degree", "enddate")) -> DataFrame:
    df = require_columns(_parquet(spark, path, schema, rebase), needed, "education")
    return require_types(df, EDUCATION_SCHEMA, "education")


#: Different headers that a list of look-up files may have.
MAX_LAYOUTS = 200


def read_city_mapper(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """City look-up CSV files with a header; every column read as text.

    A directory is one scan (files must share a header; a file whose header
    differs is an error rather than silently shifted columns).  A list of
    files or folders is one scan too, however many there are: each file is read as
    a whole, its first line says how its other lines are parsed, and columns
    line up by name; missing ones are null.  So look-up files of a list are at most 2 GB
    each and have at most ``MAX_LAYOUTS`` different headers, and, as in any line-wise CSV,
    no line breaks inside quotes.
    """
    if isinstance(path, str):
        df = (spark.read.option("header", True).option("inferSchema", False)
              .option("enforceSchema", False).option("pathGlobFilter", "*.csv").csv(path))
    else:
        df = _by_header(spark, list(path))
    return require_columns(df, CITY_KEYS, "city look-up")


def _by_header(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The lines of CSV files with headers of their own, parsed by them in one scan."""
    files = spark.read.option("pathGlobFilter", "*.csv").text(paths, wholetext=True)
    lines = F.split(F.regexp_replace("value", "^\\ufeff", ""), "\r\n|\n|\r")
    files = files.select(lines.alias("lines")).select(F.element_at("lines", 1).alias("header"), "lines")
    found = sorted(r[0] for r in files.select("header").distinct().limit(MAX_LAYOUTS + 1).collect())
    if len(found) > MAX_LAYOUTS:
        raise ValueError(f"city look-up files have more than {MAX_LAYOUTS} different headers")
    layouts = {h: next(csv.reader([h]), []) for h in found if h.strip()}
    names = list(dict.fromkeys(c for own in layouts.values() for c in own))
    rows = files.select("header", F.explode(F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0)))).alias("line"))
    rows = rows.filter(F.trim("line") != "")
    for k, own in enumerate(layouts.values()):
        schema = ", ".join(f"c{j} string" for j in range(len(own)))
        rows = rows.withColumn(f"_{k}", F.when(F.col("header") == list(layouts)[k], F.from_csv("line", schema)))

    def column(name: str):
        parts = [F.col(f"_{k}.c{own.index(name)}") for k, own in enumerate(layouts.values()) if name in own]
        return F.coalesce(*parts).alias(name)

    return rows.select(*[column(name) for name in names])
