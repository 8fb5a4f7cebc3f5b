"""Helpers the text operators share: staged tables, words, gapless ranks, components."""

from __future__ import annotations

import math
import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from workpanel.session import scratch_path

#: Words are runs of anything but blank, tab, newline, vertical tab, form feed and return.
BLANKS = r"[\x20\x09-\x0D]+"
#: Rows that one ranking window sorts, on average.
ROWS_PER_BUCKET = 20_000
#: Rows of ids that a join may broadcast, about 10 MB.
BROADCAST_ROWS = 250_000
#: Rounds of components(); labels of a chain of 2^40 nodes have met by then.
LINK_LIMIT = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Python workers import this package too, wherever the session was started
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the cluster's shared checkpoint folder and read it back.

    This cuts the lineage: what follows survives a lost executor without
    computing ``df`` again, and values that depend on task order (row ids)
    are fixed from here on.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, longer where ``df`` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Scratch:
    """A folder for the tables of one run, under the cluster's shared checkpoint folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.root, self.tables = spark, name, scratch_path(spark, name), 0

    def write(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """As ``staged``, into the run's folder; ``by``: a column to make folders of."""
        self.tables += 1
        path = f"{self.root}/{self.tables}-{name}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep(self, df: DataFrame) -> DataFrame:
        """Write the run's result beside its folder, and delete the folder."""
        out = staged(df, f"{self.name}-result")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return out


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a written table of a few numbers a row, to be broadcast if it has at
    most ``rows`` rows; beyond that Spark joins it by shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def shuffled(df: DataFrame) -> DataFrame:
    """``df``, a list of ids that grows with the corpus, to be joined by shuffle at
    every size, so that figures of small tables hold for large ones."""
    return df.hint("shuffle_merge")


def words(text: Column | str) -> Column:
    """The text's words as an array; null and blank texts give an empty one."""
    t = F.col(text) if isinstance(text, str) else text
    parts = F.split(F.coalesce(t, F.lit("")), BLANKS)
    return F.filter(parts, lambda w: w != "")


def numbered(df: DataFrame, keys: list[str], uid: str, rows: int, out: str = "rank") -> DataFrame:
    """Add ``out``: 0, 1, 2 ... within each group of ``keys``, in no particular order.

    A group is dealt into buckets by a hash of the unique ``uid``; each bucket
    is ranked by itself and shifted by the sizes of the buckets before it, so
    no task holds a whole group however large it is.
    """
    n = max(1, math.ceil(rows / ROWS_PER_BUCKET))
    df = df.withColumn("_b", F.pmod(F.xxhash64(uid), F.lit(n)).cast("int"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = (df.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
            .select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")))
    inner = Window.partitionBy(*keys, "_b").orderBy(uid)
    df = df.withColumn("_r", F.row_number().over(inner) - 1)
    on = [df[k].eqNullSafe(base[k]) for k in [*keys, "_b"]]
    kept = [df[c] for c in df.columns if c not in ("_b", "_r")]
    return df.join(base, on).select(*kept, (F.col("_base") + F.col("_r")).cast("long").alias(out))


def components(edges: DataFrame, scratch: Scratch | None = None, name: str = "components") -> DataFrame:
    """``node, component`` for the nodes of ``edges`` (``a, b``, longs): the
    smallest node reachable, itself included.

    Each round gives every node the smallest label among its own and its
    neighbours', then follows that label one step (pointer jumping), so long
    chains shorten by half.  Every round is a written table.
    """
    scratch = scratch or Scratch(edges.sparkSession, name)
    both = scratch.write(edges.select("a", "b").union(edges.select("b", "a"))
                         .filter("a is not null and b is not null and a <> b").distinct(), f"{name}-edges")
    labels = scratch.write(both.groupBy(F.col("a").alias("node"))
                           .agg(F.least(F.first("a"), F.min("b")).alias("component")), name)
    for _ in range(LINK_LIMIT):
        near = (both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node"))
                .agg(F.min("component").alias("near")))
        own = (labels.join(near, "node")
               .select("node", F.col("component").alias("old"),
                       F.least("component", "near").alias("next")))
        # the label of a node's label is at most the label itself
        via = labels.select(F.col("node").alias("next"), F.col("component").alias("jump"))
        new = scratch.write(own.join(via, "next", "left").select(
            "node", "old", F.coalesce(F.least("next", "jump"), "next").alias("component")), name)
        labels = new.select("node", "component")
        if new.filter("component <> old").isEmpty():
            return labels
    raise RuntimeError(f"components: no end after {LINK_LIMIT} rounds")
