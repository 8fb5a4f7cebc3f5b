"""Sinks: distributed CSV / Parquet writes, and lineage cuts.

Every write goes from the executors straight to storage; nothing passes
through the driver.  A single-file output (the reference's pandas
``to_csv``) is not offered: it funnels the whole result through one task.
``ordered=...`` gives the useful part of it instead: range-partitioned,
sorted part files whose concatenation in name order is one sorted file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from workpanel.session import scratch_path


def _filesystem(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` holds a finished table: it exists, and a Spark write that died
    there (``_temporary`` without ``_SUCCESS``) is not all there is of it."""
    where, fs = _filesystem(spark, path)
    child = spark._jvm.org.apache.hadoop.fs.Path
    return fs.exists(where) and (fs.exists(child(where, "_SUCCESS")) or not fs.exists(child(where, "_temporary")))


def write_if_absent(spark: SparkSession, path: str, write) -> bool:
    """Call ``write(folder)`` and make its result ``path``, unless ``path`` is there already;
    whether it wrote.

    The result is written to a hidden folder beside ``path``, whose name does not change, and
    renamed once its commit marker is there.  So ``path`` appears as a whole or not at all; a run
    that was killed leaves only the hidden folder, which the next one overwrites.  One writer
    at a time for each ``path``; on stores without an atomic rename, a reader may see ``path``
    grow during the rename.
    """
    if is_written(spark, path):
        return False
    target, fs = _filesystem(spark, path)
    new = spark._jvm.org.apache.hadoop.fs.Path
    staging = new(target.getParent(), f"_writing_{target.getName()}")
    fs.delete(staging, True)
    write(staging.toString())
    if not fs.exists(new(staging, "_SUCCESS")):
        raise RuntimeError(f"{staging} has no commit marker; see mapreduce.fileoutputcommitter.marksuccessfuljobs")
    fs.delete(target, True)  # what a write that died left there, if anything
    if not fs.rename(staging, target):
        raise RuntimeError(f"{staging} could not be renamed to {path}")
    return True


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists",
                partition_by: list[str] | None = None, ordered: list[str] | None = None,
                max_records_per_file: int | None = None, row_group_bytes: int | None = None) -> str:
    """Write ``df`` to ``path``.  ``mode``: ``errorifexists`` (default),
    ``ignore`` (write only if absent or half-written, see ``write_if_absent``),
    ``overwrite`` or ``append``.  CSV gets
    a header row; ``text`` writes one value per line (one column only).
    ``row_group_bytes``: the size of Parquet row groups, each of which one task reads."""
    if fmt not in ("csv", "parquet", "text"):
        raise ValueError(f"fmt must be 'csv', 'parquet' or 'text', got {fmt!r}")
    if mode == "ignore":
        write_if_absent(df.sparkSession, path, lambda folder: write_table(
            df, folder, fmt, "errorifexists", partition_by, ordered, max_records_per_file, row_group_bytes))
        return path
    if ordered:
        df = df.orderBy(*ordered)
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", max_records_per_file)
    if row_group_bytes:
        w = w.option("parquet.block.size", row_group_bytes)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        if len(df.columns) != 1 or partition_by:
            raise ValueError("text output takes exactly one column and no partitioning")
        df.select(df[df.columns[0]].cast("string")).write.mode(mode).text(path)
    return path


def read_back(spark: SparkSession, path: str, fmt: str, schema) -> DataFrame:
    if fmt == "csv":
        return spark.read.schema(schema).option("header", True).csv(path)
    return spark.read.schema(schema).parquet(path)


#: Folders that ``materialize`` wrote, for ``discard_staged``.
_STAGED: list[str] = []


def discard_staged(spark: SparkSession) -> None:
    """Delete what ``materialize`` wrote; call when a job's outputs are written."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    while _STAGED:
        path = fs_path(_STAGED.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(spark: SparkSession, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it
    back: cuts the lineage (a lost executor does not replay the upstream
    plan) and lets a result feed several outputs without recomputation."""
    path = scratch_path(spark, name)
    _STAGED.append(path)
    write_table(df, path, partition_by=partition_by)
    return spark.read.schema(df.schema).parquet(path)
