"""Work-history test tables derived from the TPC-H-style test data.

The driver's test data has no positions / education / city look-up tables,
so these are derived from it deterministically (see FIXTURES.md): one job
spell per line item, one degree per order, a city look-up per nation.  The
derivation is an ordinary Spark job, so its size grows with the inputs.
The same derivation as DuckDB SQL lives in ``workpanel.plans.oracle_sql``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _s(c: Column) -> Column:
    return c.cast("string")


def _iso_date(c: Column) -> Column:
    return _s(c.cast("date"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job spells: lineitem ⋈ supplier ⋈ nation ⋈ orders ⋈ part.

    Nations come first, so that a filter on the country drops line items before
    they are shuffled to their orders.  Orders grow with the line items and are
    joined by shuffle at every size, so that figures of small tables hold for large ones."""
    li = _read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        "l_extendedprice", "l_shipdate")
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate").hint("shuffle_merge")
    s = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    p = _read(spark, sf_dir, "part").select("p_partkey", "p_size")
    j = (li.join(s, li.l_suppkey == s.s_suppkey)
           .join(n, s.s_nationkey == n.n_nationkey)
           .join(o, li.l_orderkey == o.o_orderkey)
           .join(p, li.l_partkey == p.p_partkey))
    ok, ln, sk = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey")
    nk, size = F.col("n_nationkey"), F.col("p_size")
    return j.select(
        F.col("o_custkey").alias("user_id"),
        F.concat(_s(ok), F.lit("-"), _s(ln), F.lit("-"), _s(F.col("l_partkey")),
                 F.lit("-"), _s(sk)).alias("position_id"),
        F.when((ok * 7 + ln) % 10 == 0, F.lit(None).cast("string"))
         .when((ok + ln) % 29 == 0, F.lit("empty"))
         .otherwise(_iso_date(F.col("o_orderdate"))).alias("startdate"),
        F.when((ok * 3 + ln) % 9 == 0, F.lit(None).cast("string"))
         .otherwise(_iso_date(F.col("l_shipdate"))).alias("enddate"),
        F.when(nk % 4 == 1, F.lit("India")).when(nk % 4 == 2, F.lit("United States"))
         .otherwise(F.col("n_name")).alias("country"),
        F.when(sk % 13 == 12, F.lit(None).cast("string")).when(sk % 13 == 11, F.lit("empty"))
         .otherwise(F.concat(F.lit("State_"), _s(sk % 13))).alias("state"),
        F.when(ln == 7, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("Metro_"), _s(F.col("n_regionkey")))).alias("metro_area"),
        F.concat(F.lit("Loc_"), _s(nk)).alias("location_raw"),
        F.when(size % 17 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(_s(size % 9 + 11), F.lit("-"), _s(size + 1000), F.lit(".00")))
         .alias("onet_code"),
        F.when(F.col("l_quantity") == 13, F.lit(None).cast("double"))
         .otherwise(F.col("l_extendedprice")).alias("salary"),
    )


def education(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degree spells: one per order."""
    o = _read(spark, sf_dir, "orders")
    ok, prio = F.col("o_orderkey"), F.col("o_orderpriority")
    null = F.lit(None).cast("string")
    return o.select(
        F.col("o_custkey").alias("user_id"),
        ok.alias("education_id"),
        F.when(ok % 31 == 0, null).when(ok % 29 == 0, F.lit("empty"))
         .when(prio == "1-URGENT", F.lit("High School")).when(prio == "2-HIGH", F.lit("Associate"))
         .when(prio == "3-MEDIUM", F.lit("Bachelor")).when(prio == "5-LOW", F.lit("Doctor"))
         .otherwise(F.lit("Master")).alias("degree"),
        F.when(ok % 11 == 0, null)
         .otherwise(_s(F.add_months(F.col("o_orderdate").cast("date"), -120))).alias("enddate"),
        F.when(ok % 5 == 0, F.lit("empty"))
         .otherwise(F.concat(F.lit("Uni_"), _s(ok % 50))).alias("university_name"),
        F.when(ok % 3 == 0, F.lit("India")).when(ok % 3 == 1, F.lit("United States"))
         .otherwise(F.lit("empty")).alias("university_country"),
        F.when(ok % 13 == 0, null)
         .otherwise(F.concat(F.lit("Town_"), _s(ok % 40))).alias("university_location"),
        F.when(ok % 6 == 0, null)
         .otherwise(F.concat(F.lit("Field_"), _s(ok % 8))).alias("field"),
    )


def _mapper_rows(n: DataFrame) -> DataFrame:
    nk = F.col("n_nationkey")
    null = F.lit(None).cast("string")
    return n.select(
        F.concat(F.lit("Loc_"), _s(nk)).alias("location"),
        F.when(nk % 6 == 5, null)
         .otherwise(F.concat(F.lit("Metro_"), _s(F.col("n_regionkey")))).alias("metro_area"),
        F.when(nk % 7 == 0, F.lit("empty")).when(nk % 7 == 1, null)
         .otherwise(F.concat(F.lit("City_"), _s(nk))).alias("city"),
    )


def city_mapper_parts(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Two overlapping look-up parts; part 1 adds a second city for Loc_4."""
    n = _read(spark, sf_dir, "nation")
    part0 = _mapper_rows(n.filter(F.col("n_nationkey") < 15))
    conflict = n.filter(F.col("n_nationkey") == 4).select(
        F.concat(F.lit("Loc_"), _s(F.col("n_nationkey"))).alias("location"),
        F.concat(F.lit("Metro_"), _s(F.col("n_regionkey"))).alias("metro_area"),
        F.lit("City_4b").alias("city"))
    part1 = _mapper_rows(n.filter(F.col("n_nationkey") >= 10)).unionByName(conflict)
    return [part0, part1]
