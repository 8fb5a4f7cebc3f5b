"""Hot people by a sketch, Bloom filter before the movers' semi-join, and raw rows of education."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import SF0001, rows
from workpanel.operators import skew
from workpanel.operators.bloom import MAX_BITS, bits_for, bloom_words, may_be_in
from workpanel.operators.education import education_wide
from workpanel.operators.skew import hot_by_sketch, hot_keys, sketch
from workpanel.plans import pipelines as L
from workpanel.session import scratch_path
from workpanel.sources import fixtures as fx
from workpanel.sources.readers import read_education, read_positions
from workpanel.sources.writers import write_table

AS_OF = "2002-01-01"


@pytest.fixture(scope="module")
def tables(spark):
    """The test tables, with one person who has a third of the rows."""
    hot = F.xxhash64("position_id") % 3 == 0
    pos = fx.positions(spark, SF0001).withColumn("user_id", F.when(hot, F.lit(7)).otherwise(F.col("user_id")))
    edu = fx.education(spark, SF0001).withColumn("user_id", F.when(F.xxhash64("education_id") % 3 == 0, F.lit(7)).otherwise(F.col("user_id")))
    return (read_positions(spark, write_table(pos, scratch_path(spark, "heavy_positions"))),
            read_education(spark, write_table(edu, scratch_path(spark, "heavy_education"))))


def test_sketch_finds_the_exact_list(spark):
    """Keys above the limit and only they, with exact counts, though many more keys are kept out."""
    key = F.when(F.col("id") % 5 == 0, F.lit(-1)).when(F.col("id") % 50 == 1, F.lit(-2)).when(F.col("id") % 40 == 2, F.col("id") % 7 - 20)
    df = spark.range(300_000).select(key.alias("k"), "id").withColumn("k", F.coalesce("k", F.when(F.col("id") % 9 > 0, F.col("id"))))
    n, top = df.agg(*sketch("k")).first()
    assert n == 300_000
    counts = df.filter("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n_rows"))
    for share, least in ((1000, 0), (100, 0), (10, 0), (1000, 2000)):
        got = hot_by_sketch(df, "k", n, top, share, least)
        assert rows(got) == rows(hot_keys(counts, "k", threshold=max(least, n // share)))
    assert hot_by_sketch(df, "k", n, top, 2, 0) is None
    assert hot_by_sketch(df.limit(0), "k", *df.limit(0).agg(*sketch("k")).first()) is None


def test_sketch_of_text_keys(spark):
    df = spark.range(50_000).select(F.when(F.col("id") % 4 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"))
    assert rows(hot_by_sketch(df, "k", *df.agg(*sketch("k")).first(), share=10, least=0)) == [("hot", 3)]


@pytest.mark.parametrize("job", ["L3", "L4", "L5", "L6"])
def test_hot_people_by_sketch_change_no_result(tables, monkeypatch, job):
    P, E = tables
    cut = {"before": "1990-01-01"} if job in ("L4", "L6") else {}
    run = ((lambda **kw: L.mover_university_year(P, E, as_of=AS_OF, **cut, **kw)) if job in ("L3", "L4")
           else (lambda **kw: L.mover_origin_year(P, education=E, as_of=AS_OF, **cut, **kw)))
    want = rows(run(hot_rows=None))
    found = []

    def spied(*a, **kw):
        found.append(hot_by_sketch(*a, least=100, **{k: v for k, v in kw.items() if k != "least"}))
        return found[-1]

    monkeypatch.setattr(L, "hot_by_sketch", spied)
    assert rows(run()) == want
    assert 7 in {r["user_id"] for r in found[0].collect()}


def test_nobody_hot_means_no_table_of_persons(spark, tables):
    """The movers are written, no row counts, and no bucket is in the plan."""
    written = []

    def stage(df):
        written.append(df.columns)
        return L.stage_table(df)

    text = L.mover_origin_year(tables[0], as_of=AS_OF, stage=stage)._jdf.queryExecution().executedPlan().toString()
    assert written[0] == ["user_id"] and "_salt" not in text and len(written) == 2


def test_bloom_filter_keeps_all_keys_and_few_others(spark):
    keys = spark.range(20_000).select((F.col("id") * 7919).alias("k"))
    some = spark.range(400_000).select(F.when(F.col("id") % 100 > 0, F.col("id") * 7919 + F.col("id") % 3).alias("k"), F.lit("x").alias("_word"))
    kept = may_be_in(some, keys, "k", 20_000)
    assert kept.columns == some.columns
    exact = some.join(keys, "k", "left_semi")
    assert kept.join(keys, "k", "left_semi").count() == exact.count() > 5000
    assert kept.count() - exact.count() < 0.07 * 400_000 and kept.filter("k is null").isEmpty()
    words = bloom_words(keys, "k", bits_for(20_000))
    assert words.count() <= bits_for(20_000) // 64
    assert may_be_in(some, keys.limit(0), "k", 0).isEmpty()
    assert bits_for(10 ** 12) == MAX_BITS and may_be_in(some, keys, "k", MAX_BITS) is some


def test_bloom_filter_stands_before_the_movers_shuffle(spark, tables):
    """Movers too many to be broadcast: what is shuffled for the semi-join are their rows, and
    few others."""
    P, _ = tables
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    want = rows(L.mover_origin_year(P, as_of=AS_OF, hot_rows=None))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64")
    try:
        plans = []

        def stage(df):
            out = L.stage_table(df)
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])
            return out

        assert rows(L.mover_origin_year(P, as_of=AS_OF, stage=stage)) == want
        movers = L.movers(P, "India", "United States")
        kept = may_be_in(P, movers, "user_id", movers.count()).count()
        exact = P.join(movers, "user_id", "left_semi").count()
        assert exact <= kept <= exact + 0.1 * P.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    semi = plans[1].splitlines()
    at = next(k for k, line in enumerate(semi) if "LeftSemi" in line)
    assert any("bit_or" in line or "_bits" in line for line in semi[at:])


@pytest.mark.parametrize("kw", [{}, {"clean_first": True}])
def test_raw_rows_of_education(spark, tables, kw):
    _, E = tables
    E = E.unionByName(E.limit(40).withColumn("user_id", F.lit(None).cast("long")).withColumn("education_id", F.col("education_id") + 10 ** 9))
    want = rows(education_wide(E, **kw))
    assert rows(L.education_profile(E, **kw)) == want
    assert rows(L.education_profile(E, hot_rows=5, **kw)) == want
    assert rows(L.education_profile(E, hot_rows=None, **kw)) == want
    text = L.education_profile(E, **kw)._jdf.queryExecution().executedPlan().toString()
    exchanges = re.findall(r"Exchange hashpartitioning.*", text)
    assert len(exchanges) == 1 and "REPARTITION_BY_COL" in exchanges[0]
    assert skew.HOT_SHARE * 3.5 < skew.SKETCH_KEYS
