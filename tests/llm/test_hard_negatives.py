"""Hard negatives against every product, and on odd inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from workpanel.llm.hard_negatives import Best, hard_negatives, planes_of, scores, subset_sums, unpacked

R = np.random.default_rng(3)
SCHEMA = "vec_id long, embedding array<float>, label int, planes int, slot string"


def by_products(rows, every=3, positives=5, negatives=10):
    use = {}
    for k, v, label in rows:
        if k is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        use[(k, label, tuple(math.floor(256 * float(np.float32(x))) for x in v))] = None
    out = set()
    product = lambda a, b: sum(x * y for x, y in zip(a, b))
    for k, label, v in use:
        if k % every:
            continue
        near = sorted({(-product(v, w), j) for j, own, w in use if own == label and j != k})[:positives]
        for p, j in near:
            far = sorted({(-product(v, w), i) for i, own, w in use
                          if own != label and 30 * -p <= 100 * product(v, w) <= 90 * -p})[:negatives]
            out |= {(k, j, rank, i, -p, -s) for rank, (s, i) in enumerate(far, 1)}
    return out


def frame(spark, rows):
    return spark.createDataFrame([(k, v, label, 1, "x") for k, v, label in rows], SCHEMA).repartition(3)


def run(spark, rows, **more):
    df = hard_negatives(frame(spark, rows), F.col("vec_id") % 3 == 0, F.col("label"), **more)
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    out = [tuple(r) for r in df.collect()]
    assert len(out) == len(set(out))
    return set(out)


@pytest.fixture(scope="module")
def rows():
    base = R.normal(0, 1, (4, 19))
    out = [(k, (base[k % 4] * 0.4 + R.normal(0, 0.3, 19)).astype("f4").tolist(), k % 4 if k % 5 else 0) for k in range(150)]
    out += [(k, out[k - 200][1], 1) for k in range(200, 240)]  # equal vectors: ties by id
    out += out[:20]  # repeated rows
    out += [(300, None, 1), (303, [1.0] * 19, None), (None, [1.0] * 19, 2), (306, [float("nan")] + [0.0] * 18, 1),
            (309, [None] + [1.0] * 18, 1), (312, [float("-inf")] + [0.0] * 18, 1), (315, [], 1), (316, [0.5, -0.5], 2),
            (318, [0.0] * 19, 3), (321, [-0.001] * 19, 77)]
    return out


def test_equals_all_products(spark, rows):
    want = by_products(rows)
    assert len(want) > 500
    assert run(spark, rows) == want


def test_blocks_of_anchors(spark, rows):
    """Tables of 5 anchors at a time: the blocks together give the same rows."""
    assert run(spark, rows, table_bytes=5 * 3 * 256 * 4) == by_products(rows)


def test_large_components(spark):
    rows = [(k, [float(x) for x in R.integers(-10 ** 6, 10 ** 6, 5)], k % 2) for k in range(40)]
    assert run(spark, rows) == by_products(rows)
    with pytest.raises(ArithmeticError):
        run(spark, [(0, [1e30], 1), (1, [1e30], 1)])


def test_none(spark, rows):
    assert run(spark, [(0, [1.0], 1)]) == set()
    assert hard_negatives(frame(spark, rows).limit(0), F.lit(True), F.col("label")).count() == 0
    assert hard_negatives(frame(spark, rows), F.lit(None).cast("boolean"), F.col("label")).count() == 0


@pytest.mark.parametrize("dims", [1, 8, 17])
def test_scores_are_products(dims):
    a, c = R.integers(-300, 300, (7, dims)), R.integers(-511, 512, (50, dims))
    planes = planes_of(c, 10)
    assert (scores(subset_sums(a), planes) == c @ a.T).all()
    back = unpacked([p.tobytes() for p in planes], 10, -(-dims // 8))
    assert (back[:, :dims] == c).all() and not back[:, dims:].any()


def test_best_keeps_ties_by_id():
    best = Best(2, 2, np.full(2, -100))
    for ids in ([9, 8], [3, 7], [3, 1]):
        best.add(np.zeros(2, "i8"), np.array([5, 5]), np.array(ids))
    assert best.id.tolist() == [1, 3] and best.low.tolist() == [5, -100]
