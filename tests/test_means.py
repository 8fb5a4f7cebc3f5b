"""Cell means keep every value, whatever its size or fraction."""

import math

import pytest

from workpanel.operators.cells import cell_means

CASES = {
    "fractions": ([0.004, 0.003], 0.0035),
    "cents": ([10.25, 20.5, None], 15.375),
    "nan": ([math.nan, 100.0], math.nan),
    "infinite": ([math.inf, 100.0], math.inf),
    "large": ([2e16, 2e16], 2e16),
    "mixed": ([1.25, 0.0625, 3e17], (1.25 + 0.0625 + 3e17) / 3),
    "none": ([None, None], None),
}


@pytest.mark.parametrize("scale", [2, None])
def test_mean_is_the_average(spark, scale):
    rows = [(k, v) for k, (values, _) in CASES.items() for v in values]
    df = spark.createDataFrame(rows, "k string, salary double")
    got = {r["k"]: r["mean_salary"] for r in cell_means(df, ["k"], exact_scale=scale).collect()}
    for k, (_, mean) in CASES.items():
        assert got[k] == mean if mean is None or not math.isnan(mean) else math.isnan(got[k]), k
