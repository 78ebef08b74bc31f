"""Rounding of registered numbers."""

import pytest
from pyspark.sql import functions as F

from tessera.plans.pairs import near


@pytest.mark.parametrize("digits", [2, 4, 5, 6, 7])
def test_near_equals_round(spark, digits):
    odd = spark.sql("SELECT explode(array(0D, -0D, 1e300, -1e300, 1e15, -123456789.125D, 1e-9, -1e-9, double('NaN'), double('inf'), double('-inf'), NULL)) AS x")
    d = spark.range(200_000).select((F.randn(1) * F.pow(F.lit(10.0), F.col("id") % 14 - 4)).alias("x"))
    d = d.unionByName(spark.range(20_000).select((F.col("id") / 1000).alias("x"))).unionByName(odd)
    want = F.round(F.col("x") + 0.13 * 10**-digits, digits) + 0.0
    # a product rounds, so larger values may go to the other side of a half, as in DuckDB
    off = F.when(F.abs(F.col("x")) * 10**digits < 1e9, ~near(F.col("x"), digits).eqNullSafe(want)).otherwise(F.abs(near(F.col("x"), digits) - want) > 1.01 * 10**-digits + F.abs("x") * 1e-15)
    assert d.where(F.abs("x") < 1e14).where(off).count() == 0
    assert odd.where(~near(F.col("x"), digits).eqNullSafe(want)).count() == 0
    assert not any(str(r["y"]).startswith("-0.0") and r["y"] == 0 for r in odd.select(near(F.col("x"), digits).alias("y")).collect())


def test_near_goes_without_decimals_for_most_values(spark):
    plan = spark.range(1).select(near(F.col("id").cast("double")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert "rint" in plan.lower()
