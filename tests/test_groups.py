import numpy as np
import pytest
from pyspark.sql import functions as F

from stratacloud.functions import groups
from stratacloud.functions.quantiles import exact_quantiles
from stratacloud.operators import cloud, fit


@pytest.fixture
def rows(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    x, y = F.col("id") % 17, F.col("id") % 23
    yield spark.range(2000).select(F.when(F.col("id") % 50 == 0, "B").otherwise("A").alias("scan"), x.cast("double").alias("x"), y.cast("double").alias("y"),
                                   (x * 0.25 + (F.col("id") % 7) / 10).cast("double").alias("z"))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


STEPS = {
    "plane": lambda rows: fit.orthogonal_plane(rows, ["scan"]),
    "align": lambda rows: fit.align(rows.select("scan", *[F.col(a).alias(f"s{a}") for a in "xyz"], *[(F.col(a) + 1).alias(f"t{a}") for a in "xyz"]), ["scan"]),
    "quantiles": lambda rows: exact_quantiles(rows, ["scan"], "z", {"m": ("linear", 0.5)}, small_group=10),
    "noise": lambda rows: cloud.board_noise(rows, ["scan"], min_points=5),
}


@pytest.mark.parametrize("step", STEPS)
def test_rows_of_few_groups_stay_where_they_are(spark, rows, step, monkeypatch):
    found = STEPS[step](rows)
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    few = found.orderBy("scan").toPandas()
    monkeypatch.setattr(groups, "FEW_GROUPS", 1)
    many = STEPS[step](rows)
    assert "SortMergeJoin" in many._jdf.queryExecution().executedPlan().toString()
    many = many.orderBy("scan").toPandas()
    for name in few.columns:        # sums differ in their last digits
        got, want = (np.array(side[name].tolist()) for side in (few, many))
        assert (got == want).all() if got.dtype.kind in "US" else np.allclose(got, want)
