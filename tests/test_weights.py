"""Positions carry their copies through the neighbour step, so no rows are joined to them again."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratacloud.functions import near
from stratacloud.operators import neighbours as n

XYZ = ["x", "y", "z"]


def clouds(spark):
    rng = np.random.default_rng(11)
    a, b = rng.integers(0, 12, (400, 3)).astype(float), rng.integers(0, 12, (300, 3)) + 0.25
    a[:90], b[:80] = a[0], b[0]
    sides = [pd.DataFrame(p, columns=XYZ).assign(k="k", facet=np.arange(len(p)) % 3) for p in (a, b)]
    sides[0]["facet"] = sides[0]["facet"].astype("Int64").mask(np.arange(400) == 7)
    return a, b, [spark.createDataFrame(s.astype(object).where(s.notna(), None), "x double, y double, z double, k string, facet long") for s in sides]


def least(a, b):
    return np.sqrt(((a[:, None] - b[None]) ** 2).sum(2)).min(1)


@pytest.mark.parametrize("leaf", [4, 32])
def test_mutual_distances_count_copies(spark, leaf):
    a, b, (left, right) = clouds(spark)
    for got, p, q in zip(near.mutual_distances(left, right, ["k"], XYZ, "copies", leaf), (a, b), (b, a)):
        got = got.toPandas()
        assert got["copies"].sum() == len(p) and len(got) == len({tuple(r) for r in p})
        want = dict(zip(map(tuple, p), least(p, q)))
        assert all(abs(want[r[0], r[1], r[2]] - r[3]) < 1e-12 for r in got[[*XYZ, "d"]].itertuples(index=False))


def test_summary_and_shares_join_no_rows(spark):
    a, b, (left, right) = clouds(spark)
    plan = n.place_distances(left, right, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan.split("MapInArrow")[0]
    row = n.distance_summary(n.place_distances(left, right, ["k"]), ["k"]).first()
    d = least(a, b)
    assert row["n"] == 400 and row["median"] == pytest.approx(np.quantile(d, 0.5)) and row["p90"] == pytest.approx(np.quantile(d, 0.9))
    for r in n.accuracy_completeness(left, right, ["k"]).collect():
        assert r["accuracy"] == pytest.approx((d <= r["threshold"]).mean())
        assert r["completeness"] == pytest.approx((least(b, a) <= r["threshold"]).mean())


def test_coverage_of_equals_coverage_of_all_rows(spark):
    _, _, (left, right) = clouds(spark)
    left = left.unionByName(left.limit(1).select(F.lit(None).cast("double").alias("x"), "y", "z", "k", "facet"))
    got = n.coverage_of(left, right, 0.9, ["k"], "facet")
    want = n.coverage_by(n.covered(left, right, 0.9, ["k"]), ["k", "facet"])
    rows = [sorted(((str(r["facet"]), r["samples"], round(r["coverage"], 12), round(r["share"], 12)) for r in t.collect())) for t in (got, want)]
    assert rows[0] == rows[1] and len(rows[0]) == 4
