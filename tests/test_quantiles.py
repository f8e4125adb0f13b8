import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratacloud.functions.quantiles import cell_quantiles, exact_quantiles, with_quantiles

RANKS = {"p0": ("linear", 0.0), "p2": ("linear", 0.02), "med": ("linear", 0.5), "p975": ("linear", 0.975), "p1": ("linear", 1.0),
         "mid": ("at", 1, 2), "nine": ("at", 9, 10)}


def frame(spark, seed=0):
    rng = np.random.default_rng(seed)
    groups = {"hot": rng.normal(size=60_000), "ties": rng.integers(0, 4, 20_000).astype(float), "one": np.array([7.0]),
              "few": rng.normal(size=9), "heavy": np.r_[rng.normal(size=15_000), 1e12, -1e12]}
    pdf = pd.concat([pd.DataFrame({"g": k, "v": v}) for k, v in groups.items()])
    return spark.createDataFrame(pdf).repartition(7), groups


def expected(values, rank):
    values = np.sort(values)
    return np.percentile(values, rank[1] * 100) if rank[0] == "linear" else values[len(values) * rank[1] // rank[2]]


@pytest.mark.parametrize("small,accuracy", [(100_000, 10_000), (50, 200), (0, 1000)])
def test_exact_quantiles_both_routes(spark, small, accuracy):
    df, groups = frame(spark)
    small = max(small, 10)
    got = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", RANKS, small, accuracy).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        for name, rank in RANKS.items():
            assert got[g][name] == pytest.approx(expected(values, rank), rel=1e-12, abs=1e-12), (g, name)


def test_global_and_nulls(spark):
    df, groups = frame(spark)
    everything = np.concatenate(list(groups.values()))
    row = exact_quantiles(df.unionByName(spark.createDataFrame([("x", None)], "g string, v double")), [], "v", RANKS).first()
    for name, rank in RANKS.items():
        assert row[name] == pytest.approx(expected(everything, rank))


def test_cell_quantiles_routes_agree(spark):
    df, groups = frame(spark)
    for limit in (100_000, 100):
        rows = {r["g"]: r for r in cell_quantiles(df, ["g"], "v", RANKS, [F.count("*").alias("n")], limit).collect()}
        for g, values in groups.items():
            assert rows[g]["n"] == len(values)
            assert rows[g]["mid"] == pytest.approx(expected(values, ("at", 1, 2)))
            assert rows[g]["p2"] == pytest.approx(expected(values, ("linear", 0.02)))


def test_with_quantiles_keeps_groups_without_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None)], "g string, v double")
    plain = df.groupBy("g").agg(F.count("*").alias("n"))
    rows = {r["g"]: r["m"] for r in with_quantiles(df, plain, ["g"], "v", {"m": ("linear", 0.5)}).collect()}
    assert rows == {"a": 2.0, "b": None}


def test_values_that_differ_between_passes(spark):
    """Sums of doubles can come out another way in each pass, by their last digits."""
    def shake(batches):
        for batch in batches:
            yield batch.assign(v=batch["v"] * (1 + 1e-14 * np.random.default_rng().uniform(-1, 1, len(batch))))

    rows = [(g, float(v)) for g, n in (("one", 1), ("few", 5), ("many", 300)) for v in range(1, n + 1)]
    df = spark.createDataFrame(rows, "g string, v double").mapInPandas(shake, "g string, v double")
    for small, accuracy in ((100_000, 10_000), (100, 100)):
        got = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", RANKS, small, accuracy).collect()}
        for g, n in (("one", 1), ("few", 5), ("many", 300)):
            for name, rank in RANKS.items():
                assert got[g][name] == pytest.approx(expected(np.arange(1.0, n + 1), rank)), (g, name)
