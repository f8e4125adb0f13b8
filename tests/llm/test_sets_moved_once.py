"""Sets are moved once their place is known."""

from stratacloud.llm import neardup


def test_sets_are_joined_once_their_place_is_known(spark, monkeypatch):
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(words[:39] + [f"x{i % 3}"])) for i in range(9)] + [(50, "all other words stand in this text alone")]
    plans = {}
    written = neardup.written

    def kept(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return written(df, name)

    monkeypatch.setattr(neardup, "written", kept)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {**dict.fromkeys(range(9), 0), 50: 50}
    assert plans["clustered-sets"].count("Join") == 1
