"""Texts without base spans stay where they are; words travel as one string."""

from stratacloud.llm import disclosure

PLAIN = "some plain words without any address number {}"


def test_words_travel_as_one_string(spark):
    rows = [(1, "The quick Fox and the fox a@b.org ends"), (2, None), (3, ""), (4, "12 34")]
    texts = disclosure.occurring(disclosure.marked(spark.createDataFrame(rows, "doc_id long, text string")))
    assert dict(texts.dtypes)["_terms"] == "string"
    got = sorted(r["words"] for r in texts.select(disclosure._listed().alias("words")).collect())
    assert got == [[], [], ["the", "quick", "fox", "and", "ends"]]       # null and empty are one text


def test_texts_without_base_spans_meet_no_terms(spark):
    rows = [(i, PLAIN.format(i)) for i in range(30)] + [(100 + i, f"zorblax wrote from boss@corp.example.com w{i}") for i in range(3)] + [(200, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = disclosure.find_personal_data(docs)
    assert found.count() == len(rows)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lstrip().startswith("Union") or "Union" in plan.split("Join")[0]
    by_id = {r["doc_id"]: r for r in found.collect()}
    assert by_id[5]["sanitised"] == PLAIN.format(5) and by_id[5]["found"] == [] and by_id[200]["sanitised"] is None
    assert "[EMAIL]" in by_id[100]["sanitised"]
