"""Stages of the pipeline make arrays of about a megabyte of text at a time."""

import numpy as np
import pyarrow as pa

from stratacloud.llm import common, language, neardup


def test_slices_of_the_pipeline_are_small(monkeypatch):
    seen = []
    sets = common.shingle_sets
    monkeypatch.setattr(neardup, "shingle_sets", lambda data, offsets, size: seen.append(len(data)) or sets(data, offsets, size))

    class Docs:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            text = "some words of a text " * 100
            batch = pa.record_batch([pa.array(range(2000)), pa.array([text] * 2000), pa.array(np.zeros(2000, np.int64))], names=["doc_id", "text", "tkey"])
            return sum(b.num_rows for b in run(iter([batch])))

    monkeypatch.setattr(neardup, "F", type("F", (), {"col": staticmethod(lambda c: type("C", (), {"cast": lambda s, t: s, "alias": lambda s, n: s})()), "xxhash64": staticmethod(lambda c: type("C", (), {"alias": lambda s, n: s})())}))
    assert neardup._sketches(Docs(), 5) == 2000
    assert max(seen) <= 1 << 20 and language.SLICE <= 1 << 20
