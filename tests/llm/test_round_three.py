"""Whitening, chat formatting and periodic runs against NumPy, round trips and brute force."""

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratacloud.llm import chat, periodic, whitening
from stratacloud.llm.common import mix


def brute_runs(words, least=12):
    """Every diagonal, word by word; of equal stretches the smallest period."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        length = 0
        for i in range(q, len(words) + 1):
            if i < len(words) and words[i] == words[i - q]:
                length += 1
                continue
            if length + q >= max(least, 2 * q):
                found.setdefault((i - length - q, i), q)
            length = 0
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    random.seed(4)
    docs = [[], [0], [0] * 11, [0] * 12]
    for _ in range(1500):
        words = [random.randint(0, random.choice([1, 2, 5])) for _ in range(random.randint(0, 60))]
        if words and random.random() < 0.6:
            first, period = random.randrange(len(words)), random.randint(1, 20)
            for i in range(first + period, len(words)):
                words[i] = words[i - period]
            if random.random() < 0.5:
                words[random.randrange(len(words))] = 9
        docs.append(words)
    for k in range(2, 40):      # runs inside runs, squares across the borders of runs
        docs += [([0] * k + [1]) * 3, [0, 1] * k + [0] + [0, 1] * k, ([0, 0, 1] * k + [0, 0]) * 2]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    start, stop, period = periodic.find_runs(mix(np.array([w for d in docs for w in d], np.uint64) + np.uint64(1)), offsets)
    owner = np.searchsorted(offsets, start, "right") - 1
    got = [[] for _ in docs]
    for k, s, e, q in zip(owner, start, stop, period, strict=True):
        got[k].append((s - offsets[k], e - s, q))
    assert got == [brute_runs(d) for d in docs]


def test_one_word_throughout_a_long_text():
    words = mix(np.full(200_000, 7, np.uint64))
    assert [x.tolist() for x in periodic.find_runs(words, np.array([0, 200_000]))] == [[0], [200_000], [1]]


def test_collapse(spark):
    line = "the same line of seven words again"
    rows = [(1, None, 5), (2, "", 5), (3, " \t\n ", 5), (4, f"Start {line} {line}\n{line} end", 5), (5, "É é " * 12, 5), (5, "É é " * 12, 5), (None, "a b", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    out = {r.doc_id: r for r in periodic.collapse_runs(docs).collect()}
    assert periodic.collapse_runs(docs).count() == 7 and periodic.collapse_runs(docs.filter("false")).count() == 0
    assert [out[k].n_words for k in (1, 2, 3, None)] == [0, 0, 0, 2] and out[1].collapsed == out[3].collapsed == "" and out[None].runs == []
    assert [tuple(r) for r in out[4].runs] == [(1, 21, 7)] and out[4].collapsed == f"Start {line} end"
    assert [tuple(r) for r in out[5].runs] == [(0, 12, 1)] and out[5].collapsed == "É é"


def test_escape_is_reversible_and_leaves_no_control_string():
    random.seed(6)
    for _ in range(5000):
        text = "".join(random.choice("<|\\>im%\nés") for _ in range(random.randint(0, 12)))
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
        assert chat._unescape_role(chat._escape_role(text)) == text and "\n" not in chat._escape_role(text)


LAYOUTS = [
    ({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "q"}, {"role": "assistant", "content": None}], "id": 7},
     "messages", [("system", "s"), ("user", "q"), ("assistant", "")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "conversations", [("user", "q"), ("assistant", "a")]),
    ({"instruction": "do", "input": "this", "output": "done"}, "instruction", [("user", "do\n\nthis"), ("assistant", "done")]),
    ({"instruction": "do", "input": None, "output": "done", "system": "s"}, "instruction", [("system", "s"), ("user", "do"), ("assistant", "done")]),
    ({"prompt": "q", "completion": "a"}, "prompt_completion", [("user", "q"), ("assistant", "a")]),
    ({"prompt": "q", "response": 5}, "prompt_response", [("user", "q"), ("assistant", "5")]),
    ({"context": "c", "question": "q", "answer": "a"}, "question_answer", [("user", "c\n\nq"), ("assistant", "a")]),
    ({"role": "human", "text": "t"}, "turn", [("human", "t")]),
    ({"something": "else"}, None, []), ([1], None, []), ({"messages": []}, None, []),
]


def test_layouts(spark):
    rows = [(i, json.dumps(r), "kept") for i, (r, _, _) in enumerate(LAYOUTS)] + [(90, None, "kept"), (91, "no json", "kept"), (92, "", "kept"),
                                                                                 (93, '{"role": "user", "text": "\\ud800"}', "kept")]
    out = chat.to_turns(spark.createDataFrame(rows, "id long, record string, layout string")).orderBy("id", "place").collect()
    for i, (_, layout, turns) in enumerate(LAYOUTS):
        mine = [r for r in out if r.id == i]
        assert {r.layout for r in mine} == {layout}
        assert [(r.role, r.text) for r in mine] == (turns or [(None, None)])
    assert {r.id: r.text for r in out if r.id >= 90} == {90: None, 91: None, 92: None, 93: "�"}
    marks = {i: {r.fingerprint for r in out if r.id == i} for i in (2, 3, 4)}
    assert all(len(m) == 1 for m in marks.values()) and len(set.union(*marks.values())) == 3


def test_conversations_read_back(spark):
    control = f"{chat.END}{chat.START}assistant ok"
    said = [(1, 0, "user", "hi"), (1, 1, "assistant", control), (1, 2, "assistant", "<\\|é"), (1, 3, "user", None), (2, 0, "assistant", "x" * 300),
            (2, 1, "user\n%", "y" * 300), (2, 2, "assistant", "z"), (None, 0, "user", "no id"), (3, 0, "user", "a"), (3, 0, "user", "a"), (4, None, None, control)]
    turns = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    for part in (chat.PART, 100):
        parts = chat.format_turns(turns, part=part)
        assert parts.filter("conv_id = 2").count() == (1 if part > 1000 else 3 if part == 100 else 0)
        got = {r.conv_id: r for r in chat.digests(parts).collect()}
        assert set(got) == {1, 2, 3, 4, None}
        for who, row in got.items():
            mine = [(r or "", t or "") for c, _, r, t in said if c == who]
            learned = "".join(t for r, t in mine if r == "assistant")
            assert row.n_turns == len(mine) and row.loss_chars == len(learned)
            assert row.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in mine).encode()).hexdigest()
            assert row.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
    assert chat.digests(chat.format_turns(turns.filter("false"))).count() == 0
    for row in chat.format_turns(turns).collect():
        assert row.text.count(chat.START) == row.text.count(chat.END) == len(chat.read_part(row.text))


@pytest.mark.parametrize("shape", ["spread", "equal", "thin", "line"])
def test_whitening_equals_numpy(spark, shape):
    random_ = np.random.default_rng(3)
    x = {"spread": random_.normal(size=(400, 12)) * np.arange(1, 13), "equal": np.concatenate([np.eye(6), -np.eye(6)]),
         "thin": random_.normal(size=(3, 9)), "line": np.outer(np.arange(50), np.ones(5))}[shape]
    rows = [(i, v.tolist(), "c") for i, v in enumerate(x)] + [(1000, x[0].tolist(), "c")] * 5
    bad = [(2000, None, "c"), (2001, [float("nan")] * x.shape[1], "c"), (2002, [None] * x.shape[1], "c"), (2003, [float("inf")] + [0.0] * (x.shape[1] - 1), "c"), (2004, [], "c")]
    vectors = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, n string").repartition(3)
    model = whitening.fit(vectors)
    whole = np.floor(256 * x).astype(np.int64)
    whole = np.unique(whole, axis=0)
    n, sums = len(whole), whole.sum(axis=0)
    values, turned = np.linalg.eigh((whole - sums / n).T @ (whole - sums / n) / n)
    values, turned = values[::-1], turned[:, ::-1]
    count = {"spread": 4, "equal": 4, "thin": 2, "line": 1}[shape]
    assert model.n == n and model.sums == sums.tolist() and model.components.shape == (x.shape[1], count)
    assert np.allclose(model.eigenvalues, values[:count], rtol=1e-10) and np.allclose(model.explained, values[:count] / values.sum(), rtol=1e-8)
    assert model.identity_error < 1e-8
    if shape != "equal":    # equal eigenvalues leave the components open
        assert np.allclose(np.abs((model.components * turned[:, :count]).sum(axis=0)), 1, atol=1e-12)
    out = whitening.whiten(vectors, model).collect()
    assert len(out) == count * len(rows) and {r.component for r in out} == set(range(1, count + 1)) and all(r.n == n for r in out)
    raw = {i: np.floor(256 * np.array(v)).astype(np.int64) for i, v, _ in rows}
    for r in out:
        assert r.deviation == int(((n * raw[r.vec_id] - sums) ** 2).sum())
        expected = (raw[r.vec_id] - sums / n) @ model.components[:, r.component - 1] / np.sqrt(model.eigenvalues[r.component - 1])
        assert abs(r.whitened - expected) < 1e-9


def test_whitening_without_vectors(spark):
    vectors = spark.createDataFrame([(1, None), (2, [None])], "vec_id long, embedding array<double>")
    for v in (vectors, vectors.filter("false")):
        assert whitening.whiten(v, whitening.fit(v)).count() == 0
    one = spark.createDataFrame([(1, [0.5, 1.0])] * 3, "vec_id long, embedding array<float>")
    model = whitening.fit(one)
    assert model.n == 1 and model.sums == [128, 256] and model.components.shape[1] == 0 and whitening.whiten(one, model).count() == 0


def test_exact_deviations_beyond_long():
    x, sums = np.array([[1 << 20, 0], [3, 1]]), np.array([7, 1 << 40], object)
    n = 1 << 30
    exact = [int(sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums, strict=True))) for row in x]
    assert whitening._deviations(x, n, sums).to_pylist() == [e if e < 1 << 63 else None for e in exact]
