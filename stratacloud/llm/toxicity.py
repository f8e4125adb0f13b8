"""Toxicity of whole texts: word vectors from bags of subwords, averaged over windows, into a linear softmax.

A word's vector is the mean of its vectors per character n-gram (3 to 5 bytes, with marks at both ends) and of the
word itself, all hashed into one table; the vector of a window of words is the mean of its words' vectors; two classes
get a linear score of it, and a text is as toxic as its worst window, so a long text doesn't dilute what a part says. Vectors and scores are trained jointly in NumPy on a bounded sample of labelled texts. A misspelt word
shares most n-grams with its model, so it scores alike. Since everything up to the softmax is linear, scoring needs one
number per n-gram: texts are scored as arrays of bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacloud.llm.common import mix, slices, text_bytes

TRAIN_TEXTS = {0: 4_000, 1: 1_500}      # labelled texts of each class that the model is fitted on, about
RARE = 3                    # n-grams of fewer training texts keep no weight
TRAIN_BYTES = 3_000         # texts for training are no longer than this; scoring takes texts of any length
BUCKETS, WIDTH = 1 << 17, 4
SIZES = (3, 4, 5)
WINDOW = 64                 # words
PART = 1 << 19              # bytes of text whose n-grams are in memory at a time, but for longer texts
ROUNDS, RATE, SCALE = 12, 0.02, 300.0


@dataclass
class Model:
    """One number per n-gram bucket: a window's score is the mean over its words of the mean over a word's n-grams; the
    log odds of class 1 are scale times the highest window's score, plus bias."""
    weights: np.ndarray
    scale: float
    bias: float


def subwords(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts' bytes: bucket and word number of every n-gram, and the n + 1 offsets between the texts' words.

    Words are runs of letters, digits and bytes above 127, A-Z in lower case."""
    lower = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    letter = ((lower >= 97) & (lower <= 122)) | ((lower >= 48) & (lower <= 57)) | (lower >= 128)
    # a blank stands before each text, so that words don't join and every word has a mark at both ends
    n, total = len(offsets) - 1, len(data)
    shift = np.repeat(np.arange(1, n + 1), np.diff(offsets))
    padded = np.zeros(total + n + 1, np.uint32)
    padded[np.arange(total) + shift] = np.where(letter, lower, 0)
    inside = padded > 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    starts = np.flatnonzero(begins)
    counts = np.searchsorted(starts, offsets + np.arange(n + 1))
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), counts
    number = np.cumsum(begins) - 1
    buckets, owners = [], []
    rolled, middle = padded.astype(np.uint64), None
    for size in range(2, max(SIZES) + 1):
        rolled = rolled[:-1] * np.uint64(0x01000193) + padded[size - 1:]
        if size >= 3:
            middle = inside[1:1 - size + 1] if middle is None else middle[:-1] & inside[size - 2:-1]
        if size in SIZES:
            at = np.flatnonzero(middle)
            buckets.append((mix(rolled[at] + np.uint64(size)) & np.uint64(BUCKETS - 1)).astype(np.int64))
            owners.append(number[at + 1])
    place = np.arange(len(padded)) - starts[np.maximum(number, 0)]
    values = np.where(inside, mix(padded.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(8))), np.uint64(0))
    buckets.append((mix(np.add.reduceat(values, starts)) & np.uint64(BUCKETS - 1)).astype(np.int64))
    owners.append(np.arange(len(starts)))
    return np.concatenate(buckets), np.concatenate(owners), counts


def _windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each text's windows of WINDOW words begin (a text without words has one empty window), and the n + 1 offsets
    between the texts' windows."""
    words = np.diff(counts)
    each = np.maximum(1, -(-words // WINDOW))
    bounds = np.concatenate([[0], np.cumsum(each)])
    place = np.arange(bounds[-1]) - np.repeat(bounds[:-1], each)
    return np.repeat(counts[:-1], each) + place * WINDOW, bounds


def fit(texts: list[str], labels: list[int], seed: int = 5) -> Model:
    """Joint training of n-gram vectors and the linear scores over the texts' windows, one Adam step a part; then a
    logistic fit of the labels on the texts' highest window gives scale and bias of a text's score.

    Without texts of both classes the model always gives the share of class 1 (0 if there are none)."""
    y = np.asarray(labels, float)
    if not 0 < y.sum() < len(y):
        return Model(np.zeros(BUCKETS), 1.0, 30.0 if len(y) and y.all() else -30.0)
    order = np.random.default_rng(seed).permutation(len(y))     # every part holds both classes, about
    y, raw = y[order], [texts[i].encode() for i in order]
    windows, each, parts = 0, [], []
    for buckets, owners, counts in _parts(raw):
        starts, bounds = _windows(counts)
        words = int(counts[-1])
        window_of = np.searchsorted(starts, np.arange(words), "right") - 1
        size = np.maximum(np.bincount(window_of, minlength=len(starts)), 1)
        per_word = np.maximum(np.bincount(owners, minlength=words), 1)
        # an n-gram's share in its window's vector; equal (window, n-gram) pairs are joined
        pair, at = np.unique(window_of[owners] * BUCKETS + buckets, return_inverse=True)
        share = np.bincount(at, weights=1 / (per_word[owners] * size[window_of[owners]]), minlength=len(pair))
        parts.append((windows, len(starts), (pair // BUCKETS).astype(np.int32), (pair % BUCKETS).astype(np.int32), share.astype(np.float32)))
        windows += len(starts)
        each.append(np.diff(bounds))
    each = np.concatenate(each)
    label = np.repeat(y, each)
    seen = sum(np.bincount(bucket, minlength=BUCKETS) for _, _, _, bucket, _ in parts)
    used = np.flatnonzero(seen >= RARE)
    weights = np.zeros(BUCKETS)
    if len(used):
        number = np.full(BUCKETS, -1, np.int32)
        number[used] = np.arange(len(used))
        for i, (offset, size, row, bucket, share) in enumerate(parts):
            common = seen[bucket] >= RARE
            parts[i] = (offset, size, row[common], number[bucket[common]], share[common])
        weight = (np.where(label == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())) / np.repeat(each, each)).astype(np.float32)
        weights[used] = _train(parts, len(used), label, weight, seed)
    model = Model(weights, 1.0, 0.0)
    highest = np.concatenate([_highest(model, *part) for part in _parts(raw)])
    spread = max(float(highest.std()), 1e-9)
    x, theta = np.stack([highest / spread, np.ones(len(y))], axis=1), np.zeros(2)
    for _ in range(30):     # Newton steps, a little ridge keeps separable labels finite
        odds = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        curve = (x * (odds * (1 - odds))[:, None]).T @ x + 1e-3 * len(y) * np.eye(2)
        theta -= np.linalg.solve(curve, x.T @ (odds - y) + 1e-3 * len(y) * theta)
    return Model(weights, float(theta[0] / spread), float(theta[1]))


def _train(parts: list[tuple], used: int, label: np.ndarray, weight: np.ndarray, seed: int) -> np.ndarray:
    """The difference of the two classes' scores of each of used n-grams. A part holds the number of windows before it,
    its own number of windows, and per pair the window in the part, the n-gram and its share."""
    random = np.random.default_rng(seed)
    table = random.normal(0, 0.1, (WIDTH, used)).astype(np.float32)
    linear, bias = random.normal(0, 1, (WIDTH, 2)).astype(np.float32), np.zeros(2, np.float32)
    target = np.stack([1 - label, label], axis=1).astype(np.float32)
    scale = np.float32(SCALE)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (table, linear, bias)]
    step = 0
    for left in range(ROUNDS, 0, -1):
        for offset, size, row, column, share in parts:
            mine, step = slice(offset, offset + size), step + 1
            vectors = np.stack([np.bincount(row, table[k][column] * share, size) for k in range(WIDTH)], axis=1).astype(np.float32) * scale
            logits = vectors @ linear + bias
            odds = np.exp(logits - logits.max(axis=1, keepdims=True))
            odds /= odds.sum(axis=1, keepdims=True)
            error = (odds - target[mine]) * (weight[mine, None] / weight[mine].sum())
            back = linear @ error.T * scale
            into = np.stack([np.bincount(column, back[k][row] * share, used) for k in range(WIDTH)])
            for p, g, s in zip((table, linear, bias), (into, vectors.T @ error + 1e-4 * linear, error.sum(axis=0)), state, strict=True):
                s[0] = 0.9 * s[0] + 0.1 * g
                s[1] = 0.99 * s[1] + 0.01 * g * g
                move = (s[0] / (1 - 0.9 ** step)) / (np.sqrt(s[1] / (1 - 0.99 ** step)) + np.float32(1e-7))
                p -= (RATE * left / ROUNDS * move).astype(np.float32)
    return (linear[:, 1] - linear[:, 0]) @ table * scale


def _parts(raw: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """subwords of runs of texts of about PART bytes each: arrays as large as one run, not as all texts."""
    ends = np.cumsum([len(r) for r in raw])
    first = 0
    while first < len(raw):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + PART, "right")))
        run = raw[first:last]
        yield subwords(np.frombuffer(b"".join(run), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in run])]))
        first = last


def _highest(model: Model, buckets: np.ndarray, owners: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per text the highest mean of word scores over its windows; 0 without words."""
    words = int(counts[-1])
    sums = np.bincount(owners, weights=model.weights[buckets], minlength=words) / np.maximum(np.bincount(owners, minlength=words), 1)
    running = np.concatenate([[0.0], np.cumsum(sums)])
    starts, bounds = _windows(counts)
    ends = np.minimum(starts + WINDOW, np.repeat(counts[1:], np.diff(bounds)))
    means = (running[ends] - running[starts]) / np.maximum(ends - starts, 1)
    return np.maximum.reduceat(means, bounds[:-1]) if len(means) else np.zeros(0)


def learn(docs: DataFrame, labels: DataFrame, train_texts: dict[int, int] | None = None, train_bytes: int = TRAIN_BYTES) -> Model:
    """The model of docs (doc_id, text) with labels (doc_id, toxic 0 or 1); rows without text or label are left out. About
    train_texts texts of each class, chosen by hashed id, of at most train_bytes bytes reach the driver: 18 MB."""
    labelled = (docs.select("doc_id", "text").filter(f"octet_length(text) <= {train_bytes}")
                .join(labels.filter("toxic IN (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic")), "doc_id"))
    sizes = {r.toxic: r.n for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    most = train_texts or TRAIN_TEXTS
    share = F.when(F.col("toxic") == 1, F.lit(most[1] / max(1, sizes.get(1, 0)))).otherwise(F.lit(most[0] / max(1, sizes.get(0, 0))))
    rows = labelled.filter(F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1_000_000)) < share * 1_000_000).collect()
    rows.sort(key=lambda r: (r.doc_id, r.text))
    return fit([r.text for r in rows], [r.toxic for r in rows])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (0 to 1, higher: class 1 likelier) and predicted (1 if score >= 0.5) added; columns of these names
    are replaced. A null, empty or wordless text gets the score of the bias alone. The whole text counts."""
    columns = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = docs.select(columns).schema.add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, PART):
            highest = _highest(model, *subwords(*text_bytes(batch)))
            odds = 1 / (1 + np.exp(-np.clip(model.scale * highest + model.bias, -50, 50)))
            yield pa.record_batch([*(batch.column(c) for c in columns), pa.array(odds, pa.float64()), pa.array((odds >= 0.5).astype(np.int32))],
                                  names=[*columns, "score", "predicted"])

    return docs.select(columns).mapInArrow(run, schema)
