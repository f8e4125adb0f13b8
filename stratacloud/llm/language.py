"""Language of whole texts: known words first, then shorter and shorter character n-grams.

The model holds, per language, log frequencies of the commonest words and of character n-grams (1 to 5 characters) of
all words, counted by Spark over a bounded sample of the labelled documents. A text's words add up; a word the model
does not know is scored by the longest n-grams of it that it does know, at a fixed cost per step down.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratacloud.llm.common import mix, slices, texts, word_powers, written

UNKNOWN = "und"
TRAIN_DOCS = 3_000      # labelled documents per language that the model is fitted on, about
WORDS = 50_000          # words in the model; also the bound of its n-grams
LONGEST = 5
STEP_COST = 0.4         # stupid back-off: weight of a word for each step to shorter n-grams
REST = 0.5              # count of what a language was never seen with
SLICE = 1 << 20         # bytes of text whose words are arrays at a time, but for longer texts
_MOST_UNKNOWN = 200_000  # scores of unknown words that a task keeps


@dataclass
class Model:
    """languages, and log frequencies per word and n-gram as arrays over languages."""
    languages: list[str]
    words: dict[str, np.ndarray]
    grams: dict[str, np.ndarray]

    def unseen(self, word: str) -> np.ndarray:
        """Scores of a word that is not in the model."""
        padded, cost = f"<{word}>", 0.0
        for size in range(min(LONGEST, len(padded)), 0, -1):
            found = [self.grams[g] for i in range(len(padded) - size + 1) if (g := padded[i:i + size]) in self.grams]
            if found:
                return np.mean(found, axis=0) * STEP_COST ** cost
            cost += 1
        return np.zeros(len(self.languages))


class _Table:
    """Score rows by word hash: those of the model, sorted by hash, and those of unknown words, scored on first sight."""

    def __init__(self, model: Model):
        self.model = model
        starts, stops, points = _words([*model.words])
        hashes = _hashes(points, starts, stops)     # one per word: a word of the model is all letters
        order = np.argsort(hashes)
        self.hashes, self.matrix = hashes[order], np.array([*model.words.values()]).reshape(len(model.words), len(model.languages))[order]
        self.unknown: dict[int, np.ndarray] = {}

    def scores(self, points: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """One row of scores per word, given where words begin and end among code points."""
        hashes = _hashes(points, starts, stops)
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        known = self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        out = np.empty((len(hashes), len(self.model.languages)))
        out[known] = self.matrix[at[known]]
        rest = np.flatnonzero(~known)
        each, first, again = np.unique(hashes[rest], return_index=True, return_inverse=True)
        if len(self.unknown) > _MOST_UNKNOWN:
            self.unknown.clear()
        rows = np.empty((len(each), len(self.model.languages)))
        for k, (h, word) in enumerate(zip(each.tolist(), rest[first].tolist(), strict=True)):
            if h not in self.unknown:
                self.unknown[h] = self.model.unseen(points[starts[word]:stops[word]].tobytes().decode("utf-32-le"))
            rows[k] = self.unknown[h]
        out[rest] = rows[again]
        return out


_LETTER: list[np.ndarray] = []


def _words(lowered: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words, runs of letters, begin and end among the code points of all texts, each text followed by a line feed;
    and the code points."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(k).isalpha() for k in range(0x110000)), bool, 0x110000))
    points = np.frombuffer("".join(t + "\n" for t in lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _LETTER[0][points]
    edges = np.flatnonzero(np.diff(letter, prepend=False))      # the last code point is no letter, so words end
    return edges[::2], edges[1::2], points


def _hashes(points: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hashes of words by their letters."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = stops - starts
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    place = np.arange(bounds[-1]) - np.repeat(bounds[:-1], lengths)
    values = word_powers(int(lengths.max()))[place] * (points[place + np.repeat(starts, lengths)].astype(np.uint64) + np.uint64(1))
    return mix(np.add.reduceat(values, bounds[:-1]))


def learn(docs: DataFrame, train_docs: int = TRAIN_DOCS, words: int = WORDS) -> Model:
    """The model of labelled documents (doc_id, text, lang); rows without text or lang are left out.

    Per language about train_docs documents are taken, those whose hashed id falls under the language's share. Counts
    are made by Spark; what reaches the driver is at most words rows of words and as many of n-grams."""
    labelled = docs.filter("lang IS NOT NULL AND text IS NOT NULL")
    shares = labelled.groupBy("lang").agg((F.lit(float(train_docs)) / F.count("*")).alias("share"))
    taken = (labelled.select("doc_id", "text", "lang").join(F.broadcast(shares), "lang")   # one row per language
             .filter(F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1_000_000)) < F.col("share") * 1_000_000))
    words_of = F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))
    counts = written(taken.select("lang", F.explode(words_of).alias("key")).groupBy("lang", "key").agg(F.count("*").alias("c")),
                     "word-counts")
    padded = F.concat(F.lit("<"), F.col("key"), F.lit(">"))
    grams = counts.select("lang", "c", F.explode(F.flatten(F.array(*[_grams(padded, n) for n in range(1, LONGEST + 1)]))).alias("key"))
    grams = grams.groupBy("lang", "key").agg(F.sum("c").alias("c"))
    languages = sorted(r.lang for r in shares.select("lang").collect())
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("c").alias("n")).collect()}

    def table(frame: DataFrame, least: int) -> dict[str, np.ndarray]:
        common = (frame.groupBy("key").agg(F.sum("c").alias("n"), F.map_from_entries(F.collect_list(F.struct("lang", "c"))).alias("by"))
                  .filter(F.col("n") >= least).orderBy(F.desc("n"), "key").limit(words))
        size = np.array([totals.get(x, 0) + REST * words for x in languages])
        return {r.key: np.log((np.array([r.by.get(x, 0) for x in languages]) + REST) / size) for r in common.collect()}

    return Model(languages, table(counts, 2), table(grams, 3))


def _grams(word: Column, size: int) -> Column:
    last = F.length(word) - size + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(word, i, F.lit(size)))
                  ).otherwise(F.array().cast("array<string>"))


def predict(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with lang_pred and score (posterior of the best language, 0 to 1) added, under the given names; columns of
    these names are replaced.

    lang_pred is und with score 0 where text is null or has no letter (Unicode category L), or the model knows no
    language. Equal scores go to the language first in order. The whole text counts; repeated rows get equal answers; an
    empty table gives an empty one."""
    columns = [c for c in docs.columns if c not in names]
    schema = docs.select(columns).schema.add(names[0], "string").add(names[1], "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, languages = _Table(model), np.array([*model.languages, UNKNOWN], object)
        for batch in slices(batches, SLICE):
            lowered = [t.lower() for t in texts(batch)]
            ends = np.cumsum([len(t) + 1 for t in lowered])
            best, score = np.full(len(lowered), len(model.languages)), np.zeros(len(lowered))
            starts, stops, points = _words(lowered)
            if len(starts) and model.languages:
                bounds = np.searchsorted(starts, np.concatenate([[0], ends]))
                some = np.flatnonzero(np.diff(bounds))
                total = np.add.reduceat(table.scores(points, starts, stops), bounds[some], axis=0)
                odds = np.exp(total - total.max(axis=1, keepdims=True))
                best[some], score[some] = odds.argmax(axis=1), odds.max(axis=1) / odds.sum(axis=1)
            yield pa.record_batch([*(batch.column(c) for c in columns), pa.array(languages[best], pa.string()), pa.array(score)],
                                  names=[*columns, *names])

    return docs.select(columns).mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """docs whose language is known with score of at least least; its columns stay as they are, whatever their names."""
    mark = "_"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    found = predict(docs, model, (f"{mark}lang", f"{mark}score"))
    return found.filter((F.col(f"{mark}lang") != UNKNOWN) & (F.col(f"{mark}score") >= least)).select(docs.columns)
