"""Periodic runs of words, by sparse diagonals: where a text says the same again and again at one distance.

Words q apart that are equal, word after word, form a stretch of the diagonal of lag q. A stretch of L matches is a run
of L + q words with period q. Most cells of the table of words against earlier words never matter: a run of lag q needs
L >= q, so a diagonal opens only where a word and its earlier occurrence at that lag begin the same m words, m being the
largest power of two up to q, and where the words before them differ, which is where a stretch begins. An open
diagonal's match length then grows by doubled steps instead of single ones, and ends in a run or in nothing. So few
diagonals open even where one word fills a text, which has a pair of equal words for every two places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from stratacloud.llm.common import mix, slices, text_bytes, texts, word_hashes

LEAST = 12      # words of the shortest run
_CONTEXT = 4    # words that must agree for lags below twice this: a run of lag q < 8 has LEAST - q > 4 matches or more
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _places(levels: list[tuple[np.ndarray, np.ndarray]], level: int, at: np.ndarray) -> np.ndarray:
    """The names of the contexts that begin at the given words, -1 where a context occurs once only."""
    where, names = levels[level]
    found = np.minimum(np.searchsorted(where, at), len(where) - 1)
    return np.where(where[found] == at, names[found], -1)


def _contexts(words: np.ndarray, stops: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For contexts of 4, 8, 16... words: where those that occur again in their text begin, and their names.

    words differ between texts; stops holds, per word, the end of its text."""
    n = len(words) - _CONTEXT + 1
    if n < 1:
        return []
    keys = np.zeros(n, np.uint64)
    for k in range(_CONTEXT):
        keys = mix(keys + words[k:n + k])
    inside = np.flatnonzero(np.arange(n) + _CONTEXT <= stops[:n])
    levels, at, keys, size = [], inside, keys[inside], _CONTEXT
    while len(at):
        _, names, counts = np.unique(keys, return_inverse=True, return_counts=True)
        again = counts[names] > 1
        at, names = at[again], names[again]
        if not len(at):
            break
        levels.append((at, names))
        second = _places(levels, -1, at + size)
        whole = second >= 0
        keys = names[whole] * np.int64(len(words) + 1) + second[whole]
        at, size = at[whole], 2 * size
    return levels


def _openings(level: tuple[np.ndarray, np.ndarray], least: int, most: int, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (earlier, later) of words that begin one context, least to most words apart, after different words.

    Occurrences are taken from the nearest backwards; those after the same word as the later one are stepped over block
    by block, so the steps are in proportion to the pairs."""
    at, names = level
    order = np.argsort(names, kind="stable")
    at, names = at[order], names[order]
    span = np.int64(len(before) + 2 * most)
    key = names * span + at + most
    first, last = np.searchsorted(key, key - most), np.searchsorted(key, key - least, "right")
    prior = before[at]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (names[1:] != names[:-1]) | (prior[1:] != prior[:-1])
    block = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    later = np.flatnonzero(last > first)
    now = last[later] - 1
    pairs = [(now[:0], now[:0])]
    while len(later):
        same = prior[now] == prior[later]
        pairs.append((at[now[~same]], at[later[~same]]))
        now = np.where(same, block[now] - 1, now - 1)
        open_ = now >= first[later]
        now, later = now[open_], later[open_]
    return np.concatenate([p for p, _ in pairs]), np.concatenate([p for _, p in pairs])


def _match_lengths(levels: list, words: np.ndarray, stops: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many words from left on equal those from right on, within the text."""
    length = np.zeros(len(left), np.int64)
    for level in reversed(range(len(levels))):
        a, b = _places(levels, level, left + length), _places(levels, level, right + length)
        length += np.where((a == b) & (a >= 0), _CONTEXT << level, 0)
    for _ in range(_CONTEXT - 1):
        there = right + length
        inside = there < stops[right]
        equal = words[np.where(inside, left + length, 0)] == words[np.where(inside, there, 0)]
        length += inside & equal
    return length


def find_runs(words: np.ndarray, offsets: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs of several texts: first word, end and period of each, by first word and period.

    words holds the texts' word hashes end to end, offsets the n + 1 borders. A run is a longest stretch with smallest
    period q of at least max(least, 2 q) words; least is 12 or more."""
    sizes = np.diff(offsets)
    text = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
    words = mix(words + mix(text + np.uint64(1)))           # equal words of different texts differ
    stops = np.repeat(offsets[1:], sizes)
    before = np.empty_like(words)
    before[1:] = words[:-1]
    heads = offsets[:-1][sizes > 0]
    before[heads] = mix(words[heads] + heads.astype(np.uint64) + np.uint64(7))  # no word stands before a text
    levels = _contexts(words, stops)
    lefts, rights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for number, level in enumerate(levels):
        size = _CONTEXT << number
        left, right = _openings(level, 1 if number == 0 else size, 2 * size - 1, before)
        lefts.append(left)
        rights.append(right)
    left, right = np.concatenate(lefts), np.concatenate(rights)
    if not len(left):
        return left, left, left
    period = right - left
    stop = right + _match_lengths(levels, words, stops, left, right)
    enough = stop - left >= np.maximum(least, 2 * period)
    left, stop, period = left[enough], stop[enough], period[enough]
    order = np.lexsort((period, stop, left))
    left, stop, period = left[order], stop[order], period[order]
    smallest = np.ones(len(left), bool)     # of one stretch the others are multiples of the smallest period
    smallest[1:] = (left[1:] != left[:-1]) | (stop[1:] != stop[:-1])
    left, stop, period = left[smallest], stop[smallest], period[smallest]
    order = np.lexsort((period, left))
    return left[order], stop[order], period[order]


def collapse_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs with n_words, runs (array of start, length, period in words, by start and period) and collapsed added: the
    text's words, joined by one space, without those that some run repeats (those after its first period words).

    Words are maximal stretches without space and \\x09-\\x0D, compared byte by byte. Null and empty texts have no words
    and collapse to an empty text. Columns of the added names are replaced, all others kept; repeated rows get equal
    answers; an empty table gives an empty one. No rows move; memory is in proportion to the longest text."""
    columns = [c for c in docs.columns if c not in ("n_words", "runs", "collapsed")]
    schema = docs.select(columns).schema.add("n_words", "long").add(
        "runs", T.ArrayType(T.StructType().add("start", "long").add("length", "long").add("period", "long"))).add("collapsed", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = text_bytes(batch)
            hashes, counts = word_hashes(data, offsets, lower=False)
            start, stop, period = find_runs(hashes, counts, least)
            repeated = np.zeros(len(hashes) + 1, np.int64)
            np.add.at(repeated, start + period, 1)
            np.add.at(repeated, stop, -1)
            kept = np.cumsum(repeated)[:-1] == 0
            owner = np.searchsorted(counts, start, "right") - 1
            borders = np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32)
            runs = pa.ListArray.from_arrays(borders, pa.StructArray.from_arrays(
                [pa.array(start - counts[owner]), pa.array(stop - start), pa.array(period)], ["start", "length", "period"]))
            collapsed = []
            for i, text in enumerate(texts(batch)):
                words = text.encode().split()
                if borders[i + 1] > borders[i]:
                    words = [words[k] for k in np.flatnonzero(kept[counts[i]:counts[i + 1]])]
                collapsed.append(b" ".join(words).decode())
            yield pa.record_batch([*(batch.column(c) for c in columns), pa.array(np.diff(counts).astype(np.int64)), runs.cast(RUNS),
                                   pa.array(collapsed, pa.string())], names=[*columns, "n_words", "runs", "collapsed"])

    return docs.select(columns).mapInArrow(run, schema)
