"""Benchmark decontamination by edit distance: an embedding into Hamming space, bit sampling, exact verification.

The CGK embedding reads a string by a random walk: at step j it writes the character under its pointer and moves on by
a random bit of (j, character). Two strings within a small edit distance fall into step again after each edit, so their
walks agree at most steps. Sampling a few steps of the walk gives a key that near strings share with good odds;
repetitions with other bits and steps raise the odds to the target recall.

Windows of an item's size are tried where a walk may start: at anchors, words whose hash is smallest among the few
around them, so a passage and its source choose the same places. An item gives a key for every anchor whose walk stays
inside it; a document gives one for every anchor it has. Where keys meet, the item-sized window that puts the two
anchors over each other, widened by the edits allowed, goes to an exact edit distance (item against the best substring).

Items with few anchors (short ones, and texts without blanks) are looked for by pieces as well: an item cut into one
piece more than the edits expected keeps one of them unchanged, so every place of a document where eight bytes of a
piece stand is a candidate too. That route is exact up to those edits.

Characters are compared in lower case, any white space as a blank; everything runs inside one scan of the documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacloud.llm.common import mix, slices, text_bytes

STEPS = 72              # of a walk: some 36 bytes of text
SAMPLES = 10            # steps a key holds
HALF_WAY = 6            # samples after which a walk is given up if no item's walk has its half key
AROUND = 1              # an anchor's hash is smallest among the words up to so many before and after
MIN_BYTES = 48          # items shorter than this match with the edits expected only: common phrases would match them
ENOUGH = 12             # anchors; items with fewer are looked for by pieces as well
PIECE = 8               # bytes of a piece that are looked up
ITEMS_AT_ONCE = 20_000  # items held by a task; more are searched in further scans
BYTES_AT_ONCE = 64 << 20


def repetitions(recall: float, rate: float) -> int:
    """Repetitions that reach recall for the shortest items, with rate edits per byte: a walk reads STEPS / 2 bytes, an
    edit makes about three of its steps differ, and two anchors of an item count; ENOUGH are there."""
    agree = max(0.0, 1 - 3 * rate / 2) ** SAMPLES
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - max(agree, 1e-3)) / 2))


def plain(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case and white space as blanks; as many bytes as before."""
    out = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    return np.where((out == 32) | ((out >= 9) & (out <= 13)), np.uint8(32), out)


def anchors(data: np.ndarray, offsets: np.ndarray, whole: bool) -> np.ndarray:
    """Places of words whose hash is smallest among those up to AROUND before and after, of each text. With whole, words
    near an end of a text, whose neighbours are not all there, are not chosen; without, missing neighbours do not count."""
    begins = data != 32
    begins[1:] &= data[:-1] == 32
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begins[edges] = data[edges] != 32
    starts = np.flatnonzero(begins)
    if not len(starts):
        return starts
    text = np.searchsorted(offsets, starts, "right")
    # a word counts with its first four bytes and its text's end does not shift it
    padded = np.append(data, np.full(4, 32, np.uint8)).astype(np.uint64)
    key = np.zeros(len(starts), np.uint64)
    inside = np.ones(len(starts), bool)
    for k in range(4):
        byte = padded[starts + k]
        inside &= byte != 32
        key = key * np.uint64(257) + np.where(inside, byte, np.uint64(0))
    key = mix(key)
    chosen = np.ones(len(starts), bool)
    for gap in range(1, AROUND + 1):
        same = text[gap:] == text[:-gap]
        chosen[gap:] &= np.where(same, key[gap:] <= key[:-gap], not whole)
        chosen[:-gap] &= np.where(same, key[:-gap] <= key[gap:], not whole)
        if whole:
            chosen[:gap] = chosen[len(chosen) - gap:] = False
    return starts[chosen]


class Walks:
    """The random bits and sampled steps of each repetition, fixed by a seed."""

    def __init__(self, count: int, seed: int = 11):
        random = np.random.default_rng(seed)
        self.bits = random.integers(0, 2, (count, STEPS, 256), dtype=np.uint8)
        self.steps = [np.sort(random.choice(STEPS, SAMPLES, replace=False)) for _ in range(count)]

    def keys(self, padded: np.ndarray, starts: np.ndarray, r: int, early: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """Of repetition r: the keys of the walks from starts over padded bytes, the places where they end, the rows they
        belong to, and all keys as they stand after HALF_WAY samples. With early (a table of the low bits of such
        half-way keys), walks it does not hold are given up there."""
        at, rows = starts.astype(np.int64), np.arange(len(starts))
        key, half, taken = np.zeros(len(starts), np.uint64), None, 0
        for j in range(int(self.steps[r][-1]) + 1):
            byte = padded[at]
            if j == self.steps[r][taken]:
                key = key * np.uint64(0x100000001B3) + byte + np.uint64(1)
                taken += 1
                if taken == HALF_WAY:
                    half = mix(key)
                    if early is not None:
                        live = early[half & np.uint64(len(early) - 1)]
                        at, rows, key, byte = at[live], rows[live], key[live], byte[live]
            at = at + self.bits[r, j][byte]
        return mix(key), at, rows, half


def best_match(item: bytes, window: bytes) -> tuple[int, int]:
    """Smallest edit distance of item to any substring of window, and where the first such substring ends: columns of
    the distance table as bit vectors in integers (Myers)."""
    size, ones = len(item), (1 << len(item)) - 1
    masks: dict[int, int] = {}
    for i, byte in enumerate(item):
        masks[byte] = masks.get(byte, 0) | 1 << i
    up, down, score = ones, 0, size
    best, end, top = size, 0, 1 << (size - 1)
    for place, byte in enumerate(window):
        match = masks.get(byte, 0)
        across = (((match & up) + up) ^ up) | match | down
        plus, minus = down | ~(across | up) & ones, up & across
        score += bool(plus & top) - bool(minus & top)
        plus, minus = plus << 1 & ones, minus << 1 & ones
        vertical = match | down
        up, down = minus | ~(vertical | plus) & ones, plus & vertical
        if score < best:
            best, end = score, place + 1
    return best, end


def pairs_of_bytes(data: np.ndarray) -> np.ndarray:
    """How often each pair of neighbouring bytes occurs, as an array of 65,536 counts."""
    return np.bincount(data[:-1].astype(np.int64) << 8 | data[1:], minlength=1 << 16)


def windows(data: np.ndarray, width: int) -> np.ndarray:
    """The width (at most 8) bytes from each place on as one number, beyond the end as zeros."""
    padded = np.append(data, np.zeros(width, np.uint8))
    out = np.zeros(len(data), np.uint64)
    for k in range(width):
        out |= padded[k:k + len(data)].astype(np.uint64) << np.uint64(8 * k)
    return out


class _Pieces:
    """Pieces of items, by the width of what is looked up of them."""

    def __init__(self, texts: list[np.ndarray], wanted: np.ndarray, edits: float):
        rows: dict[int, list[tuple[int, int, int, int, int]]] = {}
        for item in np.flatnonzero(wanted).tolist():
            text = texts[item]
            cuts = np.linspace(0, len(text), int(edits * len(text)) + 2).astype(int).tolist()
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                width = min(PIECE, b - a)
                head, tail = (int.from_bytes(text[x:x + width].tobytes(), "little") for x in (a, b - width))
                rows.setdefault(width, []).append((head, tail, item, a, b - a))
        self.tables = {}
        for width, held in rows.items():
            held.sort()
            head, tail, item, shift, length = zip(*held, strict=True)
            head, early = np.asarray(head, np.uint64), np.zeros(1 << 20, bool)
            early[mix(head) & np.uint64(len(early) - 1)] = True
            self.tables[width] = head, np.asarray(tail, np.uint64), *(np.asarray(c, np.int64) for c in (item, shift, length)), early

    def candidates(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Rows (text, item, place in data where the item would begin)."""
        found = []
        for width, (head, tail, item, shift, length, early) in self.tables.items():
            keys = windows(data, width)
            starts = np.flatnonzero(early[mix(keys) & np.uint64(len(early) - 1)])
            low, high = np.searchsorted(head, keys[starts], "left"), np.searchsorted(head, keys[starts], "right")
            times = high - low
            place = np.repeat(starts, times)
            slot = np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())
            text = np.searchsorted(offsets, place, "right") - 1
            inside = place + length[slot] <= offsets[text + 1]
            place, slot, text = place[inside], slot[inside], text[inside]
            same = keys[place + length[slot] - width] == tail[slot]
            found.append(np.stack([text[same], item[slot][same], (place - shift[slot])[same]], axis=1))
        return found


class _Items:
    """The benchmark items one task looks for, with their keys."""

    def __init__(self, items: list[tuple[int, str]], walks: Walks, rate: float, edits: float):
        self.ids = [i for i, _ in items]
        self.texts = [plain(np.frombuffer((t or "").encode(), np.uint8)) for _, t in items]
        self.pairs = [(p := np.flatnonzero(c := pairs_of_bytes(t)), c[p]) for t in self.texts]
        data = np.concatenate([np.zeros(0, np.uint8), *self.texts])
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in self.texts])]).astype(np.int64)
        starts = anchors(data, offsets, whole=True)
        item = np.searchsorted(offsets, starts, "right") - 1
        padded = np.append(data, np.full(STEPS + 1, 32, np.uint8))
        self.most = [int((rate if len(t) >= MIN_BYTES else edits) * len(t)) for t in self.texts]
        self.slack = np.asarray([16 if len(t) >= MIN_BYTES else 0 for t in self.texts], np.int64)
        self.tables, self.early, kept = [], [], np.zeros(len(items), np.int64)
        for r in range(len(walks.steps)):
            keys, ends, _, half = walks.keys(padded, starts, r)
            inside = ends <= offsets[item + 1]
            kept = np.maximum(kept, np.bincount(item[inside], minlength=len(items)))
            order = np.argsort(keys[inside], kind="stable")
            self.tables.append((keys[inside][order], item[inside][order], (starts - offsets[item])[inside][order]))
            early = np.zeros(1 << 20, bool)
            early[half[inside] & np.uint64(len(early) - 1)] = True
            self.early.append(early)
        filled = np.asarray([bool((t != 32).any()) for t in self.texts], bool)
        self.pieces = _Pieces(self.texts, filled & (kept < ENOUGH), edits)

    def candidates(self, data: np.ndarray, offsets: np.ndarray, walks: Walks) -> np.ndarray:
        """Rows (text, item, place in data where the item would begin), distinct places, for long items in steps of 16 bytes."""
        starts = anchors(data, offsets, whole=False)
        padded = np.append(data, np.full(STEPS + 1, 32, np.uint8))
        found = self.pieces.candidates(data, offsets)
        for r, (table, item, shift) in enumerate(self.tables):
            keys, _, rows, _ = walks.keys(padded, starts, r, self.early[r])
            low, high = np.searchsorted(table, keys, "left"), np.searchsorted(table, keys, "right")
            rows, low, times = rows[high > low], low[high > low], (high - low)[high > low]
            slot = np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())
            place = np.repeat(starts[rows], times)
            found.append(np.stack([np.searchsorted(offsets, place, "right") - 1, item[slot], place - shift[slot]], axis=1))
        rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        if not len(rows):
            return rows
        _, first = np.unique(np.column_stack([rows[:, :2], rows[:, 2] // np.maximum(self.slack[rows[:, 1]], 1)]), axis=0, return_index=True)
        return rows[first]


def find_contamination(docs: DataFrame, items: DataFrame, rate: float = 0.2, recall: float = 0.99,
                       edits: float = 0.08) -> DataFrame:
    """Passages of docs (doc_id, text) within edit distance rate * length of an item of items (item_id, text); of an item
    under MIN_BYTES bytes within edits * length, and if that is no edit at all, copies that no letter or digit adjoins.
    Passages with edits edits per byte are found with odds of recall at least, in items with fewer than ENOUGH anchors
    always; more edits lower the odds, fewer raise them.

    One row per document row, item and place: doc_id, item_id, start, end (code points of the text, end exclusive),
    distance (bytes), similarity (1 - distance / item's bytes). Matches of one item that overlap give the best, then
    the first. Null, empty or blank texts and items match nothing; items with the same text all match; repeated document rows each give their rows. Other columns are ignored.
    """
    held = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("octet_length(text) > 0")
    walks = Walks(repetitions(recall, edits))
    out = None
    for block in _blocks(held):
        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
            _search(block, walks, rate, edits), "doc_id long, item_id long, start long, end long, distance long, similarity double")
        out = part if out is None else out.unionByName(part)
    return out


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks that a task can hold; an empty block if there are none."""
    block, size, any_yet = [], 0, False
    for row in items.toLocalIterator():
        if block and (len(block) >= ITEMS_AT_ONCE or size + len(row.text) > BYTES_AT_ONCE):
            yield block
            block, size, any_yet = [], 0, True
        block.append((row.item_id, row.text))
        size += len(row.text)
    if block or not any_yet:
        yield block


def _adjoined(data: np.ndarray, first: int, last: int, a: int, b: int) -> bool:
    """Whether a letter or digit of the text data[first:last] stands right before a or right after b."""
    beside = [data[x] for x in (a - 1, b) if first <= x < last]
    return any(x >= 128 or chr(x).isalnum() for x in beside)


def _search(block: list[tuple[int, str]], walks: Walks, rate: float, edits: float):
    names = ["doc_id", "item_id", "start", "end", "distance", "similarity"]
    types = [*[pa.int64()] * 5, pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _Items(block, walks, rate, edits)
        for batch in slices(batches, 1 << 20):
            data, offsets = text_bytes(batch)
            data = plain(data)
            rows, ids = [], batch.column("doc_id").to_pylist()
            hits: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
            for text, item, place in items.candidates(data, offsets, walks).tolist():
                wanted = items.texts[item]
                most, slack = items.most[item], int(items.slack[item])
                begin, stop = int(offsets[text]), int(offsets[text + 1])
                first, last = max(begin, place - most - slack), min(stop, place + len(wanted) + most + 2 * slack)
                known = hits.setdefault((text, item), [])
                # nothing that overlaps a copy without edits is better
                if any(d == 0 and x <= place + slack and place < y for d, x, y in known):
                    continue
                # an edit changes two pairs of bytes at most, so a match keeps all but 2 * most of the item's
                codes, counts = items.pairs[item]
                if np.minimum(pairs_of_bytes(data[first:last])[codes], counts).sum() < len(wanted) - 1 - 2 * most:
                    continue
                window = data[first:last].tobytes()
                distance, end = best_match(wanted.tobytes(), window)
                if distance <= most and (most or not _adjoined(data, begin, stop, first + end - len(wanted), first + end)):
                    # where it begins: the same search from the end backwards
                    _, back = best_match(wanted.tobytes()[::-1], window[:end][::-1])
                    known.append((distance, first + end - back, first + end))
            for (text, item), known in hits.items():
                taken: list[tuple[int, int]] = []
                for distance, a, b in sorted(known):
                    if all(b <= x or a >= y for x, y in taken):
                        taken.append((a, b))
                        points = lambda stop: int(((data[offsets[text]:stop] & 0xC0) != 0x80).sum())  # noqa: B023, E731
                        rows.append((ids[text], items.ids[item], points(a), points(b), distance, 1 - distance / len(items.texts[item])))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 6, types, strict=True)], names=names)

    return run


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """docs without the documents that hold a passage of an item; the rows of an id go together. A null id stays or goes
    with the other null ids."""
    hits = find_contamination(docs, items, **options).select(F.col("doc_id").alias("_id")).distinct()
    keyed = docs.withColumn("_id", F.col("doc_id").cast("long"))
    return keyed.join(hits, keyed["_id"].eqNullSafe(hits["_id"]), "left_anti").select(docs.columns)
