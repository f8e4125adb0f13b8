"""Token ids of whole texts.

Most tokenizers of the word-BPE kind (normalise, split into words, merge inside each word) give the characters between
two spaces the same ids wherever they stand. For such a file each different piece goes through the library once per
worker; texts are then cut into pieces, hashed and looked up as arrays. Texts with characters for which Python's and
the library's notions of case, space or letter could differ, texts that spell out an added token such as <|endoftext|>,
and all other tokenizer files, go through the library whole. Both ways give the library's own ids (two pieces of a worker's table share a 64-bit hash with odds below 1e-6).
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa

from stratacloud.llm.common import text_bytes, word_hashes, word_spans

#: The pre-tokenizer pattern and the normalizers of the word-BPE file for which pieces may be looked up.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SLOT_BITS = 23

# The same split for pieces of ASCII and of Latin letters with marks. Letters and digits may come first: no other
# alternative begins with one.
_LETTER = "a-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f"
_WORD = re.compile(rf"[{_LETTER}]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^\s{_LETTER}0-9]+")


def _odd(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to characters that need the library: all but ASCII without \x1c-\x1f and U+00A1 to U+017F
    without the superscript and fraction digits and the dotted capital I."""
    odd = (data >= 0xC6) | ((data >= 0x1C) & (data <= 0x1F))
    if data.max(initial=0) >= 0x80:
        after = np.append(data[1:], np.uint8(0))
        odd |= (data == 0xC4) & (after == 0xB0)
        odd |= (data == 0xC2) & ((after <= 0xA0) | (after == 0xB2) | (after == 0xB3) | (after == 0xB9)
                                 | ((after >= 0xBC) & (after <= 0xBE)))
    return odd


class Encoder:
    """Encodes texts to ids with a tokenizers file, without special tokens. most_pieces bounds the pieces kept."""

    def __init__(self, path: str, most_pieces: int = 2_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.most_pieces = most_pieces
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.vocabulary = self.whole.get_vocab_size(with_added_tokens=True)
        self.added = [t["content"].encode() for t in spec.get("added_tokens", []) if t["content"]]
        self.by_piece = self._splits_words(spec)
        if self.by_piece:
            self.bare = Tokenizer(self.whole.model)
            self.bare.pre_tokenizer = pre_tokenizers.Sequence(
                [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.ends = np.zeros(self.vocabulary, bool)
            suffix = spec["model"]["end_of_word_suffix"]
            for token, i in spec["model"]["vocab"].items():
                self.ends[i] = token.endswith(suffix)
            self._forget()

    @staticmethod
    def _splits_words(spec: dict) -> bool:
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        # added tokens matched after normalisation cannot be told from a text's bytes
        return (not any(t["normalized"] for t in spec.get("added_tokens", [])) and spec["model"]["type"] == "BPE" and bool(spec["model"].get("end_of_word_suffix"))
                and [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])] == WORD_NORMALIZERS
                and [s["type"] for s in steps] == ["Split", "ByteLevel"] and steps[0]["pattern"] == {"Regex": WORD_PATTERN}
                and steps[0]["behavior"] == "Removed" and steps[0]["invert"])

    def _forget(self) -> None:
        self.slots = np.full(1 << SLOT_BITS, -1, np.int32)  # a piece's number, at one of two slots of its hash
        self.hashes = np.zeros(1 << 16, np.uint64)          # by number: its hash, and where its ids begin
        self.place = np.zeros((1 << 16) + 1, np.int64)
        self.flat = np.zeros(1 << 18, np.uint32)
        self.count = 0

    @staticmethod
    def _two_slots(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64((1 << SLOT_BITS) - 1)
        return (hashes & mask).astype(np.int64), (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    @staticmethod
    def _room(array: np.ndarray, size: int) -> np.ndarray:
        if size <= len(array):
            return array
        return np.concatenate([array, np.zeros(max(len(array), size - len(array)), array.dtype)])

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> np.ndarray:
        """Encode new pieces; returns their numbers. A piece that finds both its slots taken is learned again next time."""
        found = [_WORD.findall(p.lower()) for p in pieces]
        words = [w for f in found for w in f]
        ids, parts = [np.zeros(0, np.uint32)], [" ".join(words[i:i + 64]) for i in range(0, len(words), 64)]
        for i in range(0, len(parts), 256):
            encoded = self.bare.encode_batch_fast(parts[i:i + 256], add_special_tokens=False)
            ids.append(np.asarray([x for p in encoded for x in p.ids], np.uint32))
        ids = np.concatenate(ids)
        last = np.flatnonzero(self.ends[ids]) + 1
        if len(last) != len(words):
            raise ValueError("a word was cut in two")
        bounds = np.concatenate([[0], last])[np.concatenate([[0], np.cumsum([len(f) for f in found])])]
        numbers = np.arange(self.count, self.count + len(hashes))
        used, self.count = self.place[self.count], self.count + len(hashes)
        self.flat = self._room(self.flat, used + len(ids))
        self.flat[used:used + len(ids)] = ids
        self.hashes, self.place = self._room(self.hashes, self.count), self._room(self.place, self.count + 1)
        self.hashes[numbers], self.place[numbers + 1] = hashes, used + bounds[1:]
        one, two = self._two_slots(hashes)
        free = self.slots[one] < 0
        self.slots[one[free]] = numbers[free]
        late = self.slots[one] != numbers
        self.slots[two[late]] = np.where(self.slots[two[late]] < 0, numbers[late], self.slots[two[late]])
        return numbers

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the bounds between the texts."""
        hashes, counts = word_hashes(data, offsets)
        if not len(hashes):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        if self.count > self.most_pieces:
            self._forget()
        one, two = self._two_slots(hashes)
        at = self.slots[one]
        for slots in (two, None):
            miss = np.flatnonzero((at < 0) | (self.hashes[at] != hashes))
            if slots is not None and len(miss):
                at[miss] = self.slots[slots[miss]]
        if len(miss):
            different, first, which = np.unique(hashes[miss], return_index=True, return_inverse=True)
            starts, ends = word_spans(data, offsets, miss[first])
            raw = data.tobytes()
            new = [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            at[miss] = self._learn(different, new)[which]
        starts = self.place[at]
        lengths = self.place[at + 1] - starts
        ends = np.cumsum(lengths)
        ids = self.flat[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1])]
        return ids, np.concatenate([[0], ends])[counts]

    def _added_at(self, data: np.ndarray) -> list[int]:
        """Where the contents of added tokens begin."""
        raw, found = data.tobytes(), []
        for content in self.added:
            at = raw.find(content)
            while at >= 0:
                found.append(at)
                at = raw.find(content, at + 1)
        return found

    def encode(self, batch: pa.RecordBatch, end: int | None = None, column: str = "text") -> list[np.ndarray]:
        """The ids (unsigned 32 bits) of each text of a batch (null: empty), with the id end appended if given."""
        tail = np.asarray([] if end is None else [end], np.uint32)
        data, offsets = text_bytes(batch, column)
        n = len(offsets) - 1
        whole = np.ones(n, bool)
        if self.by_piece:
            odd = np.flatnonzero(_odd(data))
            if added := self._added_at(data):
                odd = np.sort(np.concatenate([odd, np.asarray(added, odd.dtype)]))
            whole = np.searchsorted(odd, offsets[1:]) > np.searchsorted(odd, offsets[:-1])
            if whole.any():     # their bytes are left out of the look-up
                keep = np.repeat(~whole, np.diff(offsets))
                ids, bounds = self._pieces(data[keep], np.concatenate([[0], np.cumsum(np.where(whole, 0, np.diff(offsets)))]))
            else:
                ids, bounds = self._pieces(data, offsets)
        out = []
        for i in range(n):
            if whole[i]:
                text = data[offsets[i]:offsets[i + 1]].tobytes().decode()
                own = np.asarray(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
            else:
                own = ids[bounds[i]:bounds[i + 1]]
            out.append(np.concatenate([own, tail]))
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a file, kept for the life of the worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
