"""What several operators share: written tables in the shared folder, files opened from tasks, hashed word sequences."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacloud.session import ensure_checkpoint_dir


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the folder that spark.checkpoint.dir names, which driver and executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and go on from the files: cuts lineage, gives the planner true sizes."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove tables of written() once what was made of them is itself written: nothing that still runs may read them."""
    for table in tables:
        files = table.inputFiles()
        if files:
            spark = table.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(unquote(files[0].rsplit("/", 1)[0]))
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder URI, for tasks that write or read files of their own."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return pafs.FileSystem.from_uri(uri)


def fold(modulus: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo modulus; a null id counts as fold -1 and belongs to no held-out fold."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus)), F.lit(-1))


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """A batch's texts; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def text_bytes(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a batch's texts and the n + 1 offsets between them; null counts as empty."""
    array = batch.column(column)
    if array.null_count:
        array = array.fill_null("")
    wide = array.cast(pa.large_string())
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset:wide.offset + len(wide) + 1]
    data = np.frombuffer(wide.buffers()[2], np.uint8) if wide.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], most: int = 4 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches so that each slice holds about most bytes of text: arrays derived from it stay small. One text is never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch, column)
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers: xor-shifts and odd multipliers, a bijection."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


_BASE = np.uint64(0x9E3779B97F4A7C55)
_MOST_POWERS = 1 << 16


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(_MOST_POWERS)


def word_powers(longest: int) -> np.ndarray:
    """Multipliers of the places in a word, for words of up to longest places."""
    return _POWERS if longest <= _MOST_POWERS else _powers(longest)


def _word_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin, and which bytes are space."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    begins = ~space
    begins[1:] &= space[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begins[edges] = ~space[edges]
    return np.flatnonzero(begins), space


def word_spans(data: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The byte spans of the words with the given numbers."""
    starts, space = _word_starts(data, offsets)
    stops = np.sort(np.concatenate([np.flatnonzero(space), offsets]))
    starts = starts[which]
    return starts, stops[np.searchsorted(stops, starts, "right")]


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (maximal runs without space and \\x09-\\x0D, A-Z lower-cased if lower) of all texts, and
    the n + 1 offsets between the texts' words. A word's hash depends on its bytes alone."""
    n = len(offsets) - 1
    starts, space = _word_starts(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    base = int(starts[0])
    letters = data[base:]
    if lower:
        letters = np.where((letters >= 65) & (letters <= 90), letters + np.uint8(32), letters)
    # a byte's place in its word; spaces weigh nothing
    lengths = np.diff(np.append(starts, len(data))).astype(np.int32)
    place = np.arange(len(letters), dtype=np.int32) - np.repeat((starts - base).astype(np.int32), lengths)
    values = word_powers(int(lengths.max()))[place] * (letters.astype(np.uint64) + np.uint64(1))
    values *= ~space[base:]
    return mix(np.add.reduceat(values, starts - base)), np.searchsorted(starts, offsets)


_PLACE = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB),
          np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles of size words; a text with fewer words gives its whole
    sequence as one, a text without words nothing."""
    words, counts = word_hashes(data, offsets)
    rolled = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        rolled += mix(words[k:len(words) - size + 1 + k] * _PLACE[k % 5] + np.uint64(k)) if len(rolled) else np.uint64(0)
    rolled = mix(rolled)
    out = []
    for first, last in zip(counts[:-1], counts[1:], strict=True):
        if last - first >= size:
            out.append(np.unique(rolled[first:last - size + 1]))
        elif last > first:
            short = np.uint64(last - first)
            for k, w in enumerate(words[first:last]):
                short = mix(short + mix(np.asarray([w], np.uint64) * _PLACE[k % 5] + np.uint64(k + 17)))
            out.append(np.asarray(short, np.uint64).reshape(1))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
