"""A binary token file: ids of fixed width in blocks, readable at any position.

Layout of one shard (all numbers little-endian): MAGIC; blocks; then the index arrays block offsets (u8, one more than
blocks), document starts (u8, one more than documents), document ids (i8) and null flags of the ids (u1); then a JSON
footer and its length (u4) and MAGIC again. A block holds block_ids ids (the last one fewer) at width bits each, lowest
bits first, filled up to a multiple of 8 bytes. width is the fewest bits that hold every id of the vocabulary.
"""

from __future__ import annotations

import json
import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratacloud.llm.common import filesystem, shared_folder, slices
from stratacloud.llm.tokens import encoder

MAGIC = b"TOKBITS1"
BLOCK_IDS = 1 << 16
MANIFEST = "shard long, path string, documents long, tokens long, bytes long"


def width_of(vocabulary: int) -> int:
    """The fewest bits that hold the ids 0 .. vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """ids of width (at most 32) bits each, in words of 64 bits. Ids repeat their place in a word every few ids, so the
    work is one array operation per place."""
    period = 64 // math.gcd(width, 64)
    words = period * width // 64
    rows = -(-len(ids) // period)
    table = np.zeros((rows, period), np.uint64)
    table.reshape(-1)[:len(ids)] = ids
    out = np.zeros((rows, words + 1), np.uint64)
    for k in range(period):
        word, shift = divmod(k * width, 64)
        out[:, word] |= table[:, k] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= table[:, k] >> np.uint64(64 - shift)
    return out[:, :words].reshape(-1)[:-(-len(ids) * width // 64)].astype("<u8").tobytes()


def unpack_bits(raw: bytes, width: int, count: int) -> np.ndarray:
    """The first count ids of a block, unsigned 32 bits."""
    period = 64 // math.gcd(width, 64)
    words = period * width // 64
    rows = -(-count // period)
    table = np.zeros(rows * words, np.uint64)
    flat = np.frombuffer(raw, "<u8")[:rows * words]
    table[:len(flat)] = flat
    table = np.concatenate([table.reshape(rows, words), np.zeros((rows, 1), np.uint64)], axis=1)
    out, mask = np.empty((rows, period), np.uint32), np.uint64((1 << width) - 1)
    for k in range(period):
        word, shift = divmod(k * width, 64)
        value = table[:, word] >> np.uint64(shift)
        if shift + width > 64:
            value |= table[:, word + 1] << np.uint64(64 - shift)
        out[:, k] = value & mask
    return out.reshape(-1)[:count]


class Writer:
    """Streams documents into one shard; holds one block of ids and 17 bytes per document."""

    def __init__(self, sink, vocabulary: int, block_ids: int = BLOCK_IDS):
        self.sink, self.vocabulary, self.width, self.block_ids = sink, vocabulary, width_of(vocabulary), block_ids
        self.waiting, self.held, self.at = [], 0, len(MAGIC)
        self.blocks, self.starts, self.docs, self.nulls = [len(MAGIC)], [0], [], []
        sink.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >= self.vocabulary:
            raise ValueError("id outside the vocabulary")
        self.docs.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.starts.append(self.starts[-1] + len(ids))
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.block_ids:
            self._flush(self.held - self.held % self.block_ids)

    def _flush(self, count: int) -> None:
        ids = np.concatenate([np.zeros(0, np.uint32), *self.waiting])
        for first in range(0, count, self.block_ids):
            raw = pack_bits(ids[first:min(first + self.block_ids, count)], self.width)
            self.sink.write(raw)
            self.at += len(raw)
            self.blocks.append(self.at)
        self.waiting, self.held = [ids[count:]], len(ids) - count

    def close(self) -> int:
        """Write what is left and the index; returns the shard's size in bytes."""
        self._flush(self.held)
        index = (np.asarray(self.blocks, "<u8"), np.asarray(self.starts, "<u8"), np.asarray(self.docs, "<i8"), np.asarray(self.nulls, "u1"))
        for array in index:
            self.sink.write(array.tobytes())
        footer = json.dumps({"width": self.width, "block_ids": self.block_ids, "vocabulary": self.vocabulary, "blocks": len(self.blocks) - 1,
                             "documents": len(self.docs), "tokens": self.starts[-1], "index": self.at}).encode()
        self.sink.write(footer + len(footer).to_bytes(4, "little") + MAGIC)
        return self.at + sum(a.nbytes for a in index) + len(footer) + 4 + len(MAGIC)


class Reader:
    """Reads a shard at any position through a seekable file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        tail = source.read_at(4 + len(MAGIC), size - 4 - len(MAGIC))
        if tail[4:] != MAGIC:
            raise ValueError("not a token file")
        length = int.from_bytes(tail[:4], "little")
        self.meta = json.loads(source.read_at(length, size - 4 - len(MAGIC) - length))
        at, meta = self.meta["index"], self.meta
        self.blocks, at = np.frombuffer(source.read_at(8 * (meta["blocks"] + 1), at), "<u8"), at + 8 * (meta["blocks"] + 1)
        self.starts, at = np.frombuffer(source.read_at(8 * (meta["documents"] + 1), at), "<u8"), at + 8 * (meta["documents"] + 1)
        self.docs, at = np.frombuffer(source.read_at(8 * meta["documents"], at), "<i8"), at + 8 * meta["documents"]
        self.nulls = np.frombuffer(source.read_at(meta["documents"], at), "u1").astype(bool)

    def block(self, k: int) -> np.ndarray:
        count = min(self.meta["block_ids"], self.meta["tokens"] - k * self.meta["block_ids"])
        return unpack_bits(self.source.read_at(int(self.blocks[k + 1] - self.blocks[k]), int(self.blocks[k])), self.meta["width"], count)

    def ids(self, first: int, count: int) -> np.ndarray:
        """Ids first .. first + count - 1 of the shard; reads only their blocks."""
        size = self.meta["block_ids"]
        if not count:
            return np.zeros(0, np.uint32)
        parts = [self.block(k) for k in range(first // size, (first + count - 1) // size + 1)]
        return np.concatenate(parts)[first % size:first % size + count]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1] - self.starts[k]))

    def documents(self) -> Iterator[tuple[int, np.ndarray]]:
        """All documents in file order, each block unpacked once: (place, ids)."""
        ids, first, block = np.zeros(0, np.uint32), 0, 0
        for k in range(self.meta["documents"]):
            start, stop = int(self.starts[k]), int(self.starts[k + 1])
            parts = [ids[start - first:]]
            held = first + len(ids)
            while held < stop:
                parts.append(self.block(block))
                held, block = held + len(parts[-1]), block + 1
            if len(parts) > 1 or start - first > self.meta["block_ids"]:
                ids, first = np.concatenate(parts), start
            yield k, ids[start - first:stop - first]


def write_tokens(docs: DataFrame, tokenizer: str, end: int = 2, folder: str | None = None, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Write the ids of docs (doc_id, text) in ascending doc_id order as shards in a shared folder; returns the manifest.

    Each text (null: empty) gets the id end appended. Rows are spread by ranges of doc_id and sorted inside them, so the
    shards in order hold all documents in order; null ids come first, rows with the same id in order of their text.
    The manifest (one row per shard: shard, path, documents, tokens, bytes) is itself written, and is what commits a
    shard: files of lost or repeated tasks are in no manifest. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, writer = encoder(tokenizer), None
        shard = TaskContext.get().partitionId()
        fs, root = filesystem(folder)
        name = f"{root}/shard-{shard:06d}-{uuid.uuid4().hex}.tok"
        for batch in slices(batches):
            if writer is None:
                fs.create_dir(root)
                sink = fs.open_output_stream(name)
                writer = Writer(sink, max(ids_of.vocabulary, end + 1), block_ids)
            for doc, ids in zip(batch.column("doc_id").to_pylist(), ids_of.encode(batch, end), strict=True):
                writer.add(doc, ids)
        if writer is not None:
            size = writer.close()
            sink.close()
            row = [shard, f"{folder}/{name.rsplit('/', 1)[1]}", len(writer.docs), writer.starts[-1], size]
            yield pa.record_batch([pa.array([x]) for x in row], names=[f.split()[0] for f in MANIFEST.split(", ")])

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return open_tokens(spark, folder)


def open_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of a written folder."""
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Read the shards of a manifest back, one task per shard: doc_id, start (ids of all documents before it, over all
    shards), n_tokens, ids_crc32, shard, place (of the document in its shard)."""
    # one row per shard: the running sum needs no more than one small task
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "shard", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = filesystem(row["path"])
                with fs.open_input_file(path) as source:
                    reader, rows = Reader(source), []
                    for k, ids in reader.documents():
                        rows.append((None if reader.nulls[k] else int(reader.docs[k]), row["base"] + int(reader.starts[k]), len(ids),
                                     zlib.crc32(ids.astype("<u4").tobytes()), row["shard"], k))
                        if len(rows) == 10_000 or k + 1 == reader.meta["documents"]:
                            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)
                            rows = []

    shards = max(1, manifest.count())
    return based.repartition(shards).mapInArrow(run, ", ".join(f"{n} long" for n in names))
