"""Near duplicates by HyperMinHash: compressed minima in bands find candidates, an estimate corrected for chance
collisions thins them, and full shingle sets confirm every link.

1. A text becomes its set of hashed word shingles. Texts with the same set are one node, so exact copies cost one row.
2. A node's signature holds, for each of 128 buckets of the hash space, the smallest hash as leading-zero count and
   mantissa bits (16 bits together). Bands of 4 registers are keys; nodes that share a key are chained through its
   smallest node, first inside a batch and then across batches, so a key shared by a third of all nodes sends one row
   per batch. Two sets at similarity 0.75 share no key with odds of 5 in a million.
3. Chains give loose clusters, which hold every true link. A passage that many texts share makes them very large, so
   they are taken apart by their full sets: with all shingles in one order, rarest first, two linked sets share one
   among the first n - ceil(0.75 n) + 1 of each. Only sets that share such a shingle stay chained. How rare a shingle is
   tells a table of counters; shingles that meet in a counter pass for commoner, which moves work but loses no link.
4. What is left is cut into blocks of bounded size. Inside a block, sets in different components are compared: first
   sizes, then how many of their shingles any other set has, then signatures, then the sets. For clusters of several
   blocks, one hub per block then meets all blocks, and what still stands apart from a cluster's main component meets
   the rest block by block. No links are lost, and groups of copies cost no pairs.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratacloud.llm.common import discard, mix, shingle_sets, slices, text_bytes, written
from stratacloud.llm.components import components

REGISTERS, BAND = 128, 4
MANTISSA = 10
BLOCK_SHINGLES = 4_000_000      # of a block that one task verifies: 32 MB of hashes
SLOT_BITS = 24                  # counters of shingles, whatever the number of documents: 16 MB where tasks read them
MARK_BITS = 27                  # of the bitmap that picks the rows to make sets of: 16 MB likewise
SIGMAS = 4.5                    # the estimate may be so many standard deviations below the threshold


def signature(hashes: np.ndarray) -> np.ndarray:
    """Registers (unsigned 16 bits) of a sorted set of 64-bit hashes; 0 where no hash falls into a bucket, else
    1 + 1024 * leading zeros + mantissa of the bucket's smallest hash."""
    low = np.uint64(64 - int(REGISTERS).bit_length() + 1)
    edges = np.searchsorted(hashes, np.arange(REGISTERS, dtype=np.uint64) << low)
    ends = np.append(edges[1:], len(hashes))
    out = np.zeros(REGISTERS, np.uint16)
    filled = np.flatnonzero(ends > edges)
    rest = hashes[edges[filled]] & ((np.uint64(1) << low) - np.uint64(1))
    fraction, bits = np.frexp(np.maximum(rest, np.uint64(1)).astype(np.float64))
    zeros = np.clip(int(low) - bits, 0, 62)
    out[filled] = 1 + (zeros << MANTISSA) + ((fraction * 2 - 1) * (1 << MANTISSA)).astype(np.int64)
    return out


def band_keys(signatures: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit key per signature and band, and which bands hold a filled register."""
    bands = signatures.reshape(len(signatures), -1, BAND)
    keys = np.arange(bands.shape[1], dtype=np.uint64)[None, :] + np.uint64(1)
    for k in range(BAND):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, k].astype(np.uint64))
    return keys, bands.any(axis=2)


@functools.cache
def chance(log_n: int, log_m: int) -> float:
    """Odds that a register of two disjoint sets of 2**log_n and 2**log_m shingles agrees by chance, given one is filled."""
    mantissas = np.arange(1 << MANTISSA) / (1 << MANTISSA)
    low = np.concatenate([(1 + mantissas) * 2.0 ** -(z + 1) for z in range(40)])
    high = np.concatenate([(1 + mantissas + 2.0 ** -MANTISSA) * 2.0 ** -(z + 1) for z in range(40)])
    odds = [(1 - low / REGISTERS) ** 2.0 ** k - (1 - high / REGISTERS) ** 2.0 ** k for k in (log_n, log_m)]
    filled = 1 - (1 - 1 / REGISTERS) ** (2.0 ** log_n + 2.0 ** log_m)
    return float((odds[0] * odds[1]).sum() / filled)


def estimate(one: np.ndarray, others: np.ndarray, n: int, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Similarity of one signature to others, corrected for chance collisions, and the number of registers it rests on."""
    used = ((others > 0) | (one > 0)[None, :]).sum(axis=1)
    equal = ((others == one[None, :]) & (others > 0)).sum(axis=1)
    logs = np.round(np.log2(np.maximum(sizes, 1))).astype(int)
    luck = np.asarray([chance(int(round(np.log2(max(n, 1)))), k) for k in range(logs.max(initial=0) + 1)])[logs]
    rate = equal / np.maximum(used, 1)
    return (rate - luck) / (1 - luck), used


def _sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, tkey, n_shingles, node (16 bytes; null without words), signature of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 20):
            counts, nodes, signatures = [], [], []
            for hashes in shingle_sets(*text_bytes(batch), size):
                counts.append(len(hashes))
                nodes.append(_node(hashes))
                signatures.append(signature(hashes).tobytes() if len(hashes) else None)
            yield pa.record_batch([batch.column("doc_id"), batch.column("tkey"), pa.array(counts, pa.int64()),
                                   pa.array(nodes, pa.binary()), pa.array(signatures, pa.binary())],
                                  names=["doc_id", "tkey", "n_shingles", "node", "signature"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tkey"))
            .mapInArrow(run, "doc_id long, tkey long, n_shingles long, node binary, signature binary"))


def _mark(doc_id: Column, tkey: Column) -> Column:
    """Hash of a row's id and text; the smallest of a node names the one row its set is made of."""
    return F.xxhash64(doc_id, tkey)


def _node(hashes: np.ndarray) -> bytes | None:
    """128 bits that name a set."""
    if not len(hashes):
        return None
    return b"".join(int(mix(hashes ^ np.uint64(seed)).sum() + np.uint64(len(hashes))).to_bytes(8, "big")
                    for seed in (0x243F6A8885A308D3, 0x13198A2E03707344))


def _chains(nodes: DataFrame) -> DataFrame:
    """Links (a, b) that chain all nodes which share a band key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take = batch.column("node").to_pylist()
            raw = b"".join(batch.column("signature").to_pylist())
            keys, used = band_keys(np.frombuffer(raw, np.uint16).reshape(batch.num_rows, REGISTERS))
            rank = np.empty(len(take), np.int64)
            rank[sorted(range(len(take)), key=take.__getitem__)] = np.arange(len(take))
            row, _ = np.nonzero(used)
            flat = keys[used]
            order = np.lexsort((rank[row], flat))
            flat, row = flat[order], row[order]
            first = np.append(True, flat[1:] != flat[:-1]) if len(flat) else np.zeros(0, bool)
            centre = row[first][np.cumsum(first) - 1] if len(flat) else row
            follow = np.unique(np.stack([row[~first], centre[~first]]), axis=1) if len(flat) else np.zeros((2, 0), int)
            yield pa.record_batch([
                pa.array([*flat[first].view(np.int64).tolist(), *[None] * follow.shape[1]], pa.int64()),
                pa.array([*(take[i] for i in row[first]), *(take[i] for i in follow[0])], pa.binary()),
                pa.array([*[None] * int(first.sum()), *(take[i] for i in follow[1])], pa.binary())], names=["key", "a", "b"])

    rows = nodes.select("node", "signature").mapInArrow(run, "key long, a binary, b binary")
    inside = rows.filter("key IS NULL").select("a", "b")
    # a key has one row per batch that holds it
    across = (rows.filter("key IS NOT NULL").select("a", F.min("a").over(Window.partitionBy("key")).alias("b")).filter("a != b"))
    return inside.union(across).distinct()


def _confirm(percent: int):
    """Function of a block's rows (node, label, side, n, signature, shingles): confirmed links between different labels.

    Side 0 meets side 0 and side 1; side 1 does not meet itself. Sets already connected are not compared again."""
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["side", "node"], ignore_index=True)
        count, first = len(block), int((block.side == 0).sum())
        sizes = block.n.to_numpy()
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        # shingles become numbers of this block, so that one set marked in a table meets all others by look-up
        different, flat, held = np.unique(np.concatenate(block.shingles.to_numpy()), return_inverse=True, return_counts=True)
        flat, mark = flat.astype(np.int32), np.zeros(len(different), bool)
        # a set has no more in common with another than its shingles that any other set has
        shared = np.add.reduceat((held > 1)[flat].astype(np.int32), bounds[:-1])
        # sets whose shingles most others have go first: what they link need not be compared again
        common_first = np.lexsort((-np.add.reduceat(held[flat], bounds[:-1]) / sizes, block.side.to_numpy()))
        signatures = np.frombuffer(b"".join(block.signature), np.uint16).reshape(count, REGISTERS)
        group = pd.factorize(block.label)[0]
        least, links = percent / 100, []
        for place, i in enumerate(common_first[:first]):
            rest = common_first[place + 1:]
            rest = rest[group[rest] != group[i]]
            most = np.minimum(np.minimum(sizes, shared)[rest], min(sizes[i], shared[i]))
            rest = rest[100 * most >= percent * (sizes[rest] + sizes[i] - most)]
            if not len(rest):
                continue
            likeness, used = estimate(signatures[i], signatures[rest], sizes[i], sizes[rest])
            rest = rest[likeness >= least - SIGMAS * np.sqrt(least * (1 - least) / np.maximum(used, 1))]
            if not len(rest):
                continue
            own = flat[bounds[i]:bounds[i + 1]]
            mark[own] = True
            met = mark[np.concatenate([flat[bounds[j]:bounds[j + 1]] for j in rest])]
            mark[own] = False
            common = np.add.reduceat(met.astype(np.int32), np.cumsum(sizes[rest]) - sizes[rest])
            linked = rest[100 * common >= percent * (sizes[rest] + sizes[i] - common)]
            fresh = linked[np.unique(group[linked], return_index=True)[1]]
            if len(fresh):
                links += [(block.node[i], block.node[j]) for j in fresh]
                group[np.isin(group, group[fresh])] = group[i]
        return pd.DataFrame(links, columns=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 75, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Components of documents (doc_id, text) linked at 100 * intersection >= percent * union of their shingle sets.

    One row per row of docs: doc_id, tkey (hash of the text), n_shingles, component_id (smallest doc_id of the
    component), kept (doc_id = component_id). Fewer than size words: the whole sequence is one shingle; null, empty or
    wordless texts have no shingles, link with nothing and are kept. Repeated rows are copies of each other and share
    their fate. A null doc_id never names a component that has another id. Other columns are ignored.
    """
    sketches = written(_sketches(docs, size), "sketches")
    nodes = written(sketches.filter("node IS NOT NULL").groupBy("node")
                    .agg(F.min("doc_id").alias("doc_id"), F.min(_mark(F.col("doc_id"), F.col("tkey"))).alias("mark"), F.first("n_shingles").alias("n"),
                         F.first("signature").alias("signature")), "nodes")
    loose = components(_chains(nodes)).withColumnRenamed("label", "cluster")
    members = written(loose.join(nodes, "node").select("node", "mark", "n", "signature", "cluster"), "members")
    loose = written(members.join(_sets(docs, members, size), "node").withColumn("id", F.xxhash64("node")), "member-sets")
    discard(members)
    clusters = components(_rare_chains(loose, percent)).select(F.col("node").alias("id"), F.col("label").alias("cluster"))
    members = loose.select("id", "n").join(clusters, "id")
    sizes = members.groupBy("cluster").agg(F.ceil(F.sum("n") / F.lit(block_shingles)).alias("blocks"))
    # a set's place is settled before the sets are moved, so they are moved once
    places = written(clusters.join(sizes, "cluster"), "places")
    full = loose.drop("cluster").join(places, "id").withColumn("block", F.pmod(F.col("id"), F.col("blocks")))
    full = written(full.select("node", "n", "signature", "shingles", "cluster", "blocks", "block"), "clustered-sets")
    discard(loose, places)

    schema = "a binary, b binary"
    alone = full.select("node", F.col("node").alias("label"), F.lit(0).alias("side"), "n", "signature", "shingles", "cluster", "block")
    links = written(alone.groupBy("cluster", "block").applyInPandas(_confirm(percent), schema), "confirmed")
    labels = components(links)
    if not full.filter("blocks > 1").isEmpty():
        links, labels = _between_blocks(full.filter("blocks > 1"), links, labels, percent)
    discard(full, links)
    named = (nodes.join(labels, "node", "left").select("node", "doc_id", F.coalesce("label", "node").alias("label")))
    smallest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = named.join(smallest, "label").select("node", "component_id")
    # the rows of a group of exact copies meet one row each; adaptive execution splits them where they are many
    out = sketches.select("doc_id", "tkey", "n_shingles", "node").join(named, "node", "left")
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "tkey", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def _marked_rows(members: DataFrame) -> np.ndarray:
    """A bitmap over the marks of the members' rows, of one fixed size, so it may pass through the driver."""
    place = F.shiftrightunsigned("mark", 64 - MARK_BITS)
    blocks = written(members.select(F.shiftright(place, 15).alias("block"), F.pmod(place, F.lit(1 << 15)).alias("bit"))
                     .groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits")), "member-marks")
    table = np.zeros(1 << (MARK_BITS - 3), np.uint8)
    for row in blocks.toLocalIterator():
        table[row["block"] << 12:(row["block"] + 1) << 12] = np.frombuffer(row["bits"], np.uint8)
    discard(blocks)
    return table


def _sets(docs: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """The full sets of the members' nodes (and of few others, whose marks share a bit with a member's), made again from
    one row each: node, shingles. Rows are picked where they are read, so no text is shuffled."""
    marks = docs.sparkSession.sparkContext.broadcast(_marked_rows(members))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            place = whole.column("mark").to_numpy().view(np.uint64) >> np.uint64(64 - MARK_BITS)
            wanted = (marks.value[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1
            for batch in slices(iter([whole.filter(pa.array(wanted == 1))]), 1 << 20):
                sets = shingle_sets(*text_bytes(batch), size)
                bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                shingles = pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.record_batch([pa.array([_node(s) for s in sets], pa.binary()), shingles], names=["node", "shingles"])

    rows = docs.select("text", _mark(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("mark"))
    # rows that repeat an id and a text have one mark: combined to one set per node
    return (rows.mapInArrow(run, "node binary, shingles array<bigint>").filter("node IS NOT NULL")
            .groupBy("node").agg(F.first("shingles").alias("shingles")))


def _slots(shingles: np.ndarray) -> np.ndarray:
    return (shingles.view(np.uint64) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _commonness(sets: DataFrame) -> np.ndarray:
    """Per counter a level that grows with the number of shingles it counted, copies included: 1 for a single one.

    A task counts its sets and sends the counters it used in blocks of 4096; a block gets at most 16 kB of each task.
    The table has one fixed size, so it may pass through the driver."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(1 << SLOT_BITS, np.uint32)
        for batch in batches:
            np.add.at(counters, _slots(batch.column("shingles").flatten().to_numpy()), np.uint32(1))
        used = np.flatnonzero(counters)
        blocks, first = np.unique(used >> 12, return_index=True)
        places = np.split((used & 4095).astype(np.uint16), first[1:])
        numbers = np.split(np.minimum(counters[used], 65535).astype(np.uint16), first[1:])
        if len(blocks):
            yield pa.record_batch([pa.array(blocks, pa.int64()), pa.array([v.tobytes() for v in places], pa.binary()),
                                   pa.array([v.tobytes() for v in numbers], pa.binary())], names=["slots", "places", "numbers"])

    def add(block: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(4096, np.int64)
        for places, numbers in zip(block["places"], block["numbers"], strict=True):
            total[np.frombuffer(places, np.uint16)] += np.frombuffer(numbers, np.uint16)
        levels = 1 + np.round(4 * np.log2(np.maximum(total, 1)))
        return pd.DataFrame({"slots": block["slots"].iloc[:1], "levels": [levels.astype(np.uint8).tobytes()]})

    parts = sets.select("shingles").mapInArrow(count, "slots long, places binary, numbers binary")
    blocks = written(parts.groupBy("slots").applyInPandas(add, "slots long, levels binary"), "shingle-levels")
    table = np.ones(1 << SLOT_BITS, np.uint8)
    for row in blocks.toLocalIterator():
        table[row["slots"] << 12:(row["slots"] + 1) << 12] = np.frombuffer(row["levels"], np.uint8)
    discard(blocks)
    return table


def _rare_chains(sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that chain all ids of one cluster that share a shingle among the first of both, rarest first.

    sets: id, n, cluster, shingles (ascending as unsigned hashes). Any one order would do; the rarest come first because
    few sets share them. Only a set's first shingles are sent, and of these not the ones it has alone."""
    levels = sets.sparkSession.sparkContext.broadcast(_commonness(sets))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("shingles")
            sizes = np.diff(column.offsets.to_numpy()).astype(np.int64)
            shingles, owner = column.flatten().to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
            level = levels.value[_slots(shingles)]
            order = np.argsort(owner << 8 | level, kind="stable")       # equal levels keep the order of their hashes
            places = sizes - (sizes * percent + 99) // 100 + 1
            rank = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            take = order[(rank < places[owner]) & (level[order] > 1)]
            near = batch.column("near").to_numpy().view(np.uint64)[owner[take]]
            keys = mix(shingles[take].view(np.uint64) ^ mix(near))
            yield pa.record_batch([pa.array(batch.column("id").to_numpy()[owner[take]]), pa.array(keys.view(np.int64))],
                                  names=["id", "key"])

    keys = written(sets.select("id", F.xxhash64("cluster").alias("near"), "shingles").mapInArrow(first, "id long, key long"), "rare-shingles")
    levels.unpersist()
    # partial minima by key, then a join of written tables, which adaptive execution splits where many sets share a key
    centres = written(keys.groupBy("key").agg(F.min("id").alias("b"), F.max("id").alias("last")).filter("b != last")
                      .select("key", "b"), "centres")
    links = written(keys.join(centres, "key").select(F.col("id").alias("a"), "b").filter("a != b").distinct(), "rare-links")
    discard(keys, centres)
    return links


def _between_blocks(full: DataFrame, links: DataFrame, labels: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links between the blocks of clusters that have several."""
    schema, columns = "a binary, b binary", ["node", "label", "side", "n", "signature", "shingles", "cluster", "block", "other"]

    def labelled(current: DataFrame) -> DataFrame:
        return written(full.join(current, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")

    now = labelled(labels)
    # 1. one hub per block, the set that most others were linked to, meets every block of its cluster: copies of one
    #    text may be too far from each other and yet all near to it
    degrees = links.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"))
    ranked = now.join(degrees, "node", "left").select("cluster", "block", "node", F.coalesce("degree", F.lit(0)).alias("degree"))
    hubs = ranked.groupBy("cluster", "block").agg(F.max_by("node", F.struct("degree", "node")).alias("node")).select("node")
    hub_rows = now.join(hubs, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meet = (hub_rows.withColumn("side", F.lit(0)).withColumn("block", F.col("other")).select(columns)
            .union(now.join(hubs, "node", "left_anti").withColumn("side", F.lit(1)).withColumn("other", F.col("block")).select(columns)))
    links = written(links.union(meet.groupBy("cluster", "block").applyInPandas(_confirm(percent), schema)), "confirmed")
    now = labelled(components(links))
    # 2. what is not in its cluster's main component meets the other blocks
    shares = now.groupBy("cluster", "label").agg(F.count("*").alias("c"))
    main = shares.groupBy("cluster").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count("*").alias("labels"))
    now = now.join(main.filter("labels > 1"), "cluster").withColumn("apart", F.col("label") != F.col("main"))
    others = now.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).filter("other != block")
    left = others.filter("apart").withColumn("side", F.lit(0)).select(columns)
    # the pair of blocks (i, j) holds i's rows that stand apart, and j's rows: all if j > i, else those of the main part
    right = others.filter("NOT apart OR block > other").select(
        "node", "label", F.lit(1).alias("side"), "n", "signature", "shingles", "cluster", F.col("other").alias("block"),
        F.col("block").alias("other"))
    pairs = left.union(right).groupBy("cluster", "block", "other").applyInPandas(_confirm(percent), schema)
    links = written(links.union(pairs), "confirmed")
    return links, components(links)


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each component: the one with the smallest id. Of rows that repeat an id and a text one
    stays. Documents without words all stay."""
    found = near_duplicates(docs, **options)
    gone = written(found.filter("NOT kept").select(F.col("doc_id").alias("_id"), F.col("tkey").alias("_tkey")).distinct(), "dropped")
    again = written(found.filter("kept AND n_shingles > 0").groupBy("doc_id", "tkey").count().filter("count > 1")
                    .select(F.col("doc_id").alias("_id"), F.col("tkey").alias("_tkey")), "repeated")
    keyed = docs.withColumns({"_id": F.col("doc_id").cast("long"), "_tkey": F.xxhash64("text")})
    same = lambda other: keyed["_id"].eqNullSafe(other["_id"]) & (keyed["_tkey"] == other["_tkey"])
    stays = keyed.join(gone, same(gone), "left_anti")
    if again.isEmpty():
        return stays.select(docs.columns)
    once = stays.join(again, ["_id", "_tkey"], "left_semi").groupBy("_id", "_tkey").agg(*[F.first(c).alias(c) for c in docs.columns])
    return stays.join(again, ["_id", "_tkey"], "left_anti").select(docs.columns).unionByName(once.select(docs.columns))
