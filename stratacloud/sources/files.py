"""Readers for the file formats of a survey: listings, clouds, trajectories, detections, digests.

Each reader is one Spark job over many files: the listing is distributed, a task decodes the files of its partition, and
decoded rows leave the task batch by batch."""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratacloud.functions.ordered import number_rows

BATCH = 1 << 20     # points a decoding task hands on at a time
TOGETHER = 1 << 16  # points of small files that are handed on together


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Paths under a folder; the content is never read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
            .load(folder).select("path"))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def frame_pairs(left: DataFrame, right: DataFrame, suffix: str = ".png") -> DataFrame:
    """Names with the suffix present in both listings (path), in order."""
    def names(df):
        return df.select(file_name(F.col("path")).alias("name")).where(F.col("name").endswith(suffix)).distinct()

    return names(left).join(names(right), "name").orderBy("name")


def find_frame_pairs(spark: SparkSession, frames: str) -> DataFrame:
    return frame_pairs(listing(spark, f"{frames}/left", "*.png"), listing(spark, f"{frames}/right", "*.png"))


def locate(path: Column, root: str = "results") -> Column:
    """struct(session, scan, method) of a path under <root>/<session>/<scan>/<method>/..., else null; `analysis` is not a
    session."""
    pattern = rf"(?:^|/){root}/([^/]+)/([^/]+)/([^/]+)/[^/]+"
    parts = [F.regexp_extract(path, pattern, k) for k in (1, 2, 3)]
    ok = (parts[0] != "") & ~parts[0].isin("analysis", "..")
    return F.when(ok, F.struct(*[p.alias(n) for p, n in zip(parts, ("session", "scan", "method"))]))


def read_timestamps(spark: SparkSession, path: str) -> DataFrame:
    """(camera, pts_ns) from CSV files with those columns."""
    return spark.read.schema("camera string, pts_ns bigint").csv(path, header=True)


def trim_timestamps(stamps: DataFrame, frames: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Timestamps numbered as frames per camera, cut to the number of frames that exist (keys, camera, n_frames)."""
    keys = [*(keys or []), "camera"]
    return (number_rows(stamps, ["pts_ns"], keys, "frame").join(F.broadcast(frames) if frames.limit(1001).count() <= 1000 else frames, keys)
            .where(F.col("frame") < F.col("n_frames")).drop("n_frames"))


# PLY scalar types as NumPy ones.
PLY_TYPES = {"char": "<i1", "uchar": "<u1", "short": "<i2", "ushort": "<u2", "int": "<i4", "uint": "<u4", "float": "<f4", "double": "<f8",
             "int8": "<i1", "uint8": "<u1", "int16": "<i2", "uint16": "<u2", "int32": "<i4", "uint32": "<u4", "float32": "<f4", "float64": "<f8"}
CLOUD_SCHEMA = "path string, x double, y double, z double, grey double, views int"


def _layout(header: bytes):
    """The NumPy type of a PLY file's vertices and their number."""
    import numpy as np

    fields, count, counting = [], 0, False
    header = header.decode("ascii").split("\n")
    if not any(line.startswith("format binary_little_endian") for line in header):
        raise ValueError("only binary little-endian PLY is read")
    for line in header:
        words = line.split()
        if words[:1] == ["element"]:
            counting = words[1] == "vertex"
            count = int(words[2]) if counting else count
        elif words[:1] == ["property"] and counting:
            fields.append((words[2], PLY_TYPES[words[1]]))
    return np.dtype(fields), count


def _vertices(content: bytes, layouts: dict):
    """The vertices of a PLY file; layouts keeps the last headers read, as the files of a survey share them."""
    import numpy as np

    end = content.index(b"end_header") + len(b"end_header")
    end = content.index(b"\n", end - 1) + 1
    header = bytes(content[:end])
    if header not in layouts:
        if len(layouts) >= 256:
            layouts.clear()
        layouts[header] = _layout(header)
    kind, count = layouts[header]
    return np.frombuffer(content, kind, count, end)


def _decoded(batches) -> Iterator:
    """Rows of the files in batches of (path, content); small files leave together."""
    import numpy as np
    import pandas as pd

    held, size, layouts = [], 0, {}

    def handed():
        lengths = [len(xyz) for _, xyz, _, _ in held]
        xyz, grey, views = (np.concatenate([h[k] for h in held]) for k in (1, 2, 3))
        return pd.DataFrame({"path": np.repeat(np.array([h[0] for h in held], object), lengths), "x": xyz[:, 0], "y": xyz[:, 1],
                             "z": xyz[:, 2], "grey": grey, "views": views})

    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            if path.endswith(".npz"):
                with np.load(io.BytesIO(content)) as data:
                    xyz, grey = data["xyz"].astype(float), data["grey"].astype(float)
                views = np.ones(len(xyz), np.int32)
            else:
                v = _vertices(content, layouts)
                xyz = np.stack([v[a].astype(float) for a in "xyz"], 1)
                names = v.dtype.names
                if "grey" in names:
                    grey = v["grey"].astype(float)
                elif "red" in names:
                    grey = (v["red"].astype(float) + v["green"] + v["blue"]) / 3
                else:
                    grey = np.zeros(len(v))
                views = v["views"].astype(np.int32) if "views" in names else np.ones(len(v), np.int32)
            for at in range(0, len(xyz), BATCH):
                part = slice(at, at + BATCH)
                held.append((path, xyz[part], grey[part], views[part]))
                size += len(xyz[part])
                if size >= TOGETHER:
                    yield handed()
                    held, size = [], 0
    if held:
        yield handed()


def decode_clouds(files: DataFrame) -> DataFrame:
    """Rows of binary PLY clouds and .npz frames in (path, content): positions in double, grey from grey or the mean of
    red, green and blue (0 where neither is stored), views 1 where not stored."""
    return files.select("path", "content").mapInPandas(_decoded, CLOUD_SCHEMA)


def read_clouds(spark: SparkSession, path: str) -> DataFrame:
    """Every PLY and .npz under a path. Files above Spark's 2 GiB row limit have to be split first."""
    return decode_clouds(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
                         .where(F.lower("path").rlike(r"\.(ply|npz)$")))


TRAJECTORY_SCHEMA = "path string, frame string, T array<double>, diag map<string,double>, metadata map<string,string>"


def decode_trajectories(files: DataFrame) -> DataFrame:
    """Frames of trajectory documents in (path, value): pose T_cam_world or T_cam_board (null where neither is given) and
    every other real field as a diagnostic."""

    def decode(batches) -> Iterator:
        import pandas as pd
        import yaml

        class Loader(yaml.SafeLoader):
            pass

        # the matrix tag of the storage format: a mapping with rows, cols and data
        Loader.add_multi_constructor("tag:yaml.org,2002:opencv-matrix", lambda loader, _, node: loader.construct_mapping(node, deep=True)["data"])
        for batch in batches:
            for path, text in zip(batch["path"], batch["value"]):
                if text.startswith("%YAML"):
                    text = text.split("\n", 1)[1]
                document = yaml.load(text, Loader) or {}
                meta = {k: str(v) for k, v in (document.get("metadata") or {}).items()}
                rows = []
                for f in document.get("frames") or []:
                    pose = f.get("T_cam_world", f.get("T_cam_board"))
                    if isinstance(pose, dict):
                        pose = pose["data"]
                    diag = {k: float(v) for k, v in f.items()
                            if k not in ("name", "T_cam_world", "T_cam_board") and isinstance(v, (int, float)) and not isinstance(v, bool)}
                    rows.append((path, str(f["name"]), None if pose is None else [float(v) for v in pose], diag, meta))
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "frame", "T", "diag", "metadata"])

    return files.select("path", "value").mapInPandas(decode, TRAJECTORY_SCHEMA)


def read_trajectories(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return decode_trajectories(text)


DETECTION_JSON = T.StructType([T.StructField("cameras", T.MapType(T.StringType(), T.MapType(T.StringType(), T.StructType([
    T.StructField("ids", T.ArrayType(T.LongType())),
    T.StructField("corners", T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType()))))]))))])


def flatten_detections(documents: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per detection of the corners documents in column value: camera, image, tag, quad."""
    keys = keys or []
    parsed = documents.select(*keys, F.from_json("value", DETECTION_JSON).alias("_d"))
    cameras = parsed.select(*keys, F.explode("_d.cameras").alias("camera", "_images"))
    images = cameras.select(*keys, "camera", F.explode("_images").alias("image", "_i"))
    rows = images.select(*keys, "camera", "image", F.explode(F.arrays_zip(F.col("_i.ids").alias("ids"), F.col("_i.corners").alias("corners"))).alias("_t"))
    return rows.select(*keys, "camera", "image", F.col("_t.ids").alias("tag"), F.transform(
        F.col("_t.corners"), lambda p: F.struct(p[0].alias("u"), p[1].alias("v"))).alias("quad"))


def board_tags(detections: DataFrame, rejected: DataFrame | None = None, keys: list[str] | None = None, n_tags: int = 70) -> DataFrame:
    """Board tags seen once per image, without the rejected (camera, image, tag)."""
    keys = [*(keys or []), "camera", "image", "tag"]
    once = detections.where(F.col("tag").between(0, n_tags - 1)).groupBy(*keys).agg(
        F.count("*").alias("_n"), F.first("quad").alias("quad")).where(F.col("_n") == 1).drop("_n")
    return once if rejected is None else once.join(rejected.select(*keys).distinct(), keys, "left_anti")


def digest_order(path: Column) -> Column:
    """Order of a sorted walk: in every folder its files first, then its folders, each by name."""
    parts = F.split(path, "/")
    return F.transform(parts, lambda p, i: F.concat(F.when(i == F.size(parts) - 1, "0").otherwise("1"), p))


def digest(files: DataFrame, folder: str = "folder") -> DataFrame:
    """SHA-256 per folder over every file's relative path and content digest in walk order. (folder, path, content)

    Contents are hashed where they lie; only paths and 32-byte digests are sorted. The outer hash is a sequence by
    definition: a folder's lines stream through one hash state, never gathered."""

    def fold(batches) -> Iterator:
        import pandas as pd

        state, name = None, None
        for batch in batches:
            for key, path, inner in zip(batch[folder], batch["path"], batch["_inner"]):
                if state is None or key != name:
                    if state is not None:
                        yield pd.DataFrame({folder: [name], "digest": [state.hexdigest()]})
                    state, name = hashlib.sha256(), key
                state.update(path.encode())
                state.update(bytes.fromhex(inner))
        if state is not None:
            yield pd.DataFrame({folder: [name], "digest": [state.hexdigest()]})

    lines = files.select(folder, "path", F.sha2(F.col("content"), 256).alias("_inner"), digest_order(F.col("path")).alias("_order"))
    ordered = lines.repartition(F.col(folder)).sortWithinPartitions(folder, "_order").select(folder, "path", "_inner")
    kind = dict(files.dtypes)[folder]
    return ordered.mapInPandas(fold, f"{folder} {kind}, digest string")


def folder_digest(spark: SparkSession, root: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    clean = root.rstrip("/") + "/"
    relative = F.element_at(F.split(F.col("path"), clean.replace(".", r"\."), 2), 2)
    return digest(files.select(F.lit(root).alias("folder"), relative.alias("path"), "content"))
