"""Registered queries: sources, keyed tables, depth scoring and costs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from stratacloud.functions.columns import quantise
from stratacloud.operators import scoring as s
from stratacloud.plans import bindings as b
from stratacloud.plans.bindings import q, sql
from stratacloud.sources import files, store


def quantised(df, *columns, digits=4):
    return df.withColumns({c: quantise(c, digits) for c in columns})


def a1(spark, sf):
    path = F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1)
    pages = b.names(spark, sf).select("page_id", F.regexp_replace(path, "^[a-z]+/", "cam/").alias("path"))
    return files.frame_pairs(pages.where("page_id % 3 <> 0"), pages.where("page_id % 3 <> 1"), "5")


def a2(spark, sf):
    rows = b.summary_rows(spark, sf)
    path = F.when(F.col("version") % 7 == 0, F.concat_ws("/", F.lit("/x/results/analysis"), "scan", "method", F.lit("f.csv"))).when(
        F.col("version") % 11 == 0, F.concat_ws("/", F.lit("/x/results"), "session", F.lit("summary.csv"))).otherwise(
        F.concat_ws("/", F.lit("/x/results"), "session", "scan", "method", F.lit("cloud.ply")))
    place = rows.select(files.locate(path).alias("p"))
    return place.groupBy(*[F.col(f"p.{c}").alias(c) for c in ("session", "scan", "method")]).agg(F.count("*").alias("files"))


def a3(spark, sf):
    stamps = b.timestamps(spark, sf).select("camera", "pts_ns")
    frames = stamps.groupBy("camera").agg((F.count("*") - F.when(F.col("camera") == "left", 40).otherwise(-5)).alias("n_frames"))
    return files.trim_timestamps(stamps, frames).select("camera", "frame", "pts_ns")


def _ply(spark, sf):
    """Small PLY files built from the points: one per frame and chunk."""
    def encode(batches):
        import pyarrow as pa

        dtype = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("grey", "u1"), ("views", "<u2")])
        for batch in batches:
            rows = batch.column("rows")
            flat, ends = rows.flatten(), np.r_[0, np.cumsum(rows.value_lengths().to_numpy())]
            v = np.zeros(len(flat), dtype)
            for name in dtype.names:
                v[name] = flat.field(name).to_numpy(zero_copy_only=False)
            contents = []
            for start, end in zip(ends[:-1], ends[1:]):
                head = (f"ply\nformat binary_little_endian 1.0\nelement vertex {end - start}\nproperty float x\nproperty float y\nproperty float z\n"
                        "property uchar grey\nproperty ushort views\nend_header\n")
                contents.append(head.encode() + v[start:end].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(contents, pa.binary())], names=["path", "content"])

    points = b.table(spark, sf, "lineitem").selectExpr("l_suppkey AS frame", "l_partkey % 50 AS chunk", "l_orderkey AS o", "CAST(l_quantity AS FLOAT) AS x",
                                                       "CAST(l_extendedprice / 1000 AS FLOAT) AS y", "CAST(l_discount * 100 AS FLOAT) AS z",
                                                       "CAST(l_tax * 1000 AS INT) AS grey", "l_linenumber AS views")
    chunked = points.groupBy("frame", "chunk", (F.col("o") % 64).alias("slice")).agg(F.collect_list(F.struct("x", "y", "z", "grey", "views")).alias("rows"))
    path = F.concat_ws("/", F.lit("frames"), F.concat(F.col("frame"), F.lit("_"), F.col("chunk"), F.lit(".ply")))
    return chunked.select(path.alias("path"), "rows").mapInArrow(encode, "path string, content binary")


def a4(spark, sf):
    rows = files.decode_clouds(_ply(spark, sf))
    frame = F.regexp_extract("path", r"(\d+)_\d+\.ply$", 1).cast("long")
    return rows.groupBy(frame.alias("frame")).agg(F.count("*").alias("points"), quantise(F.avg("x")).alias("x"), quantise(F.avg("y"), 3).alias("y"),
                                                  quantise(F.avg("grey")).alias("grey"), F.sum("views").alias("views"))


def a5(spark, sf):
    poses = b.poses(spark, sf).select("frame", "lost", "ex", *[F.col(c).cast("string").alias(c) for c in ("qw", "qx", "qy", "tx", "qz", "ty", "tz")])
    data = F.concat_ws(", ", "qw", "qx", "qy", "tx", F.lit("0."), F.lit("1."), "qz", "ty", F.lit("0."), F.lit("0."), F.lit("1."), "tz", F.lit("0."), F.lit("0."), F.lit("0."), F.lit("1."))
    matrix = F.when(F.col("lost") == 0, F.concat(F.lit("\n      T_cam_world: !!opencv-matrix\n         rows: 4\n         cols: 4\n         dt: d\n         data: [ "), data, F.lit(" ]"))).otherwise("")
    text = F.concat(F.lit("%YAML:1.0\n---\nmetadata:\n   script: \"track\"\nframes:\n   -\n      name: \""), "frame", F.lit(".png\"\n      lost: "), F.col("lost").cast("double"), matrix, F.lit("\n"))
    decoded = files.decode_trajectories(poses.select(F.concat(F.lit("poses/"), "frame").alias("path"), text.alias("value")))
    return decoded.select("frame", quantise(F.col("T")[3]).alias("tx"), quantise(F.col("T")[11]).alias("tz"), F.col("diag")["lost"].alias("lost"), F.col("metadata")["script"].alias("script"))


def a6(spark, sf):
    d = b.detections(spark, sf)
    corners = F.array(*[F.array(F.col("u") + k, F.col("v") - k) for k in range(4)])
    grouped = d.groupBy("channel", "camera", "image").agg(F.sort_array(F.collect_list(F.struct(F.col("tag").alias("id"), corners.alias("c")))).alias("_r"))
    body = F.struct(F.transform("_r", lambda r: r["id"]).alias("ids"), F.transform("_r", lambda r: r["c"]).alias("corners"))
    text = F.to_json(F.struct(F.create_map(F.col("camera"), F.create_map(F.col("image").cast("string"), body)).alias("cameras")))
    flat = files.flatten_detections(grouped.select("channel", text.alias("value")), ["channel"])
    rejected = d.where("u > 1500").select("channel", "camera", F.col("image").cast("string").alias("image"), "tag")
    return quantised(files.board_tags(flat, rejected, ["channel"]).select("channel", "camera", "image", "tag", F.col("quad")[3]["u"].alias("u"), F.col("quad")[3]["v"].alias("v")), "u", "v")


def a7(spark, sf):
    rows = b.summary_rows(spark, sf)
    new = rows.where("version % 5 = 0 AND rms_mm > 200000").withColumn("rms_mm", F.col("rms_mm") / 2)
    return quantised(store.upsert(rows.where("version % 5 <> 0"), new, ["session", "scan", "method"]), "rms_mm", digits=2)


def a8(spark, sf):
    docs = b.table(spark, sf, "documents").select(F.col("source").alias("folder"), F.concat_ws("/", "lang", F.concat(F.lit("d"), "doc_id")).alias("path"),
                                                  F.encode("text", "UTF-8").alias("content"))
    return files.digest(docs)


def a9(spark, sf):
    record = store.manifest(spark, "survey", {"voxel": 1.0}, a8(spark, sf), [{"run": 1}])
    return record.select("experiment", F.size("input_digests").cast("long").alias("inputs"), "configs", "runs")


def a10(spark, sf):
    rows = b.summary_rows(spark, sf)
    return store.skip_done(rows.select("session", "scan", "method").distinct(), rows.where("rms_mm > 485000"), ["session", "scan", "method"])


def a11(spark, sf):
    settings = b.table(spark, sf, "part").select((F.col("p_size") % 7).cast("long").alias("block"), (F.col("p_partkey") % 11).alias("window")).distinct()
    cache = settings.where("block < 4").withColumn("settings_hash", store.settings_hash(["block", "window"])).select("settings_hash")
    return store.not_cached(settings, cache, ["block", "window"]).select("block", "window")


def a12(spark, sf):
    rows = b.summary_rows(spark, sf)
    axes = [rows.select("session").distinct(), rows.select("scan").distinct()]
    return store.job_matrix(axes, rows.select("session", F.concat("scan", F.when(F.col("version") % 2 == 0, "x").otherwise("")).alias("scan")))


def a13(spark, sf):
    rows = b.summary_rows(spark, sf).withColumn("key", F.concat("method", F.lit("/"), F.col("version") % 40))
    a, c = (rows.where(F.col("scan") == x).groupBy("key").agg(F.max(F.floor(F.col("rms_mm") / 100000)).alias("value")) for x in ("F", "O"))
    return store.settings_diff(a, c)


def _runs(spark, sf):
    costs = b.cost_samples(spark, sf)
    per = costs.groupBy(F.concat(F.lit("r"), "run").alias("run"), "stage").agg(F.count("*").alias("n"), F.sum("rss_mb").alias("wall"), F.max("rss_mb").alias("rss"))
    stage = F.struct(F.when(F.col("stage") == "error", 1).otherwise(0).alias("returncode"), F.col("wall").alias("wall_s"), F.col("rss").alias("peak_tree_rss_mb"),
                     F.when(F.col("stage") != "view", F.col("rss") * 2).alias("peak_gpu_mib"), (F.col("rss") * 3).alias("mean_cpu_percent"), F.lit(None).cast("double").alias("mean_gpu_util_percent"))
    docs = per.groupBy("run").agg(F.sum("n").alias("frames"), F.map_from_entries(F.collect_list(F.struct("stage", stage))).alias("stages"),
                                  F.map_from_entries(F.collect_list(F.struct(F.col("stage"), (F.col("wall") / 10).alias("w")))).alias("sub_seconds"))
    text = docs.select(F.to_json(F.struct("run", "frames", "stages", "sub_seconds")).alias("value"))
    return text.select(F.from_json("value", store.run_schema()).alias("r")).select("r.*")


def a14(spark, sf):
    return quantised(store.stage_records(_runs(spark, sf)).select("run", "frames", "stage", "wall_s", "peak_tree_rss_mb"), "wall_s", "peak_tree_rss_mb", digits=3)


def _errors(spark, sf):
    r = b.rasters(spark, sf)
    return s.pixel_errors(r.select("frame", "row_", "col_", "truth"), r.where("(row_ + col_) % 5 > 0").select("frame", "row_", "col_", "d"))


def j1(spark, sf):
    return s.truth_counts(_errors(spark, sf), ["frame"], 1.0)


def _sets(spark, sf):
    return _errors(spark, sf).withColumn("set", F.concat(F.lit("set"), F.col("frame") % 4))


def j2(spark, sf):
    return quantised(s.micro_scores(_sets(spark, sf), ["set"]), "precision", "recall", "f1", "median_error_px", "p90_error_px")


def j3(spark, sf):
    scores = s.micro_scores(_sets(spark, sf), ["set"])
    scenes = _sets(spark, sf).select("set").distinct().withColumn("scene", F.when(F.col("set") == "set0", "lab").otherwise("sea"))
    return quantised(s.macro_objective(scores, scenes), "objective", digits=6)


def j4(spark, sf):
    errors = _errors(spark, sf).withColumns({"recording": F.col("frame") % 3, "matcher": F.when(F.col("frame") % 2 == 0, "sgm").otherwise("net")})
    keys = ["recording", "matcher"]
    frames = errors.groupBy(*keys, "frame").agg(F.count("error").alias("pixels"), (F.sum("truth") / 100).alias("match_s"))
    out = s.matcher_summary(frames, s.micro_scores(errors, keys).select(*keys, "precision", "recall", "f1"), 48.0 * 64, keys)
    return quantised(out, "match_s_median", "pixels_median", "coverage_pct", "precision", "recall", "f1")


def j5(spark, sf):
    return quantised(s.robust_range(b.rasters(spark, sf), "d", ["frame"]), "low", "high")


def j5_shared(spark, sf):
    return quantised(s.robust_range(b.rasters(spark, sf), "d", ["frame"], shared=True), "low", "high")


def j6(spark, sf):
    return s.grid_samples(b.rasters(spark, sf), (48, 64), (16, 10))


def j7(spark, sf):
    return quantised(s.cost_rollup(b.cost_samples(spark, sf), ["stage", "run"], ["rss_mb"]), "peak_rss_mb", "mean_rss_mb")


def j8(spark, sf):
    frames = b.rasters(spark, sf).groupBy((F.col("frame") % 3).alias("run"), "frame").agg((F.sum("d") / 100).alias("seconds"))
    runs = frames.groupBy("run").agg((F.sum("seconds") * 1.1 + 5).alias("wall_s"))
    return quantised(s.subset_cost(runs, frames, frames.where("frame % 4 = 0"), ["run"]), "startup_s", "depth_s", digits=3)


def j9(spark, sf):
    c = b.cost_samples(spark, sf)
    part = {n: c.where(F.col("stage") == st).groupBy("run").agg(F.sum("rss_mb").alias(n)) for n, st in (("sfm_s", "click"), ("depth_s", "view"), ("tsdf_s", "error"))}
    part["depth_s"] = part["depth_s"].where("run < 3")
    return quantised(s.step_table(c.select("run").distinct(), part, ["run"]), "sfm_s", "depth_s", "tsdf_s", "total_s", digits=3)


def _long(spark, sf):
    c = b.cost_samples(spark, sf)
    rows = c.groupBy(F.col("run").alias("recording"), F.col("stage").alias("step"), F.date_trunc("day", "ts").alias("day")).agg(
        F.avg("rss_mb").alias("total_s"), F.max("rss_mb").alias("coverage"))
    return rows.withColumns({"ord": F.unix_date(F.col("day").cast("date")).cast("long"), "coverage": F.when(F.col("coverage") > 20, F.col("coverage"))}).drop("day")


def j10(spark, sf):
    return quantised(s.across_recordings(_long(spark, sf), ["total_s", "coverage"], ["step"]), "mean", "min", "max")


def j10_pivot(spark, sf):
    table = s.across_recordings(_long(spark, sf), ["total_s", "coverage"], ["step"])
    return quantised(s.pivot_measures(table, ["step"], ["total_s", "coverage"]), "total_s", "coverage")


def j11(spark, sf):
    return quantised(s.stage_costs(store.stage_records(_runs(spark, sf))), "ram_min_gb", "ram_max_gb", "gpu_gb", "cores", "gpu_util", "s_per_frame")


def _metrics(spark, sf):
    rows = b.summary_rows(spark, sf)
    fits = F.create_map(F.lit("on_board"), F.struct(F.count("*").alias("points"), F.avg("rms_mm").alias("rms_mm")),
                        F.lit("shape"), F.struct((F.count("*") * 2).alias("points"), (F.avg("rms_mm") / 2).alias("rms_mm")))
    return rows.where("version % 13 <> 0").groupBy(F.col("scan").alias("object"), "method").agg(fits.alias("fits"))


def j12(spark, sf):
    rows = s.explode_fits(_metrics(spark, sf).where("method <> 'm3_v1'"), ["object", "method"])
    grid = b.summary_rows(spark, sf).select(F.col("scan").alias("object"), "method").distinct()
    return quantised(s.accuracy_grid(rows, grid, "on_board"), "rms_mm", digits=2)


def j13(spark, sf):
    rows = b.summary_rows(spark, sf).groupBy("scan", F.when(F.col("version") % 9 == 0, F.regexp_extract("method", "^(m[0-9])", 1)).otherwise(F.col("method")).alias("method")).agg(
        (F.avg("rms_mm") / 500000).alias("coverage"), F.min("rms_mm").alias("rms_mm"))
    return quantised(s.voting_families(s.with_reliability(rows), ["scan"]).select("scan", "family", "k", "position", "coverage"), "coverage")


def j14(spark, sf):
    rows = b.summary_rows(spark, sf).withColumn("coverage", F.col("rms_mm") / 500000)
    return s.with_reliability(rows).groupBy("scan", "reliable").agg(F.count("*").alias("rows"))


QUERIES = {
    "a1_frame_pairs": a1, "a2_locate": a2, "a3_timestamps": a3, "a4_decode_clouds": a4, "a5_decode_trajectories": a5, "a6_flatten_detections": a6,
    "a7_upsert": a7, "a8_digest": a8, "a9_manifest": a9, "a10_skip_done": a10, "a11_not_cached": a11, "a12_job_matrix": a12, "a13_settings_diff": a13,
    "a14_stage_records": a14, "j1_truth_counts": j1, "j2_micro_scores": j2, "j3_macro_objective": j3, "j4_matcher_summary": j4, "j5_robust_range": j5,
    "j5_shared_range": j5_shared, "j6_grid_samples": j6, "j7_cost_rollup": j7, "j8_subset_cost": j8, "j9_step_table": j9, "j10_across_recordings": j10,
    "j10_pivot": j10_pivot, "j11_stage_costs": j11, "j12_accuracy_grid": j12, "j13_voting_families": j13, "j14_reliability": j14,
}

_ERR = """, e AS (SELECT frame, row_, col_, truth, CASE WHEN (row_ + col_) % 5 > 0 AND d > 0 THEN abs(d - truth) END AS error FROM rasters WHERE truth > 0)
"""


def _micro(keys):
    return f"""sc0 AS (SELECT {keys}, count(*) AS region, count(error) AS with_depth, count(*) FILTER (WHERE error <= 1) AS good,
  quantile_cont(error, 0.5) AS m, quantile_cont(error, 0.9) AS p FROM es GROUP BY {keys}),
sc AS (SELECT *, coalesce(good / nullif(with_depth, 0), 0) AS pr, coalesce(good / nullif(region, 0), 0) AS re FROM sc0),
sf AS (SELECT *, coalesce(2 * pr * re / nullif(pr + re, 0), 0) AS f1 FROM sc)"""


_STAGE = """, per AS (SELECT 'r' || run AS run, stage, count(*) AS n, sum(rss_mb) AS wall, max(rss_mb) AS rss FROM cost_samples GROUP BY run, stage),
fr AS (SELECT run, sum(n)::BIGINT AS frames FROM per GROUP BY run),
rec AS (SELECT per.run, frames, stage, wall AS wall_s, rss AS peak_tree_rss_mb, CASE WHEN stage <> 'view' THEN rss * 2 END AS gpu, rss * 3 AS cpu FROM per JOIN fr USING (run) WHERE stage <> 'error'
  UNION ALL SELECT per.run, frames, 'sfm_' || stage, wall / 10, NULL, NULL, NULL FROM per JOIN fr USING (run))
"""
_ACROSS = """, r AS (SELECT run AS recording, stage AS step, date_trunc('day', ts) AS d, avg(rss_mb) AS total_s, CASE WHEN max(rss_mb) > 20 THEN max(rss_mb) END AS coverage
  FROM cost_samples GROUP BY ALL),
l AS (SELECT recording, step, d, 'total_s' AS measure, total_s AS value FROM r UNION ALL SELECT recording, step, d, 'coverage', coverage FROM r),
f AS (SELECT recording, step, measure, arg_min(value, d) AS value FROM l WHERE value IS NOT NULL GROUP BY ALL),
ac AS (SELECT step, measure, avg(value) AS mean, min(value) AS min, max(value) AS max, count(*) AS recordings FROM f GROUP BY ALL)
"""

ORACLES = {
    "a1_frame_pairs": """WITH p AS (SELECT page_id, regexp_replace(regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1), '^.*/', '') AS name FROM pages)
        SELECT DISTINCT a.name FROM p a JOIN p b USING (name) WHERE a.page_id % 3 <> 0 AND b.page_id % 3 <> 1 AND name LIKE '%5' ORDER BY name""",
    "a2_locate": sql("summary_rows", body="""SELECT CASE WHEN version % 7 = 0 OR version % 11 = 0 THEN NULL ELSE session END AS session,
        CASE WHEN version % 7 = 0 OR version % 11 = 0 THEN NULL ELSE scan END AS scan, CASE WHEN version % 7 = 0 OR version % 11 = 0 THEN NULL ELSE method END AS method,
        count(*) AS files FROM summary_rows GROUP BY 1, 2, 3"""),
    "a3_timestamps": sql("timestamps", body=""", r AS (SELECT camera, pts_ns, row_number() OVER (PARTITION BY camera ORDER BY pts_ns) - 1 AS frame, count(*) OVER (PARTITION BY camera) AS n
        FROM timestamps) SELECT camera, frame, pts_ns FROM r WHERE frame < CASE WHEN camera = 'left' THEN n - 40 ELSE n + 5 END"""),
    "a4_decode_clouds": f"""SELECT l_suppkey AS frame, count(*) AS points, {q('avg(l_quantity)')} AS x, {q('avg((l_extendedprice / 1000)::FLOAT::DOUBLE)', 3)} AS y,
        {q('avg(trunc(l_tax * 1000))')} AS grey, sum(l_linenumber)::BIGINT AS views FROM lineitem GROUP BY l_suppkey""",
    "a5_decode_trajectories": sql("poses", body=f"""SELECT frame || '.png' AS frame, CASE WHEN lost = 0 THEN {q('tx')} END AS tx, CASE WHEN lost = 0 THEN {q('tz')} END AS tz,
        lost::DOUBLE AS lost, 'track' AS script FROM poses"""),
    "a6_flatten_detections": sql("detections", body=f""", o AS (SELECT channel, camera, image, tag, min(u) + 3 AS u, min(v) - 3 AS v, bool_or(u > 1500) AS bad FROM detections WHERE tag < 70
        GROUP BY channel, camera, image, tag HAVING count(*) = 1)
        SELECT channel, camera, image::VARCHAR AS image, tag, {q('u')} AS u, {q('v')} AS v FROM o WHERE NOT bad"""),
    "a7_upsert": sql("summary_rows", body=f""", n AS (SELECT session, scan, method, version, rms_mm / 2 AS rms_mm FROM summary_rows WHERE version % 5 = 0 AND rms_mm > 200000)
        SELECT session, scan, method, version, {q('rms_mm', 2)} AS rms_mm FROM (SELECT * FROM summary_rows s WHERE version % 5 <> 0 AND NOT EXISTS (SELECT 1 FROM n
        WHERE n.session = s.session AND n.scan = s.scan AND n.method = s.method) UNION ALL SELECT * FROM n)"""),
    "a10_skip_done": sql("summary_rows", body="""SELECT DISTINCT session, scan, method FROM summary_rows s WHERE NOT EXISTS (SELECT 1 FROM summary_rows d WHERE d.rms_mm > 485000
        AND d.session = s.session AND d.scan = s.scan AND d.method = s.method)"""),
    "a11_not_cached": "SELECT DISTINCT (p_size % 7)::BIGINT AS block, p_partkey % 11 AS \"window\" FROM part WHERE p_size % 7 >= 4",
    "a12_job_matrix": sql("summary_rows", body="""SELECT a.session, c.scan FROM (SELECT DISTINCT session FROM summary_rows) a, (SELECT DISTINCT scan FROM summary_rows) c
        UNION SELECT session, scan || CASE WHEN version % 2 = 0 THEN 'x' ELSE '' END FROM summary_rows"""),
    "a13_settings_diff": sql("summary_rows", body=""", r AS (SELECT scan, method || '/' || (version % 40) AS key, max(floor(rms_mm / 100000))::BIGINT AS v FROM summary_rows GROUP BY ALL)
        SELECT coalesce(a.key, b.key) AS key, a.v AS left_value, b.v AS right_value FROM (SELECT * FROM r WHERE scan = 'F') a FULL JOIN (SELECT * FROM r WHERE scan = 'O') b ON a.key = b.key
        WHERE a.v IS DISTINCT FROM b.v"""),
    "a14_stage_records": sql("cost_samples", body=_STAGE + f"SELECT run, frames, stage, {q('wall_s', 3)} AS wall_s, {q('peak_tree_rss_mb', 3)} AS peak_tree_rss_mb FROM rec"),
    "j1_truth_counts": sql("rasters", body=_ERR + """SELECT frame, count(*) AS region, count(error) AS with_depth, count(*) FILTER (WHERE error <= 1) AS good FROM e GROUP BY frame"""),
    "j2_micro_scores": sql("rasters", body=_ERR + ", es AS (SELECT *, 'set' || (frame % 4) AS set FROM e), " + _micro("set") + f"""
        SELECT set, region, with_depth, good, {q('pr')} AS precision, {q('re')} AS recall, {q('f1')} AS f1, {q('m')} AS median_error_px, {q('p')} AS p90_error_px FROM sf"""),
    "j3_macro_objective": sql("rasters", body=_ERR + ", es AS (SELECT *, 'set' || (frame % 4) AS set FROM e), " + _micro("set") + f""",
        sn AS (SELECT CASE WHEN set = 'set0' THEN 'lab' ELSE 'sea' END AS scene, avg(f1) AS f1 FROM sf GROUP BY 1)
        SELECT {q('avg(f1)', 6)} AS objective, count(*) AS scenes FROM sn"""),
    "j4_matcher_summary": sql("rasters", body=_ERR + ", es AS (SELECT *, frame % 3 AS recording, CASE WHEN frame % 2 = 0 THEN 'sgm' ELSE 'net' END AS matcher FROM e), "
        + _micro("recording, matcher") + f""", fr AS (SELECT recording, matcher, frame, count(error) AS pixels, sum(truth) / 100 AS sec FROM es GROUP BY ALL),
        a AS (SELECT recording, matcher, count(*) AS frames, quantile_cont(sec, 0.5) AS s, quantile_cont(pixels, 0.5) AS p FROM fr GROUP BY ALL)
        SELECT a.recording, a.matcher, frames, {q('a.s')} AS match_s_median, {q('a.p')} AS pixels_median, {q('100 * a.p / 3072e0')} AS coverage_pct, {q('pr')} AS precision,
        {q('re')} AS recall, {q('f1')} AS f1 FROM a JOIN sf USING (recording, matcher)"""),
    "j5_robust_range": sql("rasters", body=f""", b AS (SELECT frame, quantile_cont(d, 0.05) AS l, quantile_cont(d, 0.95) AS h FROM rasters GROUP BY frame)
        SELECT frame, {q('l - 0.1e0 * (h - l)')} AS low, {q('h + 0.1e0 * (h - l)')} AS high FROM b"""),
    "j5_shared_range": sql("rasters", body=f""", b AS (SELECT frame, quantile_cont(d, 0.05) AS l, quantile_cont(d, 0.95) AS h FROM rasters GROUP BY frame)
        SELECT frame, {q('(SELECT min(l - 0.1e0 * (h - l)) FROM b)')} AS low, {q('(SELECT max(h + 0.1e0 * (h - l)) FROM b)')} AS high FROM b"""),
    "j6_grid_samples": sql("rasters", body=""", g AS (SELECT floor((x + 0.5e0) * 64 / 16)::BIGINT AS c, floor((y + 0.5e0) * 48 / 10)::BIGINT AS r FROM range(16) a(x), range(10) b(y))
        SELECT frame, count(*) FILTER (WHERE d > 0 AND c IS NOT NULL) AS found, 160::BIGINT AS samples FROM rasters LEFT JOIN g ON c = col_ AND r = row_ GROUP BY frame"""),
    "j7_cost_rollup": sql("cost_samples", body=f"""SELECT stage, run, {q('max(rss_mb)')} AS peak_rss_mb, {q('avg(rss_mb)')} AS mean_rss_mb, count(*) AS samples FROM cost_samples GROUP BY stage, run"""),
    "j8_subset_cost": sql("rasters", body=f""", f AS (SELECT frame % 3 AS run, frame, sum(d) / 100 AS s FROM rasters GROUP BY frame),
        r AS (SELECT run, sum(s) * 1.1e0 + 5 AS w, sum(s) AS a, sum(s) FILTER (WHERE frame % 4 = 0) AS m FROM f GROUP BY run)
        SELECT run, {q('w - a', 3)} AS startup_s, {q('w - a + coalesce(m, 0)', 3)} AS depth_s FROM r"""),
    "j9_step_table": sql("cost_samples", body=f""", p AS (SELECT run, sum(rss_mb) FILTER (WHERE stage = 'click') AS a, sum(rss_mb) FILTER (WHERE stage = 'view' AND run < 3) AS b,
        sum(rss_mb) FILTER (WHERE stage = 'error') AS c FROM cost_samples GROUP BY run)
        SELECT run, {q('a', 3)} AS sfm_s, {q('b', 3)} AS depth_s, {q('c', 3)} AS tsdf_s, {q('a + b + c', 3)} AS total_s FROM p"""),
    "j10_across_recordings": sql("cost_samples", body=_ACROSS + f"SELECT step, measure, {q('mean')} AS mean, {q('min')} AS min, {q('max')} AS max, recordings FROM ac"),
    "j10_pivot": sql("cost_samples", body=_ACROSS + f"""SELECT step, {q("max(mean) FILTER (WHERE measure = 'total_s')")} AS total_s,
        {q("max(mean) FILTER (WHERE measure = 'coverage')")} AS coverage FROM ac GROUP BY step"""),
    "j11_stage_costs": sql("cost_samples", body=_STAGE + f"""SELECT stage, count(*) AS runs, {q('min(peak_tree_rss_mb) / 1024')} AS ram_min_gb, {q('max(peak_tree_rss_mb) / 1024')} AS ram_max_gb,
        {q('max(gpu) / 1024')} AS gpu_gb, {q('avg(cpu) / 100')} AS cores, NULL::DOUBLE AS gpu_util,
        {q('CASE WHEN min(frames) = max(frames) THEN quantile_cont(wall_s / frames, 0.5) ELSE regr_slope(wall_s, frames) END')} AS s_per_frame FROM rec GROUP BY stage"""),
    "j12_accuracy_grid": sql("summary_rows", body=f""", m AS (SELECT scan AS object, method, count(*) AS points, avg(rms_mm) AS rms FROM summary_rows
        WHERE version % 13 <> 0 AND method <> 'm3_v1' GROUP BY ALL)
        SELECT g.object, g.method, CASE WHEN m.method IS NOT NULL THEN 'on_board' END AS fit, points, {q('rms', 2)} AS rms_mm, m.method IS NULL AS blank
        FROM (SELECT DISTINCT scan AS object, method FROM summary_rows) g LEFT JOIN m ON g.object = m.object AND g.method = m.method"""),
    "j13_voting_families": sql("summary_rows", body=f""", r AS (SELECT scan, CASE WHEN version % 9 = 0 THEN substr(method, 1, 2) ELSE method END AS method, avg(rms_mm) / 500000 AS coverage
        FROM summary_rows GROUP BY 1, 2),
        f AS (SELECT scan, CASE WHEN contains(method, '_v') THEN substr(method, 1, 2) ELSE method END AS family, CASE WHEN contains(method, '_v') THEN substr(method, 5)::BIGINT END AS k, coverage
          FROM r WHERE coverage >= 0.15)
        SELECT scan, family, k, row_number() OVER (PARTITION BY scan, family ORDER BY k NULLS FIRST) AS position, {q('coverage')} AS coverage FROM f"""),
    "j14_reliability": sql("summary_rows", body="SELECT scan, rms_mm / 500000 >= 0.15 AS reliable, count(*) AS rows FROM summary_rows GROUP BY ALL"),
}
