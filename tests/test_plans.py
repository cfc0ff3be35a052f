"""Plans, surfaces, sources and streaming on small inputs."""

import json
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from geostrata import storage
from geostrata.config import DetectionConfig, LabelConfig, LineConfig, LinkConfig, TileConfig
from geostrata.operators import surface, tiles
from geostrata.plans import batch, detection, label_dataset, reconstruction
from geostrata.sources import fault_lines, files, segy
from geostrata.sources import surfaces as surface_files
from geostrata.sources.segy import SegyDataSource, ibm_to_float


def test_detection_finds_two_slanted_lines(spark):
    rows = [(1, x, 20 + x // 2 + d, 0.9 if d == 0 else 0.6) for x in range(60) for d in (-1, 0, 1)]
    rows += [(1, x, 100 + x // 2 + d, 0.9 if d == 0 else 0.6) for x in range(60) for d in (-1, 0, 1)]
    config = DetectionConfig(min_cluster_points=20, min_vertical_range=20, merge_distance=30, max_gap=5)
    stages = detection.detect_lines(spark.createDataFrame(rows, "inline_number int, x int, z int, p double"), config)
    counts = {x["stage"]: (x["points"], x["clusters"]) for x in detection.stage_counts(stages).collect()}
    assert counts["candidates"][0] == 360 and counts["large"][1] == 2
    lines = stages["interpolated"].toPandas()
    for label, offset in ((0, 20), (1, 100)):
        part = lines[lines["label"] == label]
        assert len(part) > 40 and (part["z"] - (offset + part["x"] / 2)).abs().max() <= 2


def test_smoothing_matches_a_plain_sum():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(5, 9))
    w = surface.gaussian_weights(1.0)
    r = len(w) // 2
    want = np.zeros_like(v)
    for i in range(5):
        for j in range(9):
            for a in range(-r, r + 1):
                for b in range(-r, r + 1):
                    want[i, j] += w[a + r] * w[b + r] * v[min(4, max(0, i + a)), min(8, max(0, j + b))]
    assert np.allclose(surface.smooth(v, (1.0, 1.0)), want)
    assert np.array_equal(surface.smooth(v, (0, 0)), v)


def test_lines_are_turned_alike(spark):
    """Against turning each line in sequence by the ends of the line before, ties left as they are."""
    rng = np.random.default_rng(4)
    lines = rng.integers(0, 3, size=(40, 3, 2)).astype(float)
    want = lines.copy()
    apart = lambda p, q: float(np.hypot(*(p - q)))
    for k in range(1, len(want)):
        p, q = want[k - 1], want[k]
        if apart(p[0], q[-1]) + apart(p[-1], q[0]) < apart(p[0], q[0]) + apart(p[-1], q[-1]):
            want[k] = q[::-1]
    rows = [("t", k, i, *map(float, lines[k, i])) for k in range(40) for i in range(3)]
    got = surface.turned_alike(spark.createDataFrame(rows, "track_id string, sec int, i int, x double, z double"), 3, ["track_id"]).orderBy("sec", "i").toPandas()
    assert np.array_equal(got[["x", "z"]].to_numpy().reshape(40, 3, 2), want)


def test_reconstruction_gives_one_smooth_surface(spark, tmp_path):
    rows = [(s, "0", 100.0 + k, 500 + 0.4 * k + 0.05 * s) for s in range(6) for k in range(21)]
    config = LinkConfig(samples=16)
    out = reconstruction.reconstruct(spark.createDataFrame(rows, "sec int, cluster string, x double, z double"), config)
    v = out["surfaces"].toPandas()
    assert len(v) == 6 * 16 and v["track_id"].unique().tolist() == ["fault_0001"] and set(v["inline"]) == set(range(300, 306))
    assert np.isfinite(v[["profile", "depth", "rmse"]]).all().all()
    summary = reconstruction.track_summary(out["tracks"], out["matches"]).first()
    assert summary["lines"] == 6 and summary["line_ids"][0] == "line_0_c0"
    at = surface.flat_offsets(out["surfaces"]).first()
    assert (at["vertex_offset"], at["vertices"], at["faces"], at["face_offset"]) == (0, 96, 150, 0)
    reconstruction.save_reconstruction(out, f"{tmp_path}/run", config, {"coordinates": {"coordinate_mode": "downsampled_array_index", "crossline_stride": 2, "sample_stride": 4}})
    record = surface_files.run_metadata(spark, f"{tmp_path}/run", wanted=True)
    assert record["counts"]["track_edge"] == 5 and record["counts"]["surfaces"] == 1 and surface_files.metadata_strides(record) == (2, 4)
    assert spark.read.parquet(f"{tmp_path}/run/faces").count() == 150 and spark.read.parquet(f"{tmp_path}/run/selected_links").count() == 5
    assert [x["source_key"] for x in spark.read.parquet(f"{tmp_path}/run/track_membership").orderBy("member_order").collect()] == [f"line_{k}" for k in range(6)]
    with pytest.raises(ValueError, match="not empty"):
        reconstruction.save_reconstruction(out, f"{tmp_path}/run", config)


def test_missing_inlines_of_a_track_are_interpolated(spark):
    member = spark.createDataFrame([("t", 0, "a", 0), ("t", 1, "b", 2)], "track_id string, member_order int, line_id string, sec int")
    points = spark.createDataFrame([(k, float(x), z) for k, z in (("a", 0.0), ("b", 4.0)) for x in range(5)], "line_id string, x double, z double")
    v = surface.track_surfaces(member, points, LinkConfig(samples=5, sigma=(0.0, 0.0))).toPandas()
    assert sorted(set(v["inline"])) == [300, 301, 302] and set(v.loc[v["row"] == 1, "depth"]) == {2.0} and v["rmse"].max() == 0


def test_strides_of_a_run():
    record = {"input": {"coordinates": {"coordinate_mode": "downsampled_array_index", "crossline_stride": 2, "sample_stride": 3}}}
    assert surface_files.resolve_strides(record) == surface_files.resolve_strides(record, 2) == (2, 3)
    assert surface_files.resolve_strides(None, 1, 2) == surface_files.resolve_strides({}, 1, 2) == (1, 2)
    for given in ((record, 4, None), (None, 1, None), ({}, None, 2)):
        with pytest.raises(ValueError):
            surface_files.resolve_strides(*given)


def test_flat_surfaces_are_read_and_catalogued(spark, tmp_path):
    faces = surface_files.grid_faces(2, 3)
    held = {
        "surface_ids": np.array(["s1", "s2"]), "vertices": np.arange(36, dtype=float).reshape(12, 3), "vertex_offsets": np.array([0, 6, 12]), "faces": np.concatenate([faces, faces + 6]),
        "face_offsets": np.array([0, 4, 8]), "grid_shapes": np.array([[2, 3], [2, 3]]), "observation_rmse": np.array([0.5, 0.25]),
    }
    np.savez(tmp_path / "a.npz", **held)
    v = surface_files.read_flat_npz(spark, [str(tmp_path / "a.npz")])
    assert v.count() == 12 and v.where("surface_id = 's2' and row = 1 and col = 2").first()["sample"] == 35.0
    inventory = {x["surface_id"]: x for x in surface_files.inventory_table(v, surface_files.input_format("a.npz")).collect()}
    assert inventory["s1"]["triangles"] == 4 and inventory["s2"]["sample_min"] == 20.0
    surface_files.save_catalogue(v, f"{tmp_path}/out", "flat-npz", {"a": 1}, slices=[0.0, 18.0])
    assert spark.read.option("header", True).csv(f"{tmp_path}/out/intersections").count() == 2
    axis = lambda n: spark.createDataFrame([(k, 10.0 * k) for k in range(n)], "idx int, value double")
    assert surface_files.mapped(v.where("surface_id = 's1' and row = 0 and col = 1"), axis(40), axis(40), axis(40)).first()["sample_coordinate"] == 50.0
    for name, bad in (("faces", held["faces"][::-1][:, [0, 0, 2]]), ("grid_shapes", np.array([[3, 2], [2, 2]])), ("vertex_offsets", np.array([0, 7, 12])), ("vertices", np.full((12, 3), np.nan))):
        with pytest.raises(ValueError):
            surface_files.check_flat(held | {name: bad})
    with pytest.raises(ValueError):
        surface_files.input_format("a.pkl")


def write_segy(path, inlines, xlines, samples, code=5):
    with open(path, "wb") as f:
        head = bytearray(3600)
        head[3216:3218], head[3220:3222], head[3224:3226] = struct.pack(">H", 4000), struct.pack(">H", samples), struct.pack(">H", code)
        f.write(head)
        for i in inlines:
            for x in xlines:
                trace = bytearray(240)
                trace[188:196] = struct.pack(">ii", i, x)
                f.write(trace + np.arange(samples, dtype=">f4").tobytes() if code == 5 else trace + struct.pack(">I", 0x42640000) * samples)


def test_segy_cube(spark, tmp_path):
    path = str(tmp_path / "a.sgy")
    write_segy(path, [10, 11, 12], [5, 6, 7, 8], 9)
    spark.dataSource.register(SegyDataSource)
    df = spark.read.format("segy").option("path", path).option("xlineStride", 2).option("sampleStride", 3).load()
    got = df.where("inline_number = 11").orderBy("xl_pos").collect()
    assert df.count() == 6 and [x["crossline"] for x in got] == [5, 7] and got[0]["amplitudes"] == [0.0, 3.0, 6.0]
    write_segy(path, [1], [1], 2, code=1)
    assert spark.read.format("segy").option("path", path).load().first()["amplitudes"] == [100.0, 100.0]
    assert ibm_to_float(np.array([0xC276A000], np.uint32))[0] == -118.625
    with pytest.raises(Exception, match="not in the file"):
        spark.read.format("segy").option("path", path).option("inline", 99).load().count()
    write_segy(path, [10, 11, 12], [5, 6, 7, 8], 9)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        whole = spark.read.format("segy").option("path", path).option("pushFilters", True).load()
        assert whole.where("inline_number = 11").rdd.getNumPartitions() == 1 and whole.where("inline_number = 11").count() == 4
        assert whole.where("inline_number = 99").count() == 0 and whole.where("inline_number = 10 and inline_number = 11").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert spark.read.format("segy").option("path", path).option("section", 2).load().select("inline_number").distinct().first()[0] == 12
    record = segy.geometry_record(segy.geometry(path))
    assert record["trace_count"] == 12 and record["inline"]["regular_step"] == 1 and record["sample_coordinate"]["maximum"] == 32.0


def test_segy_line_of_traces(spark, tmp_path):
    """A file that is no cube is one line, section 0; a hidden swap of traces is found when they are read."""
    path = str(tmp_path / "line.sgy")
    write_segy(path, [10, 11], [5, 6, 7], 4)
    raw = bytearray(open(path, "rb").read())
    size = 240 + 16
    at = 3600 + 4 * size + 192  # the second trace of the second inline
    raw[at : at + 4] = struct.pack(">i", 9)
    open(path, "wb").write(raw)
    with pytest.raises(Exception, match="regular cube"):
        spark.read.format("segy").option("path", path).load().count()
    line = spark.read.format("segy").option("path", path).option("layout", "line").load()
    assert line.count() == 6 and line.where("inline_number is not null").count() == 0
    open(path, "wb").write(raw[: 3600 + 5 * size])
    assert spark.read.format("segy").option("path", path).load().count() == 5
    with pytest.raises(Exception, match="regular cube"):
        spark.read.format("segy").option("path", path).option("layout", "cube").load().count()
    with pytest.raises(Exception, match="section 0"):
        spark.read.format("segy").option("path", path).option("section", 1).load().count()


def section_file(path, inlines, nx, nz):
    """A cube whose amplitude is 1 along the line z = x + inline and small elsewhere."""
    with open(path, "wb") as f:
        head = bytearray(3600)
        head[3216:3218], head[3220:3222], head[3224:3226] = struct.pack(">H", 4000), struct.pack(">H", nz), struct.pack(">H", 5)
        f.write(head)
        for i in inlines:
            for x in range(nx):
                trace = bytearray(240)
                trace[188:196] = struct.pack(">ii", i, x)
                f.write(trace + np.exp(-0.5 * (np.arange(nz) - x - i) ** 2).astype(">f4").tobytes())


def test_a_cube_becomes_fault_lines(spark, tmp_path):
    path = str(tmp_path / "cube.sgy")
    section_file(path, [0, 1, 2], 40, 48)
    link = LinkConfig(inline_origin=0, inline_start=0, inline_end=2)
    config = DetectionConfig(threshold=0.9, max_gap=2, eps=3, second_eps=3, min_samples=2, second_min_samples=2, merge_distance=6, min_cluster_points=10, min_vertical_range=10, support_radius=2)
    scorer = lambda x: 1 / (1 + np.exp(-2 * x.astype(float)))
    folder = f"{tmp_path}/lines"
    record = batch.run_batch(spark, path, scorer, folder, link, 1, 1, TileConfig((32, 32), 8), config)
    assert record["counts"]["sections"] == record["counts"]["fault_lines"] == 3 and record["coordinates"]["processed_section_shape"] == [40, 48]
    points, resolved = fault_lines.read_fault_lines(spark, folder, inline_start=1)
    got = points.toPandas()
    assert set(got["sec"]) == {1, 2} and (got["z"] - got["x"] - got["sec"]).abs().max() <= 1 and resolved.inline_start == 1
    counts = spark.read.parquet(f"{storage.current_version(spark, folder)}/stage_counts")
    assert counts.where("stage = 'interpolated'").count() == 3
    whole, c = fault_lines.read_fault_lines(spark, folder)
    assert reconstruction.reconstruct(whole, c, surfaces=False)["tracks"].count() == 3
    found = detection.golden_mismatches(counts, 0, {"interpolated": (1, 1), "large": (None, 1)}).collect()
    assert [x["stage"] for x in found] == ["interpolated"]
    for wanted, why in (({"inline_origin": 5}, "conflicts"), ({"inline_end": 9}, "beyond"), ({"colour": 1}, "not part")):
        with pytest.raises(ValueError, match=why):
            fault_lines.read_fault_lines(spark, folder, **wanted)
    with pytest.raises(Exception, match="(?i)exists"):
        batch.run_batch(spark, path, scorer, folder, link, 1, 1, TileConfig((32, 32), 8), config)
    with pytest.raises(ValueError, match="missing"):
        batch.run_batch(spark, path, scorer, f"{tmp_path}/more", LinkConfig(inline_origin=0, inline_start=0, inline_end=5), 1, 1)


def test_sidecars_are_reconciled(spark, tmp_path):
    config = LinkConfig(inline_origin=0, inline_start=0, inline_end=3)
    lines = spark.createDataFrame([(s, "b", x, 2) for s in (0, 2) for x in range(3)] + [(0, "a", x, 3) for x in range(3)], "inline_number int, label string, x int, z int")
    points = fault_lines.normalised(lines, 5, 5)
    sections = spark.createDataFrame([(s,) for s in range(4)], "inline_number int")
    record = fault_lines.write_fault_lines(points, sections, f"{tmp_path}/f", config)
    assert record["counts"] == {"sections": 4, "nonempty_sections": 2, "fault_lines": 3, "points": 9}
    version = storage.current_version(spark, f"{tmp_path}/f")
    saved, rows = spark.read.parquet(f"{version}/points"), spark.read.parquet(f"{version}/sections")
    assert fault_lines.reconcile(saved, rows, record).count() == 0
    assert fault_lines.reconcile(saved.where("x > 0"), rows, record).count() == 2
    assert [x["problem"] for x in fault_lines.reconcile(saved, rows, record | {"counts": record["counts"] | {"points": 1}}).collect()] == ["counts.points is inconsistent"]
    with pytest.raises(ValueError, match="contract"):
        fault_lines.normalised(lines, 2, 5)
    with pytest.raises(ValueError, match="off the declared"):
        fault_lines.write_fault_lines(points, spark.createDataFrame([(9,)], "inline_number int"), f"{tmp_path}/g", config)
    spark.createDataFrame([(json.dumps(record | {"schema_version": "9"}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{version}/metadata")
    with pytest.raises(ValueError, match="schema_version"):
        fault_lines.read_fault_lines(spark, f"{tmp_path}/f")


def test_a_label_dataset_from_files(spark, tmp_path):
    """Two lines to patches: pixels, labels, splits, files and checksums against NumPy."""
    import hashlib

    lines = []
    for n, side in ((1, "train"), (2, "val")):
        section_file(tmp_path / f"s{n}.sgy", [n], 24, 24)
        (tmp_path / f"p{n}.csv").write_text("x,z,f\n" + "".join(f"{x},{x + n},7\n" for x in range(0, 24, 4)))
        lines.append({"inline_id": n, "segy_path": str(tmp_path / f"s{n}.sgy"), "csv_path": str(tmp_path / f"p{n}.csv"), "fault_id_col": 2, "split": side})
    (tmp_path / "lines.json").write_text(json.dumps(lines))
    config = LabelConfig(ellipse=(1, 1), patch_size=16, stride=8)
    out = label_dataset.build_label_dataset(spark, files.load_lines(spark, str(tmp_path / "lines.json")), f"{tmp_path}/out", config, npy=True, dat=True)
    manifest = out["manifest"].toPandas()
    assert list(manifest.columns) == files.MANIFEST and set(manifest["split"]) == {"train", "val"} and manifest["sample_id"].is_unique
    for row in manifest.itertuples():
        image, label = np.load(f"{tmp_path}/out/{row.seismic_file}"), np.load(f"{tmp_path}/out/{row.label_file}")
        n, x0, z0 = int(row.inline_id), int(row.x0), int(row.z0)
        x, z = np.arange(x0, x0 + 16)[:, None], np.arange(z0, z0 + 16)[None]
        want = np.exp(-0.5 * (z - x - n) ** 2)
        assert np.allclose(image, (want - want.min()) / (want.max() - want.min() + 1e-8), atol=1e-4) and image.dtype == np.float32
        on = np.abs(x + n - z) + 0 * x <= 1
        assert (label.astype(bool) <= on).all() and label.sum() == int(row.label_pixels) > 0
        assert hashlib.sha256(open(f"{tmp_path}/out/{row.seismic_dat_file}", "rb").read()).hexdigest() == row.seismic_dat_sha256
    assert files.read_patches(spark, f"{tmp_path}/out/train/seismic/*.npy", 16).count() == files.read_patches(spark, f"{tmp_path}/out/train/seismic/*.dat", 16).count() > 0
    with pytest.raises(ValueError, match="not empty"):
        files.need_empty(spark, f"{tmp_path}/out")
    one = LineConfig.of(lines[0])
    every = label_dataset.line_records(*label_dataset.read_lines(spark, [one]), label_dataset.line_table(spark, [one], [("", "")]), LabelConfig(ellipse=(1, 1), patch_size=16, stride=8, positive_only=False))
    assert every.count() == 4


def test_lines_are_checked_before_they_are_read(spark, tmp_path):
    line = lambda n, side=None: LineConfig(n, "a", "b", side)
    files.check_lines([line(1, "train"), line(2, "val")])
    for given, config, why in (
        ([], {}, "no line"), ([line(1, "train"), line(2)], {}, "some lines"), ([line(1, "train")], {}, "no line"), ([line(1, "x")], {}, "neither"), ([line(1, "train"), line(1, "val")], {}, "both sides"),
        ([line(1)], {"val_inlines": (2,)}, "unknown"), ([line(1)], {"val_inlines": (1,)}, "leave an inline"), ([line(1, "train"), line(2, "val")], {"strategy": "spatial"}, "inline strategy"),
    ):
        with pytest.raises(ValueError, match=why):
            files.check_lines(given, LabelConfig(**config))
    (tmp_path / "c.csv").write_text("x,z\n1.5,2\n,3\nnan,4\n2.5,-6\n")
    got = files.read_picks(spark, LineConfig(1, "a", str(tmp_path / "c.csv"))).collect()
    assert [(x["x_idx"], x["z_idx"]) for x in got] == [(2, 2), (2, -6)]
    with pytest.raises(ValueError, match="columns"):
        files.read_picks(spark, LineConfig(1, "a", str(tmp_path / "c.csv"), fault_id_col=2))




def test_patches_configs_and_manifests(spark, tmp_path):
    np.arange(16, dtype="<f4").tofile(tmp_path / "p1.dat")
    got = files.read_patches(spark, str(tmp_path / "*.dat"), 4).first()
    assert got["stem"] == "p1" and got["values"] == list(map(float, range(16)))
    with pytest.raises(Exception, match="another length"):
        files.read_patches(spark, str(tmp_path / "*.dat"), 5).collect()
    (tmp_path / "c.json").write_text('[{"inline_id": 1, "split": "TRAIN"}, {"inline_id": 1, "split": "val"}, {"inline_id": 2}]')
    configs = files.read_line_configs(spark, str(tmp_path / "c.json"))
    assert {x[0] for x in files.split_problems(configs).collect()} == {"split is given for some lines only", "inline 1 is on both sides"}
    rows = spark.createDataFrame([("a",), ("a",)], "sample_id string")
    with pytest.raises(ValueError, match="occurs 2 times"):
        files.write_manifest(rows, str(tmp_path / "m"))


def test_stream_of_sections(spark, tmp_path):
    from geostrata.streaming import inlines

    spark.createDataFrame([(1, x, 5) for x in (0, 1, 2, 20, 21)], "inline_number int, x int, z int").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("inline_number int, x int, z int").parquet(f"{tmp_path}/in")
    inlines.write_grouped(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out").select("x", "z").collect()
    assert sorted(map(tuple, got)) == [(1, 5), (21, 5)]


def test_streamed_counts_by_time(spark, tmp_path):
    from geostrata.streaming import inlines

    rows = [("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:20:00", "a", 2.0), ("2024-01-01 01:10:00", "b", 4.0), ("2024-01-01 09:00:00", "c", 8.0)]
    spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(f"{tmp_path}/in")
    query = inlines.windowed_counts(stream).writeStream.format("memory").queryName("picks_by_time").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(x["event_type"], x["n"], x["total"]) for x in spark.table("picks_by_time").collect()} == {("a", 2, 3.0), ("b", 1, 4.0), ("c", 1, 8.0)}


def test_tiles_cover_and_blend(spark):
    """Against padding, z-scores per tile and weighted sums on one array."""
    rng = np.random.default_rng(2)
    image, p, overlap = rng.random((40, 20)), 16, 4
    traces = spark.createDataFrame(pd.DataFrame({"inline_number": 1, "xl_pos": range(40), "amplitudes": [r.tolist() for r in image]}), "inline_number int, xl_pos int, amplitudes array<float>")
    scorer = lambda x: 1 / (1 + np.exp(-x.astype(float)))
    got = tiles.probability_map(traces, scorer, TileConfig((p, p), overlap)).toPandas().pivot(index="x", columns="z", values="p").to_numpy()
    unit = (image - image.min()) / (image.max() - image.min())
    wide, total, weight = np.zeros((80, 80)), np.zeros((80, 80)), np.zeros((80, 80))
    wide[:40, :20] = unit
    edge = np.exp(-((np.arange(overlap) - overlap + 1.0) ** 2) * 0.5 / (overlap / 4) ** 2)
    w = np.ones((p, p))
    for i in range(overlap):
        w[i] = w[p - 1 - i] = edge[i]
    for i in range(overlap):
        w[:, i] = w[:, p - 1 - i] = edge[i]
    for a in range(0, 40, p - overlap):
        for b in range(0, 20, p - overlap):
            t = wide[a : a + p, b : b + p]
            total[a : a + p, b : b + p] += w * scorer((t - t.mean()) / t.std())
            weight[a : a + p, b : b + p] += w
    assert got.shape == (40, 20) and np.allclose(got, (total / np.where(weight > 0, weight, 1))[:40, :20], atol=1e-5)
    flat = traces.withColumn("amplitudes", F.transform("amplitudes", lambda v: F.lit(1.0).cast("float")))
    with pytest.raises(Exception, match="several values"):
        tiles.probability_map(flat, scorer, TileConfig((p, p), overlap)).count()
    with pytest.raises(Exception, match="no probabilities"):
        tiles.probability_map(traces, lambda x: x * 9, TileConfig((p, p), overlap)).count()


def test_sections_as_flat_archives(spark, tmp_path):
    points = spark.createDataFrame([(7, 1, 3, 4), (7, 0, 1, 2), (7, 0, 0, 2), (9, 0, 5, 5), (9, 0, 6, 5)], "inline_number int, cluster_id int, x int, z int")
    done = {x["inline_number"]: x for x in fault_lines.write_section_npz(points, f"{tmp_path}/npz").collect()}
    held = np.load(done[7]["path"], allow_pickle=False)
    assert held["cluster_ids"].tolist() == [0, 1] and held["point_offsets"].tolist() == [0, 2, 3] and held["points"].tolist() == [[0, 2], [1, 2], [3, 4]] and done[9]["points"] == 2
    with pytest.raises(Exception, match="exists"):
        fault_lines.write_section_npz(points, f"{tmp_path}/npz").collect()
    assert fault_lines.write_section_npz(points, f"{tmp_path}/npz", overwrite=True).count() == 2


def test_axis_order_of_datasets(spark, tmp_path):
    files.check_axis_order(spark, str(tmp_path))
    config = {"height": 1, "width": 1, "num_train": 1, "num_val": 1}
    for more, good in (({"array_axis_order": ["x", "z"]}, True), ({"array_axis_order": ["z", "x"]}, False), ({}, False)):
        (tmp_path / "config.json").write_text(json.dumps(config | more))
        if good:
            files.check_axis_order(spark, str(tmp_path))
        else:
            with pytest.raises(ValueError, match="axes"):
                files.check_axis_order(spark, str(tmp_path))
    (tmp_path / "config.json").write_text('{"other": 1}')
    files.check_axis_order(spark, str(tmp_path))


def test_file_checksums(spark, tmp_path):
    import hashlib

    body = bytes(range(256)) * 10_000
    (tmp_path / "big.bin").write_bytes(body)
    got = files.checksums(spark, [str(tmp_path / "big.bin")]).first()
    assert (got["size"], got["sha256"]) == (len(body), hashlib.sha256(body).hexdigest())
    assert files.checksums(spark, [str(tmp_path / "big.bin")], hashed=False).first()["sha256"] is None
