"""The seismic operators: literal expected values, plain loops, and an independent SQL engine on the smallest tables."""

import glob
import math
import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from geostrata import queries
from geostrata.config import DetectionConfig, LabelConfig, LineConfig, LinkConfig, TileConfig, as_json
from geostrata.functions import scalars
from geostrata.operators import catalogue, cluster, contracts, curve, grid, islands, labels, linking, normalise, splits
from geostrata.storage import cut_lineage

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def lines_of(spark, rows):
    return linking.fault_lines(spark.createDataFrame(rows, "sec int, cluster string, x double, z double"))


def test_parallel_lines_have_known_scores(spark):
    lines = lines_of(spark, [(s, "0", float(x), 0.0) for s in (300, 301) for x in range(3)])
    got = linking.score_candidates(lines).first()
    assert got["chamfer"] == 2.0 and got["orientation"] == 0.0
    assert math.isclose(got["similarity"], math.exp(-0.06))


def test_a_larger_step_scales_the_distance(spark):
    lines = lines_of(spark, [(s, "0", float(x), 0.0) for s in (0, 1) for x in range(3)])
    assert linking.score_candidates(lines, LinkConfig(section_scale=2.0)).first()["chamfer"] == 4.0


def test_perpendicular_lines_differ_by_one(spark):
    lines = lines_of(spark, [(0, "h", float(k), 0.0) for k in range(3)] + [(1, "v", 0.0, float(k)) for k in range(3)])
    assert math.isclose(linking.candidate_pairs(lines).first()["orientation"], 1.0)


def test_the_threshold_is_strict(spark):
    kind = "source_id string, target_id string, gap int, similarity double"
    for similarity, n in ((0.7, 0), (0.700001, 1)):
        scored = spark.createDataFrame([("a", "x", 1, similarity)], kind).withColumn("above_threshold", F.col("similarity") > 0.7)
        assert linking.best_matches(scored).count() == n


def test_a_larger_gap_splits_a_path(spark):
    """Six lines linked by gaps 1, 1, 2, 1, 1: two tracks of three."""
    secs = [300, 301, 302, 304, 305, 306]
    lines = spark.createDataFrame([(f"l{k}", s, 0.0, 0.0) for k, s in enumerate(secs)], "line_id string, sec int, mean_x double, mean_z double")
    edges = [(f"l{k}", f"l{k + 1}", secs[k + 1] - secs[k], True) for k in range(5)]
    tracks = linking.build_tracks(spark.createDataFrame(edges, "source_id string, target_id string, gap int, selected boolean"), lines).collect()
    got = {}
    for x in sorted(tracks, key=lambda x: x["member_order"]):
        got.setdefault(x["track_id"], []).append(x["line_id"])
    assert got == {"fault_0001": ["l0", "l1", "l2"], "fault_0002": ["l3", "l4", "l5"]}


def test_scoring_runs_python_once(spark):
    lines = lines_of(spark, [(s, "0", float(x), 0.0) for s in (300, 301) for x in range(3)])
    plan = linking.best_matches(linking.score_candidates(lines))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_two_stage_selection(spark):
    rows = [("a", "x", 1, 0.80), ("a", "y", 2, 0.90), ("b", "y", 1, 0.85), ("c", "z", 1, 0.70)]
    scored = spark.createDataFrame(rows, "source_id string, target_id string, gap int, similarity double").withColumn("above_threshold", F.col("similarity") > 0.7)
    got = {(x["source_id"], x["target_id"]): (x["source_best"], x["selected"]) for x in linking.best_matches(scored).collect()}
    assert got == {("a", "x"): (False, False), ("a", "y"): (True, True), ("b", "y"): (True, False)}


def test_one_track_of_thirty_one_sections_without_decoys(spark):
    rows = [(s, "c0", 100.0 + k, 500 + 0.4 * (100 + k) + 0.05 * s) for s in range(31) for k in range(21)]
    rows += [(s, "c99", 200.0 + k, 600 + 0.4 * (200 + k)) for s in (10, 11) for k in range(21)]
    lines = lines_of(spark, rows)
    got = linking.build_tracks(linking.best_matches(linking.score_candidates(lines)), lines).collect()
    assert {x["track_id"] for x in got} == {"fault_0001"} and [x["sec"] for x in sorted(got, key=lambda x: x["member_order"])] == list(range(31))
    assert not any("c99" in x["line_id"] for x in got)


def test_pruning_loses_no_link(spark):
    r = random.Random(3)
    rows = [(s, str(c), c * 6 + r.random() * 9, r.random() * 9) for s in range(4) for c in range(4) for _ in range(6)]
    lines = lines_of(spark, rows)
    points = {x["line_id"]: np.array([(u["x"], u["z"]) for u in x["points"]]) for x in lines.collect()}
    for x in linking.candidate_pairs(lines).select(F.col("a.line_id").alias("s"), F.col("b.line_id").alias("t"), "gap", "orientation", "pruned").collect():
        a, b = points[x["s"]], points[x["t"]]
        d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2) + x["gap"] ** 2)
        similarity = math.exp(-(0.03 * (d.min(1).mean() + d.min(0).mean()) + x["orientation"]))
        assert not (x["pruned"] and similarity > 0.7)


def test_runs_and_neighbours(spark):
    rows = [(t, s) for t, ss in (("a", (300, 301, 302)), ("b", (300, 301)), ("c", (300, 302, 304))) for s in ss]
    got = {x["track"]: x["valid"] for x in linking.consecutive_runs(spark.createDataFrame(rows, "track string, sec int"), 3).collect()}
    assert got == {"a": True, "b": False, "c": False}
    near = linking.neighbouring_sections(spark.range(300, 331).select(F.col("id").cast("int").alias("sec")), 5)
    assert sorted(x["neighbour"] for x in near.where("sec = 315").collect()) == [*range(310, 315), *range(316, 321)]


def test_keys(spark):
    df = spark.createDataFrame([("line_0",), ("line_30",), ("line_007",), ("x",)], "k string")
    assert [x[0] for x in df.select(scalars.line_key_to_inline(F.col("k"))).collect()] == [300, 330, None, None]
    names = spark.createDataFrame([("b10",), ("b9",), ("a2",)], "k string")
    assert [x["k"] for x in names.orderBy(scalars.natural_key(F.col("k"))).collect()] == ["a2", "b9", "b10"]
    ids = spark.createDataFrame([("10",), ("x",), ("9",)], "k string")
    assert [x["k"] for x in ids.orderBy(*scalars.cluster_sort_key(F.col("k"))).collect()] == ["9", "10", "x"]


def plain_dbscan(p, eps, m):
    near = [[j for j in range(len(p)) if (p[i][0] - p[j][0]) ** 2 + (p[i][1] - p[j][1]) ** 2 <= eps * eps] for i in range(len(p))]
    core, label, n = [len(x) >= m for x in near], [-1] * len(p), 0
    for i in range(len(p)):
        if core[i] and label[i] < 0:
            stack = [i]
            label[i] = n
            while stack:
                for j in near[stack.pop()]:
                    if label[j] < 0:
                        label[j] = n
                        if core[j]:
                            stack.append(j)
            n += 1
    return label


def test_dbscan_matches_a_plain_loop(spark):
    r = random.Random(7)
    p = sorted({(r.randint(0, 40), r.randint(0, 40)) for _ in range(220)})
    df = spark.createDataFrame([(1, k, x, z) for k, (x, z) in enumerate(p)] + [(2, 0, 5, 5)], "inline_number int, pid int, x int, z int")
    got = {x["pid"]: x["label"] for x in cluster.dbscan(df, 3, 5).where("inline_number = 1").collect()}
    assert [got[k] for k in range(len(p))] == plain_dbscan(p, 3, 5)
    noise = {x["pid"]: x["noise"] for x in cluster.noise_mask(df, 3, 5).where("inline_number = 1").collect()}
    assert all(noise[k] == (got[k] < 0) for k in got)


def test_merge_joins_lines_of_one_axis(spark):
    rows = [(1, c * 100 + k, c, float(c * 12 + k), 0.0) for c in range(3) for k in range(10)] + [(1, 900 + k, 7, 200.0, float(k)) for k in range(10)]
    df = spark.createDataFrame(rows, "inline_number int, pid int, label int, x double, z double")
    got = {x["pid"]: x["label"] for x in cluster.merge_clusters(df, 17, 5, 3).collect()}
    assert {got[k] for k in (0, 105, 209)} == {0} and got[905] == 1


def plain_angles(p):
    p = dict(enumerate(p))
    for _ in range(10):
        bad = set()
        for axis in (0, 1):
            order = sorted(p, key=lambda k: (p[k][axis], k))
            for a, b, c in zip(order, order[1:], order[2:]):
                u, v = np.subtract(p[a], p[b]), np.subtract(p[c], p[b])
                size = np.hypot(*u) * np.hypot(*v)
                if size and math.degrees(math.acos(max(-1, min(1, float(u @ v) / size)))) < 90:
                    bad.add(b)
        if not bad or len(p) < 3:
            break
        p = {k: v for k, v in p.items() if k not in bad}
    return set(p)


def test_angle_filter_matches_a_plain_loop(spark):
    r = random.Random(11)
    p = [(k + r.random() * 0.3, k * 0.5 + r.choice([0, 0, 0, 6, -5]) + r.random() * 0.1) for k in range(40)]
    df = spark.createDataFrame([(1, 0, k, x, z) for k, (x, z) in enumerate(p)], "inline_number int, label int, pid int, x double, z double")
    assert {x["pid"] for x in curve.angle_filter(df).collect()} == plain_angles(p)


def plain_curvature(p, window=7, tau=0.5, delta=0.001, margin=2):
    p = np.array(p)
    s = np.concatenate([[0], np.cumsum(np.maximum(np.hypot(*np.diff(p, axis=0).T), 1e-6))])
    d = [np.gradient(p[:, k], s, edge_order=2) for k in (0, 1)]
    e = [np.gradient(x, s, edge_order=2) for x in d]
    speed = (d[0] ** 2 + d[1] ** 2) ** 1.5
    kappa = np.where(speed <= 1e-12, 0, np.abs(d[0] * e[1] - d[1] * e[0]) / np.maximum(speed, 1e-12))
    n = len(p)
    w = min(window, n if n % 2 else n - 1)
    padded = np.pad(kappa, w // 2, mode="edge")
    mean = np.convolve(padded, np.ones(w) / w, "valid")
    eta = np.abs(kappa - mean) / (mean + delta)
    anomaly = eta > tau
    anomaly[:margin] = anomaly[n - margin :] = False
    return kappa, eta, anomaly


def test_curvature_and_smoothing_match_numpy(spark):
    r = random.Random(2)
    p = [(float(k), 10 * math.sin(k / 4) + r.random()) for k in range(30)]
    df = spark.createDataFrame([(1, 0, k, x, z) for k, (x, z) in enumerate(p)] + [(1, 1, 0, 0.0, 0.0), (1, 1, 1, 1.0, 1.0)], "inline_number int, label int, pid int, x double, z double")
    got = sorted(curve.curvature(df).where("label = 0").collect(), key=lambda x: x["pos"])
    kappa, eta, anomaly = plain_curvature([(x["x"], x["z"]) for x in got])
    assert np.allclose([x["kappa"] for x in got], kappa, atol=1e-9) and np.allclose([x["eta"] for x in got], eta, atol=1e-6)
    assert [x["anomaly"] for x in got] == anomaly.tolist()
    moved = {x["pid"]: x for x in curve.weak_smoothing(df).where("label = 0").collect()}
    for x in got:
        shift = math.hypot(moved[x["pid"]]["x"] - x["x"], moved[x["pid"]]["z"] - x["z"])
        assert (shift == 0) or (x["anomaly"] and shift <= 0.05 + 1e-12)
    assert curve.curvature(df).where("label = 1 and anomaly").count() == 0


def test_resample_matches_numpy(spark):
    p = np.array([(0.0, 0.0), (1.0, 2.0), (4.0, 2.0), (5.0, 7.0)])
    df = spark.createDataFrame([("a", k, float(x), float(z)) for k, (x, z) in enumerate(p)], "line string, pos int, x double, z double")
    got = sorted(curve.resample(df, 11, ["line"]).collect(), key=lambda r: r["i"])
    s = np.concatenate([[0], np.cumsum(np.hypot(*np.diff(p, axis=0).T))])
    u = np.linspace(0, s[-1], 11)
    assert [x["i"] for x in got] == list(range(11))
    assert np.allclose([x["x"] for x in got], np.interp(u, s, p[:, 0])) and np.allclose([x["z"] for x in got], np.interp(u, s, p[:, 1]))


def test_interpolation_rounds_half_to_even(spark):
    df = spark.createDataFrame([(1, 0, 0, 0.0, 0.0), (1, 0, 1, 4.0, 2.0), (1, 9, 0, 1.0, 1.0)], "inline_number int, label int, pid int, x double, z double")
    got = sorted((x["x"], x["z"]) for x in curve.interpolate_lines(df).collect())
    assert got == [(0, 0), (1, 0), (2, 1), (3, 2), (4, 2)]


def test_interpolation_steps_from_the_first_x_past_a_fractional_end(spark):
    """From 3 in steps of 1 below 10.97: the last whole part is 10, beyond the last knot."""
    p = spark.createDataFrame([(1, 0, 1, 3.0, 0.0), (1, 0, 2, 9.97, 6.97), (1, 1, 1, 3.5, 0.0), (1, 1, 2, 9.2, 5.7)], "inline_number int, label int, pid long, x double, z double")
    got = curve.interpolate_lines(p).orderBy("label", "x").collect()
    assert [(x["x"], x["z"]) for x in got if x["label"] == 0] == [(k, k - 3) for k in range(3, 11)]
    assert [x["x"] for x in got if x["label"] == 1] == list(range(3, 10))


def test_windows_are_made_odd():
    assert [curve.odd_window(w) for w in (1, 2, 3, 4, 7)] == [3, 3, 3, 5, 7]


def test_long_arms_stay_one_cluster(spark):
    """A chain open towards small x whose two arms are 150 hops long each."""
    rows = [(1, k, float(k) if k < 150 else float(299 - k), 0.0 if k < 150 else 100.0) for k in range(300)] + [(1, 300 + k, 150.0, float(k)) for k in range(101)]
    got = cluster.dbscan(spark.createDataFrame(rows, "inline_number int, pid long, x double, z double"), 1.5, 2)
    assert [x["label"] for x in got.select("label").distinct().collect()] == [0]


def test_gap_groups(spark):
    df = spark.createDataFrame([(1, x, 5) for x in (0, 1, 2, 20, 21)], "inline_number int, x int, z int")
    assert sorted((r["x"], r["z"]) for r in islands.group_points(df, 10).collect()) == [(1, 5), (21, 5)]


def test_raster_is_the_nearest_pixels_of_each_segment(spark):
    r = random.Random(6)
    segments = [(k, *(r.randint(-30, 30) for _ in range(4))) for k in range(200)] + [(999, 3, 3, 3, 3)]
    got = {}
    for x in labels.raster(spark.createDataFrame(segments, "s int, x0 int, z0 int, x1 int, z1 int"), ["s"]).collect():
        got.setdefault(x["s"], set()).add((x["x"], x["z"]))
    for s, x0, z0, x1, z1 in segments:
        n = max(abs(x1 - x0), abs(z1 - z0))
        assert {(x0, z0), (x1, z1)} <= got[s] and len(got[s]) == n + 1
        major, minor = (0, 1) if abs(x1 - x0) > abs(z1 - z0) else (1, 0)
        for p in got[s]:
            share = (p[major] - (x0, z0)[major]) / ((x1, z1)[major] - (x0, z0)[major]) if n else 0
            assert abs(p[minor] - ((x0, z0)[minor] + share * ((x1, z1)[minor] - (x0, z0)[minor]))) <= 0.5 + 1e-9


RECORD = "inline_id int, x0 int, z0 int, source_id string, source_segy_sha256 string, section_index int, source_nx int, source_nz int, requested_split string"


def records(spark, rows):
    """rows: (inline_id, x0) or (inline_id, x0, requested_split), of sections 20 pixels wide and 4 high, one source an inline."""
    return spark.createDataFrame([(r[0], r[1], 0, f"source_{r[0]}", None, 0, 20, 4, r[2] if len(r) > 2 else None) for r in rows], RECORD)


SMALL = {"patch_size": 4, "stride": 2, "seed": 7}


def test_whole_inlines_validate(spark):
    out = splits.split_records(records(spark, [(i, x) for i in (10, 20, 30) for x in (0, 2, 4)]), LabelConfig(**SMALL))
    train, val = ({x["inline_id"] for x in out[side].collect()} for side in ("train", "val"))
    assert train and val and not train & val and len(val) == 1
    assert out["summary"].first()["resolved_strategy"] == "inline" and out["train"].count() == 6


def test_one_inline_falls_back_to_its_tail(spark):
    out = splits.split_records(records(spark, [(10, x) for x in range(0, 17, 2)]), LabelConfig(**SMALL))
    summary = out["summary"].first()
    assert (summary["resolved_strategy"], summary["fallback_reason"]) == ("spatial", "one inline")
    train, val = ([x["x0"] for x in out[side].collect()] for side in ("train", "val"))
    assert min(val) == 14 and max(train) + 4 <= 14 - 4 and summary["discarded"] == 9 - len(train) - len(val)


def test_the_boundary_lies_on_the_legal_grid(spark):
    """Patches are kept on the left alone; the boundary is that of the section all the same."""
    got = splits.spatial_split(splits.with_sources(records(spark, [(1, 0), (1, 2), (1, 14)])), LabelConfig(**SMALL, strategy="spatial")).collect()
    assert {(x["x0"], x["boundary"], x["split"]) for x in got} == {(0, 14, "train"), (2, 14, "train"), (14, 14, "val")}


def test_wanted_inlines_and_caps(spark):
    rows = [(i, x) for i in (1, 2, 3) for x in (0, 4, 8)]
    out = splits.split_records(records(spark, rows), LabelConfig(**SMALL, val_inlines=(2,), target_train=4, target_val=2))
    assert {x["inline_id"] for x in out["val"].collect()} == {2} and out["train"].count() == 4 and out["val"].count() == 2
    assert [x["nth"] for x in out["train"].orderBy("nth").collect()] == [1, 2, 3, 4]
    for bad, why in (((9,), "without patches"), ((1, 2, 3), "leave an inline")):
        with pytest.raises(ValueError, match=why):
            splits.assign(records(spark, rows), LabelConfig(**SMALL, val_inlines=bad))


def test_declared_lines(spark):
    good = [(1, 0, "train"), (2, 0, "VAL")]
    got = splits.split_records(records(spark, good), LabelConfig(**SMALL))
    assert got["val"].first()["inline_id"] == 2 and got["summary"].first()["assignment"] == "declared"
    for rows, why in (
        ([(1, 0, "train"), (2, 0, None)], "some lines only"), ([(1, 0, "train"), (2, 0, "test")], "neither train nor val"), ([(1, 0, "train"), (2, 0, "train")], "has no patch"),
        ([(1, 0, "train"), (1, 4, "val")], "both sides"),
    ):
        with pytest.raises(ValueError, match=why):
            splits.assign(records(spark, rows), LabelConfig(**SMALL))
    with pytest.raises(ValueError, match="inline strategy"):
        splits.assign(records(spark, good), LabelConfig(**SMALL, strategy="spatial"))


def test_one_file_under_two_names_is_one_source(spark):
    rows = [(1, 0, 0, "a", "sum", 0, 20, 4, "train"), (2, 8, 0, "b", "sum", 0, 20, 4, "val")]
    with pytest.raises(ValueError, match="several"):
        splits.assign(spark.createDataFrame(rows, RECORD), LabelConfig(**SMALL))


def test_what_no_split_can_take(spark):
    for rows, why in (([], "no records"), ([(1, 0), (1, 0)], "occurs twice"), ([(1, 1)], "off the grid")):
        with pytest.raises(ValueError, match=why):
            splits.assign(records(spark, rows) if rows else spark.createDataFrame([], RECORD), LabelConfig(**SMALL, strategy="spatial"))
    with pytest.raises(ValueError, match="no patch"):
        splits.split_records(records(spark, [(1, 0)]), LabelConfig(**SMALL))


def test_overlaps_may_touch(spark):
    make = lambda x: spark.createDataFrame([("s", x, 0)], "source_id string, x0 int, z0 int")
    assert labels.overlapping_pairs(make(0), make(2), 4).count() == 1
    assert labels.overlapping_pairs(make(0), make(4), 4).count() == 0


def test_constant_groups_are_an_error(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0)], "k int, v double")
    with pytest.raises(Exception, match="one value"):
        normalise.minmax(df, ["k"], "v", "m").collect()
    assert normalise.minmax(df, ["k"], "v", "m", 1e-8).first()["m"] == 0


def test_ridge_of_a_bump_and_preservation(spark):
    rows = [(1, x, z, math.exp(-((x - 10) ** 2) / 8)) for x in range(21) for z in range(10)]
    g = grid.gradients(spark.createDataFrame(rows, "inline_number int, x int, z int, p double"))
    core = grid.ridge_core(g, 0.0)
    assert {x["x"] for x in core.collect()} >= {10}
    points = spark.createDataFrame([(1, x, 5) for x in range(0, 21)] + [(2, 0, 0)], "inline_number int, x int, z int")
    line = spark.createDataFrame([(1, 10, 5)], "inline_number int, x int, z int")
    kept = sorted(x["x"] for x in grid.preserve_around_ridges(points, line, 2, 0.5).where("inline_number = 1").collect())
    assert kept == [5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
    assert grid.preserve_around_ridges(points, line, 2, 0.5).where("inline_number = 2").count() == 1


def test_faces_without_data_go(spark):
    g = spark.createDataFrame([("s", 2, 3)], "s string, rows int, columns int")
    faces = catalogue.structured_faces(g, ["s"])
    assert faces.count() == 4
    v = spark.createDataFrame([("s", k, float("nan") if k == 0 else 1.0) for k in range(6)], "s string, vertex int, z double")
    assert catalogue.finite_faces(faces, v, ["s"]).count() == 3
    turned = faces.select("s", F.col("c").alias("a"), F.col("a").alias("b"), F.col("b").alias("c"))
    assert catalogue.same_faces(faces, turned, ["s"]).count() == 0


def test_vertices_are_not_broadcast(spark):
    """Few shapes can have many vertices."""
    for name in ("finite_faces", "decimated_vertices", "surface_boundary"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan, name


def test_parameters_are_checked():
    assert DetectionConfig().max_gap == 20 and LabelConfig().gap == 256 and LinkConfig().axis_scales == (1.0, 1.0, 1.0)
    for kind, bad in (
        (DetectionConfig, {"threshold": 2}), (DetectionConfig, {"eps": 0}), (DetectionConfig, {"merge_theta": 0}), (DetectionConfig, {"blend": 2}), (DetectionConfig, {"delta": 0}), (DetectionConfig, {"max_gap": -1}),
        (LinkConfig, {"tau": 1.5}), (LinkConfig, {"inline_step": 0}), (LinkConfig, {"inline_end": 1}), (LinkConfig, {"min_lines": 1}), (LinkConfig, {"observed_weight": 2}),
        (LabelConfig, {"axis": "y"}), (LabelConfig, {"strategy": "random"}), (LabelConfig, {"target_val": 0}), (LabelConfig, {"strategy": "spatial", "val_inlines": (1,)}), (LabelConfig, {"guard": -1}),
        (TileConfig, {"patch": (20, 16)}), (TileConfig, {"overlap": 0}), (LineConfig, {"inline_id": 1, "segy_path": "a", "csv_path": "b", "x_scale": 0}),
    ):
        with pytest.raises(ValueError):
            kind(**bad)
    line = LineConfig.of({"inline_id": 1, "segy_path": "a", "csv_path": "b", "split": "TRAIN", "label_shape_before_downsample": [4, 5]})
    assert line.split == "train" and line.label_shape_before_downsample == (4, 5) and as_json(line)["label_shape_before_downsample"] == [4, 5]
    for bad in ({"inline_id": 1}, {"inline_id": 1, "segy_path": "a", "csv_path": "b", "colour": 2}):
        with pytest.raises(ValueError, match="fields"):
            LineConfig.of(bad)


def test_inlines_are_selected(spark):
    there = spark.createDataFrame([(300,), (302,), (306,)], "inline_number int")
    assert sorted(x[0] for x in contracts.select_inlines(there, 300, 300, 306, 2, True).collect()) == [300, 302, 306]
    for given, why in (((300, 300, 306, 2), "missing"), ((300, 301, 306, 2), "origin's step"), ((301, 300, 306), "precede origin"), ((300, 306, 300), "precede start"), ((300, 310, 312), "no wanted")):
        with pytest.raises(ValueError, match=why):
            contracts.select_inlines(there, *given)
    with pytest.raises(ValueError, match="unique"):
        contracts.select_inlines(there.union(there), 300, 300, 306, 2, True)
    assert contracts.same_axis(10, 3, 4) == 3 and contracts.same_axis(4, 3, 4) == 1
    with pytest.raises(ValueError):
        contracts.same_axis(10, 3, 5)


def test_meshes_are_thinned():
    assert (catalogue.plot_stride(100, 100), catalogue.plot_stride(101, 100), catalogue.plot_stride(1000, 100)) == (1, 2, 4)
    with pytest.raises(ValueError):
        catalogue.plot_stride(10, 9)


def test_headers_are_found_once(spark):
    axis = spark.createDataFrame([(0, 10), (1, 12), (2, 12)], "idx int, value int")
    assert catalogue.header_to_index(axis, 10) == 0
    for header in (11, 12):
        with pytest.raises(ValueError):
            catalogue.header_to_index(axis, header)
    assert catalogue.face_counts(spark.createDataFrame([("s", 3, 4)], "surface_id string, rows int, columns int")).first()["faces"] == 12


def test_wavelet_is_one_at_its_peak(spark):
    got = spark.range(1).select(scalars.ricker(25.0, F.lit(0.0)).alias("a"), scalars.ricker(25.0, F.lit(1 / (math.sqrt(2) * math.pi * 25))).alias("b")).first()
    assert got["a"] == 1.0 and abs(got["b"]) < 1e-12


def _rows(df):
    out = []
    for row in df.itertuples(index=False, name=None):
        out.append(repr(tuple(None if pd.isna(x) else float(x) + 0.0 if isinstance(x, (int, float, np.integer, np.floating)) and not isinstance(x, bool) else x for x in row)))
    return sorted(out)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    a, b = _rows(got[columns].astype(object)), _rows(want[columns].astype(object))
    assert a == b


def test_values_without_data(spark):
    """Null, NaN and infinite values are no data, and refused where a value is needed."""
    from geostrata.operators import catalogue

    inf, nan = float("inf"), float("nan")
    v = spark.createDataFrame([("s", 0, k, 1.0, k, z) for k, z in enumerate([1.0, 2.0, inf, -inf, nan, None])] + [("t", 0, 0, 1.0, 0, nan)], "surface_id string, row int, col int, inline_index double, profile int, z double")
    got = {x["surface_id"]: tuple(x)[1:] for x in catalogue.inventory(v, "surface_id", ["z"]).collect()}
    assert got == {"s": (6, 4, 1.0, 2.0), "t": (1, 1, None, None)}
    assert [(x["surface_id"], x["point_order"], x["z"]) for x in catalogue.intersections(v, [1.0]).orderBy("point_order").collect()] == [("s", 0, 1.0), ("s", 1, 2.0)]
    groups = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", -3.0), ("a", nan), ("a", inf), ("a", None), ("b", 0.0)], "k string, v double")
    assert {x["k"]: x["limit"] for x in normalise.robust_limit(groups, ["k"], "v", 1.0).collect()} == {"a": 3.0, "b": 1.0}
    with pytest.raises(Exception, match="without a finite value"):
        normalise.robust_limit(groups.where("isnan(v)"), ["k"], "v", 1.0).collect()
    for bad in (nan, inf, None):
        with pytest.raises(Exception, match="not finite"):
            normalise.minmax(spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", bad)], "k string, v double"), ["k"], "v", "m").collect()


def test_bits_of_places(spark):
    from geostrata.plans.label_dataset import bits_of

    rows = spark.createDataFrame([([0, 1, 4],), ([],), (None,), ([2],), ([0, 1, 2, 3, 4],)], "p array<int>")
    got = [x[0] for x in rows.select(bits_of(F.col("p"), 5)).collect()]
    assert got == [[1, 1, 0, 0, 1], [0] * 5, [0] * 5, [0, 0, 1, 0, 0], [1] * 5]


def test_near_pairs_are_those_that_are_not_pruned(spark):
    """Lines met by cells against all pairs; swept nearest points against all distances."""
    rng = np.random.default_rng(2)
    rows = [(s, f"{c}", float(x0 + k), float(z0 + k * slope)) for s in range(6) for c in range(12) for x0, z0, slope, n in [(rng.uniform(-30, 60), rng.uniform(0, 12), rng.uniform(-1, 1), rng.integers(2, 40))] for k in range(n)]
    lines = lines_of(spark, rows)
    pair = lambda df: sorted((x["a"]["line_id"], x["b"]["line_id"], x["bound"]) for x in df.collect())
    for config in (LinkConfig(section_scale=1.0), LinkConfig(section_scale=1.0, distance_weight=0.3, tau=0.5), LinkConfig(section_scale=1.0, distance_weight=0.0)):
        got = pair(linking.near_pairs(lines, config))
        assert got == pair(linking.candidate_pairs(lines, config).where("not pruned")) and got
    for _ in range(100):
        n, m = rng.integers(1, 50, 2)
        a, b = rng.integers(0, 20, (n, 2)) / 2, rng.integers(0, 20, (m, 2)) / 2
        assert np.allclose(linking.nearest_squared(*a.T, *b.T), ((a[:, None] - b[None]) ** 2).sum(-1).min(1))


def test_nearest_points_take_few_steps():
    """Against all distances, and as fast where lines lie apart or share their places, where sweeping along one axis takes the square."""
    import time

    from geostrata.operators import nearest

    rng = np.random.default_rng(5)
    clouds = lambda n: {"grid": np.c_[rng.integers(0, 100, n) / 4, rng.integers(0, 1000, n) / 100], "apart": rng.random((n, 2)) * 25 + (0, 40), "skew": rng.exponential(1, (n, 2)) ** 3, "one": np.ones((n, 2)), "column": np.c_[np.zeros(n), rng.random(n)]}
    for n in (1, 2, 300):
        for a in clouds(n).values():
            for b in clouds(250).values():
                d = ((a[:, None] - b[None]) ** 2).sum(-1).min(1)
                assert np.array_equal(nearest.nearest_squared(*a.T, *b.T), d) and nearest.closest_squared(*a.T, *b.T) == d.min()
    began = time.process_time()
    for b in clouds(20_000).values():
        nearest.nearest_squared(*(rng.random((20_000, 2)) * 25).T, *b.T)
    assert time.process_time() - began < 6


def test_small_sets_are_compared_whole(monkeypatch):
    """Against all distances on both sides of the limit; below it without strips, which took twice as long there."""
    from geostrata.operators import nearest

    rng = np.random.default_rng(7)
    for n, m in ((1, 1), (1, 40), (40, 1), (70, 90), (200, 3)):
        a, b = rng.integers(0, 30, (n, 2)) / 4, rng.integers(0, 30, (m, 2)) / 4
        d = ((a[:, None] - b[None]) ** 2).sum(-1)
        for small in (nearest.SMALL, 0):
            monkeypatch.setattr(nearest, "SMALL", small)
            monkeypatch.setattr(nearest, "BLOCK", 64)
            monkeypatch.setattr(nearest, "SEARCHES", 16)
            there, back = nearest.mutual_squared(*a.T, *b.T)
            assert np.array_equal(there, d.min(1)) and np.array_equal(back, d.min(0))
        monkeypatch.undo()
    monkeypatch.setattr(nearest, "Strips", None)
    assert linking._nearest_with_step(*rng.random((2, 600)), *rng.random((2, 700)), 1.0)


def test_pairs_stay_spread_over_tasks(spark):
    """Tasks of the exact distances are not joined by their bytes, and a line's pairs are dealt by gap too."""
    lines = cut_lineage(lines_of(spark, [(s, "0", float(x), 0.0) for s in range(12) for x in range(3)]))
    scored = linking.score_candidates(lines)
    assert scored.count() == 45 and scored.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    tasks = scored.select("target_id", F.spark_partition_id().alias("task")).where("target_id = 'line_9_c0'").distinct().count()
    assert tasks > 1


def test_tracks_score_their_pairs_once(spark, monkeypatch):
    """Edges are read more than once by chains, so they come with no scoring behind them."""
    seen, chains = [], linking.chains
    monkeypatch.setattr(linking, "chains", lambda edges: seen.append(edges._jdf.queryExecution().executedPlan().toString()) or chains(edges))
    for name in ("track_membership", "track_summary"):
        queries.QUERIES[name](spark, SF)
    assert len(seen) == 2 and not any("ArrowEvalPython" in plan for plan in seen)


def test_distances_of_clusters_by_slabs(spark, monkeypatch):
    """Against all distances, on slabs of few points and over cells."""
    monkeypatch.setattr(cluster, "SLAB", 7)
    rng = np.random.default_rng(4)
    rows = [(s, f"{c}", float(x), float(z)) for s in range(2) for c in range(6) for x, z in rng.normal(rng.uniform(-40, 40, 2), 6, (rng.integers(1, 40), 2)).round(1)]
    points = spark.createDataFrame([*rows, (0, "0", None, 1.0)], "inline_number int, label string, x double, z double")
    pairs = points.select("inline_number", F.col("label").alias("i")).distinct().join(points.select("inline_number", F.col("label").alias("j")).distinct(), "inline_number").where("i < j")
    at = lambda s, c: np.array([r[2:] for r in rows if r[:2] == (s, c)])
    want = {(s, f"{i}", f"{j}"): np.hypot(*(at(s, f"{i}")[:, None] - at(s, f"{j}")[None]).reshape(-1, 2).T).min() for s in range(2) for i in range(6) for j in range(i + 1, 6)}
    for reach in (None, 15):
        found = cluster.pair_distances(pairs, points, reach)
        got = {(x["inline_number"], x["i"], x["j"]): x["distance"] for x in found.collect()}
        assert got == {k: pytest.approx(d) for k, d in want.items() if reach is None or d < reach}
