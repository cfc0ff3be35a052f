"""SEG-Y indexes, published folders and ranks over all rows."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from geostrata import storage
from geostrata.config import LinkConfig
from geostrata.operators import ranking
from geostrata.sources import fault_lines, segy, segy_index


def segy_file(path, keys, samples, code=5, interval=2000):
    """A file of traces (inline, crossline) in the given order; sample k of a trace is inline * 100 + crossline + k."""
    with open(path, "wb") as f:
        head = bytearray(3600)
        head[3216:3218], head[3220:3222], head[3224:3226] = struct.pack(">H", interval), struct.pack(">H", samples), struct.pack(">H", code)
        f.write(head)
        for i, x in keys:
            trace = bytearray(240)
            trace[188:196] = struct.pack(">ii", i, x)
            f.write(trace + (i * 100 + x + np.arange(samples)).astype(">f4").tobytes())


@pytest.mark.parametrize("order", ["inline", "crossline", "none", "files"])
def test_cubes_in_any_order_give_equal_sections(spark, tmp_path, monkeypatch, order):
    monkeypatch.setattr(segy, "READ_BYTES", 3 * (240 + 4 * 7))  # some traces at once
    inlines, xlines, samples = [10, 12, 14, 16], [5, 6, 7, 8, 9], 7
    keys = [(i, x) for i in inlines for x in xlines]
    if order == "crossline":
        keys.sort(key=lambda k: (k[1], k[0]))
    if order in ("none", "files"):
        keys = [keys[k] for k in np.random.default_rng(1).permutation(len(keys))]
    if order == "files":
        segy_file(tmp_path / "a.sgy", keys[:13], samples)
        segy_file(tmp_path / "b.sgy", keys[13:], samples)
    else:
        segy_file(tmp_path / "a.sgy", keys, samples)
    index = segy_index.scan_headers(spark, str(tmp_path), range_bytes=1000)
    assert [(x["path"].rpartition("/")[2], x["trace"]) for x in index.orderBy("path", "trace").collect()] == [("a.sgy", k) for k in range(13 if order == "files" else 20)] + ([("b.sgy", k) for k in range(7)] if order == "files" else [])
    segy_index.write_index(index, f"{tmp_path}/index")
    index = spark.read.parquet(f"{tmp_path}/index")
    assert segy_index.cube_problems(index).count() == 0
    if order != "files":
        assert segy_index.sorting(index).first()["sorting"] == order
    facts = segy_index.layout_facts(index).first()
    assert (facts["traces"], facts["inlines"], facts["crosslines"], facts["layout"]["interval"]) == (20, 4, 5, 2000)
    whole = segy_index.read_sections(index)
    got = {(x["inline_number"], x["xl_pos"], x["crossline"]): x["amplitudes"] for x in whole.collect()}
    assert got == {(i, k, x): [float(i * 100 + x + s) for s in range(samples)] for i in inlines for k, x in enumerate(xlines)}
    some = segy_index.read_sections(index, [16, 10], 2, 3).collect()
    assert sorted((x["inline_number"], x["xl_pos"], x["crossline"], *x["amplitudes"]) for x in some) == [(i, k // 2, x, *[float(i * 100 + x + s) for s in (0, 3, 6)]) for i in (10, 16) for k, x in enumerate(xlines) if k % 2 == 0]
    with pytest.raises(ValueError, match="11"):
        segy_index.read_sections(index, [10, 11])


def test_what_keeps_traces_from_being_a_cube(spark, tmp_path):
    segy_file(tmp_path / "a.sgy", [(1, 1), (1, 2), (2, 1), (2, 1)], 3)
    index = segy_index.scan_headers(spark, str(tmp_path / "a.sgy"))
    assert [x[0] for x in segy_index.cube_problems(index).collect()] == ["inline 2 has a crossline twice"]
    segy_file(tmp_path / "a.sgy", [(1, 1), (1, 2), (2, 1)], 3)
    segy_file(tmp_path / "b.sgy", [(2, 2)], 3, interval=4000)
    both = segy_index.scan_headers(spark, str(tmp_path))
    assert [x[0] for x in segy_index.cube_problems(both).collect()] == ["files differ in samples, interval or format"]
    with pytest.raises(ValueError, match="crossing"):
        segy_index.read_sections(segy_index.scan_headers(spark, str(tmp_path / "a.sgy")))
    assert [x[0] for x in segy_index.cube_problems(both.where("false")).collect()] == ["no traces"]
    index = storage.cut_lineage(both.where("interval = 2000").unionAll(both.where("interval = 4000").withColumn("interval", F.lit(2000))))
    segy_file(tmp_path / "b.sgy", [(3, 2)], 3)
    with pytest.raises(Exception, match="not the file that was indexed"):
        segy_index.read_sections(index).collect()
    with open(tmp_path / "c.sgy", "wb") as f:
        f.write(b"short")
    with pytest.raises(Exception, match="whole number of traces"):
        segy_index.scan_headers(spark, str(tmp_path / "c.sgy")).collect()


def test_traces_are_written_and_read_back(spark, tmp_path):
    rows = [(i, x, [float(i), float(x), 0.5]) for i in range(6) for x in range(40)]
    traces = spark.createDataFrame(rows, "inline_number int, crossline int, amplitudes array<float>").repartition(3)
    files = segy.write_segy(traces, f"{tmp_path}/out").collect()
    assert sum(x["traces"] for x in files) == 240 and len({x["path"] for x in files}) == 3
    back = segy_index.read_sections(segy_index.scan_headers(spark, f"{tmp_path}/out"))
    assert sorted((x["inline_number"], x["crossline"], x["amplitudes"]) for x in back.collect()) == rows


def points_of(spark, n):
    return spark.createDataFrame([(s, 0, x, x) for s in range(2) for x in range(n)], "inline_number int, cluster_id int, x int, z int")


def test_a_failed_overwrite_leaves_the_artefact(spark, tmp_path):
    config, folder = LinkConfig(inline_origin=0, inline_start=0, inline_end=3), f"{tmp_path}/lines"
    sections = spark.createDataFrame([(0,), (1,)], "inline_number int")
    fault_lines.write_fault_lines(points_of(spark, 4), sections, folder, config)
    first = storage.current_version(spark, folder)
    with pytest.raises(FileExistsError):
        fault_lines.write_fault_lines(points_of(spark, 4), sections, folder, config)
    far = spark.createDataFrame([(0,), (9,)], "inline_number int")
    with pytest.raises(ValueError, match="off the declared"):
        fault_lines.write_fault_lines(points_of(spark, 5), far, folder, config, overwrite=True)
    with pytest.raises(ValueError, match="other counts"):  # a section with points that is not listed
        fault_lines.write_fault_lines(points_of(spark, 5), sections.where("inline_number = 0"), folder, config, overwrite=True)
    assert storage.current_version(spark, folder) == first
    assert fault_lines.read_fault_lines(spark, folder)[0].count() == 8
    assert storage.drop_old_versions(spark, folder) == []  # failed versions are gone already
    fault_lines.write_fault_lines(points_of(spark, 5), sections, folder, config, overwrite=True)
    assert fault_lines.read_fault_lines(spark, folder)[0].count() == 10
    assert storage.drop_old_versions(spark, folder) == [first.rpartition("/")[2]]
    with pytest.raises(FileNotFoundError):
        storage.current_version(spark, f"{tmp_path}/nothing")


def test_concurrent_writers_leave_one_whole_version(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    def write(n, overwrite):
        def both(version):
            for part in ("a", "b"):
                spark.range(n).write.parquet(f"{version}/{part}")

        return storage.publish(spark, f"{tmp_path}/p", both, overwrite=overwrite)

    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(lambda n: write(n, True), range(1, 7)))
    now = storage.current_version(spark, f"{tmp_path}/p")
    assert now in versions
    sizes = {spark.read.parquet(f"{now}/{part}").count() for part in ("a", "b")}
    assert sizes == {versions.index(now) + 1}

    def once(version):  # another writer is first while this one still writes
        if not storage.is_published(spark, f"{tmp_path}/q"):
            storage.publish(spark, f"{tmp_path}/q", lambda v: spark.range(1).write.parquet(v))
        spark.range(2).write.parquet(version)

    with pytest.raises(Exception, match="(?i)exist"):
        storage.publish(spark, f"{tmp_path}/q", once)
    assert spark.read.parquet(storage.current_version(spark, f"{tmp_path}/q")).count() == 1


def test_ranks_need_no_single_task(spark):
    rows = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"), F.col("id").alias("v")).repartition(5)
    got = ranking.prefix_sums(rows, ["k"], {"before": F.col("v"), "place": F.lit(1)})
    total = 0
    for n, x in enumerate(got.orderBy("k").collect()):
        assert (x["place"], x["before"]) == (n, total)
        total += x["v"]
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    words = spark.createDataFrame([("b",), (None,), ("a",), ("b",)], "w string")
    assert sorted(map(tuple, ranking.dense_rank(words, "w").collect())) == [("a", 0), ("b", 1)]
    assert ranking.numbered(words.where("false"), ["w"]).count() == 0


def test_epochs_are_permutations(spark):
    from geostrata.operators import epochs

    for n in (1, 2, 5, 17, 257, 1000):
        for seed, epoch in ((1, 0), (1, 1), (7, 0)):
            got = spark.range(n).select("id", epochs.position(F.col("id"), n, seed, epoch).alias("p"), epochs.sample_at(F.col("id"), n, seed, epoch).alias("s")).collect()
            there = {x["id"]: x["p"] for x in got}
            assert sorted(there.values()) == list(range(n)) and all(there[x["s"]] == x["id"] for x in got)
    samples = spark.range(1000).withColumnRenamed("id", "sample")
    one = epochs.epoch_batches(samples, 1000, 64, 3, 1)
    rows = {(x["sample"], x["batch"], x["slot"], x["flip"]) for x in one.repartition(7).collect()}
    assert rows == {(x["sample"], x["batch"], x["slot"], x["flip"]) for x in one.coalesce(1).collect()}
    assert len({x[0] for x in rows}) == 1000 and 400 < sum(x[3] for x in rows) < 600
    assert {(x["sample"], 15, x["slot"], x["flip"]) for x in epochs.batch_members(spark, 1000, 64, 3, 1, 15).collect()} == {x for x in rows if x[1] == 15}
    order = [x["sample"] for x in one.orderBy("batch", "slot").collect()]
    again = [x["sample"] for x in epochs.epoch_batches(samples, 1000, 64, 3, 2).orderBy("batch", "slot").collect()]
    assert order != again and abs(np.corrcoef(order, again)[0, 1]) < 0.15 and abs(np.corrcoef(order, range(1000))[0, 1]) < 0.15
    plain = epochs.epoch_batches(samples, 1000, 64, 3, 1, shuffled=False, flip=False).collect()
    assert all((x["batch"], x["slot"], x["flip"]) == (x["sample"] // 64, x["sample"] % 64, False) for x in plain)
    assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()


def test_joint_flips(spark):
    from geostrata.operators import epochs

    rows = spark.createDataFrame([(True, [1, 2, 3, 4], [5, 6, 7, 8]), (False, [1, 2, 3, 4], [5, 6, 7, 8])], "flip boolean, image array<int>, label array<int>")
    got = sorted((x["flip"], x["image"], x["label"]) for x in epochs.joint_flip(rows, "image", "label", 2).collect())
    assert got == [(False, [1, 2, 3, 4], [5, 6, 7, 8]), (True, [3, 4, 1, 2], [7, 8, 5, 6])]


def test_models_are_loaded_once_a_worker(spark, tmp_path):
    import glob
    import hashlib
    import os
    import uuid

    from geostrata.config import TileConfig
    from geostrata.operators import tiles

    path, folder = f"{tmp_path}/model.bin", str(tmp_path)
    with open(path, "wb") as f:
        f.write(np.array([2.0]).tobytes())

    def load(body):
        with open(f"{folder}/load-{os.getpid()}-{uuid.uuid4().hex}", "w"):
            pass
        slope = np.frombuffer(body)[0]
        return lambda x: 1 / (1 + np.exp(-slope * x.astype(float)))

    rng = np.random.default_rng(0)
    traces = spark.createDataFrame([(i, x, rng.normal(size=40).tolist()) for i in range(6) for x in range(40)], "inline_number int, xl_pos int, amplitudes array<double>")
    config = TileConfig((16, 16), 4)
    with open(path, "rb") as f:
        digest = hashlib.sha256(f.read()).hexdigest()
    model = tiles.ModelFile(path, digest, load)
    cut = tiles.cut_tiles(tiles.scaled_traces(traces), config).repartition(12)
    got = tiles.score_with_model(cut, model, config).orderBy("inline_number", "tx", "tz").collect()
    want = tiles.score_tiles(cut, load(np.array([2.0]).tobytes()), config).orderBy("inline_number", "tx", "tz").collect()
    assert [tuple(x) for x in got] == [tuple(x) for x in want]
    loads = [x.split("load-")[1].split("-")[0] for x in glob.glob(f"{folder}/load-*")]
    loads.remove(str(os.getpid()))  # the one for `want`
    assert 1 <= len(loads) == len(set(loads)) < 12  # 12 tasks or more, one load a worker
    assert tiles.probability_map(traces, model, config).count() == 6 * 40 * 40
    with pytest.raises(Exception, match="SHA-256"):
        tiles.score_with_model(cut, tiles.ModelFile(path, "0" * 64, load), config).collect()


def test_stencils_by_blocks_equal_whole_sections(spark):
    """Small blocks against one array: dilation, nearness and the ridge test, with negative places, gaps and several sections."""
    from geostrata.operators import blocks, grid

    rng = np.random.default_rng(3)
    rows = [(k, int(x), int(z), float(p)) for k in range(2) for x, z, p in {(x, z): (x, z, p) for x, z, p in zip(rng.integers(-9, 40, 500), rng.integers(0, 30, 500), rng.integers(0, 5, 500) / 4, strict=True)}.values()]
    rows += [(2, 3, 3, 0.5), (3, 0, 0, 1.0), (3, 90, 1, 0.25)]
    pixels = spark.createDataFrame(rows, "inline_number int, x int, z int, p double")
    offsets = grid.disk(3)
    want = {(k, x + i, z + j) for k, x, z, _ in rows for i, j in offsets}
    got = [tuple(x) for x in blocks.dilate(pixels, offsets, ["inline_number"], side=8).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    core = pixels.where("p > 0.9")
    near = {(k, x + i, z + j) for k, x, z, p in rows if p > 0.9 for i, j in offsets}
    told = [tuple(x) for x in blocks.within(pixels, core, offsets, ["inline_number"], side=8).collect()]
    assert sorted(told) == sorted((k, x, z, (k, x, z) in near) for k, x, z, _ in rows)
    for ratio, step in ((0.0, 1.0), (0.3, 1.0), (0.1, 2.5)):
        small, large = ([tuple(x) for x in blocks.ridge_core(pixels, ratio, step, "inline_number", side=side).collect()] for side in (8, 512))
        assert len(small) == len(set(small)) and sorted(small) == sorted(large)
    plan = blocks.gradient_blocks(pixels, 2, "inline_number")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    assert blocks.ridge_core(pixels.where("false"), 0.1, 1.0, "inline_number").count() == 0


def test_stage_report_rolls_up(spark):
    from geostrata.plans import detection

    stages = {"candidates": spark.createDataFrame([(1,), (1,), (2,)], "inline_number int"), "clustered": spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 0)], "inline_number int, label int")}
    got = {(x["stage"], x["inline_number"], x["level"]): (x["points"], x["clusters"]) for x in detection.stage_report(detection.tagged_stages(stages)).collect()}
    assert got == {
        ("candidates", 1, 0): (2, 0), ("candidates", 2, 0): (1, 0), ("candidates", None, 1): (3, 0),
        ("clustered", 1, 0): (2, 2), ("clustered", 2, 0): (2, 1), ("clustered", None, 1): (4, 3), (None, None, 3): (7, 3),
    }
    assert detection.stage_counts(stages).columns == ["inline_number", "stage", "points", "clusters"] and detection.stage_counts(stages).count() == 4


def test_clusters_span_blocks(spark):
    """Density clusters by small and large blocks against plain loops: chains over many blocks, borders between clusters, repeated places."""
    from geostrata.operators import density

    rng = np.random.default_rng(5)
    for trial in range(3):
        n = 250
        p = np.round(rng.uniform(-20, 60, (n, 2)) * (1 if trial else 0.4), 0 if trial else 2)
        p = np.concatenate([p, np.stack([np.arange(-20, 60, 1.5), np.full(54, 70.0)], 1), p[:5]])
        pid = rng.permutation(len(p))
        eps, least = ((3.0, 4), (2.0, 2), (4.5, 6))[trial]
        near = ((p[:, None] - p[None]) ** 2).sum(-1) <= eps * eps
        core = near.sum(1) >= least
        left, groups = set(np.flatnonzero(core).tolist()), []
        while left:
            group, queue = set(), [left.pop()]
            while queue:
                k = queue.pop()
                group.add(k)
                more = {j for j in np.flatnonzero(near[k] & core).tolist() if j in left}
                left -= more
                queue += more
            groups.append(group)
        groups.sort(key=lambda g: min(pid[k] for k in g))
        want = {int(pid[k]): next((c for c, g in enumerate(groups) if k in g or (not core[k] and any(near[k][j] for j in g))), -1) for k in range(len(p))}
        points = spark.createDataFrame([(1, int(i), float(a), float(b)) for i, (a, b) in zip(pid, p, strict=True)], "inline_number int, pid long, x double, z double")
        for side in (8, 256):
            found = density.local_clusters(points, eps, least, "inline_number", side)
            assert found.where("own").count() == len(p)
            assert {x["pid"]: x["core"] for x in found.where("own").collect()} == {int(pid[k]): bool(core[k]) for k in range(len(p))}
            joined = {x["root"]: x["cluster"] for x in density.joined_roots(found, "inline_number").collect()}
            order = sorted(set(joined.values()))
            got = {x["pid"]: min((order.index(joined[r]) for r in x["roots"]), default=-1) for x in found.where("own").collect()}
            assert got == want


def test_flat_archives_are_written_by_byte_ranges(spark, tmp_path):
    """One archive by many tasks: NumPy and the reader of archives read it, its checksums hold, and large surfaces are split."""
    import zipfile
    import zlib

    from geostrata.sources import flat_archive, surfaces

    rng = np.random.default_rng(0)
    for _ in range(20):
        a, b = (rng.bytes(int(rng.integers(0, 300))) for _ in "ab")
        assert flat_archive.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    shapes = {"fault_b": (7, 9), "fault_a": (2, 2), "größe": (3, 5)}
    rows = [(k, r, c, 300.0 + r, float(c), rng.normal(), 0.5) for k, (n, m) in shapes.items() for r in range(n) for c in range(m)]
    v = spark.createDataFrame(rows, "track_id string, row int, col int, inline double, profile double, depth double, rmse double").repartition(3)
    path = f"{tmp_path}/s.npz"
    assert flat_archive.write_flat_npz(v, path, chunk=16) == {"surfaces": 3, "vertices": 82, "faces": 2 * (48 + 1 + 8)}
    assert zipfile.ZipFile(path).testzip() is None
    held = np.load(path, allow_pickle=False)
    assert held["surface_ids"].tolist() == ["fault_a", "fault_b", "größe"] and held["vertex_offsets"].tolist() == [0, 4, 67, 82] and held["grid_shapes"].tolist() == [[2, 2], [7, 9], [3, 5]]
    back = [tuple(x) for x in surfaces.read_flat_npz(spark, [path]).collect()]
    assert sorted(back) == sorted(rows)
    with pytest.raises(FileExistsError):
        flat_archive.write_flat_npz(v, path)
    with pytest.raises(Exception, match="without a gap"):
        flat_archive.write_flat_npz(v.where("not (row = 1 and col = 1)"), f"{tmp_path}/t.npz")
    assert flat_archive.write_flat_npz(v.where("false"), f"{tmp_path}/none.npz")["surfaces"] == 0 and np.load(f"{tmp_path}/none.npz")["vertices"].shape == (0, 3)
