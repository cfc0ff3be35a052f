"""As-of lookups on axes, and islands over streams in any split."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from geostrata.operators import asof, catalogue, islands
from geostrata.streaming import islands as streamed


def test_neighbours_across_tasks(spark):
    rng = random.Random(1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that an axis spans tasks
    try:
        axis = {k: sorted(rng.sample(range(1000), n)) for k, n in (("a", 200), ("b", 1), ("c", 2))} | {None: [5, 10**9]}
        entries = spark.createDataFrame([(k, float(v), i) for k, vs in axis.items() for i, v in enumerate(vs)], "k string, value double, idx int")
        rows = [(n, k, v) for n, (k, v) in enumerate([(k, rng.uniform(-10, 1010)) for k in ["a"] * 300 + ["b", "c", "d", None] * 20] + [("a", float(v)) for v in axis["a"]] + [("a", None), ("a", float("nan"))])]
        frame = spark.createDataFrame(rows, "n int, k string, v double")
        found = asof.neighbours(frame, entries, ["k"], "v", "value", ["idx"])
        got = {x["n"]: (x["before"] and x["before"]["at"], x["after"] and x["after"]["at"]) for x in found.collect()}
        assert len(got) == len(rows)
        for n, k, v in rows:
            vs = axis.get(k, [])
            p = bisect.bisect_right(vs, v) if v is not None and v == v else None
            assert got[n] == ((None, None) if p is None else (vs[p - 1] if p else None, vs[p] if p < len(vs) else None))
        index = {x["n"]: x["i"] for x in catalogue.value_to_index(frame, entries, "v", "i", ["k"]).collect()}
        for n, k, v in rows:
            vs = axis.get(k, [])
            inside = v is not None and v == v and bool(vs) and vs[0] <= v <= vs[-1]
            assert (n in index) == inside
            if inside:
                p = bisect.bisect_right(vs, v) - 1
                want = p if v == vs[p] else p + (v - vs[p]) / (vs[p + 1] - vs[p])
                assert index[n] == pytest.approx(want)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    wide = spark.createDataFrame([(0, 0.0), (1, 1e12)], "idx int, value double")  # a step that cells could not be laid over
    assert catalogue.value_to_index(spark.createDataFrame([(2.5e11,)], "v double"), wide, "v", "i", []).first()["i"] == 0.25
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Generate" not in plan


def test_frames_of_lookups_only_grow(spark):
    """A frame up to the last row of its group is gone through anew for each row, at the square of the group."""
    axis = spark.createDataFrame([(k, float(k)) for k in range(5)], "idx int, value double")
    found = asof.neighbours(spark.range(10).select(F.col("id").cast("double").alias("v")), axis, [], "v", "value", ["idx"])
    plan = found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("unboundedpreceding") >= 4 and "unboundedfollowing" not in plan


@pytest.mark.parametrize("split", [1, 2, 3])
def test_streamed_islands_equal_those_of_a_table(spark, tmp_path, split):
    rng = random.Random(split)
    points = [(s, z, x, f"2024-01-01 {s:02d}:{rng.randrange(60):02d}:00") for s in range(4) for z in range(5) for x in rng.sample(range(200), 30)]
    rows = spark.createDataFrame(points, "inline_number int, z int, x int, t string").select("inline_number", "z", "x", F.to_timestamp("t").alias("ts"))
    table = rows.withColumn("file", (F.rand(split) * 6).cast("int"))
    order = list(range(6))
    rng.shuffle(order)
    for n, k in enumerate(order):  # sections and lines are spread over all files; the watermark waits for four hours
        table.where(F.col("file") == k).drop("file").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    for n in (6, 7):  # time goes on, so that the last line is given out
        spark.createDataFrame([(-1, 0, 0, f"2024-01-0{n} 00:00:00")], "inline_number int, z int, x int, t string").select("inline_number", "z", "x", F.to_timestamp("t").alias("ts")).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    query = streamed.write_islands(stream, ["inline_number", "z"], "x", f"{tmp_path}/out", f"{tmp_path}/state", max_gap=5, late="5 hours")
    query.awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out").where("inline_number >= 0").select("inline_number", "z", F.col("middle").cast("int").alias("x"))
    want = islands.representatives(rows, ["inline_number"], "x", "z", 5).select("inline_number", "z", "x")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_late_points_join_islands(spark, tmp_path):
    """Two islands become one by a point of a later file; a point beyond the watermark is left out."""
    files = [[(1, 0, "01:00"), (1, 1, "01:00"), (1, 6, "01:00")], [(1, 3, "01:01")], [(9, 0, "03:00")], [(9, 0, "03:30"), (1, 50, "01:02")], [(9, 0, "09:00")], [(9, 0, "09:30")]]
    for n, held in enumerate(files):
        spark.createDataFrame([(s, x, f"2024-01-01 {t}:00") for s, x, t in held], "s int, x int, t string").select("s", "x", F.to_timestamp("t").alias("ts")).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema("s int, x int, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    streamed.write_islands(stream, ["s"], "x", f"{tmp_path}/out", f"{tmp_path}/state", max_gap=3, late="10 minutes").awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out").where("s = 1").select("first", "middle", "last", "size").collect()
    assert [tuple(x) for x in got] == [(0, 3, 6, 4)]
