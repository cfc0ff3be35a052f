"""Registered queries that write files of the library's formats from the given tables and read them back, or number rows, each with SQL over the tables."""

from __future__ import annotations

import hashlib
import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata import adapters as A
from geostrata import queries as Q
from geostrata.config import LabelConfig, LineConfig, LinkConfig, TileConfig
from geostrata.operators import cluster, epochs, labels, ranking, tiles
from geostrata.plans import detection, reconstruction
from geostrata.plans import label_dataset as datasets
from geostrata.queries import query
from geostrata.sources import fault_lines, files, segy, segy_index, surfaces
from geostrata.sources import flat_archive as archive
from geostrata.storage import current_version, cut_lineage, publish, shared_dir
from geostrata.streaming import islands as streamed


def _folder(spark: SparkSession, name: str) -> str:
    return posixpath.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


# SEG-Y --------------------------------------------------------------------------------------------------------

SAMPLES = 50
#: A cube of line items: inlines are line numbers, crosslines 100 and the month of the year, samples the counts by quantity.
CUBE_SQL = f"""
cells AS (SELECT CAST(l_linenumber AS INTEGER) AS inline_number, CAST(100 + month(l_shipdate) AS INTEGER) AS crossline, CAST(floor(l_quantity) AS INTEGER) AS q, count(*) AS n FROM lineitem GROUP BY 1, 2, 3),
traces AS (SELECT DISTINCT inline_number, crossline, unnest(range({SAMPLES})) AS k FROM cells),
cube AS (SELECT t.inline_number, t.crossline, t.k, coalesce(n, 0) AS a FROM traces t LEFT JOIN cells c ON c.inline_number = t.inline_number AND c.crossline = t.crossline AND c.q = t.k + 1)"""


def _cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = A.table(spark, sf_dir, "lineitem")  # noqa: E741
    cells = l.groupBy(F.col("l_linenumber").cast("int").alias("inline_number"), (100 + F.month("l_shipdate")).alias("crossline"), F.floor("l_quantity").cast("int").alias("q")).agg(F.count("*").alias("n"))
    held = cells.groupBy("inline_number", "crossline").agg(F.map_from_entries(F.collect_list(F.struct("q", F.col("n").cast("float")))).alias("m"))  # at most SAMPLES entries
    return held.select("inline_number", "crossline", F.transform(F.sequence(F.lit(1), F.lit(SAMPLES)), lambda q: F.coalesce(F.element_at("m", q), F.lit(0.0).cast("float"))).alias("amplitudes"))


def _cube_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index, written and read, of the cube in several files whose traces are in no order."""
    folder = _folder(spark, "cube")
    segy.write_segy(_cube(spark, sf_dir).repartition(3, F.xxhash64("crossline", "inline_number") % 5), f"{folder}/files").write.parquet(f"{folder}/written")
    segy_index.write_index(segy_index.scan_headers(spark, f"{folder}/files"), f"{folder}/index")
    return spark.read.parquet(f"{folder}/index")


@query("segy_sections", f"WITH {CUBE_SQL} SELECT inline_number, CAST((crossline - 101) // 2 AS INTEGER) AS xl_pos, crossline, CAST(k // 3 AS INTEGER) AS sample, CAST(a AS DOUBLE) AS amplitude FROM cube WHERE (crossline - 101) % 2 = 0 AND k % 3 = 0")
def segy_sections(spark, sf_dir):
    rows = segy_index.read_sections(_cube_index(spark, sf_dir), xline_stride=2, sample_stride=3)
    return rows.select("inline_number", "xl_pos", "crossline", F.posexplode("amplitudes").alias("sample", "amplitude")).withColumn("amplitude", F.col("amplitude").cast("double"))


@query("segy_inlines", f"WITH {CUBE_SQL} SELECT inline_number, count(DISTINCT crossline) AS traces, count(DISTINCT crossline) AS crosslines, min(crossline) AS first, max(crossline) AS last FROM cube GROUP BY 1")
def segy_inlines(spark, sf_dir):
    return segy_index.inline_facts(_cube_index(spark, sf_dir))


INDEX_SQL = "idx AS (SELECT CAST(l_linenumber AS INTEGER) AS i, CAST(l_suppkey AS INTEGER) AS x FROM lineitem)"


@query("segy_cube_problems", f"""WITH {INDEX_SQL} SELECT 'not one trace at each crossing of inlines and crosslines' AS problem FROM idx HAVING count(*) <> count(DISTINCT i) * count(DISTINCT x)
  UNION ALL SELECT 'inline ' || i || ' has a crossline twice' FROM idx GROUP BY i HAVING count(*) > count(DISTINCT x)""")
def segy_cube_problems(spark, sf_dir):
    """The checks of an index on one that is none of a cube: line items by line number and supplier."""
    same = {c: F.lit(1) for c in ("samples", "interval", "format")}
    index = A.table(spark, sf_dir, "lineitem").select(F.lit("f").alias("path"), F.col("l_orderkey").alias("trace"), F.col("l_linenumber").cast("int").alias("inline_number"), F.col("l_suppkey").cast("int").alias("crossline")).withColumns(same)
    return segy_index.cube_problems(index)


@query("segy_sorting", """WITH t AS (SELECT l_suppkey AS path, l_linenumber AS i, l_partkey AS x, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_linenumber, CASE WHEN l_suppkey % 2 = 0 THEN l_partkey ELSE -l_partkey END, l_orderkey) AS n FROM lineitem),
  m AS (SELECT path, n, (i, x) < lead((i, x)) OVER w AS a, (x, i) < lead((x, i)) OVER w AS b FROM t WINDOW w AS (PARTITION BY path ORDER BY n)),
  s AS (SELECT path, coalesce(bool_and(a), true) AS a, coalesce(bool_and(b), true) AS b FROM m GROUP BY 1)
  SELECT path, CASE WHEN a AND b THEN 'both' WHEN a THEN 'inline' WHEN b THEN 'crossline' ELSE 'none' END AS sorting FROM s""")
def segy_sorting(spark, sf_dir):
    """How traces are sorted in files, one a supplier: line items by line number, then part, forwards or backwards."""
    from pyspark.sql import Window

    part = F.when(F.col("l_suppkey") % 2 == 0, F.col("l_partkey")).otherwise(-F.col("l_partkey"))
    order = Window.partitionBy("l_suppkey").orderBy("l_linenumber", part, "l_orderkey")
    index = A.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("path"), F.row_number().over(order).cast("long").alias("trace"), F.col("l_linenumber").alias("inline_number"), F.col("l_partkey").alias("crossline"))
    return segy_index.sorting(index)


# The artefact -------------------------------------------------------------------------------------------------

#: Points by day and quarter of the section's depth, without quarters of a single point.
LINES_SQL = f"""WITH {A.GRID_POINTS_SQL}, named AS (SELECT inline_number, z // 26 AS label, x, z FROM grid_points WHERE inline_number >= 0),
  good AS (SELECT *, count(*) OVER (PARTITION BY inline_number, label) AS n FROM named),
  dense AS (SELECT inline_number, dense_rank() OVER (PARTITION BY inline_number ORDER BY label) - 1 AS cluster_id, x, z FROM good WHERE n > 1)"""


def _published(spark: SparkSession, sf_dir: str) -> tuple[str, LinkConfig]:
    named = A.grid_points(spark, sf_dir).where("inline_number >= 0").withColumn("label", F.floor(F.col("z") / 26).cast("string"))
    good = named.join(named.groupBy("inline_number", "label").agg(F.count("*").alias("n")).where("n > 1"), ["inline_number", "label"], "left_semi")
    last = good.agg(F.max("inline_number")).first()[0] or 0
    config, folder = LinkConfig(inline_origin=0, inline_step=1, inline_start=0, inline_end=last), _folder(spark, "lines")
    points = cut_lineage(fault_lines.normalised(good, 100, 101))
    sections = points.select("inline_number").distinct()
    fault_lines.write_fault_lines(points.where("x < 50"), sections, folder, config, allow_empty=True)
    fault_lines.write_fault_lines(points, sections, folder, config, overwrite=True, allow_empty=True)
    return folder, config


@query("published_lines", f"{LINES_SQL} SELECT inline_number AS sec, CAST(cluster_id AS VARCHAR) AS cluster, CAST(x AS DOUBLE) AS x, CAST(z AS DOUBLE) AS z FROM dense")
def published_lines(spark, sf_dir):
    """The artefact, written twice, as its readers find it: the second version, checked against its sidecar."""
    folder, config = _published(spark, sf_dir)
    return fault_lines.read_fault_lines(spark, folder, config)[0]


@query("published_sections", f"{LINES_SQL} SELECT inline_number, 'line_' || inline_number AS line_key, count(DISTINCT cluster_id) AS fault_line_count, count(*) AS point_count FROM dense GROUP BY 1")
def published_sections(spark, sf_dir):
    folder, _ = _published(spark, sf_dir)
    return spark.read.parquet(f"{current_version(spark, folder)}/sections")


@query("published_version", "SELECT c_nationkey, count(*) AS customers FROM customer GROUP BY 1")
def published_version(spark, sf_dir):
    """A table that a failed check keeps from being replaced."""
    folder = _folder(spark, "counts")
    counts = A.table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    publish(spark, folder, lambda v: counts.write.parquet(v))

    def check(version: str) -> None:
        if spark.read.parquet(version).where("customers < 0").first():
            raise ValueError("a count is negative")

    try:
        publish(spark, folder, lambda v: counts.withColumn("customers", -F.col("customers")).write.parquet(v), check, overwrite=True)
    except ValueError:
        pass  # as it should
    return spark.read.parquet(current_version(spark, folder))


# Numbers and batches --------------------------------------------------------------------------------------------

@query("order_places", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS place, CAST(coalesce(sum(o_custkey) OVER (ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM orders")
def order_places(spark, sf_dir):
    rows = A.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_custkey")
    return ranking.prefix_sums(rows, ["o_orderdate", "o_orderkey"], {"place": F.lit(1), "before": F.col("o_custkey")}).select("o_orderkey", "place", "before")


@query("date_ranks", "SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderdate) - 1 AS rank FROM orders")
def date_ranks(spark, sf_dir):
    rows = A.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return rows.join(ranking.dense_rank(rows, "o_orderdate"), "o_orderdate").select("o_orderkey", "rank")


SEED, EPOCH, BATCH = 2026, 3, 16


def _added_sql(k: int, value: str) -> str:
    return f"CAST(concat('0x', substr(md5(concat_ws(':', '{SEED}:{EPOCH}', '{k}', CAST({value} AS VARCHAR))), 1, 12)) AS BIGINT)"


#: The permutation of epochs.py, four rounds a step, repeated while a number is beyond the samples.
PLACES_SQL = f"""
numbers AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS sample, count(*) OVER () AS n FROM orders),
sized AS (SELECT *, CAST(ceil(sqrt(n)) AS BIGINT) AS a, CAST(ceil(n / ceil(sqrt(n))) AS BIGINT) AS b FROM numbers),
walk AS (
  SELECT o_orderkey, sample, n, a, b, sample AS y, 0 AS step FROM sized
  UNION ALL SELECT o_orderkey, sample, n, a, b, r2 * b + c2, step + 1 FROM (
    SELECT *, (c1 + {_added_sql(3, "r2")}) % b AS c2 FROM (SELECT *, (r1 + {_added_sql(2, "c1")}) % a AS r2 FROM (
      SELECT *, (y % b + {_added_sql(1, "r1")}) % b AS c1 FROM (SELECT *, (y // b + {_added_sql(0, "y % b")}) % a AS r1 FROM walk WHERE step = 0 OR y >= n)))) t),
places AS (SELECT o_orderkey, sample, y AS place FROM walk WHERE step > 0 AND y < n)"""
FLIP_SQL = f"CAST(concat('0x', substr(md5(concat_ws(':', 'flip:{SEED}:{EPOCH}', CAST(sample AS VARCHAR))), 1, 8)) AS BIGINT) < 2147483648"


@query("epoch_batches", f"WITH RECURSIVE {PLACES_SQL} SELECT o_orderkey, sample, place // {BATCH} AS batch, CAST(place % {BATCH} AS INTEGER) AS slot, {FLIP_SQL} AS flip FROM places")
def epoch_batches(spark, sf_dir):
    orders = cut_lineage(ranking.numbered(A.table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], "sample"))
    return epochs.epoch_batches(orders, orders.count(), BATCH, SEED, EPOCH)


@query("validation_batches", f"SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // {BATCH} AS batch, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) % {BATCH} AS INTEGER) AS slot, false AS flip FROM orders")
def validation_batches(spark, sf_dir):
    orders = ranking.numbered(A.table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], "sample")
    return epochs.epoch_batches(orders, 0, BATCH, SEED, EPOCH, shuffled=False, flip=False).drop("sample")


@query("batch_members", f"WITH RECURSIVE {PLACES_SQL} SELECT sample, CAST(place % {BATCH} AS INTEGER) AS slot, {FLIP_SQL} AS flip FROM places WHERE place // {BATCH} = 7")
def batch_members(spark, sf_dir):
    """The eighth batch, without the others."""
    return epochs.batch_members(spark, A.table(spark, sf_dir, "orders").count(), BATCH, SEED, EPOCH, 7)


# Scoring and reports --------------------------------------------------------------------------------------------

@query("model_probability_map", Q.ORACLE_SQL["probability_map"])
def model_probability_map(spark, sf_dir):
    """The probability map by a model file, here the slope of a logistic function, that each worker reads and checks once."""
    path, body = posixpath.join(_folder(spark, "model"), "weights"), b"1.0"
    store, at = files.store(posixpath.dirname(path))
    store.create_dir(at, recursive=True)
    with store.open_output_stream(f"{at}/weights") as f:
        f.write(body)
    model = tiles.ModelFile(path, hashlib.sha256(body).hexdigest(), _logistic)
    return tiles.probability_map(Q._tile_traces(spark, sf_dir), model, TileConfig((Q.TILE, Q.TILE), Q.OVERLAP)).select("inline_number", "x", "z", F.round("p", 4).alias("p"))


def _logistic(body: bytes) -> tiles.Scorer:
    import numpy as np

    slope = float(body)
    return lambda x: 1 / (1 + np.exp(-slope * x.astype(float)))


@query("stage_report", f"""WITH RECURSIVE {Q.CLUSTERS_SQL}, tagged AS (SELECT inline_number, 'candidates' AS stage, CAST(NULL AS BIGINT) AS label FROM grid_points UNION ALL SELECT inline_number, 'grouped', CAST(NULL AS BIGINT) FROM grouped UNION ALL SELECT inline_number, 'clustered', label FROM clustered WHERE label >= 0),
  each AS (SELECT inline_number, stage, label, count(*) AS points FROM tagged GROUP BY 1, 2, 3)
  SELECT inline_number, stage, CAST(GROUPING(stage, inline_number) AS BIGINT) AS level, CAST(sum(points) AS BIGINT) AS points, count(label) AS clusters FROM each GROUP BY ROLLUP (stage, inline_number)""")
def stage_report(spark, sf_dir):
    points = cut_lineage(Q._points(spark, sf_dir))
    label = cluster.dbscan(points, 3, 3).where("label >= 0")
    return detection.stage_report(detection.tagged_stages({"candidates": A.grid_points(spark, sf_dir), "grouped": points, "clustered": points.join(label, ["inline_number", "pid"])}))


@query("flat_archive", Q.ORACLE_SQL["track_surfaces"])
def flat_archive(spark, sf_dir):
    """Surfaces written as one flat archive by byte ranges, and read back."""
    path = posixpath.join(_folder(spark, "archive"), "surfaces.npz")
    archive.write_flat_npz(cut_lineage(reconstruction.reconstruct(A.fault_points(spark, sf_dir), Q.LINK)["surfaces"]), path)
    back = surfaces.read_flat_npz(spark, [path])
    return back.select(F.col("surface_id").alias("track_id"), "row", "col", "inline", F.round("profile", 5).alias("profile"), F.round("sample", 5).alias("depth"), F.round("rmse", 5).alias("rmse"))


# Streams --------------------------------------------------------------------------------------------------------

GAP = 3


@query("streamed_islands", f"WITH {A.GRID_POINTS_SQL}, {Q._grouped_sql('grid_points', GAP)} SELECT inline_number, z, x FROM rep_x")
def streamed_islands(spark, sf_dir):
    """The middles of islands along each line of a section whose points arrive in several files, by a query that keeps each line's state until its watermark has passed."""
    folder = _folder(spark, "points")
    seconds = F.unix_timestamp("ts")
    points = A.table(spark, sf_dir, "events").select(
        F.floor((seconds - A.EPOCH) / 86400).cast("int").alias("inline_number"), F.floor(F.pmod(seconds, F.lit(86400)) / 864).cast("int").alias("x"),
        F.floor(F.least("value", F.lit(100.0))).cast("int").alias("z"), F.col("ts").cast("timestamp").alias("ts"),
    )
    points.repartition(3).write.parquet(f"{folder}/0")
    for k in (1, 2):  # time goes on, so that the last lines are given out
        ends = points.agg(F.max("ts").alias("ts")).select(F.lit(None).cast("int").alias("inline_number"), F.lit(0).alias("x"), F.lit(0).alias("z"), (F.col("ts") + F.expr(f"make_interval({k} * 10)")).alias("ts"))
        ends.coalesce(1).write.parquet(f"{folder}/{k}")
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 2).option("recursiveFileLookup", True).parquet(folder)
    out = _folder(spark, "islands")
    streamed.write_islands(stream, ["inline_number", "z"], "x", f"{out}/rows", f"{out}/state", GAP, late="1000 days").awaitTermination()
    return spark.read.parquet(f"{out}/rows").where("inline_number is not null").select("inline_number", "z", F.col("middle").cast("int").alias("x"))


# The label dataset ------------------------------------------------------------------------------------------------

#: A section's amplitudes: ten times the picks of the column, and the row modulo 16; both axes are thinned by 2.
PATCH_FILES_SQL = f"""WITH {Q.PATCH_SQL}, columns AS (SELECT inline_id, x_idx, count(*) AS n FROM picks WHERE x_idx >= 0 AND x_idx < {Q.NX} AND z_idx >= 0 AND z_idx < {Q.NZ} GROUP BY 1, 2),
  cells AS (SELECT p.*, coalesce(n, 0) * 10 + (2 * (z0 + j)) % 16 AS a FROM (SELECT patch.*, i, j FROM patch, range({Q.PATCH}) t(i), range({Q.PATCH}) u(j)) p LEFT JOIN columns c ON c.inline_id = p.inline_id AND c.x_idx = 2 * (x0 + i)),
  ends AS (SELECT inline_id, x0, z0, label_pixels, min(a) AS low, max(a) AS high, avg(a) AS mean FROM cells GROUP BY 1, 2, 3, 4)
  SELECT CAST(inline_id AS INTEGER) AS inline_id, CASE WHEN inline_id % 5 = 0 THEN 'val' ELSE 'train' END AS split, CAST(x0 AS INTEGER) AS x0, CAST(z0 AS INTEGER) AS z0, label_pixels, label_pixels AS ones, round((mean - low) / (high - low) + 0.0002, 3) AS mean FROM ends"""


@query("label_dataset", PATCH_FILES_SQL)
def label_dataset(spark, sf_dir):
    """Sections and picks written as SEG-Y and CSV, made into a dataset of patches, and its manifest and patch files read back."""
    folder = _folder(spark, "labels")
    picks = A.picks(spark, sf_dir)
    inside = cut_lineage(labels.inside(picks, Q.NX, Q.NZ, "x_idx", "z_idx"))
    inlines = [x[0] for x in picks.select("inline_id").distinct().orderBy("inline_id").collect()]  # one row a nation
    counts = inside.groupBy("inline_id", F.col("x_idx").alias("crossline")).agg(F.count("*").alias("n"))
    every = picks.select("inline_id").distinct().withColumn("crossline", F.explode(F.sequence(F.lit(0), F.lit(Q.NX - 1))))
    traces = every.join(counts, ["inline_id", "crossline"], "left").select(
        F.col("inline_id").cast("int").alias("inline_number"), "crossline", F.transform(F.sequence(F.lit(0), F.lit(Q.NZ - 1)), lambda z: (F.coalesce("n", F.lit(0)) * 10 + z % 16).cast("float")).alias("amplitudes")
    )
    path = segy.write_segy(traces.repartition(1).sortWithinPartitions("inline_number", "crossline"), f"{folder}/sections").first()["path"]
    inside.select("inline_id", "x_idx", "z_idx", "fault_id").repartition("inline_id").write.option("header", True).partitionBy("inline_id").csv(f"{folder}/picks")
    found = {int(p.rpartition("inline_id=")[2].partition("/")[0]): p for p in spark.read.option("header", True).csv(f"{folder}/picks").inputFiles()}
    lines = [LineConfig(k, path, found[k], "val" if k % 5 == 0 else "train", place, fault_id_col=2, label_shape_before_downsample=(Q.NX, Q.NZ), downsample_x=2, downsample_z=2) for place, k in enumerate(inlines) if k in found]
    config = LabelConfig(ellipse=(3, 2), patch_size=Q.PATCH, stride=Q.STRIDE, min_label_pixels=4, target_train=10**6, target_val=10**6)
    manifest = datasets.build_label_dataset(spark, lines, f"{folder}/out", config)["manifest"]
    values = lambda kind, side, dtype="<f4": files.read_patches(spark, f"{folder}/out/{side}/{kind}/*.npy", Q.PATCH, dtype).withColumn("split", F.lit(side))
    mean = F.aggregate("values", F.lit(0.0), lambda a, v: a + v.cast("double")) / Q.PATCH**2
    images = values("seismic", "train").unionByName(values("seismic", "val")).select("split", "stem", mean.alias("mean"))
    marks = values("labels", "train").unionByName(values("labels", "val")).select("split", "stem", F.aggregate("values", F.lit(0.0), lambda a, v: a + v.cast("double")).cast("long").alias("ones"))
    rows = manifest.withColumn("stem", F.regexp_extract("seismic_file", r"([^/]+)\.npy$", 1)).join(images, ["split", "stem"]).join(marks, ["split", "stem"])
    return rows.select(F.col("inline_id").cast("int").alias("inline_id"), "split", F.col("x0").cast("int").alias("x0"), F.col("z0").cast("int").alias("z0"), F.col("label_pixels").cast("long").alias("label_pixels"), "ones", F.round(F.col("mean") + 0.0002, 3).alias("mean"))  # off the ties that whole amplitudes give


# Saved runs and files ---------------------------------------------------------------------------------------------


@query("saved_tracks", Q.ORACLE_SQL["track_summary"])
def saved_tracks(spark, sf_dir):
    """The tracks of a reconstruction, as a reader of its folder finds them."""
    folder = _folder(spark, "run")
    reconstruction.save_reconstruction(reconstruction.reconstruct(A.fault_points(spark, sf_dir), Q.LINK, surfaces=False), folder, Q.LINK)
    out = spark.read.parquet(f"{folder}/tracks")
    return out.select("track_id", "lines", "first", "last", *[F.round(c, 6).alias(c) for c in ("min_similarity", "mean_similarity")])


@query("file_checksums", """SELECT c_nationkey, CAST(sum(strlen(c_name) + 1) AS BIGINT) AS size, sha256(concat(string_agg(c_name, chr(10) ORDER BY c_custkey), chr(10))) AS sha256 FROM customer GROUP BY 1""")
def file_checksums(spark, sf_dir):
    """Sizes and checksums of files, here the names of each nation's customers, read in pieces."""
    folder = _folder(spark, "names")
    names = A.table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))).alias("rows"))
    names.select("c_nationkey", F.array_join("rows.c_name", "\n").alias("value")).repartition("c_nationkey").write.partitionBy("c_nationkey").text(folder)
    paths = spark.read.text(folder).inputFiles()  # one name a nation
    return files.checksums(spark, paths).select(F.regexp_extract("path", "c_nationkey=([0-9]+)", 1).cast("int").alias("c_nationkey"), "size", "sha256")


@query("section_archives", f"{LINES_SQL} SELECT inline_number, CAST(cluster_id AS INTEGER) AS cluster_id, CAST(x AS INTEGER) AS x, CAST(z AS INTEGER) AS z FROM dense")
def section_archives(spark, sf_dir):
    """Fault points written as one archive a section, and read back."""
    folder, _ = _published(spark, sf_dir)
    points = spark.read.parquet(f"{current_version(spark, folder)}/points")
    written = cut_lineage(fault_lines.write_section_npz(points, f"{folder}/archives"))
    return fault_lines.read_section_npz(written)
