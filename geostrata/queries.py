"""Registered queries of the seismic operators over the driver's tables, each with the SQL that an independent engine runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geostrata import adapters as A
from geostrata.config import LabelConfig, LinkConfig, TileConfig
from geostrata.functions import scalars
from geostrata.operators import catalogue, cluster, contracts, curve, grid, islands, labels, linking, normalise, splits, surface, tiles
from geostrata.plans import detection, reconstruction
from geostrata.sources import surfaces as surface_files
from geostrata.storage import cut_lineage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: The published defaults, named because the SQL repeats them.
LINK = LinkConfig(section_scale=1.0, profile_scale=1.0, depth_scale=1.0)
PATCH, STRIDE, NX, NZ = 32, 16, 256, 256


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return add


def _r(*columns: str):
    return [F.round(c, 6).alias(c) for c in columns]


# Linking ---------------------------------------------------------------------------------------------------

LINES_SQL = f"""
WITH {A.FAULT_POINTS_SQL},
lines AS (
  SELECT sec, cluster, count(*) AS n, min(x) AS x0, max(x) AS x1, min(z) AS z0, max(z) AS z1,
         0.5 * atan2(2 * covar_pop(x, z), var_pop(x) - var_pop(z)) AS theta, avg(x) AS mean_x, avg(z) AS mean_z,
         'line_' || sec || '_c' || cluster AS line_id
  FROM fault_points GROUP BY sec, cluster HAVING count(*) >= 2)"""
PAIRS_SQL = f"""{LINES_SQL},
pairs AS (
  SELECT a.line_id AS source_id, b.line_id AS target_id, a.sec AS source_sec, b.sec AS target_sec, a.cluster AS ca, b.cluster AS cb, b.sec - a.sec AS gap,
         least(1.0, greatest(0.0, 1 - abs(cos(a.theta - b.theta)))) AS orientation,
         sqrt(power(greatest(0.0, a.x0 - b.x1, b.x0 - a.x1), 2) + power(greatest(0.0, a.z0 - b.z1, b.z0 - a.z1), 2) + power(b.sec - a.sec, 2)) AS apart
  FROM lines a JOIN lines b ON b.sec > a.sec AND b.sec <= a.sec + 5),
bounded AS (SELECT *, 0.06 * apart + orientation AS bound, 0.06 * apart + orientation >= -ln(0.7) AS pruned FROM pairs)"""
SCORED_SQL = f"""{PAIRS_SQL},
met AS (
  SELECT p.source_id, p.target_id, p.gap, f.x AS x, f.z AS z, g.x AS u, g.z AS v, (f.x - g.x) * (f.x - g.x) + (f.z - g.z) * (f.z - g.z) AS d
  FROM bounded p JOIN fault_points f ON f.sec = p.source_sec AND f.cluster = p.ca JOIN fault_points g ON g.sec = p.target_sec AND g.cluster = p.cb
  WHERE NOT pruned),
near_a AS (SELECT source_id, target_id, sqrt(min(d) + gap * gap) AS d FROM met GROUP BY source_id, target_id, gap, x, z),
near_b AS (SELECT source_id, target_id, sqrt(min(d) + gap * gap) AS d FROM met GROUP BY source_id, target_id, gap, u, v),
ab AS (SELECT source_id, target_id, avg(d) AS chamfer_ab FROM near_a GROUP BY ALL),
ba AS (SELECT source_id, target_id, avg(d) AS chamfer_ba FROM near_b GROUP BY ALL),
scored AS (
  SELECT p.source_id, p.target_id, p.source_sec, p.target_sec, p.gap, chamfer_ab, chamfer_ba, chamfer_ab + chamfer_ba AS chamfer, orientation,
         exp(-(0.03 * (chamfer_ab + chamfer_ba) + orientation)) AS similarity
  FROM bounded p JOIN ab USING (source_id, target_id) JOIN ba USING (source_id, target_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY similarity DESC, gap, target_id) = 1 AS source_best FROM scored WHERE similarity > 0.7),
matches AS (SELECT *, source_best AND row_number() OVER (PARTITION BY target_id ORDER BY source_best DESC, similarity DESC, gap, source_id) = 1 AS selected FROM ranked)"""
TRACKS_SQL = f"""{SCORED_SQL.replace("WITH", "WITH RECURSIVE", 1)},
edges AS (SELECT source_id, target_id FROM matches WHERE selected AND gap = 1),
walk AS (
  SELECT source_id AS line_id, source_id AS start, 0 AS position FROM edges WHERE source_id NOT IN (SELECT target_id FROM edges)
  UNION ALL SELECT e.target_id, w.start, w.position + 1 FROM walk w JOIN edges e ON e.source_id = w.line_id),
member AS (SELECT w.*, l.sec, l.mean_x, l.mean_z FROM walk w JOIN lines l USING (line_id)),
tracks AS (
  SELECT start, printf('fault_%04d', row_number() OVER (ORDER BY min(sec), round(avg(mean_x), 9), round(avg(mean_z), 9), start)) AS track_id
  FROM member GROUP BY start HAVING count(*) >= 3)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.fault_lines(A.fault_points(spark, sf_dir), LINK)


@query("fault_lines", f"{LINES_SQL} SELECT line_id, sec, cluster, n, round(x0, 6) AS x0, round(x1, 6) AS x1, round(z0, 6) AS z0, round(z1, 6) AS z1, round(abs(cos(theta)), 6) AS axis FROM lines")
def fault_lines(spark, sf_dir):
    return _lines(spark, sf_dir).select("line_id", "sec", "cluster", "n", *_r("x0", "x1", "z0", "z1"), F.round(F.abs(F.cos("theta")), 6).alias("axis"))


@query("link_candidates", f"{PAIRS_SQL} SELECT source_id, target_id, gap, round(orientation, 6) AS orientation, round(bound, 6) AS bound, pruned FROM bounded")
def link_candidates(spark, sf_dir):
    pairs = linking.candidate_pairs(_lines(spark, sf_dir), LINK)
    return pairs.select(F.col("a.line_id").alias("source_id"), F.col("b.line_id").alias("target_id"), "gap", *_r("orientation", "bound"), "pruned")


@query("link_scores", f"{SCORED_SQL} SELECT source_id, target_id, gap, round(chamfer_ab, 6) AS chamfer_ab, round(chamfer_ba, 6) AS chamfer_ba, round(similarity, 6) AS similarity FROM scored")
def link_scores(spark, sf_dir):
    return linking.score_candidates(cut_lineage(_lines(spark, sf_dir)), LINK).select("source_id", "target_id", "gap", *_r("chamfer_ab", "chamfer_ba", "similarity"))


@query("best_matches", f"{SCORED_SQL} SELECT source_id, target_id, gap, source_best, selected FROM matches")
def best_matches(spark, sf_dir):
    return linking.best_matches(linking.score_candidates(cut_lineage(_lines(spark, sf_dir)), LINK)).select("source_id", "target_id", "gap", "source_best", "selected")


@query("link_counters", f"""{TRACKS_SQL}, place AS (SELECT line_id, start, position FROM member JOIN tracks USING (start)),
  edge AS (SELECT count(*) AS n FROM matches m JOIN place a ON a.line_id = m.source_id JOIN place b ON b.line_id = m.target_id WHERE selected AND gap = 1 AND a.start = b.start AND b.position = a.position + 1)
  SELECT (SELECT count(*) FROM bounded) AS considered, (SELECT count(*) FROM bounded WHERE pruned) AS pruned, (SELECT count(*) FROM scored) AS exact,
  count(*) AS above_threshold, CAST(coalesce(sum(CASE WHEN source_best THEN 1 ELSE 0 END), 0) AS BIGINT) AS source_best, CAST(coalesce(sum(CASE WHEN selected THEN 1 ELSE 0 END), 0) AS BIGINT) AS selected,
  CAST(coalesce(sum(CASE WHEN selected AND gap = 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS adjacent, (SELECT n FROM edge) AS track_edge, (SELECT count(*) FROM lines) AS lines, (SELECT count(*) FROM tracks) AS tracks FROM matches""")
def link_counters(spark, sf_dir):
    return reconstruction.reconstruct(A.fault_points(spark, sf_dir), LINK, surfaces=False)["counters"]


@query("link_table", f"""{TRACKS_SQL}, place AS (SELECT line_id, start, position FROM member JOIN tracks USING (start))
  SELECT s.source_id, s.target_id, CAST(300 + s.source_sec AS INTEGER) AS source_inline, CAST(300 + s.target_sec AS INTEGER) AS target_inline, s.gap, round(s.similarity, 6) AS similarity, s.similarity > 0.7 AS above_threshold,
  coalesce(m.source_best, false) AS source_best, coalesce(m.selected, false) AS selected, coalesce(m.selected AND s.gap = 1 AND a.start = b.start AND b.position = a.position + 1, false) AS track_edge
  FROM scored s LEFT JOIN matches m ON m.source_id = s.source_id AND m.target_id = s.target_id LEFT JOIN place a ON a.line_id = s.source_id LEFT JOIN place b ON b.line_id = s.target_id""")
def link_table(spark, sf_dir):
    links = reconstruction.reconstruct(A.fault_points(spark, sf_dir), LINK, surfaces=False)["links"]
    return links.select("source_id", "target_id", F.col("source_inline").cast("int").alias("source_inline"), F.col("target_inline").cast("int").alias("target_inline"), "gap", *_r("similarity"), "above_threshold", "source_best", "selected", "track_edge")


@query("track_membership", f"""{TRACKS_SQL} SELECT track_id, position AS member_order, line_id, 'line_' || m.sec AS source_key, CAST(300 + m.sec AS INTEGER) AS inline_number, m.sec AS section_index, cluster AS cluster_id, n AS point_count
  FROM member m JOIN tracks USING (start) JOIN lines USING (line_id)""")
def track_membership(spark, sf_dir):
    lines = cut_lineage(_lines(spark, sf_dir))
    matches = cut_lineage(linking.best_matches(linking.score_candidates(lines, LINK)))  # read more than once
    tracks = linking.build_tracks(matches, lines, LINK)
    return reconstruction.membership_table(tracks, lines, LINK).withColumn("inline_number", F.col("inline_number").cast("int"))


@query("track_summary", f"""{TRACKS_SQL} SELECT track_id, count(*) AS lines, min(m.sec) AS first, max(m.sec) AS last, round(min(similarity), 6) AS min_similarity, round(avg(similarity), 6) AS mean_similarity
  FROM member m JOIN tracks USING (start) LEFT JOIN (SELECT target_id, similarity FROM matches WHERE selected AND gap = 1) e ON e.target_id = m.line_id AND m.position > 0 GROUP BY track_id""")
def track_summary(spark, sf_dir):
    lines = cut_lineage(_lines(spark, sf_dir))
    matches = cut_lineage(linking.best_matches(linking.score_candidates(lines, LINK)))
    out = reconstruction.track_summary(linking.build_tracks(matches, lines, LINK), matches)
    return out.select("track_id", "lines", "first", "last", *_r("min_similarity", "mean_similarity"))


def _smooth_sql(source: str, name: str, along: str, across: str) -> str:
    """CTE name: v of source(track_id, axis, row, col, v) smoothed along one index by a Gaussian of sigma 1 cut off at four, edges repeated."""
    return f"""{name} AS (SELECT s.track_id, s.axis, s.{along}, s.{across}, sum(w.w * t.v) AS v FROM {source} s JOIN tops b USING (track_id), gauss w, {source} t
    WHERE t.track_id = s.track_id AND t.axis = s.axis AND t.{across} = s.{across} AND t.{along} = greatest(0, least(b.{along}, s.{along} + w.k)) GROUP BY 1, 2, 3, 4)"""


SURFACES_SQL = f"""{TRACKS_SQL},
  placed AS (SELECT track_id, m.sec, m.line_id, p.x, p.z FROM member m JOIN tracks USING (start) JOIN lines l USING (line_id) JOIN fault_points p ON p.sec = l.sec AND p.cluster = l.cluster),
  axis_of AS (SELECT line_id, avg(x) AS mx, avg(z) AS mz, 0.5 * atan2(2 * covar_pop(x, z), var_pop(x) - var_pop(z)) AS t FROM placed GROUP BY 1),
  sorted AS (SELECT p.*, row_number() OVER (PARTITION BY line_id ORDER BY round(cos(t) * (x - mx) + sin(t) * (z - mz), 9), x, z) - 1 AS pos FROM placed p JOIN axis_of USING (line_id)),
  steps AS (SELECT *, CASE WHEN pos = 0 THEN 0.0 ELSE greatest(sqrt(power(x - lag(x) OVER w, 2) + power(z - lag(z) OVER w, 2)), 1e-6) END AS d FROM sorted WINDOW w AS (PARTITION BY line_id ORDER BY pos)),
  arcs AS (SELECT *, sum(d) OVER (PARTITION BY line_id ORDER BY pos) AS s FROM steps),
  scaled AS (SELECT *, s / max(s) OVER (PARTITION BY line_id) * 127 AS u FROM arcs),
  spans AS (SELECT *, lead(u) OVER w AS u2, lead(x) OVER w AS x2, lead(z) OVER w AS z2, lead(u, 2) OVER w IS NULL AS last FROM scaled WINDOW w AS (PARTITION BY line_id ORDER BY pos)),
  even AS (SELECT track_id, sec, i, x + least(1.0, (i - u) / (u2 - u)) * (x2 - x) AS x, z + least(1.0, (i - u) / (u2 - u)) * (z2 - z) AS z
    FROM (SELECT *, unnest(range(CAST(ceil(u) AS INTEGER), CAST(CASE WHEN last THEN 127 ELSE ceil(u2) - 1 END AS INTEGER) + 1)) AS i FROM spans WHERE u2 IS NOT NULL)),
  tips AS (SELECT a.track_id, a.sec, a.x AS ax, a.z AS az, b.x AS bx, b.z AS bz FROM even a JOIN even b ON a.track_id = b.track_id AND a.sec = b.sec AND a.i = 0 AND b.i = 127),
  turns AS (SELECT *, sqrt(power(lag(ax) OVER w - bx, 2) + power(lag(az) OVER w - bz, 2)) + sqrt(power(lag(bx) OVER w - ax, 2) + power(lag(bz) OVER w - az, 2)) AS crossed,
    sqrt(power(lag(ax) OVER w - ax, 2) + power(lag(az) OVER w - az, 2)) + sqrt(power(lag(bx) OVER w - bx, 2) + power(lag(bz) OVER w - bz, 2)) AS straight FROM tips WINDOW w AS (PARTITION BY track_id ORDER BY sec)),
  parity AS (SELECT track_id, sec, sum(CASE WHEN crossed < straight THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY sec) % 2 AS turned FROM turns),
  laid AS (SELECT e.track_id, e.sec - min(e.sec) OVER (PARTITION BY e.track_id) AS row, CASE WHEN turned = 1 THEN 127 - i ELSE i END AS col, e.sec, x, z FROM even e JOIN parity USING (track_id, sec)),
  tops AS (SELECT track_id, max(row) AS row, max(col) AS col FROM laid GROUP BY 1),
  raw AS (SELECT track_id, 'x' AS axis, row, col, x AS v FROM laid UNION ALL SELECT track_id, 'z', row, col, z FROM laid),
  gauss AS (SELECT k, exp(-0.5 * k * k) / (SELECT sum(exp(-0.5 * j * j)) FROM range(-4, 5) t(j)) AS w FROM range(-4, 5) u(k)),
  {_smooth_sql("raw", "once", "row", "col")}, {_smooth_sql("once", "twice", "col", "row")},
  final AS (SELECT r.track_id, r.axis, r.row, r.col, 0.25 * r.v + 0.75 * t.v AS v, power(0.75 * (t.v - r.v), 2) AS e FROM raw r JOIN twice t USING (track_id, axis, row, col)),
  errors AS (SELECT track_id, sqrt(sum(e) / (count(*) / 2)) AS rmse FROM final GROUP BY 1)"""


@query("track_surfaces", f"""{SURFACES_SQL} SELECT l.track_id, CAST(l.row AS INTEGER) AS row, CAST(l.col AS INTEGER) AS col, CAST(300 + l.sec AS DOUBLE) AS inline, round(x.v, 5) AS profile, round(z.v, 5) AS depth, round(rmse, 5) AS rmse
  FROM laid l JOIN final x ON x.track_id = l.track_id AND x.row = l.row AND x.col = l.col AND x.axis = 'x' JOIN final z ON z.track_id = l.track_id AND z.row = l.row AND z.col = l.col AND z.axis = 'z' JOIN errors e ON e.track_id = l.track_id""")
def track_surfaces(spark, sf_dir):
    out = reconstruction.reconstruct(A.fault_points(spark, sf_dir), LINK)["surfaces"]
    return out.select("track_id", "row", "col", "inline", *[F.round(c, 5).alias(c) for c in ("profile", "depth", "rmse")])


@query("flat_faces", f"""{SURFACES_SQL}, shape AS (SELECT track_id, row + 1 AS r, col + 1 AS c, sum((row + 1) * (col + 1)) OVER (ORDER BY track_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS o FROM tops),
  cell AS (SELECT track_id, c, coalesce(o, 0) + i * c + j AS v FROM (SELECT *, unnest(range(c - 1)) AS j FROM (SELECT *, unnest(range(r - 1)) AS i FROM shape)))
  SELECT track_id, CAST(v AS BIGINT) AS a, CAST(v + c AS BIGINT) AS b, CAST(v + 1 AS BIGINT) AS c FROM cell UNION ALL SELECT track_id, CAST(v + 1 AS BIGINT), CAST(v + c AS BIGINT), CAST(v + c + 1 AS BIGINT) FROM cell""")
def flat_faces(spark, sf_dir):
    return surface.flat_faces(reconstruction.reconstruct(A.fault_points(spark, sf_dir), LINK)["surfaces"]).select("track_id", *[F.col(c).cast("long").alias(c) for c in "abc"])


@query("resampled_lines", f"""WITH {A.FAULT_POINTS_SQL}, o AS (SELECT sec, cluster, x, z, row_number() OVER (PARTITION BY sec, cluster ORDER BY x, z) - 1 AS pos FROM fault_points),
  st AS (SELECT *, CASE WHEN pos = 0 THEN 0.0 ELSE greatest(sqrt(power(x - lag(x) OVER w, 2) + power(z - lag(z) OVER w, 2)), 1e-6) END AS d FROM o WINDOW w AS (PARTITION BY sec, cluster ORDER BY pos)),
  s AS (SELECT *, sum(d) OVER (PARTITION BY sec, cluster ORDER BY pos) AS s FROM st),
  u AS (SELECT *, s / max(s) OVER (PARTITION BY sec, cluster) * 16 AS u FROM s),
  g AS (SELECT *, lead(u) OVER w AS u2, lead(x) OVER w AS x2, lead(z) OVER w AS z2, lead(u, 2) OVER w IS NULL AS last FROM u WINDOW w AS (PARTITION BY sec, cluster ORDER BY pos)),
  e AS (SELECT *, unnest(range(CAST(ceil(u) AS INTEGER), CAST(CASE WHEN last THEN 16 ELSE ceil(u2) - 1 END AS INTEGER) + 1)) AS i FROM g WHERE u2 IS NOT NULL)
  SELECT sec, cluster, CAST(i AS INTEGER) AS i, CAST(floor((x + least(1.0, (i - u) / (u2 - u)) * (x2 - x)) * 1000 + 0.3137) AS BIGINT) AS x_milli, CAST(floor((z + least(1.0, (i - u) / (u2 - u)) * (z2 - z)) * 1000 + 0.3137) AS BIGINT) AS z_milli FROM e""")
def resampled_lines(spark, sf_dir):
    w = Window.partitionBy("sec", "cluster").orderBy("x", "z")
    ordered = A.fault_points(spark, sf_dir).withColumn("pos", F.row_number().over(w) - 1)
    return curve.resample(ordered, 17, ["sec", "cluster"]).select("sec", "cluster", "i", F.floor(F.col("x") * 1000 + 0.3137).alias("x_milli"), F.floor(F.col("z") * 1000 + 0.3137).alias("z_milli"))


@query("neighbouring_sections", f"WITH {A.FAULT_POINTS_SQL}, s AS (SELECT DISTINCT sec FROM fault_points) SELECT a.sec, b.sec AS neighbour FROM s a JOIN s b ON abs(a.sec - b.sec) <= 5 AND a.sec <> b.sec")
def neighbouring_sections(spark, sf_dir):
    return linking.neighbouring_sections(A.fault_points(spark, sf_dir), 5)


@query("consecutive_runs", """WITH e AS (SELECT DISTINCT user_id AS track, CAST(floor((floor(epoch(ts)) - 1704067200) / 86400) AS INTEGER) AS sec FROM events),
  i AS (SELECT track, sec - row_number() OVER (PARTITION BY track ORDER BY sec) AS island FROM e), s AS (SELECT track, island, count(*) AS n FROM i GROUP BY ALL)
  SELECT track, max(n) AS longest, max(n) >= 3 AS valid FROM s GROUP BY track""")
def consecutive_runs(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").select(F.col("user_id").alias("track"), F.floor((F.unix_timestamp("ts") - A.EPOCH) / 86400).cast("int").alias("sec"))
    return linking.consecutive_runs(e, 3)


# Detection on sections ---------------------------------------------------------------------------------------

@query("candidate_pixels", f"WITH {A.PIXELS_SQL} SELECT inline_number, x, z, round(p, 6) AS p FROM pixels WHERE CAST(p AS FLOAT) > CAST(0.1 AS FLOAT)")
def candidate_pixels(spark, sf_dir):
    return grid.candidates(A.pixels(spark, sf_dir)).select("inline_number", "x", "z", *_r("p"))


DENSE_SQL = f"""{A.PIXELS_SQL},
box AS (SELECT inline_number, min(x) AS x0, max(x) AS x1, min(z) AS z0, max(z) AS z1 FROM pixels GROUP BY 1),
cells AS (SELECT inline_number, unnest(range(x0, x1 + 1)) AS x, z0, z1 FROM box),
cells2 AS (SELECT inline_number, x, unnest(range(z0, z1 + 1)) AS z FROM cells),
dense AS (SELECT c.inline_number, c.x, c.z, coalesce(p, 0.0) AS p FROM cells2 c LEFT JOIN pixels q ON q.inline_number = c.inline_number AND q.x = c.x AND q.z = c.z),
grads AS (
  SELECT *, CASE WHEN lag(p) OVER wx IS NULL AND lead(p) OVER wx IS NULL THEN 0 WHEN lag(p) OVER wx IS NULL THEN lead(p) OVER wx - p WHEN lead(p) OVER wx IS NULL THEN p - lag(p) OVER wx ELSE (lead(p) OVER wx - lag(p) OVER wx) / 2 END AS gx,
         CASE WHEN lag(p) OVER wz IS NULL AND lead(p) OVER wz IS NULL THEN 0 WHEN lag(p) OVER wz IS NULL THEN lead(p) OVER wz - p WHEN lead(p) OVER wz IS NULL THEN p - lag(p) OVER wz ELSE (lead(p) OVER wz - lag(p) OVER wz) / 2 END AS gz
  FROM dense WINDOW wx AS (PARTITION BY inline_number, z ORDER BY x), wz AS (PARTITION BY inline_number, x ORDER BY z))"""


@query("pixel_gradients", f"WITH {DENSE_SQL} SELECT inline_number, CAST(x AS INTEGER) AS x, CAST(z AS INTEGER) AS z, round(gx, 6) AS gx, round(gz, 6) AS gz FROM grads")
def pixel_gradients(spark, sf_dir):
    return grid.gradients(grid.dense_grid(A.pixels(spark, sf_dir))).select("inline_number", "x", "z", *_r("gx", "gz"))


RIDGE_SQL = f"""{DENSE_SQL},
most AS (SELECT inline_number, max(sqrt(gx * gx + gz * gz)) AS most FROM grads GROUP BY 1),
steep AS (SELECT g.*, gx / (sqrt(gx * gx + gz * gz) + 1.1920929e-07) AS nx, gz / (sqrt(gx * gx + gz * gz) + 1.1920929e-07) AS nz, x0, x1, z0, z1
  FROM grads g JOIN most m USING (inline_number) JOIN box b USING (inline_number) WHERE most > 0 AND sqrt(gx * gx + gz * gz) >= 0.1 * most),
sides AS (SELECT inline_number, x, z, p, x0, x1, z0, z1, s, greatest(CAST(x0 AS DOUBLE), least(CAST(x1 AS DOUBLE), x + s * nx)) AS ax, greatest(CAST(z0 AS DOUBLE), least(CAST(z1 AS DOUBLE), z + s * nz)) AS az
  FROM steep, (VALUES (1.0), (-1.0)) t(s)),
corners AS (SELECT s.*, CAST(least(x1, floor(ax) + i) AS INTEGER) AS cx, CAST(least(z1, floor(az) + j) AS INTEGER) AS cz,
  (CASE WHEN i = 0 THEN 1 - (ax - floor(ax)) ELSE ax - floor(ax) END) * (CASE WHEN j = 0 THEN 1 - (az - floor(az)) ELSE az - floor(az) END) AS w
  FROM sides s, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)),
side_values AS (SELECT c.inline_number, c.x, c.z, c.s, any_value(c.p) AS p, sum(w * d.p) AS v FROM corners c JOIN dense d ON d.inline_number = c.inline_number AND d.x = c.cx AND d.z = c.cz WHERE w > 0 GROUP BY 1, 2, 3, 4),
ridge AS (SELECT inline_number, x, z FROM side_values GROUP BY 1, 2, 3 HAVING max(v) <= any_value(p) + 1e-12)"""


@query("ridge_core", f"WITH {RIDGE_SQL} SELECT inline_number, CAST(x AS INTEGER) AS x, CAST(z AS INTEGER) AS z FROM ridge")
def ridge_core(spark, sf_dir):
    return grid.ridge_core(A.pixels(spark, sf_dir)).select("inline_number", F.col("x").cast("int").alias("x"), F.col("z").cast("int").alias("z"))


@query("ridge_preserved", f"""WITH {RIDGE_SQL}, cand AS (SELECT inline_number, x, z FROM pixels WHERE CAST(p AS FLOAT) > CAST(0.3 AS FLOAT)),
  near AS (SELECT c.inline_number, c.x, c.z, min(sqrt((c.x - r.x) * (c.x - r.x) + (c.z - r.z) * (c.z - r.z))) AS d FROM cand c JOIN ridge r USING (inline_number) GROUP BY 1, 2, 3),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY inline_number ORDER BY CASE WHEN d <= 1 THEN 0 ELSE d END, x, z) AS n, ceil(count(*) OVER (PARTITION BY inline_number) * 0.9) AS need FROM near)
  SELECT inline_number, CAST(x AS INTEGER) AS x, CAST(z AS INTEGER) AS z FROM ranked WHERE d <= 1 OR n <= need UNION ALL
  SELECT inline_number, x, z FROM cand WHERE inline_number NOT IN (SELECT inline_number FROM ridge)""")
def ridge_preserved(spark, sf_dir):
    pixels = A.pixels(spark, sf_dir)
    core = grid.ridge_core(pixels)
    out = grid.preserve_around_ridges(grid.candidates(pixels, 0.3), core, radius=1, min_keep_ratio=0.9)
    return out.select("inline_number", F.col("x").cast("int").alias("x"), F.col("z").cast("int").alias("z"))


def _grouped_sql(source: str, gap: int) -> str:
    """CTEs grouped and pts: the middle of each run of points along x, then along z, a gap beyond `gap` ending a run."""
    return f"""
by_x AS (SELECT inline_number, x, z, sum(b) OVER (PARTITION BY inline_number, z ORDER BY x) AS island FROM (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY inline_number, z ORDER BY x) > {gap} THEN 1 ELSE 0 END AS b FROM {source})),
rep_x AS (SELECT DISTINCT inline_number, x, z FROM (SELECT *, row_number() OVER (PARTITION BY inline_number, z, island ORDER BY x) - 1 AS n, count(*) OVER (PARTITION BY inline_number, z, island) // 2 AS m FROM by_x) WHERE n = m),
by_z AS (SELECT inline_number, x, z, sum(b) OVER (PARTITION BY inline_number, x ORDER BY z) AS island FROM (SELECT *, CASE WHEN z - lag(z) OVER (PARTITION BY inline_number, x ORDER BY z) > {gap} THEN 1 ELSE 0 END AS b FROM rep_x)),
grouped AS (SELECT DISTINCT inline_number, x, z FROM (SELECT *, row_number() OVER (PARTITION BY inline_number, x, island ORDER BY z) - 1 AS n, count(*) OVER (PARTITION BY inline_number, x, island) // 2 AS m FROM by_z) WHERE n = m),
pts AS (SELECT inline_number, x, z, row_number() OVER (PARTITION BY inline_number ORDER BY x, z) - 1 AS pid FROM grouped)"""


GROUPED_SQL = _grouped_sql("grid_points", 3)


def _grouped(spark, sf_dir):
    return islands.group_points(A.grid_points(spark, sf_dir), 3)


def _points(spark, sf_dir):
    return _grouped(spark, sf_dir).withColumn("pid", F.row_number().over(Window.partitionBy("inline_number").orderBy("x", "z")) - 1)


@query("gap_grouping", f"WITH {A.GRID_POINTS_SQL}, {GROUPED_SQL} SELECT inline_number, x, z FROM grouped")
def gap_grouping(spark, sf_dir):
    return _grouped(spark, sf_dir)


NEAR_SQL = """
near AS (SELECT a.inline_number, a.pid, b.pid AS other FROM pts a JOIN pts b ON a.inline_number = b.inline_number AND (a.x - b.x) * (a.x - b.x) + (a.z - b.z) * (a.z - b.z) <= 9),
core AS (SELECT inline_number, pid, count(*) >= 3 AS core FROM near GROUP BY 1, 2)"""


@query("density_noise", f"""WITH {A.GRID_POINTS_SQL}, {GROUPED_SQL}, {NEAR_SQL}
  SELECT n.inline_number, n.pid, any_value(c.core) AS core, NOT bool_or(d.core) AS noise FROM near n JOIN core c ON c.inline_number = n.inline_number AND c.pid = n.pid JOIN core d ON d.inline_number = n.inline_number AND d.pid = n.other GROUP BY 1, 2""")
def density_noise(spark, sf_dir):
    return cluster.noise_mask(_points(spark, sf_dir), 3, 3)


@query("density_clusters")
def density_clusters(spark, sf_dir):
    return cluster.dbscan(_points(spark, sf_dir), 3, 3)


LABELLED_SQL = f"""{A.FAULT_POINTS_SQL},
labelled AS (SELECT sec AS inline_number, cluster AS label, x * 4 AS x, z * 10 AS z, row_number() OVER (PARTITION BY sec, cluster ORDER BY x, z) - 1 AS pid FROM fault_points)"""


def _labelled(spark, sf_dir):
    w = Window.partitionBy("sec", "cluster").orderBy("x", "z")
    return A.fault_points(spark, sf_dir).select(F.col("sec").alias("inline_number"), F.col("cluster").alias("label"), (F.col("x") * 4).alias("x"), (F.col("z") * 10).alias("z"), (F.row_number().over(w) - 1).alias("pid"))


@query("large_clusters", f"""WITH {LABELLED_SQL}, s AS (SELECT inline_number, label, count(*) AS n, max(z) - min(z) AS r, min(x) AS first FROM labelled GROUP BY 1, 2 HAVING count(*) >= 5 AND max(z) - min(z) > 30)
  SELECT inline_number, label, n, round(r, 6) AS range FROM s""")
def large_clusters(spark, sf_dir):
    rows = _labelled(spark, sf_dir)
    kept = cluster.large_clusters(rows.withColumn("old", F.col("label")).withColumn("pid", F.xxhash64("label", "pid")), 5, 30)
    return kept.groupBy("inline_number", F.col("old").alias("label")).agg(F.count("*").alias("n"), F.round(F.max("z") - F.min("z"), 6).alias("range"))


@query("cluster_geometry", f"WITH {LABELLED_SQL} SELECT inline_number, label, count(*) AS n, round(avg(x), 6) AS mx, round(avg(z), 6) AS mz, round(abs(cos(0.5 * atan2(2 * covar_pop(x, z), var_pop(x) - var_pop(z)))), 6) AS axis FROM labelled GROUP BY 1, 2")
def cluster_geometry(spark, sf_dir):
    return cluster.cluster_geometry(_labelled(spark, sf_dir)).select("inline_number", "label", "n", *_r("mx", "mz"), F.round(F.abs(F.cos("theta")), 6).alias("axis"))


@query("cluster_pairs", f"""WITH {LABELLED_SQL},
  g AS (SELECT inline_number, label, avg(x) AS mx, avg(z) AS mz, 0.5 * atan2(2 * covar_pop(x, z), var_pop(x) - var_pop(z)) AS t FROM labelled GROUP BY 1, 2),
  d AS (SELECT a.inline_number, a.label AS i, b.label AS j, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.z - b.z) * (a.z - b.z))) AS distance FROM labelled a JOIN labelled b ON a.inline_number = b.inline_number AND a.label < b.label GROUP BY 1, 2, 3),
  oij AS (SELECT d.inline_number, d.i, d.j, avg(abs(-sin(g.t) * (p.x - g.mx) + cos(g.t) * (p.z - g.mz))) AS o FROM d JOIN labelled p ON p.inline_number = d.inline_number AND p.label = d.i JOIN g ON g.inline_number = d.inline_number AND g.label = d.j GROUP BY 1, 2, 3),
  oji AS (SELECT d.inline_number, d.i, d.j, avg(abs(-sin(g.t) * (p.x - g.mx) + cos(g.t) * (p.z - g.mz))) AS o FROM d JOIN labelled p ON p.inline_number = d.inline_number AND p.label = d.j JOIN g ON g.inline_number = d.inline_number AND g.label = d.i GROUP BY 1, 2, 3)
  SELECT d.inline_number, d.i, d.j, round(abs(cos(gi.t - gj.t)), 6) AS cosine, round(distance, 6) AS distance, round(least(oij.o, oji.o), 6) AS extrapolation
  FROM d JOIN oij USING (inline_number, i, j) JOIN oji USING (inline_number, i, j) JOIN g gi ON gi.inline_number = d.inline_number AND gi.label = d.i JOIN g gj ON gj.inline_number = d.inline_number AND gj.label = d.j WHERE distance < 75""")
def cluster_pairs(spark, sf_dir):
    out = cluster.pair_metrics(_labelled(spark, sf_dir), max_distance=75)
    return out.select("inline_number", "i", "j", F.round(F.cos(F.radians("angle")), 6).alias("cosine"), *_r("distance", "extrapolation"))


ANGLE_SQL = """
bad_flags AS (
  SELECT *, sqrt(ax * ax + az * az) * sqrt(bx * bx + bz * bz) > 0 AND coalesce(degrees(acos(greatest(-1.0, least(1.0, (ax * bx + az * bz) / nullif(sqrt(ax * ax + az * az) * sqrt(bx * bx + bz * bz), 0))))) < 90, false) AS bad
  FROM (SELECT inline_number, label, pid, 'x' AS axis, lag(x) OVER w - x AS ax, lag(z) OVER w - z AS az, lead(x) OVER w - x AS bx, lead(z) OVER w - z AS bz FROM labelled WINDOW w AS (PARTITION BY inline_number, label ORDER BY x, pid)
        UNION ALL SELECT inline_number, label, pid, 'z', lag(x) OVER w - x, lag(z) OVER w - z, lead(x) OVER w - x, lead(z) OVER w - z FROM labelled WINDOW w AS (PARTITION BY inline_number, label ORDER BY z, pid)))"""


@query("sharp_points", f"WITH {LABELLED_SQL}, {ANGLE_SQL} SELECT inline_number, label, pid, coalesce(bool_or(bad), false) AS bad FROM bad_flags GROUP BY 1, 2, 3")
def sharp_points(spark, sf_dir):
    return curve.sharp_points(_labelled(spark, sf_dir)).select("inline_number", "label", "pid", "bad")


def _angle_rounds_sql(first: str, rounds: int, mark: str = "") -> str:
    """CTEs kept<mark>1, kept<mark>2, ...: each is the one before without its sharp points; clusters of fewer than three points keep theirs."""
    out, before = [], first
    for k in range(1, rounds + 1):
        arms = []
        for axis in ("x", "z"):
            arms.append(f"""SELECT inline_number, label, pid, lag(x) OVER w - x AS ax, lag(z) OVER w - z AS az, lead(x) OVER w - x AS bx, lead(z) OVER w - z AS bz
              FROM {before} WINDOW w AS (PARTITION BY inline_number, label ORDER BY {axis}, pid)""")
        out.append(f"""sharp{mark}{k} AS (SELECT DISTINCT inline_number, label, pid FROM ({' UNION ALL '.join(arms)}) WHERE sqrt(ax * ax + az * az) * sqrt(bx * bx + bz * bz) > 0
            AND degrees(acos(greatest(-1.0, least(1.0, (ax * bx + az * bz) / nullif(sqrt(ax * ax + az * az) * sqrt(bx * bx + bz * bz), 0))))) < 90),
          size{mark}{k} AS (SELECT inline_number, label, count(*) AS n FROM {before} GROUP BY 1, 2),
          kept{mark}{k} AS (SELECT p.* FROM {before} p JOIN size{mark}{k} USING (inline_number, label) WHERE n < 3 OR NOT EXISTS (SELECT 1 FROM sharp{mark}{k} s WHERE s.inline_number = p.inline_number AND s.label = p.label AND s.pid = p.pid))""")
        before = f"kept{mark}{k}"
    return ",\n".join(out)


@query("angle_filter", f"WITH {LABELLED_SQL}, {_angle_rounds_sql('labelled', 10)} SELECT inline_number, label, pid, round(x, 6) AS x, round(z, 6) AS z FROM kept10")
def angle_filter(spark, sf_dir):
    return curve.angle_filter(_labelled(spark, sf_dir)).select("inline_number", "label", "pid", *_r("x", "z"))


def _gradient_sql(value: str, name: str) -> str:
    """The derivative of value by s on uneven spacing, second order, one-sided at the ends."""
    h, k = "(s - s_1)", "(s1 - s)"
    inner = f"(-{k} / ({h} * ({h} + {k})) * {value}_1 + ({k} - {h}) / ({h} * {k}) * {value} + {h} / ({k} * ({h} + {k})) * {value}1)"
    a, b = "(s1 - s)", "(s2 - s1)"
    left = f"(-(2 * {a} + {b}) / ({a} * ({a} + {b})) * {value} + ({a} + {b}) / ({a} * {b}) * {value}1 - {a} / ({b} * ({a} + {b})) * {value}2)"
    c, d = "(s_1 - s_2)", "(s - s_1)"
    right = f"({d} / ({c} * ({c} + {d})) * {value}_2 - ({c} + {d}) / ({c} * {d}) * {value}_1 + (2 * {d} + {c}) / ({d} * ({c} + {d})) * {value})"
    return f"CASE WHEN s_1 IS NULL THEN {left} WHEN s1 IS NULL THEN {right} ELSE {inner} END AS {name}"


def _shifted(columns: list[str]) -> str:
    return ", ".join(f"lag({c}) OVER w AS {c}_1, lag({c}, 2) OVER w AS {c}_2, lead({c}) OVER w AS {c}1, lead({c}, 2) OVER w AS {c}2" for c in columns)


def _mean_sql(value: str, window: int, name: str) -> str:
    """The centred mean, end values repeated, over the window or the largest odd number of rows there are."""
    half = window // 2
    cases = " ".join(f"WHEN least({half}, (n - 1) // 2) = {h} THEN (sum({value}) OVER (PARTITION BY inline_number, label ORDER BY pos ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING) + greatest(0, {h} - pos) * first_value({value}) OVER whole + greatest(0, {h} - (n - 1 - pos)) * last_value({value}) OVER whole) / {2 * h + 1}" for h in range(1, half + 1))
    return f"CASE {cases} ELSE {value} END AS {name}"


def _curve_sql(source: str, k: str = "") -> str:
    """CTEs up to curved<k>: arc length along the principal axis, derivatives, curvature, moving means and anomalies of the source's clusters."""
    return f"""axes{k} AS (SELECT inline_number, label, avg(x) AS mx, avg(z) AS mz, 0.5 * atan2(2 * covar_pop(x, z), var_pop(x) - var_pop(z)) AS t FROM {source} GROUP BY 1, 2),
placed{k} AS (SELECT l.*, row_number() OVER (PARTITION BY inline_number, label ORDER BY round(cos(t) * (x - mx) + sin(t) * (z - mz), 9), pid) - 1 AS pos, count(*) OVER (PARTITION BY inline_number, label) AS n FROM {source} l JOIN axes{k} USING (inline_number, label)),
stepped{k} AS (SELECT *, CASE WHEN pos = 0 THEN 0.0 ELSE greatest(sqrt(power(x - lag(x) OVER w, 2) + power(z - lag(z) OVER w, 2)), 1e-6) END AS step FROM placed{k} WINDOW w AS (PARTITION BY inline_number, label ORDER BY pos)),
along{k} AS (SELECT *, sum(step) OVER (PARTITION BY inline_number, label ORDER BY pos) AS s FROM stepped{k}),
near1{k} AS (SELECT *, {_shifted(["s", "x", "z"])} FROM along{k} WINDOW w AS (PARTITION BY inline_number, label ORDER BY pos)),
d1{k} AS (SELECT inline_number, label, pid, pos, n, x, z, s, {_gradient_sql("x", "dx")}, {_gradient_sql("z", "dz")} FROM near1{k}),
near2{k} AS (SELECT *, {_shifted(["s", "dx", "dz"])} FROM d1{k} WINDOW w AS (PARTITION BY inline_number, label ORDER BY pos)),
d2{k} AS (SELECT *, {_gradient_sql("dx", "ddx")}, {_gradient_sql("dz", "ddz")} FROM near2{k}),
bent{k} AS (SELECT *, CASE WHEN n < 5 OR power(dx * dx + dz * dz, 1.5) <= 1e-12 THEN 0.0 ELSE abs(dx * ddz - dz * ddx) / power(dx * dx + dz * dz, 1.5) END AS kappa FROM d2{k}),
meant{k} AS (SELECT *, {_mean_sql("kappa", 7, "mean")}, {_mean_sql("x", 5, "sx")}, {_mean_sql("z", 5, "sz")} FROM bent{k} WINDOW whole AS (PARTITION BY inline_number, label ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
curved{k} AS (SELECT *, abs(kappa - mean) / (mean + 0.001) AS eta, n >= 5 AND pos >= 2 AND pos < n - 2 AND abs(kappa - mean) / (mean + 0.001) > 0.5 AS anomaly FROM meant{k})"""


CURVE_SQL = f"{LABELLED_SQL},\n{_curve_sql('labelled')}"


def _smoothed_sql(k: str = "") -> str:
    """CTE smoothed<k> of curved<k>: anomalous points moved by a hundredth towards their moving mean, at most 0.05."""
    return f"""pull{k} AS (SELECT *, 0.01 * (sx - x) AS ux, 0.01 * (sz - z) AS uz FROM curved{k}),
smoothed{k} AS (SELECT inline_number, label, pid, CASE WHEN anomaly THEN x + f * ux ELSE x END AS x, CASE WHEN anomaly THEN z + f * uz ELSE z END AS z, anomaly
  FROM (SELECT *, CASE WHEN sqrt(ux * ux + uz * uz) > 0.05 THEN 0.05 / sqrt(ux * ux + uz * uz) ELSE 1.0 END AS f FROM pull{k}))"""


@query("curvature", f"WITH {CURVE_SQL} SELECT inline_number, label, pid, CAST(pos AS INTEGER) AS pos, round(kappa, 4) AS kappa, round(eta, 3) AS eta, anomaly FROM curved")
def curvature(spark, sf_dir):
    return curve.curvature(_labelled(spark, sf_dir)).select("inline_number", "label", "pid", "pos", F.round("kappa", 4).alias("kappa"), F.round("eta", 3).alias("eta"), "anomaly")


@query("weak_smoothing", f"WITH {CURVE_SQL}, {_smoothed_sql()} SELECT inline_number, label, pid, round(x, 6) AS x, round(z, 6) AS z, anomaly FROM smoothed")
def weak_smoothing(spark, sf_dir):
    return curve.weak_smoothing(_labelled(spark, sf_dir)).select("inline_number", "label", "pid", *_r("x", "z"), "anomaly")


@query("merge_clusters")
def merge_clusters(spark, sf_dir):
    """Merging of density clusters until nothing changes; tested against a plain loop."""
    points = _points(spark, sf_dir)
    label = cluster.dbscan(points, 3, 3).where("label >= 0")
    return cluster.merge_clusters(points.join(label, ["inline_number", "pid"]), 17, 20, 4).select("inline_number", "pid", "label")


@query("interpolate_lines", f"""WITH {A.FAULT_POINTS_SQL}, k AS (SELECT sec, cluster, x * 3 AS x, min_by(z * 10, z) AS z FROM fault_points GROUP BY 1, 2, 3),
  s AS (SELECT *, lead(x) OVER w AS x2, lead(z) OVER w AS z2 FROM k WINDOW w AS (PARTITION BY sec, cluster ORDER BY x)),
  ends AS (SELECT sec, cluster, min(x) AS low, max(x) AS high FROM k GROUP BY 1, 2 HAVING min(x) < max(x)),
  wanted AS (SELECT sec, cluster, low, high, CAST(trunc(low + j) AS INTEGER) AS xi FROM (SELECT *, unnest(range(CAST(ceil(high + 1 - low) AS INTEGER))) AS j FROM ends)),
  e AS (SELECT w.sec, w.cluster, xi, x, z, x2, z2 FROM wanted w JOIN s ON s.sec = w.sec AND s.cluster = w.cluster AND x2 IS NOT NULL AND ((xi >= x OR x = low) AND (xi < x2 OR x2 = high)))
  SELECT sec AS inline_number, cluster AS label, CAST(xi AS INTEGER) AS x, CAST(round_even(z + (xi - x) * (z2 - z) / (x2 - x), 0) AS INTEGER) AS z FROM e""")
def interpolate_lines(spark, sf_dir):
    p = A.fault_points(spark, sf_dir).select(F.col("sec").alias("inline_number"), F.col("cluster").alias("label"), (F.col("x") * 3).alias("x"), (F.col("z") * 10).alias("z"), F.col("z").alias("pid"))
    return curve.interpolate_lines(p)


# Labels ------------------------------------------------------------------------------------------------------

SEGMENTS_SQL = f"""{A.PICKS_SQL},
in_box AS (SELECT DISTINCT inline_id, fault_id, x_idx, z_idx FROM picks WHERE x_idx >= 0 AND x_idx < {NX} AND z_idx >= 0 AND z_idx < {NZ}),
seg AS (SELECT inline_id, x_idx AS x0, z_idx AS z0, lead(x_idx) OVER w AS x1, lead(z_idx) OVER w AS z1, lag(x_idx) OVER w IS NULL AS first FROM in_box WINDOW w AS (PARTITION BY inline_id, fault_id ORDER BY x_idx, z_idx)),
seg2 AS (SELECT inline_id, x0, z0, coalesce(x1, x0) AS x1, coalesce(z1, z0) AS z1 FROM seg WHERE x1 IS NOT NULL OR first),
steps AS (SELECT *, abs(x1 - x0) AS dx, abs(z1 - z0) AS dz, unnest(range(greatest(abs(x1 - x0), abs(z1 - z0)) + 1)) AS k FROM seg2),
drawn AS (SELECT DISTINCT inline_id,
  x0 + (CASE WHEN x0 < x1 THEN 1 ELSE -1 END) * (CASE WHEN dx > dz THEN k ELSE CAST(greatest(0, floor((2.0 * k * dx + dz - 1) / greatest(2 * dz, 1))) AS INTEGER) END) AS x,
  z0 + (CASE WHEN z0 < z1 THEN 1 ELSE -1 END) * (CASE WHEN dx > dz THEN CAST(greatest(0, floor((2.0 * k * dz + dx - 1) / greatest(2 * dx, 1))) AS INTEGER) ELSE k END) AS z FROM steps)"""
MAP_SQL = f"""{SEGMENTS_SQL},
offs AS (SELECT i, j FROM range(-3, 4) a(i), range(-2, 3) b(j) WHERE power(i / 3.0, 2) + power(j / 2.0, 2) <= 1.0),
wide AS (SELECT DISTINCT inline_id, x + i AS x, z + j AS z FROM drawn, offs WHERE x + i >= 0 AND x + i < {NX} AND z + j >= 0 AND z + j < {NZ}),
label_map AS (SELECT inline_id, CAST(x // 2 AS INTEGER) AS x, CAST(z // 2 AS INTEGER) AS z FROM wide WHERE x % 2 = 0 AND z % 2 = 0)"""
PATCH_SQL = f"""{MAP_SQL},
patch AS (SELECT inline_id, x0, z0, count(*) AS label_pixels FROM label_map JOIN (SELECT i * {STRIDE} AS x0 FROM range({(NX // 2 - PATCH) // STRIDE + 1}) t(i)) a ON x >= x0 AND x < x0 + {PATCH}
  JOIN (SELECT i * {STRIDE} AS z0 FROM range({(NZ // 2 - PATCH) // STRIDE + 1}) t(i)) b ON z >= z0 AND z < z0 + {PATCH} GROUP BY 1, 2, 3 HAVING count(*) >= 4)"""


@query("fault_raster", f"WITH {SEGMENTS_SQL} SELECT inline_id, CAST(x AS INTEGER) AS x, CAST(z AS INTEGER) AS z FROM drawn")
def fault_raster(spark, sf_dir):
    p = labels.inside(A.picks(spark, sf_dir), NX, NZ, "x_idx", "z_idx")
    return labels.raster(labels.polyline_segments(p, ["inline_id", "fault_id"]), ["inline_id"])


def _label_map(spark, sf_dir):
    return labels.label_map(A.picks(spark, sf_dir), NX, NZ, ["inline_id"], "fault_id", 3, 2, 2, 2)


@query("label_map", f"WITH {MAP_SQL} SELECT inline_id, x, z FROM label_map")
def label_map(spark, sf_dir):
    return _label_map(spark, sf_dir)


def _patches(spark, sf_dir):
    return labels.patches(_label_map(spark, sf_dir), NX // 2, NZ // 2, PATCH, STRIDE, ["inline_id"], 4)


@query("label_patches", f"WITH {PATCH_SQL} SELECT inline_id, CAST(x0 AS INTEGER) AS x0, CAST(z0 AS INTEGER) AS z0, label_pixels FROM patch")
def label_patches(spark, sf_dir):
    return _patches(spark, sf_dir)


SPLIT = LabelConfig(patch_size=PATCH, stride=STRIDE, strategy="spatial")


def _records(spark, sf_dir):
    none = F.lit(None).cast("string")
    return _patches(spark, sf_dir).withColumns({"source_id": none, "source_segy_sha256": none, "requested_split": none, "section_index": F.lit(0), "source_nx": F.lit(NX // 2), "source_nz": F.lit(NZ // 2)})


def _spatial_sql(axis: str, side: int) -> str:
    return f"""{PATCH_SQL},
legal AS (SELECT i * {STRIDE} AS o FROM range(0, {side - PATCH} // {STRIDE} + 1) t(i)),
boundary AS (SELECT o AS boundary FROM (SELECT o, row_number() OVER (ORDER BY o DESC) AS nth, count(*) OVER () AS n FROM legal) WHERE nth = greatest(1, ceil(n * 0.2))),
split AS (SELECT p.*, boundary, CASE WHEN {axis}0 >= boundary THEN 'val' WHEN {axis}0 + {PATCH} <= boundary - {PATCH} THEN 'train' END AS split FROM patch p, boundary)"""


@query("spatial_split", f"WITH {_spatial_sql('x', NX // 2)} SELECT inline_id, CAST(x0 AS INTEGER) AS x0, CAST(z0 AS INTEGER) AS z0, split FROM split")
def spatial_split(spark, sf_dir):
    return splits.spatial_split(_records(spark, sf_dir), SPLIT).select("inline_id", "x0", "z0", "split")


@query("spatial_boundaries", f"""WITH {_spatial_sql('z', NZ // 2)} SELECT 'inline_' || inline_id || '_section_0' AS physical_source, CAST({NZ // 2} AS INTEGER) AS source_length, CAST(any_value(boundary) AS INTEGER) AS boundary, 'z' AS axis,
  CAST(any_value(boundary) - {PATCH} AS INTEGER) AS train_limit, count(*) FILTER (split = 'train') AS train_pool, count(*) FILTER (split = 'val') AS val_pool, count(*) FILTER (split IS NULL) AS discarded FROM split GROUP BY inline_id""")
def spatial_boundaries(spark, sf_dir):
    config = LabelConfig(patch_size=PATCH, stride=STRIDE, strategy="spatial", axis="z")
    return splits.boundaries(splits.spatial_split(splits.with_sources(_records(spark, sf_dir)), config), config).drop("source_key")


INLINE_SQL = f"""{PATCH_SQL}, i AS (SELECT DISTINCT inline_id FROM patch),
  v AS (SELECT inline_id FROM (SELECT inline_id, row_number() OVER (ORDER BY md5('2026:' || inline_id), inline_id) AS nth, count(*) OVER () AS n FROM i) WHERE nth <= greatest(1, least(n - 1, round_even(n * (40.0 / 240.0), 0)))),
  assigned AS (SELECT p.*, CASE WHEN inline_id IN (SELECT inline_id FROM v) THEN 'val' ELSE 'train' END AS split FROM patch p)"""


@query("inline_split", f"WITH {INLINE_SQL} SELECT inline_id, CAST(x0 AS INTEGER) AS x0, CAST(z0 AS INTEGER) AS z0, split FROM assigned")
def inline_split(spark, sf_dir):
    p = _patches(spark, sf_dir)
    return splits.inline_split(p, splits.choose_val_inlines(p)).select("inline_id", "x0", "z0", "split")


@query("split_summary", f"""WITH {INLINE_SQL}, c AS (SELECT count(*) FILTER (split = 'train') AS t, count(*) FILTER (split = 'val') AS v FROM assigned)
  SELECT 'inline' AS requested_strategy, 'inline' AS resolved_strategy, 'seeded inlines' AS assignment, t AS train_pool, v AS val_pool, CAST(0 AS BIGINT) AS discarded, least(t, 200) AS train, least(v, 40) AS val FROM c""")
def split_summary(spark, sf_dir):
    out = splits.split_records(_records(spark, sf_dir), LabelConfig(patch_size=PATCH, stride=STRIDE))
    return out["summary"].drop("fallback_reason", "seed")


@query("split_train", f"""WITH {INLINE_SQL}, s AS (SELECT 'inline_' || inline_id || printf('_section_0_x%06d_z%06d_p{PATCH}', x0, z0) AS sample_id FROM assigned WHERE split = 'train')
  SELECT sample_id, CAST(nth AS INTEGER) AS nth FROM (SELECT *, row_number() OVER (ORDER BY md5('2027:' || sample_id), sample_id) AS nth FROM s) WHERE nth <= 200""")
def split_train(spark, sf_dir):
    return splits.split_records(_records(spark, sf_dir), LabelConfig(patch_size=PATCH, stride=STRIDE))["train"].select("sample_id", "nth")


@query("single_inline_split", f"""WITH {_spatial_sql('x', NX // 2)}, one AS (SELECT * FROM split WHERE inline_id = (SELECT min(inline_id) FROM patch))
  SELECT CAST(x0 AS INTEGER) AS x0, CAST(z0 AS INTEGER) AS z0, split FROM one""")
def single_inline_split(spark, sf_dir):
    """One inline alone falls back to the spatial split."""
    rows = cut_lineage(_records(spark, sf_dir))
    one = rows.join(F.broadcast(rows.agg(F.min("inline_id").alias("inline_id"))), "inline_id")  # one row
    return splits.assign(one, LabelConfig(patch_size=PATCH, stride=STRIDE))[0].select("x0", "z0", "split")


@query("split_problems", """WITH r AS (SELECT 'inline_' || c_nationkey || '_section_0' AS src, c_nationkey AS inline_id, CAST(c_custkey % 8 * 16 AS INTEGER) AS x0, CAST(c_custkey % 16 AS INTEGER) AS z0 FROM customer),
  d AS (SELECT 'patch ' || src || ' ' || x0 || ' ' || z0 || ' occurs twice' AS problem FROM r GROUP BY src, x0, z0 HAVING count(*) > 1)
  SELECT problem FROM d UNION ALL SELECT DISTINCT 'source ' || src || ' has origins off the grid' FROM r WHERE z0 % 16 <> 0 OR z0 + 32 > 128""")
def split_problems(spark, sf_dir):
    none = F.lit(None).cast("string")
    r = A.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("inline_id"), (F.col("c_custkey") % 8 * 16).cast("int").alias("x0"), (F.col("c_custkey") % 16).cast("int").alias("z0"))
    r = splits.with_sources(r.withColumns({"source_id": none, "source_segy_sha256": none, "section_index": F.lit(0), "source_nx": F.lit(NX // 2), "source_nz": F.lit(NZ // 2)}))
    return splits.record_problems(r).unionAll(splits.spatial_problems(r, LabelConfig(patch_size=PATCH, stride=STRIDE, strategy="spatial", axis="z")))


@query("declared_split_problems", """WITH r AS (SELECT c_nationkey AS inline_id, 'inline_' || c_nationkey || '_section_0' AS src, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_nationkey < 5 AND c_custkey % 2 = 0 THEN 'VAL' ELSE 'train' END AS s FROM customer),
  b AS (SELECT inline_id, src FROM r WHERE s IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT lower(s)) > 1)
  SELECT 'splits are declared for some lines only' AS problem UNION ALL SELECT 'inline_id ' || inline_id || ' is on both sides' FROM b UNION ALL SELECT 'physical_source ' || src || ' is on both sides' FROM b""")
def declared_split_problems(spark, sf_dir):
    none, n = F.lit(None).cast("string"), F.col("c_custkey")
    side = F.when(n % 7 == 0, None).when((F.col("c_nationkey") < 5) & (n % 2 == 0), "VAL").otherwise("train")
    r = A.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("inline_id"), side.alias("requested_split"), none.alias("source_id"), none.alias("source_segy_sha256"), F.lit(0).alias("section_index"))
    return splits.explicit_problems(splits.with_sources(r))


@query("split_overlaps", f"""WITH {PATCH_SQL}, t AS (SELECT * FROM patch WHERE x0 % 32 = 0), v AS (SELECT * FROM patch WHERE x0 % 32 <> 0)
  SELECT t.inline_id, CAST(t.x0 AS INTEGER) AS ax, CAST(t.z0 AS INTEGER) AS az, CAST(v.x0 AS INTEGER) AS bx, CAST(v.z0 AS INTEGER) AS bz FROM t JOIN v ON t.inline_id = v.inline_id AND abs(t.x0 - v.x0) < {PATCH} AND abs(t.z0 - v.z0) < {PATCH}""")
def split_overlaps(spark, sf_dir):
    p = _patches(spark, sf_dir)
    return labels.overlapping_pairs(p.where("x0 % 32 = 0"), p.where("x0 % 32 <> 0"), PATCH, "inline_id")


@query("shuffle_and_cap", f"""WITH {PATCH_SQL}, s AS (SELECT printf('line_%d_x%06d_z%06d_p{PATCH}', inline_id, x0, z0) AS sample_id, label_pixels FROM patch)
  SELECT sample_id, label_pixels, CAST(nth AS INTEGER) AS nth FROM (SELECT *, row_number() OVER (ORDER BY md5('2027:' || sample_id), sample_id) AS nth FROM s) WHERE nth <= 200""")
def shuffle_and_cap(spark, sf_dir):
    p = _patches(spark, sf_dir).select(labels.sample_id(F.format_string("line_%d", "inline_id"), F.col("x0"), F.col("z0"), PATCH).alias("sample_id"), "label_pixels")
    return labels.shuffle_and_cap(p, 200, 2027, "sample_id")


@query("duplicate_patches", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def duplicate_patches(spark, sf_dir):
    return labels.duplicates(A.table(spark, sf_dir, "orders"), ["o_custkey"])


@query("flipped_patches", """WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k FROM orders), s AS (SELECT o_custkey, k, o_totalprice FROM r WHERE k < 4 AND o_custkey IN (SELECT o_custkey FROM r WHERE k = 3))
  SELECT o_custkey, CAST((1 - k // 2) * 2 + k % 2 AS INTEGER) AS k, round(o_totalprice, 2) AS v FROM s""")
def flipped_patches(spark, sf_dir):
    """Patches of side 2 from each customer's first four orders."""
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    first = A.table(spark, sf_dir, "orders").withColumn("k", nth).where("k <= 4")
    patch = first.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "o_totalprice"))), lambda x: x["o_totalprice"]).alias("v")).where("size(v) = 4")
    return patch.select("o_custkey", F.posexplode(labels.flip_x(F.col("v"), 2)).alias("k", "v")).select("o_custkey", "k", F.round("v", 2).alias("v"))


@query("class_weights", "SELECT round(CAST(count(*) FILTER (quality <= 0.5) AS DOUBLE) / count(*), 6) AS w_pos, round(CAST(count(*) FILTER (quality > 0.5) AS DOUBLE) / count(*), 6) AS w_neg FROM labels")
def class_weights(spark, sf_dir):
    return labels.class_weights(A.table(spark, sf_dir, "labels"), "quality").select(*_r("w_pos", "w_neg"))


@query("stem_pairs", "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.doc_id IS NOT NULL AS in_left, l.doc_id IS NOT NULL AS in_right FROM (SELECT DISTINCT doc_id FROM documents) d FULL OUTER JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def stem_pairs(spark, sf_dir):
    return labels.stem_pairs(A.table(spark, sf_dir, "documents"), A.table(spark, sf_dir, "labels"), "doc_id")


@query("training_loss", """WITH r AS (SELECT l_orderkey % 50 AS s, (l_quantity - 25) / 10 AS z, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS t FROM lineitem),
  e AS (SELECT s, sum(0.7 * t * (greatest(-z, 0.0) + ln(1 + exp(-abs(z)))) + 0.3 * (1 - t) * (greatest(z, 0.0) + ln(1 + exp(-abs(z))))) AS ce, count(*) AS n, sum(t / (1 + exp(-z))) AS b, sum(1 / (1 + exp(-z))) + sum(t) AS a FROM r GROUP BY s)
  SELECT round(sum(ce) / sum(n), 6) AS wbce, round(avg(1 - (2 * b + 1e-7) / (a + 1e-7)), 6) AS dice, round(0.9 * sum(ce) / sum(n) + 0.1 * avg(1 - (2 * b + 1e-7) / (a + 1e-7)), 6) AS loss FROM e""")
def training_loss(spark, sf_dir):
    r = A.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("s"), ((F.col("l_quantity") - 25) / 10).alias("z"), F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("t"))
    return labels.losses(r, "s", "z", "t", 0.7, 0.3).select(*_r("wbce", "dice", "loss"))


# Normalisation, catalogue, keys ------------------------------------------------------------------------------

@query("minmax_by_section", f"WITH {A.PIXELS_SQL} SELECT inline_number, x, z, round((p - min(p) OVER w) / (max(p) OVER w - min(p) OVER w + 1e-8), 6) AS v FROM pixels WINDOW w AS (PARTITION BY inline_number)")
def minmax_by_section(spark, sf_dir):
    return normalise.minmax(A.pixels(spark, sf_dir), ["inline_number"], "p", "v", 1e-8).select("inline_number", "x", "z", *_r("v"))


@query("minmax_strict", f"WITH {A.PIXELS_SQL} SELECT inline_number, x, z, round((p - min(p) OVER w) / (max(p) OVER w - min(p) OVER w), 6) AS v FROM pixels WINDOW w AS (PARTITION BY inline_number)")
def minmax_strict(spark, sf_dir):
    """No epsilon: a section of one value is an error."""
    return normalise.minmax(A.pixels(spark, sf_dir), ["inline_number"], "p", "v").select("inline_number", "x", "z", *_r("v"))


@query("zscore_by_section", f"WITH {A.PIXELS_SQL} SELECT inline_number, x, z, round((p - avg(p) OVER w) / (stddev_pop(p) OVER w + 1e-8), 6) AS v FROM pixels WINDOW w AS (PARTITION BY inline_number)")
def zscore_by_section(spark, sf_dir):
    return normalise.zscore(A.pixels(spark, sf_dir), ["inline_number"], "p", "v", 1e-8).select("inline_number", "x", "z", *_r("v"))


@query("minmax_then_zscore", f"WITH {A.PIXELS_SQL}, m AS (SELECT inline_number, x, z, (p - min(p) OVER w) / (max(p) OVER w - min(p) OVER w) AS m FROM pixels WINDOW w AS (PARTITION BY inline_number)) SELECT inline_number, x, z, round((m - avg(m) OVER w) / stddev_pop(m) OVER w, 6) AS v FROM m WINDOW w AS (PARTITION BY inline_number)")
def minmax_then_zscore(spark, sf_dir):
    return normalise.minmax_then_zscore(A.pixels(spark, sf_dir), ["inline_number"], "p", "v").select("inline_number", "x", "z", *_r("v"))


@query("robust_limit", f"WITH {A.PIXELS_SQL} SELECT inline_number, round(CASE WHEN quantile_cont(CAST(abs(p) AS DOUBLE), 0.99) = 0 THEN 1.0 ELSE quantile_cont(CAST(abs(p) AS DOUBLE), 0.99) END, 6) AS lim FROM pixels GROUP BY 1")
def robust_limit(spark, sf_dir):
    return normalise.robust_limit(A.pixels(spark, sf_dir), ["inline_number"], "p", 0.99, "lim").select("inline_number", *_r("lim"))


@query("axis_steps", """WITH a AS (SELECT p_size AS k, p_partkey AS idx, p_retailprice AS value FROM part), d AS (SELECT *, value - lag(value) OVER (PARTITION BY k ORDER BY idx) AS d FROM a)
  SELECT k, count(*) AS n, round(min_by(value, idx), 6) AS first, round(max_by(value, idx), 6) AS last, coalesce(max(d) - min(d) <= 1e-9, false) AS regular, CASE WHEN max(d) - min(d) <= 1e-9 THEN round(min(d), 6) END AS step, coalesce(min(d) > 0, true) AS increasing FROM d GROUP BY k""")
def axis_steps(spark, sf_dir):
    a = A.table(spark, sf_dir, "part").select(F.col("p_size").alias("k"), F.col("p_partkey").alias("idx"), F.col("p_retailprice").alias("value"))
    return catalogue.axis_steps(a, ["k"]).select("k", "n", *_r("first", "last"), "regular", F.round("step", 6).alias("step"), "increasing")


@query("index_to_value", """WITH a AS (SELECT row_number() OVER (ORDER BY p_size) - 1 AS idx, CAST(p_size AS DOUBLE) * 10 AS value FROM (SELECT DISTINCT p_size FROM part)), b AS (SELECT idx, value, lead(value) OVER (ORDER BY idx) AS nxt FROM a)
  SELECT l_orderkey, l_linenumber, round(CASE WHEN v = floor(v) THEN value ELSE value + (v - floor(v)) * (nxt - value) END, 6) AS axis_value FROM (SELECT *, l_quantity / 4 AS v FROM lineitem) l LEFT JOIN b ON b.idx = floor(v)""")
def index_to_value(spark, sf_dir):
    axis = A.table(spark, sf_dir, "part").select("p_size").distinct().select((F.row_number().over(Window.orderBy("p_size")) - 1).alias("idx"), (F.col("p_size").cast("double") * 10).alias("value"))
    rows = A.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 4).alias("v"))
    return catalogue.index_to_value(rows, axis, "v", "axis_value").select("l_orderkey", "l_linenumber", *_r("axis_value"))


@query("value_to_index", """WITH a AS (SELECT 1 AS k, row_number() OVER (ORDER BY p_size) - 1 AS idx, CAST(p_size AS DOUBLE) AS v FROM (SELECT DISTINCT p_size FROM part)), b AS (SELECT k, idx, v, lead(v) OVER (ORDER BY v) AS w, lead(v, 2) OVER (ORDER BY v) IS NULL AS last FROM a)
  SELECT o_orderkey, round(idx + (y - v) / (w - v), 6) AS at FROM (SELECT o_orderkey, o_totalprice / 5000 AS y FROM orders) o JOIN b ON y >= v AND (y < w OR (last AND y = w))""")
def value_to_index(spark, sf_dir):
    axis = A.table(spark, sf_dir, "part").select("p_size").distinct().select(F.lit(1).alias("k"), (F.row_number().over(Window.orderBy("p_size")) - 1).alias("idx"), F.col("p_size").cast("double").alias("value"))
    rows = A.table(spark, sf_dir, "orders").select(F.lit(1).alias("k"), "o_orderkey", (F.col("o_totalprice") / 5000).alias("y"))
    return catalogue.value_to_index(rows, axis, "y", "at", ["k"]).select("o_orderkey", *_r("at"))


@query("surface_faces", """WITH g AS (SELECT c_custkey AS s, c_custkey % 3 + 2 AS r, c_custkey % 4 + 2 AS c FROM customer), u AS (SELECT s, c, unnest(range(r - 1)) AS i FROM g), v AS (SELECT s, c, i, unnest(range(c - 1)) AS j FROM u)
  SELECT s, CAST(i * c + j AS INTEGER) AS a, CAST(i * c + j + c AS INTEGER) AS b, CAST(i * c + j + 1 AS INTEGER) AS c FROM v UNION ALL SELECT s, CAST(i * c + j + 1 AS INTEGER), CAST(i * c + j + c AS INTEGER), CAST(i * c + j + c + 1 AS INTEGER) FROM v""")
def surface_faces(spark, sf_dir):
    return catalogue.structured_faces(_shapes(spark, sf_dir), ["s"])


def _shapes(spark, sf_dir, *more):
    return A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("s"), (F.col("c_custkey") % 3 + 2).cast("int").alias("rows"), (F.col("c_custkey") % 4 + 2).cast("int").alias("columns"), *more)


#: Grids of one surface a customer, whose vertices' depths come from the customer's balance; every seventh vertex has no data.
GRID_SQL = """
grids AS (SELECT c_custkey AS s, CAST(c_custkey % 3 + 2 AS INTEGER) AS r, CAST(c_custkey % 4 + 2 AS INTEGER) AS c, c_acctbal AS base FROM customer),
cells AS (SELECT s, r, c, base, i AS row, unnest(range(c)) AS col FROM (SELECT *, unnest(range(r)) AS i FROM grids)),
verts AS (SELECT s, r, c, row, col, row * c + col AS v, CASE WHEN (s + row * c + col) % 7 = 0 THEN NULL ELSE base + row * 10 + col END AS z FROM cells)"""


def _vertices(spark, sf_dir):
    g = _shapes(spark, sf_dir, F.col("c_acctbal").alias("base"))
    g = g.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("columns") - 1)))
    at = F.col("row") * F.col("columns") + F.col("col")
    return g.select("s", "row", "col", at.alias("vertex"), F.when((F.col("s") + at) % 7 == 0, float("nan")).otherwise(F.col("base") + F.col("row") * 10 + F.col("col")).alias("z"))


@query("finite_faces", f"""WITH {GRID_SQL}, f AS (SELECT s, v AS a, v + c AS b, v + 1 AS d FROM verts WHERE row < r - 1 AND col < c - 1 UNION ALL SELECT s, v + 1, v + c, v + c + 1 FROM verts WHERE row < r - 1 AND col < c - 1)
  SELECT f.s, CAST(f.a AS INTEGER) AS a, CAST(f.b AS INTEGER) AS b, CAST(f.d AS INTEGER) AS c FROM f JOIN verts x ON x.s = f.s AND x.v = f.a AND x.z IS NOT NULL JOIN verts y ON y.s = f.s AND y.v = f.b AND y.z IS NOT NULL JOIN verts w ON w.s = f.s AND w.v = f.d AND w.z IS NOT NULL""")
def finite_faces(spark, sf_dir):
    return catalogue.finite_faces(catalogue.structured_faces(_shapes(spark, sf_dir), ["s"]), _vertices(spark, sf_dir), ["s"])


@query("surface_boundary", f"""WITH {GRID_SQL}, o AS (SELECT s, row, col, 0 AS side, col AS k FROM verts WHERE row = 0 UNION ALL SELECT s, row, col, 1, row FROM verts WHERE col = c - 1 AND row > 0
    UNION ALL SELECT s, row, col, 2, -col FROM verts WHERE row = r - 1 AND col < c - 1 UNION ALL SELECT s, row, col, 3, -row FROM verts WHERE col = 0 AND row > 0 AND row < r - 1)
  SELECT s, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, CAST(row_number() OVER (PARTITION BY s ORDER BY side, k) - 1 AS INTEGER) AS boundary_order FROM o""")
def surface_boundary(spark, sf_dir):
    return catalogue.boundary(_vertices(spark, sf_dir), _shapes(spark, sf_dir), "s").select("s", "row", "col", "boundary_order")


@query("decimated_vertices", f"""WITH {GRID_SQL} SELECT s, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col FROM verts
  WHERE (row % 2 = 0 OR row = r - 1 OR r <= 2) AND (col % 2 = 0 OR col = c - 1 OR c <= 2)""")
def decimated_vertices(spark, sf_dir):
    return catalogue.decimate(_vertices(spark, sf_dir), _shapes(spark, sf_dir), 2, "s").select("s", "row", "col")


@query("surface_catalogue", f"""WITH {GRID_SQL}, f AS (SELECT s, v AS a, v + c AS b, v + 1 AS d FROM verts WHERE row < r - 1 AND col < c - 1 UNION ALL SELECT s, v + 1, v + c, v + c + 1 FROM verts WHERE row < r - 1 AND col < c - 1),
  t AS (SELECT f.s, count(*) AS n FROM f JOIN verts x ON x.s = f.s AND x.v = f.a AND x.z IS NOT NULL JOIN verts y ON y.s = f.s AND y.v = f.b AND y.z IS NOT NULL JOIN verts w ON w.s = f.s AND w.v = f.d AND w.z IS NOT NULL GROUP BY 1)
  SELECT s AS surface_id, any_value(r) AS rows, any_value(c) AS columns, count(*) AS vertices, count(z) AS valid_vertices, count(*) - count(z) AS no_data_vertices, coalesce(any_value(n), 0) AS triangles, round(min(z), 6) AS sample_min, round(max(z), 6) AS sample_max
  FROM verts LEFT JOIN t USING (s) GROUP BY s""")
def surface_catalogue(spark, sf_dir):
    v = _vertices(spark, sf_dir).select(F.col("s").alias("surface_id"), "row", "col", F.col("z").alias("sample"))
    return surface_files.inventory_table(v, "parquet").select("surface_id", "rows", "columns", "vertices", "valid_vertices", "no_data_vertices", "triangles", *_r("sample_min", "sample_max"))


@query("grid_problems", f"""WITH {GRID_SQL} SELECT s, 'z is not finite' AS problem FROM verts GROUP BY s HAVING count(*) > count(z)""")
def grid_problems(spark, sf_dir):
    return catalogue.grid_problems(_vertices(spark, sf_dir), _shapes(spark, sf_dir), ["z"], [], "s")


@query("surface_inventory", """SELECT c_nationkey AS surface_id, count(*) AS vertices, count(*) FILTER (z IS NULL) AS z_missing, round(min(z), 6) AS z_min, round(max(z), 6) AS z_max
  FROM (SELECT c_nationkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS z FROM customer) GROUP BY 1""")
def surface_inventory(spark, sf_dir):
    v = A.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("surface_id"), F.when(F.col("c_acctbal") < 0, float("nan")).otherwise(F.col("c_acctbal")).alias("z"))
    return catalogue.inventory(v, "surface_id", ["z"]).select("surface_id", "vertices", "z_missing", *_r("z_min", "z_max"))


@query("inline_intersections", """WITH v AS (SELECT c_nationkey AS surface_id, CAST(c_custkey % 5 AS DOUBLE) AS ii, CAST(c_custkey AS DOUBLE) AS p, c_acctbal AS z FROM customer),
  o AS (SELECT surface_id, ii AS slice, p, z, row_number() OVER (PARTITION BY surface_id, ii ORDER BY p, z) - 1 AS point_order FROM v WHERE ii IN (1, 3))
  SELECT surface_id, slice, CAST(point_order AS INTEGER) AS point_order, p AS profile, round(z, 6) AS z FROM o WHERE z >= 0""")
def inline_intersections(spark, sf_dir):
    v = A.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("surface_id"), (F.col("c_custkey") % 5).cast("double").alias("inline_index"), F.col("c_custkey").cast("double").alias("profile"), F.col("c_acctbal").alias("zz"))
    v = v.withColumn("z", F.when(F.col("zz") < 0, float("nan")).otherwise(F.col("zz")))
    return catalogue.intersections(v, [1.0, 3.0]).select("surface_id", "slice", "point_order", "profile", *_r("z"))


@query("text_checksums", "SELECT doc_id, sha256(text) AS sha256, CAST(strlen(text) AS INTEGER) AS size FROM documents")
def text_checksums(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").alias("size"))


@query("section_keys", """SELECT o_orderkey, CASE WHEN o_custkey >= 30 AND (o_custkey - 30) % 3 = 0 THEN 'line_' || ((o_custkey - 30) // 3) END AS line_key,
  CASE WHEN o_custkey >= 30 AND (o_custkey - 30) % 3 = 0 THEN CAST(o_custkey AS INTEGER) END AS inline_number FROM orders""")
def section_keys(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders").select("o_orderkey", scalars.inline_to_line_key(F.col("o_custkey"), 30, 3).alias("line_key"))
    return o.withColumn("inline_number", scalars.line_key_to_inline(F.col("line_key"), 30, 3))


@query("inline_selection", """WITH w AS (SELECT unnest(range(1, (SELECT max(c_custkey) FROM customer) + 1, 4)) AS inline_number), a AS (SELECT DISTINCT c_custkey AS inline_number FROM customer WHERE c_mktsegment = 'BUILDING')
  SELECT CAST(w.inline_number AS BIGINT) AS inline_number, a.inline_number IS NOT NULL AS available FROM w LEFT JOIN a USING (inline_number)""")
def inline_selection(spark, sf_dir):
    customer = A.table(spark, sf_dir, "customer")
    there = customer.where(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("inline_number"))
    return contracts.missing_inlines(there, 1, customer.agg(F.max("c_custkey")).first()[0], 4)


@query("selected_inlines", """SELECT c_custkey AS inline_number FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey >= 10 AND c_custkey <= 10 + ((SELECT max(c_custkey) FROM customer) - 10) // 5 * 5 AND c_custkey % 5 = 0""")
def selected_inlines(spark, sf_dir):
    customer = A.table(spark, sf_dir, "customer")
    there = customer.where(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("inline_number"))
    last = customer.agg(F.max("c_custkey")).first()[0]
    return contracts.select_inlines(there, 5, 10, 10 + (last - 10) // 5 * 5, 5, allow_missing=True)


@query("natural_keys", """SELECT c_custkey, array_to_string(list_transform(regexp_extract_all(lower(c_name || ' v' || c_nationkey || '.' || c_custkey % 11), '[0-9]+|[^0-9]+'), lambda p: CASE WHEN regexp_matches(p, '^[0-9]') THEN lpad(p, 20, '0') ELSE p END), '') AS k FROM customer""")
def natural_keys(spark, sf_dir):
    name = F.concat("c_name", F.lit(" v"), F.col("c_nationkey").cast("string"), F.lit("."), (F.col("c_custkey") % 11).cast("string"))
    return A.table(spark, sf_dir, "customer").select("c_custkey", scalars.natural_key(name).alias("k"))


@query("source_keys", """WITH r AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'src_' || doc_id END AS source_id, CASE WHEN doc_id % 2 = 0 THEN sha256(text) END AS sha, CAST(doc_id % 5 AS INTEGER) AS sec FROM documents),
  k AS (SELECT *, coalesce(source_id, 'inline_' || doc_id || '_section_' || sec) AS source_key FROM r)
  SELECT doc_id, source_key, coalesce('sha256:' || sha || ':section:' || sec, source_key) AS physical_source FROM k""")
def source_keys(spark, sf_dir):
    n = F.col("doc_id")
    r = A.table(spark, sf_dir, "documents").select(n, F.when(n % 3 != 0, F.concat(F.lit("src_"), n.cast("string"))).alias("source_id"), F.when(n % 2 == 0, F.sha2("text", 256)).alias("source_segy_sha256"), n.cast("int").alias("inline_id"), (n % 5).cast("int").alias("section_index"))
    return splits.with_sources(r).select("doc_id", "source_key", "physical_source")


TILE, OVERLAP = 16, 4
#: Sections from the pixels: one trace a column of the bounding box.
TILES_SQL = f"""{DENSE_SQL},
section AS (SELECT inline_number, CAST(x - min(x) OVER (PARTITION BY inline_number) AS INTEGER) AS x, CAST(z - min(z) OVER (PARTITION BY inline_number) AS INTEGER) AS z, CAST((CAST(p AS FLOAT) - min(CAST(p AS FLOAT)) OVER (PARTITION BY inline_number)) / (max(CAST(p AS FLOAT)) OVER (PARTITION BY inline_number) - min(CAST(p AS FLOAT)) OVER (PARTITION BY inline_number)) AS FLOAT) AS v FROM dense),
size AS (SELECT inline_number, max(x) + 1 AS nx, max(z) + 1 AS nz FROM section GROUP BY 1),
tile AS (SELECT inline_number, nx, nz, i * {TILE - OVERLAP} AS tx, j * {TILE - OVERLAP} AS tz FROM (SELECT *, unnest(range(CAST(round_even((nz + {OVERLAP}) / {TILE - OVERLAP} + 0.5, 0) AS INTEGER))) AS j FROM (SELECT *, unnest(range(CAST(round_even((nx + {OVERLAP}) / {TILE - OVERLAP} + 0.5, 0) AS INTEGER))) AS i FROM size)) WHERE i * {TILE - OVERLAP} < nx AND j * {TILE - OVERLAP} < nz),
held AS (SELECT t.inline_number, tx, tz, nx, nz, a.r, b.c, coalesce(v, 0.0) AS v FROM tile t, (SELECT i AS r FROM range({TILE}) u(i)) a, (SELECT i AS c FROM range({TILE}) u(i)) b LEFT JOIN section s ON s.inline_number = t.inline_number AND s.x = tx + a.r AND s.z = tz + b.c),
stats AS (SELECT inline_number, tx, tz, avg(v) AS m, stddev_pop(v) AS d FROM held GROUP BY 1, 2, 3)"""


def _tile_traces(spark, sf_dir):
    dense = grid.dense_grid(A.pixels(spark, sf_dir))
    low = dense.groupBy("inline_number").agg(F.min("x").alias("x0"))
    rows = dense.groupBy("inline_number", "x").agg(F.transform(F.array_sort(F.collect_list(F.struct("z", F.col("p").cast("float").alias("p")))), lambda r: r["p"]).alias("amplitudes"))
    return rows.join(low, "inline_number").select("inline_number", (F.col("x") - F.col("x0")).cast("int").alias("xl_pos"), "amplitudes")


def _plain_scorer(x):
    """Stands in for a model: the logistic function of each pixel."""
    import numpy as np

    return 1 / (1 + np.exp(-x.astype(float)))


@query("tile_statistics", f"WITH {TILES_SQL} SELECT inline_number, CAST(tx AS INTEGER) AS tx, CAST(tz AS INTEGER) AS tz, round(m, 5) AS mean, round(d, 5) AS deviation FROM stats")
def tile_statistics(spark, sf_dir):
    cut = tiles.cut_tiles(tiles.scaled_traces(_tile_traces(spark, sf_dir)), TileConfig((TILE, TILE), OVERLAP))
    pixel = cut.select("inline_number", "tx", "tz", F.explode("values").alias("v"))
    return pixel.groupBy("inline_number", "tx", "tz").agg(F.round(F.avg("v"), 5).alias("mean"), F.round(F.stddev_pop("v"), 5).alias("deviation"))


@query("probability_map", f"""WITH {TILES_SQL}, w AS (SELECT h.*, least(r, {TILE - 1} - r) AS er, least(c, {TILE - 1} - c) AS ec, 1 / (1 + exp(-(v - m) / d)) AS p FROM held h JOIN stats USING (inline_number, tx, tz)),
  e AS (SELECT *, exp(-power(CASE WHEN ec < {OVERLAP} THEN ec ELSE er END - {OVERLAP} + 1, 2) * 0.5 / power({OVERLAP} / 4.0, 2)) AS taper FROM w),
  f AS (SELECT *, CASE WHEN ec < {OVERLAP} OR er < {OVERLAP} THEN taper ELSE 1.0 END AS weight FROM e WHERE tx + r < nx AND tz + c < nz)
  SELECT inline_number, CAST(tx + r AS INTEGER) AS x, CAST(tz + c AS INTEGER) AS z, round(sum(p * weight) / sum(weight), 4) AS p FROM f GROUP BY 1, 2, 3""")
def probability_map(spark, sf_dir):
    return tiles.probability_map(_tile_traces(spark, sf_dir), _plain_scorer, TileConfig((TILE, TILE), OVERLAP)).select("inline_number", "x", "z", F.round("p", 4).alias("p"))


def _dbscan_sql(source: str, eps: float, least: int, k: str = "") -> str:
    """CTE clustered<k> of source(inline_number, pid, x, z): components of core points numbered by their smallest, borders by the lowest number around, -1 for noise."""
    on = lambda a, b: f"{a}.inline_number = {b}.inline_number"
    return f"""near{k} AS (SELECT a.inline_number, a.pid, b.pid AS other FROM {source} a JOIN {source} b ON {on("a", "b")} AND (a.x - b.x) * (a.x - b.x) + (a.z - b.z) * (a.z - b.z) <= {eps * eps}),
  core{k} AS (SELECT inline_number, pid, count(*) >= {least} AS core FROM near{k} GROUP BY 1, 2),
  ce{k} AS (SELECT n.inline_number, n.pid, n.other FROM near{k} n JOIN core{k} c ON {on("c", "n")} AND c.pid = n.pid AND c.core JOIN core{k} d ON {on("d", "n")} AND d.pid = n.other AND d.core),
  reach{k} AS (SELECT inline_number, pid, pid AS root FROM core{k} WHERE core UNION SELECT e.inline_number, e.other, r.root FROM reach{k} r JOIN ce{k} e ON {on("e", "r")} AND e.pid = r.pid WHERE r.root < e.other),
  comp{k} AS (SELECT inline_number, pid, min(root) AS root FROM reach{k} GROUP BY 1, 2),
  num{k} AS (SELECT inline_number, pid, dense_rank() OVER (PARTITION BY inline_number ORDER BY root) - 1 AS label FROM comp{k}),
  border{k} AS (SELECT n.inline_number, n.pid, min(m.label) AS label FROM near{k} n JOIN num{k} m ON {on("m", "n")} AND m.pid = n.other GROUP BY 1, 2),
  clustered{k} AS (SELECT p.inline_number, p.pid, p.x, p.z, coalesce(m.label, b.label, -1) AS label FROM {source} p LEFT JOIN num{k} m ON {on("m", "p")} AND m.pid = p.pid LEFT JOIN border{k} b ON {on("b", "p")} AND b.pid = p.pid)"""


CLUSTERS_SQL = f"{A.GRID_POINTS_SQL}, {GROUPED_SQL}, {_dbscan_sql('pts', 3, 3)}"
ORACLE_SQL["density_clusters"] = f"WITH RECURSIVE {CLUSTERS_SQL} SELECT inline_number, pid, CAST(label AS INTEGER) AS label FROM clustered"
COUNTS_SQL = f"""{CLUSTERS_SQL}, counts AS (SELECT inline_number, 'candidates' AS stage, count(*) AS points, CAST(0 AS BIGINT) AS clusters FROM grid_points GROUP BY 1 UNION ALL SELECT inline_number, 'grouped', count(*), 0 FROM grouped GROUP BY 1
  UNION ALL SELECT inline_number, 'clustered', count(*), count(DISTINCT label) FROM clustered WHERE label >= 0 GROUP BY 1)"""


def _counts(spark, sf_dir):
    points = cut_lineage(_points(spark, sf_dir))
    label = cluster.dbscan(points, 3, 3).where("label >= 0")
    return detection.stage_counts({"candidates": A.grid_points(spark, sf_dir), "grouped": points, "clustered": points.join(label, ["inline_number", "pid"])})


@query("stage_counts", f"WITH RECURSIVE {COUNTS_SQL} SELECT * FROM counts")
def stage_counts(spark, sf_dir):
    return _counts(spark, sf_dir)


@query("golden_mismatches", f"""WITH RECURSIVE {COUNTS_SQL}, e AS (SELECT * FROM (VALUES ('candidates', 1000, 0), ('grouped', 300, NULL), ('clustered', NULL, 5)) t(stage, ep, ec))
  SELECT e.stage, points, clusters, CAST(ep AS BIGINT) AS expected_points, CAST(ec AS BIGINT) AS expected_clusters FROM e LEFT JOIN counts c ON c.stage = e.stage AND c.inline_number = 3 WHERE (ep IS NOT NULL AND points IS DISTINCT FROM ep) OR (ec IS NOT NULL AND clusters IS DISTINCT FROM ec)""")
def golden_mismatches(spark, sf_dir):
    return detection.golden_mismatches(_counts(spark, sf_dir), 3, {"candidates": (1000, 0), "grouped": (300, None), "clustered": (None, 5)})


def _merge_sql(source: str, theta: float, distance: float, extrapolation: float, rounds: int = 5) -> str:
    """CTE merged of source(inline_number, label, pid, x, z): clusters joined while pairs are below all limits, labels dense by the smallest member. Five rounds are more than these tables need."""
    out, before = [], source
    off = "avg(abs(-sin(g.t) * (p.x - g.mx) + cos(g.t) * (p.z - g.mz)))"
    for k in range(1, rounds + 1):
        side = lambda mine, theirs: f"(SELECT d.inline_number, d.i, d.j, {off} AS o FROM d{k} d JOIN {before} p ON p.inline_number = d.inline_number AND p.label = d.{mine} JOIN g{k} g ON g.inline_number = d.inline_number AND g.label = d.{theirs} GROUP BY 1, 2, 3)"  # noqa: B023, E731
        out.append(f"""g{k} AS (SELECT inline_number, label, avg(x) AS mx, avg(z) AS mz, 0.5 * atan2(2 * covar_pop(x, z), var_pop(x) - var_pop(z)) AS t FROM {before} GROUP BY 1, 2),
  d{k} AS (SELECT a.inline_number, a.label AS i, b.label AS j, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.z - b.z) * (a.z - b.z))) AS distance FROM {before} a JOIN {before} b ON a.inline_number = b.inline_number AND a.label < b.label GROUP BY 1, 2, 3),
  join{k} AS (SELECT d.inline_number, d.i, d.j FROM d{k} d JOIN {side("i", "j")} u USING (inline_number, i, j) JOIN {side("j", "i")} v USING (inline_number, i, j) JOIN g{k} a ON a.inline_number = d.inline_number AND a.label = d.i JOIN g{k} b ON b.inline_number = d.inline_number AND b.label = d.j
    WHERE distance < {distance} AND least(u.o, v.o) < {extrapolation} AND degrees(acos(least(1.0, abs(cos(a.t - b.t))))) < {theta}),
  ways{k} AS (SELECT inline_number, i AS a, j AS b FROM join{k} UNION SELECT inline_number, j, i FROM join{k}),
  far{k} AS (SELECT inline_number, a AS node, a AS root FROM ways{k} UNION SELECT f.inline_number, w.b, f.root FROM far{k} f JOIN ways{k} w ON w.inline_number = f.inline_number AND w.a = f.node WHERE f.root < w.b),
  root{k} AS (SELECT inline_number, node AS label, min(root) AS root FROM far{k} GROUP BY 1, 2),
  m{k} AS (SELECT p.inline_number, coalesce(r.root, p.label) AS label, p.pid, p.x, p.z FROM {before} p LEFT JOIN root{k} r ON r.inline_number = p.inline_number AND r.label = p.label)""")
        before = f"m{k}"
    out.append(f"merged AS (SELECT inline_number, dense_rank() OVER (PARTITION BY inline_number ORDER BY label) - 1 AS label, pid, x, z FROM {before})")
    return ",\n  ".join(out)


ORACLE_SQL["merge_clusters"] = f"WITH RECURSIVE {CLUSTERS_SQL}, kept AS (SELECT * FROM clustered WHERE label >= 0), {_merge_sql('kept', 17, 20, 4)} SELECT inline_number, pid, CAST(label AS INTEGER) AS label FROM merged"

DETECTED_SQL = f"""WITH RECURSIVE {RIDGE_SQL}, cand AS (SELECT inline_number, x, z FROM pixels WHERE CAST(p AS FLOAT) > CAST(0.7 AS FLOAT)),
  ridges AS (SELECT r.* FROM ridge r JOIN cand c ON c.inline_number = r.inline_number AND c.x = r.x AND c.z = r.z),
  dist AS (SELECT c.inline_number, c.x, c.z, min(sqrt((c.x - r.x) * (c.x - r.x) + (c.z - r.z) * (c.z - r.z))) AS d FROM cand c JOIN ridges r USING (inline_number) GROUP BY 1, 2, 3),
  ordered AS (SELECT *, row_number() OVER (PARTITION BY inline_number ORDER BY CASE WHEN d <= 2 THEN 0 ELSE d END, x, z) AS n, ceil(count(*) OVER (PARTITION BY inline_number) * 0.999) AS need FROM dist),
  preserved AS (SELECT inline_number, x, z FROM ordered WHERE d <= 2 OR n <= need UNION ALL SELECT inline_number, x, z FROM cand WHERE inline_number NOT IN (SELECT inline_number FROM ridges)),
  {_grouped_sql("preserved", 1)}, first_points AS (SELECT inline_number, pid, CAST(x AS DOUBLE) AS x, CAST(z AS DOUBLE) AS z FROM pts),
  {_dbscan_sql("first_points", 4.2, 2)}, dense_points AS (SELECT * FROM clustered WHERE label >= 0),
  {_curve_sql("dense_points", "_a")}, {_smoothed_sql("_a")}, {_angle_rounds_sql("smoothed_a", 10, "a")},
  renewed AS (SELECT inline_number, label, x, z, row_number() OVER (PARTITION BY inline_number ORDER BY label, pid) - 1 AS pid FROM kepta10),
  {_dbscan_sql("renewed", 4.2, 2, "_b")}, quiet AS (SELECT r.* FROM renewed r JOIN clustered_b c ON c.inline_number = r.inline_number AND c.pid = r.pid AND c.label >= 0),
  {_merge_sql("quiet", 17, 10, 8)},
  sizes AS (SELECT inline_number, label, min(pid) AS first FROM merged GROUP BY 1, 2 HAVING count(*) >= 3 AND max(z) - min(z) > 2),
  large AS (SELECT m.inline_number, s.label, pid, x, z FROM merged m JOIN (SELECT inline_number, label AS old, row_number() OVER (PARTITION BY inline_number ORDER BY first) - 1 AS label FROM sizes) s ON s.inline_number = m.inline_number AND s.old = m.label),
  {_curve_sql("large", "_c")}, {_smoothed_sql("_c")}, {_angle_rounds_sql("smoothed_c", 10, "c")},
  knots AS (SELECT inline_number, label, x, min_by(z, pid) AS z FROM keptc10 GROUP BY 1, 2, 3),
  spans AS (SELECT *, lead(x) OVER w AS x2, lead(z) OVER w AS z2 FROM knots WINDOW w AS (PARTITION BY inline_number, label ORDER BY x)),
  ends AS (SELECT inline_number, label, min(x) AS low, max(x) AS high FROM knots GROUP BY 1, 2 HAVING min(x) < max(x)),
  wanted AS (SELECT inline_number, label, low, high, CAST(trunc(low + j) AS INTEGER) AS xi FROM (SELECT *, unnest(range(CAST(ceil(high + 1 - low) AS INTEGER))) AS j FROM ends))
  SELECT w.inline_number, CAST(w.label AS INTEGER) AS label, xi AS x, CAST(round_even(z + (xi - x) * (z2 - z) / (x2 - x), 0) AS INTEGER) AS z FROM wanted w JOIN spans s ON s.inline_number = w.inline_number AND s.label = w.label AND x2 IS NOT NULL AND (xi >= x OR x = low) AND (xi < x2 OR x2 = high)"""


@query("detected_lines", DETECTED_SQL)
def detected_lines(spark, sf_dir):
    """The whole detection on one pixel grid per line number, with thresholds for its coarse counts.

    Points start on whole pixels, so a whole eps would be met exactly by many pairs and be decided by the last
    bit of the smoothing's sums, which no two engines need share; 4.2 lies between the grid's distances.
    """
    config = detection.DetectionConfig(threshold=0.7, max_gap=1, eps=4.2, second_eps=4.2, min_samples=2, second_min_samples=2, merge_distance=10, min_cluster_points=3, min_vertical_range=2, support_radius=2)
    return detection.detect_lines(A.pixels(spark, sf_dir), config)["interpolated"]


# Contracts -----------------------------------------------------------------------------------------------------

@query("cluster_contract", f"""WITH {A.FAULT_POINTS_SQL} SELECT sec, cluster, count(*) AS points, count(DISTINCT (x, z)) AS distinct_points, bool_and(x >= 0 AND z >= 0 AND x < 20 AND z < 10) AS in_bounds, true AS finite,
  bool_and(abs(x - round_even(x, 0)) <= 1e-9 AND abs(z - round_even(z, 0)) <= 1e-9) AS whole, count(DISTINCT (x, z)) >= 2 AND bool_and(x >= 0 AND z >= 0 AND x < 20 AND z < 10) AS ok FROM fault_points GROUP BY sec, cluster""")
def cluster_contract(spark, sf_dir):
    return contracts.cluster_contract(A.fault_points(spark, sf_dir), ["sec", "cluster"], F.lit(20), F.lit(10))


@query("dense_ids", """WITH r AS (SELECT DISTINCT CAST(floor((floor(epoch(ts)) - 1704067200) / 86400) AS INTEGER) AS sec, CASE WHEN user_id % 3 = 0 THEN event_type || user_id % 2 ELSE CAST(user_id AS VARCHAR) END AS cluster FROM events)
  SELECT sec, cluster, CAST(row_number() OVER (PARTITION BY sec ORDER BY try_cast(cluster AS BIGINT) IS NULL, try_cast(cluster AS BIGINT), cluster) - 1 AS INTEGER) AS id FROM r""")
def dense_ids(spark, sf_dir):
    n = F.col("user_id")
    name = F.when(n % 3 == 0, F.concat("event_type", (n % 2).cast("string"))).otherwise(n.cast("string"))
    rows = A.table(spark, sf_dir, "events").select(F.floor((F.unix_timestamp("ts") - A.EPOCH) / 86400).cast("int").alias("sec"), name.alias("cluster")).distinct()
    return contracts.dense_ids(rows, "sec", "cluster")


@query("malformed_keys", """WITH k AS (SELECT DISTINCT CASE o_orderkey % 4 WHEN 0 THEN 'line_' || o_custkey WHEN 1 THEN 'line_0' || o_custkey WHEN 2 THEN 'row_' || o_custkey ELSE NULL END AS line_key FROM orders)
  SELECT line_key FROM k WHERE line_key IS NULL OR NOT regexp_full_match(line_key, 'line_(0|[1-9][0-9]*)')""")
def malformed_keys(spark, sf_dir):
    n, c = F.col("o_orderkey") % 4, F.col("o_custkey").cast("string")
    key = F.when(n == 0, F.concat(F.lit("line_"), c)).when(n == 1, F.concat(F.lit("line_0"), c)).when(n == 2, F.concat(F.lit("row_"), c))
    return contracts.malformed_keys(A.table(spark, sf_dir, "orders").select(key.alias("line_key")), "line_key")


@query("face_differences", """WITH f AS (SELECT l_orderkey AS s, l_partkey AS a, l_suppkey AS b, CAST(l_linenumber AS BIGINT) AS c FROM lineitem), g AS (SELECT s, list_sort([a, b, c]) AS face FROM f), h AS (SELECT s, face FROM g WHERE NOT (s % 10 = 0))
  SELECT s, array_to_string(face, ',') AS face FROM (SELECT s, face FROM g EXCEPT ALL SELECT s, face FROM h)""")
def face_differences(spark, sf_dir):
    f = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("s"), F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_linenumber").cast("long").alias("c"))
    out = catalogue.same_faces(f, f.where("s % 10 <> 0"), ["s"])
    return out.select("s", F.array_join(F.transform("face", lambda x: x.cast("string")), ",").alias("face"))


@query("count_mismatches", """WITH f AS (SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem GROUP BY 1), d AS (SELECT o_orderkey, 4 AS n FROM orders)
  SELECT o_orderkey, CAST(d.n AS BIGINT) AS declared, f.n AS found FROM d FULL OUTER JOIN f USING (o_orderkey) WHERE d.n IS DISTINCT FROM f.n""")
def count_mismatches(spark, sf_dir):
    found = A.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    declared = A.table(spark, sf_dir, "orders").select("o_orderkey", F.lit(4).cast("long").alias("n"))
    return contracts.count_mismatches(declared, found, "o_orderkey", "n")


@query("repeated_sections", "SELECT sha256(text) AS sha, lang AS section, count(*) AS n FROM documents GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_sections(spark, sf_dir):
    rows = A.table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("sha"), F.col("lang").alias("section"))
    return contracts.repeated_sections(rows, "sha", "section")
