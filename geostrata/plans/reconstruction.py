"""Fault points to tracks and surfaces."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostrata.config import LinkConfig, as_json
from geostrata.functions import scalars
from geostrata.operators import linking, surface
from geostrata.sources import files
from geostrata.storage import cut_lineage


def reconstruct(points: DataFrame, config: LinkConfig = LinkConfig(), surfaces: bool = True) -> dict[str, DataFrame]:
    """lines, candidates, matches, tracks, links, counters and, unless left out, surfaces. points: (sec, cluster, x, z)."""
    lines = cut_lineage(linking.fault_lines(points, config))
    scored = cut_lineage(linking.score_candidates(lines, config))
    matches = cut_lineage(linking.best_matches(scored))
    tracks = cut_lineage(linking.build_tracks(matches, lines, config))
    links = cut_lineage(candidate_table(scored, matches, tracks))
    out = {"lines": lines, "candidates": scored, "matches": matches, "tracks": tracks, "links": links, "counters": counters(lines, links, tracks, config)}
    if surfaces:
        named = points.select(F.format_string("line_%d_c%s", "sec", "cluster").alias("line_id"), "x", "z")
        out["surfaces"] = cut_lineage(surface.track_surfaces(tracks, named, config))
    return out


def candidate_table(scored: DataFrame, matches: DataFrame, tracks: DataFrame) -> DataFrame:
    """scored with source_best, selected and track_edge: an edge between neighbours of one track."""
    place = lambda line, order: tracks.select(F.col("line_id").alias(line), F.col("track_id").alias(f"{line}_track"), F.col("member_order").alias(order))
    marked = scored.join(matches.select("source_id", "target_id", "source_best", "selected"), ["source_id", "target_id"], "left")
    marked = marked.join(place("source_id", "from"), "source_id", "left").join(place("target_id", "to"), "target_id", "left")
    no = F.lit(False)
    edge = F.col("selected") & (F.col("gap") == 1) & (F.col("source_id_track") == F.col("target_id_track")) & (F.col("to") == F.col("from") + 1)
    return marked.select(*scored.columns, F.coalesce("source_best", no).alias("source_best"), F.coalesce("selected", no).alias("selected"), F.coalesce(edge, no).alias("track_edge"))


def counters(lines: DataFrame, links: DataFrame, tracks: DataFrame, config: LinkConfig = LinkConfig()) -> DataFrame:
    """One row: pairs considered, pruned, scored and above the threshold, best and selected ones, lines, tracks."""
    one = F.lit(1).alias("one")
    pairs = linking.candidate_pairs(lines, config).agg(F.count("*").alias("considered"), F.count_if("pruned").alias("pruned"))
    n = lambda which: F.count_if(F.col(which)).alias(which)
    found = links.agg(F.count("*").alias("exact"), n("above_threshold"), n("source_best"), n("selected"), F.count_if(F.col("selected") & (F.col("gap") == 1)).alias("adjacent"), n("track_edge"))
    sizes = lines.agg(F.count("*").alias("lines")).select("*", one).join(tracks.agg(F.countDistinct("track_id").alias("tracks")).select("*", one), "one")
    return pairs.select("*", one).join(found.select("*", one), "one").join(sizes, "one").drop("one")


def track_summary(tracks: DataFrame, matches: DataFrame) -> DataFrame:
    """(track_id, lines, first, last, line_ids, min_similarity, mean_similarity) of each track."""
    edges = matches.where("selected and gap = 1").select(F.col("target_id").alias("line_id"), "similarity")
    inner = F.when(F.col("member_order") > 0, F.col("similarity"))
    return tracks.join(edges, "line_id", "left").groupBy("track_id").agg(
        F.count("*").alias("lines"), F.min("sec").alias("first"), F.max("sec").alias("last"),
        F.transform(F.array_sort(F.collect_list(F.struct("member_order", "line_id"))), lambda m: m["line_id"]).alias("line_ids"),
        F.min(inner).alias("min_similarity"), F.avg(inner).alias("mean_similarity"),
    )


def membership_table(tracks: DataFrame, lines: DataFrame, config: LinkConfig = LinkConfig()) -> DataFrame:
    """Track members with where each line comes from and how many points it has."""
    inline = config.inline_origin + F.col("sec") * config.inline_step
    facts = lines.select("line_id", F.col("cluster").alias("cluster_id"), F.col("n").alias("point_count"))
    named = tracks.join(facts, "line_id").withColumn("inline_number", inline)
    key = scalars.inline_to_line_key(F.col("inline_number"), config.inline_origin, config.inline_step)
    return named.select("track_id", "member_order", "line_id", key.alias("source_key"), "inline_number", F.col("sec").alias("section_index"), "cluster_id", "point_count")


def save_reconstruction(out: dict[str, DataFrame], folder: str, config: LinkConfig = LinkConfig(), source: dict | None = None) -> None:
    """Writes the tables of reconstruct() and one metadata record under a new folder: candidates, links, membership, tracks, vertices, faces, shapes."""
    spark = out["lines"].sparkSession
    files.need_empty(spark, folder)
    tables = {
        "candidate_scores": out["links"], "selected_links": out["links"].where("selected"), "track_membership": membership_table(out["tracks"], out["lines"], config),
        "tracks": track_summary(out["tracks"], out["matches"]),
    }
    if "surfaces" in out:
        tables |= {"vertices": out["surfaces"].select("track_id", "row", "col", "inline", "profile", "depth"), "faces": surface.flat_faces(out["surfaces"]), "shapes": surface.flat_offsets(out["surfaces"])}
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")
    counts = out["counters"].first().asDict() | ({"surfaces": spark.read.parquet(f"{folder}/shapes").count()} if "surfaces" in out else {})
    record = {"parameters": as_json(config), "input": source or {}, "counts": counts, "coordinates": {"axis_scales": list(config.axis_scales), "surface_axis_order": ["inline_number", "profile_pixel", "depth_pixel"]}}
    spark.createDataFrame([(json.dumps(record, sort_keys=True),)], "value string").coalesce(1).write.text(f"{folder}/run_metadata")
