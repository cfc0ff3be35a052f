"""Leakage-safe splits of patches into train and validation: by declared lines, whole inlines, or the tail of each source.

Records: (source_id, source_segy_sha256, section_index, inline_id, x0, z0, source_nx, source_nz, requested_split)
and any other columns. A physical source is a section of a file by its checksum, so a file listed twice is one source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geostrata.config import LabelConfig
from geostrata.functions import scalars
from geostrata.operators import labels
from geostrata.storage import cut_lineage


def with_sources(records: DataFrame) -> DataFrame:
    """records with source_key, the logical source, and physical_source, by checksum where there is one."""
    key = scalars.source_key(F.col("source_id"), F.coalesce("inline_id", F.lit(-1)), F.coalesce("section_index", F.lit(0)))
    named = records.withColumn("source_key", key)
    return named.withColumn("physical_source", scalars.physical_source(F.col("source_segy_sha256"), F.coalesce("section_index", F.lit(0)), F.col("source_key")))


def spatial_boundary(length: Column, config: LabelConfig) -> Column:
    """The first validation origin of a source: of its legal origins along the axis, whether they hold patches or not, the last ceil(n * fraction) validate."""
    legal = F.floor((length - config.patch_size) / config.stride) + 1
    val = F.greatest(F.lit(1), F.ceil(legal * config.val_fraction))
    return ((legal - val) * config.stride).cast("int")


def spatial_split(records: DataFrame, config: LabelConfig = LabelConfig()) -> DataFrame:
    """records with boundary and split: val from the boundary on, train where a patch ends a guard before it, else null. Arithmetic on the row; nothing is shuffled."""
    origin, length = F.col(f"{config.axis}0"), F.col(f"source_n{config.axis}")
    split = F.when(origin >= F.col("boundary"), "val").when(origin + config.patch_size <= F.col("boundary") - config.gap, "train")
    return records.withColumn("boundary", spatial_boundary(length, config)).withColumn("split", split)


def boundaries(split: DataFrame, config: LabelConfig = LabelConfig()) -> DataFrame:
    """One row per physical source of a spatial split: its boundary, the limit of train patches, and the patches of either side and between."""
    n = lambda which: F.count_if(which).alias
    rows = split.groupBy("physical_source").agg(
        F.min("source_key").alias("source_key"), F.max(f"source_n{config.axis}").alias("source_length"), F.max("boundary").alias("boundary"),
        n(F.col("split") == "train")("train_pool"), n(F.col("split") == "val")("val_pool"), n(F.col("split").isNull())("discarded"),
    )
    return rows.withColumn("axis", F.lit(config.axis)).withColumn("train_limit", F.col("boundary") - config.gap)


def spatial_problems(records: DataFrame, config: LabelConfig) -> DataFrame:
    """(problem): sources of several lengths, shorter than a patch, or with origins off the grid."""
    origin, length = F.col(f"{config.axis}0"), F.col(f"source_n{config.axis}")
    each = records.groupBy("physical_source").agg(F.min(length).alias("low"), F.max(length).alias("high"), F.count_if((origin % config.stride != 0) | (origin < 0) | (origin + config.patch_size > length)).alias("off"), F.count_if(length.isNull() | origin.isNull()).alias("lacking"))
    rules = [("lacking > 0", "lacks a length or an origin"), ("low <> high", "has several lengths"), (f"high < {config.patch_size}", "is shorter than a patch"), ("off > 0", "has origins off the grid")]
    return _problems([each.where(rule).select(F.concat(F.lit("source "), "physical_source", F.lit(f" {what}")).alias("problem")) for rule, what in rules])


def record_problems(records: DataFrame) -> DataFrame:
    """(problem): physical sources listed under several inlines, and patches that occur twice."""
    several = records.groupBy("physical_source").agg(F.countDistinct("inline_id").alias("n"), F.count_if(F.col("inline_id").isNull()).alias("none")).where("n > 1 or none > 0")
    twice = labels.duplicates(records, ["physical_source", "x0", "z0"])
    return _problems([
        several.select(F.concat(F.lit("source "), "physical_source", F.lit(" has no inline or several")).alias("problem")),
        twice.select(F.format_string("patch %s %d %d occurs twice", "physical_source", "x0", "z0").alias("problem")),
    ])


def explicit_problems(records: DataFrame) -> DataFrame:
    """(problem): declared splits that are incomplete, unknown or one-sided, and inlines or physical sources on both sides."""
    side = F.lower("requested_split")
    totals = records.agg(F.count("*").alias("n"), F.count("requested_split").alias("given"), F.count_if(side == "train").alias("train"), F.count_if(side == "val").alias("val"))
    rules = [("given > 0 and given < n", "splits are declared for some lines only"), ("train + val < given", "a declared split is neither train nor val"), ("given > 0 and (train = 0 or val = 0)", "one declared side has no patch")]
    both = [records.where(side.isNotNull()).groupBy(F.col(c).cast("string").alias("k")).agg(F.countDistinct(side).alias("n")).where("n > 1").select(F.concat(F.lit(f"{c} "), "k", F.lit(" is on both sides")).alias("problem")) for c in ("inline_id", "physical_source")]
    return _problems([totals.where(rule).select(F.lit(what).alias("problem")) for rule, what in rules] + both)


def _problems(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def choose_val_inlines(records: DataFrame, config: LabelConfig = LabelConfig(), inline: str = "inline_id") -> DataFrame:
    """The validation inlines: those of the configuration, or round(n * share of target_val), half to even, at least one and at most n - 1, the first by a seeded hash.

    One row per inline is ranked.
    """
    each = records.select(inline).distinct()
    if config.val_inlines:
        return each.where(F.col(inline).isin(*config.val_inlines))
    n = each.agg(F.count("*").alias("n"))
    ranked = each.withColumn("nth", F.row_number().over(Window.orderBy(F.md5(F.concat_ws(":", F.lit(str(config.seed)), F.col(inline).cast("string"))), inline)))
    share = config.target_val / (config.target_train + config.target_val)
    take = F.greatest(F.lit(1), F.least(F.col("n") - 1, F.rint(F.col("n") * share)))
    return ranked.join(F.broadcast(n), F.col("nth") <= take).select(inline)  # n is one row


def inline_split(records: DataFrame, val_inlines: DataFrame, inline: str = "inline_id") -> DataFrame:
    """records with split: val for the inlines of val_inlines, train for the others."""
    marked = val_inlines.select(inline).distinct().withColumn("__val", F.lit(True))
    return records.join(marked, inline, "left").withColumn("split", F.when(F.col("__val"), "val").otherwise("train")).drop("__val")


def assign(records: DataFrame, config: LabelConfig = LabelConfig()) -> tuple[DataFrame, dict]:
    """(records with split, how it was resolved). Declared lines go first; a single inline falls back to the spatial split; anything unsafe is an error.

    Only counts and the names of broken rules come to the driver.
    """
    records = cut_lineage(with_sources(records))
    totals = records.agg(F.count("*").alias("n"), F.count("requested_split").alias("declared"), F.countDistinct("inline_id").alias("inlines")).first()
    _refuse(totals["n"] == 0, "there are no records to split")
    _refuse_any(record_problems(records))
    _refuse(totals["declared"] > 0 and (config.strategy != "inline" or bool(config.val_inlines)), "declared splits go with the inline strategy alone, without val_inlines")
    how = {"requested_strategy": config.strategy, "resolved_strategy": "inline", "fallback_reason": None}
    if totals["declared"]:
        _refuse_any(explicit_problems(records))
        return records.withColumn("split", F.lower("requested_split")), how | {"assignment": "declared"}
    if config.strategy == "inline" and totals["inlines"] > 1:
        chosen = choose_val_inlines(records, config)
        if config.val_inlines:
            known = chosen.count()
            _refuse(known < len(set(config.val_inlines)), "val_inlines names inlines without patches")
            _refuse(known == totals["inlines"], "val_inlines must leave an inline to train on")
        return inline_split(records, chosen), how | {"assignment": "configured inlines" if config.val_inlines else "seeded inlines"}
    _refuse(bool(config.val_inlines), "val_inlines need two inlines with patches")
    _refuse_any(spatial_problems(records, config))
    reason = "one inline" if config.strategy == "inline" else None
    return spatial_split(records, config), how | {"resolved_strategy": "spatial", "fallback_reason": reason, "assignment": "spatial tail"}


def split_records(records: DataFrame, config: LabelConfig = LabelConfig()) -> dict[str, DataFrame]:
    """train and val, each shuffled by a seeded hash of the sample and capped, assigned, before the cap, and summary, one row of counts.

    Pools that share a pixel of a physical source, or an empty side, are errors.
    """
    assigned, how = assign(records, config)
    assigned = cut_lineage(assigned.withColumn("sample_id", labels.sample_id(F.col("source_key"), F.col("x0"), F.col("z0"), config.patch_size)))
    pools = {side: assigned.where(F.col("split") == side) for side in ("train", "val")}
    shared = labels.overlapping_pairs(pools["train"], pools["val"], config.patch_size, "physical_source").first()
    _refuse(shared is not None, f"train and validation patches overlap: {shared}")
    sizes = assigned.agg(*[F.count_if(F.col("split") == side).alias(side) for side in pools], F.count_if(F.col("split").isNull()).alias("discarded")).first()
    _refuse(min(sizes["train"], sizes["val"]) == 0, "one side of the split has no patch")
    out = {side: labels.shuffle_and_cap(pools[side], target, config.seed + k, "sample_id") for k, (side, target) in enumerate((("train", config.target_train), ("val", config.target_val)), 1)}
    row = how | {"seed": config.seed, "train_pool": sizes["train"], "val_pool": sizes["val"], "discarded": sizes["discarded"]}
    row |= {"train": min(sizes["train"], config.target_train), "val": min(sizes["val"], config.target_val)}
    kinds = "requested_strategy string, resolved_strategy string, fallback_reason string, assignment string, seed long, train_pool long, val_pool long, discarded long, train long, val long"
    summary = records.sparkSession.createDataFrame([tuple(row[x.split()[0]] for x in kinds.split(", "))], kinds)
    return out | {"assigned": assigned, "summary": summary}


def _refuse(bad: bool, why: str) -> None:
    if bad:
        raise ValueError(why)


def _refuse_any(problems: DataFrame) -> None:
    found = problems.orderBy("problem").limit(5).collect()
    _refuse(bool(found), "; ".join(x["problem"] for x in found))
