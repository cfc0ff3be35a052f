"""Merkle manifest of a dataset, from level strings.

Leaves are the hashes of rows. Within a group (a source) they ascend by key, and every FAN consecutive nodes become
one, level by level, until one is left: the group's subroot. The subroots, by group, give the root likewise.

Rows get their place in their group by a range partition, counts a partition and added offsets, so no group, however
large, is in one task. Aligned blocks of FAN ** STEPS places then keep each of their levels as one hex string: parents
are the hashes of its fixed-width substrings, and the siblings of a node are the substrings that flank it. The tops
of blocks are the leaves of the next round, whose places are known. Proofs come down the same rounds: a block hands
each of its nodes the flanks above it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geostrata.llm.common import drop_saved, saved, training_rows

FAN, STEPS, HEX = 16, 2, 64
BLOCK = FAN**STEPS
RUN = FAN * HEX
FLANKS = "array<struct<left:string,right:string>>"


def leaf_hash(*fields: Column) -> Column:
    """SHA-256, as lowercase hex, of the fields as text one after another: `-` for null, else the UTF-8 byte count, `:` and the value."""
    texts = [x.cast("string") for x in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in texts]), 256)


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with `pos`, the place in the group by `order` from 0, and `n`, the group's size. group holds no null.

    Rows are dealt by ranges of (group, order), so a large group is shared by many tasks; a task counts its rows of
    each group, and the counts of the tasks before it are added: one row per task and group it holds.
    """
    ranged = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("__at", F.monotonically_increasing_id())
    ranged = saved(ranged.withColumn("__task", F.shiftright("__at", 33)), "ranged")
    shares = ranged.groupBy("__task", group).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__share"))
    whole = Window.partitionBy(group)
    before = F.coalesce(F.sum("__share").over(whole.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shares = shares.select("__task", group, "__first", before.alias("__before"), F.sum("__share").over(whole).alias("n"))
    found = ranged.join(shares, ["__task", group]).withColumn("pos", F.col("__at") - F.col("__first") + F.col("__before"))
    return found.drop("__at", "__task", "__first", "__before")


def _height(n: Column) -> Column:
    """Levels above the leaves of a tree of n leaves."""
    return sum((F.when(n > FAN**k, 1).otherwise(0) for k in range(1, 15)), F.when(n > 1, 1).otherwise(0))


def _parents(level: Column) -> Column:
    """The level above: the hash of each fixed-width run of nodes."""
    starts = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / RUN).cast("int"))
    return F.array_join(F.transform(starts, lambda i: F.sha2(level.substr(i * RUN + 1, F.lit(RUN)), 256)), "")


def _flank(level: Column, at: Column) -> Column:
    """What stands left and right of node `at` in its run."""
    run = level.substr(F.floor(at / FAN).cast("int") * RUN + 1, F.lit(RUN))
    here = (at % FAN).cast("int") * HEX
    return F.struct(run.substr(F.lit(1), here).alias("left"), run.substr(here + HEX + 1, F.lit(RUN)).alias("right"))


def _flanks(at: Column) -> Column:
    """Flanks of node `at` of a block, and of its parent where the block has two steps."""
    low, high = _flank(F.col("level0"), at), _flank(F.col("level1"), F.floor(at / FAN).cast("int"))
    empty = F.array().cast(FLANKS)
    return F.when(F.col("steps") == 2, F.array(low, high)).when(F.col("steps") == 1, F.array(low)).otherwise(empty).cast(FLANKS)


@dataclass
class Forest:
    """One tree per group. rounds: blocks with their level strings, from the leaves up; round 0 also has its rows, in order."""

    rounds: list[DataFrame]

    def roots(self) -> DataFrame:
        """(group, root), one row per group."""
        done = [x.where(f"height <= {STEPS * (r + 1)}").select("group", F.col("top").alias("root")) for r, x in enumerate(self.rounds)]
        out = done[0]
        for more in done[1:]:
            out = out.unionAll(more)
        return out

    def proofs(self, above: DataFrame) -> DataFrame:
        """(row, above, path) of every row: what `above` (group, above, path) says of its group, with the flanks up to the group's root put before its path."""
        given = None
        for r in range(len(self.rounds) - 1, -1, -1):
            blocks = self.rounds[r]
            top = blocks.where(f"height <= {STEPS * (r + 1)}").select("group", "block").join(above, "group")
            given = top if given is None else top.unionByName(given)
            held = blocks.join(given, ["group", "block"])
            if r:
                at = F.explode(F.sequence(F.lit(0), (F.length("level0") / HEX - 1).cast("int"))).alias("at")
                nodes = held.select("group", "block", "level0", "level1", "steps", "above", "path", at)
                given = nodes.select("group", (F.col("block") * BLOCK + F.col("at")).alias("block"), "above", F.concat(_flanks(F.col("at")), "path").alias("path"))
        rows = held.select("level0", "level1", "steps", "above", "path", F.posexplode("rows").alias("at", "row"))
        return rows.select("row", "above", F.concat(_flanks(F.col("at")), "path").alias("path"))


def build_forest(nodes: DataFrame) -> Forest:
    """Trees over nodes (group, pos, n, hash, row): one per group, leaves by pos, n of them."""
    held = nodes.groupBy("group", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "hash", "row"))).alias("__nodes"))
    blocks = held.select("group", "block", _height(F.col("n")).alias("height"), F.array_join("__nodes.hash", "").alias("level0"), F.col("__nodes.row").alias("rows"))
    rounds = []
    while True:
        r = len(rounds)
        steps = F.greatest(F.lit(0), F.least(F.lit(STEPS), F.col("height") - STEPS * r))
        blocks = blocks.withColumn("steps", steps).withColumn("level1", F.when(F.col("steps") > 0, _parents(F.col("level0"))))
        top = F.when(F.col("steps") == 2, _parents(F.col("level1"))).otherwise(F.coalesce("level1", "level0"))
        rounds.append(saved(blocks.withColumn("top", top), f"merkle-{r}"))
        left = rounds[-1].where(f"height > {STEPS * (r + 1)}")
        if left.isEmpty():
            return Forest(rounds)
        held = left.groupBy("group", F.floor(F.col("block") / BLOCK).alias("up")).agg(F.max("height").alias("height"), F.array_sort(F.collect_list(F.struct("block", "top"))).alias("__nodes"))
        blocks = held.select("group", F.col("up").alias("block"), "height", F.array_join("__nodes.top", "").alias("level0"))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path of siblings give."""
    return F.aggregate(path, leaf, lambda node, x: F.sha2(F.concat(x["left"], node, x["right"]), 256))


def merkle_manifest(rows: DataFrame, key: str = "doc_id", group: str = "source", leaf: str = "leaf", keep: list[str] | None = None) -> DataFrame:
    """(the columns in keep, subroot, root, path) of every row; keep is by default key, group and leaf.

    path holds the siblings left and right of the row's node, level by level from its leaf to the root; a level
    without siblings has two empty strings. Null groups are one group and come first, others follow bytewise; within a
    group null keys come first, and rows with one key ascend by leaf. Repeated rows are leaves of their own.
    An empty table has no rows and no root. Other columns are left out; those in keep that are called like
    an added one are given in its place.
    """
    spark, keep = rows.sparkSession, keep or [key, group, leaf]
    named = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaves = saved(rows.select(named.alias("group"), F.col(key).alias("key"), F.col(leaf).alias("hash"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")), "leaves")
    forest = build_forest(numbered(leaves, "group", ["key", "hash"]))
    subroots = forest.roots().select(F.lit(0).alias("all"), F.col("group"), F.col("root").alias("hash"))
    ranked = numbered(saved(subroots, "subroots"), "all", ["group"]).select(F.col("all").alias("group"), "pos", "n", "hash", F.struct("group", "hash").alias("row"))
    upper = build_forest(ranked)
    root = upper.roots().first()  # one row, of one hash
    nothing = spark.range(1).select(F.lit(0).alias("group"), F.lit("").alias("above"), F.array().cast(FLANKS).alias("path"))
    above = saved(upper.proofs(nothing).select("row.group", F.col("row.hash").alias("above"), "path"), "subroot-proofs")
    out = forest.proofs(above)
    drop_saved(leaves)
    added = {"subroot": F.col("above"), "root": F.lit(root and root["root"]).cast("string"), "path": F.col("path")}
    return out.select(*[F.col(f"row.`{c}`") for c in keep if c not in added], *[x.alias(c) for c, x in added.items()])


def op11_merkle(spark, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and what a text lower-cased after the manifest was made gives."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    parts = ["doc_id", "source", "lang", "n_chars"]
    changed = leaf_hash(*map(F.col, parts), F.translate("text", capitals, capitals.lower()))
    leaf = leaf_hash(*map(F.col, parts), F.col("text"))
    rows = docs.select("doc_id", "source", leaf.alias("leaf"), F.when(~training_rows(F.col("doc_id")), changed).alias("changed"))
    out = merkle_manifest(rows, keep=["doc_id", "leaf", "changed"])
    proof = F.sha2(F.array_join(F.transform("path", lambda x: F.concat(x["left"], x["right"])), ""), 256)
    again = out.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root"))
    return again.withColumn("verified", F.col("folded_root") == F.col("root"))
