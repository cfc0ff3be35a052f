"""MinHash near-duplicates: one-permutation hashing with optimal densification, banded buckets, star-shaped edges.

A document's shingles are hashed once; the hash's top bits choose a bin and the smallest hash of a bin is its
value. An empty bin borrows from the first filled bin in its own fixed random order, which keeps the chance
that two documents agree in a bin equal to their similarity. Bins are cut into bands; documents that agree in
a band share a bucket. A bucket's edges form a star around its smallest document, so candidates grow with the
rows, not with the square of a bucket. A candidate whose sizes or whose bins rule the threshold out goes; the
others are confirmed on full shingle sets. Documents with equal sets are one node from the start.

A bucket whose ends do not all reach its smallest document stays open: its members outside that document's
component still have to meet all members of other components. The documents of open buckets form families by the smallest
document within two open buckets of theirs, families that meet in an open bucket form blocks,
and a block is cut into tiles of bounded size, so that a document travels with its set once a tile and not once
a bucket. In a tile the bins rule out what they can, the sets decide the rest, and only links between components
that are still apart leave it. So every pair of a bucket is tried, ruled out, or joined otherwise, and no list
of a group's pairs is ever made.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostrata.llm.common import connected_components, drop_saved, mixed, saved, small_batches, tidy, window_hashes, with_maybe, word_hashes

SHINGLE, THRESHOLD = 5, 75
BINS, BAND_ROWS = 256, 5
BANDS = BINS // BAND_ROWS
#: Ends of a star that meet its hub in one task; shingles, at least LEAST_WEIGHT a document, of those that meet others in a tile and of all in it.
STAR, TILE_HUBS, TILE_MEMBERS, LEAST_WEIGHT = 1000, 1 << 19, 1 << 20, 64
#: Standard deviations by which the bins that agree may fall short of the threshold: 1e-9 of the pairs at the threshold fall short by more.
DEVIATIONS = 6.0


@functools.cache
def _orders() -> np.ndarray:
    """Each bin's own random order of the others to borrow from."""
    rng = np.random.default_rng(2017)
    return np.array([rng.permutation(BINS) for _ in range(BINS)])


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; of all its words as one, if they are fewer than width."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return mixed(window_hashes(word_hashes().of(words), len(words)) + np.uint64(len(words)))
    return np.unique(window_hashes(word_hashes().of(words), width))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The bins' values for sorted distinct hashes, at least one."""
    begins = np.arange(BINS, dtype=np.uint64) << np.uint64(56)
    at = np.minimum(np.searchsorted(hashes, begins), len(hashes) - 1)
    filled = (hashes[at] >> np.uint64(56)) == np.arange(BINS, dtype=np.uint64)
    empty = np.flatnonzero(~filled)
    if len(empty):
        order = _orders()[empty]
        at[empty] = at[order[np.arange(len(empty)), np.argmax(filled[order], axis=1)]]
    return hashes[at]


def bands(values: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of a signature."""
    rows = values[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(BAND_ROWS):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return out


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("same", pa.binary()), ("bins", pa.binary()), ("bands", pa.list_(pa.int64()))])
    for batch in batches:
        for at in range(0, len(batch), 256):
            some, rows = batch.slice(at, 256), []
            for text in some["text"].to_pylist():
                h = shingles(text)
                if len(h):
                    values = signature(h)
                    rows.append((len(h), xxhash.xxh3_128_digest(h.tobytes()), (values & np.uint64(255)).astype(np.uint8).tobytes(), bands(values).view(np.int64)))
                else:
                    rows.append((0, None, None, None))
            n, same, bins, keys = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([some["doc"], pa.array(n, pa.int64()), pa.array(same, pa.binary()), pa.array(bins, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], schema=schema)
    tidy()


def least_agreement(n: np.ndarray, threshold: int) -> np.ndarray:
    """The least number of bins in which documents of at least n shingles agree if their similarity reaches the threshold, DEVIATIONS allowed for.

    Of BINS bins about BINS * (1 - exp(-n / BINS)) are filled by themselves; borrowed values add nothing and weigh
    some values more than others, which leaves at least 0.8 of that as independent trials.
    """
    share = threshold / 100
    trials = 0.8 * BINS * (1 - np.exp(-np.maximum(n, 1) / BINS))
    return np.maximum(0, np.ceil(BINS * (share - DEVIATIONS * np.sqrt(share * (1 - share) / trials))))


def _binary_rows(column: pa.Array) -> np.ndarray:
    """The entries of a binary column, all of BINS bytes, as rows."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BINS)


def _agreeing(threshold: int):
    """Keeps the pairs whose bins do not rule the threshold out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if len(x):
                agree = (_binary_rows(x["bins_a"]) == _binary_rows(x["bins_b"])).sum(1)
                n = np.minimum(x["n_a"].to_numpy(), x["n_b"].to_numpy())
                yield x.select(["hub", "end", "size"]).filter(pa.array(agree >= least_agreement(n, threshold)))

    return run


def _confirmed(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, None
        for batch in batches:
            for at in range(0, len(batch), 256):
                x, links = batch.slice(at, 256), []
                for a, b, text_a, text_b in zip(*(x[c].to_pylist() for c in ("hub", "end", "text_hub", "text_end")), strict=True):
                    if a != last:
                        last, known = a, shingles(text_a)
                    other = shingles(text_b)
                    both = len(np.intersect1d(known, other, assume_unique=True))
                    if 100 * both >= threshold * (len(known) + len(other) - both):
                        links.append((a, b))
                a, b = zip(*links, strict=True) if links else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        tidy()

    return run


def _maybe_in(rows: DataFrame, ids: DataFrame, by: str = "doc") -> DataFrame:
    """rows without most of those whose `by` is not in ids, written, or the optimiser would move the exact join that follows before this filter."""
    return saved(with_maybe(rows, ids, by).where("maybe").drop("maybe"), "maybe-in")


TILE_KEY, TILE_ROW = ["f1", "f2", "i", "j"], ["side", "role", "doc", "part"]
#: Bits of a row's role in a tile: it is met, it meets others.
MET, MEETS = 1, 2


def _tiles(who: DataFrame, blocks: DataFrame) -> DataFrame:
    """Documents by tile (f1, f2, i, j). who: (doc, n, part, hub, family); blocks: (f1, f2), f1 <= f2."""
    weight = F.greatest("n", F.lit(LEAST_WEIGHT))
    sizes = who.groupBy("family").agg(F.sum(weight).alias("all"), F.sum(F.when(F.col("hub"), weight).otherwise(0)).alias("hubs"))
    for f in ("f1", "f2"):
        blocks = blocks.join(sizes.select(F.col("family").alias(f), F.col("all").alias(f"all_{f}"), F.col("hubs").alias(f"hubs_{f}")), f)
    same = F.col("f1") == F.col("f2")
    total = lambda c: F.col(f"{c}_f1") + F.when(same, 0).otherwise(F.col(f"{c}_f2"))
    blocks = blocks.select("f1", "f2", F.greatest(F.lit(1), F.ceil(total("hubs") / TILE_HUBS)).cast("int").alias("tall"), F.greatest(F.lit(1), F.ceil(total("all") / TILE_MEMBERS)).cast("int").alias("wide"))
    sided = blocks.select(F.col("f1").alias("family"), F.lit(0).alias("side"), "f1", "f2", "tall", "wide").union(blocks.where(~same).select("f2", F.lit(1), "f1", "f2", "tall", "wide"))
    deal = lambda salt, n: F.pmod(F.xxhash64("doc", F.lit(salt)), n).cast("int")
    rows = who.join(sided, "family").withColumn("i0", deal(1, F.col("tall"))).withColumn("j0", deal(2, F.col("wide")))
    met = F.transform(F.sequence(F.lit(0), F.col("tall") - 1), lambda i: F.struct(i.alias("i"), F.col("j0").alias("j"), F.lit(MET).alias("role")))
    meets = F.transform(F.sequence(F.lit(0), F.col("wide") - 1), lambda j: F.struct(F.col("i0").alias("i"), j.alias("j"), F.lit(MEETS).alias("role")))
    crossing = F.struct(F.col("i0").alias("i"), F.col("j0").alias("j"), F.lit(MET + MEETS).alias("role"))
    others = lambda cells: F.filter(cells, lambda c: (c["i"] != F.col("i0")) | (c["j"] != F.col("j0")))
    cells = rows.withColumn("cell", F.explode(F.when(F.col("hub"), F.concat(others(met), others(meets), F.array(crossing))).otherwise(met)))
    return cells.select("f1", "f2", "cell.i", "cell.j", "side", "cell.role", "doc", "part")


def _links_of_tile(t: dict[str, np.ndarray], bins: np.ndarray, sets: list[np.ndarray], threshold: int, within: bool) -> list[tuple[int, int]]:
    """Links between documents of a tile, one for every two components that they join."""
    doc, side, label = t["doc"], t["side"], t["part"].copy()
    hub, end = np.flatnonzero(t["role"] & MEETS), np.flatnonzero(t["role"] & MET)
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    least = least_agreement(n, threshold)
    also_hub = (t["role"][end] & MEETS) != 0
    postings = None
    out = []
    for u in hub.tolist():
        able = (label[end] != label[u]) & (100 * np.minimum(n[end], n[u]) >= threshold * np.maximum(n[end], n[u]))
        able &= ~also_hub | (doc[end] > doc[u])
        if not within:
            able &= side[end] != side[u]
        x = end[able]
        if len(x):
            x = x[(bins[x] == bins[u]).sum(1) >= np.minimum(least[x], least[u])]
        if not len(x):
            continue
        if len(x) > 8:
            if postings is None:
                owner = np.repeat(end, n[end])
                flat = np.concatenate([sets[k] for k in end.tolist()])
                order = np.argsort(flat, kind="stable")
                postings = flat[order], owner[order]
            low, high = np.searchsorted(postings[0], sets[u], "left"), np.searchsorted(postings[0], sets[u], "right")
            size = high - low
            at = np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            both = np.bincount(postings[1][at], minlength=len(n))[x]
        else:
            both = np.array([len(np.intersect1d(sets[u], sets[k], assume_unique=True)) for k in x.tolist()])
        for k in x[100 * both >= threshold * (n[x] + n[u] - both)].tolist():
            if label[k] != label[u]:
                out.append((int(doc[u]), int(doc[k])))
                label[label == label[k]] = label[u]
    return out


def _met_in_tiles(threshold: int):
    """Links of every tile; rows come sorted by tile, and one tile is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None

        def answer() -> pa.RecordBatch:
            t = {c: np.concatenate([x[c].to_numpy() for x in held]) for c in TILE_ROW}
            bins = np.concatenate([_binary_rows(x["bins"]) for x in held])
            sets = [np.frombuffer(v, np.uint64) for x in held for v in x["set"].to_pylist()]
            links = _links_of_tile(t, bins, sets, threshold, at[0] == at[1])
            a, b = zip(*links, strict=True) if links else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            if not len(batch):
                continue
            keys = np.stack([batch[c].to_numpy().astype(np.int64) for c in TILE_KEY], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(batch)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and tuple(keys[a]) != at:
                    yield answer()
                    held = []
                at = tuple(keys[a].tolist())
                held.append(batch.slice(a, b - a))
        if held:
            yield answer()
        held.clear()
        tidy()

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, bins, set) of each text: its distinct shingles' hashes in order."""
    for batch in batches:
        for at in range(0, len(batch), 256):
            some, rows = batch.slice(at, 256), []
            for text in some["text"].to_pylist():
                h = shingles(text)
                rows.append(((signature(h) & np.uint64(255)).astype(np.uint8).tobytes(), h.tobytes()) if len(h) else (None, None))
            bins, sets = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([some["doc"], pa.array(bins, pa.binary()), pa.array(sets, pa.binary())], names=["doc", "bins", "set"])
    tidy()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """(doc, n, component): each row's key, the size of its shingle set and the smallest key that links reach.

    Words are runs of anything but blanks and 0x09 to 0x0D, with A-Z in lower case. Two documents are
    linked if 100 * intersection >= threshold * union of their sets of distinct shingles. Null or empty
    texts and texts without words have an empty set and link with nothing. A null key's row links with
    nothing and has a null component. Rows that repeat a key must repeat its text; each keeps its row.
    A very long text is read whole, by one task, and counts by its distinct shingles like any other.
    Other columns are left out, whatever their names. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    sketch = saved(rows.mapInArrow(_sketches, "doc long, n long, same binary, bins binary, bands array<long>"), "sketch")
    heads = sketch.where("n > 0 and doc is not null").groupBy("same").agg(F.min(F.struct("doc", "n", "bins", "bands")).alias("h"))
    heads = saved(heads.select("same", "h.*"), "heads")
    bins = heads.select("doc", "n", "bins")
    near_size = lambda a, b: 100 * F.least(a, b) >= threshold * F.greatest(a, b)

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The links among pairs (hub, end, size), size being the ends that the hub may have here. A hub's text goes to one task for every STAR ends."""
        ids = pairs.select(F.col("hub").alias("doc")).union(pairs.select("end")).distinct()
        maybe = _maybe_in(rows.where("doc is not null"), ids)
        slots = F.ceil(F.col("size") / STAR)
        hubs = pairs.groupBy("hub").agg(F.max(slots).alias("slots"))
        hub_text = maybe.withColumnRenamed("doc", "hub").dropDuplicates(["hub"]).join(hubs.hint("merge"), "hub").select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)).alias("slot"), F.col("text").alias("text_hub"))
        end_text = maybe.dropDuplicates(["doc"]).select(F.col("doc").alias("end"), F.col("text").alias("text_end"))
        asked = pairs.select("hub", "end", F.pmod(F.xxhash64("end"), slots).alias("slot"))
        met = asked.join(end_text.hint("merge"), "end").join(hub_text.hint("merge"), ["hub", "slot"]).select("hub", "end", "text_hub", "text_end")
        out = saved(met.mapInArrow(_confirmed(threshold), "a long, b long"), "links")
        drop_saved(maybe)
        return out

    members = heads.select("doc", "n", F.explode("bands").alias("band"))
    buckets = members.groupBy("band").agg(F.min("doc").alias("first"), F.min_by("n", "doc").alias("n_first"), F.count("*").alias("size")).where("size > 1")
    shared = saved(members.join(saved(buckets, "buckets").hint("merge"), "band"), "shared")
    star = shared.where("first < doc").where(near_size(F.col("n_first"), F.col("n"))).groupBy(F.col("first").alias("hub"), F.col("doc").alias("end")).agg(F.max("size").alias("size"))
    a, b = (bins.select(F.col("doc").alias(x), F.col("n").alias(f"n_{y}"), F.col("bins").alias(f"bins_{y}")) for x, y in (("hub", "a"), ("end", "b")))
    star = saved(star.join(b.hint("merge"), "end").join(a.hint("merge"), "hub").mapInArrow(_agreeing(threshold), "hub long, end long, size long"), "pairs")
    links = confirmed(star)
    component = saved(connected_components(links), "components")

    part = lambda by, name: component.select(F.col("node").alias(by), F.col("component").alias(name))
    placed = shared.where("size > 2").join(part("doc", "part").hint("merge"), "doc", "left").join(part("first", "main").hint("merge"), "first", "left")
    placed = saved(placed.select("band", "doc", "n", "first", "size", F.coalesce("part", "doc").alias("part"), F.coalesce("main", "first").alias("main")), "placed")
    outside = F.when(F.col("part") != F.col("main"), F.col("part"))
    open_ = placed.groupBy("band").agg(F.count(outside).alias("outside"), F.min(outside).alias("low"), F.max(outside).alias("high"), F.max("size").alias("size"))
    open_ = saved(open_.where("outside > 0 and (outside < size - 1 or low < high)").select("band"), "open")  # else its first has met all others
    left = _maybe_in(placed, open_, "band").join(open_.hint("merge"), "band", "left_semi")
    left = saved(left.select("band", "doc", "n", "first", "part", (F.col("part") != F.col("main")).alias("hub")), "left-over")
    if not left.isEmpty():
        who = saved(left.groupBy("doc").agg(F.min("first").alias("near"), F.max("hub").alias("hub"), F.min("n").alias("n"), F.min("part").alias("part")), "families")
        reach = saved(left.select("band", "doc").join(who.select("doc", "near").hint("merge"), "doc").groupBy("band").agg(F.min("near").alias("far")), "reach")
        family = left.select("band", "doc").join(reach.hint("merge"), "band").groupBy("doc").agg(F.min("far").alias("family"))
        who = saved(who.drop("near").join(family.hint("merge"), "doc"), "families")
        there = saved(left.select("band", "doc", "hub").join(who.select("doc", "family").hint("merge"), "doc").groupBy("band", "family").agg(F.max("hub").alias("hub")), "meetings")
        meet = there.where("hub").select("band", F.col("family").alias("g")).join(there.select("band", F.col("family").alias("f")).hint("merge"), "band")
        blocks = saved(meet.select(F.least("f", "g").alias("f1"), F.greatest("f", "g").alias("f2")).distinct(), "blocks")
        texts = _maybe_in(rows.where("doc is not null"), who.select("doc")).dropDuplicates(["doc"])
        sets = saved(texts.mapInArrow(_sets, "doc long, bins binary, set binary"), "sets")
        dealt = _tiles(who, blocks).join(sets.hint("merge"), "doc").repartition(*TILE_KEY).sortWithinPartitions(*TILE_KEY)
        more = saved(dealt.select(*TILE_KEY, *TILE_ROW, "bins", "set").mapInArrow(_met_in_tiles(threshold), "a long, b long"), "links")
        if not more.isEmpty():
            component = saved(connected_components(links.union(more)), "components")
        drop_saved(sets)
    by_set = heads.select("same", "doc").join(component.withColumnRenamed("node", "doc"), "doc", "left").select("same", F.coalesce("component", "doc").alias("component"))
    by_set = saved(by_set, "by-set")
    out = sketch.where("same is not null").select("doc", "n", "same").join(by_set, "same", "left").select("doc", "n", "component").union(sketch.where("same is null").select("doc", "n", F.lit(None).cast("long")))
    return out.select("doc", "n", F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc")).alias("component"))


def op1_minhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), (F.col("doc") == F.col("component")).alias("kept"))
