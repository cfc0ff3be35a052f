"""Training batches of an epoch by a seeded permutation that is computed per sample, so nothing is sorted and no shuffle is needed.

Samples have dense numbers from 0 (ranking.numbered). They are permuted by a Feistel network over a rectangle of
numbers just larger than the samples: a number is a row and a column, and rounds add to one what a hash of the other
says. Numbers beyond the samples are permuted on until they are within. Every epoch has its own permutation, the
same on any cluster and for any partitioning; the inverse gives the samples of one batch without the others.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS, WALKS = 4, 16


def sides(n: int) -> tuple[int, int]:
    """Rows and columns of the rectangle for n samples: less than its rows' number beyond n, so that walks are rare and short."""
    a = max(1, math.isqrt(n - 1) + 1 if n else 1)
    return a, max(1, -(-n // a))


def _added(other: Column, seed: int, epoch: int, k: Column) -> Column:
    """What round k adds: 48 bits of a hash."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}:{epoch}"), k.cast("string"), other.cast("string"))), 1, 12), 16, 10).cast("long")


def _permuted(x: Column, n: int, seed: int, epoch: int, back: bool) -> Column:
    a, b = sides(n)
    begin = F.struct(F.floor(x / b).cast("long").alias("r"), (x % b).cast("long").alias("c"), F.lit(False).alias("done"))

    def step(s: Column, i: Column) -> Column:
        k = i % ROUNDS
        k = F.lit(ROUNDS - 1) - k if back else k
        sign = -1 if back else 1
        r = F.when(k % 2 == 0, F.pmod(s["r"] + sign * _added(s["c"], seed, epoch, k), F.lit(a).cast("long"))).otherwise(s["r"])
        c = F.when(k % 2 == 1, F.pmod(s["c"] + sign * _added(s["r"], seed, epoch, k), F.lit(b).cast("long"))).otherwise(s["c"])
        done = (i % ROUNDS == ROUNDS - 1) & (r * b + c < n)
        return F.when(s["done"], s).otherwise(F.struct(r.alias("r"), c.alias("c"), done.alias("done")))

    lost = F.raise_error(F.lit("a permutation left its range; take another seed")).cast("long")
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS * WALKS - 1)), begin, step, lambda s: F.when(s["done"], s["r"] * b + s["c"]).otherwise(lost))


def position(sample: Column, n: int, seed: int, epoch: int) -> Column:
    """The place of a sample, of n, in an epoch."""
    return _permuted(sample, n, seed, epoch, back=False)


def sample_at(place: Column, n: int, seed: int, epoch: int) -> Column:
    """The sample at a place of an epoch."""
    return _permuted(place, n, seed, epoch, back=True)


def flipped(sample: Column, seed: int, epoch: int, share: float = 0.5) -> Column:
    """Whether a sample's image and label are both flipped in an epoch."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"flip:{seed}:{epoch}"), sample.cast("string"))), 1, 8), 16, 10).cast("long")
    return bits < int(share * 2**32)


def epoch_batches(samples: DataFrame, n: int, size: int, seed: int, epoch: int, number: str = "sample", shuffled: bool = True, flip: bool = True) -> DataFrame:
    """samples, numbered from 0 to n - 1, with batch, slot and flip: the epoch's permutation, or their own order as for validation. The last batch may be short."""
    place = position(F.col(number), n, seed, epoch) if shuffled else F.col(number).cast("long")
    told = flipped(F.col(number), seed, epoch) if flip else F.lit(False)
    out = samples.withColumn("__place", place)
    return out.withColumns({"batch": F.floor(F.col("__place") / size), "slot": (F.col("__place") % size).cast("int"), "flip": told}).drop("__place")


def batch_members(spark: SparkSession, n: int, size: int, seed: int, epoch: int, batch: int) -> DataFrame:
    """(sample, slot, flip) of one batch, computed from its places alone."""
    places = spark.range(batch * size, min(n, (batch + 1) * size)).select(F.col("id"), sample_at(F.col("id"), n, seed, epoch).alias("sample"))
    return places.select("sample", (F.col("id") - batch * size).cast("int").alias("slot"), flipped(F.col("sample"), seed, epoch).alias("flip"))


def joint_flip(batches: DataFrame, image: str, label: str, side: int) -> DataFrame:
    """batches with image and label, arrays in (x, z) order, both reversed along x where flip is true."""
    from geostrata.operators.labels import flip_x

    return batches.withColumns({c: F.when(F.col("flip"), flip_x(F.col(c), side)).otherwise(F.col(c)) for c in (image, label)})
