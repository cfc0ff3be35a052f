"""Gap islands over a stream: a section may arrive in many files, in any order, and a late point may join two islands.

The state of one line of a section is its distinct places so far. Nothing is given out until the watermark has passed
the line's newest point, as until then a point may still come; then the line's islands are, once, and its state goes.
Points older than the watermark are left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "places array<long>, newest long"


def _middles(places: np.ndarray, max_gap: float) -> pd.DataFrame:
    """One row per island of ascending places: the one at half its size, and its first, last and size."""
    begins = np.flatnonzero(np.append(True, np.diff(places) > max_gap))
    ends = np.append(begins[1:], len(places))
    return pd.DataFrame({"middle": places[begins + (ends - begins) // 2], "first": places[begins], "last": places[ends - 1], "size": ends - begins})


def stream_islands(points: DataFrame, keys: list[str], along: str, max_gap: float = 10, time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """(keys, middle, first, last, size, time): the islands of `along` on each line of the stream of whole places, once its watermark has passed them.

    keys name a line, such as a section and the other axis; time is that of the line's newest point. For any order and
    split of the points, but those too late, the rows are those of the same points in a table. Rows without a place or a time are left out.
    """
    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    rows = points.where(F.col(along).isNotNull() & F.col(time).isNotNull()).withWatermark(time, late).select(*keys, F.col(along).cast("long").alias("place"), time)

    def step(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, newest = state.get if state.exists else ([], 0)
        if state.hasTimedOut:
            state.remove()
            found = _middles(np.asarray(held), max_gap)
            line = pd.DataFrame({k: [v] * len(found) for k, v in zip(keys, key, strict=True)})
            yield line.join(found).assign(**{time: pd.Timestamp(newest, unit="ms", tz="UTC")})
            return
        places, mark = [np.asarray(held, np.int64)], state.getCurrentWatermarkMs()
        for frame in frames:
            ms = np.array([int(t.timestamp() * 1000) for t in frame[time]], np.int64)
            places.append(frame["place"].to_numpy(np.int64)[ms >= mark])
            newest = max(newest, *ms[ms >= mark].tolist(), 0)
        if newest:
            state.update((np.unique(np.concatenate(places)).tolist(), newest))
            state.setTimeoutTimestamp(max(newest, mark + 1))

    out = ", ".join(f"{k} {kinds[k]}" for k in keys) + f", middle long, first long, last long, size long, {time} timestamp"
    return rows.groupBy(*keys).applyInPandasWithState(step, out, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def write_islands(points: DataFrame, keys: list[str], along: str, path: str, checkpoint: str, max_gap: float = 10, time: str = "ts", late: str = "10 minutes"):
    """Starts a query that appends stream_islands to Parquet files under path until all input at hand is read."""
    found = stream_islands(points, keys, along, max_gap, time, late)
    return found.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
