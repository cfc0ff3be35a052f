"""Periodic runs of words, by recompression.

A run is a stretch of words that repeats with its smallest period q at least EXPONENT times, is at least LEAST words
long, and can't be extended. The equality w[i] = w[i + q] then holds for at least 3 q places in a row (5, if q is 1), so
it holds at three multiples of q in a row: the harmonic grid, n / q places for each q. Where it does, the grid place
is a candidate, and how far the equality goes to both sides is asked of a grammar.

The grammar comes from recompression of the words: blocks of one symbol become a symbol (block compression), then
symbols are dealt to a left and a right half, and each pair of a left and then a right one becomes a symbol (pair
compression), in turn, until no symbol is left twice. What equal words become depends on themselves and their
neighbours alone, so two equal stretches have equal symbols but near their ends, and a common extension climbs the
levels while both sides begin a symbol, and comes down where symbols differ: a few steps a level. All candidates
take these steps at once, as arrays. Words are named per document, and a symbol of its own stands at both ends
of each document, so no extension leaves one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostrata.llm.common import mixed, small_batches

EXPONENT, LEAST = 4, 6
#: Words of documents taken together, one document at least, and candidates asked at once.
CHUNK_WORDS, CHUNK_CANDIDATES = 1 << 19, 1 << 18
#: Ways of dealing symbols to halves that are tried at each level; the one with most pairs is taken.
DEALS = 4
RUNS = "array<struct<start:long,length:long,period:long>>"


@dataclass
class Level:
    """One level: its symbols, and how they are made of those below and are parts of those above. Arrays by place in the level; begins, ends: is it its parent's first, last part."""

    symbol: np.ndarray
    first: np.ndarray | None = None  # places in the level below
    last: np.ndarray | None = None
    parent: np.ndarray | None = None
    begins: np.ndarray | None = None
    ends: np.ndarray | None = None
    onward: np.ndarray | None = None  # equal symbols from here to the end of the block, and from its beginning to here
    backward: np.ndarray | None = None


def _grouped(level: Level, starts: np.ndarray) -> Level:
    """The level above, whose symbols begin at starts; level learns its parents."""
    n = len(level.symbol)
    level.begins = np.zeros(n, bool)
    level.begins[starts] = True
    level.parent = np.cumsum(level.begins) - 1
    level.ends = np.append(level.begins[1:], True)
    return Level(np.empty(0, np.int64), first=starts, last=np.flatnonzero(level.ends))


def _blocks(level: Level) -> Level:
    """Block compression: (symbol, length) of each block gets a name."""
    s = level.symbol
    above = _grouped(level, np.flatnonzero(np.append(True, s[1:] != s[:-1])))
    at = np.arange(len(s))
    level.onward, level.backward = above.last[level.parent] - at + 1, at - above.first[level.parent] + 1
    length = above.last - above.first + 1
    above.symbol = s[above.first].copy()
    if (long := np.flatnonzero(length > 1)).size:
        key = above.symbol[long] * (len(s) + 1) + length[long]
        above.symbol[long] = s.max() + 1 + np.unique(key, return_inverse=True)[1]
    return above


def _pairs(level: Level, seed: int) -> Level:
    """Pair compression, of symbols that differ from their neighbours."""
    s = level.symbol
    level.onward = level.backward = np.ones(len(s), np.int64)
    best = np.zeros(len(s), bool)
    for k in range(DEALS):
        left = (mixed(s.astype(np.uint64) + np.uint64((seed * DEALS + k + 1) << 40)) >> np.uint64(63)).astype(bool)
        second = np.append(False, left[:-1] & ~left[1:])
        if second.sum() > best.sum():
            best = second
    above = _grouped(level, np.flatnonzero(~best))
    above.symbol = s[above.first].copy()
    if (two := np.flatnonzero(above.last > above.first)).size:
        key = s[above.first[two]] * (s.max() + 1) + s[above.last[two]]
        above.symbol[two] = s.max() + 1 + np.unique(key, return_inverse=True)[1]
    return above


def recompress(symbols: np.ndarray) -> list[Level]:
    """The levels of the grammar of symbols, from these up to one in which none comes twice. symbols are at least 0 and less than 2**31 times their number."""
    levels, seed = [Level(symbols.astype(np.int64))], 0
    while True:
        top = levels[-1]
        names, again = np.unique(top.symbol, return_inverse=True)
        if len(names) == len(top.symbol):
            top.onward = top.backward = np.ones(len(names), np.int64)
            return levels
        top.symbol = again.ravel()  # names stay dense, so that a pair of them fits 64 bits
        if len(levels) % 2:
            levels.append(_blocks(top))
        else:
            levels.append(_pairs(top, seed))
            seed += 1


def extension(levels: list[Level], x: np.ndarray, y: np.ndarray, forward: bool) -> np.ndarray:
    """For each pair of places, how many symbols from there on (or backwards, those places included) are equal. No stretch may reach an end of the text; places of a pair differ."""
    step = 1 if forward else -1
    x, y, origin = x.copy(), y.copy(), x
    at_level = np.full(len(x), len(levels) - 1)
    going = np.arange(len(x))
    for k, level in enumerate(levels[:-1]):  # up
        edge, run = (level.begins, level.onward) if forward else (level.ends, level.backward)
        risen, asking = [], going
        while asking.size:
            a, b = x[asking], y[asking]
            both = edge[a] & edge[b]
            risen.append(asking[both])
            asking, a, b = asking[~both], a[~both], b[~both]
            same = level.symbol[a] == level.symbol[b]
            at_level[asking[~same]] = k
            asking, a, b = asking[same], a[same], b[same]
            jump = step * np.minimum(run[a], run[b])
            x[asking], y[asking] = a + jump, b + jump
        going = np.concatenate(risen) if risen else going
        x[going], y[going] = level.parent[x[going]], level.parent[y[going]]
    for k in range(len(levels) - 1, -1, -1):  # down, each from where it stopped
        level = levels[k]
        run = level.onward if forward else level.backward
        down = np.flatnonzero(at_level >= k)
        asking = down
        while asking.size:
            a, b = x[asking], y[asking]
            same = level.symbol[a] == level.symbol[b]
            asking, a, b = asking[same], a[same], b[same]
            jump = step * np.minimum(run[a], run[b])
            x[asking], y[asking] = a + jump, b + jump
        if k:
            part = level.first if forward else level.last
            x[down], y[down] = part[x[down]], part[y[down]]
    return (x - origin) * step


class _Grammar:
    """The grammar of some documents of a chunk, one after another; their words get names of their own, and marks that come once stand between them."""

    def __init__(self, words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, needed: np.ndarray):
        doc = np.repeat(np.arange(len(needed)), lengths[needed])
        self.needed, self.starts = needed, starts[needed]
        self.begins = np.cumsum(lengths[needed]) - lengths[needed]
        own = words[np.arange(len(doc)) + (self.starts - self.begins)[doc]]
        names = np.unique(doc * (own.max() + 1) + own, return_inverse=True)[1].ravel()
        marks = names.max() + 1 + np.arange(len(needed) + 1)
        self.levels = recompress(np.append(np.insert(names, self.begins, marks[:-1]), marks[-1]))

    def place(self, place: np.ndarray) -> np.ndarray:
        doc = np.searchsorted(self.starts, place, "right") - 1
        return place - self.starts[doc] + self.begins[doc] + doc + 1


def _candidates(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, known: "_Known") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, periods): grid places of each document with w[i] = w[i + q] there and at the next two.

    Documents come by falling length, so those that are long enough for a period are a prefix. Candidates whose run is known are left out.
    """
    places, periods, held = [], [], 0
    long = len(lengths)
    for q in range(1, int(lengths[0]) // EXPONENT + 1):
        while lengths[long - 1] < max(LEAST, EXPONENT * q):
            long -= 1
        if long == 1:
            equal = (w := words[starts[0] : starts[0] + lengths[0] : q])[1:] == w[:-1]
        else:  # the multiples of q of all documents, one after another
            counts = (lengths[:long] - 1) // q + 1
            ends = np.cumsum(counts)
            grid = np.repeat(starts[:long] - (ends - counts) * q, counts) + np.arange(ends[-1]) * q
            equal = (w := words[grid])[1:] == w[:-1]
            equal[ends[:-1] - 1] = False  # these two are of different documents
        hit = np.flatnonzero(equal[:-2] & equal[1:-1] & equal[2:])
        if hit.size:
            place = known.unknown(starts[0] + hit * q if long == 1 else grid[hit], q)
            places.append(place)
            periods.append(np.full(place.size, q))
            held += place.size
        if held >= CHUNK_CANDIDATES:
            yield np.concatenate(places), np.concatenate(periods)
            places, periods, held = [], [], 0
    if held:
        yield np.concatenate(places), np.concatenate(periods)


class _Known:
    """Runs found so far, as rows (begin, end, period) of places in the chunk."""

    def __init__(self):
        self.runs = np.empty((0, 3), np.int64)

    def add(self, runs: np.ndarray) -> None:
        runs = np.concatenate([self.runs, runs])
        self.runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]

    def unknown(self, place: np.ndarray, q: int) -> np.ndarray:
        """Places but those that lie, with the one q on, in the run that begins last before them, if its period divides q: they would give that stretch again."""
        if not len(self.runs):
            return place
        at = np.searchsorted(self.runs[:, 0], place, "right") - 1
        begin, end, period = self.runs[np.maximum(at, 0)].T
        return place[(at < 0) | (place + q >= end) | (q % period != 0)]


def runs_of(texts: list[np.ndarray]) -> list[np.ndarray]:
    """For each sequence of word numbers, its runs as rows (start, length, period), by start, then period."""
    out = [np.empty((0, 3), np.int64)] * len(texts)
    sizes = np.array([len(x) for x in texts], np.int64)
    order = [k for k in np.argsort(-sizes, kind="stable") if sizes[k] >= LEAST]
    if not order:
        return out
    lengths = sizes[order]
    starts = np.cumsum(lengths) - lengths
    words = np.concatenate([texts[k] for k in order])
    grammar, known, rows = None, _Known(), []
    for place, period in _candidates(words, starts, lengths, known):
        doc = np.searchsorted(starts, place, "right") - 1
        if grammar is None or not np.isin(doc, grammar.needed).all():
            grammar = _Grammar(words, starts, lengths, np.union1d(doc, [] if grammar is None else grammar.needed).astype(np.int64))
        x = grammar.place(place)
        right = extension(grammar.levels, x, x + period, True)
        back = extension(grammar.levels, x, x + period, False) - 1  # the place itself counts in both
        good = right + back + period >= np.maximum(LEAST, EXPONENT * period)
        found = np.stack([place - back, place + right + period, period, doc], axis=1)[good]
        found = found[np.lexsort(found.T)]
        found = found[np.append(True, (found[1:] != found[:-1]).any(axis=1))[: len(found)]]
        rows.append(found)
        known.add(found[:, :3])
    if not sum(map(len, rows)):
        return out
    rows = np.concatenate(rows)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    rows = rows[np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1))]  # of one stretch, the smallest period
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    begins = np.flatnonzero(np.append(True, rows[1:, 3] != rows[:-1, 3]))
    for a, b in zip(begins, [*begins[1:], len(rows)], strict=True):
        first, end, period, doc = rows[a:b].T
        out[order[doc[0]]] = np.stack([first - starts[doc], end - first, period], axis=1)
    return out


def _numbers(chunk: list[list[bytes]]) -> list[np.ndarray]:
    """Words as numbers, equal for equal words of the chunk."""
    every = [w for words in chunk for w in words]
    known = dict(zip(dict.fromkeys(every), range(len(every)), strict=False))
    numbers = np.fromiter(map(known.__getitem__, every), np.int64, len(every))
    return np.split(numbers, np.cumsum([len(words) for words in chunk])[:-1])


def _collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words without those that a run holds after its first period, joined by one space."""
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0)])


def _chunks(texts: pa.Array) -> Iterator[list[list[bytes]]]:
    """Words of each text, in lists of at most CHUNK_WORDS words and at least one text."""
    held, size = [], 0
    for x in texts:
        words = (x.as_py() or "").encode().split()  # of bytes, so at these six bytes alone
        if held and size + len(words) > CHUNK_WORDS:
            yield held
            held, size = [], 0
        held.append(words)
        size += len(words)
    if held:
        yield held


def periodic_runs(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs' columns in keep (all, if None) with n_words, runs (start, length, period) and collapsed.

    Words are what stands between bytes 9 to 13 and 32, counted from 0. runs go by start, then period; collapsed are the words that no run
    holds after its first period, joined by one space. Null and empty texts have no words, no runs and an empty
    collapsed text. Texts are taken whole, however long; repeated rows are each judged alone, alike. Columns
    called like an added one are given in its place; null in other columns is kept; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    added = "n_words long, runs " + RUNS + ", collapsed string"
    kept = [x for x in (docs.columns if keep is None else keep) if x not in ("n_words", "runs", "collapsed")]
    rows = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(text).cast("string").alias("text"))
    shape = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for chunk in _chunks(batch.column(1)):
                found = runs_of(_numbers(chunk))
                ends = np.cumsum([0, *map(len, found)])
                every = np.concatenate(found)
                parts = pa.StructArray.from_arrays([pa.array(every[:, k]) for k in range(3)], fields=list(shape.value_type))
                text = [_collapsed(words, x).decode() if len(x) else b" ".join(words).decode() for words, x in zip(chunk, found, strict=True)]
                columns = [batch.column(0).slice(at, len(chunk)), pa.array([len(x) for x in chunk], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts), pa.array(text, pa.large_string()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "n_words", "runs", "collapsed"])
                at += len(chunk)

    out = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, {added}")
    return out.select(*[F.col(f"row.`{c}`") for c in kept], "n_words", "runs", "collapsed")


def _with_loops(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in a tenth of the documents, by their id's checksum, the words from one place on repeat the first p of them."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    some = F.when(h % 10 == 0, words)
    rows = docs.select("doc_id", "text", some.alias("w"), F.floor(h / 10).alias("g")).withColumn("n", F.size("w"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", F.when(F.col("n") > 0, 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))))
    a, p = F.col("a"), F.col("p")
    turned = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.element_at("w", (F.when(i < a, i).otherwise(a + (i - a) % p) + 1).cast("int")))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(turned, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic(spark, sf_dir: str) -> DataFrame:
    """Number of runs, the longest one, and digests of all runs and of the collapsed text of every document."""
    out = periodic_runs(_with_loops(spark.read.parquet(f"{sf_dir}/documents.parquet")), keep=["doc_id"])
    order = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("size"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *[r[x].cast("string") for x in ("start", "length", "period")])), "\n")
    digest = F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")), 256)
    rows = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), order.alias("top"), digest.alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length = -F.col("top.size")
    return rows.select("doc_id", "n_runs", F.col("top.start").alias("start"), length.alias("length"), F.col("top.period").alias("period"), F.floor(1000 * length / F.col("top.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
