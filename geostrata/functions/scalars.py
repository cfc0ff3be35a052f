"""Column functions: section keys, ids, sort keys, wavelets."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def line_key_to_inline(key: Column, origin: int = 300, step: int = 1) -> Column:
    """The inline number of line_<n>; null for another form."""
    n = F.regexp_extract(key, r"^line_(0|[1-9][0-9]*)$", 1)
    return F.when(n != "", F.lit(origin) + n.cast("int") * step)


def inline_to_line_key(inline: Column, origin: int = 300, step: int = 1) -> Column:
    """line_<n>; null where the inline is not on the step."""
    at = inline - origin
    return F.when((at >= 0) & (at % step == 0), F.concat(F.lit("line_"), F.floor(at / step).cast("string")))


def source_key(source_id: Column, inline: Column, section: Column) -> Column:
    return F.coalesce(source_id, F.format_string("inline_%d_section_%d", inline, section))


def physical_source(sha256: Column, section: Column, source: Column) -> Column:
    return F.when(F.coalesce(sha256, F.lit("")) != "", F.concat(F.lit("sha256:"), sha256, F.lit(":section:"), section.cast("string"))).otherwise(source)


def cluster_sort_key(cluster_id: Column) -> list[Column]:
    """Sort keys: numbers first by value, then other names."""
    number = cluster_id.try_cast("bigint")
    return [number.isNull().asc(), number.asc(), cluster_id.asc()]


def natural_key(text: Column, width: int = 20) -> Column:
    """text in lower case with each run of digits padded to the width, so that plain order is the natural order."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, width, "0")).otherwise(p)), "")


def ricker(freq: float, t: Column) -> Column:
    """Zero-phase wavelet of a peak frequency at time t."""
    a = F.pow(F.lit(math.pi * freq) * t, 2)
    return (1 - 2 * a) * F.exp(-a)

