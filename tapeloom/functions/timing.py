"""Seconds from the start of a recording."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_ts(seconds: Column | str) -> Column:
    """mm:ss.t of seconds: below zero as zero, tenths cut off, minutes that begin anew every hour."""
    given = (F.col(seconds) if isinstance(seconds, str) else seconds).cast("double")
    s = F.greatest(given, F.lit(0.0))
    whole = F.floor(s)
    tenths = F.floor((s - whole) * 10 + 1e-9)
    out = F.format_string("%02d:%02d.%d", F.floor(whole % 3600 / 60), whole % 60, tenths)
    return F.when(given.isNotNull(), out)


def midpoint(start: Column | str = "start_s", end: Column | str = "end_s") -> Column:
    c = [F.col(x) if isinstance(x, str) else x for x in (start, end)]
    return (c[0] + c[1]) / 2.0
