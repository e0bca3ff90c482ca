"""Feeds that fall silent: heartbeats move their watermark on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import _free


def wall_clock(feed: DataFrame, ts: str, lag: str = "10 seconds", per_second: int = 1) -> DataFrame:
    """A stream of times `lag` before now, under the name ts."""
    rate = feed.sparkSession.readStream.format("rate").option("rowsPerSecond", per_second).load()
    return rate.select((F.col("timestamp") - F.expr(f"INTERVAL {lag}")).alias(ts))


def _random() -> Column:
    """Numbers from 1 to 2, of which the optimizer doesn't know that (of rand() itself it does)."""
    return F.rand() + 1


def with_heartbeats(feed: DataFrame, ts: str, watermark: str, beats: DataFrame | None = None) -> DataFrame:
    """feed with a watermark on ts that beats move on as well, so that with the `min` policy a silent feed holds no other one back and no row of any feed is given up for it.

    beats: a stream with the times ts up to which feed is known to be whole, by default the wall clock's; its rows only count for the watermark and are none of the result's.
    The result has its watermark: operators that take one get watermark=None. Rows that come in behind it are dropped as late ones, as of any feed.
    """
    kind = feed.schema[ts].dataType
    # marks and NULLs of beats hang on random columns, or filters above would be known to leave nothing of a batch of beats alone before its watermark is read
    beat, kept = _free("_beat", feed), _free("_kept", feed)
    beats = wall_clock(feed, ts) if beats is None else beats
    times = beats.select(*[(F.col(f"`{ts}`").cast(kind) if f.name == ts else F.when(_random() < 0, F.raise_error(F.lit("")).cast(f.dataType))).alias(f.name) for f in feed.schema], (_random() >= 0).alias(beat))
    both = feed.withColumn(beat, _random() < 0).unionByName(times).withWatermark(ts, watermark)
    # filters must not be pushed below the watermark, where they would take the beats away: none passes a random column that is read above it
    return both.withColumn(kept, _random() >= 0).where(~F.col(beat) & F.col(kept)).drop(beat, kept)
