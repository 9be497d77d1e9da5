"""Time chunks of a recording and frame batches of a chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_SECONDS = 180
#: A remainder shorter than this gives no chunk of its own.
REMAINDER_SECONDS = 0.01
FRAMES_PER_SECOND = 2.0
FRAMES_PER_REQUEST = 15


def chunk_plan(df: DataFrame, duration: str = "duration_seconds", size: int = CHUNK_SECONDS) -> DataFrame:
    """Adds chunk_index, start_seconds, end_seconds: full chunks, then the remainder.

    A null, NaN, zero or negative duration, or a size of zero, gives no row.
    """
    if size <= 0:
        return df.limit(0).select("*", F.lit(0).cast("bigint").alias("chunk_index"), F.lit(0.0).alias("start_seconds"), F.lit(0.0).alias("end_seconds"))
    d = F.col(duration).cast("double")
    usable = df.where((d > 0) & ~F.isnan(d))
    full = F.floor(d / size)
    i = F.col("chunk_index")
    return (
        usable.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), full)).alias("chunk_index"))
        .where((i < full) | (d - full * size > REMAINDER_SECONDS))
        .withColumn("start_seconds", (i * size).cast("double"))
        .withColumn("end_seconds", F.when(i < full, (i + 1) * size).otherwise(d).cast("double"))
    )


def _rate(fps: float) -> Column:
    """The frame rate as it is kept: in single precision, widened."""
    return F.lit(float(fps)).cast("float").cast("double")


def frame_batches(df: DataFrame, fps: float = FRAMES_PER_SECOND, per_request: int = FRAMES_PER_REQUEST, frames: str | None = None) -> DataFrame:
    """Adds batch, first_frame, frames and the global times of each request's batch of frames.

    The number of frames is the column ``frames``, or the chunk's length times the rate. A batch's end is cut at the
    chunk's end, its start is not. A chunk without frames gives no row.
    """
    rate = _rate(fps)
    n = F.col(frames) if frames else F.floor((F.col("end_seconds") - F.col("start_seconds")) * rate)
    b = F.col("batch")
    counted = df.withColumn("__n", n.cast("bigint")).where("__n > 0")
    out = counted.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__n") - 1) / per_request))).alias("batch"))
    return (
        out.withColumn("first_frame", b * per_request)
        .withColumn("frames", F.least(F.col("__n") - b * per_request, F.lit(per_request).cast("bigint")))
        .withColumn("batch_start", F.col("start_seconds") + F.col("first_frame") / rate)
        .withColumn(
            "batch_end",
            F.least(F.col("start_seconds") + (F.col("first_frame") + F.col("frames")) / rate, F.col("end_seconds")),
        )
        .drop("__n")
    )


def to_global(start_seconds: Column, centiseconds: Column) -> Column:
    """Global offset of a recogniser's time inside a chunk."""
    return start_seconds + centiseconds.cast("bigint") / F.lit(100.0)


def pcm_to_float(samples: Column) -> Column:
    """16-bit samples as floats; the divisor is 32767, so the least value lies just under -1."""
    return F.transform(samples, lambda v: (v.cast("float") / F.lit(32767.0).cast("float")).cast("float"))
