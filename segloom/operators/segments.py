"""Segment rows: usability, classification, transcripts, context, merged timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from segloom.functions.text import ellipsize_bytes, is_blank, utrim
from segloom.functions.timecode import parse_offset_ms, parse_timestamp
from segloom.operators.ordered import lagged, positions

TYPES = ("speech", "visual", "sound")
CONTEXT_ROWS = 5
CONTEXT_BYTES = 200


def normal_type(c: Column) -> Column:
    """``speech``, ``visual`` or ``sound`` whatever the spelling of case and blanks; null stays null."""
    return F.lower(F.trim(c))


def usable(df: DataFrame, *keep: str) -> DataFrame:
    """Rows with a type, two offsets and an end not before the start.

    Gives job_id, chunk_index, ord, seg_id, segment_type, start_ms, end_ms and the columns in ``keep``.
    Repeated deliveries are still there: they agree on all of these columns, so an operator that sorts by
    them meets repeats side by side and drops them without a shuffle of its own.
    """
    given = df.where(F.col("segment_type").isNotNull() & F.col("start_time").isNotNull() & F.col("end_time").isNotNull())
    times = F.struct(parse_offset_ms(F.col("start_time")).alias("start_ms"), parse_offset_ms(F.col("end_time")).alias("end_ms"))
    # Generated columns are not pushed into the filters below, which would parse each time anew.
    out = given.select(
        "job_id",
        "chunk_index",
        "ord",
        "seg_id",
        normal_type(F.col("segment_type")).alias("segment_type"),
        F.inline(F.array(times)),
        *keep,
    )
    return out.where(F.col("segment_type").isin(*TYPES) & (F.col("end_ms") >= F.col("start_ms")))


def classify(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``type`` and ``content`` to recognised text and drops blank rows.

    Text wholly in one pair of square brackets, with no bracket inside, is a sound in lower case without
    the brackets; all else is speech. Both are trimmed, but the inside of brackets is not trimmed again.
    """
    t = F.col("__t")
    sound = t.rlike(r"\A\[[^\[\]]+\]\z")
    return (
        df.withColumn("__t", utrim(F.col(text)))
        .where(F.octet_length(t) > 0)
        .withColumn("type", F.when(sound, F.lit("sound")).otherwise(F.lit("speech")))
        .withColumn("content", F.when(sound, F.lower(F.substring(t, F.lit(2), F.length(t) - 2))).otherwise(t))
        .drop("__t")
    )


def chunk_texts(df: DataFrame, by: list[str], rows: int = CONTEXT_ROWS, limit: int = CONTEXT_BYTES) -> DataFrame:
    """transcript and context of each group, in one aggregate and, if ``df`` is partitioned by the group, one pass.

    The transcript is the spoken words in order, joined by one blank, null where nothing is spoken. The context, for
    the next group's prompt, holds the last ``rows`` spoken rows and the last visual row, which may be blank and is
    cut at ``limit`` bytes on a character boundary; no part gives ``''``.
    """
    w = Window.partitionBy(*by, F.col("__spoken")).orderBy(F.col("ord").desc())
    ranked = (
        df.withColumn("__spoken", F.coalesce((F.col("type") == "speech") & ~is_blank(F.col("content")), F.lit(False)))
        .withColumn("__said", F.when(F.col("__spoken"), F.col("content")))
        .withColumn("__late", F.when(F.row_number().over(w) <= rows, F.col("__said")))
    )
    visual = F.col("type") == "visual"
    grouped = ranked.groupBy(*by).agg(
        F.expr("listagg(__said, ' ') within group (order by ord)").alias("transcript"),
        F.expr("listagg(__late, ' ') within group (order by ord)").alias("__late"),
        F.max_by(F.when(visual, F.col("content")), F.when(visual, F.col("ord"))).alias("__seen"),
    )
    parts = (
        F.concat(F.lit("Recent dialogue: "), F.col("__late")),
        F.concat(F.lit("Last visual: "), ellipsize_bytes(F.col("__seen"), limit, limit)),
    )
    return grouped.select(*by, "transcript", F.concat_ws(" ", *parts).alias("context"))


def transcripts(df: DataFrame, by: list[str]) -> DataFrame:
    """Spoken words of each group in order, joined by one blank; null where nothing is spoken."""
    spoken = (F.col("type") == "speech") & ~is_blank(F.col("content"))
    return (
        df.withColumn("__said", F.when(spoken, F.col("content")))
        .groupBy(*by)
        .agg(F.expr("listagg(__said, ' ') within group (order by ord)").alias("transcript"))
    )


def contexts(df: DataFrame, by: list[str], rows: int = CONTEXT_ROWS, limit: int = CONTEXT_BYTES) -> DataFrame:
    """Context of each group for the next one's prompt, see :func:`chunk_texts`."""
    return chunk_texts(df, by, rows, limit).drop("transcript")


def previous_contexts(df: DataFrame, job: str = "job_id", index: str = "chunk_index", bucket: int = 4096) -> DataFrame:
    """Each chunk with the context of the chunk before it; null for the first. Long jobs are taken in buckets of chunks."""
    return lagged(df, [job], [index], F.floor(F.col(index) / bucket), "context", "previous_context")


def merge_timeline(df: DataFrame, entity: str = "job_id", bucket_seconds: int = 600) -> DataFrame:
    """Position of each row in its timeline: stable by parsed start, an unparsable start counting as 0.

    Rows that start at 0, among them all unparsable ones, are parted further by their chunk.
    """
    start = F.col("start_s")
    df = df.withColumn("start_s", F.coalesce(parse_timestamp(F.col("start_time")), F.lit(0.0)))
    chunk = F.when(start != 0, F.lit((1 << 63) - 1)).otherwise(F.col("chunk_index").cast("bigint"))
    bucket = F.struct(F.floor(start / bucket_seconds).alias("time"), chunk.alias("chunk"))
    return positions(df, [entity], [start, F.col("chunk_index"), F.col("ord"), F.col("seg_id")], bucket)


def collect_timelines(df: DataFrame, entity: str = "job_id", part_rows: int | None = None) -> DataFrame:
    """One row per entity with its segments nested in timeline order, the shape of one timeline file.

    Such a row is as large as its timeline, and so is its task. With ``part_rows`` it comes in parts of at most so many
    segments, numbered from 0 in ``part``, which bounds both; the flat rows of :func:`merge_timeline` need neither.
    """
    item = F.struct("position", F.struct(F.col("type"), F.col("start_time").alias("start"), F.col("end_time").alias("end"), "content").alias("seg"))
    parts = [] if part_rows is None else [F.floor(F.col("position") / part_rows).alias("part")]
    return df.groupBy(entity, *parts).agg(
        F.transform(F.array_sort(F.collect_list(item)), lambda x: x["seg"]).alias("segments"),
        F.count(F.lit(1)).alias("segment_count"),
    )


def explode_timelines(df: DataFrame) -> DataFrame:
    """Flat rows of nested timelines; ``position`` counts from 0."""
    return df.select("*", F.posexplode("segments").alias("position", "__seg")).select(
        *[c for c in df.columns if c != "segments"], "position", F.col("__seg.*")
    )
