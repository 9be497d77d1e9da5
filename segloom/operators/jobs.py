"""Job event logs and job tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segloom.operators.ordered import lagged

TERMINAL = ("completed", "failed")
CANCELLED = "cancelled by user"


def fold_status(log: DataFrame, key: str = "job_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Final status of each job: the first terminal one, which absorbs all later, else the latest.

    A partial aggregate on each side of the shuffle, so a job with very many events costs one row a task.
    """
    at = F.struct(*order)
    terminal = F.col("status").isin(*TERMINAL)
    return log.groupBy(key).agg(
        F.coalesce(
            F.min_by(F.when(terminal, F.col("status")), F.when(terminal, at)),
            F.max_by("status", at),
        ).alias("status"),
        F.count(F.lit(1)).alias("events"),
    )


def status_changes(log: DataFrame, key: str = "job_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Events at which a job's status differs from the one before, the first included; null statuses are passed over.

    Days hand on their last status, so a job with very many events spreads over many tasks.
    """
    rows = lagged(log.where("status is not null"), [key], list(order), F.to_date(F.col(order[0])), "status", "previous_status")
    return rows.where(F.col("previous_status").isNull() | (F.col("previous_status") != F.col("status")))


def cancel_open(jobs: DataFrame) -> DataFrame:
    """The table after all open jobs were cancelled; finished jobs stay as they are."""
    is_open = F.col("status").isin("queued", "processing")
    return jobs.withColumn("error", F.when(is_open, F.lit(CANCELLED)).otherwise(F.col("error"))).withColumn(
        "status", F.when(is_open, F.lit("failed")).otherwise(F.col("status"))
    )


def summary(jobs: DataFrame, by: str = "profile") -> DataFrame:
    """Counts of jobs by outcome, and whether all ended well."""
    one = jobs.select("id", by, "status").distinct()
    return one.groupBy(by).agg(
        F.count(F.lit(1)).alias("jobs"),
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status").isin("queued", "processing")).alias("cancellable"),
        F.when(F.every(F.col("status") == "completed"), F.lit("ok")).otherwise(F.lit("degraded")).alias("health"),
    )
