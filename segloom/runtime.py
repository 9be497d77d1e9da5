"""Session helpers: table loading, lineage cuts, size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segloom.errors import ConfigError


def load(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One table of a data directory."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a context, so that their workers can import it from anywhere.

    The archive is served by the driver; nothing is read from the folder it is made in but by the driver itself.
    """
    sc = spark.sparkContext
    if getattr(sc, "_segloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="segloom-"), "segloom.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    sc.addPyFile(archive)
    sc._segloom_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset, as in local
    tests, a folder of this machine is used.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured is None:
        configured = os.path.join(tempfile.gettempdir(), "segloom-checkpoints")
    sc.setCheckpointDir(configured)
    return configured


def shared_folder(spark: SparkSession) -> str:
    """A folder for files that executors hand on to each other, beside the session's checkpoints."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or os.path.join(tempfile.gettempdir(), "segloom-checkpoints")
    path = re.sub(r"^file:/*", "/", folder)
    if re.match(r"[a-z0-9+.-]+:", path):
        raise ConfigError(f"processing.temp_dir must name a folder that all executors share; tools cannot write to {folder}")
    return os.path.join(path, "segloom-jobs")


#: Tables written by :func:`cut`: a weak reference to what every plan that reads the table holds, and its path.
_TABLES: list[tuple] = []


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def sweep(spark: SparkSession, everything: bool = False) -> int:
    """Deletes the tables of :func:`cut` that no plan reads any more, or all of them; gives how many are left."""
    left = []
    for entry in _TABLES:
        reference, path, owner = entry
        try:
            if everything or reference.get() is None:
                _delete(owner, path)
            else:
                left.append(entry)
        except Exception:  # the JVM is gone, and so are the session and its plans
            continue
    _TABLES[:] = left
    return len(left)


@atexit.register
def _leave() -> None:
    if _TABLES:
        sweep(_TABLES[0][2], everything=True)


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` once as a table in the shared checkpoint folder and reads it from there.

    Like a checkpoint the table survives the loss of executors, but it is compressed and read by column. It is
    deleted when no plan refers to it any more, seen at the next cut, and at the latest when Python ends.
    """
    spark = df.sparkSession
    sweep(spark)
    path = os.path.join(ensure_checkpoint_dir(spark), f"table-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    # Plans are copied as they are rewritten, but all copies share the relation's list of files.
    files = read._jdf.queryExecution().analyzed().relation().location()
    _TABLES.append((spark._jvm.java.lang.ref.WeakReference(files), path, spark))
    return read


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it holds at most ``max_rows`` rows, else ``df`` as it is.

    The rows are counted, which moves one number a task; beyond the bound the planner is left with its shuffled joins
    and AQE's skew handling.
    """
    return F.broadcast(df) if df.count() <= max_rows else df
