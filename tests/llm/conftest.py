import contextlib

import pytest

from segloom.operators import ordered


@pytest.fixture
def sliced(spark, monkeypatch):
    """Forces ranges of few rows, so that entities span many of them, and tasks of their own for them."""

    @contextlib.contextmanager
    def force(n=6, rows=40):
        old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        monkeypatch.setattr(ordered, "SLICE_ROWS", rows)
        try:
            yield
        finally:
            monkeypatch.undo()
            for k, v in old.items():
                spark.conf.set(k, v)

    return force
