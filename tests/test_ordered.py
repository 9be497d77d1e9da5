import random
import time

from pyspark.sql import functions as F

from segloom import runtime
from segloom.operators.ordered import RANGE, slices


def test_large_entities_are_cut_in_order_and_stay_whole(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["hot"] * 8 + ["warm", "a", "b", None]), 7 if i % 3 else rnd.randint(0, 40), i) for i in range(6000)]
    rows += rows[::11]
    df = spark.createDataFrame(rows, "job string, start int, id int")
    cut = slices(df, ["job"], ["start", "id"], slice_rows=300).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.job or "", r.start, r.id) for r in cut) == sorted((r[0] or "", *r[1:]) for r in rows)
    groups = {}
    for r in cut:  # rows come task by task, in their order
        groups.setdefault((r.job, r[RANGE]), []).append((r.start, r.id))
    assert all(g == sorted(g) for g in groups.values())
    hot = sorted((k[1], g) for k, g in groups.items() if k[0] == "hot")
    assert [k for k, _ in hot] == list(range(len(hot))) and len(hot) >= 10
    assert max(len(g) for _, g in hot) < 900  # even those of one instant are parted
    assert all(a[1][-1] < b[1][0] for a, b in zip(hot, hot[1:], strict=False))
    assert {k[1] for k in groups if k[0] in ("a", None)} <= {-1, 0, 1}
    assert {r[RANGE] for r in slices(df, ["job"], ["start", "id"]).collect()} == {-1}


def test_cut_tables_go_with_their_plans(spark):
    import gc
    import os

    def left():
        spark.sparkContext._jvm.System.gc()
        return runtime.sweep(spark)

    gc.collect()
    before = left()
    made = runtime.cut(spark.range(10).toDF("x"))
    derived = made.where("x > 3").groupBy().agg(F.count("x").alias("n"))
    path = runtime._TABLES[-1][1].removeprefix("file:")
    del made
    gc.collect()
    assert left() > before and derived.first().n == 6 and os.path.isdir(path)
    del derived
    for _ in range(20):  # the session lets go of its last query when it runs others
        gc.collect()
        spark.range(3).count()
        left()
        if not os.path.isdir(path):
            return
        time.sleep(0.2)
    raise AssertionError(path)
