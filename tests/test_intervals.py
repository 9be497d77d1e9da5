import random

import numpy as np
import pytest

from segloom.operators import intervals
from segloom.operators.intervals import disjoint, gaps, merge_lists, periods, running_max

SCHEMA = "job_id string, segment_type string, start_ms bigint, end_ms bigint, k1 string, slice string"


def brute(rows):
    groups = {}
    for j, t, s, e, *_ in rows:
        if s is not None and e is not None and e >= s:
            groups.setdefault((j, t), []).append((s, e))
    covered, holes = set(), set()
    for key, spans in groups.items():
        merged = []
        for s, e in sorted(spans):
            if merged and s <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(merged[-1][1], e))
            else:
                merged.append((s, e))
        covered |= {(*key, s, e) for s, e in merged}
        holes |= {(*key, a[1], b[0]) for a, b in zip(merged, merged[1:], strict=False)}
    return covered, holes


def lists(rnd, groups, span):
    rows = sorted((rnd.randint(0, groups), rnd.randint(0, span - 1), rnd.randint(0, 40)) for _ in range(60))
    return disjoint(*(np.array(c, np.int64) for c in zip(*[(g, s, s + d) for g, s, d in rows], strict=True)))


def test_merge_is_that_of_all_rows():
    rnd = random.Random(3)
    for _ in range(200):
        a, b = lists(rnd, 3, 500), lists(rnd, 3, 500)
        rows = sorted(zip(*(np.concatenate(x).tolist() for x in zip(a, b, strict=True)), strict=True))
        want = disjoint(*(np.array(c, np.int64) for c in zip(*rows, strict=True)))
        for got in (merge_lists(a, b, 500), merge_lists(b, a, 500)):
            assert all((x == y).all() for x, y in zip(got, want, strict=True))


def test_running_maximum_of_offsets_too_large_for_one_number():
    group = np.repeat(np.arange(7), 3)
    end = np.array([1 << 61, 5, 1 << 62, -9, -3, -(1 << 61)] * 3 + [1, 2, 3])
    want = np.concatenate([np.maximum.accumulate(end[group == g]) for g in range(7)])
    assert (running_max(group, end) == want).all()


@pytest.mark.parametrize("span", [50, 3_600_000])
def test_against_brute_force_over_many_slices(spark, monkeypatch, span):
    for name, value in (("RANGE_MS", span), ("FAN_IN", 2), ("FLUSH", 20)):
        monkeypatch.setattr(intervals, name, value)
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for seed in range(3):
            rnd = random.Random(seed)
            far = rnd.choice([200, 3000, 20_000])
            rows = []
            for _ in range(800):
                s = rnd.randint(0, far)
                e = s + rnd.choice([0, 1, rnd.randint(0, 30), rnd.randint(0, far if rnd.random() < 0.02 else 10)])
                rows.append((rnd.choice(["hot"] * 6 + ["b", None]), rnd.choice(["speech", "visual"]), s, e, "x", "y"))
            rows += rows[:50] + [("b", "speech", None, 5, "x", "y"), ("b", "speech", 9, 4, "x", "y"), ("b", "speech", -4, 4, "x", "y"), ("b", "visual", 1 << 50, 1 << 55, "x", "y")]
            df = spark.createDataFrame(rows, SCHEMA).repartition(5)
            covered, holes = brute(rows)
            assert {tuple(r) for r in periods(df).collect()} == covered
            assert {tuple(r) for r in gaps(df).collect()} == holes
            assert {tuple(r) for r in gaps(df, min_gap_ms=20).collect()} == {h for h in holes if h[3] - h[2] >= 20}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[1])


def test_empty_and_single(spark):
    df = spark.createDataFrame([("j", "speech", 5, 5, "", "")], SCHEMA)
    assert gaps(df).count() == 0 and [tuple(r) for r in periods(df).collect()] == [("j", "speech", 5, 5)]
    assert gaps(df.limit(0)).count() == 0 and periods(df.limit(0)).count() == 0
