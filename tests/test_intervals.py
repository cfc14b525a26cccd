import random

import numpy as np

from taleflow.operators.intervals import fold, merge, periods_and_gaps
from taleflow.operators.utterances import file_periods


def brute(rows):
    by = {}
    for e, s, t in rows:
        if e is not None and s is not None and t is not None and t > s:
            by.setdefault(e, []).append((s, t))
    out = set()
    for e, xs in by.items():
        xs.sort()
        cur = list(xs[0])
        for s, t in xs[1:]:
            if s > cur[1]:
                out.add((e, "period", *cur))
                out.add((e, "gap", cur[1], s))
                cur = [s, t]
            else:
                cur[1] = max(cur[1], t)
        out.add((e, "period", *cur))
    return out


def test_random_intervals_over_blocks(spark):
    rng = random.Random(7)
    for block in (10, 50, 10_000):
        rows = [(rng.choice("abc"), s := rng.randrange(-100, 400), s + rng.randrange(-3, rng.choice([4, 30, 200]))) for _ in range(300)]
        rows += [(None, 1, 2), ("a", None, 3), ("b", 4, None)] + rows[:20]
        df = spark.createDataFrame(rows, "who string, a long, b long").repartition(5)
        got = periods_and_gaps(df, "who", "a", "b", block).collect()
        assert len(got) == len(set(got))
        assert {tuple(r) for r in got} == brute(rows)


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([("x", 1, 5, "k")], "entity string, start_ms long, end_ms long, kind string")
    assert [tuple(r) for r in periods_and_gaps(df, "entity", "start_ms", "end_ms").collect()] == [("x", "period", 1, 5)]
    assert periods_and_gaps(df.limit(0), "entity", "start_ms", "end_ms").collect() == []


def test_merge_is_fold():
    rng = np.random.default_rng(1)
    for _ in range(50):
        s = rng.integers(0, 60, 20)
        e = s + rng.integers(1, 9, 20)
        parts = [fold(np.zeros(10, np.int64), s[i : i + 10], e[i : i + 10])[1:] for i in (0, 10)]
        a, b = merge(*parts), fold(np.zeros(20, np.int64), s, e)[1:]
        assert (a[0] == b[0]).all() and (a[1] == b[1]).all()


def test_utterance_files(spark):
    rows = [("S1_20091_M1_1", 0.0, 1.0), (" s1-20091-m1-2", 1.0, 2.0), ("S1_20091_M1_3", 2.5, 3.0), ("S1_20091_M1_4", float("nan"), 9.0), ("S1_20091_M1_5", 5.0, 4.0), (None, 1.0, 2.0), ("bad", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "utterance_id string, start_time double, end_time double")
    assert sorted(tuple(r) for r in file_periods(df).collect()) == [("20091_M1", "gap", 2000, 2500), ("20091_M1", "period", 0, 2000), ("20091_M1", "period", 2500, 3000)]
