"""Seeded random property checks of the series operators."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.functions.ranking import positional_index
from tidecast.operators import series as S
from tidecast.operators import timeline as TL
from tidecast.operators import windows as W

from .helpers import monthly_frame


@pytest.fixture(scope="module")
def sparse(spark):
    rng = np.random.default_rng(1)
    rows = []
    for r in range(5):
        months = sorted(rng.choice(60, size=20, replace=False))
        for m in months:
            rows.append((f"o/r{r}", "m", dt.date(2019 + int(m) // 12, int(m) % 12 + 1, 1), float(rng.integers(0, 50))))
    return spark.createDataFrame(rows, "repo STRING, metric STRING, ds DATE, y DOUBLE")


def test_gap_fill_keeps_sum_and_length(sparse):
    f = S.gap_fill(sparse, "month")
    a = {r.repo: (r.s, r.n) for r in f.groupBy("repo").agg(F.sum("y").alias("s"), F.count("*").alias("n")).collect()}
    b = {r.repo: r for r in sparse.groupBy("repo").agg(F.sum("y").alias("s"), F.min("ds").alias("lo"),
                                                      F.max("ds").alias("hi")).collect()}
    for repo, (s, n) in a.items():
        assert s == b[repo].s
        months = (b[repo].hi.year - b[repo].lo.year) * 12 + b[repo].hi.month - b[repo].lo.month + 1
        assert n == months


def test_splits_partition_rows(sparse):
    o = W.split_ordered(sparse)
    h = W.split_hashed(sparse)
    assert o.count() == h.count() == sparse.count()
    per = {r.repo: r.t for r in h.where(F.col("split") == "test").groupBy("repo").agg(F.count("*").alias("t")).collect()}
    assert set(per.values()) == {4}  # ceil(0.2 * 20)


def test_horizon_rows(sparse):
    assert S.future_month_starts(sparse, 7).count() == 5 * 7


def test_lookback_window_count(sparse):
    s = W.split_ordered(sparse)
    lb = W.lookback_windows(s, 3)
    assert lb.count() == 5 * ((16 - 3) + (4 - 3))


def test_repartitioning_changes_nothing(sparse):
    a = sorted(S.gap_fill(sparse, "month").collect())
    b = sorted(S.gap_fill(sparse.repartition(7).sortWithinPartitions(F.rand(3)), "month").collect())
    assert a == b


def test_positional_index_equals_row_number(spark):
    rng = np.random.default_rng(2)
    # one hot key with most rows, plus small keys
    rows = [("hot", int(k), int(v)) for k, v in enumerate(rng.integers(0, 30, size=3000))]
    rows += [(f"k{i}", i * 10 + j, int(rng.integers(0, 30))) for i in range(20) for j in range(5)]
    df = spark.createDataFrame(rows, "repo STRING, seq BIGINT, contributions BIGINT")
    got = positional_index(df, ["repo"], [("contributions", True), ("seq", False)], num_partitions=6)
    from pyspark.sql import Window
    w = Window.partitionBy("repo").orderBy(F.col("contributions").desc(), F.col("seq").asc())
    exp = df.withColumn("pos", F.row_number().over(w) - 1)
    assert sorted(got.select("repo", "seq", "pos").collect()) == sorted(exp.select("repo", "seq", "pos").collect())


def test_synthetic_monthly_equals_row_level(spark):
    rng = np.random.default_rng(4)
    rows = [("a/b", i, int(v)) for i, v in enumerate(rng.integers(0, 9, size=400))]
    df = spark.createDataFrame(rows, "repo STRING, seq BIGINT, contributions BIGINT")
    as_of = dt.date(2024, 5, 17)
    fast = {r.ds: r.y for r in TL.synthetic_monthly(df, as_of, "c", "contributions").collect()}
    per_row = TL.rank_spaced_timeline(df, as_of, [("contributions", True), ("seq", False)])
    slow = {r.ds: r.y for r in per_row.groupBy(F.trunc("synthetic_day", "MM").alias("ds"))
            .agg(F.sum("contributions").cast("double").alias("y")).collect()}
    assert fast == slow
    cnt = {r.ds: r.y for r in TL.synthetic_monthly(df, as_of, "b").collect()}
    assert sum(cnt.values()) == 400


def test_scale_unscale_identity(spark):
    s = W.minmax_scale(monthly_frame(spark, [3.0, 9.0, 5.0, 1.0]))
    back = W.minmax_unscale(s, "y_scaled", "yb").collect()
    assert all(abs(r.y - r.yb) < 1e-12 for r in back)
