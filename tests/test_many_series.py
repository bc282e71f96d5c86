"""Least squares of many series: a worker's memory does not follow their number."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidecast.operators import additive as AD
from tidecast.operators import linalg as LA

Q = AD.P + 1


def _peak_mb(run):
    tracemalloc.start()
    try:
        got = run()
        return tracemalloc.get_traced_memory()[1] / 1e6, got
    finally:
        tracemalloc.stop()


def _body(monkeypatch, solver):
    """The Python function behind a solver's pandas UDF."""
    found = []

    class Rows:
        def withColumn(self, *_):
            return self

    monkeypatch.setattr(F, "pandas_udf", lambda _: lambda f: found.append(f) or (lambda *_: None))
    solver(Rows())
    return found[0]


def _triangles(n):
    rng = np.random.default_rng(3)
    iu, out = np.triu_indices(Q), []
    for _ in range(n):
        z = rng.normal(size=(60, Q))
        out.append((z.T @ z)[iu])
    return out


def test_solve_stacks_some_series_at_a_time(spark, monkeypatch):
    fit = _body(monkeypatch, lambda g: LA.solve(g, AD.P, ridge=AD.RIDGE))
    some = _triangles(400)
    tri = pd.Series([some[i % 400] for i in range(2000)])
    tri[777] = np.full(Q * (Q + 1) // 2, np.nan)
    peak, got = _peak_mb(lambda: fit(tri, pd.Series([None] * len(tri))))
    assert peak < 60, peak  # 2,000 matrices are 47 MB, a stacked solve holds several such
    assert len(got) == 2000 and got["error"][777] == "sums are not finite" and np.isnan(got["sse"][777])
    z = LA.unpacked(tri.iloc[[0, 1203]], Q)
    for i, m in zip((0, 1203), z):
        want = np.linalg.solve(m[:-1, :-1] + np.diag(AD.RIDGE), m[:-1, -1])
        assert got["beta"][i] == pytest.approx(want.tolist()) and got["error"][i] is None
    assert all(got["beta"][i] == pytest.approx(got["beta"][i % 400]) for i in (400, 1999))


def test_sparse_solve_stacks_some_series_at_a_time(spark, monkeypatch):
    fit = _body(monkeypatch, AD.solve_sparse)
    some = _triangles(4)
    tri = pd.Series([some[i % 4] for i in range(1200)])
    tri[5] = np.full(Q * (Q + 1) // 2, np.inf)
    peak, got = _peak_mb(lambda: fit(tri))
    assert peak < 45, peak
    assert got["error"][5] == "sums are not finite" and np.isnan(got["beta"][5]).all()
    want = AD.sparse_coefficients(LA.unpacked(tri.iloc[:4], Q))
    for i in (0, 3, 602, 1199):
        assert got["beta"][i] == pytest.approx(want[0][i % 4], abs=1e-8) and got["sse"][i] == pytest.approx(want[1][i % 4])


def test_batch_of_many_keys_gives_its_triangles_in_pieces(spark, monkeypatch):
    found, df = [], spark.createDataFrame([], "repo STRING, x ARRAY<DOUBLE>, y DOUBLE")
    real = type(df).mapInPandas
    monkeypatch.setattr(type(df), "mapInPandas", lambda self, f, *a, **k: found.append(f) or real(self, f, *a, **k))
    LA.gram(df, ["repo"], "x", "y", AD.P)
    pdf = pd.DataFrame({"repo": [f"r{i % 3000}" for i in range(4000)],
                        "x": [np.full(AD.P, float(i)) for i in range(4000)], "y": 1.0})
    peak, (n, keys) = _peak_mb(lambda: tuple(map(sum, zip(*((int(o["n"].sum()), len(o)) for o in found[0](iter([pdf])))))))
    assert (n, keys) == (4000, 3000)
    assert peak < 20, peak  # 3,000 triangles are 36 MB


def test_one_partial_a_series_after_a_broadcast_join(spark, monkeypatch):
    n, months = 3000, 12
    s = spark.range(n * months).select(
        F.concat(F.lit("r/"), F.col("id") % n).alias("repo"), F.lit("m").alias("metric"),
        F.add_months(F.lit("2020-01-01").cast("date"), F.floor(F.col("id") / n).cast("int")).alias("ds"),
        (F.col("id") % 17).cast("double").alias("y"))
    parts, real = [], type(s).mapInPandas
    monkeypatch.setattr(type(s), "mapInPandas", lambda self, *a, **k: parts.append(real(self, *a, **k)) or parts[-1])
    fit = AD.additive_fit(s, stats=F.broadcast(AD._stats(s, "month", ["repo", "metric"])))
    # a series has a second partial only where a batch or a task ends
    assert n <= parts[0].count() <= n + 2 * (n * months // 10_000 + 4)
    assert fit.where("sigma IS NOT NULL").count() == n
