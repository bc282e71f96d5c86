"""K1: least squares for many series at once.

The sufficient statistics of a linear fit -- the Gram matrix X'X, X'y,
y'y and n -- are sums. Every Arrow batch is reduced to one packed upper
triangle of Z'Z (Z = [X | y]) per key, and Spark adds these partials by
key: it never moves the rows, only p^2/2 sums per (key, batch). Callers
feed rows clustered by key, and a series is bounded by the calendar, so a
key has a few partials at most. Rows that are not clustered by key go
through ``clustered=False``: the partials of a key are then added up in
two levels, so no row ever holds one for each batch of the job.

The p x p solves run in Python, stacked: one eigendecomposition call for
some series of an Arrow batch at a time (``PIECE``). Triangles are made
and unpacked by the same pieces, so that a worker's memory does not follow
the number of series in a batch. A series whose sums cannot be solved (not
finite, no convergence) gets null coefficients and the reason in ``error``;
the others of its batch are not touched.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SOLUTION = T.StructType([
    T.StructField("beta", T.ArrayType(T.DoubleType())),
    T.StructField("sse", T.DoubleType()),
    T.StructField("rank", T.IntegerType()),
    T.StructField("error", T.StringType()),
])
#: Groups of tasks whose partials are added up first, for rows not clustered by key.
TASK_GROUPS = 256
#: Numbers of the matrices made or solved at once in a worker (4 MB); bounds its memory.
PIECE = 1 << 19


def packed(i: int, j: int, q: int) -> int:
    """Place of entry (i, j), i <= j, in the packed upper triangle of a q x q matrix."""
    return i * q - i * (i - 1) // 2 + (j - i)


def pieces(n: int, q: int):
    """Slices of ``n`` matrices q x q: ``PIECE`` numbers each, or one matrix."""
    step = max(1, PIECE // (q * q))
    return [slice(a, min(a + step, n)) for a in range(0, n, step)]


def unpacked(tri: pd.Series, q: int) -> np.ndarray:
    """Stacked symmetric matrices of packed upper triangles."""
    iu = np.triu_indices(q)
    z = np.zeros((len(tri), q, q))
    if len(tri):
        z[:, iu[0], iu[1]] = np.stack(tri.to_numpy())
        z[:, iu[1], iu[0]] = z[:, iu[0], iu[1]]
    return z


def gram(df: DataFrame, keys: list[str], x: str, y: str, p: int, clustered: bool = True) -> DataFrame:
    """(keys, n, tri) per key: ``tri`` is the packed upper triangle of Z'Z,
    Z = [X | y], row-major, (p + 1)(p + 2) / 2 numbers.

    ``x`` is an ARRAY<DOUBLE> column of length ``p``; rows with a null
    feature or target must be filtered out by the caller. ``clustered``:
    all rows of a key are in a few tasks, there one after the other (a
    batch has one partial for each of its keys).
    """
    keys = list(keys)
    q = p + 1
    iu = np.triu_indices(q)
    key_types = {f.name: f.dataType for f in df.schema.fields if f.name in keys}
    out_schema = T.StructType([T.StructField(k, key_types[k]) for k in keys] + [
        T.StructField("n", T.LongType()), T.StructField("tri", T.ArrayType(T.DoubleType()))])

    def partial(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            z = np.column_stack([np.stack(pdf[x].to_numpy()), pdf[y].to_numpy(dtype=float)])
            groups = pdf.groupby(keys, sort=False, dropna=False)
            number = groups.ngroup().to_numpy()
            order = np.argsort(number, kind="stable")
            z, ends = z[order], np.cumsum(np.bincount(number))
            starts = np.concatenate([[0], ends[:-1]])
            for s in pieces(len(starts), q):
                out = pdf.iloc[order[starts[s]]][keys].reset_index(drop=True)
                out["n"] = ends[s] - starts[s]
                out["tri"] = [(z[a:b].T @ z[a:b])[iu] for a, b in zip(starts[s], ends[s], strict=True)]
                yield out

    parts = df.select(*keys, F.col(x).alias(x), F.col(y).cast("double").alias(y)).mapInPandas(partial, out_schema)
    total = "IF(size(_t) = 1, _t[0], aggregate(slice(_t, 2, size(_t) - 1), _t[0], (a, t) -> zip_with(a, t, (u, v) -> u + v)))"

    def added(rows: DataFrame, by: list[str]) -> DataFrame:
        return rows.groupBy(*by).agg(F.sum("n").alias("n"), F.collect_list("tri").alias("_t")) \
            .select(*by, "n", F.expr(total).alias("tri"))

    if not clustered:
        parts = added(parts.withColumn("_group", F.spark_partition_id() % TASK_GROUPS), [*keys, "_group"])
    return added(parts, keys)


def gram_long(df: DataFrame, keys: list[str], x: str, y: str, p: int) -> DataFrame:
    """The same statistics as rows (keys, kind, i, j, value), 1-based,
    upper triangle for 'xx' and j = 0 for 'xy'."""
    g, q = gram(df, keys, x, y, p), p + 1
    pairs = [F.struct(F.lit("xx").alias("kind"), F.lit(i + 1).alias("i"), F.lit(j + 1).alias("j"),
                      F.col("tri")[packed(i, j, q)].alias("value")) for i in range(p) for j in range(i, p)]
    pairs += [F.struct(F.lit("xy").alias("kind"), F.lit(i + 1).alias("i"), F.lit(0).alias("j"),
                       F.col("tri")[packed(i, p, q)].alias("value")) for i in range(p)]
    return g.select(*keys, F.explode(F.array(*pairs)).alias("e")).select(*keys, "e.*")


def _solve_stacked(a: np.ndarray, b: np.ndarray, c: np.ndarray, lam: np.ndarray):
    """Minimum-norm solutions of (A + diag(lam)) beta = b for stacked A, with
    the residual sum of squares of the unpenalised problem and the rank."""
    w, v = np.linalg.eigh(a + np.eye(a.shape[1]) * lam)
    keep = w > w.max(axis=1, keepdims=True, initial=0.0) * a.shape[1] * np.finfo(float).eps
    part = np.einsum("sij,si->sj", v, b)
    beta = np.einsum("sij,sj->si", v, np.divide(part, w, out=np.zeros_like(w), where=keep))
    sse = c - 2.0 * np.einsum("si,si->s", beta, b) + np.einsum("si,sij,sj->s", beta, a, beta)
    return beta, np.maximum(sse, 0.0), keep.sum(axis=1)


def _solve_part(z: np.ndarray, rows: np.ndarray, ix: np.ndarray, penalty: np.ndarray):
    """``_solve_stacked`` of the coefficients ``ix`` of some matrices Z'Z."""
    p = z.shape[1] - 1
    return _solve_stacked(z[np.ix_(rows, ix, ix)], z[np.ix_(rows, ix, [p])][:, :, 0], z[rows, p, p], penalty[ix])


def _solve_piece(z: np.ndarray, which: list[tuple], penalty: np.ndarray) -> list[tuple]:
    """(beta, sse, rank, error) of each stacked matrix Z'Z for its positions."""
    out: list = [None] * len(z)
    finite = np.isfinite(z).all(axis=(1, 2))
    for at in set(which):  # rows of the same positions are solved together
        rows, ix = [i for i, k in enumerate(which) if k == at], np.array(at, int)
        failed = lambda why: ([float("nan")] * len(ix), float("nan"), 0, why)  # noqa: B023, E731
        for i in rows:
            if not finite[i]:
                out[i] = failed("sums are not finite")
        good = np.array([i for i in rows if finite[i]], int)
        if not len(good):
            continue
        try:
            solved = [(good, _solve_part(z, good, ix, penalty))]
        except np.linalg.LinAlgError:  # one series must not take the others with it
            solved = []
            for i in good:
                try:
                    solved.append((np.array([i]), _solve_part(z, np.array([i]), ix, penalty)))
                except np.linalg.LinAlgError as e:
                    out[i] = failed(str(e))
        for some, parts in solved:
            for i, bt, s, r in zip(some, *parts, strict=True):
                out[i] = bt.tolist(), float(s), int(r), None
    return out


def solve(g: DataFrame, p: int, ridge=0.0, keep: str | None = None) -> DataFrame:
    """Attach ``fit`` = (beta, sse, rank, error) to each row of ``gram`` output.

    ``ridge``: a float added to every diagonal entry, or one penalty a
    coefficient; 0 is plain least squares (minimum norm when singular).
    ``keep``: an ARRAY<INT> column of feature positions; only these enter.
    """
    q = p + 1
    penalty = np.broadcast_to(np.asarray(ridge, float), (p,)).copy()

    @F.pandas_udf(SOLUTION)
    def fit(tri: pd.Series, positions: pd.Series) -> pd.DataFrame:
        out: list = []
        for s in pieces(len(tri), q):
            which = [tuple(range(p)) if k is None else tuple(k) for k in positions.iloc[s]]
            out += _solve_piece(unpacked(tri.iloc[s], q), which, penalty)
        betas, sses, ranks, errors = zip(*out, strict=True) if out else ((), (), (), ())
        return pd.DataFrame({"beta": list(betas), "sse": list(sses), "rank": list(ranks),
                             "error": pd.Series(errors, dtype=object)})

    positions = F.col(keep) if keep else F.lit(None).cast("array<int>")
    return g.withColumn("fit", fit("tri", positions))


def dot(a, b):
    """SQL dot product of two equal-length ARRAY<DOUBLE> columns."""
    return F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda acc, t: acc + t)


def dot_fixed(a: str, b: str, n: int, b_offset: int = 0):
    """Dot product of ARRAY<DOUBLE> columns ``a`` and ``b`` (SQL names or
    expressions) over ``n`` elements, as one arithmetic expression
    (codegen-friendly, unlike a lambda fold); ``b`` is read from
    ``b_offset`` on."""
    return F.expr(" + ".join(f"{a}[{i}] * {b}[{i + b_offset}]" for i in range(n)))
