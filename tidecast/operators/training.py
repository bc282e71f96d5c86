"""F11 and the non-linear F9: training by epochs with a validation curve.

* ``training_curve``: gradient descent on the linear look-back model of every
  series at once. The train and test Gram matrices (K1) hold everything an
  epoch needs -- gradient and both losses -- so all epochs of a series are a
  fold inside its row, after one aggregate over the windows.
* ``train_network``: one network with a hidden layer over the windows of all
  series (the look-back network's inputs and outputs). An epoch is one
  aggregate over the staged windows: gradient sums, and the squared errors
  of the train and the test windows. The driver holds the weights only.
* ``tree_forecast``: boosted trees (``pyspark.ml``) over the same windows.

All stop when the validation loss has not improved for ``patience`` epochs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import KEYS
from ..session import cut_lineage
from .linalg import gram, packed
from .lookback import lookback_frame
from .windows import LOOK_BACK, minmax_unscale

# Fixed values of the look-back network: epochs and patience.
EPOCHS = 20
PATIENCE = 10


def _full(tri: str, q: int) -> str:
    """Rows of the symmetric matrix behind a packed triangle."""
    rows = (", ".join(f"{tri}[{packed(min(i, j), max(i, j), q)}]" for j in range(q - 1)) for i in range(q - 1))
    return "array(" + ", ".join(f"array({r})" for r in rows) + ")"


def training_curve(series: DataFrame, k: int = LOOK_BACK, epochs: int = EPOCHS, patience: int = PATIENCE,
                   rate: float = 1.0, keys=KEYS) -> DataFrame:
    """F11 by series: (keys, epoch, train_loss, val_loss, best, stopped).

    Losses are mean squared errors on the scaled values, before the epoch's
    step, starting from zero weights; the step is ``rate`` / trace of the
    train Gram matrix, which is short enough to descend always for rate up
    to 1. ``best`` marks the lowest validation loss; ``stopped`` the epoch
    after which ``patience`` epochs brought no lower one. A series without
    test windows has null ``val_loss`` and never stops early.
    """
    p = k + 1
    lb = lookback_frame(series, k, "train", keys)
    rows = lb.select(*keys, "split", F.concat(F.array(F.lit(1.0)), F.col("x")).alias("x"), "y_scaled")
    g = gram(rows, [*keys, "split"], "x", "y_scaled", p)
    part = {s: g.where(F.col("split") == s).select(
        *keys, F.col("n").alias(f"n_{s}"), F.expr(_full("tri", p + 1)).alias(f"g_{s}"),
        F.expr("array(" + ", ".join(f"tri[{packed(i, p, p + 1)}]" for i in range(p)) + ")").alias(f"b_{s}"),
        F.col("tri")[packed(p, p, p + 1)].alias(f"yy_{s}")) for s in ("train", "test")}
    both = part["train"].join(part["test"], list(keys), "left")
    dot = "aggregate(zip_with({0}, {1}, (u, v) -> u * v), 0D, (a, v) -> a + v)"
    product = "transform({g}, r -> " + dot.format("r", "{w}") + ")"

    def loss(s, w):
        gw = product.format(g=f"g_{s}", w=w)
        found = f"(yy_{s} - 2D * {dot.format(f'b_{s}', w)} + {dot.format(gw, w)}) / n_{s}"
        return f"IF(n_{s} IS NULL, NULL, greatest({found}, 0D))"  # greatest alone would pass over a null

    trace = " + ".join(f"g_train[{i}][{i}]" for i in range(p))
    step = f"zip_with(s.w, zip_with({product.format(g='g_train', w='s.w')}, b_train, (u, v) -> u - v), " \
           f"(w, d) -> w - IF(trace > 0, {float(rate)}D / trace, 0D) * d)"
    found = f"""aggregate(sequence(1, {int(epochs)}),
        named_struct('w', transform(b_train, v -> 0D), 'low', CAST(NULL AS DOUBLE), 'at', 0, 'stopped', false,
                     'out', CAST(array() AS ARRAY<STRUCT<epoch: INT, train_loss: DOUBLE, val_loss: DOUBLE>>)),
        (s, k) -> IF(s.stopped, s, aggregate(array(named_struct('train', {loss('train', 's.w')}, 'val', {loss('test', 's.w')})), s,
            (t, l) -> named_struct('w', {step},
                'low', IF(l.val < s.low OR s.low IS NULL, l.val, s.low),
                'at', IF(l.val < s.low OR s.low IS NULL, k, s.at),
                'stopped', l.val IS NOT NULL AND NOT (l.val < s.low OR s.low IS NULL) AND k - s.at >= {int(patience)},
                'out', concat(s.out, array(named_struct('epoch', k, 'train_loss', l.train, 'val_loss', l.val)))))))"""
    curve = both.withColumn("trace", F.expr(trace)).withColumn("c", F.expr(found))
    return curve.select(*keys, F.col("c.at").alias("at"), F.col("c.stopped").alias("ended"), F.size("c.out").alias("last"),
                        F.explode("c.out").alias("e")) \
        .select(*keys, "e.epoch", "e.train_loss", "e.val_loss",
                (F.col("e.val_loss").isNotNull() & (F.col("e.epoch") == F.col("at"))).alias("best"),
                (F.col("ended") & (F.col("e.epoch") == F.col("last"))).alias("stopped"))


class Network:
    """Weights of a network with one hidden layer (tanh) and one output."""

    def __init__(self, inputs: int, hidden: int, seed: int):
        rng = np.random.default_rng(seed)
        self.shapes = [(inputs, hidden), (hidden,), (hidden,), (1,)]
        self.parts = [rng.normal(size=self.shapes[0]) / np.sqrt(inputs), np.zeros(hidden),
                      rng.normal(size=hidden) / np.sqrt(hidden), np.zeros(1)]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts])

    def put(self, flat: np.ndarray) -> None:
        at = np.cumsum([int(np.prod(s)) for s in self.shapes])[:-1]
        self.parts = [p.reshape(s) for p, s in zip(np.split(flat, at), self.shapes, strict=True)]

    def predict(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.parts
        return np.tanh(x @ w1 + b1) @ w2 + b2[0]

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        """Squared error and its gradient, summed over rows."""
        w1, b1, w2, b2 = self.parts
        h = np.tanh(x @ w1 + b1)
        e = h @ w2 + b2[0] - y
        dh = np.outer(2 * e, w2) * (1 - h * h)
        return float(e @ e), np.concatenate([(x.T @ dh).ravel(), dh.sum(0), 2 * h.T @ e, [2 * e.sum()]])


class Adam:
    """Adaptive steps of a weight vector (published method, usual constants)."""

    def __init__(self, size: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * g
        self.v = 0.999 * self.v + 0.001 * g * g
        return w - self.rate * (self.m / (1 - 0.9 ** self.t)) / (np.sqrt(self.v / (1 - 0.999 ** self.t)) + 1e-8)


def _epoch(windows: DataFrame, net: Network) -> dict[str, tuple[int, float, np.ndarray | None]]:
    """split -> (windows, squared error, gradient; test windows have none).

    Partial sums of a task leave it as (split, place, value) rows and are
    added up by place, so no task and not the driver holds a list that grows
    with the number of tasks.
    """
    def sums(batches):
        total: dict[str, np.ndarray] = {}
        for pdf in batches:
            for split, rows in pdf.groupby("split"):
                x, y = np.stack(rows["x"].to_numpy()), rows["y_scaled"].to_numpy(float)
                if split == "train":
                    sse, grad = net.gradient(x, y)
                else:
                    e = net.predict(x) - y
                    sse, grad = float(e @ e), np.zeros(0)
                part = np.concatenate([[len(rows), sse], grad])
                total[split] = total[split] + part if split in total else part
        for split, part in total.items():
            yield pd.DataFrame({"split": split, "place": np.arange(len(part)), "value": part})

    found = windows.select("split", "x", "y_scaled").mapInPandas(sums, "split string, place long, value double") \
        .groupBy("split", "place").agg(F.sum("value").alias("value")).collect()  # numbers of the network, not of the data
    out = {}
    for split in {r["split"] for r in found}:
        v = np.array([r["value"] for r in sorted((r for r in found if r["split"] == split), key=lambda r: r["place"])])
        out[split] = (int(round(v[0])), float(v[1]), v[2:] if len(v) > 2 else None)
    return out


def train_network(windows: DataFrame, k: int, hidden: int = 16, epochs: int = 40, patience: int = PATIENCE,
                  rate: float = 0.02, seed: int = 1) -> tuple[Network, list[tuple]]:
    """(network of the best epoch, curve). ``windows``: staged rows (split, x,
    y_scaled). The curve has (epoch, train_loss, val_loss, best, stopped)
    for the weights before each epoch's step."""
    net = Network(k, hidden, seed)
    adam, best, curve = Adam(len(net.flat()), rate), None, []
    for epoch in range(1, epochs + 1):
        sums = _epoch(windows, net)
        if "train" not in sums:
            break
        n, sse, grad = sums["train"]
        val = sums["test"][1] / sums["test"][0] if "test" in sums else None
        if best is None or (val is not None and val < best[0]) or val is None:
            best = (val, epoch, net.flat())
        stopped = val is not None and epoch - best[1] >= patience
        curve.append([epoch, sse / n, val, False, stopped])
        if stopped:
            break
        net.put(adam.step(net.flat(), grad / n))
    if best is not None:
        net.put(best[2])
        curve[best[1] - 1][3] = best[0] is not None
    return net, [tuple(r) for r in curve]


def network_forecast(series: DataFrame, k: int = LOOK_BACK, keys=KEYS, **training) -> tuple[DataFrame, DataFrame]:
    """F9 with a network: (forecast rows like ``lookback_forecast``, curve)."""
    spark = series.sparkSession
    lb = cut_lineage(lookback_frame(series, k, "train", keys))
    net, curve = train_network(lb, k, **training)

    @F.pandas_udf("double")
    def predicted(x: pd.Series) -> pd.Series:
        return pd.Series(net.predict(np.stack(x.to_numpy())) if len(x) else [], dtype=float)

    pred = minmax_unscale(lb.withColumn("p", predicted("x")), "p", "yhat")
    rows = pred.select(*keys, F.lit("lookback_network").alias("model"), F.col("split").alias("segment"), "ds", "y", "yhat")
    return rows, spark.createDataFrame(curve, "epoch INT, train_loss DOUBLE, val_loss DOUBLE, best BOOLEAN, stopped BOOLEAN")


def tree_forecast(series: DataFrame, k: int = LOOK_BACK, trees: int = 20, depth: int = 4, rate: float = 0.2,
                  keys=KEYS) -> DataFrame:
    """F9 with boosted trees, trained once over the train windows of all series."""
    lb = cut_lineage(lookback_frame(series, k, "train", keys)).withColumn("features", array_to_vector("x"))
    gbt = GBTRegressor(featuresCol="features", labelCol="y_scaled", predictionCol="p", maxIter=trees, maxDepth=depth,
                       stepSize=rate, seed=1)
    fitted = gbt.fit(lb.where(F.col("split") == "train").select("features", "y_scaled"))
    pred = minmax_unscale(fitted.transform(lb).drop("features"), "p", "yhat")
    return pred.select(*keys, F.lit("lookback_trees").alias("model"), F.col("split").alias("segment"), "ds", "y", "yhat")
