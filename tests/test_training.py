"""F11 curves against plain loops; non-linear F9 against the linear form."""

import numpy as np
import pytest

from tidecast.operators import evaluate as EV
from tidecast.operators import lookback as LB
from tidecast.operators import training as TRN

from .helpers import daily_frame


def logistic(n, seed):
    """A chaotic map: the next value is a parabola of the last, nothing linear."""
    x = [0.2 + 0.01 * seed]
    for _ in range(n - 1):
        x.append(3.9 * x[-1] * (1 - x[-1]))
    return [100 * v for v in x]


def windows(y, k):
    y = np.asarray(y, float)
    cut = int(np.floor(len(y) * 0.8))
    lo, hi = y[:cut].min(), y[:cut].max()
    s = (y - lo) / (hi - lo) if hi > lo else y - lo
    make = lambda a: (np.array([a[i:i + k] for i in range(len(a) - k)]).reshape(-1, k), a[k:])
    return make(s[:cut]), make(s[cut:])


def plain_curve(y, k, epochs, patience, rate=1.0):
    (x, t), (xv, tv) = windows(y, k)
    x, xv = np.column_stack([np.ones(len(x)), x]), np.column_stack([np.ones(len(xv)), xv])
    w, out, low, at = np.zeros(k + 1), [], None, 0
    for epoch in range(1, epochs + 1):
        train = float(((x @ w - t) ** 2).mean())
        val = float(((xv @ w - tv) ** 2).mean()) if len(xv) else None
        if val is not None and (low is None or val < low):
            low, at = val, epoch
        stopped = val is not None and epoch - at >= patience
        out.append([epoch, train, val, False, stopped])
        if stopped:
            break
        w = w - rate / (x * x).sum() * (x.T @ (x @ w - t))
    if at:
        out[at - 1][3] = True
    return out


def rows(df):
    return [(r["epoch"], r["train_loss"], r["val_loss"], r["best"], r["stopped"]) for r in df.orderBy("epoch").collect()]


def close(got, want):
    assert [(r[0], r[3], r[4]) for r in got] == [(r[0], r[3], r[4]) for r in want]
    assert [r[1] for r in got] == pytest.approx([r[1] for r in want], abs=1e-9)
    assert [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=1e-9)


@pytest.mark.parametrize("k, epochs, patience", [(3, 30, 2), (30, 20, 10), (1, 12, 1)])
def test_curve_equals_a_plain_loop(spark, k, epochs, patience):
    rng = np.random.default_rng(k)
    # the level falls in the test part: the validation loss turns up again
    y = {"a/turn": [10.0 + rng.normal() + (0 if i < 160 else -6) for i in range(300)], "a/saw": [float(i % 7) for i in range(260)]}
    df = daily_frame(spark, y["a/turn"], repo="a/turn").unionByName(daily_frame(spark, y["a/saw"], repo="a/saw"))
    curve = TRN.training_curve(df, k, epochs, patience).cache()
    for repo, v in y.items():
        close(rows(curve.where(f"repo = '{repo}'")), plain_curve(v, k, epochs, patience))


def test_curve_stops_and_short_series(spark):
    y = [1.0] * 80 + [9.0] * 20 + [1.0] * 25
    df = daily_frame(spark, y, repo="a/jump").unionByName(daily_frame(spark, y[:9], repo="a/short"))
    got = rows(TRN.training_curve(df.where("repo = 'a/jump'"), 3, 50, 4))
    close(got, plain_curve(y, 3, 50, 4))
    # nine days: seven to train with, two to test, no window of three fits there
    short = rows(TRN.training_curve(df.where("repo = 'a/short'"), 3, 5, 1))
    assert len(short) == 5 and all(r[2] is None and not r[3] and not r[4] for r in short)


def plain_network(series, k, hidden, epochs, patience, rate, seed):
    parts = [windows(y, k) for y in series]
    x, t = np.concatenate([p[0][0] for p in parts]), np.concatenate([p[0][1] for p in parts])
    xv, tv = np.concatenate([p[1][0] for p in parts]), np.concatenate([p[1][1] for p in parts])
    rng = np.random.default_rng(seed)
    w1, b1 = rng.normal(size=(k, hidden)) / np.sqrt(k), np.zeros(hidden)
    w2, b2 = rng.normal(size=hidden) / np.sqrt(hidden), 0.0
    m = v = 0.0
    out, low, at = [], None, 0
    for epoch in range(1, epochs + 1):
        h, hv = np.tanh(x @ w1 + b1), np.tanh(xv @ w1 + b1)
        e, ev = h @ w2 + b2 - t, hv @ w2 + b2 - tv
        train, val = float((e * e).mean()), float((ev * ev).mean())
        if low is None or val < low:
            low, at = val, epoch
        out.append([epoch, train, val, False, epoch - at >= patience])
        if out[-1][4]:
            break
        d = (2 / len(t)) * e
        back = d[:, None] * w2 * (1 - h ** 2)
        g = np.concatenate([(x.T @ back).ravel(), back.sum(0), h.T @ d, [d.sum()]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g ** 2
        w = np.concatenate([w1.ravel(), b1, w2, [b2]]) \
            - rate * (m / (1 - 0.9 ** epoch)) / (np.sqrt(v / (1 - 0.999 ** epoch)) + 1e-8)
        w1, b1, w2, b2 = w[:k * hidden].reshape(k, hidden), w[k * hidden:-hidden - 1], w[-hidden - 1:-1], w[-1]
    out[at - 1][3] = True
    return out


def test_network_curve_equals_a_plain_loop(spark):
    ys = [logistic(200, 1), [float(i % 5) for i in range(150)]]
    df = daily_frame(spark, ys[0], repo="a/x").unionByName(daily_frame(spark, ys[1], repo="a/y")).repartition(3)
    _, curve = TRN.network_forecast(df, 4, hidden=5, epochs=8, patience=3, rate=0.05, seed=2)
    close(rows(curve), plain_network(ys, 4, 5, 8, 3, 0.05, 2))


def test_network_stops_when_validation_turns(spark):
    rng = np.random.default_rng(0)
    y = [5 + rng.normal() for _ in range(100)] + [25 + rng.normal() for _ in range(25)]
    _, curve = TRN.network_forecast(daily_frame(spark, y), 3, hidden=8, epochs=40, patience=3, rate=0.1)
    got = rows(curve)
    assert [r[4] for r in got].count(True) == 1 == [r[3] for r in got].count(True) and got[-1][4]
    best = next(r[0] for r in got if r[3])
    assert len(got) == best + 3


def test_trees_and_network_beat_the_line_on_a_map_without_one(spark):
    df = daily_frame(spark, logistic(400, 1), repo="a/p").unionByName(daily_frame(spark, logistic(400, 7), repo="a/q"))
    mse = lambda fc: {r["repo"]: r["mse"] for r in EV.mse(fc).collect()}
    line = mse(LB.lookback_forecast(df, k=3))
    trees = mse(TRN.tree_forecast(df, k=3))
    net, _ = TRN.network_forecast(df, 3, epochs=150, patience=150, rate=0.05)
    net = mse(net)
    assert set(trees) == set(net) == {"a/p", "a/q"}
    for repo in line:
        assert trees[repo] < 0.2 * line[repo] and net[repo] < 0.5 * line[repo]
