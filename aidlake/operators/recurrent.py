"""Water-level forecasting with small recurrent networks in numpy, one per station: a plain RNN and an LSTM, compared."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

STATE, PASSES, RATE = 8, 120, 0.02


def _forward(kind: str, p: dict, x: np.ndarray) -> tuple[np.ndarray, list]:
    h, c, kept = np.zeros((len(x), STATE)), np.zeros((len(x), STATE)), []
    for t in range(x.shape[1]):
        a = np.outer(x[:, t], p["w"]) + h @ p["u"] + p["b"]
        if kind == "rnn":
            new, gates, old_c = np.tanh(a), None, None
        else:
            i, f, o, g = (1 / (1 + np.exp(-a[:, :STATE])), 1 / (1 + np.exp(-a[:, STATE : 2 * STATE])), 1 / (1 + np.exp(-a[:, 2 * STATE : 3 * STATE])), np.tanh(a[:, 3 * STATE :]))
            old_c, c = c, f * c + i * g
            new, gates = o * np.tanh(c), (i, f, o, g, c)
        kept.append((h, new, gates, old_c))
        h = new
    return h @ p["v"] + p["d"], kept


def _gradient(kind: str, p: dict, x: np.ndarray, kept: list, error: np.ndarray) -> dict:
    out = {k: np.zeros_like(v) for k, v in p.items()}
    out["v"], out["d"] = kept[-1][1].T @ error, error.sum(keepdims=True)
    dh, dc = np.outer(error, p["v"]), np.zeros((len(x), STATE))
    for t in range(x.shape[1] - 1, -1, -1):
        h, new, gates, old_c = kept[t]
        if kind == "rnn":
            da = dh * (1 - new * new)
        else:
            i, f, o, g, c = gates
            tc = np.tanh(c)
            dc = dc + dh * o * (1 - tc * tc)
            da = np.concatenate([dc * g * i * (1 - i), dc * old_c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
            dc = dc * f
        out["w"] += x[:, t] @ da
        out["u"] += h.T @ da
        out["b"] += da.sum(0)
        dh = da @ p["u"].T
    return out


def fit(kind: str, x: np.ndarray, y: np.ndarray, seed: int = 0) -> dict:
    """Parameters after full-batch Adam on the squared error; x (windows, lags) and y are scaled to unit variance."""
    r, width = np.random.default_rng(seed), STATE * (1 if kind == "rnn" else 4)
    p = {"w": r.normal(0, 0.5, width), "u": r.normal(0, 0.3, (STATE, width)), "b": np.zeros(width), "v": r.normal(0, 0.3, STATE), "d": np.zeros(1)}
    m, s = ({k: np.zeros_like(v) for k, v in p.items()} for _ in "ms")
    for step in range(1, PASSES + 1):
        got, kept = _forward(kind, p, x)
        for k, g in _gradient(kind, p, x, kept, (got - y) / len(y)).items():
            m[k] += 0.1 * (g - m[k])
            s[k] += 0.001 * (g * g - s[k])
            p[k] = p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return p


def forecast(df: DataFrame, key: str, ts: str, value: str, lags: int = 12, held_out: float = 0.25, seed: int = 0) -> DataFrame:
    """(station, model, n, rmse): errors of "last value", "rnn" and "lstm" on the last part of each station's series.

    A station's readings are one group: a series of some years, bounded by time rather than by the number of rows
    of the table; stations are what is spread over executors. Missing readings are left out; a station with fewer
    than 4 * lags readings gives no row.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(ts)[value].dropna().to_numpy(float)
        cols = ["station", "model", "n", "rmse"]
        if len(v) < 4 * lags:
            return pd.DataFrame([], columns=cols)
        mean, sd = v.mean(), v.std() or 1.0
        z = (v - mean) / sd
        x, y = np.lib.stride_tricks.sliding_window_view(z, lags)[:-1], z[lags:]
        cut = int(len(y) * (1 - held_out))
        found = {"last value": x[cut:, -1]} | {k: _forward(k, fit(k, x[:cut], y[:cut], seed), x[cut:])[0] for k in ("rnn", "lstm")}
        return pd.DataFrame([(str(pdf[key].iloc[0]), k, len(y) - cut, float(np.sqrt(np.mean((f - y[cut:]) ** 2)) * sd)) for k, f in found.items()], columns=cols)

    return df.select(key, ts, value).groupBy(key).applyInPandas(one, "station string, model string, n long, rmse double")
