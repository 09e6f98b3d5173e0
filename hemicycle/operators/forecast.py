"""A grid of seasonal autoregressions fitted by least squares, one task per (series, setting)."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _differenced(y: np.ndarray, d: int, seasonal_d: int, period: int) -> np.ndarray:
    for _ in range(seasonal_d):
        y = y[period:] - y[:-period]
    for _ in range(d):
        y = np.diff(y)
    return y


def fit_forecast(y: np.ndarray, x: np.ndarray, lags: Sequence[int], d: int, seasonal_d: int, period: int, holdout: int) -> dict:
    """An autoregression on the lags (after d ordinary and seasonal_d seasonal differences) with regressors x, fitted without the last `holdout` values, which it then forecasts step by step.

    rmse and mae are those of the forecasts, aic that of the fit; all None where there are fewer rows than coefficients.
    """
    lost = d + seasonal_d * period
    z, u = _differenced(y, d, seasonal_d, period), x[lost:]
    first, train = max(lags, default=0), len(z) - holdout
    row = lambda s, t: np.concatenate([[1.0], [s[t - k] for k in lags], u[t]])
    rows = [row(z, t) for t in range(first, train)]
    width = 1 + len(lags) + x.shape[1]
    if holdout < 1 or len(rows) <= width:
        return {"rmse": None, "mae": None, "aic": None}
    a, b = np.array(rows), z[first:train]
    coef = np.linalg.lstsq(a, b, rcond=None)[0]
    rss = float(((b - a @ coef) ** 2).sum())
    known = list(z[:train])
    for t in range(train, len(z)):
        known.append(float(row(known, t) @ coef))
    # back to levels: an ordinary and a seasonal difference are undone from the values before
    full = list(y[: len(y) - holdout])
    for step in known[train:]:
        level = step
        if d == 1 and seasonal_d == 0:
            level += full[-1]
        elif d == 0 and seasonal_d == 1:
            level += full[-period]
        elif d == 1 and seasonal_d == 1:
            level += full[-1] + full[-period] - full[-period - 1]
        full.append(level)
    error = np.array(full[len(y) - holdout :]) - y[len(y) - holdout :]
    n = len(rows)
    return {"rmse": float(np.sqrt((error**2).mean())), "mae": float(np.abs(error).mean()), "aic": n * math.log(max(rss, 1e-300) / n) + 2 * (width + 1)}


def forecast_grid(rows: DataFrame, key: str, time: str, value: str, orders: Sequence[tuple[int, int]] = ((1, 0), (2, 0), (1, 1)), seasonal: Sequence[tuple[int, int]] = ((0, 0), (1, 0), (0, 1)), exog: Sequence[Sequence[str]] = ((),), period: int = 12, holdout: int = 12) -> DataFrame:
    """key, setting (p, d, P, D, the regressors), rmse, mae, aic and `best`: the setting with the least (rmse, aic) of the key.

    d and D are at most 1. A series is a few hundred values, and each (series, setting) is a group of its own.
    """
    settings = [(p, d, sp, sd, list(names)) for p, d in orders for sp, sd in seasonal for names in exog]
    cells = F.explode(F.array(*(F.struct(F.lit(p).alias("p"), F.lit(d).alias("d"), F.lit(sp).alias("sp"), F.lit(sd).alias("sd"), F.lit(",".join(n)).alias("exog")) for p, d, sp, sd, n in settings)))
    held = rows.withColumn("s", cells).select("*", "s.*").drop("s")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time)
        s = pdf.iloc[0]
        names = [n for n in s["exog"].split(",") if n]
        lags = [*range(1, int(s["p"]) + 1), *(period * i for i in range(1, int(s["sp"]) + 1))]
        out = fit_forecast(pdf[value].to_numpy(float), pdf[names].to_numpy(float).reshape(len(pdf), len(names)), lags, int(s["d"]), int(s["sd"]), period, holdout)
        return pd.DataFrame([{key: s[key], "p": int(s["p"]), "d": int(s["d"]), "sp": int(s["sp"]), "sd": int(s["sd"]), "exog": s["exog"]} | out])

    kind = dict(rows.dtypes)[key]
    out = held.groupBy(key, "p", "d", "sp", "sd", "exog").applyInPandas(run, f"{key} {kind}, p int, d int, sp int, sd int, exog string, rmse double, mae double, aic double")
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col("rmse").asc_nulls_last(), F.col("aic").asc_nulls_last(), "p", "d", "sp", "sd", "exog"))
    return out.withColumn("best", (place == 1) & F.col("rmse").isNotNull())
