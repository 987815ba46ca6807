"""Recursive indicators.

The latest value of each key is a fold over its ordered closes with ``aggregate``, inside
the JVM; whole series, which a fold can only give in quadratic time, are grouped pandas.
A key's history is bounded by the load window (450 days), not by the corpus.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.reasons import DIVISION_UNDEFINED, INSUFFICIENT_HISTORY, result


#: Calendar days before a key's last bar that its folds read.
HISTORY_DAYS = 450


def history(bars: DataFrame, fields: list[str] = ("high", "low", "close"), days: int = HISTORY_DAYS) -> DataFrame:
    """``key, bucket, h``: each key's bars of the last ``days`` days in order as one array, and its last bucket."""
    entry = F.struct("bucket", *fields)
    recent = F.col("bucket") >= F.max("bucket").over(Window.partitionBy("key")) - F.expr(f"INTERVAL '{days}' DAY")
    return bars.withColumn("_recent", recent).where("_recent").groupBy("key").agg(F.max("bucket").alias("bucket"), F.array_sort(F.collect_list(entry)).alias("h"))


def _mean(values: Column, n: int) -> Column:
    return F.aggregate(F.slice(values, 1, n), F.lit(0.0), lambda a, x: a + x) / n


def _rest(values: Column, n: int) -> Column:
    """What follows the first n values."""
    return F.slice(values, n + 1, F.greatest(F.size(values) - n, F.lit(0)))


def _smooth(values: Column, n: int, alpha: float) -> Column:
    return F.aggregate(_rest(values, n), _mean(values, n), lambda e, x: F.lit(alpha) * x + F.lit(1 - alpha) * e)


def _wilder(values: Column, n: int) -> Column:
    return F.aggregate(_rest(values, n), _mean(values, n), lambda e, x: (e * (n - 1) + x) / n)


def _macd(c: Column, fast: int = 12, slow: int = 26, trigger: int = 9) -> Column:
    """(line, trigger) at the last close: one fold that carries both means and the mean of their difference, seeded with its first values' mean."""
    weight = lambda n, x, e: F.lit(2 / (n + 1)) * x + F.lit(1 - 2 / (n + 1)) * e
    first = F.slice(c, 1, slow)
    a, b = _smooth(first, fast, 2 / (fast + 1)), _mean(c, slow)
    state = lambda a, b, n, total, t: F.struct(a.alias("a"), b.alias("b"), n.alias("n"), total.alias("total"), t.alias("t"))

    def step(s, x):
        a, b, n = weight(fast, x, s["a"]), weight(slow, x, s["b"]), s["n"] + 1
        total = F.when(n <= trigger, s["total"] + (a - b)).otherwise(s["total"])
        return state(a, b, n, total, F.when(n <= trigger, total / trigger).otherwise(weight(trigger, a - b, s["t"])))

    start = state(a, b, F.lit(1), a - b, F.lit(0.0))
    return F.aggregate(_rest(c, slow), start, step, lambda s: F.struct((s["a"] - s["b"]).alias("line"), s["t"].alias("trigger")))


def ema(n: int) -> Column:
    c = F.col("h.close")
    return result(_smooth(c, n, 2 / (n + 1)), (F.size("h") < n, INSUFFICIENT_HISTORY))


def _steps(f) -> Column:
    """f(previous, this) over neighbouring bars."""
    return F.zip_with(F.slice("h", 1, F.greatest(F.size("h") - 1, F.lit(0))), F.slice("h", 2, F.greatest(F.size("h") - 1, F.lit(0))), f)


def rsi(n: int = 14) -> Column:
    """Wilder's: 100 when nothing was lost, undefined when nothing moved."""
    gain = _wilder(_steps(lambda a, b: F.greatest(b["close"] - a["close"], F.lit(0.0))), n)
    loss = _wilder(_steps(lambda a, b: F.greatest(a["close"] - b["close"], F.lit(0.0))), n)
    value = F.when(loss == 0, 100.0).otherwise(F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + F.try_divide(gain, loss)))
    return result(value, (F.size("h") < n + 1, INSUFFICIENT_HISTORY), ((loss == 0) & (gain == 0), DIVISION_UNDEFINED))


def true_range(a: Column, b: Column) -> Column:
    return F.greatest(b["high"] - b["low"], F.abs(b["high"] - a["close"]), F.abs(b["low"] - a["close"]))


def atr(n: int = 14) -> Column:
    return result(_wilder(_steps(true_range), n), (F.size("h") < n + 1, INSUFFICIENT_HISTORY))


def latest_indicators(bars: DataFrame) -> DataFrame:
    """``key, bucket`` and ema_12, ema_26, rsi_14, atr_14, atr_pct_14, macd_line, macd_trigger, macd_histogram."""
    h = history(bars)
    c = F.col("h.close")
    out = h.withColumns({"ema_12": ema(12), "ema_26": ema(26), "rsi_14": rsi(), "atr_14": atr(), "_macd": F.when(F.size(c) >= 26, _macd(c))})
    last = F.element_at(c, -1)
    out = out.withColumns(
        {
            "atr_pct_14": result(F.try_divide(F.col("atr_14.value"), last), (F.col("atr_14.reason").isNotNull(), INSUFFICIENT_HISTORY), (last <= 0, DIVISION_UNDEFINED)),
            "macd_line": result(F.col("_macd.line"), (F.size(c) < 26, INSUFFICIENT_HISTORY)),
            "macd_trigger": result(F.col("_macd.trigger"), (F.size(c) < 34, INSUFFICIENT_HISTORY)),
        }
    )
    # the difference of the two rounded values, so that it is 0 where they agree
    out = out.withColumn("macd_histogram", result(F.col("macd_line.value") - F.col("macd_trigger.value"), (F.size(c) < 34, INSUFFICIENT_HISTORY)))
    return out.drop("h", "_macd")


def ema_path(x: np.ndarray, n: int) -> np.ndarray:
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        out[n - 1] = x[:n].mean()
        for i in range(n, len(x)):
            out[i] = 2 / (n + 1) * x[i] + (1 - 2 / (n + 1)) * out[i - 1]
    return out


def wilder_path(x: np.ndarray, n: int) -> np.ndarray:
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        out[n - 1] = x[:n].mean()
        for i in range(n, len(x)):
            out[i] = (out[i - 1] * (n - 1) + x[i]) / n
    return out


def adx_path(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int = 14) -> np.ndarray:
    """Average directional index, from the bar 2n - 1 on."""
    out = np.full(len(close), np.nan)
    if len(close) < 2 * n:
        return out
    up, down = np.diff(high), -np.diff(low)
    plus, minus = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
    tr = np.maximum(high[1:] - low[1:], np.maximum(abs(high[1:] - close[:-1]), abs(low[1:] - close[:-1])))
    a, p, m = wilder_path(tr, n)[n - 1 :], wilder_path(plus, n)[n - 1 :], wilder_path(minus, n)[n - 1 :]
    with np.errstate(divide="ignore", invalid="ignore"):
        pdi, mdi = np.where(a > 0, 100 * p / a, 0.0), np.where(a > 0, 100 * m / a, 0.0)
        dx = np.where(pdi + mdi > 0, 100 * abs(pdi - mdi) / (pdi + mdi), 0.0)
    out[2 * n - 1 :] = wilder_path(dx, n)[n - 1 :][: len(out) - 2 * n + 1]
    return out


SERIES_SCHEMA = "key string, bucket timestamp, ema_12 double, rsi_14 double, atr_14 double, adx_14 double, bollinger_mid double, bollinger_width double, vwap double"


def indicator_series(bars: DataFrame, n: int = 14, band: int = 20) -> DataFrame:
    """Whole series of each key: EMA, RSI, ATR (first range high - low), ADX, Bollinger middle and width, VWAP."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bucket")
        h, lo, c, v = (pdf[x].to_numpy(float) for x in ("high", "low", "close", "volume"))
        step = np.diff(c)
        gain, loss = wilder_path(np.maximum(step, 0), n), wilder_path(np.maximum(-step, 0), n)
        with np.errstate(divide="ignore", invalid="ignore"):
            strength = np.where(loss == 0, np.where(gain > 0, 100.0, np.nan), 100 - 100 / (1 + gain / loss))
            typical = np.cumsum((h + lo + c) / 3 * v) / np.cumsum(v)
        tr = np.concatenate([h[:1] - lo[:1], np.maximum(h[1:] - lo[1:], np.maximum(abs(h[1:] - c[:-1]), abs(lo[1:] - c[:-1])))])
        roll = pd.Series(c).rolling(band)
        out = pd.DataFrame({"key": pdf["key"].to_numpy(), "bucket": pdf["bucket"].to_numpy(), "ema_12": ema_path(c, 12), "rsi_14": np.concatenate([[np.nan], strength]) if len(c) else strength, "atr_14": wilder_path(tr, n), "adx_14": adx_path(h, lo, c, n), "bollinger_mid": roll.mean(), "bollinger_width": roll.std(ddof=0), "vwap": typical})
        return out.astype(object).where(out.notna(), None)

    return bars.select("key", F.col("bucket").cast("timestamp").alias("bucket"), "high", "low", "close", "volume").groupBy("key").applyInPandas(run, SERIES_SCHEMA)


__all__ = ["history", "ema", "rsi", "atr", "latest_indicators", "indicator_series"]
