"""Interrupted time series: segmented regressions, placebo distributions, verdicts, changepoints.

Each (series, date) is an independent small regression in numpy, run as one group of a grouped
map. A placebo fit does not depend on the event, so every month is fitted once and the months
near each event are left out afterwards by a filter.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_MONTHS = 24
FIT_SCHEMA = "series string, date date, model string, n int, level_pct double, trend_pct double, level_p double, trend_p double, pre_mean double, post_mean double, alpha double, converged boolean"


def design(months: np.ndarray, cut: np.datetime64) -> np.ndarray:
    """Columns: constant, time, step, time since the step, indicators of February to December."""
    t = np.arange(len(months), dtype=float)
    post = (months >= cut.astype("datetime64[M]")).astype(float)
    since = np.maximum(np.cumsum(post) - 1, 0) * post
    of_year = months.astype("datetime64[M]").astype(int) % 12
    return np.column_stack([np.ones_like(t), t, post, since, *[(of_year == m).astype(float) for m in range(1, 12)]])


def glm(x: np.ndarray, y: np.ndarray, alpha: float = 0.0, rounds: int = 100, tol: float = 1e-8):
    """(coefficients, covariance, fitted means, converged) of a log-link Poisson (alpha 0) or NB2 model by reweighted least squares."""
    mu = (y + y.mean()) / 2 + 1e-3
    eta, deviance = np.log(mu), np.inf
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        w = mu / (1 + alpha * mu)
        z = eta + (y - mu) / mu
        xtw = x.T * w
        beta = np.linalg.pinv(xtw @ x) @ (xtw @ z)
        eta = np.clip(x @ beta, -30, 30)
        mu = np.exp(eta)
        with np.errstate(divide="ignore", invalid="ignore"):
            own = np.where(y > 0, y * np.log(y / mu), 0.0)
            now = 2 * np.sum(own - ((y - mu) if alpha == 0 else (y + 1 / alpha) * np.log((1 + alpha * y) / (1 + alpha * mu))))
        if abs(deviance - now) < tol * (abs(now) + 1e-8):
            return beta, np.linalg.pinv((x.T * (mu / (1 + alpha * mu))) @ x), mu, True
        deviance = now
    return beta, np.linalg.pinv((x.T * (mu / (1 + alpha * mu))) @ x), mu, False


def dispersion(y: np.ndarray, mu: np.ndarray, k: int) -> float:
    return max(1e-6, float(np.sum(((y - mu) ** 2 - mu) / mu**2) / max(len(y) - k, 1)))


def ols_hac(x: np.ndarray, y: np.ndarray, lags: int = 12):
    """Least squares with Newey-West covariance (Bartlett weights)."""
    inv = np.linalg.pinv(x.T @ x)
    beta = inv @ (x.T @ y)
    u = x * (y - x @ beta)[:, None]
    s = u.T @ u
    for lag in range(1, min(lags, len(y) - 1) + 1):
        g = u[lag:].T @ u[:-lag]
        s += (1 - lag / (lags + 1)) * (g + g.T)
    return beta, inv @ s @ inv


def fit(months: np.ndarray, y: np.ndarray, date: str, model: str = "nbinom") -> dict | None:
    """One interrupted series; None under 24 months or when the fit fails. The step starts with the date's month, the means are cut at the date itself."""
    if len(y) < MIN_MONTHS:
        return None
    cut, y = np.datetime64(date), y.astype(float)
    x = design(months, cut)
    alpha, ok = None, True
    try:
        if model == "ols_log":
            beta, cov = ols_hac(x, np.log1p(y))
        else:
            beta, cov, mu, ok = glm(x, y)
            if model == "nbinom":
                alpha = dispersion(y, mu, x.shape[1])
                beta, cov, _, ok = glm(x, y, alpha)
    except (np.linalg.LinAlgError, FloatingPointError):
        return None
    if not np.isfinite(beta).all():
        return None
    se = np.sqrt(np.maximum(np.diag(cov), 0))
    p = lambda i: math.erfc(abs(beta[i] / se[i]) / math.sqrt(2)) if se[i] > 0 else None
    before = months.astype("datetime64[D]") < cut
    return {
        "model": model, "n": len(y), "level_pct": float(np.expm1(np.clip(beta[2], -30, 30)) * 100), "trend_pct": float(np.expm1(np.clip(beta[3], -30, 30)) * 100), "level_p": p(2), "trend_p": p(3),
        "pre_mean": float(y[before].mean()) if before.any() else None, "post_mean": float(y[~before].mean()) if (~before).any() else None, "alpha": alpha, "converged": bool(ok),
    }


def fit_dates(series: DataFrame, dates: DataFrame, model: str = "nbinom") -> DataFrame:
    """Fits of every series (series, month_start, complaints; gap-free) at its dates (series, date)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("month_start")
        months = pdf["month_start"].to_numpy().astype("datetime64[M]")
        found = fit(months, pdf["complaints"].to_numpy(), str(pdf["date"].iloc[0])[:10], model)
        columns = [x.split()[0] for x in FIT_SCHEMA.split(", ")]
        return pd.DataFrame([{"series": pdf["series"].iloc[0], "date": pdf["date"].iloc[0]} | found] if found else [], columns=columns)

    # A series is months long; repeating it per date keeps each fit a task of its own.
    return series.select("series", "month_start", "complaints").join(dates, "series").groupBy("series", "date").applyInPandas(run, FIT_SCHEMA)


def placebo_dates(series: DataFrame, min_side: int = 12) -> DataFrame:
    """Months with at least ``min_side`` months before and after them in their series."""
    from pyspark.sql import Window

    w = Window.partitionBy("series")
    ranked = series.withColumn("_t", F.row_number().over(w.orderBy("month_start")) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    return ranked.where((F.col("_t") >= min_side) & (F.col("_t") < F.col("_n") - min_side)).select("series", F.col("month_start").alias("date"))


def placebo_test(real: DataFrame, placebo: DataFrame, exclude_months: int = 6) -> DataFrame:
    """How extreme each real level change is among those of all other months of its series."""
    p = placebo.select("series", F.col("date").alias("p_date"), F.abs("level_pct").alias("p"))
    apart = F.abs(12 * (F.year("date") - F.year("p_date")) + F.month("date") - F.month("p_date"))
    both = real.join(p, "series", "left").withColumn("p", F.when(apart > exclude_months, F.col("p")))
    out = both.groupBy("series", "date").agg(
        F.first("level_pct").alias("level_pct"), F.count("p").alias("placebos"), F.count_if(F.col("p") < F.abs("level_pct")).alias("_less"), F.count_if(F.col("p") >= F.abs("level_pct")).alias("as_large"),
        F.percentile("p", F.lit(0.5)).alias("placebo_median"), F.percentile("p", F.lit(0.95)).alias("placebo_p95"),
    )
    out = out.withColumn("percentile", F.try_divide(100 * F.col("_less"), F.col("placebos"))).drop("_less")
    return out.withColumn("verdict", F.when(F.col("placebos") == 0, "inconclusive").when(F.col("percentile") >= 95, "distinctive").when(F.col("percentile") >= 80, "suggestive").otherwise("NOT distinctive"))


def binary_segmentation(y: np.ndarray, penalty: float | None = None, jump: int = 5, min_size: int = 2) -> list[int]:
    """All break positions by greedy halving with squared-error cost; a split must gain more than the penalty (3 population deviations).

    A split changes no other segment's gains, so halving each segment while its best split gains
    enough finds the same breaks as taking the best split of all segments again and again.
    """
    penalty = 3 * float(y.std()) if penalty is None else penalty
    z = y - y.mean()
    s, q = np.concatenate([[0], np.cumsum(z)]), np.concatenate([[0], np.cumsum(z * z)])
    breaks, todo = [], [(0, len(y))]
    while todo:
        a, b = todo.pop()
        k = np.arange((a // jump + 1) * jump, b, jump)
        k = k[(k - a >= min_size) & (b - k >= min_size)]
        if not len(k):
            continue
        gain = (s[k] - s[a]) ** 2 / (k - a) + (s[b] - s[k]) ** 2 / (b - k) - (s[b] - s[a]) ** 2 / (b - a)
        best = int(gain.argmax())
        if gain[best] > penalty + 1e-9 * q[-1]:
            breaks.append(int(k[best]))
            todo += [(a, int(k[best])), (int(k[best]), b)]
    return sorted(breaks)


def changepoints(series: DataFrame, penalty: float | None = None, log: bool = True) -> DataFrame:
    """Breaks of each series with the mean before (since the previous break) and after (over as many months)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("month_start")
        y = pdf["complaints"].to_numpy(float)
        rows, last = [], 0
        if len(y) >= MIN_MONTHS:
            for k in binary_segmentation(np.log1p(y) if log else y, penalty):
                before, after = y[last:k].mean(), y[k : k + (k - last)].mean()
                rows.append((pdf["series"].iloc[0], pdf["month_start"].iloc[k], before, after, (after / before - 1) * 100 if before else None))
                last = k
        return pd.DataFrame(rows, columns=["series", "date", "before_mean", "after_mean", "change_pct"])

    return series.select("series", "month_start", "complaints").groupBy("series").applyInPandas(run, "series string, date date, before_mean double, after_mean double, change_pct double")


def fit_row(fits: DataFrame) -> DataFrame:
    """Fits with display rounding."""
    rounded = {"level_pct": 2, "trend_pct": 2, "level_p": 5, "trend_p": 5, "pre_mean": 1, "post_mean": 1, "alpha": 5}
    return fits.select(*[F.round(c, rounded[c]).alias(c) if c in rounded else c for c in fits.columns])
