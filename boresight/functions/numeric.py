"""Column builders: units, local coordinates, probabilities, bands."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

FT, PPG, BBL = 0.3048, 0.119826427, 0.158987294928
EARTH_M = 6_371_000.0


def ft_to_m(x: Column) -> Column:
    return x * FT


def m_to_ft(x: Column) -> Column:
    return x / FT


def ppg_to_sg(x: Column) -> Column:
    return x * PPG


def sg_to_ppg(x: Column) -> Column:
    return x / PPG


def bbl_to_m3(x: Column) -> Column:
    return x * BBL


def normalise_depth(value: Column, unit: Column, td_m: Column) -> Column:
    """struct(md, inferred): feet by unit; without a unit, metres unless only feet fit above the total depth."""
    u = F.lower(F.regexp_replace(F.coalesce(unit, F.lit("")), " ", ""))
    feet = u.isin("ft", "feet", "'")
    bare = u == ""
    as_feet = bare & (value > td_m * 1.1) & (value * FT <= td_m * 1.1)
    return F.struct(F.when(feet | as_feet, value * FT).otherwise(value).alias("md"), bare.alias("inferred"))


def normalise_mud_weight(value: Column, unit: Column) -> Column:
    """Specific gravity from ppg or SG; without a unit, by the plausible band; null where none fits."""
    u = F.lower(F.coalesce(unit, F.lit("")))
    sg, ppg = value.between(0.8, 2.6), value.between(6.5, 22.0)
    return F.when(u == "ppg", value * PPG).when(u.isin("sg", "s.g."), value).when(sg, value).when(ppg, value * PPG)


def normalise_rate(value: Column, unit: Column) -> Column:
    """Cubic metres an hour from barrels or cubic metres an hour."""
    return F.when(F.lower(F.coalesce(unit, F.lit(""))).startswith("b"), value * BBL).otherwise(value)


def xy_to_lat(y: Column, lat0: float) -> Column:
    return lat0 + F.degrees(y / EARTH_M)


def xy_to_lon(x: Column, lat0: float, lon0: float) -> Column:
    return lon0 + F.degrees(x / (EARTH_M * math.cos(math.radians(lat0))))


def band(x: Column, cuts: list[float]) -> Column:
    """1 + the number of cuts at or below x."""
    total = F.lit(1)
    for cut in cuts:
        total = total + (x >= cut).cast("int")
    return total


def logit(p: Column) -> Column:
    return F.ln(p / (1 - p))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def fuse(prior: Column, live: Column, gain: float = 0.8) -> Column:
    """A prior probability moved by live evidence; without any it stays."""
    x = logit(F.greatest(prior, F.lit(0.01))) + gain * logit(F.least(F.greatest(live, F.lit(0.02)), F.lit(0.98)))
    return F.when(live.isNull(), prior).otherwise(sigmoid(x))  # least and greatest pass over nulls


def _beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray, steps: int = 200) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    swap = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(swap, 1 - x, x), np.where(swap, b, a), np.where(swap, a, b)
    lg = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore"):
        front = np.exp(lg(a + b) - lg(a) - lg(b) + a * np.log(x) + b * np.log1p(-x)) / a
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, steps):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    return np.where(swap, 1 - front * h, front * h)


def beta_quantile_values(q: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Beta quantiles by bisection."""
    a, b = np.maximum(a, 1e-6), np.maximum(b, 1e-6)
    low, high = np.zeros_like(a), np.ones_like(a)
    for _ in range(60):
        mid = (low + high) / 2
        below = _beta_cdf(mid, a, b) < q
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


@F.pandas_udf(DoubleType())
def beta_quantile(q: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(beta_quantile_values(q.to_numpy(float), a.to_numpy(float), b.to_numpy(float)))
