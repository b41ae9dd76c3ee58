"""Scaling expressions built on statistics frozen at the origin."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgrid.config import VOLATILITY_OPTIONS, Settings


def clean(value: Column) -> Column:
    """Numeric value with NaN turned into NULL."""
    value = value.cast("double")
    return F.when(~F.isnan(value), value)


def standardize(price: Column, mu: Column, sigma: Column) -> Column:
    return (price - mu) / sigma


def invert(z: Column, mu: Column, sigma: Column) -> Column:
    return mu + sigma * z


def standardize_array(prices: Column, mu: Column, sigma: Column) -> Column:
    return F.transform(prices, lambda p: (p - mu) / sigma)


def invert_array(z: Column, mu: Column, sigma: Column) -> Column:
    return F.transform(z, lambda v: mu + sigma * v)


def floored_sigma(std: Column, mu: Column, settings: Settings) -> Column:
    """Standard deviation with an absolute and a relative lower bound."""
    return F.greatest(
        std, F.abs(mu) * settings.sigma_floor_rel, F.lit(settings.sigma_floor_abs)
    )


def level_features(mu: Column, sigma: Column, mu_7d: Column, volatility: str) -> list[Column]:
    """Level, volatility and recent trend of a window."""
    if volatility not in VOLATILITY_OPTIONS:
        raise ValueError(f"volatility must be one of {VOLATILITY_OPTIONS}")
    spread = sigma / 1000 if volatility == "sigma_over_1000" else F.log1p(sigma)
    return [mu / 1000, spread, (mu_7d - mu) / sigma]
