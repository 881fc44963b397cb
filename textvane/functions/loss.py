"""Loss expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: how far predictions and labels are kept from 0 and 1.
EPS = 0.0000005


def log1p_exp(x: Column) -> Column:
    """log(1 + e^x) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def clip(p: Column, eps: float = EPS) -> Column:
    return F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))


def log_loss(prediction: Column, label: Column, eps: float = EPS) -> Column:
    """Twice log(1 + e^(-2yp)) of the clipped label y and prediction p."""
    return 2 * log1p_exp(-2 * clip(label, eps) * clip(prediction, eps))
