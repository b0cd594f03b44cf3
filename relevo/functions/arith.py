"""Arithmetic column helpers used by scoring, normalisation and evaluation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from relevo.functions.fixed import EPS_LIFT


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sigmoid(x) -> Column:
    """Logistic function (F-8)."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x)))


def clip01(x) -> Column:
    """``max(0, min(1, x))`` (P10)."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), _c(x)))


def lift_pct(new, base) -> Column:
    """Relative change in percent, ``(new - base) / (base + 1e-9) * 100`` (F-15)."""
    return (_c(new) - _c(base)) / (_c(base) + F.lit(EPS_LIFT)) * F.lit(100.0)


def affine_blend(a, b, alpha: float) -> Column:
    """``alpha * a + (1 - alpha) * b`` (F-14)."""
    return F.lit(alpha) * _c(a) + F.lit(1.0 - alpha) * _c(b)
