"""Probability expressions of the audit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Budgets in 1-2-5 steps from 1 to 1e13.
BUDGETS = tuple(float(m * 10**e) for e in range(13) for m in (1, 2, 5)) + (1e13,)


def finite(x: Column) -> Column:
    """NULL for NaN and the infinities, so that no comparison meets them."""
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x)


def to_double(x: Column) -> Column:
    """Numbers in text, NULL for anything else."""
    return finite(x.try_cast("double"))


def from_ll(ll: Column) -> Column:
    """M1."""
    return finite(F.exp(finite(ll)))


def extracted(pi: Column, n: Column | float, stable: bool = False) -> Column:
    """M2: probability of at least one extraction in ``n`` queries; ``stable`` keeps tiny probabilities."""
    n = F.lit(n) if isinstance(n, (int, float)) else n
    return -F.expm1(n * F.log1p(-pi)) if stable else F.lit(1.0) - F.pow(F.lit(1.0) - pi, n)


def ratio(a: Column, b: Column, otherwise: float | None = None) -> Column:
    """a / b, ``otherwise`` where b is 0 or NULL."""
    return F.when(b != 0, a / b).otherwise(F.lit(otherwise).cast("double"))


def relative_risk(pi: Column, q: Column) -> Column:
    """M9: pi / q, infinite where q has underflowed to 0."""
    return F.when(q == 0, F.when(pi > 0, F.lit(float("inf")))).otherwise(pi / q)


def query_cost(n: Column, tokens: int = 20, dollars_per_million: float = 5.0) -> Column:
    """M12."""
    return n * tokens * dollars_per_million / 1e6


def passed(score: Column, tau: Column | float) -> Column:
    """1 if the score reaches tau; a NULL or NaN score does not."""
    return F.coalesce(finite(score) >= tau, F.lit(False)).cast("int")


def budget_label(x: Column) -> Column:
    return F.format_string("%.0e", x)
