"""Van Genuchten retention curves as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARAMS = ("theta_r", "theta_s", "alpha", "n")
LEAST_SUCTION = 1e-9


def theta(psi: Column, theta_r: Column, theta_s: Column, alpha: Column, n: Column) -> Column:
    """Water content at suction ``psi`` (cm); null where ``n`` is at most 1."""
    m = 1 - 1 / n
    curve = theta_r + (theta_s - theta_r) / F.pow(1 + F.pow(alpha * F.greatest(psi, F.lit(LEAST_SUCTION)), n), m)
    return F.when(n > 1, curve)


def theta_clamped(psi: Column, theta_r: Column, theta_s: Column, alpha: Column, n: Column) -> Column:
    """The same with parameters moved into their valid ranges: n at least 1.001, alpha at least 1e-9, theta_s at least theta_r."""
    return theta(psi, theta_r, F.greatest(theta_s, theta_r), F.greatest(alpha, F.lit(1e-9)), F.greatest(n, F.lit(1.001)))


def psi(water: Column, theta_r: Column, theta_s: Column, alpha: Column, n: Column, margin: float = 1e-6) -> Column:
    """Suction (cm) at water content ``water``, kept ``margin`` inside the residual and saturated contents; infinite values are null."""
    held = F.least(F.greatest(water, theta_r + margin), theta_s - margin)
    se = F.try_divide(held - theta_r, theta_s - theta_r)
    out = F.try_divide(F.pow(F.pow(se, -n / (n - 1)) - 1, 1 / n), alpha)
    return F.when((n > 1) & ~F.isnan(out) & (F.abs(out) != float("inf")), out)


def log10_psi(water: Column, theta_r: Column, theta_s: Column, alpha: Column, n: Column) -> Column:
    """log10 of the suction at ``water``, from the ratio of drained to held water."""
    ratio = F.try_divide(theta_s - theta_r, water - theta_r)
    base = F.pow(ratio, n / (n - 1)) - 1
    return F.when((n > 1) & (base > 0) & (alpha > 0), F.log10(F.pow(base, 1 / n) / alpha))


def to_log10(df: DataFrame, names: tuple[str, ...] = ("alpha", "n"), least: float = 1e-10) -> DataFrame:
    """Adds ``log10_<name>`` of positive parts."""
    return df.withColumns({f"log10_{c}": F.log10(F.greatest(F.col(c), F.lit(least))) for c in names})


def from_log10(df: DataFrame, names: tuple[str, ...] = ("alpha", "n")) -> DataFrame:
    """Adds ``<name>`` from ``log10_<name>``."""
    return df.withColumns({c: F.pow(F.lit(10.0), F.col(f"log10_{c}")) for c in names})
