"""Scalar column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def age_at(birth: Column | str, day: Column | str) -> Column:
    """Completed years of age on a day, null for an unknown birth date."""
    b, d = col(birth), col(day)
    early = (F.month(d) < F.month(b)) | ((F.month(d) == F.month(b)) & (F.dayofmonth(d) < F.dayofmonth(b)))
    return F.year(d) - F.year(b) - early.cast("int")


def safe_divide(num: Column | str, den: Column | str, otherwise: float | None = None) -> Column:
    """num / den as double; a zero or null denominator gives null, or `otherwise`."""
    out = F.try_divide(col(num).cast("double"), col(den).cast("double"))
    return out if otherwise is None else F.coalesce(out, F.lit(float(otherwise)))


def signed_log1p(x: Column | str) -> Column:
    return F.signum(col(x).cast("double")) * F.log1p(F.abs(col(x).cast("double")))


def age_band(age: Column | str) -> Column:
    """Right-closed bands; null for a null age."""
    a = col(age)
    out = F.when(a <= 18, "Under 19")
    for most, name in ((24, "19-24"), (34, "25-34"), (44, "35-44"), (54, "45-54"), (64, "55-64")):
        out = out.when(a <= most, name)
    return out.when(a > 64, "65+")


def rank_of(label: Column | str, labels: list[str]) -> Column:
    """Position of a label in its order, for sorting; null for an unknown one."""
    out = F.when(col(label) == labels[0], 0)
    for n, name in enumerate(labels[1:], 1):
        out = out.when(col(label) == name, n)
    return out


def last_known(value: str, day: str) -> Column:
    """The last non-null value by day."""
    return F.max_by(value, F.when(F.col(value).isNotNull(), F.col(day)))


def mean_of(c: str) -> Column:
    """Mean over non-null values as a double, from an exact sum; null without any."""
    return F.try_divide(F.sum(c).cast("double"), F.count(c).cast("double"))
