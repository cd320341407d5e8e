"""Row-level expressions: coercion, units, clocks, levels, geometry, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the smallest normal double, under which a level isn't taken.
TINY = 2.2250738585072014e-308


def as_column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def number(x: Column | str) -> Column:
    """A double; what isn't a number, and NaN, is NULL."""
    value = as_column(x).cast("string").try_cast("double")
    return F.when(F.isnan(value), None).otherwise(value)


def finite(x: Column | str) -> Column:
    """The value where it is a finite number, else NULL."""
    value = as_column(x)
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL for a zero or missing b."""
    return a / F.when(b != 0, b)


def acceleration(x: Column, unit: str, gravity: float = 9.80665) -> Column:
    """In m/s^2."""
    return x * gravity if unit == "g" else x


def angular(x: Column, unit: str) -> Column:
    """In rad/s."""
    return F.radians(x) if unit in ("deg/s", "deg_s") else x


def on_reference_clock(x: Column | str, offset: Column | float) -> Column:
    """Native seconds plus the declared offset; NULL where either isn't finite."""
    return finite(finite(x) + (offset if isinstance(offset, Column) else F.lit(float(offset))))


def contact(x: Column, threshold: float) -> Column:
    return (x >= threshold).cast("int")


def dbfs(rms: Column) -> Column:
    return 20 * F.log10(F.greatest(rms, F.lit(TINY)))


def from_dbfs(level: float) -> float:
    return 10.0 ** (level / 20)


def usable(*values: Column) -> Column:
    """The first value that says something: not NULL, empty, N/A or 0/0."""
    return F.coalesce(*[F.when(~F.trim(v).isin("", "N/A", "0/0"), F.trim(v)) for v in values])


def frame_rate(text: Column) -> Column:
    """Frames a second of a text such as 30000/1001 or 25; NULL unless positive."""
    parts = F.split(text, "/")
    rate = ratio(number(F.get(parts, F.lit(0))), F.coalesce(number(F.get(parts, F.lit(1))), F.when(F.size(parts) == 1, 1.0)))
    return F.when(rate > 0, rate)


def lean_degrees(shoulder_x: Column, shoulder_y: Column, hip_x: Column, hip_y: Column) -> Column:
    return F.degrees(F.atan2(shoulder_x - hip_x, hip_y - shoulder_y))


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def rms(x: Column) -> Column:
    """Aggregate: root of the mean square of finite values."""
    return F.sqrt(F.avg(finite(x) * finite(x)))


def cv_percent(x: Column) -> Column:
    """Aggregate: sample deviation in percent of the mean; NULL under two values."""
    return ratio(F.stddev_samp(x), F.avg(x)) * 100


def metric_stem(metric: str) -> str:
    return metric.replace("__", "_")


def cost_column(metric: str) -> str:
    return f"dtc__{metric_stem(metric).removesuffix('_pct')}_pct"


def target_column(name: str) -> str:
    return name if "__" in name else f"clinical__{name}"
