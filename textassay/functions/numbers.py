"""Small numeric rules that several reports share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The collision threshold and the digits of a printed delta.
UNTOUCHED_RATIO = 0.95
DELTA_DIGITS = 6


def share(part: Column, whole: Column) -> Column:
    """``part / whole`` as double; null on an empty whole."""
    return F.when(whole != 0, part.cast("double") / whole.cast("double"))


def residual_ratio(dirty: Column, residual: Column) -> Column:
    """Residual over dirty count; NaN when the token never occurred."""
    return F.coalesce(share(residual, dirty), F.lit(float("nan")))


def verdict(dirty: Column, residual: Column) -> Column:
    """What repair did to a token: absent, pure artifact, untouched or collision."""
    return (
        F.when(dirty == 0, "absent")
        .when(residual == 0, "pure artifact")
        .when(share(residual, dirty) > UNTOUCHED_RATIO, "untouched")
        .otherwise("collision")
    )


def wilson(hits: Column, total: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score interval of a rate."""
    n = total.cast("double")
    p = hits.cast("double") / n
    centre = p + z * z / (2 * n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    return (centre - half) / scale, (centre + half) / scale


def majority(neg: Column, pos: Column) -> Column:
    """Direction most seeds agree on, from the counts and not from the mean."""
    return F.when(pos > neg, "pos").when(neg > pos, "neg").otherwise("tied")


def delta_line(left: Column, right: Column, mean: Column, sd: Column, n: Column,
               neg: Column, pos: Column, zero: Column, inside_se: Column) -> Column:
    """One printable line per contrast, six decimals and an explicit sign."""
    spec = f"%s-%s  %+.{DELTA_DIGITS}f  sd %.{DELTA_DIGITS}f  neg %d pos %d%s of %d (%s)%s"
    zeros = F.when(zero != 0, F.format_string(" zero %d", zero)).otherwise("")
    flag = F.when(inside_se, "  <- mean inside its own se; the sign count is noise").otherwise("")
    return F.format_string(spec, left, right, mean, sd, neg, pos, zeros, n, majority(neg, pos), flag)
