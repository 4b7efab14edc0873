"""Scalar expressions on intervals, identity and crude similarity. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap_length(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Shared length of two intervals; 0 when they only touch or lie apart, or an end is null."""
    known = s1.isNotNull() & e1.isNotNull() & s2.isNotNull() & e2.isNotNull()
    return F.when(known, F.greatest(F.least(e1, e2) - F.greatest(s1, s2), F.lit(0))).otherwise(F.lit(0))


def percent_identity(matches: Column, start: Column, end: Column) -> Column:
    """Matches per aligned base in percent, five digits, half to even; null for an empty interval."""
    return F.bround(F.try_divide(matches * F.lit(100.0), (end - start).cast("double")), 5)


def identity_at_least(matches: Column, start: Column, end: Column, least: Column) -> Column:
    """Exact integer test of matches/(end-start) >= least percent."""
    return matches * 100 >= least * (end - start)


def crude_identity(len1: Column, len2: Column, matches: Column) -> Column:
    """Matches over the shorter length in percent; -1 where a length is 0 (the hit filter discards those), null where one is null."""
    shorter = F.when(len1.isNotNull() & len2.isNotNull(), F.least(len1, len2))
    return F.when(shorter == 0, F.lit(-1.0)).otherwise(F.try_divide(matches * F.lit(100.0), shorter.cast("double")))


def crude_overlap_identity(s1: Column, e1: Column, s2: Column, e2: Column, len1: Column, len2: Column) -> Column:
    """Query overlap over the shorter reference in percent; -1 without overlap or with a zero length (pairing keeps those)."""
    shared, shorter = F.least(e1, e2) - F.greatest(s1, s2), F.least(len1, len2)
    return F.when((shared <= 0) | (shorter == 0), F.lit(-1.0)).otherwise(F.try_divide(shared * F.lit(100.0), shorter.cast("double")))
