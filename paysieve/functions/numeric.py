"""Column expressions built from Spark's own functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0088
CORPUS_EARTH_RADIUS_KM = 6371.0
BESSEL_TERMS = 25
BESSEL_SERIES_MAX = 15.0
KOLMOGOROV_TERMS = 50
BENFORD = tuple(math.log10(1 + 1 / d) for d in range(1, 10))
PAN_TAIL_CODES = 10


def minor_units(amount: Column) -> Column:
    """Money as an exact integer number of hundredths."""
    return F.round(amount * 100).cast("bigint")


def first_digit(cents: Column) -> Column:
    """Leading decimal digit; amounts that are null or not positive count as 1."""
    digit = F.substring(F.abs(cents).cast("string"), 1, 1).cast("int")
    return F.when(cents > 0, digit).otherwise(1)


def pan_tail_code(token: Column) -> Column:
    """Last character folded to 0..9; a missing token folds like '0'."""
    return F.ascii(F.substring(F.coalesce(token.cast("string"), F.lit("0")), -1, 1)) % PAN_TAIL_CODES


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float) -> Column:
    dlat, dlon = F.radians(lat2) - F.radians(lat1), F.radians(lon2) - F.radians(lon1)
    inner = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * radius) * F.asin(F.sqrt(F.least(F.greatest(inner, F.lit(0.0)), F.lit(1.0))))


def bessel_i0(x: Column) -> Column:
    """Modified Bessel function of order 0: its power series, and beyond BESSEL_SERIES_MAX, where
    that series would need more terms, the expansion for large arguments.
    """
    terms = F.sequence(F.lit(1), F.lit(BESSEL_TERMS - 1))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(acc, m):
        term = acc["term"] * F.pow(x / 2, F.lit(2.0)) / (m * m)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    series = F.aggregate(terms, start, add, lambda acc: acc["total"])
    y = 1 / (8 * x)
    large = F.exp(x) / F.sqrt(2 * F.pi() * x) * (1 + y * (1 + y * (4.5 + y * (37.5 + y * (459.375 + y * 7441.875)))))
    return F.when(x <= BESSEL_SERIES_MAX, series).otherwise(large)


def von_mises_loglik(hour: Column, mu: Column, kappa: Column) -> Column:
    angle = hour * (2 * math.pi / 24)
    return kappa * F.cos(angle - mu) - F.log(2 * math.pi * bessel_i0(kappa))


def kolmogorov_sf(x: Column) -> Column:
    """Survival function of the Kolmogorov distribution; 1 at and below 0."""
    terms = F.sequence(F.lit(1), F.lit(KOLMOGOROV_TERMS))

    def add(acc, k):
        sign = F.when(k % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
        return acc + sign * F.exp(-2.0 * k * k * x * x)

    series = 2 * F.aggregate(terms, F.lit(0.0), add)
    # Below 0.2 the alternating series has not converged while the value is 1 to 12 places.
    return F.when(x < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0)))


def share_entropy(counts: list[Column], classes: int) -> Column:
    """Entropy of the shares over ln(classes); 0 for an empty frame."""
    total = sum(counts[1:], counts[0])
    terms = [
        F.when(c > 0, -(c / total) * F.log(c / total)).otherwise(0.0) for c in counts
    ]
    return F.when(total > 0, sum(terms[1:], terms[0]) / math.log(classes)).otherwise(0.0)


def benford_deviation(counts: list[Column]) -> Column:
    """Mean absolute deviation of nine digit counts from Benford; 1/9 for an empty frame."""
    total = sum(counts[1:], counts[0])
    gaps = [F.abs(F.when(total > 0, c / total).otherwise(0.0) - b) for c, b in zip(counts, BENFORD)]
    return sum(gaps[1:], gaps[0]) / 9


def luhn_check(digits: Column) -> Column:
    """Whether the digit string passes the mod-10 check."""
    return F.call_function("luhn_check", digits)


def cart_digest(*fields: Column) -> Column:
    """SHA-256 of the JSON of the given fields, in the given order."""
    return F.sha2(F.to_json(F.struct(*fields)), 256)
