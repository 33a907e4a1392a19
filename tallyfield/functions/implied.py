"""Fair probabilities from decimal odds: seven ways to take the margin out.

Each is an expression over an array of odds, so a market is one row and nothing leaves the
JVM.  Roots are found by bisection inside `aggregate` over a fixed number of steps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS = 60


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def raw(odds: Column) -> Column:
    return F.transform(odds, lambda x: 1 / x.cast("double"))


def overround(odds: Column) -> Column:
    return _total(raw(odds)) - 1


def bisect(low: Column, high: Column, rising: Callable[[Column], Column], steps: int = STEPS) -> Column:
    """The point in [low, high] where a rising function crosses 0."""
    start = F.struct(low.cast("double").alias("lo"), high.cast("double").alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        middle = (s["lo"] + s["hi"]) / 2
        above = rising(middle) > 0
        return F.struct(F.when(above, s["lo"]).otherwise(middle).alias("lo"), F.when(above, middle).otherwise(s["hi"]).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: (s["lo"] + s["hi"]) / 2)


def multiplicative(odds: Column) -> Column:
    q = raw(odds)
    return F.transform(q, lambda x: x / _total(q))


def additive(odds: Column) -> Column:
    q = raw(odds)
    return F.transform(q, lambda x: x + (1 - _total(q)) / F.size(q))


def differential_margin(odds: Column) -> Column:
    """Margin in proportion to the odds."""
    margin = overround(odds)
    return F.transform(odds, lambda o: (F.size(odds) - margin * o) / (F.size(odds) * o))


def power(odds: Column) -> Column:
    """q^k with the sum 1."""
    q = raw(odds)
    k = bisect(F.lit(0.0), F.lit(100.0), lambda m: 1 - _total(F.transform(q, lambda x: F.pow(x, m))))
    return F.transform(q, lambda x: F.pow(x, k))


def shin(odds: Column) -> Column:
    """Shin's share z of insiders; with no margin the probabilities are the raw ones."""
    q = raw(odds)
    total = _total(q)

    def fair(z: Column) -> Column:
        return F.transform(q, lambda x: (F.sqrt(z * z + 4 * (1 - z) * x * x / total) - z) / (2 * (1 - z)))

    z = bisect(F.lit(0.0), F.lit(1 - 1e-9), lambda m: 1 - _total(fair(m)))
    return F.when(total <= 1, multiplicative(odds)).otherwise(fair(z))


def shin_insiders(odds: Column) -> Column:
    """The share z itself."""
    q = raw(odds)
    total = _total(q)
    return F.when(total <= 1, F.lit(0.0)).otherwise(bisect(F.lit(0.0), F.lit(1 - 1e-9), lambda m: 1 - _total(F.transform(q, lambda x: (F.sqrt(m * m + 4 * (1 - m) * x * x / total) - m) / (2 * (1 - m))))))


def odds_ratio(odds: Column) -> Column:
    """One odds ratio c between raw and fair: p = q / (c + q - c q)."""
    q = raw(odds)

    def fair(c: Column) -> Column:
        return F.transform(q, lambda x: x / (c + x - c * x))

    return fair(bisect(F.lit(1e-6), F.lit(1000.0), lambda m: 1 - _total(fair(m)), 80))


def logarithmic(odds: Column) -> Column:
    """One shift of the raw log-odds."""
    q = raw(odds)

    def fair(c: Column) -> Column:
        return F.transform(q, lambda x: 1 / (1 + F.exp(c - F.ln(x / (1 - x)))))

    return fair(bisect(F.lit(-20.0), F.lit(20.0), lambda m: 1 - _total(fair(m))))


METHODS: dict[str, Callable[[Column], Column]] = {"multiplicative": multiplicative, "additive": additive, "differential_margin": differential_margin, "power": power, "shin": shin, "odds_ratio": odds_ratio, "logarithmic": logarithmic}


def probabilities(odds: Column, method: str = "multiplicative") -> Column:
    """Fair probabilities of an array of decimal odds, in its order."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}")
    return METHODS[method](odds)


# --- odds formats ---------------------------------------------------------------------


def american_to_decimal(odds: Column) -> Column:
    return F.when(odds > 0, 1 + odds / 100).otherwise(1 + 100 / F.abs(odds))


def decimal_to_american(odds: Column) -> Column:
    return F.when(odds >= 2, (odds - 1) * 100).otherwise(-100 / (odds - 1))


def fractional_to_decimal(odds: Column) -> Column:
    """'5/2' as 3.5; 'evens' as 2."""
    parts = F.split(F.trim(odds), "/")
    return F.when(F.lower(F.trim(odds)).isin("evens", "evs"), F.lit(2.0)).otherwise(1 + F.get(parts, F.lit(0)).try_cast("double") / F.nullif(F.get(parts, F.lit(1)).try_cast("double"), F.lit(0.0)))


def to_decimal(odds: Column, form: str) -> Column:
    if form == "decimal":
        return odds.try_cast("double")
    if form == "american":
        return american_to_decimal(odds.try_cast("double"))
    if form == "fractional":
        return fractional_to_decimal(odds)
    raise ValueError("form is decimal, american or fractional")
