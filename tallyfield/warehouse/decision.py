"""Signal levels and scores as ordered conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = ("NO_SIGNAL", "WATCH", "CANDIDATE", "QUALIFIED")
STALE_SECONDS = 1800
MIN_SETTLED = 30
INPUTS = {"edge": "double", "n_settled": "long", "historical_clv": "double", "data_age_seconds": "double", "pit_violations": "long", "used_prior": "boolean"}


def _inputs(df: DataFrame, names: dict[str, str]) -> dict[str, Column]:
    return {n: F.col(n) if n in df.columns else F.lit(None).cast(t) for n, t in names.items()}


def classify(df: DataFrame, min_edge: float = 0.02, promoted: bool = False) -> DataFrame:
    """df with level, uncapped_level and reason.  Disqualifiers come first; without a promoted strategy nothing passes WATCH."""
    c = _inputs(df, INPUTS)
    settled = F.coalesce(c["n_settled"], F.lit(0))
    reason = (
        F.when(F.coalesce(c["pit_violations"], F.lit(0)) > 0, "PIT_VIOLATION")
        .when(c["data_age_seconds"] > STALE_SECONDS, "STALE_DATA")
        .when(c["edge"].isNull(), "NO_ODDS")
        .when(c["edge"] <= min_edge, "EDGE_BELOW_THRESHOLD")
        .when(F.coalesce(c["used_prior"], F.lit(False)), "LEAGUE_PRIOR")
        .when(settled < MIN_SETTLED, "THIN_SAMPLE")
        .when(c["historical_clv"].isNull(), "NO_CLV_HISTORY")
        .when(c["historical_clv"] <= 0, "NEGATIVE_CLV")
        .otherwise("POSITIVE_CLV")
    )
    level = F.when(reason == "NO_ODDS", "DATA_GAP").when(reason.isin("PIT_VIOLATION", "STALE_DATA", "EDGE_BELOW_THRESHOLD", "NEGATIVE_CLV"), "NO_SIGNAL").when(reason == "POSITIVE_CLV", F.lit("QUALIFIED" if promoted else "CANDIDATE")).otherwise("WATCH")
    capped = level if promoted else F.when(level.isin("CANDIDATE", "QUALIFIED"), "WATCH").otherwise(level)
    return df.withColumns({"reason": reason, "uncapped_level": level, "level": capped})


def saturating(value: Column, full: float) -> Column:
    """0 to 1, full at `full` and beyond."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value / full))


# What each graded part weighs, and where it is full.
WEIGHTS = {"clv": 0.30, "replication": 0.25, "sample": 0.20, "edge": 0.10, "adversarial": 0.10, "liquidity": 0.05}
FULL = {"edge": 0.05, "clv": 0.03, "sample": 500.0}


def score_signal(df: DataFrame, replications_required: int = 2, adversarial_total: int = 10) -> DataFrame:
    """df with score: 0 where a gate fails, else the weighted mean of the graded parts.

    An unknown liquidity is left out and the other weights scaled up.  Without a price and an
    edge there is no score but a data gap.
    """
    c = _inputs(df, INPUTS | {"price": "double", "replications": "long", "liquidity": "double", "adversarial_passed": "long", "executable": "boolean"})
    gates = {"pit_confidence": F.coalesce(c["pit_violations"], F.lit(0)) == 0, "freshness": F.coalesce(c["data_age_seconds"] <= STALE_SECONDS, F.lit(True)), "execution": F.coalesce(c["executable"], F.lit(True))}
    zero = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
    graded = {
        "edge": saturating(zero(c["edge"]), FULL["edge"]),
        "clv": saturating(zero(c["historical_clv"]), FULL["clv"]),
        "sample": saturating(zero(c["n_settled"]), FULL["sample"]),
        "replication": saturating(zero(c["replications"]), float(max(replications_required, 1))),
        "adversarial": saturating(zero(c["adversarial_passed"]), float(max(adversarial_total, 1))),
    }
    liquid = c["liquidity"].isNotNull()
    total = F.lit(sum(WEIGHTS[k] for k in graded)) + F.when(liquid, WEIGHTS["liquidity"]).otherwise(0.0)
    mean = F.when(liquid, saturating(c["liquidity"], 1.0) * WEIGHTS["liquidity"]).otherwise(0.0)
    for name, value in graded.items():
        mean = mean + value * WEIGHTS[name]
    failed = F.coalesce(*[F.when(~ok, F.lit(name)) for name, ok in gates.items()])
    gap = c["price"].isNull() & c["edge"].isNull()
    score = F.when(gap, F.lit(None).cast("double")).when(failed.isNotNull(), 0.0).otherwise(mean / total)
    return df.withColumns({"score": score, "failed_gate": F.when(~gap, failed), "data_gap": F.when(gap, "NO_ODDS")})
