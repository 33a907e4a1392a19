"""Diagnostics of a table of draws (parameter, chain, draw, value): chains are rows, lags are windows, all else are aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Autocorrelations are summed until the first below this.
NOISE = 0.05
#: Draws of a chain that one window goes over.
BLOCK = 8192


def _kept(draws: DataFrame, by: Sequence[str], burn: int, thin: int) -> DataFrame:
    """Draws after `burn`, every `thin`-th, numbered from 0."""
    at = F.col("draw") - burn
    return draws.filter((at >= 0) & (at % thin == 0)).withColumn("_t", (at / thin).cast("long"))


def r_hat(draws: DataFrame, by: Sequence[str] = ("parameter",), burn: int = 0, thin: int = 1, split: bool = False) -> DataFrame:
    """by, r_hat, n_chains and n_draws: the potential scale reduction, of half chains if split; null with one chain or no spread within."""
    rows = _kept(draws, by, burn, thin)
    chain = ["chain"]
    if split:
        half = F.floor((F.max("_t").over(W.partitionBy(*by)) + 1) / 2)
        rows = rows.withColumn("_half", F.floor(F.col("_t") / half)).filter("_half < 2")  # an odd last draw goes
        chain = ["chain", "_half"]
    per = rows.groupBy(*by, *chain).agg(F.count("*").alias("_n"), F.avg("value").alias("_m"), F.var_samp("value").alias("_v"))
    out = per.groupBy(*by).agg(F.count("*").alias("n_chains"), F.min("_n").alias("n_draws"), F.avg("_v").alias("_w"), F.var_samp("_m").alias("_b"))
    n = F.col("n_draws")
    return out.select(*by, F.when(F.col("_w") > 0, F.sqrt(((n - 1) / n * F.col("_w") + F.col("_b")) / F.col("_w"))).alias("r_hat"), "n_chains", "n_draws")


def autocorrelations(draws: DataFrame, by: Sequence[str] = ("parameter",), most: int = 100, burn: int = 0, thin: int = 1) -> DataFrame:
    """by, lag (0 to most) and rho: the autocorrelation of each chain, averaged over chains.

    A chain is cut into blocks, each with the `most` draws after it, and a frame over a block shows each
    draw those it meets: rows are shuffled once and a little more, products are summed where they
    arise, and a long chain is spread over its blocks."""
    rows = _kept(draws, by, burn, thin)
    means = rows.groupBy(*by, "chain").agg(F.avg("value").alias("_mean"))
    block = max(BLOCK, most)
    own = F.floor(F.col("_t") / block)
    at = F.when(F.col("_t") % block < most, F.array(own, own - 1)).otherwise(F.array(own))  # the first draws are met from the block before
    met = rows.join(means, [*by, "chain"]).select(*by, "chain", "_t", (F.col("value") - F.col("_mean")).alias("_x"), F.explode(at).alias("_block"))
    ahead = W.partitionBy(*by, "chain", "_block").orderBy("_t").rangeBetween(0, most)
    seen = met.withColumn("_ahead", F.collect_list(F.struct("_t", F.col("_x").alias("_y"))).over(ahead)).filter(F.floor(F.col("_t") / block) == F.col("_block"))
    pairs = seen.select(*by, "chain", "_t", "_x", F.explode("_ahead").alias("_a")).select(*by, "chain", (F.col("_a._t") - F.col("_t")).cast("int").alias("lag"), (F.col("_x") * F.col("_a._y")).alias("_p"))
    both = pairs.groupBy(*by, "chain", "lag").agg(F.sum("_p").alias("_c"))
    zero = F.max(F.when(F.col("lag") == 0, F.col("_c"))).over(W.partitionBy(*by, "chain"))
    return both.withColumn("_r", F.col("_c") / F.nullif(zero, F.lit(0.0))).groupBy(*by, "lag").agg(F.avg("_r").alias("rho"))


def effective_size(draws: DataFrame, by: Sequence[str] = ("parameter",), most: int = 100, noise: float = NOISE, burn: int = 0, thin: int = 1) -> DataFrame:
    """by, ess, tau and cutoff: draws over the autocorrelation time, whose sum ends before the first lag below `noise` (or at `most`)."""
    rho = autocorrelations(draws, by, most, burn, thin)
    size = _kept(draws, by, burn, thin).groupBy(*by).agg(F.count("*").alias("_n"))
    first = rho.filter((F.col("lag") > 0) & (F.col("rho") < noise)).groupBy(*by).agg(F.min("lag").alias("_end"))
    last = rho.groupBy(*by).agg(F.max("lag").alias("_last"))
    cut = last.join(first, list(by), "left").select(*by, F.coalesce("_end", F.col("_last") + 1).alias("cutoff"))
    total = rho.join(cut, list(by)).groupBy(*by, "cutoff").agg(F.sum(F.when((F.col("lag") > 0) & (F.col("lag") < F.col("cutoff")), F.col("rho")).otherwise(0.0)).alias("_sum"))
    return total.join(size, list(by)).select(*by, (F.col("_n") / (1 + 2 * F.col("_sum"))).alias("ess"), (1 + 2 * F.col("_sum")).alias("tau"), "cutoff")
