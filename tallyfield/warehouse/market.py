"""Market consensus: what the other bookmakers think a price is worth."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tallyfield.functions import implied

#: Names of averages of other bookmakers, which are no bookmaker.
AGGREGATES = ("Max", "Avg", "MaxC", "AvgC", "market_max", "market_avg")


def consensus(quotes: DataFrame, by: str = "match_id", book: str = "bookmaker_id", odds: str = "odds", method: str = "shin") -> DataFrame:
    """Median fair probabilities, their spread, best prices, and each book's edge against the others.

    A row of quotes is one book's prices of a match, as an array.  A match has as many books
    as there are bookmakers, so its books are one array and no self-join is needed.
    """
    real = quotes.filter(~F.col(book).isin(*AGGREGATES) & F.forall(odds, lambda o: o > 1))
    rows = real.withColumns({"_fair": implied.probabilities(F.col(odds), method), "_over": implied.overround(F.col(odds))})
    books = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(book).alias("book"), F.col(odds).alias("odds"), F.col("_fair").alias("fair")))).alias("books"), F.avg("_over").alias("mean_overround")).filter(F.size("books") >= 2)
    place = F.explode(F.sequence(F.lit(0), F.size(F.col("books")[0]["odds"]) - 1))
    at = books.select("*", F.size("books").alias("n_books"), place.alias("place"))
    column = F.transform("books", lambda b: F.get(b["fair"], F.col("place")))
    at = at.withColumns({"_column": column, "fair": median(column), "dispersion": F.array_max(column) - F.array_min(column)})
    best = F.array_max(F.transform("books", lambda b: F.struct(F.get(b["odds"], F.col("place")).alias("price"), b["book"].alias("book"))))
    at = at.withColumns({"best_price": best["price"], "best_book": best["book"]}).withColumn("edge_vs_consensus", F.col("fair") * F.col("best_price") - 1)
    others = lambda b: median(F.transform(F.filter("books", lambda o: o["book"] != b["book"]), lambda o: F.get(o["fair"], F.col("place"))))
    edges = F.transform("books", lambda b: F.struct(b["book"].alias("book"), F.when(F.col("n_books") >= 3, others(b) * F.get(b["odds"], F.col("place")) - 1).alias("edge")))
    return at.withColumn("leave_one_out", edges).drop("books", "_column")


def median(values):
    """Median of an array."""
    s = F.sort_array(values)
    n = F.size(s)
    low, high = F.get(s, F.floor((n - 1) / 2).cast("int")), F.get(s, F.floor(n / 2).cast("int"))
    return (low + high) / 2


#: Rows of a matrix of draws.
NULL_ROWS = 256


@lru_cache(64)
def _drawn(books: int, draws: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of `books` prices in a unit spread around 0, drawn `draws` times: one's own, and the two middle ones of the others."""
    rng = np.random.default_rng(seed)
    unit = rng.uniform(-0.5, 0.5, (draws, books))
    mine = rng.integers(0, books, draws)
    rest = np.sort(np.where(np.arange(books) == mine[:, None], np.nan, unit), axis=1)[:, :-1]
    return unit[np.arange(draws), mine], rest[:, (books - 2) // 2], rest[:, (books - 1) // 2]


def null_edge(fair, dispersion, n_books, overround, draws: int = 4000, seed: int = 20260909):
    """The 95th percentile of the edge that such disagreement shows where there is none, by simulation in Arrow batches.

    Every row sees the same draws, which only its centre and spread move, so they are made once
    for each number of books, and the rows of one number are one matrix.
    """

    @pandas_udf("double")
    def run(c: pd.Series, s: pd.Series, n: pd.Series, o: pd.Series) -> pd.Series:
        centre, spread, books, over = (x.to_numpy(float, na_value=np.nan) for x in (c, s, n, o))
        out = np.zeros(len(centre))
        moved = (spread > 0) & ~(books < 3)
        for b in np.unique(books[moved]):
            at = np.flatnonzero(moved & (books == b))
            for low in range(0, len(at), NULL_ROWS):
                k = at[low : low + NULL_ROWS, None]
                own, under, above = (np.maximum(1e-4, centre[k] + spread[k] * x) for x in _drawn(int(b), draws, seed))
                out[k[:, 0]] = np.quantile((under + above) / 2 / (own * (1 + over[k] / 3)) - 1, 0.95, axis=1)
        return pd.Series(out)

    return run(fair, dispersion, n_books, overround)
