"""Files of known feeds as bronze rows: result and odds tables, nested fixtures, price series, upcoming odds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.functions.text import snake_case

REQUIRED = ("Date", "HomeTeam", "AwayTeam", "FTHG", "FTAG", "FTR")
# Bookmakers by the prefix of their columns; a C after it marks closing prices.
BOOKS = {"pinnacle": "PS", "bet365": "B365", "market_max": "Max", "market_avg": "Avg"}
OUTCOMES = {"HOME": "H", "DRAW": "D", "AWAY": "A"}


def _text(df: DataFrame, name: str) -> Column:
    return F.nullif(F.trim(F.col(name)), F.lit("")) if name in df.columns else F.lit(None).cast("string")


def _day(text: Column) -> Column:
    """dd/mm/yyyy or dd/mm/yy, in which 69 to 99 are of the last century."""
    long = F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_timestamp(text, F.lit("d/M/yyyy")))
    short = F.to_date(F.try_to_timestamp(text, F.lit("d/M/yy")))
    return F.coalesce(F.to_date(long), F.when(F.year(short) >= 2069, F.add_months(short, -1200)).otherwise(short))


def read_results_csv(spark: SparkSession, path: str, source: str = "footballdata", competition: str | None = None, season: str | None = None) -> DataFrame:
    """Bronze rows of a results table; every bookmaker's prices go into odds_json, prices of 1 or less are left out."""
    df = spark.read.option("header", True).csv(path)
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing")
    return results_to_bronze(df, source, competition, season)


def results_to_bronze(df: DataFrame, source: str = "footballdata", competition: str | None = None, season: str | None = None) -> DataFrame:
    rows = df.filter(_text(df, "HomeTeam").isNotNull() & _text(df, "AwayTeam").isNotNull() & _text(df, "Date").isNotNull())
    day = _day(_text(rows, "Date"))
    day = F.coalesce(day, F.raise_error(F.concat(F.lit("unreadable date "), _text(rows, "Date"))).cast("date"))
    clock = _text(rows, "Time")
    parts = F.split(clock, ":")
    seconds = F.when(clock.isNotNull(), F.get(parts, F.lit(0)).cast("int") * 3600 + F.get(parts, F.lit(1)).cast("int") * 60).otherwise(15 * 3600)
    at = F.timestamp_seconds(F.unix_timestamp(day.cast("timestamp")) + seconds)
    quotes = []
    for book, prefix in BOOKS.items():
        for selection, letter in OUTCOMES.items():
            for precision, mark in (("PREMATCH", ""), ("CLOSING", "C")):
                if (name := f"{prefix}{mark}{letter}") in rows.columns:
                    price = F.col(name).try_cast("double")
                    quotes.append(F.when(price > 1, F.struct(F.lit(book).alias("bookmaker"), F.lit(precision).alias("capture_precision"), F.lit(0.0).alias("line"), F.lit("ONE_X_TWO").alias("market_type"), price.alias("price_decimal"), F.lit(selection).alias("selection"))))
    odds = F.filter(F.array(*quotes), lambda q: q.isNotNull()) if quotes else None
    comp = F.lit(competition) if competition else _text(rows, "Div")
    year = F.lit(season) if season else F.concat(F.year(day) - F.when(F.month(day) >= 7, 0).otherwise(1), F.lit(""))
    text = lambda name: _text(rows, name)
    return rows.select(
        F.lit(source).alias("source"), F.concat_ws(":", F.lit(source), comp, year, day.cast("string"), text("HomeTeam"), text("AwayTeam")).alias("source_id"), comp.alias("competition"), year.alias("season"),
        day.cast("string").alias("match_date"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("kickoff_utc"), text("HomeTeam").alias("home_name_raw"), text("AwayTeam").alias("away_name_raw"),
        text("FTHG").alias("goals_home"), text("FTAG").alias("goals_away"), text("HTHG").alias("goals_home_ht"), text("HTAG").alias("goals_away_ht"), F.lit("false").alias("neutral_venue"),
        F.when(clock.isNotNull(), "LOCAL_APPROX").otherwise("DATE_ONLY").alias("kickoff_precision"),
        (F.when(F.size(odds) > 0, F.to_json(odds)) if odds is not None else F.lit(None).cast("string")).alias("odds_json"),
    )


FIXTURES = "name string, matches array<struct<round:string,date:string,time:string,team1:string,team2:string,score:string>>"


def read_fixtures_json(spark: SparkSession, path: str, competition: str, season: str, source: str = "openfootball") -> DataFrame:
    """Bronze rows of a nested fixture list.

    A score is an object with ft and maybe ht, an empty object, a bare list, or missing; it is
    read as text and its shape decided by expression.
    """
    df = spark.read.schema(FIXTURES).option("multiLine", True).json(path)
    m = df.select(F.explode("matches").alias("m")).select("m.*").filter("team1 IS NOT NULL AND team2 IS NOT NULL AND date IS NOT NULL")
    listed = F.col("score").startswith("[")
    # each text is parsed once, however many columns take from it
    m = m.withColumns({"_bare": F.when(listed, F.from_json("score", "array<int>")), "_whole": F.from_json("score", "struct<ft:array<int>,ht:array<int>>")})
    m = m.withColumns({"_ft": F.coalesce("_bare", F.col("_whole.ft")), "_ht": F.when(~listed, F.col("_whole.ht"))})
    ft, ht = F.col("_ft"), F.col("_ht")
    both = lambda a: F.size(a) >= 2
    goal = lambda a, k, name: F.when(both(a), F.get(a, F.lit(k)).cast("string")).alias(name)
    clock = F.regexp_extract("time", r"^(\d{1,2}):(\d{2})", 0)
    at = F.concat("date", F.lit("T"), F.when(F.col("time").isNotNull() & (clock != ""), F.lpad(clock, 5, "0")).otherwise("15:00"), F.lit(":00+00:00"))
    return m.select(
        F.lit(source).alias("source"), F.concat_ws(":", F.lit(source), F.lit(competition), F.lit(season), "date", "team1", "team2").alias("source_id"), F.lit(competition).alias("competition"), F.lit(season).alias("season"),
        F.col("date").alias("match_date"), at.alias("kickoff_utc"), F.col("team1").alias("home_name_raw"), F.col("team2").alias("away_name_raw"), goal(ft, 0, "goals_home"), goal(ft, 1, "goals_away"), goal(ht, 0, "goals_home_ht"), goal(ht, 1, "goals_away_ht"),
        F.lit("false").alias("neutral_venue"), F.when(F.col("time").isNotNull(), "LOCAL_APPROX").otherwise("DATE_ONLY").alias("kickoff_precision"),
    )


RESULT_CODES = {1: "HOME", 2: "DRAW", 3: "AWAY"}


def price_series(df: DataFrame) -> DataFrame:
    """Timestamped prices of a series dump (ID, bookmaker, result, odds, odds_datetime, disabled_date).

    Other bet types and prices of 1 or less are left out; a price without an instant raises.
    """
    selection = F.coalesce(*[F.when(F.col("result").try_cast("int") == k, v) for k, v in RESULT_CODES.items()])
    price = F.col("odds").try_cast("double")
    rows = df.withColumns({"selection": selection, "price_decimal": price}).filter("selection IS NOT NULL AND price_decimal > 1")
    at = F.try_to_timestamp(F.nullif(F.col("odds_datetime").cast("string"), F.lit("")))
    at = F.coalesce(at, F.raise_error(F.concat(F.lit("a price without an instant: match "), F.col("ID").cast("string"))).cast("timestamp"))
    return rows.select(F.col("ID").cast("string").alias("match_source_id"), F.col("bookmaker").cast("string").alias("bookmaker_id"), F.lit("ONE_X_TWO").alias("market_type"), F.lit(0.0).alias("line"), "selection", "price_decimal", F.lit("TIMESTAMPED").alias("capture_precision"), at.alias("captured_at"), F.try_to_timestamp(F.nullif(F.col("disabled_date").cast("string"), F.lit(""))).alias("disabled_at"))


def upcoming_quotes(df: DataFrame, books: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """(match_key, bookmaker, home, draw, away) of complete three-way prices in a fixture table."""
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    books = books or {b: [f"{p}{x}" for x in OUTCOMES.values()] for b, p in BOOKS.items()}
    have = {b: c for b, c in books.items() if all(x in df.columns for x in c)}
    key = F.concat_ws("|", *[F.coalesce(F.trim(F.col(c)), F.lit("")) if c in df.columns else F.lit("") for c in ("Div", "Date", "HomeTeam", "AwayTeam")])
    rows = df.filter(_text(df, "HomeTeam").isNotNull() & _text(df, "AwayTeam").isNotNull())
    quotes = F.array(*[F.struct(F.lit(b).alias("bookmaker"), *[F.col(x).try_cast("double").alias(n) for x, n in zip(c, ("home", "draw", "away"), strict=True)]) for b, c in have.items()])
    return rows.select(key.alias("match_key"), F.explode(quotes).alias("q")).select("match_key", "q.*").filter("home > 1 AND draw > 1 AND away > 1")


def snake_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[snake_case(c) for c in df.columns])
