"""Saved pages of web sources as tables: ratings lists, league and shot documents, statistics in HTML tables.

Nothing here asks the network: a page is a row with its text, wherever it came from.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.functions.text import game_id, snake_case


def club_ratings(df: DataFrame) -> DataFrame:
    """A ratings list (Rank, Club, Country, Level, Elo, From, To), all text, as typed rows; the club is the team."""
    rows = df.toDF(*[snake_case(c) for c in df.columns]).withColumnRenamed("club", "team")
    day = lambda c: F.to_date(F.try_to_timestamp(F.col(c)))
    return rows.select("team", "country", F.col("level").try_cast("int").alias("level"), F.col("rank").try_cast("int").alias("rank"), F.col("elo").try_cast("double").alias("elo"), day("from").alias("from"), day("to").alias("to"))


LEAGUE = "dates array<struct<id:string,isResult:boolean,datetime:string,h:struct<title:string>,a:struct<title:string>,goals:struct<h:string,a:string>,xG:struct<h:string,a:string>,forecast:struct<w:string,d:string,l:string>>>"
SHOT = "struct<id:string,minute:string,result:string,X:string,Y:string,xG:string,player:string,h_a:string,h_team:string,a_team:string,h_goals:string,a_goals:string,date:string,match_id:string>"


def league_fixtures(documents: DataFrame, document: str = "document") -> DataFrame:
    """Played fixtures of league documents with goals, expected goals and forecasts."""
    rows = documents.select(F.explode(F.from_json(document, LEAGUE)["dates"]).alias("e")).select("e.*").filter("isResult")
    number = lambda c: F.col(c).try_cast("double")
    at = F.try_to_timestamp(F.col("datetime"))
    out = rows.select(F.col("id").alias("source_id"), at.alias("datetime"), F.to_date(at).alias("date"), F.col("h.title").alias("team_home"), F.col("a.title").alias("team_away"), F.col("goals.h").try_cast("int").alias("goals_home"), F.col("goals.a").try_cast("int").alias("goals_away"), number("xG.h").alias("xg_home"), number("xG.a").alias("xg_away"), *[number(f"forecast.{c}").alias(f"forecast_{c}") for c in "wdl"])
    return out.withColumn("id", game_id(F.col("date"), F.col("team_home"), F.col("team_away")))


def match_shots(documents: DataFrame, document: str = "document") -> DataFrame:
    """Shots of both sides of match documents."""
    sides = F.from_json(document, f"shots struct<h:array<{SHOT}>,a:array<{SHOT}>>")["shots"]
    none = F.array().cast(f"array<{SHOT}>")
    s = documents.select(F.explode(F.concat(F.coalesce(sides["h"], none), F.coalesce(sides["a"], none))).alias("s")).select("s.*")
    number = lambda c, kind="double": F.col(c).try_cast(kind)
    return s.select(F.col("id").alias("shot_id"), "match_id", number("minute", "int").alias("minute"), "result", number("X").alias("x"), number("Y").alias("y"), number("xG").alias("xg"), "player", F.col("h_a").alias("side"), F.col("h_team").alias("team_home"), F.col("a_team").alias("team_away"), number("h_goals", "int").alias("goals_home"), number("a_goals", "int").alias("goals_away"), F.try_to_timestamp(F.col("date")).alias("datetime"))


class _Tables(HTMLParser):
    """Tables of a page: (id, header rows, body rows), cells as text; a cell over several columns counts for each."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[tuple[str, list[list[str]], list[list[str]]]] = []
        self._row: list[str] | None = None
        self._cell: list[str] | None = None
        self._span, self._head, self._open = 1, False, 0

    def handle_starttag(self, tag, attrs):
        have = dict(attrs)
        if tag == "table":
            self.tables.append((have.get("id") or "", [], []))
            self._open += 1
        elif tag == "thead":
            self._head = True
        elif tag == "tr" and self._open:
            self._row = []
        elif tag in ("th", "td") and self._row is not None:
            self._cell = []
            self._span = int(have["colspan"]) if (have.get("colspan") or "").isdigit() else 1

    def handle_data(self, text):
        if self._cell is not None:
            self._cell.append(text)

    def handle_endtag(self, tag):
        if tag in ("th", "td") and self._cell is not None and self._row is not None:
            self._row += [" ".join("".join(self._cell).split())] * self._span
            self._cell = None
        elif tag == "tr" and self._row is not None and self.tables:
            self.tables[-1][1 if self._head else 2].append(self._row)
            self._row = None
        elif tag == "thead":
            self._head = False
        elif tag == "table":
            self._open = max(0, self._open - 1)


def _names(head: list[list[str]], width: int) -> list[str]:
    """Column names: the last header row under the one above it where that names a group; numbered where they repeat."""
    last = head[-1] if head else []
    above = head[-2] if len(head) > 1 else []
    out: list[str] = []
    for k in range(width):
        name = last[k] if k < len(last) else ""
        group = above[k] if k < len(above) else ""
        full = snake_case(f"{group} {name}" if group and group != name else name) or f"column_{k}"
        out.append(full if full not in out else f"{full}_{k}")
    return out


def html_tables(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, table, table_id, row, cells): a row for each row of each table of a page, cells as a map by column name.

    Tables that a page hides in comments are read too; rows that repeat the header are left out.
    """
    source = pages.select(F.col(f"`{key}`").alias("k"), F.regexp_replace(F.coalesce(F.col(f"`{html}`"), F.lit("")), "<!--|-->", "").alias("h"))
    kind = source.schema["k"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                parser = _Tables()
                parser.feed(text)
                parser.close()
                for t, (name, head, body) in enumerate(parser.tables):
                    if not head and body:
                        head, body = [body[0]], body[1:]
                    width = max(map(len, [*head, *body]), default=0)
                    names = _names(head, width)
                    body = [r for r in body if r and r not in head]
                    for n, cells in enumerate(body):
                        at.append(i)
                        rows.append((t, name, n, list(zip(names, cells, strict=False))))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.map_(pa.string(), pa.string()))], ["k", "table", "table_id", "row", "cells"])

    out = source.mapInArrow(run, f"k {kind.simpleString()}, table int, table_id string, row int, cells map<string,string>")
    return out.withColumnRenamed("k", key)


def cell(name: str, number: bool = True) -> Column:
    """One cell of `html_tables`; numbers may have thousands' commas."""
    value = F.try_element_at("cells", F.lit(name))
    return F.replace(value, F.lit(","), F.lit("")).try_cast("double") if number else value


def season_statistics(pages: DataFrame, key: str = "page_id", html: str = "html") -> dict[str, DataFrame]:
    """Rows of the first three tables of statistics pages: squads, their opponents, players."""
    rows = html_tables(pages, key, html)
    return {name: rows.filter(F.col("table") == k).drop("table") for k, name in enumerate(("squad_for", "squad_against", "players"))}
