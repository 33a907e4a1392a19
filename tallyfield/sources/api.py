"""Paged JSON endpoints as a Spark data source.

`spark.read.format("paged_json")` gives a row (page, document) for each page; pages are fetched by
the executors, each by a task of its own up to TASKS, beyond that in runs of pages.  What fetches a page is a callable
named by the option `fetch` ("module:function"), called with the endpoint, its parameters
and the page number.  The default reads files, `<root>/<endpoint>/<page>.json`.

The endpoint tables name what each provider offers: method, path and arguments.
"""

from __future__ import annotations

import importlib
import json
import os
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

PAGE_SIZE = 1000
#: Tasks that share the pages of an endpoint, however many pages there are.
TASKS = 256

# Endpoints of the providers with their arguments.
STATSBOMB = {
    "competitions": (),
    "matches": ("competition_id", "season_id"),
    "events": ("match_id", "include_360_metrics"),
    "lineups": ("match_id",),
    "player_match_stats": ("match_id",),
    "player_season_stats": ("competition_id", "season_id"),
    "team_match_stats": ("match_id",),
    "team_season_stats": ("competition_id", "season_id"),
}
OPTA = {
    "tournament_calendars": ("status", "competition_uuid", "contestant_uuid", "include_stages", "include_coverage"),
    "venues": ("tournament_calendar_uuid", "contestant_uuid", "venue_uuid", "use_opta_names"),
    "areas": ("area_uuid", "use_opta_names"),
    "tournament_schedule": ("tournament_calendar_uuid", "coverage_level", "use_opta_names"),
    "matches": ("fixture_uuids", "tournament_calendar_uuid", "competition_uuids", "contestant_uuid", "opponent_uuid", "contestant_position", "date_from", "date_to", "delta_timestamp", "live", "lineups", "use_opta_names"),
    "match": ("fixture_uuid", "live", "lineups", "use_opta_names"),
    "match_stats_player": ("fixture_uuids", "use_opta_names"),
    "match_stats_team": ("fixture_uuids", "use_opta_names"),
    "events": ("fixture_uuid", "contestant_uuid", "person_uuid", "event_types", "use_opta_names"),
    "pass_matrix": ("fixture_uuid", "use_opta_names"),
    "possession": ("fixture_uuid", "use_opta_names"),
    "player_career": ("person_uuid", "contestant_uuid", "active", "use_opta_names"),
    "referees": ("person_uuid", "tournament_calendar_uuid", "stage_uuid", "use_opta_names"),
    "rankings": ("tournament_calendar_uuid", "use_opta_names"),
    "injuries": ("person_uuid", "tournament_calendar_uuid", "contestant_uuid", "use_opta_names"),
    "transfers": ("person_uuid", "contestant_uuid", "competition_uuid", "tournament_calendar_uuid", "start_date", "end_date", "use_opta_names"),
    "teams": ("tournament_calendar_uuid", "contestant_uuid", "country_uuid", "stage_uuid", "series_uuid"),
    "team_standings": ("tournament_calendar_uuid", "stage_uuid", "live", "type", "use_opta_names"),
    "squads": ("tournament_calendar_uuid", "contestant_uuid", "use_opta_names"),
    "player_season_stats": ("tournament_calendar_uuid", "contestant_uuid", "detailed"),
    "team_season_stats": ("tournament_calendar_uuid", "contestant_uuid", "detailed"),
    "contestant_participation": ("contestant_uuid", "active"),
}
FPL = {"current_gameweek": (), "gameweek_info": (), "player_id_mappings": (), "player_data": (), "player_history": ("player_id",), "rankings": ("league_id",), "entry_picks": ("entry_id", "gameweek"), "entry_transfers": ("entry_id",)}
TABLES = {"footballdata": ("competition", "season"), "clubelo": ("date", "team"), "fbref": ("competition", "season", "stat"), "understat": ("competition", "season"), "sportmonks_lineups": ("match_keys",)}
PROVIDERS: dict[str, Mapping[str, tuple[str, ...]]] = {"statsbomb": STATSBOMB, "opta": OPTA, "fpl": FPL, "tables": TABLES}


def read_file(endpoint: str, params: Mapping[str, str], page: int) -> str | None:
    """A page from a folder of saved responses; None after the last."""
    path = os.path.join(params["root"], endpoint, f"{page}.json")
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        return f.read()


class _Pages(InputPartition):
    """Pages from first to last; 0 is a walk over all."""

    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


def _runs(n: int) -> list[InputPartition]:
    """Pages 1 to n in at most TASKS runs."""
    parts = min(n, TASKS)
    return [_Pages(k * n // parts + 1, (k + 1) * n // parts) for k in range(parts)]


class _Reader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        self.options = dict(options)
        module, _, name = self.options.get("fetch", f"{__name__}:read_file").partition(":")
        self.module, self.name = module, name
        self.endpoint = self.options["endpoint"]
        self.pages = int(self.options.get("pages", "0"))

    def _fetch(self, page: int) -> str | None:
        return getattr(importlib.import_module(self.module), self.name)(self.endpoint, self.options, page)

    def partitions(self) -> list[InputPartition]:
        """Runs of pages.  A number of pages that is not given is found by the option `probe` ("module:function", which tells whether a page is there); without one a partition walks to the last page."""
        n = self.pages
        if not n and (probe := self.options.get("probe")):
            from tallyfield.sources.polls import last_page

            module, _, name = probe.partition(":")
            there = getattr(importlib.import_module(module), name)
            n = last_page(lambda page: there(self.endpoint, self.options, page))
            return _runs(n)
        return _runs(n) if n else [_Pages(0, 0)]

    def read(self, partition: _Pages) -> Iterator[tuple[int, str]]:
        if partition.first:
            for page in range(partition.first, partition.last + 1):
                if (body := self._fetch(page)) is not None:
                    yield page, body
            return
        page, size = 1, int(self.options.get("page_size", PAGE_SIZE))
        while (body := self._fetch(page)) is not None:
            yield page, body
            if len(_records(body, [x for x in self.options.get("places", "").split(",") if x])) < size:
                return
            page += 1


def _records(body: str, places: Sequence[str] = ()) -> list[Any]:
    """The list a page holds: itself, that at the first of the places that has one, or its longest list."""
    got = json.loads(body)
    if isinstance(got, list):
        return got
    for place in places:
        found = got
        for part in place.split("."):
            found = found.get(part) if isinstance(found, dict) else None
        if isinstance(found, list):
            return found
    lists = [v for v in got.values() if isinstance(v, list)] if isinstance(got, dict) else []
    return max(lists, key=len, default=[])


class PagedJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "page int, document string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


def read(spark: SparkSession, provider: str, endpoint: str, schema: StructType | str | None = None, fetch: str | None = None, **arguments: Any) -> DataFrame:
    """Documents of one endpoint, parsed by a schema if there is one.

    Unknown endpoints and arguments raise before anything is read; an error of a page fails
    the read rather than ending it early.
    """
    endpoints = PROVIDERS.get(provider)
    if endpoints is None or endpoint not in endpoints:
        raise ValueError(f"unknown endpoint {provider}.{endpoint}")
    extra = set(arguments) - set(endpoints[endpoint]) - {"root", "pages", "page_size"}
    if extra:
        raise ValueError(f"{endpoint} takes no {sorted(extra)}")
    spark.dataSource.register(PagedJson)
    reader = spark.read.format("paged_json").option("endpoint", endpoint)
    for k, v in arguments.items():
        if v is not None:
            reader = reader.option(k, ",".join(map(str, v)) if isinstance(v, (list, tuple)) else str(v))
    if fetch:
        reader = reader.option("fetch", fetch)
    df = reader.load()
    if schema is None:
        return df
    from pyspark.sql import functions as F

    ddl = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    whole = F.from_json("document", ddl)
    listed = F.from_json("document", f"array<{ddl.simpleString()}>")
    rows = df.select(F.explode(F.when(F.ltrim("document").startswith("["), listed).otherwise(F.array(whole))).alias("r"))
    return rows.select("r.*")
