"""Feeds of two match-data providers as lazy flows.

Each method takes the feed's own arguments, checks their combination before anything is
read, and gives a `Flow` over the feed's records.  What a method asks for is a `Request`
(path, query parameters, whether it has pages, where its records are), so requests can be
made and looked at without a network; reading goes through the paged data source of
`api`, whose `fetch` function gets the path and the parameters as options.

Records are JSON text (column `record`) unless a schema is given.  Feeds whose document is
un-nested (line-ups, statistics, events, standings) need the document's schema for that.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfield.flow import Flow
from tallyfield.sources import api, nested

Day = str | dt.date | dt.datetime


@dataclass(frozen=True)
class Request:
    """One feed with its arguments: path below the provider's root, parameters, paging, places of its records."""

    feed: str
    path: str
    params: dict[str, str] = field(default_factory=dict)
    paged: bool = False
    places: tuple[str, ...] = ()
    unnest: Callable[[DataFrame], DataFrame] | None = None

    def page(self, number: int, size: int = api.PAGE_SIZE) -> dict[str, str]:
        """Parameters of one page."""
        return self.params | ({"_pgNm": str(number), "_pgSz": str(size)} if self.paged else {})


def yes(flag: bool | None) -> str | None:
    return None if flag is None else "yes" if flag else "no"


def listed(value: Any) -> str | None:
    """One value or several, as text."""
    if value is None:
        return None
    return ",".join(map(str, value)) if isinstance(value, (list, tuple)) else str(value)


def instant(day: Day) -> dt.datetime:
    if isinstance(day, dt.datetime):
        return day.replace(tzinfo=None)
    if isinstance(day, dt.date):
        return dt.datetime(day.year, day.month, day.day)
    if isinstance(day, str):
        return dt.datetime.fromisoformat(day.replace("Z", ""))
    raise TypeError(f"{day!r} is no day")


class _Provider:
    name = ""

    def __init__(self, spark: SparkSession, fetch: str | None = None, **options: Any):
        """fetch ("module:function") reads a page; options go to it as they are (root, key, pages, page_size)."""
        self.spark, self.fetch, self.options = spark, fetch, options

    def documents(self, request: Request) -> DataFrame:
        """(page, document) of a request."""
        self.spark.dataSource.register(api.PagedJson)
        reader = self.spark.read.format("paged_json").option("endpoint", request.feed).option("path_of_request", request.path)
        reader = reader.option("params", json.dumps(request.params, sort_keys=True))
        reader = reader.option("places", ",".join(request.places)) if request.paged else reader.option("pages", "1")
        for k, v in self.options.items():
            reader = reader.option(k, str(v))
        return (reader.option("fetch", self.fetch) if self.fetch else reader).load()

    def flow(self, request: Request, schema: T.StructType | str | None = None) -> Flow:
        """The records of a request; with a schema (of the document where the feed is un-nested, else of a record) parsed."""
        pages = self.documents(request)
        kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        if request.unnest is not None:
            if kind is None:
                return Flow(pages.select(F.col("document").alias("record")))
            return Flow(request.unnest(pages.select(F.from_json("document", kind).alias("d")).select("d.*")))
        rows = pages.select(F.explode(_records(F.col("document"), request.places)).alias("record"))
        return Flow(rows if kind is None else rows.select(F.from_json("record", kind).alias("r")).select("r.*"))


def _records(document: Column, places: Sequence[str]) -> Column:
    """The JSON texts of the first place that holds a list; a document that is a list itself, or else the document."""
    found = [F.when(F.ltrim(document).startswith("["), F.from_json(document, "array<string>"))]
    for place in places:
        kind = "array<string>"
        for part in reversed(place.split(".")):
            kind = f"struct<`{part}`:{kind}>"
        value = F.from_json(document, kind)
        for part in place.split("."):
            value = value.getField(part)
        found.append(value)
    return F.coalesce(*found, F.array(document))


class StatsBomb(_Provider):
    """Competitions, matches, events, line-ups and statistics; every feed is one document whose values are the records."""

    name = "statsbomb"

    def _of(self, feed: str, schema: Any, **params: Any) -> Flow:
        return self.flow(self.request(feed, **params), schema)

    @staticmethod
    def request(feed: str, **params: Any) -> Request:
        if feed not in api.STATSBOMB:
            raise ValueError(f"unknown feed {feed}")
        return Request(feed, f"/{feed}", {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in params.items() if v is not None})

    def competitions(self, schema: Any = None) -> Flow:
        return self._of("competitions", schema)

    def matches(self, competition_id: int, season_id: int, schema: Any = None) -> Flow:
        return self._of("matches", schema, competition_id=competition_id, season_id=season_id)

    def events(self, match_id: int, include_360_metrics: bool = False, schema: Any = None) -> Flow:
        return self._of("events", schema, match_id=match_id, include_360_metrics=include_360_metrics)

    def lineups(self, match_id: int, schema: Any = None) -> Flow:
        return self._of("lineups", schema, match_id=match_id)

    def player_match_stats(self, match_id: int, schema: Any = None) -> Flow:
        return self._of("player_match_stats", schema, match_id=match_id)

    def player_season_stats(self, competition_id: int, season_id: int, schema: Any = None) -> Flow:
        return self._of("player_season_stats", schema, competition_id=competition_id, season_id=season_id)

    def team_match_stats(self, match_id: int, schema: Any = None) -> Flow:
        return self._of("team_match_stats", schema, match_id=match_id)

    def team_season_stats(self, competition_id: int, season_id: int, schema: Any = None) -> Flow:
        return self._of("team_season_stats", schema, competition_id=competition_id, season_id=season_id)


class Requests:
    """Requests of the second provider's feeds.  Paths and parameter names are its fixed values."""

    def __init__(self, key: str = "", names: str = "en-op"):
        self.key, self.names = key, names

    def _of(self, feed: str, path: str, places: Sequence[str] = (), paged: bool = False, unnest=None, use_opta_names: bool = False, **params: str | None) -> Request:
        head, _, tail = path.partition("/")
        sent = {"_fmt": "json"} | params | ({"_lcl": self.names} if use_opta_names else {})
        return Request(feed, f"/{head}/{self.key}" + (f"/{tail}" if tail else ""), {k.replace("mt_", "mt."): v for k, v in sent.items() if v is not None}, paged, tuple(places), unnest)

    def tournament_calendars(self, status: str = "all", competition_uuid: str | None = None, contestant_uuid: str | None = None, include_stages: bool = False, include_coverage: bool = False) -> Request:
        ways = {"all": "", "active": "/active", "authorized": "/authorized", "active_authorized": "/active/authorized"}
        if status not in ways:
            raise ValueError(f"status is one of {', '.join(ways)}")
        return self._of("tournament_calendars", f"tournamentcalendar{ways[status]}", ["competition"], True, comp=competition_uuid, ctst=contestant_uuid, stages="yes" if include_stages else None, coverage="yes" if include_coverage else None)

    def venues(self, tournament_calendar_uuid: str | None = None, contestant_uuid: str | None = None, venue_uuid: str | None = None, use_opta_names: bool = False) -> Request:
        if not (tournament_calendar_uuid or contestant_uuid or venue_uuid):
            raise ValueError("venues needs a tournament calendar, a contestant or a venue")
        return self._of("venues", "venues", ["venue"], True, tmcl=tournament_calendar_uuid, ctst=contestant_uuid, venue=venue_uuid, use_opta_names=use_opta_names)

    def areas(self, area_uuid: str | None = None, use_opta_names: bool = False) -> Request:
        return self._of("areas", f"areas/{area_uuid}" if area_uuid else "areas", ["area"], not area_uuid, use_opta_names=use_opta_names)

    def tournament_schedule(self, tournament_calendar_uuid: str, coverage_level: int | Sequence[int] | None = None, use_opta_names: bool = False) -> Request:
        return self._of("tournament_schedule", f"tournamentschedule/{_given(tournament_calendar_uuid, 'tournament_calendar_uuid')}", unnest=nested.tournament_schedule, cvlv=listed(coverage_level), use_opta_names=use_opta_names)

    def matches(self, fixture_uuids: Sequence[str] | None = None, tournament_calendar_uuid: str | None = None, competition_uuids: Sequence[str] | None = None, contestant_uuid: str | None = None, opponent_uuid: str | None = None, contestant_position: str | None = None, date_from: Day | None = None, date_to: Day | None = None, delta_timestamp: str | None = None, live: bool = False, lineups: bool = False, use_opta_names: bool = False) -> Request:
        between = None
        if (date_from is None) != (date_to is None):
            raise ValueError("date_from and date_to come together")
        if date_from is not None and date_to is not None:
            first, last = instant(date_from), instant(date_to)
            if first > last:
                raise ValueError("date_from is after date_to")
            between = f"[{first:%Y-%m-%dT%H:%M:%SZ} TO {last:%Y-%m-%dT%H:%M:%SZ}]"
        return self._of("matches", "match", ["match", "matches.match"], True, fx=listed(fixture_uuids), tmcl=tournament_calendar_uuid, comp=listed(competition_uuids), ctst=contestant_uuid, ctst2=opponent_uuid, ctstpos=contestant_position, mt_mDt=between, _dlt=delta_timestamp, live=yes(live or lineups), lineups=yes(lineups), use_opta_names=use_opta_names)

    def match(self, fixture_uuid: str, live: bool = False, lineups: bool = False, use_opta_names: bool = False) -> Request:
        return self._of("match", f"match/{_given(fixture_uuid, 'fixture_uuid')}", unnest=nested.match_basic, live=yes(live or lineups), lineups=yes(lineups), use_opta_names=use_opta_names)

    def match_stats_player(self, fixture_uuids: str | Sequence[str], use_opta_names: bool = False) -> Request:
        return self._of("match_stats_player", "matchstats", unnest=lambda df: nested.match_basic(df, include_players=True), fx=listed(_given(fixture_uuids, "fixture_uuids")), use_opta_names=use_opta_names)

    def match_stats_team(self, fixture_uuids: str | Sequence[str], use_opta_names: bool = False) -> Request:
        return self._of("match_stats_team", "matchstats", unnest=lambda df: nested.team_stats(nested.match_basic(df)), fx=listed(_given(fixture_uuids, "fixture_uuids")), use_opta_names=use_opta_names)

    def events(self, fixture_uuid: str, contestant_uuid: str | None = None, person_uuid: str | None = None, event_types: int | Sequence[int] | None = None, use_opta_names: bool = False) -> Request:
        return self._of("events", f"matchevent/{_given(fixture_uuid, 'fixture_uuid')}", unnest=nested.match_events, ctst=contestant_uuid, prsn=person_uuid, type=listed(event_types), use_opta_names=use_opta_names)

    def pass_matrix(self, fixture_uuid: str, use_opta_names: bool = False) -> Request:
        return self._of("pass_matrix", f"passmatrix/{_given(fixture_uuid, 'fixture_uuid')}", unnest=nested.pass_matrix, use_opta_names=use_opta_names)

    def possession(self, fixture_uuid: str, use_opta_names: bool = False) -> Request:
        return self._of("possession", f"possession/{_given(fixture_uuid, 'fixture_uuid')}", unnest=nested.possession, use_opta_names=use_opta_names)

    def player_career(self, person_uuid: str | None = None, contestant_uuid: str | None = None, active: bool = True, use_opta_names: bool = False) -> Request:
        if bool(person_uuid) == bool(contestant_uuid):
            raise ValueError("player_career needs either a person or a contestant")
        if person_uuid:
            return self._of("player_career", f"playercareer/{person_uuid}", unnest=nested.player_careers, prsn=person_uuid, use_opta_names=use_opta_names)
        return self._of("player_career", "playercareer", ["person"], True, ctst=contestant_uuid, active=yes(active), use_opta_names=use_opta_names)

    def referees(self, person_uuid: str | None = None, tournament_calendar_uuid: str | None = None, stage_uuid: str | None = None, use_opta_names: bool = False) -> Request:
        if sum(map(bool, (person_uuid, tournament_calendar_uuid, stage_uuid))) != 1:
            raise ValueError("referees needs one of a person, a tournament calendar and a stage")
        return self._of("referees", "referees", ["referee"], not person_uuid, nested.referees, prsn=person_uuid, tmcl=tournament_calendar_uuid, stg=stage_uuid, use_opta_names=use_opta_names)

    def rankings(self, tournament_calendar_uuid: str, use_opta_names: bool = False) -> Request:
        return self._of("rankings", "rankings", unnest=nested.rankings, tmcl=_given(tournament_calendar_uuid, "tournament_calendar_uuid"), use_opta_names=use_opta_names)

    def injuries(self, person_uuid: str | None = None, tournament_calendar_uuid: str | None = None, contestant_uuid: str | None = None, use_opta_names: bool = False) -> Request:
        if not (person_uuid or tournament_calendar_uuid):
            raise ValueError("injuries needs a person or a tournament calendar")
        if contestant_uuid and (person_uuid or not tournament_calendar_uuid):
            raise ValueError("a contestant's injuries are asked for with a tournament calendar and no person")
        alone = person_uuid and not tournament_calendar_uuid
        return self._of("injuries", f"injuries/{person_uuid}" if alone else "injuries", ["person"], not person_uuid, nested.injuries, prsn=person_uuid, tmcl=tournament_calendar_uuid, ctst=contestant_uuid, use_opta_names=use_opta_names)

    def transfers(self, person_uuid: str | None = None, contestant_uuid: str | None = None, competition_uuid: str | None = None, tournament_calendar_uuid: str | None = None, start_date: Day | None = None, end_date: Day | None = None, use_opta_names: bool = False) -> Request:
        if not (person_uuid or contestant_uuid or competition_uuid or tournament_calendar_uuid):
            raise ValueError("transfers needs a person, a contestant, a competition or a tournament calendar")
        if (start_date is None) != (end_date is None):
            raise ValueError("start_date and end_date come together")
        if start_date is not None and (tournament_calendar_uuid or not competition_uuid):
            raise ValueError("dates go with a competition, not with a tournament calendar")
        days = [None if d is None else f"{instant(d):%Y-%m-%d}" for d in (start_date, end_date)]
        return self._of("transfers", "transfers", ["person"], not person_uuid, nested.transfers, prsn=person_uuid, ctst=contestant_uuid, comp=competition_uuid, tmcl=tournament_calendar_uuid, strtDt=days[0], endDt=days[1], use_opta_names=use_opta_names)

    def teams(self, tournament_calendar_uuid: str | None = None, contestant_uuid: str | None = None, country_uuid: str | None = None, stage_uuid: str | None = None, series_uuid: str | None = None) -> Request:
        return self._of("teams", "team", ["contestants.contestant", "contestant"], True, tmcl=tournament_calendar_uuid, ctst=contestant_uuid, ctry=country_uuid, stg=stage_uuid, srs=series_uuid)

    def team_standings(self, tournament_calendar_uuid: str, stage_uuid: str | None = None, live: bool = False, type: str | None = None, use_opta_names: bool = False) -> Request:
        return self._of("team_standings", "standings", tmcl=_given(tournament_calendar_uuid, "tournament_calendar_uuid"), stg=stage_uuid, live=yes(live), type=type, use_opta_names=use_opta_names)

    def squads(self, tournament_calendar_uuid: str | None = None, contestant_uuid: str | None = None, use_opta_names: bool = False) -> Request:
        return self._of("squads", "squads", ["squad", "teamSquads.squad"], True, tmcl=tournament_calendar_uuid, ctst=contestant_uuid, use_opta_names=use_opta_names)

    def player_season_stats(self, tournament_calendar_uuid: str, contestant_uuid: str, detailed: bool = True) -> Request:
        return self._of("player_season_stats", "seasonstats", unnest=nested.season_player_stats, tmcl=_given(tournament_calendar_uuid, "tournament_calendar_uuid"), ctst=_given(contestant_uuid, "contestant_uuid"), detailed=yes(detailed))

    def team_season_stats(self, tournament_calendar_uuid: str, contestant_uuid: str | None = None, detailed: bool = True) -> Request:
        return self._of("team_season_stats", "seasonstats", unnest=nested.season_team_stats, tmcl=_given(tournament_calendar_uuid, "tournament_calendar_uuid"), ctst=contestant_uuid, detailed=yes(detailed))

    def contestant_participation(self, contestant_uuid: str | None = None, active: bool = False) -> Request:
        return self._of("contestant_participation", "contestantparticipation", ["contestant.competition", "competition"], ctst=contestant_uuid, active=yes(active))


def _given(value: Any, name: str) -> Any:
    if not value:
        raise ValueError(f"{name} is needed")
    return value


class Opta(_Provider):
    """Every feed of `Requests` as a method with the same arguments and `schema`."""

    name = "opta"

    def __init__(self, spark: SparkSession, fetch: str | None = None, key: str = "", **options: Any):
        super().__init__(spark, fetch, **options)
        self.requests = Requests(key)

    def __getattr__(self, feed: str) -> Callable[..., Flow]:
        if feed.startswith("_") or feed not in api.OPTA:
            raise AttributeError(feed)
        make = getattr(self.requests, feed)

        def call(*args: Any, schema: Any = None, **kwargs: Any) -> Flow:
            return self.flow(make(*args, **kwargs), schema)

        call.__name__, call.__doc__ = feed, make.__doc__
        return call

    def __dir__(self) -> list[str]:
        return [*super().__dir__(), *api.OPTA]


class FPL(_Provider):
    """Feeds of the fantasy game.  Paths and places are fixed values; the schema is that of one record."""

    name = "fpl"

    @staticmethod
    def request(feed: str, **ids: int) -> Request:
        ways = {
            "gameweek_info": ("/bootstrap-static/", ("events",)),
            "player_data": ("/bootstrap-static/", ("elements",)),
            "player_history": ("/element-summary/{player_id}/", ("history",)),
            "rankings": ("/leagues-classic/{league_id}/standings/", ("standings.results",)),
            "entry_picks": ("/entry/{entry_id}/event/{gameweek}/picks/", ("picks",)),
            "entry_transfers": ("/entry/{entry_id}/transfers/", ()),
        }
        if feed not in ways:
            raise ValueError(f"unknown feed {feed}")
        path, places = ways[feed]
        if any(v < 1 for v in ids.values()):
            raise ValueError("ids count from 1")
        return Request(feed, path.format(**ids), {}, False, places)

    def gameweek_info(self, schema: Any = None) -> Flow:
        return self.flow(self.request("gameweek_info"), schema)

    def current_gameweek(self) -> Flow:
        """The gameweek that is on, with its id."""
        weeks = self.gameweek_info("id int, is_current boolean").df
        return Flow(weeks.filter("is_current").select("id"))

    def player_data(self, schema: Any = None) -> Flow:
        return self.flow(self.request("player_data"), schema)

    def player_id_mappings(self) -> Flow:
        """Ids and names of all players."""
        return self.player_data("id int, first_name string, second_name string, web_name string")

    def player_history(self, player_id: int, schema: Any = None) -> Flow:
        return self.flow(self.request("player_history", player_id=player_id), schema)

    def rankings(self, league_id: int = 314, schema: Any = None) -> Flow:
        return self.flow(self.request("rankings", league_id=league_id), schema)

    def entry_picks(self, entry_id: int, gameweek: int, schema: Any = None) -> Flow:
        return self.flow(self.request("entry_picks", entry_id=entry_id, gameweek=gameweek), schema)

    def entry_transfers(self, entry_id: int, schema: Any = None) -> Flow:
        return self.flow(self.request("entry_transfers", entry_id=entry_id), schema)
