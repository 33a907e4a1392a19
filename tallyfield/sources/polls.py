"""Poll feeds as a streaming data source: pages are offsets and input partitions.

`spark.readStream.format("poll_feed")` (or `spark.read`) gives a row (page, document) for each
record of each page.  A feed only grows: page k, once there, stays.  What fetches a page and
what counts the pages are callables named by options `fetch` and `pages` ("module:function"), called with
the endpoint and the options (and a page number).  A stream starts after the last page it has
committed, reads every new page in a task of its own, and fails rather than skip a page.

A page is its JSON text, or records' JSON texts one after the other, which no task holds together.
The default callables read saved pages, `<root>/<endpoint>/page=<k>/`, line by line from any
file system that Arrow knows; a missing client library is named before anything is read.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterable, Iterator, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tallyfield.streaming.folds import CONFIRMED

#: Rows of a lineup that are starters, and how many make one whole.
STARTER = 11
ELEVEN = 11


def file_system(root: str) -> tuple[Any, str]:
    """(file system, path) of a folder or address; a scheme whose client is not there raises with its name."""
    from pyarrow import fs

    if "://" not in root and not root.startswith("file:"):
        return fs.LocalFileSystem(), root
    scheme = root.partition(":")[0]
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + root.partition(":")[2].lstrip("/")
    try:
        return fs.FileSystem.from_uri(root)
    except (OSError, ValueError, ImportError) as why:
        raise RuntimeError(f"{scheme}: no client for {root} here ({why})") from why


def lines(stream: Any, size: int = 1 << 20) -> Iterator[str]:
    """Lines of a stream of bytes, of which `size` are read at a time; empty ones are left out."""
    rest: list[bytes] = []
    while block := stream.read(size):
        first, *more = block.split(b"\n")
        rest.append(first)
        for part in more:
            yield b"".join(rest).decode()
            rest = [part]
    yield b"".join(rest).decode()


def saved_page(endpoint: str, options: Mapping[str, str], page: int) -> Iterator[str]:
    """The JSON lines of a saved page."""
    from pyarrow import fs

    system, path = file_system(options["root"])
    found = system.get_file_info(fs.FileSelector(f"{path}/{endpoint}/page={page}", allow_not_found=False))
    for info in sorted(found, key=lambda f: f.path):
        if info.is_file and not info.base_name.startswith(("_", ".")):
            with system.open_input_stream(info.path) as f:
                yield from (x for x in lines(f) if x.strip())


def texts(body: str | bytes | Iterable[str]) -> Iterator[str]:
    """The records of a page as JSON texts; what is no JSON raises."""
    if isinstance(body, (str, bytes, bytearray)):
        got = json.loads(body)
        yield from (json.dumps(r) for r in (got if isinstance(got, list) else [got]))
    else:
        for text in body:
            yield json.dumps(json.loads(text))


def saved_pages(endpoint: str, options: Mapping[str, str]) -> int:
    """How many pages are saved without a gap."""
    from pyarrow import fs

    system, path = file_system(options["root"])
    names = {f.base_name for f in system.get_file_info(fs.FileSelector(f"{path}/{endpoint}", allow_not_found=True))}
    n = 0
    while f"page={n + 1}" in names:
        n += 1
    return n


def last_page(exists) -> int:
    """The number of pages of a feed that only tells whether a page is there: doubling, then halving."""
    high = 1
    while exists(high):
        high *= 2
    low = high // 2
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if exists(middle) else (low, middle)
    return low


class _Page(InputPartition):
    def __init__(self, page: int):
        self.page = page


class _Feed:
    def __init__(self, options: Mapping[str, str]):
        self.options = dict(options)
        self.endpoint = self.options["endpoint"]

    def _call(self, option: str, default: str, *more):
        module, _, name = self.options.get(option, f"{__name__}:{default}").partition(":")
        return getattr(importlib.import_module(module), name)(self.endpoint, self.options, *more)

    def count(self) -> int:
        return self._call("pages", "saved_pages")

    def read(self, partition: _Page) -> Iterator[tuple[int, str]]:
        body = self._call("fetch", "saved_page", partition.page)
        if body is None:
            raise RuntimeError(f"{self.endpoint}: page {partition.page} is gone")
        for text in texts(body):
            yield partition.page, text


class _Batch(_Feed, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return [_Page(k + 1) for k in range(self.count())]


class _Stream(_Feed, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        return {"page": self.count()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Page(k + 1) for k in range(start["page"], end["page"])]


class PollFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "poll_feed"

    def schema(self) -> str:
        return "page int, document string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self.options)


def infer(spark: SparkSession, endpoint: str, options: Mapping[str, str]) -> str:
    """The schema of a feed's records, as its first page has them."""
    body = _Feed(dict(options) | {"endpoint": endpoint})._call("fetch", "saved_page", 1)
    return spark.range(1).select(F.schema_of_json(F.lit(f"[{','.join(texts(body))}]"))).first()[0].removeprefix("ARRAY<").removesuffix(">")


def read(spark: SparkSession, endpoint: str, schema: str | None = None, stream: bool = False, **options: str) -> DataFrame:
    """Records of a feed, parsed by a schema or by that of its first page, as a batch or as a stream."""
    spark.dataSource.register(PollFeed)
    schema = schema or infer(spark, endpoint, options)
    reader = (spark.readStream if stream else spark.read).format("poll_feed").option("endpoint", endpoint)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load().select("page", F.from_json("document", schema).alias("r")).select("page", "r.*")


def _lineups(fixture: Column) -> Column:
    """Confirmed lineups of a fixture: teams with a whole eleven of starters, each named by id or else by name."""
    starters = F.filter(F.coalesce(fixture["lineups"], F.array().cast("array<struct<type_id:bigint,team_id:bigint,player_id:bigint,player_name:string>>")), lambda p: (p["type_id"] == STARTER) & p["team_id"].isNotNull() & (F.coalesce(p["player_id"].cast("string"), p["player_name"], F.lit("")) != ""))
    teams = F.array_sort(F.array_distinct(F.transform(starters, lambda p: p["team_id"].cast("string"))))
    of = lambda t: F.array_sort(F.transform(F.filter(starters, lambda p: p["team_id"].cast("string") == t), lambda p: F.coalesce(p["player_id"].cast("string"), p["player_name"])))
    all_ = F.transform(teams, lambda t: F.struct(fixture["id"].cast("string").alias("match_key"), t.alias("team"), F.lit(CONFIRMED).alias("status"), of(t).alias("players")))
    return F.filter(all_, lambda x: F.size(x["players"]) >= ELEVEN)


#: Records of the lineup feed: a look at the fixtures of a day.
LINEUP_FEED = "observed_at timestamp, error string, data array<struct<id:bigint,lineups:array<struct<type_id:bigint,team_id:bigint,player_id:bigint,player_name:string>>>>"


def lineup_polls(records: DataFrame, source: str) -> DataFrame:
    """Polls (source, observed_at, scope, error, lineups) of lineup records; a failed look has no scope, and 0 is no fixture that was asked for."""
    fixtures = F.filter(F.coalesce("data", F.array().cast(records.schema["data"].dataType)), lambda f: f["id"].isNotNull())
    ok = F.col("error").isNull()
    return records.select(F.lit(source).alias("source"), F.col("observed_at"), F.when(ok, F.transform(F.filter(fixtures, lambda f: f["id"] != 0), lambda f: f["id"].cast("string"))).otherwise(F.array().cast("array<string>")).alias("scope"), "error", F.flatten(F.transform(F.when(ok, fixtures).otherwise(F.slice(fixtures, 1, 0)), _lineups)).alias("lineups"))
