"""Python aggregates of groups of any size: states are made batch by batch where rows lie, and merged.

Rows are dealt by ranges of their groups, a hot group's over several tasks, and sorted, so that a
batch holds few groups and `add` is called for each of these once.  A task sends on states; a
group's states meet in steps, so a hot group is as many small states as it has tasks.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from itertools import groupby
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Groups whose states a task holds before it sends them on.
HELD = 50_000
#: Rows of a batch that is sent on.
PAGE = 10_000
#: Parts in which a group's states are merged first.
SALTS = 32


def merge_aggregate(df: DataFrame, by: Sequence[str], fields: Sequence[str], name: str, returns: str, add: Callable[[Any, pd.DataFrame], Any], merge: Callable[[Any, Any], Any], finish: Callable[[Any], Any]) -> DataFrame:
    """by and `name`: add(state or None, rows of a group in a batch) gives a state, merge joins two of them, finish gives the value.

    The order in which rows and states come is not fixed, so merge must not depend on it; states are pickled."""
    keys = [F.col(f"`{c}`").alias(f"_g{k}") for k, c in enumerate(by)]
    names = [f"_g{k}" for k in range(len(by))]
    rows = df.select(*keys, *[F.col(f"`{c}`") for c in fields])
    schema = T.StructType([*[rows.schema[n] for n in names], T.StructField("_state", T.BinaryType())])

    def sent(held: dict) -> pd.DataFrame:
        return pd.DataFrame([(*k, pickle.dumps(v)) for k, v in held.items()], columns=schema.names)

    def plain(key: Any) -> tuple:
        return tuple(None if pd.isna(x) else x for x in (key if isinstance(key, tuple) else (key,)))

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for pdf in batches:
            for key, own in pdf.groupby(names, dropna=False, sort=False) if names else [((), pdf)]:
                k = plain(key) if names else ()
                held[k] = add(held.get(k), own[list(fields)].reset_index(drop=True))
            if len(held) > HELD:
                yield sent(held)
                held = {}
        if held:
            yield sent(held)

    def joined(pickled: list[bytes]) -> Any:
        states = [pickle.loads(s) for s in pickled]  # noqa: S301  states of our own
        while len(states) > 1:
            states = [merge(*states[k : k + 2]) if k + 1 < len(states) else states[k] for k in range(0, len(states), 2)]
        return states[0]

    def runs(batches: Iterator[pd.DataFrame], keys: int) -> Iterator[tuple[tuple, Any]]:
        """Keys and merged state of each run of rows with the same keys."""
        rows = (r for pdf in batches for r in pdf.itertuples(index=False, name=None))
        for key, own in groupby(rows, key=lambda r: plain(r[:keys])):
            yield key, joined([r[-1] for r in own])

    def paged(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
        held = []
        for r in rows:
            held.append(r)
            if len(held) == PAGE:
                yield pd.DataFrame(held, columns=columns)
                held = []
        if held:
            yield pd.DataFrame(held, columns=columns)

    def halfway(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return paged(((*key[:-1], pickle.dumps(state)) for key, state in runs(batches, len(names) + 1)), schema.names)

    def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return paged(((*key, finish(state)) for key, state in runs(batches, len(names))), [*names, name])

    if names:
        rows = rows.repartitionByRange(*names, F.xxhash64(*[F.col(f"`{c}`") for c in fields] or names)).sortWithinPartitions(*names)
    states = rows.mapInPandas(gather, schema).withColumn("_salt", F.pmod(F.xxhash64("_state"), F.lit(SALTS)))
    some = states.repartition(*names, "_salt").sortWithinPartitions(*names, "_salt").select(*names, "_salt", "_state").mapInPandas(halfway, schema)
    out = T.StructType([*schema.fields[:-1], T.StructField(name, T._parse_datatype_string(returns))])
    met = some.repartition(*names).sortWithinPartitions(*names) if names else some.coalesce(1)
    return met.mapInPandas(last, out).toDF(*by, name)
