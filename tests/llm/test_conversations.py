"""Conversation repair against an exhaustive search and the SQL that states it."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from oracle import rows_of, rows_of_sql
from tallyfield.llm import conversations as cv

SCHEMA = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile("(s?(ua)+)?")


def cheapest(rows):
    """(cost, audit, lines) by search over whole edit lists; rows: (role, text, fault)."""
    best, heap, done = None, [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, roles, lines = heapq.heappop(heap)
        if best and cost > best[0]:
            break
        if at == len(rows) and GRAMMAR.fullmatch(roles):
            best = min(best, (cost, audit, lines)) if best else (cost, audit, lines)
        state = ("" if not roles else roles[-1], at, audit)
        if state in done:
            continue
        done.add(state)

        def go(more, letter, step, initial="", line=()):
            now = roles + initial
            if re.fullmatch("s?(ua)*u?", now):
                heapq.heappush(heap, (cost + more, audit + letter, at + step, now, lines + line))  # noqa: B023

        if not audit.endswith("II"):
            for role in ("user", "assistant"):
                go(2, "I", 0, role[0], (f"{role}:",))
        if at < len(rows):
            role, text, fault = rows[at]
            go(3, "D", 1)
            if fault not in ("blank", "duplicate"):
                late = fault == "truncated"
                if role[:1]:
                    go(late, "K", 1, role[0], (f"{role}:{text}",))
                for new in ("user", "assistant"):
                    go(2 + late, "R", 1, new[0], (f"{new}:{text}",))
    return best


def brute(table):
    out = {}
    for conv in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in (r for r in table if r[0] == conv):
            role, text = (" " if x is None else x for x in (role, text))
            digit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if digit == 1 else re.sub("[.!?]", "", text) if digit == 2 else text
            rows += [(turn, "user" if digit == 4 else role, text)] * (0 if digit == 0 else 2 if digit == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, judged = set(), []
        for _, role, text in rows:
            body = re.findall("[^\x20\x09-\x0D]", text)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            judged.append((role, text, fault))
            seen.add((role, text))
        turns = {r[0] for r in rows} - {None}
        count = lambda f: sum(x[2] == f for x in judged)  # noqa: B023, E731
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
        cost, audit, lines = cheapest(judged)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def made(n, seed=1):
    pick = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", "u", None]
    texts = ["Yes.", "No", "", " \t", None, "Why?", "Yes.", "a longer text\nof two lines!", "end. \x0b", "über…"]
    table = []
    for conv in range(n):
        for k in range(pick.randrange(0, 7)):
            table.append((conv, pick.choice([k, k, k, k + 3, None]), pick.choices(roles, [8, 8, 2, 1, 1, 1, 1])[0], pick.choice(texts)))
    return table + [(None, 0, "user", "Hi."), (None, 1, "assistant", "Hi.")]


def rows(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


def test_against_a_search(spark):
    table = made(120)
    got = rows(cv.report(cv.damaged(spark.createDataFrame(table, SCHEMA).repartition(3))))
    assert got == brute(table)


def test_sql_on_odd_rows(spark):
    import duckdb
    import pandas as pd

    table = made(60, 2)
    con = duckdb.connect()
    frame = pd.DataFrame(table, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    con.register("made_rows", frame)
    con.execute("CREATE VIEW conversations AS SELECT * REPLACE (CAST(role AS VARCHAR) AS role, CAST(text AS VARCHAR) AS text) FROM made_rows")
    df = cv.report(cv.damaged(spark.createDataFrame(table, SCHEMA)))
    assert rows_of(df) == rows_of_sql(con, cv.OP13_SQL, df.columns)


def test_given_table(spark, data):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{data}/conversations.parquet'")
    df = cv.op13_conversation_repair(spark, data)
    assert rows_of(df) == rows_of_sql(con, cv.OP13_SQL, df.columns)


def test_a_conversation_over_many_batches(spark):
    """Batches of 50 rows: costs and states are handed from one to the next, both ways."""
    pick = random.Random(3)
    table = [(7, k, pick.choice(["user", "assistant", "system", "tool"]), f"text {k}" + pick.choice([".", "", "?"])) for k in range(400)] + [(8, k, "user", "x.") for k in range(3)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        some = cv.report(cv.damaged(spark.createDataFrame(table, SCHEMA))).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    whole = cv.report(cv.damaged(spark.createDataFrame(table, SCHEMA))).collect()
    assert sorted(map(tuple, some)) == sorted(map(tuple, whole)) and len(whole) == 2


def test_repaired_rows_are_those_of_the_digest(spark):
    df = cv.damaged(spark.createDataFrame(made(40, 4), SCHEMA))
    digests = {r["conv_id"]: r["repaired_sha256"] for r in cv.report(df).collect()}
    lines = {}
    for r in cv.repaired(df).orderBy("conv_id", "position").collect():
        lines.setdefault(r["conv_id"], []).append(r)
    for conv, digest in digests.items():
        got = lines.get(conv, [])
        assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in got).encode()).hexdigest() == digest
        assert [r["position"] for r in got] == list(range(len(got)))
        assert GRAMMAR.fullmatch("".join(r["role"][0] for r in got))


def test_undamaged_and_empty(spark):
    fine = spark.createDataFrame([(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Hello!")], SCHEMA)
    (r,) = cv.report(fine).collect()
    assert (r["cost"], r["audit"], r["illegal"]) == (0, "KKK", 0)
    assert cv.report(cv.damaged(spark.createDataFrame([], SCHEMA))).collect() == []
    extra = fine.withColumns({"_gone_": F.lit(1), "cost": F.lit("x")})
    assert cv.report(extra.select("conv_id", "turn", "role", "text")).count() == 1


@pytest.mark.parametrize("kind", ["string", "int"])
def test_ids_of_any_type(spark, kind):
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "assistant", "Oh")], SCHEMA).withColumn("conv_id", F.col("conv_id").cast(kind))
    (r,) = cv.report(df).collect()
    assert r["conv_id"] == ("1" if kind == "string" else 1) and r["cost"] == 1
