"""Conversation structure repair: the cheapest edits that give each conversation a legal order of roles.

Grammar of role initials: `(s?(ua)+)?`.  A row is kept (K, free), gets the role user or assistant
(R, 2) or is deleted (D, 3; blank and duplicate rows must be); an empty user or assistant row
is inserted anywhere (I, 2); a truncated row that stays costs 1 more.  Of the cheapest edits those
whose initials are least in ASCII order count.

Method: rows are hash-partitioned by conversation and read in Arrow batches; within a batch a
recursive DuckDB query advances one turn of all conversations at a time.  It goes from the last
turn to the first and keeps, for each state of the grammar, the least cost and the initials with
which its audit goes on (`choose`).  Two edits of one row and state never begin alike, so the
initials alone settle ties and no audit has to be copied at each turn: a conversation costs time
and space in proportion to its rows.  A second recursion walks the chosen edits forward (`trace`).
What a conversation needs beyond the end of a batch (the costs of four states, or the state) is
handed to the next batch, so one with a third of all rows streams through a task in bounded memory;
its digest is sequential by definition.

Cases: nulls in any column are one space (a null conversation is one of its own and stays null);
rows at one turn are taken by role and text, repeated rows one after the other; a role without an
initial, or with one other than s, u or a, is never kept; blank goes before duplicate, duplicate before truncated;
a conversation without rows after damage has zeros and empty results; an empty table gives none;
texts of any length are whole; columns other than the four are not read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfield.llm._spark import bound_batches, table

#: States of the grammar: nothing yet, after a system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
KEEPS = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: The row that an insertion or a new role gives in each state.
GIVES = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Inserted rows that end a conversation legally from each state.
ENDS = {START: [], SYSTEM: ["user", "assistant"], USER: ["assistant"], ASSISTANT: []}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Kinds of rows beside the initials s, u and a: any other role; one that has to go; one that the damage dropped.
OTHER, DOOMED, ABSENT = "o", "d", "x"
#: Characters that do not make a text.
SPACE = " \t\n\x0b\x0c\r"


def _moves() -> list[tuple[int, str, str, int, int, int]]:
    """(state, kind, initials, next state, cost, 1 if the row stays): at most two insertions go before a row, as a third would lead back to where the first led."""
    out = []
    for state, kind, more in itertools.product(range(4), ("s", "u", "a", OTHER, DOOMED), range(3)):
        at = state
        for _ in range(more):
            at = GIVES[at]
        before, paid = "I" * more, INSERT * more
        out.append((state, kind, f"{before}D", at, paid + DELETE, 0))
        if kind != DOOMED:
            out.append((state, kind, f"{before}R", GIVES[at], paid + REROLE, 1))
            if kind in KEEPS[at]:
                out.append((state, kind, f"{before}K", KEEPS[at][kind], paid, 1))
    return out + [(state, ABSENT, "", state, 0, 0) for state in range(4)]


_LIST = _moves()
INITIALS = sorted({m[2] for m in _LIST})
_MOVES = pa.table({"state": [m[0] for m in _LIST], "kind": [m[1] for m in _LIST], "move": [INITIALS.index(m[2]) for m in _LIST], "next": [m[3] for m in _LIST], "cost": [m[4] for m in _LIST], "stays": [m[5] for m in _LIST]})

#: Costs of the states at the last row's end, then turn by turn backwards: of the edits from a state those of least cost, then least initials.
CHOOSE = """
WITH RECURSIVE turns AS (
  SELECT conv, 0 AS k, state, cost, 0 AS move FROM beyond
  UNION ALL
  SELECT conv, k, state, best // 64 AS cost, best % 64 AS move FROM (
    SELECT r.conv, r.k, m.state, min((t.cost + m.cost + m.stays * r.late) * 64 + m.move) AS best
    FROM turns t JOIN lines r ON r.conv = t.conv AND r.k = t.k + 1 JOIN moves m ON m.next = t.state AND m.kind = r.kind
    GROUP BY r.conv, r.k, m.state)
)
SELECT conv, k, CAST(sum(move << (8 * state)) AS BIGINT) AS chosen, list(cost ORDER BY state) AS costs FROM turns WHERE k > 0 GROUP BY conv, k ORDER BY conv, k
"""

#: The chosen edits from the first turn on.
TRACE = """
WITH RECURSIVE walk AS (
  SELECT conv, 0 AS k, state AS next, 0 AS state, 0 AS move FROM reached
  UNION ALL
  SELECT r.conv, r.k, m.next, w.next AS state, m.move
  FROM walk w JOIN lines r ON r.conv = w.conv AND r.k = w.k + 1
  JOIN moves m ON m.state = w.next AND m.kind = r.kind AND m.move = (r.chosen >> (8 * w.next)) & 255
)
SELECT conv, k, state, move, next FROM walk WHERE k > 0 ORDER BY conv, k
"""


def fault_digit(conv: Column, turn: Column) -> Column:
    """crc32 of `conv_id:turn` modulo 20."""
    return F.crc32(F.concat(F.coalesce(conv.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" ")))) % 20


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and _gone: rows dropped, emptied, stripped of their ends, repeated or given to the user by their digit."""
    digit = fault_digit(F.col("conv_id"), F.col("turn"))
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    text = F.when(digit == 0, "").when(digit == 1, "").when(digit == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(digit == 4, "user").otherwise(role)
    once = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (digit == 0).alias("_gone"), F.when(digit == 3, 2).otherwise(1).alias("_times"))
    return once.select("conv_id", "turn", "role", "text", "_gone", F.explode(F.array_repeat(F.lit(0), F.col("_times"))).alias("_copy")).drop("_copy")


def judged(rows: DataFrame) -> DataFrame:
    """Rows in their order (_pos; rows that are _gone stand last) with the kind of each, its first fault, and how it stands to the row before.  rows: conv_id, turn, role, text, and _gone if some are only listed so that their conversation is."""
    if "_gone" not in rows.columns:
        rows = rows.withColumn("_gone", F.lit(False))
    order = Window.partitionBy("conv_id").orderBy("_gone", F.col("turn").asc_nulls_first(), "role", "text")
    initial = F.substring("role", 1, 1)
    body = F.rtrim(F.col("text"), F.lit(SPACE))
    rows = rows.withColumns({"_pos": F.row_number().over(order), "_last": F.lead(F.lit(1)).over(order).isNull(), "_was": F.lag(initial).over(order), "_turn": F.lag("turn").over(order)})
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("_pos")) > 1
    first = F.when(F.col("_gone"), "").when(body == "", "blank").when(seen, "duplicate").when(~F.substring(body, -1, 1).isin(".", "!", "?"), "truncated").otherwise("")
    kind = F.when(F.col("_gone"), ABSENT).when(F.col("_fault").isin("blank", "duplicate"), DOOMED).when(initial.isin("s", "u", "a"), initial).otherwise(OTHER)
    return rows.withColumn("_fault", first).select(
        "conv_id", "turn", "role", "text", "_pos", "_last", "_fault", kind.alias("_kind"),
        (~F.col("_gone") & F.col("_was").isNotNull() & ~F.concat("_was", initial).isin("su", "ua", "au")).alias("_illegal"),
        (~F.col("_gone") & F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("_turn"))).alias("_fresh"),
    )


def _connect() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect(config={"threads": 1, "temp_directory": ""})  # batches are bounded: nothing is spilled to a local folder
    con.register("given", _MOVES)
    con.execute("CREATE TABLE moves AS SELECT * FROM given")
    return con


def _lines(batch: pa.RecordBatch, begins: np.ndarray) -> pa.Table:
    """conv and k (from 1) of each row of a batch, counted from the rows that begin a conversation; a part of the conversation before is conv 0."""
    conv = np.cumsum(begins)
    first = np.flatnonzero(np.diff(conv, prepend=-1))
    k = np.arange(len(conv)) - np.repeat(first, np.diff(first, append=len(conv))) + 1
    late = np.asarray(batch["_fault"].to_pylist(), object) == "truncated"
    return pa.table({"conv": conv, "k": k, "kind": batch["_kind"], "late": late.astype(np.int64)})


def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of `judged` rows by conversation, last row first, with the edit chosen in each state (one byte a state)."""
    con, carried = _connect(), None
    last = [INSERT * len(ENDS[s]) for s in range(4)]
    for batch in batches:
        if not batch.num_rows:
            continue
        lines = _lines(batch, np.asarray(batch["_last"]))
        convs = np.unique(lines["conv"].to_numpy())
        costs = np.array([carried if c == 0 else last for c in convs]).ravel()
        con.register("lines", lines)
        con.register("beyond", pa.table({"conv": np.repeat(convs, 4), "state": np.tile(np.arange(4), len(convs)), "cost": costs}))
        got = con.sql(CHOOSE).to_arrow_table()
        carried = got["costs"][-1].as_py()
        yield pa.RecordBatch.from_arrays([*batch.columns, got["chosen"].combine_chunks().cast(pa.int64())], [*batch.schema.names, "_chosen"])


_EDIT = pa.array(INITIALS)
_BEFORE, _ROLES = [], []
for _state, _initials in itertools.product(range(4), INITIALS):
    _at, _names = _state, []
    for _ in range(_initials.count("I")):
        _at = GIVES[_at]
        _names.append(ROLE[_at])
    _BEFORE.append(_names)
    _ROLES.append(ROLE[GIVES[_at]] if _initials.endswith("R") else None)
_BEFORE, _ROLES = pa.array(_BEFORE, pa.list_(pa.string())), pa.array(_ROLES, pa.string())
_AFTER = pa.array([ENDS[s] for s in range(4)] + [[]], pa.list_(pa.string()))


def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with _chosen by conversation, first row first, with the edit of each row, the rows inserted before and after it, and its new role, if any."""
    con, state = _connect(), START
    for batch in batches:
        if not batch.num_rows:
            continue
        lines = _lines(batch, np.asarray(batch["_pos"]) == 1).append_column("chosen", batch["_chosen"])
        convs = np.unique(lines["conv"].to_numpy())
        con.register("lines", lines)
        con.register("reached", pa.table({"conv": convs, "state": np.where(convs == 0, state, START)}))
        got = con.sql(TRACE).to_arrow_table()
        at, move, reached = (got[c].to_numpy() for c in ("state", "move", "next"))
        state = int(reached[-1])
        which = pa.array(at * len(INITIALS) + move)
        after = _AFTER.take(pa.array(np.where(np.asarray(batch["_last"]), reached, 4)))
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in batch.schema.names if c not in ("_chosen", "_kind")), _EDIT.take(pa.array(move)), _BEFORE.take(which), after, _ROLES.take(which)], [*(c for c in batch.schema.names if c not in ("_chosen", "_kind")), "_edit", "_before", "_after", "_role"])


def edited(rows: DataFrame) -> DataFrame:
    """Every row of `judged` with its edit, in order of _pos within its conversation; a conversation is in one partition."""
    bound_batches(rows.sparkSession)
    kinds = judged(rows)
    backward = kinds.sortWithinPartitions("conv_id", F.desc("_pos"))
    chosen = backward.mapInArrow(choose, T.StructType([*kinds.schema.fields, T.StructField("_chosen", T.LongType())]))
    forward = chosen.repartition("conv_id").sortWithinPartitions("conv_id", "_pos")
    kept = [f for f in kinds.schema.fields if f.name != "_kind"]
    names = T.ArrayType(T.StringType())
    return forward.mapInArrow(trace, T.StructType([*kept, T.StructField("_edit", T.StringType()), T.StructField("_before", names), T.StructField("_after", names), T.StructField("_role", T.StringType())]))


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, position (from 0), role and text of the repaired conversations, and origin_turn (null in inserted rows)."""
    empty = lambda c: F.transform(c, lambda r: F.struct(r.alias("role"), F.lit("").alias("text"), F.lit(None).cast(rows.schema["turn"].dataType).alias("origin_turn")))
    own = F.struct(F.coalesce("_role", "role").alias("role"), F.col("text"), F.col("turn").alias("origin_turn"))
    mine = F.when(F.col("_edit").rlike("[KR]$"), F.array(own)).otherwise(F.slice(F.array(own), 1, 0))
    out = edited(rows).select("conv_id", "_pos", F.posexplode(F.concat(empty(F.col("_before")), mine, empty(F.col("_after")))).alias("_at", "_row"))
    order = Window.partitionBy("conv_id").orderBy("_pos", "_at")
    return out.select("conv_id", (F.row_number().over(order) - 1).alias("position"), "_row.role", "_row.text", "_row.origin_turn")


_COST = {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}
_COUNTS = ("blank", "duplicate", "truncated")


class _Report:
    """One conversation as its rows go by; the digest is fed line by line."""

    def __init__(self, conv):
        self.conv, self.faults, self.illegal, self.turns, self.low, self.high = conv, dict.fromkeys(_COUNTS, 0), 0, 0, None, None
        self.cost, self.audit, self.digest, self.lines = 0, [], hashlib.sha256(), 0

    def line(self, role: str, text: str) -> None:
        self.digest.update((("\n" if self.lines else "") + f"{role}:{text}").encode())
        self.lines += 1

    def add(self, turn, role, text, fault, illegal, fresh, edit, before, after, new_role) -> None:
        if fault:
            self.faults[fault] += 1
        self.illegal += illegal
        if fresh:
            self.turns, self.low, self.high = self.turns + 1, turn if self.low is None else self.low, turn
        self.cost += sum(map(_COST.__getitem__, edit)) + INSERT * len(after) + TRUNCATED * (fault == "truncated" and not edit.endswith("D"))
        self.audit.append(edit + "I" * len(after))
        for inserted in before:
            self.line(inserted, "")
        if edit and not edit.endswith("D"):
            self.line(new_role or role, text)
        for inserted in after:
            self.line(inserted, "")

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest())


_OUT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums up `edited` rows, conversation by conversation."""
    now, kind = None, None

    def batch(rows: list[_Report]) -> pa.RecordBatch:
        columns = zip(*(r.row() for r in rows), strict=True) if rows else [[]] * len(_OUT)
        kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], _OUT)

    for rows in batches:
        kind, done = rows.schema.field("conv_id").type, []
        columns = (rows[c].to_pylist() for c in ("turn", "role", "text", "_fault", "_illegal", "_fresh", "_edit", "_before", "_after", "_role"))
        for conv, pos, *row in zip(rows["conv_id"].to_pylist(), rows["_pos"].to_pylist(), *columns, strict=True):
            if pos == 1:
                done += [now] if now is not None else []
                now = _Report(conv)
            now.add(*row)
        yield batch(done)
    if now is not None:
        yield batch([now])


def report(rows: DataFrame) -> DataFrame:
    """One row for each conversation of `edited`: its faults, the cheapest edits and the digest of what they give."""
    counts = [T.StructField(c, T.LongType()) for c in _OUT[1:7]]
    schema = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), *counts, T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    return edited(rows).mapInArrow(_reports, schema)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(damaged(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


#: The same edits forward: whole audits and repaired texts are kept for each state.
OP13_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(b))
), digits AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))),
           lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1]))) % 20 AS digit
  FROM conversations, crc
), hurt AS (
  SELECT conv_id, turn, CASE WHEN digit = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN digit = 1 THEN '' WHEN digit = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM digits WHERE digit <> 0
  UNION ALL SELECT conv_id, turn, role, text FROM digits WHERE digit = 3
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM hurt
), seen AS (
  SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS was,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) AS copy,
         right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) AS ending
  FROM placed
), faulty AS (
  SELECT *, CASE WHEN ending = '' THEN 'blank' WHEN copy > 1 THEN 'duplicate' WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM seen
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (was || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM faulty GROUP BY conv_id
), states(state, given) AS (VALUES (0, 2), (1, 2), (2, 3), (3, 2)
), hops AS (
  SELECT state, state AS at, '' AS letters, '' AS lines, 0 AS cost FROM states
  UNION ALL SELECT state, given, 'I', chr(10) || CASE given WHEN 2 THEN 'user:' ELSE 'assistant:' END, 2 FROM states
  UNION ALL SELECT state, 5 - given, 'II', CASE given WHEN 2 THEN chr(10) || 'user:' || chr(10) || 'assistant:' ELSE chr(10) || 'assistant:' || chr(10) || 'user:' END, 4 FROM states
), acts AS (
  SELECT h.state, h.letters || a.letter AS letters, h.lines, h.cost + a.cost AS cost, a.letter, a.initial,
         CASE a.letter WHEN 'D' THEN h.at WHEN 'R' THEN s.given ELSE a.goes END AS goes
  FROM hops h JOIN states s ON s.state = h.at
  JOIN (VALUES ('D', 3, NULL, NULL, NULL), ('R', 2, NULL, NULL, NULL), ('K', 0, 's', 0, 1), ('K', 0, 'u', 0, 2), ('K', 0, 'u', 1, 2), ('K', 0, 'u', 3, 2), ('K', 0, 'a', 2, 3)) a(letter, cost, initial, comes, goes)
    ON a.comes IS NULL OR a.comes = h.at
), steps AS (
  SELECT f.conv_id, f.k, f.role, f.text, a.state, a.goes, a.letters, a.letter, a.lines, a.cost + CASE WHEN a.letter <> 'D' AND f.fault = 'truncated' THEN 1 ELSE 0 END AS cost
  FROM faulty f JOIN acts a ON (a.initial IS NULL OR a.initial = f.initial) AND (a.letter = 'D' OR f.fault NOT IN ('blank', 'duplicate'))
), walk AS (
  SELECT conv_id, n, CAST(0 AS BIGINT) AS k, 0 AS state, CAST({'cost': 0, 'audit': '', 'lines': ''} AS STRUCT(cost INTEGER, audit VARCHAR, "lines" VARCHAR)) AS best FROM counts
  UNION ALL
  SELECT w.conv_id, w.n, s.k, s.goes, min(CAST({'cost': w.best.cost + s.cost, 'audit': w.best.audit || s.letters,
         'lines': w.best.lines || s.lines || CASE s.letter WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || s.role || ':' || s.text ELSE chr(10) || CASE s.goes WHEN 2 THEN 'user:' ELSE 'assistant:' END || s.text END} AS STRUCT(cost INTEGER, audit VARCHAR, "lines" VARCHAR)))
  FROM walk w JOIN steps s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.k = w.k + 1 AND s.state = w.state
  GROUP BY w.conv_id, w.n, s.k, s.goes
), ended AS (
  SELECT w.conv_id, min(CAST({'cost': w.best.cost + h.cost, 'audit': w.best.audit || h.letters, 'lines': w.best.lines || h.lines} AS STRUCT(cost INTEGER, audit VARCHAR, "lines" VARCHAR))) AS best
  FROM walk w JOIN hops h ON h.state = w.state WHERE w.k = w.n AND h.at IN (0, 3) GROUP BY w.conv_id
)
SELECT o.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal,
       CAST(coalesce(e.best.cost, 0) AS BIGINT) AS cost, coalesce(e.best.audit, '') AS audit, sha256(coalesce(substr(e.best.lines, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""
