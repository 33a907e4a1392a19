"""Repeated passages against every 50-byte window in a dictionary."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from tallyfield.llm import suffix_dedup as sd
from tallyfield.llm._spark import table

SCHEMA = "doc_id long, text string"


def brute(rows):
    least, out = {}, []
    big = (1 << 63) - 1
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - sd.LEAST + 1):
            w = b[p : p + sd.LEAST]
            least[w] = min(least.get(w, big), big if i is None else i)
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - sd.LEAST + 1):
            if least[b[p : p + sd.LEAST]] < (big if i is None else i):
                gone[p : p + sd.LEAST] = b"\1" * sd.LEAST
        spans = [p for p in range(len(b)) if gone[p] and (not p or not gone[p - 1])]
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), len(spans), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    out = []
    for r in df.collect():
        assert all(s["start"] < s["end"] <= r["n_bytes"] for s in r["spans"])
        out.append((r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()))
    return sorted(out, key=repr)


def made(n, seed):
    """Texts with shared passages, edits, copies, periods, and passages that end or begin a text."""
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice("abcdefé ") for _ in range(pick.randrange(3, 9)))
    text = lambda k: " ".join(word() for _ in range(k))
    passages = [text(k) for k in (8, 12, 30, 100)] + ["ab" * 90, "x" * 300, text(9)[:52]]
    rows = []
    for i in range(n):
        parts = [text(pick.randrange(0, 20)) if pick.random() < 0.5 else pick.choice(passages) for _ in range(pick.randrange(0, 5))]
        body = pick.choice(["", " "]).join(parts)
        if body and pick.random() < 0.3:
            at = pick.randrange(len(body))
            body = body[:at] + "Q" + body[at + 1 :]
        rows.append((pick.randrange(0, 3 * n), body))
    copies = [(pick.randrange(0, 3 * n), pick.choice(rows)[1]) for _ in range(n // 5)]
    return rows + copies + [(1, None), (2, ""), (None, passages[2]), (None, passages[2]), (5, "short"), (5, passages[3] * 2), (5, passages[3] * 2), (0, "word " * 3000)]


@pytest.mark.parametrize(("hot", "shard_bytes"), [(sd.HOT, sd.SHARD_BYTES), (1, 20_000), (4, 5_000)])
def test_against_all_windows(spark, hot, shard_bytes):
    rows = made(150, 5)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(sd.dedup_passages(df, hot=hot, shard_bytes=shard_bytes)) == brute(rows)


def test_given_table(spark, data):
    rows = [tuple(r) for r in table(spark, data, "documents").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in sd.op11_suffix_dedup(spark, data).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)
    assert got == brute(rows)


def test_blocks_and_long_runs(spark, monkeypatch):
    """A text longer than a block, in which one string repeats throughout, gives the runs of shorter blocks."""
    data = np.frombuffer(("abcdefghij" * 3000 + "tail of the text").encode(), np.uint8)
    offsets = np.array([0, 17_000, len(data)])

    def windows():
        start, n, key, _, row = sd.runs(data, offsets)
        return {(s + k, int(a), r) for s, m, a, r in zip(start.tolist(), n.tolist(), key, row.tolist()) for k in range(m)}

    whole = windows()
    assert len(whole) == len(data) - 2 * (sd.LEAST - 1) and sd.runs(data, offsets)[1].max() <= sd.RUN
    monkeypatch.setattr(sd, "BLOCK", 700)
    assert windows() == whole


def test_suffix_order_and_collisions():
    pick = np.random.default_rng(1)
    data = np.concatenate([pick.integers(97, 100, 400).astype(np.uint8), np.frombuffer(b"abcab" * 60, np.uint8), np.zeros(60, np.uint8)])
    start = np.arange(len(data) - sd.LEAST)
    group = (start % 3).astype(np.int64)
    text = data.tobytes()
    want = sorted(start.tolist(), key=lambda s: (s % 3, text[s : s + sd.LEAST]))
    suffixes = sd.Suffixes(data)
    for order, begins in (suffixes.sorted(start, group), suffixes.by_bytes(start, group)):
        key = lambda s: (s % 3, text[s : s + sd.LEAST])
        assert [key(s) for s in start[order]] == [key(s) for s in want]
        assert [bool(b) for b in begins] == [k == 0 or key(start[order[k]]) != key(start[order[k - 1]]) for k in range(len(order))]
        assert suffixes.true(start, order, begins, group)
    broken = begins.copy()
    broken[1:] = True
    assert not suffixes.true(start, order, broken, group)  # a wrong class is seen, and the bytes are sorted instead


def test_hash_collisions_do_not_join_runs():
    data = np.frombuffer(b"a" * 60 + b"b" * 60, np.uint8)
    start, n, same = np.array([0, 60]), np.array([5, 5]), np.array([9, 9], np.uint64)
    order, which, behind = sd._fallen_together(data, start, n, same, same, np.array([1, 2]))
    assert which[0] != which[1] and not behind.any()


def test_empty_table_and_clashing_columns(spark):
    assert sd.dedup_passages(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([(1, "p" * 60, 1, "x"), (2, "p" * 60, 2, "y")], SCHEMA + ", chunk int, kept string")
    assert [(r["doc_id"], len(r["kept"])) for r in sd.dedup_passages(df).orderBy("doc_id").collect()] == [(1, 60), (2, 0)]
