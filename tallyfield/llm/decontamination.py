"""Benchmark decontamination by pigeonhole edit matching.

Method: a test item of L bytes may differ from a passage by k = L // BYTES_PER_ERROR
edits.  It is cut into k + 1 pieces; k edits leave at least one piece untouched, so every
match holds an exact piece hit at most k bytes from its place.  Piece hits come from one
rolling hash over each whole text (a bit table of the pieces' first ANCHOR bytes, then the
hash of the whole piece), and each window around hits is verified with Myers' bit-parallel
edit distance, which finds the best end of the item in the window.

Texts and items are compared in lower case (A-Z) with runs of white space as one blank;
distances count UTF-8 bytes.  Items are read in blocks of at most BLOCK_BYTES, one pass
over the texts each, so what is sent to the executors has a bound; usually there is one.

Cases: null or blank texts hold nothing; null or blank items match nothing; an item under
BYTES_PER_ERROR bytes matches exactly only; items equal after folding each match; repeated
rows match each; very long texts are searched whole; extra columns are ignored by `find`
and kept by `drop_contaminated`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfield.llm._spark import bound_batches, fresh, table, text_of
from tallyfield.llm._text import _BASE_INVERSE, _IS_SEPARATOR, _power, lower_table, mix, pieces, running, span_hashes

BYTES_PER_ERROR = 20
#: Bytes of a piece that are looked up at every position (pieces of items over BYTES_PER_ERROR have at least so many).
ANCHOR = 10
TABLE_BITS = 22
#: Candidates (a place and a piece) that are looked at together; pieces may be common to many items.
CANDIDATES = 1 << 20
BLOCK_BYTES = 8_000_000


def fold(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower case, runs of separators as one blank, none at a row's start; new offsets."""
    blank = _IS_SEPARATOR[data]
    before = np.ones(len(data), bool)
    before[1:] = blank[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    before[inner] = True
    keep = ~(blank & before)
    out = lower_table()[data[keep]]
    out[blank[keep]] = 32
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=total[1:])
    return out, total[offsets]


def folded(text: str) -> bytes:
    data = np.frombuffer(text.encode(), np.uint8)
    return fold(data, np.array([0, len(data)]))[0].tobytes().rstrip(b" ")


def myers(pattern: bytes, text: bytes) -> tuple[int, int]:
    """(least edit distance of pattern to a part of text, end of the first best part)."""
    m = len(pattern)
    mask: dict[int, int] = {}
    for i, c in enumerate(pattern):
        mask[c] = mask.get(c, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << m - 1
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = mask.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | ~(xh | plus) & full
        mh = plus & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        plus = mh | ~(xv | ph) & full
        minus = ph & xv
        if score < best:
            best, end = score, j
    return best, end


class Items:
    """Test items with their pieces, ready for the search."""

    def __init__(self, items: list[tuple[object, str]], bytes_per_error: int = BYTES_PER_ERROR):
        self.ids, self.items, self.budget = [], [], []
        piece_of, offset, length, anchor, whole = [], [], [], [], []
        self.short: list[int] = []
        for number, text in items:
            body = folded(text or "")
            if not body:
                continue
            k = len(body) // bytes_per_error
            i = len(self.items)
            self.ids.append(number)
            self.items.append(body)
            self.budget.append(k)
            data = np.frombuffer(body, np.uint8)
            cuts = np.linspace(0, len(body), k + 2).astype(np.int64)
            if np.diff(cuts).min() < ANCHOR:
                self.short.append(i)
                continue
            piece_of += [i] * (k + 1)
            offset += cuts[:-1].tolist()
            length += np.diff(cuts).tolist()
            anchor.append(span_hashes(data, cuts[:-1], cuts[:-1] + ANCHOR))
            whole.append(span_hashes(data, cuts[:-1], cuts[1:]))
        self.anchor = np.concatenate(anchor) if anchor else np.zeros(0, np.uint64)
        order = np.argsort(self.anchor, kind="stable")
        self.anchor = self.anchor[order]
        self.piece_of, self.offset, self.length = (np.array(x, np.int64)[order] for x in (piece_of, offset, length))
        self.whole = (np.concatenate(whole) if whole else np.zeros(0, np.uint64))[order]
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[(self.anchor >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True

    def search(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item, distance, start, end) of the best match of each item in each row of folded texts."""
        out = []
        n = len(data)
        windows: dict[tuple[int, int], list[int]] = {}
        if n >= ANCHOR and len(self.anchor):
            total = running(data)
            head = mix((total[ANCHOR:] - total[:-ANCHOR]) * _power(_BASE_INVERSE, n + 1 - ANCHOR) + np.uint64(ANCHOR))
            at = np.flatnonzero(self.table[(head >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
            low, high = np.searchsorted(self.anchor, head[at], "left"), np.searchsorted(self.anchor, head[at], "right")
            count = high - low
            places, lows, counts = at[count > 0], low[count > 0], count[count > 0]
            upto = np.cumsum(counts)
            first = 0
            while first < len(places):
                last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + CANDIDATES, "right")))
                low, count = lows[first:last], counts[first:last]
                piece = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
                at = np.repeat(places[first:last], count)
                first = last
                row = np.searchsorted(offsets, at, "right") - 1
                fits = at + self.length[piece] <= offsets[row + 1]
                at, piece, row = at[fits], piece[fits], row[fits]
                same = span_hashes(data, at, at + self.length[piece], total) == self.whole[piece]
                for p, j, r in zip(at[same].tolist(), piece[same].tolist(), row[same].tolist(), strict=True):
                    windows.setdefault((r, int(self.piece_of[j])), []).append(p - int(self.offset[j]))
        for (r, i), begins in windows.items():
            item, k = self.items[i], self.budget[i]
            low, high = int(offsets[r]), int(offsets[r + 1])
            best = None
            spans: list[list[int]] = []
            for b in sorted(set(begins)):
                a, z = max(low, b - k), min(high, b + len(item) + k)
                if spans and a <= spans[-1][1] and z - spans[-1][0] <= 4 * (len(item) + 2 * k):
                    spans[-1][1] = max(z, spans[-1][1])
                else:
                    spans.append([a, z])
            for a, z in spans:
                body = data[a:z].tobytes()
                p = body.find(item)
                found = (0, p + len(item)) if p >= 0 else myers(item, body)
                if best is None or found[0] < best[0]:
                    best = (found[0], a + found[1])
            if best is not None and best[0] <= k:
                end = best[1] - low
                out.append((r, i, best[0], max(0, end - len(item)), end))
        if self.short:
            body = data.tobytes()
            for i in self.short:
                item, k, last = self.items[i], self.budget[i], -1
                if k:  # pieces under the anchor's length: each row is verified whole
                    for r in range(len(offsets) - 1):
                        d, end = myers(item, body[offsets[r] : offsets[r + 1]])
                        if d <= k:
                            out.append((r, i, d, max(0, end - len(item)), end))
                    continue
                p = body.find(item)
                while p >= 0:
                    r = int(np.searchsorted(offsets, p, "right")) - 1
                    if p + len(item) <= offsets[r + 1] and r != last:
                        last = r
                        out.append((r, i, 0, p - int(offsets[r]), p + len(item) - int(offsets[r])))
                    p = body.find(item, p + 1)
        return out


def item_blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of a bounded size; an item alone may be larger."""
    rows = benchmark.select(F.col(f"`{item}`").alias("i"), text_of(f"`{text}`").alias("t"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    number = F.pmod(F.xxhash64("i", "t"), F.lit(blocks))
    for k in range(blocks):
        some = [(r["i"], r["t"]) for r in (rows if blocks == 1 else rows.filter(number == k)).collect()]
        if some:
            yield some


def find(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", bytes_per_error: int = BYTES_PER_ERROR) -> DataFrame:
    """A row for each document and item it holds: doc_id, item_id, distance, start, end (bytes of the folded text)."""
    spark = docs.sparkSession
    bound_batches(spark)
    body = docs.select(F.col(f"`{key}`").alias("doc_id"), text_of(f"`{text}`").alias("_text"))
    schema = T.StructType([body.schema["doc_id"], T.StructField("item_id", benchmark.schema[item].dataType), T.StructField("distance", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    found = spark.createDataFrame([], schema)
    for block in item_blocks(benchmark, item, item_text):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = Items(sent.value, bytes_per_error)
            for batch in batches:
                for a, _, data, offsets in pieces(batch.column(1)):
                    hits = items.search(*fold(data, offsets))
                    if hits:
                        r, i, d, s, e = zip(*hits, strict=True)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([a + x for x in r])), pa.array([items.ids[x] for x in i], batch_type), pa.array(d, pa.int32()), pa.array(s, pa.int64()), pa.array(e, pa.int64())], schema.names)

        batch_type = _arrow(benchmark.schema[item].dataType)
        found = found.union(body.mapInArrow(run, schema))
    return found


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", bytes_per_error: int = BYTES_PER_ERROR) -> DataFrame:
    """docs without the rows that hold a test item; all columns stay."""
    spark = docs.sparkSession
    bound_batches(spark)
    columns, flag = docs.columns, fresh(docs, "_text")
    for block in item_blocks(benchmark, item, item_text):
        sent = spark.sparkContext.broadcast(block)
        source = docs.select(*[F.col(f"`{c}`") for c in columns], text_of(f"`{text}`").alias(flag))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = Items(sent.value, bytes_per_error)
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for a, _, data, offsets in pieces(batch.column(len(columns))):
                    for hit in items.search(*fold(data, offsets)):
                        clean[a + hit[0]] = False
                keep = pa.array(clean)
                yield pa.RecordBatch.from_arrays([c.filter(keep) for c in batch.columns[: len(columns)]], columns)

        docs = source.mapInArrow(run, docs.schema)
    return docs


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
