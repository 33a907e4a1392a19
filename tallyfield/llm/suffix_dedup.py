"""Suffix-array dedup: bytes of passages that a document with a smaller id holds too are taken out.

A byte goes if it lies in a run of LEAST bytes that also starts in a document of smaller id; runs are
judged on the input and never cross documents.

Method.  1. Windows of LEAST bytes are grouped by their anchor, the least hash among the GRAM-byte
strings in them: equal windows have equal anchors, and a run of neighbouring windows shares one.  Texts
are written in chunks, each chunk's distinct anchors go to shards, and the shards say which anchors more
than one document has.  2. Runs of such anchors go to shards as they are, bytes and all.  Equal runs
fall together under the least id at the chunk already, so copies and common passages arrive once a chunk.
3. In a shard the suffixes that start in runs with one anchor but different bytes are sorted: prefix
polynomial hashes and binary search give the common extension of two suffixes in log LEAST steps, a
merge sort of all segments side by side puts them in order, and neighbours that share LEAST bytes are one
class, whose least id decides.  Every hit is compared byte by byte, and so is the order; where hashes
collided the bytes are sorted instead.  4. Spans go back to their chunk.

Scale: a text is read in its chunk only and never shuffled; what a shard reads is in proportion
to its share of the corpus.  An anchor that more than HOT documents have (the edge of a passage that a
third of them share) is not gathered in one shard: its windows are dealt by a hash of all their bytes.

Cases: null and empty texts have no bytes, and fewer than LEAST bytes lose none; of equal texts
the one with the least id stays; rows with one id do not count against each other; a null id counts
as larger than all others; ids are whole numbers; texts of any length are whole; other columns are not read;
an empty table gives none.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.llm._memory import trim
from tallyfield.llm._pack import edges, pack, pack_plain, unpack, unpack_plain
from tallyfield.llm._spark import bound_batches, new_table, partitions, table, text_of, written
from tallyfield.llm._text import _BASE_INVERSE, _power, mix, pieces, running, span_hashes

#: Bytes of a run that counts as repeated.
LEAST = 50
#: Bytes of the strings whose least hash is a window's anchor, and their number in a window.
GRAM = 25
GRAMS = LEAST - GRAM + 1
#: Anchors are hashes of so many bits: a false match only sends a run in vain.
KEY_BITS = 48
#: Bytes of text in a chunk, and of the corpus for each shard.
CHUNK_BYTES = 8 << 20
SHARD_BYTES = 16 << 20
#: Windows of one run at most (texts that repeat themselves have longer ones) and window starts worked on at once.
RUN = 64
BLOCK = 1 << 18
#: Suffixes that a shard sorts at once: whole anchors, one at least.
WORK = 1 << 17
#: Documents with one anchor beyond which its windows are dealt one by one.
HOT = 50_000

_NO_ID = (1 << 63) - 1
_SALT = np.uint64(0xA24BAED4963EE407)
_ZSTD = pa.Codec("zstd")


# --- windows and anchors --------------------------------------------------------------


def _sliding_least(x: np.ndarray, n: int) -> np.ndarray:
    """Least of each n neighbours."""
    span = 1
    while span * 2 <= n:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (n - span)], x[n - span :]) if n > span else x


def _block_runs(data: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, anchor, hash of the bytes) of the runs of windows in a block; whole[i]: window i lies in one document."""
    total = running(data)
    gram = np.arange(len(data) - GRAM + 1)
    least = _sliding_least(span_hashes(data, gram, gram + GRAM, total), GRAMS)[: len(whole)]
    fresh = np.ones(len(whole) + 1, bool)
    fresh[1:-1] = (least[1:] != least[:-1]) | (whole[1:] != whole[:-1])
    bounds = np.flatnonzero(fresh)
    start, n = bounds[:-1], np.diff(bounds)
    start, n = start[whole[start]], n[whole[start]]
    if len(n) and n.max() > RUN:
        parts = -(-n // RUN)
        turn = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start, n = np.repeat(start, parts) + RUN * turn, np.minimum(RUN, np.repeat(n, parts) - RUN * turn)
    key = mix(least[start] ^ _SALT) >> np.uint64(64 - KEY_BITS)  # least hashes are small: mixed anew they fill all shards alike
    return start, n, key, span_hashes(data, start, start + n + (LEAST - 1), total)


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, anchor, hash, row) of the runs of windows of all rows, in order; worked out in blocks, so that a long text takes no more room than short ones."""
    out = [[np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.uint64)] * 2]
    for low in range(0, len(data) - LEAST + 1, BLOCK):
        high = min(low + BLOCK, len(data) - LEAST + 1)
        at = offsets[np.searchsorted(offsets, low, "left") : np.searchsorted(offsets, high + LEAST, "left")] - low
        crossed = np.zeros(high - low + 1, np.int32)  # windows that start within LEAST - 1 bytes of a row's end
        np.add.at(crossed, np.clip(at - (LEAST - 1), 0, high - low), 1)
        np.add.at(crossed, np.clip(at, 0, high - low), -1)
        start, n, key, own = _block_runs(data[low : high + LEAST - 1], np.cumsum(crossed[:-1]) == 0)
        out.append([start + low, n, key, own])
    start, n, key, own = (np.concatenate(x) for x in zip(*out, strict=True))
    return start, n, key, own, np.searchsorted(offsets, start, "right") - 1


def _chunk_runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The runs of a chunk, its bytes and its offsets."""
    out, all_data, ends, base = [], [], [0], 0
    for first, _, data, offsets in pieces(texts):
        start, n, key, own, row = runs(data, offsets)
        out.append((start + base, n, key, own, row + first))
        all_data.append(data)
        ends += list(offsets[1:] + base)
        base += len(data)
    if not out:
        return (*(np.zeros(0, np.int64),) * 2, *(np.zeros(0, np.uint64),) * 2, np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(1, np.int64))
    return *(np.concatenate(x) for x in zip(*out, strict=True)), np.concatenate(all_data), np.array(ends, np.int64)


def _dealt(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(shards, where each one's keys begin and the last ends) of sorted keys: a shard holds a range of them."""
    shard = (keys.astype(np.float64) * (shards / 2.0**KEY_BITS)).astype(np.int64).clip(0, shards - 1)
    at = edges(shard)
    return shard[at], np.append(at, len(keys))


# --- chunks ---------------------------------------------------------------------------


def _chunker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

    def chunk() -> pa.RecordBatch:
        batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        ids = batch.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
        _, _, key, _, row, data, _ = _chunk_runs(batch.column(1))
        order = np.argsort(key, kind="stable")
        key, by = key[order], ids[row[order]]
        first = edges(key)
        changed = np.ones(len(key), np.int64)
        changed[1:] = (key[1:] != key[:-1]) | (by[1:] != by[:-1])
        documents = np.add.reduceat(changed, first) if len(first) else changed
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as out:
            out.write_batch(batch)
        trim()
        return pa.RecordBatch.from_pydict({"chunk": [part << 32 | number], "data": pa.array([sink.getvalue().to_pybytes()], pa.binary()), "bytes": [len(data)], "keys": pa.array([pack(key[first])], pa.binary()), "documents": pa.array([pack_plain(np.minimum(documents, 255).astype(np.uint8))], pa.binary())})

    for batch in batches:
        for low in range(0, batch.num_rows, 64):
            some = batch.slice(low, 64)
            held.append(some)
            size += some.nbytes
            if size >= CHUNK_BYTES:
                yield chunk()
                held, size, number = [], 0, number + 1
    if any(b.num_rows for b in held):
        yield chunk()


def chunks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(chunk, data, bytes, keys, documents), a table in the shared folder bucketed by chunk; keys: the chunk's anchors, documents: in how many of its documents each stands."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), text_of(f"`{text}`").alias("text")).mapInArrow(_chunker, "chunk long, data binary, bytes long, keys binary, documents binary")
    name, path = f"suffix_chunks_{uuid.uuid4().hex}", new_table(spark)
    rows.write.format("parquet").option("compression", "none").option("path", path).bucketBy(partitions(docs), "chunk").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay: the table has a path of its own
    return out


# --- anchors that several documents have ----------------------------------------------


def _anchor_dealer(shards: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, keys, documents in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                key = unpack(keys)
                count = unpack_plain(documents, len(key), np.uint8)
                shard, at = _dealt(key, shards)
                spans = list(zip(at[:-1], at[1:], strict=True))
                yield pa.RecordBatch.from_pydict({"shard": pa.array(shard, pa.int64()), "chunk": pa.array([chunk] * len(shard), pa.int64()), "keys": pa.array([pack(key[a:b]) for a, b in spans], pa.binary()), "documents": pa.array([pack_plain(count[a:b]) for a, b in spans], pa.binary())})

    return run


def _spread(hot: int) -> Callable:
    def run(asked: pa.Table) -> pa.Table:
        """How far each anchor of each chunk is spread: 0 in one document, 1 in several, 2 in more than `hot`."""
        blocks = [unpack(x) for x in asked.column("keys").to_pylist()]
        counts = [unpack_plain(x, len(b), np.uint8) for x, b in zip(asked.column("documents").to_pylist(), blocks, strict=True)]
        _, place = np.unique(np.concatenate(blocks), return_inverse=True)
        total = np.bincount(place, np.concatenate(counts))
        reply = ((total > 1).astype(np.uint8) + (total > hot))[place]
        ends = np.cumsum([len(b) for b in blocks])
        return pa.table({"chunk": asked.column("chunk"), "shard": asked.column("shard"), "spread": pa.array([pack_plain(x) for x in np.split(reply, ends[:-1])], pa.binary()), "n": pa.array([len(b) for b in blocks], pa.int64())})

    return run


# --- runs that may be repeated --------------------------------------------------------


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[a : a + size] equals data[b : b + size], byte by byte."""
    out = np.zeros(len(a), bool)
    for n in np.unique(size):
        some = np.flatnonzero(size == n)
        for low in range(0, len(some), 1 << 14):
            at = some[low : low + (1 << 14)]
            step = np.arange(n)
            out[at] = (data[a[at, None] + step] == data[b[at, None] + step]).all(1)
    return out


def _fallen_together(data: np.ndarray, start: np.ndarray, n: np.ndarray, key: np.ndarray, own: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, class, behind): runs by anchor and bytes (least id first); behind: runs whose bytes an earlier run of their class has under a smaller id."""
    order = np.lexsort((ids, own, key))
    k, h, d, m = key[order], own[order], ids[order], n[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (k[1:] != k[:-1]) | (h[1:] != h[:-1]) | (m[1:] != m[:-1])
    first = np.flatnonzero(fresh)
    which = np.cumsum(fresh) - 1
    head = order[first][which] if len(first) else order
    later = np.flatnonzero(~fresh)
    if len(later):  # hashes that collide make a class of their own
        wrong = later[~_same_bytes(data, start[order[later]], start[head[later]], m[later] + LEAST - 1)]
        which[wrong] = which[-1] + 1 + np.arange(len(wrong))
        head[wrong] = order[wrong]
    return order, which, d > ids[head]


def _bytes_of(data: np.ndarray, start: np.ndarray, n: np.ndarray) -> bytes:
    """The bytes of runs, one after the other, compressed."""
    size = n + LEAST - 1
    at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return _ZSTD.compress(data[at].tobytes(), asbytes=True)


_SENT = ["shard", "chunk", "n", "keys", "ids", "starts", "counts", "text"]
_SENT_SCHEMA = "shard long, chunk long, n long, keys binary, ids binary, starts binary, counts binary, text binary"
_SENT_TYPES = [pa.int64()] * 3 + [pa.binary()] * 5


def _sender(shards: int) -> Callable:
    """For a chunk and how its anchors are spread: the runs to send to each shard, and (shard -1) those that are repeated within the chunk already."""

    def run(chunk: pa.Table, reply: pa.Table) -> pa.Table:
        rows = []
        for which, data_ in zip(chunk.column("chunk").to_pylist(), chunk.column("data"), strict=True):
            batch = pa.ipc.open_stream(data_.as_buffer()).read_all().combine_chunks().to_batches()[0]
            ids = batch.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            start, n, key, own, row, data, _ = _chunk_runs(batch.column(1))
            if not len(start):
                continue
            reply = reply.sort_by("shard")
            spread = np.concatenate([unpack_plain(x, m, np.uint8) for x, m in zip(reply.column("spread").to_pylist(), reply.column("n").to_pylist(), strict=True)])
            distinct, place = np.unique(key, return_inverse=True)
            assert len(distinct) == len(spread)
            spread = spread[place]
            own_id = ids[row]
            one, hot = spread == 1, spread == 2
            start_, n_, key_, hash_, id_ = start[one], n[one], key[one], own[one], own_id[one]
            if hot.any():  # window by window, by a hash of all its bytes
                times = n[hot]
                turn = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                at = np.repeat(start[hot], times) + turn
                h = span_hashes(data, at, at + LEAST)
                start_, n_, id_ = np.append(start_, at), np.append(n_, np.ones(len(at), np.int64)), np.append(id_, np.repeat(own_id[hot], times))
                key_, hash_ = np.append(key_, h >> np.uint64(64 - KEY_BITS)), np.append(hash_, h)
            order, _, behind = _fallen_together(data, start_, n_, key_, hash_, id_)
            here, sent = np.sort(order[behind]), order[~behind]
            rows.append((-1, which, len(here), b"", b"", pack_plain(start_[here]), pack_plain(n_[here].astype(np.uint8)), b""))
            shard, at = _dealt(key_[sent], shards)
            for s, a, b in zip(shard.tolist(), at[:-1], at[1:], strict=True):
                some = sent[a:b]
                rows.append((s, which, len(some), pack(key_[some]), pack_plain(id_[some]), pack_plain(start_[some]), pack_plain(n_[some].astype(np.uint8)), _bytes_of(data, start_[some], n_[some])))
            trim()
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, _SENT_TYPES, strict=True)], _SENT)

    return run


# --- suffixes -------------------------------------------------------------------------


class Suffixes:
    """Suffixes of a byte string, compared by their first `least` bytes: prefix polynomial hashes and binary search give the common extension."""

    def __init__(self, data: np.ndarray, least: int = LEAST):
        self.data, self.least = data, least
        self.total, self.back = running(data), _power(_BASE_INVERSE, len(data) + 1)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at a and b have in common, `least` at most."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.least, np.int64)
        back_a, back_b, from_a, from_b = self.back[a], self.back[b], self.total[a], self.total[b]
        for _ in range(self.least.bit_length()):
            middle = (low + high + 1) >> 1
            same = (self.total[a + middle] - from_a) * back_a == (self.total[b + middle] - from_b) * back_b
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as the suffix at a stands to that at b."""
        shared = self.common(a, b)
        inside = np.minimum(shared, self.least - 1)
        sign = np.sign(self.data[a + inside].astype(np.int16) - self.data[b + inside].astype(np.int16))
        return np.where(shared >= self.least, 0, sign)

    def sorted(self, start: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order, whether each suffix in order begins a new class): by group, then by bytes; a class shares `least` bytes.

        Suffixes that differ in their group or first eight bytes are told apart at once; the others are segments,
        and each round merges the sorted runs of all segments, twice as long every time."""
        prefix = np.zeros(len(start), np.uint64)
        for k in range(8):
            prefix = prefix << np.uint64(8) | self.data[start + k]
        order = np.lexsort((prefix, group))
        begins = np.ones(len(order), bool)
        begins[1:] = (group[order][1:] != group[order][:-1]) | (prefix[order][1:] != prefix[order][:-1])
        first = np.flatnonzero(begins)
        size = np.diff(first, append=len(order))
        width = 1
        while len(size) and width < size.max():
            big = size > width
            base, length = np.repeat(first[big], size[big]), np.repeat(size[big], size[big])
            r = np.arange(len(base)) - np.repeat(np.cumsum(size[big]) - size[big], size[big])
            mine = order[base + r]
            pair = r // (2 * width) * (2 * width)
            right = (r - pair) >= width
            low = np.minimum(np.where(right, pair, pair + width), length)
            high = np.minimum(low + width, length)
            other = low.copy()
            while True:  # how many of the other run go before each suffix
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                middle = (low[open_] + high[open_]) >> 1
                sign = self.compare(start[order[base[open_] + middle]], start[mine[open_]])
                before = (sign < 0) | ((sign == 0) & right[open_])
                low[open_] = np.where(before, middle + 1, low[open_])
                high[open_] = np.where(before, high[open_], middle)
            put = base + pair + (r - pair - width * right) + (low - other)
            order[put] = mine
            width *= 2
        inner = np.flatnonzero(~begins)
        begins[inner] = self.common(start[order[inner - 1]], start[order[inner]]) < self.least
        return order, begins

    def true(self, start: np.ndarray, order: np.ndarray, begins: np.ndarray, group: np.ndarray) -> bool:
        """Whether classes and order hold byte by byte."""
        step = np.arange(self.least)
        pairs = np.flatnonzero(group[order[1:]] == group[order[:-1]]) + 1
        for low in range(0, len(pairs), 1 << 14):
            at = pairs[low : low + (1 << 14)]
            a, b = self.data[start[order[at - 1], None] + step], self.data[start[order[at], None] + step]
            differ = a != b
            where = differ.argmax(1)
            row = np.arange(len(at))
            if not np.array_equal(differ.any(1), begins[at]) or (a[row, where] > b[row, where]).any():
                return False
        return True

    def by_bytes(self, start: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What `sorted` gives, without hashes."""
        rows = self.data[start[:, None] + np.arange(self.least)]
        order = np.lexsort((*rows.T[::-1], group))
        begins = np.ones(len(order), bool)
        begins[1:] = (group[order][1:] != group[order][:-1]) | (rows[order][1:] != rows[order][:-1]).any(1)
        return order, begins


def repeated_windows(data: np.ndarray, start: np.ndarray, n: np.ndarray, group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(run, window in it) of the windows that a run of the same group with a smaller id has too."""
    turn = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    run = np.repeat(np.arange(len(n)), n)
    at, of = start[run] + turn, group[run]
    suffixes = Suffixes(data)
    order, begins = suffixes.sorted(at, of)
    if not suffixes.true(at, order, begins, of):
        order, begins = suffixes.by_bytes(at, of)
    first = np.flatnonzero(begins)
    by = ids[run[order]]
    least = np.minimum.reduceat(by, first) if len(first) else by
    hit = np.sort(order[by > least[np.cumsum(begins) - 1]])
    return run[hit], turn[hit]


def _in_parts(data: np.ndarray, start: np.ndarray, n: np.ndarray, group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`repeated_windows` of runs in order of their groups, about WORK suffixes at once."""
    before = np.cumsum(n) - n
    first = edges(group)
    part = (before[first] // WORK)[np.cumsum(np.diff(group, prepend=group[0] - 1) != 0) - 1]
    bounds = np.append(edges(part), len(part))
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        size = n[a:b] + LEAST - 1
        at = np.cumsum(size) - size
        own = data[np.repeat(start[a:b] - at, size) + np.arange(size.sum())]
        run, turn = repeated_windows(own, at, n[a:b], group[a:b], ids[a:b])
        out.append((run + a, turn))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _judge(sent: pa.Table) -> pa.Table:
    """The windows of each chunk's runs that a smaller id has: (chunk, starts, counts)."""
    count = sent.column("n").to_pylist()
    key = np.concatenate([unpack(x) for x in sent.column("keys").to_pylist()])
    ids, start, n = (np.concatenate([unpack_plain(x, m, kind) for x, m in zip(sent.column(c).to_pylist(), count, strict=True)]) for c, kind in (("ids", np.int64), ("starts", np.int64), ("counts", np.uint8)))
    n = n.astype(np.int64)
    size = n + LEAST - 1
    ends = np.cumsum(size)
    at, texts, own = ends - size, [], []
    marks = np.append(0, np.cumsum(count))
    for blob, a, b in zip(sent.column("text"), marks[:-1], marks[1:], strict=True):  # hashed block by block: their sums take eight times the room
        texts.append(np.frombuffer(_ZSTD.decompress(blob.as_buffer(), int(size[a:b].sum())), np.uint8))
        own.append(span_hashes(texts[-1], at[a:b] - at[a], ends[a:b] - at[a]))
    data, own = np.concatenate(texts), np.concatenate(own)
    del texts
    order, which, behind = _fallen_together(data, at, n, key, own, ids)
    hits = [(order[behind], np.zeros(behind.sum(), np.int64), n[order[behind]])]
    ahead, of = order[~behind], which[~behind]
    one = ahead[edges(of)]  # a run for each different text of an anchor
    anchors = key[one]
    first = edges(anchors)
    several = np.repeat(np.diff(first, append=len(one)) > 1, np.diff(first, append=len(one)))
    chosen = one[several]
    if len(chosen):
        run, turn = _in_parts(data, at[chosen], n[chosen], np.searchsorted(anchors[first], key[chosen]), ids[chosen])
        # neighbouring windows of a run are one hit; other runs of the same text and id share it
        fresh = np.ones(len(run), bool)
        fresh[1:] = (run[1:] != run[:-1]) | (turn[1:] != turn[:-1] + 1)
        head = np.flatnonzero(fresh)
        found = np.zeros(len(n), np.int64)
        found[chosen] = np.bincount(run[head], minlength=len(chosen))
        begin = np.zeros(len(n), np.int64)
        begin[chosen] = np.cumsum(found[chosen]) - found[chosen]
        face = one[np.searchsorted(of[edges(of)], of)]  # the run that was judged for each
        times = found[face]
        turn_at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(begin[face], times)
        hits.append((np.repeat(ahead, times), turn[head][turn_at], np.diff(head, append=len(run))[turn_at]))
    who, shift, length = (np.concatenate(x) for x in zip(*hits, strict=True))
    chunk = np.repeat(np.array(sent.column("chunk").to_pylist(), np.int64), count)[who]
    back = np.lexsort((start[who] + shift, chunk))
    chunk, starts, length = chunk[back], (start[who] + shift)[back], length[back]
    first = edges(chunk)
    spans = list(zip(first, np.append(first[1:], len(chunk)), strict=True)) if len(chunk) else []
    trim()
    return pa.table({"chunk": pa.array(chunk[first], pa.int64()), "n": pa.array([int(b - a) for a, b in spans], pa.int64()), "starts": pa.array([pack_plain(starts[a:b]) for a, b in spans], pa.binary()), "counts": pa.array([pack_plain(length[a:b].astype(np.uint8)) for a, b in spans], pa.binary())})


# --- spans ----------------------------------------------------------------------------

_RESULT = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"


def _cutter(chunk: pa.Table, found: pa.Table) -> pa.Table:
    """Texts without the bytes of the windows found."""
    out = []
    for data_ in chunk.column("data"):
        batch = pa.ipc.open_stream(data_.as_buffer()).read_all().combine_chunks().to_batches()[0]
        body, ends = [], [0]
        for _, _, data, offsets in pieces(batch.column(1)):
            body.append(data)
            ends += list(offsets[1:] + ends[-1])
        data, ends = np.concatenate(body) if body else np.zeros(0, np.uint8), np.array(ends, np.int64)
        change = np.zeros(len(data) + 1, np.int32)
        for starts, counts, n in zip(found.column("starts").to_pylist(), found.column("counts").to_pylist(), found.column("n").to_pylist(), strict=True):
            at = unpack_plain(starts, n, np.int64)
            np.add.at(change, at, 1)
            np.add.at(change, at + unpack_plain(counts, n, np.uint8) + (LEAST - 1), -1)
        gone = np.cumsum(change[:-1]) > 0
        low, high = ends[:-1], ends[1:]
        edge = np.zeros(len(data) + 1, bool)
        edge[ends] = True
        begin = gone.copy()
        begin[1:] &= ~gone[:-1] | edge[1:-1]
        stop = gone.copy()
        stop[:-1] &= ~gone[1:] | edge[1:-1]
        begin, stop = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        row = np.searchsorted(ends, begin, "right") - 1
        spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(low) + 1)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(begin - low[row] if len(row) else begin), pa.array(stop - low[row] if len(row) else stop)], ["start", "end"]))
        left = np.append(0, np.cumsum(~gone))[ends]
        kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(low), [None, pa.py_buffer(left.astype(np.int64)), pa.py_buffer(data[~gone])])
        out.append(pa.table({"doc_id": batch.column(0), "n_bytes": pa.array(high - low), "spans": spans, "kept": kept.cast(pa.binary()) if left[-1] < 1 << 31 else kept}))
        trim()
    return pa.concat_tables(out)


def dedup_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", hot: int = HOT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_bytes, spans (start and end in bytes of the runs taken out) and kept (the other bytes; a character may be cut)."""
    table_ = chunks(docs, key, text)
    size = table_.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    shards = max(1, -(-size // shard_bytes))
    asked = table_.select("chunk", "keys", "documents").mapInArrow(_anchor_dealer(shards), "shard long, chunk long, keys binary, documents binary")
    spread = asked.groupBy("shard").applyInArrow(_spread(hot), "chunk long, shard long, spread binary, n long")
    whole = table_.select("chunk", "data")
    sent = written(whole.groupBy("chunk").cogroup(spread.groupBy("chunk")).applyInArrow(_sender(shards), _SENT_SCHEMA))
    here = sent.filter("shard = -1 AND n > 0").select("chunk", "n", "starts", "counts")
    there = sent.filter("shard >= 0").groupBy("shard").applyInArrow(_judge, "chunk long, n long, starts binary, counts binary")
    return whole.groupBy("chunk").cogroup(here.unionByName(there).groupBy("chunk")).applyInArrow(_cutter, _RESULT)


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_passages(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
