"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text.

Method.  Trusted text (documents labelled of good quality) is read as byte n-grams of
ORDER within its language: lower case A-Z, digits as 0, white space as one blank.  An
n-gram is exact: a language code and six bytes in 64 bits; six bytes reach over the ends
of words, so the model grows with the trusted text.

Sharded count joins are the one way from texts to perplexities, at every size:

1. Chunks: documents are written in chunks of about CHUNK_BYTES (a compressed Arrow batch
   each), with the chunk's distinct n-grams and how often each occurs in training text.
2. Every shard adds up the counts of its n-grams over all chunks.  A shard holds the
   n-grams of equal middle bytes, so an n-gram's context and its suffix are there too.
   n-grams that only other documents have take part with a count of 0.
3. Lower orders take continuation counts.  Discounts D1, D2, D3+ come from the counts of
   counts of each order.  An order's probabilities are joined with those of its suffixes in
   the next lower one; a context has at most 256 n-grams, so nothing grows hot.  A context
   that training text lacks passes the lower order's probability on.
4. Each chunk is sent the log probabilities of its own n-grams (in 1/SCALE of a nat, 32
   nats at most), joined with its texts (bucketed by chunk, so texts are not shuffled), and
   every document's bytes are added up.

A document's perplexity per byte is drawn to its language's mean by SMOOTHING bytes, so
short texts are not judged by a few bytes.  A document is rejected if that is above the
KEEP quantile of its language, times MARGIN.  Mean and quantile (exact, of perplexities in
steps of STEP, between steps in proportion) are those of held-out trusted documents: one of HELD_PARTS by the hash of
the text, so that equal texts fall together; the model never sees them.

Cases: a null language is a language of its own; a language without held-out trusted text
is judged by no threshold and kept; null, empty and blank texts hold no bytes to judge and
are kept (other operators drop them); very long texts are scored whole; repeated rows get
equal scores; without trusted labels everything is kept; a document labelled twice is
trusted if one label says so; an empty table gives no rows; extra columns of any name stay
in `keep_good`.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tallyfield.llm._pack import edges, pack, pack_plain, unpack, unpack_plain
from tallyfield.llm._memory import trim
from tallyfield.llm._spark import BATCH_BYTES, bound_batches, new_table, partitions, release, sized_broadcast, table, text_of, written
from tallyfield.llm._text import _IS_SEPARATOR, lower_table, mix, pieces

ORDER = 6
#: Quantile of held-out trusted perplexities, by language, and what it is multiplied by.
KEEP = 0.995
MARGIN = 1.05
STEP = 1e-3
SMOOTHING = 200
#: One of so many parts of the trusted documents is held out for the thresholds.
HELD_PARTS = 5
#: Bytes of text in a chunk (a longer text is a chunk of its own); n-grams of a shard on average.
CHUNK_BYTES = 12 << 20
SHARD_KEYS = 2_000_000
#: Compression of the chunks: their texts are most of what this writes.
LEVEL = 6
#: Parts of a nat in which log probabilities are sent.
SCALE = 2048

#: What a document is to the model.
OTHER, TRAIN, HELD = 0, 1, 2

_MAP = lower_table().copy()
_MAP[48:58] = 48
_BYTES = np.uint64((1 << 48) - 1)
_LANGUAGE = -(1 << 48)
_FREE = np.uint64(0xFFFFFFFFFFFFFFFF)  # no text has a byte 0xFF


def language_code(lang: Column) -> Column:
    """0 for no language, else 1 .. 65535."""
    return F.when(lang.isNull(), F.lit(0)).otherwise(F.pmod(F.crc32(lang.cast("binary")), F.lit(65535)) + 1).cast("long")


def symbols(data: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each row after order - 1 blanks, runs of white space as one blank; new offsets."""
    rows = len(offsets) - 1
    blank = _IS_SEPARATOR[data]
    before = np.ones(len(data), bool)
    before[1:] = blank[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    before[inner] = True
    keep = ~(blank & before)
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=total[1:])
    at = total[offsets]
    out = np.full(len(data[keep]) + rows * (order - 1), 32, np.uint8)
    row = np.repeat(np.arange(rows), np.diff(at))
    place = np.arange(len(row)) + (row + 1) * (order - 1)
    byte = _MAP[data[keep]]
    byte[blank[keep]] = 32
    out[place] = byte
    return out, at + np.arange(rows + 1) * (order - 1)


def grams(data: np.ndarray, offsets: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(language code and bytes of the n-gram that ends at each byte, row of each)."""
    byte, at = symbols(data, offsets)
    n = len(byte) - ORDER + 1
    key = np.zeros(max(n, 0), np.uint64)
    for k in range(ORDER if n > 0 else 0):
        key = (key << np.uint64(8)) | byte[k : k + n]
    rows = len(offsets) - 1
    sizes = np.diff(at) - (ORDER - 1)
    row = np.repeat(np.arange(rows), sizes)
    key = key[np.arange(sizes.sum()) + row * (ORDER - 1)] if n > 0 else key
    return key | codes.astype(np.uint64)[row] << np.uint64(48), row


def shard_of(middle: np.ndarray, language: np.ndarray, shards: int) -> np.ndarray:
    """Shard of the four bytes that an n-gram's context and its suffix share."""
    return (mix(middle & np.uint64(0xFFFFFFFF) | language << np.uint64(32)) % np.uint64(shards)).astype(np.int32)


def turned(key: np.ndarray) -> np.ndarray:
    """n-grams with their middle bytes before the first and the last one: in that order a shard's n-grams lie close together."""
    low = np.uint64(0xFF)
    return key >> np.uint64(48) << np.uint64(48) | (key >> np.uint64(8) & np.uint64(0xFFFFFFFF)) << np.uint64(16) | (key >> np.uint64(40) & low) << np.uint64(8) | key & low


def turned_back(key: np.ndarray) -> np.ndarray:
    low = np.uint64(0xFF)
    return key >> np.uint64(48) << np.uint64(48) | (key >> np.uint64(8) & low) << np.uint64(40) | (key >> np.uint64(16) & np.uint64(0xFFFFFFFF)) << np.uint64(8) | key & low


def _by_shard(key: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shards that have keys, order that deals keys to them, its bounds); within a shard n-grams stand as `turned` sorts them."""
    shard = shard_of(key >> np.uint64(8), key >> np.uint64(48), shards)
    turn = np.lexsort((turned(key), shard))
    start = edges(shard[turn])
    return shard[turn][start], turn, np.append(start, len(key))


def trusted_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with a column _role: OTHER, TRAIN or HELD."""
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_trusted_id")).distinct()
    joined = docs.join(sized_broadcast(good), F.col(f"`{key}`") == F.col("_trusted_id"), "left")
    held = F.pmod(F.xxhash64(text_of(f"`{text}`")), F.lit(HELD_PARTS)) == 0
    role = F.when(F.col("_trusted_id").isNull(), OTHER).when(held, HELD).otherwise(TRAIN)
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], role.alias("_role"))


# --- 1. chunks ------------------------------------------------------------------------


class Layout:
    """Columns of the Arrow batch of a chunk: those kept, then the text if it is none of them, the language code and the role."""

    def __init__(self, docs: DataFrame, keep: list[str], text: str, lang: str, role: str):
        self.keep = keep
        whole = isinstance(docs.schema[text].dataType, T.StringType)
        columns = [F.col(f"`{c}`") for c in keep]
        self.body = keep.index(text) if text in keep and whole else len(keep)
        if self.body == len(keep):
            columns.append(text_of(f"`{text}`").alias("_body"))
        columns += [language_code(F.col(f"`{lang}`")).alias("_code"), F.col(f"`{role}`").alias("_role")]
        self.kept = [docs.schema[c] for c in keep]
        self.source = docs.select(*columns)


def _added(keys: np.ndarray, count: np.ndarray, more: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with counts, and more of them, as one."""
    at = np.searchsorted(keys, more)
    known = np.zeros(len(more), bool)
    known[at < len(keys)] = keys[at[at < len(keys)]] == more[at < len(keys)]
    count[at[known]] += n[known]
    return np.insert(keys, at[~known], more[~known]), np.insert(count, at[~known], n[~known])


def _chunker(body: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        size = 0

        def chunk() -> pa.RecordBatch:
            batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            codes, role = batch.column(batch.num_columns - 2).to_numpy(), batch.column(batch.num_columns - 1).to_numpy()
            keys, count = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
            for a, b, data, offsets in pieces(batch.column(body)):
                key, row = grams(data, offsets, codes[a:b])
                training = role[a:b][row] == TRAIN
                some, n = np.unique(key[training], return_counts=True)
                keys, count = _added(keys, count, some, n.astype(np.uint32))
                some = np.unique(key[~training])
                keys, count = _added(keys, count, some, np.zeros(len(some), np.uint32))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=LEVEL))) as out:
                out.write_batch(batch)
            return pa.RecordBatch.from_pydict({"chunk": [part << 32 | number], "data": pa.array([sink.getvalue().to_pybytes()], pa.binary()), "grams": pa.array([pack(keys)], pa.binary()), "counts": pa.array([pack_plain(count)], pa.binary()), "n": pa.array([len(keys)], pa.int64())})

        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                some = batch.slice(low, 256)
                held.append(some)
                size += some.nbytes
                if size >= CHUNK_BYTES:
                    yield chunk()
                    held, size, number = [], 0, number + 1
                    trim()
        if any(b.num_rows for b in held):
            yield chunk()

    return run


def chunks(layout: Layout) -> DataFrame:
    """(chunk, data, grams, counts, n), a table in the shared folder bucketed by chunk."""
    spark = layout.source.sparkSession
    bound_batches(spark)
    rows = layout.source.mapInArrow(_chunker(layout.body), "chunk long, data binary, grams binary, counts binary, n long")
    name, path = f"quality_chunks_{uuid.uuid4().hex}", new_table(spark)
    rows.write.format("parquet").option("compression", "none").option("path", path).bucketBy(partitions(rows), "chunk").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay: the table has a path of its own
    return out


# --- 2. shards ------------------------------------------------------------------------


def _dealer(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob, counts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                key = unpack(blob)
                count = unpack_plain(counts, len(key), np.uint32)
                shard, turn, at = _by_shard(key, shards)
                parts = [turn[at[k] : at[k + 1]] for k in range(len(shard))]
                yield pa.RecordBatch.from_pydict({"shard": pa.array(shard), "chunk": pa.array([chunk] * len(shard), pa.int64()), "grams": pa.array([pack(turned(key[p])) for p in parts], pa.binary()), "counts": pa.array([pack_plain(count[p]) for p in parts], pa.binary())})

    return run


def _merged(asked: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(distinct n-grams of a shard, their counts, place of each block's n-grams among them)."""
    blocks = [turned_back(unpack(x)) for x in asked.column("grams").to_pylist()]
    counts = [unpack_plain(x, len(b), np.uint32) for x, b in zip(asked.column("counts").to_pylist(), blocks, strict=True)]
    key, place = np.unique(np.concatenate(blocks), return_inverse=True)
    count = np.bincount(place, np.concatenate(counts), len(key)).astype(np.int64)
    return key, count, np.split(place, np.cumsum([len(b) for b in blocks])[:-1])


def _continued(asked: pa.Table) -> pa.Table:
    """Rows (order, g, c): the next lower order's n-grams with their continuation counts, and the counts of counts 1 to 4 (order ORDER, g is the count)."""
    key, count, _ = _merged(asked)
    low, place = np.unique(key & np.uint64((1 << 40) - 1) | key >> np.uint64(48) << np.uint64(48), return_inverse=True)
    c = np.bincount(place, count > 0, len(low)).astype(np.int64)
    of = np.bincount(np.minimum(count, 5), minlength=6)[1:5]
    order = np.concatenate([np.full(len(low), ORDER - 1, np.int32), np.full(4, ORDER, np.int32)])
    return pa.table({"order": order, "g": np.concatenate([low.view(np.int64), np.arange(1, 5)]), "c": np.concatenate([c, of])})


# --- 3. probabilities -----------------------------------------------------------------


def _discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """D1, D2 and D3+ from the counts of counts."""
    n1, n2, n3, n4 = (max(1, x) for x in (n1, n2, n3, n4))
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * b / a, 0.05), k - 0.05) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def _last(g: Column, n: int) -> Column:
    """Language and last n bytes."""
    return g.bitwiseAND(F.lit(_LANGUAGE | (1 << 8 * n) - 1))


def _context(g: Column, n: int) -> Column:
    """Language and first n - 1 bytes of an n-gram."""
    return g.bitwiseAND(F.lit(_LANGUAGE)).bitwiseOR(F.shiftright(g.bitwiseAND(F.lit((1 << 8 * n) - 1)), 8))


def lower_orders(counts: DataFrame) -> DataFrame:
    """(g, p) of order ORDER - 1: interpolated probabilities, from (g, c) of that order."""
    levels = {ORDER - 1: counts}
    for n in range(ORDER - 2, 0, -1):  # continuation counts: distinct bytes before the suffix
        levels[n] = written(levels[n + 1].groupBy(_last(F.col("g"), n).alias("g")).agg(F.sum((F.col("c") > 0).cast("long")).alias("c")))
    lower = None
    for n in range(1, ORDER):
        row = levels[n].agg(*[F.coalesce(F.sum((F.col("c") == k).cast("long")), F.lit(0)) for k in (1, 2, 3, 4)]).first()
        d1, d2, d3 = _discounts(*row)
        c = F.col("c")
        less = F.when(c == 0, 0.0).when(c == 1, d1).when(c == 2, d2).otherwise(d3)
        over = W.partitionBy("h")  # at most 256 rows
        rows = levels[n].withColumn("h", _context(F.col("g"), n)).select("g", (c - less).alias("own"), F.sum("c").over(over).alias("total"), F.sum(less).over(over).alias("rest"))
        if n == 1:
            rows = rows.withColumn("q", F.lit(1 / 256))
        else:
            rows = rows.withColumn("s", _last(F.col("g"), n - 1)).join(lower.select(F.col("g").alias("s"), F.col("p").alias("q")), "s")
        lower = rows.select("g", F.when(F.col("total") > 0, (F.col("own") + F.col("rest") * F.col("q")) / F.col("total")).otherwise(F.col("q")).alias("p"))
    return written(lower)


def _dealt_lower(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy().view(np.uint64)
            turn = np.argsort(key)
            key, p = key[turn], batch.column(1).to_numpy()[turn]
            # the first four of the five bytes are the middle of the n-grams above
            shard = shard_of(key >> np.uint64(8), key >> np.uint64(48), shards)
            turn = np.argsort(shard, kind="stable")
            start = edges(shard[turn])
            shard, parts = shard[turn][start], np.split(turn, start[1:])
            yield pa.RecordBatch.from_pydict({"shard": pa.array(shard), "low": pa.array([pack(key[x]) for x in parts], pa.binary()), "p": pa.array([p[x].tobytes() for x in parts], pa.binary())})

    return run


def probabilities(key: np.ndarray, count: np.ndarray, low: np.ndarray, p: np.ndarray, discounts: tuple[float, float, float]) -> np.ndarray:
    """Interpolated probabilities of sorted n-grams of ORDER, whose contexts and suffixes are all here."""
    less = np.array([0.0, *discounts])[np.minimum(count, 3)]
    start = edges(key >> np.uint64(8))
    size = np.diff(np.append(start, len(key)))
    total, rest = (np.repeat(np.add.reduceat(x, start), size) for x in (count, less))
    q = p[np.searchsorted(low, key & np.uint64((1 << 40) - 1) | key >> np.uint64(48) << np.uint64(48))]
    return np.where(total > 0, (count - less + rest * q) / np.maximum(total, 1), q)


# --- 4. answers and scores ------------------------------------------------------------


def _answerer(discounts: tuple[float, float, float]):
    def run(asked: pa.Table, lower: pa.Table) -> pa.Table:
        names = ["chunk", "shard", "values"]
        if not asked.num_rows:
            return pa.table({"chunk": pa.array([], pa.int64()), "shard": pa.array([], pa.int32()), "values": pa.array([], pa.binary())})
        low, p = np.concatenate([unpack(x) for x in lower.column("low").to_pylist()]), np.concatenate([np.frombuffer(x) for x in lower.column("p").to_pylist()])
        turn = np.argsort(low)
        key, count, places = _merged(asked)
        cost = np.minimum(np.rint(-np.log(probabilities(key, count, low[turn], p[turn], discounts)) * SCALE), 65535).astype(np.uint16)
        return pa.table([asked.column("chunk"), asked.column("shard"), pa.array([pack_plain(cost[k]) for k in places], pa.binary())], names)

    return run


def answers(table: DataFrame) -> tuple[DataFrame, int]:
    """(chunk, shard, values) and the number of shards: the costs of each chunk's n-grams, by shard in the order of the n-grams."""
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(partitions(table), -(-total // SHARD_KEYS))
    asked = table.select("chunk", "grams", "counts").mapInArrow(_dealer(shards), "shard int, chunk long, grams binary, counts binary")
    counted = written(asked.groupBy("shard").applyInArrow(_continued, "order int, g long, c long"))
    release(table.sparkSession)
    of = {r["g"]: r["n"] for r in counted.filter(F.col("order") == ORDER).groupBy("g").agg(F.sum("c").alias("n")).collect()}
    probable = lower_orders(counted.filter(F.col("order") == ORDER - 1).select("g", "c"))
    release(table.sparkSession)
    lower = probable.mapInArrow(_dealt_lower(shards), "shard int, low binary, p binary")
    reply = asked.groupBy("shard").cogroup(lower.groupBy("shard")).applyInArrow(_answerer(_discounts(*(of.get(k, 0) for k in (1, 2, 3, 4)))), "chunk long, shard int, values binary")
    reply = written(reply)
    release(table.sparkSession)
    return reply, shards


class Costs:
    """Costs of a chunk's n-grams in an open-addressing table; every n-gram that is asked for is there."""

    def __init__(self, key: np.ndarray, cost: np.ndarray):
        self.bits = max(4, (2 * len(key)).bit_length())
        self.keys = np.full(1 << self.bits, _FREE, np.uint64)
        self.costs = np.zeros(1 << self.bits, np.uint16)
        at = self._slot(key)
        while len(key):
            free = self.keys[at] == _FREE
            self.keys[at[free]] = key[free]  # of several for one place the last stays
            won = self.keys[at] == key
            self.costs[at[won]] = cost[won]
            key, cost, at = key[~won], cost[~won], (at[~won] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, key: np.ndarray) -> np.ndarray:
        at = self._slot(key)
        out, ask = self.costs[at], np.flatnonzero(self.keys[at] != key)
        at = at[ask]
        while len(ask):
            at = (at + 1) & ((1 << self.bits) - 1)
            hit = self.keys[at] == key[ask]
            out[ask[hit]] = self.costs[at[hit]]
            ask, at = ask[~hit], at[~hit]
        return out


def _scorer(body: int, width: int, shards: int, only: int | None, schema: T.StructType):
    def run(chunk: pa.Table, reply: pa.Table) -> pa.Table:
        out = []
        by_shard = dict(zip(reply.column("shard").to_pylist(), reply.column("values").to_pylist(), strict=True)) if chunk.num_rows else {}
        for data, blob in zip(chunk.column("data").to_pylist(), chunk.column("grams").to_pylist(), strict=True):
            batch = pa.ipc.open_stream(data).read_next_batch()
            if only is not None:
                batch = batch.filter(pa.compute.equal(batch.column(batch.num_columns - 1), only))
                if not batch.num_rows:
                    continue
            key = unpack(blob)
            cost = np.zeros(len(key), np.uint16)
            some, turn, at = _by_shard(key, shards)
            for k, s in enumerate(some.tolist()):
                place = turn[at[k] : at[k + 1]]
                cost[place] = unpack_plain(by_shard[s], len(place), np.uint16)
            known, codes = Costs(key, cost), batch.column(batch.num_columns - 2).to_numpy()
            n, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for a, b, text, offsets in pieces(batch.column(body)):
                asked, row = grams(text, offsets, codes[a:b])
                n[a:b] = np.bincount(row, minlength=b - a)
                total[a:b] = np.bincount(row, known.get(asked), b - a)
            done = pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(codes), pa.array(n), pa.array(-total / SCALE)], schema.names)
            rows = max(1, done.num_rows * BATCH_BYTES // max(1, done.nbytes))  # of a bounded size, also on the way back
            out += [done.slice(low, rows) for low in range(0, done.num_rows, rows)]
        trim()
        if out:
            return pa.Table.from_batches(out)
        from pyspark.sql.pandas.types import to_arrow_schema

        return to_arrow_schema(schema).empty_table()

    return run


def scored(layout: Layout, table: DataFrame, reply: DataFrame, shards: int, only: int | None = None) -> DataFrame:
    """The kept columns (none with `only`), _code, _n (bytes scored) and _total (their log probability) of all documents, or of one role."""
    kept = [] if only is not None else layout.kept
    schema = T.StructType([T.StructField(f"_k{i}", f.dataType) for i, f in enumerate(kept)] + [T.StructField("_code", T.LongType()), T.StructField("_n", T.LongType()), T.StructField("_total", T.DoubleType())])
    run = _scorer(layout.body, len(kept), shards, only, schema)
    return table.select("chunk", "data", "grams").groupBy("chunk").cogroup(reply.groupBy("chunk")).applyInArrow(run, schema)


def _limits(held: DataFrame, quantile: float, margin: float) -> DataFrame:
    """(_code, _mean, threshold) of each language: mean log probability a byte, and the quantile times margin."""
    means = held.groupBy("_code").agg((F.sum("_total") / F.sum("_n")).alias("_mean"))
    steps = held.join(sized_broadcast(means), "_code").withColumn("_step", F.round(_smoothed() / STEP).cast("long"))  # at most 256 / STEP values
    return steps.groupBy("_code", "_mean").agg((F.percentile("_step", F.lit(quantile)) * STEP * margin).alias("threshold"))


def _smoothed() -> Column:
    return F.exp(-(F.col("_total") + SMOOTHING * F.col("_mean")) / (F.col("_n") + SMOOTHING))


def classify(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, text: str = "text", lang: str = "lang", key: str = "doc_id", quantile: float = KEEP, margin: float = MARGIN) -> DataFrame:
    """The columns `keep`, then perplexity (per byte, smoothed), threshold and kept."""
    keep = [key, lang] if keep is None else keep
    names = docs.columns
    own = [f"c{i}" for i in range(len(names))]
    at = dict(zip(names, own, strict=True))
    known = trusted_documents(docs.toDF(*own), labels, at[key], at[text])
    layout = Layout(known, [at[c] for c in keep], at[text], at[lang], "_role")
    held = chunks(layout)
    reply, shards = answers(held)
    limits = sized_broadcast(written(_limits(written(scored(layout, held, reply, shards, HELD).filter("_n > 0")), quantile, margin)))
    release(docs.sparkSession)
    joined = scored(layout, held, reply, shards).join(limits, "_code", "left")
    perplexity = F.when((F.col("_n") > 0) & F.col("_mean").isNotNull(), _smoothed())
    return joined.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], perplexity.alias("perplexity"), "threshold", F.coalesce(perplexity <= F.col("threshold"), F.lit(True)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """docs without the rejected rows; all columns stay, whatever their names."""
    names = docs.columns
    own = [f"c{i}" for i in range(len(names))]
    at = dict(zip(names, own, strict=True))
    judged = classify(docs.toDF(*own), labels, own, at[text], at[lang], at[key])
    return judged.filter("kept").select(*own).toDF(*names)


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
