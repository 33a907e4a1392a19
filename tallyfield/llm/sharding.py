"""Fixed-capacity shards by best-fit-decreasing bin packing.

Method: indivisible groups (rows of equal text) are taken in order of size, the largest
first, and each enters the bin whose remaining capacity is the smallest that still holds
it; a balanced tree (a treap) over remaining capacities finds that bin in logarithmic
time.  Groups of one size are alike, and the tightest bin stays the tightest until it
can hold no more of them, so a run of equal groups enters a bin at once: `pack_runs` makes
the same bins as `pack` does group by group.  Sizes count in SIZE_BITS significant bits
(rounded up, exact up to 4095 bytes), so there are at most 2^(SIZE_BITS - 1) * 64 sizes at
any number of groups; the packing on the driver sees only these and their counts.  Every
group is packed in that way; there is no other path.

The groups of a size are numbered in cells of about CELL_ROWS, and a number is a place in
the runs of that size.  Groups of more than 1 / HEAVY of all rows (so fewer than HEAVY of
them) are sent to their rows, the others are joined with theirs on the text's digest.

`pack` opens as few bins of a capacity as the method finds; `shard_table` looks for the
least capacity at which the method fills no more than the wanted number of shards, so the
shards' bytes are near equal.  A group larger than an even share has a shard to itself and
the rest is evened out over the others.

Slots are gapless from 0 in each shard.  They come from row numbers in small cells of a
shard and the cells' running counts, so no task holds a shard.

Cases: null text counts 0 bytes, has the checksum 0 and groups with other null texts;
an empty text is a group of its own kind; repeated rows are placed each, beside one
another; ties go to the earlier bin; very long texts are groups of their size; an empty
table gives no rows; columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyfield.llm._spark import table, text_of, written

SHARDS = 40
#: Bytes that a row takes beside its text.
ROW_BYTES = 16
#: Different sizes that are packed as they are, and the least significant bits of a size where there are more.
MOST_SIZES = 1 << 16
SIZE_BITS = 12
#: A group of more than one of so many rows is sent to its rows rather than joined with them.
HEAVY = 10_000
#: Rows of one cell of a shard, groups of one cell of a size.
CELL_ROWS = 20_000


class Treap:
    """A balanced search tree of distinct keys; `least(key)` is the smallest key not below it."""

    def __init__(self, seed: int = 1):
        self._random = random.Random(seed)
        self._root: list | None = None  # [key, priority, left, right]

    def _split(self, node: list | None, key: tuple) -> tuple[list | None, list | None]:
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            node[3] = low
            return node, high
        low, high = self._split(node[2], key)
        node[2] = high
        return low, node

    def _merge(self, low: list | None, high: list | None) -> list | None:
        if low is None or high is None:
            return low or high
        if low[1] > high[1]:
            low[3] = self._merge(low[3], high)
            return low
        high[2] = self._merge(low, high[2])
        return high

    def add(self, key: tuple) -> None:
        low, high = self._split(self._root, key)
        self._root = self._merge(self._merge(low, [key, self._random.random(), None, None]), high)

    def least(self, key: tuple) -> tuple | None:
        node, found = self._root, None
        while node is not None:
            if node[0] >= key:
                found, node = node[0], node[2]
            else:
                node = node[3]
        return found

    def remove(self, key: tuple) -> None:
        parent, side, node = None, 0, self._root
        while node is not None and node[0] != key:
            parent, side = node, 2 if key < node[0] else 3
            node = node[side]
        if node is None:
            raise KeyError(key)
        rest = self._merge(node[2], node[3])
        if parent is None:
            self._root = rest
        else:
            parent[side] = rest


def pack(sizes: list[int], capacity: int, most: int | None = None) -> list[int] | None:
    """The bin of each item by best-fit decreasing; ties go to the earlier item and the earlier bin.

    An item above the capacity has a bin to itself.  None as soon as more than `most` bins are open.
    """
    bins: list[int] = [0] * len(sizes)
    free, opened = Treap(), 0
    for k in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = free.least((sizes[k], -1)) if sizes[k] <= capacity else None
        if found is None:
            bins[k], left = opened, capacity - sizes[k]
            opened += 1
            if most is not None and opened > most:
                return None
        else:
            free.remove(found)
            bins[k], left = found[1], found[0] - sizes[k]
        if left > 0:
            free.add((left, bins[k]))
    return bins


def pack_runs(runs: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[list[tuple[int, int]]] | None:
    """`pack` for (size, count) runs in order of falling size: the (bin, count) pairs of each run."""
    out: list[list[tuple[int, int]]] = []
    free, opened = Treap(), 0
    for size, count in runs:
        placed = []
        while count:
            found = free.least((size, -1)) if size <= capacity else None
            if found is None:
                bin_, left = opened, capacity
                opened += 1
                if most is not None and opened > most:
                    return None
            else:
                free.remove(found)
                left, bin_ = found
            some = min(count, max(1, left // size))
            placed.append((bin_, some))
            count -= some
            left -= some * size
            if left > 0:
                free.add((left, bin_))
        out.append(placed)
    return out


def even_runs(runs: list[tuple[int, int]], shards: int) -> list[list[tuple[int, int]]]:
    """Bins 0 .. shards-1 of near equal size: groups above an even share get bins of their own, the rest the least capacity that serves."""
    total, left = sum(s * n for s, n in runs), shards
    alone: list[int] = []  # groups of each run that have a bin of their own
    for size, count in runs:
        own = 0
        while own < count and left > 1 and size * left > total:
            own, left, total = own + 1, left - 1, total - size
        alone.append(own)
        if own < count:
            break
    alone += [0] * (len(runs) - len(alone))
    rest = [(size, count - own) for (size, count), own in zip(runs, alone, strict=True)]
    low = max([1, -(-total // left), *(s for s, n in rest if n)])
    best = pack_runs(rest, low, left)
    if best is None:
        step = max(1, low // 2000)
        while (best := pack_runs(rest, low + step, left)) is None:
            step *= 2
        high = low + step
        while high - low > max(1, high // 100_000):
            middle = (low + high) // 2
            found = pack_runs(rest, middle, left)
            low, high, best = (middle, high, best) if found is None else (low, middle, found)
    out, first = [], 0
    for own, placed in zip(alone, best, strict=True):
        out.append([(first + k, 1) for k in range(own)] + [(b + shards - left, n) for b, n in placed])
        first += own
    return out


def _rounded(size: Column, bits: int = SIZE_BITS) -> Column:
    """A size in so many significant bits, rounded up."""
    spare = F.greatest(F.length(F.bin(size)) - bits, F.lit(0))
    unit = F.call_function("shiftleft", F.lit(1).cast("long"), spare)
    return F.call_function("shiftleft", F.call_function("shiftright", size + unit - 1, spare), spare)


def significant_bits(groups: DataFrame, most: int = MOST_SIZES) -> int:
    """The most significant bits (63: exact) at which `bytes` has at most `most` different values."""
    sizes = groups.select("bytes").distinct()
    for bits in (63, 24, 20, 16, 14):
        if sizes.select(_rounded(F.col("bytes"), bits)).distinct().limit(most + 1).count() <= most:
            return bits
    return SIZE_BITS


def _starts(df: DataFrame, of: str, cell: str) -> DataFrame:
    """(of, cell, _start): how many rows of `of` are in the cells before."""
    before = W.partitionBy(of).orderBy(cell).rowsBetween(W.unboundedPreceding, -1)
    return df.groupBy(of, cell).agg(F.count("*").alias("_rows")).select(of, cell, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))


def place_groups(groups: DataFrame, shards: int, most: int = MOST_SIZES) -> DataFrame:
    """(_group, shard, copies) from (_group, bytes, copies)."""
    spark = groups.sparkSession
    groups = written(groups)
    sized = groups.withColumn("_size", _rounded(F.col("bytes"), significant_bits(groups, most)))
    runs = [(r["_size"], r["n"]) for r in sized.groupBy("_size").agg(F.count("*").alias("n")).orderBy(F.desc("_size")).collect()]  # one row a size
    spans = []
    for (size, count), placed in zip(runs, even_runs(runs, shards) if runs else [], strict=True):
        ends, total = [], 0
        for _, n in placed:
            ends.append(total := total + n)
        spans.append((size, -(-count // CELL_ROWS), ends, [b for b, _ in placed]))
    placed = F.broadcast(spark.createDataFrame(spans, "_size long, _cells long, _ends array<long>, _bins array<int>"))
    dealt = sized.join(placed, "_size").withColumn("_cell", F.pmod(F.xxhash64("_group"), F.col("_cells")))
    numbered = dealt.withColumn("_at", F.row_number().over(W.partitionBy("_size", "_cell").orderBy("_group")) - 1)
    known = numbered.join(_starts(dealt, "_size", "_cell"), ["_size", "_cell"])
    at = F.col("_start") + F.col("_at")
    return known.select("_group", F.get("_bins", F.size(F.filter("_ends", lambda x: x <= at))).alias("shard"), "copies")


def shard_table(docs: DataFrame, shards: int = SHARDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    body = F.col(f"`{text}`").cast("string")
    digest = F.coalesce(F.unhex(F.md5(body.cast("binary"))), F.lit(b""))
    base = written(docs.select(F.col(f"`{key}`").alias("doc_id"), (F.octet_length(text_of(f"`{text}`")) + ROW_BYTES).cast("long").alias("size"), F.crc32(text_of(f"`{text}`").cast("binary")).alias("text_crc32"), digest.alias("_group")))
    rows = base.count()
    placed = written(place_groups(base.groupBy("_group").agg(F.sum("size").alias("bytes"), F.count("*").alias("copies")), shards))
    heavy = F.broadcast(placed.filter(F.col("copies") * HEAVY > rows).select("_group", "shard"))  # fewer than HEAVY rows
    light = placed.filter(F.col("copies") * HEAVY <= rows).select("_group", "shard")
    salted = F.pmod(F.xxhash64("doc_id", "_group") + F.monotonically_increasing_id(), F.lit(1 << 20))
    put = base.join(heavy, "_group").withColumn("_salt", salted).union(base.join(heavy, "_group", "left_anti").join(light, "_group").withColumn("_salt", F.xxhash64("doc_id", "_group")))
    cells = F.broadcast(put.groupBy("shard").agg(F.ceil(F.count("*") / CELL_ROWS).alias("_cells")))  # one row a shard
    put = written(put.join(cells, "shard").withColumn("_cell", F.pmod("_salt", "_cells")).drop("_salt", "_cells"))
    numbered = put.withColumn("_at", F.row_number().over(W.partitionBy("shard", "_cell").orderBy("doc_id", "text_crc32", "_group")) - 1)
    return numbered.join(_starts(put, "shard", "_cell"), ["shard", "_cell"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_start") + F.col("_at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_table(table(spark, sf_dir, "documents"))
