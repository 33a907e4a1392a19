"""N-gram Jaccard join: documents whose sets of word shingles overlap by 0.75 or more.

Method (T-occurrence search with DivideSkip).  Two sets of sizes m and n reach a Jaccard
of 3/4 only if they share T = ceil(3 (m + n) / 7) shingles.

1. Classes: documents of equal sets are one class, named by a 64-bit signature.
2. Order: document frequencies of all shingles (summed before they are dealt) give the
   global order "rare first"; only the HOT_ROWS most frequent ones are told apart, and the
   order never affects the result, only the length of inverted lists.
3. Lists: by the prefix bound, linked classes share one of their first n - ceil(3n/4) + 1
   shingles in that order.  These are dealt into inverted lists.  Lists of up to SHORT
   classes give pairs; longer ones stay lists.  Shingles of WIDE classes and more are known
   by then; their lists are never brought together but stay rows.
4. Sketches: a parity bitmap of 2n bits a class bounds the symmetric difference from
   below, so a pair over the bound is no link.  Of a list over LIST_CHUNK classes each is
   first paired with a few pivots, classes of least hash in its lists, which many lists share.  Classes that are joined by then need no pair of their own: only those outside the
   list's largest component are compared, chunk by chunk, with all of the list.
5. Blocks: connected components of the remaining pairs.  Any link lies within a block.
   In a block over BLOCK_CHUNK shingles every class is first joined with a few pivots; then
   only classes outside the largest component query the block, chunk by chunk.
6. Exact join in each block: an inverted index; for every query class the longest lists are
   set aside, the short ones merged by a heap and counted, classes that reach T less the
   number of long lists are probed for in the long lists by binary search, and those with T
   shingles in common are linked.  Queries are needed only for classes outside the largest
   component found so far.
7. Components of these links; the smallest doc_id of all members names a component.

No list, block or component is collected; nothing is capped or sampled.

Cases: null and empty texts, and texts without words, have an empty set and are linked
with nothing; texts under five words have one shingle, the whole sequence; very long texts
count whole; repeated rows and equal texts are one class; rows with a null doc_id are
compared like others but never name a component while another id can; ids may be of any
type that has an order; columns beside doc_id and text are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import merge
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfield.llm._pack import edges, pack, pack_plain, unpack, unpack_plain
from tallyfield.llm._spark import bound_batches, partitions, sized_broadcast, table, text_of, written
from tallyfield.llm._text import lower_table, mix, pieces, shingle_hashes, span_hashes, words
from tallyfield.llm.graph import Union, components

WORDS = 5
#: Shingles in at least so many classes count as frequent, and of those the most frequent HOT_ROWS come last in the order.
HOT_FREQUENCY = 32
HOT_ROWS = 1 << 18
#: Inverted lists up to this length give pairs at once.
SHORT = 8
#: A frequent shingle in at least so many classes has a list of rows; pivots of a long list.
WIDE = 4096
PIVOTS = 2
#: Long lists and large blocks whose numbers may be broadcast (about 100 bytes each); large blocks whose pivots' sets may be (some kB each).
LARGE_GROUPS = 500_000
LARGE_BLOCKS = 2_000
#: Classes of a chunk of a long list; shingles of a chunk of a block.
LIST_CHUNK = 512
BLOCK_CHUNK = 40_000
#: Shingles that a task holds before it passes them on.
FLUSH = 400_000
#: A class of more than one of so many rows is sent to its rows rather than joined with them.
HEAVY = 10_000
#: Bits of the bitmap that spares most sets outside all blocks the join (it may only let too many pass).
MAX_FILTER_BITS = 1 << 24
#: Cost of a binary probe against a merge step, for the number of long lists.
DIVIDE_SKIP_MU = 0.01


def required(m: np.ndarray | int, n: np.ndarray | int) -> np.ndarray | int:
    """Least overlap of linked sets of sizes m and n: 100 i >= 75 (m + n - i)."""
    return -(-3 * (m + n) // 7)


def sets_of(array: pa.Array, size: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every row."""
    lower, empty = lower_table(), np.zeros(0, np.uint64)
    for a, b, data, offsets in pieces(array):
        data = lower[data]
        start, end, first = words(data, offsets)
        hashes = span_hashes(data, start, end)
        grams = shingle_hashes(hashes, size)
        at = first.tolist()
        for k in range(b - a):
            low, high = at[k], at[k + 1]
            if high - low >= size:
                yield np.unique(grams[low : high - size + 1])
            elif high > low:
                whole = np.array([high - low], np.uint64)
                for h in hashes[low:high]:
                    whole = mix(whole * np.uint64(0x9E3779B97F4A7C15) + h)
                yield whole
            else:
                yield empty


def signature(grams: np.ndarray) -> int:
    """Signed 64-bit name of a set."""
    total = mix(grams + np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64, keepdims=True)
    return int(mix(total * np.uint64(0xE7037ED1A0B428DB) + np.uint64(len(grams))).view(np.int64)[0])


def sketch(grams: np.ndarray) -> bytes:
    """Parity bitmap of at least 2n bits (a power of two); folding it in half gives the smaller one."""
    bits = max(64, 1 << (2 * len(grams) - 1).bit_length())
    count = np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    # bit i of the map is bit i mod 8 of byte i // 8, so a fold halves the bytes
    return np.packbits((count & 1).astype(np.uint8), bitorder="little").tobytes()


def _fold(bitmap: np.ndarray, words64: int) -> np.ndarray:
    """Fold rows of 64-bit words to `words64` of them."""
    while bitmap.shape[1] > words64:
        half = bitmap.shape[1] // 2
        bitmap = bitmap[:, :half] ^ bitmap[:, half:]
    return bitmap


# --- 1. classes -----------------------------------------------------------------------


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, names, maps = [], [], []
        for grams in sets_of(batch.column(1)):
            n.append(len(grams))
            names.append(signature(grams) if len(grams) else None)
            maps.append(sketch(grams) if len(grams) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(names, pa.int64()), pa.array(maps, pa.binary())], ["doc_id", "n_shingles", "sig", "sketch"])


# --- 2. order -------------------------------------------------------------------------


def _frequency_parts(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, size = [], 0

        def out() -> pa.RecordBatch:
            values, count = np.unique(np.concatenate(held) >> np.uint64(24), return_counts=True)
            edge = np.searchsorted(values, (np.arange(1, shards, dtype=np.uint64) << np.uint64(40)) // np.uint64(shards))
            parts, counts = np.split(values, edge), np.split(count.astype(np.uint32), edge)
            full = [k for k, p in enumerate(parts) if len(p)]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([pack(parts[k]) for k in full], pa.binary()), pa.array([pack_plain(counts[k]) for k in full], pa.binary())], ["shard", "grams", "counts"])

        for batch in batches:
            for grams in sets_of(batch.column(0)):
                if not len(grams) or (name := signature(grams)) in seen:
                    continue
                seen.add(name)
                held.append(grams)
                size += len(grams)
                if size >= FLUSH:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return run


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams, counts = [], []
    for b in batches:
        for g, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            grams.append(unpack(g))
            counts.append(unpack_plain(c, len(grams[-1]), np.uint32))
    if not grams:
        return
    values, place = np.unique(np.concatenate(grams), return_inverse=True)
    count = np.bincount(place, np.concatenate(counts), len(values)).astype(np.int64)
    hot = count >= HOT_FREQUENCY
    yield pa.RecordBatch.from_arrays([pa.array(values[hot].astype(np.int64)), pa.array(count[hot])], ["gram", "df"])


# --- 3. inverted lists ----------------------------------------------------------------


def _postings(shards: int, hot):
    """Blocks of postings by shards of shingles; those of wide shingles by shards -1, -2, ... of classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, wide = hot.value
        seen: set[int] = set()
        held, names, sizes, size = [], [], [], 0

        def out() -> pa.RecordBatch:
            lengths = np.fromiter(map(len, held), np.int64, len(held))
            grams = np.concatenate(held) >> np.uint64(8)
            name = np.repeat(np.array(names, np.int64), lengths)
            n = np.repeat(np.array(sizes, np.int32), lengths)
            shard = ((grams >> np.uint64(24)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
            if len(wide):
                at = np.minimum(np.searchsorted(wide, grams >> np.uint64(16)), len(wide) - 1)
                apart = wide[at] == grams >> np.uint64(16)
                shard[apart] = -1 - (mix(name[apart].view(np.uint64)) % np.uint64(shards)).astype(np.int64)
            order = np.lexsort((grams, shard))
            grams, name, n, shard = grams[order], name[order], n[order], shard[order]
            cut_at = np.append(edges(shard), len(grams))
            full = shard[cut_at[:-1]].tolist()
            parts = [slice(x, y) for x, y in zip(cut_at[:-1], cut_at[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([pack(grams[p]) for p in parts], pa.binary()), pa.array([name[p].tobytes() for p in parts], pa.binary()), pa.array([n[p].tobytes() for p in parts], pa.binary())], ["shard", "grams", "sigs", "sizes"])

        for batch in batches:
            for grams in sets_of(batch.column(0)):
                n = len(grams)
                if not n or (name := signature(grams)) in seen:
                    continue
                seen.add(name)
                prefix = n - (3 * n + 3) // 4 + 1
                if len(frequent):
                    short = grams >> np.uint64(24)
                    at = np.minimum(np.searchsorted(frequent, short), len(frequent) - 1)
                    late = frequent[at] == short
                    grams = np.concatenate([grams[~late], grams[late]])
                held.append(grams[:prefix])
                names.append(name)
                sizes.append(n)
                size += prefix
                if size >= FLUSH:
                    yield out()
                    held, names, sizes, size = [], [], [], 0
        if held:
            yield out()

    return run


_LISTS = "list long, a long, na int, b long, nb int"


def _members(lists: np.ndarray, sig: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(lists), pa.array(sig), pa.array(n), pa.nulls(len(lists), pa.int64()), pa.nulls(len(lists), pa.int32())], ["list", "a", "na", "b", "nb"])


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of short lists (list null) and members of long ones (a is the member).  Postings of wide shingles are members as they come."""
    grams, sigs, sizes = [], [], []
    for b in batches:
        for shard, g, s, n in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            if shard < 0:
                yield _members(unpack(g).view(np.int64), np.frombuffer(s, np.int64), np.frombuffer(n, np.int32))
                continue
            grams.append(unpack(g))
            sigs.append(np.frombuffer(s, np.int64))
            sizes.append(np.frombuffer(n, np.int32))
    if not grams:
        return
    gram, sig, n = np.concatenate(grams), np.concatenate(sigs), np.concatenate(sizes)
    order = np.argsort(gram, kind="stable")
    gram = gram[order]
    twin = np.zeros(len(gram) + 1, bool)
    twin[1:-1] = gram[1:] == gram[:-1]
    shared = twin[1:] | twin[:-1]  # grams of one posting alone make no list
    gram, order = gram[shared], order[shared]
    sig, n = sig[order], n[order]
    order = np.lexsort((sig, n, gram))
    gram, sig, n = gram[order], sig[order], n[order]
    fresh = np.ones(len(gram), bool)
    fresh[1:] = (gram[1:] != gram[:-1]) | (sig[1:] != sig[:-1])  # a class may come from several tasks
    gram, sig, n = gram[fresh], sig[fresh], n[fresh]
    if not len(gram):
        return
    start = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    length = np.diff(np.append(start, len(gram)))
    of = np.repeat(length, length)
    pairs = []
    for d in range(1, SHORT):
        i = np.flatnonzero((gram[d:] == gram[:-d]) & (of[d:] <= SHORT) & (4 * n[:-d].astype(np.int64) >= 3 * n[d:].astype(np.int64))) if len(gram) > d else np.zeros(0, np.int64)
        pairs.append(np.stack([i, i + d], 1))
    pair = np.concatenate(pairs)
    if len(pair):
        a, b, na, nb = sig[pair[:, 0]], sig[pair[:, 1]], n[pair[:, 0]], n[pair[:, 1]]
        _, one = np.unique(mix(mix(a.view(np.uint64)) + b.view(np.uint64)), return_index=True)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(one), pa.int64()), pa.array(a[one]), pa.array(na[one]), pa.array(b[one]), pa.array(nb[one])], ["list", "a", "na", "b", "nb"])
    long = np.flatnonzero(length > SHORT)
    if len(long):
        total = np.add.reduceat(mix(sig.view(np.uint64)), start)[long]
        name, one = np.unique(total, return_index=True)
        for k in range(0, len(one), 1000):
            some = long[one[k : k + 1000]]
            at = np.concatenate([np.arange(start[x], start[x] + length[x]) for x in some])
            yield _members(np.repeat(name[k : k + 1000].view(np.int64), length[some]), sig[at], n[at])


# --- 4. sketches ----------------------------------------------------------------------


def _agree(sketch_a: np.ndarray, sketch_b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether rows may be linked: 64-bit words of two bitmaps of one width."""
    apart = np.bitwise_count(sketch_a ^ sketch_b).sum(1, dtype=np.int64)
    return apart <= na + nb - 2 * required(na, nb)


def _close_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (a, na, sketch, b, nb, sketch) those that may be links."""
    for batch in batches:
        a, b = batch.column(0), batch.column(3)
        na, nb = (batch.column(k).to_numpy().astype(np.int64) for k in (1, 4))
        left, right = batch.column(2).to_pylist(), batch.column(5).to_pylist()
        width = np.fromiter((min(len(x), len(y)) for x, y in zip(left, right, strict=True)), np.int64, len(left))
        good = np.zeros(len(left), bool)
        for w in np.unique(width).tolist():
            rows = np.flatnonzero(width == w)
            x = np.concatenate([_fold(np.frombuffer(left[k], np.uint64)[None], w // 8) for k in rows])
            y = np.concatenate([_fold(np.frombuffer(right[k], np.uint64)[None], w // 8) for k in rows])
            good[rows] = _agree(x, y, na[rows], nb[rows])
        keep = pa.array(good)
        yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], ["a", "b"])


def _nearer(n: np.ndarray, maps: list[bytes]):
    """near(k): rows whose sketches allow a link with row k."""
    width = np.fromiter(map(len, maps), np.int64, len(maps)) // 8
    by_width = {w: (rows := np.flatnonzero(width == w), np.frombuffer(b"".join(maps[k] for k in rows), np.uint64).reshape(len(rows), w)) for w in np.unique(width).tolist()}
    folded: dict[tuple[int, int], np.ndarray] = {}

    def near(k: int) -> np.ndarray:
        own, found = np.frombuffer(maps[k], np.uint64)[None], []
        for w, (rows, block) in by_width.items():
            if not width[k] // 2 <= w <= 2 * width[k]:
                continue  # sizes of linked sets differ by a third at most
            least = min(w, int(width[k]))
            if (w, least) not in folded:
                folded[w, least] = _fold(block, least)
            size = n[rows]
            ok = (4 * np.minimum(size, n[k]) >= 3 * np.maximum(size, n[k])) & _agree(folded[w, least], _fold(own, least), size, n[k])
            found.append(rows[ok])
        return np.concatenate(found)

    return near


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _rest_forest(group: pa.Table) -> pa.Table:
    """Edges between the classes that ask and all classes of a chunk of a long list."""
    return _asked(group, "a", _nearer(group.column("na").to_numpy().astype(np.int64), group.column("sketch").to_pylist()))


def _asked(group: pa.Table, name: str, near) -> pa.Table:
    """Edges of the rows that ask to those that near(k) gives, without circles."""
    sig, asks = group.column(name).to_numpy(), np.flatnonzero(group.column("asks").to_numpy(zero_copy_only=False))
    sets, a, b = Union(len(sig)), [], []
    for k in asks.tolist():
        for x in near(k).tolist():
            if x != k and sets.join(k, x) and sig[x] != sig[k]:
                a.append(int(sig[k]))
                b.append(int(sig[x]))
    return pa.table({"a": a, "b": b}, schema=_EDGES)


def _cover(sig: np.ndarray, near) -> tuple[list[int], list[int]]:
    """A spanning forest of the graph whose neighbours near(k) gives, asking as few k as possible.

    A few classes are tried for one with many neighbours; after that every class outside the
    largest component is asked, which finds all links but those within that component.
    """
    m, edges, asked = len(sig), [], set()
    sets = Union(m)
    outside = np.ones(m, bool)

    def ask(k: int) -> None:
        asked.add(k)
        for x in near(k).tolist():
            if x != k and sets.join(k, x):
                edges.append((k, x))

    for k in dict.fromkeys((m * i) // 5 for i in range(5)):
        ask(k)
    root = np.fromiter((sets.find(x) for x in range(m)), np.int64, m)
    outside = root != np.bincount(root).argmax()
    for k in np.flatnonzero(outside).tolist():
        if k not in asked:
            ask(k)
    return [int(sig[x]) for x, _ in edges], [int(sig[y]) for _, y in edges]


# --- 6. exact join --------------------------------------------------------------------


def divide_skip(lists: list[np.ndarray], need: int) -> tuple[np.ndarray, np.ndarray]:
    """Members of at least `need` of the sorted lists, and in how many each is.

    The longest lists are set aside; the others are merged by a heap and counted; what can
    still reach `need` is looked up in the long lists by binary search.
    """
    none = np.zeros(0, np.int64)
    if len(lists) < need:
        return none, none
    lists = sorted(lists, key=len)
    aside = int(need / (DIVIDE_SKIP_MU * np.log2(max(2, len(lists[-1]))) + 1))
    aside = max(0, min(need - 1, aside, len(lists) - 1))
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    who_, count_ = [], []
    for x, same in groupby(merge(*[x.tolist() for x in short])):  # a heap over the heads of the lists
        c = sum(1 for _ in same)
        if c >= need - aside:
            who_.append(x)
            count_.append(c)
    who, count = np.array(who_, np.int64), np.array(count_, np.int64)
    for done, x in enumerate(long, 1):
        if not len(who):
            break
        at = np.minimum(np.searchsorted(x, who), len(x) - 1)
        count = count + (x[at] == who)
        keep = count >= need - (aside - done)
        who, count = who[keep], count[keep]
    return who, count


def _linker(grams: list[np.ndarray]):
    """near(k): rows whose sets are linked with the set of row k, by an inverted index of all."""
    n = np.fromiter(map(len, grams), np.int64, len(grams))
    flat, doc = np.concatenate(grams), np.repeat(np.arange(len(grams)), n)
    order = np.lexsort((doc, flat))
    gram, doc = flat[order], doc[order]
    start = edges(gram)
    ends = np.append(start[1:], len(gram))
    # number of the list of each shingle of each class, in the order of the classes
    number = np.empty(len(flat), np.int64)
    number[order] = np.repeat(np.arange(len(start)), ends - start)
    at = np.concatenate([[0], np.cumsum(n)])

    def near(k: int) -> np.ndarray:
        need = -(-3 * int(n[k]) // 4)  # the least over all sizes that may be linked
        own = number[at[k] : at[k + 1]]
        own = own[ends[own] - start[own] > 1]
        who, common = divide_skip([doc[start[x] : ends[x]] for x in own.tolist()], need)
        return who[(who != k) & (common >= required(n[k], n[who]))]

    return near


def _block_links(group: pa.Table) -> pa.Table:
    """Links that connect each component of one block."""
    near = _linker([np.frombuffer(x, np.uint64) for x in group.column("grams").to_pylist()])
    return pa.table(dict(zip(("a", "b"), _cover(group.column("sig").to_numpy(), near), strict=True)), schema=_EDGES)


def _rest_links(group: pa.Table) -> pa.Table:
    """Links between the classes that ask and all classes of a chunk of a large block."""
    near = _linker([np.frombuffer(x, np.uint64) for x in group.column("grams").to_pylist()])
    return _asked(group, "sig", near)


def _pivot_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of classes (sig, grams) with the pivots of their block (pivots: sig and grams of each)."""
    for batch in batches:
        a, b = [], []
        sets: dict[int, np.ndarray] = {}
        for name, blob, pivots in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            own = np.frombuffer(blob, np.uint64)
            for p in pivots:
                other = sets.setdefault(p["sig"], np.frombuffer(p["grams"], np.uint64))
                if p["sig"] != name:
                    at = np.minimum(np.searchsorted(other, own), len(other) - 1)
                    if (other[at] == own).sum() >= required(len(own), len(other)):
                        a.append(name)
                        b.append(p["sig"])
        yield pa.RecordBatch.from_pydict({"a": a, "b": b}, schema=_EDGES)


def _sets_in(bitmap):
    """(sig, grams) of the classes whose bit is set; each once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        mask = np.int64(len(bits) * 64 - 1)
        seen: set[int] = set()
        for batch in batches:
            names, data = [], []
            for grams in sets_of(batch.column(0)):
                if not len(grams) or (name := signature(grams)) in seen:
                    continue
                bit = int(np.int64(name) & mask)
                if int(bits[bit >> 6]) >> (bit & 63) & 1:
                    seen.add(name)
                    names.append(name)
                    data.append(grams.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(data, pa.binary())], ["sig", "grams"])

    return run


def _bitmap(names: DataFrame, count: int) -> np.ndarray:
    """64-bit words of a bitmap of names: at least 16 bits a name up to MAX_FILTER_BITS, so of bounded size."""
    bits = min(MAX_FILTER_BITS, max(64, 1 << (16 * count).bit_length()))
    slot = F.col("vertex").bitwiseAND(F.lit(bits - 1))
    words64 = names.groupBy(F.shiftright(slot, 6).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))).alias("x"))
    out = np.zeros(bits // 64, np.int64)
    for r in words64.toLocalIterator():
        out[r["w"]] = r["x"]
    return out.view(np.uint64)


def _rest(rows: DataFrame, group: str, name: str, weight, most: int, joined: DataFrame) -> DataFrame:
    """rows with columns part and asks: of groups whose classes are not of one component of `joined`, the classes outside the largest one (they ask), and beside each chunk of those all classes, in chunks of `most` weight."""
    named = rows.join(joined.select(F.col("vertex").alias(name), F.col("root").alias("_root")), name, "left").withColumn("_root", F.coalesce("_root", name))
    named = written(named)
    sizes = named.groupBy(group, "_root").agg(F.sum(weight).alias("_n"))
    of = sizes.groupBy(group).agg(F.max_by("_root", F.struct("_n", "_root")).alias("_main"), F.sum("_n").alias("_all"), F.max("_n").alias("_most")).filter("_all > _most")
    chunks = [F.ceil(x / most).cast("int").alias(c) for x, c in ((F.col("_all"), "_chunks"), (F.col("_all") - F.col("_most"), "_asked"))]
    dealt = named.join(sized_broadcast(written(of.select(group, "_main", *chunks)), LARGE_GROUPS), group)
    spread = lambda c: F.pmod(F.xxhash64(name), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    asks = dealt.filter("_root <> _main").withColumns({"_i": spread("_asked"), "asks": F.lit(True)}).withColumn("_c", every("_chunks"))
    others = dealt.withColumns({"_c": spread("_chunks"), "asks": F.lit(False)}).withColumn("_i", every("_asked"))
    return asks.unionByName(others).select(*rows.columns, (F.col("_i").cast("long") * F.col("_chunks") + F.col("_c")).alias("part"), "asks")


def _exact_links(sets: DataFrame) -> DataFrame:
    """(a, b): links that connect the components of the blocks of (sig, grams, root)."""
    weight = F.octet_length("grams") / 8
    pivot = F.struct("sig", "grams")
    large = written(sets.groupBy("root").agg(F.sum(weight).alias("_all"), F.array(*[F.min_by(pivot, F.xxhash64("sig", F.lit(i))) for i in range(PIVOTS)]).alias("pivots")).filter(F.col("_all") > BLOCK_CHUNK))
    if not large.limit(1).count():
        return sets.groupBy("root").applyInArrow(_block_links, "a long, b long")
    roots = sized_broadcast(large.select("root"), LARGE_GROUPS)
    links = sets.join(roots, "root", "left_anti").groupBy("root").applyInArrow(_block_links, "a long, b long")
    rows = sets.join(sized_broadcast(large.select("root", "pivots"), LARGE_BLOCKS), "root")
    found = written(rows.select("sig", "grams", "pivots").mapInArrow(_pivot_links, "a long, b long"))
    rest = _rest(sets.join(roots, "root", "left_semi"), "root", "sig", weight, BLOCK_CHUNK, components(found))
    return links.union(found).union(rest.groupBy("root", "part").applyInArrow(_rest_links, "a long, b long"))


def _classes_named(docs: DataFrame, text: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, sig, sketch) of every row, and (sig, copies, component, root) of every class: its component's smallest id and a name of the component."""
    spark = docs.sparkSession
    bound_batches(spark)
    body = docs.select(F.col(f"`{key}`").alias("doc_id"), text_of(f"`{text}`").alias("_text"))
    only_text = body.select("_text")
    parts = partitions(docs)

    schema = T.StructType([body.schema["doc_id"], T.StructField("n_shingles", T.LongType()), T.StructField("sig", T.LongType()), T.StructField("sketch", T.BinaryType())])
    rows = written(body.mapInArrow(_classes, schema))
    classes = written(rows.filter("sig IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("first_id"), F.any_value("sketch").alias("sketch"), F.count("*").alias("copies")))

    shards = 4 * parts
    frequent = only_text.mapInArrow(_frequency_parts(shards), "shard int, grams binary, counts binary").repartition(parts, "shard").mapInArrow(_frequent, "gram long, df long")
    top = frequent.orderBy(F.desc("df"), "gram").limit(HOT_ROWS).collect()  # at most HOT_ROWS pairs of numbers
    sorted_ = lambda x: np.sort(np.array(x, np.int64)).astype(np.uint64)
    hot = spark.sparkContext.broadcast((sorted_([r["gram"] for r in top]), sorted_([r["gram"] for r in top if r["df"] >= WIDE])))

    posted = only_text.mapInArrow(_postings(shards, hot), "shard int, grams binary, sigs binary, sizes binary")
    lists = written(posted.repartition(parts, "shard").mapInArrow(_lists, _LISTS))

    sketches = classes.select(F.col("sig").alias("a"), F.col("sketch").alias("sketch"))
    members = written(lists.filter("list IS NOT NULL").select("list", "a", "na").distinct())
    pivot = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("b"), F.col("na").alias("nb"))
    pivots = members.groupBy("list").agg(F.min(pivot).alias("_first"), F.min_by(pivot, F.xxhash64("a", F.lit(1))).alias("_second"))
    asked = members.join(sized_broadcast(pivots, LARGE_GROUPS), "list").select("a", "na", F.explode(F.array("_first", "_second")).alias("_pivot")).select("a", "na", "_pivot.*")
    # of the pivots of all its lists, a class is paired with those of least hash: most classes of a family share them
    fits = asked.filter("a <> b AND 4 * least(na, nb) >= 3 * greatest(na, nb)").groupBy("a", "na").agg(F.slice(F.sort_array(F.collect_set(F.struct("h", "b", "nb"))), 1, PIVOTS).alias("_least"))
    pairs = lists.filter("list IS NULL").select("a", "na", "b", "nb").union(fits.select("a", "na", F.explode("_least").alias("_pivot")).select("a", "na", "_pivot.b", "_pivot.nb"))
    left, right = (sketches.select(F.col("a").alias(x), F.col("sketch").alias(f"sketch_{x}")) for x in "ab")
    close = pairs.distinct().join(left, "a").join(right, "b").select("a", "na", "sketch_a", "b", "nb", "sketch_b").mapInArrow(_close_pairs, "a long, b long")
    blocks = components(close)
    rest = _rest(members, "list", "a", F.lit(1), LIST_CHUNK, blocks).join(sketches, "a")
    more = written(rest.groupBy("list", "part").applyInArrow(_rest_forest, "a long, b long"))
    if more.limit(1).count():
        blocks = components(blocks.select(F.col("vertex").alias("a"), F.col("root").alias("b")).union(more))

    count = blocks.count()
    if count:
        bitmap = spark.sparkContext.broadcast(_bitmap(blocks, count))
        sets = only_text.mapInArrow(_sets_in(bitmap), "sig long, grams binary").join(blocks.withColumnRenamed("vertex", "sig"), "sig").dropDuplicates(["sig"])
        links = components(_exact_links(written(sets)))
        named = links.join(classes.select("sig", "first_id"), F.col("vertex") == F.col("sig"))
        lowest = named.groupBy("root").agg(F.min("first_id").alias("component"))
        class_of = classes.join(links.join(lowest, "root").select(F.col("vertex").alias("sig"), "component", "root"), "sig", "left").select("sig", "copies", F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("component")).alias("component"), F.coalesce("root", "sig").alias("root"))
    else:
        class_of = classes.select("sig", "copies", F.col("first_id").alias("component"), F.col("sig").alias("root"))
    return rows, written(class_of)


def _with_classes(rows: DataFrame, named: DataFrame, total: int) -> DataFrame:
    """rows (with sig) and the component and root of their classes; null for empty sets."""
    heavy = F.broadcast(named.filter(F.col("copies") * HEAVY > total).select("sig", "component", "root"))  # fewer than HEAVY rows
    light = named.filter(F.col("copies") * HEAVY <= total).select("sig", "component", "root")
    return rows.join(heavy, "sig").unionByName(rows.join(heavy, "sig", "left_anti").join(light, "sig", "left"))


def _labelled(rows: DataFrame, named: DataFrame) -> DataFrame:
    out = _with_classes(rows.select("doc_id", "n_shingles", "sig"), named, rows.count())
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def similar_components(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    return _labelled(*_classes_named(docs, text, key))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text) with the text's signature in place of the text; null for an empty set."""
    for batch in batches:
        names = [signature(g) if len(g) else None for g in sets_of(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.int64())], ["_row", "sig"])


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each component stays, that of the smallest id.

    A row without an id stays if its component has no id and it is the first of its rows (as
    JSON text), or if its set is empty.  Of several rows of one kept id the first as JSON text
    stays.
    """
    rows, classes = _classes_named(docs, text, key)
    named = written(_labelled(rows, classes))
    kept = named.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("_copies"), F.bool_or(F.col("doc_id") == F.col("component_id")).alias("_first")).filter("_first")
    once = sized_broadcast(kept.select(F.col("doc_id").alias("_kept"), "_copies"))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{key}`").alias("_own"))
    joined = row.join(once, row["_own"] == once["_kept"])
    single = joined.filter("_copies = 1").select("_row")
    if kept.filter("_copies > 1").limit(1).count():
        single = single.unionByName(joined.filter("_copies > 1").groupBy("_own").agg(F.min_by("_row", F.to_json("_row")).alias("_row")).select("_row"))
    bare = docs.filter(F.col(f"`{key}`").isNull())
    if bare.limit(1).count():
        source = bare.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), text_of(f"`{text}`").alias("_text"))
        signed = source.mapInArrow(_signed, T.StructType([source.schema["_row"], T.StructField("sig", T.LongType())]))
        found = written(_with_classes(signed, classes, rows.count()))
        alone = found.filter("sig IS NOT NULL AND component IS NULL").groupBy("root").agg(F.min_by("_row", F.to_json("_row")).alias("_row")).select("_row")
        single = single.unionByName(found.filter("sig IS NULL").select("_row")).unionByName(alone)
    return single.select("_row.*")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"))
