"""Byte-level BPE encoding and decoding by the ranks of a public vocabulary.

Method: the distinct pre-tokens of a block of texts are laid out as padded numpy
matrices, bucketed by length.  In each round every row merges its leftmost pair of
minimum rank; pair ranks come from an open-addressing hash table, and each merge deletes
one column entry of the row, so matrices stay rectangular and shrink by one column a
round.  Rows without a pair of the vocabulary are done and leave the matrix.

A row over WIDE_BYTES is a bucket by itself.  Its rounds are the same, but a round takes all
pairs of the minimum rank from left to right at once, up to the first whose merge makes a
pair of the same or a lower rank beside it: so far, one merge a round would do the same.
It has as many rounds as ranks occur, not as many as merges, so its time is not quadratic.

Cases: null text is empty; an empty text has no tokens and the digests of no bytes; very
long texts are cut nowhere; repeated rows are each encoded; extra columns are ignored by
`encode_table` unless named in `keep`; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfield.llm._spark import bound_batches, fresh, table, text_of

#: Pre-tokens over this many bytes are rows by themselves.
WIDE_BYTES = 256
#: Distinct pre-tokens that one worker keeps encoded before it starts afresh.
CACHE_WORDS = 300_000
#: Characters of text that are pre-tokenised before the matrices run.
BLOCK_CHARS = 1 << 20
#: Entries of one matrix at most.
MATRIX_CELLS = 1 << 21
NO_PAIR = np.int32(2**31 - 1)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class _Slots(dict):
    """word -> number of the word; new words are numbered in order of arrival."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class ByteBPE:
    """Encoder and decoder for one rank file; ids must be below 2**16."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        if max(ranks.values()) >= 1 << 16:
            raise ValueError("pair keys hold ids below 65536")
        self.findall = regex.compile(pattern).findall
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        size = max(ranks.values()) + 1
        self.token_len = np.zeros(size, np.int64)
        for token, rank in ranks.items():
            self.token_len[rank] = len(token)
        self.token_start = np.concatenate([[0], np.cumsum(self.token_len)])
        flat = bytearray(int(self.token_start[-1]))
        for token, rank in ranks.items():
            flat[self.token_start[rank] : self.token_start[rank] + len(token)] = token
        self.token_bytes = np.frombuffer(bytes(flat), np.uint8)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 16 | b] = rank
        self._fill(pairs)
        self._restart()

    def _fill(self, pairs: dict[int, int]) -> None:
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NO_PAIR, np.int32)
        left = np.fromiter(pairs, np.int64, len(pairs))
        rank = np.fromiter(pairs.values(), np.int32, len(pairs))
        at = self._slot(left)
        while len(left):
            free = self.keys[at] == -1
            self.keys[at[free]] = left[free]  # of several for one slot the last stays
            won = self.keys[at] == left
            self.values[at[won]] = rank[won]
            left, rank, at = left[~won], rank[~won], (at[~won] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merged pair, NO_PAIR if it is none or a side is padding (-1)."""
        key = (a.astype(np.int64) << 16) | b.astype(np.int64)
        out = np.full(len(key), NO_PAIR, np.int32)
        ask = np.flatnonzero((a >= 0) & (b >= 0))
        at = self._slot(key[ask])
        while len(ask):
            found = self.keys[at]
            hit = found == key[ask]
            out[ask[hit]] = self.values[at[hit]]
            go = ~hit & (found != -1)
            ask, at = ask[go], (at[go] + 1) & ((1 << self.bits) - 1)
        return out

    def _matrix(self, words: list[bytes], width: int) -> list[np.ndarray]:
        """Ids of words of at most `width` bytes."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        ids = np.full((len(words), width), -1, np.int32)
        ids[np.arange(width) < lengths[:, None]] = self.byte_id[data]
        out: list[np.ndarray] = [None] * len(words)  # type: ignore[list-item]
        who = np.arange(len(words))
        rank = np.full((len(words), width), NO_PAIR, np.int32)
        if width > 1:
            rank[:, :-1] = self.pair_rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(words), width - 1)
        while len(who):
            best = rank.argmin(1)
            low = rank[np.arange(len(who)), best]
            done = low == NO_PAIR
            if done.any():
                held = (ids[done] >= 0).sum(1)
                for k, row, n in zip(who[done].tolist(), ids[done], held.tolist(), strict=True):
                    out[k] = row[:n].copy()
                keep = ~done
                who, ids, rank, best, low = who[keep], ids[keep], rank[keep], best[keep], low[keep]
                if not len(who):
                    break
            rows, width = np.arange(len(who)), ids.shape[1]
            ids[rows, best] = low
            stay = np.ones(ids.shape, bool)
            stay[rows, best + 1] = False
            ids, rank = ids[stay].reshape(len(who), width - 1), rank[stay].reshape(len(who), width - 1)
            after = np.minimum(best + 1, width - 2)
            rank[rows, best] = np.where(best + 1 <= width - 2, self.pair_rank(ids[rows, best], ids[rows, after]), NO_PAIR)
            left = np.flatnonzero(best > 0)
            rank[left, best[left] - 1] = self.pair_rank(ids[left, best[left] - 1], ids[left, best[left]])
        return out

    def _wide(self, word: bytes) -> np.ndarray:
        """Ids of one wide row; a round merges all leftmost pairs of minimum rank that stay so."""
        ids = self.byte_id[np.frombuffer(word, np.uint8)].copy()
        rank = np.full(len(ids), NO_PAIR, np.int32)
        rank[:-1] = self.pair_rank(ids[:-1], ids[1:])
        while (low := rank.min()) != NO_PAIR:
            at = np.flatnonzero(rank == low)
            # of pairs that overlap every second one is taken
            run = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
            # ids around each merge, those before it already merged; -1 is the edge
            around = np.full(len(ids) + 3, -1, ids.dtype)
            around[1:-2] = ids
            before, after = around[at], around[at + 3]
            before[1:][at[1:] == at[:-1] + 2] = low
            merged = np.full(len(at), low, ids.dtype)
            first = np.flatnonzero((self.pair_rank(before, merged) <= low) | (self.pair_rank(merged, after) <= low))
            at = at[: first[0] + 1] if len(first) else at
            ids[at] = low
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            ids, rank = ids[stay], rank[stay]
            at -= np.arange(len(at))
            around = np.append(ids, np.int32(-1))
            rank[at] = self.pair_rank(ids[at], around[at + 1])
            left = at[at > 0]
            rank[left - 1] = self.pair_rank(ids[left - 1], ids[left])
        return ids

    def _restart(self) -> None:
        self.slots = _Slots()
        self.flat = np.zeros(0, np.int32)
        self.start = np.zeros(1, np.int64)

    def _encode_new(self) -> None:
        """Encode the words numbered since the last call."""
        have = len(self.start) - 1
        new = [w.encode() for w in list(self.slots)[have:]]
        if not new:
            return
        out: list[np.ndarray] = [None] * len(new)  # type: ignore[list-item]
        lengths = np.fromiter(map(len, new), np.int64, len(new))
        for k in np.flatnonzero(lengths > WIDE_BYTES).tolist():
            out[k] = self._wide(new[k])
        low = 0
        for width in (2, 4, 6, 8, 10, 12, 16, 24, 32, 64, WIDE_BYTES):
            rows = np.flatnonzero((lengths > low) & (lengths <= width))
            low = width
            step = max(1, MATRIX_CELLS // width)
            for k in range(0, len(rows), step):
                some = rows[k : k + step].tolist()
                for i, ids in zip(some, self._matrix([new[i] for i in some], width), strict=True):
                    out[i] = ids
        counts = np.fromiter(map(len, out), np.int64, len(out))
        self.flat = np.concatenate([self.flat, *out])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(counts)])

    def encode_batch(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text, in order."""
        k = 0
        while k < len(texts):
            if len(self.slots) > CACHE_WORDS:
                self._restart()
            number, block, chars = self.slots.__getitem__, [], 0
            while k < len(texts) and (not block or chars < BLOCK_CHARS):
                found = self.findall(texts[k])
                block.append(np.fromiter(map(number, found), np.int64, len(found)))
                chars += len(texts[k])
                k += 1
            self._encode_new()
            for word in block:
                yield _ranges(self.flat, self.start[word], self.start[word + 1])

    def decode(self, ids: np.ndarray) -> bytes:
        return _ranges(self.token_bytes, self.token_start[ids], self.token_start[ids + 1]).tobytes()


def _ranges(flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """flat[start:end] of each pair, one after the other."""
    size = end - start
    total = np.cumsum(size)
    if not len(size) or not total[-1]:
        return flat[:0]
    return flat[np.arange(total[-1]) + np.repeat(start - total + size, size)]


@lru_cache(2)
def load(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(path, pattern)


def encode_table(docs: DataFrame, text: str = "text", keep: list[str] | None = None, ids: bool = False, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per row of docs: the columns `keep`, then n_tokens, ids_sha256, decoded_sha256, and with ids=True the ids themselves.

    The vocabulary file is read on each executor, where its package is installed.
    """
    bound_batches(docs.sparkSession)
    keep = ["doc_id"] if keep is None else keep
    new = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())] + [("token_ids", T.ArrayType(T.IntegerType(), False))] * ids
    clash = {n for n, _ in new} & set(keep)
    if clash:
        raise ValueError(f"columns {sorted(clash)} clash with the new ones")
    body = fresh(docs, "_text")
    source = docs.select(*[F.col(f"`{c}`") for c in keep], text_of(f"`{text}`").alias(body))
    schema = T.StructType([source.schema[c] for c in keep] + [T.StructField(n, t) for n, t in new])

    return source.mapInArrow(_encoder(keep, body, ids, vocabulary, pattern), schema)


def _encoder(keep: list[str], body: str, ids: bool, vocabulary: str | None, pattern: str | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary or default_vocabulary(), pattern or default_pattern())
        for batch in batches:
            rows = batch.num_rows
            column = batch.column(batch.schema.get_field_index(body))
            for low in range(0, rows, 512):
                part = batch.slice(low, 512)
                n, digest, decoded, all_ids = [], [], [], []
                for got in bpe.encode_batch(column.slice(low, 512).to_pylist()):
                    n.append(len(got))
                    digest.append(hashlib.sha256(got.astype("<u4").tobytes()).hexdigest())
                    decoded.append(hashlib.sha256(bpe.decode(got)).hexdigest())
                    if ids:
                        all_ids.append(got)
                arrays = [part.column(batch.schema.get_field_index(c)) for c in keep] + [pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(decoded, pa.string())]
                if ids:
                    arrays.append(pa.array(all_ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, [*keep, "n_tokens", "ids_sha256", "decoded_sha256", *["token_ids"] * ids])

    return run


def decode_table(encoded: DataFrame, ids: str = "token_ids", keep: list[str] | None = None, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """The columns `keep` and the decoded bytes (column decoded); null ids give no bytes."""
    keep = ["doc_id"] if keep is None else keep
    source = encoded.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{ids}`").alias("_bpe_ids"))
    schema = T.StructType([source.schema[c] for c in keep] + [T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary or default_vocabulary(), pattern or default_pattern())
        for batch in batches:
            out = [bpe.decode(np.array(x or [], np.int64)) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(out, pa.binary())], [*keep, "decoded"])

    return source.mapInArrow(run, schema)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_table(table(spark, sf_dir, "documents"))
