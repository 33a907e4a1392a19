"""Toxicity by maximum-scoring segments of token log-odds.

Method.  A token's features are the whole word and its first 5, 6 and 7 bytes, in lower
case and without outer punctuation, hashed into FEATURES cells.  The cells' log-odds
between toxic and other training texts are taken with an informative Dirichlet prior (the
cells' share of all training text, worth PRIOR tokens, and half a token each) and drawn to
0 by CONFIDENCE of their standard deviations, so rare words stay at 0.  A
token scores the largest of its features' log-odds less DRIFT, so that texts without toxic
words drift down.  The linear-time scan of Ruzzo and Tompa finds all maximal segments of a
text.  Segment scores S follow an extreme-value law in a text of n tokens: lambda solves
E[exp(lambda s)] = 1 over tokens of other texts, K comes from the median of their largest
segments, and E = K n exp(-lambda S) is the number of such segments expected by chance.
Segments with E <= SIGNIFICANT are passages.  A logistic curve over the largest
lambda S - ln(K n) and the sum of the significant ones gives the score.

Log-odds come from training rows of three remainders of crc32(doc_id) mod 5, the law and
the curve from another; remainder 0 is held out.  Training takes at most TRAIN_ROWS
labelled documents, those of the least hashed ids (of documents with one id, the least text).
What is sent to executors are FEATURES numbers; what comes back are two numbers a labelled
document and a histogram a task.

Cases: null and empty texts have no tokens and get the score of a text without segments;
very long texts are scanned whole; repeated rows get equal scores; rows with a null doc_id
are scored and not held out; extra columns are ignored; an empty table gives no rows;
labels of null are left out; with no labels of one kind all
scores are 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfield.llm._spark import bound_batches, table, text_of, written
from tallyfield.llm._text import lower_table, pieces, span_hashes, words

FEATURES = 1 << 20
TRAIN_ROWS = 20_000
PRIOR = 20_000.0
#: Standard deviations by which log-odds are drawn to 0.
CONFIDENCE = 2.0
DRIFT = 0.05
#: Times that a feature counts at most in one text.
SATURATION = 8
#: Segments expected by chance, at most, for a passage to count.
SIGNIFICANT = 0.001
PREFIXES = (5, 6, 7)
BINS = 400
TRAIN_PARTS = 16

_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of each token, first): a column of cells for the word and for each prefix; -1 where a word has no such prefix."""
    data = lower_table()[data]
    start, end, first = words(data, offsets)
    if len(start):
        # outer punctuation goes by way of the nearest other byte inside the word
        plain = np.flatnonzero(~_PUNCTUATION[data])
        if len(plain):
            a = plain[np.minimum(np.searchsorted(plain, start), len(plain) - 1)]
            z = plain[np.maximum(np.searchsorted(plain, end) - 1, 0)] + 1
            word = (a >= start) & (z <= end) & (a < z)
            start, end = np.where(word, a, start), np.where(word, z, end)
    cells = np.full((len(start), 1 + len(PREFIXES)), -1, np.int32)
    shift = np.uint64(64 - FEATURES.bit_length() + 1)
    cells[:, 0] = span_hashes(data, start, end) >> shift
    for k, size in enumerate(PREFIXES, 1):
        long = np.flatnonzero(end - start > size)
        cells[long, k] = span_hashes(data, start[long], start[long] + size) >> shift
    return cells, first


def segments(score: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, start, end) by the scan of Ruzzo and Tompa."""
    total = np.zeros(len(score) + 1)
    np.cumsum(score, out=total[1:])
    found: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum up to the end, the last one before with a lower sum before
    for p in np.flatnonzero(score > 0).tolist():
        start, end, low, high = p, p + 1, float(total[p]), float(total[p + 1])
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= high:
                found.append((start, end, low, high, j))
                break
            start, low = found[j][0], found[j][2]
            del found[j:]
    return [(high - low, start, end) for start, end, low, high, _ in found]


class Model:
    """Log-odds of the cells, the law of segments and the curve."""

    def __init__(self, odds: np.ndarray):
        self.odds = np.append(odds, np.float32(-np.inf)).astype(np.float32)  # cell -1 is the last
        self.lam, self.log_k, self.curve = 1.0, 0.0, (-50.0, 0.0, 0.0)
        self.level = -math.log(SIGNIFICANT)

    def token_scores(self, cells: np.ndarray) -> np.ndarray:
        best = self.odds[cells[:, 0]]
        for k in range(1, cells.shape[1]):
            best = np.maximum(best, self.odds[cells[:, k]])
        return best.astype(np.float64) - DRIFT

    def statistics(self, score: np.ndarray) -> tuple[float, float, int, tuple[int, int]]:
        """(largest normalised segment, sum of the significant ones, their number, best span) of a text's token scores."""
        found = segments(score)
        if not found:
            return self.none(len(score))
        size = self.log_k + math.log(len(score))
        top = max(found)
        over = [x for x in (self.lam * s[0] - size for s in found) if x >= self.level]
        return self.lam * top[0] - size, sum(over), len(over), (top[1], top[2])

    def none(self, n: int) -> tuple[float, float, int, tuple[int, int]]:
        return -(self.log_k + math.log(max(1, n))), 0.0, 0, (0, 0)

    def probability(self, largest: np.ndarray, total: np.ndarray) -> np.ndarray:
        a, b, c = self.curve
        return 1 / (1 + np.exp(-np.clip(a + b * largest + c * np.log1p(total), -50, 50)))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Saturated counts of the cells in a partition's texts, other texts and then toxic ones, in 16 slices."""
    count = np.zeros((2, FEATURES), np.int32)
    some = False
    for batch in batches:
        toxic = batch.column(1).to_numpy()
        for a, b, data, offsets in pieces(batch.column(0)):
            cells, first = tokens(data, offsets)
            for k in range(b - a):
                own = cells[first[k] : first[k + 1]].ravel()
                got, n = np.unique(own[own >= 0], return_counts=True)
                count[toxic[a + k], got] += np.minimum(n, SATURATION).astype(np.int32)
                some = True
    if some:
        parts = count.reshape(2, 16, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(16), pa.int32()), pa.array([parts[:, k].tobytes() for k in range(16)], pa.binary())], ["part", "data"])


def _add(group: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.int32).astype(np.int64) for x in group.column("data").to_pylist())
    return pa.table({"part": group.column("part").slice(0, 1), "data": pa.array([total.tobytes()], pa.binary())})


def log_odds(other: np.ndarray, toxic: np.ndarray, prior: float = PRIOR, z: float = CONFIDENCE) -> np.ndarray:
    """Log-odds ratio of each cell with an informative Dirichlet prior, drawn to 0 by z standard deviations."""
    both = other + toxic
    share = prior * both / max(1, both.sum()) + 0.5
    part = [np.log(x + share) - np.log(x.sum() + share.sum() - x - share) for x in (toxic, other)]
    ratio, deviation = part[0] - part[1], np.sqrt(1 / (toxic + share) + 1 / (other + share))
    return np.sign(ratio) * np.maximum(0, np.abs(ratio) - z * deviation)


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(text, toxic, fold) of at most `rows` labelled documents that are not held out."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)).cast("int")
    known = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    few = known.withColumn("fold", fold).filter("fold <> 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    rows = docs.join(F.broadcast(few), "doc_id")
    # an id that many documents bear counts once, with the least of its texts
    return rows.groupBy("doc_id").agg(F.min(text_of()).alias("text"), F.first("toxic").alias("toxic"), F.first("fold").alias("fold")).drop("doc_id")


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    bound_batches(docs.sparkSession)
    train = written(training_rows(docs.select("doc_id", "text"), labels, rows).repartition(TRAIN_PARTS))
    counted = train.filter("fold > 1").select("text", "toxic").mapInArrow(_counts, "part int, data binary").groupBy("part").applyInArrow(_add, "part int, data binary").collect()
    count = np.zeros((2, 16, FEATURES // 16), np.int64)
    for r in counted:
        count[:, r["part"]] = np.frombuffer(r["data"], np.int64).reshape(2, -1)
    other, toxic = count.reshape(2, -1)
    if not other.sum() or not toxic.sum():
        return Model(np.zeros(FEATURES))
    model = Model(log_odds(other, toxic))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(n, top) of each text without toxic label: tokens and largest segment; then one row with the histogram of all their token scores."""
        bins = np.zeros(BINS, np.int64)
        for batch in batches:
            n, top = [], []
            for _, _, data, offsets in pieces(batch.column(0)):
                cells, first = tokens(data, offsets)
                score = sent.value.token_scores(cells)
                bins += histogram(score)
                for low, high in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                    n.append(high - low)
                    top.append(max((s[0] for s in segments(score[low:high])), default=0.0))
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(top, pa.float64()), pa.nulls(len(n), pa.list_(pa.int64()))], ["n", "top", "bins"])
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([0.0]), pa.array([bins.tolist()], pa.list_(pa.int64()))], ["n", "top", "bins"])

    held = train.filter("fold = 1").select("text", "toxic")
    got = held.filter("toxic = 0").select("text").mapInArrow(largest, "n long, top double, bins array<bigint>").collect()  # at most `rows` and a row a task
    clean = [(r["n"], r["top"]) for r in got if r["bins"] is None and r["n"]]
    if not clean:
        return Model(np.zeros(FEATURES))
    model.lam, model.log_k = law(np.sum([r["bins"] for r in got if r["bins"] is not None], 0), clean)
    judged = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(toxic, largest, total) of each text."""
        for batch in batches:
            found = []
            for _, _, data, offsets in pieces(batch.column(0)):
                cells, first = tokens(data, offsets)
                score = judged.value.token_scores(cells)
                found += [judged.value.statistics(score[low:high])[:2] for low, high in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], pa.float64())], ["toxic", "largest", "total"])

    rows = held.mapInArrow(measure, "toxic int, largest double, total double").collect()  # at most `rows`
    toxic = np.array([r["toxic"] for r in rows], float)
    if not toxic.any():
        return Model(np.zeros(FEATURES))
    model.curve = curve(np.array([r["largest"] for r in rows]), np.array([r["total"] for r in rows]), toxic)
    return model


def histogram(score: np.ndarray) -> np.ndarray:
    """Token scores from -10 to 10 in steps of 0.05."""
    return np.bincount(np.clip((score + 10) * 20, 0, BINS - 1).astype(np.int64), minlength=BINS)


def law(bins: np.ndarray, largest: list[tuple[int, float]]) -> tuple[float, float]:
    """lambda and ln K of the extreme-value law, from a histogram of token scores and (tokens, largest segment) of texts."""
    middle, share = (np.arange(BINS) + 0.5) / 20 - 10, bins / bins.sum()
    low, high = 1e-3, 5.0
    for _ in range(60):
        lam = (low + high) / 2
        low, high = (low, lam) if (share * np.exp(lam * middle)).sum() > 1 else (lam, high)
    # the median of lambda S - ln n is ln K - ln ln 2
    return low, float(np.median([low * top - math.log(n) for n, top in largest])) + math.log(math.log(2))


def curve(largest: np.ndarray, total: np.ndarray, toxic: np.ndarray, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Logistic weights of 1, largest and ln(1 + total), by Newton steps with a slight ridge."""
    x = np.stack([np.ones(len(largest)), largest, np.log1p(total)], 1)
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(3), x.T @ (p - toxic) + ridge * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def score_table(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, n_tokens, n_passages, passage_start, passage_end (tokens of the best segment)."""
    held_out = F.coalesce(F.pmod(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    body = docs.select(F.col(f"`{key}`").alias("doc_id"), held_out.alias("held_out"), text_of(f"`{text}`").alias("_text"))
    schema = T.StructType([body.schema["doc_id"], body.schema["held_out"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), *[T.StructField(n, T.LongType()) for n in ("n_tokens", "n_passages", "passage_start", "passage_end")]])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            largest, total, n, number, begin, end = ([] for _ in range(6))
            for _, _, data, offsets in pieces(batch.column(2)):
                cells, first = tokens(data, offsets)
                score = model.token_scores(cells)
                some = np.zeros(len(score) + 1, np.int64)
                np.cumsum(score > 0, out=some[1:])
                for low, high in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                    s = model.statistics(score[low:high]) if some[high] > some[low] else model.none(high - low)
                    largest.append(s[0])
                    total.append(s[1])
                    number.append(s[2])
                    begin.append(s[3][0])
                    end.append(s[3][1])
                    n.append(high - low)
            p = model.probability(np.array(largest), np.array(total))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), *[pa.array(v, pa.int64()) for v in (n, number, begin, end)]], schema.names)

    return body.mapInArrow(run, schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_table(docs, fit(docs, table(spark, sf_dir, "labels")))
