"""Line-first quality rules.

Method: every line of a text is judged by itself.  A line fails if it is navigation
(pipes and other symbols between words, or a row of names and numbers), boilerplate (a known notice), shouting, a run of
the same word, or a longer line without punctuation.  Failed lines are taken out,
and a document that loses more than MAX_LOST of its words is rejected.  Before that the
base counts of a text decide: under 50 words or more than half of its words in repeated
3-word windows.

Notices are short phrases of legal, cookie and subscription lines in four languages; a line
that holds one fails.  All counts come from array operations over the bytes of whole texts
(see _text).

Cases: null text has no words and fails the base; so does an empty text.  A text of any
length is read whole.  Repeated rows get equal results; a text that
loses just MAX_LOST of its words stays.  Lines are what `\\n` splits.
Extra columns stay out unless named in `keep`; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfield.llm._spark import bound_batches, fresh, table, text_of
from tallyfield.llm._text import mix, pieces, shingle_hashes, span_hashes, words

#: Share of a text's words that may be lost with failed lines.
MAX_LOST = 0.3
#: A line with more symbols than this share of its words is navigation or markup.
MAX_SYMBOLS = 0.25
#: A line of at least 3 words, more than this share of them in capitals, shouts.
MAX_CAPITALS = 0.5
#: A line of at least 6 words, more than this share of them equal to the word before, is a run.
MAX_RUN = 0.3
#: A line of at least so many words must hold one that ends with punctuation.
PUNCTUATION_WORDS = 12
#: Notices that make a line boilerplate (compared in lower case, accents included).
NOTICES = tuple(
    notice.encode()
    for notice in (
        # English
        "all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "uses cookies", "enable javascript", "licensed under", "sign in to", "subscribe to our", "share on facebook", "lorem ipsum", "general public license", "apache license", "creative commons", "click here", "powered by",
        # German
        "alle rechte vorbehalten", "datenschutzerkl\u00e4rung", "allgemeine gesch\u00e4ftsbedingungen", "verwendet cookies", "javascript aktivieren", "unseren newsletter",
        # French
        "tous droits r\u00e9serv\u00e9s", "politique de confidentialit\u00e9", "conditions d'utilisation", "utilise des cookies", "activer javascript",
        # Spanish
        "todos los derechos reservados", "pol\u00edtica de privacidad", "aviso legal", "utiliza cookies", "activar javascript",
    )
)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER_CASE = np.zeros(256, bool)
_LOWER_CASE[97:123] = True
#: Characters that end a sentence, a clause or a quotation.
PUNCTUATION = ".!?:;\"')]}\u2026\u201d\u201c\u2019\u00bb\u3002\uff01\uff1f\u061f\u0964"
_ENDS = [np.array(sorted(int.from_bytes(c.encode(), "big") for c in PUNCTUATION if len(c.encode()) == size), np.int64) for size in (1, 2, 3)]
#: A line of at least so many words, each with a capital or a digit first and none with punctuation last, is navigation.
MENU_WORDS = 6
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = _CAPITAL[48:58] = True

COLUMNS = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()), ("base_failed", T.BooleanType()), ("kept", T.BooleanType()), ("n_lines", T.LongType()), ("n_failed_lines", T.LongType()), ("n_lost_words", T.LongType())]


def _sums(mask: np.ndarray) -> np.ndarray:
    out = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def _stops(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether each word's last character, as a whole, is punctuation."""
    code, out = np.zeros(len(end), np.int64), np.zeros(len(end), bool)
    for k, known in enumerate(_ENDS):  # the last byte, the last two, the last three
        inside = end - 1 - k >= start
        code += np.where(inside, data[np.maximum(end - 1 - k, 0)].astype(np.int64), 0) << (8 * k)
        out |= inside & np.isin(code, known)
    return out


def _folded(data: np.ndarray) -> bytes:
    """Bytes in lower case: A-Z, and the capitals of Western European letters with accents."""
    low = np.frombuffer(data.tobytes().lower(), np.uint8).copy()
    accents = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)
    low[1:][accents] += 0x20
    return low.tobytes()


def _repeated(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order that sorts key, whether each sorted entry equals the one before)."""
    order = np.argsort(key, kind="stable")
    got = key[order]
    same = np.zeros(len(key), bool)
    same[1:] = got[1:] == got[:-1]
    return order, same


def judge(data: np.ndarray, offsets: np.ndarray, max_lost: float = MAX_LOST) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Counts and verdicts of the rows of one piece; then line starts, line ends and which lines failed."""
    rows = len(offsets) - 1
    start, end, first = words(data, offsets)
    n_words = np.diff(first)
    hashes = span_hashes(data, start, end)
    row_of_word = np.repeat(np.arange(rows), n_words)

    letters = _sums((data & 0xC0) != 0x80)
    word_chars = np.bincount(row_of_word, letters[end] - letters[start], rows).astype(np.int64)
    symbols = _sums(_SYMBOL[data])
    n_symbols = symbols[offsets[1:]] - symbols[offsets[:-1]]

    # lines: a row of k line feeds has k + 1 lines
    feed = np.flatnonzero(data == 10)
    feed_row = np.searchsorted(offsets, feed, "right") - 1
    line_start = np.sort(np.concatenate([offsets[:-1], feed + 1]), kind="stable")
    line_end = np.sort(np.concatenate([offsets[1:], feed]), kind="stable")
    per_row = np.bincount(feed_row, minlength=rows) + 1
    line_row = np.repeat(np.arange(rows), per_row)
    # a row's own bounds keep starts and ends in step, also for empty rows
    word_low, word_high = np.searchsorted(start, line_start), np.searchsorted(start, line_end)
    in_line = word_high - word_low

    spoken = np.flatnonzero(in_line > 0)
    key = mix(span_hashes(data, line_start[spoken], line_end[spoken]) + mix(line_row[spoken].astype(np.uint64) + np.uint64(1)))
    order, same = _repeated(key)
    n_dup_lines = np.bincount(line_row[spoken][order[same]], minlength=rows)

    tri = shingle_hashes(hashes, 3)
    inside = np.zeros(len(tri), bool)
    if len(tri):
        inside = row_of_word[: len(tri)] == row_of_word[2:]
    at = np.flatnonzero(inside)
    order, same = _repeated(mix(tri[at] + mix(row_of_word[at].astype(np.uint64) + np.uint64(1))))
    twice = same.copy()
    twice[:-1] |= same[1:]
    cover = np.zeros(len(start), bool)
    hit = at[order[twice]]
    for k in range(3):
        cover[hit + k] = True
    n_repeat = np.bincount(row_of_word[cover], minlength=rows)

    upper, lower = _sums(_UPPER[data]), _sums(_LOWER_CASE[data])
    capital = _sums((upper[end] - upper[start] >= 2) & (lower[end] == lower[start]))
    again = np.zeros(len(start), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    run, stops = _sums(again), _sums(_stops(data, start, end))
    fail = np.zeros(len(line_start), bool)
    s, w = spoken, in_line[spoken]
    fail[s] = symbols[line_end[s]] - symbols[line_start[s]] > MAX_SYMBOLS * w
    fail[s] |= (w >= 3) & (capital[word_high[s]] - capital[word_low[s]] > MAX_CAPITALS * w)
    fail[s] |= (w >= 6) & (run[word_high[s]] - run[word_low[s] + 1] > MAX_RUN * w)
    fail[s] |= (w >= PUNCTUATION_WORDS) & (stops[word_high[s]] == stops[word_low[s]])
    named = _sums(_CAPITAL[data[start]])
    fail[s] |= (w >= MENU_WORDS) & (named[word_high[s]] - named[word_low[s]] == w) & (stops[word_high[s]] == stops[word_low[s]])
    low = _folded(data)
    for notice in NOTICES:
        k = low.find(notice)
        while k >= 0:
            line = int(np.searchsorted(line_end, k, "right"))  # the first line that ends after k
            if line_start[line] <= k and k + len(notice) <= line_end[line]:
                fail[line] = True
            k = low.find(notice, k + 1)

    lost = np.bincount(line_row[fail], in_line[fail], rows).astype(np.int64)
    base_failed = (n_words < 50) | (100 * n_repeat > 50 * n_words)
    kept = ~base_failed & (lost <= max_lost * n_words)
    counts = dict(n_words=n_words, word_chars=word_chars, n_symbols=n_symbols, n_dup_lines=n_dup_lines, n_repeat_words=n_repeat, base_failed=base_failed, kept=kept, n_lines=per_row, n_failed_lines=np.bincount(line_row[fail], minlength=rows), n_lost_words=lost)
    return counts, line_start, line_end, fail


def apply_rules(docs: DataFrame, text: str = "text", keep: list[str] | None = None, clean: bool = False, max_lost: float = MAX_LOST) -> DataFrame:
    """The columns `keep`, the counts and verdicts of COLUMNS and, with clean=True, clean_text: the text without its failed lines."""
    bound_batches(docs.sparkSession)
    keep = ["doc_id"] if keep is None else keep
    source = docs.select(*[F.col(f"`{c}`") for c in keep], text_of(f"`{text}`").alias(fresh(docs, "_text")))
    schema = T.StructType([source.schema[c] for c in keep] + [T.StructField(n, t) for n, t in COLUMNS] + [T.StructField("clean_text", T.StringType())] * clean)
    names = [n for n, _ in COLUMNS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in pieces(batch.column(len(keep))):
                counts, line_start, line_end, fail = judge(data, offsets, max_lost)
                arrays = [c.slice(a, b - a) for c in batch.columns[: len(keep)]]
                arrays += [pa.array(counts[n], pa.bool_() if n in ("base_failed", "kept") else pa.int64()) for n in names]
                if clean:
                    ends = np.cumsum(counts["n_lines"])
                    body, texts = data.tobytes(), []
                    for low, high in zip(ends - counts["n_lines"], ends, strict=True):
                        texts.append(b"\n".join(body[line_start[k] : line_end[k]] for k in range(low, high) if not fail[k]).decode())
                    arrays.append(pa.array(texts, pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return source.mapInArrow(run, schema)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents"))
