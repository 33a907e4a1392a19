"""Names: normalising, token overlap and string likeness."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

# Club-type words that sources add and leave out freely, and letters that
# Unicode does not decompose.
AFFIXES = (
    "fc", "afc", "cfc", "cf", "sc", "ac", "ss", "ssc", "us", "usc", "as",
    "rc", "sd", "cd", "ud", "rcd", "sv", "tsv", "tsg", "vfb", "vfl", "bsc",
    "bv", "fsv", "sk", "fk", "nk", "hc", "cp", "club", "calcio", "kv", "rkc",
)
TRANSLITERATE = {"ø": "o", "đ": "d", "ð": "d", "ł": "l", "ı": "i", "þ": "th", "æ": "ae", "œ": "oe", "ß": "ss"}


def _accents() -> tuple[str, str]:
    """Lower-case letters of the Latin blocks that decompose to one plain letter, and those letters."""
    pairs = []
    for point in range(0xC0, 0x250):
        c = chr(point).lower()
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(c) == 1 and len(plain) == 1 and plain != c and plain.isascii():
            pairs.append((c, plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _accents()


def fold(col: Column) -> Column:
    """Lower case without accents; letters beyond the Latin blocks stay."""
    out = F.translate(F.lower(col), _FROM, _TO)
    for letter, plain in TRANSLITERATE.items():
        out = F.replace(out, F.lit(letter), F.lit(plain))
    return F.regexp_replace(out, r"\p{M}", "")


def tokens(col: Column) -> Column:
    """Words of a name: folded, & as and, apostrophes left out, other punctuation as blanks."""
    out = F.replace(fold(col), F.lit("&"), F.lit(" and "))
    out = F.regexp_replace(out, "['’ʼ]", "")
    out = F.regexp_replace(out, r"[^\p{L}\p{N}_\s]", " ")
    return F.filter(F.split(out, r"\s+"), lambda t: t != "")


def normalize_name(col: Column) -> Column:
    """Comparison key of a club name: words without affixes (all words if there are only such); numbers stay."""
    words = tokens(col)
    kept = F.filter(words, lambda t: ~t.isin(*AFFIXES))
    return F.array_join(F.when(F.size(kept) > 0, kept).otherwise(words), " ")


def token_set_ratio(a: Column, b: Column) -> Column:
    """Jaccard of the words of two names; numbers weigh 0.3."""
    return token_ratio(F.array_distinct(tokens(a)), F.array_distinct(tokens(b)))


def token_ratio(x: Column, y: Column) -> Column:
    """`token_set_ratio` of names whose distinct words are given."""
    weigh = lambda words: F.aggregate(words, F.lit(0.0), lambda s, t: s + F.when(t.rlike("^[0-9]+$"), 0.3).otherwise(1.0))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(weigh(F.array_intersect(x, y)) / weigh(F.array_union(x, y)))


def word_weight(word: str) -> float:
    return 0.3 if re.fullmatch("[0-9]+", word) else 1.0


def token_ratio_value(x: list[str], y: list[str]) -> float:
    """`token_ratio` of two lists of distinct words, summed in its order."""
    common = whole = 0.0
    for t in x:
        common += word_weight(t) if t in y else 0.0
    for t in (*x, *(t for t in y if t not in x)):
        whole += word_weight(t)
    return common / whole if x and y else 0.0


#: Pairs that are compared together.
PAIRS = 4096


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words, padded, and their lengths."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    out = np.zeros((len(words), max(1, size.max(initial=0))), np.uint32)
    out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out, size


def jaro_array(a: list[str], b: list[str]) -> np.ndarray:
    """Jaro similarity of pairs: letters within half the longer length match once each; two matches out of order are one transposition."""
    x, m = _codes(a)
    y, n = _codes(b)
    rows, place = np.arange(len(a)), np.arange(y.shape[1])
    reach = np.maximum(m, n) // 2 - 1
    used, hit = np.zeros(y.shape, bool), np.zeros(x.shape, bool)
    for i in range(x.shape[1]):
        near = (np.abs(place - i) <= reach[:, None]) & (place < n[:, None]) & (i < m)[:, None]
        ok = near & (y == x[:, i : i + 1]) & ~used
        first = ok.argmax(1)
        hit[:, i] = ok[rows, first]
        used[rows[hit[:, i]], first[hit[:, i]]] = True
    matches = hit.sum(1)
    left, right = np.zeros((len(a), x.shape[1]), np.uint32), np.zeros((len(a), x.shape[1]), np.uint32)
    for out, codes, mask in ((left, x, hit), (right, y, used)):
        row, col = np.nonzero(mask)
        out[row, (np.cumsum(mask, 1) - 1)[row, col]] = codes[row, col]
    swapped = (left != right).sum(1) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where(matches > 0, (matches / m + matches / n + (matches - swapped) / matches) / 3, 0.0)
    same = np.fromiter((p == q for p, q in zip(a, b, strict=True)), bool, len(a))
    return np.where(same, 1.0, score)


def jaro_winkler_array(a: list[str], b: list[str], scale: float = 0.1) -> np.ndarray:
    score = jaro_array(a, b)
    prefix, alike = np.zeros(len(a)), np.ones(len(a), bool)
    for k in range(4):
        alike &= np.fromiter((p[k : k + 1] == q[k : k + 1] != "" for p, q in zip(a, b, strict=True)), bool, len(a))
        prefix += alike
    return score + prefix * scale * (1 - score)


#: Bits of places that `Packed` keeps, in numbers.
KEPT = 1 << 23


class Packed:
    """Names that one name at a time is compared with: `jaro_winkler_array` of it and each of them.

    The places of a letter in each name are the bits of a number, so a letter of the other name meets all
    names in a few array operations.  Names are best given in order of length and letters, as what
    their common beginnings have met is kept.
    """

    def __init__(self, names: list[str]):
        self.codes, self.size = _codes(names)
        width = self.codes.shape[1]
        self.kind = np.uint32 if width <= 32 else np.uint64 if width <= 64 else object
        bits = np.array([1 << k for k in range(width)], self.kind)
        self.inside = np.arange(width) < self.size[:, None]
        self.letters = {int(c): ((self.codes == c) & self.inside).astype(self.kind) @ bits for c in np.unique(self.codes[self.inside])}
        self.sizes, self.of = np.unique(self.size, return_inverse=True)
        self.all = np.full(len(names), (1 << width) - 1, self.kind)
        self.m, self.beginning = -1, None

    def _within_reach(self, m: int, i: int) -> np.ndarray:
        """Bits of the places that letter i of a name of m letters may match."""
        reach = [max(m, n) // 2 - 1 for n in self.sizes.tolist()]
        spans = [(max(i - r, 0), min(i + r, n - 1)) for r, n in zip(reach, self.sizes.tolist(), strict=True)]
        return np.array([(1 << high + 1) - (1 << low) if low <= high else 0 for low, high in spans], self.kind)[self.of]

    def _meet(self, name: str) -> None:
        """After it: free and matches after each letter of name, hit by each letter."""
        if len(name) != self.m:
            self.m, self.met = len(name), ""
            self.reach, self.near = [self._within_reach(self.m, i) for i in range(self.m)], {}
            self.free, self.matches = [self.all], [np.zeros(len(self.size), np.uint8 if self.codes.shape[1] < 256 else np.int64)]
            # a bound for each length, prefix and number of matches
            length, prefix, matches = (x.ravel() for x in np.meshgrid(self.sizes, np.arange(5.0), np.arange(self.codes.shape[1] + 1), indexing="ij"))
            self.table, self.beginning = self._scored(matches, 0, self.m, length, prefix), None
            self.hit = np.zeros((self.m, len(self.size)), bool)
        same = next((i for i, (x, y) in enumerate(zip(name, self.met, strict=False)) if x != y), len(self.met))
        del self.free[same + 1 :], self.matches[same + 1 :]
        for i in range(same, self.m):
            c = ord(name[i])
            if c not in self.letters:
                self.hit[i] = False
                self.free.append(self.free[i])
                self.matches.append(self.matches[i])
                continue
            if (i, c) not in self.near:
                if len(self.near) * len(self.size) > KEPT:
                    self.near.clear()
                self.near[i, c] = self.letters[c] & self.reach[i]
            met = self.near[i, c] & self.free[i]
            first = met & -met
            np.not_equal(first, 0, out=self.hit[i])
            self.free.append(self.free[i] ^ first)
            self.matches.append(self.matches[i] + self.hit[i])
        self.met = name
        if self.beginning != name[:4]:
            self.beginning, alike, self.prefix = name[:4], np.ones(len(self.size), bool), np.zeros(len(self.size))
            for k, c in enumerate(name[:4]):
                alike = alike & (self.inside[:, k] & (self.codes[:, k] == ord(c)) if k < self.codes.shape[1] else False)
                self.prefix += alike
            self.place = (self.of * 5 + self.prefix.astype(np.int64)) * (self.codes.shape[1] + 1)

    def _scored(self, matches: np.ndarray, swapped: np.ndarray | int, m: np.ndarray | int, size: np.ndarray, prefix: np.ndarray, scale: float = 0.1) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.where((matches > 0) & (matches <= np.minimum(size, m)), (matches / m + matches / size + (matches - swapped) / matches) / 3, 0.0)
        score = np.where((m < 2) & (size == m) & (prefix == m), 1.0, score)  # no letter is within reach of another
        return score + prefix * scale * (1 - score)

    def bounds(self, name: str) -> np.ndarray:
        """What the scores would be if all matches were in order."""
        self._meet(name)
        return self.table[self.place + self.matches[-1]]

    def pairs(self, name: str, which: np.ndarray) -> tuple:
        """What `scores` takes of name and some of the names."""
        self._meet(name)
        letters = np.broadcast_to(np.fromiter(map(ord, name), np.uint32, self.m), (len(which), self.m))
        return self.m, which, self.matches[-1][which], self.prefix[which], self.free[-1][which], letters[self.hit[:, which].T]

    def scores(self, pairs: list[tuple]) -> list[np.ndarray]:
        """The scores of pairs."""
        count = [len(p[1]) for p in pairs]
        m, (which, matches, prefix, free, left) = np.repeat([p[0] for p in pairs], count), (np.concatenate([p[k] for p in pairs]) for k in range(1, 6))
        place = np.arange(self.codes.shape[1]).astype(self.kind)
        taken = ((self.all[which] ^ free)[:, None] >> place & 1).astype(bool)
        apart = np.concatenate([[0], np.cumsum(left != self.codes[which][taken])])  # as many letters of both for each pair
        matches = matches.astype(np.int64)
        end = np.cumsum(matches)
        return np.split(self._scored(matches, (apart[end] - apart[end - matches]) // 2, m, self.size[which], prefix), np.cumsum(count)[:-1])


def jaro_value(a: str, b: str) -> float:
    return float(jaro_array([a], [b])[0])


def jaro_winkler_value(a: str, b: str, scale: float = 0.1) -> float:
    return float(jaro_winkler_array([a], [b], scale)[0])


def _in_batches(a: pd.Series, b: pd.Series, compare) -> pd.Series:
    """compare of the pairs, those of like length together; null beside a null."""
    x, y = a.to_numpy(object), b.to_numpy(object)
    known = np.flatnonzero((a.notna() & b.notna()).to_numpy())
    length = np.fromiter((len(x[k]) + len(y[k]) for k in known), np.int64, len(known))
    known = known[length.argsort(kind="stable")]
    out = np.full(len(x), np.nan)
    for k in range(0, len(known), PAIRS):
        own = known[k : k + PAIRS]
        out[own] = compare(x[own].tolist(), y[own].tolist())
    return pd.Series(out)


@pandas_udf(DoubleType())
def jaro(a: pd.Series, b: pd.Series) -> pd.Series:
    return _in_batches(a, b, jaro_array)


@pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro with a bonus for up to four equal first letters, at any score."""
    return _in_batches(a, b, jaro_winkler_array)


def snake_case(name: str) -> str:
    """A column name in lower case words and underscores."""
    out = re.sub(r"[^0-9A-Za-z]+", "_", name.strip())
    out = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", out)
    return re.sub(r"_+", "_", out).strip("_").lower()


def game_id(day: Column, home: Column, away: Column) -> Column:
    """A game's identifier: day in seconds, home and away side."""
    key = lambda c: F.regexp_replace(F.lower(c), " ", "_")
    return F.concat_ws("---", F.unix_timestamp(day.cast("timestamp")).cast("string"), key(home), key(away))


def season_of(day: Column, first_month: int = 7) -> Column:
    """'2023-24' for days from July 2023 to June 2024."""
    start = F.year(day) - F.when(F.month(day) >= first_month, 0).otherwise(1)
    return F.concat(start.cast("string"), F.lit("-"), F.lpad(F.pmod(start + 1, F.lit(100)).cast("string"), 2, "0"))
