"""Team identity: the resolution cascade and fuzzy proposals within a country."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tallyfield.functions.text import Packed, jaro_winkler, normalize_name, token_ratio, token_ratio_value, token_set_ratio, tokens, word_weight
from tallyfield.warehouse.views import Warehouse


def resolve(names: DataFrame, w: Warehouse) -> DataFrame:
    """names (source, raw_name, country) with team_id and method.

    An override wins, then an approved alias as written, then one that is the same when
    normalised and belongs to one team of the country; anything else is unresolved.
    """
    over = w["team_identity_overrides"].select("source", F.col("alias_raw").alias("raw_name"), F.col("team_id").alias("_override")).dropDuplicates(["source", "raw_name"])
    approved = w["team_aliases"].filter("status = 'APPROVED'").join(w["teams"].select("team_id", "country"), "team_id")
    exact = approved.groupBy("source", F.col("alias_raw").alias("raw_name"), "country").agg(F.min("team_id").alias("_exact"), F.count_distinct("team_id").alias("_ne")).filter("_ne = 1").drop("_ne")
    normal = approved.groupBy(normalize_name(F.col("alias_raw")).alias("_key"), "country").agg(F.min("team_id").alias("_normal"), F.count_distinct("team_id").alias("_nn")).filter("_nn = 1").drop("_nn")
    out = names.withColumn("_key", normalize_name(F.col("raw_name"))).join(over, ["source", "raw_name"], "left").join(exact, ["source", "raw_name", "country"], "left").join(normal, ["_key", "country"], "left")
    method = F.when(F.col("_override").isNotNull(), "OVERRIDE").when(F.col("_exact").isNotNull(), "EXACT").when(F.col("_normal").isNotNull(), "NORMALIZED").otherwise("UNRESOLVED")
    return out.select(*names.columns, F.coalesce("_override", "_exact", "_normal").alias("team_id"), method.alias("method"))


def similarity(a, b):
    """(score, method): the better of string and token likeness."""
    jw, ts = jaro_winkler(normalize_name(a), normalize_name(b)), token_set_ratio(a, b)
    return F.greatest(jw, ts).alias("score"), F.when(jw >= ts, "JARO_WINKLER").otherwise("TOKEN_SET").alias("score_method")


#: Letters from rare to common in names; an order for the index, any would do.
RARE = "qxzjkvwyfbghpmucdltosnriea"
#: Weight of a word that is a number, of any other 1 (as in `token_set_ratio`).
NUMBER_WEIGHT = 0.3


def _letters(name: Column) -> Column:
    """The letters of a name as a set: each with its how-manieth occurrence, rare ones and late occurrences first."""
    chars = F.filter(F.split(name, ""), lambda c: c != "")
    nth = F.transform(chars, lambda c, i: F.struct((-F.size(F.filter(F.slice(chars, 1, i + 1), lambda x: x == c))).alias("n"), F.instr(F.lit(RARE), c).alias("rank"), c.alias("letter")))
    return F.transform(F.array_sort(nth), lambda x: F.concat(x["letter"], (-x["n"]).cast("string")))


def index_keys(name: Column, words: Column, least: float) -> Column:
    """Keys of a name: two names that may be alike share one.

    Jaro-Winkler of at least `least` takes an equal first letter, or else Jaro itself of that, which takes
    so many common letters that of either name's letters, in one order for all names, one of the
    first few is common.  A token ratio of at least `least` takes a common word among each one's first
    words, up to where the weight of the others falls below `least` of all.
    """
    letters, n = _letters(name), F.length(name)
    common = F.greatest(F.ceil((3 * least - 2) * n - F.lit(1e-9)), F.lit(1))  # at the greatest difference in length that is left
    of_letters = F.transform(F.slice(letters, 1, F.greatest(n - common + 1, F.lit(0)).cast("int")), lambda t: F.concat(F.lit("L"), t))
    ordered = F.array_sort(F.transform(F.array_distinct(words), lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    weigh = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + F.when(x["t"].rlike("^[0-9]+$"), NUMBER_WEIGHT).otherwise(1.0))
    total = weigh(ordered)
    first = F.filter(F.transform(ordered, lambda x, i: F.struct(x["t"].alias("t"), weigh(F.slice(ordered, i + 1, F.lit(1 << 20))).alias("w"))), lambda x: x["w"] >= least * total - 1e-9)
    return F.concat(F.array(F.concat(F.lit("F"), F.left(name, F.lit(1)))), of_letters, F.transform(first, lambda x: F.concat(F.lit("W"), x["t"])))


#: Parts of a country's names, each compared with all its teams.
SALTS = 32
#: Tasks that pairs are dealt to: names are few and short, so by their bytes they would be one.
PARTS = 200


def candidates(left: DataFrame, right: DataFrame, a: str, b: str, by: str, least: float = 0.80) -> DataFrame:
    """Pairs of rows (all columns of both) of one `by` whose names `a` and `b` may be alike by `least` or more: no pair that is goes missing.

    Names are joined on the keys of an inverted index, each pair at its least common key only.
    What is left is bounded by common letters, lengths and first letters before anything is scored.
    """
    def indexed(df: DataFrame, name: str, side: str) -> DataFrame:
        norm, words = normalize_name(F.col(name)), tokens(F.col(name))
        named = df.filter(F.col(name).isNotNull()).withColumns({f"_n{side}": norm, f"_w{side}": words}).withColumns({f"_l{side}": _letters(F.col(f"_n{side}")), f"_k{side}": F.array_distinct(index_keys(F.col(f"_n{side}"), F.col(f"_w{side}"), least))})
        return named.withColumn("_key", F.explode(f"_k{side}"))

    l, r = indexed(left, a, "a"), indexed(right, b, "b")
    # names of one first letter meet at that; the others at their least common key
    first = l["_key"].startswith("F")
    same = (l[by] == r[by]) & (l["_key"] == r["_key"]) & (first | (F.left("_na", F.lit(1)) != F.left("_nb", F.lit(1))))
    met = l.join(r, same).drop(r[by], r["_key"])
    met = met.filter(F.col("_key").startswith("F") | (F.col("_key") == F.array_min(F.array_intersect("_ka", "_kb"))))
    m, x, y = F.size(F.array_intersect("_la", "_lb")), F.length("_na"), F.length("_nb")
    jaro = F.when(F.col("_na") == F.col("_nb"), 1.0).when(m == 0, 0.0).otherwise((m / x + m / y + 1) / 3)
    prefix = F.aggregate(F.array(*[F.lit(k) for k in range(1, 5)]), F.lit(0), lambda p, k: p + F.when((x >= k) & (F.left("_na", k) == F.left("_nb", k)), 1).otherwise(0))
    bound = jaro + 0.1 * prefix * (1 - jaro)
    hopeful = met.filter((bound >= least - 1e-9) | (token_set_ratio(F.col(a), F.col(b)) >= least - 1e-9))
    return hopeful.drop("_key", *[f"_{c}{side}" for c in "nwlk" for side in "ab"])


@cache
def _rounded(score: float) -> float:
    """As Spark rounds."""
    return float(Decimal(repr(score)).quantize(Decimal("1e-9"), ROUND_HALF_UP))


#: Scores of less distance may be equal when rounded.
SLACK = 2e-9
#: Pairs of the highest bounds of a name, scored first.
FIRST = 96
#: Pairs whose bounds are held together.
CELLS = 1 << 19
#: Pairs that leave a task together.
PAGE = 10_000


class _Teams:
    """A country's teams in order, and which of them are the nearest to a name."""

    def __init__(self, names: list[str], words: list[list[str]]):
        size = np.fromiter(map(len, names), np.int64, len(names))
        parts = [np.flatnonzero(x) for x in (size <= 64, size > 64)]  # the bits of longer names are beyond a machine word
        self.parts = [(where, Packed([names[k] for k in where])) for where in parts if len(where)]
        self.words, self.whole, holders = words, np.zeros(len(names)), defaultdict(list)
        for k, own in enumerate(words):
            for t in own:
                holders[t].append(k)
                self.whole[k] += word_weight(t)
        self.holders = {t: np.array(x) for t, x in holders.items()}

    def _ratios(self, words: list[str]) -> np.ndarray | None:
        """Token ratios but for rounding; None if no word is common."""
        if not any(t in self.holders for t in words):
            return None
        common = np.zeros(len(self.whole))
        for t in words:
            if t in self.holders:
                common[self.holders[t]] += word_weight(t)
        return common / np.maximum(self.whole + sum(map(word_weight, words)) - common, 0.1)

    def _pairs(self, name: str, which: np.ndarray) -> list[tuple]:
        """For each part, where its teams are in `which`, and what it scores."""
        if len(self.parts) == 1:
            return [(slice(None), self.parts[0][1].pairs(name, which))]
        own = [np.isin(which, where) for where, _ in self.parts]
        return [(x, packed.pairs(name, np.searchsorted(where, which[x]))) for x, (where, packed) in zip(own, self.parts, strict=True)]

    def _scores(self, asked: list[tuple]) -> list[np.ndarray]:
        """The scores of (words, ratios, which, pairs)."""
        out = [np.zeros(len(which)) for _, _, which, _ in asked]
        for k, (_, packed) in enumerate(self.parts if asked else ()):
            for x, (*_, pairs), scores in zip(out, asked, packed.scores([pairs[k][1] for *_, pairs in asked]), strict=True):
                x[pairs[k][0]] = scores
        for x, (words, ratios, which, _) in zip(out, asked, strict=True):
            for k in np.flatnonzero(ratios[which] >= x - SLACK) if ratios is not None else ():
                x[k] = max(x[k], token_ratio_value(words, self.words[which[k]]))
        return out

    def _bounds(self, name: str, words: list[str]) -> tuple[np.ndarray, np.ndarray | None]:
        """What scores cannot exceed (an array of its own), and the ratios."""
        bounds = [packed.bounds(name) for _, packed in self.parts]
        if len(bounds) == 1:
            bounds = bounds[0]
        else:
            bounds = np.concatenate(bounds)[np.argsort(np.concatenate([where for where, _ in self.parts]))]
        ratios = self._ratios(words)
        return bounds if ratios is None else np.maximum(bounds, ratios), ratios

    def nearest(self, asked: list[tuple[str, list[str]]], least: float, most: int) -> list[np.ndarray]:
        """For each name and its words the `most` teams of the best scores of about `least` or more, of equal ones (when rounded) the first."""
        first, others, ready = max(FIRST, most), [], []
        for name, words in asked:  # those of the highest bounds
            bounds, ratios = self._bounds(name, words)
            which = np.argpartition(bounds, -first)[-first:] if len(bounds) > first else np.arange(len(bounds))
            which = which[bounds[which] >= least - SLACK]
            ready.append((words, ratios, which, self._pairs(name, which)))
            bounds[which] = -1
            others.append(bounds)
        found = [(which, scores) for (_, _, which, _), scores in zip(ready, self._scores(ready), strict=True)]
        more = []
        for k, ((name, words), bounds, (which, scores)) in enumerate(zip(asked, others, found, strict=True)):  # those whose bounds reach the last of them
            if len(which) == first:
                which = np.flatnonzero(bounds >= max(np.partition(scores, -most)[-most], least) - SLACK)
                if len(which):
                    more.append((k, (words, ready[k][1], which, self._pairs(name, which))))
        for (k, (_, _, which, _)), scores in zip(more, self._scores([x for _, x in more]), strict=True):
            found[k] = np.concatenate([found[k][0], which]), np.concatenate([found[k][1], scores])
        out = []
        for which, scores in found:
            if len(which) > most:
                best = np.flatnonzero(scores >= np.partition(scores, -most)[-most] - SLACK)
                which = np.array([k for _, k in sorted(zip([-_rounded(x) for x in scores[best].tolist()], which[best].tolist(), strict=True))[:most]])
            out.append(which)
        return out


def _nearest(names: DataFrame, teams: DataFrame, least: float, most: int) -> DataFrame:
    """Pairs of names (country, _na, _wa and others) and teams (team_id, canonical_name, country, _nb, _wb): for each name at least those of its best teams.

    A country's names are dealt in SALTS parts, each with all its teams; a task holds a country's teams, which are at most some thousand, and
    reads names in batches.
    """
    salted = F.pmod(F.xxhash64("_na"), F.lit(SALTS)).cast("int")
    mine, theirs = [c for c in names.columns if c != "country"], [c for c in teams.columns if c != "country"]
    rows = names.withColumns({"_salt": salted, "_side": F.lit(1)}).unionByName(teams.withColumns({"_salt": F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))), "_side": F.lit(0)}), allowMissingColumns=True)
    # names by length and letters, as `Packed` would have them
    order = ["country", "_salt", "_side", "canonical_name", "team_id", F.length("_na"), "_na", "_wa"]

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        country, held, packed = None, [], None
        for batch in batches:
            keys = list(zip(*(batch[c].to_pylist() for c in ("country", "_salt", "_side")), strict=True))
            for key, run in groupby(range(len(keys)), keys.__getitem__):
                run = list(run)
                part = batch.slice(run[0], len(run))
                if key[:2] != country:
                    country, held, packed = key[:2], [], None
                if key[2] == 0:
                    held.append(part)
                    continue
                if not held:
                    continue
                if packed is None:
                    known = pa.Table.from_batches(held).combine_chunks()
                    packed = _Teams(known["_nb"].to_pylist(), known["_wb"].to_pylist())
                names_of = list(zip(part["_na"].to_pylist(), part["_wa"].to_pylist(), strict=True))
                apart = [k for k in range(len(names_of)) if k == 0 or names_of[k] != names_of[k - 1]]  # where another name begins
                found, step = [], max(1, CELLS // len(known))
                for low in range(0, len(apart), step):
                    found += packed.nearest([names_of[k] for k in apart[low : low + step]], least, most)
                found = [x for x, low, high in zip(found, apart, [*apart[1:], len(names_of)], strict=True) for _ in range(low, high)]
                left, right = np.repeat(np.arange(len(found)), [len(x) for x in found]), np.concatenate(found)
                for low in range(0, len(left), PAGE):
                    own, other = part.take(pa.array(left[low : low + PAGE])), known.take(pa.array(right[low : low + PAGE])).combine_chunks()
                    columns = [own["country"], *(own[c] for c in mine), *(other[c].combine_chunks() for c in theirs)]
                    yield pa.RecordBatch.from_arrays(columns, names=["country", *mine, *theirs])

    schema = T.StructType([names.schema["country"], *(names.schema[c] for c in mine), *(teams.schema[c] for c in theirs)])
    return rows.repartition(PARTS, "country", "_salt").sortWithinPartitions(*order).mapInArrow(pair, schema)


def proposals(unresolved: DataFrame, teams: DataFrame, least: float = 0.80, most: int = 5, indexed: bool = False) -> DataFrame:
    """The best candidates of the same country for each unresolved name; never applied by themselves.

    Names are compared with every team of their country, all at a time by the bits of their letters (`Packed`), and the best
    of these pairs are scored, or (indexed) all pairs that `candidates` leaves, which gives the same rows.
    """
    left = unresolved.select("source", "raw_name", "country").distinct()
    known = teams.select("team_id", "canonical_name", "country").distinct()
    if indexed:
        pairs = candidates(left, known, "raw_name", "canonical_name", "country", least)
        scored = pairs.select("*", *similarity(F.col("raw_name"), F.col("canonical_name"))).filter(F.col("score") >= least)
    else:  # each name is normalised once, not in each pair
        prepared = lambda df, name, side: df.filter(F.col(name).isNotNull() & F.col("country").isNotNull()).withColumns({f"_n{side}": normalize_name(F.col(name)), f"_w{side}": F.array_distinct(tokens(F.col(name)))})
        both = _nearest(prepared(left, "raw_name", "a"), prepared(known, "canonical_name", "b"), least, most).withColumns({"_jw": jaro_winkler("_na", "_nb"), "_ts": token_ratio(F.col("_wa"), F.col("_wb"))})
        found = F.struct(F.greatest("_jw", "_ts").alias("score"), F.when(F.col("_jw") >= F.col("_ts"), "JARO_WINKLER").otherwise("TOKEN_SET").alias("score_method"))
        # an explode, as a filter would have the letters compared once for itself and once for the column
        scored = both.select(*left.columns, "team_id", "canonical_name", F.explode(F.filter(F.array(found), lambda x: x["score"] >= least)).alias("_s")).select(*left.columns, "team_id", "canonical_name", "_s.*")
    own = W.partitionBy("source", "raw_name", "country").orderBy(F.desc(F.round("score", 9)), "canonical_name", "team_id")
    return scored.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= most)
