"""Joins with null-safe keys, key coercion and suffixes; as-of and interval joins.

Null-safe equality (`<=>`) is an equi-join key to Catalyst, so these still hash or sort
and merge; sizes and skew are left to adaptive execution.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tallyfield.functions.paths import get_field, resolve

TYPES = {"inner": "inner", "left": "left", "right": "right", "outer": "full", "full": "full", "anti": "left_anti", "semi": "left_semi"}
COERCIONS = ("strict", "string", "auto")


def canonical(col: Column) -> Column:
    """One text for values that mean the same number (1, 1.0, "1", "01"); other text stays as it is."""
    text = F.trim(col.cast("string"))
    value = text.try_cast("double")
    whole = value.isNotNull() & (F.abs(value) < F.lit(2.0**53)) & (value == F.floor(value))
    return F.when(whole, value.try_cast("long").cast("string")).when(value.isNotNull() & ~F.isnan(value), value.cast("string")).otherwise(col.cast("string"))


def _key(df: DataFrame, path: str, coercion: str) -> Column:
    col = get_field(df, path)
    return col if coercion == "strict" else col.cast("string") if coercion == "string" else canonical(col)


def _same_family(a: T.DataType, b: T.DataType) -> bool:
    for kind in (T.NumericType, T.StringType, T.BooleanType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        if isinstance(a, kind) or isinstance(b, kind):
            return isinstance(a, kind) and isinstance(b, kind)
    return True


def join(left: DataFrame, right: DataFrame, on: str | Sequence[str] | None = None, left_on: str | Sequence[str] | None = None, right_on: str | Sequence[str] | None = None, how: str = "left", lsuffix: str = "", rsuffix: str = "_right", type_coercion: str = "strict") -> DataFrame:
    """Equi-join in which null keys match each other.

    With `on` the key columns appear once.  A right column whose name the left has too is
    renamed with rsuffix (with an empty one the left column stays alone); lsuffix renames
    the left column of such a pair.  A right join keeps the right columns' names and gives
    clashing left ones the lsuffix (with an empty one the left value replaces the right).
    """
    how = how.lower()
    if how not in TYPES:
        raise ValueError(f"how must be one of {', '.join(TYPES)}")
    if type_coercion not in COERCIONS:
        raise ValueError(f"type_coercion must be one of {', '.join(COERCIONS)}")
    if on is not None and (left_on is not None or right_on is not None):
        raise ValueError("give either on, or left_on and right_on")
    a, b = (on, on) if on is not None else (left_on, right_on)
    if a is None or b is None:
        raise ValueError("a join needs keys")
    a, b = ([x] if isinstance(x, str) else list(x) for x in (a, b))
    if len(a) != len(b) or not a:
        raise ValueError("left and right have different numbers of keys")
    if type_coercion == "strict":
        for x, y in zip(a, b, strict=True):
            p, q = resolve(left.schema, x), resolve(right.schema, y)
            if p and q and not _same_family(p[1], q[1]):
                raise TypeError(f"keys {x} ({p[1].simpleString()}) and {y} ({q[1].simpleString()}) differ in type; choose a coercion")

    # keys are computed under names of their own, so equal column names cannot be confused
    lk, rk = [f"__l{i}" for i in range(len(a))], [f"__r{i}" for i in range(len(b))]
    l_cols, r_cols = left.columns, right.columns
    l = left.select(*[F.col(f"`{c}`").alias(f"__a{i}") for i, c in enumerate(l_cols)], *[_key(left, p, type_coercion).alias(k) for p, k in zip(a, lk, strict=True)])
    r = right.select(*[F.col(f"`{c}`").alias(f"__b{i}") for i, c in enumerate(r_cols)], *[_key(right, p, type_coercion).alias(k) for p, k in zip(b, rk, strict=True)])
    condition = l[lk[0]].eqNullSafe(r[rk[0]])
    for x, y in zip(lk[1:], rk[1:], strict=True):
        condition = condition & l[x].eqNullSafe(r[y])
    if TYPES[how] in ("left_anti", "left_semi"):
        return l.join(r, condition, TYPES[how]).select(*[F.col(f"__a{i}").alias(c) for i, c in enumerate(l_cols)])
    joined = l.join(r, condition, TYPES[how])
    shared = {c for x, y in zip(a, b, strict=True) if x == y for c in [x] if c in l_cols and c in r_cols}
    values: dict[str, Column] = {}
    first, second = (l_cols, r_cols) if how != "right" else (r_cols, l_cols)
    mark = {False: "__a", True: "__b"}

    def col(name: str, of_right: bool) -> Column:
        names = r_cols if of_right else l_cols
        return F.col(f"{mark[of_right]}{names.index(name)}")

    for c in first:
        of_right = how == "right"
        if c in shared:
            values[c] = F.coalesce(col(c, False), col(c, True)) if how in ("outer", "full") else col(c, of_right)
        elif c in second and how != "right" and lsuffix:
            values[c + lsuffix] = col(c, False)
        else:
            values[c] = col(c, of_right)
    for c in second:
        of_right = how != "right"
        if c in shared:
            continue
        if how == "right":
            if c in first and lsuffix:
                values[c + lsuffix] = col(c, False)
            elif c in first:
                values[c] = F.coalesce(col(c, False), col(c, True))  # the left value where there is a left row
            else:
                values[c] = col(c, False)
        elif c in first:
            if rsuffix:
                values[c + rsuffix] = col(c, of_right)
        else:
            values[c] = col(c, of_right)
    return joined.select(*[v.alias(k) for k, v in values.items()])


def asof_join(left: DataFrame, right: DataFrame, by: str | Sequence[str], left_time: str, right_time: str, prefix: str = "", strict: bool = False, tolerance_seconds: float | None = None, bin_seconds: float | None = None) -> DataFrame:
    """Each left row with the latest right row of its key at or (strict) before its time.

    Both sides go through one sort by key and time and a running last value: one shuffle,
    no join, and memory that does not grow with matches.  Right columns get the prefix; of
    right rows at one time the one greatest in its remaining columns is taken.

    A key that holds a large share of the rows is one task in that sort.  With bin_seconds a
    key's time is cut into bins that are sorted apart; the last right row of each bin is carried
    over to the bins after it (a row a key and bin), so hot keys are spread over their bins.
    """
    keys = [by] if isinstance(by, str) else list(by)
    values = [c for c in right.columns if c not in keys]
    l_turn, r_turn = (0, 1) if strict else (1, 0)  # where times are equal: left first, or right first
    body = F.struct(*[F.col(f"`{c}`") for c in values])
    r = right.filter(F.col(f"`{right_time}`").isNotNull()).select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)], F.col(f"`{right_time}`").cast("timestamp_ntz").alias("__t"), F.lit(r_turn).alias("__turn"), body.alias("__right"), F.lit(None).cast(T.StructType(left.schema.fields)).alias("__left"))
    l = left.select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)], F.col(f"`{left_time}`").cast("timestamp_ntz").alias("__t"), F.lit(l_turn).alias("__turn"), F.lit(None).cast(r.schema["__right"].dataType).alias("__right"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("__left"))
    own, order = [f"__k{i}" for i in range(len(keys))], (F.col("__t").asc_nulls_first(), "__turn", F.col("__right").asc_nulls_first())
    both = l.unionByName(r)
    if bin_seconds is None:
        window = W.partitionBy(*own).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        seen = both.withColumn("__match", F.last("__right", ignorenulls=True).over(window)).filter(F.col("__left").isNotNull())
    else:
        both = both.withColumn("__bin", F.floor(F.unix_micros(F.col("__t").cast("timestamp")) / F.lit(float(bin_seconds) * 1e6)))
        window = W.partitionBy(*own, "__bin").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        # of a bin's right rows the latest, of those at one time the greatest; then the last of the bins before
        last = both.groupBy(*own, "__bin").agg(F.max(F.when(F.col("__right").isNotNull(), F.struct("__t", "__right")))["__right"].alias("__last"))
        before = W.partitionBy(*own).orderBy("__bin").rowsBetween(W.unboundedPreceding, -1)
        carried = last.select(*[F.col(k).alias(f"_{k}") for k in own], F.col("__bin").alias("__carry_bin"), F.last("__last", ignorenulls=True).over(before).alias("__carry"))
        inside = both.withColumn("__in", F.last("__right", ignorenulls=True).over(window)).filter(F.col("__left").isNotNull())
        same = F.col("__bin").eqNullSafe(F.col("__carry_bin"))
        for k in own:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        seen = inside.join(carried, same, "left").withColumn("__match", F.coalesce("__in", F.when(F.col("__t").isNotNull(), F.col("__carry"))))
    if tolerance_seconds is not None:
        age = F.col("__t").cast("timestamp").cast("double") - F.col(f"__match.`{right_time}`").cast("timestamp").cast("double")
        seen = seen.withColumn("__match", F.when(age <= tolerance_seconds, F.col("__match")))
    return seen.select(*[F.col(f"__left.`{c}`").alias(c) for c in left.columns], *[F.col(f"__match.`{c}`").alias(prefix + c) for c in values])


def latest_as_of(df: DataFrame, keys: Sequence[str], time: str, at: Column, values: Sequence[str], tie: str | None = None) -> DataFrame:
    """The values of the latest row of each key with time <= at, by one partial aggregation."""
    order = F.struct(time, *([tie] if tie else []))
    return df.filter(F.col(time) <= at).groupBy(*keys).agg(F.max(time).alias(time), *[F.max_by(v, order).alias(v) for v in values])


def interval_join(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, before_seconds: float, after_seconds: float, how: str = "inner", prefix: str = "right_") -> DataFrame:
    """Right rows of the same key within [t - before, t + after] of each left row.

    Time is cut into bins as wide as the interval: a left row looks into the two or three
    bins it touches, so key and bin are an equi-join and a hot key is spread over its bins.
    """
    width = max(before_seconds + after_seconds, 1e-6)
    seconds = lambda c: F.col(f"`{c}`").cast("timestamp").cast("double")
    l = left.withColumn("__lo", seconds(left_time) - before_seconds).withColumn("__hi", seconds(left_time) + after_seconds)
    spread = l.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("__lo") / width), F.floor(F.col("__hi") / width))))
    r = right.select(*[F.col(f"`{c}`").alias(c if c == by else prefix + c) for c in right.columns]).withColumn("__at", F.col(f"`{prefix + right_time}`").cast("timestamp").cast("double"))
    r = r.withColumn("__bin", F.floor(F.col("__at") / width))
    hits = spread.join(r, [by, "__bin"]).filter((F.col("__at") >= F.col("__lo")) & (F.col("__at") <= F.col("__hi")))
    hits = hits.drop("__lo", "__hi", "__at", "__bin")
    return hits if how == "inner" else with_misses(left, hits)


def with_misses(left: DataFrame, hits: DataFrame) -> DataFrame:
    """hits (columns of left, then others) and the left rows without one.  Rows are told by what they hold, which is the same however often they are read; equal rows have equal hits."""
    met = hits.select(*[F.col(f"`{c}`").alias(f"__m{k}") for k, c in enumerate(left.columns)]).distinct()
    same = [F.col(f"`{c}`").eqNullSafe(F.col(f"__m{k}")) for k, c in enumerate(left.columns)]
    return hits.unionByName(left.join(met, same, "left_anti"), allowMissingColumns=True)


#: Shortest cells of `span_join`, in seconds; each level doubles them.
CELL_SECONDS = 60.0


def span_join(spans: DataFrame, points: DataFrame, by: str, start: str, end: str, time: str, how: str = "inner", prefix: str = "right_", cell_seconds: float = CELL_SECONDS) -> DataFrame:
    """Points of the same key within [start, end] of each span, whatever the spans' lengths.

    A span lies in the level whose cells are at least as long as itself, so it touches two of them
    at most; a point looks into its one cell of every level that spans use.  Key, level and
    cell are an equi-join: minutes and years side by side, and a hot key is spread over its cells.
    The levels in use (two dozen from a minute to years) are read first.
    """
    seconds = lambda c: F.col(f"`{c}`").cast("timestamp").cast("double")
    length = F.greatest(F.col("__hi") - F.col("__lo"), F.lit(cell_seconds))
    level = F.ceil(F.round(F.log2(length / cell_seconds), 9)).cast("int")
    known = spans.withColumns({"__lo": seconds(start), "__hi": seconds(end)}).filter("__hi >= __lo").withColumn("__level", level)
    levels = sorted(r[0] for r in known.select("__level").distinct().collect())  # fewer than sixty
    width = F.lit(cell_seconds) * F.pow(F.lit(2.0), F.col("__level"))
    spread = known.withColumn("__cell", F.explode(F.sequence(F.floor(F.col("__lo") / width), F.floor(F.col("__hi") / width))))
    r = points.select(*[F.col(f"`{c}`").alias(c if c == by else prefix + c) for c in points.columns]).withColumn("__at", F.col(f"`{prefix + time}`").cast("timestamp").cast("double"))
    r = r.filter("__at IS NOT NULL").withColumn("__level", F.explode(F.array(*[F.lit(k) for k in levels]).cast("array<int>"))).withColumn("__cell", F.floor(F.col("__at") / width))
    hits = spread.join(r, [by, "__level", "__cell"]).filter("__at >= __lo AND __at <= __hi").drop("__lo", "__hi", "__at", "__level", "__cell")
    return hits if how == "inner" else with_misses(spans, hits)


#: Shortest cells of `span_summary`, in seconds.
SUMMARY_SECONDS = 1.0


def span_summary(spans: DataFrame, points: DataFrame, by: str, start: str, end: str, time: str, ident: str, value: str, cell_seconds: float = SUMMARY_SECONDS) -> DataFrame:
    """ident, n, least and most: how many values points of the same key have within [start, end] of each span, and their bounds; ident tells spans apart.

    Points are summed up in cells, each level twice as long as the one below.  A span is the whole cells in it,
    at most two of a level, and its ends, which meet the points of one shortest cell each: long spans over
    hot keys cost a few rows, not their points.
    """
    micros = lambda c: F.unix_micros(F.col(f"`{c}`").cast("timestamp"))
    width = round(cell_seconds * 1_000_000)
    cell_of = lambda x: ((x - F.pmod(x, F.lit(width))) / F.lit(width)).cast("long")
    known = spans.select(F.col(f"`{ident}`").alias("__id"), F.col(f"`{by}`").alias("__key"), micros(start).alias("__lo"), micros(end).alias("__hi")).filter("__hi >= __lo AND __key IS NOT NULL")
    known = known.withColumns({"__a": cell_of(F.col("__lo") + (width - 1)), "__b": cell_of(F.col("__hi") + 1)})
    most = known.agg(F.max(F.col("__b") - F.col("__a"))).first()[0] or 1
    at = points.select(F.col(f"`{by}`").alias("__key"), micros(time).alias("__at"), F.col(f"`{value}`").alias("__v")).filter("__at IS NOT NULL AND __key IS NOT NULL").withColumn("__cell", cell_of(F.col("__at")))
    sums = lambda: (F.sum("__n").alias("__n"), F.min("__least").alias("__least"), F.max("__most").alias("__most"))
    shortest = at.groupBy("__key", "__cell").agg(F.count("__v").alias("__n"), F.min("__v").alias("__least"), F.max("__v").alias("__most"))
    levels = F.sequence(F.lit(0), F.lit(max(int(most).bit_length() - 1, 0)))
    cells = shortest.withColumn("__level", F.explode(levels)).withColumn("__cell", F.expr("shiftright(__cell, __level)")).groupBy("__key", "__level", "__cell").agg(*sums())
    pieces = """flatten(transform(sequence(0, cast(floor(log2(__b - __a) + 1e-9) AS int)), k -> filter(array(
        if(shiftright(__a + shiftleft(1L, k) - 1, k) < shiftright(__b, k) AND (shiftright(__a + shiftleft(1L, k) - 1, k) & 1) = 1, named_struct('level', k, 'cell', shiftright(__a + shiftleft(1L, k) - 1, k)), NULL),
        if(shiftright(__a + shiftleft(1L, k) - 1, k) < shiftright(__b, k) AND (shiftright(__b, k) & 1) = 1, named_struct('level', k, 'cell', shiftright(__b, k) - 1), NULL)), x -> x IS NOT NULL)))"""
    whole = known.filter("__b > __a").select("__id", "__key", F.explode(F.expr(pieces)).alias("__p")).select("__id", "__key", F.col("__p.level").alias("__level"), F.col("__p.cell").alias("__cell"))
    ends = f"""filter(if(__a > __b, array(named_struct('lo', __lo, 'hi', __hi)), array(named_struct('lo', __lo, 'hi', __a * {width} - 1), named_struct('lo', __b * {width}, 'hi', __hi))), x -> x.lo <= x.hi)"""
    edges = known.select("__id", "__key", F.explode(F.expr(ends)).alias("__e")).select("__id", "__key", "__e.lo", "__e.hi", cell_of(F.col("__e.lo")).alias("__cell"))
    met = edges.join(at, ["__key", "__cell"]).filter("__at >= lo AND __at <= hi").select("__id", F.col("__v").isNotNull().cast("long").alias("__n"), F.col("__v").alias("__least"), F.col("__v").alias("__most"))
    none = spans.select(F.col(f"`{ident}`").alias("__id"), F.lit(0).cast("long").alias("__n"), F.lit(None).cast(points.schema[value].dataType).alias("__least")).withColumn("__most", F.col("__least"))
    parts = none.unionByName(whole.join(cells, ["__key", "__level", "__cell"]).select("__id", "__n", "__least", "__most")).unionByName(met)
    return parts.groupBy("__id").agg(*sums()).select(F.col("__id").alias(ident), F.col("__n").alias("n"), F.col("__least").alias("least"), F.col("__most").alias("most"))


def resolve_merges(merges: DataFrame, merged: str = "merged_id", surviving: str = "surviving_id", most: int = 64) -> DataFrame:
    """(merged, final): each merged id with the id its chain ends at; a cycle raises.

    Pointer doubling: the chain length halves each round, so rounds are logarithmic.
    """
    links = merges.select(F.col(merged).alias("m"), F.col(surviving).alias("s"))
    for _ in range(most):
        step = links.alias("a").join(links.alias("b"), F.col("a.s") == F.col("b.m"), "left").select(F.col("a.m").alias("m"), F.coalesce("b.s", "a.s").alias("s"), F.col("b.s").isNotNull().alias("moved")).persist()
        if step.filter("m = s").limit(1).count():
            raise ValueError("merges form a cycle")
        moved = step.filter("moved").limit(1).count()
        links = step.select("m", "s")
        if not moved:
            return links.select(F.col("m").alias(merged), F.col("s").alias("final_id"))
    raise ValueError("merges form a cycle")
