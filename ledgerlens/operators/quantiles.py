"""Exact interpolated quantiles in bounded memory.

`percentile` keeps every distinct value of a group in one task. Here a bounded sketch first
brackets each wanted rank, then the rows below the bracket are counted and only the values inside
it are kept. All passes combine on the map side. If a bracket ever missed its rank the query
stops with an error instead of returning a wrong number.

What is left of a bracket is cut by rank, never by width, so extreme values do not gather the rest
of a bracket in one place: over groups into slots of about equally many distinct values, again and
again while a bracket is large; over whole columns by bracketing again inside the bracket until few
values remain.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from ledgerlens.session import materialise

ACCURACY = 2_000
_MARGIN = 10          # bracket half-width in units of the sketch's own rank error
_SLOTS = 100          # pieces of a bracket with about equally many values, of which at most two are sorted
_MOST = 1_000_000     # a bracket of a group is cut again until it holds no more distinct values
_FEW = 10_000         # a bracket is narrowed until no more rows lie strictly inside it


def _brackets(prob: float, accuracy: int) -> tuple[float, float]:
    slack = _MARGIN / accuracy
    return max(prob - slack, 0.0), min(prob + slack, 1.0)


def _few_rows(accuracy: int) -> int:
    """Below this number of rows the bracket is narrower than a few ranks, so it is not used."""
    return 4 * accuracy // _MARGIN


def _sketch(value: Column, probs: Sequence[float], accuracy: int) -> Column:
    """low₀, high₀, low₁, high₁, … as one array."""
    wanted = [F.lit(p) for prob in probs for p in _brackets(prob, accuracy)]
    return F.percentile_approx(value, F.array(*wanted), F.lit(accuracy))


def _running(df: DataFrame, keys: Sequence[str], order: str, size: str) -> DataFrame:
    """Add the ranks [_from, _upto) that each row covers."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("_upto", F.sum(size).over(w)).withColumn("_from", F.col("_upto") - F.col(size))


def _covers(rank: Column) -> Column:
    return (rank >= F.col("_from")) & (rank < F.col("_upto"))


def _pick(covered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, _quantile) from values with the ranks they cover."""
    lower = F.max(F.when(_covers(F.floor("_rank")), F.col("_value")))
    upper = F.max(F.when(_covers(F.ceil("_rank")), F.col("_value")))
    value = lower + (upper - lower) * F.max(F.col("_rank") - F.floor("_rank"))
    missed = F.raise_error(F.lit("quantile bracket missed its rank; raise accuracy")).cast("double")
    return covered.groupBy(*keys).agg(F.when(value.isNotNull(), value).otherwise(missed).alias("_quantile"))


def exact_quantiles(
    df: DataFrame,
    value_col: str,
    probs: Mapping[str, float],
    group_cols: Sequence[str],
    accuracy: int = ACCURACY,
    bounded_groups: bool = False,
) -> DataFrame:
    """One row per group with one column per entry of `probs` (column name → probability).

    Null values and NaN are ignored, groups without a value are absent, null group keys are
    kept. `bounded_groups` says that the number of groups has a fixed bound (flags, calendar
    periods), which makes the bracket table safe to broadcast.

    The distinct values of each bracket are written out once and divided by a second sketch into
    slots of about equally many; the slots are counted and only those holding the wanted ranks are
    kept. While any bracket is large, all of them are cut again in the same jobs; what is sorted in
    the end is a bounded number of values per slot, however many rows a group has.
    """
    groups = list(group_cols)
    names, ps = list(probs), list(probs.values())
    rows = df.select(*groups, F.col(value_col).cast("double").alias("_value"))
    rows = rows.where(F.col("_value").isNotNull() & ~F.isnan("_value"))

    sketch = rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("_count"),
        F.min("_value").alias("_lowest"),
        F.max("_value").alias("_highest"),
        _sketch(F.col("_value"), ps, accuracy).alias("_sketch"),
    )
    few = F.col("_count") < _few_rows(accuracy)
    wanted = []
    for i, p in enumerate(ps):
        low_p, high_p = _brackets(p, accuracy)
        low = F.when(few | F.lit(low_p <= 0), F.col("_lowest")).otherwise(F.col("_sketch")[2 * i])
        high = F.when(few | F.lit(high_p >= 1), F.col("_highest")).otherwise(F.col("_sketch")[2 * i + 1])
        rank = (F.col("_count") - 1) * F.lit(p)
        wanted.append(F.struct(F.lit(i).alias("q"), low.alias("low"), high.alias("high"), rank.alias("rank")))
    brackets = sketch.select(
        *[F.col(g).alias(f"_key_{i}") for i, g in enumerate(groups)], F.array(*wanted).alias("_wanted"))
    if bounded_groups:
        brackets = F.broadcast(brackets)

    same_group = F.lit(True)
    for i, g in enumerate(groups):
        same_group = same_group & F.col(g).eqNullSafe(F.col(f"_key_{i}"))
    joined = rows.join(brackets, same_group).select(*groups, "_value", F.explode("_wanted").alias("_w"))
    v, low, high = F.col("_value"), F.col("_w.low"), F.col("_w.high")
    # Rows under the bracket share one null value, so they shrink to a count on the map side.
    counted = joined.where(v <= high).select(
        *groups, F.col("_w.q").alias("_q"), F.col("_w.rank").alias("_rank"), F.when(v >= low, v).alias("_value"),
    ).groupBy(*groups, "_q", "_rank", "_value").agg(F.count(F.lit(1)).alias("_n"))
    written = Observation()
    counted = materialise(counted.observe(written, F.count(F.lit(1)).alias("rows")))
    keys = [*groups, "_q"]
    if written.get["rows"] > _MOST:
        while counted.groupBy(*keys).count().agg(F.max("count")).first()[0] > _MOST:
            counted = _cut_again(_needed_slots(counted, groups, accuracy, bounded_groups), keys)
    needed = _needed_slots(counted, groups, accuracy, bounded_groups)
    inside = _running(needed, [*keys, "_slot"], "_value", "_n").withColumns(
        {"_from": F.col("_from") + F.col("_start"), "_upto": F.col("_upto") + F.col("_start")})
    return _pick(inside, keys).groupBy(*groups).agg(
        *[F.max(F.when(F.col("_q") == i, F.col("_quantile"))).alias(n) for i, n in enumerate(names)])


def _cut_again(needed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The values of the needed slots, with the rows under them as one null value again."""
    under = needed.groupBy(*keys, "_rank").agg(F.min("_start").alias("_n")).where("_n > 0")
    return materialise(needed.select(*keys, "_rank", "_value", "_n").unionByName(
        under.select(*keys, "_rank", F.lit(None).cast("double").alias("_value"), "_n")))


def _needed_slots(counted: DataFrame, groups: Sequence[str], accuracy: int, bounded_groups: bool) -> DataFrame:
    """The values of those slots that hold a wanted rank, with `_slot` and the rows before it as `_start`."""
    cut_at = F.array(*[F.lit(i / _SLOTS) for i in range(1, _SLOTS)])
    cuts = counted.groupBy(*groups, "_q").agg(F.percentile_approx("_value", cut_at, F.lit(accuracy)).alias("_cuts")).select(
        *[F.col(g).alias(f"_key_{i}") for i, g in enumerate([*groups, "_q"])], "_cuts")
    if bounded_groups:
        cuts = F.broadcast(cuts)  # one short array per group and probability
    same = F.lit(True)
    for i, g in enumerate([*groups, "_q"]):
        same = same & F.col(g).eqNullSafe(F.col(f"_key_{i}"))
    slot = F.when(F.col("_value").isNull(), -1).otherwise(F.size(F.filter("_cuts", lambda c: c < F.col("_value"))))
    counted = counted.join(cuts, same).select(*groups, "_q", "_rank", slot.cast("int").alias("_slot"), "_value", "_n")

    keys = [*groups, "_q"]
    slots = counted.groupBy(*keys, "_rank", "_slot").agg(F.sum("_n").alias("_slot_rows"))
    needed = _running(slots, keys, "_slot", "_slot_rows").where(
        _covers(F.floor("_rank")) | _covers(F.ceil("_rank")))
    needed = needed.select(
        *[F.col(g).alias(f"_key_{i}") for i, g in enumerate(keys)],
        F.col("_slot").alias("_needed"), F.col("_from").alias("_start"))
    if bounded_groups:
        needed = F.broadcast(needed)  # at most two rows per group and probability
    same = F.col("_slot") == F.col("_needed")
    for i, g in enumerate(keys):
        same = same & F.col(g).eqNullSafe(F.col(f"_key_{i}"))
    return counted.join(needed, same).select(*keys, "_rank", "_slot", "_value", "_n", "_start")


def column_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], accuracy: int = ACCURACY
) -> dict[str, list[float | None]]:
    """Exact quantiles of several columns over the whole table, as numbers for a fitted model.

    What reaches the driver is a few numbers per column and probability. All brackets are narrowed
    together: a round is one sketch of the values strictly inside and one count, and leaves about a
    hundredth of them. The number of jobs grows with the logarithm of the rows, not with the columns.
    """
    cols, ps = list(columns), list(probs)
    values = {c: F.nullif(F.col(c).cast("double"), F.lit(math.nan)) for c in cols}
    measures = []
    for i, c in enumerate(cols):
        measures += [
            F.count(values[c]).alias(f"n{i}"), F.min(values[c]).alias(f"lo{i}"),
            F.max(values[c]).alias(f"hi{i}"), _sketch(values[c], ps, accuracy).alias(f"s{i}"),
        ]
    found = df.agg(*measures).first()

    result: dict[str, list[float | None]] = {c: [None] * len(ps) for c in cols}
    ends, ranks = {}, {}
    for i, c in enumerate(cols):
        if not found[f"n{i}"]:
            continue
        few = found[f"n{i}"] < _few_rows(accuracy)
        for j, p in enumerate(ps):
            low_p, high_p = _brackets(p, accuracy)
            low = found[f"lo{i}"] if few or low_p <= 0 else found[f"s{i}"][2 * j]
            high = found[f"hi{i}"] if few or high_p >= 1 else found[f"s{i}"][2 * j + 1]
            ends[i, j], ranks[i, j] = (low, high), (found[f"n{i}"] - 1) * p
    if not ends:
        return result

    held = _counted(df, cols, values, ends, ranks)
    while wide := [k for k, (low, high) in ends.items() if low < high and held[k][2] > _FEW]:
        closer = _narrowed(df, cols, values, {k: ends[k] for k in wide}, ranks, held, accuracy)
        ends |= closer
        held |= _counted(df, cols, values, closer, ranks)
    to_sort = []
    for (i, j), (low, high) in ends.items():
        if low == high:
            result[cols[i]][j] = low
        else:
            to_sort.append((i, j, float(ranks[i, j]), held[i, j][0], float(low), float(high)))
    for (i, j), value in _sorted_brackets(df, cols, values, to_sort).items():
        result[cols[i]][j] = value
    return result


def _counted(df, cols, values, ends, ranks) -> dict[tuple[int, int], tuple[int, int, int]]:
    """Rows below, at the lower end of and strictly inside each bracket (column, probability)."""
    counts = []
    for (i, j), (low, high) in ends.items():
        v = values[cols[i]]
        counts += [F.count(F.when(test, 1)).alias(f"{name}{i}_{j}") for name, test in (
            ("b", v < F.lit(low)), ("l", v == F.lit(low)), ("i", (v > F.lit(low)) & (v < F.lit(high))),
            ("h", (v == F.lit(high)) & (v > F.lit(low))))]
    found = df.agg(*counts).first()
    held = {}
    for i, j in ends:
        below, at_low, inside, at_high = (found[f"{name}{i}_{j}"] for name in "blih")
        if not below <= math.floor(ranks[i, j]) <= math.ceil(ranks[i, j]) < below + at_low + inside + at_high:
            raise RuntimeError("quantile bracket missed its rank; raise accuracy")
        held[i, j] = (below, at_low, inside)
    return held


def _narrowed(df, cols, values, ends, ranks, held, accuracy) -> dict[tuple[int, int], tuple[float, float]]:
    """Closer ends for each bracket, from a sketch of the values strictly inside it.

    Ends that many rows share are left out of the sketch, so each round leaves about a hundredth.
    """
    sketches, kept = [], {}
    for (i, j), (low, high) in ends.items():
        v = values[cols[i]]
        below, at_low, inside = held[i, j]
        low_p, high_p = _brackets((ranks[i, j] - below - at_low) / max(inside - 1, 1), accuracy)
        kept[i, j] = (low_p <= 0, high_p >= 1)
        wanted = F.array(F.lit(min(low_p, 1.0)), F.lit(max(high_p, 0.0)))
        sketches.append(F.percentile_approx(
            F.when((v > F.lit(low)) & (v < F.lit(high)), v), wanted, F.lit(accuracy)).alias(f"s{i}_{j}"))
    found = df.agg(*sketches).first()
    return {k: (low if kept[k][0] else found[f"s{k[0]}_{k[1]}"][0], high if kept[k][1] else found[f"s{k[0]}_{k[1]}"][1])
            for k, (low, high) in ends.items()}


def _sorted_brackets(df, cols, values, brackets) -> dict[tuple[int, int], float]:
    """The quantile of each bracket (column, probability, rank, rows below, low, high) by sorting it."""
    if not brackets:
        return {}
    entries = []
    for i, j, _, _, low, high in brackets:
        v = values[cols[i]]
        entries.append(F.when((v >= F.lit(low)) & (v <= F.lit(high)), F.struct(
            F.lit(i).alias("c"), F.lit(j).alias("q"), v.alias("value"))))
    inside = df.select(F.explode(F.array_compact(F.array(*entries))).alias("_e")).select(
        F.col("_e.c").alias("_c"), F.col("_e.q").alias("_q"), F.col("_e.value").alias("_value"))
    counted = inside.groupBy("_c", "_q", "_value").agg(F.count(F.lit(1)).alias("_n"))
    # One row per column and probability.
    starts = F.broadcast(df.sparkSession.createDataFrame(
        [b[:4] for b in brackets], "_c int, _q int, _rank double, _start bigint"))
    covered = _running(counted.join(starts, ["_c", "_q"]), ["_c", "_q"], "_value", "_n").withColumns(
        {"_from": F.col("_from") + F.col("_start"), "_upto": F.col("_upto") + F.col("_start")})
    return {(r["_c"], r["_q"]): r["_quantile"] for r in _pick(covered, ["_c", "_q"]).collect()}


def robust_center_scale(
    df: DataFrame, columns: Sequence[str], accuracy: int = ACCURACY
) -> tuple[dict[str, float], dict[str, float]]:
    """Median of each column, and the interquartile range after the median has filled its nulls.

    A column without any value is centred on 0; a range of zero scales by 1.
    """
    medians = {c: (v[0] if v[0] is not None else 0.0)
               for c, v in column_quantiles(df, columns, [0.5], accuracy).items()}
    filled = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(medians[c])).alias(c) for c in columns])
    scales = {}
    for c, (q1, q3) in column_quantiles(filled, columns, [0.25, 0.75], accuracy).items():
        spread = 0.0 if q1 is None else q3 - q1
        scales[c] = spread if spread > 0 and math.isfinite(spread) else 1.0
    return medians, scales
