"""Exact (linearly interpolated) quantiles and modes without a global buffer.

Columns of a frame take ``rank_quantiles``: each wanted rank of each column has a
window of values that holds it.  A sketch of the values inside the windows narrows
all of them together, a counting pass proves where they lie, and so on until every
window is one value.  Both passes are plain aggregates over the frame with the
windows as literals: nothing is joined, exploded, sorted or shuffled but a row of
counters a task, whatever the number of rows or ties.

Groups of a long table (``quantiles_long``) work as follows.

Spark's exact ``percentile`` aggregate keeps a value->count map per group and
merges it in one task, so a global quantile over a near-unique column would
hold every distinct value in one place.  Here the exact answer is found in
two distributed passes:

1. ``approx_percentile`` (a bounded-size sketch, merged map-side) gives, per
   group and probability, a value window ``[lo, hi]`` that is guaranteed to
   contain the wanted ranks (rank error <= n / accuracy, we widen by 2x).
2. One scan counts the values below each window and aggregates the values
   inside it as ``(value, count)``; only those few rows are ranked, in a
   window partitioned by (group, probability).

Interpolation is the usual ``v[floor(pos)] + frac * (v[ceil(pos)] - v[floor(pos)])``
with ``pos = p * (n - 1)`` (pandas / DuckDB ``quantile_cont`` semantics).
Groups with at most ``accuracy`` values use Spark's exact ``percentile``
directly (its buffer is then bounded by ``accuracy``); only larger groups take
the refine path, with the same answers (tested, null groups included), where the widened window spans at least two ranks either side
of the target.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Aggregates in one pass; more windows take further passes.
AGGREGATES = 120
#: Accuracy of a narrowing sketch at most.  Every task sends its sketches to one task, so that they
#: must stay small; a coarser one leaves a wider window, which the next round narrows (that round's
#: sketches hold the values inside the windows only, so it costs a scan of counts, not of sketches).
SKETCH = 2_000


@dataclass
class _Window:
    column: int
    rank: int                     # wanted, from 0, among the column's values
    low: float | None = None      # both ends lie outside the window; None: open
    high: float | None = None
    below: int = 0                # values up to ``low``
    inside: int = 0
    value: float | None = None    # found
    margin: int = 1               # grows if a count disproves the sketch

    def holds(self, x):
        ok = x.isNotNull()
        if self.low is not None:
            ok = ok & (x > F.lit(self.low))
        return ok & (x < F.lit(self.high)) if self.high is not None else ok


def _pass(df: DataFrame, exprs: list) -> list:
    """Values of many aggregates, ``AGGREGATES`` to a scan."""
    out: list = []
    for s in range(0, len(exprs), AGGREGATES):
        out += df.agg(*[e.alias(f"a{i}") for i, e in enumerate(exprs[s:s + AGGREGATES])]).first()
    return out


def rank_quantiles(df: DataFrame, columns: list, probs: list[float], accuracy: int = 100_000) -> list[list[float | None]]:
    """For each column expression its exact quantiles (None for a column without values).

    Every round keeps, of the n values in a window, about 4 n / ``accuracy`` around the wanted
    rank, so that three rounds do for ten billion values; a window of at most ``accuracy`` / 2 values
    is answered by its sketch, which is lossless up to there.  ``accuracy`` counts up to ``SKETCH``, and
    ranks that still share a window share its sketch.  NaN counts as the greatest value."""
    accuracy = min(accuracy, SKETCH)
    x = [c.cast("double") for c in columns]
    n = [int(v) for v in _pass(df, [F.count(c) for c in x])]
    windows: dict[tuple[int, int], _Window] = {}
    for i, total in enumerate(n):
        for p in probs if total else ():
            for r in (math.floor(p * (total - 1)), math.ceil(p * (total - 1))):
                windows.setdefault((i, r), _Window(i, r, inside=total))
    while todo := [w for w in windows.values() if w.value is None]:
        shared: dict[tuple, list[_Window]] = {}
        for w in todo:
            shared.setdefault((w.column, w.low, w.high), []).append(w)
        asked = []
        for (i, _, _), ws in shared.items():
            probes = []
            for w in ws:
                at = w.rank - w.below
                reach = 0 if 2 * w.inside <= accuracy else w.margin * math.ceil(2 * w.inside / accuracy)
                probes += [(e + 0.5) / w.inside for e in (max(0, at - reach), min(w.inside - 1, at + reach))]
            sketch = F.percentile_approx(F.when(ws[0].holds(x[i]), x[i]), F.array(*map(F.lit, probes)), accuracy)
            asked += [F.slice(sketch, 2 * j + 1, 2) for j in range(len(ws))]      # one aggregate to Spark
        ends = list(zip([w for ws in shared.values() for w in ws], _pass(df, asked)))
        for w, (low, _) in ends:
            if 2 * w.inside <= accuracy:
                w.value = low
        ends = [(w, e) for w, e in ends if w.value is None]
        counts = []
        for w, (low, high) in ends:
            c = x[w.column]
            counts += [F.count(F.when(t, 1)) for t in (c < low, c == F.lit(low), (c > low) & (c < high), c == F.lit(high))]
        counted = iter(_pass(df, counts) if counts else [])
        for w, (low, high) in ends:
            under, lows, between, highs = (int(next(counted)) for _ in range(4))
            at = w.rank - under
            if 0 <= at < lows:
                w.value = low
            elif 0 <= at - lows < between:
                w.low, w.high, w.below, w.inside, w.margin = low, high, under + lows, between, 1
            elif 0 <= at - lows - between < highs and low < high:
                w.value = high
            else:                                           # the sketch erred by more than it should
                w.margin *= 4
    out = []
    for i, total in enumerate(n):
        row: list[float | None] = []
        for p in probs:
            if not total:
                row.append(None)
                continue
            pos = p * (total - 1)
            a, b = windows[i, math.floor(pos)].value, windows[i, math.ceil(pos)].value
            row.append(a if a == b else a + (pos - math.floor(pos)) * (b - a))
        out.append(row)
    return out


def quantiles_long(long_df: DataFrame, group_cols: list[str], value_col: str, probs: list[float],
                   exact: bool = True, accuracy: int = 100_000, small_groups_first: bool = True,
                   max_groups: int = 10_000) -> DataFrame:
    """-> (group_cols..., prob double, value double); nulls ignored, groups with no values omitted."""
    # one struct key: struct equality holds for null fields too, so a null group joins its own bounds
    named, group_cols = group_cols, ["_g"]
    v = F.col(value_col).cast("double")
    base = long_df.where(F.col(value_col).isNotNull()).select(F.struct(*named).alias("_g"), v.alias("_v"))
    return _quantiles(base, group_cols, probs, exact, accuracy, small_groups_first, max_groups).select(
        *[F.col("_g")[c].alias(c) for c in named], "prob", "value")


def _quantiles(base: DataFrame, group_cols: list[str], probs: list[float], exact: bool, accuracy: int, small_groups_first: bool, max_groups: int) -> DataFrame:
    probs = [float(p) for p in probs]
    if not exact:
        q = base.groupBy(*group_cols).agg(F.percentile_approx("_v", F.array(*[F.lit(p) for p in probs]), accuracy).alias("_q"))
        return q.select(*group_cols, F.posexplode("_q").alias("_i", "value")).select(
            *group_cols, F.element_at(F.array(*[F.lit(p) for p in probs]), F.col("_i") + 1).alias("prob"), "value")

    # pass 0: group sizes (one row per group).  With few groups that all fit the
    # sketch bound, one exact ``percentile`` aggregate is the whole answer.
    if small_groups_first:
        sizes = base.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_n")).limit(max_groups + 1).collect()
        if len(sizes) <= max_groups and all(r["_n"] <= accuracy for r in sizes):
            q = base.groupBy(*group_cols).agg(F.percentile("_v", F.array(*[F.lit(p) for p in probs])).alias("_q"))
            return q.select(*group_cols, F.posexplode("_q").alias("_i", "value")).select(
                *group_cols, F.element_at(F.array(*[F.lit(p) for p in probs]), F.col("_i") + 1).alias("prob"), "value")
    eps = 3.0 / accuracy
    lo_p = [max(0.0, p - eps) for p in probs]
    hi_p = [min(1.0, p + eps) for p in probs]
    # pass 1: counts + sketch bounds (one row per group; bounded by the number of groups)
    bounds = base.groupBy(*group_cols).agg(
        F.count("_v").alias("_n"),
        F.percentile_approx("_v", F.array(*[F.lit(p) for p in lo_p]), accuracy).alias("_lo"),
        F.percentile_approx("_v", F.array(*[F.lit(p) for p in hi_p]), accuracy).alias("_hi"),
    )
    k = len(probs)
    joined = base.join(bounds, on=group_cols, how="inner")
    small = joined.where(F.col("_n") <= accuracy).groupBy(*group_cols).agg(
        F.percentile("_v", F.array(*[F.lit(p) for p in probs])).alias("_q"))
    small = small.select(*group_cols, F.posexplode("_q").alias("_i", "value")).select(
        *group_cols, F.element_at(F.array(*[F.lit(p) for p in probs]), F.col("_i") + 1).alias("prob"), "value")
    # large groups, pass 2: one scan; each row explodes into a "below" counter row
    # plus one row per window it lies in
    joined = joined.where(F.col("_n") > accuracy)
    bounds = bounds.where(F.col("_n") > accuracy)
    below = F.array(*[F.when(F.col("_v") < F.col("_lo")[i], 1).otherwise(0) for i in range(k)])
    in_windows = F.filter(
        F.array(*[F.when((F.col("_v") >= F.col("_lo")[i]) & (F.col("_v") <= F.col("_hi")[i]), F.lit(i)) for i in range(k)]),
        lambda x: x.isNotNull())
    entries = F.concat(
        F.array(F.struct(F.lit(-1).alias("i"), F.lit(None).cast("double").alias("v"), below.alias("b"))),
        F.transform(in_windows, lambda i: F.struct(i.alias("i"), F.col("_v").alias("v"),
                                                   F.array_repeat(F.lit(0), k).alias("b"))),
    )
    exploded = joined.select(*group_cols, F.explode(entries).alias("_e")).select(
        *group_cols, F.col("_e.i").alias("_i"), F.col("_e.v").alias("_val"), F.col("_e.b").alias("_b"))
    agg = exploded.groupBy(*group_cols, "_i", "_val").agg(
        F.count(F.lit(1)).alias("_c"),
        *[F.sum(F.col("_b")[j]).alias(f"_b{j}") for j in range(k)])
    below_counts = agg.where(F.col("_i") == -1).select(*group_cols, *[F.col(f"_b{j}") for j in range(k)])
    win = agg.where(F.col("_i") >= 0).select(*group_cols, "_i", "_val", "_c")

    targets = bounds.select(*group_cols, "_n", F.posexplode(F.array(*[F.lit(p) for p in probs])).alias("_i", "prob"))
    targets = targets.join(below_counts, on=group_cols, how="left").select(
        *group_cols, "_n", "_i", "prob",
        F.coalesce(F.element_at(F.array(*[F.col(f"_b{j}") for j in range(k)]), F.col("_i") + 1), F.lit(0)).alias("_below"),
        (F.col("prob") * (F.col("_n") - 1)).alias("_pos"))
    targets = targets.select("*", F.floor("_pos").alias("_r0"), F.ceil("_pos").alias("_r1"))

    w = Window.partitionBy(*group_cols, "_i").orderBy("_val").rowsBetween(Window.unboundedPreceding, -1)
    ranked = win.select("*", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_before"))
    cand = ranked.join(targets, on=[*group_cols, "_i"], how="inner").select(
        *group_cols, "_i", "_val",
        (F.col("_below") + F.col("_before")).alias("_start"),
        (F.col("_below") + F.col("_before") + F.col("_c")).alias("_end"),
        "_r0", "_r1")
    hit0 = cand.where((F.col("_r0") >= F.col("_start")) & (F.col("_r0") < F.col("_end"))) \
        .select(*group_cols, "_i", F.col("_val").alias("_v0"))
    hit1 = cand.where((F.col("_r1") >= F.col("_start")) & (F.col("_r1") < F.col("_end"))) \
        .select(*group_cols, "_i", F.col("_val").alias("_v1"))
    res = targets.join(hit0, on=[*group_cols, "_i"], how="left").join(hit1, on=[*group_cols, "_i"], how="left")
    res = res.select(*group_cols, "prob", "_pos", "_r0", "_v0", "_v1",
                     (F.col("_v0") + (F.col("_pos") - F.col("_r0")) * (F.col("_v1") - F.col("_v0"))).alias("value"))
    return res.select(*group_cols, "prob", "value").unionByName(small)


def mode_long(long_df: DataFrame, group_cols: list[str], value_col: str) -> DataFrame:
    """Most frequent non-null value per group, ties -> smallest value.

    Two aggregates, both partially aggregated map-side: (group, value) counts,
    then ``min(struct(-count, value))`` per group.  No window over a group.
    """
    counts = long_df.where(F.col(value_col).isNotNull()).groupBy(*group_cols, value_col).agg(F.count(F.lit(1)).alias("_c"))
    best = counts.groupBy(*group_cols).agg(F.min(F.struct((-F.col("_c")).alias("nc"), F.col(value_col).alias("v"))).alias("_m"))
    return best.select(*group_cols, F.col("_m.v").alias("mode"), (-F.col("_m.nc")).alias("mode_count"))
