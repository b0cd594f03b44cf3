"""Quantiles without gathering a column into one task.

``percentile``/``median`` aggregates keep every value of a group in one
buffer, which for a global quantile means the whole column in one task.
Here a KLL sketch (merged map-side, a few thousand values whatever the input)
gives approximate quantiles with a stated rank error, and brackets the target
ranks of exact ones: rows below a bracket are only counted, the values inside
it are reduced to (value, count) pairs. All columns share every pass: one for
counts and sketches, repeated inside the brackets (about a hundredth of the
rows each time) while they hold too many rows, and one for the pairs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows a bracket may be expected to hold before its values are listed; more only mean another narrowing pass.
MAX_CANDIDATES = 200_000
#: Size parameter of the sketches, and steps of the quantiles read from one.
SKETCH_K, GRID = 4096, 1000


def rank_error(k: int = SKETCH_K) -> float:
    """Rank error of a KLL sketch as a share of the rows, at 99 % confidence (the published fit for one quantile)."""
    return 2.296 / k ** 0.9021


def _value(col: str) -> Column:
    """``col`` as a double; NaN counts as missing."""
    c = F.col(col).cast("double")
    return F.when(~F.isnan(c), c)


def _quantiles(v: Column, ps: list[float], k: int) -> Column:
    """Sketched quantiles of ``v`` as an array, null without values; a NULL of ``v`` is skipped."""
    sketch = F.kll_sketch_agg_double(v, F.lit(k))
    return F.when(F.count(v) > 0, F.kll_sketch_get_quantile_double(sketch, F.array(*[F.lit(float(p)) for p in ps])))


def sketch_percentiles(df: DataFrame, col: str, ps: list[float], by: tuple[str, ...] = (), k: int = SKETCH_K) -> DataFrame:
    """Approximate percentiles ``ps`` of ``col`` as an array ``quantiles`` beside the row count ``n``, in one aggregate.

    A returned value's rank is within ``rank_error(k)`` of the asked share
    (99 % confidence, whatever the distribution; a repeated value covers all
    the ranks of its copies). NULL and NaN are skipped; without values
    ``n`` is 0 and ``quantiles`` null. With ``by`` there is one row a group.
    """
    v = _value(col)
    return df.groupBy(*by).agg(F.count(v).alias("n"), _quantiles(v, ps, k).alias("quantiles"))


def _sketched(df: DataFrame, brackets: dict, k: int) -> dict:
    """One pass: for each column the rows inside and below its bracket, and quantiles of those inside."""
    aggs = []
    for i, (col, (lo, hi)) in enumerate(brackets.items()):
        v = _value(col)
        inside = F.when((v >= lo) & (v <= hi), v)
        aggs += [F.count(inside).alias(f"n{i}"), F.count_if(v < lo).alias(f"b{i}"),
                 _quantiles(inside, [j / GRID for j in range(GRID + 1)], k).alias(f"q{i}")]
    row = df.agg(*aggs).first()
    return {c: (row[f"n{i}"], row[f"b{i}"], row[f"q{i}"]) for i, c in enumerate(brackets)}


def _narrowed(bracket: tuple, ranks: list[int], inside: int, below: int, grid: list, margin: float) -> tuple[tuple, float]:
    """The part of a bracket that holds its ranks by the sketch, and the rows it is expected to hold."""
    lo, hi = bracket
    if not below <= ranks[0] <= ranks[-1] < below + inside:
        wide = (-math.inf if ranks[0] < below else lo), (math.inf if ranks[-1] >= below + inside else hi)
        return wide, math.inf
    first = math.floor(((ranks[0] - below) / inside - margin) * GRID)
    last = math.ceil(((ranks[-1] + 1 - below) / inside + margin) * GRID)
    part = (grid[first] if first > 0 else lo), (grid[last] if last < GRID else hi)
    return part, 0.0 if part == bracket or part[0] == part[1] else inside * (min(last, GRID) - max(first, 0)) / GRID


def _picked(df: DataFrame, brackets: dict, ranks: dict) -> dict:
    """One pass: ``(column, rank) -> value`` from the (value, count) pairs of the brackets.

    Ranks outside a bracket are missing; ``(column, None)`` is the number of rows below it.
    """
    cols = list(brackets)

    def of(values: list) -> Column:
        return F.array(*values)[F.col("i")]

    cells = F.array(*[F.struct(F.lit(i).alias("i"), _value(c).alias("v")) for i, c in enumerate(cols)])
    lo, hi = (of([F.lit(float(brackets[c][end])) for c in cols]) for end in (0, 1))
    pairs = (df.select(F.inline(cells)).where(F.col("v") <= hi).select("i", F.when(F.col("v") >= lo, F.col("v")).alias("v"))
             .groupBy("i", "v").agg(F.count(F.lit(1)).alias("c")))
    so_far = Window.partitionBy("i").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    run = pairs.withColumn("end", F.sum("c").over(so_far))
    wanted = of([F.array(*[F.lit(r).cast("long") for r in ranks[c]]) for c in cols])
    hit = F.exists(wanted, lambda r: (r < F.col("end")) & (r >= F.col("end") - F.col("c")))
    out = {}
    for i, v, c, end in run.where(F.col("v").isNull() | hit).select("i", "v", "c", "end").collect():
        out.update({(cols[i], None): end} if v is None else {(cols[i], r): v for r in ranks[cols[i]] if end - c <= r < end})
    return out


def exact_percentiles(df: DataFrame, ps: dict[str, float], k: int = SKETCH_K,
                      max_candidates: int = MAX_CANDIDATES) -> dict[str, float | None]:
    """Exact percentile ``ps[col]`` of each column with linear interpolation (numpy/pandas/DuckDB ``quantile_cont``).

    NULL and NaN are skipped; a column without values gives None. Two passes
    over ``df`` for all columns while the first brackets hold at most
    ``max_candidates`` rows (some 10^7 rows in all), three up to some 10^9. A
    bracket that misses a rank, which its margin makes unlikely, is opened to
    that side and read again.
    """
    margin = 3 * rank_error(k)
    open_ = {c: (-math.inf, math.inf) for c in ps}
    brackets, ranks, at = {}, {}, {}
    while open_:
        seen = _sketched(df, open_, k)
        for c, (inside, below, grid) in seen.items():
            bracket = open_.pop(c)
            if c not in ranks:
                if not inside:
                    continue
                at[c] = ps[c] * (inside - 1)
                ranks[c] = sorted({math.floor(at[c]), math.ceil(at[c])})
            part, rows = _narrowed(bracket, ranks[c], inside, below, grid, margin)
            (brackets if rows <= max_candidates else open_)[c] = part
    found, missing = {}, set(ranks)
    while missing:
        got = _picked(df, {c: brackets[c] for c in sorted(missing)}, ranks)
        for c in sorted(missing):
            lost = [r for r in ranks[c] if (c, r) not in got]
            if lost:
                below = got.get((c, None), 0)
                brackets[c] = ((-math.inf if lost[0] < below else brackets[c][0]),
                               (math.inf if lost[-1] >= below else brackets[c][1]))
            else:
                v0, v1 = got[c, ranks[c][0]], got[c, ranks[c][-1]]
                found[c] = v0 + (v1 - v0) * (at[c] - ranks[c][0]) if v0 != v1 else v0
                missing.remove(c)
    return {c: found.get(c) for c in ps}


def exact_percentile(df: DataFrame, col: str, p: float, k: int = SKETCH_K,
                     max_candidates: int = MAX_CANDIDATES) -> float | None:
    """``exact_percentiles`` of one column."""
    return exact_percentiles(df.select(col), {col: p}, k, max_candidates)[col]
