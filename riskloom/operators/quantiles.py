"""Exact quantiles by distributed selection.

``percentile`` keeps a value -> count map of a whole column in one buffer.
Here a sketch brackets each wanted rank, and only the rows inside the brackets
are counted by value:

1. one aggregate over all columns: counts, and for each wanted rank a value
   below and one above it (``percentile_approx``, a bounded sketch whose rank
   error is known);
2. one grouped count over all columns: every row falls into a section of its
   column (inside a bracket, or between two), and rows inside a bracket keep
   their value.  Sections between brackets are one counter per task; a bracket
   holds about 6 / ACCURACY of the rows and is sorted alone.

The counts between the brackets tell each rank's place exactly, so a bracket
that missed its rank is seen, and widened.  Brackets that still hold more than
SORT_ROWS rows are narrowed by another sketch of the rows inside them first.

The driver receives at most two values for each wanted quantile.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10000
SORT_ROWS = 2_000_000
#: Rank error of the sketch as a share of its rows, doubled.
_SLACK = 2.0 / ACCURACY


class _Target:
    """One rank (0-based, its successor included) of one column and the values known to enclose it."""

    def __init__(self, column: str, rank: int):
        self.column, self.rank = column, rank
        self.lo: float | None = None
        self.hi: float | None = None
        self.below, self.inside = 0, 0


def _within(x: Column, t: _Target) -> Column:
    if t.lo is None:
        return x.isNotNull()
    return (x >= F.lit(t.lo)) & (x <= F.lit(t.hi))


def _sketch(df: DataFrame, targets: list[_Target], values: dict[str, Column]) -> None:
    """Narrow the brackets of ``targets`` by one aggregate."""
    aggs = []
    for i, t in enumerate(targets):
        n, k = t.inside, t.rank - t.below
        probs = [max(0.0, k / n - _SLACK), min(1.0, (k + 2) / n + _SLACK)]
        x = values[t.column]
        aggs.append(F.percentile_approx(F.when(_within(x, t), x), F.array(*[F.lit(p) for p in probs]), ACCURACY).alias(f"b{i}"))
    row = df.agg(*aggs).first()
    for i, t in enumerate(targets):
        t.lo, t.hi = (float(v) for v in row[f"b{i}"])


def _count_insides(df: DataFrame, targets: list[_Target], values: dict[str, Column]) -> None:
    aggs = []
    for i, t in enumerate(targets):
        x = values[t.column]
        aggs += [F.count_if(x < F.lit(t.lo)).alias(f"u{i}"), F.count_if(_within(x, t)).alias(f"n{i}")]
    row = df.agg(*aggs).first()
    for i, t in enumerate(targets):
        t.below, t.inside = row[f"u{i}"], row[f"n{i}"]


def _merged(targets: list[_Target]) -> list[tuple[float, float]]:
    """Disjoint ascending brackets that cover those of ``targets`` (of one column)."""
    out: list[list[float]] = []
    for lo, hi in sorted(((t.lo, t.hi) for t in targets), key=lambda b: (_order(b[0]), _order(b[1]))):
        if out and _order(lo) <= _order(out[-1][1]):
            out[-1][1] = max(out[-1][1], hi, key=_order)
        else:
            out.append([lo, hi])
    return [tuple(b) for b in out]


def _order(v: float) -> tuple[bool, float]:
    """Spark's order of doubles: NaN is the greatest."""
    return math.isnan(v), 0.0 if math.isnan(v) else v


def _sections(x: Column, brackets: list[tuple[float, float]]) -> Column:
    """(section, value): 2 i + 1 inside bracket i with the value, the even numbers between them without."""
    out = F.struct(F.lit(2 * len(brackets)).alias("s"), F.lit(None).cast("double").alias("v"))
    for i in reversed(range(len(brackets))):
        lo, hi = brackets[i]
        out = F.when(x < F.lit(lo), F.struct(F.lit(2 * i).alias("s"), F.lit(None).cast("double").alias("v"))) \
            .when(x <= F.lit(hi), F.struct(F.lit(2 * i + 1).alias("s"), x.alias("v"))).otherwise(out)
    return out


def _select(df: DataFrame, targets: list[_Target], values: dict[str, Column]) -> dict[tuple[str, int], float]:
    """Values of the ranks (and their successors) that the brackets hold."""
    by_column: dict[str, list[_Target]] = {}
    for t in targets:
        by_column.setdefault(t.column, []).append(t)
    cells = [F.when(values[c].isNotNull(), F.struct(F.lit(c).alias("c"), _sections(values[c], _merged(ts)).alias("x")))
             for c, ts in by_column.items()]
    counts = df.select(F.explode(F.array_compact(F.array(*cells))).alias("e")) \
        .groupBy(F.col("e.c").alias("c"), F.col("e.x.s").alias("s"), F.col("e.x.v").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    # Rows before a section, from its column's few sections; rows before a value, inside its bracket alone.
    sizes = counts.groupBy("c", "s").agg(F.sum("n").alias("n"))
    start = sizes.select("c", "s", (F.sum("n").over(Window.partitionBy("c").orderBy("s")) - F.col("n")).alias("start"))
    upto = F.sum("n").over(Window.partitionBy("c", "s").orderBy("v"))
    ranked = counts.where("v is not null").select("c", "s", "v", "n", upto.alias("upto")).join(F.broadcast(start), ["c", "s"]) \
        .select("c", "v", (F.col("start") + F.col("upto") - F.col("n")).alias("first"), (F.col("start") + F.col("upto")).alias("end"))
    wanted = {c: sorted({k for t in ts for k in (t.rank, t.rank + 1)}) for c, ts in by_column.items()}
    hit = F.lit(False)
    for c, ranks in wanted.items():
        here = F.exists(F.array(*[F.lit(k).cast("long") for k in ranks]), lambda k: (k >= F.col("first")) & (k < F.col("end")))
        hit = hit | ((F.col("c") == c) & here)
    found = {}
    for r in ranked.where(hit).collect():           # at most two rows for each wanted rank
        for k in wanted[r["c"]]:
            if r["first"] <= k < r["end"]:
                found[r["c"], k] = r["v"]
    return found


def exact_quantiles(df: DataFrame, wanted: dict[str, list[float]], values: dict[str, Column] | None = None) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of each column (NULL is left out; None where nothing is left).

    ``wanted`` maps a column to probabilities; ``values`` to an expression other
    than the column itself as double.  NaN is the greatest value.
    """
    if not wanted:
        return {}
    values = {c: F.col(c).cast("double") for c in wanted} | (values or {})
    first = {c: i for i, c in enumerate(wanted)}
    # Counts and first brackets in one aggregate: the sketch takes probabilities, so it needs no count.
    aggs = []
    for c, i in first.items():
        probs = sorted({p for q in wanted[c] for p in (max(0.0, q - _SLACK), min(1.0, q + _SLACK))})
        aggs += [F.count(values[c]).alias(f"n{i}"), F.percentile_approx(values[c], F.array(*[F.lit(p) for p in probs]), ACCURACY).alias(f"q{i}"),
                 F.min(values[c]).alias(f"lo{i}"), F.max(values[c]).alias(f"hi{i}")]
    row = df.agg(*aggs).first()
    targets: dict[tuple[str, int], _Target] = {}
    place: dict[str, list[float]] = {}
    for c, i in first.items():
        n = row[f"n{i}"]
        place[c] = [q * (n - 1) for q in wanted[c]] if n else []
        probs = sorted({p for q in wanted[c] for p in (max(0.0, q - _SLACK), min(1.0, q + _SLACK))})
        at = dict(zip(probs, row[f"q{i}"] or []))
        for q, x in zip(wanted[c], place[c]):
            t = targets.setdefault((c, math.floor(x)), _Target(c, math.floor(x)))
            t.inside = n
            small = 4 / n > _SLACK                  # a few rows: a bracket's rounding may not hold the successor
            t.lo = row[f"lo{i}"] if small or q <= _SLACK else float(at[max(0.0, q - _SLACK)])
            t.hi = row[f"hi{i}"] if small or q >= 1 - _SLACK else float(at[min(1.0, q + _SLACK)])
            t.inside = n if small else int(n * 3 * _SLACK) + 1
    found: dict[tuple[str, int], float] = {}
    todo = list(targets.values())
    while todo:
        large = [t for t in todo if t.inside > SORT_ROWS]
        while large:
            _count_insides(df, large, values)
            large = [t for t in large if t.inside > SORT_ROWS and _order(t.lo) < _order(t.hi)]
            if large:
                _sketch(df, large, values)
                _count_insides(df, large, values)
                large = [t for t in large if t.inside > SORT_ROWS and _order(t.lo) < _order(t.hi)]
        found |= _select(df, todo, values)
        n_of = {c: row[f"n{i}"] for c, i in first.items()}
        todo = [t for t in todo if (t.column, t.rank) not in found or
                (t.rank + 1 < n_of[t.column] and (t.column, t.rank + 1) not in found)]
        for t in todo:                              # the bracket missed its rank: take the whole column
            i = first[t.column]
            t.lo, t.hi, t.below, t.inside = row[f"lo{i}"], row[f"hi{i}"], 0, n_of[t.column]
    out: dict[str, list[float | None]] = {}
    for c in wanted:
        out[c] = []
        for x in place[c] or [None] * len(wanted[c]):
            if x is None:
                out[c].append(None)
                continue
            k = math.floor(x)
            a, b = found[c, k], found.get((c, k + 1), found[c, k])
            out[c].append(a if x == k else (k + 1 - x) * a + (x - k) * b)
    return out
