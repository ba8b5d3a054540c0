"""Exact, interpolated quantiles without gathering the values in one place.

Spark's ``percentile`` keeps every distinct value of a group in one buffer.
Here a bounded sketch (``percentile_approx``) only proposes an interval around
each wanted rank, exact counts confirm or narrow it, and the values inside the
final narrow interval are counted per value and ranked. Each pass is a scan
with a tiny aggregate; no pass shuffles the data. Copies of one value collapse
into one counted row, so a value held by a third of all rows costs nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from featloom.functions.columns import as_double, batches, col

SKETCH_ACCURACY = 10_000
INSIDE_LIMIT = 1_000_000  # values ranked in one window at the end
MARGIN = 3.0 / SKETCH_ACCURACY
MAX_ROUNDS = 25  # each shrinks the inside a thousandfold


class _Cut:
    """Interval [lo, hi] known to hold ranks k0 and k1 of one group's column."""

    def __init__(self, group, column, p, n):
        self.group, self.column, self.p, self.n = group, column, p, n
        position = (n - 1) * p
        self.k0 = int(math.floor(position))
        self.k1 = min(self.k0 + 1, n - 1)
        self.share = position - self.k0
        self.lo = self.hi = None
        self.below = self.mid = self.upto_hi = 0

    def holds_ranks(self, below, upto_hi):
        return below <= self.k0 and self.k1 < upto_hi


def exact_quantiles(
    df: DataFrame,
    columns: list[str],
    probabilities: list[float],
    by: str | None = None,
    inside_limit: int = INSIDE_LIMIT,
) -> dict:
    """``{(group, column): [quantile per probability]}``; None for empty columns.

    ``group`` is None without ``by``. ``by`` must have few values (classes of a
    chart), because one row per group comes back to the caller.
    """
    wanted = sorted(set(probabilities))
    groups = batches(columns, 2 * len(wanted))  # a few counts each, a compiled method's worth
    if len(groups) > 1:
        result = {}
        for group in groups:  # every group scans its own columns only
            result.update(exact_quantiles(df, group, probabilities, by, inside_limit))
        return result
    data = df.select(*([col(by).alias("__g")] if by else [F.lit(None).cast("string").alias("__g")]),
                     *[as_double(c).alias(f"c{i}") for i, c in enumerate(columns)])
    names = {c: f"c{i}" for i, c in enumerate(columns)}

    cuts = _propose(data, columns, names, wanted, by is not None)
    _confirm(data, names, cuts, inside_limit)
    values = _pick(data, names, cuts)

    result = {}
    for group, column in {(c.group, c.column) for c in cuts}:
        per_p = {c.p: values[i] for i, c in enumerate(cuts) if (c.group, c.column) == (group, column)}
        result[group, column] = [per_p[p] for p in probabilities]
    for column in columns:
        if by is None:
            result.setdefault((None, column), [None] * len(probabilities))
    return result


def _grouped(data: DataFrame, grouped: bool):
    return data.groupBy("__g") if grouped else data.groupBy()


def _propose(data, columns, names, wanted, grouped) -> list[_Cut]:
    grid = sorted({min(max(p + s * MARGIN, 0.0), 1.0) for p in wanted for s in (-1, 1)})
    aggregates = []
    for c in columns:
        x = F.col(names[c])
        aggregates += [
            F.count(x).alias(f"{names[c]}_n"),
            F.min(x).alias(f"{names[c]}_min"),
            F.max(x).alias(f"{names[c]}_max"),
            F.percentile_approx(x, grid, SKETCH_ACCURACY).alias(f"{names[c]}_q"),
        ]
    cuts = []
    for row in _grouped(data, grouped).agg(*aggregates).collect():
        for c in columns:
            n, low, high, sketch = (row[f"{names[c]}_{s}"] for s in ("n", "min", "max", "q"))
            if not n:
                continue
            at = dict(zip(grid, sketch))
            for p in wanted:
                cut = _Cut(row["__g"] if grouped else None, c, p, n)
                cut.min, cut.max = low, high
                cut.lo = low if p - MARGIN <= 0 else at[p - MARGIN]
                cut.hi = high if p + MARGIN >= 1 else at[p + MARGIN]
                cuts.append(cut)
    return cuts


def _bound_columns(data: DataFrame, names, cuts: list[_Cut]):
    """Give every row the interval bounds of its own group.

    Without groups the bounds are literals. With groups they come from a
    broadcast table of one row per group (chart classes, collected above).
    """
    grouped = any(c.group is not None for c in cuts)
    slots = sorted({(c.column, c.p) for c in cuts})
    index = {slot: i for i, slot in enumerate(slots)}
    if not grouped:
        bounds = {index[c.column, c.p]: (F.lit(c.lo), F.lit(c.hi)) for c in cuts}
        return data, index, bounds
    spark = data.sparkSession
    table = {}
    for c in cuts:
        row = table.setdefault(c.group, {})
        row[index[c.column, c.p]] = (c.lo, c.hi)
    fields = [f"g {data.schema['__g'].dataType.simpleString()}"]
    fields += [f"lo{i} double, hi{i} double" for i in range(len(slots))]
    rows = [
        (g, *[v for i in range(len(slots)) for v in row.get(i, (None, None))])
        for g, row in table.items()
    ]
    side = F.broadcast(spark.createDataFrame(rows, ", ".join(fields)))
    joined = data.join(side, F.col("__g").eqNullSafe(F.col("g")), "inner").drop("g")
    bounds = {i: (F.col(f"lo{i}"), F.col(f"hi{i}")) for i in range(len(slots))}
    return joined, index, bounds


def _confirm(data, names, cuts: list[_Cut], inside_limit: int) -> None:
    """Count around the bounds; narrow until few values lie strictly inside."""
    open_cuts = list(cuts)
    for _ in range(MAX_ROUNDS):
        if not open_cuts:
            return
        _count(data, names, open_cuts)
        missed = [c for c in open_cuts if not c.holds_ranks(c.below, c.upto_hi)]
        for c in missed:  # the sketch was off: start again from the full range
            c.lo, c.hi = c.min, c.max
        wide = [c for c in open_cuts if c not in missed and c.mid > max(inside_limit, 1)]
        if wide:
            _narrow(data, names, wide)
        open_cuts = missed + wide
    raise RuntimeError(f"quantile intervals did not settle in {MAX_ROUNDS} rounds; are NaN values left?")


def _count(data, names, cuts: list[_Cut]) -> None:
    rows, index, bounds = _bound_columns(data, names, cuts)
    aggregates = []
    for (column, _), i in index.items():
        x, (lo, hi) = F.col(names[column]), bounds[i]
        for tag, test in (("a", x < lo), ("b", (x > lo) & (x < hi)), ("c", x <= hi)):
            aggregates.append(F.count_if(test).alias(f"{tag}{i}"))
    grouped = any(c.group is not None for c in cuts)
    found = {(r["__g"] if grouped else None): r for r in _grouped(rows, grouped).agg(*aggregates).collect()}
    for c in cuts:
        row, i = found[c.group], index[c.column, c.p]
        c.below, c.mid, c.upto_hi = row[f"a{i}"], row[f"b{i}"], row[f"c{i}"]


def _narrow(data, names, cuts: list[_Cut]) -> None:
    """New bounds from a sketch of only the values strictly inside.

    A value with many copies becomes a bound itself and leaves the inside, so
    every round shrinks the inside by about the sketch accuracy.
    """
    rows, index, bounds = _bound_columns(data, names, cuts)
    grouped = any(c.group is not None for c in cuts)
    copies = _grouped(rows, grouped).agg(
        *[F.count_if(F.col(names[column]) == bounds[i][0]).alias(f"e{i}") for (column, _), i in index.items()]
    )
    at_lo = {(r["__g"] if grouped else None): r for r in copies.collect()}
    grid = {}
    for c in cuts:
        before = c.below + at_lo[c.group][f"e{index[c.column, c.p]}"]
        c.low_p, c.high_p = (c.k0 - before) / c.mid - MARGIN, (c.k1 - before) / c.mid + MARGIN
        grid.setdefault(index[c.column, c.p], set()).update(
            min(max(p, 0.0), 1.0) for p in (c.low_p, c.high_p)
        )
    aggregates = []
    for (column, _), i in index.items():
        x, (lo, hi) = F.col(names[column]), bounds[i]
        inside = F.when((x > lo) & (x < hi), x)
        aggregates.append(F.percentile_approx(inside, sorted(grid[i]), SKETCH_ACCURACY).alias(f"q{i}"))
    found = {(r["__g"] if grouped else None): r for r in _grouped(rows, grouped).agg(*aggregates).collect()}
    for c in cuts:
        i = index[c.column, c.p]
        at = dict(zip(sorted(grid[i]), found[c.group][f"q{i}"]))
        if c.low_p > 0:
            c.lo = at[min(c.low_p, 1.0)]
        if c.high_p < 1:
            c.hi = at[max(c.high_p, 0.0)]


def _pick(data, names, cuts: list[_Cut]) -> dict:
    """Rank the counted values inside each interval and interpolate."""
    values = {i: c.lo for i, c in enumerate(cuts) if c.lo == c.hi}
    todo = [c for c in cuts if c.lo != c.hi]
    if todo:
        rows, index, bounds = _bound_columns(data, names, todo)
        hits: list[Column] = []
        for (column, _), i in index.items():
            x, (lo, hi) = F.col(names[column]), bounds[i]
            hits.append(F.when(x.between(lo, hi), F.struct(F.lit(i).alias("slot"), x.alias("x"))))
        # No filter in front: a condition over many columns takes the planner exponential time.
        counted = (
            rows.select("__g", F.explode(F.array_compact(F.array(*hits))).alias("hit"))
            .groupBy("__g", "hit.slot", "hit.x").agg(F.count(F.lit(1)).alias("n"))
        )
        running = F.sum("n").over(
            Window.partitionBy("__g", "slot").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
        )
        kind = data.schema["__g"].dataType.simpleString()
        ranks = data.sparkSession.createDataFrame(
            [(c.group, index[c.column, c.p], c.k0 - c.below, c.k1 - c.below) for c in todo],
            f"g {kind}, slot int, r0 bigint, r1 bigint",
        )
        picked = (
            counted.withColumn("upto", running).alias("v")
            .join(F.broadcast(ranks.alias("k")),  # one row per group, column and probability
                  (F.col("v.slot") == F.col("k.slot")) & F.col("__g").eqNullSafe(F.col("g")))
            .where((F.col("upto") > F.col("r0")) & (F.col("upto") - F.col("n") <= F.col("r1")))
            .select("g", "v.slot", "x", "upto")
            .collect()  # one or two values per rank
        )
        found = {}
        for row in picked:
            found.setdefault((row["g"], row["slot"]), []).append((row["x"], row["upto"]))
        for i, c in enumerate(cuts):
            if i in values:
                continue
            pair = sorted(found[c.group, index[c.column, c.p]])
            first = next(x for x, upto in pair if upto > c.k0 - c.below)
            second = next(x for x, upto in pair if upto > c.k1 - c.below)
            values[i] = first + (second - first) * c.share
    return values
