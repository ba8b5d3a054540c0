"""Categorical encodings: fit a level table, look it up, add indicator columns."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame, functions as F

from featloom.functions.columns import col, level_key, unpivot
from featloom.operators.ranking import rank_levels
from featloom.session import cut_lineage

SMALL_LEVELS = 100_000  # level rows that may come to the driver and be broadcast …
SMALL_BYTES = 32 * 2**20  # … and the size of their texts together
HOT_SHARE = 0.001  # a level above this share of the rows at hand is looked up by broadcast
LEVELS_PER_STRETCH = 500_000  # levels sorted by one task
MISSING_CLASS = "nan"


@dataclass
class LevelTable:
    """Levels of one column with their counts and label codes.

    ``rows`` is set when the table is small; otherwise ``table`` is a
    checkpointed DataFrame of ``level, n, code, all_rows``: ``n`` counts present
    values, ``all_rows`` also the missing ones of the class ``'nan'``.
    """

    column: str
    total: int  # rows with a present value
    n_levels: int  # label classes (missing counts as a class)
    rows: list[tuple] | None = None
    table: DataFrame | None = None
    missing: int = 0

    def frame(self, spark) -> DataFrame:
        if self.table is not None:
            return self.table
        return spark.createDataFrame(self.rows, "level string, n bigint, code bigint")


def fit_levels(df: DataFrame, columns: list[str], small_limit: int = SMALL_LEVELS) -> dict[str, LevelTable]:
    """Count the levels of all columns in one grouping and rank them by text.

    Missing values belong to the class ``'nan'`` for codes. Up to
    ``small_limit`` level rows are fetched, after a check of their number and
    size; beyond that the counts stay distributed.
    """
    counts = unpivot(df, columns, "string").groupBy("feature", F.col("value").alias("level")).agg(
        F.count(F.lit(1)).alias("n")
    ).persist()  # counted once, whichever way it goes on
    try:
        size = counts.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("level")).alias("bytes")).first()
        if size["rows"] <= small_limit and (size["bytes"] or 0) <= SMALL_BYTES:
            fetched = counts.collect()
            return {c: _small_table(c, [r for r in fetched if r["feature"] == c]) for c in columns}
        stored = cut_lineage(counts)
    finally:
        counts.unpersist()
    return {c: _large_table(c, stored.where(F.col("feature") == c)) for c in columns}


def _small_table(column: str, rows) -> LevelTable:
    present = {r["level"]: r["n"] for r in rows if r["level"] is not None}
    missing = sum(r["n"] for r in rows if r["level"] is None)
    classes = sorted(set(present) | ({MISSING_CLASS} if missing else set()))
    coded = [(level, present.get(level, 0), code) for code, level in enumerate(classes)]
    return LevelTable(column, sum(present.values()), len(classes), rows=coded, missing=missing)


def _large_table(column: str, counts: DataFrame) -> LevelTable:
    facts = counts.agg(
        F.sum(F.when(F.col("level").isNotNull(), F.col("n"))).alias("total"),
        F.sum(F.when(F.col("level").isNull(), F.col("n"))).alias("missing"),
        F.count(F.lit(1)).alias("levels"),
    ).first()
    classes = counts.select(
        F.coalesce("level", F.lit(MISSING_CLASS)).alias("level"),
        F.when(F.col("level").isNotNull(), F.col("n")).otherwise(0).alias("present"),
        "n",
    ).groupBy("level").agg(F.sum("present").alias("n"), F.sum("n").alias("all_rows"))
    stretches = max(2, math.ceil(facts["levels"] / LEVELS_PER_STRETCH))
    table = cut_lineage(rank_levels(classes, partitions=stretches))
    return LevelTable(column, facts["total"] or 0, table.count(), table=table, missing=facts["missing"] or 0)


def _lookup(df: DataFrame, key: Column, levels: LevelTable, value: Column, out: str) -> DataFrame:
    """Left join of a level's value; NULL where the level is unknown.

    A small table is broadcast. With a large one the rows are split into two
    frames. Rows without a key, and rows of levels that hold more than
    ``HOT_SHARE`` of the table at hand (at most 1/HOT_SHARE of them, known to
    the fit or not), are answered by a broadcast and never shuffle. Only rows
    of rarer levels meet in the join.
    """
    side = levels.frame(df.sparkSession).withColumn(out, value)
    if levels.table is None:
        small = F.broadcast(side.select(F.col("level").alias("__k"), out))
        return df.withColumn("__k", key).join(small, "__k", "left").drop("__k")
    side = side.select(level_key(F.col("level")).alias("__k"), out)
    keyed = df.withColumn("__k", level_key(key))
    counts = keyed.where(F.col("__k").isNotNull()).groupBy("__k").agg(F.count(F.lit(1)).alias("__n"))
    floor = HOT_SHARE * keyed.count()
    hot = cut_lineage(counts.where(F.col("__n") > floor).join(side, "__k", "left").select("__k", F.col(out).alias("__hot"), F.lit(True).alias("__is_hot")))
    marked = keyed.join(F.broadcast(hot), "__k", "left")
    easy = marked.where(F.col("__is_hot") | F.col("__k").isNull()).withColumn(out, F.col("__hot"))
    rest = marked.where(F.col("__is_hot").isNull() & F.col("__k").isNotNull()).join(side, "__k", "left")
    columns = [*[col(c) for c in df.columns], col(out)]
    return easy.select(*columns).unionByName(rest.select(*columns))


def attach_codes(
    df: DataFrame, column: str, levels: LevelTable, out: str,
    missing: str | None = MISSING_CLASS, on_unseen: str = "error",
) -> DataFrame:
    """Label codes of ``column`` as ``out``.

    ``on_unseen``: ``error`` fails the job when a level was not seen in fit,
    ``null`` and ``minus_one`` keep the row.
    """
    text = col(column).cast("string")
    key = F.coalesce(text, F.lit(missing)) if missing is not None else text
    joined = _lookup(df, key, levels, F.col("code"), "__code")
    code = F.col("__code")
    if on_unseen == "error":
        code = F.coalesce(code, F.raise_error(F.concat(
            F.lit(f"{column} contains a level not seen in fit: "), F.coalesce(text, F.lit(MISSING_CLASS))
        )).cast("bigint"))
    elif on_unseen == "minus_one":
        code = F.coalesce(code, F.lit(-1))
    elif on_unseen != "null":
        raise ValueError(f"unknown on_unseen: {on_unseen}")
    return joined.withColumn(out, code.cast("bigint")).drop("__code")


def name_codes(df: DataFrame, code: Column, levels: LevelTable, out: str) -> DataFrame:
    """The level of each label code as ``out``; the other way round, with the same care for hot ones."""
    named = levels.frame(df.sparkSession).select(F.col("code").cast("string").alias("level"), F.col("level").alias("__name"))
    rows = None if levels.rows is None else [(str(c), level) for level, _, c in levels.rows]
    turned = _NamedCodes(levels.column, levels.total, levels.n_levels, rows=rows, table=None if rows is not None else named)
    return _lookup(df, code.cast("string"), turned, F.col("__name"), out)


class _NamedCodes(LevelTable):
    def frame(self, spark) -> DataFrame:
        return self.table if self.table is not None else spark.createDataFrame(self.rows, "level string, __name string")


def label_encode(df: DataFrame, tables: dict[str, LevelTable], on_unseen: str = "error") -> DataFrame:
    order = df.columns
    for c, levels in tables.items():
        df = attach_codes(df, c, levels, c, on_unseen=on_unseen)
    return df.select(*[col(c) for c in order])


def frequency_encode(df: DataFrame, tables: dict[str, LevelTable]) -> DataFrame:
    """Share of present rows holding the level; 0 for missing or unseen."""
    order = df.columns
    for c, levels in tables.items():
        share = F.col("n").cast("double") / F.lit(float(max(levels.total, 1)))
        df = _lookup(df, col(c).cast("string"), levels, share, "__f")
        df = df.withColumn(c, F.coalesce(F.when(col(c).isNotNull(), F.col("__f")), F.lit(0.0))).drop("__f")
    return df.select(*[col(c) for c in order])


@dataclass(frozen=True)
class OneHotSlots:
    """Slots of the sparse vector ``{column}_vec``: one per level in text order, then one for missing values.

    ``counts`` holds the rows of each slot in the fit, ``rows`` their number. ``names`` is None where
    the levels were not fetched; ``name_of`` then asks for single ones.
    """

    levels: LevelTable
    gap: int | None  # label code of the missing class where no level has that text
    counts: np.ndarray
    names: list[str] | None

    @property
    def column(self) -> str:
        return self.levels.column

    @property
    def vector(self) -> str:
        return f"{self.column}_vec"

    @property
    def size(self) -> int:
        return len(self.counts)

    @property
    def rows(self) -> int:
        return self.levels.total + self.levels.missing

    def _missing_name(self) -> str:
        return f"{self.column}_{MISSING_CLASS}" + ("" if self.gap is not None else "_missing")

    def _slot_of(self, code: Column) -> Column:
        return code if self.gap is None else F.when(code < self.gap, code).when(code > self.gap, code - 1)

    def name_of(self, slots: list[int]) -> dict[int, str]:
        if self.names is not None:
            return {i: self.names[i] for i in slots}
        last = self.size - 1 if self.levels.missing else None
        found = self.levels.table.withColumn("slot", self._slot_of(F.col("code"))).where(F.col("slot").isin([i for i in slots if i != last]))
        out = {r["slot"]: f"{self.column}_{r['level']}" for r in found.select("slot", "level").collect()}
        return out | ({last: self._missing_name()} if last in slots else {})

    def slot_named(self, name: str) -> int | None:
        """The slot of a name ``{column}_{level}``."""
        if self.names is not None:
            return self.names.index(name) if name in self.names else None
        if self.levels.missing and name == self._missing_name():
            return self.size - 1
        level = name[len(self.column) + 1:]
        if not name.startswith(f"{self.column}_"):
            return None
        found = self.levels.table.where(F.col("level") == level).select(self._slot_of(F.col("code")).alias("slot")).first()
        return found["slot"] if found else None

    def attach(self, df: DataFrame, out: str) -> DataFrame:
        """The slot of each row as ``out``; null for a level not seen in fit, and for missing values if none were."""
        coded = attach_codes(df, self.column, self.levels, out, missing=None, on_unseen="null")
        missing = F.lit(self.size - 1 if self.levels.missing else None).cast("long")
        return coded.withColumn(out, F.when(col(self.column).isNull(), missing).otherwise(self._slot_of(F.col(out))))


def one_hot_slots(levels: LevelTable) -> OneHotSlots:
    if levels.rows is not None:
        own = next((r for r in levels.rows if r[0] == MISSING_CLASS), None)
        present = [(level, n) for level, n, _ in sorted(levels.rows, key=lambda r: r[2]) if n]
        counts = [n for _, n in present]
    else:
        own = levels.table.where(F.col("level") == MISSING_CLASS).select("level", "n", "code").first()
        # One number per slot: a model on these slots holds as many in the driver.
        present, counts = None, [r["n"] for r in levels.table.where(F.col("n") > 0).select("code", "n").orderBy("code").toLocalIterator()]
    gap = own[2] if own and not own[1] else None
    slots = OneHotSlots(levels, gap, np.array([*counts, *([levels.missing] if levels.missing else [])], np.int64), None)
    if present is None:
        return slots
    names = [f"{levels.column}_{level}" for level, _ in present] + ([slots._missing_name()] if levels.missing else [])
    return replace(slots, names=names)


def one_hot_vector(df: DataFrame, slots: OneHotSlots) -> DataFrame:
    """``{column}_vec`` at the right instead of the column; slot names go along as column metadata."""
    at = f"__i_{slots.column}"
    coded = slots.attach(df, at).withColumn(at, F.coalesce(F.col(at), F.lit(slots.size)).cast("double"))
    # An indexer range of known size: the slot after the last stands for no slot at all.
    sized = df.sparkSession.createDataFrame([(float(slots.size),)], f"`{at}` double")
    encoder = OneHotEncoder(inputCol=at, outputCol=slots.vector, dropLast=True)
    made = encoder.fit(sized).transform(coded)
    # Numeric, not binary: slots may be scaled, and trees take binary slots for categories 0 and 1.
    names = {} if slots.names is None else {"attrs": {"numeric": [{"idx": i, "name": n} for i, n in enumerate(slots.names)]}}
    vector = col(slots.vector).alias(slots.vector, metadata={"ml_attr": {**names, "num_attrs": slots.size}})
    return made.select(*[col(c) for c in df.columns if c != slots.column], vector)


def one_hot_encode(df: DataFrame, tables: dict[str, LevelTable], form: str = "columns") -> DataFrame:
    """Missing is a level of its own, an unseen level gives all zeros; originals are removed.

    ``form="columns"`` adds indicator columns ``{column}_{level}`` at the right, for any number of
    levels that were fetched; ``form="vector"`` adds one sparse vector ``{column}_vec`` per feature,
    for any number at all. The form never depends on the data.
    """
    if form == "vector":
        for levels in tables.values():
            df = one_hot_vector(df, one_hot_slots(levels))
        return df
    if form != "columns":
        raise ValueError(f"unknown one-hot form: {form!r}; use 'columns' or 'vector'")
    large = [c for c, levels in tables.items() if levels.rows is None]
    if large:
        raise ValueError(f"too many levels for indicator columns in {large}; use the form 'vector'")
    indicators = []
    for c, levels in tables.items():
        for level, n, _ in levels.rows:
            if n:
                indicators.append(F.when(col(c).eqNullSafe(F.lit(level)), 1.0).otherwise(0.0).alias(f"{c}_{level}"))
        if levels.missing:
            indicators.append(F.when(col(c).isNull(), 1.0).otherwise(0.0).alias(one_hot_slots(levels).names[-1]))
    return df.select(*[col(c) for c in df.columns if c not in tables], *indicators)
