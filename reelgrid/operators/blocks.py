"""Prefix operators over a long order, in blocks: windows stay within a block, and one row a block carries what went before.

A window over a run puts the run in one task. Where a run may hold a great part of all rows,
the operators that take `block` cut it into stretches of so many units of the order column:
totals of blocks are folded in order (one row a block) and joined back. The input is read
twice for it. Results are those of the window over the run; without `block` that is used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK = "_block"


def blocked(rows: DataFrame, order: str, block: int) -> DataFrame:
    """Adds the number of each row's block; rows of null order come first, as they do in a window."""
    return rows.withColumn(BLOCK, F.coalesce(F.floor(F.col(order) / block), F.lit(-(2**62))).cast("long"))


def in_block(run: str, order: str) -> WindowSpec:
    return Window.partitionBy(run, BLOCK).orderBy(order)


def with_prior(rows: DataFrame, run: str, totals: dict[str, Column], *folds: dict[str, Callable[[WindowSpec], Column]]) -> DataFrame:
    """Adds, to rows with block numbers, what the folds make of the totals of the run's earlier blocks; null in its first.

    Each fold gets the window over the earlier blocks; later folds see the columns of former ones.
    """
    before = Window.partitionBy(run).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    per = rows.groupBy(run, BLOCK).agg(*[c.alias(n) for n, c in totals.items()])
    names = []
    for fold in folds:
        per = per.withColumns({n: f(before) for n, f in fold.items()})
        names += list(fold)
    per = per.select(F.col(run).alias("_run"), F.col(BLOCK).alias("_at"), *names)
    return rows.join(per, F.col(run).eqNullSafe(F.col("_run")) & (F.col(BLOCK) == F.col("_at"))).drop("_run", "_at")
