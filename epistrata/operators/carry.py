"""Values carried along a sequence of any length: windows over bounded cells, and one row a cell carried from cell to cell."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from epistrata.runtime import c, settled


def known_around(df: DataFrame, keys: Sequence[str], cell: Column, order: Sequence[Column], value: Column, before: str, after: str, order_after: Sequence[Column] | None = None) -> DataFrame:
    """Adds ``before`` and ``after``: the last value that is not null at or before each row of its keys, and the first at or after it.

    ``cell`` must rise with the order. A window takes one cell, so a sequence with a third of all rows is the work of as many tasks as it has cells; what
    a cell has not got comes from its neighbours' edges, by windows over one row a cell. Null keys and cells are values of their own.
    ``order_after`` is the order for ``after`` where ties are broken otherwise.
    """
    later = list(order_after or order)
    rows = settled(df.withColumn("__c", cell).withColumn("__v", value), "carry")
    at = [*keys, "__c"]
    upto = lambda w: F.last("__v", True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    w = Window.partitionBy(*[c(k) for k in at])
    inside = rows.select("*", upto(w.orderBy(*order)).alias("__b"), upto(w.orderBy(*[o.desc() for o in later])).alias("__a"))
    known = F.col("__v").isNotNull()
    ends = rows.groupBy(*[c(k) for k in at]).agg(F.max_by("__v", F.when(known, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))).alias("__hi"), F.min_by("__v", F.when(known, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(later)]))).alias("__lo"))
    k = Window.partitionBy(*[c(k) for k in keys])
    rest = lambda w, col: F.last(col, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.select(*[c(n).alias(f"__k{i}") for i, n in enumerate(at)], rest(k.orderBy("__c"), "__hi").alias("__pb"), rest(k.orderBy(F.desc("__c")), "__lo").alias("__pa"))
    same = [c(n).eqNullSafe(F.col(f"__k{i}")) for i, n in enumerate(at)]
    near = inside.join(carried, same, "left")
    return near.select(*[c(n) for n in df.columns], F.coalesce("__b", "__pb").alias(before), F.coalesce("__a", "__pa").alias(after))
