"""Positions in a global order without sending all rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def global_rank(rows: DataFrame, coarse: list[Column], fine: list[Column], name: str = "rank") -> DataFrame:
    """1-based place of each row in the order of coarse, then fine keys.

    Rows are numbered inside each value of the coarse keys; the sizes of those
    values, one row each, are summed up in order and added.  Choose coarse keys
    with few values, such as a field or a date.
    """
    names = [f"_c{k}" for k in range(len(coarse))]
    keyed = rows.select("*", *[c.alias(n) for c, n in zip(coarse, names, strict=True)])
    sizes = keyed.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*[F.col(n).alias(f"_o{k}") for k, n in enumerate(names)], before.alias("_before"))
    own = keyed.withColumn("_own", F.row_number().over(Window.partitionBy(*names).orderBy(*fine)))
    same = F.lit(True)
    for k, n in enumerate(names):
        same = same & F.col(n).eqNullSafe(F.col(f"_o{k}"))
    return own.join(offsets, same).withColumn(name, F.col("_before") + F.col("_own")).select(*rows.columns, name)
