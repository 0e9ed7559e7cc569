"""Tolerant comparison of two tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table_diff(left: DataFrame, right: DataFrame, key: list[str], rtol: float = 1e-9, atol: float = 1e-10) -> DataFrame:
    """Per shared column: rows compared, rows that differ, largest numeric difference, rows on one side only.

    Numbers differ if |a-b| > atol + rtol*|b|; other values if not equal, null equal to null.
    Keys must be unique on both sides.
    """
    numeric = {c for c, t in left.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint")}
    shared = [c for c in left.columns if c in right.columns and c not in key]
    a = left.select(*key, F.struct(*shared).alias("a"))
    b = right.select(*key, F.struct(*shared).alias("b"))
    both = a.join(b, key, "full")
    aggs = []
    for c in shared:
        x, y = F.col(f"a.`{c}`"), F.col(f"b.`{c}`")
        present = F.col("a").isNotNull() & F.col("b").isNotNull()
        if c in numeric:
            off = F.coalesce(F.abs(x - y) > atol + rtol * F.abs(y), x.isNull() != y.isNull())
            far = F.max(F.when(present, F.abs(x - y).cast("double")))
        else:
            off, far = ~x.eqNullSafe(y), F.lit(None).cast("double")
        aggs += [F.sum((present & off).cast("long")).alias(f"off_{c}"), far.alias(f"far_{c}")]
    one = both.agg(F.count(F.lit(1)).alias("rows"), F.sum((F.col("a").isNull() | F.col("b").isNull()).cast("long")).alias("one_sided"), *aggs)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"off_{c}").alias("differing"), F.col(f"far_{c}").alias("largest")) for c in shared])
    return one.select("rows", "one_sided", F.inline(cells))
