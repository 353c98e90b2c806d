"""Places and running sums over all rows, without a task that sees them all.

Rows are dealt to ranges of the order and sorted there; each range's totals
give what stands before the next one, and windows run within ranges. The order
must be total, or places of equal rows are arbitrary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written


def placed(df: DataFrame, order: list[Column], sums: dict[str, Column] | None = None, place: str = "place") -> DataFrame:
    """df with place (from 1) in ascending order of the columns, and the running sums of the named columns, own row included."""
    sums, spark = sums or {}, df.sparkSession
    keys, values = [f"_o{k}" for k in range(len(order))], [f"_v{k}" for k in range(len(sums))]
    keyed = df.withColumns(dict(zip(keys, order, strict=True)) | dict(zip(values, sums.values(), strict=True)))
    ranged = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id())
    rows = written(spark, ranged, "ordered")
    total = rows.groupBy("_part").agg(F.count("*").alias("_n"), *[F.sum(v).alias(f"_s{v}") for v in values])
    # one row for each range
    before = "OVER (ORDER BY _part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    offset = total.selectExpr("_part", f"coalesce(sum(_n) {before}, 0) AS _n0", *[f"coalesce(sum(_s{v}) {before}, 0) AS _s0{v}" for v in values])
    at = f"OVER (PARTITION BY _part ORDER BY {', '.join(keys)} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    own = [f"_n0 + row_number() OVER (PARTITION BY _part ORDER BY {', '.join(keys)}) AS {place}", *[f"_s0{v} + sum({v}) {at} AS {name}" for v, name in zip(values, sums, strict=True)]]
    kept = [f"`{c}`" for c in df.columns if c not in sums and c != place]
    return rows.join(offset, "_part").selectExpr(*kept, *own)
