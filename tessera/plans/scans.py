"""Running sums over a whole table, in two levels, so that no task holds more than a range of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.tables import saved


def sums_before(table: DataFrame, order: list[Column | str], sums: dict[str, Column]) -> DataFrame:
    """Adds for each name the sum of its column over all rows that come before a row; 0 for the first.

    The order has to be total.  Rows are split into ranges; the sums of whole ranges, a row for each,
    are added to running sums within them.  Nulls count as 0; an empty table stays empty.
    """
    parted = saved(table.withColumns({f"_of_{n}": F.coalesce(c, F.lit(0)) for n, c in sums.items()}).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    wholes = parted.groupBy("_part").agg(*(F.sum(f"_of_{n}").alias(f"_all_{n}") for n in sums))
    bases = wholes.select("_part", *(F.coalesce(F.sum(f"_all_{n}").over(earlier), F.lit(0)).alias(f"_base_{n}") for n in sums))
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = parted.join(F.broadcast(bases), "_part")
    return found.select(*table.columns, *((F.col(f"_base_{n}") + F.coalesce(F.sum(f"_of_{n}").over(within), F.lit(0))).alias(n) for n in sums))


def running_before(table: DataFrame, group: str, order: list[str], sums: dict[str, Column], maxima: dict[str, Column]) -> DataFrame:
    """Adds for each row the sums and maxima over the rows of its group that come before it in the order.

    As ``sums_before``: a group may hold most of the rows, so ranges of the whole order are scanned each
    by itself, after what earlier ranges hold of their group, one row for each range and group.  The
    order has to be total within a group; rows without a group form one.  First rows have a sum of 0 and no maximum.
    """
    inputs = {f"_of_{n}": F.coalesce(c, F.lit(0)) for n, c in sums.items()} | {f"_of_{n}": c for n, c in maxima.items()}
    parted = saved(table.withColumns(inputs).repartitionByRange(group, *order).withColumn("_part", F.spark_partition_id()))
    wholes = parted.groupBy("_part", group).agg(*(F.sum(f"_of_{n}").alias(f"_all_{n}") for n in sums), *(F.max(f"_of_{n}").alias(f"_all_{n}") for n in maxima))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range that the group is in
    bases = wholes.select(
        F.col("_part").alias("_base_part"), F.col(group).alias("_base_group"),
        *(F.coalesce(F.sum(f"_all_{n}").over(earlier), F.lit(0)).alias(f"_base_{n}") for n in sums), *(F.max(f"_all_{n}").over(earlier).alias(f"_base_{n}") for n in maxima),
    )
    within = Window.partitionBy("_part", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = parted.join(bases, (F.col("_part") == F.col("_base_part")) & F.col(group).eqNullSafe(F.col("_base_group")))
    return found.select(
        *table.columns, *((F.col(f"_base_{n}") + F.coalesce(F.sum(f"_of_{n}").over(within), F.lit(0))).alias(n) for n in sums),
        *(F.greatest(f"_base_{n}", F.max(f"_of_{n}").over(within)).alias(n) for n in maxima),
    )
