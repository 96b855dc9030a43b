"""Helpers that keep hot groups spread over many tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.session import written


def salted_join(
    rows: DataFrame, per_key: DataFrame, on: Sequence[str], spread: Sequence[str], how: str = "inner", salts: int = 16
) -> DataFrame:
    """Join a large table, where one key may hold a large share of the rows, to a table with one row per key.

    The rows of a key are dealt over ``salts`` buckets by a hash of ``spread`` and the small side is repeated
    once per bucket, so a hot key is worked on by up to ``salts`` tasks. Nothing is broadcast by force: Spark
    still does so by itself when its own size estimate allows it. ``how``: inner, left, left_semi, left_anti.
    """
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    right = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def prefix_sum(
    df: DataFrame, group: Sequence[str], order: str | Sequence[str], value: str, name: str, parts: int | None = None
) -> DataFrame:
    """Add ``name`` = sum of ``value`` over the earlier rows of the group, without one task per group.

    ``order`` may be any columns that can be sorted: sparse or negative numbers, text, times; rows of equal order follow
    each other in some order. Rows are dealt into ``parts`` ranges of (group, order), and written, so that a row's range is
    fixed. The sums of a group's ranges, at most as many as there are ranges, become offsets; rows only need a running
    sum inside their own range. One hot group is thus spread over its ranges, however its numbers lie.
    """
    order = [order] if isinstance(order, str) else list(order)
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(df.repartitionByRange(parts, *group, *order).withColumn("_range", F.spark_partition_id()), "prefix-sum")
    totals = rows.groupBy(*group, "_range").agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(g).alias(f"_of_{g}") for g in group], F.col("_range").alias("_of"), F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = [F.col(g).eqNullSafe(F.col(f"_of_{g}")) for g in group]
    return (
        rows.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(offsets, [F.col("_range") == F.col("_of"), *same])
        .withColumn(name, F.col("_offset") + F.col("_inside"))
        .drop("_range", "_inside", "_offset", "_of", *[f"_of_{g}" for g in group])
    )


# Spark cuts a ranking to its first rows before the shuffle up to this number of rows per group
GROUP_LIMIT = 1000


def top_rows(df: DataFrame, group: Sequence[str], order: Sequence, k: int, name: str = "rank", salts: int = 64) -> DataFrame:
    """First ``k`` rows per group, for any ``k`` without sorting a whole group in one task.

    Up to ``GROUP_LIMIT`` rows every task is cut to ``k`` rows per group before the shuffle by Spark itself. Beyond,
    each group is dealt over ``salts`` parts that are cut to ``k`` rows first.
    """
    if k > GROUP_LIMIT:
        part = F.pmod(F.xxhash64(*order_columns(df, order)), F.lit(salts))
        parts = Window.partitionBy(*group, "_part").orderBy(*order)
        df = df.withColumn("_part", part).withColumn("_nth", F.row_number().over(parts)).filter(F.col("_nth") <= k).drop("_part", "_nth")
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.filter(F.col(name) <= k)


def order_columns(df: DataFrame, order: Sequence) -> list:
    """Plain columns to deal rows by: all that can be hashed."""
    return [F.col(f"`{n}`") for n, kind in df.dtypes if not kind.startswith(("map", "variant"))]
