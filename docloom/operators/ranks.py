"""Ranks over a whole table without bringing its rows into one task: ranks are prefix sums over the counts of distinct values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.lookups import lookup
from docloom.sources.shared import Steps


def average_ranks(df: DataFrame, value: str) -> DataFrame:
    """Add avg_rank: ties share the mean of their places. Values are counted by range, ranges are summed, and only one row per
    range (their number is that of the shuffle's partitions) meets in one task."""
    counts = df.groupBy(F.col(value).alias("__v")).agg(F.count("*").alias("__n")).filter("__v is not null")
    ranged = counts.repartitionByRange("__v").withColumn("__p", F.spark_partition_id())
    totals = ranged.groupBy("__p").agg(F.sum("__n").alias("__t"))
    base = totals.withColumn("__base", F.coalesce(F.sum("__t").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.coalesce(F.sum("__n").over(Window.partitionBy("__p").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.withColumn("__own", own).join(base, "__p").select("__v", (F.col("__base") + F.col("__own") + 1 + (F.col("__n") - 1) / 2).alias("avg_rank"))
    # a value that very many rows have is looked up without bringing them together
    return lookup(df, placed.withColumnRenamed("__v", value), [value])


def medians(df: DataFrame, groups: list[str], value: str, name: str) -> DataFrame:
    """The exact median of each group's values that are not null (null for a group without any), as a double. Values are counted where they lie, their counts are dealt by range of group and
    value, and a median is where the counts pass the middle; so a group with all rows is spread over all tasks, and no task holds a group's values."""
    steps = Steps(df.sparkSession)
    key = F.struct(*groups) if groups else F.struct(F.lit(0).alias("all"))
    counts = df.select(key.alias("__k"), F.col(value).alias("__v")).groupBy("__k", "__v").agg(F.count("*").alias("__n"))
    ranged = steps.keep("ranged", counts.filter("__v is not null").repartitionByRange("__k", "__v").withColumn("__p", F.spark_partition_id()))
    totals = ranged.groupBy("__k", "__p").agg(F.sum("__n").alias("__t"))
    # a row for each range that a group has a part in
    before = F.coalesce(F.sum("__t").over(Window.partitionBy("__k").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = totals.select("__k", "__p", before.alias("__base"), F.sum("__t").over(Window.partitionBy("__k")).alias("__all"))
    own = F.sum("__n").over(Window.partitionBy("__k", "__p").orderBy("__v"))
    placed = ranged.withColumn("__own", own).join(base, ["__k", "__p"]).withColumn("__upto", F.col("__base") + F.col("__own"))
    low, high = F.floor((F.col("__all") - 1) / 2) + 1, F.floor(F.col("__all") / 2) + 1
    holds = lambda k: (F.col("__upto") >= k) & (F.col("__upto") - F.col("__n") < k)
    one = lambda k: F.max(F.when(holds(k), F.col("__v").cast("double")))
    mid = placed.filter(holds(low) | holds(high)).groupBy("__k").agg(((one(low) + one(high)) / 2).alias(name))
    every = df.select(key.alias("__k")).distinct().join(mid, "__k", "left") if groups else mid
    return steps.last(every.select(*(F.col(f"__k.{g}").alias(g) for g in groups), name))


def top_list(df: DataFrame, keys: list[str], k: int, value: Column, *order, name: str = "top") -> DataFrame:
    """(keys, name): the values of each key's first k rows by order, as an array. Each task finds its own first k before rows of a key meet, so that no key's rows are collected."""
    ranked = df.withColumn("__rk", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__rk") <= k)
    listed = F.array_sort(F.collect_list(F.struct("__rk", value.alias("v"))))
    return ranked.groupBy(*keys).agg(F.transform(listed, lambda x: x["v"]).alias(name))


def row_numbers(df: DataFrame, name: str, *order, tasks: int | None = None) -> DataFrame:
    """Add name = the row's place (from 1) by order, which must be total. Rows are dealt by range and counted; a task numbers one range, and only
    one row per range meets in one task. tasks: the number of ranges, if not the session's number of a shuffle."""
    ranged = (df.repartitionByRange(tasks, *order) if tasks else df.repartitionByRange(*order)).withColumn("__p", F.spark_partition_id())
    base = ranged.groupBy("__p").agg(F.count("*").alias("__n"))
    base = base.withColumn("__base", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    own = ranged.withColumn("__own", F.row_number().over(Window.partitionBy("__p").orderBy(*order)))
    return own.join(F.broadcast(base), "__p").withColumn(name, (F.col("__base") + F.col("__own")).cast("long")).drop("__p", "__own", "__base")
