"""Corpus curation: drop cascades, dedup inside a partition, trimming at the last marker, reconcile plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cascade(*rules: tuple[str, Column], keep: str = "keep") -> Column:
    """The name of the first rule that holds."""
    out = F.when(F.coalesce(rules[0][1], F.lit(False)), rules[0][0])
    for name, rule in rules[1:]:
        out = out.when(F.coalesce(rule, F.lit(False)), name)
    return out.otherwise(keep)


def keep_first(df: DataFrame, keys: list[str], order: list[str], content: Column) -> DataFrame:
    """The first row by order of each content within the keys. Aggregated map-side, so that many copies meet nowhere."""
    first = df.withColumn("__h", content).groupBy(*keys, "__h").agg(F.min(F.struct(*order)).alias("__first"))
    return first.select(*keys, F.lower(F.hex("__h")).alias("content"), *(F.col(f"__first.{c}").alias(c) for c in order))


def trim_at_last(df: DataFrame, key: str, position: str, strong: Column, weak: Column) -> DataFrame:
    """Rows up to the key's last strong marker, else its last weak one, else all; with the cut's method."""
    w = Window.partitionBy(key)
    marked = df.withColumn("__s", F.max(F.when(strong, F.col(position))).over(w)).withColumn("__w", F.max(F.when(weak, F.col(position))).over(w))
    marked = marked.withColumn("__cut", F.coalesce("__s", "__w", F.max(position).over(w)))
    method = F.when(F.col("__s").isNotNull(), "strong").when(F.col("__w").isNotNull(), "weak").otherwise("whole")
    return marked.withColumn("cut_method", method).filter(F.col(position) <= F.col("__cut")).drop("__s", "__w", "__cut")


def reconcile(desired: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """What to do with each key so that what is present becomes what is desired: link, keep or remove."""
    a, b = desired.select(key, F.lit(True).alias("__d")), present.select(key, F.lit(True).alias("__p"))
    action = F.when(F.col("__p").isNull(), "link").when(F.col("__d").isNull(), "remove").otherwise("keep")
    return a.join(b, key, "full_outer").select(key, action.alias("action"))
