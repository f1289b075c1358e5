"""Agreement of two sides: presence, precision and recall, confusion, field agreement, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.fuzzy import jaccard
from docloom.functions.stats import f1, wilson


def presence(gold: DataFrame, ours: DataFrame, keys: list[str]) -> DataFrame:
    """Every key of either side with where it is."""
    a, b = gold.select(*keys).distinct().withColumn("__g", F.lit(True)), ours.select(*keys).distinct().withColumn("__o", F.lit(True))
    where = F.when(F.col("__o").isNull(), "gold_only").when(F.col("__g").isNull(), "ours_only").otherwise("both")
    return a.join(b, keys, "full_outer").select(*keys, where.alias("presence"))


def precision_recall(presence_rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """matched, gold, ours, precision, recall, f1 and Wilson limits of recall."""
    both, gold, ours = F.count_if(F.col("presence") == "both"), F.count_if(F.col("presence") != "ours_only"), F.count_if(F.col("presence") != "gold_only")
    n = presence_rows.groupBy(*(by or [])).agg(both.alias("matched"), gold.alias("gold"), ours.alias("ours"))
    p, r = F.coalesce(F.try_divide("matched", "ours"), F.lit(0.0)), F.coalesce(F.try_divide("matched", "gold"), F.lit(0.0))
    low, high = wilson(F.col("matched"), F.col("gold"))
    return n.withColumns({"precision": p, "recall": r, "f1": f1(p, r), "low": low, "high": high})


def field_agreement(joined: DataFrame, fields: list[str]) -> DataFrame:
    """(field, agree, total) over the rows whose gold value is filled; gold_x and our_x are the fields' columns."""
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"gold_{f}").cast("string").alias("g"), F.col(f"our_{f}").cast("string").alias("o")) for f in fields))
    rows = joined.select(F.explode(each).alias("x")).select("x.*").filter("g is not null and g <> ''")
    return rows.groupBy("field").agg(F.count_if(F.col("g").eqNullSafe(F.col("o"))).alias("agree"), F.count("*").alias("total"))


def entries(rows: DataFrame, keys: list[str], role: str, side: str, flags: list[str], order: Column) -> DataFrame:
    """One entry per key: the sorted set of its roles, the first side by order that is not empty ('' without any), and of each flag whether a row has it."""
    some = F.col(side) != ""
    first = F.coalesce(F.min_by(F.when(some, F.col(side)), F.when(some, order)), F.lit(""))
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_set(role)).alias("roles"), first.alias("side"), *(F.coalesce(F.bool_or(f), F.lit(False)).alias(f) for f in flags))


def soft_scores(rows: DataFrame, source: str, gold: str, ours: str, keys: list[str]) -> DataFrame:
    """One row: matched, gold, ours, soft_recall, soft_precision, soft_f1 (of the rounded two), and the percentages of matches whose side (where gold has one) and interim flag agree.
    rows: entries of both sources."""
    g, o = rows.filter(F.col(source) == gold), rows.filter(F.col(source) == ours)
    side = lambda df, n: df.select(*keys, *(F.col(c).alias(f"{n}_{c}") for c in ("roles", "side", "interim")))
    met = side(g, "g").join(side(o, "o"), keys)
    agrees = F.when(F.col("g_side") != "", F.lower("g_side") == F.lower("o_side"))
    percent = lambda k, n: F.round(F.try_divide(100.0 * k, n), 1)
    sums = met.agg(F.count("*").alias("matched"), F.sum(jaccard(F.col("g_roles"), F.col("o_roles"))).alias("soft"), percent(F.count_if(agrees), F.count(agrees)).alias("side_pct"), percent(F.count_if(F.col("g_interim") == F.col("o_interim")), F.count("*")).alias("interim_pct"))
    n = rows.agg(F.count_if(F.col(source) == gold).alias("gold"), F.count_if(F.col(source) == ours).alias("ours"))
    share = lambda c: F.round(F.try_divide(F.coalesce("soft", F.lit(0.0)), F.col(c)), 3)
    r = sums.join(F.broadcast(n)).withColumns({"soft_recall": share("gold"), "soft_precision": share("ours")})
    p, q = F.coalesce("soft_recall", F.lit(0.0)), F.coalesce("soft_precision", F.lit(0.0))
    f = F.when(p + q > 0, F.round(2 * p * q / (p + q), 3)).otherwise(0.0)
    return r.select("matched", "gold", "ours", "soft_recall", "soft_precision", f.alias("soft_f1"), "side_pct", "interim_pct")
