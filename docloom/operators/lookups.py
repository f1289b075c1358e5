"""Joins that no single key can stop: the rows of a hot key stay where they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than one in HOT_SHARE of the rows, and at least HOT_ROWS of them, is hot: so there are at most HOT_SHARE hot keys.
HOT_SHARE, HOT_ROWS = 500, 20_000
#: Bytes that the rows of the hot keys may have to be broadcast.
HOT_BYTES = 32 << 20


def hot_keys(left: DataFrame, keys: list[str], share: int | None = None, rows: int | None = None, counts: DataFrame | None = None) -> DataFrame | None:
    """The hot keys of left, or None if there are none. counts: keys and their numbers of rows (n) where they are known; else left is summed where it lies."""
    total = left.count()
    least = max(HOT_ROWS if rows is None else rows, total // (share or HOT_SHARE))
    if total <= least:
        return None
    n = left.groupBy(*keys).agg(F.count("*").alias("n")) if counts is None else counts.select(*keys, "n")
    found = n.filter(F.col("n") > least).select(*keys).collect()
    if not found:
        return None
    return left.sparkSession.createDataFrame(found, n.select(*keys).schema)


def lookup(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", share: int | None = None, rows: int | None = None, counted: bool = False, total: int | None = None) -> DataFrame:
    """left joined (left, inner, left_semi or left_anti) with right, which has one row for each key. Rows of left with a hot key meet that key's row by broadcast, all
    others by whatever join the optimizer picks; so no task gets the rows of one key. A null key matches nothing. counted: right has a column n, as many rows
    as left has of the key or more; it is not returned. Both sides are read more than once and so should be kept tables."""
    hot = hot_keys(left.dropna(subset=keys), keys, share, rows, right if counted else None)
    right = right.drop("n") if counted else right
    if hot is None:
        return left.join(right, keys, how)
    names = F.broadcast(hot)
    few = right.join(names, keys, "left_semi")
    width = few.select(F.sum(F.octet_length(F.to_json(F.struct(*few.columns))))).first()[0] or 0
    if width > HOT_BYTES:  # very long rows: 64 copies of each, and left's rows dealt to them
        salt = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("__salt")
        dealt = left.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(64)).cast("int"))
        return dealt.join(right.select("*", salt), [*keys, "__salt"], how).drop("__salt")
    warm = left.join(names, keys, "left_semi").join(F.broadcast(few), keys, how)
    return left.join(names, keys, "left_anti").join(right, keys, how).unionByName(warm)
