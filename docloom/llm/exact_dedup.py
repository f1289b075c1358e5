"""Exact dedup: group by a 128-bit content hash, keep one row, compare the bytes inside groups.

Cases: a null text counts as empty; empty texts are equal to each other; of equal rows with the same length the smallest
doc_id stays, a null doc_id after all others; a row that is there twice with the same doc_id is kept once; an empty table
gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, durable, lookup, within

#: Rows of a group that one task compares with the group's representative.
COMPARE_ROWS = 2_000


def content_hash(normal: Column) -> Column:
    """128 bits of the normalised text."""
    return F.unhex(F.md5(normal.cast("binary")))


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", "")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, n_chars.

    Two scans of the texts. The first gives a light table (hash, length, id), whose groups are summed map-side. The
    second ships only texts of groups with several rows to a comparison with the group's representative; a large group is
    dealt to several tasks, each with a copy of the representative. Rows that share the hash but not the bytes are
    grouped again by their bytes."""
    text, normal = F.col(text_col), normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.length(F.coalesce(text, F.lit(""))).cast("long").alias("n_chars"), normal.alias("normal")).withColumn("h", hash_of(F.col("normal")))
    light = durable(rows.select("doc_id", "n_chars", "h", F.unhex(F.sha2(F.col("normal").cast("binary"), 256)).alias("sha"), F.monotonically_increasing_id().alias("rid")), "exact-light")
    best = F.min(F.struct((-F.col("n_chars")).alias("neg"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("rid").alias("rid"))).alias("best")
    groups = durable(light.groupBy("h").agg(F.count("*").alias("n"), best).filter("n > 1"), "exact-groups")
    total = light.count()
    other = collided(rows, groups, total)
    out = lookup(light, groups, ["h"], "n", total)
    if not other.isEmpty():
        return _regrouped(out, other, best)
    return _result(out)


def collided(rows: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """Rows whose bytes differ from those of their hash group's representative (none but for hash collisions)."""
    salts = F.ceil(F.col("n") / COMPARE_ROWS).cast("int")
    keys = groups.select("h", "n", F.col("best.neg").alias("neg"), F.col("best.id").alias("best_id"))
    members = lookup(within(rows, groups, ["h"]), keys, ["h"], "n", total, "inner")
    first = members.filter((F.col("n_chars") == -F.col("neg")) & F.col("doc_id").eqNullSafe(F.col("best_id")))
    first = first.groupBy("h", "n").agg(F.min("normal").alias("first"), F.max("normal").alias("last"))
    spread = first.select("h", "first", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    dealt = members.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_chars"), salts).cast("int"))
    return durable(dealt.join(spread, ["h", "salt"]).filter("normal <> first").select("h", "doc_id", "n_chars", "normal"), "exact-collided")


def _result(out: DataFrame) -> DataFrame:
    mine = F.coalesce(F.col("best.rid") == F.col("rid"), F.lit(True))
    return out.select("doc_id", F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), mine.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "n_chars")


def _regrouped(out: DataFrame, other: DataFrame, best: Column) -> DataFrame:
    """The classes where a hash has collided: those rows by their SHA-256 and bytes, the rest as before but for the count."""
    sha = F.unhex(F.sha2(F.col("normal").cast("binary"), 256)).alias("sha")
    odd = other.select("h", "normal", sha).distinct().groupBy("h", "sha").agg(F.count("*").alias("texts"))
    if not odd.filter("texts > 1").isEmpty():
        raise ValueError("two different texts share an MD5 and a SHA-256 hash")
    marked = out.join(odd.select("h", "sha", F.lit(True).alias("odd")), ["h", "sha"], "left")
    marked = marked.withColumn("cls", F.when(F.col("odd"), F.col("sha")))
    again = marked.drop("n", "best").filter(F.col("h").isNotNull()).groupBy("h", "cls").agg(F.count("*").alias("n"), best)
    again = again.withColumnRenamed("h", "h2").withColumnRenamed("cls", "cls2")
    return _result(marked.drop("n", "best").join(again, (F.col("h") == F.col("h2")) & F.col("cls").eqNullSafe(F.col("cls2")), "left"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns. A row that is there several times with one
    doc_id and equal text stays once."""
    decided = durable(exact_dedup(docs, id_col, text_col).select(F.col("doc_id").alias("__id"), "kept"), "exact-decided")
    named = docs.withColumn("__id", F.col(id_col))
    twice = durable(decided.groupBy("__id").agg(F.count("*").alias("c"), F.count_if("kept").alias("k")).filter("c > 1 or __id is null"), "exact-repeated")
    gone = decided.filter("not kept and __id is not null").select("__id")
    if twice.isEmpty():
        return within(named, gone, ["__id"], "left_anti").drop("__id")
    seen = twice.filter("__id is not null")
    plain = within(within(named, gone, ["__id"], "left_anti"), seen, ["__id"], "left_anti").filter("__id is not null")
    odd = named.join(twice.select(F.col("__id").alias("__i"), "k"), F.col("__id").eqNullSafe(F.col("__i"))).filter("k > 0").drop("__i", "k")
    odd = odd.withColumn("__h", content_hash(normalised(F.col(text_col)))).dropDuplicates(["__id", "__h"]).drop("__h")
    return plain.unionByName(odd).drop("__id")
