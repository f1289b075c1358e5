"""Helpers shared by the training-data operators: durable tables, checked lookups, distributed ranks."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of every contract of this subpackage.
SPACE = r"[\x20\x09-\x0D]"
#: Rows that a broadcast lookup table may have, and bytes of its texts; beyond either the lookup is a shuffle join.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20
#: A key with more than 1/HOT_SHARE of all rows is hot, so there are at most HOT_SHARE hot keys.
HOT_SHARE = 1_000

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir, or where unset and the master is local one of our own (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    if "://" not in base and base.startswith("/"):
        base = f"file://{base}"
    return base.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/docloom-{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _remove_all() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # the JVM may be gone already  # noqa: BLE001
            return


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def made() -> int:
    """How many durable tables there are so far."""
    return len(_made)


def clear(since: int) -> None:
    """Remove the durable tables made after the first `since`, but for the last one. For a caller who has written into that what the others
    were needed for; tables of other callers stay."""
    for own, path in _made[since:-1]:
        remove(own, path)
    del _made[since:-1]


#: Rows and bytes of the Arrow batches that Python workers get; every function of this subpackage works under the same limits, which
#: stay set in the session (texts may be very long, so that rows alone bound nothing).
ARROW_ROWS, ARROW_BYTES = 2_000, 16 << 20


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """df.mapInArrow under the limits; at its end a task gives the memory it has freed back to the system, so that a worker which
    serves one stage after another holds what its present stage needs."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))

    def task(batches: Iterator) -> Iterator:
        from docloom.llm.common import give_back

        yield from run(batches)
        give_back()

    return df.mapInArrow(task, schema)


def give_back() -> None:
    """Collect garbage and return free memory of Arrow and of the C library to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether the durable table df has at most `rows` rows and BROADCAST_BYTES bytes of texts, so that it may be broadcast."""
    wide = [F.octet_length(F.col(c).cast("string")) for c, kind in df.dtypes if kind == "string" or "<" in kind] + [F.octet_length(c) for c, kind in df.dtypes if kind == "binary"]
    width = sum((F.coalesce(w, F.lit(0)).cast("long") for w in wide), F.lit(0).cast("long"))
    n, size = df.agg(F.count("*"), F.sum(width)).first()
    return n <= rows and (size or 0) <= BROADCAST_BYTES


def checked(df: DataFrame) -> DataFrame:
    """The durable table df, to be broadcast if it fits."""
    return F.broadcast(df) if fits(df) else df


def lookup(left: DataFrame, right: DataFrame, keys: list[str], rows: str, total: int, how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join left with right, which is a durable table with one row for each key; right[rows] says how many rows
    of left have the key, total how many rows left has. A right side of at most `limit` rows is broadcast. Beyond that,
    the hot keys alone are (their number is bounded by HOT_SHARE), so no task gets all rows of one key."""
    if fits(right, limit):
        return left.join(F.broadcast(right), keys, how)
    hot = F.col(rows) > F.lit(max(1, total // HOT_SHARE))
    if not fits(right.filter(hot)):  # few keys, but of very long texts
        return left.join(right, keys, how)
    warm = left.join(F.broadcast(right.filter(hot)), keys, "inner")
    cold = left.join(F.broadcast(right.filter(hot).select(*keys)), keys, "left_anti").join(right.filter(~hot), keys, how)
    return warm.unionByName(cold)


def within(left: DataFrame, keys_of: DataFrame, keys: list[str], how: str = "left_semi", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Semi- or anti-join of left with the (durable) distinct keys; broadcast only up to `limit` rows."""
    right = keys_of.select(*keys)
    return left.join(F.broadcast(right) if fits(right, limit) else right, keys, how)


def running(df: DataFrame, group: list[str], order: list[Column], value: str, out: str, buckets: int, salt: Column) -> DataFrame:
    """Add out = sum of value over the rows before this one in its group (0-based prefix sum), without bringing a
    group together: rows are dealt into `buckets` by salt, sums run inside a bucket, and bucket totals (one
    row per group and bucket) give each bucket its base. The order is (bucket, order)."""
    b, base = f"__{out}_bucket", f"__{out}_base"
    df = df.withColumn(b, F.pmod(salt, F.lit(buckets)).cast("int"))
    own = Window.partitionBy(*group, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*group, b).agg(F.sum(value).alias("__sum")).withColumn(base, F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")
    keyed = df.withColumn(out, F.coalesce(F.sum(value).over(own), F.lit(0)))
    return keyed.join(totals, [*group, b]).withColumn(out, (F.col(out) + F.col(base)).cast("long")).drop(b, base)
