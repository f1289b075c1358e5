"""Tables that are replaced as a whole: immutable snapshots, and pointers of which the last one counts.

A table is a folder with `data-<id>` folders, each written once, and files `pointer-<number>`, each of which names one of them. A new pointer is made whole under another name and then put in
place by one operation that fails if there is a pointer of its number already: a hard link on local disks, a rename on other file systems, where a rename does not overwrite. So a reader
sees the table before or after a change and nothing between, a writer that ends early leaves files that nobody reads, and of two writers who start from one state the slower one is told.

Cases: a table without a pointer doesn't exist (`read` raises FileNotFoundError); replacing it by an empty table leaves an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession

from .sinks import upserted


class Conflict(Exception):
    """Another writer has published first."""


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, path: str) -> list[int]:
    fs, at = _fs(spark, path)
    if not fs.exists(at):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(at)]
    return sorted(int(n.removeprefix("pointer-")) for n in names if n.startswith("pointer-"))


def target(spark: SparkSession, path: str, version: int) -> str:
    fs, at = _fs(spark, f"{path}/pointer-{version:012d}")
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def stage(df: DataFrame, path: str) -> str:
    """Write the rows into a new folder of the table, which nobody reads yet."""
    name = f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}")
    return name


def draft(spark: SparkSession, path: str, name: str) -> str:
    """Write a whole pointer under a name that is none."""
    made = f"{path}/.draft-{uuid.uuid4().hex}"
    fs, at = _fs(spark, made)
    stream = fs.create(at, False)
    try:
        stream.write(bytearray(name.encode()))
    finally:
        stream.close()
    return made


def publish(spark: SparkSession, path: str, drafted: str, version: int) -> None:
    """Put the drafted pointer in place as `version`, or raise Conflict if there is one."""
    fs, at = _fs(spark, f"{path}/pointer-{version:012d}")
    _, of = _fs(spark, drafted)
    if fs.getScheme() == "file":
        files = spark.sparkContext._jvm.java.nio.file
        local = lambda p: files.Path.of(p.toUri().getPath(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.java.lang.String, 0))
        try:
            files.Files.createLink(local(at), local(of))
        except Exception as e:
            if "FileAlreadyExistsException" in str(e):
                raise Conflict(f"{path} has a version {version} already") from None
            raise
        fs.delete(of, False)
    elif not fs.rename(of, at):
        raise Conflict(f"{path} has a version {version} already")


def replace(df: DataFrame, path: str, after: int | None = None) -> int:
    """Replace the table by the rows of df, which may read it, and return the new version. after: the version that df was made from (the present one if not given, 0 for none); Conflict if there is a
    later one by then."""
    spark = df.sparkSession
    if after is None:
        after = max(versions(spark, path), default=0)
    publish(spark, path, draft(spark, path, stage(df, path)), after + 1)
    return after + 1


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as of a version (the last one if not given)."""
    known = versions(spark, path)
    if not known or version is not None and version not in known:
        raise FileNotFoundError(f"no table at {path}" if not known else f"no version {version} of {path}")
    return spark.read.parquet(f"{path}/{target(spark, path, known[-1] if version is None else version)}")


def upsert(new: DataFrame, path: str, key: str, order: Column, tries: int = 5) -> int:
    """Put the rows of new into the table, of each key the last one by order; made anew from the table as another writer has left it, if one was faster."""
    spark = new.sparkSession
    for _ in range(tries):
        after = max(versions(spark, path), default=0)
        rows = upserted(read(spark, path, after), new, key, order) if after else upserted(new.limit(0), new, key, order)
        try:
            return replace(rows, path, after)
        except Conflict:
            continue
    raise Conflict(f"{path}: {tries} times another writer was faster")


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Remove all but the last `keep` versions, and what no pointer names; return how many folders went. For a time when nobody writes or reads older versions."""
    fs, at = _fs(spark, path)
    last = versions(spark, path)[-keep:]
    wanted = {target(spark, path, v) for v in last}
    gone = 0
    for f in fs.listStatus(at):
        name = f.getPath().getName()
        if name.startswith("pointer-") and int(name.removeprefix("pointer-")) not in last or name.startswith(".draft-"):
            fs.delete(f.getPath(), False)
        elif name.startswith("data-") and name not in wanted:
            fs.delete(f.getPath(), True)
            gone += 1
    return gone
