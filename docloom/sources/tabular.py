"""Tables from files: all-text CSV, tolerant JSON lines, nested documents, binary scans, keyed caches."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical_names(df: DataFrame, prefix: str = "") -> DataFrame:
    """Trimmed lower-case names, runs of other characters as one underscore."""
    return df.toDF(*(re.sub(r"\W+", "_", c.removeprefix(prefix).strip().lower()).strip("_") for c in df.columns))


def discover(columns: list[str], *parts: str) -> str | None:
    """The first column that contains the first part that any contains."""
    return next((c for p in parts for c in columns if p in c.lower()), None)


def aligned(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly these columns, null (as text) where the table has none."""
    return df.select(*(F.col("`" + c.replace("`", "``") + "`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns))


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Every value as text; a byte order mark before the header is ignored, since columns go by place."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("enforceSchema", True).option("escape", '"').csv(path)


def csv_fields(spark: SparkSession, path: str) -> list[str]:
    """The names in the header, in the file's order."""
    return spark.read.option("header", True).csv(path).columns


def read_csv_inferred(spark: SparkSession, path: str) -> DataFrame:
    return canonical_names(spark.read.option("header", True).option("inferSchema", True).csv(path))


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines; strict fails on a malformed one, otherwise such lines are left out."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    table = spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    return table.filter("_bad is null").drop("_bad")


def read_documents(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One JSON document per file (or per line); its pages' texts in page order."""
    schema = "relpath string, n_pages int, pages array<struct<page:int,chars:int,source:string,text:string>>"
    table = spark.read.schema(schema).option("multiLine", multi_line).option("recursiveFileLookup", True).json(path)
    return table.withColumn("pages", F.array_sort("pages")).withColumn("text", F.array_join(F.transform("pages", lambda p: p["text"]), "\n"))


def scan_files(spark: SparkSession, path: str, glob: str = "*.{pdf,PDF}") -> DataFrame:
    """Path, size and time of files below a folder, without their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", "length", "modificationTime")


def newest(files: DataFrame, stem: Column) -> DataFrame:
    return files.groupBy(stem.alias("stem")).agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """The ids of a list file, one to a line; what follows a # is a comment, and lines without an id are left out."""
    return spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("id")).filter("id <> ''").distinct()


def discovered(columns: list[str], parts: tuple[str, ...], first: tuple[str, ...] = ()) -> str:
    """The column that holds what is looked for: of those whose name has one of the parts (whatever the case) the first named in `first`, else the first of the table.
    A ValueError if there is none."""
    some = [c for c in columns if any(p.lower() in c.lower() for p in parts)]
    if not some:
        raise ValueError(f"no column has {' or '.join(parts)} in its name")
    return next((c for c in first if c in some), some[0])


def last_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("__rk", F.row_number().over(w)).filter("__rk = 1").drop("__rk")


def first_text(*sources: tuple[str, Column]) -> tuple[Column, Column]:
    """The first non-empty text and the name of its source."""
    filled = [(n, F.nullif(c, F.lit(""))) for n, c in sources]
    name = F.lit("none")
    for n, c in reversed(filled):
        name = F.when(c.isNotNull(), n).otherwise(name)
    return F.coalesce(*(c for _, c in filled), F.lit("")), name


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def probe(files: DataFrame, measure, schema: str = "path string, n int") -> DataFrame:
    """Apply measure(content) -> int to the files of a binary scan (path, content); -1 where it fails."""

    def run(batches):
        for pdf in batches:
            out = []
            for content in pdf["content"]:
                try:
                    out.append(int(measure(content)))
                except Exception:  # noqa: BLE001
                    out.append(-1)
            yield pdf[["path"]].assign(n=out)

    return files.select("path", "content").mapInPandas(run, schema)


def grouped_files(files: DataFrame) -> DataFrame:
    """Add the group number that the file's folder begins with."""
    return files.withColumn("grp", F.nullif(F.regexp_extract("path", r"/(\d+)[^/]*/[^/]+$", 1), F.lit("")))


def read_tab(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """A workbook's tab as text, by pandas where its reader is installed; workbooks are small files at the edge."""
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path, sheet_name=sheet, dtype=str).fillna(""))


def read_tab_folder(spark: SparkSession, path: str, tab: str) -> DataFrame:
    """A tab of a set that write_tabs has written, its values as text and empty where they are missing."""
    table = spark.read.parquet(f"{path}/{tab}")
    return table.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in table.columns))
