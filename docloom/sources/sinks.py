"""Tables to files: fixed-column CSV, JSON lines, tab sets and keyed upserts (tables that are replaced as a whole: see `snapshots`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tabular import aligned


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Quotes inside of a value are doubled, as spreadsheets write them."""
    aligned(df, columns).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_by_group(df: DataFrame, path: str, group: str) -> None:
    """One folder per group."""
    df.write.mode("overwrite").partitionBy(group).json(path)


def write_tabs(tabs: dict[str, DataFrame], path: str) -> None:
    """A folder per tab, audit tabs among them."""
    for name, df in tabs.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def write_files(df: DataFrame, path: str, folder: str, name: str, body: str, ending: str = ".txt") -> None:
    """A file of text per row, in a folder of its own kind; written by the tasks through the Hadoop-independent file system of Arrow, under a name
    of the attempt and renamed, so that a repeated task leaves one file."""

    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        where, base = fs.FileSystem.from_uri(path)
        attempt = TaskContext.get().taskAttemptId()
        for pdf in batches:
            for d, n, text in zip(pdf[folder], pdf[name], pdf[body], strict=True):
                where.create_dir(f"{base}/{d}", recursive=True)
                with where.open_output_stream(f"{base}/{d}/{n}.{attempt}.tmp") as f:
                    f.write(text.encode())
                where.move(f"{base}/{d}/{n}.{attempt}.tmp", f"{base}/{d}/{n}{ending}")
            yield pdf[[name]]

    df.select(F.col(folder).cast("string"), F.col(name).cast("string"), F.col(body).cast("string")).mapInPandas(run, f"{name} string").write.format("noop").mode("overwrite").save()


def upserted(old: DataFrame, new: DataFrame, key: str, order: Column) -> DataFrame:
    """Of both tables' rows the last of each key by order, new ones first among equals."""
    both = old.withColumn("__n", F.lit(0)).unionByName(new.withColumn("__n", F.lit(1)))
    columns = [c for c in old.columns if c != key]
    top = both.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(order, F.col("__n"))).alias("__r"))
    return top.select(key, *(F.col(f"__r.{c}").alias(c) for c in columns)).select(*old.columns)


def report(metrics: DataFrame, title: str) -> str:
    """A small table of aggregates as Markdown."""
    rows = metrics.collect()
    lines = [f"# {title}", "", "| " + " | ".join(metrics.columns) + " |", "|" + "-|" * len(metrics.columns)]
    return "\n".join([*lines, *("| " + " | ".join(str(v) for v in r) + " |" for r in rows)]) + "\n"


def dictionary(df: DataFrame) -> str:
    """A table's data dictionary as Markdown: column, type, the comment of its metadata."""
    lines = ["| column | type | meaning |", "|-|-|-|"]
    return "\n".join([*lines, *(f"| {f.name} | {f.dataType.simpleString()} | {f.metadata.get('comment', '')} |" for f in df.schema.fields)]) + "\n"


def chart(rows: DataFrame, label: str, value: str, title: str, kind: str = "bar", width: int = 640, height: int = 360) -> str:
    """A small aggregate as an SVG picture: bars, a line through the values, or a strip of cells shaded by value (heat). The rows are few by
    nature, as a reader has to see each."""
    from html import escape

    data = [(str(r[0]), float(r[1] or 0)) for r in rows.select(label, value).collect()]
    top, step = max((v for _, v in data), default=0.0) or 1.0, width / max(1, len(data))
    y = lambda v: height - 30 - max(0.0, v) / top * (height - 60)
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"><text x="8" y="18">{escape(title)}</text>']
    if kind == "line":
        points = " ".join(f"{(k + 0.5) * step:.1f},{y(v):.1f}" for k, (_, v) in enumerate(data))
        out.append(f'<polyline fill="none" stroke="#336699" points="{points}"/>')
    for k, (name, v) in enumerate(data):
        at = k * step
        if kind == "bar":
            out.append(f'<rect x="{at + 1:.1f}" y="{y(v):.1f}" width="{max(1.0, step - 2):.1f}" height="{height - 30 - y(v):.1f}" fill="#336699"/>')
        if kind == "heat":
            out.append(f'<rect x="{at:.1f}" y="30" width="{step:.1f}" height="{height - 60}" fill="#336699" fill-opacity="{max(0.0, v) / top:.3f}"/>')
        out.append(f'<text x="{at + 2:.1f}" y="{height - 12}" font-size="10">{escape(name)}</text>')
    return "\n".join([*out, "</svg>"]) + "\n"
