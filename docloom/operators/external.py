"""Calls of external models as batch functions behind a frozen cache: what the cache knows is never asked again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_cache(df: DataFrame, cache: DataFrame, key: str, answer: str, schema: str, call: Callable) -> DataFrame:
    """(key, answer, source): cached answers, and for the other keys those of `call`, an iterator of pandas frames to frames. The
    anti-join stands before the call, so that only missing keys reach Python."""
    known = df.select(key).join(cache.select(key, answer), key)
    missing = df.join(cache.select(key), key, "left_anti").mapInPandas(call, schema)
    return known.select(key, answer, F.lit("cache").alias("source")).unionByName(missing.select(key, answer, F.lit("rule").alias("source")))


def batched(call: Callable[[list], list], column: str, answer: str, size: int = 14, empty: object = None) -> Callable:
    """A mapInPandas function that asks `call` about `size` values at a time; answers that are missing become `empty`."""

    def run(batches):
        for pdf in batches:
            asked = list(pdf[column])
            got: list = []
            for at in range(0, len(asked), size):
                part = call(asked[at : at + size])
                got += [*part, *[empty] * (len(asked[at : at + size]) - len(part))][: len(asked[at : at + size])]
            yield pdf.drop(columns=[column]).assign(**{answer: got})

    return run


def retried(call: Callable, times: int = 3, otherwise: object = None) -> Callable:
    """call, tried so often; after that `otherwise`, so that one bad row does not end a job."""

    def run(*args):
        for _ in range(times):
            try:
                return call(*args)
            except Exception:  # noqa: BLE001, S112
                continue
        return otherwise

    return run


def first_available(names: list[str], works: Callable[[str], bool]) -> str | None:
    """Preflight on the driver: the first name that works."""
    return next((n for n in names if works(n)), None)


def overridden(batch: DataFrame, second: DataFrame, key: str, answer: str) -> DataFrame:
    """Second opinions replace the batch's answers where there are any."""
    other = second.select(key, F.col(answer).alias("__second"))
    return batch.join(other, key, "left").withColumn(answer, F.coalesce("__second", answer)).drop("__second")


def with_cached_struct(df: DataFrame, cache: DataFrame, key: str, column: str, schema: str, call: Callable) -> DataFrame:
    """(key, answer, source) with a struct as answer: the cache's, or call(value of column), a tuple in the schema's order. The anti-join stands
    before the call."""
    known = df.select(key).join(cache.select(key, "answer"), key)
    kind = dict(df.dtypes)[key]

    def run(batches):
        import pandas as pd

        names = [x.split()[0] for x in schema.split(", ")]
        for pdf in batches:
            answers = [call(x) for x in pdf[column]]
            yield pd.concat([pdf[[key]], pd.DataFrame(answers, columns=names, index=pdf.index)], axis=1)

    asked = df.join(cache.select(key), key, "left_anti").select(key, column).mapInPandas(run, f"{key} {kind}, {schema}")
    names = [x.split()[0] for x in schema.split(", ")]
    asked = asked.select(key, F.struct(*names).alias("answer"))
    return known.withColumn("source", F.lit("cache")).unionByName(asked.withColumn("source", F.lit("call")))


def recognised(df: DataFrame, key: str, text: str, remote: Callable, local: Callable, least: int = 100, chunk: int = 10, times: int = 3) -> DataFrame:
    """(key, text, source, chunks): a text layer of `least` characters is taken; otherwise chunks go to remote(chunk, key), tried `times`
    times, and where one fails for good the whole goes to local."""
    has = F.length(text) >= least
    layer = df.filter(has).select(key, F.col(text).alias("text"), F.lit("text layer").alias("source"), F.lit(1).cast("long").alias("chunks"))
    kind = dict(df.dtypes)[key]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for k, content in zip(pdf[key], pdf[text], strict=True):
                content = content or ""
                parts = [content[at : at + chunk] for at in range(0, max(1, len(content)), chunk)]
                done = []
                for part in parts:
                    done.append(retried(remote, times)(part, k))
                    if done[-1] is None:
                        break
                failed = done[-1] is None
                out.append((k, "".join(local(part, k) for part in parts) if failed else "".join(done), "local" if failed else "ocr", len(parts)))
            yield pd.DataFrame(out, columns=[key, "text", "source", "chunks"])

    rest = df.filter(~F.coalesce(has, F.lit(False))).select(key, text).mapInPandas(run, f"{key} {kind}, text string, source string, chunks long")
    return layer.unionByName(rest)
