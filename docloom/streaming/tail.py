"""A stream of the lines of growing logs: what another program appends, a batch at a time, by byte offsets.

A batch ends with the last whole line that each log has; a line whose writer has not finished stays for a later batch. Offsets are a number of bytes for each file, so that a stream that starts
again from its checkpoint reads each line once, and a batch that is run again reads the same lines. Large batches are cut into pieces that tasks read side by side.

Cases: a log that isn't there yet, or is empty, has no lines; blank lines are left out, as are lines longer than the parser's (`parsed`) patience: those that are no JSON object of the schema have a null record;
a log that has become shorter than its offset was replaced and is an error; bytes that are no UTF-8 are replaced by the replacement character; a carriage return before the end of a line goes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes that a task reads; bytes that are read at once when looking for the end of a line.
PIECE, STEP = 64 << 20, 1 << 16


def _open(uri: str):
    from pyarrow import fs

    where, base = fs.FileSystem.from_uri(uri)
    return where, base


def logs(uri: str, ending: str) -> dict[str, int]:
    """Files of a folder with an ending, and their sizes."""
    from pyarrow import fs

    where, base = _open(uri)
    some = where.get_file_info(fs.FileSelector(base, allow_not_found=True))
    return {f.base_name: f.size for f in some if f.type == fs.FileType.File and f.base_name.endswith(ending)}


def whole_lines(file, size: int, least: int) -> int:
    """The place behind the last end of a line that lies between least and size; least if there is none."""
    at = size
    while at > least:
        first = max(least, at - STEP)
        file.seek(first)
        k = file.read(at - first).rfind(b"\n")
        if k >= 0:
            return first + k + 1
        at = first
    return least


class Piece(InputPartition):
    def __init__(self, name: str, first: int, end: int, limit: int):
        self.name, self.first, self.end, self.limit = name, first, end, limit


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.uri, self.ending, self.piece = options["path"].rstrip("/"), options.get("ending", ""), int(options.get("piece", PIECE))
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        where, base = _open(self.uri)
        for name, size in logs(self.uri, self.ending).items():
            with where.open_input_file(f"{base}/{name}") as file:
                self.known[name] = whole_lines(file, size, self.known.get(name, 0))
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        self.known = {k: max(v, self.known.get(k, 0)) for k, v in end.items()} | {k: v for k, v in self.known.items() if k not in end}
        out = []
        for name, upto in sorted(end.items()):
            first = start.get(name, 0)
            if upto < first:
                raise ValueError(f"{name} has become shorter: {upto} bytes, {first} read")
            out += [Piece(name, at, min(upto, at + self.piece), upto) for at in range(first, upto, self.piece)]
        return out

    def read(self, piece: Piece) -> Iterator:
        """The lines that begin in the piece; the batch begins at the beginning of a line, so a piece within it skips what the one before reads on."""
        import pyarrow as pa

        where, base = _open(self.uri)
        with where.open_input_file(f"{base}/{piece.name}") as file:
            at = piece.first
            if at:
                file.seek(at - 1)
                while at < piece.end:
                    data = file.read(min(STEP, piece.end - at + 1))
                    k = data.find(b"\n")
                    if k >= 0:
                        at += k
                        break
                    at += len(data)
                    file.seek(at - 1)
                else:
                    return
            rest, places, lines = b"", [], []
            file.seek(at)
            seen = at
            while at < piece.end:
                more = file.read(min(STEP, piece.limit - seen))
                seen += len(more)
                *whole, rest = (rest + more).split(b"\n")
                for line in whole:
                    if at < piece.end and (text := line.rstrip(b"\r").decode("utf-8", "replace")).strip():
                        places.append(at)
                        lines.append(text)
                    at += len(line) + 1
                if len(lines) >= 1_000 or at >= piece.end or not more:
                    if lines:
                        yield pa.RecordBatch.from_arrays([pa.array([piece.name] * len(lines)), pa.array(places, pa.int64()), pa.array(lines)], names=["log", "place", "line"])
                    places, lines = [], []
                if not more:
                    return

    def commit(self, end: dict) -> None:
        pass


class Tail(DataSource):
    """spark.readStream.format("tail").option("path", uri).option("ending", ".jsonl").load(): log, place (in bytes) and line."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "log string, place long, line string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def lines(spark: SparkSession, uri: str, ending: str = "", piece: int = PIECE) -> DataFrame:
    spark.dataSource.register(Tail)
    return spark.readStream.format("tail").option("path", uri).option("ending", ending).option("piece", str(piece)).load()


def parsed(rows: DataFrame, schema: str) -> DataFrame:
    """log, place and the fields of each line's JSON object; lines that are none are left out."""
    record = rows.select("log", "place", F.from_json("line", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"), "line")
    return record.filter(F.col("line").rlike(r"^\s*\{") & F.try_parse_json("line").isNotNull()).select("log", "place", "r.*")


def run_available(stream: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Take what has come since the last run with this checkpoint, and end."""
    stream.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
