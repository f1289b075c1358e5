"""Token ids in Arrow stream files: record batches of fixed-size lists, so that a reader maps a file and views any sequence.

Layout of a part: `part-R-N.arrow` (the N-th of range R) has record batches of (ids: fixed_size_list<uint16 or uint32>[length], mask:
fixed_size_list<bool>[length]); the ids of the part's documents fill the sequences in a row, and only the last
sequence of a part has padding (mask false). `part-R-N.index.arrow` has (doc_id, start, n_tokens) with start counted from
the part's first id. Parts hold ascending ranges of doc_id.

Cases: a null or empty text is its end id alone; a row that is there twice is written twice; null doc_ids come first; an
empty table gives no part and no rows; other columns of the input are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, map_arrow, new_dir

#: Documents in a part; ranges of doc_id at most, each of which one task writes part by part, and tasks that read at most.
PART_DOCS, RANGES, READERS = 8_192, 8_192, 20_000
#: Sequences in a record batch.
BATCH = 256


def opened(uri: str) -> tuple:
    """File system and path of a URI that every executor can reach."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, uri: str, tokenizer_path: str, length: int = 2_048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", part_docs: int = PART_DOCS, ranges: int = RANGES) -> DataFrame:
    """Write the files and return the manifest: one row per part (number, range, part, path, n_docs, n_tokens, base), base being
    the ids of all parts before, number the part's place among all. Texts are encoded where they are read; only ids are shuffled (2 bytes
    a token for small vocabularies), to the range that a doc_id belongs to. Limits of ranges are quantiles of doc_id, from a scan of that
    column alone; there are at most `ranges` of them, whatever the input, since a range holds as many parts as its documents fill. A task
    holds one record batch, writes under a name of its attempt and renames, so a repeated task leaves one file."""
    named = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text")
    wanted = max(1, min(ranges, -(-named.count() // part_docs)))
    limits: list[int] = []
    if wanted > 1:
        limits = sorted(set(named.agg(F.percentile_approx("doc_id", [k / wanted for k in range(1, wanted)], 20 * wanted)).first()[0] or []))

    def encoded(batches: Iterator) -> Iterator:
        from bisect import bisect_left

        import numpy as np
        import pyarrow as pa

        from docloom.llm.encoding import encoder

        code, end = encoder(tokenizer_path), struct.pack("<I", end_id)
        kind = "<u2" if code.size <= 1 << 16 else "<u4"
        for batch in batches:
            doc = batch.column(0).to_pylist()
            ids = [np.frombuffer(x + end, "<u4").astype(kind).tobytes() for x in code.encode(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(ids, pa.binary()), pa.array([0 if d is None else bisect_left(limits, d) for d in doc], pa.int32())], names=["doc_id", "ids", "range"])

    def written(batches: Iterator) -> Iterator:
        from docloom.llm.encoding import encoder

        kind = "<u2" if encoder(tokenizer_path).size <= 1 << 16 else "<u4"
        part = None
        for batch in batches:
            for r, doc, ids in zip(batch.column(2).to_pylist(), batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part is None or r != part.range or len(part.docs) >= part_docs:
                    number = part.number + 1 if part is not None and r == part.range else 0
                    if part is not None:
                        yield part.close()
                    part = PartWriter(uri, r, number, length, kind)
                part.add(doc, ids)
        if part is not None:
            yield part.close()

    rows = map_arrow(named, encoded, "doc_id long, ids binary, range int")
    placed = rows.repartitionById(len(limits) + 1, F.col("range")).sortWithinPartitions("range", F.col("doc_id").asc_nulls_first(), F.xxhash64("ids"))
    made = durable(map_arrow(placed.select("doc_id", "ids", "range"), written, "range int, part int, path string, n_docs long, n_tokens long"), "token-manifest")
    # sums over the ranges, a bounded number of rows, then within each
    sums = made.groupBy("range").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("parts"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("range", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("t"), F.coalesce(F.sum("parts").over(earlier), F.lit(0)).alias("p"))
    before = Window.partitionBy("range").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    own = made.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    return own.join(F.broadcast(sums), "range").select((F.col("p") + F.col("part")).cast("long").alias("number"), "range", "part", "path", "n_docs", "n_tokens", (F.col("t") + F.col("base")).cast("long").alias("base"))


class PartWriter:
    """Fills sequences with ids as they come and keeps one record batch in memory."""

    def __init__(self, uri: str, range_: int, number: int, length: int, kind: str):
        import pyarrow as pa
        from pyspark import TaskContext

        self.range, self.number, self.length, self.kind = range_, number, length, kind
        self.fs, base = opened(uri)
        self.fs.create_dir(base, recursive=True)
        name = f"part-{range_:05d}-{number:06d}"
        self.path, self.uri = f"{base}/{name}", f"{uri}/{name}"
        self.own = f"{self.path}.{TaskContext.get().taskAttemptId()}"
        item = pa.uint16() if kind == "<u2" else pa.uint32()
        self.schema = pa.schema([("ids", pa.list_(item, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.item = item
        self.out = self.fs.open_output_stream(f"{self.own}.tmp")
        self.writer = pa.ipc.new_stream(self.out, self.schema)
        self.buffer, self.held, self.tokens = [], 0, 0
        self.docs: list = []

    def add(self, doc: int | None, ids: bytes) -> None:
        n = len(ids) // int(self.kind[-1])
        self.docs.append((doc, self.tokens, n))
        self.buffer.append(ids)
        self.held += n
        self.tokens += n
        if self.held >= BATCH * self.length:
            self.flush(False)

    def flush(self, last: bool) -> None:
        import numpy as np
        import pyarrow as pa

        flat = np.frombuffer(b"".join(self.buffer), self.kind)
        if last and len(flat) % self.length:
            real, flat = len(flat), np.concatenate([flat, np.zeros(-len(flat) % self.length, self.kind)])
        else:
            flat, rest = flat[: len(flat) // self.length * self.length], flat[len(flat) // self.length * self.length :]
            real = len(flat)
            self.buffer, self.held = ([rest.tobytes()], len(rest)) if not last else ([], 0)
        step = BATCH * self.length
        for at in range(0, len(flat), step):
            some = flat[at : at + step]
            mask = np.arange(at, at + len(some)) < real
            self.writer.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(some, self.item), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)], schema=self.schema))

    def close(self):
        import pyarrow as pa

        self.flush(True)
        self.writer.close()
        self.out.close()
        doc, start, n = zip(*self.docs, strict=True)
        index = pa.record_batch([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "start", "n_tokens"])
        with self.fs.open_output_stream(f"{self.own}.index.tmp") as f, pa.ipc.new_stream(f, index.schema) as w:
            w.write_batch(index)
        self.fs.move(f"{self.own}.tmp", f"{self.path}.arrow")
        self.fs.move(f"{self.own}.index.tmp", f"{self.path}.index.arrow")
        return pa.RecordBatch.from_arrays([pa.array([self.range], pa.int32()), pa.array([self.number], pa.int32()), pa.array([self.uri]), pa.array([len(doc)], pa.int64()), pa.array([self.tokens], pa.int64())], names=["range", "part", "path", "n_docs", "n_tokens"])


class TokenFile:
    """A part opened for random access; local files are mapped, and sequence() copies nothing then."""

    def __init__(self, uri: str):
        import pyarrow as pa
        from pyarrow import fs

        where, path = opened(uri)
        local = isinstance(where, fs.LocalFileSystem)
        self.source = pa.memory_map(f"{path}.arrow") if local else where.open_input_file(f"{path}.arrow")
        self.batches = pa.ipc.open_stream(self.source).read_all().to_batches()
        with where.open_input_file(f"{path}.index.arrow") as f:
            self.index = pa.ipc.open_stream(f).read_all()
        self.length = self.batches[0].schema.field("ids").type.list_size
        self.first = [0]
        for b in self.batches:
            self.first.append(self.first[-1] + b.num_rows)

    def _flat(self, k: int):
        return self.batches[k].column("ids").flatten().to_numpy(zero_copy_only=True)

    def sequence(self, number: int) -> tuple:
        """Ids (a view) and mask of the part's sequence of this number."""
        from bisect import bisect_right

        k = bisect_right(self.first, number) - 1
        at = (number - self.first[k]) * self.length
        return self._flat(k)[at : at + self.length], self.batches[k].column("mask")[number - self.first[k]].values

    def ids(self, start: int, n: int):
        """The ids start..start+n of the part's stream."""
        from bisect import bisect_right

        import numpy as np

        some, k = [], bisect_right(self.first, start // self.length) - 1
        while n:
            at = start - self.first[k] * self.length
            piece = self._flat(k)[at : at + n]
            some.append(piece)
            start, n, k = start + len(piece), n - len(piece), k + 1
        return some[0] if len(some) == 1 else np.concatenate(some)


def read_token_files(manifest: DataFrame, readers: int = READERS) -> DataFrame:
    """One row per document, from the files: doc_id, start (over all parts), ids (uint32, little-endian). A task per part, up to `readers`
    tasks that read several one after another."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = TokenFile(uri)
                for rows in part.index.to_batches(max_chunksize=1_000):
                    doc, start, n = (c.to_pylist() for c in rows.columns)
                    ids = [part.ids(s, k).astype("<u4").tobytes() for s, k in zip(start, n, strict=True)]
                    yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([base + s for s in start], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "ids"])

    tasks = max(1, min(readers, manifest.count()))
    # by number, so that adaptive execution does not bring small manifests into one task
    dealt = manifest.select("path", "base", (F.col("number") % tasks).cast("int").alias("to")).repartitionById(tasks, F.col("to"))
    return map_arrow(dealt.select("path", "base"), run, "doc_id long, start long, ids binary")


def folder(spark: SparkSession) -> str:
    return new_dir(spark, "tokens")


def crc32(ids: bytes) -> int:
    return zlib.crc32(ids)
