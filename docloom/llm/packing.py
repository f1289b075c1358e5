"""Packing by best-fit decreasing: a segment tree indexed by remaining capacity finds the tightest open window.

Cases: a null or empty text is its end id alone; repeated rows are packed each by itself; a null doc_id stays null; an
empty table gives no rows; other columns of the input are not read. Ties of length go by the order of the input.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .common import map_arrow
from .encoding import CACHE_BYTES

SCHEMA = "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_tokens long, padded_length long"


class OpenWindows:
    """How many open windows there are of each remaining capacity, as a segment tree over 0..capacity."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, left: int, window: int) -> None:
        self.at[left].append(window)
        node = self.leaves + left
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The window whose remaining capacity is the least that is at least need, removed; and that capacity."""
        node = self.leaves + need
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        left = node - self.leaves
        window = self.at[left].pop()
        while node:
            self.count[node] -= 1
            node >>= 1
        return window, left


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """Window and offset of each piece; every length is 1 to capacity."""
    places: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    tree, windows = OpenWindows(capacity), 0
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        n = lengths[k]
        found = tree.take(n)
        if found is None:
            found = windows, capacity
            windows += 1
        window, left = found
        places[k] = window, capacity - left
        if left > n:
            tree.add(left - n, window)
    return places


def cut(ids: bytes, capacity: int) -> list[tuple[int, bytes]]:
    """Full windows first, then the rest."""
    step = 4 * capacity
    return [(at // 4, ids[at : at + step]) for at in range(0, len(ids), step)]


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2_048, end_id: int = 1, group_tokens: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text", cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """One row per piece, with its ids and its place in a sequence.

    A narrow map: each task packs groups of about `group_tokens` tokens (thousands of documents, 16 MB) by itself, so that
    nothing is shuffled and memory is bounded whatever the input's size. A sequence's length is capacity, or its
    own token count where that is a power of two (padded_length). Window ids hold the task's number and are the same in each
    run over the same files. cache_bytes bounds the words that a worker remembers, for speed alone."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        from docloom.llm.encoding import encoder

        code, end = encoder(tokenizer_path, cache_bytes), struct.pack("<I", end_id)
        first = TaskContext.get().partitionId() << 33
        pieces: list[tuple] = []  # doc, start, ids, doc tokens
        held = 0

        def flush() -> Iterator:
            nonlocal first, held
            places = best_fit_decreasing([len(p[2]) // 4 for p in pieces], capacity)
            full: dict[int, int] = {}
            for (w, _), p in zip(places, pieces, strict=True):
                full[w] = full.get(w, 0) + len(p[2]) // 4
            for at in range(0, len(pieces), 1_000):
                some, where = pieces[at : at + 1_000], places[at : at + 1_000]
                tokens = [full[w] for w, _ in where]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([p[0] for p in some], pa.int64()), pa.array([p[1] for p in some], pa.int64()), pa.array([p[2] for p in some], pa.binary()), pa.array([p[3] for p in some], pa.int64()),
                        pa.array([first + w for w, _ in where], pa.int64()), pa.array([o for _, o in where], pa.int64()), pa.array(tokens, pa.int64()),
                        pa.array([n if n & (n - 1) == 0 else capacity for n in tokens], pa.int64()),
                    ],
                    names=["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "padded_length"],
                )
            first += len(full)
            pieces.clear()
            held = 0

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), code.encode(batch.column(1).to_pylist()), strict=True):
                ids += end
                pieces.extend((doc, start, piece, len(ids) // 4) for start, piece in cut(ids, capacity))
                held += len(ids) // 4
                if held >= group_tokens:
                    yield from flush()
        if pieces:
            yield from flush()

    return map_arrow(docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text"), run, SCHEMA)
