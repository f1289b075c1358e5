"""Hard negatives by a vector-approximation file.

Each component of a vector is an integer; of each dimension the range is cut into CELLS cells of one width, and a row's approximation is the cell of
each of its components. For an anchor, a table holds the least and greatest product that each cell of each dimension allows, so that sums over a
row's cells bound its score from both sides. A row is scored exactly only if its bounds allow it to enter what is looked for: the first positives, or
the first negatives in the window of scores that a positive opens.

The anchors are a stated set of queries, which meets all rows in blocks: rows are packed into blocks, blocks are dealt to stripes, and a task takes one block
of anchors through the blocks of one stripe, one at a time, keeping the best found so far, by which it prunes what follows. What it returns is a few rows
per anchor, of which the first are then chosen over all stripes.

Cases: rows with a null id, label or vector, or with a null or non-finite component, take no part; a shorter vector counts as if filled up with zeros, and an empty
one as all zeros; rows that share an id are rows of their own, and none is a positive of an anchor with its id; a row that is there twice may be named
twice, and twice as an anchor gives its rows twice; with fewer rows than asked for, all are returned; no positive, or no row in a window, gives no rows;
a score beyond 64 bits ends with an error; an empty table gives no rows; columns other than id, vector and label are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, map_arrow

#: An anchor's id is divisible by ANCHOR; positives of an anchor; negatives of a positive; limits of a negative's score in percent of the positive's.
ANCHOR, POSITIVES, NEGATIVES, LOW, HIGH = 100, 5, 10, 30, 90
#: Labels are one higher, modulo LABELS, where the id is divisible by SHIFTED; a component x becomes floor(SCALE * x).
SHIFTED, LABELS, SCALE = 7, 10, 256
#: Cells of a dimension; rows of a block; anchors of a block, and of a tile of it; stripes that blocks are dealt to.
CELLS, ROWS, ANCHORS, TILE, STRIPES = 64, 4_096, 1_024, 128, 64


def packed(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """Blocks of the rows that take part: n, ids, labels and integer components as bytes (64 bits each), and the components' least and greatest by dimension."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from docloom.llm.negatives import LABELS, ROWS, SCALE, SHIFTED

        def out(ids, labels, x):
            low, high = (x.min(axis=0), x.max(axis=0)) if len(x) else ([], [])
            columns = [pa.array([len(ids)], pa.int32()), pa.array([x.shape[1]], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in (ids, labels, x)), *(pa.array([v], pa.list_(pa.int64())) for v in (low, high))]
            return pa.RecordBatch.from_arrays(columns, names=["n", "dims", "ids", "labels", "x", "low", "high"])

        held: dict[int, list] = {}
        for batch in batches:
            ids, labels, lists = (batch.column(k) for k in range(3))
            whole = ids.is_valid().to_numpy(zero_copy_only=False) & labels.is_valid().to_numpy(zero_copy_only=False) & lists.is_valid().to_numpy(zero_copy_only=False)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            values = lists.flatten()
            bad = values.is_null().to_numpy(zero_copy_only=False)
            values = np.where(bad, np.nan, values.fill_null(0).to_numpy(zero_copy_only=False).astype(float))
            ends = np.cumsum(sizes)
            odd = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            whole &= odd[ends] == odd[ends - sizes]
            own, label = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), labels.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            label = np.where(own % SHIFTED == 0, np.fmod(label + 1, LABELS), label)
            for d in np.unique(sizes[whole]):
                take = np.flatnonzero(whole & (sizes == d))
                x = np.floor(SCALE * values[(ends - sizes)[take][:, None] + np.arange(d)])
                if d and abs(x).max(initial=0) >= 2**62:
                    raise OverflowError("a component of a vector is too large for scores of 64 bits")
                ready = held.setdefault(int(d), [])
                ready.append((own[take], label[take], x.astype(np.int64)))
                if sum(len(r[0]) for r in ready) >= ROWS:
                    rows = [np.concatenate(c) for c in zip(*ready, strict=True)]
                    full = len(rows[0]) // ROWS * ROWS
                    for at in range(0, full, ROWS):
                        yield out(*(r[at : at + ROWS] for r in rows))
                    held[int(d)] = [tuple(r[full:] for r in rows)]
        for ready in held.values():
            rows = [np.concatenate(c) for c in zip(*ready, strict=True)]
            if len(rows[0]):
                yield out(*rows)

    read = vectors.select(F.col(id_col).cast("long"), F.col(label_col).cast("long"), F.col(vector_col).cast("array<double>"))
    return map_arrow(read, run, "n int, dims int, ids binary, labels binary, x binary, low array<long>, high array<long>")


def approximated(blocks: DataFrame, low: list[int], width: list[int]) -> DataFrame:
    """The blocks with their approximations: the cell of each component, one byte each, dimension by dimension. Shorter vectors are filled up."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        base, step = np.array(low, np.int64), np.array(width, np.int64)
        for batch in batches:
            x = [padded(raw, n, dims, len(base)) for n, dims, raw in zip(*(batch.column(k).to_pylist() for k in (0, 1, 4)), strict=True)]
            cells = [((v - base) // step).astype(np.uint8).T.tobytes() for v in x]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(cells, pa.binary())], names=["n", "ids", "labels", "x", "cells"])

    return map_arrow(blocks, run, "n int, ids binary, labels binary, x binary, cells binary")


def padded(raw: bytes, n: int, dims: int, wide: int):
    import numpy as np

    x = np.frombuffer(raw, np.int64).reshape(n, dims)
    return x if dims == wide else np.hstack([x, np.zeros((n, wide - dims), np.int64)])


class Tables:
    """Bounds of the scores of a tile of anchors by table lookup."""

    def __init__(self, anchors, low: list[int], width: list[int]):
        import numpy as np

        # numbers are exact: in 32 bits where no sum can be larger, else in 64, else as whole numbers of any size
        far = [max(abs(lo), abs(lo + CELLS * w)) for lo, w in zip(low, width, strict=True)]
        most = sum(f * int(abs(anchors[:, d]).max(initial=0)) for d, f in enumerate(far))
        most = max([most, *far])
        kind = np.int32 if most < 2**30 else np.int64 if most < 2**62 else object
        self.lower, self.upper, self.kind = [], [], kind
        for d, (lo, w) in enumerate(zip(low, width, strict=True)):
            first = lo + w * np.arange(CELLS).astype(kind)
            own = anchors[:, d].astype(kind)
            one, two = first[:, None] * own, (first + (w - 1))[:, None] * own
            self.lower.append(np.minimum(one, two))
            self.upper.append(np.maximum(one, two))

    def bounds(self, cells, rows):
        """(lower, upper), each rows by anchors; cells: dimensions by rows of a block, of which `rows` are asked for."""
        import numpy as np

        n = self.lower[0].shape[1] if self.lower else 0
        out = np.zeros((2, len(rows), n), self.kind)
        for d, (low, high) in enumerate(zip(self.lower, self.upper, strict=True)):
            cell = cells[d][rows]
            out[0] += low[cell]
            out[1] += high[cell]
        return out


def exact(x, q):
    """The scores of rows x and one anchor q, as whole numbers: in floating point where every sum stays exact there."""
    import numpy as np

    if not len(x) or not len(q):
        return np.zeros(len(x), np.int64)
    most = int(abs(x).max()) * int(abs(q).max()) * len(q)
    if most < 2**53:
        return (x.astype(float) @ q.astype(float)).astype(np.int64)
    if most < 2**63:
        return x @ q
    score = x.astype(object) @ q.astype(object)
    if any(abs(s) >= 2**63 for s in score):
        raise OverflowError("a score is beyond 64 bits")
    return score.astype(np.int64)


class Best:
    """The first k rows (greatest score, then least id) that one search has met so far, among scores from low to high."""

    def __init__(self, k: int, low: int | None = None, high: int | None = None):
        self.k, self.low, self.high, self.found = k, low, high, []

    def may_enter(self, lower, upper):
        """Which rows' bounds allow them to enter. `lower` and `upper` bound the scores of all rows that the search may take."""
        import numpy as np

        can = np.ones(len(upper), bool)
        sure = lower
        if self.low is not None:
            can = (upper >= self.low) & (lower <= self.high)
            sure = lower[(lower >= self.low) & (upper <= self.high)]
        # k rows are sure to have scores as high as this
        limits = [self.found[-1][0]] if len(self.found) == self.k else []
        if len(sure) >= self.k:
            limits.append(np.partition(sure, len(sure) - self.k)[len(sure) - self.k])
        return can & (upper >= max(limits)) if limits else can

    def enter(self, scores, ids) -> None:
        import numpy as np

        if self.low is not None:
            own = (scores >= self.low) & (scores <= self.high)
            scores, ids = scores[own], ids[own]
        first = np.lexsort((ids, -scores))[: self.k]
        self.found = sorted([*self.found, *zip(scores[first].tolist(), ids[first].tolist(), strict=True)], key=lambda r: (-r[0], r[1]))[: self.k]


def searched(blocks: DataFrame, anchors: DataFrame, low: list[int], width: list[int], anchor_blocks: int, stripes: int, dims: int, positives: bool) -> DataFrame:
    """(anchor, place, score, id) of the best in each stripe: an anchor's first positives (place 0), or the first negatives of each of its positives' windows (place:
    the positive's). anchors: block, anchor, anchor_id, label, x as bytes, and the positives' scores."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from docloom.llm.negatives import HIGH, LOW, NEGATIVES, POSITIVES, TILE, Best, Tables, exact

        key, rows, tiles, searches = None, [], None, []

        def begun():
            """Tiles of anchors of one label each, and the searches of each anchor."""
            labels = np.array([r[2] for r in rows], np.int64)
            q = np.array([np.frombuffer(r[3], np.int64) for r in rows]).reshape(len(rows), dims)
            own = [[Best(POSITIVES)] if positives else [Best(NEGATIVES, -(-LOW * s // 100), HIGH * s // 100) for s in r[4]] for r in rows]
            some = []
            for label in np.unique(labels):
                of = np.flatnonzero(labels == label)
                some += [(label, of[at : at + TILE], Tables(q[of[at : at + TILE]], low, width)) for at in range(0, len(of), TILE)]
            return q, some, own

        def ended() -> Iterator:
            flat = [(r[0], place, s, k) for r, own in zip(rows, searches, strict=False) for place, best in enumerate(own) for s, k in best.found]
            if flat:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["anchor", "place", "score", "id"])

        for batch in batches:
            for at in range(len(batch)):
                now = (batch.column(0)[at].as_py(), batch.column(1)[at].as_py())
                if now != key:
                    yield from ended()
                    key, rows, tiles, searches = now, [], None, []
                if batch.column(2)[at].as_py() == 0:  # an anchor; those come before the rows
                    rows.append((batch.column(3)[at].as_py(), batch.column(4)[at].as_py(), batch.column(5)[at].as_py(), batch.column(6)[at].as_py(), batch.column(7)[at].as_py()))
                    continue
                if tiles is None:
                    q, tiles, searches = begun()
                n = batch.column(8)[at].as_py()
                ids, labels = (np.frombuffer(batch.column(k)[at].as_py(), np.int64) for k in (9, 10))
                x = np.frombuffer(batch.column(6)[at].as_py(), np.int64).reshape(n, dims)
                cells = np.frombuffer(batch.column(11)[at].as_py(), np.uint8).reshape(dims, n)
                for label, some, tables in tiles:
                    asked = np.flatnonzero((labels == label) == positives)
                    if not len(asked):
                        continue
                    bounds = tables.bounds(cells, asked)
                    lowers, uppers = (np.ascontiguousarray(b.T) for b in bounds)
                    for k, a in enumerate(some):
                        lower, upper, own = lowers[k], uppers[k], searches[a]
                        if positives:
                            other = ids[asked] != rows[a][1]
                            can = asked[other][own[0].may_enter(lower[other], upper[other])]
                        else:
                            may = np.zeros(len(asked), bool)
                            for best in own:
                                may |= best.may_enter(lower, upper)
                            can = asked[may]
                        if len(can):
                            scores, which = exact(x[can], q[a]), ids[can]
                            for best in own:
                                best.enter(scores, which)
        yield from ended()

    stripe = F.pmod(F.xxhash64("block"), F.lit(stripes)).cast("int")
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    tail = [("n", "int"), ("ids", "binary"), ("labels", "binary"), ("cells", "binary")]
    one = anchors.select("a", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe"), F.lit(0).alias("role"), "anchor", "anchor_id", "label", "x", "scores", *(none(c, t) for c, t in tail))
    two = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(anchor_blocks - 1))).alias("a"), stripe.alias("stripe"), F.lit(1).alias("role"), none("anchor", "long"), none("anchor_id", "long"), none("label", "long"), "x", none("scores", "array<long>"), *(c for c, _ in tail))
    dealt = one.unionByName(two).repartition("a", "stripe").sortWithinPartitions("a", "stripe", "role")
    return map_arrow(dealt, run, "anchor long, place int, score long, id long")


def first_of(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its first positives the first rows of other labels
    with LOW * positive_score <= 100 * negative_score <= HIGH * positive_score."""
    spark = vectors.sparkSession
    blocks = durable(packed(vectors, id_col, vector_col, label_col), "negatives-blocks")
    limits = blocks.select("dims", F.posexplode(F.arrays_zip("low", "high")).alias("d", "z")).groupBy("d").agg(F.min("z.low").alias("low"), F.max("z.high").alias("high"))
    limits = {r.d: (r.low, r.high) for r in limits.collect()}
    fewest, dims = blocks.agg(F.min("dims"), F.max("dims")).first()
    # where some vectors are shorter, the zeros that fill them up are components too
    limits = [(min(limits[d][0], 0), max(limits[d][1], 0)) if d >= fewest else limits[d] for d in range(dims or 0)]
    low, width = [lo for lo, _ in limits], [(hi - lo) // CELLS + 1 for lo, hi in limits]
    whole = durable(approximated(blocks, low, width).withColumn("block", F.monotonically_increasing_id()), "negatives-file")
    wide = dims or 0

    def queries(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from docloom.llm.negatives import ANCHOR

        for batch in batches:
            for n, ids, labels, x in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                own, label, x = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64), np.frombuffer(x, np.int64).reshape(n, wide)
                k = np.flatnonzero(own % ANCHOR == 0)
                yield pa.RecordBatch.from_arrays([pa.array(own[k]), pa.array(label[k]), pa.array([x[i].tobytes() for i in k], pa.binary())], names=["anchor_id", "label", "x"])

    anchors = map_arrow(whole.select("n", "ids", "labels", "x"), queries, "anchor_id long, label long, x binary").withColumn("anchor", F.monotonically_increasing_id())
    anchors = durable(anchors, "negatives-anchors")
    total = anchors.count()
    if not total:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    many = -(-total // ANCHORS)
    anchors = anchors.withColumn("a", F.pmod(F.xxhash64("anchor"), F.lit(many)).cast("int"))
    stripes = max(1, min(STRIPES, whole.count()))
    none = F.array().cast("array<long>").alias("scores")
    best = durable(searched(whole, anchors.select("*", none), low, width, many, stripes, wide, True), "negatives-best")
    positives = durable(first_of(best, ["anchor"], POSITIVES).select("anchor", (F.col("rank") - 1).alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")
    # an anchor has POSITIVES of them at most
    lists = positives.groupBy("anchor").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "positive_score"))), lambda z: z["positive_score"]).alias("scores"))
    asked = durable(anchors.join(lists, "anchor"), "negatives-asked")
    found = durable(searched(whole, asked, low, width, many, stripes, wide, False), "negatives-found")
    out = first_of(found, ["anchor", "place"], NEGATIVES).join(positives, ["anchor", "place"]).join(anchors.select("anchor", "anchor_id"), "anchor")
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


SQL = r"""
WITH r AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS k
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(k AS INTEGER) AS rank, negative_id, CAST(positive_score AS BIGINT) AS positive_score, CAST(negative_score AS BIGINT) AS negative_score FROM n WHERE k <= 10
"""
