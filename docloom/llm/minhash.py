"""Near-duplicates by MinHash with tensored banding; every candidate is confirmed on the full shingle sets.

Cases: a null or empty text has no shingles and is linked with nothing; equal sets are one class before any search, so copies
never make pairs; rows that share a doc_id are one document; a null doc_id is linked with nothing, has a null component
and is kept; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, durable, lookup, map_arrow, within
from .components import components

#: Members of one pivot that are compared by one task; documents of one shingle that meet as many others of it in a task.
COMPARE_ROWS, MEET_ROWS = 100, 1_000


def sketches(docs: DataFrame, size: int, halves: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, digest of the shingle set (null if empty), half-keys."""

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        from docloom.llm.shingles import Sketcher, shingles

        sketcher = Sketcher(halves, rows)
        for batch in batches:
            n, digest, keys = [], [], []
            for text in batch.column(1):
                items = shingles(text.as_py(), size)
                n.append(len(items))
                digest.append(hashlib.blake2b(items.tobytes(), digest_size=16).digest() if len(items) else None)
                keys.append(sketcher.half_keys(items) if len(items) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "digest", "keys"])

    return map_arrow(docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text"), run, "doc_id long, n_shingles long, digest binary, keys array<long>")


def compare(docs: DataFrame, pairs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(a, b, same, total): sizes of intersection and union of the full sets of each pair (a, b) of the durable table pairs.

    Sets are made again from the texts of the documents that are in pairs. A task streams over rows sorted by (a, share):
    first a's set, then those of its partners, of which a share has about COMPARE_ROWS; it holds one set at a time."""
    degree = durable(pairs.groupBy("a").agg(F.count("*").alias("n")), "pair-degrees")
    total = pairs.count()
    shares = F.ceil(F.col("n") / COMPARE_ROWS).cast("int")
    dealt = lookup(pairs, degree, ["a"], "n", total, "inner")
    partners = dealt.select(F.col("b").alias("doc_id"), "a", F.pmod(F.xxhash64("b"), shares).cast("int").alias("share"), F.lit(1).alias("role"))
    heads = degree.select(F.col("a").alias("doc_id"), "a", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"), F.lit(0).alias("role"))
    wanted = durable(partners.unionByName(heads), "pair-wanted")
    ids = durable(wanted.select("doc_id").distinct(), "pair-ids")

    def sets(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from docloom.llm.shingles import shingles

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t.as_py(), size).tobytes() for t in batch.column(1)], pa.binary())], names=["doc_id", "items"])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        head, own = None, []
        for batch in batches:
            out: dict[tuple, tuple] = {}
            for a, share, role, b, raw in zip(*(batch.column(k).to_pylist() for k in range(4)), (x.as_buffer() for x in batch.column(4)), strict=True):
                items = np.frombuffer(raw, np.uint64)
                if role == 0:
                    if head != (a, share):
                        head, own = (a, share), []
                    own.append(items.copy())
                    continue
                for mine in own:
                    same = len(np.intersect1d(mine, items, assume_unique=True))
                    union = len(mine) + len(items) - same
                    if (a, b) not in out or same * out[a, b][1] > out[a, b][0] * union:
                        out[a, b] = same, union
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in out], pa.int64()), pa.array([k[1] for k in out], pa.int64()), pa.array([v[0] for v in out.values()], pa.int64()), pa.array([v[1] for v in out.values()], pa.int64())], names=["a", "b", "same", "total"])

    texts = within(docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text"), ids, ["doc_id"])
    made = map_arrow(texts, sets, "doc_id long, items binary")
    joined = made.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, "doc_id")
    grouped = joined.select("a", "share", "role", "doc_id", "items").repartition("a", "share").sortWithinPartitions("a", "share", "role", "doc_id")
    return durable(map_arrow(grouped, run, "a long, b long, same long, total long"), "pair-sizes")


def near_duplicates(docs: DataFrame, threshold: int = 85, size: int = 5, halves: int = 12, rows: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept. Linked are documents whose sets have
    100 * intersection >= threshold * union.

    With 12 half-keys of 4 minhashes a side, a pair at 0.85 shares a table with probability 0.9997. Buckets don't make all
    their pairs: each member is compared with the bucket's least member (its pivot); where a bucket then still holds
    several components, an exact prefix filter finds what may link them."""
    light = durable(sketches(docs, size, halves, rows, id_col, text_col), "near-light")
    sets = durable(light.filter("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first("keys").alias("keys")), "near-classes")
    named = light.filter("doc_id is not null and digest is not null")
    total = light.count()
    split = F.posexplode("keys").alias("place", "value")
    single = sets.select("rep", split)
    shared = durable(single.groupBy("place", "value").agg(F.count("*").alias("c")).filter("c > 1"), "near-halves")
    alive = lookup(single, shared, ["place", "value"], "c", sets.count() * 2 * halves, "inner")
    alive = durable(alive.groupBy("rep").agg(F.collect_list(F.struct("place", "value")).alias("keys")), "near-alive")
    first, second = F.filter("keys", lambda k: k["place"] < halves), F.filter("keys", lambda k: k["place"] >= halves)
    tables = alive.select("rep", F.explode(first).alias("u"), second.alias("second")).select("rep", "u", F.explode("second").alias("v"))
    tables = tables.select("rep", F.xxhash64("u.place", "u.value", "v.place", "v.value").alias("key"))
    buckets = durable(tables.groupBy("key").agg(F.count("*").alias("c"), F.min("rep").alias("pivot")).filter("c > 1"), "near-buckets")
    inside = lookup(tables, buckets, ["key"], "c", alive.count() * halves * halves, "inner")
    pairs = durable(inside.filter("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct(), "near-pairs")
    linked = F.expr(f"100 * same >= {threshold} * total")
    # rows of one doc_id with different texts belong together
    again = durable(sets.join(named, "digest").filter("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct(), "near-ids") if _repeated(named) else None
    sizes = compare(docs, pairs, size, id_col, text_col)
    links = sizes.filter(linked).select("a", "b")
    if again is not None:
        links = links.unionByName(again)
    links = durable(links, "near-links")
    of = durable(components(links), "near-labels")
    rest = residual(docs, tables, buckets, of, threshold, size, alive.count() * halves * halves, id_col, text_col)
    if not rest.isEmpty():
        links = durable(links.unionByName(compare(docs, rest, size, id_col, text_col).filter(linked).select("a", "b")), "near-links")
        of = durable(components(links), "near-labels")
    members = durable(sets.join(of.withColumnRenamed("node", "rep"), "rep", "left").select("digest", "n", F.coalesce("component", "rep").alias("component_id")), "near-members")
    out = lookup(light, members, ["digest"], "n", total)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _repeated(named: DataFrame) -> bool:
    """Whether a doc_id comes with two texts."""
    return not named.groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).filter("x <> y").isEmpty()


def residual(docs: DataFrame, tables: DataFrame, buckets: DataFrame, of: DataFrame, threshold: int, size: int, total: int, id_col: str, text_col: str) -> DataFrame:
    """Pairs (a, b) in different components that may still be linked, by an exact prefix filter among the documents of buckets
    in which several components meet.

    Such documents' shingles are ordered by how many of these documents have them, rare ones first. Two sets with the
    threshold's overlap share a shingle among their first n - ceil(threshold * n) + 1, and the first shared one leaves enough behind
    it in both. In a group of copies with edits the first ones are the edits, so that pairs come from common edits alone.
    Of a shingle's documents, those outside its largest component are joined with all."""
    label = of.select(F.col("node").alias("rep"), "component")
    inside = lookup(tables, buckets.filter("c > 2"), ["key"], "c", total, "inner").select("key", "rep")
    rows = inside.join(F.broadcast(label) if label.count() <= BROADCAST_ROWS else label, "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("label"))
    mixed = durable(rows.groupBy("key").agg(F.count("*").alias("c"), F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("key", "c"), "near-mixed")
    some = durable(lookup(rows, mixed, ["key"], "c", total, "inner").select("rep", "label").distinct(), "near-open")

    def items(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from docloom.llm.shingles import shingles

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t.as_py(), size).view(np.int64) for t in batch.column(1)], pa.list_(pa.int64()))], names=["rep", "items"])

    texts = within(docs.selectExpr(f"cast(`{id_col}` as long) rep", f"`{text_col}` text"), some, ["rep"])
    each = durable(map_arrow(texts, items, "rep long, items array<long>").select("rep", F.size("items").alias("n"), F.explode("items").alias("item")), "near-items")
    often = durable(each.groupBy("item").agg(F.count("*").alias("df")).filter("df > 1"), "near-often")
    ranked = lookup(each, often, ["item"], "df", each.count()).withColumn("df", F.coalesce("df", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy("rep").orderBy("df", "item"))
    prefix = ranked.withColumn("r", rank).filter(F.expr(f"r <= n - ceil({threshold} * n / 100.0) + 1 and df > 1")).select("item", "rep", "n", "r")
    prefix = durable(prefix.join(F.broadcast(some) if some.count() <= BROADCAST_ROWS else some, "rep"), "near-prefix")
    by_label = prefix.groupBy("item", "label").agg(F.count("*").alias("c"))
    main = durable(by_label.groupBy("item").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count("*").alias("labels"), F.sum("c").alias("c")).filter("labels > 1").select("item", "main", "c"), "near-main")
    blocks = F.ceil(F.col("c") / MEET_ROWS).cast("int").alias("blocks")
    shared = durable(lookup(prefix, main, ["item"], "c", prefix.count(), "inner").select("item", "rep", "n", "r", "label", "main", blocks), "near-shared")
    # the documents of a very common shingle are a grid of blocks, and a task gets single cells of it
    block, each_block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    minor = shared.filter("label <> main").withColumn("i", block).withColumn("j", each_block).drop("blocks")
    other = shared.withColumn("j", block).withColumn("i", each_block)
    other = other.select("item", "i", "j", F.col("rep").alias("rep2"), F.col("n").alias("n2"), F.col("r").alias("r2"), F.col("label").alias("label2"), (F.col("label") != F.col("main")).alias("minor2"))
    enough = F.expr(f"least(n - r, n2 - r2) + 1 >= ceil({threshold} * (n + n2) / {100.0 + threshold})")
    met = minor.join(other, ["item", "i", "j"]).filter((F.col("label") != F.col("label2")) & enough & (~F.col("minor2") | (F.col("rep") < F.col("rep2"))))
    return durable(met.select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b")).distinct(), "near-rest")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", **named) -> DataFrame:
    """The rows of docs whose document is the one that its group of near-duplicates keeps, with all their columns."""
    gone = durable(near_duplicates(docs, id_col=id_col, **named).filter("not kept").select(F.col("doc_id").alias("__id")).distinct(), "near-gone")
    return within(docs.withColumn("__id", F.col(id_col)), gone, ["__id"], "left_anti").drop("__id")
