"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

DataFrame functions only. A document's id places it on the ring and gives it a turn. In order of turns, each document goes to the
first shard clockwise that is not full: a key that overflows a full shard continues along the ring. A shard that is not full takes all keys that
come to it, so between two moments at which a shard fills, an arc of the ring belongs to one shard. So nobody walks the documents one by one:
the moments (one per shard at most) are found from the documents' numbers by arc and part of the turns.

Cases: a null text has no bytes; a null id is the id ''; rows that share an id take turns by text and, where that is the same, by their place in the
input; with fewer rows than shards some shards stay empty; an empty table gives no rows; columns other than id and text are read by
`write_shards` alone, under any name.
"""

from __future__ import annotations

from hashlib import md5
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, lookup

#: Virtual nodes of a shard; bits of a place on the ring and of a turn; rows that one task orders; the least number of parts is 2 ** PART_BITS.
VIRTUAL, BITS, PART_ROWS, PART_BITS = 128, 60, 20_000, 6
#: Parts that a hot part is dealt to are numbered within it.
SPREAD = 1 << 20


def ring(shards: int, virtual: int = VIRTUAL) -> list[tuple[int, int]]:
    """(place, shard) of all virtual nodes in order."""
    return sorted((int(md5(f"{s}:{v}".encode()).hexdigest()[:15], 16), s) for s in range(shards) for v in range(virtual))


def clockwise(nodes: list[tuple[int, int]], open_shards: set[int]) -> list[int]:
    """For each arc (the keys up to a node) the first open shard."""
    out, found = [0] * len(nodes), None
    for k in range(2 * len(nodes) - 1, -1, -1):
        shard = nodes[k % len(nodes)][1]
        found = shard if shard in open_shards else found
        if k < len(nodes):
            out[k] = found
    return out


def listed(numbers: list[int], kind: str) -> Column:
    """The numbers as one constant array."""
    return F.split(F.lit(",".join(map(str, numbers or [0]))), ",").cast(f"array<{kind}>")


def on_ring(p: Column, nodes: list[tuple[int, int]]) -> Column:
    """The arc of a place p. The ring is cut into as many cells as it has nodes; of a cell are known the nodes before it and the few inside."""
    bits = max(1, (len(nodes) - 1).bit_length())
    inside = [0] * (1 << bits)
    for x, _ in nodes:
        inside[x >> (BITS - bits)] += 1
    before = listed([0, *accumulate(inside)], "int")
    cell = F.shiftright(p, BITS - bits).cast("int")
    first, after = F.get(before, cell), F.get(before, cell + 1)
    some = F.slice(listed([x for x, _ in nodes], "bigint"), first + 1, after - first)
    return F.pmod(first + F.size(F.filter(some, lambda x: x < p)), F.lit(len(nodes)))


def in_turn(docs: DataFrame, nodes: list[tuple[int, int]], id_col: str, text_col: str, part_rows: int) -> DataFrame:
    """doc_id, size, text_crc32, arc, and the turn as (part, k): parts follow each other, k counts within a part."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    digits = lambda at: F.conv(F.substring("key", at, BITS // 4), 16, 10).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), key.alias("key"))
    rows = rows.withColumns({"p": digits(1), "h": digits(1 + BITS // 4)}).drop("key")
    rows = rows.withColumns({"arc": on_ring(F.col("p"), nodes), "row": F.monotonically_increasing_id()}).drop("p")
    rows = durable(rows, "shard-rows")
    total = rows.count()
    bits = max(PART_BITS, (total // part_rows).bit_length())
    rows = rows.withColumn("range", F.shiftright("h", BITS - bits))
    # an id that very many rows share makes its range hot: that range's rows are dealt to parts by their place in the input
    hot = durable(rows.groupBy("range").agg(F.count("*").alias("n")).filter(F.col("n") > 4 * part_rows), "shard-hot")
    dealt = lookup(rows, hot, ["range"], "n", max(1, total))
    share = F.coalesce(F.pmod(F.xxhash64("row"), F.ceil(F.col("n") / part_rows)), F.lit(0))
    dealt = dealt.withColumn("part", F.col("range") * SPREAD + share)
    turn = F.row_number().over(Window.partitionBy("part").orderBy("h", "text_crc32", "size", "row"))
    return durable(dealt.select("doc_id", "size", "text_crc32", "arc", "part", turn.alias("k")), "shard-turns")


def phases(turns: DataFrame, nodes: list[tuple[int, int]], room: list[int]) -> list[tuple[tuple[int, int], list[int]]]:
    """[(turn, owner of each arc)]: owners hold for the turns after (part, k), up to that of the next entry. room: rows that each shard takes.

    A step sums a row per part and arc, finds the part in which the next shard fills, and orders that part's rows alone."""
    room = list(room)
    counts = durable(turns.groupBy("part", "arc").agg(F.count("*").alias("n")), "shard-counts")
    at, out = (-1, 0), []
    while open_shards := {s for s, r in enumerate(room) if r > 0}:
        owners = clockwise(nodes, open_shards)
        out.append((at, owners))
        if len(open_shards) == 1:
            break
        shard, left = F.get(listed(owners, "int"), F.col("arc")).alias("shard"), F.get(listed(room, "bigint"), F.col("shard"))
        rest = turns.filter((F.col("part") == at[0]) & (F.col("k") > at[1])).groupBy("part", "arc").agg(F.count("*").alias("n"))
        loads = counts.filter(F.col("part") > at[0]).unionByName(rest).groupBy("part", shard).agg(F.sum("n").alias("n"))
        by_part = Window.partitionBy("shard").orderBy("part")
        full = loads.withColumn("upto", F.sum("n").over(by_part)).filter(F.col("upto") >= left).agg(F.min("part")).first()[0]
        if full is None:
            break
        # the rows of that part one by one, behind one row a shard for all before it
        ahead = loads.filter(F.col("part") < full).groupBy("shard").agg(F.lit(0).alias("k"), F.sum("n").alias("n"))
        inside = turns.filter((F.col("part") == full) & (F.col("k") > (at[1] if at[0] == full else 0))).select("k", shard, F.lit(1).alias("n"))
        inside = inside.select("shard", "k", "n").unionByName(ahead)
        k = inside.withColumn("upto", F.sum("n").over(Window.partitionBy("shard").orderBy("k"))).filter(F.col("upto") >= left).agg(F.min("k")).first()[0]
        for r in inside.filter(F.col("k") <= k).groupBy("shard").agg(F.sum("n").alias("n")).collect():
            room[r.shard] -= r.n
        at = full, k
    return out


def shard(docs: DataFrame, shards: int = 8, slack: float = 0.0, virtual: int = VIRTUAL, id_col: str = "doc_id", text_col: str = "text", part_rows: int = PART_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, size (UTF-8 bytes and one), text_crc32, shard, and its slot in the shard, from 0.

    Without slack a shard takes its even share, so that shards' numbers of rows differ by one at most. With slack it takes up to 1 + slack
    times that: fewer keys overflow, and fewer move when a shard is added."""
    nodes = ring(shards, virtual)
    turns = in_turn(docs, nodes, id_col, text_col, part_rows)
    total = turns.count()
    room = [total // shards + (s < total % shards) for s in range(shards)] if slack <= 0 else [int(-(-total * (1 + slack) // shards))] * shards
    steps = phases(turns, nodes, room)
    step = F.lit(-1)
    for n, ((part, k), _) in enumerate(steps):
        step = F.when(F.struct("part", "k") > F.struct(F.lit(part).cast("long"), F.lit(k)), n).otherwise(step)
    # the owners of all steps in one constant array: shards x arcs numbers, which the parameters bound
    owners = listed([s for _, owned in steps for s in owned], "int")
    turns = turns.withColumn("shard", F.get(owners, step * len(nodes) + F.col("arc")))
    placed = durable(turns.select("doc_id", "size", "text_crc32", "part", "k", "shard"), "shard-placed")
    sums = placed.groupBy("part", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("part", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("part", "shard").orderBy("k")) - 1
    out = placed.withColumn("own", own).join(base, ["part", "shard"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("own")).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", **named) -> DataFrame:
    """Write the rows of docs as Parquet into one folder of path per shard, in order of their slots within each file, and return (shard, n, bytes) of what was
    written. Rows with the same id and text get the other columns of one of them."""
    assigned = durable(shard(docs, id_col=id_col, text_col=text_col, **named), "shards")
    p = "__"
    while any(c.startswith(p) for c in docs.columns):
        p += "_"
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumns({f"{p}id": F.coalesce(F.col(id_col).cast("string"), F.lit("")), f"{p}size": F.octet_length(text) + 1, f"{p}crc": F.crc32(text.cast("binary"))})
    keyed = keyed.dropDuplicates([f"{p}id", f"{p}size", f"{p}crc"])
    of = assigned.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(f"{p}id"), F.col("size").alias(f"{p}size"), F.col("text_crc32").alias(f"{p}crc"), F.col("shard").alias(f"{p}shard"), F.col("slot").alias(f"{p}slot"))
    met = keyed.join(of, [f"{p}id", f"{p}size", f"{p}crc"]).select(*docs.columns, f"{p}shard", f"{p}slot")
    n = max(1, assigned.count() // 1_000_000)
    dealt = met.repartition(F.col(f"{p}shard"), F.floor(F.col(f"{p}slot") / max(1, n))).sortWithinPartitions(f"{p}shard", f"{p}slot")
    dealt.drop(f"{p}slot").withColumnRenamed(f"{p}shard", "_shard").write.partitionBy("_shard").parquet(path)
    return assigned.groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def report(docs: DataFrame, **named) -> DataFrame:
    """The rows of `shard` under the law of even numbers of rows."""
    out = shard(docs, **named)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


# CRC-32 of the text's bytes by its table of 256 remainders; then one step per document in order of turns, each to the first shard
# clockwise with room.
SQL = r"""
WITH RECURSIVE z AS (SELECT i, 0 AS k, i AS c FROM range(256) g(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM z WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS tab FROM z WHERE k = 8),
b AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS m FROM documents),
d AS (SELECT doc_id, len(bytes) + 1 AS size, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda s, x: xor(s >> 8, tab[(xor(s, x) & 255) + 1])), 4294967295) AS text_crc32,
  CAST('0x' || substr(m, 1, 15) AS BIGINT) AS p, CAST('0x' || substr(m, 16, 15) AS BIGINT) AS h FROM b, tab),
v AS (SELECT row_number() OVER (ORDER BY pos, s) - 1 AS i, pos, s FROM (SELECT s, CAST('0x' || substr(md5(s || ':' || v), 1, 15) AS BIGINT) AS pos FROM range(8) x(s), range(128) y(v))),
w AS (SELECT a.i, b.s, min((b.i - a.i + 1024) % 1024) AS far FROM v a, v b GROUP BY a.i, b.s),
arcs AS (SELECT i, list(s ORDER BY far) AS shards FROM w GROUP BY i),
t AS (SELECT doc_id, size, text_crc32, row_number() OVER (ORDER BY h, text_crc32, size) AS turn, (SELECT count(*) FROM v WHERE v.pos < d.p) % 1024 AS i FROM d),
o AS (SELECT t.*, shards FROM t JOIN arcs USING (i)),
room AS (SELECT list_transform(range(8), lambda s: n // 8 + CAST(s < n % 8 AS BIGINT)) AS room FROM (SELECT count(*) AS n FROM documents)),
r AS (SELECT CAST(0 AS BIGINT) AS turn, NULL::BIGINT AS shard, room FROM room
  UNION ALL SELECT turn, shard, list_transform(range(8), lambda x: room[x + 1] - CAST(x = shard AS BIGINT)) FROM
  (SELECT o.turn, list_filter(shards, lambda s: room[s + 1] > 0)[1] AS shard, room FROM r JOIN o ON o.turn = r.turn + 1))
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY o.turn) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM o JOIN r ON o.turn = r.turn
"""
