"""Mixing sources to target weights: fixed-length blocks, multinomial draws per output shard, permuted block indices.

DataFrame functions only. Words are runs of anything but the six ASCII white-space characters.

Cases: a null or empty text has no words and is never taken; a null source is a source of its own, the last one; a row that is
there twice counts and is taken twice; ties in the layout go by doc_id and the text's hash; an empty table gives no rows;
columns of the input other than id, text and source are not read by mix() and are kept by mixed_documents().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, SPACE, durable, lookup, running

#: Words in a block, output slots in a shard, rows in a bucket of the layout, uses that a block may have.
BLOCK, SHARD, BUCKET_ROWS, MOST = 128, 1_024, 512, 3
#: Cells of the inverse distribution function, each with the sources that reach into it.
CELLS = 4_096
#: Rounds of the index permutations.
SHUFFLES = 12


def n_words(text: Column) -> Column:
    """Number of words: the ends of runs, counted without an array of the words."""
    kept = F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", " ")
    spaces = F.length(kept) - F.length(F.replace(kept, F.lit(" "), F.lit("")))
    return F.when(F.trim(kept) == "", F.lit(0)).otherwise(spaces + 1 - kept.startswith(" ").cast("int") - kept.endswith(" ").cast("int")).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """Add target to one row per source (name, source_size): weights repeat over the sources by code point, null last, and share all
    words; a target stops at `most` times the source's size. The excess is shared again by weight, in closed form: with the sources
    ordered by most * size / weight, the first k stop where the level that the others then reach is at least their own."""
    by_name = Window.orderBy(F.col("name").isNull(), F.col("name"))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("weight", weight.cast("double")).withColumn("ratio", most * F.col("source_size") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("name").isNull(), F.col("name"))
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum(most * F.col("source_size")).over(upto), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0)))
    leveled = ranked.withColumn("level", level).withColumn("stops", F.col("ratio") <= F.col("level"))
    free = F.min(F.when(~F.col("stops"), F.struct("ratio", "level"))).over(every)["level"]
    target = F.when(F.col("stops") | free.isNull(), most * F.col("source_size").cast("double")).otherwise(F.least(free * F.col("weight"), most * F.col("source_size").cast("double")))
    return leveled.withColumn("target", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(target)).drop("ratio", "level", "stops", "weight")


def unit(*parts: Column) -> Column:
    """A pseudorandom number in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def permuted(x: Column, n: Column, *key: Column, inverse: bool = False) -> Column:
    """Where a pseudorandom permutation of 0..n-1 takes x. Each round of this swap-or-not shuffle pairs every number with its mirror image
    about a drawn one and swaps the two or not by a hash of the pair, so that a round is its own inverse. Only sums and
    remainders of numbers below n are made, whatever n is."""
    rounds = F.sequence(F.lit(SHUFFLES - 1), F.lit(0)) if inverse else F.sequence(F.lit(0), F.lit(SHUFFLES - 1))

    def step(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(r, *key), n) - x, n)
        return F.when(F.pmod(F.xxhash64(r, F.greatest(x, other), *key), F.lit(2)) == 1, other).otherwise(x)

    return F.aggregate(rounds, x.cast("long"), step)


def mix(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, pieces, used): rows of docs with their place in their source; the pieces of documents in blocks; and how often
    the mix uses each block (name, index, uses), a block in uses of several slots.

    Every output shard has `shard` slots, whose counts by source are one multinomial draw of the sources' shares. The k-th slot of a source with n
    blocks takes the block to which a permutation, another one for each round over the blocks, takes k mod n, so that every block is used
    once before one is used again. No key holds a source: places, ranks and joins go by bucket or block."""
    text, name = F.col(text_col), F.col(source_col).cast("string")
    rows = durable(docs.select(F.col(id_col).alias("doc_id"), name.alias("name"), n_words(text).alias("size"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("mark")), "mix-rows")
    total = rows.count()
    sums = rows.groupBy("name").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    goal = targets(sums).withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    goal = goal.withColumn("slots", F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(0.0))
    goal = durable(goal.withColumn("src", F.row_number().over(Window.orderBy(F.col("name").isNull(), F.col("name")))), "mix-goal")
    wide = max(1, -(-total // BUCKET_ROWS))
    placed = with_source(rows, goal.select("name", "src", "source_size", "target", "n_rows"), total)
    placed = running(placed, ["src"], [F.col("doc_id"), F.col("mark"), F.col("size")], "size", "at", wide, F.xxhash64("doc_id", "mark", F.lit(seed)))
    placed = durable(placed.withColumn("row", F.monotonically_increasing_id()), "mix-placed")
    used = durable(uses(goal, shard, seed), "mix-used")
    first, last = F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block)
    spread = placed.filter("size > 0").select("row", "src", "at", "size", F.explode(F.sequence(first, last)).alias("index"))
    begin = F.greatest(F.col("at"), F.col("index") * block) - F.col("at")
    pieces = spread.select("row", "src", "index", begin.alias("start"), (F.least(F.col("at") + F.col("size"), (F.col("index") + 1) * block) - F.col("at") - begin).alias("words"))
    return placed, pieces, used


def with_source(rows: DataFrame, goal: DataFrame, total: int) -> DataFrame:
    known = F.struct(F.col("name").isNull().alias("none"), F.coalesce("name", F.lit("")).alias("name"))
    out = lookup(rows.withColumn("k", known).drop("name"), goal.withColumn("k", known).drop("name"), ["k"], "n_rows", total, "inner")
    return out.withColumn("name", F.when(~F.col("k.none"), F.col("k.name"))).drop("k", "n_rows")


def shard_counts(share: DataFrame, slots: int, shard: int, seed: int) -> DataFrame:
    """(shard, src, n): for each shard of so many slots in all, a multinomial draw of its slots' sources by share (src, slots). A slot's draw is looked up by the cell of the inverse distribution function that it falls into."""
    spark = share.sparkSession
    whole = share.agg(F.sum("slots")).first()[0]
    upto = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, -1)
    # the last source reaches to 1 whatever the rounding of the sums
    lo = F.coalesce(F.sum("slots").over(upto), F.lit(0.0)) / whole
    limits = share.withColumn("lo", lo).withColumn("hi", F.coalesce(F.lead("lo").over(Window.orderBy("src")), F.lit(1.0))).filter("hi > lo")
    cells = durable(limits.select("src", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))).alias("cell")), "mix-cells")
    tasks = max(1, min(20_000, slots // 200_000))
    drawn = spark.range(0, slots, 1, tasks).select(F.floor(F.col("id") / shard).alias("shard"), unit(F.lit(seed), F.col("id")).alias("u"))
    drawn = drawn.withColumn("cell", F.floor(F.col("u") * CELLS))
    met = drawn.join(F.broadcast(cells) if cells.count() <= BROADCAST_ROWS else cells, "cell").filter("u >= lo and u < hi")
    return met.groupBy("shard", "src").agg(F.count("*").alias("n"))


def draws(goal: DataFrame, shard: int, seed: int) -> DataFrame:
    """(shard, src, n, base): the slots of all shards, with base counting those of the source in the shards before.

    Every shard's counts are a multinomial draw. Over all shards a source takes its target in whole slots: of draws beyond that, about
    the square root of their number, the last ones are refused, and as many slots go in closing shards to the sources that the draws
    have left short. So no block is used more than MOST times, and no draw is lost."""
    spark = goal.sparkSession
    share = goal.filter("slots > 0")
    by_rest = Window.orderBy(F.desc(F.col("slots") - F.floor("slots")), "src")
    sums = share.agg(F.sum("slots"), F.sum(F.floor("slots"))).first()
    whole, more = round(sums[0] or 0.0), round(sums[0] or 0.0) - (sums[1] or 0)
    if whole <= 0:
        return spark.createDataFrame([], "shard long, src int, n long, base long")
    need = durable(share.select("src", "slots", (F.floor("slots") + (F.row_number().over(by_rest) <= more).cast("int")).alias("need")), "mix-need")
    shards = -(-whole // shard)
    got = durable(shard_counts(need.select("src", "slots"), whole, shard, seed), "mix-draws")
    placed = running(got, ["src"], [F.col("shard")], "n", "base", max(1, -(-shards // 256)), F.floor(F.col("shard") / 256))
    small = need.count() <= BROADCAST_ROWS
    limits = F.broadcast(need.select("src", "need")) if small else need.select("src", "need")
    kept = placed.join(limits, "src").select("shard", "src", F.least("n", F.col("need") - F.col("base")).alias("n"), "base").filter("n > 0")
    drawn = got.groupBy("src").agg(F.sum("n").alias("base"))
    short = need.join(drawn, "src", "left").select("src", "need", F.coalesce("base", F.lit(0)).cast("long").alias("base")).filter("base < need")
    return kept.unionByName(short.select(F.lit(shards).cast("long").alias("shard"), "src", (F.col("need") - F.col("base")).alias("n"), "base"))


def uses(goal: DataFrame, shard: int, seed: int) -> DataFrame:
    """(src, index, uses): how many slots of all shards take each block."""
    blocks = goal.select("src", "blocks")
    counts = draws(goal, shard, seed)
    slots = counts.join(F.broadcast(blocks) if blocks.count() <= BROADCAST_ROWS else blocks, "src").select("src", "blocks", F.explode(F.sequence(F.col("base"), F.col("base") + F.col("n") - 1)).alias("k"))
    lap = F.floor(F.col("k") / F.col("blocks"))
    index = permuted(F.col("k") % F.col("blocks"), F.col("blocks"), F.col("src"), lap, F.lit(seed))
    return slots.select("src", index.alias("index")).groupBy("src", "index").agg(F.count("*").alias("uses"))


def taken_words(docs: DataFrame, **named) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken."""
    placed, pieces, used = mix(docs, **named)
    sums = pieces.join(used, ["src", "index"]).groupBy("row").agg(F.sum(F.col("words") * F.col("uses")).alias("taken"))
    return placed.join(sums, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str = "n_chars", **named) -> DataFrame:
    """The mix as rows like those of docs: up to three copies of a document, the k-th with the words of its blocks that the mix
    uses k times or more, in order and with the white space behind each (the text as it is where those are all). A document without such words has no row;
    so a source whose target is below its size loses blocks, and one above it repeats them. Character counts are made anew."""
    placed, pieces, used = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **named)
    p = "__"
    while any(c.startswith(p) for c in docs.columns):  # names that clash with none of the input
        p += "_"
    at = {n: p + n for n in ("id", "mark", "i", "m", "size", "parts", "copy", "some", "split")}
    # the blocks of one document, which its text bounds
    plans = pieces.join(used, ["src", "index"]).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "words", "uses"))).alias(at["parts"]))
    plans = durable(placed.select("row", F.col("size").alias(at["size"]), F.col("doc_id").alias(at["i"]), F.col("mark").alias(at["m"])).join(plans, "row"), "mix-plans").drop("row")
    texts = docs.withColumn(at["id"], F.col(id_col)).withColumn(at["mark"], F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    if not placed.groupBy("doc_id", "mark").agg(F.count("*").alias("c")).filter("c > 1").isEmpty():
        texts = texts.dropDuplicates([at["id"], at["mark"]])
    out = texts.join(plans, F.col(at["id"]).eqNullSafe(F.col(at["i"])) & (F.col(at["mark"]) == F.col(at["m"])))
    out = out.withColumn(at["copy"], F.explode(F.sequence(F.lit(1), F.array_max(F.transform(at["parts"], lambda x: x["uses"])).cast("int"))))
    out = out.withColumn(at["some"], F.filter(at["parts"], lambda x: x["uses"] >= F.col(at["copy"])))
    whole = F.aggregate(at["some"], F.lit(0).cast("long"), lambda s, x: s + x["words"]) == F.col(at["size"])
    # words with the white space after them, the first one with that before it too
    words = F.regexp_extract_all(F.col(text_col), F.lit(rf"(?:\A{SPACE}+)?[^\x20\x09-\x0D]+{SPACE}*"), F.lit(0))
    out = out.withColumn(at["split"], F.when(~whole, words))
    cut = F.array_join(F.flatten(F.transform(at["some"], lambda x: F.slice(at["split"], (x["start"] + 1).cast("int"), x["words"].cast("int")))), "")
    out = out.withColumn(text_col, F.when(whole, F.col(text_col)).otherwise(cut))
    if chars_col in docs.columns:
        out = out.withColumn(chars_col, F.length(text_col).cast(dict(docs.dtypes)[chars_col]))
    return out.select(*docs.columns)
