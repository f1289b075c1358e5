"""Similarity joins by indexes: candidate pairs come from shared keys that every wanted pair must have, never from all pairs of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.lookups import lookup
from docloom.sources.shared import Steps

#: Rows of one key that a task takes on each side; large keys (with more rows than that) that are told to all tasks, more are looked up.
BLOCK, FEW = 1_000, 100_000


def met_pairs(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, block: int | None = None, ordered: bool = True, twins: bool = False, tasks: int | None = None) -> DataFrame:
    """left joined with right on the keys, of which columns a and b tell rows apart; both tables are read more than once. A key with many rows is a grid of
    blocks of them: each row goes to all cells of its block's line, and a task gets single cells, never the key as a whole. ordered: only a < b. twins: both sides have as many rows of each key.
    tasks: how many tasks the join and the counts by key are dealt to, if not the session's number of a shuffle."""
    block = BLOCK if block is None else block
    spaced = lambda df, *c: df.repartition(tasks, *keys, *c) if tasks else df
    blocks = lambda df: spaced(df.select(*keys)).groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias("n")).filter("n > 1")
    wide_l = blocks(left)
    if twins:
        grid = wide_l.select(*keys, F.col("n").alias("__nl"), F.col("n").alias("__nr"))
    else:
        grid = wide_l.withColumnRenamed("n", "__nl").join(blocks(right).withColumnRenamed("n", "__nr"), keys, "full_outer")
        grid = grid.select(*keys, F.coalesce("__nl", F.lit(1)).alias("__nl"), F.coalesce("__nr", F.lit(1)).alias("__nr"))
    large = grid.count()
    if not large:
        out = spaced(left).join(spaced(right), keys)
        return out.filter(F.col(a) < F.col(b)) if ordered else out
    dealt = lambda df: df.join(F.broadcast(grid), keys, "left") if large <= FEW else lookup(df, grid, keys)
    one = F.coalesce("__nl", F.lit(1)), F.coalesce("__nr", F.lit(1))
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    x = dealt(left).withColumn("__i", F.pmod(F.xxhash64(a), one[0]).cast("int")).withColumn("__j", spread(one[1])).drop("__nl", "__nr")
    y = dealt(right).withColumn("__j", F.pmod(F.xxhash64(b), one[1]).cast("int")).withColumn("__i", spread(one[0])).drop("__nl", "__nr")
    out = spaced(x, "__i", "__j").join(spaced(y, "__i", "__j"), [*keys, "__i", "__j"]).drop("__i", "__j")
    return out.filter(F.col(a) < F.col(b)) if ordered else out


def similar_sets(sets: DataFrame, key: str, tokens: str, least: float, measure: str = "jaccard", group: str | None = None, block: int | None = None) -> DataFrame:
    """(grp, a, b, shared, size_a, size_b): the pairs a < b of keys (of one group) whose token sets are similar: shared / union >= least (measure jaccard) or
    shared / smaller >= least (overlap). Keys are unique; sets without tokens are similar to nothing; nulls among the tokens don't count.

    Tokens are ordered by how many sets have them, rare ones first. A set of n tokens that must share k of them with another shares one of its first n - k + 1; so
    these alone are looked up: in the others' first ones for Jaccard, whose sizes bound each other, and in the larger sets' whole lists for overlap.
    A token in every set then makes no pairs, unless a set has no rarer ones. Candidates are confirmed on the whole sets."""
    steps = Steps(sets.sparkSession)
    some = F.array_compact(F.array_distinct(tokens))
    rows = sets.select((F.col(group) if group else F.lit(0)).alias("grp"), F.col(key).alias("k"), F.array_sort(some).alias("s")).filter(F.size("s") > 0)
    rows = steps.keep("sets", rows)
    each = steps.keep("tokens", rows.select("grp", "k", F.size("s").alias("n"), F.explode("s").alias("token")))
    df = steps.keep("frequencies", each.groupBy("grp", "token").agg(F.count("*").alias("df")).filter("df > 1"))
    each = steps.keep("postings", lookup(each, df, ["grp", "token"], "inner"))
    # tokens of one set alone come first in it and meet nothing
    place = F.row_number().over(Window.partitionBy("grp", "k").orderBy("df", "token"))
    common = Window.partitionBy("grp", "k")
    ranked = each.withColumn("r", place + F.col("n") - F.count("*").over(common)).drop("df")
    need = F.ceil(F.lit(least) * F.col("n") - F.lit(1e-9))
    first = ranked.filter(F.col("r") <= F.col("n") - need + 1)
    if measure == "jaccard":
        first = steps.keep("first", first)
        side = lambda c: first.select("grp", "token", F.col("k").alias(c), F.col("n").alias(f"n{c}"), F.col("r").alias(f"r{c}"))
        left, right = side("a"), side("b")
        found = met_pairs(left, right, ["grp", "token"], "a", "b", block, twins=True)
        # the first shared token leaves enough behind it in both
        behind = F.least(F.col("na") - F.col("ra"), F.col("nb") - F.col("rb")) + 1
        found = found.filter(behind >= F.lit(least) / (1 + least) * (F.col("na") + F.col("nb")) - 1e-9).select("grp", "a", "b")
    else:
        probes, lists = steps.keep("first", first.select("grp", "token", F.col("k").alias("x"), F.col("n").alias("nx"))), steps.keep("lists", ranked.select("grp", "token", F.col("k").alias("y"), F.col("n").alias("ny")))
        found = met_pairs(probes, lists, ["grp", "token"], "x", "y", block, ordered=False)
        found = found.filter((F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y")))).select("grp", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    pairs = steps.keep("pairs", found.distinct())
    side = lambda c: rows.select("grp", F.col("k").alias(c), F.col("s").alias(f"s_{c}"))
    whole = steps.keep("left", lookup(pairs, side("a"), ["grp", "a"], "inner"))
    whole = lookup(whole, side("b"), ["grp", "b"], "inner").select("grp", "a", "b", F.size(F.array_intersect("s_a", "s_b")).alias("shared"), F.size("s_a").alias("size_a"), F.size("s_b").alias("size_b"))
    of = (F.col("size_a") + F.col("size_b") - F.col("shared")) if measure == "jaccard" else F.least("size_a", "size_b")
    return steps.last(whole.filter(F.col("shared") / of >= least))


def shortened(word: Column, most: int) -> Column:
    """The word and all that is left of it without up to `most` of its letters."""
    once = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda k: F.concat(F.substr(w, F.lit(1), k - 1), F.substr(w, k + 1)))
    out, last = [F.array(word)], F.array(word)
    for _ in range(most):
        last = F.array_distinct(F.flatten(F.transform(last, once)))
        out.append(last)
    return F.array_distinct(F.flatten(F.array(*out)))


def edit_pairs(words: DataFrame, word: str, most: int = 2, block: int | None = None) -> DataFrame:
    """(a, b, d): the pairs a < b of distinct words that d <= most edits lead from one to the other. Two such words have a string in common that each becomes without
    up to `most` letters; the index holds these strings, and what meets there is confirmed."""
    steps = Steps(words.sparkSession)
    index = steps.keep("neighbours", words.select(F.col(word).alias("a")).dropna().distinct().select("a", F.explode(shortened(F.col("a"), most)).alias("key")))
    met = met_pairs(index, index.withColumnRenamed("a", "b"), ["key"], "a", "b", block, twins=True).select("a", "b").distinct()
    near = met.filter(F.abs(F.length("a") - F.length("b")) <= most).withColumn("d", F.levenshtein("a", "b"))
    return steps.last(near.filter(F.col("d") <= most))


def keyed_pairs(words: DataFrame, word: str, *keys: Column, block: int | None = None) -> DataFrame:
    """(a, b): the pairs a < b of distinct words that share one of the keys, each a column or an array of the word's keys; null and '' are no keys."""
    steps = Steps(words.sparkSession)
    every = words.select(word).dropna().distinct()
    index = None
    for n, key in enumerate(keys):
        some = key if "array" in dict(every.select(key.alias("k")).dtypes)["k"] else F.array(key)
        one = every.select(F.col(word).alias("a"), F.lit(n).alias("no"), F.explode(F.array_distinct(some)).alias("key")).filter("key <> ''")
        index = one if index is None else index.unionByName(one)
    index = steps.keep("keys", index)
    return steps.last(met_pairs(index, index.withColumnRenamed("a", "b"), ["no", "key"], "a", "b", block, twins=True).select("a", "b").distinct())


def prefix_pairs(words: DataFrame, word: str, least: int = 1, block: int | None = None) -> DataFrame:
    """(a, b): the pairs a < b of distinct words of `least` letters or more of which one begins with the other; all beginnings of a word meet the words that are one."""
    steps = Steps(words.sparkSession)
    every = steps.keep("words", words.select(F.col(word).alias("x")).dropna().distinct().filter(F.length("x") >= least))
    whole = steps.keep("whole", every.select("x", F.col("x").alias("key")))
    begin = steps.keep("begin", every.select(F.col("x").alias("y"), F.explode(prefixes(F.col("x"), least)).alias("key")).filter("y <> key"))
    met = met_pairs(whole, begin, ["key"], "x", "y", block, ordered=False)
    return steps.last(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def prefixes(word: Column, least: int) -> Column:
    """All beginnings of the word of `least` letters or more."""
    return F.when(F.length(word) >= least, F.transform(F.sequence(F.lit(least), F.length(word)), lambda k: F.substr(word, F.lit(1), k))).otherwise(F.array().cast("array<string>"))
