"""Co-occurrence, cohorts and permutation nulls: group members, pairs, entrants, cycling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.similar import met_pairs

#: Rows or pairs that a task of a shuffle gets, about.
ROWS = 1_000_000


def enough(df: DataFrame, rows: int) -> int | None:
    """How many tasks give each at most ROWS of so many rows, and one at least to each core; None where one task does. The session's number of a shuffle is no measure
    of it: adaptive execution puts its parts together again, by bytes and cores, whatever their rows."""
    n = -(-rows // ROWS)
    spark = df.sparkSession
    return max(n, min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))) if n > 1 else None


def dealt(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    return df.repartition(tasks, *keys) if tasks else df


def members(df: DataFrame, group: str, actor: str) -> DataFrame:
    rows = df.select(F.col(group).alias("g"), F.col(actor).alias("m"))
    return dealt(rows, enough(df, df.count()), "g", "m").dropna().distinct()


def pair_tasks(slate: DataFrame) -> tuple[int | None, int | None]:
    """How many tasks the join of a slate (g, m) with itself needs by its rows, and how many the sums by pair. Where the actors make but few pairs, sums made where the pairs are
    found stay small; else the pairs are dealt, and one that meets very often streams through its task."""
    # about how many actors is enough to choose by
    rows, actors = slate.agg(F.count("*"), F.approx_count_distinct("m")).first()
    sizes = dealt(slate.select("g"), enough(slate, rows), "g").groupBy("g").agg(F.count("*").alias("n"))
    pairs = sizes.agg(F.coalesce(F.expr("sum(n * (n - 1) div 2)"), F.lit(0))).first()[0]
    sums = enough(slate, pairs)
    if sums and not enough(slate, actors * (actors - 1) // 2):
        sums = None
    # a task's rows make its pairs
    return enough(slate, max(rows, pairs)), sums


def co_members(slate: DataFrame, block: int | None = None, tasks: int | None = None) -> DataFrame:
    """Unordered pairs (a, b) within each group g. A large group's members are dealt to blocks, and a task gets pairs of blocks."""
    left, right = slate.select("g", F.col("m").alias("a")), slate.select("g", F.col("m").alias("b"))
    return met_pairs(left, right, ["g"], "a", "b", block, twins=True, tasks=tasks)


def pair_counts(slate: DataFrame) -> DataFrame:
    tasks, sums = pair_tasks(slate)
    return dealt(co_members(slate, tasks=tasks).select("a", "b"), sums, "a", "b").groupBy("a", "b").agg(F.count("*").alias("cnt"))


def filled_histogram(counts: DataFrame, value: str, n: str = "n") -> DataFrame:
    """Rows 1..max of value with their numbers, 0 where there are none."""
    seen = counts.groupBy(F.col(value).cast("long").alias(value)).agg(F.count("*").alias(n))
    every = seen.agg(F.max(value).alias("top")).select(F.explode(F.sequence(F.lit(1).cast("long"), "top")).alias(value))
    return every.join(seen, value, "left").select(value, F.coalesce(n, F.lit(0)).alias(n))


def symmetric(pairs: DataFrame) -> DataFrame:
    return pairs.union(pairs.select("b", "a", "cnt").toDF("a", "b", "cnt"))


def additional(slate: DataFrame) -> DataFrame:
    """How often pairs meet again: the sum of max(count - 1, 0)."""
    return pair_counts(slate).agg(F.coalesce(F.sum(F.greatest(F.col("cnt") - 1, F.lit(0))), F.lit(0)).alias("stat"))


def shuffle(total: int, seed: int, sim: int):
    """The function that gives each slot its stub in a simulation: a keyed bijection of the numbers below total. Six rounds of a Feistel network, whose round functions
    are lists of random numbers; its halves have 2^b and as many values as are needed for total, so that hardly a number comes out too large and goes through it again."""
    import numpy as np

    b = max(4, (max(2, total) - 1).bit_length() + 1 >> 1)
    wide = max(16, -(-total // (1 << b)))
    rng = np.random.Generator(np.random.PCG64([seed, sim]))
    lists = [rng.integers(0, *((1 << b, wide) if k % 2 == 0 else (wide, 1 << b)), dtype=np.int64) for k in range(6)]
    shift, mask = np.int64(b), np.int64((1 << b) - 1)

    def once(x):
        # in place, as most of the time would go into new arrays
        left, right, drawn = x >> shift, x & mask, np.empty_like(x)
        for k in range(0, 6, 2):
            np.take(lists[k], left, out=drawn, mode="clip")
            right ^= drawn
            np.take(lists[k + 1], right, out=drawn, mode="clip")
            left += drawn
            # what is below zero is the larger number without a sign
            np.subtract(left, wide, out=drawn)
            np.minimum(left.view(np.uint64), drawn.view(np.uint64), out=left.view(np.uint64))
        left <<= shift
        left |= right
        return left

    def of(slots):
        x = once(np.asarray(slots, np.int64))
        while len(again := np.flatnonzero(x >= total)):
            x[again] = once(x[again])
        return x

    return of


def shuffled(slots, total: int, seed: int, sim: int):
    """The stub that each slot gets in a simulation."""
    return shuffle(total, seed, sim)(slots)


def owners(places: list[tuple[int, int]]):
    """The function that gives each stub its actor; stubs and actors lie in order of the actors' places. A list says who has the first stub of each block, and bisection who
    of the block's has the stub: small lists, as a list of all stubs would be read out of order, from memory."""
    import numpy as np

    starts = np.concatenate([[0], np.cumsum(np.repeat(np.array([c for c, _ in places], np.int64), np.array([n for _, n in places], np.int64)))])
    total = int(starts[-1])
    bits = max(0, places[0][0].bit_length() - 1, total.bit_length() - 17) if places else 0
    heads = np.searchsorted(starts, np.append(np.arange(0, total, 1 << bits), max(0, total - 1)), "right") - 1
    most = int(np.diff(heads).max(initial=0))
    steps = [1 << k for k in reversed(range(most.bit_length()))]

    def of(stubs):
        own = np.take(heads, stubs >> np.int64(bits), mode="clip")
        for step in steps:
            own += (np.take(starts, own + step, mode="clip") <= stubs) * np.int64(step)
        return own

    return of


def pair_bits(actors: int) -> int:
    """Bits of a pair's number."""
    return 32 if actors <= 1 << 16 else 64


def shares_of(sizes: list[tuple[int, int]], actors: int, pairs: int) -> int:
    """In how many shares a task sorts the pairs of a simulation, each of which draws it anew; pairs: how many of 64 bits it holds."""
    return 1 + sum(s * (s - 1) // 2 * n for s, n in sizes) * pair_bits(actors) // (64 * pairs)


def drawn_pairs(sizes: list[tuple[int, int]], places: list[tuple[int, int]], seed: int, sim: int, chunk: int = 1 << 15, owner=None):
    """The pairs of actors that meet in each group of one simulation, as numbers a * actors + b (of 32 bits where they are enough), some groups at a time. sizes: (size, groups of it);
    places: (places of an actor, actors that have so many), both in order; owner: `owners` of places."""
    import numpy as np

    actors = sum(n for _, n in places)
    word = np.dtype(f"uint{pair_bits(actors)}").type
    base = word(min(actors, np.iinfo(word).max))
    stub, owner = shuffle(sum(s * n for s, n in sizes), seed, sim), owner or owners(places)
    at = 0
    for size, groups in sizes:
        if size == 1:  # meets nobody
            at += groups
            continue
        rows, twice = max(1, chunk // size), []
        for first in range(0, groups, rows):
            n = min(rows, groups - first)
            # a row for each place, so that pairs of places are whole arrays
            slots = np.arange(at + first * size, at + (first + n) * size, size) + np.arange(size)[:, None]
            line = owner(stub(slots.ravel())).astype(word).reshape(size, n)
            if size > 64:
                for k in range(n):
                    u = np.unique(line[:, k])
                    for i in range(len(u) - 1):
                        yield u[i] * base + u[i + 1 :]
                continue
            again = np.zeros(n, bool)
            for i in range(size - 1):
                again |= (line[i] == line[i + 1 :]).any(axis=0)
            if len(some := np.flatnonzero(again)):
                # an actor that is drawn twice into a group is there once: these come later, and others take their places
                twice.append(line[:, some])
                n -= len(some)
                line[:, some[some < n]] = line[:, n:][:, ~again[n:]]
                line = line[:, :n]
            for i in range(size - 1):
                met = np.minimum(line[i], line[i + 1 :])
                met *= base
                met += np.maximum(line[i], line[i + 1 :])
                yield met.ravel()
        if twice:
            line = np.sort(np.concatenate(twice, axis=1), axis=0)
            new = np.ones(line.shape, bool)
            np.not_equal(line[1:], line[:-1], out=new[1:])
            for i in range(size - 1):
                yield (line[i] * base + line[i + 1 :])[new[i] & new[i + 1 :]]
        at += size * groups


def repeats(found, codes) -> int:
    """How many of the numbers in these arrays came before; codes: an array to hold them, which is used again and again as new memory takes time; where it is too small, others are made."""
    import numpy as np

    n = 0
    for x in found:
        if n + len(x) > len(codes):
            codes = np.concatenate([codes[:n], np.empty(max(len(x), n >> 3), codes.dtype)])
        codes[n : n + len(x)] = x
        n += len(x)
    codes = codes[:n]
    codes.sort()
    step = 1 << 20
    return sum(int(np.count_nonzero(codes[k + 1 : k + step + 1] == codes[k : min(k + step, n - 1)])) for k in range(0, n - 1, step))


def permuted(slate: DataFrame, simulations: int, seed: int = 1, pairs: int = 64_000_000, marks: int = 1 << 26) -> DataFrame:
    """(sim, stat): the statistic of `additional` in each of so many configuration-model shuffles: every actor keeps its number of
    places and every group its size; an actor drawn twice into a group is there once.

    The statistic depends on how many groups have each size and how many actors each number of places, and on nothing else of the slate. So tasks get these
    two short lists (a total of N has fewer than 2 * sqrt(N) different sizes), and draw for themselves: a keyed bijection says which stub a slot gets, so that nothing is
    sorted or shuffled. Where there are at most `marks` possible pairs, a task marks those that it meets. Else it sorts a simulation's pairs that fall into one share of all pairs, of
    which there are as many as are needed to hold about `pairs` numbers of 64 bits at once."""
    spark = slate.sparkSession
    lengths = lambda c: [tuple(r) for r in slate.groupBy(c).agg(F.count("*").alias("k")).groupBy("k").agg(F.count("*").alias("n")).orderBy("k").collect()]
    sizes, places = lengths("g"), lengths("m")
    actors = sum(n for _, n in places)
    marked = actors**2 <= marks
    shares = 1 if marked else shares_of(sizes, actors, pairs)
    room = sum(s * (s - 1) // 2 * n for s, n in sizes)
    room = room if shares == 1 else room // shares * 17 // 16

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from docloom.operators.network import drawn_pairs, owners, pair_bits, repeats

        owner = owners(places)
        seen, codes = np.zeros(actors**2 if marked else 0, bool), np.empty(0 if marked else room, f"uint{pair_bits(actors)}")
        for batch in batches:
            for unit in batch.column(0).to_pylist():
                sim, share = divmod(unit, shares)
                if marked:
                    met = 0
                    for x in drawn_pairs(sizes, places, seed, sim, owner=owner):
                        met += len(x)
                        seen[x] = True
                    stat = met - int(np.count_nonzero(seen))
                    seen[:] = False
                else:
                    found = drawn_pairs(sizes, places, seed, sim, owner=owner)
                    stat = repeats(found if shares == 1 else (x[x % x.dtype.type(shares) == share] for x in found), codes)
                yield pa.RecordBatch.from_arrays([pa.array([sim], pa.int64()), pa.array([stat], pa.int64())], names=["sim", "stat"])

    units = simulations * shares
    # a task draws some hundred million slots (a few seconds), or less where there are cores for it
    tasks = max(4 * spark.sparkContext.defaultParallelism, units * sum(s * n for s, n in sizes) // 100_000_000)
    each = spark.range(0, units, 1, max(1, min(units, tasks))).mapInArrow(run, "sim long, stat long")
    return each.groupBy("sim").agg(F.sum("stat").alias("stat"))


def new_after_absence(active: DataFrame, who: str, year: str, back: int = 3) -> DataFrame:
    """Marks rows (who, year), one per pair, without activity in the `back` years before."""
    w = Window.partitionBy(who).orderBy(year).rangeBetween(-back, -1)
    return active.withColumn("is_new", F.count("*").over(w) == 0)


def cycling(ranked: DataFrame, group: str, who: str, lead: str) -> DataFrame:
    """Per pair (a, b): whether a led b somewhere, b led a somewhere, and both."""
    one = ranked.select(F.col(group).alias("g"), F.col(who).alias("a"), F.col(lead).alias("la"))
    two = ranked.select(F.col(group).alias("g"), F.col(who).alias("b"), F.col(lead).alias("lb"))
    tasks, sums = pair_tasks(ranked.select(F.col(group).alias("g"), F.col(who).alias("m")))
    pair = dealt(met_pairs(one, two, ["g"], "a", "b", twins=True, tasks=tasks).select("a", "b", "la", "lb"), sums, "a", "b").groupBy("a", "b")
    return pair.agg(F.bool_or(F.col("la") & ~F.col("lb")).alias("a_over"), F.bool_or(F.col("lb") & ~F.col("la")).alias("b_over")).withColumn("cycles", F.col("a_over") & F.col("b_over"))


def ranked_mode(df: DataFrame, keys: list[str], value: str, first: Column | None = None) -> DataFrame:
    """The most frequent value per key; ties to the one first seen, or to the least."""
    counts = df.dropna(subset=[value]).groupBy(*keys, value).agg(F.count("*").alias("cnt"), F.min(first if first is not None else F.col(value)).alias("seen"))
    w = Window.partitionBy(*keys).orderBy(F.col("cnt").desc(), "seen", value)
    return counts.withColumn("rk", F.row_number().over(w)).filter("rk = 1").select(*keys, value, "cnt")
