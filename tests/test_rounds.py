"""Operators that work in rounds, by indexes or by ranges: held against brute force, and with one key for all rows."""

import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from docloom.operators import entity as en
from docloom.operators import network as net
from docloom.operators import ranks as rk
from docloom.operators import resolve as rs
from docloom.operators import similar as sm
from docloom.operators.lookups import lookup


def spread(df):
    """Rows of df by task."""
    return [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]


@pytest.fixture(scope="module", autouse=True)
def quick(spark):
    """Plans here run over a few rows, so that compiling them would take most of the time."""
    some = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in some}
    for k, v in some.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture
def tasks(spark):
    """Sixteen tasks a shuffle, which stay apart."""
    some = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in some}
    for k, v in some.items():
        spark.conf.set(k, v)
    yield 16
    for k, v in before.items():
        spark.conf.set(k, v)


# lookups


def test_lookup_of_a_hot_key(spark, tasks):
    left = spark.range(20_000).selectExpr("case when id % 10 < 8 then 1 when id % 10 = 8 then id end as k", "id").repartition(8)
    right = spark.range(30_000).selectExpr("id as k", "id * 2 as v")
    for how in ("left", "inner", "left_semi", "left_anti"):
        got = lookup(left, right, ["k"], how, rows=100)
        assert sorted(map(str, got.collect())) == sorted(map(str, left.join(right, ["k"], how).select(*got.columns).collect()))
    hot = lookup(left, right, ["k"], "inner", rows=100)
    assert max(spread(hot)) < 4_000  # of 18,000
    assert sorted(map(str, lookup(left, right, ["k"], "left", rows=10**6).collect())) == sorted(map(str, hot.collect() + left.filter("k is null").selectExpr("k", "id", "cast(null as long) v").collect()))


# clusters


def brute_guarded(nodes, edges, incompatible):
    cluster, members = {n: n for n in nodes}, {n: [n] for n in nodes}
    direct = {frozenset(e[1:]) for e in edges}
    for _, a, b in sorted(set(edges)):
        x, y = sorted((cluster[a], cluster[b]))
        if x == y or any(frozenset((p, q)) not in direct and incompatible(nodes[p], nodes[q]) for p in members[x] for q in members[y]):
            continue
        for n in members[y]:
            cluster[n] = x
        members[x] += members.pop(y)
    return cluster


@pytest.mark.parametrize("seed", range(2))
def test_guarded_clusters(spark, monkeypatch, seed):
    if seed == 1:  # the ways for large tables
        monkeypatch.setattr(en, "CELL", 2)
        monkeypatch.setattr(en, "HOT_ROWS", 0)
        monkeypatch.setattr("docloom.operators.lookups.HOT_ROWS", 3)
        monkeypatch.setattr("docloom.operators.lookups.HOT_SHARE", 20)
    rng = random.Random(seed)
    nodes = {k: (rng.choice(["", "", "jr", "sr"]), rng.choice("xyz")) for k in range(14)}
    edges = [(rng.randrange(3), *rng.sample(range(14), 2)) for _ in range((24, 12)[seed])]
    differ = lambda x, y: x[0] != "" and y[0] != "" and x[0] != y[0] or x[1] + y[1] in ("xz", "zx")
    rule = lambda x, y: (x("mark") != "") & (y("mark") != "") & (x("mark") != y("mark")) | F.concat(x("kind"), y("kind")).isin("xz", "zx")
    n = spark.createDataFrame([(k, *v) for k, v in nodes.items()], "node long, mark string, kind string")
    e = spark.createDataFrame(edges, "rank int, a long, b long")
    want = brute_guarded(nodes, edges, differ)
    assert {r.node: r.cluster for r in en.guarded(n, e, rule, free=0 if seed else 500).collect()} == want
    assert 1 < len(set(want.values())) < 14


def test_guarded_clusters_edges(spark):
    none = lambda x, y: F.lit(False)
    n = spark.createDataFrame([(1, None), (2, "a"), (3, None)], "node long, mark string")
    e = spark.createDataFrame([(0, 2, 1), (0, 2, 1), (1, 3, 3)], "rank int, a long, b long")
    assert {r.node: r.cluster for r in en.guarded(n, e, none).collect()} == {1: 1, 2: 1, 3: 3}
    assert en.guarded(n.limit(0), e.limit(0), none).count() == 0
    assert {r.node: r.cluster for r in en.guarded(n, e.limit(0), none).collect()} == {1: 1, 2: 2, 3: 3}


def test_guarded_chain(spark):
    """One component of a long chain whose edges are taken from one end to the other; a single pair excludes each other."""
    n = 24
    nodes = spark.range(n).select(F.col("id").alias("node"), F.when(F.col("id") == 0, "a").when(F.col("id") == n - 1, "b").otherwise("").alias("mark"))
    edges = spark.range(n - 1).select(F.xxhash64("id").alias("rank"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    rule = lambda x, y: (x("mark") != "") & (y("mark") != "") & (x("mark") != y("mark"))
    got = en.guarded(nodes, edges, rule).groupBy("cluster").agg(F.count("*").alias("n"), F.max("node").alias("top")).orderBy("cluster").collect()
    last = edges.orderBy(F.desc("rank"), F.desc("a")).first()
    assert [(r.cluster, r.n, r.top) for r in got] == [(0, last.b, last.a), (last.b, n - last.b, n - 1)]


@pytest.mark.parametrize("whole", [1_000, 12, 0])
def test_split_mentions(spark, monkeypatch, whole):
    """Keys done in one task and keys done as a graph, by brute force; in one task nothing is written and rows are shuffled once."""
    rng = random.Random(5)
    rows = [(k, rng.randrange(9), rng.choice("pq"), rng.sample("abcdefgh", 0 if rng.random() < 0.04 else rng.randrange(1, 3)), rng.choice([None, *range(40)])) for k in range(110)]
    part = {r[0]: r[0] for r in rows}
    for _ in rows:  # until nothing changes
        for x, y in combinations(rows, 2):
            if x[1:3] == y[1:3] and (not x[3] or not y[3] or set(x[3]) & set(y[3]) or x[4] is not None and x[4] == y[4]):
                part[x[0]] = part[y[0]] = min(part[x[0]], part[y[0]])
    monkeypatch.setattr(en, "WHOLE", whole)
    got = en.split_mentions(spark.createDataFrame(rows, "mention long, k1 int, k2 string, tokens array<string>, grp long"), ["k1", "k2"])
    assert {r.mention: r.part for r in got.collect()} == part and 20 < len(set(part.values())) < 100
    if whole == 1_000:
        assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_split_mentions_of_odd_keys(spark):
    """NaN is one key, a null is none."""
    nan = float("nan")
    rows = [(1, nan, ["a"], None), (2, nan, ["a"], None), (3, None, ["a"], None), (4, None, ["a"], None), (5, 0.0, ["a"], 7), (6, -0.0, ["b"], 7), (7, 0.0, None, None)]
    got = en.split_mentions(spark.createDataFrame(rows, "mention long, k double, tokens array<string>, grp long"), ["k"])
    assert {r.mention: r.part for r in got.collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7}


def brute_first_come(nodes, links):
    near = {}
    for a, b in links:
        near.setdefault(b, set()).add(a)
    seed = {}
    for n in sorted(nodes):
        seed[n] = min((a for a in near.get(n, ()) if seed[a] == a), default=n)
    return seed


@pytest.mark.parametrize("seed", range(2))
def test_first_come(spark, seed):
    rng = random.Random(seed)
    links = [tuple(sorted(rng.sample(range(80), 2))) for _ in range((60, 250)[seed])]
    got = en.first_come(spark.range(80).withColumnRenamed("id", "node"), spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.seed for r in got.collect()} == brute_first_come(range(80), links)


def test_first_come_of_a_hub(spark, tasks):
    """A seed that all rows are linked with."""
    n = 30_000
    links = spark.range(1, n).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    got = en.first_come(spark.range(n).withColumnRenamed("id", "node"), links)
    assert got.agg(F.count("*"), F.max("seed")).first() == (n, 0)


def test_greedy_seeds(spark):
    rng = random.Random(2)
    rows = [(f"g{k % 3}", k, rng.sample("abcdefgh", rng.randrange(0, 5)) + ["same"] * (k % 7 == 0)) for k in range(60)] + [("g0", 500, None), ("g1", 501, [None, "a"])]
    got = {r.key: r.seed for r in en.greedy_seeds(spark.createDataFrame(rows, "grp string, key long, tokens array<string>"), "key", "grp", "tokens").collect()}
    want = {}
    for g in ("g0", "g1", "g2"):
        seeds = []
        for _, k, t in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            s = {x for x in t or () if x}
            found = next((j for j, u in seeds if s and len(s & u) / min(len(s), len(u)) >= 0.6), None)
            want[k] = k if found is None else found
            if found is None and s:
                seeds.append((k, s))
    assert got == want


# similarity joins


@pytest.mark.parametrize(("measure", "least", "block"), [("jaccard", 0.5, 1_000), ("jaccard", 0.8, 3), ("overlap", 0.6, 1_000), ("overlap", 0.5, 4), ("jaccard", 0.05, 5), ("overlap", 1.0, 2)])
def test_similar_sets(spark, measure, least, block):
    rng = random.Random(7)
    sets = {k: set(rng.choices("abcdefghijklmnop", weights=range(1, 17), k=rng.randrange(1, 7))) for k in range(90)} | {200: {"z"}, 201: {"z"}, 202: {"q"}}
    df = spark.createDataFrame([(k, [*s, *s, None]) for k, s in sets.items()] + [(300, []), (301, None)], "k long, s array<string>")
    got = {(r.a, r.b): (r.shared, r.size_a, r.size_b) for r in sm.similar_sets(df, "k", "s", least, measure, block=block).collect()}
    of = {"jaccard": lambda x, y: len(x | y), "overlap": lambda x, y: min(len(x), len(y))}[measure]
    assert got == {(a, b): (len(sets[a] & sets[b]), len(sets[a]), len(sets[b])) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / of(sets[a], sets[b]) >= least}


@pytest.mark.parametrize("measure", ["jaccard", "overlap"])
def test_a_token_of_all_rows_makes_no_pairs(spark, measure):
    """With one token in every row and three of their own, the index meets nothing, whatever the number of rows."""
    df = spark.range(4_000).select(F.col("id").alias("k"), F.array(F.lit("the"), *(F.concat(F.lit(c), F.col("id").cast("string")) for c in "abc")).alias("s"))
    assert sm.similar_sets(df, "k", "s", 0.5, measure).count() == 0
    two = df.union(df.select(F.col("k") + 10_000, "s").limit(50))
    assert sm.similar_sets(two, "k", "s", 0.5, measure).count() == 50


def test_a_large_key_is_a_grid(spark, tasks):
    """All rows have one key: each pair is met once, in tasks of about the same size."""
    rows = spark.range(400).select(F.lit("x").alias("k"), F.col("id").alias("a"))
    met = sm.met_pairs(rows, rows.withColumnRenamed("a", "b"), ["k"], "a", "b", block=40, twins=True)
    assert met.count() == met.distinct().count() == 400 * 399 // 2
    sizes = spread(met)
    assert len(sizes) == tasks and max(sizes) < 3 * 400 * 399 // 2 / tasks
    slate = spark.range(300).select(F.lit(1).alias("g"), F.col("id").alias("m")).union(spark.createDataFrame([(2, 5), (2, 9), (3, 1)], "g int, m long"))
    assert Counter(r.cnt for r in net.co_members(slate, 30).groupBy("a", "b").agg(F.count("*").alias("cnt")).collect()) == Counter({1: 300 * 299 // 2 - 1, 2: 1})


def test_pairs_are_dealt_to_more_tasks_as_they_grow(spark, monkeypatch):
    """However few tasks the session gives a shuffle; the same counts."""
    rng = random.Random(3)
    df = spark.createDataFrame(sorted({(rng.randrange(300), rng.randrange(60)) for _ in range(1_500)}), "l_orderkey long, l_suppkey long").withColumn("l_linenumber", F.lit(1) + F.col("l_suppkey") % 3)
    rank = df.withColumn("lead", F.col("l_linenumber") == 1)
    ways = lambda: (net.pair_counts(net.members(df, "l_orderkey", "l_suppkey")), net.cycling(rank, "l_orderkey", "l_suppkey", "lead"))
    want = [sorted(map(tuple, x.collect())) for x in ways()]
    monkeypatch.setattr(net, "ROWS", 100)
    got = ways()
    assert [sorted(map(tuple, x.collect())) for x in got] == want
    assert all(len(spread(x)) > 10 and max(spread(x)) < 200 for x in got)


def test_pairs_stay_dealt_where_the_session_has_more_tasks(spark, monkeypatch):
    """Adaptive execution would put the session's parts together again, to as many as there are cores."""
    df = spark.range(3_000).selectExpr("id div 5 as l_orderkey", "(id * 7 + id div 11) % 83 as l_suppkey")
    want = sorted(map(tuple, net.pair_counts(net.members(df, "l_orderkey", "l_suppkey")).collect()))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    monkeypatch.setattr(net, "ROWS", 200)
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    try:
        slate = net.members(df, "l_orderkey", "l_suppkey")
        counts = net.pair_counts(slate)
        assert max(spread(slate)) < 400 and max(spread(counts)) < 400
        assert sorted(map(tuple, counts.collect())) == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_groups_are_counted_in_as_many_tasks_as_they_need(spark, monkeypatch):
    """No shuffle of the pair counts keeps the session's number of tasks, the counts by group before them included."""
    df = spark.range(3_000).selectExpr("id div 5 as l_orderkey", "(id * 7 + id div 11) % 83 as l_suppkey", "id % 5 = 0 as lead")
    ways = lambda: (net.pair_counts(net.members(df, "l_orderkey", "l_suppkey")), net.cycling(df, "l_orderkey", "l_suppkey", "lead"))
    want = [sorted(map(tuple, x.collect())) for x in ways()]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    monkeypatch.setattr(net, "ROWS", 200)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    tracker = spark.sparkContext.statusTracker()
    try:
        spark.sparkContext.setJobGroup("counts by group", "")
        assert [sorted(map(tuple, x.collect())) for x in ways()] == want
        stages = [s for job in tracker.getJobIdsForGroup("counts by group") for s in tracker.getJobInfo(job).stageIds]
        tasks = Counter(tracker.getStageInfo(s).numTasks for s in stages)
        assert 7 not in tasks and 15 in tasks, tasks
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)


def test_edit_pairs(spark):
    rng = random.Random(11)
    words = sorted({"".join(rng.choices("abc", k=rng.randrange(0, 7))) for _ in range(150)} | {"smith", "smyth", "smithe", "schmidt", "é", "ée", "müller", "muller"})
    df = spark.createDataFrame([(w,) for w in [*words, None, words[3]]], "w string")

    def lev(a, b):
        row = range(len(b) + 1)
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    far = {(a, b): lev(a, b) for a, b in combinations(words, 2)}
    for most in (1, 2):
        assert {(r.a, r.b): r.d for r in sm.edit_pairs(df, "w", most, block=7).collect()} == {p: d for p, d in far.items() if d <= most}
    got = {tuple(r) for r in sm.prefix_pairs(df, "w", 2, block=5).collect()}
    assert got == {(a, b) for a, b in far if min(len(a), len(b)) >= 2 and (a.startswith(b) or b.startswith(a))}


# permutation null


def test_shuffles_are_bijections():
    import numpy as np

    for total in (1, 2, 3, 10, 255, 256, 257, 5_000):
        for sim in range(3):
            assert sorted(net.shuffled(np.arange(total), total, 1, sim).tolist()) == list(range(total))
    assert net.shuffled(np.arange(50), 50, 1, 0).tolist() != net.shuffled(np.arange(50), 50, 1, 1).tolist()
    # a slot gets each stub as often: 4,000 shuffles of 12, by chi-square for each slot (11 degrees of freedom, 99.99 %)
    seen = np.array([net.shuffled(np.arange(12), 12, 5, sim) for sim in range(4_000)])
    chi = [((np.bincount(seen[:, k], minlength=12) - 4_000 / 12) ** 2 / (4_000 / 12)).sum() for k in range(12)]
    assert max(chi) < 40
    # and two slots each pair of stubs (131 degrees of freedom)
    pairs = np.bincount(seen[:, 0] * 12 + seen[:, 7], minlength=144)
    pairs = pairs[[k for k in range(144) if k // 12 != k % 12]]
    assert ((pairs - 4_000 / 132) ** 2 / (4_000 / 132)).sum() < 200


def brute_stat(slate, total_seed, sim):
    """The statistic of one shuffle, actor by actor: stubs in order of the actors' places, slots in order of the groups' sizes."""
    import numpy as np

    places, sizes = Counter(m for _, m in slate), Counter(g for g, _ in slate)
    stubs = [m for m, c in sorted(places.items(), key=lambda x: (x[1], x[0])) for _ in range(c)]
    drawn = net.shuffled(np.arange(len(stubs)), len(stubs), total_seed, sim)
    met, at = Counter(), 0
    for _, size in sorted(sizes.items(), key=lambda x: x[1]):
        met.update(combinations(sorted({stubs[k] for k in drawn[at : at + size]}), 2))
        at += size
    return sum(c - 1 for c in met.values())


def test_permuted(spark):
    rng = random.Random(4)
    slate = sorted({(rng.randrange(30), rng.choices(range(15), weights=range(1, 16))[0]) for _ in range(150)} | {(99, k) for k in range(90)})
    df = spark.createDataFrame(slate, "g long, m long")
    want = {sim: brute_stat(slate, 1, sim) for sim in range(20)}
    assert {r.sim: r.stat for r in net.permuted(df, 20).collect()} == want
    assert {r.sim: r.stat for r in net.permuted(df, 20, pairs=300).collect()} == want  # in shares of the pairs
    assert [tuple(r) for r in net.permuted(df.limit(0), 2).orderBy("sim").collect()] == [(0, 0), (1, 0)]


def test_permuted_by_marks_or_sorting(spark):
    """Pairs that are marked, sorted, or sorted in shares, and actors looked up in a list or found by division: one statistic."""
    rng = random.Random(6)
    slate = sorted({(rng.randrange(40), rng.choices(range(20), weights=range(1, 21))[0]) for _ in range(200)})
    df = spark.createDataFrame(slate, "g long, m long")
    want = {sim: brute_stat(slate, 1, sim) for sim in range(8)}
    for some in ({}, {"marks": 0}, {"marks": 0, "pairs": 100}):
        assert {r.sim: r.stat for r in net.permuted(df, 8, **some).collect()} == want


def test_owners():
    import numpy as np

    for places in ([(1, 1)], [(3, 40)], [(600, 50), (601, 7)], [(1, 5_000), (2, 30), (700, 3), (400_000, 1)], [(1, 1), (300_000, 2)]):
        every = np.repeat(np.arange(sum(n for _, n in places)), np.repeat(*np.array(places).T))
        assert (net.owners(places)(np.arange(len(every))) == every).all()


@pytest.mark.parametrize("actors", [40_000, 70_000])
def test_large_simulation(actors):
    """Many actors, groups of all kinds: pairs have 32 bits where they are enough, and the statistic is the one of a count pair by pair."""
    import numpy as np

    rng = np.random.default_rng(actors)
    places, sizes = Counter((1 + rng.geometric(0.4, actors)).tolist()), [(1, 500), (2, 9_000), (3, 9_000), (70, 2), (90, 1)]
    left = sum(c * n for c, n in places.items()) - sum(s * n for s, n in sizes)
    sizes, places = sorted([*sizes, (4, (left - left % 4) // 4), *([(left % 4 + 100, 1)] if left % 4 else [])]), sorted(places.items())
    # what the last group takes too many, an actor more has
    places = sorted(Counter({c: n for c, n in places} | {100: 1}).items()) if left % 4 else places
    stubs = np.repeat(np.arange(sum(n for _, n in places)), np.repeat(*np.array(places).T))
    total = sum(s * n for s, n in sizes)
    assert len(stubs) == total
    drawn, met, at = stubs[net.shuffled(np.arange(total), total, 1, 3)].tolist(), Counter(), 0
    for size, groups in sizes:
        for _ in range(groups):
            met.update(combinations(sorted(set(drawn[at : at + size])), 2))
            at += size
    found = list(net.drawn_pairs(sizes, places, 1, 3))
    assert {x.dtype.itemsize for x in found} == {4 if actors == 40_000 else 8}
    assert sum(map(len, found)) == sum(met.values())
    for room in (0, 1_000, total * 9):
        assert net.repeats(iter(found), np.empty(room, found[0].dtype)) == sum(met.values()) - len(met)


def test_a_task_holds_a_simulation_of_large_tables():
    """Sixty times sf0.1 (36 million lines, 60,000 suppliers): drawn once for each simulation; with more actors in shares, each within the memory."""
    sizes = [(k + 1, 60 * n) for k, n in enumerate([11033, 21901, 29587, 29121, 23637, 15589, 8888, 4347, 1917, 802, 287, 85, 29, 9, 1, 3])]
    assert net.shares_of(sizes, 60_000, 64_000_000) == 1
    assert net.shares_of(sizes, 70_000, 64_000_000) == 2


def test_shuffles_beyond_a_power_cost_no_more():
    """A number too large goes through the bijection again: hardly any does, whatever the total."""
    import time

    import numpy as np

    def took(total):
        slots, best = np.arange(total), 9.0
        for _ in range(7):
            began = time.perf_counter()
            net.shuffled(slots, total, 1, 1)
            best = min(best, time.perf_counter() - began)
        return best

    assert took((1 << 18) + 1) < 2.5 * took(1 << 18)


def test_permuted_like_independent_shuffles(spark):
    """Mean and spread of the statistic are those of numpy's shuffles."""
    import numpy as np

    rng = np.random.default_rng(8)
    slate = sorted({(int(g), int(m)) for g, m in zip(rng.integers(0, 25, 140), rng.integers(0, 12, 140), strict=True)})
    got = np.array([r.stat for r in net.permuted(spark.createDataFrame(slate, "g long, m long"), 600).collect()])
    stubs, sizes = np.array([m for _, m in slate]), list(Counter(g for g, _ in slate).values())
    want = []
    for _ in range(600):
        rng.shuffle(stubs)
        met = Counter(p for part in np.split(stubs, np.cumsum(sizes)[:-1]) for p in combinations(sorted(set(part.tolist())), 2))
        want.append(sum(c - 1 for c in met.values()))
    want = np.array(want)
    assert abs(got.mean() - want.mean()) < 5 * want.std() / 600**0.5 and 0.8 < got.std() / want.std() < 1.25


# scans over ranges


def brute_as_of(left, right, overlap):
    out = []
    for i, k, t, roles in left:
        some = [(bool(set(roles) & set(r)) if overlap and roles else not overlap, u, v) for j, u, v, r in right if j == k and None not in (k, t, u) and u < t]
        best = max(some, default=None)
        out.append((i, None if best is None else best[2], bool(overlap and best and roles and best[0])))
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_as_of(spark, parts):
    rng = random.Random(parts)
    left = [(k, rng.choice([1, 1, 1, 2, 3, None]), rng.choice([*range(12), None]), rng.sample("abcd", rng.randrange(3))) for k in range(150)]
    right = [(rng.choice([1, 1, 2, None]), rng.choice([*range(12), None]), rng.randrange(100), rng.sample("abc", rng.randrange(3))) for _ in range(60)]
    x, y = spark.createDataFrame(left, "id long, k int, t int, roles array<string>"), spark.createDataFrame(right, "k int, t int, v int, roles array<string>")
    got = rs.as_of(x, y.select("k", "t", "v"), "k", "t", "v", parts).collect()
    assert sorted((r.id, r.v, False) for r in got) == brute_as_of(left, right, False)
    got = rs.as_of_overlap(x, y, "k", "t", "v", "roles", parts).collect()
    assert sorted((r.id, r.v, r.overlap) for r in got) == brute_as_of(left, right, True)


def test_as_of_of_one_key(spark, tasks):
    """All rows have one key: tasks scan ranges of it."""
    left = spark.range(16_000).select(F.lit(7).alias("k"), F.col("id").alias("t"))
    right = spark.range(0, 16_000, 100).select(F.lit(7).alias("k"), F.col("id").alias("t"), F.col("id").alias("v"))
    got = rs.as_of(left, right, "k", "t", "v", 16)
    assert got.filter("v <> (t - 1) div 100 * 100").count() == 0 and got.filter("v is null").count() == 1


def test_medians(spark, tasks):
    import statistics

    rng = random.Random(1)
    rows = [("hot", rng.randrange(50) / 4) for _ in range(901)] + [("two", 1.5), ("two", 4.0), ("one", -3.0), ("none", None), (None, 2.0), ("some", None), ("some", 9.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    want = {g: statistics.median(v) if (v := [x for h, x in rows if h == g and x is not None]) else None for g in {r[0] for r in rows}}
    assert {r.g: r.mid for r in rk.medians(df, ["g"], "v", "mid").collect()} == want
    assert rk.medians(df, [], "v", "mid").first().mid == statistics.median(x for _, x in rows if x is not None)
    assert rk.medians(df.limit(0), ["g"], "v", "mid").count() == 0


def test_average_ranks_of_one_value(spark, tasks):
    df = spark.range(30_000).select((F.when(F.col("id") < 25_000, 5).otherwise(F.col("id"))).alias("v"))
    got = rk.average_ranks(df, "v").groupBy("avg_rank").agg(F.count("*").alias("n")).orderBy("avg_rank").limit(2).collect()
    assert [tuple(r) for r in got] == [(12_500.5, 25_000), (25_001.0, 1)]


def test_components_of_a_star(spark, tasks):
    edges = spark.range(1, 40_000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    got = en.connected(spark.range(40_001).withColumnRenamed("id", "node"), edges)
    assert sorted(map(tuple, got.groupBy("component").count().collect())) == [(0, 40_000), (40_000, 1)]


def test_as_of_overlap_of_rows_that_are_one(spark, tmp_path):
    """Rows that are one line get one answer, the best of any of them; a null in what says so finds nothing."""
    from docloom import registry

    from .compare import DATA, same

    line = spark.read.parquet(f"{DATA}/lineitem.parquet").filter("l_suppkey <= 3").withColumn("l_orderkey", F.when(F.col("l_orderkey") % 17 > 0, F.col("l_orderkey") % 5)).withColumn("l_partkey", F.col("l_partkey") % 7)
    line.coalesce(1).write.parquet(str(tmp_path / "made"))
    next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "lineitem.parquet")
    for f in (tmp_path / "made").iterdir():
        f.unlink()
    (tmp_path / "made").rmdir()
    name = "j20_as_of_role_overlap"
    same(registry.QUERIES[name](spark, str(tmp_path)), registry.ORACLES[name], str(tmp_path))
