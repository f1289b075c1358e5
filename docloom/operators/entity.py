"""Entity resolution: blocking, candidate pairs, components, guarded clusters, rosters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.lookups import HOT_ROWS, lookup
from docloom.operators.network import dealt, enough
from docloom.operators.ranks import row_numbers
from docloom.operators.similar import met_pairs, similar_sets
from docloom.sources.shared import Steps

#: Profiles of a cluster that a task compares with as many of another; clusters that one cluster may take in a round.
CELL, SUITORS = 1_000, 500
#: Mentions of one key that a task takes as a whole.
WHOLE = 20_000


def blocked_pairs(df: DataFrame, key: str, blocks: DataFrame, cap: int | None = None) -> DataFrame:
    """Unordered pairs (a, b) that share a block, with the first block that proposes each. blocks: (key, block_no, block). A cap
    leaves out blocks with more keys, which is part of the rule and not a matter of speed."""
    rows = blocks.dropDuplicates([key, "block_no", "block"])
    if cap is not None:
        allowed = rows.groupBy("block_no", "block").agg(F.count("*").alias("n")).filter(F.col("n") <= cap).drop("n")
        rows = rows.join(allowed, ["block_no", "block"])
    a, b = rows.select("block_no", "block", F.col(key).alias("a")), rows.select("block_no", "block", F.col(key).alias("b"))
    return met_pairs(a, b, ["block_no", "block"], "a", "b", twins=True).groupBy("a", "b").agg(F.min("block_no").alias("why"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows into the folder that the cluster names, until the JVM ends, and read them again."""
    return Steps(df.sparkSession).last(df)


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b). In each round every node with links hooks to the neighbour of
    least hash and the links are rewritten to the hooked nodes, which at least halves the nodes that have links; hashes keep chains of hooks
    short. A hub's links, and the nodes of a giant component, are looked up without meeting in one task."""
    steps = Steps(nodes.sparkSession)
    mark = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    links = steps.keep("links", edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    names, hooks, total = nodes.select("node", F.col("node").alias("root")), 0, None
    while n := links.count():
        both = links.union(links.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min(mark("v")).alias("m"), F.count("*").alias("n"))
        hook = steps.keep(f"hook{hooks}", low.select("u", "n", F.when(F.col("m") < mark("u"), F.col("m.v")).otherwise(F.col("u")).alias("p")))
        one = lookup(links, hook.select(F.col("u").alias("a"), "n", F.col("p").alias("pa")), ["a"], "inner", counted=True, total=n)
        two = lookup(one, hook.select(F.col("u").alias("b"), "n", F.col("p").alias("pb")), ["b"], "inner", counted=True, total=n)
        links = steps.keep("links", two.filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        to = hook.select(F.col("u").alias("root"), "p")
        # at first every node is its own root; later many nodes share one
        met = names.join(to, "root", "left") if not hooks else lookup(names, to, ["root"], total=total)
        names = met.select("node", F.coalesce("p", "root").alias("root"))
        if total is None or total > HOT_ROWS:
            names = steps.keep("names", names)
            total = names.count()
        hooks += 1
    least = names.groupBy("root").agg(F.min("node").alias("component"), F.count("*").alias("n"))
    least = least if total is not None and total <= HOT_ROWS else steps.keep("least", least)
    return steps.last(lookup(names, least, ["root"], "inner", counted=True, total=total).select("node", "component"))


def guarded(nodes: DataFrame, edges: DataFrame, incompatible: Callable, free: int = 500) -> DataFrame:
    """(node, cluster): edges (a, b, rank) in order of (rank, a, b) merge clusters, unless two members across them are incompatible without
    an edge of their own. A cluster is named by its smallest node. nodes: node and the columns that incompatible(x, y) reads of two profiles, where x and y give a
    column by its name.

    Nobody takes the edges one by one. An edge that is the first of both its clusters is decided at once: whatever the sequential rule decides before it
    touches neither. So are the next edges of one of the two, as long as they are first for their other ends and nothing else can come between. So a round merges or vetoes many clusters, and what is known of pairs of clusters (the first edge, whether there was a veto, how many edges join incompatible
    nodes) and of single ones (their profiles, with numbers) is contracted to the merged ones. Two clusters exclude each other if they have more incompatible pairs than such edges.
    A veto stays, as clusters only grow, and so does away with all edges between the two. Components of at most `free` profiles without an incompatible pair are done in one step, however
    long their chains of edges."""
    steps = Steps(nodes.sparkSession)
    columns = [c for c in nodes.columns if c != "node"]
    profile = F.struct(*columns) if columns else F.struct(F.lit(0).alias("none"))
    apart = incompatible(lambda c: F.col("x")[c], lambda c: F.col("y")[c])
    known = steps.keep("known", nodes.select("node", profile.alias("w"), F.to_json(profile).alias("profile")))
    raw = edges.select("a", "b", "rank").filter("a <> b").groupBy(F.least("a", "b").alias("cx"), F.greatest("a", "b").alias("cy")).agg(F.min(F.struct("rank", "a", "b")).alias("o"))
    side = lambda c, w: known.select(F.col("node").alias(c), F.col("w").alias(w))
    ends = steps.keep("ends", lookup(steps.keep("raw", raw), side("cx", "x"), ["cx"], "inner"))
    # at first each node is a cluster; cx < cy
    pairs = lookup(ends, side("cy", "y"), ["cy"], "inner").select("cx", "cy", "o", F.lit(False).alias("veto"), F.when(apart, 1).otherwise(0).cast("long").alias("direct"))
    pairs = steps.keep("relations", pairs)
    members = steps.keep("members", known.select(F.col("node").alias("c"), "profile", "w", F.lit(1).cast("long").alias("n")))
    hooks, rounds, check, size = [], 0, 0, members.count()

    def contracted(name: str, df: DataFrame, n: int, hook: DataFrame, *ends: str) -> DataFrame:
        df = df if n <= HOT_ROWS else steps.keep(name, df)
        for c in ends:
            df = lookup(df, hook.select(F.col("u").alias(c), "p"), [c], total=n).withColumn(c, F.coalesce("p", c)).drop("p")
        return df

    def conflicts(chosen: DataFrame) -> DataFrame:
        """(cx, cy, n): incompatible pairs across two clusters, profile by profile, in cells of a grid."""
        if size <= CELL:  # as all clusters together
            one, two = (members.select(F.col("c").alias(c), F.col("w").alias(w), F.col("n").alias(n)) for c, w, n in (("cx", "x", "nx"), ("cy", "y", "ny")))
            return chosen.select("cx", "cy").join(one, "cx").join(two, "cy").filter(apart).groupBy("cx", "cy").agg(F.sum(F.col("nx") * F.col("ny")).alias("n"))
        wanted = chosen.select(F.col("cx").alias("c")).union(chosen.select(F.col("cy").alias("c"))).distinct()
        chosen = chosen.select("cx", "cy")
        own = steps.keep("own", members.join(wanted, "c", "left_semi").groupBy("c").agg(F.ceil(F.count("*") / CELL).cast("int").alias("k")))
        some = lookup(members, own, ["c"], "inner").select("c", "w", "n", F.pmod(F.xxhash64("profile"), "k").cast("int").alias("block"))
        cells = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
        of = lambda c, k: own.select(F.col("c").alias(c), F.col("k").alias(k))
        grid = chosen.select("cx", "cy").join(of("cx", "kx"), "cx").join(of("cy", "ky"), "cy").withColumn("bx", cells("kx")).withColumn("by", cells("ky"))
        block = lambda c, b, w, n: some.select(F.col("c").alias(c), F.col("block").alias(b), F.col("w").alias(w), F.col("n").alias(n))
        met = grid.select("cx", "cy", "bx", "by").join(block("cx", "bx", "x", "nx"), ["cx", "bx"]).join(block("cy", "by", "y", "ny"), ["cy", "by"])
        return met.filter(apart).groupBy("cx", "cy").agg(F.sum(F.col("nx") * F.col("ny")).alias("n"))

    left = lambda: pairs.filter("o is not null")
    while not left().isEmpty():
        total = pairs.count()
        if rounds == check:
            check = 4 * check + 4
            found = connected(left().select(F.col("cx").alias("node")).union(left().select("cy")).distinct(), left().select(F.col("cx").alias("a"), F.col("cy").alias("b")))
            by_part = lookup(members, found.select(F.col("node").alias("c"), "component"), ["c"], "inner").groupBy("component", "profile").agg(F.first("w").alias("w"))
            by_part = steps.keep("profiles", by_part)
            few = by_part.groupBy("component").agg(F.count("*").alias("k")).filter(F.col("k") <= free)
            some = by_part.join(few, "component").select("component", "profile", "w")
            # no more than the few profiles of a component meet
            mixed = some.select("component", F.col("profile").alias("px"), F.col("w").alias("x")).join(some.select("component", F.col("profile").alias("py"), F.col("w").alias("y")), "component")
            mixed = mixed.filter((F.col("px") <= F.col("py")) & apart).select("component").distinct()
            gone = steps.keep("gone", found.join(few.select("component").join(mixed, "component", "left_anti"), "component", "left_semi"))
            if not gone.isEmpty():
                hooks.append(steps.keep(f"hook{len(hooks)}", gone.filter("node <> component").select(F.col("node").alias("u"), F.col("component").alias("p"))))
                pairs = steps.keep("relations", lookup(pairs, gone.select(F.col("node").alias("cx")), ["cx"], "left_anti"))
                rounds += 1
                continue
        rounds += 1
        # every edge from both of its ends: the first of each end, and the first behind that
        ways = left().select(F.explode(F.array(F.struct(F.col("cx").alias("u"), F.col("cy").alias("v")), F.struct(F.col("cy").alias("u"), F.col("cx").alias("v")))).alias("e"), "o").select("e.u", "e.v", "o")
        ways = ways if total <= HOT_ROWS else steps.keep("ways", ways)
        first = ways.groupBy("u").agg(F.min("o").alias("f"))
        first = steps.keep("first", first)
        of = lambda c, f: first.select(F.col("u").alias(c), F.col("f").alias(f))
        met = lookup(lookup(ways, of("u", "fu"), ["u"], "inner", total=total), of("v", "fv"), ["v"], "inner", total=total)
        met = met if total <= HOT_ROWS else steps.keep("met", met)
        second = met.filter("o > fu").groupBy("u").agg(F.min("o").alias("next"))
        # a hub is the smaller end of an edge that is the first of both; it may take the clusters whose first edge leads to it, up to an edge of its own that is not the first
        # of its other end, and up to the second edge of a cluster that it takes
        hubs = met.filter("o = fu and o = fv and u < v").select("u")
        bound = met.filter("o < fv or o > fv").groupBy("u").agg(F.min("o").alias("bound"))
        suit = met.join(hubs, "u", "left_semi").filter("o = fv").select("u", "v", "o").join(bound, "u", "left").filter("bound is null or o < bound").drop("bound")
        suit = suit.join(second.select(F.col("u").alias("v"), "next"), "v", "left")
        line = Window.partitionBy("u").orderBy("o")
        suit = suit.withColumn("k", F.row_number().over(line)).filter(F.col("k") <= SUITORS)
        suit = suit.withColumn("stop", F.min("next").over(line.rowsBetween(Window.unboundedPreceding, -1))).filter("stop is null or o < stop")
        chosen = steps.keep("chosen", suit.select(F.least("u", "v").alias("cx"), F.greatest("u", "v").alias("cy"), F.col("u").alias("hub"), "v", "k"))
        direct = pairs.select("cx", "cy", "direct")
        judged = chosen.join(direct, ["cx", "cy"]).join(conflicts(chosen), ["cx", "cy"], "left")
        judged = steps.keep(f"judged{rounds}", judged.select("cx", "cy", "hub", "v", "k", (F.coalesce("n", F.lit(0)) > F.col("direct")).alias("against")))
        # of those that the hub itself doesn't exclude, all before the first that may not be with one before it
        fine = judged.filter("not against").select("hub", F.col("v").alias("c"), "k")
        seen = fine.join(members, "c").groupBy("hub", "profile").agg(F.min("k").alias("k"), F.first("w").alias("w"), F.count("*").alias("n"))
        one, two = seen.select("hub", F.col("k").alias("kx"), F.col("w").alias("x"), F.col("profile").alias("px"), "n"), seen.select("hub", F.col("k").alias("ky"), F.col("w").alias("y"), F.col("profile").alias("py"))
        clash = one.join(two, "hub").filter((F.col("kx") <= F.col("ky")) & ((F.col("px") != F.col("py")) | (F.col("n") > 1)) & apart)
        cut = clash.groupBy("hub").agg(F.min("ky").alias("cut"))
        least = fine.groupBy("hub").agg(F.min("k").alias("least"))
        taken = fine.join(cut, "hub", "left").join(least, "hub").filter("k = least or cut is null or k < cut")
        # the hub and what it takes go by their smallest name
        group = taken.select("hub", "c").union(taken.select("hub", F.col("hub").alias("c"))).distinct()
        group = group.join(group.groupBy("hub").agg(F.min("c").alias("p")), "hub")
        hook = steps.keep(f"hook{len(hooks)}", group.filter("c <> p").select(F.col("c").alias("u"), "p"))
        hooks.append(hook)
        marked = pairs.join(judged.select("cx", "cy", "against"), ["cx", "cy"], "left").withColumn("veto", F.col("veto") | F.coalesce("against", F.lit(False))).drop("against")
        moved = contracted("marked", marked, total, hook, "cx", "cy").select(F.least("cx", "cy").alias("cx"), F.greatest("cx", "cy").alias("cy"), "o", "veto", "direct").filter("cx <> cy")
        merged = moved.groupBy("cx", "cy").agg(F.min("o").alias("o"), F.bool_or("veto").alias("veto"), F.sum("direct").alias("direct"))
        pairs = steps.keep("relations", merged.withColumn("o", F.when(~F.col("veto"), F.col("o"))))
        members = steps.keep("members", contracted("moved", members, size, hook, "c").groupBy("c", "profile").agg(F.first("w").alias("w"), F.sum("n").alias("n")))
    out = known.select("node", F.col("node").alias("cluster"))
    if hooks:
        every = hooks[0]
        for hook in hooks[1:]:
            every = every.unionByName(hook)
        out = out.join(rooted(steps, every).toDF("node", "to"), "node", "left").select("node", F.coalesce("to", "node").alias("cluster"))
    return steps.last(out)


def rooted(steps: Steps, hooks: DataFrame) -> DataFrame:
    """(u, p): each u of the hooks (u, p), a forest, with the root that its hooks lead to, by doubling."""
    to = steps.keep("to", hooks.select("u", "p"))
    while True:
        far = steps.keep("far", lookup(to.withColumnRenamed("p", "k"), to.select(F.col("u").alias("k"), F.col("p").alias("q")), ["k"]))
        if far.filter("q is not null").isEmpty():
            return to
        to = steps.keep("to", far.select("u", F.coalesce("q", "k").alias("p")))


def split_mentions(mentions: DataFrame, key: list[str]) -> DataFrame:
    """(mention, part): the mentions of a name key fall into parts that share a firm token or a group; a mention without firm tokens
    belongs with all of its key. mentions: mention, the key's columns, tokens, grp; read more than once, so it should be a kept table. No mention shares a null.

    As parts lie within a key, keys of at most WHOLE mentions are done where their mentions meet, in one shuffle. The mentions of larger ones are linked as a graph."""
    large = mentions.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > WHOLE).dropna(subset=key)
    large = checkpointed(large)
    if large.isEmpty():
        return split_in_tasks(mentions, key)
    few = large.select(*key)
    return split_in_tasks(lookup(mentions, few, key, "left_anti"), key).unionByName(split_as_graph(lookup(mentions, few, key, "left_semi"), key))


def split_in_tasks(mentions: DataFrame, key: list[str]) -> DataFrame:
    """The parts of keys whose mentions a task can hold, key by key."""

    def parts(ids: list, tokens: list, grps: list) -> list:
        if any(t is not None and not len(t) for t in tokens):
            return [ids[0]] * len(ids)
        up, first = list(range(len(ids))), {}

        def root(k: int) -> int:
            while up[k] != k:
                up[k] = k = up[up[k]]
            return k

        for k, (some, grp) in enumerate(zip(tokens, grps, strict=True)):
            for link in [*((0, t) for t in some or () if t is not None), *([(1, grp)] if grp is not None else [])]:
                x, y = root(first.setdefault(link, k)), root(k)
                up[max(x, y)] = min(x, y)
        # mentions come in order, so that a part's least one is its root
        return [ids[root(k)] for k in range(len(ids))]

    def run(batches):
        import pyarrow as pa

        held, ids, tokens, grps = None, [], [], []
        for batch in batches:
            out_ids, out_parts = [], []
            values = [c.to_pylist() for c in batch.columns]
            for mention, some, grp, *now in zip(*values, strict=True):
                if None in now or now != held and not (held and all(x == y or x != x and y != y for x, y in zip(now, held, strict=True))):
                    out_ids += ids
                    out_parts += parts(ids, tokens, grps) if len(ids) > 1 else ids
                    held, ids, tokens, grps = now, [], [], []
                ids.append(mention)
                tokens.append(some)
                grps.append(grp)
            yield pa.RecordBatch.from_arrays([pa.array(out_ids, pa.int64()), pa.array(out_parts, pa.int64())], names=["mention", "part"])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts(ids, tokens, grps) if len(ids) > 1 else ids, pa.int64())], names=["mention", "part"])

    tasks = enough(mentions, mentions.count())
    rows = mentions.select("mention", "tokens", "grp", *key)
    rows = rows.repartition(tasks, *key) if tasks else rows.repartition(*key)
    return rows.sortWithinPartitions(*key, "mention").mapInArrow(run, "mention long, part long")


def split_as_graph(mentions: DataFrame, key: list[str]) -> DataFrame:
    """Instead of pairs, mentions are linked with a hub of their key and token, key and group, or of the whole key."""
    hub = lambda kind, *c: -1 - F.abs(F.xxhash64(F.lit(kind), *key, *c) % (1 << 62))
    lone = mentions.filter(F.size("tokens") == 0).select(*key).distinct().withColumn("__lone", F.lit(True))
    rows = mentions.join(lone, key, "left")
    by_token = rows.select("mention", F.explode("tokens").alias("__t"), *key).select(F.col("mention").alias("a"), hub("token", "__t").alias("b"))
    by_group = rows.filter("grp is not null").select(F.col("mention").alias("a"), hub("group", "grp").alias("b"))
    whole = rows.filter("__lone").select(F.col("mention").alias("a"), hub("key").alias("b"))
    edges = by_token.union(by_group).union(whole).distinct()
    nodes = mentions.select(F.col("mention").alias("node")).union(edges.select("b")).distinct()
    found = connected(nodes, edges).filter("node >= 0")
    first = found.groupBy("component").agg(F.min("node").alias("part"))
    return found.join(first, "component").select(F.col("node").alias("mention"), "part")


def first_come(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, seed): in order of node, each node that no earlier seed is linked with becomes a seed; others go to the first seed that they are linked with. links:
    (a, b) with a < b.

    In each round, the nodes that have only later ones left to meet are seeds, and what is linked with them is not and goes with its links. So the seeds are the
    sequential rule's, and no group of nodes meets in one task."""
    steps = Steps(nodes.sparkSession)
    every = steps.keep("every", links.select("a", "b").filter("a < b").distinct())
    left, taken, rounds = every, None, 0
    while not left.isEmpty():
        later = left.select(F.col("b").alias("a")).distinct()
        seeds = steps.keep("seeds", left.select("a").distinct().join(later, "a", "left_anti"))
        gone = steps.keep(f"gone{rounds}", lookup(left, seeds, ["a"], "left_semi").select("b").distinct())
        taken = gone if taken is None else taken.unionByName(gone)
        rest = steps.keep("half", lookup(left, gone, ["b"], "left_anti"))
        left = steps.keep("left", lookup(rest, gone.withColumnRenamed("b", "a"), ["a"], "left_anti"))
        rounds += 1
    seed = nodes.select("node", F.col("node").alias("seed"))
    if taken is not None:
        taken = steps.keep("taken", taken.distinct())
        of_seeds = lookup(every, taken.withColumnRenamed("b", "a"), ["a"], "left_anti")
        to = of_seeds.groupBy("b").agg(F.min("a").alias("to"))
        seed = seed.join(to.withColumnRenamed("b", "node"), "node", "left").select("node", F.coalesce("to", "seed").alias("seed"))
    return steps.last(seed)


def greedy_seeds(df: DataFrame, key: str, group: str, tokens: str, least: float = 0.6) -> DataFrame:
    """(grp, key, seed): within a group, in order of key, each row not taken seeds a cluster with the later free rows whose token overlap
    is at least `least`; rows without tokens stand alone. Keys are unique over all groups."""
    links = similar_sets(df, key, tokens, least, "overlap", group)
    found = first_come(df.select(F.col(key).alias("node")), links)
    return df.select(F.col(group).alias("grp"), F.col(key).alias("key")).join(found.toDF("key", "seed"), "key").select("grp", "key", "seed")


def greedy_match(edges: DataFrame) -> DataFrame:
    """One-to-one matches (grp, a, b) taken from candidate edges (grp, a, b, score) by descending score, then a, then b.

    Nobody takes the edges one by one: in each round all edges that are the first of both their ends are matched, and the edges of these
    ends go. An edge is first of both ends exactly if the sequential rule takes it before any edge that could prevent it, so the matches
    are the same. A round has as many tasks as the edges that are left need."""
    ends = lambda df, n, c: dealt(df, n, "grp", c)
    left = checkpointed(edges.select("grp", "a", "b", (-F.col("score")).alias("s")))
    first = F.min(F.struct("s", "a", "b"))
    done = left.select("grp", "a", "b").limit(0)
    while count := left.count():
        n = enough(left, count)
        of_a = ends(left, n, "a").groupBy("grp", "a").agg(first.alias("e")).select("grp", "e.a", "e.b")
        of_b = ends(left, n, "b").groupBy("grp", "b").agg(first.alias("e")).select("grp", "e.a", "e.b")
        best = checkpointed(of_a.join(of_b, ["grp", "a", "b"]))
        rest = ends(left, n, "a").join(best.select("grp", "a"), ["grp", "a"], "left_anti")
        left = checkpointed(ends(rest, n, "b").join(best.select("grp", "b"), ["grp", "b"], "left_anti").select("grp", "a", "b", "s"))
        done = done.unionByName(best)
    return done


def roster(mentions: DataFrame, cluster: str, name: str) -> DataFrame:
    """One row per cluster: canonical name (by frequency, length, name), up to three others, mentions, and a dense id by weight."""
    counts = mentions.groupBy(cluster, name).agg(F.count("*").alias("n"))
    order = Window.partitionBy(cluster).orderBy(F.desc("n"), F.desc(F.length(name)), F.desc(name))
    ranked = counts.withColumn("rk", F.row_number().over(order))
    rows = ranked.groupBy(cluster).agg(F.max(F.when(F.col("rk") == 1, F.col(name))).alias("canonical"), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("rk").between(2, 4), F.struct("rk", name)))), lambda x: x[name]), "; ").alias("aka"), F.sum("n").alias("mentions"), F.count("*").alias("variants"))
    return row_numbers(rows, "__no", F.desc("mentions"), F.col(cluster)).withColumn("id", F.concat(F.lit("A"), F.lpad(F.col("__no").cast("string"), 4, "0"))).drop("__no")
