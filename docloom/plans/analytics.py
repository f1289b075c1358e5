"""Network, cohort, aggregate, window, sort and set queries over the star schema. Group: order; actor: supplier; time: order date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators import network as net
from docloom.operators.ranks import medians, row_numbers, top_list
from docloom.registry import query
from docloom.sources.shared import Steps

PAIRS = "SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) AS cnt FROM s a JOIN s b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2"
SLATE = "s AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), p AS (" + PAIRS + ")"


def slate(t) -> DataFrame:
    return net.members(t.lineitem, "l_orderkey", "l_suppkey")


@query("a18_j18_a13_pair_hist", f"WITH {SLATE}, h AS (SELECT cnt, count(*) AS n FROM p GROUP BY 1) SELECT r.i AS cnt, coalesce(n, 0) AS n FROM (SELECT unnest(range(1, (SELECT max(cnt) FROM h) + 1)) AS i) r LEFT JOIN h ON h.cnt = r.i")
def pair_hist(t):
    return net.filled_histogram(net.pair_counts(slate(t)), "cnt")


@query("a18_m09_pairs_never_met", f"WITH {SLATE}, n AS (SELECT count(DISTINCT l_suppkey) AS n FROM s) SELECT n AS actors, (SELECT count(*) FROM p) AS met, CAST(n * (n - 1) // 2 AS BIGINT) - (SELECT count(*) FROM p) AS never FROM n")
def never_met(t):
    """Pairs of suppliers that share no order: all pairs less those that met, which come from orders alone."""
    s = slate(t)
    met = net.pair_counts(s).agg(F.count("*").alias("met"))
    return s.agg(F.count_distinct("m").alias("actors")).join(F.broadcast(met)).select("actors", "met", (F.expr("actors * (actors - 1) div 2") - F.col("met")).alias("never"))


@query("o03_top_pairs", f"WITH {SLATE} SELECT a, b, cnt FROM p ORDER BY cnt DESC, a, b LIMIT 20")
def top_pairs(t):
    return net.pair_counts(slate(t)).orderBy(F.desc("cnt"), "a", "b").limit(20)


@query("u07_g08_top_matrix", f"WITH {SLATE}, q AS (SELECT a, b, cnt FROM p ORDER BY cnt DESC, a, b LIMIT 20) SELECT a, b, cnt FROM q UNION ALL SELECT b, a, cnt FROM q")
def top_matrix(t):
    return net.symmetric(top_pairs(t))


@query("a19_o04_one_off_share", f"WITH {SLATE}, d AS (SELECT l_suppkey AS m, count(DISTINCT l_orderkey) AS groups FROM s GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20), x AS (SELECT a AS m, cnt FROM p UNION ALL SELECT b, cnt FROM p) SELECT d.m, groups, avg(CASE WHEN cnt = 1 THEN 1.0 ELSE 0.0 END) AS once FROM d JOIN x USING (m) GROUP BY 1, 2")
def one_off(t):
    s = slate(t)
    top = s.groupBy("m").agg(F.count_distinct("g").alias("groups")).orderBy(F.desc("groups"), "m").limit(20)
    partners = net.symmetric(net.pair_counts(s)).withColumnRenamed("a", "m")
    return partners.join(F.broadcast(top), "m").groupBy("m", "groups").agg(F.avg(F.when(F.col("cnt") == 1, 1.0).otherwise(0.0)).alias("once"))


@query("a20_additional", f"WITH {SLATE} SELECT CAST(sum(greatest(cnt - 1, 0)) AS BIGINT) AS stat FROM p")
def additional(t):
    return net.additional(slate(t))


@query("g06_m11_permutation_null")
def null(t):
    """A thousand shuffles of all suppliers over all orders: how often pairs meet again, and how often by chance as often as in fact."""
    steps = Steps(t.spark)
    s = steps.keep("slate", slate(t))
    shuffles = net.permuted(s, 1_000)
    observed = steps.last(net.additional(s).withColumnRenamed("stat", "observed"))
    return shuffles.join(F.broadcast(observed)).agg(F.first("observed").alias("observed"), F.avg("stat").alias("null_mean"), F.avg((F.col("stat") >= F.col("observed")).cast("double")).alias("p"))


@query("g07_cycling", "WITH r AS (SELECT l_orderkey AS g, l_suppkey AS m, bool_or(l_linenumber = 1) AS lead FROM lineitem GROUP BY 1, 2), p AS (SELECT a.m AS a, b.m AS b, bool_or(a.lead AND NOT b.lead) AS x, bool_or(b.lead AND NOT a.lead) AS y FROM r a JOIN r b ON a.g = b.g AND a.m < b.m GROUP BY 1, 2) SELECT count(*) AS pairs, sum(CASE WHEN x AND y THEN 1 ELSE 0 END)::BIGINT AS cycling, avg(CASE WHEN x AND y THEN 1.0 ELSE 0.0 END) AS rate FROM p")
def cycling(t):
    line = t.lineitem.select("l_orderkey", "l_suppkey", "l_linenumber")
    ranked = net.dealt(line, net.enough(line, line.count()), "l_orderkey", "l_suppkey").groupBy("l_orderkey", "l_suppkey").agg(F.bool_or(F.col("l_linenumber") == 1).alias("lead"))
    return net.cycling(ranked, "l_orderkey", "l_suppkey", "lead").agg(F.count("*").alias("pairs"), F.count_if("cycles").alias("cycling"), F.avg(F.when(F.col("cycles"), 1.0).otherwise(0.0)).alias("rate"))


@query("a16_d03_a10_a36_entrants", "WITH f AS (SELECT o_custkey, year(o_orderdate) AS y, min(year(o_orderdate)) OVER (PARTITION BY o_custkey) AS f FROM orders) SELECT y, count(DISTINCT o_custkey) AS total, count(DISTINCT CASE WHEN y = f THEN o_custkey END) AS first_timers, count(DISTINCT CASE WHEN y = f THEN o_custkey END) / count(DISTINCT o_custkey) AS ratio FROM f GROUP BY y")
def entrants(t):
    y = t.orders.select("o_custkey", F.year("o_orderdate").alias("y")).distinct()
    first = y.withColumn("f", F.min("y").over(Window.partitionBy("o_custkey")))
    out = first.groupBy("y").agg(F.count("*").alias("total"), F.count_if(F.col("y") == F.col("f")).alias("first_timers"))
    return out.withColumn("ratio", F.col("first_timers") / F.col("total"))


@query("w05_d07_rolling_entrants", "WITH a AS (SELECT DISTINCT o_custkey AS c, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders), n AS (SELECT y, count(*) OVER (PARTITION BY c ORDER BY y RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING) = 0 AS is_new FROM a) SELECT y, count(*) AS active, count(*) FILTER (is_new) AS entered FROM n WHERE y >= (SELECT min(y) + 3 FROM a) GROUP BY y")
def rolling(t):
    active = t.orders.select(F.col("o_custkey").alias("c"), F.year("o_orderdate").alias("y")).distinct()
    first = active.agg((F.min("y") + 3).alias("from"))
    marked = net.new_after_absence(active, "c", "y").join(F.broadcast(first)).filter("y >= from")
    return marked.groupBy("y").agg(F.count("*").alias("active"), F.count_if("is_new").alias("entered"))


@query("a11_f16_j04_entry_share", "WITH f AS (SELECT o_orderpriority, o_orderdate = min(o_orderdate) OVER (PARTITION BY o_custkey) AS first FROM orders) SELECT o_orderpriority, count(*) AS n, count(*) FILTER (first) AS first_n, count(*) FILTER (first) / count(*) AS share FROM f GROUP BY 1 HAVING count(*) >= 10")
def entry_share(t):
    first = F.col("o_orderdate") == F.min("o_orderdate").over(Window.partitionBy("o_custkey"))
    out = t.orders.withColumn("first", first).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if("first").alias("first_n")).filter("n >= 10")
    return out.withColumn("share", F.col("first_n") / F.col("n"))


@query("a26_capacity_check", "WITH s AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) SELECT (SELECT CAST(sum(c) AS BIGINT) FROM (SELECT count(*) AS c FROM s GROUP BY l_suppkey)) AS capacity, (SELECT CAST(sum(c) AS BIGINT) FROM (SELECT count(*) AS c FROM s GROUP BY l_orderkey)) AS places")
def capacity(t):
    s = slate(t)
    places = s.groupBy("g").count().agg(F.sum("count").alias("places"))
    return s.groupBy("m").count().agg(F.sum("count").alias("capacity")).join(F.broadcast(places))


@query("a35_scopes", "WITH o AS (SELECT *, CASE WHEN year(o_orderdate) < 1997 THEN 'old' ELSE 'new' END AS scope FROM orders), e AS (SELECT scope, o_custkey, o_totalprice FROM o UNION ALL SELECT 'both', o_custkey, o_totalprice FROM o) SELECT scope, count(*) AS n, count(DISTINCT o_custkey) AS customers, avg(o_totalprice) AS mean FROM e GROUP BY 1")
def scopes(t):
    scope = F.when(F.year("o_orderdate") < 1997, "old").otherwise("new")
    e = t.orders.select(F.explode(F.array(scope, F.lit("both"))).alias("scope"), "o_custkey", "o_totalprice")
    return e.groupBy("scope").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"), F.avg("o_totalprice").alias("mean"))


@query("a01_a02_scan_summary", "SELECT count(*) AS files, count(*) FILTER (n_chars > 0) AS readable, count(*) FILTER (n_chars <= 0) AS failed, CAST(sum(n_chars) AS BIGINT) AS total, avg(n_chars) AS mean FROM documents")
def summary(t):
    return t.documents.agg(F.count("*").alias("files"), F.count_if(F.col("n_chars") > 0).alias("readable"), F.count_if(F.col("n_chars") <= 0).alias("failed"), F.sum("n_chars").alias("total"), F.avg("n_chars").alias("mean"))


@query("a04_j03_stable_mode", "WITH c AS (SELECT l_partkey, l_suppkey, count(*) AS cnt FROM lineitem GROUP BY 1, 2) SELECT l_partkey, l_suppkey, cnt FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY cnt DESC, l_suppkey) AS rk FROM c) WHERE rk = 1")
def stable_mode(t):
    return net.ranked_mode(t.lineitem, ["l_partkey"], "l_suppkey")


@query("a05_canonical_label", "WITH c AS (SELECT p_brand, p_name, count(*) AS cnt FROM part GROUP BY 1, 2) SELECT p_brand, p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY cnt DESC, length(p_name) DESC, p_name DESC) AS rk FROM c) WHERE rk = 1")
def canonical(t):
    c = t.part.groupBy("p_brand", "p_name").agg(F.count("*").alias("cnt"))
    return c.groupBy("p_brand").agg(F.max_by("p_name", F.struct("cnt", F.length("p_name"), "p_name")).alias("p_name"))


@query("a03_a06_o06_top3", "WITH c AS (SELECT p_brand, p_type, count(*) AS cnt FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY cnt DESC, p_type) AS rk FROM c) SELECT p_brand, string_agg(p_type || ':' || cnt, '; ' ORDER BY rk) AS top FROM r WHERE rk <= 3 GROUP BY 1")
def top3(t):
    c = t.part.groupBy("p_brand", "p_type").agg(F.count("*").alias("cnt"))
    top = top_list(c, ["p_brand"], 3, F.concat("p_type", F.lit(":"), F.col("cnt").cast("string")), F.desc("cnt"), "p_type")
    return top.select("p_brand", F.array_join("top", "; ").alias("top"))


@query("a07_r02_p32_uniq_list", "SELECT p_brand, string_agg(DISTINCT p_type, '; ' ORDER BY p_type) AS types FROM part GROUP BY 1")
def uniq_list(t):
    return t.part.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), "; ").alias("types"))


@query("a08_f11_collapse", "SELECT l_suppkey, l_orderkey, count(*) AS n, sum(l_quantity) AS qty, max(l_discount) AS disc, bool_or(l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1, 2 HAVING bool_or(l_returnflag = 'R')")
def collapse(t):
    out = t.lineitem.groupBy("l_suppkey", "l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"), F.max("l_discount").alias("disc"), F.bool_or(F.col("l_returnflag") == "R").alias("returned"))
    return out.filter("returned")


@query("a12_p37_r03_freq", "SELECT w AS word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1")
def freq(t):
    return t.part.select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("a14_hist_bins", "WITH m AS (SELECT min(c_acctbal) AS lo, (max(c_acctbal) - min(c_acctbal)) / 20 AS w FROM customer) SELECT CAST(least(floor((c_acctbal - lo) / w), 19) AS INTEGER) AS bin, count(*) AS n FROM customer, m GROUP BY 1")
def bins(t):
    m = t.customer.agg(F.min("c_acctbal").alias("lo"), ((F.max("c_acctbal") - F.min("c_acctbal")) / 20).alias("w"))
    b = F.least(F.floor((F.col("c_acctbal") - F.col("lo")) / F.col("w")), F.lit(19)).cast("int")
    return t.customer.join(F.broadcast(m)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


@query("a15_d04_mean_median", "SELECT c_mktsegment, avg(c_acctbal) AS mean, median(c_acctbal) AS mid FROM customer GROUP BY 1")
def mean_median(t):
    mid = medians(t.customer, ["c_mktsegment"], "c_acctbal", "mid")
    return t.customer.groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("mean")).join(mid, "c_mktsegment")


@query("a17_share_pct", "SELECT c_mktsegment, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER () AS pct FROM customer GROUP BY 1")
def share(t):
    n = t.customer.groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    return n.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))


@query("a30_document_frequency", "SELECT w AS word, count(DISTINCT p_partkey) AS df FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1")
def doc_freq(t):
    return t.part.select("p_partkey", F.explode(F.array_distinct(F.split("p_name", " "))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))


@query("a31_nested_counts", "WITH l AS (SELECT l_orderkey, count(*) AS c FROM lineitem GROUP BY 1), o AS (SELECT o_custkey, count(*) AS orders, sum(c) AS lines FROM orders JOIN l ON o_orderkey = l_orderkey GROUP BY 1) SELECT avg(orders) AS orders_per, median(orders) AS orders_mid, avg(lines) AS lines_per FROM o")
def nested(t):
    l = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("c"))
    o = t.orders.join(l, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum("c").alias("lines"))
    return o.agg(F.avg("orders").alias("orders_per"), F.avg("lines").alias("lines_per")).join(medians(o, [], "orders", "orders_mid")).select("orders_per", "orders_mid", "lines_per")


@query("a33_scoped_cost", "SELECT count(*) AS n, count(*) * 0.0125 AS cost FROM orders WHERE o_orderstatus = 'F' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def scoped_cost(t):
    who = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.filter("o_orderstatus = 'F'").join(who, "o_custkey", "left_semi").agg(F.count("*").alias("n"), (F.count("*") * F.lit(0.0125).cast("double")).alias("cost"))


@query("a29_estimate", "SELECT p_type, CAST(sum(ceil(length(p_name) / 4.0)) AS DOUBLE) AS tokens, CAST(sum(ceil(length(p_name) / 4.0)) AS DOUBLE) * 1.25 / 1000000 AS cost FROM part GROUP BY 1")
def estimate(t):
    tokens = F.sum(F.ceil(F.length("p_name") / 4.0)).cast("double")
    return t.part.groupBy("p_type").agg(tokens.alias("tokens"), (tokens * 1.25 / 1000000).alias("cost"))


@query("a37_w09_first_value", "SELECT l_orderkey, arg_min(l_suppkey, (l_linenumber, l_suppkey)) AS supp FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1")
def first_value(t):
    return t.lineitem.filter("l_returnflag <> 'N'").groupBy("l_orderkey").agg(F.min_by("l_suppkey", F.struct("l_linenumber", "l_suppkey")).alias("supp"))


@query("a25_cluster_pairs", "WITH x AS (SELECT c_mktsegment AS a, c_nationkey AS b, count(*) AS n FROM customer GROUP BY 1, 2), r AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM x) AS tp, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM x GROUP BY a)) AS pa, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM x GROUP BY b)) AS pb) SELECT tp / pa AS precision, tp / pb AS recall, 2 * tp / (pa + pb) AS f1 FROM r")
def cluster_pairs(t):
    pairs = F.sum(F.col("n") * (F.col("n") - 1) / 2)
    x = t.customer.groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"))
    by = lambda c, name: x.groupBy(c).agg(F.sum("n").alias("n")).agg(pairs.alias(name))
    r = x.agg(pairs.alias("tp")).join(F.broadcast(by("c_mktsegment", "pa"))).join(F.broadcast(by("c_nationkey", "pb")))
    return r.select((F.col("tp") / F.col("pa")).alias("precision"), (F.col("tp") / F.col("pb")).alias("recall"), (2 * F.col("tp") / (F.col("pa") + F.col("pb"))).alias("f1"))


@query("w01_keep_first", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS rk FROM orders) WHERE rk = 1")
def keep_first(t):
    w = Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderdate", "o_orderkey")
    return t.orders.withColumn("rk", F.row_number().over(w)).filter("rk = 1").select("o_custkey", "o_orderkey")


@query("w02_dense_ids", "WITH w AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT o_custkey, n, 'A' || lpad(CAST(row_number() OVER (ORDER BY n DESC, o_custkey) AS VARCHAR), 6, '0') AS id FROM w")
def dense_ids(t):
    w = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    return row_numbers(w, "no", F.desc("n"), F.col("o_custkey")).withColumn("id", F.concat(F.lit("A"), F.lpad(F.col("no").cast("string"), 6, "0"))).drop("no")


@query("w03_r08_positions", "SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey) AS pos FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)")
def positions(t):
    nested = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("s"))
    return nested.select("l_orderkey", F.posexplode("s").alias("p", "l_suppkey")).select("l_orderkey", "l_suppkey", (F.col("p") + 1).alias("pos"))


@query("w04_average_rank", "SELECT p_partkey, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2 AS avg_rank FROM part")
def average_rank(t):
    from docloom.operators.ranks import average_ranks

    return average_ranks(t.part, "p_retailprice").select("p_partkey", "avg_rank")


@query("w08_last_wins", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last FROM orders GROUP BY 1")
def last_wins(t):
    return t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last"))


@query("w10_first_wins", "SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first FROM orders GROUP BY 1")
def first_wins(t):
    return t.orders.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first"))


@query("o01_o10_sorted_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem ORDER BY 1, 2")
def sorted_distinct(t):
    return t.lineitem.select("l_returnflag", "l_linestatus").distinct().orderBy("l_returnflag", "l_linestatus")


@query("o02_numeric_string_sort", "SELECT CAST(o_custkey AS VARCHAR) AS k, row_number() OVER (ORDER BY length(CAST(o_custkey AS VARCHAR)), CAST(o_custkey AS VARCHAR)) AS pos FROM (SELECT DISTINCT o_custkey FROM orders)")
def numeric_sort(t):
    k = t.orders.select(F.col("o_custkey").cast("string").alias("k")).distinct()
    return row_numbers(k, "pos", F.length("k"), F.col("k"))


@query("o05_top_ratio", "SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') / count(*) AS ratio FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_ratio(t):
    r = t.lineitem.groupBy("l_suppkey").agg((F.count_if(F.col("l_returnflag") == "R") / F.count("*")).alias("ratio"))
    return r.orderBy(F.desc("ratio"), "l_suppkey").limit(10)


@query("o07_argmax_first", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rk FROM orders) WHERE rk = 1")
def argmax(t):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t.orders.withColumn("rk", F.row_number().over(w)).filter("rk = 1").select("o_custkey", "o_orderkey", "o_totalprice")


@query("o08_seeded_sample", "SELECT c_custkey, c_name FROM customer ORDER BY md5('42,' || c_custkey), c_custkey LIMIT 100")
def sample(t):
    """The rows of least hash, the same on every engine that knows MD5."""
    mark = F.md5(F.concat_ws(",", F.lit(42), "c_custkey").cast("binary"))
    return t.customer.orderBy(mark, "c_custkey").limit(100).select("c_custkey", "c_name")


@query("o09_batches", "SELECT (row_number() OVER (ORDER BY c_custkey) - 1) // 14 AS batch, c_custkey FROM customer")
def batches(t):
    return row_numbers(t.customer.select("c_custkey"), "no", F.col("c_custkey")).select(F.floor((F.col("no") - 1) / 14).alias("batch"), "c_custkey")


@query("u01_p03_p38_union_align", "SELECT c_name AS name, c_mktsegment AS segment, 'customer' AS unit FROM customer UNION ALL SELECT s_name, NULL, 'supplier' FROM supplier")
def union_align(t):
    c = t.customer.select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.lit("customer").alias("unit"))
    return c.unionByName(t.supplier.select(F.col("s_name").alias("name"), F.lit("supplier").alias("unit")), allowMissingColumns=True)


@query("u03_union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("u04_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).intersect(t.supplier.select("s_nationkey"))


@query("u05_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def except_(t):
    return t.customer.select(F.col("c_custkey").alias("k")).join(t.orders.select(F.col("o_custkey").alias("k")), "k", "left_anti").distinct()


@query("u06_membership", "SELECT o_custkey, CASE WHEN bool_or(year(o_orderdate) < 1997) AND bool_or(year(o_orderdate) >= 1997) THEN 'both' WHEN bool_or(year(o_orderdate) < 1997) THEN 'old_only' ELSE 'new_only' END AS corpus FROM orders GROUP BY 1")
def membership(t):
    old = F.bool_or(F.year("o_orderdate") < 1997)
    new = F.bool_or(F.year("o_orderdate") >= 1997)
    return t.orders.groupBy("o_custkey").agg(F.when(old & new, "both").when(old, "old_only").otherwise("new_only").alias("corpus"))


@query("u02_u08_row_multiplication", "SELECT p_partkey AS id, 'part' AS kind, p_name AS name FROM part UNION ALL SELECT p_partkey, 'brand', p_brand FROM part")
def multiplied(t):
    both = F.array(F.struct(F.lit("part").alias("kind"), F.col("p_name").alias("name")), F.struct(F.lit("brand").alias("kind"), F.col("p_brand").alias("name")))
    return t.part.select(F.col("p_partkey").alias("id"), F.explode(both).alias("x")).select("id", "x.kind", "x.name")


@query("u09_decision_log", "SELECT o_orderkey AS k, 'rule' AS source, 'distinct' AS verdict FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_orderkey, 'batch', 'same' FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 'web', 'unsure' FROM orders WHERE o_orderstatus = 'O'")
def decision_log(t):
    part = lambda s, src, v: t.orders.filter(F.col("o_orderstatus") == s).select(F.col("o_orderkey").alias("k"), F.lit(src).alias("source"), F.lit(v).alias("verdict"))
    return part("P", "rule", "distinct").unionByName(part("F", "batch", "same")).unionByName(part("O", "web", "unsure"))
