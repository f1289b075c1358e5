"""Agreement, statistics and enrichment queries. Gold: labels or customers; ours: documents or orders."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import fuzzy as fz
from docloom.functions import stats
from docloom.operators import agree
from docloom.operators.ranks import average_ranks
from docloom.registry import query


@query("j11_a26_presence", "SELECT coalesce(c_custkey, o_custkey) AS k, CASE WHEN o_custkey IS NULL THEN 'gold_only' WHEN c_custkey IS NULL THEN 'ours_only' ELSE 'both' END AS presence FROM (SELECT DISTINCT c_custkey FROM customer WHERE c_acctbal > 0) FULL JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F') ON c_custkey = o_custkey")
def presence(t):
    return agree.presence(t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("k")), t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")), ["k"])


@query("a23_m03_m10_j12_prf", "WITH g AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_acctbal > 0), o AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), n AS (SELECT (SELECT count(*) FROM g JOIN o USING (k)) AS matched, (SELECT count(*) FROM g) AS gold, (SELECT count(*) FROM o) AS ours), r AS (SELECT *, matched / ours AS precision, matched / gold AS recall FROM n) SELECT *, 2 * precision * recall / (precision + recall) AS f1, (recall + 3.8416 / (2 * gold) - 1.96 * sqrt(recall * (1 - recall) / gold + 3.8416 / (4 * gold * gold))) / (1 + 3.8416 / gold) AS low, (recall + 3.8416 / (2 * gold) + 1.96 * sqrt(recall * (1 - recall) / gold + 3.8416 / (4 * gold * gold))) / (1 + 3.8416 / gold) AS high FROM r")
def prf(t):
    return agree.precision_recall(presence(t))


@query("a21_confusion", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2")
def confusion(t):
    return t.labels.groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query("a22_field_agreement", "WITH j AS (SELECT lang AS gl, CASE WHEN text LIKE '% the %' THEN 'en' ELSE 'other' END AS ol, CAST(toxic AS VARCHAR) AS gt, CASE WHEN text LIKE '%idiot%' THEN '1' ELSE '0' END AS ot FROM documents JOIN labels USING (doc_id)) SELECT 'lang' AS field, count(*) FILTER (gl = ol) AS agree, count(*) AS total FROM j UNION ALL SELECT 'toxic', count(*) FILTER (gt = ot), count(*) FROM j")
def fields(t):
    j = t.documents.join(t.labels, "doc_id")
    text = F.col("text")
    return agree.field_agreement(j.select(F.col("lang").alias("gold_lang"), F.when(text.contains(" the "), "en").otherwise("other").alias("our_lang"), F.col("toxic").alias("gold_toxic"), F.when(text.contains("idiot"), 1).otherwise(0).alias("our_toxic")), ["lang", "toxic"])


ROLES = "g AS (SELECT l_orderkey AS k, list_sort(list_distinct(list(l_returnflag))) AS r FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY 1), o AS (SELECT l_orderkey AS k, list_sort(list_distinct(list(l_returnflag))) AS r FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1), j AS (SELECT k, g.r AS x, o.r AS y, len(list_intersect(g.r, o.r)) / len(list_distinct(list_concat(g.r, o.r))) AS jac FROM g JOIN o USING (k))"


def role_sets(t):
    """Odd lines of an order are one source's, even lines the other's; both sides come out of one grouping."""
    side = lambda n: F.array_sort(F.collect_set(F.when(F.col("l_linenumber") % 2 == n, F.col("l_returnflag"))))
    both = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(side(1).alias("x"), side(0).alias("y")).filter((F.size("x") > 0) & (F.size("y") > 0))
    return both.withColumn("jac", fz.jaccard(F.col("x"), F.col("y")))


@query("a09_a24_soft_agreement", f"WITH {ROLES} SELECT count(*) AS n, sum(jac) / count(*) AS soft, count(*) FILTER (jac = 1) AS exact FROM j")
def soft(t):
    return role_sets(t).agg(F.count("*").alias("n"), (F.sum("jac") / F.count("*")).alias("soft"), F.count_if(F.col("jac") == 1).alias("exact"))


#: Appointments of two sources: an order's odd lines are one source's, its even lines the other's.
ENTRIES = "a AS (SELECT CASE WHEN l_linenumber % 2 = 1 THEN 'gold' ELSE 'ours' END AS src, l_orderkey AS k, l_returnflag AS role, CASE WHEN l_quantity > 25 THEN 'Plaintiff' WHEN l_quantity > 5 THEN 'Defendant' ELSE '' END AS side, l_discount > 0.08 AS interim, l_linenumber AS n, l_partkey AS p FROM lineitem), e AS (SELECT src, k, list_sort(list_distinct(list(role))) AS roles, coalesce(arg_min(side, (n, p, side)) FILTER (side <> ''), '') AS side, bool_or(interim) AS interim FROM a GROUP BY 1, 2)"


def entries(t) -> DataFrame:
    """An entry per source and order: all roles, whether any line is interim, and the first side that a line has."""
    side = F.when(F.col("l_quantity") > 25, "Plaintiff").when(F.col("l_quantity") > 5, "Defendant").otherwise("")
    source = F.when(F.col("l_linenumber") % 2 == 1, "gold").otherwise("ours")
    a = t.lineitem.select(source.alias("src"), F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("role"), side.alias("side"), (F.col("l_discount") > 0.08).alias("interim"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"))
    return agree.entries(a, ["src", "k"], "role", "side", ["interim"], F.struct("n", "p", "side"))


@query("a09_entries", f"WITH {ENTRIES} SELECT src, k, array_to_string(roles, ',') AS roles, side, interim FROM e")
def entry_rows(t):
    return entries(t).select("src", "k", F.array_join("roles", ",").alias("roles"), "side", "interim")


@query("a24_soft_scores", f"WITH {ENTRIES}, m AS (SELECT g.k, len(list_intersect(g.roles, o.roles)) / len(list_distinct(list_concat(g.roles, o.roles))) AS j, CASE WHEN g.side <> '' THEN lower(g.side) = lower(o.side) END AS agrees, g.interim = o.interim AS same FROM e g JOIN e o ON g.src = 'gold' AND o.src = 'ours' AND g.k = o.k), n AS (SELECT count(*) AS matched, sum(j) AS soft, 100.0 * count(*) FILTER (agrees) / count(agrees) AS side_pct, 100.0 * count(*) FILTER (same) / count(*) AS interim_pct FROM m), c AS (SELECT count(*) FILTER (src = 'gold') AS gold, count(*) FILTER (src = 'ours') AS ours FROM e), r AS (SELECT *, round(soft / gold, 3) AS soft_recall, round(soft / ours, 3) AS soft_precision FROM n, c) SELECT matched, gold, ours, soft_recall, soft_precision, round(2 * soft_recall * soft_precision / (soft_recall + soft_precision), 3) AS soft_f1, round(side_pct, 1) AS side_pct, round(interim_pct, 1) AS interim_pct FROM r")
def soft_scores(t):
    """Recall, precision and F1 in which a match counts by how far its roles agree; and how often the sides and the interim flags of matches agree."""
    return agree.soft_scores(entries(t), "src", "gold", "ours", ["k"])


@query("a34_role_flags", f"WITH {ROLES} SELECT CASE WHEN jac = 1 THEN 'identical' WHEN jac >= 0.5 THEN 'partial' ELSE 'divergent' END AS flag, count(*) AS n FROM j GROUP BY 1")
def flags(t):
    return role_sets(t).groupBy(F.when(F.col("jac") == 1, "identical").when(F.col("jac") >= 0.5, "partial").otherwise("divergent").alias("flag")).agg(F.count("*").alias("n"))


@query("m05_chi_square", "WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY 1, 2), r AS (SELECT a, sum(n) AS r FROM c GROUP BY 1), k AS (SELECT b, sum(n) AS k FROM c GROUP BY 1), g AS (SELECT r.a, k.b, coalesce(n, 0) AS n, r * k / (SELECT sum(n) FROM c) AS e FROM r JOIN k ON true LEFT JOIN c ON c.a = r.a AND c.b = k.b) SELECT sum((n - e) * (n - e) / e) AS chi2, CAST((count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS BIGINT) AS df FROM g")
def chi_square(t):
    """The table's size is bounded by the two vocabularies; its cells alone come to the driver."""
    cells = t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n")).collect()
    a, b = sorted({r[0] for r in cells}), sorted({r[1] for r in cells})
    n = {(r[0], r[1]): r[2] for r in cells}
    x, df, _, _ = stats.chi2([[n.get((i, j), 0) for j in b] for i in a])
    return t.spark.createDataFrame([(x, df)], "chi2 double, df long")


@query("m04_m05_chi_square_p", "WITH c AS (SELECT l_linenumber AS t, l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT t, a, sum(n) AS r FROM c GROUP BY 1, 2), k AS (SELECT t, b, sum(n) AS k FROM c GROUP BY 1, 2), s AS (SELECT t, sum(n) AS s FROM c GROUP BY 1), g AS (SELECT r.t, coalesce(n, 0) AS n, r * k / s AS e FROM r JOIN k USING (t) JOIN s USING (t) LEFT JOIN c ON c.t = r.t AND c.a = r.a AND c.b = k.b) SELECT t AS line, round(exp(-sum((n - e) * (n - e) / e) / 2), 9) AS p FROM g GROUP BY 1")
def chi_square_p(t):
    """A test for each line number; three flags by two states have two degrees of freedom. Only the tables' cells come to the driver."""
    cells = t.lineitem.groupBy("l_linenumber", "l_returnflag", "l_linestatus").agg(F.count("*").alias("n")).collect()
    a, b = sorted({r[1] for r in cells}), sorted({r[2] for r in cells})
    n = {(r[0], r[1], r[2]): r[3] for r in cells}
    rows = [(k, round(stats.chi2([[n.get((k, i, j), 0) for j in b] for i in a])[2], 9)) for k in sorted({r[0] for r in cells})]
    return t.spark.createDataFrame(rows, "line int, p double")


#: Two-sided normal tail of z (in the column named) by Simpson's rule.
TAIL = "(SELECT sum(w * exp(-x * x / 2)) * 12.0 / 20000 / 3 * 2 / sqrt(2 * pi()) FROM (SELECT abs(s.z) + i * 12.0 / 20000 AS x, CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w FROM range(20001) r(i)))"


@query("m06_m08_w04_mann_whitney", f"WITH x AS (SELECT c_acctbal AS v, c_mktsegment = 'BUILDING' AS g FROM customer), r AS (SELECT g, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS k FROM x), q AS (SELECT sum(t * t * t - t) AS ties FROM (SELECT count(*) AS t FROM x GROUP BY v)), a AS (SELECT sum(k) FILTER (g) AS r1, count(*) FILTER (g) AS n1, count(*) FILTER (NOT g) AS n2 FROM r), s AS (SELECT r1 - n1 * (n1 + 1) / 2 AS u, (r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1.0)))) AS z FROM a, q) SELECT u, round({TAIL}, 9) AS p FROM s")
def mann_whitney(t):
    """Ranks and sums are made by Spark; four numbers come to the driver."""
    ranked = average_ranks(t.customer, "c_acctbal").withColumn("g", F.col("c_mktsegment") == "BUILDING")
    s = ranked.agg(F.sum(F.when(F.col("g"), F.col("avg_rank"))).alias("r1"), F.count_if("g").alias("n1"), F.count_if(~F.col("g")).alias("n2")).first()
    ties = t.customer.groupBy("c_acctbal").agg(F.count("*").cast("double").alias("t")).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t"))).first()[0]
    u, p = stats.mann_whitney(s["r1"], s["n1"], s["n2"], ties)
    return t.spark.createDataFrame([(u, round(p, 9))], "u double, p double")


@query("m07_m08_two_proportions", f"WITH c AS (SELECT o_orderpriority AS k, count(*) FILTER (o_orderstatus = 'F' AND y) AS k1, count(*) FILTER (y) AS n1, count(*) FILTER (o_orderstatus = 'F' AND NOT y) AS k2, count(*) FILTER (NOT y) AS n2 FROM (SELECT o_orderpriority, o_orderstatus, year(o_orderdate) < 1997 AS y FROM orders) GROUP BY 1), s AS (SELECT k, (k1 / n1 - k2 / n2) / sqrt((k1 + k2) / (n1 + n2) * (1 - (k1 + k2) / (n1 + n2)) * (1 / n1 + 1 / n2)) AS z FROM c) SELECT k, z, round({TAIL}, 9) AS p FROM s")
def two_proportions(t):
    """A test for each priority; four counts of each come to the driver."""
    y, f = F.year("o_orderdate") < 1997, F.col("o_orderstatus") == "F"
    rows = t.orders.groupBy("o_orderpriority").agg(F.count_if(f & y).alias("k1"), F.count_if(y).alias("n1"), F.count_if(f & ~y).alias("k2"), F.count_if(~y).alias("n2")).collect()
    out = [(r[0], *stats.two_proportions(*r[1:])) for r in rows]
    return t.spark.createDataFrame([(k, z, round(p, 9)) for k, z, p in out], "k string, z double, p double")


@query("d04_age", "SELECT o_custkey, avg(year(o_orderdate) - (1920 + c_nationkey * 2)) AS age FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def age(t):
    """Whole years between a birth year (of the customer) and an event's year, without months."""
    born = t.customer.select(F.col("c_custkey").alias("o_custkey"), (F.lit(1920) + F.col("c_nationkey") * 2).alias("born"))
    return t.orders.join(born, "o_custkey").groupBy("o_custkey").agg(F.avg(F.year("o_orderdate") - F.col("born")).alias("age"))


@query("j01_j02_lookup_default", "SELECT doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def lookup_default(t):
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic"))


@query("j04_fanout", "SELECT c_mktsegment, o_orderpriority, count(*) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2")
def fanout(t):
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_mktsegment", "o_orderpriority").agg(F.count("*").alias("n"))


@query("j05_j29_correction", "SELECT s_suppkey, coalesce(CASE WHEN r_name = 'ASIA' THEN 'Far East' WHEN r_name = 'EUROPE' THEN 'Old World' END, r_name) AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def correction(t):
    fix = t.spark.createDataFrame([("ASIA", "Far East"), ("EUROPE", "Old World")], "r_name string, fixed string")
    s = t.supplier.join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    return s.join(F.broadcast(fix), "r_name", "left").select("s_suppkey", F.coalesce("fixed", "r_name").alias("region"))


@query("j06_j07_key_map", "WITH m AS (SELECT l_partkey, l_suppkey, max(l_orderkey) AS id FROM lineitem GROUP BY 1, 2) SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, m.id FROM lineitem l JOIN m USING (l_partkey, l_suppkey)")
def key_map(t):
    m = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.max("l_orderkey").alias("id"))
    return t.lineitem.join(m, ["l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "id")


@query("j08_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def semi(t):
    return t.customer.join(t.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey")


@query("j09_j10_s14_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def anti(t):
    return t.customer.join(t.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("j25_multi_key_seed", "WITH k AS (SELECT p_partkey, unnest([p_name, p_brand, p_type]) AS k FROM part), h AS (SELECT k.p_partkey, p.p_partkey AS hit, p.p_retailprice AS score FROM k JOIN (SELECT min(p_partkey) AS p_partkey, p_brand, max(p_retailprice) AS p_retailprice FROM part GROUP BY p_brand) p ON k.k = p.p_brand) SELECT p_partkey, arg_max(hit, (score, hit)) AS hit, count(DISTINCT hit) AS n FROM h GROUP BY 1")
def seed(t):
    k = t.part.select("p_partkey", F.explode(F.array_distinct(F.array("p_name", "p_brand", "p_type"))).alias("k"))
    p = t.part.groupBy(F.col("p_brand").alias("k")).agg(F.min("p_partkey").alias("hit"), F.max("p_retailprice").alias("score"))
    return k.join(p, "k").groupBy("p_partkey").agg(F.max_by("hit", F.struct("score", "hit")).alias("hit"), F.count_distinct("hit").alias("n"))


@query("j27_unordered_pair_replay", "WITH d AS (SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem WHERE l_returnflag = 'R') SELECT l_returnflag, count(*) AS n, count(d.a) AS known FROM lineitem LEFT JOIN d ON a = least(l_partkey, l_suppkey) AND b = greatest(l_partkey, l_suppkey) GROUP BY 1")
def replay(t):
    pair = (F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b"))
    d = t.lineitem.filter("l_returnflag = 'R'").select(*pair, F.lit(1).alias("hit")).distinct()
    return t.lineitem.select("l_returnflag", *pair).join(d, ["a", "b"], "left").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count("hit").alias("known"))


@query("j31_j26_precedence", "SELECT doc_id, CASE WHEN quality = 0 THEN 'web' WHEN toxic IS NOT NULL THEN 'batch' ELSE 'default' END AS source, CASE WHEN quality = 0 THEN 'unsure' WHEN toxic = 1 THEN 'same' ELSE 'distinct' END AS verdict FROM documents LEFT JOIN labels USING (doc_id)")
def precedence(t):
    web = t.labels.filter("quality = 0").select("doc_id", F.struct(F.lit("web").alias("source"), F.lit("unsure").alias("verdict")).alias("w"))
    batch = t.labels.select("doc_id", F.struct(F.lit("batch").alias("source"), F.when(F.col("toxic") == 1, "same").otherwise("distinct").alias("verdict")).alias("b"))
    default = F.struct(F.lit("default").alias("source"), F.lit("distinct").alias("verdict"))
    v = F.coalesce("w", "b", default)
    return t.documents.select("doc_id").join(web, "doc_id", "left").join(batch, "doc_id", "left").select("doc_id", v["source"].alias("source"), v["verdict"].alias("verdict"))


@query("j33_conditional_update", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'R' ELSE o_orderstatus END AS status FROM orders")
def conditional_update(t):
    hit = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(True).alias("hit")).distinct()
    return t.orders.join(hit, "o_orderkey", "left").select("o_orderkey", F.when((F.col("o_orderstatus") == "O") & F.col("hit"), "R").otherwise(F.col("o_orderstatus")).alias("status"))


@query("j35_u03_candidates", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) UNION SELECT l_orderkey FROM lineitem WHERE l_quantity > 49 AND l_orderkey IN (SELECT o_orderkey FROM orders)")
def candidates(t):
    good = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    one = t.orders.filter("o_orderstatus = 'F'").join(good, "o_custkey", "left_semi").select("o_orderkey")
    two = t.lineitem.filter("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey")).join(t.orders, "o_orderkey", "left_semi")
    return one.union(two).distinct()


@query("m12_unrounded_mean", "SELECT c_mktsegment, avg(c_acctbal) AS mean FROM customer GROUP BY 1")
def unrounded(t):
    return t.customer.groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("mean"))


