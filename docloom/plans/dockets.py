"""Rules over file names and titles of court dockets: each order gives a file, a customer's orders are a group."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators.ranks import top_list
from docloom.registry import query

NAME_SQL = "n AS (SELECT o_orderkey AS k, o_custkey + 10 AS grp, o_orderkey % 4 + 1 AS no, CASE o_orderkey % 5 WHEN 0 THEN (o_custkey + 10) || ', Doc. ' || (o_orderkey % 4 + 1) || ', OrderAppointing_Lead Counsel.pdf' WHEN 1 THEN (o_custkey + 10) || ', Doc ' || (o_orderkey % 4 + 1) || '-' || (o_orderkey % 3 + 1) || ', ' || CASE WHEN o_orderkey % 2 = 0 THEN 'Steering Committee Slate' ELSE 'Map' END || '.pdf' WHEN 2 THEN 'US_DIS_NYSD_05md' || (o_custkey + 10) || '_' || (o_orderkey % 4 + 1) || '_Order Approving Settlement Fees.pdf' WHEN 3 THEN (o_custkey + 10) || '_Docket #' || (o_orderkey % 4 + 1) || ', Report and Recommendation (2).pdf' ELSE 'Order on Reappointment.PDF' END AS name FROM orders)"


def names(t):
    k, grp, no = F.col("o_orderkey"), F.col("o_custkey") + 10, F.col("o_orderkey") % 4 + 1
    join = lambda *parts: F.concat(*(p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts))
    name = F.when(k % 5 == 0, join(grp, ", Doc. ", no, ", OrderAppointing_Lead Counsel.pdf"))
    name = name.when(k % 5 == 1, join(grp, ", Doc ", no, "-", k % 3 + 1, ", ", F.when(k % 2 == 0, "Steering Committee Slate").otherwise("Map"), ".pdf"))
    name = name.when(k % 5 == 2, join("US_DIS_NYSD_05md", grp, "_", no, "_Order Approving Settlement Fees.pdf"))
    name = name.when(k % 5 == 3, join(grp, "_Docket #", no, ", Report and Recommendation (2).pdf")).otherwise("Order on Reappointment.PDF")
    return t.orders.select(k.alias("k"), grp.alias("grp"), no.alias("no"), name.alias("name"))


@query("p10_docket_number", f"WITH {NAME_SQL} SELECT k, CASE WHEN k % 5 < 4 THEN CAST(no AS VARCHAR) END AS docket FROM n")
def docket_number(t):
    return names(t).select("k", tx.docket_number(F.col("name")).alias("docket"))


@query("p04_p05_title_of_docket", f"WITH {NAME_SQL} SELECT k, CASE k % 5 WHEN 0 THEN 'order appointing lead counsel' WHEN 1 THEN CASE WHEN k % 2 = 0 THEN 'steering committee slate' ELSE 'map' END WHEN 2 THEN 'order approving settlement fees' WHEN 3 THEN 'report and recommendation' ELSE 'order on reappointment' END AS title FROM n")
def title(t):
    """The title behind the docket number in either convention, cleaned as other titles are."""
    behind = F.regexp_replace(F.regexp_replace("name", r"(?i)^.*?[,_]\s*Doc(?:ket)?\.?\s*#?\s*\d+(?:-\d+)?\s*,\s*", ""), r"(?i)^.*_\d+(?:md|mc|cv)\d+_\d+_", "")
    return names(t).select("k", tx.title(behind).alias("title"))


@query("p12_id_hints", "WITH n AS (SELECT o_orderkey AS k, o_custkey + 10 AS g, o_orderkey % 4 + 1 AS d FROM orders) SELECT k, CASE WHEN k % 4 < 3 THEN g || '-' || d ELSE '' END AS hint FROM n")
def id_hints(t):
    """Three ways to name group and docket in a text, and texts without any."""
    k, g, d = F.col("o_orderkey"), (F.col("o_custkey") + 10).cast("string"), (F.col("o_orderkey") % 4 + 1).cast("string")
    text = F.when(k % 4 == 0, F.concat(F.lit("in re mdl no. "), g, F.lit(", see\nthe order, DOC. "), d)).when(k % 4 == 1, F.concat(g, F.lit(" has Doc "), d, F.lit(" on it"))).when(k % 4 == 2, F.concat(F.lit("order "), g, F.lit("–"), d)).otherwise("no number of any kind")
    return t.orders.select(k.alias("k"), tx.id_hint(text).alias("hint"))


@query("f18_roster_exhibits", f"WITH {NAME_SQL} SELECT r.k AS report, x.k AS exhibit FROM n r JOIN n x ON r.grp = x.grp AND r.no = x.no WHERE r.k % 5 = 3 AND x.k % 5 = 1 AND x.k % 2 = 0")
def roster_exhibits(t):
    """The exhibits of a report: files of its group below its docket number whose names speak of a roster. The numbers are taken out of
    the names and joined, instead of a pattern per report."""
    n = names(t)
    reports = n.filter(F.col("name").rlike(tx.REPORT_TITLE)).select("grp", tx.docket_number(F.col("name")).alias("base"), F.col("k").alias("report"))
    exhibits = n.filter(F.col("name").rlike(tx.EXHIBIT) & F.col("name").rlike(tx.ROSTER_WORDS)).select("grp", F.regexp_extract("name", tx.EXHIBIT, 1).alias("base"), F.col("k").alias("exhibit"))
    return reports.join(exhibits, ["grp", "base"]).select("report", "exhibit")


@query("f17_title_predicates", f"WITH {NAME_SQL} SELECT k % 5 AS kind, count(*) AS n, count(*) FILTER (k % 5 = 3) AS report, count(*) FILTER (k % 5 = 4) AS reappoint, count(*) FILTER (k % 5 = 2) AS fee FROM n GROUP BY 1")
def title_predicates(t):
    """What a title says: a report, a reappointment, or fees without an appointment."""
    c = F.col("name")
    fee = c.rlike(tx.FEE_TITLE) & ~c.rlike(tx.APPOINT_TITLE)
    return names(t).groupBy((F.col("k") % 5).alias("kind")).agg(F.count("*").alias("n"), F.count_if(c.rlike(tx.REPORT_TITLE)).alias("report"), F.count_if(c.rlike(tx.REAPPOINT_TITLE)).alias("reappoint"), F.count_if(fee).alias("fee"))


@query("w09_backfilled_firsts", "WITH r AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS firm, o_orderstatus FROM orders) SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS status, arg_min(firm, o_orderkey) FILTER (firm IS NOT NULL) AS firm FROM r GROUP BY 1")
def backfilled(t):
    """The first row of each key, its firm from the first row that has one."""
    firm = F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority"))
    filled = F.when(firm.isNotNull(), F.col("o_orderkey"))
    return t.orders.groupBy("o_custkey").agg(F.min_by("o_orderstatus", "o_orderkey").alias("status"), F.min_by(firm, filled).alias("firm"))


@query("a06_other_names", "WITH c AS (SELECT p_brand, p_name, count(*) AS n, min(p_partkey) AS seen FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, seen) AS rk FROM c) SELECT p_brand, max(p_name) FILTER (rk = 1) AS canonical, string_agg(p_name, '; ' ORDER BY rk) FILTER (rk BETWEEN 2 AND 4) AS others FROM r GROUP BY 1")
def other_names(t):
    """The most frequent name, the first seen among equals, and the three most frequent others."""
    c = t.part.groupBy("p_brand", "p_name").agg(F.count("*").alias("n"), F.min("p_partkey").alias("seen"))
    ranked = top_list(c, ["p_brand"], 4, F.col("p_name"), F.desc("n"), "seen")
    return ranked.select("p_brand", F.get("top", F.lit(0)).alias("canonical"), F.nullif(F.array_join(F.slice("top", 2, 3), "; "), F.lit("")).alias("others"))


@query("f02_docket_lists", "SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN true WHEN 4 THEN false WHEN 5 THEN true WHEN 6 THEN false ELSE false END AS dump FROM orders")
def docket_lists(t):
    """Names of docket lists, and names that only speak of a docket."""
    forms = ["Docket Entries.pdf", "12, Master Docket (2).PDF", "12, Docket #4, Order.pdf", "MDL-12 docket.pdf", "12, Order on Dockets.pdf", "Consolidated Docket of all cases.pdf", "Order.pdf", "Docketed order.pdf"]
    name = F.element_at(F.array(*map(F.lit, forms)), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return t.orders.select("o_orderkey", tx.is_docket_list(name).alias("dump"))


@query("f05_disposition", "SELECT o_orderkey, o_orderstatus = 'F' OR o_orderkey % 3 = 0 AS decided FROM orders")
def disposition(t):
    """Texts in which a court decides, with other words that only begin alike."""
    text = F.when(F.col("o_orderstatus") == "F", "the motion is GRANTED in part").when(F.col("o_orderkey") % 3 == 0, "it is so\tordered: so ordered.").otherwise("the grantor disallowed re-entry, approval sought")
    return t.orders.select("o_orderkey", text.rlike(tx.DISPOSITION).alias("decided"))


STOP_SQL = "(" + ", ".join(f"'{w}'" for w in tx.signature_stop()) + ")"


@query("p24_firm_signature", f"SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower('The ' || p_name || ' Law Offices of New York & ' || p_type || ' Trial Lawyers, P.L.L.C. Inc'), '[a-z]+'), lambda x: length(x) > 1 AND x NOT IN {STOP_SQL}))), ' ') AS sig FROM part")
def firm_signature(t):
    firm = F.concat(F.lit("The "), "p_name", F.lit(" Law Offices of New York & "), "p_type", F.lit(" Trial Lawyers, P.L.L.C. Inc"))
    return t.part.select("p_partkey", F.array_join(tx.firm_signature(firm), " ").alias("sig"))
