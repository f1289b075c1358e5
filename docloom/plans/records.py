"""Nested records, derived rows, reconciliation, sinks and incremental queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.registry import query


def nested(t):
    """Orders with their lines as a nested array, as an extraction log has them."""
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey", "l_returnflag"))).alias("lines"))
    return t.orders.join(lines, "o_orderkey")


@query("s17_r03_a02_flatten", "SELECT o_orderkey, o_custkey, l_linenumber, l_suppkey, l_returnflag FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag <> 'N'")
def flatten(t):
    return nested(t).select("o_orderkey", "o_custkey", F.explode("lines").alias("x")).select("o_orderkey", "o_custkey", "x.l_linenumber", "x.l_suppkey", "x.l_returnflag").filter("l_returnflag <> 'N'")


@query("r05_r06_r11_w06_ordered_arrays", "SELECT o_orderkey, string_agg(l_suppkey, ',' ORDER BY l_linenumber, l_suppkey, l_partkey, l_returnflag) AS supps, max(l_linenumber) AS top FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def ordered(t):
    return nested(t).select("o_orderkey", F.array_join(F.transform("lines", lambda x: x["l_suppkey"].cast("string")), ",").alias("supps"), F.array_max(F.transform("lines", lambda x: x["l_linenumber"])).alias("top"))


@query("j28_r08_label_attach", "SELECT o_orderkey, count(*) AS n, count(*) FILTER (s_acctbal > 5000) AS gold FROM orders JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1")
def label_attach(t):
    gold = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_acctbal") > 5000).alias("gold"))
    flat = nested(t).select("o_orderkey", F.explode("lines").alias("x")).select("o_orderkey", "x.*").join(gold, "l_suppkey", "left")
    again = flat.groupBy("o_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_suppkey", "gold")).alias("lines"))
    return again.select("o_orderkey", F.size("lines").alias("n"), F.size(F.filter("lines", lambda x: F.coalesce(x["gold"], F.lit(False)))).alias("gold"))


@query("j32_js04_nested_update", "SELECT o_orderkey, count(*) FILTER (l_returnflag = 'R' OR o_orderstatus = 'P') AS marked FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def nested_update(t):
    new = F.transform("lines", lambda x: x.withField("l_returnflag", F.lit("R")))
    folded = nested(t).withColumn("lines", F.when(F.col("o_orderstatus") == "P", new).otherwise(F.col("lines")))
    return folded.select("o_orderkey", F.size(F.filter("lines", lambda x: x["l_returnflag"] == "R")).alias("marked"))


@query("a28_r09_derived_firms", "SELECT l_orderkey, p_brand, count(*) AS n, string_agg(DISTINCT l_returnflag, '; ' ORDER BY l_returnflag) AS roles FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
def derived(t):
    brand = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return t.lineitem.join(brand, "l_partkey").groupBy("l_orderkey", "p_brand").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), "; ").alias("roles"))


@query("js02_schema_decode", "SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN event_type END AS kind FROM events")
def decode(t):
    record = F.to_json(F.struct(F.array("event_type").alias("kinds")))
    kinds = F.filter(F.from_json(record, "kinds array<string>")["kinds"], lambda x: x.isin("click", "view"))
    return t.events.select("event_id", F.get(kinds, 0).alias("kind"))


@query("js03_s08_tolerant", "SELECT count(*) AS good FROM events WHERE event_id % 10 <> 0")
def tolerant(t):
    raw = F.when(F.col("event_id") % 10 == 0, F.lit('{"k": ')).otherwise(F.col("props"))
    parsed = t.events.select(F.from_json(raw, "k long, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("x"))
    return parsed.filter("x._bad is null").agg(F.count("*").alias("good"))


@query("r07_r12_membership", "SELECT p_partkey, list_contains(['ECONOMY', 'PROMO'], p_type) AS has, CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'PROMO' THEN 2 ELSE 0 END AS code FROM part")
def membership(t):
    code = F.create_map(F.lit("ECONOMY"), F.lit(1), F.lit("PROMO"), F.lit(2))
    return t.part.select("p_partkey", F.array_contains(F.array(F.lit("ECONOMY"), F.lit("PROMO")), F.col("p_type")).alias("has"), F.coalesce(F.try_element_at(code, F.col("p_type")), F.lit(0)).alias("code"))


@query("s11_s12_coalesced_sources", "SELECT doc_id, CASE WHEN n_chars > 1000 THEN 'ocr' WHEN lang = 'en' THEN 'pdf' ELSE 'none' END AS source FROM documents")
def sources(t):
    from docloom.sources.tabular import first_text

    ocr, pdf = F.when(F.col("n_chars") > 1000, F.col("text")), F.when(F.col("lang") == "en", F.col("text"))
    return t.documents.select("doc_id", first_text(("ocr", ocr), ("pdf", pdf))[1].alias("source"))


@query("s15_w08_last_row_map", "SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS label FROM orders GROUP BY 1")
def last_row(t):
    from docloom.sources.tabular import last_per_key

    return last_per_key(t.orders, "o_custkey", "o_orderkey").select("o_custkey", F.col("o_orderstatus").alias("label"))


@query("s13_literal_table", "SELECT * FROM (VALUES ('en', 'English'), ('de', 'German'), ('fr', 'French'), ('es', 'Spanish')) v(lang, name)")
def literal(t):
    from docloom.sources.tabular import literal as rows

    return rows(t.spark, [("en", "English"), ("de", "German"), ("fr", "French"), ("es", "Spanish")], "lang string, name string")


@query("k04_upsert", "SELECT o_custkey, max(o_orderkey) AS latest FROM orders GROUP BY 1")
def upsert(t):
    from docloom.sources.sinks import upserted

    old = t.orders.filter("o_orderkey % 2 = 0").select("o_custkey", F.col("o_orderkey").alias("latest"))
    new = t.orders.filter("o_orderkey % 2 = 1").select("o_custkey", F.col("o_orderkey").alias("latest"))
    return upserted(old, new, "o_custkey", F.col("latest"))


@query("st01_j09_k02_resume", "SELECT event_id FROM events WHERE event_id % 3 <> 0")
def resume(t):
    from docloom.streaming.incremental import remaining

    done = t.events.filter("event_id % 3 = 0").select("event_id", F.lit("ok").alias("status"))
    return remaining(t.events.select("event_id"), done, "event_id")
