"""Projection, filter and curation queries over documents, pages, conversations and the star schema's names."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import curate
from docloom.registry import query


@query("p01_columns", "SELECT c_custkey AS custkey, c_name AS name, c_nationkey AS nationkey FROM customer")
def columns(t):
    """Canonical names: without the table's prefix, lower case, runs of other characters as one underscore."""
    from docloom.sources.tabular import canonical_names

    return canonical_names(t.customer.select("c_custkey", "c_name", "c_nationkey"), "c_")


@query("p02_discovered_columns", "SELECT p_name AS value, count(*) AS n FROM part GROUP BY 1 UNION ALL SELECT r_name, count(*) FROM region GROUP BY 1 UNION ALL SELECT event_type, count(*) FROM events GROUP BY 1")
def discovered_columns(t):
    """The column of names or types, whatever each table calls it: a part's name before its type, a region's only name, an event's type."""
    from docloom.sources.tabular import discovered

    of = lambda df: df.select(F.col(discovered(df.columns, ("name", "type"), ("p_name",))).alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    return of(t.part.select("p_partkey", "p_type", "p_name")).union(of(t.region)).union(of(t.events))


@query("p06_title_chain", r"SELECT page_id, lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '[^/]*$'), '\.html.*$', ''), '\s*\(\d+\)$', ''), '([a-z])([A-Z])', '\1 \2', 'g'), '_', ' ', 'g'))) AS title FROM pages")
def title(t):
    name = F.regexp_replace(F.regexp_extract("url", "[^/]*$", 0), r"\.html.*$", "")
    return t.pages.select("page_id", F.lower(F.trim(tx.chain(name, (r"\s*\(\d+\)$", ""), ("([a-z])([A-Z])", "$1 $2"), ("_", " ")))).alias("title"))


@query("p07_norm_title", r"SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name), '\b(amended|second|interim|proposed|red|small)\b', '', 'g'), '\s+', ' ', 'g')) AS title FROM part")
def norm_title(t):
    return t.part.select("p_partkey", F.trim(tx.chain(F.lower("p_name"), (r"\b(amended|second|interim|proposed|red|small)\b", ""), (r"\s+", " "))).alias("title"))


@query("p08_p11_p50_group_id", r"SELECT o_orderkey, regexp_extract(concat(o_custkey, '/', o_orderkey, '-', o_orderpriority), '^(\d+)', 1) AS grp, regexp_extract(concat(o_custkey, '-', o_orderkey), '-(\d+)$', 1) AS docket FROM orders")
def group_id(t):
    path = F.concat_ws("/", "o_custkey", F.concat_ws("-", "o_orderkey", "o_orderpriority"))
    return t.orders.select("o_orderkey", tx.group_id(path).alias("grp"), F.regexp_extract(F.concat_ws("-", "o_custkey", "o_orderkey"), r"-(\d+)$", 1).alias("docket"))


@query("p09_zero_strip", r"SELECT c_custkey, regexp_replace(regexp_extract(c_name, '#(\d+)$', 1), '^0+(\d)', '\1') AS id FROM customer")
def zero_strip(t):
    return t.customer.select("c_custkey", tx.unpadded(F.regexp_extract("c_name", r"#(\d+)$", 1)).alias("id"))


@query("p13_override_flag", "SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_linenumber > 5 THEN 5 ELSE l_linenumber END AS line, CASE WHEN l_linenumber > 5 THEN 'file=5, text=' || l_linenumber ELSE '' END AS mismatch FROM lineitem")
def override(t):
    far = F.col("l_linenumber") > 5
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", F.when(far, 5).otherwise(F.col("l_linenumber")).alias("line"), F.when(far, F.format_string("file=5, text=%d", "l_linenumber")).otherwise("").alias("mismatch"))


@query("p14_d05_d06_iso_prefix", r"SELECT o_orderkey, regexp_extract(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), '^\s*(\d{4}-\d{2}-\d{2})', 1) AS day, regexp_extract(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), '^\s*(\d{4}-\d{2}-\d{2})', 1) < '1997-01-01' AS early FROM orders")
def iso(t):
    day = tx.iso_prefix(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return t.orders.select("o_orderkey", day.alias("day"), (day < "1997-01-01").alias("early"))


@query("p15_ascii_fold", r"SELECT doc_id, trim(regexp_replace(regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS folded FROM documents")
def fold(t):
    return t.documents.select("doc_id", tx.ascii_fold(F.col("text")).alias("folded"))


@query("p16_p17_letters_key", r"SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z]', '', 'g') AS key, regexp_replace(lower(split_part(trim(p_name), ' ', 1)), '[^a-z]', '', 'g') AS first FROM part")
def letters_key(t):
    return t.part.select("p_partkey", tx.letters(F.col("p_name")).alias("key"), tx.first_token(F.col("p_name")).alias("first"))


@query("p23_p26_tokens", r"SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(p_type || ' ' || p_name), '[a-z]+'), lambda x: length(x) > 1 AND x NOT IN ('small', 'large')))), ' ') AS sig FROM part")
def signature(t):
    toks = tx.tokens(F.concat_ws(" ", "p_type", "p_name"), 2, ("small", "large"))
    return t.part.select("p_partkey", F.array_join(F.array_sort(toks), " ").alias("sig"))


@query("p22_p25_firm_norm", "SELECT p_partkey, upper(trim(regexp_replace(lower(p_brand || ', L.L.P.'), '[^a-z0-9]+', ' ', 'g'))) AS firm FROM part")
def firm(t):
    return t.part.select("p_partkey", F.upper(F.trim(F.regexp_replace(F.lower(F.concat("p_brand", F.lit(", L.L.P."))), "[^a-z0-9]+", " "))).alias("firm"))


@query("p27_js01_list_coercion", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 1 END AS n FROM events")
def coercion(t):
    raw = F.when(F.col("event_id") % 2 == 0, F.lit('["a","b"]')).otherwise(F.col("event_type"))
    return t.events.select("event_id", F.size(tx.as_list(raw)).alias("n"))


@query("p28_d02_coalesce", "SELECT event_id, upper(trim(coalesce(CASE WHEN value > 50 THEN event_type END, CASE WHEN value > 20 THEN 'mid' END, 'low'))) AS role FROM events")
def coalesced(t):
    return t.events.select("event_id", F.upper(F.trim(F.coalesce(F.when(F.col("value") > 50, F.col("event_type")), F.when(F.col("value") > 20, F.lit("mid")), F.lit("low")))).alias("role"))


@query("p29_p48_side", "SELECT o_orderkey, CASE WHEN lower(o_orderstatus) LIKE 'p%' THEN 'Plaintiff' WHEN lower(o_orderstatus) LIKE 'f%' THEN 'Defendant' ELSE 'Other' END AS side FROM orders")
def side(t):
    s = F.lower("o_orderstatus")
    return t.orders.select("o_orderkey", F.when(s.startswith("p"), "Plaintiff").when(s.startswith("f"), "Defendant").otherwise("Other").alias("side"))


@query("p29_side_of_lists", "WITH l AS (SELECT o_custkey, list_distinct(list(CASE o_orderstatus WHEN 'P' THEN 'Plaintiff' WHEN 'F' THEN 'Defendant' ELSE ' ' END)) AS s FROM orders GROUP BY 1) SELECT o_custkey, len(s) AS said, coalesce(list_max(list_filter(s, lambda x: trim(x) <> '')), '') AS side FROM l")
def side_of_lists(t):
    """One side of a customer's orders: of a list with one side that one, of more the last by letters; blanks are none."""
    status = F.when(F.col("o_orderstatus") == "P", "Plaintiff").when(F.col("o_orderstatus") == "F", "Defendant").otherwise(" ")
    lists = t.orders.groupBy("o_custkey").agg(F.collect_set(status).alias("s"))
    return lists.select("o_custkey", F.size("s").cast("long").alias("said"), tx.one_of(F.col("s")).alias("side"))


@query("p30_truthy", "SELECT l_returnflag, l_linestatus, lower(l_returnflag) IN ('r', 'true', '1') AS flag, count(*) AS n FROM lineitem GROUP BY 1, 2, 3")
def truthy(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus", tx.truthy(F.col("l_returnflag"), "r", "true", "1").alias("flag")).agg(F.count("*").alias("n"))


@query("p31_d08_number", r"SELECT c_custkey, coalesce(TRY_CAST(regexp_extract(c_name, '(\d{4})$', 1) AS INTEGER), 0) AS year, coalesce(TRY_CAST(c_mktsegment AS DOUBLE), -1.0) AS num FROM customer")
def number(t):
    return t.customer.select("c_custkey", F.coalesce(F.regexp_extract("c_name", r"(\d{4})$", 1).try_cast("int"), F.lit(0)).alias("year"), tx.number(F.col("c_mktsegment"), -1.0).alias("num"))


@query("p33_roles", "SELECT p_partkey, CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN lower(p_type) ELSE '' END AS roles, CASE WHEN p_type = 'ECONOMY' THEN 'Lead' ELSE 'Other' END AS bucket FROM part")
def roles(t):
    r = tx.roles(F.concat_ws(";", "p_type", F.lit("junk")), ("economy", "promo"))
    return t.part.select("p_partkey", F.array_join(r, "; ").alias("roles"), F.when(F.array_contains(r, "economy"), "Lead").otherwise("Other").alias("bucket"))


@query("p34_recode", "SELECT n_nationkey, CASE WHEN n_regionkey IN (1, 3) THEN 9999 ELSE n_regionkey END AS region FROM nation")
def recode(t):
    return t.nation.select("n_nationkey", F.when(F.col("n_regionkey").isin(1, 3), 9999).otherwise(F.col("n_regionkey")).alias("region"))


@query("p39_p47_pair_key", "SELECT l_orderkey, l_partkey, l_suppkey, 'att|' || least(CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)) || '|' || greatest(CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)) AS k, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 1 ELSE 2 END AS rank FROM lineitem")
def pair_key(t):
    k = tx.pair_key("att", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    rank = F.element_at(F.create_map(F.lit("A"), F.lit(0), F.lit("R"), F.lit(1), F.lit("N"), F.lit(2)), F.col("l_returnflag"))
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", k.alias("k"), rank.alias("rank"))


@query("p40_sf18_fingerprint", "SELECT doc_id, substr(sha1(text), 1, 12) AS fp, md5(text) AS content FROM documents")
def fingerprint(t):
    return t.documents.select("doc_id", F.substring(F.sha1("text"), 1, 12).alias("fp"), F.md5(F.col("text").cast("binary")).alias("content"))


@query("p41_sf16_excerpt", "SELECT doc_id, CASE WHEN length(text) <= 2000 THEN text ELSE '[HEAD] ' || substr(text, 1, 600) || ' [EARLY] ' || substr(text, 601, 600) || ' [MIDDLE] ' || substr(text, CAST(length(text) // 2 AS BIGINT) - 200 + 1, 400) || ' [TAIL] ' || right(text, 400) END AS cut FROM documents")
def excerpt(t):
    return t.documents.select("doc_id", tx.excerpt(F.col("text"), 2_000, 600, 400, 400).alias("cut"))


@query("p46_identity", "SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_linenumber <= 3 THEN 'ind|' || l_suppkey || '|' || l_partkey ELSE 'firm|' || l_partkey END AS ident FROM lineitem")
def identity(t):
    ident = F.when(F.col("l_linenumber") <= 3, F.concat_ws("|", F.lit("ind"), "l_suppkey", "l_partkey")).otherwise(F.concat_ws("|", F.lit("firm"), "l_partkey"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", ident.alias("ident"))


@query("p51_completeness", "SELECT doc_id, CAST(text <> '' AS INTEGER) + CAST(lang <> '' AS INTEGER) + CAST(source <> '' AS INTEGER) + CAST(n_chars > 1000 AS INTEGER) AS score FROM documents")
def completeness(t):
    return t.documents.select("doc_id", F.expr("cast(text <> '' as int) + cast(lang <> '' as int) + cast(source <> '' as int) + cast(n_chars > 1000 as int)").alias("score"))


@query("f01_sf15_earliest_keyword", "WITH p AS (SELECT doc_id, position('order' IN lower(text)) AS o, position('motion' IN lower(text)) AS m, position('license' IN lower(text)) AS l FROM documents), q AS (SELECT doc_id, CASE WHEN o = 0 THEN 1000000000 ELSE o END AS o, CASE WHEN m = 0 THEN 1000000000 ELSE m END AS m, CASE WHEN l = 0 THEN 1000000000 ELSE l END AS l FROM p) SELECT doc_id, CASE WHEN least(o, m, l) = 1000000000 THEN 'OTHER' WHEN o = least(o, m, l) THEN 'ORDER' WHEN m = least(o, m, l) THEN 'MOTION' ELSE 'LICENSE' END AS kind FROM q")
def earliest(t):
    return t.documents.select("doc_id", tx.earliest_class(F.lower("text"), {"ORDER": "order", "MOTION": "motion", "LICENSE": "license"}, "OTHER").alias("kind"))


@query("f03_a02_drop_cascade", "SELECT CASE WHEN text LIKE '%license%' OR text LIKE '%License%' THEN 'license' WHEN lang <> 'en' THEN 'other_language' WHEN n_chars > 5000 THEN 'long' WHEN n_chars < 200 THEN 'short' ELSE 'keep' END AS reason, count(*) AS n FROM documents GROUP BY 1")
def drop_cascade(t):
    c = F.col
    reason = curate.cascade(("license", c("text").contains("license") | c("text").contains("License")), ("other_language", c("lang") != "en"), ("long", c("n_chars") > 5000), ("short", c("n_chars") < 200))
    return t.documents.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("f04_language_gate", r"SELECT doc_id, regexp_matches(text, '(?i)\b(licen[sc]e[ds]?|token|version)\b') AS gate, regexp_matches(text, '(?i)docket') AND NOT text LIKE '%#%' AS dump FROM documents")
def predicates(t):
    return t.documents.select("doc_id", F.col("text").rlike(r"(?i)\b(licen[sc]e[ds]?|token|version)\b").alias("gate"), (F.col("text").rlike("(?i)docket") & ~F.col("text").contains("#")).alias("dump"))


@query("f06_f12_f20_row_filters", "SELECT p_partkey, p_name FROM part WHERE p_type <> 'PROMO' AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') AND contains(p_name, 'ring')")
def row_filters(t):
    return t.part.filter((F.col("p_type") != "PROMO") & F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3") & F.col("p_name").contains("ring")).select("p_partkey", "p_name")


@query("f07_w06_w07_trim", "WITH m AS (SELECT *, max(CASE WHEN text LIKE '%?%' THEN turn END) OVER (PARTITION BY conv_id) AS s, max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS w, max(turn) OVER (PARTITION BY conv_id) AS e FROM conversations) SELECT conv_id, turn, CASE WHEN s IS NOT NULL THEN 'strong' WHEN w IS NOT NULL THEN 'weak' ELSE 'whole' END AS cut_method FROM m WHERE turn <= coalesce(s, w, e)")
def trim(t):
    return curate.trim_at_last(t.conversations, "conv_id", "turn", F.col("text").contains("?"), F.col("role") == "assistant").select("conv_id", "turn", "cut_method")


@query("f08_keep_policy", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') OR o_orderstatus = 'P'")
def keep_policy(t):
    some = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(1).alias("hit")).distinct()
    return t.orders.join(some, "o_orderkey", "left").filter((F.col("hit") == 1) | F.col("o_orderstatus").eqNullSafe("P")).select("o_orderkey")


@query("f09_f10_gate", "SELECT doc_id, coalesce(quality, 1) AS gate FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(quality, 1) = 1")
def gate(t):
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(1)).alias("gate")).filter("gate = 1")


@query("f13_f14_f15_contains", "SELECT p_partkey, p_type ILIKE '%eco%' AS has, list_contains(string_split(p_name, ' '), 'ring') AS is_lead FROM part WHERE upper(trim(p_type)) IN ('ECONOMY', 'PROMO')")
def contains(t):
    return t.part.filter(F.upper(F.trim("p_type")).isin("ECONOMY", "PROMO")).select("p_partkey", F.coalesce(F.col("p_type"), F.lit("")).ilike("%eco%").alias("has"), F.array_contains(F.split("p_name", " "), "ring").alias("is_lead"))


@query("f24_unresolved", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def unresolved(t):
    return t.orders.filter("o_orderstatus = 'P'").join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").select("o_orderkey")


@query("f19_nulls_dropped", "SELECT doc_id, toxic FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic IS NOT NULL")
def nulls(t):
    return t.documents.join(t.labels, "doc_id", "left").dropna(subset=["toxic"]).select("doc_id", "toxic")


@query("f21_f23_slices", "SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 'high' WHEN o_orderpriority = '1-URGENT' THEN 'urgent' WHEN o_orderstatus = 'P' THEN 'pending' END AS slice FROM orders WHERE o_totalprice > 400000 OR o_orderpriority = '1-URGENT' OR o_orderstatus = 'P'")
def slices(t):
    tag = F.when(F.col("o_totalprice") > 400000, "high").when(F.col("o_orderpriority") == "1-URGENT", "urgent").when(F.col("o_orderstatus") == "P", "pending")
    return t.orders.select("o_orderkey", tag.alias("slice")).filter("slice is not null")


@query("f22_f16_conflict", "SELECT p_brand, count(*) AS n FROM part WHERE NOT list_has_any(string_split(p_name, ' '), ['ring', 'widget']) GROUP BY 1 HAVING count(*) >= 10")
def conflict(t):
    return t.part.filter(~F.arrays_overlap(F.split("p_name", " "), F.array(F.lit("ring"), F.lit("widget")))).groupBy("p_brand").agg(F.count("*").alias("n")).filter("n >= 10")


@query("w01_sf18_opt4_content_dedup", "SELECT lang, source, md5(text) AS content, min(doc_id) AS doc_id FROM documents GROUP BY 1, 2, 3")
def content_dedup(t):
    return curate.keep_first(t.documents, ["lang", "source"], ["doc_id"], F.unhex(F.md5(F.col("text").cast("binary")))).select("lang", "source", "content", "doc_id")


@query("k08_u05_reconcile", "WITH d AS (SELECT doc_id FROM documents WHERE lang = 'en'), p AS (SELECT doc_id FROM labels) SELECT coalesce(d.doc_id, p.doc_id) AS doc_id, CASE WHEN p.doc_id IS NULL THEN 'link' WHEN d.doc_id IS NULL THEN 'remove' ELSE 'keep' END AS action FROM d FULL JOIN p ON d.doc_id = p.doc_id")
def reconcile(t):
    return curate.reconcile(t.documents.filter("lang = 'en'"), t.labels, "doc_id")


@query("d01_d03_dates", "SELECT o_orderkey, year(TRY_CAST(CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') ELSE 'unknown' END AS TIMESTAMP)) AS y FROM orders")
def dates(t):
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).otherwise("unknown")
    return t.orders.select("o_orderkey", F.year(raw.try_cast("timestamp")).cast("long").alias("y"))


@query("js01_sf17_js05_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def props(t):
    wrapped = F.concat(F.lit("answer: "), F.col("props"), F.lit(" end"))
    return t.events.select("event_id", F.from_json(tx.first_object(wrapped), "k long")["k"].alias("k"))
