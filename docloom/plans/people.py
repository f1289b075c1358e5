"""Rules over people and firms, on entities made of the tables' words: a part's two words are first and last name, its type the firm."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import fuzzy as fz
from docloom.functions import text as tx
from docloom.operators import entity as en
from docloom.operators import similar as sm
from docloom.operators.network import dealt, enough
from docloom.operators.ranks import row_numbers, top_list
from docloom.registry import query


def letters_sql(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^a-z]', '', 'g')"


def soundex_sql(x: str) -> str:
    word = letters_sql(x)
    code = f"translate(substr({word}, 1, 1) || regexp_replace(substr({word}, 2), '[hw]', '', 'g'), 'aeiouyhwbfpvcgjkqsxzdtlmnr', '00000000111122222222334556')"
    for d in range(7):
        code = f"regexp_replace({code}, '{d}+', '{d}', 'g')"
    return f"CASE WHEN {word} = '' THEN '' ELSE upper(substr({word}, 1, 1)) || rpad(substr(replace(substr({code}, 2), '0', ''), 1, 3), 3, '0') END"


def sounds_sql(a: str, b: str) -> str:
    return f"(({a} <> '' AND {b} <> '' AND ({a} = {b} OR {soundex_sql(a)} = {soundex_sql(b)})) OR (least(length({a}), length({b})) >= 5 AND levenshtein({a}, {b}) <= 1))"


def surname_sql(a: str, b: str) -> str:
    return f"({a} <> '' AND {b} <> '' AND ({a} = {b} OR (length({a}) >= 4 AND length({b}) >= 4 AND (starts_with({a}, {b}) OR starts_with({b}, {a}))) OR (least(length({a}), length({b})) >= 5 AND levenshtein({a}, {b}) <= 1)))"


def initial_sql(a: str, b: str) -> str:
    return f"({a} = '' OR {b} = '' OR substr({a}, 1, 1) = substr({b}, 1, 1))"


NICK_SQL = "nick AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {k})" for n, some in fz.groups_of_names(fz.nickname_groups()).items() for k in some) + ") v(name, grp)), nicks AS (SELECT DISTINCT x.name AS a, y.name AS b FROM nick x JOIN nick y USING (grp))"


def one_edit_sql(a: str, b: str) -> str:
    return f"(substr({a}, 1, 1) = substr({b}, 1, 1) AND levenshtein({a}, {b}) <= 1)"


def sorted_sql(a: str) -> str:
    return f"array_to_string(list_sort(string_split({a}, '')), '')"


def related_sql(a: str, b: str, nick: str) -> str:
    rest = f"(starts_with({a}, {b}) OR starts_with({b}, {a}) OR {one_edit_sql(a, b)} OR ({sorted_sql(a)} = {sorted_sql(b)} AND levenshtein({a}, {b}) <= 2))"
    return f"CASE WHEN {a} = '' OR {b} = '' OR {a} = {b} OR {nick} THEN true WHEN length({a}) = 1 OR length({b}) = 1 THEN substr({a}, 1, 1) = substr({b}, 1, 1) ELSE {rest} END"


#: Every word of the tables' names, in lower case.
WORDS_SQL = "w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(x), '[a-z]+')) AS w FROM (SELECT p_name || ' ' || p_type AS x FROM part UNION ALL SELECT c_mktsegment FROM customer UNION ALL SELECT n_name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT o_orderpriority FROM orders UNION ALL SELECT event_type FROM events))"


def words(t) -> DataFrame:
    texts = [t.part.select(F.concat_ws(" ", "p_name", "p_type").alias("x")), t.customer.select("c_mktsegment"), t.nation.select("n_name"), t.region.select("r_name"), t.orders.select("o_orderpriority"), t.events.select("event_type")]
    # distinct texts first, so that few of them are split
    every = texts[0].distinct()
    for some in texts[1:]:
        every = every.union(some.distinct())
    return every.select(F.explode(F.regexp_extract_all(F.lower("x"), F.lit("([a-z]+)"), F.lit(1))).alias("w")).distinct()


def name_pairs(w: DataFrame, sounds: bool) -> DataFrame:
    """Candidate pairs (a, b) of words that may be one surname: one edit apart, one the beginning of the other, or of one sound. No other words meet."""
    pairs = sm.edit_pairs(w, "w", 1).select("a", "b")
    return pairs.union(sm.keyed_pairs(w, "w", fz.soundex(F.col("w"))) if sounds else sm.prefix_pairs(w, "w", 4))


PAIRS_SQL = "p AS (SELECT a.w AS a, b.w AS b FROM w a JOIN w b ON a.w < b.w)"


@query("sf01_sf03_sf04_surnames", f"WITH {WORDS_SQL}, {PAIRS_SQL}, r AS (SELECT a, b, {soundex_sql('a')} AS code_a, {soundex_sql('b')} AS code_b, {sounds_sql('a', 'b')} AS sounds, {surname_sql('a', 'b')} AS same FROM p) SELECT * FROM r WHERE sounds OR same")
def surnames(t):
    """The pairs of words that sound alike or may be one surname."""
    a, b, w = F.col("a"), F.col("b"), words(t)
    pairs = name_pairs(w, True).union(name_pairs(w, False)).distinct()
    return pairs.select("a", "b", fz.soundex(a).alias("code_a"), fz.soundex(b).alias("code_b"), fz.sounds_like(a, b).alias("sounds"), fz.same_surname(a, b).alias("same")).filter("sounds or same")


RELATION_SQL = f"CASE WHEN n.a IS NOT NULL THEN 'nick' WHEN (length(p.a) = 1 OR length(p.b) = 1) AND substr(p.a, 1, 1) = substr(p.b, 1, 1) THEN 'initial' WHEN {one_edit_sql('p.a', 'p.b')} THEN 'edit1' ELSE 'none' END"


def given_pairs(w: DataFrame) -> DataFrame:
    """Candidate pairs of words that may be one given name: a short form, a beginning (an initial is one), one edit apart, or an anagram."""
    keys = F.transform(fz.name_groups(F.col("w")), lambda k: k.cast("string")), fz.anagram(F.col("w"))
    return sm.keyed_pairs(w, "w", *keys).union(sm.prefix_pairs(w, "w")).union(sm.edit_pairs(w, "w", 1).select("a", "b")).distinct()


@query("sf09_sf10_sf12_given_names", f"WITH {NICK_SQL}, {WORDS_SQL.replace('w AS (SELECT', 'v AS (SELECT')}, w AS (SELECT w FROM v UNION SELECT substr(w, 1, 1) FROM v UNION SELECT name FROM nick), {PAIRS_SQL}, r AS (SELECT p.a, p.b, {RELATION_SQL} AS relation, {related_sql('p.a', 'p.b', 'n.a IS NOT NULL')} AS related FROM p LEFT JOIN nicks n ON n.a = p.a AND n.b = p.b) SELECT * FROM r WHERE relation <> 'none' OR related")
def given_names(t):
    """The tables' words and their initials, and the names that have short forms: the pairs that are related."""
    names = t.spark.createDataFrame([(n,) for some in fz.nickname_groups() for n in some], "w string")
    v = words(t)
    every = en.checkpointed(v.union(v.select(F.substring("w", 1, 1))).union(names).distinct())
    a, b = F.col("a"), F.col("b")
    return given_pairs(every).select("a", "b", fz.first_relation(a, b, F.array(a), F.array(b)).alias("relation"), fz.related_given(a, b).alias("related")).filter("relation <> 'none' or related")


#: People: a row for each name and type that occurs.
PEOPLE_SQL = "q AS (SELECT DISTINCT p_name, p_type FROM part), e AS (SELECT row_number() OVER (ORDER BY p_name, p_type) AS id, split_part(p_name, ' ', 1) AS first, split_part(p_name, ' ', 2) AS last, lower(p_type) AS firm, CASE WHEN p_type > 'M' THEN list_distinct([split_part(p_name, ' ', 1), lower(p_type)]) ELSE [split_part(p_name, ' ', 1)] END AS given FROM q)"


def people(t) -> DataFrame:
    q = row_numbers(t.part.select("p_name", "p_type").distinct(), "id", "p_name", "p_type")
    first, firm = F.split("p_name", " ")[0], F.lower("p_type")
    return q.select("id", first.alias("first"), F.split("p_name", " ")[1].alias("last"), firm.alias("firm"), F.when(F.col("p_type") > "M", F.array_distinct(F.array(first, firm))).otherwise(F.array(first)).alias("given"))


def sides(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    return e.toDF(*(f"{c}_a" for c in e.columns)), e.toDF(*(f"{c}_b" for c in e.columns))


def both_ways(pairs: DataFrame, w: DataFrame) -> DataFrame:
    """(x, y): the pairs in both orders, and each word with itself."""
    return en.checkpointed(pairs.select("a", "b").toDF("x", "y").union(pairs.select("b", "a")).union(w.select("w", "w")).distinct())


def people_words(e: DataFrame) -> DataFrame:
    return en.checkpointed(e.select(F.explode(F.array("first", "last")).alias("w")).distinct())


def person_pairs(e: DataFrame) -> DataFrame:
    """Pairs of people (columns with _a and _b) that are the same person by surname and initial, also with the names of a swapped. Similar surnames are
    found among the distinct names; people then meet by surname and initial, so that only pairs meet that are wanted."""
    w = people_words(e)
    near = name_pairs(w, False)
    near = both_ways(near.filter(fz.same_surname(F.col("a"), F.col("b"))), w)
    a, b = sides(e)
    b = b.withColumns({"y": F.col("last_b"), "k": F.substring("first_b", 1, 1)})
    straight = a.join(near, F.col("x") == F.col("last_a")).withColumn("k", F.substring("first_a", 1, 1))
    swapped = a.join(near, F.col("x") == F.col("first_a")).withColumn("k", F.substring("last_a", 1, 1))
    one = en.checkpointed(straight.union(swapped).drop("x").distinct())
    return sm.met_pairs(one, en.checkpointed(b), ["y", "k"], "id_a", "id_b", ordered=False).drop("y", "k").filter("id_a <> id_b").dropDuplicates(["id_a", "id_b"])


ANY_PAIRS_SQL = f"{PEOPLE_SQL}, p AS (SELECT a.id AS id_a, b.id AS id_b, a.first AS first_a, b.first AS first_b, a.last AS last_a, b.last AS last_b, a.firm AS firm_a, b.firm AS firm_b, a.given AS given_a, b.given AS given_b FROM e a JOIN e b ON a.id < b.id)"
SAME_PERSON_SQL = f"({surname_sql('last_a', 'last_b')} AND {initial_sql('first_a', 'first_b')}) OR ({surname_sql('first_a', 'last_b')} AND {initial_sql('last_a', 'first_b')})"


@query("sf05_sf06_same_person", f"WITH {ANY_PAIRS_SQL} SELECT id_a, id_b, last_a = last_b AND first_a = first_b AS strict FROM p WHERE {SAME_PERSON_SQL}")
def same_person(t):
    """The pairs of people that are the same one, and whether by the strict rule too."""
    names = [F.col(c) for c in ("last_a", "first_a", "last_b", "first_b")]
    pairs = person_pairs(en.checkpointed(people(t))).filter("id_a < id_b").filter(fz.same_person(*names))
    return pairs.select("id_a", "id_b", fz.same_person(*names, strict=True).alias("strict"))


LEVEL_REL = f"CASE WHEN first_a = first_b THEN 'exact' WHEN n.a IS NOT NULL THEN 'nick' WHEN (len(list_intersect(given_a, given_b)) = len(given_a) OR len(list_intersect(given_a, given_b)) = len(given_b)) AND len(list_intersect(given_a, given_b)) > 0 THEN 'subset' WHEN {one_edit_sql('first_a', 'first_b')} THEN 'edit1' ELSE 'none' END"


@query("sf11_sf12_sf13_pair_level", f"WITH {NICK_SQL}, {ANY_PAIRS_SQL}, r AS (SELECT p.*, {LEVEL_REL} AS relation, last_a = last_b AS exact, last_a <> last_b AND {sounds_sql('last_a', 'last_b')} AS near, {sounds_sql('first_a', 'last_b')} AND {sounds_sql('first_b', 'last_a')} AS swap, CASE WHEN firm_a = firm_b THEN 'context' ELSE 'weak' END AS ctx, len(list_intersect(given_a, given_b)) > 0 OR len(list_filter(given_a, lambda x: len(list_filter(given_b, lambda y: {related_sql('x', 'y', 'false')})) > 0)) > 0 AS compatible FROM p LEFT JOIN nicks n ON n.a = first_a AND n.b = first_b), l AS (SELECT id_a, id_b, relation, compatible, CASE WHEN NOT exact AND NOT near AND swap THEN ctx WHEN NOT (exact OR near) OR relation = 'none' THEN NULL WHEN exact AND relation IN ('exact', 'nick') THEN 'strong' ELSE ctx END AS level FROM r) SELECT * FROM l WHERE level IS NOT NULL")
def pair_level(t):
    """The pairs of people with any evidence that they are one. Similar names are found among the distinct ones; people then meet by surname with a first name that is
    related or with a shared given name, or with both names swapped."""
    e = en.checkpointed(people(t))
    w = people_words(e)
    last = both_ways(name_pairs(w, True).filter(fz.sounds_like(F.col("a"), F.col("b"))), w)
    x, y = F.col("a"), F.col("b")
    first = both_ways(given_pairs(w).filter(fz.first_relation(x, y, F.array(x), F.array(y)) != "none"), w)
    a, b = sides(e)
    named = lambda pairs, x, y: pairs.toDF(x, y)
    one = a.join(named(last, "last_a", "l"), "last_a").select("id_a", "l", F.col("first_a").alias("f")).join(named(first, "f", "k"), "f").select("id_a", "l", F.concat(F.lit("f "), "k").alias("k"))
    two = a.join(named(last, "last_a", "l"), "last_a").select("id_a", "l", F.explode(F.transform("given_a", lambda g: F.concat(F.lit("g "), g))).alias("k"))
    three = a.join(named(last, "first_a", "l"), "first_a").join(named(last, "last_a", "f"), "last_a").select("id_a", "l", F.concat(F.lit("s "), "f").alias("k"))
    wanted = b.select("id_b", F.col("last_b").alias("l"), F.explode(F.concat(F.array(F.concat(F.lit("f "), "first_b"), F.concat(F.lit("s "), "first_b")), F.transform("given_b", lambda g: F.concat(F.lit("g "), g)))).alias("k"))
    met = sm.met_pairs(en.checkpointed(one.union(two).union(three).distinct()), en.checkpointed(wanted), ["l", "k"], "id_a", "id_b").select("id_a", "id_b").distinct()
    pairs = met.join(a, "id_a").join(b, "id_b")
    la, fa, lb, fb = (F.col(c) for c in ("last_a", "first_a", "last_b", "first_b"))
    pairs = pairs.withColumn("relation", fz.first_relation(fa, fb, F.col("given_a"), F.col("given_b")))
    level = fz.pair_level(la, fa, lb, fb, F.col("relation"), F.col("firm_a") == F.col("firm_b"))
    return pairs.select("id_a", "id_b", "relation", fz.lists_compatible(F.col("given_a"), F.col("given_b")).alias("compatible"), level.alias("level")).filter("level is not null")


STOP_SQL = ", ".join(f"'{w}'" for w in tx.FIRM_STOP)
FIRMS_SQL = f"f AS (SELECT DISTINCT CASE p_size % 4 WHEN 0 THEN 'The Law Offices of ' || p_name || ', P.C.' WHEN 1 THEN split_part(p_name, ' ', 1) || ' & ' || p_type || ' LLP' WHEN 2 THEN split_part(p_name, ' ', 2) || ', P.L.L.C.' ELSE p_name || ' and ' || p_type || ' Associates, a Law Group' END AS firm FROM part), g AS (SELECT firm, list_sort(list_distinct(list_filter(regexp_extract_all(lower(firm), '[a-z]+'), lambda x: length(x) > 1 AND x NOT IN ({STOP_SQL})))) AS s FROM f), p AS (SELECT a.firm AS a, b.firm AS b, a.s AS x, b.s AS y, len(list_intersect(a.s, b.s)) AS n FROM g a JOIN g b ON a.firm < b.firm AND len(a.s) > 0 AND len(b.s) > 0)"
FIRM_RULES_SQL = "CASE WHEN len(x) = 1 AND len(y) = 1 THEN levenshtein(x[1], y[1]) <= 1 ELSE false END AS single, n = len(x) OR n = len(y) OR n / (len(x) + len(y) - n) >= 0.5 AS like_"


@query("sf07_sf08_r01_r10_firms", f"WITH {FIRMS_SQL}, r AS (SELECT *, {FIRM_RULES_SQL} FROM p) SELECT a, b, CASE WHEN len(x) = 1 AND len(y) = 1 THEN single ELSE n >= 2 AND like_ END AS careful FROM r WHERE single OR like_")
def firms(t):
    """The pairs of firms that one rule or both take for one, by the words that tell firms apart: sets of which one holds the other or that share half of their
    words come from a similarity join, single words one edit apart from the index of words."""
    first, last, size = F.split("p_name", " ")[0], F.split("p_name", " ")[1], F.col("p_size") % 4
    name = F.when(size == 0, F.concat(F.lit("The Law Offices of "), "p_name", F.lit(", P.C."))).when(size == 1, F.concat(first, F.lit(" & "), "p_type", F.lit(" LLP")))
    name = name.when(size == 2, F.concat(last, F.lit(", P.L.L.C."))).otherwise(F.concat("p_name", F.lit(" and "), "p_type", F.lit(" Associates, a Law Group")))
    f = en.checkpointed(t.part.select(name.alias("firm")).distinct().withColumn("s", tx.firm_tokens(F.col("firm"))))
    # half of the union is half of the smaller set at least
    like = sm.similar_sets(f, "firm", "s", 0.5, "overlap").select("a", "b")
    single = en.checkpointed(f.filter(F.size("s") == 1).select("firm", F.col("s")[0].alias("w")))
    near = both_ways(sm.edit_pairs(single, "w", 1), single.select("w").distinct())
    ones = single.select(F.col("firm").alias("a"), F.col("w").alias("x")).join(near, "x").join(single.select(F.col("firm").alias("b"), F.col("w").alias("y")), "y").filter("a < b").select("a", "b")
    side = lambda c, s: f.select(F.col("firm").alias(c), F.col("s").alias(s))
    pairs = like.union(ones).distinct().join(side("a", "x"), "a").join(side("b", "y"), "b")
    return pairs.filter(fz.same_firm(F.col("x"), F.col("y"))).select("a", "b", fz.same_firm_careful(F.col("x"), F.col("y")).alias("careful"))


FULL_SQL = "n AS (SELECT p_partkey, CASE p_size % 5 WHEN 1 THEN 'van ' WHEN 2 THEN 'de la ' WHEN 3 THEN 'St. ' ELSE '' END || CASE WHEN p_size % 4 = 0 THEN split_part(p_name, ' ', 1) ELSE split_part(p_name, ' ', 2) END AS last, split_part(p_name, ' ', 1) AS first, CASE p_size % 7 WHEN 1 THEN ' Jr' WHEN 2 THEN ', Sr.' WHEN 3 THEN ' II' WHEN 4 THEN ' iii' WHEN 5 THEN ' IV.' WHEN 6 THEN ' V' ELSE '' END AS mark FROM part), m AS (SELECT *, upper(first) || ' X. ' || last || mark AS whole FROM n), k AS (SELECT *, list_filter(regexp_extract_all(lower(last), '[a-z]+'), lambda x: x NOT IN ('de', 'del', 'della', 'van', 'von', 'der', 'den', 'da', 'di', 'la', 'le', 'st', 'saint', 'jr', 'sr', 'ii', 'iii', 'iv', 'v')) AS kept FROM m)"


@query("p18_p19_p20_p21_names", f"WITH {FULL_SQL}, s AS (SELECT *, array_to_string(kept, '') AS key FROM k) SELECT p_partkey, key, coalesce(CASE p_size % 7 WHEN 1 THEN 'jr' WHEN 2 THEN 'sr' WHEN 3 THEN '2' WHEN 4 THEN '3' WHEN 5 THEN '4' WHEN 6 THEN '5' END, '') AS gen, CASE WHEN first = key THEN '' ELSE first END AS first, array_to_string(list_filter([first, 'x', CASE WHEN p_size % 4 = 0 THEN split_part(p_name, ' ', 1) ELSE split_part(p_name, ' ', 2) END], lambda x: x <> key), ' ') AS given FROM s JOIN part USING (p_partkey)")
def names(t):
    """Names with particles and generation marks; where the size divides by four, the surname repeats the first name."""
    first, size = F.split("p_name", " ")[0], F.col("p_size")
    particle = F.when(size % 5 == 1, "van ").when(size % 5 == 2, "de la ").when(size % 5 == 3, "St. ").otherwise("")
    last = F.concat(particle, F.when(size % 4 == 0, first).otherwise(F.split("p_name", " ")[1]))
    mark = F.when(size % 7 == 1, " Jr").when(size % 7 == 2, ", Sr.").when(size % 7 == 3, " II").when(size % 7 == 4, " iii").when(size % 7 == 5, " IV.").when(size % 7 == 6, " V").otherwise("")
    n = t.part.select("p_partkey", first.alias("f"), last.alias("l"), F.concat(F.upper(first), F.lit(" X. "), last, mark).alias("whole"))
    whole, f, ln = F.col("whole"), F.col("f"), F.col("l")
    return n.select("p_partkey", tx.surname_key(ln).alias("key"), tx.generation(whole).alias("gen"), tx.salvaged_first(f, ln).alias("first"), F.array_join(tx.given_tokens(whole, ln), " ").alias("given"))


@query("p35_p36_f10_roles", "SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'management' WHEN 'PROMO' THEN 'lead; management' ELSE '' END AS roles, CASE WHEN p_type = 'PROMO' THEN 'Lead' WHEN p_type = 'ECONOMY' THEN 'Management' ELSE 'Other' END AS bucket, CASE WHEN p_size % 3 = 0 THEN false WHEN p_size % 3 = 1 THEN true ELSE p_size % 2 = 0 END AS individual FROM part")
def roles(t):
    """Coordination counts as management; whoever has a stated kind is that, others are individuals if they have a name."""
    said = F.when(F.col("p_type") == "ECONOMY", "Coordination; junk").when(F.col("p_type") == "PROMO", "lead,coordination;management").otherwise("junk")
    r = tx.reconciled_roles(tx.roles(said, ("lead", "coordination", "management")))
    bucket = F.when(F.array_contains(r, "lead"), "Lead").when(F.array_contains(r, "management"), "Management").otherwise("Other")
    size = F.col("p_size")
    kind = F.when(size % 3 == 0, " Firm ").when(size % 3 == 1, "INDIVIDUAL")
    return t.part.select("p_partkey", F.array_join(r, "; ").alias("roles"), bucket.alias("bucket"), tx.is_individual(kind, F.when(size % 2 == 0, F.col("p_name")), F.lit(" ")).alias("individual"))


@query("p49_a04_display_name", "WITH c AS (SELECT p_brand, p_type, p_name, count(*) AS n, min(p_partkey) AS seen FROM part WHERE p_size % 5 > 0 GROUP BY ALL), m AS (SELECT p_brand, p_type, p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY n DESC, seen) AS rk FROM c) WHERE rk = 1) SELECT g.p_brand, g.p_type, coalesce(p_name, lower(g.p_type) || ' ' || g.p_brand) AS display FROM (SELECT DISTINCT p_brand, p_type FROM part) g LEFT JOIN m ON m.p_brand = g.p_brand AND m.p_type = g.p_type")
def display_name(t):
    """The most frequent full name, the first seen among equals; without one, first and last name. Some rows have no full name."""
    full = t.part.withColumn("full", F.when(F.col("p_size") % 5 > 0, F.col("p_name")))
    c = full.groupBy("p_brand", "p_type", "full").agg(F.count("full").alias("n"), F.min("p_partkey").alias("seen"))
    top = F.max_by("full", F.when(F.col("full").isNotNull(), F.struct("n", -F.col("seen"))))
    return c.groupBy("p_brand", "p_type").agg(top.alias("top")).select("p_brand", "p_type", F.coalesce("top", F.concat_ws(" ", F.lower("p_type"), "p_brand")).alias("display"))


@query("p42_p43_p44_render", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'male' WHEN c_custkey % 3 = 1 THEN 'female' ELSE '' END AS gender, CASE WHEN c_nationkey % 4 > 0 THEN 'NY; CA' ELSE '' END AS bars, CASE WHEN c_custkey % 2 = 0 THEN CAST(1950 + c_nationkey AS VARCHAR) ELSE '' END AS born, lower(c_mktsegment) || '|' || 'customer' AS key FROM customer")
def render(t):
    """Gold values to a record (m and f spelt out, lists split) and back to a row (lists joined, unknown empty), with a first and last word key."""
    gold = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "m").when(F.col("c_custkey") % 3 == 1, "F").otherwise("unknown").alias("g"), F.when(F.col("c_nationkey") % 4 > 0, "NY ;CA; ").otherwise("").alias("bars"), F.when(F.col("c_custkey") % 2 == 0, (F.col("c_nationkey") + 1950).cast("string")).otherwise("unknown").alias("born"), F.concat_ws(" ", "c_mktsegment", F.lit("Q."), "c_name", F.lit("Jr.")).alias("name"))
    code = F.lower("g")
    record = gold.select("c_custkey", "name", F.struct(F.when(code == "m", "male").when(code == "f", "female").alias("gender"), F.filter(F.transform(F.split("bars", ";"), lambda x: F.trim(x)), lambda x: x != "").alias("bars"), F.col("born").try_cast("int").alias("born")).alias("r"))
    parts = F.filter(F.regexp_extract_all(F.lower("name"), F.lit("([a-z]+)"), F.lit(1)), lambda x: (F.length(x) > 1) & ~x.isin(*tx.SUFFIXES))
    return record.select("c_custkey", F.coalesce("r.gender", F.lit("")).alias("gender"), F.array_join("r.bars", "; ").alias("bars"), F.coalesce(F.col("r.born").cast("string"), F.lit("")).alias("born"), F.concat_ws("|", F.element_at(parts, 1), F.element_at(parts, -1)).alias("key"))


@query("p45_prompt_lines", "WITH c AS (SELECT p_brand, p_name, count(*) AS n FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_name) AS rk FROM c), m AS (SELECT p_brand, list_sort(list_distinct(list(p_size)))[1:10] AS sizes FROM part GROUP BY 1) SELECT r.p_brand, 'names: ' || string_agg(p_name, ', ' ORDER BY rk) FILTER (rk <= 3) || ' | groups: ' || array_to_string(any_value(sizes), ', ') AS line FROM r JOIN m USING (p_brand) GROUP BY 1")
def prompt_lines(t):
    """The three most frequent names and the first ten groups of each entity."""
    top = top_list(t.part.groupBy("p_brand", "p_name").agg(F.count("*").alias("n")), ["p_brand"], 3, F.col("p_name"), F.desc("n"), "p_name", name="names")
    groups = top_list(t.part.select("p_brand", "p_size").distinct(), ["p_brand"], 10, F.col("p_size").cast("string"), "p_size", name="sizes")
    line = F.concat(F.lit("names: "), F.array_join("names", ", "), F.lit(" | groups: "), F.array_join("sizes", ", "))
    return top.join(groups, "p_brand").select("p_brand", line.alias("line"))


@query("g02_mention_split", "WITH RECURSIVE x AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY k1, k2, g, tok) AS id FROM (SELECT DISTINCT l_suppkey AS k1, l_quantity AS k2, l_orderkey AS g, CASE WHEN p_size % 11 = 0 THEN '' ELSE p_brand END AS tok FROM lineitem JOIN part ON l_partkey = p_partkey)), e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM x a JOIN x b ON a.k1 = b.k1 AND a.k2 = b.k2 AND (a.tok = b.tok OR a.tok = '' OR b.tok = '' OR a.g = b.g)), r AS (SELECT id AS node, id AS reach FROM x UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a) SELECT node AS mention, min(reach) AS part FROM r GROUP BY 1")
def mention_split(t):
    """Mentions are the different brands that a supplier's lines of one quantity have in an order; some have no firm token."""
    part = t.part.select(F.col("p_partkey").alias("l_partkey"), F.when(F.col("p_size") % 11 == 0, "").otherwise(F.col("p_brand")).alias("tok"))
    line = t.lineitem.select("l_partkey", "l_suppkey", "l_quantity", F.col("l_orderkey").alias("grp"))
    tasks = enough(line, line.count())
    seen = dealt(line, tasks, "l_partkey").join(part, "l_partkey").select("l_suppkey", "l_quantity", "grp", "tok")
    seen = dealt(seen, tasks, "l_suppkey", "l_quantity", "grp", "tok").distinct()
    mentions = row_numbers(seen, "mention", "l_suppkey", "l_quantity", "grp", "tok", tasks=tasks)
    tokens = F.when(F.col("tok") == "", F.array().cast("array<string>")).otherwise(F.array("tok"))
    return en.split_mentions(en.checkpointed(mentions.select("mention", "l_suppkey", "l_quantity", "grp", tokens.alias("tokens"))), ["l_suppkey", "l_quantity"])


def incompatible(x, y):
    """Other generation marks, or given names that share none; a given name that is the other's surname is no conflict."""
    marks = (x("mark") != "") & (y("mark") != "") & (x("mark") != y("mark"))
    kin = F.array_contains(x("given"), y("last")) | F.array_contains(y("given"), x("last"))
    return marks | ~kin & ~F.arrays_overlap(x("given"), y("given"))


MARKED_SQL = f"{PEOPLE_SQL}, n AS (SELECT *, CASE id % 4 WHEN 0 THEN 'jr' WHEN 1 THEN 'sr' ELSE '' END AS mark FROM e), c AS (SELECT a.last AS grp, a.id AS a, b.id AS b, substr(a.first, 1, 1) <> substr(b.first, 1, 1) AS rank, (a.id + b.id) % 3 > 0 AS linked, (a.mark <> '' AND b.mark <> '' AND a.mark <> b.mark) OR (NOT list_contains(a.given, b.last) AND NOT list_contains(b.given, a.last) AND len(list_intersect(a.given, b.given)) = 0) AS apart FROM n a JOIN n b ON a.last = b.last AND a.id < b.id)"
GUARDED_SQL = f"WITH RECURSIVE {MARKED_SQL}, s AS (SELECT grp, a, b, row_number() OVER (PARTITION BY grp ORDER BY rank, a, b) AS k FROM c WHERE linked), bad AS (SELECT grp, list({{'x': a, 'y': b}}) AS bad FROM c WHERE apart AND NOT linked GROUP BY grp), g AS (SELECT last AS grp, list(id ORDER BY id) AS ids FROM n GROUP BY 1), r AS (SELECT grp, 0::BIGINT AS k, ids, ids AS own FROM g UNION ALL SELECT grp, k, ids, CASE WHEN la <> lb AND NOT veto THEN list_transform(own, lambda c: CASE WHEN c = greatest(la, lb) THEN least(la, lb) ELSE c END) ELSE own END FROM (SELECT *, la <> lb AND len(list_filter(coalesce(bad, []), lambda p: (own[list_position(ids, p.x)] = la AND own[list_position(ids, p.y)] = lb) OR (own[list_position(ids, p.x)] = lb AND own[list_position(ids, p.y)] = la))) > 0 AS veto FROM (SELECT r.grp, s.k, ids, own, bad, own[list_position(ids, a)] AS la, own[list_position(ids, b)] AS lb FROM r JOIN s ON s.grp = r.grp AND s.k = r.k + 1 LEFT JOIN bad ON bad.grp = r.grp))), z AS (SELECT grp, max_by(ids, k) AS ids, max_by(own, k) AS own FROM r GROUP BY grp) SELECT unnest(ids) AS node, unnest(own) AS cluster FROM z"


@query("g03_f23_guarded_clusters", GUARDED_SQL)
def guarded(t):
    """People with one surname are linked (but for a third of their pairs), those with the same first letter of the given name first."""
    e = en.checkpointed(people(t).withColumn("mark", F.when(F.col("id") % 4 == 0, "jr").when(F.col("id") % 4 == 1, "sr").otherwise("")))
    nodes = e.select(F.col("id").alias("node"), "given", "last", "mark")
    a, b = e.select("last", F.col("id").alias("a"), F.col("first").alias("first_a")), e.select("last", F.col("id").alias("b"), F.col("first").alias("first_b"))
    linked = sm.met_pairs(a, b, ["last"], "a", "b", twins=True).filter("(a + b) % 3 > 0")
    rank = (F.substring("first_a", 1, 1) != F.substring("first_b", 1, 1)).cast("int")
    return en.guarded(nodes, linked.select("a", "b", rank.alias("rank")), incompatible)


COLLAPSED_SQL = f"WITH RECURSIVE {PEOPLE_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY firm ORDER BY id) AS i FROM e), r AS (SELECT firm, 0::BIGINT AS i, NULL::BIGINT AS key, NULL::BIGINT AS rep, [{{'k': 0::BIGINT, 'first': '', 'last': ''}}] AS reps FROM (SELECT DISTINCT firm FROM e) UNION ALL SELECT firm, i, id, coalesce(found, id), CASE WHEN found IS NULL THEN list_append(reps, {{'k': id, 'first': first, 'last': last}}) ELSE reps END FROM (SELECT o.firm, o.i, o.id, o.first, o.last, reps, list_filter(reps, lambda z: z.k > 0 AND (({surname_sql('o.last', 'z.last')} AND {initial_sql('o.first', 'z.first')}) OR ({surname_sql('o.first', 'z.last')} AND {initial_sql('o.last', 'z.first')})))[1].k AS found FROM r JOIN o ON o.firm = r.firm AND o.i = r.i + 1)) SELECT firm AS grp, key, rep FROM r WHERE i > 0"


@query("g05_collapsed_people", COLLAPSED_SQL)
def collapsed(t):
    """Within a firm, a person is absorbed by the first representative that is the same one by surname and initial, also with the person's names swapped, or becomes one."""
    e = en.checkpointed(people(t))
    pairs = person_pairs(e).filter("firm_a = firm_b and id_a > id_b").filter(fz.same_person(*(F.col(c) for c in ("last_a", "first_a", "last_b", "first_b"))))
    found = en.first_come(e.select(F.col("id").alias("node")), en.checkpointed(pairs.select(F.col("id_b").alias("a"), F.col("id_a").alias("b"))))
    return e.select(F.col("firm").alias("grp"), F.col("id").alias("node")).join(found, "node").select("grp", F.col("node").alias("key"), F.col("seed").alias("rep"))


@query("g09_j27_replay", "WITH w AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT o_custkey, 'A' || lpad(CAST(row_number() OVER (ORDER BY n DESC, o_custkey) AS VARCHAR), 6, '0') AS id FROM w), d AS (SELECT l_orderkey, 'A' || lpad(CAST(dense_rank() OVER (ORDER BY n DESC, w.o_custkey) AS VARCHAR), 6, '0') AS id FROM lineitem JOIN orders o ON l_orderkey = o_orderkey JOIN w ON w.o_custkey = o.o_custkey WHERE l_returnflag <> 'A'), x AS (SELECT DISTINCT id FROM d) SELECT count(*) FILTER (x.id IS NULL) AS roster_only, count(*) FILTER (r.id IS NULL) AS derived_only, count(*) FILTER (r.id = x.id) AS both FROM r FULL JOIN x ON r.id = x.id")
def replay(t):
    """A roster of ids, and the ids derived anew from the rows of another table (ranked among those that it has): which of them differ."""
    weights = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    ids = lambda df: row_numbers(df, "no", F.desc("n"), F.col("o_custkey")).select("o_custkey", F.concat(F.lit("A"), F.lpad(F.col("no").cast("string"), 6, "0")).alias("id"))
    roster = ids(weights)
    seen = t.lineitem.filter("l_returnflag <> 'A'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().join(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey").select("o_custkey").distinct()
    derived = ids(weights.join(seen, "o_custkey"))
    both = roster.select("id", F.lit(True).alias("r")).join(derived.select("id", F.lit(True).alias("d")), "id", "full_outer")
    return both.agg(F.count_if(F.col("d").isNull()).alias("roster_only"), F.count_if(F.col("r").isNull()).alias("derived_only"), F.count_if(F.col("r") & F.col("d")).alias("both"))


BLOCKS_SQL = f"k AS (SELECT id, 1 AS no, array_to_string(list_sort(list_distinct([{soundex_sql('first')}, {soundex_sql('last')}])), '+') AS b, 40 AS cap FROM e UNION ALL SELECT id, 2, substr(last, 1, 3) || '|' || substr(first, 1, 1), 40 FROM e UNION ALL SELECT id, 2, substr(last, 1, 3) || '|*', 40 FROM e UNION ALL SELECT id, 3, firm, 60 FROM e WHERE firm IN (SELECT firm FROM e GROUP BY 1 HAVING count(*) <= 25) UNION ALL SELECT id, 4, array_to_string(list_sort([first, last]), '+'), 1000000000 FROM e UNION ALL SELECT id, 5, {sorted_sql('last')}, 40 FROM e UNION ALL SELECT id, 6, first || '|' || substr(last, 1, 1), 25 FROM e WHERE length(first) >= 4), ok AS (SELECT no, b FROM k GROUP BY no, b, cap HAVING count(*) <= cap), c AS (SELECT x.id AS a, y.id AS b, min(x.no) AS why FROM k x JOIN k y ON x.no = y.no AND x.b = y.b AND x.id < y.id JOIN ok ON ok.no = x.no AND ok.b = x.b GROUP BY 1, 2)"
SANE_SQL = f"(({soundex_sql('x.first')} = {soundex_sql('y.last')} AND {soundex_sql('y.first')} = {soundex_sql('x.last')}) OR ((x.last = y.last OR {soundex_sql('x.last')} = {soundex_sql('y.last')} OR levenshtein(x.last, y.last) <= 2 OR starts_with(x.last, y.last) OR starts_with(y.last, x.last)) AND (x.firm = y.firm OR {related_sql('x.first', 'y.first', 'n.a IS NOT NULL')} OR len(list_intersect(x.given, y.given)) > 0 OR len(list_filter(x.given, lambda p: len(list_filter(y.given, lambda q: {related_sql('p', 'q', 'false')})) > 0)) > 0)))"


@query("j15_six_blocks", f"WITH {NICK_SQL}, {PEOPLE_SQL}, {BLOCKS_SQL} SELECT c.a, c.b, c.why FROM c JOIN e x ON x.id = c.a JOIN e y ON y.id = c.b LEFT JOIN nicks n ON n.a = x.first AND n.b = y.first WHERE {SANE_SQL}")
def six_blocks(t):
    """Candidates from six kinds of blocks, each with its own largest size, that pass the check of names or context."""
    e = people(t)
    df = e.groupBy("firm").agg(F.count("*").alias("df"))
    e = e.join(df, "firm")
    first, last = F.col("first"), F.col("last")
    key = lambda no, cap, block, when=None: F.when(F.lit(True) if when is None else when, F.struct(F.lit(no).alias("no"), F.lit(cap).alias("cap"), block.alias("block")))
    keys = F.array(
        key(1, 40, F.array_join(F.array_sort(F.array_distinct(F.array(fz.soundex(first), fz.soundex(last)))), "+")),
        key(2, 40, F.concat_ws("|", F.substring(last, 1, 3), F.substring(first, 1, 1))),
        key(2, 40, F.concat(F.substring(last, 1, 3), F.lit("|*"))),
        key(3, 60, F.col("firm"), F.col("df") <= 25),
        key(4, 1_000_000_000, F.array_join(F.array_sort(F.array(first, last)), "+")),
        key(5, 40, fz.anagram(last)),
        key(6, 25, F.concat_ws("|", first, F.substring(last, 1, 1)), F.length(first) >= 4),
    )
    rows = e.select("id", F.explode(keys).alias("x")).filter("x is not null").select("id", "x.*")
    small = rows.groupBy("no", "block").agg(F.count("*").alias("n"), F.first("cap").alias("cap")).filter("n <= cap").select("no", "block")
    rows = rows.join(small, ["no", "block"]).select("no", "block", "id")
    pairs = rows.toDF("no", "block", "id_a").join(rows.toDF("no", "block", "id_b"), ["no", "block"]).filter("id_a < id_b").groupBy("id_a", "id_b").agg(F.min("no").alias("why"))
    a, b = sides(e.drop("df"))
    c = pairs.join(a, "id_a").join(b, "id_b")
    la, fa, lb, fb = (F.col(x) for x in ("last_a", "first_a", "last_b", "first_b"))
    near = (la == lb) | (fz.soundex(la) == fz.soundex(lb)) | (F.levenshtein(la, lb) <= 2) | la.startswith(lb) | lb.startswith(la)
    swapped = (fz.soundex(fa) == fz.soundex(lb)) & (fz.soundex(fb) == fz.soundex(la))
    given = fz.related_given(fa, fb) | fz.lists_compatible(F.col("given_a"), F.col("given_b"))
    return c.filter(swapped | near & (given | (F.col("firm_a") == F.col("firm_b")))).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "why")


@query("a27_both_duplicate_flags", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE), o_orderpriority) > 1 AS same_title, count(*) OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE)) > 1 AS same_day FROM orders")
def duplicate_flags(t):
    day = t.orders.select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"), "o_orderpriority")
    n = day.groupBy("o_custkey", "day", "o_orderpriority").agg(F.count("*").alias("n"))
    n = n.withColumn("all", F.sum("n").over(Window.partitionBy("o_custkey", "day")))
    return day.join(n, ["o_custkey", "day", "o_orderpriority"]).select("o_orderkey", (F.col("n") > 1).alias("same_title"), (F.col("all") > 1).alias("same_day"))
