"""Personal data: base patterns, then bootstrapped contextual extraction.

DataFrame functions only. Base matches are the seeds. A whole base match, or elsewhere a run of digit groups or a token with a
digit or an at sign, and the two words before it make an edge (pattern, instance) of a graph over all documents; patterns are scored by the share of their instances that are known,
instances by their best pattern, in rounds; tokens behind patterns of high confidence become spans of the pattern's kind.

Cases: a null or empty text has no spans; a row that is there twice has its spans twice; very long runs of one kind of
character, and addresses of any number of labels, are read once (no pattern starts inside a run); an empty table gives no rows; columns other than id and text are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, lookup

# The base patterns, in the order of the report. Each starts where a run of its first characters starts, or
# where the match before has ended, which is where the leftmost match of the plain pattern starts; a card is a whole chain of
# 14 to 19 digits, with shorter and longer chains left out at once. Repeated groups are possessive: the regex engine then loops, while
# a greedy group recurses once per repeat and ends the JVM on a text with some thousands of them.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "phone": "+"}
# What may be an identifier: a whole run of digit groups with their separators, which ends where a sentence does and before an ip
# or a card, and may start behind a label as in "tel:"; else a run of non-space with a digit or an at sign.
GROUP = r"[0-9]++(?:[().-]++[0-9]++)*+(?=[^\x20\x09-\x0D\p{L}\p{N}@]*+(?![^\x20\x09-\x0D]))"
RUN = rf"{GROUP}(?:[()-]*+\x20++(?!{PATTERNS['ip']}|{PATTERNS['card']})[().-]*+{GROUP})*+"
TOKEN = (
    rf"""(?<![^\x20\x09-\x0D:=<\[{{"'])\+?+[().-]*+{RUN}"""
    rf"""|(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+(?!(?<=[:=<\[{{"'][+().-]{{0,3}}){RUN})[0-9@][^\x20\x09-\x0D]*+"""
)
#: The two words before an identifier, which stands behind white space and opening marks or right behind the second word.
CONTEXT = r"""(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D0-9@]++[\x20\x09-\x0D]++[^\x20\x09-\x0D0-9@]++)(?:[\x20\x09-\x0D]++[<(\[{"'+]*+)?+\z"""
#: Rounds; distinct known instances that a pattern needs; its least confidence; digits that a discovered token needs.
ROUNDS, SUPPORT, CONFIDENCE, DIGITS = 3, 3, 0.8, 4


def valid(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.substring(F.concat(F.lit("000"), p), -3, 3) <= "255"))
    if kind == "card":
        value = lambda c, i: F.ascii(c) - 48
        twice = lambda c, i: F.when(value(c, i) < 5, 2 * value(c, i)).otherwise(2 * value(c, i) - 9)
        each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, value(c, i)).otherwise(twice(c, i)))
        return F.aggregate(each, F.lit(0), lambda s, x: s + x) % 10 == 0
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def matches(text: Column, kind: str, pattern: str) -> Column:
    """Every match with the length of the text before it (from the match before), its own length, the two words before it and itself."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    # in one array, so that a text is split once and not for each of its matches
    pairs = F.filter(F.arrays_zip(found.alias("found"), between.alias("before")), lambda z: z["found"].isNotNull())
    # a match before it is no word
    ahead = lambda z, i: F.concat(F.when(i > 0, "0").otherwise(""), z["before"])
    words = lambda z, i: F.lower(F.regexp_extract(ahead(z, i), CONTEXT, 1))
    ok = lambda x: F.lit(True) if kind == "token" else valid(kind, x)
    bare = lambda x: F.regexp_replace(F.regexp_replace(x, r"\A[^A-Za-z0-9@+]++", ""), r"(?<![^A-Za-z0-9])[^A-Za-z0-9]++\z", "")
    core = lambda x: F.lower(bare(x) if kind == "token" else x)
    more = lambda z, i: (ok(z["found"]).alias("ok"), F.regexp_replace(words(z, i), r"[\x20\x09-\x0D]+", " ").alias("context"), core(z["found"]).alias("core"))
    no = KINDS.index(kind) if kind in KINDS else len(KINDS)
    each = F.transform(pairs, lambda z, i: F.struct(F.lit(no).alias("kind"), i.alias("k"), F.length(z["before"]).alias("gap"), F.length(z["found"]).alias("long"), *more(z, i)))
    can = text.contains(NEEDS[kind]) if kind in NEEDS else text.rlike("[0-9@]" if kind == "token" else "[0-9]")
    return F.when(can, each)


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The one pass over the texts: a durable row per document with its matches of all kinds."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kinds = [*PATTERNS.items(), ("token", TOKEN)]
    rows = rows.select("doc_id", *(matches(F.col("text"), k, p).alias(k) for k, p in kinds))
    rows = rows.select("doc_id", F.filter(F.array(*(k for k, _ in kinds)), lambda x: x.isNotNull()).alias("found"))
    return durable(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.flatten("found").alias("found")), "pii-scan")


def placed(scanned: DataFrame) -> DataFrame:
    """A row per base match, and per token that overlaps none: row, kind, start, end, context, core, and a base match's kind as seed."""
    one = scanned.select("row", F.explode("found").alias("m")).select("row", "m.*")
    upto = Window.partitionBy("row", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("long")).over(upto)
    spans = one.withColumn("end", end).withColumn("start", F.col("end") - F.col("long")).filter("ok").drop("gap", "long", "ok", "k")
    base = F.when(F.col("kind") < len(KINDS), F.struct("end", "start", "kind"))
    order = Window.partitionBy("row").orderBy("start", F.col("kind"))
    # backwards, as a frame up to the last row is summed anew for each row
    back = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("kind"))
    before = F.max(base).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(F.col("kind") < len(KINDS), F.struct("start", "end", "kind"))).over(back.rowsBetween(Window.unboundedPreceding, 0))
    over = (before["end"] > F.col("start")) | (after["start"] < F.col("end"))
    spans = spans.withColumn("over", F.coalesce(over, F.lit(False))).filter((F.col("kind") < len(KINDS)) | ~F.col("over")).drop("over")
    return spans.withColumn("seed", F.when(F.col("kind") < len(KINDS), F.col("kind")))


def bootstrapped(found: DataFrame) -> DataFrame:
    """(context, kind) of the patterns of high confidence, from the matches (context, core, seed) of all documents."""
    edges = found.filter("context <> '' and core <> ''").groupBy("context", "core").agg(F.max("seed").alias("seed"))
    sizes = durable(edges.groupBy("context").agg(F.count("*").alias("n")).filter(f"n >= {SUPPORT}"), "pii-patterns")
    total = max(1, sizes.agg(F.sum("n")).first()[0] or 0)
    graph = durable(lookup(edges, sizes, ["context"], "n", total, "inner").drop("n").select("context", "core", "seed", F.col("seed").alias("kind"), F.when(F.col("seed").isNotNull(), 1.0).otherwise(0.0).alias("score")), "pii-graph")
    best = None
    for _ in range(ROUNDS):
        mass = graph.filter("score > 0").groupBy("context", "kind").agg(F.sum("score").alias("mass"), F.count("*").alias("known"))
        top = mass.groupBy("context").agg(F.max_by(F.struct("kind", "known"), F.struct("mass", -F.col("kind"))).alias("top"), F.max("mass").alias("mass"))
        best = sizes.join(top, "context").select("context", "n", F.col("top.kind").alias("pattern_kind"), (F.col("mass") / F.col("n")).alias("confidence"), F.col("top.known").alias("known"))
        best = durable(best.filter(f"known >= {SUPPORT} and confidence >= {CONFIDENCE}"), "pii-best")
        scored = lookup(graph, best.select("context", "n", "pattern_kind", "confidence"), ["context"], "n", total).drop("n")
        reach = scored.filter("confidence is not null and seed is null").groupBy("core").agg(F.max(F.struct("confidence", "pattern_kind")).alias("by"), F.count("*").alias("c"))
        reach = durable(reach, "pii-reach")
        new = lookup(graph, reach, ["core"], "c", total)
        score = F.when(F.col("seed").isNotNull(), 1.0).otherwise(F.coalesce("by.confidence", F.lit(0.0)))
        graph = durable(new.select("context", "core", "seed", F.coalesce("seed", "by.pattern_kind").alias("kind"), score.alias("score")), "pii-graph")
    return best.select("context", "pattern_kind", "n")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, base (array of start, no, kind, end) and spans (those and the discovered ones), sorted."""
    scanned = scan(docs, id_col, text_col)
    spans = durable(placed(scanned), "pii-spans")
    tokens = spans.filter("seed is null and context <> ''")
    known = bootstrapped(spans)
    hits = durable(tokens.groupBy("context").agg(F.count("*").alias("hits")).join(known, "context").drop("n"), "pii-hits")
    fresh = lookup(tokens, hits, ["context"], "hits", spans.count(), "inner")
    fresh = fresh.filter((F.length(F.regexp_replace("core", "[^0-9]", "")) >= DIGITS) | F.col("core").contains("@"))
    span = F.struct("start", F.col("no"), F.element_at(F.array(*map(F.lit, KINDS)), F.col("no") + 1).alias("kind"), "end")
    base = spans.filter(F.col("kind") < len(KINDS)).select("row", "start", "end", F.col("kind").alias("no"), F.lit(True).alias("base"))
    every = base.unionByName(fresh.select("row", "start", "end", F.col("pattern_kind").alias("no"), F.lit(False).alias("base")))
    # the matches of one document, which its text bounds
    grouped = every.groupBy("row").agg(F.sort_array(F.collect_list(F.when(F.col("base"), span))).alias("base"), F.sort_array(F.collect_list(span)).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,no:int,kind:string,end:bigint>>")
    return scanned.select("row", "doc_id").join(grouped, "row", "left").select("doc_id", F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))


def listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame, **columns: str) -> DataFrame:
    found = find_pii(docs, **columns)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"))
