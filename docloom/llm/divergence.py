"""Audit of how far sources diverge in their terms, by joint histograms of counts.

Terms are runs of A-Z, a-z and non-ASCII characters, A-Z in lower case. Each language keeps the terms of at least DOCS of its documents. A
group (language, source) gives a kept term the share 1 + floor(SCALE * (count + 2) / (N + 2 * V)), and two shares p and q differ by
floor((p - q) ** 2 / (p + q)). Over the terms of a language, two sources meet in few different combinations of counts: for each pair these are tallied, the
cells with a zero follow from what the sources have alone, and the difference is evaluated once per combination, times the number of its terms.
All numbers are whole: shares come from decimals, so that counts may be of any size.

Cases: null text, language and source count as ''; a row that is there twice is two documents; a text without terms still makes its group occur;
a group without kept terms has counts of 0; a language without kept terms has values of 0 and no terms; very long texts are read in chunks; an
empty table gives no rows; columns other than text, lang and source are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checked, durable, map_arrow

#: Documents that a kept term has at least; scale of the shares; terms listed for a group.
DOCS, SCALE, TOP = 10, 1_000_000_000, 10
#: Bytes of text read at a time; terms that a task holds before it passes them on; counts of terms that it tallies at a time; sources of a cell of the grid of pairs.
CHUNK, HELD, ENTRIES, GRID = 1 << 22, 400_000, 200_000, 1_000
_TERM = re.compile(rb"[a-z\x80-\xff]+")
_GAP = re.compile(rb"[^A-Za-z\x80-\xff]")


def chunks(data: bytes) -> Iterator[bytes]:
    """The text in pieces that end between terms."""
    at = 0
    while len(data) - at > CHUNK:
        gap = _GAP.search(data, at + CHUNK)
        if gap is None:
            break
        yield data[at : gap.start()]
        at = gap.end()
    yield data[at:] if at else data


def counted(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, summed within each task; a null term for each group that occurs."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from docloom.llm.divergence import _TERM, HELD, chunks

        counts: dict[tuple, tuple[Counter, Counter]] = {}

        def passed() -> Iterator:
            for (lang, source), (n, d) in counts.items():
                k = len(n)
                if k:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * k), pa.array([source] * k), pa.array(n.keys(), pa.binary()), pa.array(n.values(), pa.int64()), pa.array(map(d.__getitem__, n), pa.int64())], names=["lang", "source", "term", "n", "docs"])
            counts.clear()

        seen = set()
        for batch in batches:
            for lang, source, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                n, d = counts.setdefault((lang, source), (Counter(), Counter()))
                seen.add((lang, source))
                own = set()
                for part in chunks(text):
                    terms = _TERM.findall(part.lower())
                    n.update(terms)
                    own.update(terms)
                d.update(own)
            if sum(len(n) for n, _ in counts.values()) > HELD:
                yield from passed()
        yield from passed()
        for lang, source in seen:
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([source]), pa.array([None], pa.binary()), pa.array([0], pa.int64()), pa.array([0], pa.int64())], names=["lang", "source", "term", "n", "docs"])

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).cast("binary").alias("text"))
    return map_arrow(rows, run, "lang string, source string, term binary, n long, docs long")


def kept_terms(found: DataFrame, least: int = DOCS) -> DataFrame:
    """(lang, term, source, n) of the kept terms. A term's rows, one per task and source at most, are dealt once by language and term."""
    dealt = found.filter("term is not null").repartition("lang", "term")
    each = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    df = F.sum("docs").over(Window.partitionBy("lang", "term"))
    return each.withColumn("df", df).filter(F.col("df") >= least).select("lang", F.col("term").cast("string").alias("term"), "source", "n")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), exactly."""
    whole = F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")
    return F.when(terms > 0, F.call_function("div", whole, (total + 2 * terms).cast("decimal(20,0)")) + 1).otherwise(F.lit(1).cast("long"))


def difference(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def tallied(t, s, n) -> tuple:
    """Columns a, b, ca, cb, m: for each pair of sources a < b the combinations of their counts over the terms that both have. t, s and n are the
    term, source and count of each entry, in order of terms."""
    import numpy as np

    t = np.cumsum(np.diff(t, prepend=t[:1]) != 0)
    # counts by number, so that a combination of two is one number
    values, v = np.unique(n, return_inverse=True)
    order = np.argsort(s, kind="stable")
    sources, starts = np.unique(s[order], return_index=True)
    own = [(t[k], v[k]) for k in np.split(order, starts[1:])]
    found: list[list] = [[], [], [], [], []]
    line = np.full(t[-1] + 1, -1, np.int64)
    for i, (ti, vi) in enumerate(own):
        line[ti] = vi
        for j in range(i + 1, len(own)):
            tj, vj = own[j]
            met = line[tj]
            both = met >= 0
            code, m = np.unique(met[both] * len(values) + vj[both], return_counts=True)
            if len(code):
                for col, x in zip(found, (np.full(len(code), sources[i]), np.full(len(code), sources[j]), values[code // len(values)], values[code % len(values)], m), strict=True):
                    col.append(x)
        line[ti] = -1
    return tuple(np.concatenate(c) if c else np.zeros(0, np.int64) for c in found)


def joint_histograms(kept: DataFrame) -> DataFrame:
    """(lang, a, b, ca, cb, n): of the sources a < b by number, the terms that both have, by their two counts. kept: lang, term, src, n. A task gets
    whole terms and tallies some tens of thousands of entries at a time."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        from docloom.llm.divergence import ENTRIES, tallied

        def out(lang: int, t, s, n) -> Iterator:
            cols = tallied(t, s, n)
            for at in range(0, len(cols[0]), 100_000):
                own = [c[at : at + 100_000] for c in cols]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own[0]), lang), pa.int32()), *(pa.array(c, pa.int32()) for c in own[:2]), *(pa.array(c, pa.int64()) for c in own[2:])], names=["lang", "a", "b", "ca", "cb", "n"])

        held, rows, lang, base, last = [], 0, None, 0, None
        for batch in batches:
            langs, terms, size = batch.column(0).to_numpy(), batch.column(1), len(batch)
            if not size:
                continue
            new = np.ones(size, bool)
            new[1:] = pc.not_equal(terms.slice(1), terms.slice(0, size - 1)).to_numpy(zero_copy_only=False) | (langs[1:] != langs[:-1])
            new[0] = (langs[0], terms[0].as_py()) != last
            last = langs[-1], terms[size - 1].as_py()
            t = base + np.cumsum(new)
            base = t[-1]
            s, n = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            edges = [0, *(np.flatnonzero(langs[1:] != langs[:-1]) + 1), size]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if langs[lo] != lang and held:
                    yield from out(lang, *map(np.concatenate, zip(*held, strict=True)))
                    held, rows = [], 0
                lang = langs[lo]
                held.append((t[lo:hi], s[lo:hi], n[lo:hi]))
                rows += hi - lo
                if rows >= ENTRIES:
                    every = [*map(np.concatenate, zip(*held, strict=True))]
                    # the last term may go on
                    cut = np.searchsorted(every[0], every[0][-1])
                    if cut:
                        yield from out(lang, *(x[:cut] for x in every))
                    held, rows = [tuple(x[cut:] for x in every)], len(every[0]) - cut
        if held:
            yield from out(lang, *map(np.concatenate, zip(*held, strict=True)))

    dealt = kept.select("lang", "term", "src", "n").repartition("lang", "term").sortWithinPartitions("lang", "term", "src")
    found = map_arrow(dealt, run, "lang int, a int, b int, ca long, cb long, n long")
    return found.groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("n").alias("n"))


def audit(docs: DataFrame, least: int = DOCS, top: int = TOP, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: for each group the other sources of its language by the difference summed over all kept terms
    (part `pair`), and the `top` terms by which it stands out most from its language (part `term`)."""
    found = durable(counted(docs, text_col, lang_col, source_col), "audit-counts")
    # languages and groups by number: names of any length are joined in here once, and again at the end
    langs = found.select("lang").distinct()
    langs = durable(langs.withColumn("l", F.row_number().over(Window.orderBy("lang"))), "audit-langs")
    groups = found.select("lang", "source").distinct().join(langs, "lang")
    groups = durable(groups.withColumn("src", F.row_number().over(Window.partitionBy("lang").orderBy("source"))), "audit-groups")
    terms = kept_terms(found, least).join(checked(groups), ["lang", "source"]).select(F.col("l").alias("lang"), "term", "src", "n")
    kept = durable(terms, "audit-kept")
    of_lang = kept.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    sizes = of_lang.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_total"))
    totals = kept.groupBy("lang", "src").agg(F.sum("n").alias("total"), F.count("*").alias("own"))
    known = groups.select(F.col("l").alias("lang"), "src", F.col("lang").alias("lang_name"), "source").join(sizes, "lang", "left").join(totals, ["lang", "src"], "left")
    known = durable(known.fillna(0, ["v", "lang_total", "total", "own"]), "audit-groups")

    # pairs: cells that both have, and the zero cells that follow from what each has alone
    side = lambda s: known.select("lang", F.col("src").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("total", "own")), "v")
    grid = 1 + known.count() // GRID
    left = side("a").withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    right = side("b").drop("v").withColumn("cell", F.pmod(F.col("b"), F.lit(grid)))
    pairs = durable(left.join(right, ["lang", "cell"]).filter("a < b").drop("cell"), "audit-pairs")
    both = durable(joint_histograms(kept), "audit-joint")
    alone = durable(kept.groupBy("lang", "src", F.col("n").alias("c")).agg(F.count("*").alias("n")), "audit-alone")
    zero, cell = F.lit(0).cast("long"), ("lang", "a", "b", "ca", "cb", "n")
    of_a = pairs.select("lang", "a", "b").join(alone.withColumnRenamed("src", "a"), ["lang", "a"]).select("lang", "a", "b", F.col("c").alias("ca"), zero.alias("cb"), "n")
    of_b = pairs.select("lang", "a", "b").join(alone.withColumnRenamed("src", "b"), ["lang", "b"]).select("lang", "a", "b", zero.alias("ca"), F.col("c").alias("cb"), "n")
    empty = pairs.select("lang", "a", "b", zero.alias("ca"), zero.alias("cb"), (F.col("v") - F.col("own_a") - F.col("own_b")).alias("n"))
    taken = both.select("lang", "a", "b", F.explode(F.array(F.struct("ca", "cb", "n"), F.struct("ca", zero.alias("cb"), (-F.col("n")).alias("n")), F.struct(zero.alias("ca"), "cb", (-F.col("n")).alias("n")), F.struct(zero.alias("ca"), zero.alias("cb"), F.col("n")))).alias("x"))
    taken = taken.select("lang", "a", "b", F.col("x.ca").alias("ca"), F.col("x.cb").alias("cb"), F.col("x.n").alias("n"))
    cells = taken.unionByName(of_a.select(*cell)).unionByName(of_b.select(*cell)).unionByName(empty.select(*cell))
    cells = cells.groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("n").alias("n")).filter("n <> 0")
    met = cells.join(checked(pairs), ["lang", "a", "b"])
    value = difference(share(F.col("ca"), F.col("total_a"), F.col("v")), share(F.col("cb"), F.col("total_b"), F.col("v"))) * F.col("n")
    sums = durable(met.groupBy("lang", "a", "b").agg(F.sum(value).alias("value")), "audit-sums")
    sums = pairs.select("lang", "a", "b").join(sums, ["lang", "a", "b"], "left").select("lang", "a", "b", F.coalesce("value", zero).alias("value"))
    each = sums.unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    named = known.select("lang", F.col("src").alias("a"), "lang_name", "source").join(each, ["lang", "a"])
    named = named.join(known.select("lang", F.col("src").alias("b"), F.col("source").alias("item")), ["lang", "b"])
    by = Window.partitionBy("lang_name", "source").orderBy(F.desc("value"), "item")
    one = named.select(F.col("lang_name").alias("lang"), "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by).alias("rank"))

    # terms: against the language as a whole
    rated = kept.join(of_lang.withColumnRenamed("n", "lang_n"), ["lang", "term"]).join(checked(known), ["lang", "src"])
    p, q = share(F.col("n"), F.col("total"), F.col("v")), share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    rated = rated.withColumns({"p": p, "q": q}).filter("p > q").select("lang_name", "source", F.col("term").alias("item"), difference(F.col("p"), F.col("q")).alias("value"))
    # a group's best are found in each task before they meet
    two = rated.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top).select(F.col("lang_name").alias("lang"), "source", F.lit("term").alias("part"), "item", "value", "rank")
    return one.unionByName(two)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(term) AS v FROM (SELECT DISTINCT lang FROM d) LEFT JOIN k USING (lang) GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
cl AS (SELECT lang, term, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY lang, term),
n AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
nl AS (SELECT lang, sum(n) AS total FROM cl GROUP BY lang),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2) // (n.total + 2 * v.v) AS p
  FROM g JOIN k USING (lang) JOIN v USING (lang) JOIN n ON n.lang = g.lang AND n.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pl AS (SELECT cl.lang, cl.term, 1 + CAST(1000000000 AS HUGEINT) * (cl.n + 2) // (nl.total + 2 * v.v) AS q FROM cl JOIN nl USING (lang) JOIN v USING (lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
w AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, CAST((p.p - q) * (p.p - q) // (p.p + q) AS BIGINT) AS value FROM p JOIN pl USING (lang, term) WHERE p.n > 0 AND p.p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM o UNION ALL SELECT * FROM w))
SELECT * FROM r WHERE part = 'pair' OR rank <= 10
"""
