"""Host-level quality rules: failures by host, rates shrunk by an empirical beta prior, verdicts joined back to documents.

DataFrame functions only. Words are runs of anything but the six ASCII white-space characters.

Cases: a null or empty text has no words and fails; a null source is a host of its own; a row that is there twice counts twice;
an empty table gives no rows; columns other than id, text and source are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, durable, lookup

#: Words in a window, least words of a document, most percent of repeated words.
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
#: Rules whose failures count against a host, besides those of the base.
HOST_RULES = {"f_short": f"n_words < {LEAST_WORDS}", "f_repeat": f"100 * n_repeat_words > {MOST_REPEATED} * n_words", "f_symbols": "10 * n_symbols > n_words and n_words > 0", "f_lines": "10 * n_dup_lines > 3 * n_lines and n_lines > 0"}
#: A host is rejected if a shrunk failure rate is above this; the prior's weight in documents is held in these limits.
HOST_RATE, PRIOR = 0.5, (1.0, 1e6)


def window_hashes(words: Column) -> Column:
    """A hash of each window of the words."""
    at = F.sequence(F.lit(0), F.size(words) - WINDOW)
    return F.when(F.size(words) >= WINDOW, F.transform(at, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW))))).otherwise(F.array().cast("array<bigint>"))


def covered(places: Column) -> Column:
    """Words in the windows that begin at the sorted places."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda s, i: F.struct((s["n"] + i + WINDOW - F.greatest(s["end"], i)).alias("n"), (i + WINDOW).alias("end"))
    return F.aggregate(places, zero, step, lambda s: s["n"])


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("host"), text.alias("text"))
    blank = " \t\n\x0b\x0c\r"
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(blank)) != "")
    rows = rows.select("doc_id", "host", F.array_remove(F.split("text", f"{SPACE}+"), "").alias("words"), lines.alias("lines"), F.length(F.regexp_replace("text", f"{SPACE}+", "")).cast("long").alias("word_chars"), F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"))
    rows = rows.select("doc_id", "host", "word_chars", "n_symbols", F.size("words").cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"), F.size(F.array_distinct("lines")).cast("long").alias("distinct_lines"), F.transform("words", lambda w: F.xxhash64(w)).alias("marks"))
    rows = rows.withColumn("windows", window_hashes(F.col("marks"))).drop("marks")
    rows = rows.withColumn("some", F.size(F.array_distinct("windows")) < F.size("windows"))
    rows = rows.withColumn("sorted", F.when(F.col("some"), F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    twin = lambda s, k: (F.get("sorted", k - 1)["x"] == s["x"]) | (F.get("sorted", k + 1)["x"] == s["x"])
    rows = rows.withColumn("places", F.sort_array(F.transform(F.filter("sorted", lambda s, k: F.coalesce(twin(s, k), F.lit(False))), lambda s: s["i"])))
    return rows.select("doc_id", "host", "n_words", "word_chars", "n_symbols", (F.col("n_lines") - F.col("distinct_lines")).alias("n_dup_lines"), F.when(F.col("some"), covered(F.col("places"))).otherwise(0).cast("long").alias("n_repeat_words"), "n_lines")


def host_verdicts(rows: DataFrame) -> DataFrame:
    """(host, n, accepted) with every rule's shrunk rate. The prior of a rule is fitted to all hosts by moments: mean and variance of
    the hosts' rates, weighted by documents. Of the variance only what goes beyond the binomial noise of H hosts with N documents tells
    hosts apart: rho = (var / (mean * (1 - mean)) - H / N) / (1 - H / N), and the prior weighs 1 / rho - 1 documents. Where nothing is beyond it,
    as with one document a host, the prior has its greatest weight. Only the rules' sums and the number of hosts come to the driver."""
    rules = list(HOST_RULES)
    hosts = durable(rows.groupBy("host").agg(F.count("*").alias("n"), *(F.count_if(F.expr(HOST_RULES[r])).alias(r) for r in rules)), "quality-hosts")
    sums = hosts.agg(F.sum("n").alias("n"), F.count("*").alias("hosts"), *(F.sum(r).alias(r) for r in rules)).first()
    n = max(1, sums["n"] or 0)
    mean = {r: (sums[r] or 0) / n for r in rules}
    spread = hosts.agg(*(F.sum(F.col("n") * F.pow(F.col(r) / F.col("n") - mean[r], 2)).alias(r) for r in rules)).first()
    noise = sums["hosts"] / n
    rates = []
    for r in rules:
        own = mean[r] * (1 - mean[r])
        rho = ((spread[r] or 0.0) / n / own - noise) / (1 - noise) if own > 0 and noise < 1 else 0.0
        weight = min(PRIOR[1], max(PRIOR[0], 1 / rho - 1)) if rho > 0 else PRIOR[1]
        rates.append(((F.col(r) + mean[r] * weight) / (F.col("n") + weight)).alias(f"rate_{r[2:]}"))
    out = hosts.select("host", "n", *rates)
    return durable(out.withColumn("accepted", F.greatest(*(F.col(c) for c in out.columns[2:])) <= HOST_RATE), "quality-verdicts")


def quality(docs: DataFrame, **columns: str) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    rows = durable(features(docs, **columns), "quality-features")
    key = F.struct(F.col("host").isNull().alias("none"), F.coalesce("host", F.lit("")).alias("name"))
    verdicts = host_verdicts(rows).select(key.alias("key"), "n", "accepted")
    out = lookup(rows.withColumn("key", key), verdicts, ["key"], "n", rows.count(), "inner")
    failed = F.expr(f"{HOST_RULES['f_short']} or {HOST_RULES['f_repeat']}")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("accepted")).alias("kept"))


SQL = r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT doc_id, i, array_to_string(list_slice(words, i, i + 4), ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g),
p AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM r WHERE c > 1) GROUP BY doc_id),
f AS (SELECT w.doc_id, source, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines FROM w LEFT JOIN p USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f),
h AS (SELECT source, count(*) AS n, unnest(['short', 'repeat', 'symbols', 'lines']) AS rule, unnest([count(*) FILTER (n_words < 10),
  count(*) FILTER (100 * n_repeat_words > 20 * n_words), count(*) FILTER (10 * n_symbols > n_words AND n_words > 0),
  count(*) FILTER (10 * n_dup_lines > 3 * n_lines AND n_lines > 0)]) AS bad FROM b GROUP BY source),
m AS (SELECT rule, sum(bad) / sum(n) AS mean FROM h GROUP BY rule),
v AS (SELECT rule, mean, sum(n * (bad / n - mean) ** 2) / sum(n) AS var, count(*) / sum(n) AS noise FROM h JOIN m USING (rule) GROUP BY rule, mean),
q AS (SELECT rule, mean, CASE WHEN mean > 0 AND mean < 1 AND noise < 1 THEN (var / (mean * (1 - mean)) - noise) / (1 - noise) ELSE 0.0 END AS rho FROM v),
k AS (SELECT rule, mean, CASE WHEN rho > 0 THEN least(1e6, greatest(1.0, 1 / rho - 1)) ELSE 1e6 END AS weight FROM q),
a AS (SELECT source, max((bad + mean * weight) / (n + weight)) <= 0.5 AS accepted FROM h JOIN k USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND accepted AS kept
FROM b JOIN a ON b.source IS NOT DISTINCT FROM a.source
"""
