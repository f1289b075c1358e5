"""Functions, sources, sinks and incremental runs on small fixtures."""

import json
import math

from pyspark.sql import functions as F

from docloom.functions import fuzzy, stats, text
from docloom.operators import entity, network, resolve
from docloom.sources import sinks, tabular
from docloom.streaming import incremental


def value(spark, column, **named):
    return spark.createDataFrame([tuple(named.values())], list(named)).select(column.alias("x")).first()["x"]


def test_chi_square_tails():
    assert math.isclose(stats.chi2_p(3.841, 1), 0.05, abs_tol=1e-4)
    assert math.isclose(stats.chi2_p(6.635, 1), 0.01, abs_tol=1e-4)
    assert math.isclose(stats.chi2_p(9.21, 2), 0.01, abs_tol=1e-4)
    x, df, p, v = stats.chi2([[10, 20], [20, 10]])
    assert math.isclose(x, 6.667, abs_tol=1e-3) and df == 1 and math.isclose(p, 0.0098, abs_tol=1e-4) and v > 0
    assert stats.chi2([[1, 0], [2, 0]]) == (0.0, 0, 1.0, 0.0)


def test_names(spark):
    assert value(spark, text.surname_key(F.col("a")), a="van der Berg Jr") == "berg"
    assert value(spark, text.firm_name(F.col("a")), a="Motley-Rice, LLP") == "motley rice"
    assert value(spark, text.title(F.col("a")), a="12_OrderOne_final (2).pdf") == "order one final"
    assert value(spark, text.ascii_fold(F.col("a")), a="Peña  O’Brién") == "Pena O'Brien"
    assert value(spark, fuzzy.same_surname(F.col("a"), F.col("b")), a="hellums", b="hellmich") is False
    assert value(spark, fuzzy.same_surname(F.col("a"), F.col("b")), a="mccarley", b="mccarle") is True


def test_initial_decides(spark):
    assert value(spark, fuzzy.related_given(F.col("a"), F.col("b")), a="k", b="thomas") is False


def test_name_rules(spark):
    c = F.col
    swap = lambda **n: value(spark, fuzzy.same_person(c("la"), c("fa"), c("lb"), c("fb")), **n)
    assert swap(la="berman", fa="steve", lb="steve", fb="berman") and not swap(la="smith", fa="ann", lb="smith", fb="bob")
    level = lambda la, fa, lb, fb, shared: value(spark, fuzzy.pair_level(c("la"), c("fa"), c("lb"), c("fb"), fuzzy.first_relation(c("fa"), c("fb"), F.array("fa"), F.array("fb")), F.lit(shared)), la=la, fa=fa, lb=lb, fb=fb)
    assert level("smith", "bill", "smith", "william", False) == "strong"
    assert level("mccarley", "ann", "mccauley", "ann", False) == "weak" and level("mccarley", "ann", "mccauley", "ann", True) == "context"
    assert level("smith", "ann", "smith", "tom", True) is None and level("berman", "steve", "steve", "berman", True) == "context"
    firms = lambda f, a, b: value(spark, f(text.tokens(c("a")), text.tokens(c("b"))), a=a, b=b)
    assert firms(fuzzy.same_firm, "weitz luxenberg", "weitz") and not firms(fuzzy.same_firm_careful, "weitz luxenberg", "weitz")
    assert firms(fuzzy.same_firm_careful, "pomeranz", "pomerantz") and not firms(fuzzy.same_firm_careful, "smith jones", "smith brown")
    assert value(spark, text.generation(c("a")), a="Smith, Jr.") == "jr" and value(spark, text.generation(c("a")), a="Smith V") == "5" and value(spark, text.generation(c("a")), a="Olev") == ""
    assert value(spark, text.salvaged_first(c("a"), c("b")), a="Zapala", b="Zapala") == ""
    assert [value(spark, fuzzy.related_given(c("a"), c("b")), a=a, b=b) for a, b in (("aimee", "amiee"), ("sandy", "alexandra"), ("sandy", "cindy"), ("", "tom"))] == [True, True, False, True]
    assert value(spark, text.docket_number(c("a")), a="US_DIS_NYSD_05md1654_10_order.pdf") == "10" and value(spark, text.docket_number(c("a")), a="2428, Doc. 33, x.pdf") == "33"


def test_statistics_against_definitions():
    """Tails by plain integration of their densities."""
    def area(f, a, b, n=200_000):
        h = (b - a) / n
        return h * sum(f(a + (k + 0.5) * h) for k in range(n))

    for x, df in ((0.5, 1), (3.0, 2), (4.0, 3), (20.0, 7), (9.0, 10)):
        density = lambda t, d=df: t ** (d / 2 - 1) * math.exp(-t / 2) / (2 ** (d / 2) * math.gamma(d / 2))
        assert math.isclose(stats.chi2_p(x, df), area(density, x, x + 120), rel_tol=1e-5)
    # [1, 2, 2, 5] against [2, 3, 4]: average ranks 1, 3, 3, 7 and 3, 5, 6
    u, p = stats.mann_whitney(1 + 3 + 3 + 7, 4, 3, 3**3 - 3)
    z = (4 - 6) / math.sqrt(4 * 3 / 12 * (8 - 24 / 42))
    assert u == 4 and math.isclose(p, math.erfc(-z / math.sqrt(2)))
    assert stats.two_proportions(1, 2, 1, 2) == (0.0, 1.0) and stats.two_proportions(0, 0, 1, 2) == (0.0, 1.0) and stats.mann_whitney(3, 2, 0, 0)[1] == 1.0


def test_guarded_clusters_by_brute_force(spark):
    import random

    from docloom.plans.people import incompatible

    def excluded(x, y):
        if x["mark"] and y["mark"] and x["mark"] != y["mark"]:
            return True
        return x["last"] not in y["given"] and y["last"] not in x["given"] and not set(x["given"]) & set(y["given"])

    rng = random.Random(5)
    rows = [(k, rng.sample(["ann", "bob", "cid", "dora"], rng.randint(1, 2)), rng.choice(["ann", "lee", "ray"]), rng.choice(["", "", "jr", "sr"])) for k in range(16)]
    pairs = sorted({(rng.randint(0, 1), *sorted(rng.sample(range(16), 2))) for _ in range(20)})
    seen, edges = set(), []
    for r, a, b in pairs:
        if (a, b) not in seen:
            seen.add((a, b))
            edges.append((a, b, r))
    of = {k: {k} for k in range(16)}
    at = {r[0]: dict(zip(("node", "given", "last", "mark"), r, strict=True)) for r in rows}
    for a, b, _ in sorted(edges, key=lambda e: (e[2], e[0], e[1])):
        if of[a] is of[b] or any((min(x, y), max(x, y)) not in seen and excluded(at[x], at[y]) for x in of[a] for y in of[b]):
            continue
        whole = of[a] | of[b]
        for k in whole:
            of[k] = whole
    got = entity.guarded(spark.createDataFrame(rows, "node long, given array<string>, last string, mark string"), spark.createDataFrame(edges, "a long, b long, rank int"), incompatible).collect()
    assert {frozenset(x.node for x in got if x.cluster == c) for c in {r.cluster for r in got}} == {frozenset(s) for s in of.values()} and len(got) == 16


def test_sequential_rules_by_brute_force(spark):
    edges = [("g", 1, 1, 5), ("g", 1, 2, 9), ("g", 2, 2, 8), ("g", 2, 1, 1), ("g", 3, 1, 5), ("h", 1, 1, 0)]
    got = entity.greedy_match(spark.createDataFrame(edges, "grp string, a long, b long, score long")).collect()
    assert sorted(map(tuple, got)) == [("g", 1, 2), ("g", 3, 1), ("h", 1, 1)]
    import random

    rng = random.Random(2)
    many = [(rng.choice("gh"), rng.randrange(25), rng.randrange(25), rng.randrange(9)) for _ in range(300)]
    taken, want = set(), []
    for grp, a, b, _ in sorted(many, key=lambda e: (-e[3], e[1], e[2])):
        if not {(grp, "a", a), (grp, "b", b)} & taken:
            taken |= {(grp, "a", a), (grp, "b", b)}
            want.append((grp, a, b))
    got = entity.greedy_match(spark.createDataFrame(many, "grp string, a long, b long, score long")).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    tokens = [("p", 1, ["a", "b"]), ("p", 2, ["b"]), ("p", 3, ["c"]), ("p", 4, ["a", "c", "d"]), ("p", 5, [])]
    got = entity.greedy_seeds(spark.createDataFrame(tokens, "g string, k long, t array<string>"), "k", "g", "t").collect()
    assert {r.key: r.seed for r in got} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}


def test_recognition_falls_back(spark):
    from docloom.operators.external import recognised

    def remote(chunk, key):
        if key == 2:
            raise TimeoutError
        return chunk.upper()

    df = spark.createDataFrame([(1, "a" * 25), (2, "b" * 5), (3, "c" * 200), (4, None)], "k long, text string")
    got = {r.k: (r.text, r.source, r.chunks) for r in recognised(df, "k", "text", remote, lambda chunk, key: chunk).collect()}
    assert got == {1: ("A" * 25, "ocr", 3), 2: ("b" * 5, "local", 1), 3: ("c" * 200, "text layer", 1), 4: ("", "ocr", 1)}


def test_chart(spark):
    rows = spark.createDataFrame([("a<", 1.0), ("b", 3.0)], "k string, v double")
    assert sinks.chart(rows, "k", "v", "t").count("<rect") == 2 and "a&lt;" in sinks.chart(rows, "k", "v", "t")
    assert "<polyline" in sinks.chart(rows, "k", "v", "t", "line") and 'fill-opacity="1.000"' in sinks.chart(rows, "k", "v", "t", "heat")


def test_row_numbers_and_ranges(spark):
    from docloom.operators.ranks import row_numbers

    rows = row_numbers(spark.range(1_000).select(((F.col("id") * 7919) % 1_000).alias("x")), "no", F.desc("x")).collect()
    assert all(r.no == 1_000 - r.x for r in rows) and row_numbers(spark.range(0), "no", F.col("id")).count() == 0


def test_as_of_is_strictly_earlier(spark):
    left = spark.createDataFrame([(1, 5), (1, 3), (2, 5)], "k int, t int")
    right = spark.createDataFrame([(1, 3, 30), (1, 4, 40), (1, 5, 50)], "k int, t int, v int")
    assert {(r.k, r.t): r.v for r in resolve.as_of(left, right, "k", "t", "v").collect()} == {(1, 5): 40, (1, 3): None, (2, 5): None}


def test_guard_vetoes_merges(spark):
    nodes = spark.createDataFrame([(1, "jr"), (2, ""), (3, "sr"), (4, "")], "node long, mark string")
    edges = spark.createDataFrame([(1, 2, 0), (2, 3, 0)], "a long, b long, rank int")
    other = lambda x, y: (x("mark") != "") & (y("mark") != "") & (x("mark") != y("mark"))
    got = {r.node: r.cluster for r in entity.guarded(nodes, edges, other).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_components_of_a_chain(spark):
    n = 40
    nodes = spark.range(n).withColumnRenamed("id", "node")
    edges = nodes.filter(f"node < {n - 1}").select(F.col("node").alias("a"), (F.col("node") + 1).alias("b"))
    assert entity.connected(nodes, edges).select("component").distinct().count() == 1


def test_permutation_keeps_places(spark):
    slate = spark.createDataFrame([(g, m) for g in range(6) for m in range(g % 3 + 1)], "g long, m long")
    assert network.permuted(slate, 5).count() == 5


def test_csv_with_byte_order_mark(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿Name,Age\nAnn,\"1\n2\"\n".encode())
    assert [tuple(r) for r in tabular.read_csv(spark, str(tmp_path / "a.csv"), ["name", "age"]).collect()] == [("Ann", "1\n2")]


def test_tolerant_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1}\n\n{"k": 2}\n{"k": ')
    assert sorted(r.k for r in tabular.read_jsonl(spark, str(tmp_path), "k long", strict=False).collect()) == [1, 2]


def test_document_pages_in_order(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"relpath": "a", "n_pages": 2, "pages": [{"page": 2, "text": "b"}, {"page": 1, "text": "a"}]}))
    assert tabular.read_documents(spark, str(tmp_path)).first()["text"] == "a\nb"


def test_file_scan(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.PDF").write_bytes(b"1")
    (tmp_path / "y.txt").write_bytes(b"1")
    assert tabular.scan_files(spark, str(tmp_path)).count() == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    sinks.write_csv(df, str(tmp_path / "c"), ["v", "k", "missing"])
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["v", "k", "missing"]
    old, new = spark.createDataFrame([(1, 5), (2, 5)], "k int, v int"), spark.createDataFrame([(1, 5), (3, 1)], "k int, v int")
    assert sorted(map(tuple, sinks.upserted(old, new, "k", F.col("v")).collect())) == [(1, 5), (2, 5), (3, 1)]


def test_stream_runs_new_files_once(spark, tmp_path):
    source, sink, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    step = lambda df: df.filter("k > 1")
    for n, k in enumerate((1, 2, 3)):
        (source / f"{n}.json").write_text(json.dumps({"k": k}) + "\n")
        incremental.run_new_files(spark, str(source), "k long", state, sink, step)
    incremental.run_new_files(spark, str(source), "k long", state, sink, step)
    assert sorted(r.k for r in spark.read.parquet(sink).collect()) == [2, 3]


def test_retry_policy(spark):
    todo = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    log = spark.createDataFrame([(1, "ok"), (2, "error")], "k int, status string")
    assert sorted(r.k for r in incremental.remaining(todo, log, "k").collect()) == [3]
    assert sorted(r.k for r in incremental.remaining(todo, log, "k", ("error",)).collect()) == [2, 3]


def test_external_calls(spark):
    from docloom.operators import external

    df = spark.createDataFrame([(k, f"t{k}") for k in range(30)], "k long, text string")
    cache = spark.createDataFrame([(1, "cached")], "k long, verdict string")
    call = external.batched(lambda some: [x.upper() for x in some][:13], "text", "verdict", empty="unsure")
    got = {r.k: r.verdict for r in external.with_cache(df.coalesce(1), cache, "k", "verdict", "k long, verdict string", call).collect()}
    assert got[1] == "cached" and got[0] == "T0" and list(got.values()).count("unsure") == 2
    assert external.retried(lambda: 1 / 0, otherwise="x")() == "x"
    assert external.first_available(["a", "b"], lambda n: n == "b") == "b"
    second = spark.createDataFrame([(0, "same")], "k long, verdict string")
    assert {r.k: r.verdict for r in external.overridden(cache.union(second.selectExpr("k", "'unsure'")), second, "k", "verdict").collect()} == {1: "cached", 0: "same"}


def test_probe_and_reports(spark, tmp_path):
    (tmp_path / "12-x").mkdir()
    (tmp_path / "12-x" / "a.pdf").write_bytes(b"abc")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path))
    assert [r.n for r in tabular.probe(files, len).collect()] == [3] and [r.n for r in tabular.probe(files, lambda c: 1 / 0).collect()] == [-1]
    assert tabular.grouped_files(files).first()["grp"] == "12"
    assert "| n |" in sinks.report(spark.range(1).withColumnRenamed("id", "n"), "x") and "bigint" in sinks.dictionary(spark.range(1))


def test_as_of_keeps_every_supplier(spark, tmp_path):
    """The query's rows over all suppliers, against brute force."""
    from docloom import registry

    rows = [(k, k % 3, s, (7 * k + s) % 50, f"1995-01-{1 + (5 * k + s) % 9:02d}", "RN"[k % 2]) for k in range(12) for s in (3, 20, 75)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_linenumber long, l_suppkey long, l_partkey long, l_shipdate string, l_returnflag string")
    lines.withColumn("l_shipdate", F.to_timestamp("l_shipdate")).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted((r.l_orderkey, r.l_suppkey, r.prev) for r in registry.QUERIES["j20_as_of"](spark, str(tmp_path)).collect())
    last = lambda s, d: max(((x[4], x[3]) for x in rows if x[5] == "R" and x[2] == s and x[4] < d), default=(None, None))[1]
    assert got == sorted((k, s, last(s, d)) for k, _, s, _, d, _ in rows)
