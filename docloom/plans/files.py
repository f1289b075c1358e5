"""Sources and sinks on whole driver tables: written by a sink, read back by a source, compared with the table by SQL."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from docloom.registry import query
from docloom.sources import sinks, snapshots, tabular
from docloom.sources.shared import folder
from docloom.streaming import incremental, tail


@query("k01_s04_csv_round_trip", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN ', \"quoted\"' || chr(10) || 'line' ELSE '' END AS c_mktsegment, CAST(NULL AS VARCHAR) AS missing FROM customer")
def csv_round_trip(t):
    """Every value as text, with quotes, commas and line ends inside; a column that the table lacks is null."""
    path = folder(t.spark, "csv")
    odd = F.when(F.col("c_custkey") % 2 == 0, F.lit(', "quoted"\nline')).otherwise("")
    columns = ["c_custkey", "c_name", "c_mktsegment", "missing"]
    sinks.write_csv(t.customer.withColumn("c_mktsegment", F.concat("c_mktsegment", odd)), path, columns)
    return tabular.read_csv(t.spark, path, columns)


@query("s06_p01_csv_inferred", "SELECT CAST(s_suppkey AS INTEGER) AS supplier_no, s_name AS supplier_name, s_acctbal AS balance_usd FROM supplier")
def csv_inferred(t):
    path = folder(t.spark, "csv")
    named = t.supplier.select(F.col("s_suppkey").alias(" Supplier No."), F.col("s_name").alias("Supplier  Name"), F.col("s_acctbal").alias("Balance (USD)"))
    sinks.write_csv(named, path, named.columns)
    return tabular.read_csv_inferred(t.spark, path)


@query("k06_s07_jsonl_round_trip", "SELECT event_id, event_type, value FROM events")
def jsonl_round_trip(t):
    path = folder(t.spark, "jsonl")
    sinks.write_jsonl(t.events.select("event_id", "event_type", "value"), path)
    return tabular.read_jsonl(t.spark, path, "event_id long, event_type string, value double")


@query("s08_st02_broken_lines", "SELECT event_id, event_type FROM events WHERE event_id % 7 <> 0")
def broken_lines(t):
    """A log with blank lines and lines cut off in the middle, as a writer that is still at work leaves them."""
    path = folder(t.spark, "log")
    line = F.to_json(F.struct("event_id", "event_type"))
    t.events.select(F.when(F.col("event_id") % 7 == 0, F.substring(line, 1, 12)).when(F.col("event_id") % 7 == 1, F.concat(line, F.lit("\n\n"))).otherwise(line).alias("value")).write.text(path)
    return tabular.read_jsonl(t.spark, path, "event_id long, event_type string", strict=False)


@query("k05_s09_nested_documents", "SELECT 'order-' || l_orderkey AS relpath, count(*) AS n_pages, string_agg(l_partkey || ':' || l_suppkey, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS text FROM lineitem GROUP BY l_orderkey")
def nested_documents(t):
    """A document per order with its pages out of order, in folders by status; read back with the pages sorted."""
    path = folder(t.spark, "documents")
    text = F.concat_ws(":", "l_partkey", "l_suppkey")
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    pages = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("text")))).alias("p"))
    pages = pages.select(F.concat(F.lit("order-"), "l_orderkey").alias("relpath"), F.size("p").alias("n_pages"), F.reverse(F.transform("p", lambda x, i: F.struct((i + 1).alias("page"), F.length(x["text"]).alias("chars"), F.lit("ocr").alias("source"), x["text"].alias("text")))).alias("pages"), F.pmod("l_orderkey", F.lit(4)).alias("grp"))
    sinks.write_by_group(pages, path, "grp")
    read = tabular.read_documents(t.spark, path, multi_line=False)
    return read.select("relpath", F.col("n_pages").cast("long").alias("n_pages"), "text")


@query("k07_s10_tabs", "SELECT 'nation' AS tab, n_name AS name FROM nation UNION ALL SELECT 'region', r_name FROM region")
def tabs(t):
    """A tab for each table; each is read by its name."""
    path = folder(t.spark, "tabs")
    sinks.write_tabs({"nation": t.nation, "region": t.region}, path)
    read = lambda tab, c: tabular.read_tab_folder(t.spark, path, tab).select(F.lit(tab).alias("tab"), F.col(c).alias("name"))
    return read("nation", "n_name").union(read("region", "r_name"))


@query("k03_replaced", "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey % 2 = 1")
def replaced(t):
    """A table that is replaced as a whole; readers go by its pointer."""
    path = folder(t.spark, "replaced")
    for side in (0, 1):
        snapshots.replace(t.supplier.filter(F.col("s_nationkey") % 2 == side).select("s_suppkey", "s_name"), path)
    return snapshots.read(t.spark, path)


@query("k03_k04_snapshot_upsert", "WITH n AS (SELECT o_custkey, o_orderkey, o_totalprice, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) SELECT 3 AS version, o_custkey, o_orderkey, o_totalprice FROM n WHERE k = 1")
def snapshot_upsert(t):
    """Each customer's last order, from thirds of the orders that are put into a table one after the other; older versions are cleared away."""
    path = folder(t.spark, "upserted")
    for third in range(3):
        some = t.orders.filter(F.col("o_orderkey") % 3 == third).select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
        latest = some.groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_totalprice", "o_orderdate"), F.struct("o_orderdate", "o_orderkey")).alias("x")).select("o_custkey", "x.*")
        version = snapshots.upsert(latest, path, "o_custkey", F.struct("o_orderdate", "o_orderkey"))
    snapshots.vacuum(t.spark, path, 1)
    return snapshots.read(t.spark, path).select(F.lit(version).alias("version"), "o_custkey", "o_orderkey", "o_totalprice")


@query("s01_s02_file_scan", "SELECT n_regionkey AS grp, count(*) AS files, CAST(sum(length(n_name)) AS BIGINT) AS bytes FROM nation GROUP BY 1")
def file_scan(t):
    """A file per nation in a folder per region; counted from the listing alone."""
    path = folder(t.spark, "scan")
    rows = t.nation.select(F.lpad(F.col("n_nationkey").cast("string"), 3, "0").alias("file"), F.concat(F.col("n_regionkey").cast("string"), F.lit("-region")).alias("dir"), "n_name")
    sinks.write_files(rows, path, "dir", "file", "n_name", ".PDF")
    files = tabular.scan_files(t.spark, path)
    return tabular.grouped_files(files).groupBy(F.col("grp").cast("long").alias("grp")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


@query("s05_newest_file", "SELECT s_suppkey, CASE WHEN s_nationkey % 3 = 0 THEN 'a' ELSE 'z' END || s_name AS text FROM supplier")
def newest_file(t):
    """A file for each supplier, and later for a third of them another one whose name sorts before it: the newest by time counts."""
    path = folder(t.spark, "newest")
    rows = t.supplier.select(F.lit("all").alias("dir"), F.col("s_suppkey").cast("string").alias("key"), "s_name", "s_nationkey")
    for name, some in (("z", rows), ("a", rows.filter("s_nationkey % 3 = 0"))):
        sinks.write_files(some.select("dir", F.concat("key", F.lit(f"-{name}")).alias("file"), F.concat(F.lit(name), "s_name").alias("body")), path, "dir", "file", "body", ".pdf")
        time.sleep(0.05)  # file systems keep milliseconds
    files = t.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    last = tabular.newest(files.select("path", "modificationTime"), F.regexp_extract("path", r"(\d+)-[az]\.pdf$", 1))
    return last.join(files.select("path", F.col("content").cast("string").alias("text")), "path").select(F.col("stem").cast("long").alias("s_suppkey"), "text")


@query("s14_exclude_list", "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 7 <> 0")
def exclude_list(t):
    """Documents without those that a list names; the list is a file of ids, a line each, with blanks and comments."""
    path = folder(t.spark, "list")
    ids = t.documents.filter("doc_id % 3 = 0 or doc_id % 7 = 0").select(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("  "), F.col("doc_id").cast("string"), F.lit("  # seen"))).otherwise(F.col("doc_id").cast("string")).alias("value"))
    ids.union(t.spark.range(1).select(F.lit("# ids to leave out"))).union(t.spark.range(1).select(F.lit(""))).write.text(path)
    listed = tabular.id_list(t.spark, path).select(F.col("id").try_cast("long").alias("doc_id"))
    return t.documents.select("doc_id").join(listed, "doc_id", "left_anti")


@query("s03_probe", "SELECT n_name, CASE WHEN n_nationkey % 5 = 0 THEN -1 ELSE length(n_name) END AS n FROM nation")
def probe(t):
    """A measure of each file's bytes, -1 where it fails."""
    path = folder(t.spark, "probe")
    bad = F.when(F.col("n_nationkey") % 5 == 0, "!").otherwise("")
    sinks.write_files(t.nation.select(F.col("n_name").alias("file"), F.lit("all").alias("dir"), F.concat(bad, "n_name").alias("body")), path, "dir", "file", "body", ".pdf")

    def measure(content: bytes) -> int:
        if content.startswith(b"!"):
            raise ValueError("unreadable")
        return len(content)

    files = t.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return tabular.probe(files, measure).select(F.regexp_extract("path", r"([^/]+)\.pdf$", 1).alias("n_name"), "n")


@query("st01_three_retry_policies", "SELECT (SELECT count(*) FROM events) AS todo, count(*) FILTER (event_id % 3 > 1) AS errors_done, count(*) FILTER (event_id % 3 > 1 OR event_id % 6 = 1) AS errors_again, count(*) FILTER (event_id % 3 > 1) AS cached_again FROM events")
def retry_policies(t):
    """What is left to do if errors count as done, if errors are tried again, and if whatever is cached stays."""
    status = F.when(F.col("event_id") % 3 == 0, "ok").when(F.col("event_id") % 6 == 1, "error").when(F.col("event_id") % 6 == 4, "missing")
    log = t.events.select("event_id", status.alias("status")).filter("status is not null")
    todo = t.events.select("event_id")
    left = lambda *again: incremental.remaining(todo, log, "event_id", again).agg(F.count("*").alias("n"))
    one, two, three = (x.withColumnRenamed("n", c) for x, c in ((left(), "errors_done"), (left("error"), "errors_again"), (left("never"), "cached_again")))
    return todo.agg(F.count("*").alias("todo")).join(one).join(two).join(three)


@query("st03_st04_progress", "SELECT lang AS step, count(*) AS done, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1")
def progress(t):
    """Work done and its cost so far by kind, from a log whose lines come in any order."""
    return incremental.progress(t.documents.select(F.col("lang").alias("step"), F.col("n_chars").alias("cost")), "step", "cost").select("step", "done", F.col("cost").alias("chars"))


@query("st02_st03_growing_log", "SELECT event_type AS step, count(*) AS done, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS cost FROM events GROUP BY 1")
def growing_log(t):
    """Running costs from logs that grow while they are read: each log is written in three parts that end within a line, and a stream takes the whole lines that have come
    after each part; its state has the costs so far, which replace the table of the run before."""
    logs, state, out = (folder(t.spark, n) for n in ("logs", "state", "costs"))
    lines = t.events.select("event_id", F.to_json(F.struct(F.col("event_type").alias("step"), F.floor(F.col("value") * 100).cast("long").alias("cost"))).alias("line"))
    files = 2 + lines.count() // 200_000
    keep = lambda batch, number: snapshots.replace(batch, out)
    for part in range(3):
        write_logs(lines.withColumn("log", F.pmod("event_id", F.lit(files))), logs, part + 1, 3)
        costs = incremental.progress(tail.parsed(tail.lines(t.spark, logs, ".jsonl"), "step string, cost long"), "step", "cost")
        tail.run_available(costs, state, keep, "complete")
    return snapshots.read(t.spark, out)


def write_logs(lines, path: str, part: int, parts: int) -> None:
    """Each log's lines in order of their ids, up to the byte at part / parts of its length; a longer file takes the place of a shorter one."""

    def run(pdf):
        from pyarrow import fs
        from pyspark import TaskContext

        where, base = fs.FileSystem.from_uri(path)
        data = "".join(f"{x}\n" for x in pdf.sort_values("event_id")["line"]).encode()
        name, upto = f"{base}/{pdf['log'].iloc[0]}.jsonl", len(data) * part // parts
        where.create_dir(base, recursive=True)
        with where.open_output_stream(made := f"{name}.{TaskContext.get().taskAttemptId()}.tmp") as f:
            f.write(data[:upto])
        where.move(made, name)
        return pdf[["log"]].head(1)

    lines.groupBy("log").applyInPandas(run, "log long").write.format("noop").mode("overwrite").save()


@query("k11_data_dictionary", "SELECT * FROM (VALUES ('s_suppkey', 'bigint', 'number'), ('s_name', 'string', 'name of the supplier'), ('s_nationkey', 'int', '')) v(name, kind, meaning)")
def data_dictionary(t):
    """The dictionary of the supplier table, with the meanings that its columns carry, as a document that is written and read back."""
    meant = {"s_suppkey": "number", "s_name": "name of the supplier"}
    table = t.supplier.select(*(F.col(c).alias(c, metadata={"comment": meant.get(c, "")}) for c in ("s_suppkey", "s_name", "s_nationkey")))
    path = folder(t.spark, "dictionary")
    t.spark.createDataFrame([(x,) for x in sinks.dictionary(table).splitlines()], "value string").coalesce(1).write.text(path)
    cells = F.transform(F.split("value", r"\|"), lambda x: F.trim(x))
    read = t.spark.read.text(path).filter("value like '| %' and value not like '| column |%'").select(cells.alias("x"))
    return read.select(F.col("x")[1].alias("name"), F.col("x")[2].alias("kind"), F.col("x")[3].alias("meaning"))


@query("k09_k11_reports", "SELECT '| ' || r_name || ' | ' || (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) || ' |' AS line FROM region")
def reports(t):
    """The lines of a Markdown report of a small aggregate, without title and head."""
    n = t.nation.groupBy("n_regionkey").agg(F.count("*").alias("n"))
    metrics = t.region.join(n, F.col("r_regionkey") == F.col("n_regionkey")).select("r_name", "n")
    lines = [x for x in sinks.report(metrics, "nations").splitlines() if x.startswith("| ")][1:]
    return t.spark.createDataFrame([(x,) for x in lines], "line string")


@query("x10_s11_ocr_fallback", "SELECT doc_id, CASE WHEN length(text) >= 100 THEN 'text layer' WHEN doc_id % 4 = 0 THEN 'local' ELSE 'ocr' END AS source, CASE WHEN length(text) >= 100 THEN 1 ELSE CAST(ceil(greatest(length(text), 1) / 10.0) AS BIGINT) END AS chunks FROM documents")
def ocr(t):
    """Texts with a text layer of 100 characters are taken as they are; the others go to a recogniser in chunks of ten pages (here of a
    character), tried three times, and where it fails to a local one."""
    from docloom.operators.external import recognised

    def remote(chunk: str, doc: int) -> str:
        if doc % 4 == 0:
            raise TimeoutError
        return chunk

    pages = t.documents.select("doc_id", "text")
    return recognised(pages, "doc_id", "text", remote, lambda chunk, doc: chunk).select("doc_id", "source", "chunks")


@query("x02_x03_x12_rule_calls", "SELECT doc_id, CASE WHEN toxic IS NOT NULL THEN 'cache' ELSE 'call' END AS source, CASE WHEN toxic IS NOT NULL THEN toxic = 0 ELSE text LIKE '%the%' END AS is_order, CASE WHEN toxic IS NOT NULL THEN 'known' WHEN text LIKE '%the%' THEN 'ordered' ELSE 'none' END AS reason FROM documents LEFT JOIN labels USING (doc_id)")
def rule_calls(t):
    """A call that answers with a struct for the documents that the frozen cache lacks; a stand-in rule takes the model's place."""
    from docloom.operators.external import with_cached_struct

    cache = t.labels.select("doc_id", F.struct((F.col("toxic") == 0).alias("is_order"), F.lit("known").alias("reason")).alias("answer"))

    def call(text: str) -> tuple:
        found = "the" in (text or "")
        return found, "ordered" if found else "none"

    out = with_cached_struct(t.documents.select("doc_id", "text"), cache, "doc_id", "text", "is_order boolean, reason string", call)
    return out.select("doc_id", "source", "answer.is_order", "answer.reason")


@query("s16_k02_roster_appended", "SELECT CAST(n_regionkey AS VARCHAR) AS n_regionkey, n_name, CAST(n_nationkey AS VARCHAR) AS n_nationkey FROM nation UNION ALL SELECT CAST(r_regionkey AS VARCHAR), r_name, NULL FROM region")
def roster_appended(t):
    """A roster file whose own order of fields is kept, with new rows appended under it; a field that they lack stays empty."""
    path = folder(t.spark, "roster")
    sinks.write_csv(t.nation, path, ["n_regionkey", "n_name", "n_nationkey"])
    fields = tabular.csv_fields(t.spark, path)
    new = t.region.select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("n_name"))
    tabular.aligned(new, fields).write.mode("append").option("header", True).option("escape", '"').csv(path)
    return tabular.read_csv(t.spark, path, fields)


@query("x07_second_opinions", "SELECT doc_id, CASE WHEN quality = 0 THEN 'distinct' WHEN n_chars % 3 = 0 THEN 'same' ELSE 'unsure' END AS verdict FROM documents LEFT JOIN labels USING (doc_id)")
def second_opinions(t):
    """The batch's verdicts, and in their place those of a second source where it has one."""
    from docloom.operators.external import overridden

    batch = t.documents.select("doc_id", F.when(F.col("n_chars") % 3 == 0, "same").otherwise("unsure").alias("verdict"))
    second = t.labels.filter("quality = 0").select("doc_id", F.lit("distinct").alias("verdict"))
    return overridden(batch, second, "doc_id", "verdict")


@query("x08_weak_pairs", "WITH w AS (SELECT DISTINCT p_name, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part) SELECT p_name, CASE WHEN levenshtein(a, b) <= 3 THEN 'same' WHEN abs(length(a) - length(b)) <= 1 THEN 'unsure' ELSE 'distinct' END AS verdict FROM w")
def weak_pairs(t):
    """An adjudicator's verdicts on pairs of names; where its confidence is low it abstains. A stand-in rule takes the model's place."""
    from docloom.operators.external import with_cached_struct

    def call(pair: str) -> tuple:
        a, _, b = (pair or "").partition(" ")
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _next_row(row, i, x, b)
        near = row[-1] <= 3
        return near, "high" if near or abs(len(a) - len(b)) > 1 else "low"

    pairs = t.part.select(F.col("p_name").alias("key"), F.col("p_name").alias("pair")).distinct()
    none = t.spark.createDataFrame([], "key string, answer struct<same:boolean,confidence:string>")
    out = with_cached_struct(pairs, none, "key", "pair", "same boolean, confidence string", call)
    return out.select(F.col("key").alias("p_name"), F.when(F.col("answer.confidence") == "low", "unsure").when(F.col("answer.same"), "same").otherwise("distinct").alias("verdict"))


def _next_row(row: list[int], i: int, x: str, b: str) -> list[int]:
    """The next row of the edit-distance table."""
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(out[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
    return out


@query("x09_demographics", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'cache' ELSE 'call' END AS source, CASE WHEN s_suppkey % 2 = 0 THEN 'known' ELSE 'of ' || s_name END AS notes, CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE 1900 + length(s_name) END AS birth_year FROM supplier")
def demographics(t):
    """A record per roster row, from the cache or from a call (a stand-in rule)."""
    from docloom.operators.external import with_cached_struct

    cache = t.supplier.filter("s_suppkey % 2 = 0").select("s_suppkey", F.struct(F.lit("known").alias("notes"), F.lit(None).cast("int").alias("birth_year")).alias("answer"))
    out = with_cached_struct(t.supplier.select("s_suppkey", "s_name"), cache, "s_suppkey", "s_name", "notes string, birth_year int", lambda name: (f"of {name}", 1900 + len(name)))
    return out.select("s_suppkey", "source", "answer.notes", "answer.birth_year")
