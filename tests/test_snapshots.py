"""Replacement that readers never see half done, and logs that are read while they grow."""

import json

import pytest
from pyspark.sql import functions as F

from docloom.operators import agree
from docloom.sources import snapshots, tabular
from docloom.streaming import tail


class Killed(Exception):
    pass


def rows(spark, *keys):
    return spark.createDataFrame([(k, f"v{k}") for k in keys], "k int, v string")


@pytest.mark.parametrize("step", ["stage", "draft", "publish", "write", "delete"])
def test_a_reader_finds_the_old_or_the_new_table(spark, tmp_path, monkeypatch, step):
    """The writer is killed before each of its steps, and after the pointer is in place."""
    path = f"file://{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, path)
    assert snapshots.replace(rows(spark, 1), path) == 1
    if step in ("stage", "draft", "publish"):
        def killed(*a):
            raise Killed

        monkeypatch.setattr(snapshots, step, killed)
    elif step == "write":  # half a table is written
        real = snapshots.stage
        monkeypatch.setattr(snapshots, "stage", lambda df, p: real(df, p) and (_ for _ in ()).throw(Killed))
    else:  # all is done but for the draft's removal
        real_publish = snapshots.publish
        monkeypatch.setattr(snapshots, "publish", lambda *a: real_publish(*a) or (_ for _ in ()).throw(Killed))
    with pytest.raises(Killed):
        snapshots.replace(rows(spark, 2, 3), path)
    want = [2, 3] if step == "delete" else [1]
    assert sorted(r.k for r in snapshots.read(spark, path).collect()) == want
    monkeypatch.undo()
    after = snapshots.replace(rows(spark, 4), path)
    assert after == (3 if step == "delete" else 2) and [r.k for r in snapshots.read(spark, path).collect()] == [4]
    snapshots.vacuum(spark, path, 1)
    assert [r.k for r in snapshots.read(spark, path).collect()] == [4] and snapshots.versions(spark, path) == [after]
    assert sum(p.name.startswith("data-") for p in (tmp_path / "t").iterdir()) == 1


def test_the_slower_writer_is_told(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    snapshots.replace(rows(spark, 1), path)
    mine = rows(spark, 2)
    snapshots.replace(rows(spark, 3), path)
    with pytest.raises(snapshots.Conflict):
        snapshots.replace(mine, path, after=1)
    assert [r.k for r in snapshots.read(spark, path).collect()] == [3]
    assert [r.k for r in snapshots.read(spark, path, 1).collect()] == [1]
    # an upsert that another one has overtaken is made anew from what that one left
    real, calls = snapshots.stage, []

    def late(df, p):
        calls.append(1)
        if len(calls) == 1:
            real_stage, snapshots.stage = snapshots.stage, real
            snapshots.replace(rows(spark, 3, 7), path)
            snapshots.stage = real_stage
        return real(df, p)

    monkeypatch.setattr(snapshots, "stage", late)
    assert snapshots.upsert(rows(spark, 3, 9).withColumn("v", F.lit("new")), path, "k", F.lit(1)) == 4
    assert sorted(map(tuple, snapshots.read(spark, path).collect())) == [(3, "new"), (7, "v7"), (9, "new")]


def test_a_table_read_while_it_is_replaced(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    snapshots.replace(rows(spark, *range(50)), path)
    before = snapshots.read(spark, path)
    snapshots.replace(before.filter("k < 10"), path)
    assert before.count() == 50 and snapshots.read(spark, path).count() == 10
    snapshots.replace(before.limit(0), path)
    assert snapshots.read(spark, path).count() == 0


def collected(spark, logs, state, out, piece=tail.PIECE):
    tail.run_available(tail.lines(spark, f"file://{logs}", ".jsonl", piece), state, lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}"))


@pytest.mark.parametrize("piece", [tail.PIECE, 37])
def test_growing_logs(spark, tmp_path, piece):
    logs, state, out = tmp_path / "logs", str(tmp_path / "state"), str(tmp_path / "out")
    logs.mkdir()
    whole = {n: "".join(json.dumps({"k": k, "t": "é" * (k % 5)}, ensure_ascii=False) + ("\r\n" if k % 7 == 0 else "\n") + "\n" * (k % 11 == 0) for k in range(60)).encode() for n in "ab"}
    for part in (0.2, 0.2, 0.71, 1.0):
        for n, data in whole.items():
            (logs / f"{n}.jsonl").write_bytes(data[: int(len(data) * part)])
        (logs / "other.txt").write_text("no log\n")
        collected(spark, logs, state, out, piece)
    (logs / "c.jsonl").write_bytes(b'{"k": 1}\nunfinished')
    collected(spark, logs, state, out, piece)
    got = sorted((r.log, r.place, r.line) for r in spark.read.parquet(out).collect())
    want = [("c.jsonl", 0, '{"k": 1}')]
    for n, data in whole.items():
        at = 0
        for line in data.split(b"\n"):
            if line.strip():
                want.append((f"{n}.jsonl", at, line.rstrip(b"\r").decode()))
            at += len(line) + 1
    assert got == sorted(want)


def test_lines_that_are_no_records(spark):
    df = spark.createDataFrame([("l", k, x) for k, x in enumerate(['{"k": 1}', "[1]", '{"k": ', "null", '{"k": "x", "z": 1}', "{}"])], "log string, place long, line string")
    assert sorted((r.place, r.k) for r in tail.parsed(df, "k long").collect()) == [(0, 1), (4, None), (5, None)]


def test_discovered_columns():
    some = ["id", "Name_First", "canonical_name", "NAME"]
    assert tabular.discovered(some, ("name",)) == "Name_First" and tabular.discovered(some, ("NAME",), ("missing", "canonical_name")) == "canonical_name"
    with pytest.raises(ValueError):
        tabular.discovered(some, ("side",))


def test_soft_scores_of_nothing(spark):
    empty = spark.createDataFrame([], "src string, k int, roles array<string>, side string, interim boolean")
    r = agree.soft_scores(empty, "src", "gold", "ours", ["k"]).first()
    assert (r.matched, r.gold, r.soft_recall, r.soft_f1, r.side_pct) == (0, 0, None, 0.0, None)
