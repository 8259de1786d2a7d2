"""Committed tables, daily indexes and scans that open only the files of their window."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from marlstone.sources import scans as sc
from marlstone.sources import store

T = [datetime(2024, 1, d) for d in range(1, 9)]


def states(spark, rows):
    return spark.createDataFrame(rows, "name string, value string, updated_at timestamp")


def held(df):
    return {r.name: r.value for r in df.collect()}


def test_commits_upsert_keep_rejects_and_stay_readable(spark, tmp_path):
    root = str(tmp_path / "db")
    assert store.version(spark, root, "state") == 0 and store.read_table(spark, root, "state").count() == 0
    assert store.commit(states(spark, [("a", "1", T[0]), ("b", "1", T[3]), (None, "x", T[0])]), root, "state") == 1
    assert store.commit(states(spark, [("a", "2", T[1]), ("b", "old", T[2]), ("b", "2", T[3]), ("c", "1", None)]), root, "state") == 2
    assert held(store.read_table(spark, root, "state")) == {"a": "2", "b": "2", "c": "1"}
    assert held(store.read_table(spark, root, "state", 1)) == {"a": "1", "b": "1"}
    assert [(r.value, r.errors) for r in store.rejected(spark, root, "state").collect()] == [("x", ["name_missing"])]


def test_a_write_that_fails_leaves_the_old_version(spark, tmp_path):
    root = str(tmp_path / "db")
    store.commit(states(spark, [("a", "1", T[0])]), root, "state")
    bad = states(spark, [("a", "2", T[1])]).withColumn("value", F.when(F.col("name") == "a", F.raise_error(F.lit("lost"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="lost"):
        store.commit(bad, root, "state")
    assert store.version(spark, root, "state") == 1 and held(store.read_table(spark, root, "state")) == {"a": "1"}


def test_of_two_writers_the_second_has_to_merge_anew(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "db")
    store.commit(states(spark, [("a", "1", T[0])]), root, "state")
    whole = store.merged

    def slow(*args):  # another writer commits while this one merges
        monkeypatch.setattr(store, "merged", whole)
        store.commit(states(spark, [("b", "other", T[1])]), root, "state")
        return whole(*args)

    monkeypatch.setattr(store, "merged", slow)
    with pytest.raises(store.Conflict):
        store.commit(states(spark, [("a", "2", T[1])]), root, "state")
    assert held(store.read_table(spark, root, "state")) == {"a": "1", "b": "other"}
    store.commit(states(spark, [("a", "2", T[1])]), root, "state")
    assert held(store.read_table(spark, root, "state")) == {"a": "2", "b": "other"} and store.version(spark, root, "state") == 3


def test_a_daily_index_rewrites_only_its_days(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = lambda x: spark.createDataFrame(x, "day string, k string, v long, at long")
    store.upsert_days(rows([("d1", "a", 1, 1), ("d1", "b", 1, 1), ("d2", "a", 5, 1)]), path, "day", ["k"], "at")
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "index" / "day=d2").iterdir()}
    store.upsert_days(rows([("d1", "a", 2, 2), ("d1", "b", 0, 0), ("d3", "c", 9, 1), ("d3", "c", 8, 1)]), path, "day", ["k"], "at")
    got = {(r.day, r.k): r.v for r in spark.read.parquet(path).collect()}
    assert {k: v for k, v in got.items() if k[0] != "d3"} == {("d1", "a"): 2, ("d1", "b"): 1, ("d2", "a"): 5} and got["d3", "c"] in (8, 9)
    assert {p.name: p.stat().st_mtime_ns for p in (tmp_path / "index" / "day=d2").iterdir()} == before


def test_a_window_opens_its_files_alone(spark, tmp_path):
    for day in ("20231231T235959", "20240101T000000", "20240102T120000", "20240104T000000", "20240104T090000", "20240201T000000"):
        (tmp_path / f"journal_{day}_x.jsonl").write_text('{"k": "%s"}\n{"k": \n' % day)
    (tmp_path / "other_20240102T120000_x.jsonl").write_text('{"k": "no"}\n')
    (tmp_path / "journal_none_x.jsonl").write_text('{"k": "no"}\n')
    x, gaps = sc.scan_window(spark, str(tmp_path), "journal", "k string", datetime(2024, 1, 1), datetime(2024, 1, 4, 8))
    assert sorted(r.k for r in x.collect() if r.k) == ["20240101T000000", "20240102T120000", "20240104T000000"]
    assert [str(r.day) for r in gaps.collect()] == ["2024-01-03"]
    # The list of files that are planned has those of the four days alone.
    planned = spark.read.schema("k string").option("pathGlobFilter", sc.window_globs(datetime(2024, 1, 1), datetime(2024, 1, 4, 8), "journal")).json(str(tmp_path)).inputFiles()
    assert len(planned) == 4 and len(x.inputFiles()) == 4
    assert sc.window_globs(datetime(2022, 12, 31), datetime(2024, 3, 2), "j") == "j_{20221231,2023,202401,202402,20240301}*"
    with pytest.raises(ValueError):
        sc.scan_window(spark, str(tmp_path), "journal", "k string", datetime(2024, 1, 2), datetime(2024, 1, 2))


def test_expected_keys_without_a_source_are_told(spark):
    a, b = (spark.createDataFrame([(k, 1) for k in ks], "symbol string, v int") for ks in (("x",), ("x", "y", "y")))
    got = {r.symbol: (r.source_no, r.n, r.failure) for r in sc.cascade_status([a, b], spark.createDataFrame([("x",), ("y",), ("z",)], "symbol string"), ["symbol"]).collect()}
    assert got == {"x": (0, 1, None), "y": (1, 2, None), "z": (None, 0, "no_source_has_rows")}
