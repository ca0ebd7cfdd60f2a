"""Orphan references (p3) and snapshot changes (p5): behaviour at the edges, and against plain Python."""

import datetime as D
import random

import pytest
from conftest import SF, rows
from pyspark.sql import functions as F

from cinderlode.core import spread_join
from cinderlode.operators.orphans import asof, orphans, runs
from cinderlode.operators.snapshots import chunked, map_value, snapshot_changes, text_value
from cinderlode.plans import general_queries as G


@pytest.mark.parametrize("name", ["p3_found", "p5_found", "p3_report"])
def test_empty_tables(spark, empty, name):
    assert rows(G.QUERIES[name](spark, empty)) == []


@pytest.mark.parametrize("name", ["p3_found", "p5_found"])
def test_clashing_columns_and_repeated_rows(spark, clashing, repeated, name):
    plain = rows(G.QUERIES[name](spark, SF))
    assert plain and rows(G.QUERIES[name](spark, clashing)) == plain
    assert rows(G.QUERIES[name](spark, repeated)) == plain


def at(day, micro=0):
    return D.datetime(2025, 1, day, 0, 0, 0, micro)


def test_orphan_kinds_and_bounds(spark):
    apps = spark.createDataFrame([("A ", at(2), at(5)), ("a", at(5), at(7)), ("a", at(10), None), ("b", at(20), None), (None, at(1), None), (" ", at(1), None)], "app_id string, loaded_at timestamp_ntz, deleted_at timestamp_ntz")
    cases = [(1, "a", at(1), "late"), (2, " A", at(2), None), (3, "a", at(6), None), (4, "a", at(7), "deleted"), (5, "a", at(9, 999999), "deleted"), (6, "a", at(10), None), (7, "b", at(19, 999999), "late"),
             (8, "zz", at(3), "missing"), (9, None, at(3), None), (10, "  ", at(3), None), (11, "a", None, None), (12, "a", at(28), None)]
    refs = spark.createDataFrame([c[:3] for c in cases], "row_id long, app_id string, loaded_at timestamp_ntz")
    for slice_us in (1_000_000, 86_400_000_000, 10**15):
        got = {r["row_key"]: r["orphan_kind"] for r in orphans(refs, apps, "row_id", "app_id", "loaded_at", "app_id", "loaded_at", "deleted_at", slice_us=slice_us).collect()}
        assert got == {c[0]: c[3] for c in cases if c[3]}


def test_runs_and_asof_against_python(spark):
    rnd = random.Random(4)
    spans = [(rnd.randrange(4), s, s + rnd.randrange(-2, 30)) for s in (rnd.randrange(400) for _ in range(120))]
    keys = [(rnd.randrange(5), t) for t in range(0, 440, 3)]
    table = runs(spark.createDataFrame(spans, "code long, start long, end long"), slice_us=25)
    found = asof(table, spark.createDataFrame(keys, "code long, t long").distinct(), slice_us=25).collect()
    assert len(found) == len(set(keys))
    for r in found:
        covered = any(c == r["code"] and s <= r["t"] < e for c, s, e in spans)
        assert covered == (r["run_end"] is not None and r["t"] < r["run_end"])


def test_hot_key_with_a_third_of_all_rows(spark):
    refs = spark.range(3000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("app_id"), F.lit(at(3)).alias("loaded_at"))
    apps = spark.createDataFrame([("hot", at(1), at(2))], "app_id string, loaded_at timestamp_ntz, deleted_at timestamp_ntz")
    kinds = orphans(refs, apps, "row_id", "app_id", "loaded_at", "app_id", "loaded_at", "deleted_at").groupBy("orphan_kind").count().collect()
    assert {r[0]: r[1] for r in kinds} == {"deleted": 1000, "missing": 2000}
    many = spark.range(1000).select(F.when(F.col("id") < 900, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    few = spark.createDataFrame([("hot", 1), ("950", 2), ("x", 3)], "k string, v int")
    assert spread_join(many, few, "k", hot_rows=100, salts=5).groupBy("v").count().orderBy("v").collect() == [(1, 900), (2, 1)]
    assert spread_join(many, few, "k", hot_rows=100, salts=5, how="left").count() == 1000


def changes(spark, data, **kw):
    df = spark.createDataFrame(data, "snap_no int, key string, name string, js string")
    return rows(snapshot_changes(df, "snap_no", "key", {"name": text_value("name"), "js": map_value("js")}, **kw))


def test_snapshot_values(spark):
    data = [(1, " a ", "x", '{"b": "1", "a": "2"}'), (2, "a", " x\n", '{"a":"2","b":"1"}'),  # spacing and order mean nothing
            (1, "b", None, None), (2, "b", "", None),  # null differs from empty
            (1, "c", "x", None), (3, "d", "y", "{broken"), (4, "d", "y", "{broken "), (1, None, "x", None), (1, "  ", "x", None),
            (2, "c", "x", None), (2, "c", "x", None), (3, "a", "x", '{"a":"2","b":"1"}'), (3, "b", "", None), (3, "c", "x", None), (4, "a", "x", '{"a":"3","b":"1"}'), (4, "b", "", None), (4, "c", "x", None)]
    assert changes(spark, data) == [(2, "b", "changed"), (3, "d", "added"), (4, "a", "changed")]
    assert changes(spark, []) == []


def test_snapshots_against_python(spark):
    rnd = random.Random(9)
    state, data, want = {}, [], []
    for no in range(1, 5):
        new = {k: v for k, v in state.items() if rnd.random() > 0.05}
        for _ in range(60):
            new[f"k{rnd.randrange(900)}"] = str(rnd.randrange(3))
        if no > 1:
            want += [(no, k, "removed" if k not in new else "added" if k not in state else "changed") for k in state.keys() | new.keys() if state.get(k) != new.get(k)]
        state = new
        data += [(no, k, v, None) for k, v in state.items()] * 2
    rnd.shuffle(data)
    for mean_rows, rows_a_part in ((1, 50), (8, 20_000), (64, 300)):
        assert changes(spark, data, mean_rows=mean_rows, rows_a_part=rows_a_part) == sorted(want, key=str)


def test_equal_stretches_give_equal_chunks(spark):
    keys = spark.range(2000).select(F.lit(1).alias("snap"), F.concat(F.lit("k"), "id").alias("key"), F.lit("d").alias("digest"))
    both = keys.unionByName(keys.where("key <> 'k77'").withColumn("snap", F.lit(2)))
    cut = chunked(both, 4, 8)
    per = cut.groupBy("part", "chunk").agg(F.sum(F.when(F.col("snap") == 1, 1).otherwise(-1)).alias("d"))
    assert cut.select("part", "chunk").distinct().count() > 100 and 0 < per.where("d <> 0").count() <= 2
