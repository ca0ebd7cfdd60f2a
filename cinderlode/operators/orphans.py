"""References to records that do not exist, or not at the time they were made.

All keys, those of parents and those referred to, get dense integer codes in the order of the keys (within a hash part). The codes
of parents are sorted and compressed into contiguous runs; each distinct referred code is matched as of the preceding run start and is
missing beyond the run's end. The same is done for time: a parent is listed over spans, so that (code, time) is one long integer key
and every span a run of consecutive keys; a reference beyond the run's end is an orphan of a parent that comes later or is gone.
Long sequences are cut in slices: each (code, slice) is sorted by itself and gets what ran before it from a small table of one
row a slice, so no task sees a whole key or part. Joins on the key alone spread keys that many references name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlode.core import key_of, spread_join, stage

FOREVER = 2**62


def _micros(column: Column) -> Column:
    return F.unix_micros(column.cast("timestamp"))


def runs(parents: DataFrame, code: str = "code", start: str = "start", end: str = "end", slice_us: int = 86_400_000_000) -> DataFrame:
    """Contiguous runs of listed keys per code: overlapping or touching spans [start, end) become one.

    Result: code, slice, run_start, run_end; a run is cut where a slice begins anew, which leaves as-of matching exact, as
    run_end holds the furthest end of all spans of the code that start no later. Empty spans (end <= start) add no key.
    """
    spans = (
        parents.select(F.col(code).alias("code"), F.col(start).alias("s"), F.col(end).alias("e"))
        .where("e > s").distinct().withColumn("slice", F.expr(f"s div {slice_us}"))
    )
    before = (
        spans.groupBy("code", "slice").agg(F.max("e").alias("far"))
        .withColumn("before", F.max("far").over(Window.partitionBy("code").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)))
        .drop("far")
    )
    w = Window.partitionBy("code", "slice").orderBy("s", "e")
    reach = F.greatest(F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("before"))
    return (
        spans.join(before, ["code", "slice"])
        .withColumn("reach", reach)
        .withColumn("new", (F.col("reach").isNull() | (F.col("s") > F.col("reach"))).cast("int"))
        .withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("code", "slice", "run")
        .agg(F.min("s").alias("run_start"), F.max(F.greatest("e", F.coalesce("reach", "e"))).alias("run_end"))
        .drop("run")
    )


def asof(run_table: DataFrame, keys: DataFrame, slice_us: int = 86_400_000_000) -> DataFrame:
    """Every distinct key (code, t) with the preceding run of its code: run_start, run_end, null where none starts at or before t."""
    line = run_table.select("code", "slice", F.col("run_start").alias("t"), F.lit(0).alias("is_key"), "run_start", "run_end").unionByName(
        keys.select("code", F.expr(f"t div {slice_us}").alias("slice"), "t", F.lit(1).alias("is_key"), F.lit(None).cast("long").alias("run_start"), F.lit(None).cast("long").alias("run_end"))
    )
    carried = (
        line.groupBy("code", "slice").agg(F.max("run_start").alias("last"), F.max("run_end").alias("far"))
        .withColumn("carry_start", F.max("last").over(Window.partitionBy("code").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("carry_end", F.max("far").over(Window.partitionBy("code").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)))
        .drop("last", "far")
    )
    w = Window.partitionBy("code", "slice").orderBy("t", "is_key").rowsBetween(Window.unboundedPreceding, 0)
    return (
        line.withColumn("own_start", F.max("run_start").over(w)).withColumn("own_end", F.max("run_end").over(w))
        .where("is_key = 1").select("code", "slice", "t", "own_start", "own_end")
        .join(carried, ["code", "slice"])
        .select("code", "t", F.greatest("own_start", "carry_start").alias("run_start"), F.greatest("own_end", "carry_end").alias("run_end"))
    )


def orphans(
    references: DataFrame, parents: DataFrame, ref_row: str, ref_key: str, ref_time: str, parent_key: str, listed_from: str, listed_to: str | None = None,
    code_parts: int = 4096, slice_us: int = 86_400_000_000, slice_keys: int = 65_536, hot_rows: int = 100_000,
) -> DataFrame:
    """Rows of references whose key has no parent listed at their time.

    Result: row_key, ref_key, ref_time, orphan_kind in missing (no parent row at all), late (all of them listed later), deleted.
    Keys are compared trimmed and lower-cased. Null or blank keys and null times refer to nothing: no row. A parent without a
    begin is never listed but exists; without an end it stays listed. Repeated rows and ties give one answer each; extra columns are ignored.
    """
    until = F.coalesce(_micros(F.col(listed_to)), F.lit(FOREVER)) if listed_to else F.lit(FOREVER)
    parent = parents.select(key_of(F.col(parent_key)).alias("k"), _micros(F.col(listed_from)).alias("s"), until.alias("e")).where("k is not null").distinct()
    refs = references.select(F.col(ref_row).alias("row_key"), key_of(F.col(ref_key)).alias("k"), F.col(ref_time).alias("at")).where("k is not null and at is not null")
    points = stage(refs.select("k", _micros(F.col("at")).alias("t")).distinct())
    firsts = parent.groupBy("k").agg(F.min("s").alias("first"), F.lit(True).alias("is_parent"))
    keys = points.select("k").distinct().join(firsts, "k", "full_outer").withColumn("part", F.pmod(F.xxhash64("k"), F.lit(code_parts)))
    codes = stage(keys.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy("k")).cast("long")).withColumn("code", F.col("place") * F.lit(code_parts) + F.col("part")))
    # Runs of consecutive parents; a key that is referred to and lies beyond the end of the run before it is missing.
    there = runs(codes.where("is_parent").select(F.col("part").alias("code"), F.col("place").alias("start"), (F.col("place") + 1).alias("end")), slice_us=slice_keys)
    known = asof(there, codes.select(F.col("part").alias("code"), F.col("place").alias("t")), slice_keys).where("run_end is null or t >= run_end").select(F.col("code").alias("part"), F.col("t").alias("place"), F.lit(True).alias("missing"))
    judged = stage(codes.join(known, ["part", "place"], "left").select("k", "code", "first", F.coalesce("missing", F.lit(False)).alias("missing")))
    coded_points = stage(spread_join(points, judged, "k", hot_rows))
    missing = coded_points.where("missing").select("k", "t", F.lit("missing").alias("orphan_kind"))
    listed = spread_join(parent, judged.select("k", "code"), "k", hot_rows)
    matched = asof(runs(listed.select("code", F.col("s").alias("start"), F.col("e").alias("end")), slice_us=slice_us), coded_points.where("not missing").select("code", "t"), slice_us)
    beyond = (
        matched.where("run_end is null or t >= run_end").join(coded_points.where("not missing"), ["code", "t"])
        .select("k", "t", F.when(F.col("first").isNull() | (F.col("first") > F.col("t")), "late").otherwise("deleted").alias("orphan_kind"))
    )
    return (
        refs.withColumn("t", _micros(F.col("at"))).join(missing.unionByName(beyond), ["k", "t"])
        .select("row_key", F.col("k").alias("ref_key"), F.col("at").alias("ref_time"), "orphan_kind")
    )
