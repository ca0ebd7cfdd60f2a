"""What changed between full snapshots.

Each snapshot is key-sorted within hash parts and cut into content-defined chunks: a row opens a chunk where a hash of its key
says so, hence equal stretches of two snapshots give equal chunks wherever they stand. Chunks whose digests match are discarded;
only rows of unmatched chunks are joined to tell added, removed and changed records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlode.core import parts_for, stage, trimmed


def text_value(column: str) -> Column:
    return trimmed(F.col(column))


def map_value(column: str) -> Column:
    """A JSON object as its sorted entries, so that spacing and order mean nothing; broken JSON counts as trimmed text."""
    text = trimmed(F.col(column))
    parsed = F.from_json(text, "map<string,string>")
    entries = F.array_sort(F.transform(F.map_entries(parsed), lambda e: F.struct(trimmed(e["key"]).alias("key"), trimmed(e["value"]).alias("value"))))
    return F.when(text.startswith("{") & F.try_parse_json(text).isNotNull() & parsed.isNotNull(), F.concat(F.lit("map:"), F.to_json(entries))).otherwise(F.concat(F.lit("text:"), text))


def chunked(rows: DataFrame, parts: int, mean_rows: int) -> DataFrame:
    """Rows (snap, key, digest) with part and chunk: the chunk's opening key, found within the key-sorted part."""
    opens = F.pmod(F.xxhash64(F.col("key"), F.lit(17)), F.lit(mean_rows)) == 0
    w = Window.partitionBy("snap", "part").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts))).withColumn("chunk", F.coalesce(F.last(F.when(opens, F.col("key")), ignorenulls=True).over(w), F.lit("")))


def snapshot_changes(snapshots: DataFrame, snap: str, key: str, compared: dict[str, Column], mean_rows: int = 8, rows_a_part: int = 20_000) -> DataFrame:
    """Changes between each two consecutive snapshots: snap_no (the later), rec_key, change_kind in added, removed, changed.

    compared: name -> canonical value of each compared field. Null equals only null. Keys are trimmed; rows without a key or
    snapshot number are ignored. Rows repeated in a snapshot count once; a key that comes with several contents stands for the set
    of them, so order never matters. An empty input has no changes. Numbers of snapshots need not be dense.
    """
    fields = [F.coalesce(F.concat(F.lit("="), value), F.lit("null")) for value in compared.values()]
    content = F.sha2(F.to_json(F.array(*fields)), 256)
    rows = (
        snapshots.select(F.col(snap).alias("snap"), trimmed(F.col(key)).alias("key"), content.alias("digest")).where("snap is not null and key <> ''")
        .distinct().groupBy("snap", "key").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("digest")), ""), 256).alias("digest"))
    )
    parts = parts_for(snapshots, rows_a_part)
    cut = stage(chunked(rows, parts, mean_rows).select("snap", "part", "chunk", "key", "digest"))
    order = Window.orderBy("snap")
    # One row a snapshot: the window holds as many rows as there are deliveries.
    steps = cut.select("snap").distinct().withColumn("later", F.lead("snap").over(order)).where("later is not null")
    chunks = cut.groupBy("snap", "part", "chunk").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("key", "digest")).alias("x"), F.bit_xor(F.xxhash64("digest", "key", F.lit(7))).alias("y"), F.sum(F.xxhash64("digest", "key", F.lit(3)).cast("decimal(38,0)")).alias("z"))
    old = chunks.join(F.broadcast(steps), "snap").select(F.col("later").alias("step"), "part", "chunk", "n", "x", "y", "z")
    new = chunks.join(F.broadcast(steps.select(F.col("later").alias("snap"))), "snap").select(F.col("snap").alias("step"), "part", "chunk", "n", "x", "y", "z")
    same = ["step", "part", "chunk", "n", "x", "y", "z"]
    old_open, new_open = old.join(new, same, "left_anti").select("step", "part", "chunk"), new.join(old, same, "left_anti").select("step", "part", "chunk")
    rows_then = cut.join(F.broadcast(steps), "snap").withColumn("step", F.col("later")).join(old_open, ["step", "part", "chunk"], "left_semi").select("step", "key", F.col("digest").alias("then"))
    rows_now = cut.withColumn("step", F.col("snap")).join(new_open, ["step", "part", "chunk"], "left_semi").select("step", "key", F.col("digest").alias("now"))
    return (
        rows_then.join(rows_now, ["step", "key"], "full_outer").where("not (then <=> now)")
        .select(F.col("step").alias("snap_no"), F.col("key").alias("rec_key"), F.expr("case when then is null then 'added' when now is null then 'removed' else 'changed' end").alias("change_kind"))
    )
