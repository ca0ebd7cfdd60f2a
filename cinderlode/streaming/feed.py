"""Structured Streaming: a change feed of files applied to a versioned table, batch after batch, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlode.core import stage
from cinderlode.operators.sync import VersionedTable

GONE, PART = "_gone", "_part"


def latest_changes(batch: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last change of each key in a batch; a struct maximum, so a hot key is combined before the shuffle."""
    rest = [c for c in batch.columns if c != key]
    return batch.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, *(F.col(f"_r.{c}").alias(c) for c in rest)).select(*batch.columns)


def apply_feed(
    spark: SparkSession, source: str, schema, target: str, checkpoint: str, key: str, order: list[str], deleted: str | None = None, files_a_batch: int = 1000, parts: int = 64,
    keep_deleted: str | None = None,
):
    """Start a query that upserts the rows of new Parquet files into the versioned table at target and stops when all are read.

    A later change by order wins, within a batch and against the table. Rows for which the deleted expression holds remove their
    key; they stay in the table as tombstones, so an older change that comes later does not bring the key back (see live). The table
    is parted by a hash of the key into parts, and a batch rewrites only the parts it touches. keep_deleted: an expression; tombstones
    for which it is false are dropped when their part is rewritten. Batches are stored under their own version, so a batch that is
    run again after a failure changes nothing.
    """
    place = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")

    def upsert(batch: DataFrame, number: int) -> None:
        table = VersionedTable(spark, target)
        if number + 1 <= table.version():
            return
        gone = F.expr(f"coalesce({deleted}, false)") if deleted else F.lit(False)
        fresh = stage(latest_changes(batch, key, order).withColumn(GONE, gone).withColumn(PART, place))
        touched = sorted(r[0] for r in fresh.select(PART).distinct().collect())  # at most parts
        if table.version():
            # Of two changes with the same order the one that came later counts.
            old = table.read(touched).withColumn(PART, place)
            both = old.withColumn("_new", F.lit(0)).unionByName(fresh.select(*old.columns).withColumn("_new", F.lit(1)))
            fresh = latest_changes(both, key, [*order, "_new"]).drop("_new")
        if keep_deleted:
            fresh = fresh.where(f"not {GONE} or coalesce({keep_deleted}, true)")
        table.write(fresh, number + 1, PART, touched)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)
    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live(spark: SparkSession, target: str) -> DataFrame:
    """The rows of a table kept by apply_feed, without tombstones."""
    return VersionedTable(spark, target).read().where(f"not {GONE}").drop(GONE)


def windowed_counts(stream: DataFrame, time: str, group: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts per time window and group with a watermark; the same plan runs on a batch table, where the watermark has no effect."""
    return stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late).groupBy(F.window("_t", width).alias("w"), group).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), group, "n")
