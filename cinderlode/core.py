"""Session, staging and table helpers shared by every operator."""

from __future__ import annotations

import atexit
import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FOLDERS: dict[str, str] = {}
_SHIPPED: set[str] = set()
_STAGES: list[str] = []


def session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the submitter's session is used as it is."""
    return ship(
        SparkSession.builder.master(f"local[{cpus}]").appName("cinderlode")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def ship(spark: SparkSession) -> SparkSession:
    """Give the session's Python workers this package, once a session, wherever it was imported from."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        _SHIPPED.add(context.applicationId)
        root = pathlib.Path(__file__).resolve().parent
        folder = tempfile.TemporaryDirectory(prefix="cinderlode-code-", ignore_cleanup_errors=True)
        atexit.register(folder.cleanup)
        archive = f"{folder.name}/cinderlode.zip"  # the driver serves it to the executors
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for path in sorted(root.rglob("*.py")):
                z.write(path, f"{root.name}/{path.relative_to(root)}")
        context.addPyFile(archive)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Only a purely local session may lack the setting; it then gets a temporary folder, as driver and executors are one machine.
    """
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor reaches")
        held = tempfile.TemporaryDirectory(prefix="cinderlode-", ignore_cleanup_errors=True)
        atexit.register(held.cleanup)
        _FOLDERS[app] = "file://" + held.name
    return _FOLDERS[app]


def stage(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and return a scan of it: lineage ends there and a lost executor costs no recomputation.

    Staged tables are dropped by drop_stages, and at the latest when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    if not _STAGES:
        atexit.register(drop_stages, spark)
    _STAGES.append(path)
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stages(spark: SparkSession) -> None:
    """Delete what stage has written so far; to be called when the results that read it are stored."""
    try:
        for path in _STAGES:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended before: nothing can be reached any more
        return
    _STAGES.clear()


def spread_join(many: DataFrame, few: DataFrame, key: str, hot_rows: int = 100_000, salts: int = 64, how: str = "inner") -> DataFrame:
    """many joined with few, which has at most one row a key, so that no key of many's lands in one task.

    Keys with more than hot_rows rows in many, found by a count that is combined before its shuffle, are spread over salts tasks by a
    hash of the row, to each of which few's row of the key is sent; there are at most count / hot_rows such keys, so they are broadcast.
    """
    hot = many.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows).select(key, F.lit(True).alias("_hot"))
    left = many.join(F.broadcast(hot), key, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*many.columns), F.lit(salts)).cast("int")).otherwise(0)).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = few.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def with_default(df: DataFrame, column: str, value) -> DataFrame:
    """df with the column filled by a literal where an older schema lacks it."""
    return df if column in df.columns else df.withColumn(column, F.lit(value))


def trimmed(column):
    """Outer white space of any kind removed."""
    return F.regexp_replace(column, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def key_of(column):
    """Lower-cased key without outer blanks; null where nothing is left."""
    return F.nullif(F.lower(F.trim(column)), F.lit(""))


def parts_for(df: DataFrame, rows_each: int, least: int = 1) -> int:
    """Number of hash parts so that each holds about rows_each rows; counts from file footers where df is a plain scan."""
    return max(least, -(-df.count() // rows_each))
