"""Incremental synchronisation of a registry (D1-D7, J15, U3-U4, M4): app-scoped differences, their application and its proof."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered(snapshots: DataFrame, snap: str) -> DataFrame:
    """snapshots with step, the number from 1 of each snapshot among those there are, so consecutive ones differ by 1."""
    steps = snapshots.select(snap).where(F.col(snap).isNotNull()).distinct().withColumn("step", F.row_number().over(Window.orderBy(snap)))  # one row a snapshot
    return snapshots.join(F.broadcast(steps), snap)


def fingerprints(apps: DataFrame, arguments: DataFrame, app_columns: list[str], argument_columns: list[str], vectors: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """app_id, print: one digest of an app's row, of all its commands and of their vectors, whatever their order.

    Copies of a row count once. vectors: cmd_path, embedding; a command's vector belongs to its app. by: columns (such as a snapshot's
    number) that part the tables, first in the result.
    """
    by = by or []
    rows = arguments.select(*by, "app_id", F.struct(*argument_columns).alias("r")).distinct().select(*by, "app_id", F.xxhash64(F.to_json("r")).alias("h"))
    if vectors is not None:
        owned = arguments.select(*by, "cmd_path", "app_id").distinct().join(vectors.select("cmd_path", F.xxhash64("cmd_path", F.to_json("embedding"), F.lit(1)).alias("h")).distinct(), "cmd_path")
        rows = rows.unionByName(owned.select(*by, "app_id", "h"))
    trees = rows.groupBy(*by, "app_id").agg(F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"))
    heads = apps.groupBy(*by, "app_id").agg(F.min(F.sha2(F.to_json(F.struct(*app_columns)), 256)).alias("head"))
    return heads.join(trees, [*by, "app_id"], "full_outer").select(*by, "app_id", F.sha2(F.to_json(F.struct("head", "x", "s", "n")), 256).alias("print"))


def difference(old: DataFrame, new: DataFrame, by: list[str] | None = None) -> DataFrame:
    """app_id, change (added, changed, deleted) from two tables of fingerprints; each app_id once in either (within by)."""
    by = by or []
    both = old.select(*by, "app_id", F.col("print").alias("was")).join(new.select(*by, "app_id", F.col("print").alias("now")), [*by, "app_id"], "full_outer").where("not (was <=> now)")
    return both.select(*by, "app_id", F.expr("case when was is null then 'added' when now is null then 'deleted' else 'changed' end").alias("change"))


def payload(changes: DataFrame, apps: DataFrame, arguments: DataFrame, vectors: DataFrame | None = None, by: list[str] | None = None) -> dict[str, DataFrame]:
    """What a client needs: ids of deleted apps, and the whole state of added and changed ones with every column, vectors included."""
    key = [*(by or []), "app_id"]
    dirty = changes.where("change <> 'deleted'").select(*key)
    out = {"deleted": changes.where("change = 'deleted'").select(*key), "apps": apps.join(dirty, key, "left_semi"), "arguments": arguments.join(dirty, key, "left_semi")}
    if vectors is not None:
        out["vectors"] = vectors.join(out["arguments"].select("cmd_path"), "cmd_path", "left_semi")
    return out


def applied(table: DataFrame, fresh: DataFrame, changes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """table without the rows of all changed apps, with the fresh rows of the payload: for apps and for commands."""
    return table.join(changes.select(*(by or []), "app_id"), [*(by or []), "app_id"], "left_anti").select(*table.columns).unionByName(fresh.select(*table.columns))


def vectors_applied(vectors: DataFrame, before: DataFrame, fresh: DataFrame, changes: DataFrame, dims: int) -> DataFrame:
    """vectors (cmd_path, embedding) without those of commands that changed apps owned before, with the payload's of dims components."""
    gone = before.join(changes.select("app_id"), "app_id", "left_semi").select("cmd_path").unionByName(fresh.select("cmd_path")).distinct()
    return vectors.join(gone, "cmd_path", "left_anti").select("cmd_path", "embedding").unionByName(fresh.where(F.size("embedding") == dims).select("cmd_path", "embedding"))


def reusable(texts: DataFrame, stored: DataFrame, model: str, stored_model: str, by: list[str] | None = None) -> DataFrame:
    """texts (cmd_path, text, ...) with reuse: whether the stored vectors (cmd_path, text) hold one of the same path and text.

    Vectors of another model are never reused; that is refused before anything is compared.
    """
    if model != stored_model:
        return texts.withColumn("reuse", F.lit(False))
    key = [*(by or []), "cmd_path", "text"]
    return texts.join(stored.select(*key).distinct().withColumn("_there", F.lit(True)), key, "left").withColumn("reuse", F.coalesce("_there", F.lit(False))).drop("_there")


def write_artefact(parts: dict[str, DataFrame], folder: str, version: int) -> DataFrame:
    """Store the parts of a payload as compressed JSON lines, one folder a part, and beside them a manifest, which is returned.

    Manifest: version, part, file, bytes, sha256. A version that is stored is never written over.
    """
    for name, df in parts.items():
        df.write.mode("errorifexists").option("compression", "gzip").json(f"{folder}/v{version}/{name}")
    told = file_digests(next(iter(parts.values())).sparkSession, f"{folder}/v{version}", list(parts)).withColumn("version", F.lit(version))
    told.coalesce(1).write.mode("errorifexists").json(f"{folder}/manifest-{version}")
    return told


def file_digests(spark: SparkSession, folder: str, parts: list[str]) -> DataFrame:
    """part, file, bytes, sha256 of every data file below the parts of an artefact; files are digested where they are read."""
    out = None
    for part in parts:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/{part}")
        one = files.select(F.lit(part).alias("part"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
        out = one if out is None else out.unionByName(one)
    return out


def damaged(spark: SparkSession, folder: str, version: int, parts: list[str]) -> DataFrame:
    """part, file, state (missing, unknown, changed) of the files of an artefact that differ from its manifest; empty if it is whole.

    This is checked before anything of an artefact is applied, without exception.
    """
    told = spark.read.schema("part string, file string, bytes long, sha256 string, version int").json(f"{folder}/manifest-{version}").select("part", "file", F.col("sha256").alias("told"))
    seen = file_digests(spark, f"{folder}/v{version}", parts).select("part", "file", "sha256")
    both = told.join(seen, ["part", "file"], "full_outer").where("not (told <=> sha256)")
    return both.select("part", "file", F.when(F.col("sha256").isNull(), "missing").when(F.col("told").isNull(), "unknown").otherwise("changed").alias("state"))


def unequal(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one side has, with the side; empty if both hold the same rows the same number of times."""
    right = right.select(*left.columns)
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def sync_modes(clients: DataFrame, releases: DataFrame) -> DataFrame:
    """How each client (client, synced) catches up: noop at the newest release, incremental exactly one behind, else full."""
    ranks = releases.select("released").distinct().withColumn("no", F.row_number().over(Window.orderBy("released")))  # one row a release
    newest = ranks.agg(F.max("no").alias("newest"))
    return clients.join(F.broadcast(ranks), clients["synced"] == ranks["released"], "left").join(F.broadcast(newest), F.lit(True)).select(
        "client", F.when(F.col("no") == F.col("newest"), "noop").when(F.col("no") == F.col("newest") - 1, "incremental").otherwise("full").alias("mode"))


class VersionedTable:
    """A table kept as immutable version folders. A version counts once its mark exists, a file that is made whole by one rename.

    Marks are never changed or deleted and readers take the highest, so a reader at any moment sees a whole version. Partitions (by
    a hash of the key) that a version did not touch are taken over from the versions before: each mark lists the folder of each.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def version(self) -> int:
        fs, p = self._fs(f"{self.folder}/marks")
        if not fs.exists(p):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def _mark(self) -> dict:
        number = self.version()
        return json.loads(self.spark.read.text(f"{self.folder}/marks/v{number}.json").first()[0]) if number else {"version": 0, "places": {}}

    def read(self, only: list[int] | None = None) -> DataFrame:
        """The newest version, or of it the partitions in only."""
        mark = self._mark()
        places = [f"{self.folder}/{p}" for k, p in mark["places"].items() if only is None or int(k) in only]
        if not places:
            return self.spark.createDataFrame([], mark["schema"])
        return self.spark.read.schema(mark["schema"]).parquet(*places)

    def write(self, df: DataFrame, version: int, partition: str | None = None, touched: list[int] | None = None) -> bool:
        """Store df as a version; a version that is not newer was stored before and is left alone, so a repeated batch changes nothing.

        partition: the integer column of df that parts it; df then holds the partitions in touched whole, and the others stay as they are.
        """
        mark = self._mark()
        if version <= mark["version"]:
            return False
        base = f"v{version}"
        plain = df.drop(partition) if partition else df
        writer = df.write.mode("overwrite").option("compression", "zstd")
        if partition:
            writer.partitionBy(partition).parquet(f"{self.folder}/{base}")
            fs, _ = self._fs(self.folder)
            places = {k: p for k, p in mark["places"].items() if int(k) not in set(touched or [])}
            there = [k for k in touched or [] if fs.exists(self._fs(f"{self.folder}/{base}/{partition}={k}")[1])]
            places |= {str(k): f"{base}/{partition}={k}" for k in there}
        else:
            writer.parquet(f"{self.folder}/{base}")
            places = {"0": base}
        fs, final = self._fs(f"{self.folder}/marks/{base}.json")
        _, part = self._fs(f"{self.folder}/_{base}.{uuid.uuid4().hex}.tmp")
        out = fs.create(part, True)
        out.write(bytearray(json.dumps({"version": version, "schema": ", ".join(f"`{n}` {t}" for n, t in plain.dtypes), "places": places}).encode()))
        out.close()
        fs.mkdirs(final.getParent())
        return bool(fs.rename(part, final))
