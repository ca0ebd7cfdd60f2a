"""Declared tables of a registry and the work list of a prober."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as Ty


def _struct(*fields: tuple[str, Ty.DataType, bool]) -> Ty.StructType:
    return Ty.StructType([Ty.StructField(n, t, nullable) for n, t, nullable in fields])


_S, _D = Ty.StringType(), Ty.DoubleType()
TABLES = {
    "apps": _struct(("app_id", _S, False), ("name", _S, False), ("os_aliases", _S, True), ("install_instructions", _S, True), ("popularity", _D, True)),
    "arguments": _struct(
        ("cmd_path", _S, False), ("app_id", _S, False), ("node_name", _S, False), ("node_type", _S, False), ("description", _S, False), ("risk_level", _S, False), ("example_template", _S, True),
        ("docker_image", _S, True), ("script_url", _S, True), ("source_url", _S, True), ("topics", _S, True), ("provenance", _S, False)),
    "index": _struct(("cmd_path", _S, False), ("name", _S, True), ("capabilities", _S, True)),
    "commands_vec": _struct(("cmd_path", _S, False), ("embedding", Ty.ArrayType(Ty.FloatType()), False)),
    "meta": _struct(("key", _S, False), ("value", _S, True)),
}
DEFAULTS = {"popularity": "0.0D", "provenance": "'inferred'"}
#: What is probed where no target file is there.
TARGETS = ["echo", "pwd", "git"]


def conformed(df: DataFrame, name: str) -> DataFrame:
    """df with exactly the columns of a declared table: absent ones are filled by their default or null, others cast, more ones dropped."""
    held = set(df.columns)
    return df.selectExpr(*(
        f"cast({f'coalesce(`{f.name}`, {DEFAULTS[f.name]})' if f.name in held and f.name in DEFAULTS else f'`{f.name}`' if f.name in held else DEFAULTS.get(f.name, 'null')} as {f.dataType.simpleString()}) as `{f.name}`"
        for f in TABLES[name]))


def create(spark: SparkSession, folder: str) -> None:
    """Empty tables where there are none; present ones are left as they are."""
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{folder}/{name}.parquet")


def missing_tables(spark: SparkSession, folder: str) -> DataFrame:
    """table, problem for each declared table: absent, or a column it lacks (columns with a default may lack); no row where all is there."""
    found = []
    for name, schema in TABLES.items():
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            found.append((name, "absent"))
            continue
        held = set(spark.read.parquet(f"{folder}/{name}.parquet").columns)
        found += [(name, f"lacks {f.name}") for f in schema if f.name not in held and f.name not in DEFAULTS and not f.nullable]
    return spark.createDataFrame(found, "table string, problem string")


def probe_targets(spark: SparkSession, path: str | None) -> DataFrame:
    """name, path of the binaries to probe, from a document {targets: [{name, path}]}; the default ones without a file."""
    if path is None:
        return spark.createDataFrame([(t, t) for t in TARGETS], "name string, path string")
    return spark.read.schema("targets array<struct<name:string,path:string>>").option("multiLine", True).json(path).selectExpr("inline(targets)")
