"""The build of a registry out of an export (M1): every pass in its order, as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlode.core import stage
from cinderlode.functions import installs as I
from cinderlode.functions import text as T
from cinderlode.operators import curate as C
from cinderlode.operators.sync import reusable

SCHEMA_VERSION = 2


def built(
    apps: DataFrame, arguments: DataFrame, patches: DataFrame, additions: DataFrame, stored: DataFrame, model: str, stored_model: str, synced: int,
    borrowers: tuple[str, ...], last: tuple[str, ...], least: int = 20, times: int = 5,
) -> dict[str, DataFrame]:
    """The tables of a registry: apps, arguments, index, embed, meta.

    apps: app_id, name, os_aliases, install_instructions, pop, ord (input order); arguments: row_id, cmd_path, app_id, description, risk_level,
    example_template, topics, provenance; patches and additions as for overridden and added; stored: cmd_path, text of vectors that exist.
    Paths are cleaned and the first row of each kept, noise dropped, overrides applied, roots moved to the app that owns their tree,
    paths that mean the same merged; then texts for the index and the encoder are made (a text whose vector exists is not embedded
    again, unless the model changed), install data are stripped of nulls and lent to same-name apps.
    """
    rows = C.cleaned(arguments, "row_id")
    rows = C.added(C.overridden(rows, patches), additions, apps)
    rows = C.reanchored(rows, apps.select("app_id", "name", "ord"), least, times)
    one = stage(C.canonical(rows, apps.select("app_id", "pop")).select("cmd_path", F.col("topics").alias("united")))
    rows = rows.drop("topics").join(one.withColumnRenamed("united", "topics"), "cmd_path")
    p, d, t = F.col("cmd_path"), F.col("description"), F.col("topics")
    loaded = stage(rows.select(
        "cmd_path", "app_id", T.leaf(p).alias("node_name"), T.node_type(p).alias("node_type"), "description", T.risk(p, d, F.col("risk_level")).alias("risk_level"), "example_template", "topics",
        F.coalesce(F.nullif("provenance", F.lit("")), F.lit("inferred")).alias("provenance")))
    named = loaded.join(apps.select("app_id", "name"), "app_id", "left")
    index = named.select("cmd_path", T.index_name(F.col("app_id"), F.col("name")).alias("name"), T.index_text(p, d, t).alias("capabilities"))
    embed = reusable(loaded.select("cmd_path", T.embed_text(p, d, t).alias("text")), stored, model, stored_model)
    kept = apps.withColumn("install_instructions", I.stripped(F.col("install_instructions"))).withColumn("os_aliases", I.stripped(F.col("os_aliases")))
    lent = C.donors(kept, borrowers, last).select("app_id", F.col("install_instructions").alias("lent"), "donor")
    final = kept.join(lent, "app_id").select("app_id", "name", "os_aliases", F.col("lent").alias("install_instructions"), F.coalesce("pop", F.lit(0.0)).alias("popularity"))
    meta = apps.sparkSession.createDataFrame([("schema_version", str(SCHEMA_VERSION)), ("last_sync_time", str(synced)), ("embed_model", model)], "key string, value string")
    return {"apps": final, "arguments": loaded, "index": index, "embed": embed, "meta": meta}
