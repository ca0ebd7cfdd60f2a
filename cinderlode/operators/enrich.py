"""Enrichment of apps from a dump of package repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlode.functions import installs as I


def keyed(apps: DataFrame, always_name: bool) -> DataFrame:
    """app_id, key: every package name an app (app_id, name, install_instructions) may go by."""
    return apps.select("app_id", F.explode(I.package_keys(I.install_map(F.col("install_instructions")), F.col("name"), always_name)).alias("key"))


def dump_popularity(apps: DataFrame, names: DataFrame, cap: int) -> DataFrame:
    """app_id, popularity: the log-normalised number of repositories that carry the app's best known key. names: repo, name.

    Names are joined only where an app has the key and are counted once a repository, so the dump is reduced before it is shuffled.
    """
    keys = keyed(apps, True)
    per = names.where("repo is not null").join(keys.select(F.col("key").alias("name")).distinct(), "name", "left_semi").select("name", "repo").distinct().groupBy("name").agg(F.count("*").alias("n"))
    return keys.join(per.withColumnRenamed("name", "key"), "key").groupBy("app_id").agg(F.max(I.popularity(F.col("n"), cap)).alias("popularity"))


def dump_installs(apps: DataFrame, dump: DataFrame, ordinal: str) -> DataFrame:
    """app_id, install_instructions of apps with install data, which get commands of managers they lack.

    dump: repo, effname, binname, srcname and an ordinal. The first package of a project and manager counts. A project is an app's if one of
    its install commands names it; where several projects do, the smaller key goes first. Present commands win; null ones are filled.
    """
    some = apps.where("length(install_instructions) > 2").withColumn("m", I.install_map(F.col("install_instructions"))).where("m is not null")
    keys = keyed(some, False)
    offers = dump.select(F.lower("effname").alias("key"), I.manager_of(F.col("repo")).alias("pm"), I.package_in(F.col("repo"), F.col("binname"), F.col("srcname")).alias("pkg"), F.col(ordinal).alias("o"))
    offers = offers.where("pm is not null and pkg is not null").join(keys.select("key").distinct(), "key", "left_semi")
    first = offers.groupBy("key", "pm").agg(F.min_by("pkg", "o").alias("pkg"))
    given = keys.join(first, "key").groupBy("app_id", "pm").agg(F.min_by("pkg", "key").alias("pkg"))
    new = given.groupBy("app_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("pm", I.build_command(F.col("pm"), F.col("pkg")).alias("c"))))).alias("new"))  # one entry a manager
    return some.join(new, "app_id", "left").select("app_id", F.to_json(I.merged_add_only(F.col("m"), F.col("new"))).alias("install_instructions"))
