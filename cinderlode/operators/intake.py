"""Records that come in: probes, enrichment, topics, prefixes, states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlode.functions import text as T
from cinderlode.functions.installs import install_map


def lookup(commands: DataFrame, path: str) -> DataFrame:
    return commands.where(F.col("cmd_path") == path)


def gated(commands: DataFrame, policy: str = "ask") -> DataFrame:
    """commands with blocked: dangerous ones under any policy but allow."""
    return commands.withColumn("blocked", (F.lower(F.trim("risk_level")) == "dangerous") & F.lit(policy != "allow"))


def enriched(arguments: DataFrame, news: DataFrame) -> DataFrame:
    """Descriptions that are not blank, risk, topics and examples of news (cmd_path, ...), one row a path, over those present."""
    n = news.select("cmd_path", *(F.nullif(F.trim(c), F.lit("")).alias("n_" + c) for c in ("description", "topics", "risk_level", "example_template")))
    told = F.col("n_description").isNotNull()
    joined = arguments.join(n, "cmd_path", "left")
    return joined.select(*(F.when(told, F.coalesce("n_" + c, c)).otherwise(F.col(c)).alias(c) if "n_" + c in n.columns else F.col(c) for c in arguments.columns))


def topic_targets(arguments: DataFrame, apps: DataFrame, least: float, most: int) -> DataFrame:
    """Commands without topics of apps with a popularity of at least least, the most popular first, most of them."""
    lacking = arguments.where("coalesce(trim(topics), '') = ''").join(apps.where(F.col("pop") >= least).select("app_id", "pop"), "app_id")
    return lacking.orderBy(F.desc("pop"), "cmd_path", "row_id").limit(most).select("row_id", "cmd_path", "pop")


def probe_imported(existing: DataFrame, apps: DataFrame, incoming: DataFrame, installs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """existing with the incoming commands it lacks, and apps with install data where they had none (installs: app_id, install_instructions)."""
    fresh = incoming.join(existing.select("cmd_path"), "cmd_path", "left_anti").select(*existing.columns)
    data = installs.select("app_id", F.col("install_instructions").alias("new"))
    filled = apps.join(data, "app_id", "left").withColumn("install_instructions", F.coalesce(F.nullif(F.trim("install_instructions"), F.lit("")), "new")).select(*apps.columns)
    return existing.unionByName(fresh), filled


def prefixed(arguments: DataFrame, apps: DataFrame) -> DataFrame:
    """Paths that lack their app's binary get it as a root, and apps that then lack a root row get one: app_id, cmd_path, made."""
    named = arguments.join(apps.select("app_id", F.lower("name").alias("binary")).where("binary <> ''"), "app_id")
    owns = F.lower(T.root(F.col("cmd_path"))) == F.col("binary")
    fixed = named.select("app_id", "binary", F.when(owns, F.col("cmd_path")).otherwise(F.concat_ws(".", "binary", "cmd_path")).alias("cmd_path"), F.when(owns, "kept").otherwise("prefixed").alias("made")).distinct()
    bare = fixed.groupBy("app_id", "binary").agg(F.max((F.lower("cmd_path") == F.col("binary")).cast("int")).alias("has")).where("has = 0")
    return fixed.select("app_id", "cmd_path", "made").unionByName(bare.select("app_id", F.col("binary").alias("cmd_path"), F.lit("root").alias("made")))


def names_without_install(apps: DataFrame) -> DataFrame:
    """name: tool names of which no app has install data, that is whose greatest text has at most two letters or is null."""
    return apps.where("name is not null").groupBy("name").agg(F.max("install_instructions").alias("most")).where("most is null or length(most) <= 2").select("name")


def topics_filled(arguments: DataFrame, found: DataFrame) -> DataFrame:
    """arguments with the topics of found (cmd_path, topics; one row a path) where they have none; others keep theirs."""
    joined = arguments.join(found.select("cmd_path", F.nullif(F.trim("topics"), F.lit("")).alias("_t")), "cmd_path", "left")
    empty = F.coalesce(F.trim("topics"), F.lit("")) == ""
    return joined.withColumn("topics", F.when(empty, F.coalesce("_t", "topics")).otherwise(F.col("topics"))).select(*arguments.columns)


def corrected_installs(apps: DataFrame, corrections: DataFrame) -> DataFrame:
    """apps with the install data of corrections (name, install_instructions; one row a name) in place of their own, by exact name."""
    told = corrections.select("name", F.col("install_instructions").alias("_c"))
    return apps.join(told, "name", "left").withColumn("install_instructions", F.coalesce("_c", "install_instructions")).select(*apps.columns)


#: Fixed pattern: a valid package name of the registry.
PACKAGE_NAME = r"^@?[a-z0-9][a-z0-9._-]*(/[a-z0-9._-]+)?$"


def npm_filled(apps: DataFrame, with_binary: DataFrame, skipped: DataFrame) -> DataFrame:
    """apps (app_id, name, install_instructions) with an npm command where none of their name has one and the registry's package of
    that name brings a binary (with_binary: name). The greatest install text of the name is the base, as JSON; names in skipped stay.
    """
    m = install_map(F.col("install_instructions"))
    lacks = F.coalesce(m["npm"], F.lit("")) == ""
    named = apps.where(lacks & F.col("name").rlike(PACKAGE_NAME)).groupBy("name").agg(F.max("install_instructions").alias("base"))
    base = F.coalesce(install_map(F.col("base")), F.from_json(F.lit("{}"), "map<string,string>"))
    entry = F.create_map(F.lit("npm"), F.concat(F.lit("npm install -g "), "name"))
    kept = F.map_filter(base, lambda k, v: k != "npm")
    new = named.join(with_binary.select("name").distinct(), "name", "left_semi").join(skipped.select("name"), "name", "left_anti").select("name", F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(kept, entry))))).alias("_n"))
    return apps.join(new, "name", "left").withColumn("install_instructions", F.when(lacks & F.col("_n").isNotNull(), F.col("_n")).otherwise(F.col("install_instructions"))).select(*apps.columns)


DONE = ("merged", "no-subcommands")


def probe_states(attempts: DataFrame, tries: int = 2) -> DataFrame:
    """attempts (tool, at, outcome) -> tool, attempts, status, terminal: merged, no-subcommands, failed, or perma-failed after tries.

    The last attempt tells the status; tools that are done or gave up are not tried again, so attempts after that do not count. Outcomes
    other than the two that end well are failures.
    """
    w = Window.partitionBy("tool").orderBy("at", "outcome")
    first = attempts.where("tool is not null").withColumn("i", F.row_number().over(w)).where(F.col("i") <= tries)
    ok = F.coalesce(F.col("outcome").isin(*DONE), F.lit(False))
    ends = first.withColumn("end", ok | (F.col("i") >= tries))
    per = ends.groupBy("tool").agg(F.min(F.when(F.col("end"), F.struct("i", F.when(ok, F.col("outcome")).otherwise("perma-failed").alias("status")))).alias("e"), F.max("i").alias("n"))
    return per.select("tool", F.coalesce("e.i", "n").alias("attempts"), F.coalesce("e.status", F.lit("failed")).alias("status"), F.col("e").isNotNull().alias("terminal"))


def content_key(column: Column) -> Column:
    """The first 16 hexadecimal digits of a SHA-256, by which artefacts are addressed."""
    return F.substring(F.sha2(column, 256), 1, 16)


def release_index(releases: DataFrame) -> DataFrame:
    """version, sync_time, delta_from of releases (version, full_time, delta_time); raises where the two times of a release differ."""
    same = F.assert_true(F.col("full_time").eqNullSafe(F.col("delta_time")), F.concat(F.lit("release times differ: "), F.col("version")))
    return releases.select("version", F.col("full_time").alias("sync_time"), same.alias("_ok")).where("_ok is null").drop("_ok")
