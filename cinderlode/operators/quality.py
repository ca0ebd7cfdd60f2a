"""Data-quality checks of a registry (V1-V9, A3-A5): each gives rows check, status (pass, warn, fail), n."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlode.functions import lexicon as L
from cinderlode.functions import text as T
from cinderlode.functions.installs import install_map


def _tidy(df: DataFrame, counts: dict[str, tuple[str, Column]]) -> DataFrame:
    """One scan of df for all counts: name -> (status where it is above 0, what to count)."""
    one = df.agg(*(F.sum(F.coalesce(c.cast("int"), F.lit(0))).alias(name) for name, (_, c) in counts.items()))
    rows = F.array(*(F.struct(F.lit(name).alias("check"), F.lit(bad).alias("bad"), F.coalesce(F.col(name), F.lit(0)).cast("long").alias("n")) for name, (bad, _) in counts.items()))
    return one.select(F.explode(rows).alias("r")).select("r.check", F.when(F.col("r.n") > 0, F.col("r.bad")).otherwise("pass").alias("status"), "r.n")


def node_types(arguments: DataFrame) -> DataFrame:
    dot = F.contains("cmd_path", F.lit("."))
    return _tidy(arguments, {"root_with_dot": ("fail", (F.col("node_type") == "root") & dot), "sub_without_dot": ("fail", (F.col("node_type") == "sub") & ~dot),
                             "node_type_unknown": ("fail", F.col("node_type").isNull() | ~F.col("node_type").isin("root", "sub"))})


def install_data(apps: DataFrame) -> DataFrame:
    m = install_map(F.col("install_instructions"))
    told = apps.select("install_instructions", m.alias("m"))
    return _tidy(told, {
        "install_null": ("warn", F.col("install_instructions").isNull()), "install_malformed": ("fail", F.col("install_instructions").isNotNull() & F.col("m").isNull()),
        "install_empty_value": ("fail", F.exists(F.map_values("m"), lambda v: v.isNull() | (F.trim(v) == ""))), "install_unknown_key": ("warn", F.size(F.array_except(F.map_keys("m"), F.array(*map(F.lit, L.KNOWN_MANAGERS)))) > 0)})


def descriptions(arguments: DataFrame) -> DataFrame:
    d = F.trim("description")
    generic = (F.length(d) < 50) & reduce(lambda a, b: a | b, (F.lower(d).startswith(p) for p in L.BAD_DESCRIPTIONS))
    return _tidy(arguments, {"description_empty": ("fail", F.col("description").isNull() | (d == "")), "description_short": ("fail", (d != "") & (F.length(d) < 4)), "description_placeholder": ("warn", (d != "") & generic)})


def examples(arguments: DataFrame) -> DataFrame:
    judged = arguments.where("coalesce(lower(trim(provenance)), 'inferred') = 'inferred' and trim(example_template) <> '' and cmd_path is not null").select(T.example_fault(F.col("cmd_path"), F.col("example_template")).alias("f"))
    return _tidy(judged, {"example_other_binary": ("warn", F.col("f") == "binary"), "example_stray_word": ("warn", F.col("f") == "subcommand")})


def index_consistency(arguments: DataFrame, vectors: DataFrame, postings_docs: DataFrame) -> DataFrame:
    """Rows of the fact table against the documents of the text index and of the vector index, by key."""
    keys = arguments.select("cmd_path").distinct()
    return (
        keys.join(vectors.select("cmd_path"), "cmd_path", "left_anti").agg(F.count("*").alias("n")).select(F.lit("without_vector").alias("check"), "n")
        .unionByName(keys.join(postings_docs.select(F.col("doc").alias("cmd_path")), "cmd_path", "left_anti").agg(F.count("*").alias("n")).select(F.lit("without_text").alias("check"), "n"))
        .unionByName(vectors.select("cmd_path").join(keys, "cmd_path", "left_anti").agg(F.count("*").alias("n")).select(F.lit("vector_orphan").alias("check"), "n"))
        .select("check", F.when(F.col("n") > 0, "fail").otherwise("pass").alias("status"), "n"))


def coverage(arguments: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected (tool, sub) pairs that are not there; a null sub asks only for the tool. Result: tool, sub."""
    have = arguments.select(F.lower(T.root(F.col("cmd_path"))).alias("tool"), F.lower(F.get(F.split("cmd_path", r"\."), F.lit(1))).alias("sub"))
    pairs = have.unionByName(have.select("tool", F.lit(None).cast("string").alias("sub"))).distinct()
    e, p = expected.select("tool", "sub"), pairs.select(F.col("tool").alias("t"), F.col("sub").alias("s"))
    return e.join(p, F.col("tool").eqNullSafe(F.col("t")) & F.col("sub").eqNullSafe(F.col("s")), "left_anti")


def subcommand_histogram(arguments: DataFrame) -> DataFrame:
    sizes = arguments.groupBy("app_id").agg(F.count("*").alias("n"))
    bucket = F.when(F.col("n") == 1, "1").when(F.col("n") <= 5, "2-5").when(F.col("n") <= 20, "6-20").otherwise(">20")
    return sizes.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("apps"), F.sum("n").alias("commands"))


def tool_depth(arguments: DataFrame, tools: DataFrame, least: int = 5) -> DataFrame:
    """tool, subs, depth, status of the given tools: fail without a subcommand, warn under least or without a second level."""
    parts = F.size(F.split("cmd_path", r"\."))
    per = arguments.groupBy(F.lower(T.root(F.col("cmd_path"))).alias("tool")).agg(F.sum(F.when(parts > 1, 1).otherwise(0)).alias("subs"), F.max(parts).alias("depth"))
    joined = tools.select("tool").join(per, "tool", "left").na.fill(0)
    return joined.withColumn("status", F.when(F.col("subs") == 0, "fail").when((F.col("subs") < least) | (F.col("depth") < 3), "warn").otherwise("pass"))
