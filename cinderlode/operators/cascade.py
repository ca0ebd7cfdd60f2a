"""Hybrid cascading search for whole batches of queries.

Every relation carries qid. Stage 1 ranks apps by fused text and vector positions with a popularity prior, stage 2 ranks the
commands of the chosen apps, a composite of integer scores re-ranks them, exact matches go first, and a confidence label tells
whether the nearest vector is near enough.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinderlode.core import stage
from cinderlode.functions import lexicon as L
from cinderlode.functions import text as T
from cinderlode.operators.index import Index, best_with_any, ranked, scored, shares, with_all
from cinderlode.operators.knn import knn


@dataclass(frozen=True)
class Settings:
    limit: int = 5
    cold_floor: float = 1.0
    danger: float = 0.75
    verified_bonus: int = 12
    hard: float = L.HARD_DISTANCE
    soft: float = L.SOFT_DISTANCE
    dims: int = 384
    drop_out_of_domain: bool = False

    @classmethod
    def of(cls, spark: SparkSession, **given) -> "Settings":
        """Settings by the session's configuration (cinderlode.search.<name>), and over it those given."""
        kinds = {f.name: type(f.default) for f in fields(cls)}
        told = {n: spark.conf.get(f"cinderlode.search.{n}", None) for n in kinds}
        read = {n: (v.strip().lower() == "true") if kinds[n] is bool else kinds[n](v) for n, v in told.items() if v is not None}
        return cls(**(read | given))


def phrases_of(queries: DataFrame) -> DataFrame:
    """qid, group, prefix for the groups and, or (with concept synonyms) and alias; a prefix with underscores is a phrase of its parts."""
    q = queries.select("qid", T.robust(F.col("text")).alias("t"))
    sets = F.array(*(F.struct(F.lit(g).alias("group"), f(F.col("t")).alias("terms")) for g, f in (("and", T.query_terms), ("or", T.expanded_terms), ("alias", T.alias_terms))))
    words = q.select("qid", F.explode(sets).alias("s")).select("qid", "s.group", F.explode("s.terms").alias("term"))
    # Outer and repeated underscores part nothing.
    return words.select("qid", "group", F.array_join(F.filter(F.split("term", "_"), lambda w: w != ""), "_").alias("prefix")).where("prefix <> ''").distinct()


def confidence(nearest: DataFrame, queries: DataFrame, and_match: DataFrame, s: Settings) -> DataFrame:
    """qid, confidence: none beyond the hard distance without a text match, low from the soft one or with it, else high."""
    d, near = F.coalesce("distance", F.lit(3.4e38)), F.coalesce("hit", F.lit(False))
    told = F.when(~F.col("has_vec"), "high").when((d > s.hard) & ~near, "none").when((d > s.soft), "low").otherwise("high")
    return queries.select("qid", F.col("vec").isNotNull().alias("has_vec")).join(nearest, "qid", "left").join(and_match.withColumn("hit", F.lit(True)), "qid", "left").select("qid", told.alias("confidence"))


def search(queries: DataFrame, commands: DataFrame, apps: DataFrame, vectors: DataFrame, index: Index, s: Settings = Settings()) -> DataFrame:
    """queries (qid, text, vec) -> qid, pos, doc, app, confidence.

    commands: doc, app, path, node_type, risk, provenance (one row a doc); apps: app, name, pop; vectors: doc, embedding. index: over
    the docs of commands. Scores are rounded and ties end with the doc, so results are total and do not depend on the partitioning.
    A query without words and vector gives its exact matches.
    """
    phrases = stage(phrases_of(queries))
    parts = shares(index, phrases, wide=(5.0, 2.0), narrow=(10.0, 1.0))
    whole = stage(with_all(parts, phrases.where("group = 'and'")))
    and_match = stage(whole.select("qid").distinct())
    # Where a document has all words of a query, these and tool aliases are asked for; otherwise any word or synonym.
    alias = phrases.where("group = 'alias'").join(and_match, "qid", "left_semi").select("qid", "prefix")
    loose = stage(phrases.where("group = 'or'").join(and_match, "qid", "left_anti").select("qid", "prefix"))
    strict = scored(parts, phrases.where("group = 'and'"), whole, "wide", "narrow")
    named = alias.join(parts, "prefix").groupBy("qid", "doc").agg(F.sum("wide").alias("wide"), F.sum("narrow").alias("narrow"))
    sure = stage(strict.unionByName(named).groupBy("qid", "doc").agg(F.round(F.sum("wide"), 6).alias("wide"), F.round(F.sum("narrow"), 6).alias("narrow")))
    tokens = stage(queries.select("qid", T.content_tokens(T.robust(F.col("text"))).alias("ct"), F.lower(F.trim("text")).alias("raw"), F.col("vec").isNotNull().alias("has_vec")).withColumn("nt", F.size("ct")))
    meta = commands.select("doc", "app", "path", "node_type", "risk", "provenance")
    pop = apps.select("app", F.coalesce("name", F.lit("")).alias("nm"), F.coalesce("pop", F.lit(0.0)).alias("pop"))

    text1 = sure.select("qid", "doc", F.col("wide").alias("score")).unionByName(best_with_any(parts, loose, L.POOL_FTS, "wide").withColumnRenamed("wide", "score"))
    text1 = stage(ranked(text1, ["score", "doc"], L.POOL_FTS))
    valid = F.col("risk").isin(*L.RISKS)  # others are no contract; they take their places in the pools and are dropped there
    near = stage(knn(queries, vectors, L.POOL_VEC, s.dims).join(meta.select("doc"), "doc", "left_semi"))
    exact = (
        meta.join(pop, "app").withColumn("key", F.explode(F.array_distinct(F.array(F.lower("path"), F.when(F.col("node_type") == "root", F.lower("nm")))))).where("key is not null")
        .join(tokens.select("qid", F.col("raw").alias("key")), "key").select("qid", "doc", "app", "risk").distinct()
    )
    exact = ranked(exact, ["doc"], s.limit).where(valid)

    # Stage 1: apps.
    by_text = text1.join(meta.select("doc", "app"), "doc").groupBy("qid", "app").agg(F.min("pos").alias("fts"))
    roots = ranked(near.drop("pos").join(meta.where("node_type = 'root'").select("doc", "app"), "doc"), ["distance", "doc"], L.POOL_VEC)
    by_vec = roots.groupBy("qid", "app").agg(F.min("pos").alias("vecpos"))
    root_risk = commands.where("node_type = 'root'").groupBy("app").agg(F.min("risk").alias("root_risk"))
    few = F.col("nt") <= 1
    trust = F.when(F.col("root_risk") == "dangerous", s.danger).otherwise(1.0)
    score = (
        F.coalesce((s.cold_floor + (1 - s.cold_floor) * F.col("pop")) / (L.RRF_K + F.col("fts")), F.lit(0.0)) + F.coalesce(1.0 / (L.RRF_K + F.col("vecpos")), F.lit(0.0))
        + F.when(few, 0.05 * F.col("pop")).otherwise(0.015 * F.col("pop") * F.col("pop") * F.col("pop")) * trust
    )
    fused = by_text.join(by_vec, ["qid", "app"], "full_outer").join(pop, "app").join(root_risk, "app", "left").join(tokens.select("qid", "nt"), "qid").withColumn("s1", F.round(score, 9))
    first_of_name = fused.withColumn("r", F.row_number().over(Window.partitionBy("qid", "nm").orderBy(F.desc("s1"), "app"))).where("r = 1")
    kept = ranked(first_of_name, [F.desc("s1"), "app"], L.APPS_KEPT).select("qid", "app", "pos")
    extra = ranked(text1.where(F.col("pos") <= L.POOL_FTS_SCOPED).join(meta.select("doc", "app"), "doc").groupBy("qid", "app").agg(F.min("pos").alias("p")), ["p", "app"], L.APPS_INJECTED).select("qid", "app", (F.col("pos") + 100).alias("pos"))
    extra = extra.join(kept.select("qid").distinct(), "qid", "left_semi")
    chosen = ranked(kept.unionByName(extra).groupBy("qid", "app").agg(F.min("pos").alias("o")), ["o"], L.APPS_CAP).select("qid", "app")

    # Stage 2: commands of the chosen apps; positions are global, the scope is applied after them.
    hybrid = tokens.where("has_vec").select("qid")
    with_vec = best_with_any(parts, loose.join(hybrid, "qid", "left_semi"), L.POOL_FTS_SCOPED, "narrow")
    text2 = ranked(sure.join(hybrid, "qid", "left_semi").select("qid", "doc", "narrow").unionByName(with_vec), ["narrow", "doc"], L.POOL_FTS_SCOPED).select("qid", "doc", F.col("pos").alias("f"))
    vec2 = near.where(F.col("pos") <= L.POOL_VEC_SCOPED).select("qid", "doc", F.col("pos").alias("v"))
    both = text2.join(vec2, ["qid", "doc"], "full_outer").select("qid", "doc", F.round(F.coalesce(1.0 / (L.RRF_K + F.col("f")), F.lit(0.0)) + F.coalesce(1.0 / (L.RRF_K + F.col("v")), F.lit(0.0)), 9).alias("s2"))
    # Queries without a vector rank all text matches of the chosen apps.
    owned = parts.join(meta.select("doc", "app"), "doc")
    some = loose.join(hybrid, "qid", "left_anti").join(chosen, "qid").join(owned, ["prefix", "app"]).groupBy("qid", "doc").agg(F.round(F.sum("wide"), 6).alias("wide"))
    alone = sure.join(hybrid, "qid", "left_anti").select("qid", "doc", "wide").unionByName(some).select("qid", "doc", (-F.col("wide")).alias("s2"))
    pool = ranked(both.unionByName(alone).join(meta, "doc").join(chosen, ["qid", "app"], "left_semi"), [F.desc("s2"), "doc"], max(s.limit, L.POOL_LEAST), "first")
    pool = ranked(pool.where(valid), ["first"], max(s.limit, L.POOL_LEAST), "i").join(pop, "app").join(tokens.drop("raw", "has_vec"), "qid")
    n = F.count("*").over(Window.partitionBy("qid"))
    composite = F.when((F.col("nt") >= 1) & (n > 1), (
        n - (F.col("i") - 1) + F.when(F.col("nt") >= 2, 4).otherwise(1) * T.path_score(F.col("path"), T.path_expansion(F.col("ct"))) + (F.when(few, 15).otherwise(3) * F.col("pop")).cast("int")
        + F.when((F.col("node_type") == "root") & few, 20).otherwise(0) + F.when(F.col("provenance") == "probe", s.verified_bonus).otherwise(0))).otherwise(n - (F.col("i") - 1))
    reranked = ranked(pool.withColumn("composite", composite), [F.desc("composite"), "i"], 10**6).select("qid", "doc", "app", (F.col("pos") + 10**6).alias("o"))

    merged = exact.select("qid", "doc", "app", F.col("pos").alias("o")).unionByName(reranked).groupBy("qid", "doc", "app").agg(F.min("o").alias("o"))
    capped = merged.withColumn("nth", F.row_number().over(Window.partitionBy("qid", "app").orderBy("o"))).where(F.col("nth") <= L.PER_APP)
    nearest = near.where(F.col("pos") <= L.POOL_VEC_SCOPED).groupBy("qid").agg(F.min("distance").alias("distance"))
    out = ranked(capped, ["o"], s.limit).join(confidence(nearest, queries, and_match, s), "qid").select("qid", "pos", "doc", "app", "confidence")
    return out.where("confidence <> 'none'") if s.drop_out_of_domain else out


def with_skills(found: DataFrame, queries: DataFrame, skills: DataFrame, limit: int, block: int = 10_000) -> DataFrame:
    """Skills appended to search results (qid, pos, doc, ...): qid, pos, doc, source (search or skill), each doc once, limit a query.

    skills: path, name, description, one row a skill. A skill matches if its name, path and description together contain every word of
    the query; a query without words matches all. Skills are few (a user's folder): they go to the tasks in blocks of at most
    block rows, each block against all queries.
    """
    hay = F.lower(F.concat_ws(" ", "name", "path", "description"))
    offered = stage(skills.where("path is not null").groupBy("path").agg(F.min(hay).alias("hay")))
    blocks = max(1, -(-offered.count() // block))
    asked = queries.select("qid", F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "").alias("words"))
    extra = None
    for part in range(blocks):
        some = F.broadcast(offered.where(f"pmod(xxhash64(path), {blocks}) = {part}"))
        hit = asked.join(some, F.expr("forall(words, w -> contains(hay, w))")).select("qid", F.col("path").alias("doc"))
        extra = hit if extra is None else extra.unionByName(hit)
    extra = ranked(extra, ["doc"], limit).select("qid", "doc", (F.col("pos") + 10**6).alias("o"), F.lit("skill").alias("source"))
    both = found.select("qid", "doc", F.col("pos").cast("int").alias("o"), F.lit("search").alias("source")).unionByName(extra)
    once = both.groupBy("qid", "doc").agg(F.min_by("source", "o").alias("source"), F.min("o").alias("o"))
    return ranked(once, ["o"], limit).select("qid", "pos", "doc", "source")
