"""Retrieval evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinderlode.functions import lexicon as L
from cinderlode.functions import text as T

#: How bad a kind of failure is, 0 the worst.
SEVERITY = {"not_found": 0, "canonical_burial": 1, "inferred_attractor": 1, "sibling_misorder": 2, "genuine_ambiguity": 3}


def first_hits(results: DataFrame, accepted: DataFrame) -> DataFrame:
    """cases (qid) with the rank of the first result whose path segments meet the accepted tokens; null where none does.

    Results that state lead and an accepted token already (best_any with cases) are judged where they lie.
    """
    beside = results if "token" in results.columns else results.join(accepted.select("qid", "token").distinct(), "qid")
    met = beside.where(F.array_contains(T.segments_of(F.col("doc")), F.lower("token")))
    hit = met.groupBy(*_lead(met), "qid").agg(F.min("pos").alias("rank")).groupBy("qid").agg(F.min("rank").alias("rank"))
    return accepted.select("qid").distinct().join(hit, "qid", "left")


def _lead(results: DataFrame) -> list[str]:
    return ["lead"] if "lead" in results.columns else []


def metrics(ranks: DataFrame, by: str | None = None) -> DataFrame:
    """Cases, found rate, recall at 1 and 5, mean reciprocal rank; with by, per category and in all (null category)."""
    columns = [F.count("*").alias("cases"), F.round(F.avg(F.col("rank").isNotNull().cast("double")), 6).alias("found"), *(F.round(F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))), 6).alias(f"recall_{k}") for k in (1, 5)),
               F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr")]
    return ranks.rollup(by).agg(*columns) if by else ranks.agg(*columns)


def quantiles(values: DataFrame, value: str, by: str, slices: int = 64) -> DataFrame:
    """Per group: the value at index floor(q n) of the sorted values for five q, and the interpolated median.

    Equal values are counted first. A group is cut in slices at approximate quantiles, which only part the work: counts up to a value are summed
    within its slice and over the slices before it, so the result is exact and no task sorts a whole group.
    """
    counted = values.where(f"{value} is not null").groupBy(by, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    bounds = counted.groupBy(by).agg(F.percentile_approx("v", [i / slices for i in range(1, slices)], 1000).alias("bounds"))
    bounds = bounds.withColumnRenamed(by, "_b")
    cut = counted.join(F.broadcast(bounds), F.expr(f"`{by}` <=> _b")).select(by, "v", "c", F.size(F.filter("bounds", lambda b: b < F.col("v"))).alias("slice"))
    per = cut.groupBy(by, "slice").agg(F.sum("c").alias("s"))
    all_, ahead = Window.partitionBy(by), Window.partitionBy(by).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(F.col(by).alias("_b"), F.col("slice").alias("_s"), F.coalesce(F.sum("s").over(ahead), F.lit(0)).alias("before"), F.sum("s").over(all_).alias("n"))
    placed = cut.join(F.broadcast(per), F.expr(f"`{by}` <=> _b and slice = _s")).withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy(by, "slice").orderBy("v")))

    def at(index):
        return F.min(F.when(F.col("upto") > index, F.col("v")))

    n = F.col("n")
    middle = (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2
    return placed.groupBy(by).agg(F.max("n").alias("n"), F.min("v").alias("least"), *(at(F.floor(n * q)).alias(name) for q, name in ((0.25, "p25"), (0.75, "p75"), (0.9, "p90"))), middle.alias("median"), F.max("v").alias("most"))


def threshold_sweep(distances: DataFrame, grid: list[float]) -> DataFrame:
    """For each threshold: wanted rows beyond it (damaged) and unwanted ones beyond it (filtered). distances: distance, wanted.

    The thresholds are few and fixed; each row adds to all of them in one pass.
    """
    sums = distances.agg(*(F.sum(((F.col("distance") > t) & (F.col("wanted") == w)).cast("int")).alias(f"{name}{i}") for i, t in enumerate(grid) for w, name in ((True, "d"), (False, "f"))))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"d{i}").alias("damaged"), F.col(f"f{i}").alias("filtered")) for i, t in enumerate(grid)))).alias("r")).select("r.*")


def verdicts(cases: DataFrame, results: DataFrame, k: int = 5, near: int = 20) -> DataFrame:
    """cases (qid, target), results (qid, pos, doc, verified) -> qid, target, status, rank, category, blocker.

    A target within k passes, within near is a near miss. Failures are classed by their first k results: none, one of the target's
    own tool, an unverified one, or none of these. Results that state lead and target already (best_any with cases) are judged where they lie.
    """
    shown = results.where(F.col("pos") <= near)
    joined = shown if "target" in results.columns else cases.join(shown, "qid", "left")
    top = F.col("pos") <= k
    other = top & (F.col("doc") != F.col("target"))
    per = joined.groupBy(*_lead(joined), "qid", "target").agg(
        F.min(F.when(F.col("doc") == F.col("target"), F.col("pos"))).alias("rank"), F.sum(F.when(top, 1).otherwise(0)).alias("shown"), F.max(other & (T.root(F.col("doc")) == T.root(F.col("target")))).alias("sibling"),
        F.max(top & ~F.col("verified")).alias("unverified"), F.min_by("doc", F.when(top, F.col("pos"))).alias("blocker"))
    if "target" in results.columns:  # cases without results follow
        per = cases.select("qid", "target").distinct().join(per.drop("lead"), ["qid", "target"], "left").withColumn("shown", F.coalesce("shown", F.lit(0)))
    status = F.when(F.col("rank") <= k, "pass").when(F.col("rank").isNotNull(), "near_miss").otherwise("fail")
    category = F.when(F.col("shown") == 0, "not_found").when(F.col("sibling"), "sibling_misorder").when(F.col("unverified"), "canonical_burial").otherwise("genuine_ambiguity")
    return per.withColumn("status", status).withColumn("category", F.when(F.col("status") != "pass", category)).select("qid", "target", "status", "rank", "category", "blocker")


def verdict_counts(judged: DataFrame) -> DataFrame:
    """status, category, n: what a report begins with; passes have no category."""
    return judged.groupBy("status", "category").agg(F.count("*").alias("n"))


def attractors(judged: DataFrame, least: int = 3) -> DataFrame:
    return judged.where("status <> 'pass' and blocker is not null").groupBy("blocker").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def failure_report(judged: DataFrame) -> DataFrame:
    """Failures with the category of attractors set, worst first."""
    pull = attractors(judged).select("blocker", F.lit(True).alias("pull"))
    told = judged.where("status <> 'pass'").join(pull, "blocker", "left").withColumn("category", F.when(F.col("pull"), "inferred_attractor").otherwise(F.col("category")))
    severity = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])[F.col("category")]
    return told.withColumn("severity", severity).orderBy("severity", "target").select("qid", "target", "category", "severity")


def suggestions(query):
    """Distinct content words of a failed query, in order."""
    words = F.transform(F.split(F.lower(query), r"\s+"), lambda w: F.regexp_replace(w, r"^[.,()\[\]<>]+|[.,()\[\]<>]+$", ""))
    return F.array_join(F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*L.REPORT_STOP_WORDS))), " ")


BURIALS = ("canonical_burial", "inferred_attractor")


def override_suggestions(failures: DataFrame, queries: DataFrame) -> DataFrame:
    """failures (qid, target, category) with the words of their query that an override could append to the target's topics.

    Only for targets that others bury; null for other failures, and where the query has no such word.
    """
    words = F.nullif(suggestions(F.col("text")), F.lit(""))
    return failures.join(queries.select("qid", "text"), "qid").select("qid", "target", "category", F.when(F.col("category").isin(*BURIALS), words).alias("topics_append"))


def json_in_prose(text):
    """The object between the first { and the last } of a text, parsed as a map; null where there is none."""
    return F.from_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1), "map<string,string>")
