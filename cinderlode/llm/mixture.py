"""Mixing sources to target weights by a curriculum that changes over training.

Each source s has a weight w_s(u) over training time u in [0, 1], share_s * (1 + tilt_s * (2u - 1)); the tilts are centred so
that all weights sum to 1 at every time. Its integral W_s(u) = share_s * (u + tilt_s * (u*u - u)) is the part of the budget that
the source has delivered by u. Documents of a source stand in a fixed random order, pass after pass; the token offset q at which
a copy ends is inverted, W_s(u) = q / budget, to the copy's training position, and copies are range-sorted by it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinderlode.core import key_of, stage
from cinderlode.llm.tokens import VOCABULARY, encoding


def token_counts(documents: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """doc_id, source (trimmed, lower-cased) and n_tokens of every document with a source and a text that is not blank."""

    def run(batches):
        encode = encoding(path).encode_ordinary
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(encode(t.as_py())) for t in batch.column(2)], pa.int64())], names=["doc_id", "source", "n_tokens"])

    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), key_of(F.col(source)).alias("source"), F.col(text).alias("text"))
    return rows.where("doc_id is not null and source is not null and trim(text) <> ''").mapInArrow(run, "doc_id long, source string, n_tokens long")


def plan_shares(sizes: DataFrame, targets: DataFrame, budget: int | None = None, tilts: dict[str, float] | None = None) -> DataFrame:
    """Per target source: share (of the sources that have documents), demand in tokens, tilt. One row a source of the target table.

    Without a budget it is the largest at which every source reaches its share within max_repeats passes. With one, a source that
    would need more passes is held at its cap, and the report shows the shortfall. Sources without documents have demand 0.
    """
    given = F.create_map(*[x for k, v in (tilts or {}).items() for x in (F.lit(k), F.lit(float(v)))]) if tilts else None
    t = targets.select(key_of(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("target_share"), F.greatest(F.col("max_repeats"), F.lit(0)).alias("max_repeats")).where("source is not null")
    t = t.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    every = Window.partitionBy(F.lit(1))  # one row a source
    usable = (F.coalesce("have", F.lit(0)) > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    return (
        t.join(sizes, "source", "left").withColumn("usable", usable)
        .withColumn("share", F.when(F.col("usable"), F.col("target_share") / F.sum(F.when(F.col("usable"), F.col("target_share"))).over(every)).otherwise(0.0))
        .withColumn("budget", F.lit(float(budget)) if budget else F.floor(F.min(F.when(F.col("usable"), F.col("have") * F.col("max_repeats") / F.col("share"))).over(every)).cast("double"))
        .withColumn("demand", F.when(F.col("usable"), F.least(F.col("share") * F.col("budget"), (F.col("have") * F.col("max_repeats")).cast("double"))).otherwise(0.0))
        .withColumn("raw_tilt", F.coalesce(given[F.col("source")], F.lit(0.0)) if tilts else F.lit(0.0))
        .withColumn("centred", F.col("raw_tilt") - F.sum(F.col("share") * F.col("raw_tilt")).over(every))
        # All are made smaller alike where one is too steep, so that the weights sum to 1 at every moment.
        .withColumn("tilt", F.col("centred") / F.greatest(F.lit(1.0), F.max(F.abs("centred")).over(every)))
        .drop("raw_tilt", "centred")
    )


def mixture(documents: DataFrame, targets: DataFrame, budget: int | None = None, tilts: dict[str, float] | None = None, seed: int = 20240, slice_rows: int = 100_000, path: str = VOCABULARY, counts: DataFrame | None = None, targets_limit: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """The mixture and its report.

    Mixture: position (the token at which the copy is due, of the whole budget), doc_id, source, repeat_no (from 1), n_tokens;
    range-sorted by position. A copy belongs to the mixture if at least half of it lies before the source's demand is met, and no
    pass goes beyond max_repeats, so a source misses its demand by half a document at most. Ties are broken by doc_id and repeat_no.
    Report: one row per target source with target_share, share_reached, repeats_used, n_docs, n_copies, n_tokens, capped.
    Documents without text, id, or a source of the targets take no part. Documents delivered twice under two ids are two documents.
    """
    named = targets.select(key_of(F.col("source")).alias("target")).where("target is not null").distinct()
    if named.limit(targets_limit + 1).count() > targets_limit:
        raise ValueError(f"more than {targets_limit} target sources")
    if counts is None:
        counts = token_counts(documents.join(F.broadcast(named), key_of(F.col("source")) == F.col("target"), "left_semi"), path=path)
    counted = stage(counts)
    sizes = counted.groupBy("source").agg(F.sum("n_tokens").alias("have"), F.count("*").alias("n_docs"))
    plan = stage(plan_shares(sizes, targets, budget, tilts))
    slices = 1 << max(9, (counted.count() // slice_rows).bit_length())  # of each source, a power of two
    # Prefix sums in two steps: whole slices of each source first, then within a slice, so that no task holds a source.
    order = F.xxhash64(F.col("doc_id"), F.lit(seed))
    placed = counted.withColumn("h", order).withColumn("slice", F.shiftrightunsigned("h", 64 - (slices - 1).bit_length()).cast("int"))
    heads = (
        placed.groupBy("source", "slice").agg(F.sum("n_tokens").alias("t"))
        .withColumn("before", F.coalesce(F.sum("t").over(Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("t")
    )
    inner = Window.partitionBy("source", "slice").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    begun = placed.withColumn("within", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0))).join(F.broadcast(heads), ["source", "slice"]).select("source", "doc_id", "n_tokens", (F.col("before") + F.col("within")).alias("begin"))
    copies = (
        begun.join(F.broadcast(plan.where("usable").select("source", "have", "share", "demand", "budget", "tilt", "max_repeats")), "source")
        .withColumn("passes", F.least(F.ceil((F.col("demand") - F.col("begin") - F.col("n_tokens") / 2) / F.col("have")).cast("int"), F.col("max_repeats")))
        .where("passes > 0").withColumn("repeat_no", F.explode(F.sequence(F.lit(1), F.col("passes"))))
        .withColumn("q", F.least((F.col("begin") + (F.col("repeat_no") - 1) * F.col("have")) / F.col("demand"), F.lit(1.0)))
    )
    # u + tilt*(u*u - u) = q; the stable root of tilt*u*u + (1 - tilt)*u - q = 0.
    u = 2 * F.col("q") / ((1 - F.col("tilt")) + F.sqrt((1 - F.col("tilt")) * (1 - F.col("tilt")) + 4 * F.col("tilt") * F.col("q")))
    mixed = copies.select(F.floor(F.when(F.col("q") == 0, 0.0).otherwise(u) * F.col("budget")).alias("position"), "doc_id", "source", "repeat_no", "n_tokens")
    used = mixed.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_copies"), F.max("repeat_no").alias("repeats_used"))
    report = (
        plan.join(used, "source", "left").na.fill(0, ["n_tokens", "n_copies", "repeats_used", "n_docs"])
        .select("source", "target_share", (F.col("n_tokens") / F.sum("n_tokens").over(Window.partitionBy(F.lit(1)))).alias("share_reached"), "max_repeats", "repeats_used", "n_docs", "n_copies", "n_tokens",
                (~F.col("usable") | (F.col("demand") < F.col("share") * F.col("budget"))).alias("capped"))
    )
    return mixed.orderBy("position", "source", "doc_id", "repeat_no"), report
