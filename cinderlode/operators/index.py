"""Inverted index as tables, and BM25 over it.

Prefix terms are expanded against the dictionary by an equi-join on the terms' own prefixes, so no query term is compared with
every word. A term with underscores is a phrase: its parts must follow each other in one field, the last of them as a prefix. A
phrase's document frequency counts documents with any of its words. Searches never join a query with all documents of a common
word: a search for all words starts from the rarest one, a search for any word leaves out documents whose words cannot lift them
among the best, by bounds of each word's share (both give the exact result).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinderlode.core import stage

K1, B = 1.2, 0.75


@dataclass
class Index:
    postings: DataFrame  # doc, term, in_name, in_text: occurrences in either field
    lengths: DataFrame  # doc, size: words of both fields
    words: DataFrame  # doc, n, t: the words of either field in order
    docs: int
    mean: float


def tokens(column: str):
    return F.filter(F.split(F.lower(F.coalesce(F.col(column), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def build_index(docs: DataFrame, doc: str, name: str, text: str) -> Index:
    """Postings, lengths and corpus statistics of two fields, stored as tables; documents without words count with length 0."""
    words = stage(docs.select(F.col(doc).alias("doc"), tokens(name).alias("n"), tokens(text).alias("t")))
    lengths = words.select("doc", (F.size("n") + F.size("t")).alias("size"))
    both = words.select("doc", F.explode("n").alias("term"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        words.select("doc", F.explode("t").alias("term"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    postings = stage(both.groupBy("doc", "term").agg(F.sum("a").alias("in_name"), F.sum("b").alias("in_text")))
    stats = lengths.agg(F.count("*").alias("n"), F.avg("size").alias("mean")).first()
    return Index(postings, lengths, words, stats["n"], stats["mean"] or 1.0)


def prefix_hits(index: Index, prefixes: DataFrame) -> DataFrame:
    """prefix, doc, in_name, in_text: occurrences of words that begin with each of the (distinct) prefixes, and of phrases a_b."""
    asked = prefixes.select("prefix").where("prefix <> ''").distinct()
    words = index.postings.select("term").distinct()
    spread = words.select("term", F.explode(F.expr("transform(sequence(1, length(term)), i -> left(term, i))")).alias("prefix")).join(asked, "prefix", "left_semi")
    single = index.postings.join(spread, "term").groupBy("prefix", "doc").agg(F.sum("in_name").alias("in_name"), F.sum("in_text").alias("in_text"))
    parts = asked.where("instr(prefix, '_') > 0").withColumn("p", F.filter(F.split("prefix", "_"), lambda w: w != ""))
    # Only documents with the phrase's first word are read again; its last word is a prefix, the others stand as they are.
    near = parts.withColumn("term", F.get("p", F.lit(0))).join(index.postings.select("term", "doc"), "term").join(index.words, "doc")
    count = "size(filter(sequence(0, size({f}) - size(p)), i -> size({f}) >= size(p) and slice({f}, i + 1, size(p) - 1) = slice(p, 1, size(p) - 1) and startswith(get({f}, i + size(p) - 1), get(p, size(p) - 1))))"
    phrase = near.select("prefix", "doc", F.expr(count.format(f="n")).cast("long").alias("in_name"), F.expr(count.format(f="t")).cast("long").alias("in_text")).where("in_name + in_text > 0")
    return single.unionByName(phrase)


def shares(index: Index, prefixes: DataFrame, **weights: tuple[float, float]) -> DataFrame:
    """prefix, doc and a column for each pair of field weights: the phrase's share in the document's BM25; lower is better. Stored."""
    hits = stage(prefix_hits(index, prefixes))
    n, mean = float(index.docs), float(index.mean)
    df = hits.groupBy("prefix").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))

    def part(name_weight: float, text_weight: float):
        f = name_weight * F.col("in_name") + text_weight * F.col("in_text")
        return -idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("size") / mean))

    return stage(hits.join(df, "prefix").join(index.lengths, "doc").select("prefix", "doc", *(part(*w).alias(name) for name, w in weights.items())))


def with_all(parts: DataFrame, asked: DataFrame) -> DataFrame:
    """qid, doc of the documents that hold every prefix of a query. asked: qid, prefix. Starts from each query's rarest prefix."""
    df = parts.groupBy("prefix").agg(F.count("*").alias("df"))
    known = asked.select("qid", "prefix").distinct().join(df, "prefix", "left")
    w = Window.partitionBy("qid")
    known = known.withColumn("need", F.count("*").over(w)).withColumn("found", F.count("df").over(w)).where("need = found").withColumn("r", F.row_number().over(w.orderBy("df", "prefix")))
    first = known.where("r = 1").select("qid", "prefix", "need").join(parts.select("prefix", "doc"), "prefix").select("qid", "doc", "need")
    rest = known.where("r > 1").select("qid", "prefix").join(first, "qid").join(parts.select("prefix", "doc"), ["prefix", "doc"], "left_semi")
    whole = rest.groupBy("qid", "doc", "need").agg(F.count("*").alias("have")).where("have = need - 1").select("qid", "doc")
    return first.where("need = 1").select("qid", "doc").unionByName(whole)


def scored(parts: DataFrame, asked: DataFrame, docs: DataFrame, *scores: str) -> DataFrame:
    """qid, doc and the summed shares of the query's prefixes in the stated documents. docs: qid, doc."""
    found = docs.join(asked.select("qid", "prefix").distinct(), "qid").join(parts, ["prefix", "doc"])
    return found.groupBy("qid", "doc").agg(*(F.round(F.sum(s), 6).alias(s) for s in scores))


def best_with_any(parts: DataFrame, asked: DataFrame, most: int, score: str) -> DataFrame:
    """qid, doc, score: the best documents (most of them, at least) that hold any prefix of a query. Scores are rounded to 6 digits.

    A query's prefixes are ordered by the largest share each has anywhere. The documents of the strongest prefix give a score
    that the last place needs at least; documents with only the weakest prefixes, whose shares together stay below it, are never
    expanded, and of the others those are completed that can still reach it.
    """
    asked = asked.select("qid", "prefix").distinct()
    bound = parts.groupBy("prefix").agg(F.max(-F.col(score)).alias("bound"))
    ordered = stage(asked.join(bound, "prefix").withColumn("below", F.sum("bound").over(Window.partitionBy("qid").orderBy("bound", "prefix").rowsBetween(Window.unboundedPreceding, 0)))
                    .withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("bound"), F.desc("prefix")))))
    value = parts.select("prefix", "doc", (-F.col(score)).alias("s"))
    lead = ordered.where("r = 1").select("qid", "prefix").join(value, "prefix")
    bar = lead.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("s")))).where(F.col("r") == most).select("qid", (F.col("s") - 1e-5).alias("bar"))
    placed = stage(ordered.join(bar, "qid", "left").withColumn("bar", F.coalesce("bar", F.lit(0.0))).withColumn("strong", F.col("below") >= F.col("bar")))
    weak = placed.where("not strong")
    spare = weak.groupBy("qid").agg(F.max("below").alias("spare"))
    open_ = placed.where("strong").select("qid", "prefix", "bar").join(value, "prefix").groupBy("qid", "doc", "bar").agg(F.sum("s").alias("s"))
    open_ = stage(open_.join(spare, "qid", "left").where(F.col("s") + F.coalesce("spare", F.lit(0.0)) >= F.col("bar")).select("qid", "doc", "s"))
    more = weak.select("qid", "prefix").join(open_.select("qid", "doc"), "qid").join(value, ["prefix", "doc"]).select("qid", "doc", "s")
    return open_.unionByName(more).groupBy("qid", "doc").agg(F.round(-F.sum("s"), 6).alias(score))


def ranked(scores: DataFrame, by: list, most: int, position: str = "pos", partition: str = "qid") -> DataFrame:
    """The best rows of each query with their position; by must be a total order."""
    return scores.withColumn(position, F.row_number().over(Window.partitionBy(partition).orderBy(*by))).where(F.col(position) <= most)
