"""Registered queries of the training-data problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlode.core import stage, table
from cinderlode.llm.fusion import SAYS_NOTHING, STAND_INS, command_claims, foremost, posteriors, survivors
from cinderlode.llm.leaks import decontaminated, leak_report, leaked_passages
from cinderlode.llm.mixture import mixture
from cinderlode.llm.neardup import duplicate_groups, letters_of, near_duplicates
from cinderlode.llm.pieces import limits_of, split_documents
from cinderlode.llm.truncation import truncated, truncation_report
from cinderlode.llm.vectors import nearest, recall

#: Late weight for scarce sources that are worth most; the tilts are centred by the operator.
TILTS = {"goldnotes": 0.6, "rfcnotes": 0.4, "vendorkb": 0.2, "changelogs": -0.3}


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncated(table(spark, folder, "arguments"), "row_id", "description", "feed").where("cut and row_id is not null").select("row_id").distinct()


def p1_feeds(spark: SparkSession, folder: str) -> DataFrame:
    return truncation_report(table(spark, folder, "arguments"), "row_id", "description", "feed")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    apps = near_duplicates(table(spark, folder, "apps"), "app_id", letters_of("name"), least_letters=6)
    arguments = near_duplicates(table(spark, folder, "arguments"), "cmd_path", letters_of("cmd_path"), words="description")
    return apps.select(F.lit("apps").alias("tbl"), "*").unionByName(arguments.select(F.lit("arguments").alias("tbl"), "*"))


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    apps = duplicate_groups(table(spark, folder, "apps"), "app_id", letters_of("name"), least_letters=6)
    arguments = duplicate_groups(table(spark, folder, "arguments"), "cmd_path", letters_of("cmd_path"), words="description")
    return apps.select(F.lit("apps").alias("tbl"), "*").unionByName(arguments.select(F.lit("arguments").alias("tbl"), "*"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    found = nearest(table(spark, folder, "commands_vec"), "cmd_path", "embedding", least_sim=0.90)
    return found.select(F.least("key", "neighbour").alias("cmd_a"), F.greatest("key", "neighbour").alias("cmd_b")).distinct()


def p4_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "commands_vec"), "cmd_path", "embedding")


def p4_recall(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "commands_vec")
    return recall(vectors, "cmd_path", "embedding", nearest(vectors, "cmd_path", "embedding"))


def _claimed(spark: SparkSession, folder: str) -> DataFrame:
    return command_claims(table(spark, folder, "arguments_raw"), table(spark, folder, "apps"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The prescribed order is strict, so votes could change nothing: none are estimated."""
    return foremost(_claimed(spark, folder)).select(F.col("grp").alias("canon_path"), F.col("field").alias("field_name"), F.col("record").alias("rec_id"))


def p6_fused(spark: SparkSession, folder: str) -> DataFrame:
    claimed = stage(_claimed(spark, folder))
    return survivors(claimed, posteriors(claimed)).select(F.col("grp").alias("canon_path"), F.col("field").alias("field_name"), F.col("record").alias("rec_id"), "value", F.round("posterior", 6).alias("posterior"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_passages(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("doc_id", "item_id")


def p7_items(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "eval_items")
    return leak_report(items, leaked_passages(table(spark, folder, "documents"), items))


def p7_clean(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return decontaminated(documents.select("doc_id"), leaked_passages(documents, table(spark, folder, "eval_items")))


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixture(table(spark, folder, "documents"), table(spark, folder, "mix_targets"), tilts=TILTS)[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixture(table(spark, folder, "documents"), table(spark, folder, "mix_targets"), tilts=TILTS)[1]


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    limits = [x for x in limits_of(table(spark, folder, "piece_limits")) if x[0] == "standard"]
    return split_documents(table(spark, folder, "documents"), limits, with_text=False).where("n_pieces > 1").select("doc_id").distinct()


def p9_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split_documents(table(spark, folder, "documents"), limits_of(table(spark, folder, "piece_limits")))


_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"
_LEAKS = f"""
with dw as (select doc_id, {_WORDS} w from documents where text is not null),
iw as (select item_id, {_WORDS} w from eval_items where text is not null),
ig as (select distinct item_id, hash(w[i:i+11]) g from (select item_id, w, unnest(range(1, len(w) - 10)) i from iw where len(w) >= 12)),
dg as (select distinct doc_id, hash(w[i:i+11]) g from (select doc_id, w, unnest(range(1, len(w) - 10)) i from dw where len(w) >= 12)),
l as (select distinct doc_id, item_id from dg join ig using (g))
"""

_NEAR = """
with a as (select distinct app_id k, regexp_replace(lower(name), '[^\\p{L}\\p{N}]+', '', 'g') t from apps where app_id is not null),
g as (select distinct cmd_path k, regexp_replace(lower(cmd_path), '[^\\p{L}\\p{N}]+', '', 'g') t,
  list_sort(list_filter(regexp_split_to_array(lower(description), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) ws from arguments where cmd_path is not null),
b as (select k, t, list_transform(ws, lambda w, i: w || '#' || (i - list_position(ws, w))::varchar) w from g where len(ws) > 0 and t <> '')
select distinct 'apps' tbl, x.k key_a, y.k key_b from a x join a y on x.k < y.k and length(x.t) >= 6 and length(y.t) >= 6 and abs(length(x.t) - length(y.t)) <= 2 and levenshtein(x.t, y.t) <= 2
union all
select distinct 'arguments', x.k, y.k from b x join b y on x.k < y.k and abs(length(x.t) - length(y.t)) <= 2 and levenshtein(x.t, y.t) <= 2
  and len(list_intersect(x.w, y.w)) >= 0.75 * greatest(len(x.w), len(y.w))
"""
_SURVIVORS = """
with a as (select distinct lower(trim(app_id)) k from apps where trim(app_id) <> ''),
r as (select *, lower(regexp_replace(provenance, '^\\s+|\\s+$', '', 'g')) p from arguments_raw where canon_path in (select canon_path from arguments_raw group by 1 having count(*) >= 2)),
f as (select canon_path, 'app_id' field_name, rec_id, app_id v, p, loaded_at from r where lower(trim(app_id)) in (select k from a)
  union all select canon_path, 'description', rec_id, description, p, loaded_at from r
  union all select canon_path, 'example_template', rec_id, example_template, p, loaded_at from r),
w as (select *, regexp_replace(lower(v), '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g') core from f),
u as (select * from w where core <> '' and core not in (STAND_INS) and not regexp_matches(core, 'SAYS_NOTHING'))
select canon_path, field_name, rec_id from u qualify row_number() over (partition by canon_path, field_name
  order by case p when 'probe' then 0 when 'manual' then 1 when 'inferred' then 2 else 3 end, loaded_at desc nulls last, rec_id) = 1
"""
_SURVIVORS = _SURVIVORS.replace("STAND_INS", ", ".join(f"'{w}'" for w in STAND_INS)).replace("SAYS_NOTHING", SAYS_NOTHING)
_VECTORS = """
with u as (select cmd_path k, embedding e from commands_vec where len(embedding) = 384 and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0 and len(list_filter(embedding, lambda v: v <> 0)) > 0),
v as (select k, list_transform(e, lambda z: z / sqrt(list_inner_product(e::double[], e::double[])))::float[384] e from u),
s as (select x.k a, y.k b, array_inner_product(x.e, y.e) c from v x join v y on x.k <> y.k),
r as (select a, b, c, row_number() over (partition by a order by c desc, b) r from s)
select distinct least(a, b) cmd_a, greatest(a, b) cmd_b from r where r <= 10 and c >= 0.9
"""

QUERIES = {"p1_found": p1_found, "p1_feeds": p1_feeds, "p2_found": p2_found, "p2_groups": p2_groups, "p4_found": p4_found, "p4_neighbours": p4_neighbours, "p4_recall": p4_recall, "p6_found": p6_found, "p6_fused": p6_fused, "p7_found": p7_found, "p7_items": p7_items, "p7_clean": p7_clean, "p8_mixture": p8_mixture, "p8_shares": p8_shares, "p9_found": p9_found, "p9_pieces": p9_pieces}
ORACLE = {
    "p2_found": _NEAR,
    "p2_groups": f"""with recursive pr as materialized ({_NEAR}), ed as (select tbl, key_a a, key_b b from pr union select tbl, key_b, key_a from pr),
rc(tbl, k, g) as (select tbl, a, a from ed union select ed.tbl, ed.b, rc.g from rc join ed on ed.tbl = rc.tbl and ed.a = rc.k) select tbl, k "key", min(g) group_key from rc group by 1, 2""",
    "p4_found": _VECTORS,
    "p6_found": _SURVIVORS,
    "p7_found": _LEAKS + "select doc_id, item_id from l",
    "p7_items": _LEAKS + """, ip as (select item_id, i j, hash(w[i:i+11]) g from (select item_id, w, unnest(range(1, len(w) - 10)) i from iw where len(w) >= 12)),
dp as (select doc_id, i, hash(w[i:i+11]) g from (select doc_id, w, unnest(range(1, len(w) - 10)) i from dw where len(w) >= 12)),
m as (select distinct doc_id, item_id, i, i - j d from dp join ip using (g)), s as (select doc_id, item_id, d, i - row_number() over (partition by doc_id, item_id, d order by i) k from m),
r as (select doc_id, item_id, count(*) + 11 n from s group by doc_id, item_id, d, k), p as (select item_id, count(distinct doc_id) n_docs, max(n)::int longest from r group by 1)
select distinct item_set, item_id, coalesce(n_docs, 0) n_docs, coalesce(longest, 0) longest from eval_items left join p using (item_id)""",
    "p7_clean": _LEAKS + "select doc_id from documents where doc_id not in (select doc_id from l)",
}
