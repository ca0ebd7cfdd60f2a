"""Registered queries of synchronisation, quality, evaluation, export, help texts and streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinderlode.core import key_of, shared_folder, stage, table
from cinderlode.functions import helptext as H
from cinderlode.functions import lexicon as L
from cinderlode.functions import text as T
from cinderlode.operators import evaluate as E
from cinderlode.operators import export as X
from cinderlode.operators import quality as V
from cinderlode.operators import sync as S
from cinderlode.operators.knn import knn
from cinderlode.plans.curation_queries import _APPS, _ARGS, _arguments, _apps
from cinderlode.plans.search_queries import _CATALOGUE, _EMB, _asked, _bm25_sql, _index, _q, _ranking, catalogue
from cinderlode.streaming.feed import apply_feed, live, windowed_counts


BY = ["step"]


def _snapshots(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Apps and commands of every snapshot with its step, keys trimmed, one row each: the smallest of repeated ones."""
    a, g = S.numbered(table(spark, folder, "apps_snap"), "snap_no"), S.numbered(table(spark, folder, "arguments_snap"), "snap_no")
    a = a.select("step", F.trim("app_id").alias("app_id"), F.trim("name").alias("name")).where("app_id <> ''")
    g = g.select("step", *(F.trim(c).alias(c) for c in ("cmd_path", "app_id", "description", "risk_level"))).where("cmd_path <> '' and app_id <> ''")
    first = g.groupBy("step", "cmd_path").agg(F.min(F.struct("app_id", "description", "risk_level")).alias("r")).select("step", "cmd_path", "r.*")
    return stage(a.groupBy("step", "app_id").agg(F.min("name").alias("name"))), stage(first)


def _steps(pair):
    """Old and new states of every step between consecutive snapshots, both under the later one's step."""
    last = pair[0].agg(F.max("step")).first()[0] or 0
    return tuple(x.withColumn("step", F.col("step") + 1).where(F.col("step") <= last) for x in pair), tuple(x.where("step > 1") for x in pair)


def _prints(pair):
    return S.fingerprints(pair[0], pair[1], ["name"], ["cmd_path", "description", "risk_level"], by=BY)


def snapshot_diff(spark: SparkSession, folder: str) -> DataFrame:
    old, new = _steps(_snapshots(spark, folder))
    return S.difference(_prints(old), _prints(new), BY)


def _applied(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, tuple[DataFrame, DataFrame]]:
    old, new = _steps(_snapshots(spark, folder))
    changes = stage(S.difference(_prints(old), _prints(new), BY))
    fresh = S.payload(changes, *new, by=BY)
    return S.applied(old[0], fresh["apps"], changes, BY), S.applied(old[1], fresh["arguments"], changes, BY), new


def delta_apply(spark: SparkSession, folder: str) -> DataFrame:
    """The commands of each snapshot brought to the next one by the payload of their difference."""
    return _applied(spark, folder)[1]


def delta_apply_apps(spark: SparkSession, folder: str) -> DataFrame:
    return _applied(spark, folder)[0]


def delta_equivalence(spark: SparkSession, folder: str) -> DataFrame:
    """Per step, the rows of the new snapshot and how many of it or of the applied difference have no equal, on every column."""
    _, rows, new = _applied(spark, folder)
    odd = S.unequal(stage(rows), new[1]).groupBy("step").agg(F.count("*").alias("n"))
    return new[1].groupBy("step").agg(F.count("*").alias("total")).join(odd, "step", "left").select("step", "total", F.coalesce("n", F.lit(0)).alias("unequal"))


def vector_delta(spark: SparkSession, folder: str) -> DataFrame:
    """Apps that differ when only vectors do: those of commands that were delivered again are taken to be embedded anew, as zeros."""
    commands = table(spark, folder, "arguments").where("cmd_path is not null").select("cmd_path", key_of(F.col("app_id")).alias("app_id")).where("app_id is not null").distinct()
    old = table(spark, folder, "commands_vec").where("embedding is not null")
    again = table(spark, folder, "arguments").groupBy("cmd_path").count().where("count > 1").select("cmd_path", F.lit(True).alias("again"))
    zeros = F.array_repeat(F.lit(0.0).cast("float"), 384)
    new = old.join(again, "cmd_path", "left").select("cmd_path", F.when(F.col("again"), zeros).otherwise(F.col("embedding")).alias("embedding"))
    return S.difference(*(S.fingerprints(commands.select("app_id").distinct(), commands, ["app_id"], ["cmd_path"], v) for v in (old, new)))


def sync_mode(spark: SparkSession, folder: str) -> DataFrame:
    releases = table(spark, folder, "apps_snap").select(F.col("snap_no").alias("released"))
    clients = table(spark, folder, "customer").select(F.col("c_custkey").alias("client"), (F.col("c_custkey") % 6).cast("int").alias("synced"))
    return S.sync_modes(clients, releases)


def quality_checks(spark: SparkSession, folder: str) -> DataFrame:
    arguments, apps = table(spark, folder, "arguments"), table(spark, folder, "apps")
    return V.node_types(arguments).unionByName(V.install_data(apps)).unionByName(V.descriptions(arguments)).unionByName(V.examples(arguments))


def index_consistency(spark: SparkSession, folder: str) -> DataFrame:
    commands = catalogue(spark, folder)
    return V.index_consistency(table(spark, folder, "arguments").where("cmd_path is not null"), table(spark, folder, "commands_vec"), _index(commands).lengths)


def expected_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Tools and first subcommands of raw records that the registry lacks."""
    raw = table(spark, folder, "arguments_raw").where("cmd_path is not null")
    expected = raw.select(F.lower(T.root(F.col("cmd_path"))).alias("tool"), F.lower(F.get(F.split("cmd_path", r"\."), F.lit(1))).alias("sub")).distinct()
    return V.coverage(table(spark, folder, "arguments").where("cmd_path is not null"), expected)


def subcommand_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return V.subcommand_histogram(_arguments(spark, folder).where("app_id is not null"))


def tool_depth(spark: SparkSession, folder: str) -> DataFrame:
    tools = _apps(spark, folder).where("pop >= 0.8 and name is not null").select(F.lower("name").alias("tool")).distinct()
    return V.tool_depth(_arguments(spark, folder), tools)


def recall_mrr(spark: SparkSession, folder: str) -> DataFrame:
    """Recall and reciprocal rank of each asked command's leaf word among the first 20 results, per registry and in all."""
    accepted = _asked(spark, folder).select("qid", T.leaf(F.col("own")).alias("token"), F.substring(F.col("own"), 1, 1).alias("category"))
    results = _ranking(spark, folder, False, 5.0, 2.0, 20, cases=accepted.select("qid", "token"))[1]
    return E.metrics(E.first_hits(results, accepted).join(accepted.select("qid", "category"), "qid"), "category")


def coverage_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    cases = _asked(spark, folder).select("qid", F.col("own").alias("target"))
    return E.verdicts(cases, _ranking(spark, folder, False, 5.0, 2.0, 20, ["verified"], cases)[1])


def failure_report(spark: SparkSession, folder: str) -> DataFrame:
    return E.failure_report(stage(coverage_verdicts(spark, folder)))


def verdict_counts(spark: SparkSession, folder: str) -> DataFrame:
    return E.verdict_counts(coverage_verdicts(spark, folder))


def override_suggestions(spark: SparkSession, folder: str) -> DataFrame:
    return E.override_suggestions(failure_report(spark, folder), _asked(spark, folder))


def dist_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    return E.quantiles(table(spark, folder, "events"), "value", "event_type").select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("least", "p25", "median", "p75", "p90", "most")))


def threshold_sweep(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    asked = e.where("vec_id % 20 = 0")
    near = knn(asked.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec")), e, 10, 64, doc="vec_id").where("doc <> qid")
    labelled = near.join(asked.select(F.col("vec_id").alias("qid"), F.col("label").alias("l1")), "qid").join(e.select(F.col("vec_id").alias("doc"), F.col("label").alias("l2")), "doc")
    return E.threshold_sweep(labelled.select("distance", (F.col("l1") == F.col("l2")).alias("wanted")), [1.02, 1.06, 1.1, 1.14, 1.18, 1.22])


def query_suggestions(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "arguments").where("description is not null and cmd_path is not null")
    return rows.select("row_id", E.suggestions(F.col("description")).alias("words"), T.echoes_path(F.col("cmd_path"), F.col("description")).alias("leaks"))


def json_in_prose(spark: SparkSession, folder: str) -> DataFrame:
    text = F.concat(F.lit("Here it is: "), F.col("props"), F.lit(" - done"))
    return table(spark, folder, "events").select("event_id", E.json_in_prose(text)["k"].alias("k"))


def shard_tree(spark: SparkSession, folder: str) -> DataFrame:
    apps = _apps(spark, folder).select("app_id", "name", F.col("pop").alias("popularity"))
    return X.shards(apps, _arguments(spark, folder)).select("app_id", "nodes", "shard")


def index_order(spark: SparkSession, folder: str) -> DataFrame:
    return X.ordered(_apps(spark, folder).select("app_id", F.col("pop").alias("popularity"))).select("app_id", "place")


def sitemap_parts(spark: SparkSession, folder: str) -> DataFrame:
    return X.sitemap(_apps(spark, folder).select("app_id", F.col("pop").alias("popularity")), 50, "https://tools.example", "2025-01-01")


_TOLD = {"apps": ["app_id", "name", "os_aliases", "install_instructions"], "commands_vec": ["cmd_path"],
         "arguments": ["cmd_path", "app_id", "node_name", "node_type", "description", "risk_level", "example_template", "docker_image", "script_url", "source_url", "topics", "provenance", "feed"]}


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return X.manifest({n: table(spark, folder, n).select(*columns) for n, columns in _TOLD.items()})


def skill_match(spark: SparkSession, folder: str) -> DataFrame:
    from cinderlode.sources.registries import skill_matches

    return skill_matches(table(spark, folder, "arguments").withColumn("name", F.col("node_name")), "Archive data").select("row_id")


def help_descriptions(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").where("text is not null")
    return d.select("doc_id", H.described_by("text").alias("prose"), H.first_paragraph_of("text").alias("first"), H.is_error_page(F.col("text")).alias("error"))


def help_subcommands(spark: SparkSession, folder: str) -> DataFrame:
    """Subcommands that pages list: the documents, and a page of each command that lists it by its leaf and description."""
    d = table(spark, folder, "documents").where("text is not null").select(F.lit("documents").alias("origin"), F.col("doc_id").alias("page"), "text", F.array_compact(F.array(F.substring_index("app_id", ".", -1))).alias("prefix"))
    p = F.col("cmd_path")
    page = F.concat(F.lit("A page.\n\nCommands:\n  "), T.leaf(p), F.lit("   "), F.coalesce("description", F.lit("")), F.lit("\nOptions:\n  --all   everything\n"))
    g = table(spark, folder, "arguments").where("instr(cmd_path, '.') > 0").select(F.lit("arguments").alias("origin"), F.col("row_id").alias("page"), page.alias("text"), F.array(T.root(p)).alias("prefix"))
    return d.unionByName(g).select("origin", "page", F.explode(H.subcommands_of("text", "prefix")).alias("s")).select("origin", "page", "s.name", "s.description")


def event_counts(spark: SparkSession, folder: str) -> DataFrame:
    return windowed_counts(table(spark, folder, "events"), "ts", "event_type").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def streaming_apply(spark: SparkSession, folder: str) -> DataFrame:
    """The events table as a change feed, keyed by user: the state after the stream is the last event of each user."""
    events = table(spark, folder, "events")
    base = f"{shared_folder(spark)}/feed-{uuid.uuid4().hex}"
    events.write.parquet(f"{base}/in")
    apply_feed(spark, f"{base}/in", events.schema, f"{base}/table", f"{base}/state", "user_id", ["ts", "event_id"], "event_type = 'logout'").awaitTermination()
    return live(spark, f"{base}/table").select("user_id", "event_id", "event_type")


_SNAP = """
sa as (select dense_rank() over (order by snap_no) step, app_id, "name" from (select snap_no, trim(app_id) app_id, min(trim("name")) "name" from apps_snap where trim(app_id) <> '' group by 1, 2)),
sg as (select dense_rank() over (order by snap_no) step, trim(cmd_path) cmd_path, trim(app_id) app_id, trim(description) description, trim(risk_level) risk_level from arguments_snap where trim(cmd_path) <> '' and trim(app_id) <> ''
  qualify row_number() over (partition by snap_no, trim(cmd_path) order by trim(app_id), trim(description) nulls first, trim(risk_level) nulls first) = 1)
"""
_DIFF = f"""with {_SNAP}, t as (select step, app_id, string_agg(to_json([cmd_path, description, risk_level])::varchar, '' order by cmd_path) tree from sg group by 1, 2),
f as (select coalesce(sa.step, t.step) step, coalesce(sa.app_id, t.app_id) app_id, to_json(["name"])::varchar || '|' || coalesce(tree, '') || (sa.app_id is null)::varchar p from sa full outer join t on sa.step = t.step and sa.app_id = t.app_id),
d as (select coalesce(o.step, n.step) step, coalesce(o.app_id, n.app_id) app_id, case when o.app_id is null then 'added' when n.app_id is null then 'deleted' else 'changed' end change
  from (select step + 1 step, app_id, p from f where step < (select max(step) from f)) o full outer join (select * from f where step > 1) n on o.app_id = n.app_id and o.step = n.step where o.p is distinct from n.p)"""
_VERDICT = f"""with rs as ({_bm25_sql(False, '5', '2', 20)}), ow as (select row_id qid, cmd_path own from arguments where cmd_path is not null and row_id % 20 = 0),
vf as (select cmd_path doc, coalesce(lower(trim(provenance)), '') = 'probe' verified from arguments where cmd_path is not null qualify row_number() over (partition by cmd_path order by row_id) = 1),
p as (select ow.qid, own target, min(case when rs.doc = own then pos end) rank, coalesce(sum((pos <= 5)::int), 0) shown, max((pos <= 5 and rs.doc <> own and split_part(rs.doc, '.', 1) = split_part(own, '.', 1))::int) sib, max((pos <= 5 and not verified)::int) unv, arg_min(rs.doc, case when pos <= 5 then pos end) blocker
  from ow left join rs on ow.qid = rs.qid left join vf on vf.doc = rs.doc group by all),
vd as (select qid, target, case when rank <= 5 then 'pass' when rank is not null then 'near_miss' else 'fail' end status, rank, case when rank <= 5 then null when shown = 0 then 'not_found' when sib = 1 then 'sibling_misorder' when unv = 1 then 'canonical_burial' else 'genuine_ambiguity' end category, blocker from p)
"""
_G = "(" + " or ".join(f"starts_with(lower(d), '{p}')" for p in L.BAD_DESCRIPTIONS) + ")"
_NODE = "'{\"cmd_path\":' || to_json(cmd_path) || ',\"node_type\":' || to_json(node_type) || ',\"description\":' || to_json(coalesce(description, '')) || ',\"risk_level\":' || to_json(coalesce(risk_level, 'safe')) || coalesce(',\"example_template\":' || to_json(example_template), '') || '}'"

QUERIES = {f.__name__: f for f in (
    snapshot_diff, delta_apply, delta_apply_apps, delta_equivalence, vector_delta, sync_mode, quality_checks, index_consistency, expected_coverage, subcommand_histogram, tool_depth, recall_mrr, coverage_verdicts, verdict_counts, failure_report, override_suggestions, dist_quantiles, threshold_sweep,
    query_suggestions, json_in_prose, shard_tree, index_order, sitemap_parts, manifest, skill_match, help_descriptions, help_subcommands, event_counts, streaming_apply)}
ORACLE = {
    "snapshot_diff": _DIFF + " select step, app_id, change from d",
    "delta_apply": f"with {_SNAP} select step, cmd_path, app_id, description, risk_level from sg where step > 1",
    "delta_apply_apps": f"with {_SNAP} select step, app_id, \"name\" from sa where step > 1",
    "delta_equivalence": f"with {_SNAP} select step, count(*) total, 0::bigint unequal from sg where step > 1 group by 1",
    "vector_delta": """select distinct lower(trim(app_id)) app_id, 'changed' change from arguments where trim(app_id) <> '' and cmd_path in (select cmd_path from arguments group by 1 having count(*) > 1)
and cmd_path in (select cmd_path from commands_vec where embedding is not null and not (len(embedding) = 384 and len(list_filter(embedding, lambda v: v is distinct from 0)) = 0))""",
    "sync_mode": "with r as (select released, row_number() over (order by released) no_ from (select distinct snap_no released from apps_snap)), m as (select max(no_) mx from r) select c_custkey client, case when no_ = mx then 'noop' when no_ = mx - 1 then 'incremental' else 'full' end mode from customer left join r on c_custkey % 6 = released, m",
    "quality_checks": f"""with g as (select *, trim(description) d from arguments), j as (select install_instructions ii, case when trim(install_instructions) like '{{%' and json_valid(install_instructions) then install_instructions end js from apps),
e as (select coalesce(sum((v is null or trim(v) = '')::int), 0) > 0 bad, len(list_filter(ks, lambda k: k not in {_q(L.KNOWN_MANAGERS)})) > 0 unk from (select rn, json_keys(js) ks, unnest(json_extract_string(js, '$.*')) v from (select js, row_number() over () rn from j where js is not null)) group by rn, ks),
f as (select g.row_id, (select case when len(k) = 0 then null when lower(k[1]) not in (b, './' || b) then 'binary' when position('.' in cmd_path) > 0 and len(list_filter(case when en > 0 then k[2:][:en - 1] else k[2:] end, lambda x, i: string_split(lower(cmd_path), '.')[2:][i] is distinct from lower(x))) > 0 then 'sub' end
   from (select k, b, list_position(list_transform(k[2:], lambda x: starts_with(x, '-') or contains(x, '{{{{') or contains(x, '=') or x in {_q(L.SHELL_OPERATORS)}), true) en from (select case when z[1] = 'sudo' then z[2:] else z end k, lower(split_part(cmd_path, '.', 1)) b from (select list_filter(regexp_split_to_array(trim(example_template), '\\s+'), lambda x: x <> '') z)))) f
   from g where coalesce(lower(trim(provenance)), 'inferred') = 'inferred' and trim(example_template) <> '' and cmd_path is not null),
r as (select 'root_with_dot' c, 'fail' b, count(*) filter (node_type = 'root' and position('.' in cmd_path) > 0) n from g union all select 'sub_without_dot', 'fail', count(*) filter (node_type = 'sub' and position('.' in cmd_path) = 0) from g
union all select 'node_type_unknown', 'fail', count(*) filter (node_type is null or node_type not in ('root', 'sub')) from g
union all select 'install_null', 'warn', count(*) filter (ii is null) from j union all select 'install_malformed', 'fail', count(*) filter (ii is not null and js is null) from j
union all select 'install_empty_value', 'fail', count(*) filter (bad) from e union all select 'install_unknown_key', 'warn', count(*) filter (unk) from e
union all select 'description_empty', 'fail', count(*) filter (description is null or d = '') from g union all select 'description_short', 'fail', count(*) filter (d <> '' and length(d) < 4) from g
union all select 'description_placeholder', 'warn', count(*) filter (d <> '' and length(d) < 50 and {_G}) from g
union all select 'example_other_binary', 'warn', count(*) filter (f = 'binary') from f union all select 'example_stray_word', 'warn', count(*) filter (f = 'sub') from f)
select c "check", case when n > 0 then b else 'pass' end status, n from r""",
    "index_consistency": """with k as (select distinct cmd_path from arguments where cmd_path is not null), r as (select 'without_vector' c, (select count(*) from k where cmd_path not in (select cmd_path from commands_vec)) n union all select 'without_text', 0
union all select 'vector_orphan', (select count(*) from commands_vec where cmd_path not in (select cmd_path from k))) select c "check", case when n > 0 then 'fail' else 'pass' end status, n from r""",
    "expected_coverage": """with h as (select lower(split_part(cmd_path, '.', 1)) tool, case when position('.' in cmd_path) > 0 then lower(split_part(cmd_path, '.', 2)) end sub from arguments where cmd_path is not null),
e as (select distinct lower(split_part(cmd_path, '.', 1)) tool, case when position('.' in cmd_path) > 0 then lower(split_part(cmd_path, '.', 2)) end sub from arguments_raw where cmd_path is not null)
select tool, sub from e where not exists (select 1 from h where h.tool = e.tool and (e.sub is null or h.sub = e.sub))""",
    "subcommand_histogram": f"with {_ARGS}, s as (select app_id, count(*) n from g where app_id is not null group by 1) select case when n = 1 then '1' when n <= 5 then '2-5' when n <= 20 then '6-20' else '>20' end bucket, count(*) apps, sum(n)::bigint commands from s group by 1",
    "tool_depth": f"""with {_ARGS}, {_APPS}, t as (select distinct lower("name") tool from a where pop >= 0.8 and "name" is not null), p as (select lower(split_part(cmd_path, '.', 1)) tool, sum((position('.' in cmd_path) > 0)::int)::bigint subs, max(len(string_split(cmd_path, '.')))::int depth from g group by 1)
select tool, coalesce(subs, 0) subs, coalesce(depth, 0) depth, case when coalesce(subs, 0) = 0 then 'fail' when subs < 5 or depth < 3 then 'warn' else 'pass' end status from t left join p using (tool)""",
    "recall_mrr": f"""with rs as ({_bm25_sql(False, '5', '2', 20)}), {_CATALOGUE.strip()}, ac as (select qid, lower(split_part(own, '.', -1)) tok, own[1] cat from aq),
h as (select ac.qid, cat, min(case when list_contains(string_split(lower(doc), '.'), tok) or lower(doc) = tok then pos end) rank from ac left join rs on ac.qid = rs.qid group by 1, 2)
select cat category, count(*) cases, round(avg((rank is not null)::int), 6) found, round(avg(coalesce(rank <= 1, false)::int), 6) recall_1, round(avg(coalesce(rank <= 5, false)::int), 6) recall_5, round(avg(coalesce(1.0::double / rank, 0)), 6) mrr from h group by rollup (cat)""",
    "coverage_verdicts": _VERDICT + "select * from vd", "verdict_counts": _VERDICT + "select status, category, count(*) n from vd group by all",
    "failure_report": _VERDICT + """, att as (select blocker from vd where status <> 'pass' and blocker is not null group by 1 having count(*) >= 3),
c as (select qid, target, case when blocker in (select blocker from att) then 'inferred_attractor' else category end category from vd where status <> 'pass')
select qid, target, category, case category when 'not_found' then 0 when 'canonical_burial' then 1 when 'inferred_attractor' then 1 when 'sibling_misorder' then 2 else 3 end severity from c""",
    "override_suggestions": _VERDICT + f""", att as (select blocker from vd where status <> 'pass' and blocker is not null group by 1 having count(*) >= 3),
c as (select qid, target, case when blocker in (select blocker from att) then 'inferred_attractor' else category end category from vd where status <> 'pass'),
tx as (select row_id qid, translate(case when regexp_extract(cmd_path, '^[^.]*\\.(.*)$', 1) = '' then cmd_path else regexp_extract(cmd_path, '^[^.]*\\.(.*)$', 1) end, '.-', '  ') text from arguments where cmd_path is not null and row_id % 20 = 0),
z as (select c.*, list_filter(list_transform(regexp_split_to_array(lower(text), '\\s+'), lambda w: regexp_replace(w, '^[.,()\\[\\]<>]+|[.,()\\[\\]<>]+$', '', 'g')), lambda w: length(w) > 1 and w not in {_q(L.REPORT_STOP_WORDS)}) z from c join tx using (qid))
select qid, target, category, case when category in ('canonical_burial', 'inferred_attractor') then nullif(array_to_string(list_filter(z, lambda x, i: list_position(z, x) = i), ' '), '') end topics_append from z""",
    "dist_quantiles": """with s as (select event_type, list_sort(list(value)) l from events where value is not null group by 1)
select event_type, len(l)::bigint n, round(l[1], 6) least, round(l[floor(len(l) * 0.25)::int + 1], 6) p25, round(list_median(l), 6) median, round(l[floor(len(l) * 0.75)::int + 1], 6) p75, round(l[floor(len(l) * 0.9)::int + 1], 6) p90, round(l[-1], 6) most from s""".replace("list_median(l)", "(l[floor((len(l) - 1) / 2)::int + 1] + l[floor(len(l) / 2)::int + 1]) / 2"),
    "threshold_sweep": f"""with k as (select * from (select *, row_number() over (partition by qid order by d, vec_id) r from ({_EMB})) where r <= 10 and qid <> vec_id), w as (select d, x.label = y.label wanted from k join embeddings x on x.vec_id = k.qid join embeddings y on y.vec_id = k.vec_id)
select t threshold, sum((d > t and wanted)::int)::bigint damaged, sum((d > t and not wanted)::int)::bigint filtered from w, (select unnest([1.02, 1.06, 1.1, 1.14, 1.18, 1.22])::double t) group by 1""",
    "query_suggestions": f"""with d as (select row_id, lower(cmd_path) p, ' ' || lower(description) || ' ' q, list_filter(list_transform(regexp_split_to_array(lower(description), '\\s+'), lambda w: regexp_replace(w, '^[.,()\\[\\]<>]+|[.,()\\[\\]<>]+$', '', 'g')), lambda w: length(w) > 1 and w not in {_q(L.REPORT_STOP_WORDS)}) z from arguments where description is not null and cmd_path is not null)
select row_id, array_to_string(list_filter(z, lambda x, i: list_position(z, x) = i), ' ') words, len(list_filter(string_split(p, '.'), lambda s: length(s) >= 2 and (contains(q, ' ' || s || ' ') or contains(q, ' ' || s || '.') or contains(q, ' ' || s || ',')))) > 0 leaks from d""",
    "json_in_prose": "select event_id, props ->> '$.k' k from events",
    "shard_tree": f"""with {_ARGS}, {_APPS}, nd as (select distinct app_id, cmd_path, node_type, coalesce(description, '') d, coalesce(risk_level, 'safe') r, example_template e, {_NODE} js from g where app_id is not null),
t as (select app_id, count(*) n, string_agg(js, ',' order by cmd_path, node_type, d, r, e nulls first) tr from nd group by 1),
ro as (select app_id, coalesce(arg_min(struct_pack(x := description), cmd_path).x, '') d, coalesce(arg_min(struct_pack(x := topics), cmd_path).x, '') tp from g where position('.' in cmd_path) = 0 group by 1),
tl as (select app_id, d, list_filter(regexp_split_to_array(tp, '\\s+'), lambda x: x <> '') z from ro)
select a.app_id, coalesce(n, 0)::int nodes, '{{"app_id":' || to_json(a.app_id) || coalesce(',"name":' || to_json(a."name"), '') || ',"description":' || to_json(coalesce(tl.d, '')) || ',"topics":' || to_json(coalesce(z, [])) || coalesce(',"popularity":"' || pop::decimal(10,6)::varchar || '"', '') || ',"tree":[' || coalesce(tr, '') || ']}}' shard
from a left join t using (app_id) left join tl using (app_id)""",
    "index_order": f"with {_APPS} select app_id, row_number() over (order by coalesce(pop, 0) desc, app_id) place from a",
    "sitemap_parts": f"""with {_APPS}, o as (select *, row_number() over (order by coalesce(pop, 0) desc, app_id) place from a)
select app_id, ((place - 1) // 50 + 1)::int part, place, '  <url><loc>https://tools.example/c/' || app_id || '</loc><lastmod>2025-01-01</lastmod><priority>' || format('{{:.1f}}', least(1, greatest(0, coalesce(pop, 0)))) || '</priority></url>' entry from o""",
    "manifest": " union all ".join(f"select '{n}' \"table\", count(*) \"rows\", sum(('0x' || md5(concat_ws(chr(31), {', '.join(f'coalesce({c}, chr(30))' for c in sorted(columns))}))[1:12])::bigint)::bigint checksum from {n}" for n, columns in _TOLD.items()),
    "skill_match": "select row_id from arguments where contains(lower(concat_ws(' ', node_name, cmd_path, description)), 'archive') and contains(lower(concat_ws(' ', node_name, cmd_path, description)), 'data')",
    "help_subcommands": """with g as (select row_id, split_part(cmd_path, '.', 1) rt, split_part(cmd_path, '.', -1) lf, description from arguments where position('.' in cmd_path) > 0)
select 'arguments' origin, row_id page, lf "name", nullif(trim(regexp_replace(trim(coalesce(description, '')), '^[→:-]+', '')), '') description from g where lf <> rt and regexp_full_match(lf, '[\\p{L}\\p{N}][\\p{L}\\p{N}_-]*|_[\\p{L}\\p{N}_-]*') and lf not in ('See', 'EXPERIMENTAL')""",
    "event_counts": "select date_trunc('hour', ts) \"start\", event_type, count(*) n from events group by 1, 2",
    "streaming_apply": "select user_id, event_id, event_type from (select * from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1) where event_type <> 'logout'",
}
