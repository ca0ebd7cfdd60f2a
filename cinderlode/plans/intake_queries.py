"""Registered queries of intake."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlode.core import table
from cinderlode.functions import text as T
from cinderlode.functions.encode import unit
from cinderlode.operators import intake as N
from cinderlode.plans.curation_queries import _APPS, _ARGS, _ENTRIES, _apps, _arguments


def enrichment_applied(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "arguments_raw").where("cmd_path is not null").groupBy("cmd_path").agg(F.max_by(F.struct("description", "example_template"), "rec_id").alias("r"))
    news = raw.select("cmd_path", "r.description", F.lit(None).cast("string").alias("topics"), F.lit("medium").alias("risk_level"), "r.example_template")
    return N.enriched(_arguments(spark, folder), news).select("row_id", "description", "risk_level", "topics", "example_template")


def topic_targets(spark: SparkSession, folder: str) -> DataFrame:
    return N.topic_targets(_arguments(spark, folder), _apps(spark, folder), 0.2, 100)


def prefix_fixed(spark: SparkSession, folder: str) -> DataFrame:
    return N.prefixed(_arguments(spark, folder).select("app_id", "cmd_path"), _apps(spark, folder))


def names_without_install(spark: SparkSession, folder: str) -> DataFrame:
    return N.names_without_install(_apps(spark, folder))


def topics_filled(spark: SparkSession, folder: str) -> DataFrame:
    """Topics proposed by raw examples (their words), applied where a command has none."""
    found = table(spark, folder, "arguments_raw").where("cmd_path is not null").groupBy("cmd_path").agg(F.min("example_template").alias("topics"))
    return N.topics_filled(_arguments(spark, folder), found).select("row_id", "topics")


def installs_corrected(spark: SparkSession, folder: str) -> DataFrame:
    """Names that several apps share are corrected to the npm package of that name, then other names get an npm entry where the registry (the raw records' roots) has a binary."""
    apps = _apps(spark, folder).select("app_id", "name", "install_instructions")
    shared = apps.where("name is not null").groupBy("name").agg(F.count("*").alias("n")).where("n >= 2").select("name", F.concat(F.lit('{"npm":"npm install -g '), "name", F.lit('"}')).alias("install_instructions"))
    binaries = table(spark, folder, "arguments_raw").select(T.root(F.col("cmd_path")).alias("name"))
    return N.npm_filled(N.corrected_installs(apps, shared), binaries, shared).select("app_id", "install_instructions")


def risk_gate(spark: SparkSession, folder: str) -> DataFrame:
    return N.gated(table(spark, folder, "arguments")).select("row_id", F.coalesce("blocked", F.lit(False)).alias("blocked"))


def probe_states(spark: SparkSession, folder: str) -> DataFrame:
    """Probe states of users' events: a purchase ends well, a logout has nothing below, all else fails."""
    outcome = F.when(F.col("event_type") == "purchase", "merged").when(F.col("event_type") == "logout", "no-subcommands").otherwise("failed")
    return N.probe_states(table(spark, folder, "events").select(F.col("user_id").alias("tool"), F.struct("ts", "event_id").alias("at"), outcome.alias("outcome")), 3)


def probe_state_counts(spark: SparkSession, folder: str) -> DataFrame:
    return probe_states(spark, folder).groupBy("status").agg(F.count("*").alias("n"))


def content_keys(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "arguments").where("description is not null").select("row_id", N.content_key(F.col("description")).alias("key"))


def unit_vectors(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    doubled = F.transform("embedding", lambda x: x.cast("double") * 3)
    return e.select("vec_id", F.round(F.aggregate(unit(doubled), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 4).alias("length"))


_STATES = """with o as (select user_id, row_number() over (partition by user_id order by ts, event_id) i, case event_type when 'purchase' then 'merged' when 'logout' then 'no-subcommands' else 'failed' end o from events where user_id is not null),
e as (select user_id, min(i) filter (o <> 'failed' or i >= 3) e, max(i) n from o where i <= 3 group by 1),
st as (select e.user_id, coalesce(e, n)::int attempts, case when e is null then 'failed' when o.o = 'failed' then 'perma-failed' else o.o end status, e is not null terminal from e left join o on o.user_id = e.user_id and o.i = e.e)"""

QUERIES = {f.__name__: f for f in (enrichment_applied, topic_targets, prefix_fixed, names_without_install, topics_filled, installs_corrected, risk_gate, probe_states, probe_state_counts, content_keys, unit_vectors)}
ORACLE = {
    "enrichment_applied": f"""with {_ARGS}, w as (select cmd_path, nullif(trim(description), '') d, nullif(trim(example_template), '') e from arguments_raw where cmd_path is not null qualify row_number() over (partition by cmd_path order by rec_id desc) = 1)
select row_id, coalesce(w.d, g.description) description, case when w.d is not null then 'medium' else risk_level end risk_level, topics, case when w.d is not null then coalesce(w.e, example_template) else example_template end example_template from g left join w using (cmd_path)""",
    "topic_targets": f"with {_ARGS}, {_APPS} select row_id, cmd_path, pop from g join a using (app_id) where coalesce(trim(topics), '') = '' and pop >= 0.2 order by pop desc, cmd_path, row_id limit 100",
    "prefix_fixed": f"""with {_ARGS}, {_APPS}, n as (select app_id, cmd_path, lower("name") b from g join a using (app_id) where "name" <> ''),
f as (select distinct app_id, b, case when lower(split_part(cmd_path, '.', 1)) = b then cmd_path else b || '.' || cmd_path end cmd_path, case when lower(split_part(cmd_path, '.', 1)) = b then 'kept' else 'prefixed' end made from n)
select app_id, cmd_path, made from f union all select app_id, b, 'root' from f group by app_id, b having max((lower(cmd_path) = b)::int) = 0""",
    "names_without_install": f"""with {_APPS} select "name" from a where "name" is not null group by 1 having coalesce(length(max(ii)), 0) <= 2""",
    "topics_filled": f"""with {_ARGS}, w as (select cmd_path, nullif(trim(min(example_template)), '') t from arguments_raw where cmd_path is not null group by 1) select row_id, case when coalesce(trim(topics), '') = '' then coalesce(w.t, topics) else topics end topics from g left join w using (cmd_path)""",
    "installs_corrected": f"""with {_APPS}, {_ENTRIES}, sh as (select "name" n from a where "name" is not null group by 1 having count(*) >= 2), c as (select app_id, "name", case when "name" in (select n from sh) then '{{"npm":"npm install -g ' || "name" || '"}}' else ii end ii from a),
la as (select *, case when json_valid(ii) and trim(ii) like '{{%' then coalesce(ii ->> '$.npm', '') else '' end = '' lacks from c),
b as (select "name" n, max(ii) base from la where lacks and regexp_matches("name", '{N.PACKAGE_NAME}') and "name" in (select split_part(cmd_path, '.', 1) from arguments_raw) and "name" not in (select n from sh) group by 1),
nw as (select n, '{{' || string_agg(to_json(pm) || ':' || to_json(cmd), ',' order by pm) || '}}' js from (select n, 'npm' pm, 'npm install -g ' || n cmd from b union all select n, j.key, j.value ->> '$' from (select * from b where base is not null and json_valid(base) and trim(base) like '{{%') x, json_each(x.base) j where j.key <> 'npm' and j.value ->> '$' is not null) group by 1)
select app_id, case when lacks and js is not null then js else ii end install_instructions from la left join nw on la."name" = nw.n""",
    "risk_gate": "select row_id, coalesce(lower(trim(risk_level)) = 'dangerous', false) blocked from arguments",
    "probe_states": _STATES + " select user_id tool, attempts, status, terminal from st", "probe_state_counts": _STATES + " select status, count(*) n from st group by 1",
    "content_keys": "select row_id, sha256(description)[1:16] \"key\" from arguments where description is not null",
    "unit_vectors": "select vec_id, 1.0::double \"length\" from embeddings",
}
