"""Registered queries of the general problems: orphan references (p3) and snapshot changes (p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlode.core import table
from cinderlode.operators.orphans import orphans
from cinderlode.operators.snapshots import map_value, snapshot_changes, text_value


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    """Both tables' references at once: their distinct keys and times are few beside their rows."""
    refs = [
        table(spark, folder, name).select(F.struct(F.lit(name).alias("ref_table"), F.col(row).alias("row_key")).alias("row"), "app_id", "loaded_at")
        for name, row in (("arguments", "row_id"), ("arguments_raw", "rec_id"))
    ]
    found = orphans(refs[0].unionByName(refs[1]), table(spark, folder, "apps"), "row", "app_id", "loaded_at", "app_id", "loaded_at", "deleted_at")
    return found.select("row_key.ref_table", "row_key.row_key", "ref_key", "ref_time", "orphan_kind")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder).select("ref_table", "row_key", "orphan_kind").distinct()


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder).groupBy("ref_table", F.date_format("ref_time", "yyyy-MM").alias("month"), "orphan_kind").agg(F.count("*").alias("n"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    apps = snapshot_changes(table(spark, folder, "apps_snap"), "snap_no", "app_id", {"name": text_value("name"), "install_instructions": map_value("install_instructions")})
    arguments = snapshot_changes(table(spark, folder, "arguments_snap"), "snap_no", "cmd_path", {c: text_value(c) for c in ("app_id", "description", "risk_level")})
    return apps.select(F.lit("apps_snap").alias("tbl"), "*").unionByName(arguments.select(F.lit("arguments_snap").alias("tbl"), "*"))


_ORPHANS = """
with a as (select lower(trim(app_id)) k, loaded_at s, coalesce(deleted_at, timestamp '9999-01-01') e from apps where trim(app_id) <> ''),
r as (select 'arguments' ref_table, row_id row_key, lower(trim(app_id)) k, loaded_at t from arguments where trim(app_id) <> '' and loaded_at is not null
      union all select 'arguments_raw', rec_id, lower(trim(app_id)), loaded_at from arguments_raw where trim(app_id) <> '' and loaded_at is not null),
f as (select k, min(s) first from a group by k),
l as (select distinct r.ref_table, r.row_key from r join a on r.k = a.k and a.s <= r.t and r.t < a.e),
o as (select r.ref_table, r.row_key, r.t, case when f.k is null then 'missing' when f.first is null or f.first > r.t then 'late' else 'deleted' end orphan_kind
      from r left join f on r.k = f.k where not exists (select 1 from l where l.ref_table = r.ref_table and l.row_key = r.row_key))
"""

_SNAPS = """
with raw as (
  select 'apps_snap' tbl, snap_no, regexp_replace(app_id, '^\\s+|\\s+$', '', 'g') k, md5(coalesce('=' || regexp_replace(name, '^\\s+|\\s+$', '', 'g'), 'null') || chr(1) ||
    coalesce('=' || case when json_valid(install_instructions) and trim(install_instructions) like '{%' then
      (select string_agg(trim(j.key) || chr(2) || trim(j.value ->> '$'), chr(3) order by trim(j.key)) from json_each(install_instructions) j) else regexp_replace(install_instructions, '^\\s+|\\s+$', '', 'g') end, 'null')) d from apps_snap
  union all
  select 'arguments_snap', snap_no, regexp_replace(cmd_path, '^\\s+|\\s+$', '', 'g'), md5(coalesce('=' || regexp_replace(app_id, '^\\s+|\\s+$', '', 'g'), 'null') || chr(1) ||
    coalesce('=' || regexp_replace(description, '^\\s+|\\s+$', '', 'g'), 'null') || chr(1) || coalesce('=' || regexp_replace(risk_level, '^\\s+|\\s+$', '', 'g'), 'null')) from arguments_snap),
rows_ as (select tbl, snap_no, k, string_agg(distinct d, ',' order by d) d from raw where k <> '' group by all),
steps as (select distinct tbl, snap_no, lead(snap_no) over (partition by tbl order by snap_no) later from (select distinct tbl, snap_no from rows_)),
olds as (select r.tbl, s.later snap_no, k, d from rows_ r join steps s using (tbl, snap_no) where s.later is not null),
news as (select r.tbl, r.snap_no, k, d from rows_ r join steps s on r.tbl = s.tbl and r.snap_no = s.later)
select coalesce(o.tbl, n.tbl) tbl, coalesce(o.snap_no, n.snap_no) snap_no, coalesce(o.k, n.k) rec_key,
  case when o.k is null then 'added' when n.k is null then 'removed' else 'changed' end change_kind
from olds o full outer join news n on o.tbl = n.tbl and o.snap_no = n.snap_no and o.k = n.k where o.d is distinct from n.d
"""

QUERIES = {"p3_found": p3_found, "p3_report": p3_report, "p5_found": p5_found}
ORACLE = {
    "p3_found": _ORPHANS + "select ref_table, row_key, orphan_kind from o",
    "p3_report": _ORPHANS + "select ref_table, strftime(t, '%Y-%m') as \"month\", orphan_kind, count(*) n from o group by all",
    "p5_found": _SNAPS,
}
