"""Registered queries of curation and enrichment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinderlode.core import key_of, table
from cinderlode.functions import installs as I
from cinderlode.functions import lexicon as L
from cinderlode.functions import text as T
from cinderlode.operators import curate as C
from cinderlode.operators import enrich as X
from cinderlode.operators import sync as S
from cinderlode.operators.build import built
from cinderlode.sources.registries import package_names
from cinderlode.plans.search_queries import _CATALOGUE, _m, _q

BORROWERS, LAST = ("py.wheelhub.", "io.cratery.", "dev.helpscan."), ("org.archipel.", "sh.tapline.")
ARG = ["row_id", "cmd_path", "app_id", "node_type", "description", "risk_level", "example_template", "topics", "provenance"]


def _arguments(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "arguments").where("cmd_path is not null")
    return rows.select(*ARG).withColumn("app_id", key_of(F.col("app_id"))).withColumn("provenance", F.lower(F.trim("provenance")))


def _apps(spark: SparkSession, folder: str) -> DataFrame:
    apps = table(spark, folder, "apps").withColumn("app_id", key_of(F.col("app_id"))).where("app_id is not null")
    return apps.groupBy("app_id").agg(F.min("name").alias("name"), F.max("popularity").alias("pop"), F.min("install_instructions").alias("install_instructions"), F.min("os_aliases").alias("os_aliases"), F.min("loaded_at").alias("loaded_at"))


def _registry(spark: SparkSession, folder: str) -> DataFrame:
    return C.cleaned(_arguments(spark, folder), "row_id")


def path_functions(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("cmd_path")
    return table(spark, folder, "arguments").where("cmd_path is not null").select(
        "row_id", T.clean_path(p).alias("clean"), T.node_type(p).alias("kind"), T.leaf(p).alias("leaf"), T.root(p).alias("root"), T.is_noise(p).alias("noise"), T.canonical_path(p).alias("canon"), T.path_words(p).alias("words"))


def risk_from_verbs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "arguments").where("cmd_path is not null").select("row_id", T.risk(F.col("cmd_path"), F.col("description"), F.col("risk_level")).alias("risk"), T.risk(F.col("cmd_path"), F.col("description"), F.lit(None).cast("string")).alias("derived"))


def example_faults(spark: SparkSession, folder: str) -> DataFrame:
    """Faults of every example, null where it has none; each example is also judged for the command that follows it by row_id."""
    rows = _arguments(spark, folder).where("coalesce(provenance, 'inferred') = 'inferred' and trim(example_template) <> ''")
    other = rows.select((F.col("row_id") + 1).alias("row_id"), F.col("example_template").alias("other"))
    return rows.join(other, "row_id", "left").select("row_id", T.example_fault(F.col("cmd_path"), F.col("example_template")).alias("fault"), T.example_fault(F.col("cmd_path"), F.col("other")).alias("other_fault"))


def embed_and_index_text(spark: SparkSession, folder: str) -> DataFrame:
    named = table(spark, folder, "arguments").where("cmd_path is not null").withColumn("app_id", key_of(F.col("app_id"))).join(_apps(spark, folder).select("app_id", "name"), "app_id", "left")
    p, d, t = F.col("cmd_path"), F.col("description"), F.col("topics")
    return named.select("row_id", T.embed_text(p, d, t).alias("embed"), T.index_name(F.col("app_id"), F.col("name")).alias("index_name"), T.index_text(p, d, t).alias("index_text"), T.content_key(p, F.coalesce(d, F.lit(""))).alias("key"))


def topics_parsed(spark: SparkSession, folder: str) -> DataFrame:
    """Answers that list topics, parsed: topics as they stand, and beside them descriptions, whose commas and line ends part them."""
    rows = table(spark, folder, "arguments")
    raw = rows.select("row_id", F.lit("topics").alias("origin"), F.col("topics").alias("raw")).unionByName(rows.select("row_id", F.lit("description").alias("origin"), F.col("description").alias("raw")))
    return raw.where("raw is not null").select("row_id", "origin", F.array_join(T.topic_list(F.col("raw")), ", ").alias("topics"))


def clean_registry(spark: SparkSession, folder: str) -> DataFrame:
    return _registry(spark, folder).select("cmd_path", "row_id", "node_type")


def canonical_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return C.canonical(_registry(spark, folder), _apps(spark, folder))


def reanchor_roots(spark: SparkSession, folder: str) -> DataFrame:
    """Roots that move to the richest app of their name, where each root is held by an app of its own beside its tree's app."""
    apps = _apps(spark, folder).withColumn("ord", F.unix_micros(F.col("loaded_at").cast("timestamp")))
    before = _registry(spark, folder).withColumn("app_id", F.when(F.col("node_type") == "root", F.concat(F.lit("root."), "app_id")).otherwise(F.col("app_id")))
    apps = apps.select("app_id", "name", "ord").unionByName(apps.select(F.concat(F.lit("root."), "app_id").alias("app_id"), "name", "ord"))
    apps = apps.withColumn("ord", F.row_number().over(Window.partitionBy(F.lower("name")).orderBy("ord", "app_id")))
    after = C.reanchored(before, apps, least=3, times=2)
    return before.select("row_id", F.col("app_id").alias("was")).join(after.select("row_id", "app_id"), "row_id").where("not (was <=> app_id)")


def _overrides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The first raw record of each path as a patch, and as a new manual command."""
    raw = table(spark, folder, "arguments_raw").where("cmd_path is not null").groupBy("cmd_path").agg(F.min_by(F.struct("description", "example_template", "app_id"), "rec_id").alias("r"), F.min("rec_id").alias("rec_id"))
    patches = raw.select("cmd_path", F.col("r.description").alias("description"), F.lit(None).cast("string").alias("topics"), F.lit("patched").alias("topics_append"), F.col("r.example_template").alias("example_template"))
    new = raw.select((-F.col("rec_id")).alias("row_id"), "cmd_path", key_of(F.col("r.app_id")).alias("app_id"), T.node_type(F.col("cmd_path")).alias("node_type"), F.col("r.description").alias("description"), F.lit("safe").alias("risk_level"),
                     F.col("r.example_template").alias("example_template"), F.lit(None).cast("string").alias("topics"), F.lit("manual").alias("provenance"))
    return patches, new


def overrides_applied(spark: SparkSession, folder: str) -> DataFrame:
    patches, new = _overrides(spark, folder)
    return C.added(C.overridden(_registry(spark, folder), patches), new, _apps(spark, folder)).select("row_id", "cmd_path", "description", "topics", "example_template")


def library_noise(spark: SparkSession, folder: str) -> DataFrame:
    """Libraries among the apps, and among the same apps as if they were packaged under other names."""
    apps = _apps(spark, folder).select("app_id", "name")
    named = [apps, *(apps.select(F.concat("app_id", F.lit(s)).alias("app_id"), F.concat("name", F.lit(s)).alias("name")) for s in ("-dev", "-git", "-docs"))]
    return C.libraries(reduce(lambda x, y: x.unionByName(y), named), "org.archipel.").select("app_id")


def clean_index(spark: SparkSession, folder: str) -> DataFrame:
    """Commands left when those of libraries, malformed ones and those of unknown apps are dropped."""
    rows, apps = _arguments(spark, folder), _apps(spark, folder)
    gone = C.libraries(apps, "org.archipel.").select("app_id")
    return rows.where(~C.malformed(F.col("cmd_path"), "az")).join(gone, "app_id", "left_anti").join(apps, "app_id", "left_semi").select("row_id")


def index_orphans(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "commands_vec").join(table(spark, folder, "arguments").select("cmd_path"), "cmd_path", "left_anti").select("cmd_path")


def registry_import(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "arguments_raw").where("cmd_path is not null").select("cmd_path", T.root(F.col("cmd_path")).alias("name"), "description", "rec_id")
    covered = _apps(spark, folder).where("length(install_instructions) > 2").select("name")
    return C.registry_import(_arguments(spark, folder), raw, covered, "rec_id").select("cmd_path", "rec_id", "description")


def subtree_replaced(spark: SparkSession, folder: str) -> DataFrame:
    """The command subtrees of tools for which raw probe records came, replaced by these records."""
    current = _arguments(spark, folder).groupBy("cmd_path").agg(F.min("row_id").alias("id"))
    probe = table(spark, folder, "arguments_raw").where("cmd_path is not null and lower(trim(provenance)) = 'probe'").groupBy("cmd_path").agg((-F.min("rec_id")).alias("id"))
    return C.replaced_subtrees(current, probe, probe.select(F.col("cmd_path").alias("root")))


def broken_prefix_twins(spark: SparkSession, folder: str) -> DataFrame:
    """Apps whose paths lost their root, among the apps and copies of them that lost it."""
    rows, apps = _arguments(spark, folder), _apps(spark, folder)
    rest = F.regexp_extract("cmd_path", r"^[^.]*\.(.*)$", 1)
    lost = rows.withColumn("cmd_path", rest).where("cmd_path <> ''").withColumn("app_id", F.concat(F.lit("lost."), "app_id"))
    return C.broken_prefix_twins(rows.unionByName(lost), apps.select("app_id", "name").unionByName(apps.select(F.concat(F.lit("lost."), "app_id").alias("app_id"), "name")))


def fabrication_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """Apps that are another tool's subcommand, among the apps and copies whose paths join root and subcommand by a dash."""
    rows, apps = _arguments(spark, folder), _apps(spark, folder)
    fused = rows.where("instr(cmd_path, '.') > 0").withColumn("app_id", F.concat(F.lit("fused."), "app_id", F.lit("."), T.leaf(F.col("cmd_path")))).withColumn("cmd_path", F.regexp_replace("cmd_path", r"^([^.]*)\.", "$1-")).withColumn("provenance", F.lit("inferred"))
    return C.fabrications(rows.unionByName(fused), apps.select("app_id").unionByName(fused.select("app_id").distinct()), ["py.wheelhub."])


def install_donors(spark: SparkSession, folder: str) -> DataFrame:
    return C.donors(_apps(spark, folder), BORROWERS, LAST)


def _probed_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Probed raw records as pages of their tools; texts under thirty letters are error pages."""
    raw = table(spark, folder, "arguments_raw").where("cmd_path <> '' and lower(trim(provenance)) = 'probe' and length(trim(description)) >= 30")
    p = F.col("cmd_path")
    return raw.select(T.root(p).alias("tool"), "cmd_path", F.split(p, r"\.").alias("path"), F.trim("description").alias("description"), F.col("rec_id").alias("ordinal"))


def _deep(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    first = table(spark, folder, "arguments").where("cmd_path is not null").groupBy("cmd_path").agg(F.min_by(F.struct("app_id", "node_name", "node_type", "description", "risk_level", "provenance"), "row_id").alias("r")).select("cmd_path", "r.*")
    return C.deep_imported(first.withColumn("app_id", key_of(F.col("app_id"))), _apps(spark, folder).select("app_id", "name", "install_instructions"), _probed_pages(spark, folder), "org.found.", LAST)


def deep_import_commands(spark: SparkSession, folder: str) -> DataFrame:
    return _deep(spark, folder)[0]


def deep_import_apps(spark: SparkSession, folder: str) -> DataFrame:
    return _deep(spark, folder)[1]


def strip_json_nulls(spark: SparkSession, folder: str) -> DataFrame:
    return _apps(spark, folder).where("install_instructions is not null").select("app_id", F.when(I.install_map(F.col("install_instructions")).isNotNull(), I.stripped(F.col("install_instructions"))).otherwise("broken").alias("json"))


def install_commands(spark: SparkSession, folder: str) -> DataFrame:
    m = I.install_map(F.col("install_instructions"))
    apps = _apps(spark, folder).select("app_id", m.alias("m"), "os_aliases", "name")
    return apps.select("app_id", *(I.resolved(F.col("m"), F.lit(os), ["npm", "scoop"]).alias(os) for os in ("ubuntu", "arch", "macos", "fedora")), I.binary_name(F.col("os_aliases"), "linux", F.col("name")).alias("linux_binary"))


def install_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Each app's map enriched by commands built for the packages of its mirrors; present entries win."""
    m = F.coalesce(I.install_map(F.col("install_instructions")), F.from_json(F.lit("{}"), "map<string,string>"))
    pkg = F.substring_index("app_id", ".", -1)
    new = F.create_map(F.lit("apt"), I.build_command(F.lit("apt"), pkg), F.lit("snap"), I.build_command(F.lit("snap"), pkg))
    return _apps(spark, folder).select("app_id", F.to_json(I.merged_add_only(m, new)).alias("merged"))


def arch_reclassified(spark: SparkSession, folder: str) -> DataFrame:
    """Install maps after their pacman entries are reclassified: official is what one registry lists, users' what popular apps of others are called."""
    apps = _apps(spark, folder).select("app_id", I.install_map(F.col("install_instructions")).alias("m")).where("m is not null").withColumn("pkg", I.package_of(F.col("m")["pacman"]))
    last = F.substring_index("app_id", ".", -1).alias("pkg")
    official = _apps(spark, folder).where("app_id like 'org.archipel.%'").select(last).distinct()
    users = _apps(spark, folder).where("app_id not like 'org.archipel.%' and pop >= 0.3").select(last).distinct()
    tagged = apps.join(official.withColumn("o", F.lit(True)), "pkg", "left").join(users.withColumn("u", F.lit(True)), "pkg", "left")
    return tagged.select("app_id", F.to_json(I.reclassified(F.col("m"), F.col("pkg"), F.coalesce("o", F.lit(False)), F.coalesce("u", F.lit(False)))).alias("install_instructions"))


def examples_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """Faulty examples of commands that get the example of the command before them (by row_id), repaired by the command's own path."""
    rows = _arguments(spark, folder)
    other = rows.select((F.col("row_id") + 1).alias("row_id"), F.col("example_template").alias("example_template"))
    mixed = rows.drop("example_template").join(other, "row_id")
    return C.examples_repaired(mixed, lambda p, d, e: F.translate(p, ".", " ")).select("row_id", "example_template")


def repository_managers(spark: SparkSession, folder: str) -> DataFrame:
    """Package manager of each registry by its name's prefix, and the first app it gives per manager."""
    apps = _apps(spark, folder).withColumn("repo", F.get(F.split("app_id", r"\."), F.lit(1))).withColumn("pm", I.manager_of(F.col("repo"))).where("pm is not null")
    return apps.groupBy("repo", "pm").agg(F.count("*").alias("n"), F.min(F.struct("loaded_at", "app_id")).alias("f")).select("repo", "pm", "n", F.col("f.app_id").alias("first_app"))


def popularity_lognorm(spark: SparkSession, folder: str) -> DataFrame:
    """Popularity of a part from the number of distinct suppliers that ship it; the most of its two keys counts."""
    part, line = table(spark, folder, "part"), table(spark, folder, "lineitem")
    per = line.groupBy(F.col("l_partkey").alias("key")).agg(F.countDistinct("l_suppkey").alias("n"))
    keys = part.select("p_partkey", F.explode(F.array(F.col("p_partkey"), F.col("p_partkey") - 1)).alias("key"))
    return keys.join(per, "key").groupBy("p_partkey").agg(F.round(F.max(I.popularity(F.col("n"))), 8).alias("popularity"))


def consensus_package(spark: SparkSession, folder: str) -> DataFrame:
    """The package name that most managers of an app agree on; the first manager's on ties."""
    told = _apps(spark, folder).select("app_id", F.posexplode(F.array_sort(F.map_entries(I.install_map(F.col("install_instructions"))))).alias("p", "e")).select("app_id", "p", I.package_of(F.col("e.value")).alias("pkg")).where("pkg <> ''")
    count = told.groupBy("app_id", "pkg").agg(F.count("*").alias("n"), F.min("p").alias("p"))
    return count.groupBy("app_id").agg(F.max_by("pkg", F.struct("n", (-F.col("p")).alias("q"))).alias("pkg"), F.max("n").alias("votes"))


def name_score_best(spark: SparkSession, folder: str) -> DataFrame:
    """The best package candidate of each app and manager by name score, at least 60; the smallest name on ties."""
    told = _apps(spark, folder).select("app_id", "name", F.explode(I.install_map(F.col("install_instructions"))).alias("pm", "cmd")).where("name is not null and trim(cmd) <> ''").select("app_id", "pm", I.package_of(F.col("cmd")).alias("pkg"), F.col("name").alias("nm"))
    scored = told.withColumn("score", I.name_score(F.col("pkg"), F.col("nm"))).where("score >= 60")
    return scored.groupBy("pm", F.lower("nm").alias("project")).agg(F.max_by(F.struct("pkg", "score"), F.struct("score", (-F.length("pkg")).alias("l"), "pkg")).alias("b")).select("pm", "project", "b.pkg", "b.score")


def probe_targets(spark: SparkSession, folder: str) -> DataFrame:
    """The most popular apps without a probed command, and those that feedback names."""
    apps, rows = _apps(spark, folder), _arguments(spark, folder)
    unprobed = apps.join(rows.where("provenance = 'probe'").select("app_id"), "app_id", "left_anti")
    top = unprobed.orderBy(F.desc(F.coalesce("pop", F.lit(0.0))), "app_id").limit(50).select("app_id")
    feedback = table(spark, folder, "arguments_raw").select(key_of(F.col("app_id")).alias("app_id")).distinct().join(unprobed.where("pop >= 0.9"), "app_id", "left_semi")
    return top.union(feedback.select("app_id")).distinct()


def work_queue(spark: SparkSession, folder: str) -> DataFrame:
    rows = _arguments(spark, folder).where("instr(cmd_path, '.') = 0 and coalesce(provenance, '') <> 'probe'").join(_apps(spark, folder).where("pop >= 0.8"), "app_id")
    return rows.select("cmd_path", "app_id", "pop").distinct().orderBy(F.desc("pop"), "cmd_path")


def vector_reuse(spark: SparkSession, folder: str) -> DataFrame:
    """Commands of each snapshot whose embedded text is that of the one before keep their vector; the rest is to be embedded."""
    snap = S.numbered(table(spark, folder, "arguments_snap").where("cmd_path is not null"), "snap_no").withColumn("cmd_path", F.trim("cmd_path"))
    keyed = snap.select("step", "snap_no", "cmd_path", T.embed_text(F.col("cmd_path"), F.col("description"), F.lit(None).cast("string")).alias("text")).groupBy("step", "snap_no", "cmd_path").agg(F.min("text").alias("text"))
    return S.reusable(keyed.where("step > 1"), keyed.withColumn("step", F.col("step") + 1), "m", "m", ["step"]).select("snap_no", "cmd_path", "reuse")


REPOSITORIES = ["debian_12", "fedora_40", "gentoo", "nix_stable", "homebrew", "aur", "pypi", "odd_one"]


def _dump(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of arguments as those of a package dump: repositories in turn, the root as project, the leaf as package."""
    p = F.col("cmd_path")
    repo = F.element_at(F.array(*map(F.lit, REPOSITORIES)), (F.col("row_id") % len(REPOSITORIES) + 1).cast("int"))
    return table(spark, folder, "arguments").where("cmd_path is not null").select(repo.alias("repo"), T.root(p).alias("effname"), T.leaf(p).alias("binname"), T.root(p).alias("srcname"), F.lit(None).cast("string").alias("binnames"), "row_id")


def dump_installs(spark: SparkSession, folder: str) -> DataFrame:
    return X.dump_installs(_apps(spark, folder).select("app_id", "name", "install_instructions"), _dump(spark, folder), "row_id")


def dump_popularity(spark: SparkSession, folder: str) -> DataFrame:
    found = X.dump_popularity(_apps(spark, folder).select("app_id", "name", "install_instructions"), package_names(_dump(spark, folder)), L.POPULARITY_CAP)
    return found.select("app_id", F.round("popularity", 8).alias("popularity"))


def _built(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The registry built from the tables, with the raw records as overrides, and the texts of the uncleaned rows as those embedded before."""
    apps = _apps(spark, folder).withColumn("ord", F.row_number().over(Window.partitionBy(F.lower("name")).orderBy(F.unix_micros(F.col("loaded_at").cast("timestamp")), "app_id")))
    rows = _arguments(spark, folder)
    patches, new = _overrides(spark, folder)
    stored = rows.select("cmd_path", T.embed_text(F.col("cmd_path"), F.col("description"), F.col("topics")).alias("text"))
    return built(apps, rows, patches, new, stored, "m1", "m1", 0, BORROWERS, LAST, least=3, times=2)


def build_commands(spark: SparkSession, folder: str) -> DataFrame:
    made = _built(spark, folder)
    return made["arguments"].join(made["index"], "cmd_path").join(made["embed"], "cmd_path")


def build_apps(spark: SparkSession, folder: str) -> DataFrame:
    return _built(spark, folder)["apps"].drop("os_aliases")


_ARGS = "g as (select row_id, cmd_path, nullif(lower(trim(app_id)), '') app_id, node_type, description, risk_level, example_template, topics, lower(trim(provenance)) provenance from arguments where cmd_path is not null)"
_APPS = "a as (select lower(trim(app_id)) app_id, min(name) \"name\", max(popularity) pop, min(install_instructions) ii, min(os_aliases) os, min(loaded_at) loaded_at from apps where trim(app_id) <> '' group by 1)"


def _clean(p):
    for old, new in L.PATH_REWRITES:
        p = f"replace({p}, '{old}', '{new}')"
    parts = f"list_filter(regexp_split_to_array({p}, '\\s+'), lambda x: x <> '')"
    kept = f"(select list_filter(z, lambda x, i: i < coalesce(nullif(list_position(list_transform(z, lambda y: starts_with(y, '-')), true), 0), 1000000)) from (select {parts} z))"
    return f"regexp_replace(regexp_replace(array_to_string({kept}, '.'), '\\.{{2,}}', '.', 'g'), '^\\.+|\\.+$', '', 'g')"


_NOISE = "(position('.' in {p}) > 0 and (lower(split_part({p}, '.', -1)) in " + _q(L.NOISE_LEAVES) + " or list_has_any(string_split({p}, '.')[2:], ['completion', 'completions'])))"
_TOOL = "case when regexp_extract({r}, '^[^-]*-(.*)$', 1) in " + _q(L.COMPOUND_TOOLS) + " then {r} else regexp_replace({r}, '-(" + "|".join(L.FUSED_SUFFIXES) + ")$', '') end"


def _canon(p):
    r = f"split_part(lower({p}), '.', 1)"
    t = _TOOL.format(r=r)
    return (f"array_to_string(list_concat([{t}], list_transform(list_concat(case when ({t}) <> {r} then [{r}[length({t}) + 2:]] else [] end, string_split(lower({p}), '.')[2:]), "
            "lambda w: case when w like '%s' and length(w) > 3 then w[:-2] else w end)), '.')")


_CLEANED = f"cl as (select * replace ({_clean('cmd_path')} as cmd_path) from g), r as (select * replace (case when position('.' in cmd_path) > 0 then 'sub' else 'root' end as node_type) from (select * from cl where cmd_path <> '' qualify row_number() over (partition by cmd_path order by row_id) = 1) where not {_NOISE.format(p='cmd_path')})"
_HAS = lambda words: "(" + " or ".join(f"contains(hay, '{w}')" for w in words) + ")"
_LIB = f"lib as (select app_id from (select *, split_part(app_id, '.', -1) pkg from a) where coalesce(\"name\" not in {_q(L.LIBRARY_ALLOWED)}, true) and pkg not in {_q(L.LIBRARY_ALLOWED)} and (coalesce(regexp_matches(\"name\", '{L.LIBRARY_PATTERN}'), false) or regexp_matches(pkg, '{L.LIBRARY_PATTERN}') or (starts_with(app_id, 'org.archipel.') and (coalesce(regexp_matches(\"name\", '{L.LONG_TAIL_PATTERN}'), false) or regexp_matches(pkg, '{L.LONG_TAIL_PATTERN}')))))"
_ENTRIES = "en as (select app_id, \"name\", j.key pm, j.value ->> '$' cmd from (select * from a where ii is not null and json_valid(ii) and trim(ii) like '{%') x, json_each(x.ii) j)"
_TPL = _m(L.INSTALL_TEMPLATES)


def _resolved(os: str) -> str:
    own = L.OS_MANAGERS[os]
    order = [own, *(["yay", "paru"] if os == "arch" else []), "npm", "scoop", *L.FALLBACK_MANAGERS]
    return f"(select case when pm in {_q(L.SYSTEM_MANAGERS)} then 'sudo ' else '' end || case when contains(cmd, ' ') or starts_with(cmd, pm) then cmd else coalesce({_TPL}[pm], '') || cmd end from en where en.app_id = a.app_id and cmd is not null and pm in {_q(order)} order by list_position([{', '.join(repr(x) for x in order)}], pm) limit 1) {os}"


_SEGS = f"""with {_ARGS.replace('g as', 'g0 as', 1)}, {_APPS.replace('a as', 'a0 as', 1)},
g as (select cmd_path, app_id from g0 union all select regexp_extract(cmd_path, '^[^.]*\\.(.*)$', 1), 'lost.' || app_id from g0 where regexp_extract(cmd_path, '^[^.]*\\.(.*)$', 1) <> ''), a as (select app_id, "name" from a0 union all select 'lost.' || app_id, "name" from a0),
nm as (select g.cmd_path, lower(a."name") nm, g.app_id from g join a using (app_id) where a."name" <> ''),
h as (select distinct nm, app_id, lower(split_part(cmd_path, '.', 1)) seg from nm),
good as (select distinct nm, app_id twin, lower(split_part(cmd_path, '.', 2)) seg from nm where lower(split_part(cmd_path, '.', 1)) = nm and position('.' in cmd_path) > 0),
odd as (select nm, app_id, count(*) n from h group by all having count(*) >= 2 and max((seg = nm)::int) = 0)
select app_id, min(twin) twin from (select h.app_id, twin, n from h join odd using (nm, app_id) join good using (nm, seg) where h.app_id <> twin group by h.app_id, twin, n having count(*) = n) group by 1"""

_DEEP = f"""with {_APPS}, f as (select cmd_path, nullif(lower(trim(app_id)), '') app_id, node_name, node_type, description, risk_level, provenance from arguments where cmd_path is not null qualify row_number() over (partition by cmd_path order by row_id) = 1),
pg as (select *, split_part(cmd_path, '.', 1) tool from arguments_raw where cmd_path <> '' and lower(trim(provenance)) = 'probe' and length(trim(description)) >= 30),
hm as (select t.tool, coalesce(x.app_id, 'org.found.' || t.tool) home from (select distinct tool from pg) t left join (select "name", a.app_id from a left join (select app_id, count(*) n from f group by 1) using (app_id) qualify row_number() over (partition by "name" order by coalesce(n, 0) desc, a.app_id) = 1) x on x."name" = t.tool),
fr as (select cmd_path, home app_id, split_part(cmd_path, '.', -1) node_name, case when position('.' in cmd_path) > 0 then 'sub' else 'root' end node_type, trim(description) description, 'safe' risk_level, 'probe' provenance from pg join hm using (tool) qualify row_number() over (partition by cmd_path order by rec_id desc) = 1),
gone as (select cmd_path from f where exists (select 1 from hm where f.cmd_path = tool or starts_with(f.cmd_path, tool || '.'))),
ih as (select "name", ii from a where length(ii) > 2 qualify row_number() over (partition by "name" order by case when app_id like 'org.archipel.%' then 1 when app_id like 'sh.tapline.%' then 2 else 3 end, length(ii) desc, app_id) = 1)
"""

# A command's own path is a sound example of it unless a segment looks like a flag or a placeholder, which would end it.
_SOUND = "len(list_filter(string_split(cmd_path, '.'), lambda y: y = '' or regexp_matches(y, '\\s'))) = 0"
_PKG = "split_part(trim(cmd), ' ', -1)"
_DUMP = f"""du as (select ([{', '.join(repr(x) for x in REPOSITORIES)}])[row_id % {len(REPOSITORIES)} + 1] repo, split_part(cmd_path, '.', 1) eff, split_part(cmd_path, '.', -1) own, row_id from arguments where cmd_path is not null),
k0 as (select distinct app_id, lower({_PKG}) "key" from en where pm in {_q(L.PACKAGE_MANAGERS)} and {_PKG} <> '')"""
_BUILT = f"""with {_ARGS}, {_APPS}, {_CLEANED}, w as (select * from arguments_raw where cmd_path is not null qualify row_number() over (partition by cmd_path order by rec_id) = 1),
o as (select r.row_id, r.cmd_path, r.app_id, coalesce(w.description, r.description) description, r.risk_level, coalesce(w.example_template, r.example_template) example_template, case when w.cmd_path is not null then trim(concat_ws(' ', r.topics, 'patched')) else r.topics end topics, r.provenance from r left join w using (cmd_path)
  union all select -rec_id, cmd_path, nullif(lower(trim(app_id)), ''), description, 'safe', example_template, null, 'manual' from w where cmd_path not in (select cmd_path from r) and lower(trim(app_id)) in (select app_id from a)),
s0 as (select app_id, count(*) size from o group by 1),
n as (select a.app_id, lower("name") nm, coalesce(size, 0) size, row_number() over (partition by lower("name") order by loaded_at nulls first, a.app_id) rk from a left join s0 using (app_id) where "name" <> ''),
b as (select nm, app_id target, size t from n qualify row_number() over (partition by nm order by size desc, rk) = 1),
ra as (select o.* replace (case when position('.' in o.cmd_path) = 0 and lower(o.cmd_path) = n.nm and b.target <> o.app_id and t >= 3 and t >= 2 * greatest(n.size, 1) then b.target else o.app_id end as app_id) from o left join n on o.app_id = n.app_id left join b on b.nm = n.nm),
sz as (select app_id, count(*) size from ra group by 1),
c as (select ra.*, {_canon('ra.cmd_path')} canon, row_number() over (partition by {_canon('ra.cmd_path')} order by coalesce(provenance, '') <> 'probe', lower(ra.cmd_path) <> {_canon('ra.cmd_path')}, -coalesce(pop, 0), -coalesce(size, 0), coalesce(ra.app_id, ''), ra.cmd_path) rn, count(*) over (partition by {_canon('ra.cmd_path')}) n
  from ra left join a on ra.app_id = a.app_id left join sz on ra.app_id = sz.app_id),
tw as (select canon, rn, unnest(z) w, generate_subscripts(z, 1) p from (select canon, rn, list_filter(regexp_split_to_array(coalesce(topics, ''), '[,\\s]+'), lambda x: x <> '') z from c)),
u as (select canon, string_agg(w, ' ' order by rn, p) un from (select canon, w, min(rn) rn, min_by(p, (rn, p)) p from tw group by canon, w) group by 1),
l as (select c.* replace (case when n > 1 then coalesce(un, '') else topics end as topics), lower(split_part(cmd_path, '.', -1)) || ' ' || lower(coalesce(description, '')) hay from c left join u using (canon) where rn = 1),
st as (select distinct cmd_path, regexp_replace(translate(cmd_path, '.-', '  ') || '. ' || coalesce(description, '') || ' ' || coalesce(topics, ''), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') e from g),
f as (select l.*, a."name" nm, translate(cmd_path, '.-', '  ') pw, regexp_replace(translate(cmd_path, '.-', '  ') || '. ' || coalesce(description, '') || ' ' || coalesce(topics, ''), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') e from l left join a on l.app_id = a.app_id)
"""

QUERIES = {f.__name__: f for f in (
    path_functions, risk_from_verbs, example_faults, embed_and_index_text, topics_parsed, clean_registry, canonical_dedup, reanchor_roots, overrides_applied, library_noise, clean_index, index_orphans, registry_import, subtree_replaced,
    broken_prefix_twins, fabrication_sweep, install_donors, deep_import_commands, deep_import_apps, strip_json_nulls, install_commands, install_merge, arch_reclassified, examples_repaired, repository_managers, popularity_lognorm, consensus_package, name_score_best, probe_targets, work_queue, vector_reuse, dump_installs, dump_popularity, build_commands, build_apps)}
ORACLE = {
    "path_functions": f"select row_id, {_clean('cmd_path')} clean, case when position('.' in cmd_path) > 0 then 'sub' else 'root' end kind, split_part(cmd_path, '.', -1) leaf, split_part(cmd_path, '.', 1) root, {_NOISE.format(p='cmd_path')} noise, {_canon('cmd_path')} canon, translate(cmd_path, '._-', '   ') words from arguments where cmd_path is not null",
    "risk_from_verbs": f"with h as (select *, lower(split_part(cmd_path, '.', -1)) || ' ' || lower(coalesce(description, '')) hay from arguments where cmd_path is not null), d as (select *, case when {_HAS(L.DANGEROUS)} then 'dangerous' when {_HAS(L.MEDIUM)} then 'medium' else 'safe' end derived from h) select row_id, case when risk_level is not null and risk_level not in ('safe', '') then risk_level else derived end risk, derived from d",
    "example_faults": f"""with {_ARGS}, t0 as (select row_id, cmd_path, example_template from g where coalesce(provenance, 'inferred') = 'inferred' and trim(example_template) <> ''),
x as (select row_id, cmd_path, 1 k, example_template e from t0 union all select t0.row_id, t0.cmd_path, 2, o.example_template from t0 join t0 o on t0.row_id = o.row_id + 1),
t as (select row_id, k no_, cmd_path, list_filter(regexp_split_to_array(trim(e), '\\s+'), lambda x: x <> '') z from x),
u as (select row_id, no_, cmd_path, case when z[1] = 'sudo' then z[2:] else z end k, lower(split_part(cmd_path, '.', 1)) b, string_split(lower(cmd_path), '.')[2:] s from t),
v as (select *, list_position(list_transform(k[2:], lambda x: starts_with(x, '-') or contains(x, '{{{{') or contains(x, '=') or x in {_q(L.SHELL_OPERATORS)}), true) e from u),
w as (select *, case when e > 0 then k[2:][:e - 1] else k[2:] end bare from v),
f as (select row_id, no_, case when len(k) = 0 then null when lower(k[1]) not in (b, './' || b) then 'binary' when position('.' in cmd_path) > 0 and len(list_filter(bare, lambda x, i: s[i] is distinct from lower(x))) > 0 then 'subcommand' end fault from w)
select row_id, max(fault) filter (no_ = 1) fault, max(fault) filter (no_ = 2) other_fault from f group by 1""",
    "embed_and_index_text": f"""with {_CATALOGUE} select row_id, regexp_replace(translate(cmd_path, '.-', '  ') || '. ' || coalesce(description, '') || ' ' || coalesce(topics, ''), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') embed,
coalesce(nm, app, '') || case when contains(app, '.') and not contains(coalesce(nm, app), split_part(app, '.', -1)) then ' ' || split_part(app, '.', -1) else '' end index_name,
concat_ws(' ', translate(cmd_path, '.-', '  '), coalesce(description, ''), coalesce(topics, '')) index_text, sha1(cmd_path || chr(0) || coalesce(description, '')) "key" from (select *, nullif(lower(trim(app_id)), '') app from arguments where cmd_path is not null) left join ap using (app)""",
    "topics_parsed": """with r as (select row_id, 'topics' origin, topics raw from arguments where topics is not null union all select row_id, 'description', description from arguments where description is not null),
t as (select row_id, origin, list_filter(list_transform(string_split(replace(raw, chr(10), ','), ','), lambda x: lower(trim(x, ' ' || chr(9) || chr(13)))), lambda x: x <> '') z from r)
select row_id, origin, array_to_string(list_filter(z, lambda x, i: list_position(z, x) = i)[:15], ', ') topics from t""",
    "clean_registry": f"with {_ARGS}, {_CLEANED} select cmd_path, row_id, node_type from r",
    "canonical_dedup": f"""with {_ARGS}, {_APPS}, {_CLEANED}, sz as (select app_id, count(*) size from r group by 1),
c as (select r.*, {_canon('r.cmd_path')} canon, row_number() over (partition by {_canon('r.cmd_path')} order by coalesce(provenance, '') <> 'probe', lower(r.cmd_path) <> {_canon('r.cmd_path')}, -coalesce(pop, 0), -coalesce(size, 0), coalesce(r.app_id, ''), r.cmd_path) rn, count(*) over (partition by {_canon('r.cmd_path')}) n
  from r left join a on r.app_id = a.app_id left join sz on r.app_id = sz.app_id),
tw as (select canon, rn, unnest(z) w, generate_subscripts(z, 1) p from (select canon, rn, list_filter(regexp_split_to_array(coalesce(topics, ''), '[,\\s]+'), lambda x: x <> '') z from c)),
u as (select canon, string_agg(w, ' ' order by rn, p) un from (select canon, w, min((rn, p)) m, min(rn) rn, min_by(p, (rn, p)) p from tw group by canon, w) group by 1)
select c.canon, cmd_path, app_id, n merged, case when n > 1 then coalesce(un, '') else topics end topics from c left join u using (canon) where rn = 1""",
    "reanchor_roots": f"""with {_ARGS}, {_APPS.replace('a as', 'a0 as', 1)}, {_CLEANED.replace('r as', 'r0 as', 1)}, r as (select * replace (case when position('.' in cmd_path) = 0 then 'root.' || app_id else app_id end as app_id) from r0),
a as (select app_id, "name", loaded_at from a0 union all select 'root.' || app_id, "name", loaded_at from a0), sz as (select app_id, count(*) size from r group by 1),
n as (select a.app_id, lower("name") nm, coalesce(size, 0) size, row_number() over (partition by lower("name") order by loaded_at nulls first, a.app_id) o from a left join sz using (app_id) where "name" <> ''),
b as (select nm, app_id target, size t from n qualify row_number() over (partition by nm order by size desc, o) = 1)
select r.row_id, r.app_id was, b.target app_id from r join n on r.app_id = n.app_id join b on b.nm = n.nm where position('.' in r.cmd_path) = 0 and lower(r.cmd_path) = n.nm and b.target <> r.app_id and t >= 3 and t >= 2 * greatest(n.size, 1)""",
    "overrides_applied": f"""with {_ARGS}, {_APPS}, {_CLEANED}, w as (select * from arguments_raw where cmd_path is not null qualify row_number() over (partition by cmd_path order by rec_id) = 1)
select r.row_id, r.cmd_path, coalesce(w.description, r.description) description, case when w.cmd_path is not null then trim(concat_ws(' ', r.topics, 'patched')) else r.topics end topics, coalesce(w.example_template, r.example_template) example_template from r left join w using (cmd_path)
union all select -rec_id, cmd_path, description, null, example_template from w where cmd_path not in (select cmd_path from r) and lower(trim(app_id)) in (select app_id from a)""",
    "library_noise": f"with {_APPS.replace('a as', 'a0 as', 1)}, a as (select app_id || s app_id, \"name\" || s \"name\" from a0, (select unnest(['', '-dev', '-git', '-docs']) s)), {_LIB} select app_id from lib",
    "clean_index": f"with {_ARGS}, {_APPS}, {_LIB} select row_id from g where not (cmd_path like 'az.az.%' or cmd_path like '%.az.az.%' or cmd_path like 'az.%.az' or cmd_path like 'az.%.az.%') and app_id in (select app_id from a) and app_id not in (select app_id from lib)",
    "index_orphans": "select cmd_path from commands_vec where cmd_path not in (select cmd_path from arguments where cmd_path is not null)",
    "registry_import": f"""with {_ARGS}, {_APPS}, co as (select "name" n from a where length(ii) > 2 and "name" is not null), tk as (select n from co union select cmd_path from g),
w as (select *, split_part(cmd_path, '.', 1) nm from arguments_raw where cmd_path is not null), k as (select * from w where cmd_path not in (select cmd_path from g) and nm not in (select n from co) and not (nm like '%-bin' and nm[:-5] in (select n from tk)) qualify row_number() over (partition by cmd_path order by rec_id) = 1)
select cmd_path, rec_id, case when length(coalesce(trim(description), '')) < 5 then nm || ' — command-line tool' else trim(description) end description from k where not (nm like '%-bin' and exists (select 1 from k j where j.cmd_path = k.nm[:-5] and j.rec_id < k.rec_id))""",
    "subtree_replaced": f"""with {_ARGS}, p as (select cmd_path, -min(rec_id) id from arguments_raw where cmd_path is not null and lower(trim(provenance)) = 'probe' group by 1),
c as (select cmd_path, min(row_id) id from g group by 1) select cmd_path, id from c where not exists (select 1 from p where c.cmd_path = p.cmd_path or starts_with(c.cmd_path, p.cmd_path || '.')) union all select cmd_path, id from p""",
    "broken_prefix_twins": _SEGS,
    "fabrication_sweep": f"""with {_ARGS.replace('g as', 'g0 as', 1)}, {_APPS.replace('a as', 'a0 as', 1)}, fz as (select 'fused.' || app_id || '.' || split_part(cmd_path, '.', -1) app_id, regexp_replace(cmd_path, '^([^.]*)\\.', '\\1-') cmd_path, 'inferred' provenance from g0 where position('.' in cmd_path) > 0),
g as (select app_id, cmd_path, provenance from g0 union all select * from fz), a as (select app_id from a0 union select app_id from fz where app_id is not null), pp as (select distinct cmd_path from g where provenance = 'probe'),
f as (select app_id, min(cmd_path) fc, count(*) cmd_count from g where app_id in (select app_id from a) group by 1 having sum((coalesce(provenance, '') in ('probe', 'manual'))::int) = 0),
x as (select app_id, split_part(fc, '.', 1) binary_root, cmd_count, regexp_extract(split_part(fc, '.', 1), '^([a-z][a-z0-9_]+)-([a-z][a-z0-9_]+)$', 1) || '.' || regexp_extract(split_part(fc, '.', 1), '^([a-z][a-z0-9_]+)-([a-z][a-z0-9_]+)$', 2) sp from f where regexp_matches(split_part(fc, '.', 1), '^([a-z][a-z0-9_]+)-([a-z][a-z0-9_]+)$') and app_id not like 'py.wheelhub.%')
select app_id, binary_root, sp probe_sub_path, cmd_count, count(*) probe_sub_count from x join pp on pp.cmd_path = sp or starts_with(pp.cmd_path, sp || '.') group by all""",
    "dump_installs": f"""with {_APPS}, {_ENTRIES}, {_DUMP}, so as (select * from a where length(ii) > 2 and json_valid(ii) and trim(ii) like '{{%'),
ke as (select app_id, "key" from k0 where app_id in (select app_id from so) union select app_id, lower("name") from so where app_id not in (select app_id from k0) and "name" <> ''),
f as (select lower(eff) "key", case {' '.join(f"when starts_with(repo, '{x}') then '{m}'" for x, m in L.REPOSITORY_PREFIXES)} end pm, case when repo = 'gentoo' then eff else own end pkg, row_id from du),
n1 as (select "key", pm, arg_min(pkg, row_id) pkg from f where pm is not null group by all), n2 as (select app_id, pm, arg_min(pkg, "key") pkg from ke join n1 using ("key") group by all),
al as (select en.app_id, pm, cmd from en join so using (app_id) where cmd is not null union all select app_id, pm, coalesce({_TPL}[pm], pm || ' install ') || pkg from n2 where not exists (select 1 from en where en.app_id = n2.app_id and en.pm = n2.pm and en.cmd is not null))
select so.app_id, coalesce('{{' || string_agg(to_json(pm) || ':' || to_json(cmd), ',' order by pm) || '}}', '{{}}') install_instructions from so left join al using (app_id) group by 1""",
    "dump_popularity": f"""with {_APPS}, {_ENTRIES}, {_DUMP}, ke as (select app_id, "key" from k0 union select app_id, lower("name") from a where "name" <> ''),
n as (select z "key", count(distinct repo) n from (select repo, unnest([lower(eff), lower(own)]) z from du) group by 1)
select app_id, round(max(least(1.0::double, ln(1 + n::double) / ln(101::double))), 8) popularity from ke join n using ("key") group by 1""",
    "build_commands": _BUILT + f"""select cmd_path, app_id, split_part(cmd_path, '.', -1) node_name, case when position('.' in cmd_path) > 0 then 'sub' else 'root' end node_type, description,
case when risk_level is not null and risk_level not in ('safe', '') then risk_level when {_HAS(L.DANGEROUS)} then 'dangerous' when {_HAS(L.MEDIUM)} then 'medium' else 'safe' end risk_level, example_template, topics, coalesce(nullif(provenance, ''), 'inferred') provenance,
coalesce(nm, app_id, '') || case when contains(app_id, '.') and not contains(coalesce(nm, app_id), split_part(app_id, '.', -1)) then ' ' || split_part(app_id, '.', -1) else '' end "name", concat_ws(' ', pw, coalesce(description, ''), coalesce(topics, '')) capabilities, e "text", exists (select 1 from st where st.cmd_path = f.cmd_path and st.e = f.e) reuse from f""",
    "build_apps": f"""with {_APPS}, {_ENTRIES}, k as (select app_id, '{{' || string_agg(to_json(pm) || ':' || to_json(cmd), ',' order by pm, cmd) || '}}' js from en where trim(cmd) <> '' group by 1),
x as (select a.*, case when json_valid(ii) and trim(ii) like '{{%' then js else ii end i2 from a left join k using (app_id)),
d as (select * from x where "name" is not null and length(i2) > 2 qualify row_number() over (partition by "name" order by case when app_id like 'org.archipel.%' then 1 when app_id like 'sh.tapline.%' then 2 else 0 end, app_id) = 1)
select x.app_id, x."name", case when coalesce(length(x.i2), 0) <= 2 and (x.app_id like 'py.wheelhub.%' or x.app_id like 'io.cratery.%' or x.app_id like 'dev.helpscan.%') then coalesce(d.i2, x.i2) else x.i2 end install_instructions, coalesce(x.pop, 0) popularity from x left join d using ("name")""",
    "install_donors": f"""with {_APPS}, d as (select * from a where "name" is not null and length(ii) > 2 qualify row_number() over (partition by "name" order by case when app_id like 'org.archipel.%' then 1 when app_id like 'sh.tapline.%' then 2 else 0 end, app_id) = 1),
x as (select a.*, coalesce(length(ii), 0) <= 2 and (app_id like 'py.wheelhub.%' or app_id like 'io.cratery.%' or app_id like 'dev.helpscan.%') lends from a)
select x.app_id, case when lends then coalesce(d.ii, x.ii) else x.ii end install_instructions, case when lends then d.app_id end donor from x left join d using ("name")""",
    "deep_import_commands": _DEEP + """select cmd_path, app_id, node_name, node_type, description, risk_level, provenance from f where cmd_path not in (select cmd_path from gone) and cmd_path not in (select cmd_path from fr) union all select * from fr""",
    "deep_import_apps": _DEEP + """select a.app_id, a."name", coalesce(ih.ii, a.ii) install_instructions from a left join hm on a.app_id = hm.home left join ih on ih."name" = hm.tool
where a.app_id not in (select a.app_id from a join hm on a."name" = hm.tool and a.app_id <> hm.home where a.app_id not in (select app_id from f where app_id is not null and cmd_path not in (select cmd_path from gone)))
union all select home, tool, ih.ii from hm left join ih on ih."name" = tool where home not in (select app_id from a)""",
    "strip_json_nulls": f"""with {_APPS}, {_ENTRIES}, k as (select app_id, '{{' || string_agg(to_json(pm) || ':' || to_json(cmd), ',' order by pm, cmd) || '}}' js from en where trim(cmd) <> '' group by 1)
select app_id, case when json_valid(ii) and trim(ii) like '{{%' then js else 'broken' end "json" from a left join k using (app_id) where ii is not null""",
    "install_commands": f"""with {_APPS}, {_ENTRIES} select app_id, {', '.join(_resolved(o) for o in ('ubuntu', 'arch', 'macos', 'fedora'))},
coalesce(case when json_type(os, '$.linux') = 'ARRAY' then os ->> '$.linux[0]' else os ->> '$.linux' end, "name") linux_binary from (select * replace (case when json_valid(os) then os end as os) from a) a""",
    "install_merge": f"""with {_APPS}, {_ENTRIES}, n as (select app_id, pm, cmd from en where cmd is not null union all select a.app_id, x.pm, x.c || split_part(a.app_id, '.', -1) from a, (values ('apt', 'apt install '), ('snap', 'snap install ')) x(pm, c) where not exists (select 1 from en where en.app_id = a.app_id and en.pm = x.pm and en.cmd is not null))
select app_id, '{{' || string_agg(to_json(pm) || ':' || to_json(cmd), ',' order by pm) || '}}' merged from n group by 1""",
    "arch_reclassified": f"""with {_APPS}, {_ENTRIES}, x as (select app_id, {_PKG} pkg from en where pm = 'pacman' and cmd is not null),
o as (select distinct split_part(app_id, '.', -1) pkg from a where app_id like 'org.archipel.%'), u as (select distinct split_part(app_id, '.', -1) pkg from a where app_id not like 'org.archipel.%' and pop >= 0.3),
k as (select app_id, pkg, case when pkg in (select pkg from o) then 'o' when pkg in (select pkg from u) then 'u' else '' end c from x),
n as (select en.app_id, pm, cmd from en left join k using (app_id) where k.app_id is null or (pm <> 'pacman' and not (c = 'u' and pm in ('yay', 'paru'))) union all select app_id, 'pacman', 'pacman -S ' || pkg from k where c = 'o' union all select app_id, z, z || ' -S ' || pkg from k, (select unnest(['yay', 'paru']) z) where c = 'u')
select a.app_id, coalesce('{{' || string_agg(to_json(pm) || ':' || to_json(cmd), ',' order by pm) filter (cmd is not null) || '}}', '{{}}') install_instructions from a left join n using (app_id) where ii is not null and json_valid(ii) and trim(ii) like '{{%' group by 1""",
    "examples_repaired": f"""with {_ARGS}, x as (select g.row_id, g.cmd_path, g.provenance, o.example_template e from g join g o on g.row_id = o.row_id + 1),
t as (select *, list_filter(regexp_split_to_array(trim(e), '\\s+'), lambda z: z <> '') z from x),
u as (select *, case when z[1] = 'sudo' then z[2:] else z end k, lower(split_part(cmd_path, '.', 1)) b, string_split(lower(cmd_path), '.')[2:] s from t),
v as (select *, list_position(list_transform(k[2:], lambda y: starts_with(y, '-') or contains(y, '{{{{') or contains(y, '=') or y in {_q(L.SHELL_OPERATORS)}), true) st from u),
w as (select *, case when st > 0 then k[2:][:st - 1] else k[2:] end bare from v),
f as (select *, coalesce(len(k) > 0 and (lower(k[1]) not in (b, './' || b) or (position('.' in cmd_path) > 0 and len(list_filter(bare, lambda y, i: s[i] is distinct from lower(y))) > 0)), false) faulty from w)
select row_id, case when faulty and coalesce(provenance, 'inferred') = 'inferred' and {_SOUND} then replace(cmd_path, '.', ' ') else e end example_template from f""",
    "repository_managers": f"""with {_APPS}, x as (select *, split_part(app_id, '.', 2) repo from a), y as (select *, case {' '.join(f"when starts_with(lower(repo), '{p}') then '{m}'" for p, m in L.REPOSITORY_PREFIXES)} end pm from x)
select repo, pm, count(*) n, arg_min(app_id, (loaded_at, app_id)) first_app from y where pm is not null group by all""",
    "popularity_lognorm": "with n as (select l_partkey k, count(distinct l_suppkey) n from lineitem group by 1), k as (select p_partkey, unnest([p_partkey, p_partkey - 1]) k from part) select p_partkey, round(max(least(1.0::double, ln(1 + n::double) / ln(101::double))), 8) popularity from k join n using (k) group by 1",
    "consensus_package": f"""with {_APPS}, {_ENTRIES}, t as (select app_id, row_number() over (partition by app_id order by pm, cmd) p, split_part(trim(cmd), ' ', -1) pkg from en), c as (select app_id, pkg, count(*) n, min(p) p from t where pkg <> '' group by all)
select app_id, pkg, n votes from c qualify row_number() over (partition by app_id order by n desc, p) = 1""",
    "name_score_best": f"""with {_APPS}, {_ENTRIES}, t as (select pm, lower("name") q, split_part(trim(cmd), ' ', -1) pkg from en where "name" is not null and trim(cmd) <> ''),
s as (select *, case when lower(pkg) = q then 100 when starts_with(lower(pkg), q) and regexp_replace(lower(pkg)[length(q) + 1:], '^[-_]+', '') = '' then 80 when contains(lower(pkg), q) and not regexp_matches(lower(pkg), 'lib32|lib64|debug|doc|dev|git') then 60 else 0 end score from t)
select pm, q project, pkg, score from s where score >= 60 qualify row_number() over (partition by pm, q order by score desc, length(pkg), pkg desc) = 1""",
    "probe_targets": f"""with {_ARGS}, {_APPS}, u as (select * from a where app_id not in (select app_id from g where provenance = 'probe' and app_id is not null))
select app_id from (select app_id from u order by coalesce(pop, 0) desc, app_id limit 50) union select app_id from u where pop >= 0.9 and app_id in (select lower(trim(app_id)) from arguments_raw)""",
    "work_queue": f"with {_ARGS}, {_APPS} select distinct cmd_path, app_id, pop from g join a using (app_id) where position('.' in cmd_path) = 0 and coalesce(provenance, '') <> 'probe' and pop >= 0.8",
    "vector_reuse": """with k as (select snap_no, dense_rank() over (order by snap_no) step, trim(cmd_path) cmd_path, regexp_replace(translate(trim(cmd_path), '.-', '  ') || '. ' || coalesce(description, '') || ' ', '[\\s\\p{Z}]+$', '') e from arguments_snap where cmd_path is not null),
u as (select snap_no, step, cmd_path, min(regexp_replace(e, '^[\\s\\p{Z}]+', '')) e from k group by 1, 2, 3)
select n.snap_no, n.cmd_path, o.e is not null reuse from (select * from u where step > 1) n left join u o on n.cmd_path = o.cmd_path and n.step = o.step + 1 and n.e = o.e""",
}
