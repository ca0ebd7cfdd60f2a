"""Curation of a command registry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlode.functions import lexicon as L
from cinderlode.functions import text as T


def first_by(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The first row of each key by ordinal; a struct minimum, so it combines before the shuffle and holds no group."""
    rest = [c for c in rows.columns if c not in (key, ordinal)]
    return rows.groupBy(key).agg(F.min_by(F.struct(F.col(ordinal), *rest), ordinal).alias("r")).select(key, "r.*")


def cleaned(arguments: DataFrame, ordinal: str) -> DataFrame:
    """Paths cleaned, first row of each, node types set anew, noise commands left out."""
    rows = arguments.withColumn("cmd_path", T.clean_path(F.col("cmd_path"))).where("cmd_path <> ''")
    rows = first_by(rows, "cmd_path", ordinal).where(~T.is_noise(F.col("cmd_path")))
    return rows.withColumn("node_type", T.node_type(F.col("cmd_path")))


def reanchored(arguments: DataFrame, apps: DataFrame, least: int = 20, times: int = 5) -> DataFrame:
    """Roots moved to the same-name app with by far the most commands. apps: app_id, name, ord (input order breaks ties)."""
    size = arguments.groupBy("app_id").agg(F.count("*").alias("size"))
    named = apps.select("app_id", F.lower("name").alias("nm"), "ord").where("nm <> ''").join(size, "app_id", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    richest = named.groupBy("nm").agg(F.max_by(F.struct("app_id", "size"), F.struct("size", (-F.col("ord")).alias("o"))).alias("r")).select("nm", F.col("r.app_id").alias("target"), F.col("r.size").alias("t_size"))
    owner = named.select("app_id", F.col("nm").alias("own_name"), F.col("size").alias("o_size"))
    joined = arguments.join(owner, "app_id", "left").withColumn("nm", F.when(~F.contains("cmd_path", F.lit(".")) & (F.lower("cmd_path") == F.col("own_name")), F.col("own_name"))).join(richest, "nm", "left")
    moves = F.col("target").isNotNull() & (F.col("target") != F.col("app_id")) & (F.col("t_size") >= least) & (F.col("t_size") >= times * F.greatest("o_size", F.lit(1)))
    return joined.withColumn("app_id", F.when(moves, F.col("target")).otherwise(F.col("app_id"))).select(*arguments.columns)


def canonical(arguments: DataFrame, apps: DataFrame) -> DataFrame:
    """One row per canonical path: probe rows first, own path canonical, popularity, size of the app's tree, app; topics of the
    merged rows are united in that order. A path that stands alone keeps its topics as they are. apps: app_id, pop.
    """
    size = arguments.groupBy("app_id").agg(F.count("*").alias("size"))
    rows = arguments.withColumn("canon", T.canonical_path(F.col("cmd_path"))).join(apps.select("app_id", "pop"), "app_id", "left").join(size, "app_id", "left")
    order = F.struct((F.coalesce(F.col("provenance"), F.lit("")) != "probe").alias("a"), (F.lower("cmd_path") != F.col("canon")).alias("b"), (-F.coalesce("pop", F.lit(0.0))).alias("c"), (-F.coalesce("size", F.lit(0))).alias("d"), F.coalesce("app_id", F.lit("")).alias("e"), F.col("cmd_path").alias("f"))
    words = F.filter(F.split(F.coalesce("topics", F.lit("")), r"[,\s]+"), lambda t: t != "")
    # Topics are first reduced to one row per word and group, the best place of each, so a hot group stays small.
    ranked = rows.withColumn("o", order)
    united = (
        ranked.select("canon", "o", F.posexplode(words).alias("p", "topic")).groupBy("canon", "topic").agg(F.min(F.struct("o", "p")).alias("at"))
        .groupBy("canon").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "topic"))), lambda x: x["topic"]), " ").alias("united"))
    )
    keep = ranked.groupBy("canon").agg(F.min_by(F.struct("cmd_path", "app_id", "provenance", "topics"), "o").alias("k"), F.count("*").alias("n"))
    return keep.join(united, "canon", "left").select("canon", "k.cmd_path", "k.app_id", F.col("n").alias("merged"), F.when(F.col("n") > 1, F.coalesce("united", F.lit(""))).otherwise(F.col("k.topics")).alias("topics"))


def overridden(arguments: DataFrame, patches: DataFrame) -> DataFrame:
    """patches (cmd_path, description, topics, topics_append, example_template), one row a path; null leaves a field as it is."""
    p = patches.select("cmd_path", *(F.col(c).alias("p_" + c) for c in ("description", "topics", "topics_append", "example_template")))
    joined = arguments.join(p, "cmd_path", "left")
    topics = F.coalesce("p_topics", "topics")
    return joined.select(*(
        F.coalesce("p_description", "description").alias(c) if c == "description" else F.coalesce("p_example_template", "example_template").alias(c) if c == "example_template"
        else F.when(F.col("p_topics_append").isNotNull(), F.trim(F.concat_ws(" ", topics, "p_topics_append"))).otherwise(topics).alias(c) if c == "topics" else F.col(c) for c in arguments.columns))


def added(arguments: DataFrame, new: DataFrame, apps: DataFrame) -> DataFrame:
    """arguments with the new rows whose path is absent and whose app exists."""
    fresh = new.join(arguments.select("cmd_path"), "cmd_path", "left_anti").join(apps.select("app_id"), "app_id", "left_semi")
    return arguments.unionByName(fresh.select(*arguments.columns))


def libraries(apps: DataFrame, long_tail: str) -> DataFrame:
    """Apps that are language libraries, by name or package; the wider pattern counts only under the long_tail namespace."""
    pkg = F.substring_index("app_id", ".", -1)

    def hit(pattern):
        return F.coalesce(F.col("name").rlike(pattern), F.lit(False)) | pkg.rlike(pattern)

    allowed = F.coalesce(F.col("name").isin(*L.LIBRARY_ALLOWED), F.lit(False)) | pkg.isin(*L.LIBRARY_ALLOWED)
    return apps.where(~allowed & (hit(L.LIBRARY_PATTERN) | (F.col("app_id").startswith(long_tail) & hit(L.LONG_TAIL_PATTERN))))


def malformed(path, tool: str):
    """The tool's own name again as a deeper segment."""
    return path.like(f"{tool}.{tool}.%") | path.like(f"%.{tool}.{tool}.%") | path.like(f"{tool}.%.{tool}") | path.like(f"{tool}.%.{tool}.%")


def registry_import(existing: DataFrame, incoming: DataFrame, covered: DataFrame, ordinal: str) -> DataFrame:
    """Incoming records (cmd_path, name, description, ordinal, ...) to insert, in their order.

    Left out are paths that exist or came before, names that are covered (by an app with install data), and <base>-bin where the base is
    covered, exists as a path, or comes in before it. A description of fewer than five letters is replaced by the name and
    what it is. Records with a null path or name are no records; ties of the ordinal are for the caller to break.
    """
    names = covered.select(F.col("name")).where("name is not null").distinct()
    paths = existing.select("cmd_path").where("cmd_path is not null").distinct()
    taken = names.unionByName(paths.select(F.col("cmd_path").alias("name"))).distinct()
    rows = incoming.where("cmd_path is not null and name is not null").join(paths, "cmd_path", "left_anti").join(names, "name", "left_anti")
    rows = rows.withColumn("base", F.when(F.col("name").endswith("-bin"), F.regexp_replace("name", "-bin$", "")))
    rows = rows.join(taken.select(F.col("name").alias("base")), "base", "left_anti")
    rows = first_by(rows.select(*incoming.columns, "base"), "cmd_path", ordinal)
    earlier = rows.where("base is null").select(F.col("cmd_path").alias("base"), F.col(ordinal).alias("_before"))
    twin = rows.join(earlier, "base", "left").where(F.col("_before").isNull() | (F.col("_before") > F.col(ordinal)))
    text = F.trim(F.coalesce("description", F.lit("")))
    return twin.withColumn("description", F.when(F.length(text) < 5, F.concat("name", F.lit(" — command-line tool"))).otherwise(text)).select(*incoming.columns)


def with_ancestors(paths: DataFrame, column: str = "cmd_path") -> DataFrame:
    """Every path with each of its ancestors, itself included: the equi-join form of a path-prefix test."""
    parts = F.split(column, r"\.")
    return paths.withColumn("ancestor", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))))


def replaced_subtrees(current: DataFrame, incoming: DataFrame, roots: DataFrame) -> DataFrame:
    """current without the subtrees below roots (root), and the incoming rows instead."""
    gone = with_ancestors(current.select("cmd_path").distinct()).join(roots.select(F.col("root").alias("ancestor")), "ancestor", "left_semi").select("cmd_path").distinct()
    return current.join(gone, "cmd_path", "left_anti").unionByName(incoming.select(*current.columns))


def broken_prefix_twins(arguments: DataFrame, apps: DataFrame, least: int = 2) -> DataFrame:
    """Apps whose first path segments (least or more, none the app's own name) are all subcommands of a same-name app: app_id, twin."""
    named = arguments.join(apps.select("app_id", F.lower("name").alias("nm")).where("nm <> ''"), "app_id")
    first, second = F.lower(T.root(F.col("cmd_path"))), F.lower(F.get(F.split("cmd_path", r"\."), F.lit(1)))
    heads = named.select("nm", "app_id", first.alias("seg")).distinct()
    good = named.where(first == F.col("nm")).select("nm", F.col("app_id").alias("twin"), second.alias("seg")).where("seg is not null").distinct()
    odd = heads.groupBy("nm", "app_id").agg(F.count("*").alias("n"), F.max((F.col("seg") == F.col("nm")).cast("int")).alias("own")).where(f"n >= {least} and own = 0").select("nm", "app_id", "n")
    shared = heads.join(odd, ["nm", "app_id"]).join(good, ["nm", "seg"]).where("app_id <> twin").groupBy("app_id", "twin", "n").agg(F.count("*").alias("k"))
    return shared.where("k = n").groupBy("app_id").agg(F.min("twin").alias("twin"))


def fabrications(arguments: DataFrame, apps: DataFrame, real_namespaces: list[str]) -> DataFrame:
    """Apps of only inferred commands named <tool>-<sub>, where <tool>.<sub> is a probed command of another."""
    rows = arguments.where("cmd_path is not null")
    probed = rows.where("provenance = 'probe'").select("cmd_path").distinct()
    below = with_ancestors(probed).groupBy("ancestor").agg(F.count("*").alias("probe_sub_count"))
    profile = rows.join(apps.select("app_id"), "app_id").groupBy("app_id").agg(F.min("cmd_path").alias("first_cmd"), F.count("*").alias("cmd_count"), F.sum(F.when(F.col("provenance").isin("probe", "manual"), 1).otherwise(0)).alias("real"))
    base = T.root(F.col("first_cmd"))
    pattern = "^([a-z][a-z0-9_]+)-([a-z][a-z0-9_]+)$"
    odd = profile.where("real = 0").withColumn("binary_root", base).withColumn("tool", F.regexp_extract("binary_root", pattern, 1)).withColumn("ancestor", F.concat("tool", F.lit("."), F.regexp_extract("binary_root", pattern, 2)))
    for namespace in real_namespaces:
        odd = odd.where(~F.col("app_id").startswith(namespace))
    return odd.where("tool <> ''").join(below, "ancestor").select("app_id", "binary_root", F.col("ancestor").alias("probe_sub_path"), "cmd_count", "probe_sub_count")


def without_apps(arguments: DataFrame, apps: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """arguments and apps without those of the found apps (app_id): what a sweep deletes once its report is accepted."""
    gone = found.select("app_id").distinct()
    return arguments.join(gone, "app_id", "left_anti").select(*arguments.columns), apps.join(gone, "app_id", "left_anti").select(*apps.columns)


def examples_repaired(arguments: DataFrame, repair) -> DataFrame:
    """arguments with the examples that call another binary or stray replaced by repair (a function of path, description and example
    columns, such as a look-up in landed answers); a repair that is null or faulty itself is not taken.
    """
    p, e = F.col("cmd_path"), F.col("example_template")
    faulty = T.example_fault(p, e).isNotNull() & (F.coalesce("provenance", F.lit("inferred")) == "inferred")
    new = repair(p, F.col("description"), e)
    taken = faulty & new.isNotNull() & T.example_fault(p, new).isNull()
    return arguments.withColumn("example_template", F.when(taken, new).otherwise(e))


def donors(apps: DataFrame, borrowers: tuple[str, ...] = ("com.github.", "com.gitlab."), last: tuple[str, ...] = ("org.archlinux.", "org.tldr.")) -> DataFrame:
    """Install data that apps of the borrowing namespaces lack, from an app of the same name: app_id, install_instructions, donor.

    Data of two letters or fewer ({} or less) count as none. Namespaces in last give only where no other does, in that order; then the
    smallest app_id. Other apps keep what they have.
    """
    place = F.lit(0)
    for i, prefix in enumerate(last, 1):
        place = F.when(F.col("app_id").startswith(prefix), i).otherwise(place)
    has = F.coalesce(F.length("install_instructions") > 2, F.lit(False))
    giving = apps.where(F.col("name").isNotNull() & has).groupBy("name").agg(F.min(F.struct(place.alias("o"), "app_id", "install_instructions")).alias("d"))
    lends = ~has & reduce(lambda x, y: x | y, (F.col("app_id").startswith(b) for b in borrowers))
    return apps.join(giving, "name", "left").select(
        "app_id", F.when(lends, F.coalesce("d.install_instructions", "install_instructions")).otherwise(F.col("install_instructions")).alias("install_instructions"), F.when(lends, F.col("d.app_id")).alias("donor"))


def inherited_install(apps: DataFrame, preferred: tuple[str, ...]) -> DataFrame:
    """name, inherited: install data of more than two letters by the order of namespaces, then the longest, then the smallest app_id."""
    place = F.lit(len(preferred) + 1)
    for i in range(len(preferred), 0, -1):
        place = F.when(F.col("app_id").startswith(preferred[i - 1]), i).otherwise(place)
    usable = apps.where("name is not null and length(install_instructions) > 2")
    return usable.groupBy("name").agg(F.min(F.struct(place.alias("o"), (-F.length("install_instructions")).alias("l"), "app_id", "install_instructions")).alias("d")).select("name", F.col("d.install_instructions").alias("inherited"))


def deep_imported(arguments: DataFrame, apps: DataFrame, pages: DataFrame, namespace: str, preferred: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Probed command trees take the place of what was known of their tools: (arguments, apps).

    pages: tool, cmd_path, path (array), description, ordinal; error pages are left out before. A tool's commands go to the app of its name
    with the most commands (smallest app_id on ties), or to namespace + tool. All paths below the tool are replaced; other apps of
    its name that then own no command are dropped. The app gets install data by inherited_install, else keeps its own. arguments: cmd_path, app_id,
    node_name, node_type, description, risk_level, provenance; apps: app_id, name, install_instructions. The last page of a path counts.
    """
    tools = pages.select("tool").where("tool is not null").distinct()
    size = arguments.groupBy("app_id").agg(F.count("*").alias("n"))
    owned = apps.join(tools.select(F.col("tool").alias("name")), "name", "left_semi").join(size, "app_id", "left")
    home = owned.groupBy("name").agg(F.min(F.struct((-F.coalesce("n", F.lit(0))).alias("n"), "app_id")).alias("h")).select(F.col("name").alias("tool"), F.col("h.app_id").alias("home"))
    home = tools.join(home, "tool", "left").withColumn("home", F.coalesce("home", F.concat(F.lit(namespace), "tool")))
    last = pages.where("cmd_path <> ''").groupBy("cmd_path").agg(F.max_by(F.struct("tool", "path", "description"), "ordinal").alias("p")).select("cmd_path", "p.*").join(home, "tool")
    fresh = last.select(
        "cmd_path", F.col("home").alias("app_id"), F.coalesce(F.element_at("path", -1), F.substring_index("cmd_path", ".", -1)).alias("node_name"), F.when(F.size("path") <= 1, "root").otherwise("sub").alias("node_type"),
        F.coalesce(F.nullif("description", F.lit("")), F.concat(F.array_join("path", " "), F.lit(" command"))).alias("description"), F.lit("safe").alias("risk_level"), F.lit("probe").alias("provenance"))
    gone = with_ancestors(arguments.select("cmd_path").distinct()).join(tools.select(F.col("tool").alias("ancestor")), "ancestor", "left_semi").select("cmd_path").distinct()
    kept = arguments.join(gone, "cmd_path", "left_anti").join(fresh.select("cmd_path"), "cmd_path", "left_anti")
    left = arguments.join(gone, "cmd_path", "left_anti").select("app_id").distinct()
    twins = apps.join(home, (apps["name"] == home["tool"]) & (apps["app_id"] != home["home"]), "left_semi").select("app_id").join(left, "app_id", "left_anti")
    given = home.join(inherited_install(apps, preferred).withColumnRenamed("name", "tool"), "tool", "left")
    rest = apps.join(twins, "app_id", "left_anti").join(given.select(F.col("home").alias("app_id"), "inherited", F.lit(True).alias("_home")), "app_id", "left")
    rest = rest.withColumn("install_instructions", F.coalesce("inherited", "install_instructions")).select("app_id", "name", "install_instructions")
    new = given.join(apps.select(F.col("app_id").alias("home")), "home", "left_anti").select(F.col("home").alias("app_id"), F.col("tool").alias("name"), F.col("inherited").alias("install_instructions"))
    return kept.select(*fresh.columns).unionByName(fresh), rest.unionByName(new)
