"""Column functions over install maps, package names and repositories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cinderlode.functions import lexicon as L
from cinderlode.functions.text import literal_map


def install_map(text: Column) -> Column:
    """The map of a JSON object; null where the text is no object."""
    return F.when(F.trim(text).startswith("{") & F.try_parse_json(text).isNotNull(), F.from_json(F.trim(text), "map<string,string>"))


def stripped(text: Column) -> Column:
    """Entries that are null or blank removed, nothing left becomes null, broken JSON stays as it is."""
    m = install_map(text)
    kept = F.map_filter(m, lambda k, v: v.isNotNull() & (F.trim(v) != ""))
    return F.when(m.isNull(), text).when(F.size(kept) > 0, F.to_json(F.map_from_entries(F.array_sort(F.map_entries(kept)))))


def command_for(manager: Column, raw: Column) -> Column:
    """A full install command: as it is where it has a blank or begins with the manager, else by the manager's template."""
    return F.when(F.contains(raw, F.lit(" ")) | F.startswith(raw, manager), raw).otherwise(F.concat(F.coalesce(literal_map(L.INSTALL_TEMPLATES)[manager], F.lit("")), raw))


def build_command(manager: Column, package: Column) -> Column:
    return F.concat(F.coalesce(literal_map(L.INSTALL_TEMPLATES)[manager], F.concat(manager, F.lit(" install "))), package)


def resolved(m: Column, os: Column, preferred: list[str], superuser: bool = False) -> Column:
    """The install command for an OS: its own manager, helpers on arch, the preferred managers, then the cross-platform ones."""
    own = F.coalesce(literal_map(L.OS_MANAGERS)[os], os)
    helpers = F.when(os == "arch", F.array(F.lit("yay"), F.lit("paru"))).otherwise(F.array().cast("array<string>"))
    order = F.concat(F.array(own), helpers, F.array(*map(F.lit, [*preferred, *L.FALLBACK_MANAGERS])))
    pm = F.get(F.filter(order, lambda p: m[p].isNotNull()), F.lit(0))
    command = command_for(pm, m[pm])
    return command if superuser else F.when(pm.isin(*L.SYSTEM_MANAGERS), F.concat(F.lit("sudo "), command)).otherwise(command)


def merged_add_only(old: Column, new: Column) -> Column:
    """Entries of both maps; an old value that is not null wins. Sorted by key."""
    kept = F.map_filter(F.coalesce(old, F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>"))), lambda k, v: v.isNotNull())
    extra = F.map_filter(F.coalesce(new, F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>"))), lambda k, v: v.isNotNull() & ~F.map_contains_key(kept, k))
    return F.map_from_entries(F.array_sort(F.concat(F.map_entries(kept), F.map_entries(extra))))


def package_of(value: Column) -> Column:
    """The last word of an install command."""
    return F.element_at(F.split(F.trim(value), r"\s+"), -1)


def name_score(package: Column, project: Column) -> Column:
    """100 equal, 80 equal but for trailing - or _, 60 contained and clean, 10 a build variant, else 30."""
    p, q = F.lower(package), F.lower(project)
    rest = F.regexp_replace(F.substring(p, F.length(q) + 1, F.length(p)), "^[-_]+", "")
    return F.when(p == q, 100).when(F.startswith(p, q) & (rest == ""), 80).when(F.contains(p, q) & ~p.rlike("lib32|lib64|debug|doc|dev|git"), 60).when(p.rlike("lib32|lib64|debug|doc|dev|-git|-nox"), 10).otherwise(30)


def manager_of(repository: Column, table: list[tuple[str, str]] = L.REPOSITORY_PREFIXES) -> Column:
    """The package manager of a repository by the first prefix that fits; null if none does."""
    prefixes = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(m).alias("m")) for p, m in table))
    return F.get(F.filter(prefixes, lambda x: F.startswith(F.lower(repository), x["p"])), F.lit(0))["m"]


def package_in(repository: Column, binary: Column, source: Column) -> Column:
    """The name a package is installed by: its source's name where the repository goes by that, else its own; either if one is empty."""
    own, src = F.nullif(binary, F.lit("")), F.nullif(source, F.lit(""))
    by_source = F.exists(F.array(*map(F.lit, L.BY_SOURCE_NAME)), lambda p: F.startswith(F.lower(repository), p))
    return F.when(by_source, F.coalesce(src, own)).otherwise(F.coalesce(own, src))


def package_keys(m: Column, name: Column, always_name: bool) -> Column:
    """Lower-cased package names of an app's install commands; its name too, or only where there are no others."""
    told = F.filter(F.transform(F.array(*map(F.lit, L.PACKAGE_MANAGERS)), lambda k: F.lower(package_of(m[k]))), lambda p: F.coalesce(p != "", F.lit(False)))
    told = F.coalesce(told, F.array().cast("array<string>"))
    own = F.filter(F.array(F.lower(name)), lambda p: F.coalesce(p != "", F.lit(False)))
    return F.array_distinct(F.concat(told, own) if always_name else F.when(F.size(told) > 0, told).otherwise(own))


def popularity(repositories: Column, cap: int = L.POPULARITY_CAP) -> Column:
    return F.least(F.lit(1.0), F.log1p(repositories) / F.log1p(F.lit(cap)))


def binary_name(aliases: Column, os: str, name: Column) -> Column:
    """The binary's name on an OS by a JSON map of aliases, a text or a list whose first entry counts; else the name."""
    told = F.get_json_object(aliases, f"$.{os}")
    return F.coalesce(F.when(told.startswith("["), F.get_json_object(told, "$[0]")).otherwise(told), name)


def reclassified(m: Column, package: Column, official: Column, users: Column) -> Column:
    """An install map (sorted by key) whose pacman entry is made a whole command if its package is official, becomes a yay and a paru entry if
    it is one of the users' repository, and goes otherwise; a map without that entry, or without a package, stays as it is.
    """
    rest = F.map_filter(m, lambda k, v: k != "pacman")
    own = F.create_map(F.lit("pacman"), F.concat(F.lit("pacman -S "), package))
    theirs = F.create_map(F.lit("yay"), F.concat(F.lit("yay -S "), package), F.lit("paru"), F.concat(F.lit("paru -S "), package))
    others = F.map_filter(rest, lambda k, v: ~k.isin("yay", "paru"))
    made = F.when(official, F.map_concat(rest, own)).when(users, F.map_concat(others, theirs)).otherwise(rest)
    return F.map_from_entries(F.array_sort(F.map_entries(F.when(F.map_contains_key(m, F.lit("pacman")) & package.isNotNull(), made).otherwise(m))))
