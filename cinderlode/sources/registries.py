"""Registry records from landed dumps, and other scans (S5-S14, N-adapters): every adapter gives the same columns.

app_id, name, cmd_path, description, install_instructions (map), source, source_url.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed patterns: names that are almost never a command-line tool.
SKIP = [
    "^lib", "^python-", "^python2-", "^perl-", "^ruby-", "^haskell-", "^ghc-", "^rust-", "^nodejs-", "^golang-", "-sdk$", "-headers$", "-dev$", "-docs?$", "-bindings$", "-typelib$", "-stubs$", "-dkms$", "-dbg$", "-debug$",
    "-git$", "-svn$", "-hg$", "-bzr$", "^ttf-", "^otf-", "-fonts?$", "-theme$", "-themes$", "-icon", "-cursor-theme$", "-wallpapers?$", "-gtk-theme$", "-kde-theme$", "-cursors$", "-sounds?$", "-emoji", "-i18n-", "-l10n-", "-lang-",
    "-translation", "-locale",
]
ALLOWED = ["libtree", "python-llm", "libcaca", "libxml2"]
NAMESPACES = {"pip": "org.pypi", "npm": "com.npmjs", "aur": "org.archlinux", "cargo": "io.crates", "go": "io.pkg.go"}


def _record(df: DataFrame, app_id: Column, name: Column, description: Column, fallback: Column, installs: Column, source: str, url: Column) -> DataFrame:
    text = F.trim(F.coalesce(description, F.lit("")))
    return df.select(app_id.alias("app_id"), name.alias("name"), name.alias("cmd_path"), F.when(text != "", text).otherwise(fallback).alias("description"), installs.alias("install_instructions"), F.lit(source).alias("source"), F.coalesce(url, F.lit("")).alias("source_url"))


def aur(spark: SparkSession, path: str) -> DataFrame:
    """A dump of JSON packages (gz is read as it is): Name, Description, URL."""
    df = spark.read.schema("Name string, Description string, URL string").option("multiLine", True).json(path).where("Name <> ''")
    df = df.where(F.col("Name").isin(*ALLOWED) | ~F.col("Name").rlike("(?i)" + "|".join(SKIP)))
    name = F.col("Name")
    return _record(df, F.concat(F.lit("org.archlinux.aur."), name), name, F.col("Description"), F.concat(name, F.lit(" (AUR package)")), F.create_map(F.lit("yay"), F.concat(F.lit("yay -S "), name), F.lit("paru"), F.concat(F.lit("paru -S "), name)), "aur", F.col("URL"))


def crates(spark: SparkSession, path: str) -> DataFrame:
    """Landed listing pages: {crates: [{id, name, description, repository, homepage}]}."""
    pages = spark.read.schema("crates array<struct<id:string,name:string,description:string,repository:string,homepage:string>>").option("multiLine", True).json(path)
    df = pages.select(F.explode("crates").alias("c")).select("c.*").withColumn("n", F.coalesce(F.nullif("id", F.lit("")), "name")).where("n <> ''")
    n = F.col("n")
    return _record(df, F.concat(F.lit("io.crates."), n), n, F.col("description"), F.concat(n, F.lit(" (Rust command-line tool)")), F.create_map(F.lit("cargo"), F.concat(F.lit("cargo install "), n)), "crates.io", F.coalesce(F.nullif("repository", F.lit("")), "homepage"))


def npm(spark: SparkSession, path: str) -> DataFrame:
    """Landed packages {name, description, bin, repository}; each name once, only those with a binary."""
    df = spark.read.schema("name string, description string, bin string, repository string").json(path).where("name <> ''")
    df = df.groupBy("name").agg(F.max_by(F.struct("description", "bin", "repository"), F.struct(F.col("bin").isNotNull().alias("b"), F.coalesce("description", F.lit("")).alias("d"))).alias("r")).select("name", "r.*")
    df = df.where("bin is not null and trim(bin) not in ('', '{}', 'null', 'false')")
    leaf, url = F.substring_index("name", "/", -1), F.coalesce(F.when(F.col("repository").startswith("{"), F.get_json_object("repository", "$.url")), "repository")
    clean = F.regexp_replace(F.regexp_replace(url, r"^git\+", ""), r"\.git$", "")
    return _record(df, F.concat(F.lit("com.npmjs."), F.replace(F.regexp_replace("name", "^@+", ""), F.lit("/"), F.lit("-"))), leaf, F.col("description"), F.concat("name", F.lit(" (npm CLI package)")), F.create_map(F.lit("npm"), F.concat(F.lit("npm install -g "), "name")), "npm", clean)


def pypi(spark: SparkSession, path: str) -> DataFrame:
    """Landed package documents {info: {...}}; only those classified for the console, the first project URL that is there."""
    info = "name string, summary string, classifiers array<string>, project_urls map<string,string>, project_url string"
    df = spark.read.schema(f"info struct<{', '.join(x.replace(' ', ':', 1) for x in info.split(', '))}>").json(path).select("info.*").where("name <> ''")
    df = df.where(F.exists("classifiers", lambda c: c.startswith("Environment :: Console")))
    urls = F.coalesce(*(F.nullif(F.col("project_urls")[k], F.lit("")) for k in ("Source", "Code", "Repository", "Homepage")), "project_url")
    n = F.col("name")
    return _record(df, F.concat(F.lit("org.pypi."), n), n, F.col("summary"), F.concat(n, F.lit(" (PyPI console application)")), F.create_map(F.lit("pip"), F.concat(F.lit("pip install "), n), F.lit("uv"), F.concat(F.lit("uv tool install "), n)), "pypi", urls)


def app_id_for(source: Column, package: Column) -> Column:
    """A stable app_id: the source's namespace and the package without scope mark and extras, unsafe letters as single dashes."""
    space = F.coalesce(F.create_map(*[F.lit(x) for kv in NAMESPACES.items() for x in kv])[source], F.concat(F.lit("unknown."), source))
    bare = F.regexp_replace(F.regexp_replace(package, r"^@+", ""), r"\[.*$", "")
    return F.concat(space, F.lit("."), F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"[^a-zA-Z0-9._-]", "-"), "-+", "-"), "^-+|-+$", ""))


def copy_dump(spark: SparkSession, path: str, table: str = "packages") -> DataFrame:
    r"""Rows of the COPY blocks of a table in plain SQL dumps: one string column per name in the block's head, and line, their order.

    A block runs from its head to the next line \. of the same file; \N is null. Heads and ends, two lines a table of the dump,
    are found first; the rows between them are then read in parallel, by their place in the file.
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"))
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), place.alias("at"))
    marks = sorted((r["file"], tuple(r["at"]), r["value"]) for r in lines.where((F.col("value") == r"\.") | F.col("value").rlike(r"^COPY \S+ \(.*FROM stdin")).collect())
    rows = None
    for n, (file, begin, head) in enumerate(marks):
        if not re.match(rf"COPY (\S+\.)?{table} \(", head):
            continue
        end = next(((f, at) for f, at, v in marks[n + 1:] if f == file and v == r"\."), None)
        names = [c.strip().strip('"') for c in head[head.index("(") + 1:head.index(")")].split(",")]

        def limit(at):
            return F.struct(F.lit(at[0]).cast("long").alias("block"), F.lit(at[1]).cast("long").alias("i"))

        inside = (F.col("file") == file) & (F.col("at") > limit(begin)) & ((F.col("at") < limit(end[1])) if end else F.lit(True))
        fields = F.split("value", "\t", -1)
        block = lines.where(inside).select(*(F.when(F.get(fields, F.lit(i)) != r"\N", F.get(fields, F.lit(i))).alias(c) for i, c in enumerate(names)), F.struct("file", "at").alias("line"))
        rows = block if rows is None else rows.unionByName(block, allowMissingColumns=True)
    return spark.createDataFrame([], "repo string") if rows is None else rows


def package_names(dump: DataFrame) -> DataFrame:
    """repo, name: every name a row of the package dump is known by, lower-cased."""
    listed = F.split(F.regexp_replace(F.coalesce("binnames", F.lit("")), r'[{}"]', ""), ",")
    names = F.concat(F.array(*(F.coalesce(c, F.lit("")) for c in ("effname", "binname", "srcname"))), listed)
    return dump.select("repo", F.explode(F.array_distinct(F.transform(names, lambda n: F.lower(F.trim(n))))).alias("name")).where("name <> '' and repo is not null")


def probe_pages(spark: SparkSession, folder: str) -> DataFrame:
    """cmd_path, path, text of probe files with the tool, or source and package, that the file's name tells."""
    df = spark.read.schema("cmd_path string, path array<string>, text string").option("multiLine", True).option("pathGlobFilter", "*.json").json(folder).withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    return df.withColumn("tool", F.nullif(F.regexp_extract("file", "^cli_(.+)$", 1), F.lit(""))).withColumn("source", F.when(F.col("tool").isNull(), F.substring_index("file", "_", 1))).withColumn("package", F.when(F.col("tool").isNull(), F.regexp_extract("file", "^[^_]*_(.*)$", 1)))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; bad ones are left out. enrichment caches may end in a half-written line."""
    return spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path).where("_bad is null").drop("_bad")


def snapshot_json(spark: SparkSession, path: str, apps: str, arguments: str) -> tuple[DataFrame, DataFrame]:
    """The two tables of a one-document snapshot {apps: [...], arguments: [...]}."""
    def struct(schema):
        return "array<struct<" + ", ".join(x.strip().replace(" ", ":", 1) for x in schema.split(",")) + ">>"

    doc = spark.read.schema(f"apps {struct(apps)}, arguments {struct(arguments)}").option("multiLine", True).json(path)
    return doc.select(F.explode("apps").alias("x")).select("x.*"), doc.select(F.explode("arguments").alias("x")).select("x.*")


def skills(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Contracts of a folder tree of JSON files, an object or a list in each; files that are not JSON are skipped."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).option("multiLine", True).option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.json").json(folder)


def skill_matches(contracts: DataFrame, query: str) -> DataFrame:
    """Contracts whose name, path and description together hold every word of the query; all for an empty query."""
    words = query.lower().split()
    hay = F.lower(F.concat_ws(" ", "name", "cmd_path", "description"))
    for w in words:
        contracts = contracts.where(F.contains(hay, F.lit(w)))
    return contracts


def bootstrap(current: DataFrame | None, starter: DataFrame) -> DataFrame:
    """The starter data where there is no table or an empty one; a table that cannot be read must raise, it is never replaced."""
    return starter if current is None or current.isEmpty() else current
