"""Exports of a registry."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinderlode.core import stage
from cinderlode.functions import installs as I
from cinderlode.functions import text as T


def shards(apps: DataFrame, arguments: DataFrame) -> DataFrame:
    """One JSON document per app: its data, what its root tells, and its command tree in path order.

    A tree is one app's published document, so it is one row by its nature; equal rows are united before they are collected.
    """
    node = F.struct("cmd_path", "node_type", F.coalesce("description", F.lit("")).alias("description"), F.coalesce("risk_level", F.lit("safe")).alias("risk_level"), "example_template")
    tree = arguments.select("app_id", node.alias("node")).distinct().groupBy("app_id").agg(F.array_sort(F.collect_list("node")).alias("tree"))
    roots = arguments.where("instr(cmd_path, '.') = 0").groupBy("app_id").agg(F.min_by(F.struct("description", "topics"), "cmd_path").alias("root"))
    joined = apps.join(tree, "app_id", "left").join(roots, "app_id", "left")
    doc = F.struct("app_id", "name", F.coalesce("root.description", F.lit("")).alias("description"), T.topic_words(F.col("root.topics")).alias("topics"), F.col("popularity").cast("decimal(10,6)").cast("string").alias("popularity"), F.coalesce("tree", F.array().cast("array<struct<cmd_path:string,node_type:string,description:string,risk_level:string,example_template:string>>")).alias("tree"))
    return joined.select("app_id", F.size(F.coalesce("tree", F.array().cast("array<struct<cmd_path:string,node_type:string,description:string,risk_level:string,example_template:string>>"))).alias("nodes"), F.to_json(doc).alias("shard"))


def ordered(apps: DataFrame, slices: int = 64, spread: int = 64) -> DataFrame:
    """Every app with its place in the index: popularity down, then app_id.

    Places come in steps: popularity is cut in slices, and each slice by the first letters' order of app_id, found from
    the exact quantile bounds of a sorted sample of ids; so apps of one popularity do not share a task.
    """
    pop = F.coalesce("popularity", F.lit(0.0))
    cut = apps.withColumn("slice", (slices - 1 - F.least(F.lit(slices - 1), F.greatest(F.lit(0), F.floor(pop * slices)))).cast("int"))
    # A slice of one popularity only is parted by ranges of app_id, others are ordered as they are.
    shape = cut.groupBy("slice").agg(F.min(pop).alias("lo"), F.max(pop).alias("hi"))
    flat = cut.join(F.broadcast(shape), "slice").withColumn("flat", F.col("lo") == F.col("hi")).drop("lo", "hi")
    bounds = flat.where("flat").select("app_id").sample(min(1.0, 20_000 / max(1, apps.count())), 7).limit(20_000).orderBy("app_id").collect()
    edges = sorted({bounds[len(bounds) * i // spread][0] for i in range(1, spread)} - {None}) if bounds else []
    piece = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col("app_id"))) if edges else F.lit(0)
    cut = flat.withColumn("piece", F.when(F.col("flat"), piece).otherwise(0))
    w = Window.orderBy("slice", "piece").rowsBetween(Window.unboundedPreceding, -1)  # one row a slice and piece
    before = cut.groupBy("slice", "piece").agg(F.count("*").alias("c")).withColumn("before", F.coalesce(F.sum("c").over(w), F.lit(0))).drop("c")
    own = F.row_number().over(Window.partitionBy("slice", "piece").orderBy(F.desc(pop), "app_id"))
    return cut.withColumn("own", own).join(F.broadcast(before), ["slice", "piece"]).withColumn("place", F.col("before") + F.col("own")).drop("slice", "piece", "flat", "own", "before")


def sitemap(apps: DataFrame, per_file: int = 50_000, base_url: str = "", changed: str = "") -> DataFrame:
    """app_id, part (from 1), place and the URL entry with the date of the change and the popularity as priority."""
    priority = F.format_number(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("popularity", F.lit(0.0)))), 1)
    address = T.xml_escaped(F.concat(F.lit(f"{base_url}/c/"), "app_id"))
    entry = F.concat(F.lit("  <url><loc>"), address, F.lit(f"</loc><lastmod>{changed}</lastmod><priority>"), priority, F.lit("</priority></url>"))
    return ordered(apps).select("app_id", (F.floor((F.col("place") - 1) / per_file) + 1).cast("int").alias("part"), "place", entry.alias("entry"))


#: Heads and tails of the files.
URLS = ('<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">', "</urlset>")
MAPS = ('<?xml version="1.0" encoding="UTF-8"?>\n<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">', "</sitemapindex>")


def write_sitemaps(apps: DataFrame, folder: str, base_url: str, changed: str, per_file: int = 50_000) -> int:
    """Gzip files of at most per_file addresses below folder/part=N, the index and the robots file; returns the number of parts.

    A part is one file by its nature, so it is written by one task; parts are written side by side.
    """
    entries = stage(sitemap(apps, per_file, base_url, changed).select("part", "place", F.col("entry").alias("value")))
    parts = max(1, -(-entries.count() // per_file))
    numbers = apps.sparkSession.range(1, parts + 1).select(F.col("id").cast("int").alias("part"))
    ends = [numbers.select("part", F.lit(at).cast("long").alias("place"), F.lit(line).alias("value")) for at, line in ((0, URLS[0]), (2**62, URLS[1]))]
    lines = entries.select("part", F.col("place").cast("long").alias("place"), "value").unionByName(ends[0]).unionByName(ends[1])
    lines.repartitionByRange(parts, "part").sortWithinPartitions("part", "place").drop("place").write.mode("overwrite").partitionBy("part").option("compression", "gzip").text(f"{folder}/parts")
    refs = [f"  <sitemap><loc>{base_url}/sitemaps/sitemap-{n}.xml.gz</loc><lastmod>{changed}</lastmod></sitemap>" for n in range(1, parts + 1)]  # one line a file of per_file addresses
    robots = ["User-agent: *", "Allow: /c/", "Allow: /commands/", f"Sitemap: {base_url}/sitemaps/sitemap-index.xml"]
    for name, told in (("index", [MAPS[0], *refs, MAPS[1]]), ("robots", robots)):
        apps.sparkSession.createDataFrame([("\n".join(told),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{name}")
    return parts


def contract_presets(contracts: DataFrame, there: DataFrame, os: str, managers: list[str]) -> DataFrame:
    """contracts with the columns minimal, usage and full: a result as JSON, with few, some and all of its fields.

    contracts: app, name, path, node_type, description, risk, example_template, provenance, docker_image, script_url, source_url,
    confidence, install_instructions, os_aliases. there: binary, the lower-cased binaries found on the machine. Absent examples and install
    commands are null in the JSON, absent images and addresses are left out of it.
    """
    command = I.resolved(I.install_map(F.col("install_instructions")), F.lit(os), managers)
    binary = F.lower(I.binary_name(F.col("os_aliases"), "macos" if os == "macos" else "windows" if os == "windows" else "linux", F.col("name")))
    rows = contracts.withColumn("binary", binary).join(there.select("binary", F.lit(True).alias("found")).distinct(), "binary", "left")

    def told(*fields):
        return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})

    p, e, c = F.col("path").alias("cmd_path"), F.col("example_template"), F.col("confidence")
    always = told(
        F.col("app").alias("app_id"), "name", p, "node_type", "description", F.col("risk").alias("risk_level"), e, F.when(F.col("found"), "installed").otherwise("not_installed").alias("status"),
        command.alias("install_command"), F.coalesce(F.col("provenance") == "probe", F.lit(False)).alias("verified"))
    known = F.to_json(F.struct("docker_image", "script_url", "source_url", c))
    full = F.concat(F.substring(always, F.lit(1), F.length(always) - 1), F.lit(","), F.substring(known, F.lit(2), F.length(known)))
    return rows.withColumn("minimal", told(p, c)).withColumn("usage", told(p, e, c)).withColumn("full", full)


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """table, rows and an order-free checksum of the contents of each table: the sum of the first 48 bits of each row's MD5, modulo 2**63.

    A row's text is its columns in the order of their names, joined by the unit separator, null as the record separator; columns that are
    not text are cast.
    """
    out = None
    for name, df in tables.items():
        text = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in sorted(df.columns)))
        number = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")
        # A long holds the plain sum of some 65,000 rows only: it is summed as a decimal, exactly.
        total = F.coalesce(F.sum(F.col("h").cast("decimal(15,0)")), F.lit(0).cast("decimal(25,0)")) % F.lit(Decimal(2**63))
        one = df.select(number.alias("h")).agg(F.count("*").alias("rows"), total.cast("long").alias("checksum")).select(F.lit(name).alias("table"), "rows", "checksum")
        out = one if out is None else out.unionByName(one)
    return out


def snapshot(apps: DataFrame, arguments: DataFrame, folder: str) -> None:
    """A whole snapshot as JSON lines, one folder a table: the form for tables of any size."""
    for name, df in (("apps", apps), ("arguments", arguments)):
        df.write.mode("overwrite").option("ignoreNullFields", "true").json(f"{folder}/{name}")


def snapshot_document(apps: DataFrame, arguments: DataFrame) -> DataFrame:
    """The lines of one JSON document {apps: [...], arguments: [...]} as n, line, to be written in the order of n.

    No list is ever collected: every record is a line, numbered in two steps, with the commas and brackets that part them.
    """
    def lines(df, shift, head, tail):
        told = stage(df.select(F.to_json(F.struct(*df.columns)).alias("line")).withColumn("i", F.monotonically_increasing_id()))
        last = told.agg(F.max("i")).first()[0]
        body = told.select((F.col("i") + 1).alias("i"), F.when(F.col("i") < F.lit(last), F.concat("line", F.lit(","))).otherwise(F.col("line")).alias("line"))
        ends = df.sparkSession.createDataFrame([(0, head), (2**62 if last is None else last + 2, tail)], "i long, line string")
        return body.unionByName(ends).select(F.struct(F.lit(shift).alias("s"), "i").alias("n"), "line")

    return lines(apps, 0, '{"apps": [', "],").unionByName(lines(arguments, 1, '"arguments": [', "]}"))


def work_list(names: DataFrame, column: str, path: str) -> None:
    """A list of names as TOML array entries, one a line."""
    names.select(F.concat(F.lit('  "'), F.replace(F.col(column), F.lit('"'), F.lit('\\"')), F.lit('",'))).write.mode("overwrite").text(path)


def report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
