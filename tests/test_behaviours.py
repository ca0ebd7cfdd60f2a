"""Behaviours of the reference's operators on small tables of our own."""

import json
import pathlib
import random

import pytest
from conftest import SF, rows
from pyspark.sql import functions as F

from cinderlode.core import shared_folder, stage
from cinderlode.functions import helptext as H
from cinderlode.functions import installs as I
from cinderlode.functions import text as T
from cinderlode.operators import curate as C
from cinderlode.operators import enrich as X2
from cinderlode.operators import evaluate as E
from cinderlode.operators import export as X
from cinderlode.operators import intake as N
from cinderlode.operators import scan as A_
from cinderlode.operators import sync as S
from cinderlode.operators.cascade import Settings, search, with_skills
from cinderlode.operators.index import best_with_any, build_index, prefix_hits, ranked, shares, with_all
from cinderlode.operators.knn import knn, pack, unpack
from cinderlode.operators.scan import best_any, words_of
from cinderlode.plans import registry
from cinderlode.plans import search_queries as S_
from cinderlode.sources import catalogue as K
from cinderlode.sources import registries as R
from cinderlode.streaming.feed import apply_feed, live, windowed_counts


def one(spark, function, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(function(*(F.col(f"c{i}") for i in range(len(values))))).first()[0]


@pytest.mark.parametrize("given,want", [("gerp the Wenjian!", "grep the file!"), ("Makdir a-b", "mkdir a-b"), ("chmmod x", "chmod x"), ("Hello WORLD", "Hello WORLD"), ("", ""), ("read mail", "head tail")])
def test_robust(spark, given, want):
    assert one(spark, T.robust, given) == want


@pytest.mark.parametrize("given,want", [("docker compose up -d", "docker.compose.up"), ("docker_compose.logs_container x", "docker.compose.logs.x"), ("beep -r 3", "beep"), ("..a..b.", "a.b"), ("--x", "")])
def test_clean_path(spark, given, want):
    assert one(spark, T.clean_path, given) == want


@pytest.mark.parametrize("given,want", [("podman-images", "podman.image"), ("Podman-image.prune", "podman.image.prune"), ("podman-compose.ups", "podman-compose.ups"), ("git.tags", "git.tag"), ("a.gas.bus", "a.gas.bus"), ("x-system", "x.system")])
def test_canonical_path(spark, given, want):
    assert one(spark, T.canonical_path, given) == want


def test_path_score_and_noise(spark):
    def score(path, text):
        return one(spark, lambda p, q: T.path_score(p, T.path_expansion(T.content_tokens(q))), path, text)

    assert score("aws.ec2.create-vpc", "create a vpc on aws") == 5 and score("aws.apigw.create-vpc-link", "create a vpc on aws") == 4
    assert score("git", "git") == 0 and score("podman.image.prune", "clear unused images") == 6
    assert one(spark, T.is_noise, "git.help") and one(spark, T.is_noise, "x.completion.show") and not one(spark, T.is_noise, "help")


@pytest.mark.parametrize("path,example,fault", [("git.commit", "sudo git commit -m x", None), ("git.commit", "git push", "subcommand"), ("podman-images", "podman images", "binary"), ("git", "git push", None), ("a.b", "./a b c", "subcommand"), ("a.b", "a b | c", None), ("a.b", " ", None)])
def test_example_fault(spark, path, example, fault):
    assert one(spark, T.example_fault, path, example) == fault


def test_risk_and_topics(spark):
    assert one(spark, T.risk, "x.delete", "gone", None) == "dangerous" and one(spark, T.risk, "x.y", "an offset", "safe") == "medium" and one(spark, T.risk, "x", "list", "") == "safe" and one(spark, T.risk, "x.rm", "rm it", "medium") == "medium"
    assert one(spark, lambda t: T.topic_list(t), "B, a b,,C,\nb") == ["b", "a b", "c"] and one(spark, lambda t: T.topic_list(t), "machine learning, cloud") == ["machine learning", "cloud"]
    assert one(spark, lambda t: T.topic_words(t), " b  a b\tc ") == ["b", "a", "b", "c"]
    assert one(spark, lambda p, d: T.embed_text(p, d, F.lit(None).cast("string")), "git.show_ref-x", "Shows.") == "git show_ref x. Shows."
    assert [one(spark, T.index_name, a, n) for a, n in (("org.arch.nb-cli", "nb"), ("org.arch.nb", "nb"), ("org.arch.NB", "nb"), ("plain", "nb"), ("x.y", None))] == ["nb nb-cli", "nb", "nb NB", "nb", "x.y"]


def test_installs(spark):
    def res(js, os):
        return one(spark, lambda m: I.resolved(I.install_map(m), F.lit(os), ["npm"]), js)

    assert res('{"apt": "restic", "brew": "brew install restic"}', "ubuntu") == "sudo apt install restic"
    assert res('{"paru": "x"}', "arch") == "paru -S x" and res('{"yay": "x"}', "debian") is None and res('{"pip": "p"}', "fedora") == "pip install p" and res("{broken", "arch") is None
    assert one(spark, I.stripped, '{"a": "", "b": null, "c": "x"}') == '{"c":"x"}' and one(spark, I.stripped, '{"a": " "}') is None and one(spark, I.stripped, "{bad") == "{bad"
    assert [one(spark, I.name_score, p, "rg") for p in ("RG", "rg-", "xrg", "rg-dev", "zzz")] == [100, 80, 60, 10, 30]
    assert [one(spark, I.manager_of, r) for r in ("Debian_12", "archlinux", "nixpkgs", "weird")] == ["apt", "pacman", "nix-env", None]
    assert one(spark, R.app_id_for, "npm", "@scope/na me[extra]") == "com.npmjs.scope-na-me"


def test_curation(spark):
    args = spark.createDataFrame(
        [(1, "tool", "small", "inferred", None)] + [(10 + i, f"tool.sub{i}", "big", "inferred", "t") for i in range(25)] + [(50, "podman.images", "p1", "inferred", "a, b"), (51, "podman-image", "p2", "probe", "b c"), (52, "solo", "p3", None, "keep  me")],
        "row_id int, cmd_path string, app_id string, provenance string, topics string")
    apps = spark.createDataFrame([("small", "Tool", 1, 0.0), ("big", "tool", 2, 0.0), ("p1", "podman", 3, 0.9), ("p2", "podman", 4, 0.1), ("p3", "solo", 5, None)], "app_id string, name string, ord int, pop double")
    moved = C.reanchored(args, apps)
    assert moved.where("row_id = 1").first()["app_id"] == "big" and moved.where("app_id <> 'big'").count() == 3
    assert C.reanchored(args.where("row_id < 15"), apps).where("row_id = 1").first()["app_id"] == "small"
    got = {r["canon"]: r for r in C.canonical(args, apps).collect()}
    assert got["podman.image"]["cmd_path"] == "podman-image" and got["podman.image"]["topics"] == "b c a" and got["podman.image"]["merged"] == 2 and got["solo"]["topics"] == "keep  me"


def test_overrides_sweep_twins_donors_libraries(spark):
    args = spark.createDataFrame([("docker.buildx", "real", "probe"), ("docker.buildx.ls", "real", "probe"), ("docker-buildx.x", "fake", "inferred"), ("docker-odd", "fake2", "inferred"), ("run", "broken", "inferred"), ("stop", "broken", "inferred"), ("tool.run", "good", "probe"), ("tool.stop", "good", "probe")], "cmd_path string, app_id string, provenance string")
    apps = spark.createDataFrame([("real", "docker", "x"), ("fake", "db", " "), ("fake2", "dd", None), ("broken", "tool", None), ("good", "Tool", '{"a":"b"}'), ("org.archlinux.python-x", "db", "y"), ("org.archlinux.aur.libfoo", "foo", None), ("libreoffice", "libreoffice", None)], "app_id string, name string, install_instructions string")
    assert [r["app_id"] for r in C.fabrications(args, apps, []).collect()] == ["fake"] and C.fabrications(args, apps, ["fa"]).count() == 0
    assert rows(C.broken_prefix_twins(args, apps)) == [("broken", "good")]
    assert {r["app_id"] for r in C.libraries(apps, "org.archlinux.aur.").collect()} == {"org.archlinux.python-x", "org.archlinux.aur.libfoo"}
    full = spark.createDataFrame([("a", "old", "t", None), ("b", None, None, "e")], "cmd_path string, description string, topics string, example_template string")
    patch = spark.createDataFrame([("a", "new", None, "more", None)], "cmd_path string, description string, topics string, topics_append string, example_template string")
    assert rows(C.overridden(full, patch)) == [("a", "new", "t more", None), ("b", None, None, "e")]


def test_index_phrases_and_pruned_search(spark):
    docs = spark.createDataFrame([("a", "", "foo bar baz"), ("b", "", "bar foo"), ("c", "foo", "barn"), ("d", "foo bars", "foo bark"), ("e", None, None)], "doc string, n string, t string")
    index = build_index(docs, "doc", "n", "t")
    hits = prefix_hits(index, spark.createDataFrame([("foo_bar",), ("foo",), ("zzz_a",)], "prefix string"))
    assert {(r["prefix"], r["doc"], r["in_name"], r["in_text"]) for r in hits.collect()} == {("foo_bar", "a", 0, 1), ("foo_bar", "d", 1, 1), ("foo", "a", 0, 1), ("foo", "b", 0, 1), ("foo", "c", 1, 0), ("foo", "d", 1, 1)}
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    many = spark.createDataFrame([(f"d{i:03}", rnd.choice(words), " ".join(words[min(29, int(rnd.expovariate(0.2)))] for _ in range(rnd.randrange(12)))) for i in range(300)], "doc string, n string, t string")
    index = build_index(many, "doc", "n", "t")
    asked = spark.createDataFrame([(q, w) for q in range(12) for w in set(rnd.sample(words, 4))], "qid int, prefix string")
    parts = shares(index, asked, score=(5.0, 2.0))
    plain = asked.join(parts, "prefix").groupBy("qid", "doc").agg(F.round(F.sum("score"), 6).alias("score"), F.count("*").alias("n"))
    want = {(r["qid"], r["doc"]): r["score"] for r in ranked(plain, ["score", "doc"], 5).collect()}
    assert {(r["qid"], r["doc"]): r["score"] for r in ranked(best_with_any(parts, asked, 5, "score"), ["score", "doc"], 5).collect()} == pytest.approx(want)
    need = {q: n for q, n in rows(asked.groupBy("qid").count())}
    whole = {(r["qid"], r["doc"]) for r in plain.collect() if r["n"] == need[r["qid"]]}
    assert {(r["qid"], r["doc"]) for r in with_all(parts, asked).collect()} == whole


def test_skills_follow_search_results(spark):
    found = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "s2")], "qid int, pos int, doc string")
    asked = spark.createDataFrame([(1, "Pack files"), (2, "open"), (3, "")], "qid int, text string")
    skills = spark.createDataFrame([("s1", "Pack", "all FILES"), ("s2", "open", None), ("s1", "Pack", "all FILES"), (None, "x", "pack files")], "path string, name string, description string")
    assert rows(with_skills(found, asked, skills, 3).select("qid", "pos", "doc", "source")) == [(1, 1, "a", "search"), (1, 2, "b", "search"), (1, 3, "s1", "skill"), (2, 1, "s2", "search"), (3, 1, "s1", "skill"), (3, 2, "s2", "skill")]
    assert with_skills(found, asked, skills.limit(0), 3, block=1).count() == 3


CASES = [("root", "jq", "sub"), ("git.log", "git", "sub"), ("git.commit", "git", "sub")]


@pytest.fixture(scope="module")
def tiny(spark):
    commands = spark.createDataFrame(
        [("jq", "jq", "jq", "root", "safe", "probe", "jq", "Process json data"), ("git", "git", "git", "root", "safe", "probe", "git", "Version control"), ("git.log", "git", "git.log", "sub", "safe", "inferred", "git log", "Show the commit history"),
         ("git.commit", "git", "git.commit", "sub", "safe", "probe", "git commit", "Record changes"), ("gitk", "gitk", "gitk", "root", "safe", "inferred", "gitk", "Browse commits of a repository"), ("tar", "tar", "tar", "root", "safe", None, "tar", "Pack archives")],
        "doc string, app string, path string, node_type string, risk string, provenance string, name_text string, cap_text string")
    apps = spark.createDataFrame([("jq", "jq", 0.5), ("git", "git", 1.0), ("gitk", "gitk", 0.1), ("tar", "tar", None)], "app string, name string, pop double")
    vectors = spark.createDataFrame([(d, [float(i == j) for j in range(6)]) for i, d in enumerate(["jq", "git", "git.log", "git.commit", "gitk", "tar"])], "doc string, embedding array<float>")
    return commands, apps, vectors, build_index(commands, "doc", "name_text", "cap_text")


def ask(spark, tiny, cases, **kw):
    """One search for all cases (text, vec): the documents of each and the confidence labels."""
    q = spark.createDataFrame([(i, t, v) for i, (t, v) in enumerate(cases)], "qid int, text string, vec array<float>")
    found = search(q, *tiny[:3], tiny[3], Settings(dims=6, **kw)).orderBy("qid", "pos").collect()
    return [[r["doc"] for r in found if r["qid"] == i] for i in range(len(cases))], [{r["confidence"] for r in found if r["qid"] == i} for i in range(len(cases))]


def test_cascade(spark, tiny):
    to, away = [0.0, 0.0, 0.0, 0.0, 0.0, 1.0], [0.0, 0.0, 0.0, 0.0, 0.0, -1.0]
    docs, labels = ask(spark, tiny, [("GIT", None), ("commit history", None), ("json zebra", None), ("nothing matches", to), ("nothing matches", away), ("to the of", None), ("git commit history changes", None)], limit=30)
    assert docs[0][0] == "git"  # an exact name goes first
    assert docs[1][0] == "git.log"  # all words
    assert "jq" in docs[2]  # any word
    assert "tar" in docs[3] and labels[3] == {"high"}  # verified and popular tools may still go before it
    assert labels[4] == {"none"} and docs[5] == [] and labels[0] == {"high"}
    assert sum(d.startswith("git.") or d == "git" for d in docs[6]) <= 3
    docs, _ = ask(spark, tiny, [("nothing matches", away), ("git", None)], limit=2, drop_out_of_domain=True)
    assert docs[0] == [] and len(docs[1]) == 2


def test_knn_codec_and_bad_vectors(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", None), ("d", [float("nan"), 1.0]), ("e", [1.0])], "doc string, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "qid int, vec array<float>")
    assert [(r["doc"], r["pos"]) for r in knn(q, v, 3, 2).orderBy("pos").collect()] == [("a", 1), ("e", 2), ("b", 3)]
    assert [r["embedding"] for r in unpack(pack(v.where("doc <> 'd'"), "embedding"), "embedding").orderBy("doc").collect()] == [[1.0, 0.0], [0.0, 1.0], None, [1.0]]
    assert knn(q.limit(0), v, 3, 2).count() == 0 and knn(q, v.limit(0), 3, 2).count() == 0


def test_help_texts():
    page = "usage: tool [options]\n\nTool keeps your notes in order.\nIt is small.\n\nCommands:\n  add, a     Add a note\n             to the list\n  rm         Remove a note\nOptions:\n  --x        y\n"
    assert H.first_paragraph(page) == "Tool keeps your notes in order. It is small."
    assert H.described(page).startswith("Tool keeps") and H.described("NAME\n\nDESCRIPTION\n   Keeps all notes.\n\nOPTIONS\n") == "Keeps all notes."
    assert H.described("tool v1.2.3\nCopyright 2020 x\n--flag a\n") == "" and H.described(None) == "" and H.described("Segmentation fault (core dumped)") == ""
    assert H.subcommands(page) == [("add", "Add a note"), ("rm", "Remove a note")]
    assert H.subcommands("Subgroups:\n    blob : Manage blobs.\n    disk [Preview] : Disks.\n\nCommands:\n    list : List.\n") == [("blob", "Manage blobs."), ("disk", None), ("list", "List.")]
    assert H.subcommands("COMMANDS\n  w d1 create <name>  Make one\n  w d1 list  All\n", ["w", "d1"]) == [("create", "Make one"), ("list", "All")]
    assert H.subcommands("All commands:\n    access, adduser, audit,\n    ci\n") == [("access", None), ("adduser", None), ("audit", None), ("ci", None)]
    assert H.subcommands("") == [] and H.subcommands("<Commands>\n  a : Add\n<Switches>\n  -x : y\n") == [("a", "Add")]


def test_help_readings():
    assert H.described("Commands are run in parallel over many hosts.\nwarning: this is old\nIt waits for all.") == "Commands are run in parallel over many hosts. It waits for all."
    assert H.described("Flag shorthand -h has been deprecated, use --help\nUsage:\n  look [options] <string>\n\nDisplay lines beginning with a string.\n") == "Display lines beginning with a string."
    assert H.described("Process JSON data with filters [version 1.8.1]\n") == "Process JSON data with filters" and H.described("-a --all  everything\n  b c") == ""
    assert H.described("short one") == "" and H.described("x [a] [b] -c <d> word") == ""
    assert H.own_line("az storage : Manage storage.\n", "az storage") == "Manage storage."
    assert H.own_line("tool d1 create <name> [x]\n\nCOMMANDS & MORE\n--flag\nMake one", "tool d1 create") == "Make one" and H.own_line(None, "x") == H.NO_DESCRIPTION and H.own_line("x\n-a", "x") == H.NO_DESCRIPTION


def test_page_predicates_and_probe_risk(spark):
    long = "An ordinary help page that tells what the tool does and how it is called, in more than eighty letters."
    pages = [long, "[error] " + long, long + " unrecognized arguments: x", "x: error while loading " + long, "short", None, "a page of more than thirty letters, less than 80"]
    df = spark.createDataFrame([(p,) for p in pages], "t string")
    assert [tuple(r) for r in df.select(H.is_error_page(F.col("t")), H.is_error_page(F.col("t"), False)).collect()] == [(False, False), (True, False), (True, False), (False, True), (True, True), (True, True), (False, True)]
    assert [one(spark, H.path_risk, p) for p in ("x.remove", "x.add", "x.show", "x.form")] == ["dangerous", "medium", "safe", "dangerous"]  # parts of words count
    assert one(spark, H.is_alias_page, "a", "a") and not one(spark, H.is_alias_page, "a", None) and one(spark, H.is_unknown_page, "Unknown help topic x") and not one(spark, H.is_unknown_page, None)
    assert one(spark, H.picked_description, "tool\nMakes it", "tool", None) == "Makes it" and one(spark, H.picked_description, "tool\nMakes it", "tool", "listed") == "listed"


def test_declared_tables(spark, tmp_path):
    K.create(spark, str(tmp_path))
    assert rows(K.missing_tables(spark, str(tmp_path))) == []
    spark.createDataFrame([("a", "A")], "app_id string, title string").write.mode("overwrite").parquet(str(tmp_path / "apps.parquet"))
    assert rows(K.missing_tables(spark, str(tmp_path))) == [("apps", "lacks name")] and ("meta", "absent") in rows(K.missing_tables(spark, str(tmp_path / "none")))
    old = spark.createDataFrame([("p", "a", "more")], "cmd_path string, app_id string, more string")
    assert K.conformed(old, "arguments").select("cmd_path", "provenance", "topics").first() == ("p", "inferred", None)
    (tmp_path / "targets.json").write_text('{"targets": [{"name": "x", "path": "/bin/x"}]}')
    assert rows(K.probe_targets(spark, str(tmp_path / "targets.json"))) == [("x", "/bin/x")] and K.probe_targets(spark, None).count() == 3


def test_artefact_and_its_integrity(spark, tmp_path):
    parts = {"deleted": spark.createDataFrame([("a",)], "app_id string"), "apps": spark.createDataFrame([("b", 1.0)], "app_id string, popularity double")}
    told = S.write_artefact(parts, str(tmp_path / "d"), 7)
    assert told.count() >= 2 and rows(S.damaged(spark, str(tmp_path / "d"), 7, list(parts))) == []
    victim = next((tmp_path / "d" / "v7" / "apps").glob("part-*"))
    victim.write_bytes(victim.read_bytes() + b"x")
    (victim.parent / f".{victim.name}.crc").unlink(missing_ok=True)
    assert {r["state"] for r in S.damaged(spark, str(tmp_path / "d"), 7, list(parts)).collect()} == {"changed"}


def test_sitemap_files_and_settings(spark, tmp_path):
    apps = spark.createDataFrame([(f"a{i}", None if i == 3 else i / 10) for i in range(7)], "app_id string, popularity double")
    assert X.write_sitemaps(apps, str(tmp_path / "s"), "https://x.example", "2025-01-01", 3) == 3
    first = [r[0] for r in spark.read.text(str(tmp_path / "s" / "parts" / "part=1")).collect()]
    assert [line[:5] for line in first] == ["<?xml", "<urls", "  <ur", "  <ur", "  <ur", "</url"] and "/c/a6</loc>" in first[2] and "<priority>0.6" in first[2]
    assert "sitemap-3.xml.gz" in "".join(r[0] for r in spark.read.text(str(tmp_path / "s" / "index")).collect()) and spark.read.text(str(tmp_path / "s" / "robots")).count() == 4
    flat = spark.createDataFrame([(f"b{i:04}", 0.5) for i in range(500)], "app_id string, popularity double")
    assert [r["place"] for r in X.ordered(flat).orderBy("app_id").collect()] == list(range(1, 501))
    spark.conf.set("cinderlode.search.verified_bonus", "3")
    spark.conf.set("cinderlode.search.drop_out_of_domain", "true")
    told = Settings.of(spark, limit=7)
    spark.conf.unset("cinderlode.search.verified_bonus"), spark.conf.unset("cinderlode.search.drop_out_of_domain")
    assert (told.verified_bonus, told.drop_out_of_domain, told.limit, told.danger) == (3, True, 7, 0.75)


def test_snapshot_as_one_document(spark):
    apps = spark.createDataFrame([("a", "A"), ("b", None)], "app_id string, name string")
    told = X.snapshot_document(apps, spark.createDataFrame([("a.x", "a")], "cmd_path string, app_id string").limit(1)).orderBy("n").collect()
    assert json.loads("\n".join(r["line"] for r in told)) == {"apps": [{"app_id": "a", "name": "A"}, {"app_id": "b"}], "arguments": [{"cmd_path": "a.x", "app_id": "a"}]}
    empty = X.snapshot_document(apps.limit(0), apps.limit(0)).orderBy("n").collect()
    assert json.loads("\n".join(r["line"] for r in empty)) == {"apps": [], "arguments": []}


def test_repairs_and_reclassification(spark):
    rows_ = spark.createDataFrame([("git.push", "d", "git pull", "inferred"), ("git.log", "d", "git log", None), ("git", "d", "hg x", "probe"), ("hg.up", "d", "git up", "inferred")], "cmd_path string, description string, example_template string, provenance string")
    fixed = C.examples_repaired(rows_, lambda p, d, e: F.when(p == "git.push", F.lit("git push")).when(p == "hg.up", F.lit("svn up")))
    assert [r["example_template"] for r in fixed.orderBy("cmd_path").collect()] == ["hg x", "git log", "git push", "git up"]
    kept = C.without_apps(rows_.withColumn("app_id", F.col("cmd_path")), rows_.select(F.col("cmd_path").alias("app_id")), spark.createDataFrame([("git",)], "app_id string"))
    assert [k.count() for k in kept] == [3, 3]

    def made(js, official, users):
        return one(spark, lambda m: F.to_json(I.reclassified(I.install_map(m), I.package_of(I.install_map(m)["pacman"]), F.lit(official), F.lit(users))), js)

    js = '{"pacman": "fd", "apt": "apt install fd"}'
    assert made(js, True, True) == '{"apt":"apt install fd","pacman":"pacman -S fd"}' and made(js, False, True) == '{"apt":"apt install fd","paru":"paru -S fd","yay":"yay -S fd"}'
    assert made(js, False, False) == '{"apt":"apt install fd"}' and made('{"apt": "x"}', True, True) == '{"apt":"x"}'


def test_vectors_in_differences(spark):
    apps = spark.createDataFrame([("a", "A"), ("b", "B")], "app_id string, name string")
    g = spark.createDataFrame([("a.x", "a"), ("b.x", "b")], "cmd_path string, app_id string")
    v1, v2 = (spark.createDataFrame(x, "cmd_path string, embedding array<float>") for x in ([("a.x", [1.0, 0.0]), ("b.x", [0.0, 1.0])], [("a.x", [1.0, 0.0]), ("b.x", [0.5, 1.0])]))
    changes = S.difference(*(S.fingerprints(apps, g, ["name"], ["cmd_path"], v) for v in (v1, v2)))
    assert rows(changes) == [("b", "changed")]
    fresh = S.payload(changes, apps, g, v2)
    assert {r["cmd_path"]: r["embedding"] for r in S.vectors_applied(v1, g, fresh["vectors"], changes, 2).collect()} == {"a.x": [1.0, 0.0], "b.x": [0.5, 1.0]}
    assert {r["cmd_path"] for r in S.vectors_applied(v1, g, fresh["vectors"], changes, 3).collect()} == {"a.x"}
    assert not S.reusable(spark.createDataFrame([("p", "t")], "cmd_path string, text string"), spark.createDataFrame([("p", "t")], "cmd_path string, text string"), "new", "old").first()["reuse"]


def test_registry_import_donors_and_probes(spark):
    have = spark.createDataFrame([("old",)], "cmd_path string")
    new = spark.createDataFrame([("fd", "fd", "finds", 1), ("fd-bin", "fd-bin", "finds all", 2), ("old", "old", "x", 3), ("jq-bin", "jq-bin", "", 4), ("jq", "jq", "json data", 5), ("cov", "cov", "covered", 6), ("fd", "fd", "again", 7), (None, "n", "null", 8)], "cmd_path string, name string, description string, n int")
    got = C.registry_import(have, new, spark.createDataFrame([("cov",), (None,)], "name string"), "n")
    assert rows(got) == [("fd", "fd", "finds", 1), ("jq", "jq", "json data", 5), ("jq-bin", "jq-bin", "jq-bin — command-line tool", 4)]
    apps = spark.createDataFrame([("com.github.x", "x", None), ("org.tldr.x", "x", '{"a":"tldr"}'), ("org.archlinux.x", "x", '{"a":"arch"}'), ("com.other.x", "x", "{}"), ("com.gitlab.y", "y", "")], "app_id string, name string, install_instructions string")
    assert {r["app_id"]: r["donor"] for r in C.donors(apps).collect() if r["donor"]} == {"com.github.x": "org.archlinux.x"}
    tries = spark.createDataFrame([("a", 1, "failed"), ("a", 2, "merged"), ("b", 1, "failed"), ("b", 2, "failed"), ("b", 3, "merged"), ("c", 1, "failed"), ("d", 1, "no-subcommands"), ("d", 2, "failed"), (None, 1, "x")], "tool string, at int, outcome string")
    assert rows(N.probe_states(tries)) == [("a", 2, "merged", True), ("b", 2, "perma-failed", True), ("c", 1, "failed", False), ("d", 1, "no-subcommands", True)]
    dump = spark.createDataFrame([("debian_12", "fd-find", "fd-find", None, 1), ("gentoo", "fd-find", "fd", "sys-apps/fd", 2), ("debian_13", "fd-find", "other", None, 0), ("odd", "fd-find", "z", None, 3)], "repo string, effname string, binname string, srcname string, n int")
    some = spark.createDataFrame([("i", "fd", '{"cargo": "cargo install fd-find", "brew": null}'), ("j", "none", None)], "app_id string, name string, install_instructions string")
    assert rows(X2.dump_installs(some, dump, "n")) == [("i", '{"apt":"apt install other","cargo":"cargo install fd-find","emerge":"emerge sys-apps/fd"}')]
    names = spark.createDataFrame([("a", "fd-find"), ("a", "fd-find"), ("b", "fd"), ("c", "fd"), (None, "fd")], "repo string, name string")
    assert [r["app_id"] for r in X2.dump_popularity(some, names, 100).where("round(popularity, 4) = round(ln(3) / ln(101), 4)").collect()] == ["i"]


def test_help_columns_and_table_function(spark):
    df = spark.createDataFrame([(1, "Commands:\n  a   One\n"), (2, None)], "id int, text string")
    assert df.select(F.size(H.subcommands_of("text", F.array().cast("array<string>")))).collect()[0][0] == 1
    spark.udtf.register("help_subcommands", H.Subcommands)
    df.createOrReplaceTempView("help_pages")
    assert rows(spark.sql("select p.id, s.* from help_pages p, lateral help_subcommands(p.text, array()) s")) == [(1, "a", "One")]
    assert one(spark, H.os_of_release, 'NAME=x\nID="mint"\nID_LIKE="ubuntu debian"\n') == "ubuntu" and one(spark, H.os_of_release, "ID=arch\n") == "arch" and one(spark, H.os_of_release, "ID=odd\n") is None


def test_sources(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    aur = put("aur.json", json.dumps([{"Name": "fd", "Description": " find ", "URL": None}, {"Name": "libfoo"}, {"Name": "libtree"}, {"Name": "x-git"}]))
    assert {r["name"]: r["description"] for r in R.aur(spark, aur).collect()} == {"fd": "find", "libtree": "libtree (AUR package)"}
    npm = put("npm.json", "\n".join(json.dumps(x) for x in [{"name": "@s/cli", "bin": {"c": "x"}, "repository": {"url": "git+https://h/x.git"}}, {"name": "lib", "description": "d"}, {"name": "@s/cli", "bin": {"c": "x"}}]))
    got = R.npm(spark, npm).collect()
    assert len(got) == 1 and got[0]["app_id"] == "com.npmjs.s-cli" and got[0]["name"] == "cli"
    pypi = put("pypi.json", "\n".join(json.dumps(x) for x in [{"info": {"name": "a", "classifiers": ["Environment :: Console"], "project_urls": {"Homepage": "h", "Code": "c"}}}, {"info": {"name": "b", "classifiers": []}}]))
    assert [(r["app_id"], r["source_url"]) for r in R.pypi(spark, pypi).collect()] == [("org.pypi.a", "c")]
    crates = put("crates.json", json.dumps({"crates": [{"id": "rg", "description": "grep", "homepage": "h"}]}))
    assert R.crates(spark, crates).first()["install_instructions"] == {"cargo": "cargo install rg"}
    dump = put("dump.sql", "SET x;\nCOPY public.packages (repo, effname, binname, srcname, binnames) FROM stdin;\narch\tFD\tfd\t\\N\t{fd,fdfind}\ndebian\tfd\t\\N\tfd-find\t\\N\n\\.\nCOPY public.problems (a, b, c, d, e) FROM stdin;\nx\ty\tz\tu\tv\n\\.\n")
    names = R.package_names(R.copy_dump(spark, dump))
    assert rows(names) == [("arch", "fd"), ("arch", "fdfind"), ("debian", "fd"), ("debian", "fd-find")]
    put("pages/cli_git.json", json.dumps([{"cmd_path": "git", "path": ["git"], "text": "t"}]))
    put("pages/pip_black.json", json.dumps([{"cmd_path": "black", "path": [], "text": "u"}]))
    assert rows(R.probe_pages(spark, str(tmp_path / "pages")).select("cmd_path", "tool", "source", "package")) == [("black", None, "pip", "black"), ("git", "git", None, None)]
    lines = put("cache.jsonl", '{"a": 1}\n{"a": 2\n{"a": 3}')
    assert rows(R.json_lines(spark, lines, "a int")) == [(1,), (3,)]
    put("skills/x/one.json", json.dumps({"cmd_path": "p", "name": "Pack files", "description": "d"}))
    put("skills/two.json", json.dumps([{"cmd_path": "q", "name": "Open", "description": "files too"}]))
    put("skills/bad.json", "{nope")
    skills = R.skills(spark, str(tmp_path / "skills"), "cmd_path string, name string, description string").where("cmd_path is not null")
    assert R.skill_matches(skills, "FILES pack").count() == 1 and R.skill_matches(skills, "").count() == 2
    export = put("export.json", json.dumps({"apps": [{"app_id": "a", "name": "A"}], "arguments": [{"cmd_path": "a", "app_id": "a"}, {"cmd_path": "a", "app_id": "a"}]}))
    apps, arguments = R.snapshot_json(spark, export, "app_id string, name string", "cmd_path string, app_id string")
    assert apps.count() == 1 and arguments.count() == 2 and R.bootstrap(None, apps).count() == 1


def test_sync_round_trip_and_versions(spark, tmp_path):
    a1, a2 = (spark.createDataFrame(x, "app_id string, name string") for x in ([("a", "A"), ("b", "B"), ("c", "C")], [("a", "A"), ("b", "B2"), ("d", "D")]))
    g1, g2 = (spark.createDataFrame(x, "cmd_path string, app_id string, description string") for x in ([("a", "a", "1"), ("a.x", "a", "2"), ("b", "b", None), ("c", "c", "3")], [("a", "a", "1"), ("b", "b", None), ("d", "d", "4")]))
    prints = [S.fingerprints(a, g, ["name"], ["cmd_path", "description"]) for a, g in ((a1, g1), (a2, g2))]
    changes = S.difference(*prints)
    assert rows(changes) == [("a", "changed"), ("b", "changed"), ("c", "deleted"), ("d", "added")]
    assert S.difference(prints[0], prints[0]).count() == 0
    assert S.unequal(S.applied(g1, S.payload(changes, a2, g2)["arguments"], changes), g2).count() == 0
    t = S.VersionedTable(spark, str(tmp_path / "t"))
    assert t.version() == 0 and t.write(g1, 1) and not t.write(g2, 1) and t.read().count() == 4 and t.write(g2, 2) and t.read().count() == 3


def test_stream_applies_each_change_once(spark, tmp_path):
    first = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, v string, ts int")
    first.coalesce(1).write.parquet(str(tmp_path / "in"))

    def run():
        apply_feed(spark, str(tmp_path / "in"), first.schema, str(tmp_path / "t"), str(tmp_path / "c"), "id", ["ts"], "v = 'gone'").awaitTermination()
        return rows(live(spark, str(tmp_path / "t")))

    assert run() == [(1, "a", 1), (2, "b", 1)] and run() == [(1, "a", 1), (2, "b", 1)]
    spark.createDataFrame([(1, "late", 0), (2, "gone", 5), (3, "c", 2), (3, "d", 3)], "id int, v string, ts int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    reader = S.VersionedTable(spark, str(tmp_path / "t")).read()
    assert run() == [(1, "a", 1), (3, "d", 3)]
    assert reader.count() == 2  # what was read before the swap is still whole
    spark.createDataFrame([(2, "older", 3), (3, "same", 3)], "id int, v string, ts int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert run() == [(1, "a", 1), (3, "same", 3)]  # the deletion holds against a late, older change; of equal times the later delivery counts


def test_verdicts_and_quantiles(spark):
    cases = spark.createDataFrame([(1, "a.b"), (2, "a.b"), (3, "a.b"), (4, "z")], "qid int, target string")
    results = spark.createDataFrame([(1, 1, "a.b", True), (2, 1, "a.c", True), (2, 7, "a.b", True), (3, 1, "q", False)], "qid int, pos int, doc string, verified boolean")
    got = {r["qid"]: (r["status"], r["category"]) for r in E.verdicts(cases, results).collect()}
    assert got == {1: ("pass", None), 2: ("near_miss", "sibling_misorder"), 3: ("fail", "canonical_burial"), 4: ("fail", "not_found")}
    q = E.quantiles(spark.createDataFrame([("g", float(v)) for v in (5, 1, 2, 2, 9, 9)], "g string, v double"), "v", "g").first()
    assert (q["n"], q["least"], q["p25"], q["median"], q["p90"], q["most"]) == (6, 1.0, 2.0, 3.5, 9.0, 9.0)


def test_windowed_counts_on_a_batch(spark):
    e = spark.read.parquet(f"{SF}/events.parquet")
    assert windowed_counts(e, "ts", "event_type").agg(F.sum("n")).first()[0] == e.count()


def test_registry_is_whole():
    assert set(registry.ORACLE) <= set(registry.QUERIES) and len(registry.QUERIES) > 70


def test_manifest_sums_beyond_a_long(spark):
    import hashlib

    told = X.manifest({"many": spark.range(140_000).select(F.col("id").cast("string").alias("k")), "none": spark.range(0).select(F.col("id").cast("string").alias("k"))})
    total = sum(int(hashlib.md5(str(i).encode()).hexdigest()[:12], 16) for i in range(140_000))
    assert total > 2**63 and dict(told.dtypes)["checksum"] == "bigint"
    assert rows(told) == [("many", 140_000, total % 2**63), ("none", 0, 0)]


def test_any_word_search_keeps_pairs_in_its_tasks(spark):
    """Exact beside the joined shares, for phrases and ties too; of a word that all documents hold, no task hands on more than the best."""
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(30)] + ["all", "w1x", "é"]
    texts = [(f"d{i:03}", rnd.choice(words), "all " + " ".join(words[min(32, int(rnd.expovariate(0.2)))] for _ in range(rnd.randrange(9)))) for i in range(400)]
    docs = spark.createDataFrame([*texts, ("e", None, None)], "doc string, n string, t string").repartition(6)
    asked = spark.createDataFrame([(q, w) for q in range(40) for w in {*rnd.sample(words, 3), "all", *(("w1_w", "w2_w3_w", "none") if q % 3 == 0 else ())}] + [(q, w) for q in (98, 99) for w in ("all", "w1")] + [(100, "none")], "qid int, prefix string")
    index = build_index(docs, "doc", "n", "t")
    plain = asked.join(shares(index, asked, score=(5.0, 2.0)), "prefix").groupBy("qid", "doc").agg(F.round(F.sum("score"), 6).alias("score"))
    want = rows(ranked(plain, ["score", "doc"], 7).select("qid", "doc", "score", "pos"))
    for held, task_docs in ((5000, 1000), (9, 100)):
        found = best_any(words_of(index.words), asked, 7, 5.0, 2.0, held, task_docs)
        assert [r[:2] + r[3:] for r in rows(found)] == [r[:2] + r[3:] for r in want] and [r[2] for r in rows(found)] == pytest.approx([r[2] for r in want])
    before = {p.name for p in pathlib.Path(shared_folder(spark).removeprefix("file://")).iterdir()}
    registry.QUERIES["bm25_or_topk"](spark, SF).count()
    new = [p for p in pathlib.Path(shared_folder(spark).removeprefix("file://")).iterdir() if p.name not in before]
    assert new and all({"prefix", "doc"} - set(spark.read.parquet(f"file://{p}").columns) for p in new)
    assert best_any(words_of(index.words.limit(0)), asked, 7, 5.0, 2.0).count() == 0 and best_any(words_of(index.words), asked.limit(0), 7, 5.0, 2.0).count() == 0


@pytest.mark.parametrize("name", ["failure_report", "verdict_counts", "coverage_verdicts", "override_suggestions", "recall_mrr"])
def test_evaluations_store_no_pairs_of_words_and_documents(spark, name):
    folder = pathlib.Path(shared_folder(spark).removeprefix("file://"))
    before = {p.name for p in folder.iterdir()} if folder.exists() else set()
    registry.QUERIES[name](spark, SF).count()
    new = [p for p in folder.iterdir() if p.name not in before]
    assert new and all({"prefix", "doc"} - set(spark.read.parquet(f"file://{p}").columns) for p in new)


def test_nearest_hand_on_few_rows(spark):
    """However many files the vectors come in, no more tasks than cores hand on the nearest of each query."""
    vectors = spark.createDataFrame([(f"d{i:04}", [float(i % 7), float(i)]) for i in range(900)], "doc string, embedding array<float>").repartition(40)
    found = knn(vectors.limit(20).select(F.xxhash64("doc").alias("qid"), F.col("embedding").alias("vec")), vectors, 5, 2)
    plan = found._jdf.queryExecution().toString()
    cores = spark.sparkContext.defaultParallelism
    assert f"Coalesce {cores}" in plan or f"Repartition {cores}, false" in plan
    assert found.groupBy("qid").count().where("count = 5").count() == 20


def stages(spark):
    """What all stages of the session have done so far."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none = context._gateway.new_array(context._jvm.double, 0)
    told = context._jsc.sc().statusStore().stageList(None, False, False, none, None)
    return [told.apply(i) for i in range(told.size())]


def shuffled(spark, what="shuffleWriteRecords"):
    """Rows (or bytes) that all stages of the session have written to shuffles so far."""
    return sum(getattr(x, what)() for x in stages(spark))


@pytest.mark.parametrize("name", ["failure_report", "verdict_counts", "coverage_verdicts", "override_suggestions", "recall_mrr"])
def test_evaluations_shuffle_results_once(spark, name):
    """The documents' texts stay where they are read, and the results where they are ranked: their paths and the results are shuffled once."""
    folder = "/root/testdata/sf0.01"
    paths, apps = (spark.read.parquet(f"{folder}/{n}.parquet").count() for n in ("arguments", "apps"))
    results = registry.QUERIES["bm25_or_topk"](spark, folder).count() * 2
    before = shuffled(spark)
    found = registry.QUERIES[name](spark, folder)
    found.collect()
    assert shuffled(spark) - before < paths + apps + results and "Generate" not in found._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["verdict_counts", "coverage_verdicts", "override_suggestions", "recall_mrr"])
def test_evaluations_hand_on_the_best_once(spark, name, monkeypatch):
    """However many parts the documents lie in, each query's best are shuffled by two tasks where as many scans as cores run, and nothing changes."""
    folder = "/root/testdata/sf0.01"
    paths, apps = (spark.read.parquet(f"{folder}/{n}.parquet").count() for n in ("arguments", "apps"))
    results = registry.QUERIES["bm25_or_topk"](spark, folder).count() * 2
    want = rows(registry.QUERIES[name](spark, folder))
    parts = 12
    monkeypatch.setattr(S_, "words_of", lambda docs, *shown: words_of(stage(docs.repartition(parts)), *shown))
    monkeypatch.setattr(S_, "best_any", lambda *a, **k: best_any(*a, **k, held=5, task_docs=60))
    before = shuffled(spark)
    assert rows(registry.QUERIES[name](spark, folder)) == want
    assert shuffled(spark) - before < 2 * paths + apps + 3 * results


def test_ranking_sweeps_store_no_pairs_and_agree_in_any_parts(spark, monkeypatch):
    """Queries with all words of a document and without, in few and many tasks and scans."""
    folder = pathlib.Path(shared_folder(spark).removeprefix("file://"))
    before = {p.name for p in folder.iterdir()} if folder.exists() else set()
    plain = S_._asked
    odd = F.concat("text", F.when(F.col("qid") % 40 == 0, " zzzz remove").otherwise(""))
    monkeypatch.setattr(S_, "_asked", lambda s, f: plain(s, f).withColumn("text", odd))
    want = rows(registry.QUERIES["ranking_sweeps"](spark, SF))
    new = [p for p in folder.iterdir() if p.name not in before]
    assert new and all({"prefix", "doc"} - set(spark.read.parquet(f"file://{p}").columns) for p in new)
    whole, sweep = S_.numbered_documents, S_.ranking_sweep
    monkeypatch.setattr(S_, "numbered_documents", lambda rows: stage(whole(rows).repartition(5)))
    monkeypatch.setattr(S_, "ranking_sweep", lambda *a, **k: sweep(*a, **k, held=2, task_docs=40))
    assert rows(registry.QUERIES["ranking_sweeps"](spark, SF)) == want and len(want) == 72


def test_paths_delivered_again_keep_their_texts_in_place(spark, tmp_path):
    """Where every path is delivered twice, and every tenth row twice alike, the first rows are found without a shuffle of texts."""
    told = F.concat_ws("", *(F.sha2(F.concat_ws("-", "row_id", F.lit(i)), 512) for i in range(24)))
    plain = spark.read.parquet(f"{SF}/arguments.parquet").where("cmd_path is not null").withColumn("description", told)
    once = plain.withColumn("r", F.expr("row_number() over (partition by cmd_path order by row_id)")).where("r = 1").drop("r")
    for name, df in (("once", once), ("again", plain.unionByName(plain.withColumn("row_id", F.col("row_id") + 1000)).unionByName(plain.where("row_id % 10 = 0")))):
        df.repartition(3).write.parquet(f"{tmp_path}/{name}/arguments.parquet")
        spark.read.parquet(f"{SF}/apps.parquet").write.parquet(f"{tmp_path}/{name}/apps.parquet")
    want = rows(S_.catalogue(spark, f"{tmp_path}/once"))
    assert rows(S_.catalogue(spark, f"{tmp_path}/again")) == want
    before = shuffled(spark, "shuffleWriteBytes")
    assert registry.QUERIES["coverage_verdicts"](spark, f"{tmp_path}/again").count()
    assert shuffled(spark, "shuffleWriteBytes") - before < plain.count() * 24 * 128 / 4
    for least in (0, 10):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(S_, "BESIDE", least)
            assert rows(S_.catalogue(spark, f"{tmp_path}/again")) == want


@pytest.mark.parametrize("name", ["override_suggestions", "verdict_counts"])
def test_evaluations_hand_on_the_best_from_one_task(spark, name, monkeypatch):
    """With scans enough for all cores, each but the first ranks in a single task, so a query's best are shuffled once; the scans run beside each other."""
    folder, parts = "/root/testdata/sf0.01", 12
    want = rows(registry.QUERIES[name](spark, folder))
    monkeypatch.setattr(S_, "words_of", lambda docs, *shown: words_of(stage(docs.repartition(parts)), *shown))
    seen = []

    def ranked_here(*a, **k):
        top = best_any(*a, **k, held=5, task_docs=60)
        sets = a[1].groupBy("qid").agg(F.sort_array(F.collect_set("prefix")).alias("s")).select("s").distinct().count()
        before = {x.stageId() for x in stages(spark)}
        kept = top.select("lead", "doc").distinct().count()
        seen.append((sets, kept, max((x for x in stages(spark) if x.stageId() not in before), key=lambda x: x.shuffleWriteRecords())))
        return top

    monkeypatch.setattr(S_, "best_any", ranked_here)
    assert rows(registry.QUERIES[name](spark, folder)) == want
    (sets, kept, largest), = seen
    assert sets // 5 > spark.sparkContext.defaultParallelism / 2 and largest.numTasks() > sets // 5
    assert kept <= largest.shuffleWriteRecords() < 1.4 * kept


def test_evaluations_shuffle_whole_points(spark, monkeypatch):
    """What the scans hand on has no fractions, whose digits take most of a shuffled row that has a short path."""
    want, seen = rows(registry.QUERIES["recall_mrr"](spark, SF)), []
    monkeypatch.setattr(A_, "ranked", lambda found, *a, **k: (seen.append(dict(found.dtypes)), ranked(found, *a, **k))[1])
    assert rows(registry.QUERIES["recall_mrr"](spark, SF)) == want
    assert len(seen) == 1 and set(seen[0].values()) == {"bigint", "string"}
