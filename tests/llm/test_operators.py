"""The dealt operators against brute force, exact round trips and planted truth."""

import inspect
import itertools
import random

import numpy as np
import pytest
from conftest import SF, rows
from pyspark.sql import functions as F

from cinderlode.llm import queries as Q
from cinderlode.llm.fusion import claims, posteriors, says_something, survivors, trust_tier
from cinderlode.llm.graph import Graph
from cinderlode.llm.leaks import ItemBlock, leaked_passages, suffix_array, words_of
from cinderlode.llm.mixture import mixture
from cinderlode.llm.neardup import close_texts, groups, letters_of, near_duplicates
from cinderlode.llm.pieces import KINDS, PENALTY, cuts, split_documents, split_text
from cinderlode.llm.tokens import VOCABULARY, encoding
from cinderlode.llm.truncation import _limits, truncated
from cinderlode.llm.vectors import nearest, recall


# 1: truncation
def descriptions(seed=1, n=1500):
    rnd = random.Random(seed)
    nouns, verbs = [f"{a}{b}" for a in ("vol", "buck", "tab", "serv", "clust", "form", "quot") for b in ("ume", "et", "le", "ice", "er", "at", "a")], ["create", "remove", "restore", "update", "inspect", "archive"]
    return [f"{rnd.choice(verbs).capitalize()} the {rnd.choice(nouns)} of every {rnd.choice(nouns)} inside the current workspace" + rnd.choice(["", f", then {rnd.choice(verbs)} its {rnd.choice(nouns)}"]) + rnd.choice([".", ""]) for _ in range(n)]


def test_truncated(spark):
    full = descriptions()
    data = [(i, "whole", t) for i, t in enumerate(full)]
    planted = {5001: ("whole", "Create the volume of every table inside the current worksp"), 5002: ("marks", "Remove the table of every…"), 5003: ("marks", "Restore the volume of [...]"), 5004: ("marks", "Update the"),
               5005: ("marks", "Inspect the volume of every bucket,"), 5006: ("bytes", "Archive the caf�")}
    innocent = {6001: "", 6002: None, 6003: "-", 6004: "???", 6005: "  ", 6006: "Create the volume of every table inside the current workspace", 6007: "!", 6008: "Remove the table."}
    data += [(i, s, t) for i, (s, t) in planted.items()] + [(i, "marks", t) for i, t in innocent.items()] + [(7000 + i, "limited", t[:70]) for i, t in enumerate(full) if len(t) > 75]
    got = {r["row_id"]: r for r in truncated(spark.createDataFrame(data, "row_id long, description string, text string"), "row_id", "text", "description").collect()}
    assert len(got) == len(data)
    assert all(got[i]["cut"] for i in planted) and not any(got[i]["cut"] for i in innocent)
    limited = [r["cut"] for i, r in got.items() if 7000 <= i < 9000]
    assert sum(limited) > 0.97 * len(limited)
    assert sum(got[i]["cut"] for i in range(len(full))) < 0.01 * len(full)


def test_cut_sentence_in_a_feed_without_cut_words(spark):
    data = [(i, "whole", t) for i, t in enumerate(descriptions())] + [(5001, "clean", "Remove the table of every"), (5002, "clean", "Remove the table of every bucket inside the current workspace")]
    got = {r["row_id"]: r["reason"] for r in truncated(spark.createDataFrame(data, "row_id long, feed string, text string"), "row_id", "text", "feed").where("row_id > 5000").collect()}
    assert got == {5001: "sentence", 5002: None}


def test_limit_of_a_small_feed(spark):
    rows_ = [("small", f"{i:02d}" + "x" * 178) for i in range(7)] + [("small", "y" * n) for n in (150, 171, 176, 185, 190)] + [("even", f"{i}" + "z" * n) for n in range(60, 80) for i in range(7)]
    given = inspect.signature(truncated).parameters
    texts = spark.createDataFrame([(s, len(t), len(t)) for s, t in rows_], "source string, letters int, bytes int")
    found = {(r["source"], r["unit"], r["size"]) for r in _limits(texts, given["spike"].default, given["spike_factor"].default).collect()}
    assert found == {("small", "letters", 180), ("small", "bytes", 180)}


def test_phrases_of_several_feeds_are_whole(spark):
    helper = [(i, f"f{i % 9}", f"Interactive helper {i} for the volume") for i in range(2000)]
    for feeds, want in ((4, [None] * 4), (2, ["word"] * 2)):
        data = [*helper, *((9000 + i, f"f{i}", "Print help") for i in range(feeds))]
        got = truncated(spark.createDataFrame(data, "row_id long, feed string, text string"), "row_id", "text", "feed").where("row_id >= 9000").orderBy("row_id").collect()
        assert [r["reason"] for r in got] == want


# 2: near-duplicates
def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def mutated(rnd, s, n):
    for _ in range(n):
        i = rnd.randrange(len(s) + 1)
        s = rnd.choice([s[:i] + rnd.choice("abcé9") + s[i:], s[:i] + s[i + 1:], s[:i] + rnd.choice("xyz中") + s[i + 1:]])
    return s


@pytest.mark.parametrize("size", [1, 3, 7, 15, 30, 59, 61, 90])
def test_close_texts_finds_every_pair(spark, size):
    rnd = random.Random(size)
    base = ["".join(rnd.choice("abcdefgh") for _ in range(size)) for _ in range(12)]
    texts = sorted({mutated(rnd, b, rnd.randrange(4)) for b in base for _ in range(6)} - {""})
    want = {(a, b) for a, b in itertools.combinations(texts, 2) if edits(a, b) <= 2}
    df = spark.createDataFrame([(t,) for t in texts] * 2 + [(None,), ("",)], "t string")
    assert set(map(tuple, close_texts(df, "t").collect())) == want and want


def test_near_duplicates_by_words_and_groups(spark):
    data = [("a.b-c", "Show the big red table."), ("a.b_c", "table, RED big the show!"), ("a.b.cs", "Show the big red chair"), ("a.b.d", "Show one"), ("q", None), (None, "x"), ("r", " "), ("A.B.C", "show the the big red")]
    df = spark.createDataFrame(data, "k string, d string")
    found = set(map(tuple, near_duplicates(df, "k", letters_of("k"), words="d").collect()))
    assert found == {("a.b-c", "a.b_c"), ("a.b-c", "a.b.cs"), ("a.b.cs", "a.b_c"), ("A.B.C", "a.b-c"), ("A.B.C", "a.b_c")} | ({("A.B.C", "a.b.cs")} if 4 / 5 >= 0.75 else set())
    chain = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(40) if i != 20] + [("x", "y")], "key_a string, key_b string")
    got = {r["key"]: r["group_key"] for r in groups(chain).collect()}
    assert got["n020"] == "n000" and got["n021"] == "n021" and got["n040"] == "n021" and got["y"] == "x" and len(got) == 43


def test_many_copies_of_one_name_stay_one_text(spark):
    df = spark.range(400).select(F.col("id").cast("string").alias("k"), F.lit("samename").alias("name"))
    assert close_texts(df, "name").count() == 0
    assert near_duplicates(df.limit(20), "k", letters_of("name"), least_letters=6).count() == 190


# 4: vectors
def clustered(n=1500, dims=16, topics=9, seed=2):
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(topics, dims))[rnd.integers(0, topics, n) ** 2 // topics] + 0.7 * rnd.normal(size=(n, dims))
    return x.astype(np.float32)


def test_graph_recall():
    x = clustered(3000, 24)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = x @ x.T
    np.fill_diagonal(g, -2)
    truth = np.argsort(-g, axis=1)[:, :10]
    ids, sims = Graph(x, degree=16, beam=32).search(x, 40)
    mine = np.where(ids == np.arange(len(x))[:, None], -1, ids)
    assert (mine[:, :, None] == truth[:, None, :]).any(axis=1).mean() > 0.95
    assert (np.diff(sims, axis=1) <= 1e-6).all()
    for n in (1, 2, 5, 60):
        assert set(Graph(x[:n]).search(x[:n], 8)[0][0].tolist()) - {-1} == set(range(n)) or n > 8


@pytest.mark.parametrize("kw", [{}, {"shard_rows": 150, "visitors": 90}, {"shard_rows": 60, "probes": 4, "visitors": 40}, {"shard_rows": 60, "fan": 5, "probes": 4, "margin": 0.3}])
def test_nearest_vectors(spark, kw):
    x = clustered()
    data = [(f"k{i:04}", [float(v) for v in row]) for i, row in enumerate(x)]
    bad = [("none", None), ("short", [1.0]), ("zero", [0.0] * 16), ("nan", [float("nan")] * 16), ("inf", [float("inf")] + [0.0] * 15), (None, [1.0] * 16), ("hole", [None] + [1.0] * 15)]
    copies = [(f"same{i:02}", [3.0 * float(v) for v in x[0]]) for i in range(14)]
    df = spark.createDataFrame(data + bad + copies + data[:5], "key string, embedding array<float>")
    found = nearest(df, "key", "embedding", dims=16, **kw).cache()
    per = {r[0]: r[1] for r in found.groupBy("key").count().collect()}
    assert set(per) == {k for k, _ in data + copies} and set(per.values()) == {10}
    assert recall(df, "key", "embedding", found, dims=16, share=3).first()["recall"] >= 0.9
    same = {r["neighbour"] for r in found.where("key = 'same00'").collect()}
    assert len(same & ({f"same{i:02}" for i in range(14)} | {"k0000"})) == 10
    found.unpersist()


# 6: fusion
def test_priority_and_stand_ins(spark):
    vals = ["", " ", "-", "N/A", "n/a", "TODO", "TBD", "???", "null", "none", "to be written", "No description available.", "<example>", None, "real", "Test the disk", "none of these"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    assert [r[0] for r in df.select(says_something(F.col("v"))).collect()] == [False] * 14 + [True] * 3
    assert [r[0] for r in spark.createDataFrame([("PROBE ",), ("Manual",), ("inferred",), ("import",), (None,), ("",)], "p string").select(trust_tier(F.col("p"))).collect()] == [0, 1, 2, 3, 3, 3]


def test_copied_votes_count_little(spark):
    rnd = random.Random(3)
    data, truth = [], {}
    for g in range(120):
        truth[g] = f"v{g}"
        right = {s: rnd.random() < acc for s, acc in (("good1", 0.9), ("good2", 0.85), ("bad", 0.35))}
        wrong = f"w{rnd.randrange(10)}"
        for i, s in enumerate(("good1", "good2", "bad", "copy1", "copy2")):
            ok = right["bad"] if s.startswith("copy") else right[s]
            data.append((g, g * 10 + i, s, truth[g] if ok else (wrong if s in ("bad", "copy1", "copy2") else f"x{rnd.randrange(99)}")))
    df = spark.createDataFrame(data, "g long, r long, s string, v string")
    claimed = claims(df, "g", "r", {"f": F.col("v")}, F.col("s"), F.lit(0), F.lit(None).cast("timestamp"))
    best = {r["grp"]: r["value"] for r in survivors(claimed, posteriors(claimed)).collect()}
    votes = {g: max({v for gg, _, _, v in data if gg == g}, key=lambda v: sum(1 for gg, _, _, w in data if gg == g and w == v)) for g in truth}
    score, majority = (sum(b[g] == truth[g] for g in truth) for b in (best, votes))
    assert score > majority + 20 and score > 100


def test_strict_order_estimates_no_votes(spark, monkeypatch):
    def never(*_, **__):
        raise AssertionError("votes are estimated, though they cannot change what is taken")

    monkeypatch.setattr(Q, "posteriors", never)
    found = rows(Q.QUERIES["p6_found"](spark, SF).select("canon_path", "field_name", "rec_id"))
    claimed = Q.command_claims(spark.read.parquet(f"{SF}/arguments_raw.parquet"), spark.read.parquet(f"{SF}/apps.parquet")).collect()
    best = {}
    for r in claimed:
        at = (r["tier"], r["at"] is None, -r["at"].timestamp() if r["at"] else 0, r["record"])
        best[r["grp"], r["field"]] = min(best.get((r["grp"], r["field"]), at), at)
    assert found == sorted(((*k, v[-1]) for k, v in best.items()), key=str) and found


# 7: leaks
def test_suffix_array_and_search_against_brute_force():
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(6)]
    for length in (2, 3, 5):
        items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 30)))) for i in range(20)]
        docs = [" ".join(rnd.choice([*words, "zzz"]) for _ in range(rnd.randrange(0, 60))) for _ in range(40)]
        block = ItemBlock(items, length)
        ids, of, at = [], [], []
        for d, t in enumerate(docs):
            w = [block.vocabulary.get(x, 0) for x in words_of(t)]
            ids += [*w, 0]
            of += [d] * (len(w) + 1)
            at += range(len(w) + 1)
        got = {(d, i): n for d, i, n, _, _ in block.search(np.array(ids), np.array(of), np.array(at))}
        want = {}
        for d, t in enumerate(docs):
            a = words_of(t)
            for i, q in items:
                b = words_of(q)
                best = 0
                for x in range(len(a)):
                    for y in range(len(b)):
                        n = 0
                        while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n]:
                            n += 1
                        best = max(best, n)
                if best >= length:
                    want[d, i] = best
        assert got == want
    ids = np.array([rnd.randrange(1, 4) for _ in range(300)] + [0] * 8)
    order = suffix_array(ids, np.arange(300), 8)
    assert [tuple(ids[i:i + 8]) for i in order] == sorted(tuple(ids[i:i + 8]) for i in range(300))


def test_leaks_across_shards_and_blocks(spark):
    text = " ".join(f"tok{i}" for i in range(40))
    docs = spark.createDataFrame([(1, "Before: " + text.upper().replace(" ", " -- ")), (2, " ".join(text.split()[5:16])), (3, " ".join(text.split()[5:17])), (4, None), (5, ""), (6, "x " * 50_000 + text), (7, text)], "doc_id long, text string")
    items = spark.createDataFrame([(10, text), (11, "too short"), (12, None), (13, "y " + " ".join(text.split()[20:40]))], "item_id long, text string")
    for kw in ({}, {"shard_words": 10, "item_block": 1}, {"items_held": 1}, {"letters_held": 100}):
        got = {(r["doc_id"], r["item_id"]): r["words"] for r in leaked_passages(docs, items, **kw).collect()}
        assert got == {(1, 10): 40, (1, 13): 20, (3, 10): 12, (6, 10): 40, (6, 13): 20, (7, 10): 40, (7, 13): 20}


# 8: mixture
def test_mixture_reaches_shares_within_repeats(spark):
    docs = spark.createDataFrame([(i, "word " * (20 + i % 50), ["Big ", "big", "SMALL", "mid", None, "other"][i % 6]) for i in range(1200)] + [(5000, None, "big"), (5001, " ", "big"), (None, "a b", "big")], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 0.2, 2), ("small", 0.5, 3), ("mid", 0.2, 1), ("none", 0.1, 4)], "source string, target_share double, max_repeats int")
    mix, report = mixture(docs, targets, tilts={"small": 0.8})
    told = {r["source"]: r for r in report.collect()}
    for s, share in (("big", 0.2), ("small", 0.5), ("mid", 0.2)):
        assert abs(told[s]["share_reached"] - share / 0.9) < 0.005 and told[s]["repeats_used"] <= told[s]["max_repeats"]
    assert told["none"]["n_tokens"] == 0 and told["none"]["capped"]
    got = mix.collect()
    assert [r["position"] for r in got] == sorted(r["position"] for r in got)
    assert len({(r["doc_id"], r["repeat_no"]) for r in got}) == len(got) and max(r["repeat_no"] for r in got if r["source"] == "small") <= 3
    assert not {r["doc_id"] for r in got} & {5000, 5001}
    half = got[-1]["position"] / 2
    early = sum(r["n_tokens"] for r in got if r["source"] == "small" and r["position"] < half) / sum(r["n_tokens"] for r in got if r["source"] == "small")
    assert early < 0.45  # the tilt brings it late
    _, capped = mixture(docs, targets, budget=10**7)
    assert {r["source"] for r in capped.collect() if r["capped"]} == {"big", "small", "mid", "none"}


def test_default_budget_is_the_largest_the_repeats_allow(spark):
    docs = spark.createDataFrame([(i, "word " * 20, "ab"[i % 2]) for i in range(200)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 3), ("b", 0.5, 4)], "source string, target_share double, max_repeats int")
    report = mixture(docs, targets)[1].collect()
    assert {(r["source"], r["n_copies"], r["repeats_used"], r["capped"]) for r in report} == {("a", 300, 3, False), ("b", 300, 3, False)}


# 9: pieces
TEXTS = {
    "paragraphs": "\n\n".join(" ".join(f"Sentence {i} of the paragraph tells a little." for i in range(j, j + 9)) for j in range(60)),
    "no breaks": "abcdefghij" * 900,
    "chinese": "安装此工具之前请阅读说明。" * 300,
    "emoji": "😀👩‍👩‍👧" * 400,
    "white": " \n\t" * 3000,
    "mixed": ("x" * 5000) + " word" * 900 + "\n\nEnd of it. " * 200,
}


@pytest.mark.parametrize("name", TEXTS)
@pytest.mark.parametrize("most,overlap", [(64, 8), (512, 32), (20, 0)])
def test_pieces_join_to_the_text(name, most, overlap):
    text = TEXTS[name]
    raw, e = text.encode(), encoding(VOCABULARY)
    found = split_text(text, most, overlap)
    assert found
    said = b""
    for n, (a, b, x, y) in enumerate(found):
        assert b - a <= most and raw[x:y].decode()
        if n:
            back = found[n - 1][1] - a
            assert overlap <= back <= overlap + 3 and x <= len(said)
        said += raw[len(said):y]
        assert len(e.encode_ordinary(raw[x:y].decode())) <= most + 2
    assert said == raw


def test_pieces_end_at_natural_boundaries():
    raw = TEXTS["paragraphs"].encode()
    ends = [raw[:y].decode().rstrip()[-1] for _, _, _, y in split_text(TEXTS["paragraphs"], 512, 32)]
    assert all(c == "." for c in ends)


def test_cuts_have_the_least_cost():
    rnd = np.random.default_rng(5)
    for _ in range(60):
        total, most = int(rnd.integers(100, 400)), int(rnd.integers(80, 120))
        kinds = rnd.choice(5, total, p=[0.05, 0.05, 0.1, 0.4, 0.4])
        room = most - 8 - 3
        share = total / -(-total // room)

        def step(a, b):
            return 20 * ((b - a) / share - 1) ** 2 + 4 + (PENALTY[KINDS[kinds[b - 1]]] if b < total else 0)

        least = [0.0]
        for b in range(1, total + 1):
            least.append(min(least[a] + step(a, b) for a in range(max(0, b - room), b)))
        found = cuts(kinds, most, 8).tolist()
        assert all(b - a <= room for a, b in zip(found, found[1:])) and abs(sum(map(step, found, found[1:])) - least[total]) < 1e-6


def test_split_documents_rows(spark):
    df = spark.createDataFrame([(1, TEXTS["paragraphs"]), (2, "short"), (3, None), (4, ""), (None, TEXTS["chinese"]), (5, TEXTS["chinese"])], "doc_id long, text string")
    got = split_documents(df, [("a", 64, 8), ("b", 4000, 100)]).collect()
    assert {r["doc_id"] for r in got if r["limit_name"] == "a"} == {1, 5} and all(1 <= r["piece_no"] <= r["n_pieces"] for r in got)
    with pytest.raises(Exception):
        split_documents(df, [("a", 10, 8)]).collect()


def test_queries_on_their_tables(spark):
    assert {r[0] for r in Q.p9_found(spark, SF).collect()} == {r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").where("text is not null").collect() if len(encoding(VOCABULARY).encode_ordinary(r["text"])) > 2048}
    assert rows(Q.p8_shares(spark, SF))
