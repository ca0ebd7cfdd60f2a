"""Column functions over query texts and command paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cinderlode.core import trimmed
from cinderlode.functions import lexicon as L

SPLIT = r"[^\p{L}\p{N}_]+"


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def literal_lists(values: dict[str, list[str]]) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def corrected(token: Column) -> Column:
    """A lower-cased token, transliterated, or else with a known typo or one edit to a famous command put right."""
    near = F.array_min(F.transform(strings(L.FAMOUS), lambda w, i: F.struct(F.levenshtein(token, w).alias("d"), i.alias("i"), w.alias("w"))))
    edited = F.when((F.octet_length(token) > 3) & (near["d"] <= 1), near["w"]).otherwise(token)
    return F.coalesce(literal_map(L.TRANSLITERATED)[token], literal_map(L.TYPOS)[token], edited)


def robust(text: Column) -> Column:
    """Every run of letters and digits corrected, what stands between kept; a run keeps its case unless it changes."""
    runs = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.when(corrected(F.lower(r)) != F.lower(r), corrected(F.lower(r))).otherwise(r)), "")


def query_terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), SPLIT), lambda w: (w != "") & ~w.isin(*L.STOP_WORDS))


def expanded_terms(text: Column) -> Column:
    """Query terms and, once each and after them, the concrete terms of their concepts."""
    terms = query_terms(text)
    return F.concat(terms, F.array_except(F.array_distinct(F.flatten(F.transform(terms, lambda w: F.coalesce(literal_lists(L.CONCEPTS)[w], F.array().cast("array<string>"))))), terms))


def alias_terms(text: Column) -> Column:
    """Tool names that any word of the text stands for and that are not among its words; stop words are not removed first."""
    words = F.filter(F.split(F.lower(text), SPLIT), lambda w: w != "")
    named = F.array_distinct(F.flatten(F.transform(words, lambda w: F.coalesce(literal_lists(L.TOOL_ALIASES)[w], F.array().cast("array<string>")))))
    return F.array_except(named, words)


def content_tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), SPLIT), lambda w: (w != "") & ~w.isin(*L.CONTENT_STOP_WORDS)))


def singular(word: Column, least: int = 3) -> Column:
    """Without a final s, where least letters (in bytes) remain."""
    return F.when(word.endswith("s") & (F.octet_length(word) > least), F.regexp_replace(word, "s$", "")).otherwise(word)


def path_expansion(tokens: Column) -> Column:
    concepts = F.flatten(F.transform(tokens, lambda w: F.coalesce(literal_lists(L.CONCEPTS)[w], F.array().cast("array<string>"))))
    return F.array_distinct(F.concat(tokens, F.transform(tokens, lambda w: singular(w)), concepts))


def path_score(path: Column, expanded: Column) -> Column:
    """max(0, 3 overlap - extra) over the words of the path after its root; 0 for roots."""
    words = F.filter(F.split(F.lower(F.regexp_extract(path, r"^[^.]*\.(.*)$", 1)), SPLIT), lambda w: w != "")
    hit = F.size(F.filter(words, lambda w: F.array_contains(expanded, w) | F.array_contains(expanded, singular(w))))
    return F.when(F.contains(path, F.lit(".")), F.greatest(F.lit(0), 3 * hit - (F.size(words) - hit))).otherwise(0)


def clean_path(path: Column) -> Column:
    for old, new in L.PATH_REWRITES:
        path = F.replace(path, F.lit(old), F.lit(new))
    parts = F.filter(F.split(path, r"\s+"), lambda p: p != "")
    flag = F.array_position(F.transform(parts, lambda p: p.startswith("-")), F.lit(True))
    kept = F.when(flag > 0, F.slice(parts, 1, (flag - 1).cast("int"))).otherwise(parts)
    return F.regexp_replace(F.regexp_replace(F.array_join(kept, "."), r"\.{2,}", "."), r"^\.+|\.+$", "")


def node_type(path: Column) -> Column:
    return F.when(F.contains(path, F.lit(".")), "sub").otherwise("root")


def leaf(path: Column) -> Column:
    return F.substring_index(path, ".", -1)


def root(path: Column) -> Column:
    return F.substring_index(path, ".", 1)


def below(parts: Column) -> Column:
    """All entries but the first."""
    return F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1)))


def is_noise(path: Column) -> Column:
    deeper = below(F.split(path, r"\."))
    return F.contains(path, F.lit(".")) & (F.lower(leaf(path)).isin(*L.NOISE_LEAVES) | F.arrays_overlap(deeper, strings(["completion", "completions"])))


def canonical_tool(name: Column) -> Column:
    r = F.lower(F.trim(name))
    rest = F.regexp_extract(r, "^[^-]*-(.*)$", 1)
    return F.when(rest.isin(*L.COMPOUND_TOOLS), r).otherwise(F.regexp_replace(r, "-(" + "|".join(L.FUSED_SUFFIXES) + ")$", ""))


def canonical_path(path: Column) -> Column:
    lower = F.lower(path)
    first, rest = F.substring_index(lower, ".", 1), below(F.split(lower, r"\."))
    tool = canonical_tool(first)
    fused = F.when(tool != first, F.array(F.substring(first, F.length(tool) + 2, F.length(first)))).otherwise(F.array().cast("array<string>"))
    stems = F.transform(F.concat(fused, rest), lambda w: F.when(w.endswith("s") & (F.length(w) > 3), F.regexp_replace(w, "s$", "")).otherwise(w))
    return F.array_join(F.concat(F.array(tool), stems), ".")


def path_words(path: Column) -> Column:
    return F.translate(path, "._-", "   ")


def embed_text(path: Column, description: Column, topics: Column) -> Column:
    """Path words, description and topics; underscores of the path stay."""
    return trimmed(F.concat(F.translate(path, ".-", "  "), F.lit(". "), F.coalesce(description, F.lit("")), F.lit(" "), F.coalesce(topics, F.lit(""))))


def index_name(app_id: Column, name: Column) -> Column:
    """The app's name (its id where it has none), with the last part of the id where the name does not contain that."""
    alias = F.substring_index(app_id, ".", -1)
    name = F.coalesce(name, app_id, F.lit(""))
    apart = F.contains(app_id, F.lit(".")) & ~F.contains(name, alias)
    return F.when(F.coalesce(apart, F.lit(False)), F.concat_ws(" ", name, alias)).otherwise(name)


def index_text(path: Column, description: Column, topics: Column) -> Column:
    """The field of capabilities: path words, description, topics."""
    return F.concat_ws(" ", F.translate(path, ".-", "  "), F.coalesce(description, F.lit("")), F.coalesce(topics, F.lit("")))


def risk(path: Column, description: Column, existing: Column) -> Column:
    hay = F.concat_ws(" ", F.lower(leaf(path)), F.lower(F.coalesce(description, F.lit(""))))

    def has(words):
        return hay.rlike("|".join(w.replace("-", r"\-") for w in words))

    return F.when(existing.isNotNull() & ~existing.isin("safe", ""), existing).when(has(L.DANGEROUS), "dangerous").when(has(L.MEDIUM), "medium").otherwise("safe")


def example_fault(path: Column, example: Column) -> Column:
    """binary, subcommand or null: whether an example calls another binary or strays from the path's own words."""
    told = F.filter(F.split(F.trim(example), r"\s+"), lambda t: t != "")
    tokens = F.when(F.get(told, F.lit(0)) == "sudo", below(told)).otherwise(told)
    base, rest = F.lower(root(path)), below(tokens)
    ends = F.transform(rest, lambda t: t.startswith("-") | F.contains(t, F.lit("{{")) | F.contains(t, F.lit("=")) | t.isin(*L.SHELL_OPERATORS))
    stop = F.array_position(ends, F.lit(True))
    bare = F.when(stop > 0, F.slice(rest, 1, (stop - 1).cast("int"))).otherwise(rest)
    segments = below(F.split(F.lower(path), r"\."))
    strays = F.exists(F.transform(bare, lambda t, i: F.coalesce(F.get(segments, i) != F.lower(t), F.lit(True))), lambda b: b)
    first = F.lower(F.get(tokens, F.lit(0)))
    return F.when(F.size(tokens) <= 0, F.lit(None).cast("string")).when((first != base) & (first != F.concat(F.lit("./"), base)), "binary").when(F.contains(path, F.lit(".")) & strays, "subcommand")


def topic_list(raw: Column, most: int = 15) -> Column:
    """Topics parted by commas or line ends, lower-cased, each once in order of appearance."""
    return F.slice(F.array_distinct(F.filter(F.transform(F.split(raw, r"[,\n]"), lambda t: F.lower(trimmed(t))), lambda t: t != "")), 1, most)


def topic_words(raw: Column) -> Column:
    """The stored topics of a command as they are shown: split at white space."""
    return F.filter(F.split(F.coalesce(raw, F.lit("")), r"\s+"), lambda t: t != "")


def segments_of(path: Column) -> Column:
    return F.array_union(F.split(F.lower(path), r"\."), F.array(F.lower(path)))


def content_key(path: Column, description: Column) -> Column:
    return F.sha1(F.concat(path, F.char(F.lit(0)), description))


def echoes_path(path: Column, query: Column) -> Column:
    """Whether the query names a segment (of two letters or more) of the path."""
    q = F.concat(F.lit(" "), F.lower(query), F.lit(" "))
    return F.exists(F.split(F.lower(path), r"\."), lambda s: (F.length(s) >= 2) & (F.contains(q, F.concat(F.lit(" "), s, F.lit(" "))) | F.contains(q, F.concat(F.lit(" "), s, F.lit("."))) | F.contains(q, F.concat(F.lit(" "), s, F.lit(",")))))


def unstyled(text: Column) -> Column:
    """Without terminal colours and overstrikes."""
    return F.regexp_replace(F.regexp_replace(text, r"\x1b\[[0-9;?]*[ -/]*[@-~]", ""), r".\x08", "")


def xml_escaped(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text
