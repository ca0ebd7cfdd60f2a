"""Near-duplicate records with small edits, over collections too large for pairwise comparison.

Tensored banding: each key is cut in a left and a right half; each half gives a small collection of hashes, one for every way to
delete up to max_edits of its letters, and the table keys are pairs of a left and a right hash that together delete no more than
max_edits. Two keys within max_edits edits always share such a pair, so no link is lost; candidates are verified exactly.
Min-hashes are not used for the halves, as shingles of short keys overlap too little after two edits (README, problem 2).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlode.core import stage

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
LONG = 60


def letters_of(column: str) -> Column:
    """The letters and digits, lower-cased."""
    return F.lower(F.regexp_replace(F.col(column), r"[^\p{L}\p{N}]+", ""))


def sorted_words(column: str) -> Column:
    return F.array_sort(F.filter(F.split(F.lower(F.col(column)), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def bag_of(words: str) -> Column:
    """A column of sorted words, the k-th occurrence of a word told apart from the others, so that sets of them act as bags."""
    return F.transform(F.col(words), lambda w, i: F.concat(w, F.lit("#"), (i + 1 - F.array_position(words, w)).cast("string")))


def _mixed(codes: np.ndarray) -> np.ndarray:
    x = codes.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n + 2, BASE, np.uint64))])


def _half(c: np.ndarray, most: int) -> list[np.ndarray]:
    """Hashes of rows of equal length after deleting 0, 1, ... most letters: one array (rows, ways) per number of deletions."""
    m, n = c.shape
    power = _powers(n)
    prefix = np.zeros((m, n + 1), np.uint64)
    for i in range(n):
        prefix[:, i + 1] = prefix[:, i] * BASE + c[:, i]

    def span(i, j):  # hash of letters i to j
        return prefix[:, j] - prefix[:, i] * power[j - i]

    out = [prefix[:, n:]]
    if most >= 1:
        i = np.arange(n)
        out.append(prefix[:, i] * power[n - 1 - i] + span(i + 1, np.full(n, n)) if n >= 1 else np.zeros((m, 0), np.uint64))
    if most >= 2:
        i, j = np.triu_indices(n, 1)
        out.append(prefix[:, i] * power[n - 2 - i] + span(i + 1, j) * power[n - 1 - j] + span(j + 1, np.full(len(j), n)) if n >= 2 else np.zeros((m, 0), np.uint64))
    return out


def tensored_keys(c: np.ndarray, most: int) -> np.ndarray:
    """Table keys (rows, keys) of strings of equal length, given as mixed letter codes: pairs of a left and a right hash."""
    m, n = c.shape
    h = n // 2
    left, right, power = _half(c[:, :h], most), _half(c[:, h:], most), _powers(n)
    keys = []
    for a in range(most + 1):
        for b in range(most + 1 - a):
            if left[a].shape[1] and right[b].shape[1]:
                keys.append((left[a][:, :, None] * power[n - h - b] + right[b][:, None, :]).reshape(m, -1))
    return np.concatenate(keys, axis=1)


def segment_keys(c: np.ndarray, most: int) -> np.ndarray:
    """Table keys of long strings: of most + 1 segments one is intact and shifted by no more than most letters."""
    m, n = c.shape
    power = _powers(n)
    prefix = np.zeros((m, n + 1), np.uint64)
    for i in range(n):
        prefix[:, i + 1] = prefix[:, i] * BASE + c[:, i]
    keys = []
    for length in range(n - most, n + most + 1):
        edges = [length * k // (most + 1) for k in range(most + 2)]
        for k in range(most + 1):
            for shift in range(-most, most + 1):
                i, j = edges[k] + shift, edges[k + 1] + shift
                if 0 <= i < j <= n:
                    keys.append(((prefix[:, j] - prefix[:, i] * power[j - i]) * np.uint64(0x9FB21C651E98DF25) + np.uint64(length * 64 + k))[:, None])
    return np.concatenate(keys, axis=1)


def _banded(most: int, parts: int, flush: int = 2_000_000):
    """Table keys of a portion of texts, packed as one row for each part of the key space: 32 bits of every key and a 16-bit place in
    the row's own list of text ids. The part tells the other bits; keys that agree by chance only cost a comparison.
    """

    def packed(held):
        owner_ids, held_bands, held_places = (np.concatenate(x) for x in held)
        part = ((held_bands >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(part, kind="stable")  # keys of one text stay together, so their places compress to nothing
        bands, places, part = held_bands[order].astype(np.uint32), held_places[order].astype(np.uint16), part[order]
        edges = np.searchsorted(part, np.arange(parts + 1))
        rows = [(k, bands[x:y].tobytes(), places[x:y].tobytes()) for k, (x, y) in enumerate(zip(edges[:-1], edges[1:])) if y > x]
        owners = owner_ids.tobytes()
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary()), pa.array([owners] * len(rows), pa.binary())], names=["part", "bands", "places", "ids"])

    def run(batches):
        held, texts_held, size = ([], [], []), 0, 0
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            by_length: dict[int, list[int]] = {}
            for i, t in enumerate(texts):
                by_length.setdefault(len(t), []).append(i)
            for n, rows in by_length.items():
                step = max(1, 1_000_000 // (n * n // 2 + 100 if n <= LONG else 100 * n))
                for at in range(0, len(rows), step):
                    chosen = rows[at:at + step]
                    if size > flush or texts_held + len(chosen) > 65_535:
                        yield packed(held)
                        held, texts_held, size = ([], [], []), 0, 0
                    c = _mixed(np.array([[ord(x) for x in texts[i]] for i in chosen], np.int64).reshape(len(chosen), n))
                    held[0].append(ids[chosen])
                    for made in ([tensored_keys] if n <= LONG else []) + ([segment_keys] if n > LONG - most else []):
                        keys = _spread(made(c, most))
                        held[1].append(keys.ravel()), held[2].append(np.repeat(np.arange(texts_held, texts_held + len(chosen), dtype=np.uint32), keys.shape[1]))
                        size += keys.size
                    texts_held += len(chosen)
        if size:
            yield packed(held)

    return run


def _spread(keys: np.ndarray) -> np.ndarray:
    """Keys with all bits mixed, so that any of them part them evenly."""
    x = keys ^ (keys >> np.uint64(31))
    x = x * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(29))


def _collisions(run_rows: int):
    """Pairs of ids that meet under a key; a task has all ids of its keys, as it has its part of the key space.

    Two columns of pairs come packed as bytes. Runs of more than run_rows ids come as blocks, every two pieces of the run, which
    other tasks expand, so no task makes all pairs of a run.
    """

    def run(batches):
        bands, ids = [], []
        for batch in batches:
            for band, place, owner in zip(batch.column(1), batch.column(2), batch.column(3)):
                bands.append(np.frombuffer(band.as_py(), np.uint32))
                ids.append(np.frombuffer(owner.as_py(), np.int64)[np.frombuffer(place.as_py(), np.uint16)])
        band, idn = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((bands, np.uint32), (ids, np.int64)))
        bands.clear(), ids.clear()
        order = np.argsort(band, kind="stable")
        band, idn = band[order], idn[order]
        start = np.flatnonzero(np.concatenate([[True], band[1:] != band[:-1]])) if len(band) else np.zeros(0, np.int64)
        size = np.diff(np.concatenate([start, [len(band)]]))
        for s, n in zip(start[size > run_rows], size[size > run_rows]):
            pieces = np.array_split(np.unique(idn[s:s + n]), -(-n // run_rows))
            for i, one in enumerate(pieces):
                for two in pieces[i:]:
                    yield _packed_pairs(one, two, True)
        start, size = start[(size > 1) & (size <= run_rows)], size[(size > 1) & (size <= run_rows)]
        place = np.arange(len(start))
        d, kept, waiting = 1, [], 0
        while len(place):  # the d-th neighbour to the right within the run of equal keys, for d = 1, 2, ...
            place = place[size[place] > d]
            many = size[place] - d
            first = np.repeat(start[place], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            kept.append(np.stack([np.minimum(idn[first], idn[first + d]), np.maximum(idn[first], idn[first + d])], axis=1))
            waiting += len(first)
            if waiting > 1_000_000 or not len(place):
                pairs = np.unique(np.concatenate(kept), axis=0)
                kept, waiting = [pairs], 0
                if len(pairs) > 500_000 or not len(place):
                    kept = []
                    for at in range(0, len(pairs), 100_000):
                        yield _packed_pairs(pairs[at:at + 100_000, 0], pairs[at:at + 100_000, 1], False)
            d += 1

    return run


def _packed_pairs(one: np.ndarray, two: np.ndarray, every: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([one.tobytes()], pa.binary()), pa.array([two.tobytes()], pa.binary()), pa.array([every])], names=["one", "two", "every"])


def _expanded(batches):
    """Distinct pairs id_a < id_b of packed rows: side by side, or all of one with all of two."""
    for batch in batches:
        for one, two, every in zip(*(batch.column(i) for i in range(3))):
            a, b = (np.frombuffer(x.as_py(), np.int64) for x in (one, two))
            if every.as_py():
                a, b = np.repeat(a, len(b)), np.tile(b, len(a))
            a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["id_a", "id_b"])


def close_texts(texts: DataFrame, column: str, max_edits: int = 2, keys_a_part: int = 4_000_000, run_rows: int = 2000) -> DataFrame:
    """Pairs (text_a, text_b), text_a < text_b, of distinct values within max_edits edits (insert, delete, replace a letter).

    Nulls and empty values take part in no pair. Values of any length are handled; beyond LONG letters keys are segments instead
    of deletions, so their number stays the same. Equal values are one text: see near_duplicates for copies.
    """
    if max_edits not in (1, 2):
        raise ValueError("max_edits is 1 or 2")
    named = stage(texts.select(F.col(column).alias("text")).where("text <> ''").distinct().select(F.xxhash64("text").alias("id"), "text"))
    shape = named.agg(F.sum(F.when(F.length("text") <= LONG, F.length("text") * F.length("text") / 2 + F.length("text") + 1).otherwise(75)).alias("k")).first()
    parts = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(shape["k"] or 0) // keys_a_part))
    bands = named.mapInArrow(_banded(max_edits, parts), "part int, bands binary, places binary, ids binary").repartitionById(parts, F.col("part"))
    met = stage(bands.mapInArrow(_collisions(run_rows), "one binary, two binary, every boolean"))
    # Blocks of long runs go to tasks of their own; other pairs are expanded where they are read.
    long = met.where("every").repartition(parts).mapInArrow(_expanded, "id_a long, id_b long")
    found = met.where("not every").mapInArrow(_expanded, "id_a long, id_b long").unionByName(long).distinct()
    a, b = named.select(F.col("id").alias("id_a"), F.col("text").alias("a")), named.select(F.col("id").alias("id_b"), F.col("text").alias("b"))
    return (
        found.join(a, "id_a").join(b, "id_b").where(f"abs(length(a) - length(b)) <= {max_edits} and levenshtein(a, b, {max_edits}) >= 0")
        .select(F.least("a", "b").alias("text_a"), F.greatest("a", "b").alias("text_b")).where("text_a <> text_b").distinct()
    )


def _records(records: DataFrame, key: str, text: Column, least_letters: int, words: str | None) -> DataFrame:
    rows = records.select(F.col(key).alias("key"), text.alias("text"), *([sorted_words(words).alias("words")] if words else [])).where(f"key is not null and length(text) >= {least_letters}")
    return stage((rows.where("size(words) > 0") if words else rows).distinct())


def _alike(least_shared: float) -> Column:
    return F.size(F.array_intersect(bag_of("words_a"), bag_of("words_b"))) >= least_shared * F.greatest(F.size("words_a"), F.size("words_b"))


def near_duplicates(records: DataFrame, key: str, text: Column, max_edits: int = 2, least_letters: int = 1, words: str | None = None, least_shared: float = 0.75) -> DataFrame:
    """Pairs of different keys (key_a < key_b) whose texts are within max_edits edits.

    With words given, the descriptions in that column must also share at least least_shared of the words of the longer one, as
    bags, in any order; a description without words shares nothing. A key that comes with several texts or descriptions links by
    any of them. Null keys, null texts and texts under least_letters are left out; rows delivered again add nothing. These are
    all pairs, as many as there are: duplicate_groups gives the groups without them.
    """
    rows = _records(records, key, text, least_letters, words)
    close = close_texts(rows, "text", max_edits)
    both = close.unionByName(rows.select(F.col("text").alias("text_a"), F.col("text").alias("text_b")).distinct())
    extra = ["words"] if words else []
    left = rows.select(F.col("key").alias("k1"), F.col("text").alias("text_a"), *(F.col(c).alias("words_a") for c in extra))
    right = rows.select(F.col("key").alias("k2"), F.col("text").alias("text_b"), *(F.col(c).alias("words_b") for c in extra))
    pairs = both.join(left, "text_a").join(right, "text_b").where("k1 <> k2 and (text_a <> text_b or k1 < k2)")
    if words:
        pairs = pairs.where(_alike(least_shared))
    return pairs.select(F.least("k1", "k2").alias("key_a"), F.greatest("k1", "k2").alias("key_b")).distinct()


def duplicate_groups(records: DataFrame, key: str, text: Column, max_edits: int = 2, least_letters: int = 1, words: str | None = None, least_shared: float = 0.75) -> DataFrame:
    """The groups that near_duplicates' pairs connect: key, group_key (the smallest key of its group); keys without a link are in none.

    Keys of one text (and, with words, one description) hang on one representative of it; only different representatives are
    compared. So a name that many keys share gives as many rows as keys, not their pairs.
    """
    rows = _records(records, key, text, least_letters, words)
    same = ["text", "words"] if words else ["text"]
    node = F.concat(F.lit("n"), F.sha2(F.to_json(F.struct(*same)), 256))
    rows = stage(rows.withColumn("node", node))
    ends = [rows.select(F.col("node").alias(f"n{i}"), *(F.col(c).alias(f"{c}_{x}") for c in same)).distinct() for i, x in ((1, "a"), (2, "b"))]
    close = close_texts(rows, "text", max_edits)
    if words:  # the same text with other descriptions
        close = close.unionByName(rows.select(F.col("text").alias("text_a"), F.col("text").alias("text_b")).distinct())
    pairs = close.join(ends[0], "text_a").join(ends[1], "text_b").where("n1 <> n2")
    if words:
        pairs = pairs.where(_alike(least_shared))
    links = pairs.select(F.col("n1").alias("key_a"), F.col("n2").alias("key_b")).unionByName(rows.select(F.concat(F.lit("k"), F.col("key").cast("string")).alias("key_a"), F.col("node").alias("key_b")))
    found = groups(links).where("key like 'k%'").select(F.expr("substring(key, 2)").alias("key"), F.expr("substring(group_key, 2)").alias("group_key"))
    several = found.groupBy("group_key").agg(F.count("*").alias("n")).where("n > 1").select("group_key")
    return found.join(several, "group_key").select("key", "group_key")


def groups(pairs: DataFrame) -> DataFrame:
    """Connected groups of linked keys: key, group_key (the smallest key of its group). Keys without a link are in no group.

    Each round every key takes the least label among its own, its neighbours' and that of its label, so labels travel twice as far
    each time; it ends when nothing changes.
    """
    edges = stage(pairs.selectExpr("key_a as k", "key_b as o").unionByName(pairs.selectExpr("key_b as k", "key_a as o")).distinct())
    label = stage(edges.groupBy("k").agg(F.least(F.min("o"), F.first("k")).alias("g")))
    while True:
        near = edges.join(label.select(F.col("k").alias("o"), "g"), "o").select("k", "g")
        least = near.unionByName(label).groupBy("k").agg(F.min("g").alias("g"))
        jumped = least.join(least.select(F.col("k").alias("g"), F.col("g").alias("gg")), "g", "left").select("k", F.least("g", F.coalesce("gg", "g")).alias("g"))
        new = stage(jumped.join(label.select("k", F.col("g").alias("was")), "k").select("k", "g", (F.col("g") != F.col("was")).alias("moved")))
        label = new.select("k", "g")
        if not new.where("moved").limit(1).count():
            return label.select(F.col("k").alias("key"), F.col("g").alias("group_key"))
