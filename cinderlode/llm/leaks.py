"""Evaluation texts that leaked into training documents.

Documents are cut into shards of a bounded number of words. In each shard the suffixes that can start a long enough match, that
is those followed by enough words known to the evaluation texts, are sorted into a suffix array by prefix doubling; every suffix
of every evaluation item is then located by binary search, and each hit is extended to its full length.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def suffix_array(ids: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """starts ordered by the first depth (or more) entries that follow each; ids must end with depth zeros."""
    rank, width = ids.astype(np.int64), 1
    while width < depth:
        shifted = np.concatenate([rank[width:], np.zeros(width, np.int64)])
        key = rank * (int(rank.max(initial=0)) + 1) + shifted
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        width *= 2
    return starts[np.argsort(rank[starts], kind="stable")]


def locate(ids: np.ndarray, suffixes: np.ndarray, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-last place in the suffix array of the suffixes that begin with each row of patterns."""
    columns = np.arange(patterns.shape[1])

    def bound(upper: bool) -> np.ndarray:
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(suffixes), np.int64)
        while (active := low < high).any():
            mid = (low + high) // 2
            seen = ids[suffixes[np.minimum(mid, len(suffixes) - 1)][:, None] + columns]
            differs = seen != patterns
            at = differs.argmax(axis=1)
            rows = np.arange(len(patterns))
            less = np.where(differs.any(axis=1), seen[rows, at] < patterns[rows, at], upper)
            low, high = np.where(active & less, mid + 1, low), np.where(active & ~less, mid, high)
        return low

    return bound(False), bound(True)


class ItemBlock:
    """A block of evaluation items, ready for search."""

    def __init__(self, items: list[tuple[int, str]], length: int):
        self.length, self.vocabulary = length, {}
        ids, owner, offset = [], [], []
        for item, text in items:
            words = words_of(text or "")
            if len(words) >= length:
                ids += [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words] + [-1]
                owner += [item] * (len(words) + 1)
                offset += range(len(words) + 1)
        self.ids, self.owner, self.offset = np.array([*ids, *[-1] * length], np.int64), np.array([*owner, *[0] * length], np.int64), np.array([*offset, *[0] * length], np.int64)
        ends = np.flatnonzero(self.ids < 0)
        places = np.arange(len(ids))
        self.at = places[ends[np.searchsorted(ends, places)] - places >= length] if len(ids) else places
        self.patterns = self.ids[self.at[:, None] + np.arange(length)] if len(self.at) else np.zeros((0, length), np.int64)

    def search(self, ids: np.ndarray, doc_of: np.ndarray, place: np.ndarray) -> list[tuple]:
        """Matches (doc, item, words, doc_word, item_word), the longest of each document and item."""
        length = self.length
        ids, doc_of, place = np.concatenate([ids, np.zeros(length, np.int64)]), np.concatenate([doc_of, np.full(length, -1)]), np.concatenate([place, np.zeros(length, np.int64)])
        unknown = np.flatnonzero(ids == 0)
        every = np.arange(len(ids))
        starts = every[unknown[np.minimum(np.searchsorted(unknown, every), len(unknown) - 1)] - every >= length]
        if not len(starts) or not len(self.at):
            return []
        # Only stretches that hold such a start are kept; the zero after each stretch is kept with it.
        keep = np.zeros(len(ids) + 1, np.int64)
        np.add.at(keep, starts, 1)
        np.add.at(keep, np.minimum(starts + length + 1, len(ids)), -1)
        kept = np.flatnonzero(np.cumsum(keep[:-1]) > 0)
        new_of = np.full(len(ids), -1)
        new_of[kept] = np.arange(len(kept))
        starts = new_of[starts]
        ids, doc_of, place = (np.concatenate([x[kept], np.full(length, fill)]) for x, fill in ((ids, 0), (doc_of, -1), (place, 0)))
        suffixes = suffix_array(ids, starts, length)
        low, high = locate(ids, suffixes, self.patterns)
        hits = high - low
        if not hits.sum():
            return []
        which = np.repeat(np.arange(len(hits)), hits)
        found = suffixes[np.arange(hits.sum()) - np.repeat(np.cumsum(hits) - hits, hits) + np.repeat(low, hits)]
        a, b, size = found + length, self.at[which] + length, np.full(len(found), length)
        going = np.arange(len(found))
        while len(going):
            ok = (a[going] < len(ids)) & (b[going] < len(self.ids))
            going = going[ok]
            going = going[ids[a[going]] == self.ids[b[going]]]
            a[going] += 1
            b[going] += 1
            size[going] += 1
        doc, item, doc_word, item_word = doc_of[found], self.owner[self.at[which]], place[found], self.offset[self.at[which]]
        order = np.lexsort((doc_word, item_word, -size, item, doc))
        first = np.ones(len(order), bool)
        first[1:] = (doc[order][1:] != doc[order][:-1]) | (item[order][1:] != item[order][:-1])
        best = order[first]
        return list(zip(doc[best].tolist(), item[best].tolist(), size[best].tolist(), doc_word[best].tolist(), item_word[best].tolist()))


def leaked_passages(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
                    length: int = 12, shard_words: int = 1_500_000, item_block: int = 5_000, items_held: int = 50_000, letters_held: int = 50_000_000) -> DataFrame:
    """The longest passage of at least length words that each document shares with each item.

    Result: doc_id, item_id, words, doc_word, item_word (word offsets). Words are maximal runs of letters and digits, lower-cased.
    The items are the stated query set: they reach the executors in parts of about items_held items of letters_held letters, a scan of all documents each.
    Null or blank texts, and items of fewer words, match nothing; repeated documents each give their own rows (equal ids collapse
    into one row each); other columns are ignored. A shard is closed after shard_words words, so memory does not grow with the input.
    """
    asked = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null")
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("letters")).first()
    rounds, found = max(1, -(-size["n"] // items_held), -(-size["letters"] // letters_held)), None
    source = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    for part in range(rounds):
        pairs = [(r[0], r[1]) for r in asked.where(f"pmod(xxhash64(i, t), {rounds}) = {part}").collect()]
        some = _scan(source, [pairs[i:i + item_block] for i in range(0, len(pairs), item_block)], length, shard_words)
        found = some if found is None else found.unionByName(some)
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("words", (-F.col("item_word")).alias("i"), (-F.col("doc_word")).alias("d"))).alias("m")).select(
        "doc_id", "item_id", "m.words", (-F.col("m.d")).alias("doc_word"), (-F.col("m.i")).alias("item_word"))


def _scan(source: DataFrame, blocks: list[list[tuple[int, str]]], length: int, shard_words: int) -> DataFrame:
    """Matches of bounded blocks of items in all documents."""
    schema = "doc_id long, item_id long, words int, doc_word int, item_word int"

    def scan(batches):
        indexes = [ItemBlock(b, length) for b in blocks]
        known: dict[str, int] = {}
        for index in indexes:
            for w in index.vocabulary:
                known.setdefault(w, len(known) + 1)
        # One numbering for all blocks, so that documents are split into words once.
        for index in indexes:
            to = np.array([0, *(known[w] for w in index.vocabulary)], np.int64)
            index.ids = np.where(index.ids > 0, to[np.maximum(index.ids, 0)], index.ids)
            index.patterns = to[index.patterns]
        get = known.get
        ids, docs, sizes = [], [], []

        def close():
            n = np.array(sizes, np.int64)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
            doc_of = np.repeat(np.array(docs, np.int64), n)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
            rows = [r for index in indexes for r in index.search(flat, doc_of, place)]
            ids.clear(), docs.clear(), sizes.clear()
            columns = list(zip(*rows)) if rows else [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.int32()) for c in columns[2:])], names=["doc_id", "item_id", "words", "doc_word", "item_word"])

        total = 0
        for batch in batches:
            for doc, body in zip(batch.column(0), batch.column(1)):
                found = [get(w, 0) for w in WORD.findall(body.as_py().lower())]
                if len(found) < length:
                    continue
                ids.append(np.array([*found, 0], np.int64))
                docs.append(doc.as_py())
                sizes.append(len(found) + 1)
                total += len(found)
                if total >= shard_words:
                    yield close()
                    total = 0
        yield close()

    return source.mapInArrow(scan, schema)


def decontaminated(documents: DataFrame, leaks: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """documents without those that leak; documents with a null id stay."""
    return documents.join(leaks.select(F.col("doc_id").alias(doc_id)).distinct(), doc_id, "left_anti")


def leak_report(items: DataFrame, leaks: DataFrame) -> DataFrame:
    """Per item: item_set, item_id, n_docs, longest passage in words (0 where none)."""
    per = leaks.groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("words").alias("longest"))
    return items.select("item_set", "item_id").distinct().join(per, "item_id", "left").na.fill(0, ["n_docs", "longest"])
