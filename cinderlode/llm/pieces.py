"""Oversized texts cut into pieces at natural boundaries.

Dynamic programming over boundary positions: a cut costs by its kind (paragraph, line, sentence, word, inside a word), a piece by
how far its size is from an even share; the cheapest sequence of cuts whose pieces stay within the limit is taken.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlode.llm.tokens import VOCABULARY, encoding, token_bytes

#: Cost of a cut by the kind of boundary.
PENALTY = {"paragraph": 0.0, "line": 1.0, "sentence": 2.0, "word": 6.0, "inside": 25.0}
KINDS = list(PENALTY)


def boundary_kinds(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The kind (index in KINDS) of the boundary after each token that ends at byte ends; -1 inside a character."""
    size = len(raw)
    padded = np.concatenate([np.zeros(4, np.uint8), raw, np.zeros(2, np.uint8)]).astype(np.int32)
    at = ends + 4
    p1, p2, p3, n1, n2 = padded[at - 1], padded[at - 2], padded[at - 3], padded[at], padded[at + 1]

    def white(x):
        return (x == 32) | (x == 10) | (x == 9) | (x == 13)

    def stop(x):
        return (x == 46) | (x == 33) | (x == 63)

    closer = (p1 == 34) | (p1 == 39) | (p1 == 41) | (p1 == 93)
    ideographic = ((p3 == 0xE3) & (p2 == 0x80) & (p1 == 0x82)) | ((p3 == 0xEF) & (p2 == 0xBC) & ((p1 == 0x81) | (p1 == 0x9F)))
    kind = np.full(len(ends), KINDS.index("inside"), np.int64)
    kind[white(n1) | white(p1)] = KINDS.index("word")
    kind[ideographic | (white(n1) & (stop(p1) | (closer & stop(p2)))) | ((p1 == 32) & stop(p2))] = KINDS.index("sentence")
    kind[(n1 == 10) | (p1 == 10)] = KINDS.index("line")
    kind[((n1 == 10) & (n2 == 10)) | ((p1 == 10) & (n1 == 10)) | ((p1 == 10) & (p2 == 10))] = KINDS.index("paragraph")
    kind[(ends < size) & ((n1 & 0xC0) == 0x80)] = -1
    return kind


def cuts(kinds: np.ndarray, limit: int, overlap: int, piece_cost: float = 4.0, balance: float = 20.0) -> np.ndarray:
    """Token positions of the cuts, from 0 to the number of tokens; the span of a piece is at most limit - overlap - 3 new tokens.

    Every boundary is a candidate. The costs of two piece beginnings differ by a linear function of where the piece ends, so from
    some end on the later one is never worse; a queue holds the beginnings that are still the cheapest for some end to come, each
    with the end from which it is, so the minimum is exact. 3 tokens are held back to start on a whole character.
    """
    total, room = len(kinds), limit - overlap - 3
    if room < 1:
        raise ValueError("the limit must exceed the overlap by more than 3 tokens")
    places = np.flatnonzero(kinds[: total - 1] >= 0) + 1
    best = np.array([PENALTY[k] for k in KINDS])[kinds[places - 1]] + piece_cost
    places, best = [*places.tolist(), total], [*best.tolist(), piece_cost]
    share = total / max(1, -(-total // room))
    scale = balance / (share * share)
    back = {}
    begins, costs, since = [0], [0.0], [0.0]
    head = 0
    for x, c in zip(places, best):
        while head + 1 < len(begins) and since[head + 1] <= x:
            head += 1
        p = begins[head]
        if x - p > room:
            continue
        off = x - p - share
        r = costs[head] + scale * off * off + c
        back[x] = p
        # A beginning gives way to this one where their costs cross, or where it falls out of reach.
        while True:
            q = begins[-1]
            start = min(share + 0.5 * (q + x) - (costs[-1] - r) / (2.0 * scale * (x - q)), q + room + 1)
            if len(begins) - head < 2 or start > since[-1]:
                break
            begins.pop(), costs.pop(), since.pop()
        begins.append(x), costs.append(r), since.append(start)
    if total not in back:  # no character boundary within reach; cannot happen with whole characters of at most 4 tokens and room of 8
        raise ValueError("no admissible sequence of cuts")
    path = [total]
    while path[-1]:
        path.append(back[path[-1]])
    return np.array(path[::-1])


def split_text(body: str, max_tokens: int, overlap: int, path: str = VOCABULARY) -> list[tuple[int, int, int, int]]:
    """Pieces (start_token, end_token, start_byte, end_byte) of a text above the limit; none for a text within it."""
    raw = body.encode("utf-8", "replace")
    if len(raw) <= max_tokens:  # a token holds a byte at least
        return []
    ids = encoding(path).encode_ordinary(body)
    if len(ids) <= max_tokens:
        return []
    ends = np.cumsum(token_bytes(path)[np.array(ids)])
    kinds = boundary_kinds(np.frombuffer(raw, np.uint8), ends)
    places = cuts(kinds, max_tokens, overlap)
    whole = np.concatenate([[True], kinds >= 0])
    offsets = np.concatenate([[0], ends])
    out = []
    for a, b in zip(places[:-1].tolist(), places[1:].tolist()):
        start = max(0, a - overlap) if a else 0
        while not whole[start]:
            start -= 1
        out.append((start, b, int(offsets[start]), int(offsets[b])))
    return out


def split_documents(documents: DataFrame, limits: list[tuple[str, int, int]], doc_id: str = "doc_id", text: str = "text", with_text: bool = True, path: str = VOCABULARY) -> DataFrame:
    """Ordered pieces of every text above each limit (limit_name, max_tokens, overlap_tokens).

    Result: doc_id, limit_name, piece_no (from 1), n_pieces, start_token, end_token and, unless with_text is false, text. Sizes are
    tokens of the text's own encoding; piece_no > 1 begins overlap_tokens before the end of the piece before, or up to 3 tokens
    earlier where that is inside a character. Texts within a limit, blank or null ones, and null ids give no piece; repeated
    rows are split each by itself. The pieces, joined without their overlaps, are the text.
    """
    schema = "doc_id long, limit_name string, piece_no int, n_pieces int, start_token int, end_token int" + (", text string" if with_text else "")
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]

    def run(batches):
        for batch in batches:
            columns = [[] for _ in names]
            held = 0
            for doc, body in zip(batch.column(0), batch.column(1)):
                body = body.as_py()
                raw = body.encode("utf-8", "replace") if with_text else b""
                for name, most, overlap in limits:
                    found = split_text(body, most, overlap, path)
                    for no, (a, b, x, y) in enumerate(found, 1):
                        row = (doc.as_py(), name, no, len(found), a, b, *([raw[x:y].decode()] if with_text else []))
                        for c, v in zip(columns, row):
                            c.append(v)
                        held += y - x if with_text else 50
                if held > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
                    columns, held = [[] for _ in names], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    least = min((most for _, most, _ in limits), default=2**31 - 1)
    source = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(f"doc_id is not null and octet_length(text) > {least}")
    return source.mapInArrow(run, schema)


def limits_of(piece_limits: DataFrame, most: int = 1000) -> list[tuple[str, int, int]]:
    """The limits as a list; a table of settings, checked to have no more than most rows."""
    rows = piece_limits.select("limit_name", "max_tokens", "overlap_tokens").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many limits")
    return sorted((r[0], r[1], r[2]) for r in rows)
