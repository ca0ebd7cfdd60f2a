"""The most similar vectors for every vector: robust-pruned graphs on shards, with beam search.

Centroids are fitted on bounded samples, in two levels where there are many; every vector is a member of its nearest cell. When a
cell's graph is finished, it is searched by its own members and by vectors for which the cell's centroid is almost as near as their
own (at most probes cells each). Cells half as large again as shard_rows are split by a hash of the vector and every query of the
cell searches all its parts, so no link is lost to a split; parts with many visitors are built several times, each for a share of
the visitors. Copies of a vector are one node.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinderlode.core import stage
from cinderlode.llm.graph import Graph


def usable(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column that hold dims finite components, not all zero, and these vectors at length one."""
    if not len(column):
        return np.zeros(0, np.int64), np.zeros((0, dims), np.float32)
    sizes = np.diff(column.offsets.to_numpy())
    ok = (sizes == dims) & column.is_valid().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(ok)
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    x = flat[column.offsets.to_numpy()[rows][:, None] + np.arange(dims)]
    if column.values.null_count:  # a null component
        x = np.where(column.values.is_valid().to_numpy(zero_copy_only=False)[column.offsets.to_numpy()[rows][:, None] + np.arange(dims)], x, np.nan)
    with np.errstate(all="ignore"):
        top = np.abs(x).max(axis=1, initial=0)
        fine = np.isfinite(top) & (top > 0) & np.isfinite(x).all(axis=1)
        rows, x, top = rows[fine], x[fine], top[fine]
        x = x / top[:, None]  # neither overflow nor underflow of the squares
    return rows, (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def digests(x: np.ndarray) -> list[bytes]:
    x = x + np.float32(0)  # -0 and 0 are one
    return [hashlib.blake2b(row.tobytes(), digest_size=12).digest() for row in x]


def centroids(sample: np.ndarray, cells: int, rounds: int = 10, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    if not len(sample):
        return np.zeros((1, sample.shape[1]), np.float32)
    c = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        near = (sample @ c.T).argmax(axis=1)
        count = np.bincount(near, minlength=len(c))
        sums = np.zeros(c.shape, np.float32)
        np.add.at(sums, near, sample)
        sums[count == 0] = sample[rng.choice(len(sample), int((count == 0).sum()))]
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-20), c).astype(np.float32)
    return c


class Cells:
    """Centroids of one or two levels. children: for each first centroid the second ones below it, numbered through; none with one level."""

    def __init__(self, first: np.ndarray, children: list[np.ndarray] | None = None):
        self.first, self.children = first, children
        self.base = np.cumsum([0, *(len(c) for c in children)]) if children else None

    def of(self, x: np.ndarray, probes: int, margin: float) -> np.ndarray:
        """Cells each vector searches, its own first, -1 where fewer."""
        near = x @ self.first.T
        top = np.argsort(-near, axis=1)[:, :probes]
        sims = np.take_along_axis(near, top, 1)
        if self.children:
            above = top
            top, sims = np.full((len(x), probes), -1, np.int64), np.full((len(x), probes), -np.inf, np.float32)
            for g in np.unique(above):
                rows = np.flatnonzero((above == g).any(axis=1))
                near = np.concatenate([sims[rows], x[rows] @ self.children[g].T], axis=1)
                ids = np.concatenate([top[rows], np.broadcast_to(self.base[g] + np.arange(len(self.children[g])), (len(rows), len(self.children[g])))], axis=1)
                best = np.argsort(-near, axis=1)[:, :probes]
                top[rows], sims[rows] = np.take_along_axis(ids, best, 1), np.take_along_axis(near, best, 1)
        return np.where(sims >= sims[:, :1] - margin, top, -1)


def fitted_cells(source: DataFrame, n: int, dims: int, shard_rows: int, sample_rows: int, fan: int) -> Cells:
    """About n / shard_rows cells, fitted on samples of at most sample_rows vectors; two levels where there are more than fan.

    The second level is fitted below each first centroid by a task of its own, on a sample of that cell. At most fan * fan
    centroids reach the driver and the tasks (100 MB for fan 256 and 384 components).
    """
    sample = source.select("embedding").sample(min(1.0, 1.1 * sample_rows / max(1, n)), 11).limit(sample_rows).toArrow().column(0)
    s = np.concatenate([usable(c, dims)[1] for c in sample.chunks] or [np.zeros((0, dims), np.float32)])
    cells = max(1, min(-(-n // shard_rows), fan * fan, max(len(s), 1) // 8 if n <= sample_rows else n // 8))
    if cells <= fan:
        return Cells(centroids(s, cells))
    first = centroids(s, min(fan, -(-len(s) // 8), int(cells ** 0.5) + 1))
    share = np.bincount((s @ first.T).argmax(axis=1), minlength=len(first)) / max(1, len(s))
    below = np.clip(np.round(cells * share), 1, fan * fan // len(first)).astype(int)
    chance = np.minimum(1.0, np.minimum(64 * below, sample_rows) / np.maximum(1.0, n * share))

    def draw(batches):
        for number, batch in enumerate(batches):
            _, x = usable(batch.column(0), dims)
            cell = (x @ first.T).argmax(axis=1)
            told = np.array([int.from_bytes(h[:6], "big") for h in digests(x)], np.float64) / 2.0 ** 48  # a vector's draw is its digest
            kept = np.flatnonzero(told < chance[cell])
            yield pa.RecordBatch.from_arrays([pa.array(cell[kept].astype(np.int32)), pa.array([x[i].tobytes() for i in kept], pa.binary())], names=["cell", "vec"])

    def fit(table: pa.Table) -> pa.Table:
        g = int(table.column("cell")[0].as_py())
        x = np.frombuffer(b"".join(table.column("vec").to_pylist()), np.float32).reshape(-1, dims)[:2 * sample_rows]
        c = centroids(x, int(min(below[g], -(-len(x) // 4))))
        return pa.table({"cell": pa.array([g] * len(c), pa.int32()), "vec": pa.array([row.tobytes() for row in c], pa.binary())})

    children = [first[g:g + 1] for g in range(len(first))]  # a cell whose sample is empty stands for itself
    held: dict[int, list[bytes]] = {}
    for r in source.select("embedding").mapInArrow(draw, "cell int, vec binary").groupBy("cell").applyInArrow(fit, "cell int, vec binary").collect():  # at most fan * fan rows
        held.setdefault(r["cell"], []).append(bytes(r["vec"]))
    for g, rows in held.items():
        children[g] = np.frombuffer(b"".join(sorted(rows)), np.float32).reshape(-1, dims)
    return Cells(first, children)


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    return np.concatenate([np.frombuffer(b"".join(c.to_pylist()), np.float32) for c in column.chunks] or [np.zeros(0, np.float32)]).reshape(-1, dims)


def _neighbours(table: pa.Table, k: int, beam: int, degree: int, build_beam: int, alpha: float, dims: int) -> pa.Table:
    """Links (h, nh, sim) that one shard gives: its graph is searched by its members and by its visitors."""
    h, role, x = np.array(table.column("h").to_pylist(), dtype="S12"), table.column("role").to_numpy(), _matrix(table.column("vec"), dims)
    member, seeker = np.flatnonzero(role != 1), np.flatnonzero(role == 1)
    member, seeker = (rows[np.unique(h[rows], return_index=True)[1]] for rows in (member, seeker))
    found = []
    if len(member):
        graph = Graph(np.ascontiguousarray(x[member]), degree, build_beam, alpha)
        seeks = [(seeker, None)] if len(seeker) else []
        if (role[member] == 0).any() and len(member) > 1:
            seeks.append((member, np.arange(len(member), dtype=np.int32)))
        for who, among in seeks:
            ids, sims = graph.search(x[who], beam, among=among)
            ids, sims = ids[:, :2 * k + 1], sims[:, :2 * k + 1]
            a, b, s = np.repeat(who, ids.shape[1]), member[np.maximum(ids, 0)].ravel(), sims.ravel()
            ok = (ids.ravel() >= 0) & (a != b) & (h[a] != h[b])
            found += [(a[ok], b[ok], s[ok]), (b[ok], a[ok], s[ok])]
    if not found:
        return pa.table({"h": pa.array([], pa.binary()), "nh": pa.array([], pa.binary()), "sim": pa.array([], pa.float64())})
    a, b, s = (np.concatenate(v) for v in zip(*found))
    order = np.lexsort((b, -s, a))
    a, b = a[order], b[order]
    keep = np.ones(len(a), bool)
    keep[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    a, b = a[keep], b[keep]
    start = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    rank = np.arange(len(a)) - np.repeat(start, np.diff(np.concatenate([start, [len(a)]])))
    a, b = a[rank < k], b[rank < k]
    exact = np.empty(len(a))
    for at in range(0, len(a), 8192):
        p = slice(at, at + 8192)
        exact[p] = np.einsum("nd,nd->n", x[a[p]].astype(np.float64), x[b[p]].astype(np.float64))
    digest = np.array(table.column("h").to_pylist(), dtype=object)
    return pa.table({"h": pa.array(digest[a].tolist(), pa.binary()), "nh": pa.array(digest[b].tolist(), pa.binary()), "sim": pa.array(exact, pa.float64())})


def nearest(
    vectors: DataFrame, key: str, embedding: str, k: int = 10, dims: int = 384, least_sim: float | None = None, shard_rows: int = 25_000, sample_rows: int = 20_000, fan: int = 256,
    probes: int = 3, margin: float = 0.1, degree: int = 16, build_beam: int = 40, beam: int = 48, alpha: float = 1.2, visitors: int = 50_000,
) -> DataFrame:
    """For every usable vector its k most similar others: key, neighbour, sim (cosine), rank from 1.

    Usable are embeddings of dims finite components that are not all zero; others, and rows with a null key, are left out and are
    nobody's neighbour. Ties are ordered by the neighbour's key; rows delivered again under one key count once, a key with several
    vectors stands for each of them and keeps the nearest k of all. least_sim drops pairs below it after ranking. Centroids are
    fitted on samples of at most sample_rows vectors a level; every vector is indexed and searched.
    """
    source = vectors.select(F.col(key).cast("string").alias("key"), F.col(embedding).cast("array<float>").alias("embedding")).where("key is not null and embedding is not null")
    tree = fitted_cells(source, vectors.count(), dims, shard_rows, sample_rows, fan)

    def name(batches):
        for batch in batches:
            rows, x = usable(batch.column(1), dims)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(digests(x), pa.binary()), pa.array(tree.of(x, probes, margin).tolist(), pa.list_(pa.int32()))], names=["key", "h", "cells"])

    named = stage(source.mapInArrow(name, "key string, h binary, cells array<int>"))
    distinct = named.select("h", "cells").dropDuplicates(["h"])
    load = {r["cell"]: r for r in distinct.select(F.posexplode("cells").alias("p", "cell")).where("cell >= 0").groupBy("cell").agg(F.sum((F.col("p") == 0).cast("long")).alias("own"), F.sum((F.col("p") > 0).cast("long")).alias("guests")).collect()}
    # One row a cell. parts: splits of a cell; copies: times each part is built, for shares of its visitors.
    parts = {cell: max(1, -(-r["own"] // (shard_rows + shard_rows // 2))) for cell, r in load.items()}
    copies = {cell: max(1, -(-(r["guests"] + (r["own"] if parts[cell] > 1 else 0)) // visitors)) for cell, r in load.items()}
    base, total = {}, 0
    for cell in sorted(load):
        base[cell], total = total, total + parts[cell] * copies[cell]

    def send(batches):
        for batch in batches:
            rows, x = usable(batch.column(1), dims)
            hs = digests(x)
            once = list({h: i for i, h in enumerate(hs)}.values())
            to, role, who = [], [], []
            for i, cells in zip(once, tree.of(x[once], probes, margin).tolist()):
                number = int.from_bytes(hs[i][:6], "big")
                for place, cell in enumerate(cells):
                    if cell < 0 or cell not in base:
                        continue
                    for part in range(parts[cell]):
                        own = place == 0 and part == number % parts[cell]
                        at = base[cell] + part * copies[cell]
                        for r in range(copies[cell]) if own else [(number >> 16) % copies[cell]]:
                            to.append(at + r), role.append((0 if r == 0 else 2) if own else 1), who.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(role, pa.int32()), pa.array([hs[i] for i in who], pa.binary()), pa.array([x[i].tobytes() for i in who], pa.binary())], names=["task", "role", "h", "vec"])

    def shard(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        held.clear()
        for task in np.unique(rows.column("task").to_numpy()):  # one a partition
            one = rows.filter(pc.equal(rows.column("task"), int(task)))
            yield from _neighbours(one, k, beam, degree, build_beam, alpha, dims).to_batches(max_chunksize=100_000)

    links = source.mapInArrow(send, "task int, role int, h binary, vec binary").repartitionById(max(1, total), F.col("task")).mapInArrow(shard, "h binary, nh binary, sim double")
    if least_sim is not None:
        # Neighbours below least_sim never count and never displace a nearer one.
        links = links.where(F.col("sim") >= least_sim)
    best = Window.partitionBy("h").orderBy(F.desc("sim"), "nh")
    near = links.groupBy("h", "nh").agg(F.max("sim").alias("sim")).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)
    # Copies: the other members of a node come first, then the members of its neighbours.
    size = named.groupBy("h").agg(F.countDistinct("key").alias("n"))
    few = named.select("h", "key").distinct().withColumn("m", F.row_number().over(Window.partitionBy("h").orderBy("key"))).where(F.col("m") <= k + 1)
    ahead = Window.partitionBy("h").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    own = size.where("n > 1").select("h", F.col("h").alias("nh"), F.lit(1.0).alias("sim"), F.lit(0).alias("r"))
    reach = (
        near.join(size.select(F.col("h").alias("nh"), F.col("n").alias("nn")), "nh").unionByName(own.join(size.select("h", (F.col("n") - 1).alias("nn")), "h"))
        .withColumn("left", k - F.coalesce(F.sum("nn").over(ahead), F.lit(0))).where("left > 0")
    )
    pairs = (
        reach.join(few.select(F.col("h").alias("nh"), F.col("key").alias("neighbour"), "m"), "nh").where(F.col("m") <= F.col("left") + (F.col("r") == 0).cast("int"))
        .join(named.select("h", "key").distinct(), "h").where("key <> neighbour")
    )
    w = Window.partitionBy("key").orderBy(F.desc("sim"), "neighbour")
    return pairs.groupBy("key", "neighbour").agg(F.max("sim").alias("sim")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("key", "neighbour", "sim", "rank")


def recall(vectors: DataFrame, key: str, embedding: str, found: DataFrame, k: int = 10, dims: int = 384, share: int = 20, block: int = 2000) -> DataFrame:
    """Recall of found (key, neighbour) against brute force, for every share-th vector by a hash of its key: n_queries, k, recall.

    The queries are searched against all rows in blocks of at most block; a neighbour as similar as the k-th (to 1e-6) counts as right.
    """
    source = vectors.select(F.col(key).cast("string").alias("key"), F.col(embedding).cast("array<float>").alias("embedding")).where("key is not null and embedding is not null")
    asked = source.where(f"pmod(xxhash64(key), {share}) = 0").dropDuplicates(["key"])
    bars = []
    for part in range(max(1, -(-asked.count() // block))):
        blocks = max(1, -(-asked.count() // block))
        table = asked.where(f"pmod(xxhash64(key, 5), {blocks}) = {part}").toArrow()
        keys, rows = table.column(0).to_pylist(), [usable(ch, dims) for ch in table.column(1).chunks]
        if not any(len(r[0]) for r in rows):
            continue
        shift = np.cumsum([0, *(len(ch) for ch in table.column(1).chunks)])
        names = [keys[int(i) + int(sh)] for (r, _), sh in zip(rows, shift) for i in r]
        q = np.concatenate([x for _, x in rows])

        def scan(batches, names=names, q=q):
            for batch in batches:
                r, x = usable(batch.column(1), dims)
                if not len(r):
                    continue
                own = batch.column(0).take(pa.array(r)).to_pylist()
                sims = q @ x.T
                at = {n: i for i, n in enumerate(names)}
                for j, o in enumerate(own):
                    if o in at:
                        sims[at[o], j] = -2
                m = min(k, len(r))
                top = np.argpartition(-sims, m - 1, axis=1)[:, :m]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(names, object), m).tolist()), pa.array(np.take_along_axis(sims, top, 1).ravel().astype(np.float64))], names=["key", "sim"])

        bars.append(source.mapInArrow(scan, "key string, sim double").withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("sim")))).where(F.col("r") <= k).groupBy("key").agg(F.min("sim").alias("bar"), F.count("*").alias("n")))
    if not bars:
        return vectors.sparkSession.createDataFrame([], "n_queries long, k int, recall double")
    bar = bars[0]
    for b in bars[1:]:
        bar = bar.unionByName(b)
    hits = found.join(bar, "key").groupBy("key").agg(F.sum((F.col("sim") >= F.col("bar") - 1e-6).cast("int")).alias("hit"))
    return bar.join(hits, "key", "left").agg(F.count("*").alias("n_queries"), F.lit(k).alias("k"), F.round(F.sum(F.least(F.coalesce("hit", F.lit(0)), F.col("n"))) / F.sum("n"), 4).alias("recall"))
