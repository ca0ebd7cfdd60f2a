"""Exact nearest neighbours for a stated set of query vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fitted(column: Column, dims: int) -> Column:
    """A vector cut or filled with zeros to dims components; one of that size is passed on as it is."""
    v = column.cast("array<float>")
    return F.when(F.size(v) == dims, v).otherwise(F.slice(F.concat(v, F.array_repeat(F.lit(0.0).cast("float"), dims)), 1, dims))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The values of a list column end to end, with the offsets and whether each row is there."""
    values = column.values.to_numpy(zero_copy_only=False)
    return values, column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)


def pack(vectors: DataFrame, column: str) -> DataFrame:
    """vectors with the column as float32 little-endian bytes; null stays null."""
    others = [c for c in vectors.columns if c != column]

    def run(batches):
        for batch in batches:
            values, at, there = _flat(batch.column(len(others)))
            held = pa.py_buffer(np.ascontiguousarray(values, "<f4").tobytes())
            offsets = pa.py_buffer((at * 4).astype(np.int32).tobytes())
            valid = pa.array(there).buffers()[1]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(others))), pa.Array.from_buffers(pa.binary(), len(there), [valid, offsets, held])], names=[*others, column])

    return vectors.select(*others, F.col(column).cast("array<float>")).mapInArrow(run, _schema(vectors, others, f"{column} binary"))


def unpack(vectors: DataFrame, column: str) -> DataFrame:
    """vectors with the packed column as arrays again."""
    others = [c for c in vectors.columns if c != column]

    def run(batches):
        for batch in batches:
            packed = batch.column(len(others))
            _, offsets, held = packed.buffers()
            at = np.frombuffer(offsets, np.int32)[packed.offset:packed.offset + len(packed) + 1]
            values = pa.array(np.frombuffer(held, "<f4", int(at[-1]) // 4) if held is not None and len(packed) else np.zeros(0, "<f4"))
            lists = pa.ListArray.from_arrays(pa.array((at // 4).astype(np.int32)), values, mask=packed.is_null())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(others))), lists], names=[*others, column])

    return vectors.select(*others, column).mapInArrow(run, _schema(vectors, others, f"{column} array<float>"))


def _schema(df: DataFrame, others: list[str], last: str) -> str:
    types = dict(df.dtypes)
    return ", ".join([*(f"`{c}` {types[c]}" for c in others), last])


def knn(queries: DataFrame, vectors: DataFrame, k: int, dims: int, qid: str = "qid", query_vec: str = "vec", doc: str = "doc", vec: str = "embedding", block: int = 1024, held: int = 20_000, task_rows: int = 100_000) -> DataFrame:
    """The k nearest documents of each query by Euclidean distance: qid, doc, distance, pos. Ties go to the smaller doc.

    The query set reaches the executors in parts of about held queries, a scan each; each task keeps the k best per query of all
    documents it reads and only these are shuffled. As every task hands on k rows a query, a scan has no more tasks than there are cores, or
    than are needed for about task_rows documents each. Vectors with a null or non-finite component, and null vectors, are left out;
    others are cut or filled to dims.
    """
    asked = queries.select(F.col(qid).cast("string").alias("q"), fitted(F.col(query_vec), dims).alias("v")).where(f"{query_vec} is not null")
    source = vectors.select(F.col(doc).cast("string").alias("doc"), fitted(F.col(vec), dims).alias("v")).where(f"doc is not null and {vec} is not null")
    rounds, found = max(1, -(-asked.count() // held)), None
    source = source.coalesce(max(vectors.sparkSession.sparkContext.defaultParallelism, -(-source.count() // task_rows)))
    for part in range(rounds):
        some = _scan(asked.where(f"pmod(xxhash64(q), {rounds}) = {part}").toArrow(), source, k, dims, block)
        found = some if found is None else found.unionByName(some)
    w = Window.partitionBy("q").orderBy("distance", "doc")
    return found.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k).select(F.col("q").cast(dict(queries.dtypes)[qid]).alias("qid"), F.col("doc").cast(dict(vectors.dtypes)[doc]).alias("doc"), "distance", "pos")


def _dense(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that hold dims finite components, and these as float64."""
    values, at, there = _flat(column)
    rows = np.flatnonzero(there & (np.diff(at) == dims))
    x = values[at[rows][:, None] + np.arange(dims)].astype(np.float64) if len(rows) else np.zeros((0, dims))
    ok = np.isfinite(x).all(axis=1)  # a null component comes as NaN
    return rows[ok], x[ok]


def _scan(rows: pa.Table, source: DataFrame, k: int, dims: int, block: int) -> DataFrame:
    """The k nearest in each task's share of source for a bounded table of queries."""
    kept = [(np.array(rows.column(0).chunk(i).to_pylist(), object), *_dense(rows.column(1).chunk(i), dims)) for i in range(rows.column(0).num_chunks)]
    names = [n for q, at, _ in kept for n in q[at]]
    x = np.concatenate([v for _, _, v in kept]) if kept else np.zeros((0, dims))

    def scan(batches):
        best = np.full((len(names), 0), np.inf)  # distances to the documents in who
        who = np.empty((len(names), 0), object)
        for batch in batches:
            at, y = _dense(batch.column(1), dims)
            if not len(at) or not names:
                continue
            docs = np.array(batch.column(0).to_pylist(), object)[at]
            by_name = np.argsort(docs, kind="stable")
            docs, y = docs[by_name], y[by_name]
            squares, m = (y * y).sum(axis=1), min(k, len(docs))
            new_best, new_who = [], []
            for a in range(0, len(names), block):
                q = x[a:a + block]
                near = squares - 2 * (q @ y.T)
                top = np.sort(np.argpartition(near, m - 1, axis=1)[:, :m], axis=1) if m < len(docs) else np.broadcast_to(np.arange(m), near.shape)
                edge = np.take_along_axis(near, top, 1).max(axis=1)
                for i in np.flatnonzero((near <= edge[:, None] + 1e-9).sum(axis=1) > m):  # a tie at the edge: the smaller names
                    top = np.array(top)
                    top[i] = np.argsort(near[i].round(9), kind="stable")[:m]
                d = np.empty(top.shape)
                for i in range(len(q)):
                    d[i] = np.sqrt(np.square(q[i] - y[top[i]]).sum(axis=1))
                every, each = np.concatenate([best[a:a + block], d], axis=1), np.concatenate([who[a:a + block], docs[top]], axis=1)
                if every.shape[1] > k:
                    order = np.stack([np.lexsort((each[i].astype(str), every[i]))[:k] for i in range(len(every))])
                    every, each = np.take_along_axis(every, order, 1), np.take_along_axis(each, order, 1)
                new_best.append(every), new_who.append(each)
            best, who = np.concatenate(new_best), np.concatenate(new_who)
        for a in range(0, len(names), block):
            b, w = best[a:a + block], who[a:a + block]
            if b.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(names[a:a + block], object), b.shape[1]).tolist(), pa.string()), pa.array(w.ravel().tolist(), pa.string()), pa.array(b.ravel())], names=["q", "doc", "distance"])

    return source.mapInArrow(scan, "q string, doc string, distance double")


def rrf(left: DataFrame, right: DataFrame, keys: list[str], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (keys, pos): keys, left_pos, right_pos, rrf."""
    a, b = left.select(*keys, F.col("pos").alias("left_pos")), right.select(*keys, F.col("pos").alias("right_pos"))
    return a.join(b, keys, "full_outer").withColumn("rrf", F.coalesce(1.0 / (k + F.col("left_pos")), F.lit(0.0)) + F.coalesce(1.0 / (k + F.col("right_pos")), F.lit(0.0)))
