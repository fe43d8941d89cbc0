"""Exact top-k inner products: items by descending length, SVD-rotated partial sums, Cauchy-Schwarz bounds."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, materialize
from .vectors import matrix, valid

EPS = 2e-9


def rotation(v: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of the items, largest singular value first, from their summed outer products."""

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for b in batches:
            if b.num_rows:
                x = matrix(b["embedding"])
                total += x.T @ x
        at = np.arange(dim * dim, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel())], ["at", "v"])

    sums = v.select("embedding").mapInArrow(outer, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    gram = np.zeros(dim * dim)
    for r in sums:
        gram[r["at"]] = r["v"]
    return np.linalg.eigh(gram.reshape(dim, dim))[1][:, ::-1].copy()


def top_k(table: DataFrame, k: int = 10, asked: DataFrame | None = None, heads: tuple[int, ...] | None = None, block: int = 4096, queries: int = 1024) -> DataFrame:
    """(vec_id, rank, neighbor_id, score): for every row of asked, its k items of largest inner product among the other vec_ids of
    table. asked has vec_id and embedding; unless given, it is the table itself.

    Score is the inner product in double precision rounded to 9 digits; equal scores rank by the smaller neighbor_id. Exact: items
    are read by descending length, and a query stops when its length times the item's falls below its k-th score; of the
    items before that, those whose product over the first rotated coordinates plus the product of the residual
    lengths stays below it are skipped, in steps of more and more coordinates while few are left (heads: an eighth, a quarter and a half of them unless given).

    Rows that `valid` leaves out (null ids or vectors, null or non-finite elements, lengths other than the table's commonest) are neither
    queries nor items. A row that repeats is a query each time, and counts as an item each time. Fewer than k others give fewer rows; an
    empty table gives none, nor do no queries.

    Scale: items lie once in the shared folder in blocks of `block` rows, already rotated and with their residual lengths; a task holds
    `queries` queries and one block, and nothing is broadcast. Each task reads the blocks up to where the bound stops it.
    """
    spark = table.sparkSession
    v = valid(table)
    schema = "vec_id long, rank int, neighbor_id long, score double"
    one = v.first()
    if not one:
        return spark.createDataFrame([], schema)
    dim = len(one["embedding"])
    asked = v if asked is None else valid(asked, dim)
    turn, steps = rotation(v, dim), heads or tuple(sorted({max(1, dim // n) for n in (8, 4, 2)}))
    path = fresh_path(spark, "items")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path if "://" in path else "file://" + path)
        fs.create_dir(root, recursive=True)
        held_id, held_x, n = [], [], 0

        def flush(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.npz"
            out = io.BytesIO()
            x64 = x.astype(np.float64)
            r = x64 @ turn
            np.savez(out, ids=ids, x=x, r=r[:, : steps[-1]], rest=np.stack([np.sqrt((r[:, h:] ** 2).sum(1)) for h in steps]), norm=np.sqrt((x64**2).sum(1)))
            with fs.open_output_stream(f"{root}/{name}") as f:
                f.write(out.getvalue())
            return pa.RecordBatch.from_arrays([pa.array([float(np.sqrt((x.astype(np.float64) ** 2).sum(1)).max())]), pa.array([name])], ["norm", "file"])

        for b in batches:
            held_id.append(b["vec_id"].to_numpy())
            held_x.append(matrix(b["embedding"], np.float32) if b.num_rows else np.zeros((0, dim), np.float32))
            n += b.num_rows
            if n >= block:
                ids, x = np.concatenate(held_id), np.concatenate(held_x)
                for a in range(0, n - n % block, block):
                    yield flush(ids[a : a + block], x[a : a + block])
                held_id, held_x, n = [ids[n - n % block :]], [x[n - n % block :]], n % block
        if n:
            yield flush(np.concatenate(held_id), np.concatenate(held_x))

    length = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    items = v.withColumn("_n", length).repartitionByRange(F.desc("_n"), "vec_id").sortWithinPartitions(F.desc("_n"), "vec_id").drop("_n")
    listing = materialize(items.mapInArrow(put, "norm double, file string"), "item-blocks").inputFiles()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds

        fs, root = pafs.FileSystem.from_uri(path if "://" in path else "file://" + path)
        lfs, _ = pafs.FileSystem.from_uri(listing[0] if "://" in listing[0] else "file://" + listing[0])
        order = ds.dataset([pafs.FileSystem.from_uri(f if "://" in f else "file://" + f)[1] for f in listing], filesystem=lfs, format="parquet").to_table()
        order = order.sort_by([("norm", "descending"), ("file", "ascending")])
        blocks = list(zip(order["norm"].to_pylist(), order["file"].to_pylist(), strict=True))

        def answer(qid: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
            search_ = _Search(qid, q, k, turn, steps)
            for norm, name in blocks:
                if not search_.open(norm):
                    break
                with fs.open_input_file(f"{root}/{name}") as f:
                    z = np.load(io.BytesIO(f.read()))
                search_.block(z["ids"], z["x"].astype(np.float64), z["r"], z["rest"], z["norm"])
            return search_.result()

        held_id, held_q, n = [], [], 0
        for b in batches:
            if b.num_rows:
                held_id.append(b["vec_id"].to_numpy())
                held_q.append(matrix(b["embedding"]))
                n += b.num_rows
            if n >= queries:
                ids, q = np.concatenate(held_id), np.concatenate(held_q)
                for a in range(0, n, queries):
                    yield answer(ids[a : a + queries], q[a : a + queries])
                held_id, held_q, n = [], [], 0
        if n:
            yield answer(np.concatenate(held_id), np.concatenate(held_q))

    return asked.mapInArrow(search, schema)


class _Search:
    def __init__(self, qid: np.ndarray, q: np.ndarray, k: int, turn: np.ndarray, steps: tuple[int, ...]):
        self.qid, self.q, self.k, self.steps = qid, q, k, steps
        self.r = q @ turn
        self.rest = np.stack([np.sqrt((self.r[:, h:] ** 2).sum(1)) for h in steps])
        self.norm = np.sqrt((q * q).sum(1))
        self.low = np.full(len(q), -np.inf)
        self.row, self.nid, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def open(self, norm: float) -> bool:
        self.live = np.flatnonzero(self.norm * norm * (1 + 1e-12) >= self.low - EPS)
        return len(self.live) > 0

    def block(self, ids: np.ndarray, x: np.ndarray, r: np.ndarray, rest: np.ndarray, norm: np.ndarray) -> None:
        live, low = self.live, self.low[self.live]
        slack = EPS + 1e-12 * self.norm[live] * norm.max()
        first = np.isneginf(low).any()
        if not first:
            h = self.steps[0]
            part = self.r[live, :h] @ r[:, :h].T
            maybe = part + self.rest[0][live][:, None] * rest[0][None, :] >= (low - slack)[:, None]
        if first or np.count_nonzero(maybe) > 0.05 * maybe.size:  # where many are left, one product of all is cheaper than steps for each
            full = self.q[live] @ x.T
            if first:  # the block's own k-th best, leaving room for the query itself among its items
                own = np.where(self.qid[live][:, None] == ids[None, :], -np.inf, full)
                if own.shape[1] >= self.k:
                    low = np.maximum(low, np.partition(own, own.shape[1] - self.k, axis=1)[:, own.shape[1] - self.k])
            a, b = np.nonzero(full >= (low - slack)[:, None])
        else:
            a, b = np.nonzero(maybe)
            part = part[a, b]
            for n, (h, g) in enumerate(zip(self.steps, self.steps[1:]), 1):
                part = part + self._dots(self.r[live, h:g], r[:, h:g], a, b)
                on = part + self.rest[n][live[a]] * rest[n][b] >= (low - slack)[a]
                a, b, part = a[on], b[on], part[on]
        a = live[a]
        other = self.qid[a] != ids[b]
        a, b = a[other], b[other]
        score = np.round(self._dots(self.q, x, a, b), 9)
        row, nid, score = np.concatenate([self.row, a]), np.concatenate([self.nid, ids[b]]), np.concatenate([self.score, score])
        by = np.lexsort((nid, -score, row))
        row, nid, score = row[by], nid[by], score[by]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < self.k
        self.row, self.nid, self.score, self.rank = row[keep], nid[keep], score[keep], rank[keep]
        last = self.rank == self.k - 1
        self.low[self.row[last]] = self.score[last]

    @staticmethod
    def _dots(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, most: int = 1 << 16) -> np.ndarray:
        """Inner products of the rows a of x and b of y."""
        return np.concatenate([np.einsum("ij,ij->i", x[a[s : s + most]], y[b[s : s + most]]) for s in range(0, len(a), most)] or [np.zeros(0)])

    def result(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.qid[self.row]), pa.array((self.rank + 1).astype(np.int32)), pa.array(self.nid), pa.array(self.score)], ["vec_id", "rank", "neighbor_id", "score"])


EVERY = 20


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours among all rows of every row whose vec_id is divisible by EVERY."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(table, asked=table.where(F.col("vec_id") % EVERY == 0))


SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
s AS (SELECT a.vec_id, b.vec_id AS neighbor_id, round(list_inner_product(a.e, b.e), 9) AS score FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id != b.vec_id)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, neighbor_id, score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, neighbor_id) AS rank FROM s) WHERE rank <= 10
"""
