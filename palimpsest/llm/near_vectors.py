"""Near-duplicate embeddings: sign hashing by random hyperplanes, exact cosines, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import chunked, materialize, pairs_within, whole_groups
from .components import components, labels_of
from .vectors import matrix, valid


def plan(rows: int, threshold: float, recall: float) -> tuple[int, int]:
    """Bits a table and tables: buckets hold about four unrelated vectors, and a pair at the threshold shares one with `recall`."""
    bits = min(30, max(8, math.ceil(math.log2(max(rows, 2))) - 2))
    same = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log1p(-min(same, 1 - 1e-9))))


def near_duplicates(table: DataFrame, threshold: float = 0.95, recall: float = 0.97, seed: int = 5, chunk: int = 2048) -> DataFrame:
    """(vec_id, component): vectors linked by cosine >= threshold, directly or through others; component is the least vec_id.

    Every valid vec_id has one row; one without near copies is its own component. Equal vectors are linked at once and
    searched as one. Pairs that share a bucket in some table are candidates; those whose sign codes differ in far more bits than pairs at
    the threshold do (by four standard deviations) are dropped, and the components of the rest are compared by exact
    cosine, all pairs of each. `recall` is the chance that a pair exactly at the threshold becomes a candidate directly.

    Left out: null ids, null, empty, zero or non-finite vectors, vectors with null elements or of another
    length than most. Rows that repeat an id are one vertex. Other columns are not read. An empty table gives no rows.

    Scale: shuffles are one key per vector and table; the sign codes of a vector once for each of its buckets that hold others too, of which
    there are as many as `plan` keeps unrelated vectors a bucket; then each vector of a candidate component once. A bucket or
    component of any size is compared in chunks of `chunk` rows in parallel, and only a spanning forest of its edges is kept.
    """
    v = valid(table).where(F.exists("embedding", lambda x: x != 0))
    same = W.partitionBy("embedding").orderBy("vec_id")
    v = v.withColumn("rep", F.first("vec_id").over(same)).withColumn("lead", F.row_number().over(same) == 1)
    v = materialize(v.select("vec_id", "rep", F.when(F.col("lead"), F.col("embedding")).alias("embedding")), "vectors")
    reps = v.where("embedding is not null").select(F.col("vec_id").alias("id"), "embedding")
    bits, tables = plan(reps.count(), threshold, recall)
    first = reps.first()
    dim = len(first["embedding"]) if first else 1
    planes = np.random.default_rng(seed).standard_normal((dim, tables * bits)).astype(np.float32)
    weights = (1 << np.arange(bits, dtype=np.uint32))[None, None, :]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                on = (matrix(b["embedding"], np.float32) @ planes > 0).reshape(b.num_rows, tables, bits)
                code = (on * weights).sum(2, dtype=np.uint32)
                yield pa.RecordBatch.from_arrays([b["id"], pa.array([c.tobytes() for c in code], pa.binary())], ["id", "code"])

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                code = np.frombuffer(b"".join(b["code"].to_pylist()), np.uint32).reshape(-1, tables)
                key = (np.arange(tables, dtype=np.int64) << 32)[None, :] | code
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), b["id"].take(pa.array(np.repeat(np.arange(b.num_rows), tables)))], ["key", "id"])

    most = 1 - math.acos(min(1.0, threshold)) / math.pi
    n = tables * bits
    limit = n * (1 - most) + 4 * math.sqrt(n * most * (1 - most)) + 1

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in whole_groups(batches, ["key", "_lo", "_hi"]):
            ids = t["id"].to_numpy()
            code = np.frombuffer(b"".join(t["code"].to_pylist()), np.uint32).reshape(-1, tables)
            at = t["key"].to_numpy() >> 32
            apart = t["_lo"].to_numpy() != t["_hi"].to_numpy()
            for i, j in pairs_within(group, t["_side"].to_numpy(), apart, 1 << 16):
                near = np.bitwise_count(code[i] ^ code[j]).sum(1) <= limit
                i, j = i[near], j[near]
                earlier = ((code[i] == code[j]) & (np.arange(tables)[None, :] < at[i][:, None])).any(1)
                yield _forest(ids[i[~earlier]], ids[j[~earlier]])

    codes = materialize(reps.mapInArrow(sign, "id long, code binary"), "sign-codes")
    keyed = chunked(codes.mapInArrow(buckets, "key long, id long"), "key", "id", chunk).join(codes, "id")
    keyed = keyed.repartition("key", "_lo", "_hi").sortWithinPartitions("key", "_lo", "_hi", "id")
    linked = components(keyed.mapInArrow(candidates, "a long, b long"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in whole_groups(batches, ["component", "_lo", "_hi"]):
            ids = t["id"].to_numpy()
            x = matrix(t["embedding"].combine_chunks() if isinstance(t["embedding"], pa.ChunkedArray) else t["embedding"])
            x = x / np.sqrt((x * x).sum(1))[:, None]
            apart = t["_lo"].to_numpy() != t["_hi"].to_numpy()
            for i, j in pairs_within(group, t["_side"].to_numpy(), apart, 1 << 14):
                near = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
                yield _forest(ids[i[near]], ids[j[near]])

    close = chunked(reps.join(linked, "id"), "component", "id", chunk)
    close = close.repartition("component", "_lo", "_hi").sortWithinPartitions("component", "_lo", "_hi", "id")
    edges = close.mapInArrow(verify, "a long, b long").union(v.where("vec_id != rep").select("vec_id", "rep"))
    found = components(edges)
    ids = v.select("vec_id").distinct()
    return ids.join(found, F.col("vec_id") == F.col("id"), "left").select("vec_id", F.coalesce("component", "vec_id").alias("component"))


def _forest(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    ids, low = labels_of(a, b)
    keep = ids != low
    return pa.RecordBatch.from_arrays([pa.array(ids[keep], pa.int64()), pa.array(low[keep], pa.int64())], ["a", "b"])


def op4_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
