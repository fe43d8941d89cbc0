"""Shared plumbing: durable intermediate tables, stable row numbers, whole groups in Arrow batches."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

ROW = "_pl_row"
BROADCAST_ROWS = 2_000_000
"""A side of at most so many rows of two numbers (about 32 MB) may be broadcast; a larger one is shuffled."""

_own: dict[str, str] = {}
_STABLE = {"Project", "Filter", "Relation", "LocalRelation", "LogicalRDD", "ExternalRDD", "SerializeFromObject", "Range"}


BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": (None, str(8 << 20))}
"""Settings that bound the Arrow batches of whole texts, each with Spark's default and ours."""


def bounded(spark: SparkSession) -> None:
    """Bound the batches that Python gets, for the rest of the session: texts may be long, and 10,000 of them at a time fill an
    executor. Values that the caller has set stay."""
    for key, (usual, ours) in BATCH.items():
        if spark.conf.get(key, usual) == usual:
            spark.conf.set(key, ours)


def release() -> None:
    """Give memory that this Python worker has freed back to the system: workers outlive their tasks and stages."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session. Where that is unset and all runs in one
    process, as in tests, a temporary folder that goes when the process ends; on a cluster it must be set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not folder:
        if app not in _own:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            made = tempfile.mkdtemp(prefix="palimpsest-")
            atexit.register(shutil.rmtree, made, ignore_errors=True)
            _own[app] = "file://" + made
            spark.sparkContext.setCheckpointDir(_own[app])
        folder = _own[app]
    return f"{folder.rstrip('/')}/palimpsest-{app}"


def own_names(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns that begin as those we add do (_pl_) under other names, and the names to give back at the end."""
    mark = "own"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark += "_"
    away = {c: f"{mark}{i}" for i, c in enumerate(docs.columns) if c.lower().startswith("_pl_")}
    return docs.withColumnsRenamed(away), {v: k for k, v in away.items()}


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there and no lost executor takes it along."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stable(df: DataFrame, label: str) -> DataFrame:
    """df itself if its plan has none but nodes of _STABLE, a plain scan, whose partitions and row order repeat on every run; else, at
    the cost of one more write, a copy of it. Spark splits small files by the number of cores at hand, which changes as executors come
    and go, so where spark.sql.files.minPartitionNum is unset it is set to that of now."""
    least = "spark.sql.files.minPartitionNum"
    if not df.sparkSession.conf.get(least, None):
        df.sparkSession.conf.set(least, str(df.sparkSession.sparkContext.defaultParallelism))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    names = {m[1] for line in plan.splitlines() if (m := re.match(r"[\s:+\-]*([A-Za-z]+)", line))}
    return df if names <= _STABLE else materialize(df, label)


def numbered(df: DataFrame, label: str) -> DataFrame:
    """df with ROW, unique and equal on every run: scan partition << 33 | position."""
    return stable(df, label).withColumn(ROW, F.monotonically_increasing_id())


def marked(df: DataFrame, side: DataFrame, on: str, how: str) -> DataFrame:
    """Join with a table of row numbers (and little else): broadcast if its counted size allows, shuffled otherwise."""
    small = side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(side) if small else side.hint("merge"), on, how)


def chunked(df: DataFrame, key: str, order: str, size: int) -> DataFrame:
    """Split every group of `key` into chunks of `size` rows and pair the chunks: columns _lo, _hi and _side name the
    pair of chunks that a copy of the row belongs to. All pairs of a group's rows meet in exactly one (key, _lo, _hi),
    those of one chunk in _lo = _hi; so a group of any size is compared in pieces of at most 2 * size rows. Groups of
    one row are left out."""
    w = W.partitionBy(key)
    n = F.floor((F.col("_n") - 1) / size).cast("int")
    d = df.withColumn("_n", F.count(F.lit(1)).over(w)).where("_n > 1")
    d = d.withColumn("_c", F.floor((F.row_number().over(w.orderBy(order)) - 1) / size).cast("int"))
    d = d.withColumn("_j", F.explode(F.sequence(F.lit(0), n)))
    d = d.withColumn("_lo", F.least("_c", "_j")).withColumn("_hi", F.greatest("_c", "_j"))
    return d.withColumn("_side", (F.col("_c") == F.col("_hi")).cast("int")).drop("_c", "_j", "_n")


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int = 8192) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with each row's group number, from batches sorted by keys."""
    held: list[pa.RecordBatch] = []
    n = 0

    def numbers(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        for k in keys:
            v = t.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.cumsum(new)

    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            t = pa.Table.from_batches(held).combine_chunks()
            g = numbers(t)
            cut = int(np.searchsorted(g, g[-1])) if n else 0
            if cut:
                yield t.slice(0, cut), g[:cut]
            held, n = t.slice(cut).to_batches(), n - cut
            rows = max(rows, 2 * n)
    if n:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, numbers(t)


def pairs_within(group: np.ndarray, side: np.ndarray, apart: np.ndarray, most: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of one group (sorted by group), in vectors of bounded length; where `apart`, of different sides only."""
    d, held_i, held_j, n = 1, [], [], 0
    alive = np.arange(len(group))
    while True:
        alive = alive[alive + d < len(group)]
        alive = alive[group[alive] == group[alive + d]]
        if not len(alive):
            break
        i, j = alive, alive + d
        ok = ~apart[i] | (side[i] != side[j])
        held_i.append(i[ok])
        held_j.append(j[ok])
        n += int(ok.sum())
        if n >= most:
            yield np.concatenate(held_i), np.concatenate(held_j)
            held_i, held_j, n = [], [], 0
        d += 1
    if n:
        yield np.concatenate(held_i), np.concatenate(held_j)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column without copying; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    else:
        off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(column) or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]], off - off[0]


def runs_of(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most `most` bytes together, or of one longer text."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)
