"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def labels_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of the edges a-b and the least vertex that each is connected with."""
    ids, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    lab = np.arange(len(ids))
    while len(x):
        lx, ly = lab[x], lab[y]
        open_ = lx != ly
        x, y, lx, ly = x[open_], y[open_], lx[open_], ly[open_]
        if not len(x):
            break
        np.minimum.at(lab, np.maximum(lx, ly), np.minimum(lx, ly))
        while True:
            up = lab[lab]
            if (up == lab).all():
                break
            lab = up
    return ids, ids[lab]


def _contract(batches):
    """A spanning star forest of each run of edges: fewer edges, the same components."""
    held, n = [], 0

    def out():
        t = pa.Table.from_batches(held)
        v, low = labels_of(t["a"].to_numpy(), t["b"].to_numpy())
        keep = v != low
        return pa.RecordBatch.from_arrays([pa.array(v[keep]), pa.array(low[keep])], ["a", "b"])

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n > 500_000:
            yield out()
            held, n = [], 0
    if n:
        yield out()


def components(edges: DataFrame, single: int = 1_000_000) -> DataFrame:
    """(id, component) for each vertex of edges (a, b: BIGINT); component is the least id of its component.

    Edges are first contracted within their partitions. While more than `single` are left, large-star and small-star
    steps (each a shuffle, its result written to the shared folder) run until nothing changes; what fits one task is
    finished there. Both ways give the same labels. Null ends and loops are ignored; no edges give no rows.
    """
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null and a != b")
    e = materialize(e.mapInArrow(_contract, "a long, b long"), "edges")
    before = None
    while (n := e.count()) > single:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large.where("a != b"), "large-star")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a")
        small = small.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        e = materialize(small.distinct(), "small-star")
        now = e.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first()
        if now == before:
            return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(e.select("b", "b").distinct())
        before = now

    def finish(batches):
        held = list(batches)
        if sum(b.num_rows for b in held):
            t = pa.Table.from_batches(held)
            v, low = labels_of(t["a"].to_numpy(), t["b"].to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(low)], ["id", "component"])

    return materialize(e.repartition(1).mapInArrow(finish, "id long, component long"), "components")
