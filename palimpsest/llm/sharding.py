"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ROW, numbered, own_names


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """Sizes that differ by one at most, the larger ones first."""
    return np.full(shards, rows // shards, np.int64) + (np.arange(shards) < rows % shards)


def hypergeometric(rng: np.random.Generator, good: np.ndarray, bad: np.ndarray, sample: np.ndarray) -> np.ndarray:
    """How many of `good` are among `sample` drawn from good + bad, for arrays of any (int64) sizes; exact in law.

    Each row is taken with the probability sample / (good + bad) by itself: two binomial draws. Given their sum, what was taken
    is a uniform choice of that many; the rows too many or too few, some square root of the sample, are then drawn from those
    taken or left, which is the same task again with a smaller sample.
    """
    good, bad, sample = (np.array(x, np.int64) for x in np.broadcast_arrays(good, bad, sample))
    out, sign = np.zeros_like(good), np.ones_like(good)
    open_ = np.flatnonzero(sample > 0)
    while len(open_):
        g, b, n = good[open_], bad[open_], sample[open_]
        many = 2 * n > g + b  # draw those that stay instead
        out[open_] += np.where(many, sign[open_] * g, 0)
        sign[open_] = np.where(many, -sign[open_], sign[open_])
        n = np.where(many, g + b - n, n)
        p = n / (g + b)
        x, y = rng.binomial(g, p), rng.binomial(b, p)
        out[open_] += sign[open_] * x
        over = x + y - n
        sign[open_] = np.where(over > 0, -sign[open_], sign[open_])
        good[open_], bad[open_], sample[open_] = np.where(over > 0, x, g - x), np.where(over > 0, y, b - y), np.abs(over)
        open_ = open_[over != 0]
    return out


def spread(rng: np.random.Generator, room: np.ndarray, want: int) -> np.ndarray:
    """How many of `want` rows drawn at random from places in groups of `room` fall to each group: halves of the groups, then their
    halves, all draws of a step at once."""
    size = 1 << max(0, (len(room) - 1).bit_length())
    sums = [np.concatenate([room, np.zeros(size - len(room), np.int64)])]
    while len(sums[-1]) > 1:
        sums.append(sums[-1][::2] + sums[-1][1::2])
    out = np.array([want], np.int64)
    for below in sums[-2::-1]:
        left = hypergeometric(rng, below[::2], below[1::2], out)
        out = np.stack([left, out - left], 1).ravel()
    return out[: len(room)]


def matrix_row(counts_before: np.ndarray, sizes: np.ndarray, part: int, seed: int) -> np.ndarray:
    """Row `part` of the communication matrix: how many rows of that partition go to each bucket.

    The matrix is drawn by halving the range of partitions: at each node the rows of the left half are spread over what
    the buckets have left by a multivariate hypergeometric draw, seeded by the node. So each task draws its own row in
    log2(partitions) steps, and the whole matrix (partitions x buckets) exists nowhere.
    """
    lo, hi, room = 0, len(counts_before) - 1, sizes.astype(np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = spread(np.random.default_rng([seed, lo, hi]), room, int(counts_before[mid] - counts_before[lo]))
        lo, hi, room = (lo, mid, left) if part < mid else (mid, hi, room - left)
    return room


BUCKET_SHARDS = 32


def shuffle_to_shards(docs: DataFrame, shard_rows: int = 4096, seed: int = 11) -> DataFrame:
    """docs in a uniformly random order, cut into shards: its columns, then shard (INT) and position (BIGINT, from 0).

    There are ceil(rows / shard_rows) shards and their sizes differ by one at most. Neighbouring shards form buckets: up to
    BUCKET_SHARDS of them, fewer while there are fewer buckets than shuffle partitions. Exact counts of rows for each pair of
    partition and bucket are drawn first; each partition then deals its rows at random by these counts, one exchange moves each row straight
    to its bucket, and each bucket is permuted again and cut into its shards. Seeded: the same input in the same
    partitions gives the same order.

    Values play no part, so nulls, empty or long texts and repeated rows are rows like others. Columns shard and
    position that docs has are replaced. An empty table gives an empty table.

    Scale: one pass over partition counts, one shuffle of the rows. The driver gets a count a partition.
    """
    docs, names = own_names(docs.drop("shard", "position"))
    d = numbered(docs, "shard-input")
    counts = {r["p"]: r["n"] for r in d.groupBy(F.shiftright(F.col(ROW), 33).cast("int").alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before = np.concatenate([[0], np.cumsum([counts.get(p, 0) for p in range(max(counts, default=-1) + 1)])]).astype(np.int64)
    rows = int(before[-1])
    shards = max(1, -(-rows // shard_rows))
    larger = rows % shards or shards  # so many shards, the first ones, have `most` rows, the others one less
    most = -(-rows // shards)
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    per = max(1, min(BUCKET_SHARDS, shards // max(1, partitions)))
    buckets = -(-shards // per)
    sizes = np.add.reduceat(shard_sizes(rows, shards), np.arange(0, shards, per))

    def deal(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        part, labels, keys = -1, None, None
        for ids in batches:
            out = np.empty((2, len(ids)), np.int64)
            p, at = (ids.to_numpy() >> 33), (ids.to_numpy() & ((1 << 33) - 1))
            for q in np.unique(p):
                if q != part:
                    part, row = int(q), matrix_row(before, sizes, int(q), seed)
                    rng = np.random.default_rng([seed, part])
                    labels = rng.permutation(np.repeat(np.arange(buckets, dtype=np.int32), row))
                    keys = rng.integers(0, 1 << 62, len(labels))
                mine = p == q
                out[0, mine], out[1, mine] = labels[at[mine]], keys[at[mine]]
            yield pd.DataFrame({"bucket": out[0].astype(np.int32), "key": out[1]})

    deal.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}  # types, not strings, for Spark
    d = d.withColumn("_pl_to", F.pandas_udf(deal, "bucket int, key long")(ROW)).withColumns({"_pl_bucket": F.col("_pl_to.bucket"), "_pl_key": F.col("_pl_to.key")})
    d = d.drop("_pl_to").repartitionById(buckets, F.col("_pl_bucket"))
    place = F.row_number().over(W.partitionBy("_pl_bucket").orderBy("_pl_key", ROW)).cast("long") - 1
    first = F.col("_pl_bucket").cast("long") * per  # the bucket's first shard; the larger shards come first
    full = F.greatest(F.lit(0).cast("long"), F.lit(larger) - first)  # shards of `most` rows from there on
    d = d.withColumns({"_pl_at": place, "_pl_first": first, "_pl_full": full}).withColumn("_pl_rest", F.col("_pl_at") - F.col("_pl_full") * most)
    inner = F.col("_pl_rest") < 0
    nth = F.when(inner, F.expr(f"_pl_at div {max(1, most)}")).otherwise(F.col("_pl_full") + F.expr(f"_pl_rest div {max(1, most - 1)}"))
    inside = F.when(inner, F.col("_pl_at") % max(1, most)).otherwise(F.col("_pl_rest") % max(1, most - 1))
    return d.select(*docs.columns, (F.col("_pl_first") + nth).cast("int").alias("shard"), inside.cast("long").alias("position")).withColumnsRenamed(names)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shuffle_to_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
