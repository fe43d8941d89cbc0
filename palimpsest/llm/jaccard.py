"""N-gram Jaccard join: MinHash bands propose pairs, Bayesian pruning drops most of them, the rest are verified exactly."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, bounded, chunked, marked, materialize, numbered, own_names, pairs_within, release, runs_of, text_buffers, whole_groups
from .components import components, labels_of
from .grams import grams, words

HASHES, ROWS, STEP = 128, 3, 32
BANDS = HASHES // ROWS
THRESHOLD, GRAM, TOLERANCE = 0.5, 3, 1e-4


def least_matches(threshold: float, tolerance: float, hashes: int = HASHES, step: int = STEP) -> list[tuple[int, int]]:
    """(compared, matches): fewest matches among so many compared values with which the posterior probability of a Jaccard
    similarity >= threshold is still >= tolerance. The prior is uniform, so after m matches of n the posterior is
    Beta(m + 1, n - m + 1), whose upper tail at t is P(Binomial(n + 1, t) <= m)."""
    out = []
    for n in range(step, hashes + 1, step):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def _constants(seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 64, HASHES, np.uint64), rng.integers(0, 1 << 64, HASHES, np.uint64) | np.uint64(1)


def _signatures(n: int):
    flip, times = _constants()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch["text"])
            keep, first, second, sigs = [], [], [], []
            for a, b in runs_of(offsets, 1 << 18):
                h, doc, _, _ = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                g, at = grams(h, doc, b - a, n)
                some = np.flatnonzero(np.diff(at))
                if not len(some):
                    continue
                begin = at[some]
                sig = np.empty((HASHES, len(some)), np.uint32)
                for k in range(HASHES):
                    sig[k] = np.minimum.reduceat((g ^ flip[k]) * times[k], begin) >> np.uint64(32)
                place = (np.arange(len(g)) - np.repeat(at[:-1], np.diff(at))).astype(np.uint64)
                keep.append(some + a)
                first.append(np.add.reduceat((g ^ (place * times[0])) * flip[2], begin).view(np.int64))
                second.append(np.add.reduceat(((g * times[1]) ^ (g >> np.uint64(29))) * (place + flip[3]), begin).view(np.int64))
                sigs.append(np.ascontiguousarray(sig.T))
            if keep:
                at = pa.array(np.concatenate(keep))
                sig = np.concatenate(sigs)
                ends = pa.array(np.arange(len(sig) + 1, dtype=np.int32) * (4 * HASHES))
                packed = pa.Array.from_buffers(pa.binary(), len(sig), [None, ends.buffers()[1], pa.py_buffer(sig)])
                yield pa.RecordBatch.from_arrays([batch[ROW].take(at), pa.array(np.concatenate(first)), pa.array(np.concatenate(second)), packed], [ROW, "f1", "f2", "sig"])
        release()

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            s = _matrix(b["sig"])[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(np.uint64)
            h = np.zeros(s.shape[:2], np.uint64)
            for r in range(ROWS):
                h = (h ^ s[:, :, r]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(31)
            key = (np.arange(BANDS, dtype=np.uint64) << np.uint64(57))[None, :] | (h >> np.uint64(7))
            yield pa.RecordBatch.from_arrays([b[ROW].take(pa.array(np.repeat(np.arange(b.num_rows), BANDS))), pa.array(key.ravel().view(np.int64))], [ROW, "key"])


def _forest(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    ids, low = labels_of(a, b)
    keep = ids != low
    return pa.RecordBatch.from_arrays([pa.array(ids[keep], pa.int64()), pa.array(low[keep], pa.int64())], ["a", "b"])


def _prune(threshold: float, tolerance: float):
    least = least_matches(threshold, tolerance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in whole_groups(batches, ["key", "_lo", "_hi"]):
            ids, sig = t[ROW].to_numpy(), _matrix(t["sig"])
            apart = t["_lo"].to_numpy() != t["_hi"].to_numpy()
            for i, j in pairs_within(group, t["_side"].to_numpy(), apart, 1 << 15):
                m, done = np.zeros(len(i), np.int64), 0
                for n, need in least:
                    m += (sig[i, done:n] == sig[j, done:n]).sum(1)
                    on = m >= need
                    i, j, m, done = i[on], j[on], m[on], n
                yield _forest(ids[i], ids[j])
        release()

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch["text"])
            for a, b in runs_of(offsets, 1 << 20):
                h, doc, _, _ = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                g, at = grams(h, doc, b - a, n)
                each = [np.unique(g[at[i] : at[i + 1]]).view(np.int64) for i in range(b - a)]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(each)))
                yield pa.RecordBatch.from_arrays([*(batch[c].slice(a, b - a) for c in (ROW, "component", "copies")), lists], [ROW, "component", "copies", "grams"])
        release()

    return run


def shared(values: np.ndarray, owner: np.ndarray, m: int) -> np.ndarray:
    """m x m, above the diagonal: how many values each two of m owners have in common. Owners ascend and repeat no value."""
    by = np.argsort(values, kind="stable")
    v, o = values[by], owner[by]
    start = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, np.int64)
    df = np.diff(np.append(start, len(v)))
    c = np.zeros((m, m), np.int32)
    for size in range(2, 9):
        s = start[df == size]
        for x in range(size):
            for y in range(x + 1, size):
                np.add.at(c, (o[s + x], o[s + y]), 1)
    for s, d in zip(start[df > 8], df[df > 8], strict=True):
        p = o[s : s + d]
        c[np.ix_(p, p)] += 1
    return c


def _verify(threshold: float):
    """A row for each representative with a link: the least one that it is linked with here, directly or through others,
    and how many rows those stand for that it is linked with directly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in whole_groups(batches, ["component", "_lo", "_hi"], 256):
            ids, lists = t[ROW].to_numpy(), t["grams"].combine_chunks() if isinstance(t["grams"], pa.ChunkedArray) else t["grams"]
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy()
            begin = np.concatenate([[0], np.cumsum(sizes)])
            side, apart = t["_side"].to_numpy(), t["_lo"].to_numpy() != t["_hi"].to_numpy()
            copies = t["copies"].to_numpy()
            out_id, out_low, out_n = [], [], []
            for g in np.unique(group):
                lo, hi = np.searchsorted(group, [g, g + 1])
                m = hi - lo
                both = shared(flat[begin[lo] : begin[hi]], np.repeat(np.arange(m), sizes[lo:hi]), m)
                size = sizes[lo:hi]
                ok = both / np.maximum(size[:, None] + size[None, :] - both, 1) >= threshold
                if apart[lo]:
                    ok &= side[lo:hi][:, None] != side[lo:hi][None, :]
                x, y = np.nonzero(np.triu(ok, 1))
                n = np.bincount(np.concatenate([x, y]), np.concatenate([copies[lo + y], copies[lo + x]]), m)
                v, low = labels_of(x, y)
                out_id.append(ids[lo + v])
                out_low.append(ids[lo + low])
                out_n.append(n[v].astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (out_id, out_low, out_n)], ["id", "low", "links"])
        release()

    return run


def join_rows(d: DataFrame, threshold: float = THRESHOLD, n: int = GRAM, tolerance: float = TOLERANCE, chunk: int = 1024) -> tuple[DataFrame, DataFrame, DataFrame]:
    """d: ROW and text. (members, links, families). members (ROW, rep) for each row with a word, rows of equal word
    sequences having one representative; links (rep, links): how many rows of other texts a representative is linked with; families
    (rep, component) of the representatives that have a link."""
    bounded(d.sparkSession)
    low = d.select(ROW, F.lower("text").alias("text"))
    sigs = materialize(low.mapInArrow(_signatures(n), f"{ROW} long, f1 long, f2 long, sig binary"), "signatures")
    reps = sigs.groupBy("f1", "f2").agg(F.min(ROW).alias("rep"))
    members = materialize(sigs.select(ROW, "f1", "f2").join(reps, ["f1", "f2"]).select(ROW, "rep"), "members")
    copies = members.where(F.col(ROW) != F.col("rep")).select(ROW)
    unlike = marked(sigs.select(ROW, "sig"), copies, ROW, "left_anti")
    keyed = materialize(chunked(unlike.mapInArrow(_bands, f"{ROW} long, key long"), "key", ROW, chunk), "bands")
    near = keyed.join(unlike, ROW).repartition("key", "_lo", "_hi").sortWithinPartitions("key", "_lo", "_hi", ROW)
    likely = components(near.mapInArrow(_prune(threshold, tolerance), "a long, b long")).withColumnRenamed("id", ROW)
    times = members.groupBy("rep").agg(F.count(F.lit(1)).alias("copies")).withColumnRenamed("rep", ROW)
    likely = materialize(likely.join(times, ROW), "likely")
    sets = marked(low, likely, ROW, "inner").select(ROW, "component", "copies", "text").mapInArrow(_sets(n), f"{ROW} long, component long, copies long, grams array<long>")
    sets = chunked(sets, "component", ROW, chunk).repartition("component", "_lo", "_hi").sortWithinPartitions("component", "_lo", "_hi", ROW)
    found = materialize(sets.mapInArrow(_verify(threshold), "id long, low long, links long"), "links")
    families = components(found.select(F.col("id").alias("a"), F.col("low").alias("b"))).withColumnRenamed("id", "rep")
    return members, found.groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("links")), families


def near_copies(docs: DataFrame, threshold: float = THRESHOLD, n: int = GRAM, tolerance: float = TOLERANCE, chunk: int = 1024) -> DataFrame:
    """(doc_id, class_id, links): for every row of docs, the class it belongs to and how many other rows it is linked with.

    Two rows are linked if the Jaccard similarity of their sets of word n-grams is >= threshold; a class is what links connect, directly
    or through others, and class_id its least doc_id (null if it has none). A row without a link is a class by itself, with 0 links.

    Words are runs of ASCII letters and digits and of other non-ASCII characters, in lower case; a text of fewer than n
    words has one gram. Texts of equal words are found by a fingerprint and compared as one. For the rest, 128 MinHash
    values in 42 bands of 3 propose pairs (a pair at 0.5 is proposed with probability 0.996); their values are
    compared 32 at a time and a pair is dropped once the posterior probability of reaching the threshold is below `tolerance`.
    The families that the remaining pairs form are verified exactly, each pair within.

    Null and empty texts and texts without a word have no links. Rows with a null doc_id are searched and counted like others. Where
    doc_id repeats, each row counts. Very long texts are read whole. Other columns are not read. An empty table gives no rows.

    Scale: the corpus is read twice and never shuffled as text (unless more than two million documents have a near copy); buckets and families
    of any size are split into chunks whose pairs of chunks run in parallel. A task gives counts and a forest, not its pairs, so
    the result and what is shuffled grow as the rows; the comparisons within a family of different texts grow as its square.
    """
    d = numbered(docs.select("doc_id", "text"), "jaccard-input")
    members, links, families = join_rows(d, threshold, n, tolerance, chunk)
    times = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
    each = times.join(links, "rep", "left").join(families, "rep", "left")
    each = each.select("rep", F.coalesce("component", "rep").alias("class"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    rows = d.select(ROW, F.col("doc_id").cast("long").alias("doc_id")).join(members.join(each, "rep"), ROW, "left")
    rows = materialize(rows.select("doc_id", F.coalesce("class", ROW).alias("class"), F.coalesce("links", F.lit(0)).alias("links")), "classed")
    least = rows.where("links > 0").groupBy("class").agg(F.min("doc_id").alias("class_id"))
    return rows.join(least, "class", "left").select("doc_id", F.when(F.col("links") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), "links")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, n: int = GRAM) -> DataFrame:
    """docs without the rows that are a near copy of another: of each group that the join links, directly or through others,
    the row of the least doc_id stays (null last; the first read, among rows of equal doc_id). Texts without a word all stay, null and
    empty ones too. All columns of docs stay as they are. An empty table gives an empty table."""
    docs, names = own_names(docs)
    d = numbered(docs, "dedup-input")
    members, _, families = join_rows(d.select(ROW, "text"), threshold, n)
    grouped = members.join(families, "rep", "left").select(ROW, F.coalesce("component", "rep").alias("g"))
    grouped = grouped.join(d.select(ROW, "doc_id"), ROW)
    kept = grouped.groupBy("g").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW)).alias("m"))
    losers = materialize(grouped.join(kept, "g").where(F.col(ROW) != F.col(f"m.{ROW}")).select(ROW), "losers")
    return marked(d, losers, ROW, "left_anti").drop(ROW).withColumnsRenamed(names)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9\x{80}-\x{10FFFF}]+'), lambda x: x != '') AS w FROM d WHERE text IS NOT NULL),
g AS (SELECT r, list_distinct(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w WHERE len(w) > 0),
e AS (SELECT r, unnest(g) AS x FROM g),
c AS (SELECT a.r AS ra, b.r AS rb, count(*) AS n FROM e a JOIN e b ON a.x = b.x AND a.r < b.r GROUP BY 1, 2),
j AS MATERIALIZED (SELECT ra, rb FROM c JOIN g a ON a.r = ra JOIN g b ON b.r = rb WHERE CAST(n AS DOUBLE) / (len(a.g) + len(b.g) - n) >= 0.5),
s AS MATERIALIZED (SELECT ra AS x, rb AS y FROM j UNION ALL SELECT rb, ra FROM j),
reach AS (SELECT x, y FROM s UNION SELECT reach.x, s.y FROM reach JOIN s ON reach.y = s.x),
k AS (SELECT x, min(doc_id) AS least FROM reach JOIN d ON d.r = y GROUP BY x),
n AS (SELECT x, count(*) AS links FROM s GROUP BY x)
SELECT doc_id, CASE WHEN links > 0 THEN least ELSE doc_id END AS class_id, coalesce(links, 0) AS links FROM d LEFT JOIN k ON k.x = r LEFT JOIN n ON n.x = r
"""
