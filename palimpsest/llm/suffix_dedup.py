"""Passages that repeat across documents, from suffix arrays built by external induced sorting."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ROW, bounded, marked, materialize, numbered, release, runs_of, shared_dir, text_buffers, whole_groups
from .grams import grams, mix, words
from .induced import LIMIT, Spill, suffixes

PASSAGE = 50
SHARD_WORDS = 250_000
GROUP_WORDS = 250_000
_ODD = 0x9E3779B97F4A7C15


def _least(g: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of each g[i .. i + width - 1], the last of equal ones."""
    v, at, size = g, np.arange(len(g)), 1

    def better(v1, at1, v2, at2):
        first = v1 < v2
        return np.where(first, v1, v2), np.where(first, at1, at2)

    while 2 * size <= width:
        v, at = better(v[:-size], at[:-size], v[size:], at[size:])
        size *= 2
    if size < width:
        n = len(g) - width + 1
        v, at = better(v[:n], at[:n], v[width - size :], at[width - size :])
    return at


class _Prefix:
    """Hashes of any stretches of words, from sums of powers."""

    def __init__(self, h: np.ndarray):
        power = np.cumprod(np.full(len(h) + 1, _ODD, np.uint64))
        self.back = np.cumprod(np.full(len(h) + 1, pow(_ODD, -1, 1 << 64), np.uint64))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[:-1])])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.back[begin] + (end - begin).astype(np.uint64))


def _split(passage: int) -> tuple[int, int]:
    """Gram and window whose least gram every passage of so many words has: gram + window - 1 = passage."""
    gram = max(1, passage // 2)
    return gram, passage - gram + 1


def levels(passage: int) -> int:
    """Steps in which a print's windows can be halved until each is alone."""
    return (_split(passage)[1] - 1).bit_length()


def pieces(h: np.ndarray, doc: np.ndarray, texts: int, passage: int, level: int = 0, within: tuple | None = None):
    """(text, start, size, key, body) of the pieces of texts: each window of `passage` words is in one piece, and equal
    windows are in pieces of the same key.

    The windows whose least gram (the print) is at the same place are one piece; its key is the print. At a higher level the
    piece is cut by how far its windows begin before the print, into 2^level ranges; the key is a hash of all the words that the
    windows of such a range share, so at the last level it is the window itself. within: (text, start, size) of pieces to
    which this is confined. body is a hash of the piece's words.
    """
    gram, width = _split(passage)
    size = np.bincount(doc, minlength=texts)
    begin = np.cumsum(size) - size
    g, go = grams(h, doc, texts, gram)
    none = np.zeros(0, np.int64)
    if len(g) < width:
        return none, none, none, none, none
    at = _least(g, width)
    owner = np.repeat(np.arange(texts), np.diff(go))
    on = owner[: len(at)] == owner[width - 1 :]
    if within is not None:
        k, s, n = within
        edge = np.zeros(len(at) + 1, np.int64)
        np.add.at(edge, go[k] + s, 1)
        np.add.at(edge, go[k] + s + n - passage + 1, -1)
        on &= np.cumsum(edge[:-1]) > 0
    i = np.flatnonzero(on)
    if not len(i):
        return none, none, none, none, none
    at, shift = at[i], levels(passage) - level
    part = (at - i) >> shift
    new = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1] + 1) | (at[1:] != at[:-1]) | (part[1:] != part[:-1])]))
    first, n = i[new], np.diff(np.append(new, len(i))) + passage - 1
    text, at, part = owner[first], at[new], part[new]
    start = first - go[text]
    prefix = _Prefix(h)
    flat = begin[text] + start
    if level:
        far = part << shift
        near = np.minimum(far + (1 << shift) - 1, width - 1)
        core = begin[text] + at - go[text]
        key = mix(prefix.of(core - far, core - near + passage) + part.astype(np.uint64) * np.uint64(64) + np.uint64(level))
    else:
        key = g[at]
    return text, start, n, key.view(np.int64), prefix.of(flat, flat + n).view(np.int64)


def _lists(per_text: np.ndarray, *columns) -> list[pa.Array]:
    ends = pa.array(np.concatenate([[0], np.cumsum(per_text)]).astype(np.int32))
    return [pa.ListArray.from_arrays(ends, pa.array(c)) for c in columns]


def _winnow(passage: int):
    """A row for each text of `passage` words or more: two hashes of it, and its pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch["text"])
            for a, b in runs_of(offsets, 1 << 20):
                h, doc, _, _ = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                size = np.bincount(doc, minlength=b - a)
                long = np.flatnonzero(size >= passage)
                if not len(long):
                    continue
                end = np.cumsum(size)[long]
                f1, f2 = _Prefix(h).of(end - size[long], end), _Prefix(mix(h)).of(end - size[long], end)
                text, start, n, key, body = pieces(h, doc, b - a, passage)
                lists = _lists(np.bincount(text, minlength=b - a)[long], key, body, start.astype(np.int32), n.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch[ROW].take(pa.array(long + a)), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.array(size[long].astype(np.int32)), *lists],
                    [ROW, "f1", "f2", "words", "p", "f", "start", "size"],
                )
        release()

    return run


def _asked(batch: pa.RecordBatch, a: int, b: int):
    """Row of each asked-for piece of the texts a .. b - 1, and their list of structs laid flat."""
    part = batch["asked"].slice(a, b - a)
    return np.repeat(np.arange(b - a), part.value_lengths().to_numpy()), part.flatten()


def _finer(passage: int, level: int):
    """The pieces of a higher level that lie within the pieces asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch["text"])
            for a, b in runs_of(offsets, 1 << 20):
                h, doc, _, _ = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                k, asked = _asked(batch, a, b)
                text, start, n, key, body = pieces(h, doc, b - a, passage, level, (k, *(asked.field(c).to_numpy() for c in ("start", "size"))))
                yield pa.RecordBatch.from_arrays([batch[ROW].take(pa.array(text + a)), pa.array(key), pa.array(body), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], [ROW, "p", "f", "start", "size"])
        release()

    return run


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The word hashes of the pieces asked for."""
    for batch in batches:
        data, offsets = text_buffers(batch["text"])
        for a, b in runs_of(offsets, 1 << 20):
            h, doc, _, _ = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            size = np.bincount(doc, minlength=b - a)
            k, asked = _asked(batch, a, b)
            n = asked.field("size").to_numpy().astype(np.int64)
            flat = (np.cumsum(size) - size)[k] + asked.field("start").to_numpy()
            at = np.arange(int(n.sum())) + np.repeat(flat - (np.cumsum(n) - n), n)
            yield pa.RecordBatch.from_arrays([asked.field("p"), asked.field("f"), asked.field("owner"), *_lists(n, h[at].view(np.int64))], ["p", "f", "owner", "body"])
    release()


def repeats(bodies: list[np.ndarray], owner: np.ndarray, passage: int, spill: Spill) -> Iterator[tuple[int, int, int]]:
    """(body, start, end) of the maximal stretches of bodies that windows of `passage` words cover which also occur in a
    body of another owner."""
    size = np.array([len(b) for b in bodies], np.int64)
    ends = np.cumsum(size + 1)
    flat = np.concatenate([np.append(b, 0) for b in bodies])
    mark = np.zeros(len(flat), bool)
    mark[ends - 1] = True
    t = np.empty(len(flat) + 1, np.int64)
    t[:-1][~mark] = np.unique(flat[~mark], return_inverse=True)[1] + len(bodies) + 1
    t[:-1][mark] = np.arange(1, len(bodies) + 1)  # every body ends in a character of its own
    t[-1] = 0
    sa, lcp = suffixes(t, spill)
    body = np.searchsorted(ends, sa, side="right")
    own = np.append(owner, np.iinfo(np.int64).min)[body]
    reach = np.zeros(len(t), np.int64)
    hot = np.flatnonzero(lcp >= passage)
    for way in (1, -1):  # nearest suffix of another owner before, then after
        best, last = 0, -2
        for i in hot.tolist() if way == 1 else hot[::-1].tolist():
            here, there, value = (i, i - 1, int(lcp[i])) if way == 1 else (i - 1, i, int(lcp[i]))
            carry = best if last == there else 0
            best = value if own[here] != own[there] else min(value, carry)
            last = here
            if best > reach[sa[here]]:
                reach[sa[here]] = best
    at = np.flatnonzero(reach >= passage)
    if not len(at):
        return
    which = np.searchsorted(ends, at, side="right")
    begin = at - (ends - size - 1)[which]
    end = begin + reach[at]
    for k in np.unique(which):
        s, e = begin[which == k], np.maximum.accumulate(end[which == k])
        new = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]))
        for x, y in zip(new, np.append(new[1:], len(s)), strict=True):
            yield int(k), int(s[x]), int(e[y - 1])


def _sorted_shards(passage: int, folder: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in whole_groups(batches, ["shard"], 1):
            for g in np.unique(group):
                lo, hi = np.searchsorted(group, [g, g + 1])
                part = t.slice(lo, hi - lo)
                spill = Spill(f"{folder}/{uuid.uuid4().hex}", limit)
                lists = part["body"].combine_chunks() if isinstance(part["body"], pa.ChunkedArray) else part["body"]
                cut = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
                flat = lists.flatten().to_numpy()
                bodies = [flat[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)]
                found = list(repeats(bodies, part["owner"].to_numpy(), passage, spill))
                spill.clear()
                k, s, e = (np.array([f[c] for f in found], np.int64) for c in range(3))
                yield pa.RecordBatch.from_arrays([part["p"].combine_chunks().take(pa.array(k)), part["f"].combine_chunks().take(pa.array(k)), pa.array(s), pa.array(e)], ["p", "f", "s", "e"])

    return run


def _with_texts(d: DataFrame, asked: DataFrame) -> DataFrame:
    """The texts of the rows that asked names, with the structs asked of each. asked: ROW and a struct column."""
    lists = materialize(asked.groupBy(ROW).agg(F.collect_list("asked").alias("asked")), "asked")
    return marked(d.select(ROW, "text"), lists.select(ROW), ROW, "left_semi").join(lists, ROW)


def repeated_passages(docs: DataFrame, passage: int = PASSAGE, shard_words: int = SHARD_WORDS, group_words: int = GROUP_WORDS, limit: int = LIMIT) -> DataFrame:
    """(doc_id, start_word, end_word): the stretches of every document that repeat elsewhere: the union of all windows of
    `passage` words that also occur in another row, word numbers from 0, end excluded.

    Words are runs of ASCII letters and digits and of other non-ASCII characters, in lower case. Null, empty and shorter texts have no
    stretch. Rows are documents, also rows that repeat or share a doc_id; a null doc_id is carried as null. Other
    columns are not read. An empty table gives no rows. Texts are read whole.

    First, every window goes into one piece of its text, under the least of the window's grams: the piece's print (see pieces). Equal
    windows have equal prints, so only pieces under one print need be compared, and prints of one row only are left. A piece that
    several rows have word by word repeats as a whole, and a print all of whose pieces are such is settled. The different
    pieces of the other prints go into shards of about shard_words words, whole prints together. Each shard's suffix array is built by external
    induced sorting (module induced), `limit` tuples in memory and the rest in the shared folder, and neighbours' common prefixes of
    `passage` words or more give the stretches. A print whose different pieces have more than group_words words, as when a
    passage stands in a third of all documents amid as many surroundings, is cut: its windows are halved by how far before the print
    they begin, each half under all the words its windows share, again and again until the groups are small; at the last
    step a group is one window and has one piece. Texts that are equal word by word are sorted once.

    Scale: the corpus is read twice; a piece is some 13 windows, and what is shuffled is a few numbers a piece, then once each different
    piece to be sorted and the texts that have one. No group of any kind is gathered in one task.
    """
    bounded(docs.sparkSession)
    d = numbered(docs.select("doc_id", "text"), "suffix-input").select(ROW, "doc_id", F.lower("text").alias("text"))
    schema = f"{ROW} long, f1 long, f2 long, words int, p array<long>, f array<long>, start array<int>, size array<int>"
    texts = materialize(d.select(ROW, "text").mapInArrow(_winnow(passage), schema), "pieces")
    same = texts.groupBy("f1", "f2").agg(F.min(ROW).alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").select("f1", "f2", "rep")
    copies = materialize(texts.select(ROW, "f1", "f2", "words").join(same, ["f1", "f2"]).select(ROW, "rep", "words"), "equal-texts")
    once = marked(texts, copies.where(F.col(ROW) != F.col("rep")).select(ROW), ROW, "left_anti")

    def shared(found: DataFrame, prints: DataFrame, level: int) -> DataFrame:
        """Pieces whose print several rows have."""
        keys = prints.groupBy("p").agg(F.min(ROW).alias("a"), F.max(ROW).alias("b")).where("a != b").select("p")
        return materialize(marked(found, materialize(keys, f"prints-{level}"), "p", "left_semi"), f"shared-{level}")

    flat = F.inline(F.arrays_zip("p", "f", "start", "size"))
    found = shared(once.select(ROW, flat), once.select(ROW, F.explode("p").alias("p")), 0)
    settled: list[tuple[DataFrame, DataFrame, DataFrame]] = []
    for level in range(levels(passage) + 1):
        kinds = found.groupBy("p", "f").agg(F.min(ROW).alias("low"), F.max(ROW).alias("high"), F.min(F.struct(ROW, "start", "size")).alias("one"))
        kinds = materialize(kinds.withColumn("whole", F.col("low") != F.col("high")), f"kinds-{level}")
        groups = kinds.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.sum("one.size").alias("words"), F.every("whole").alias("plain"))
        groups = materialize(groups.where("n > 1 and not plain").select("p", "words"), f"groups-{level}")
        wide = groups.where(F.col("words") > group_words).select("p")
        if level < levels(passage) and wide.head(1):
            settled.append((marked(found, wide, "p", "left_anti"), marked(kinds, wide, "p", "left_anti"), groups.where(F.col("words") <= group_words)))
            asked = marked(found, wide, "p", "left_semi").select(ROW, F.struct("start", "size").alias("asked"))
            finer = materialize(_with_texts(d, asked).select(ROW, "text", "asked").mapInArrow(_finer(passage, level + 1), f"{ROW} long, p long, f long, start int, size int"), f"finer-{level}")
            found = shared(finer, finer, level + 1)
        else:
            settled.append((found, kinds, groups))
            break
    places, kinds, groups = (_union(parts) for parts in zip(*settled, strict=True))
    todo = kinds.join(groups.select("p"), "p").withColumn("owner", F.when(F.col("whole"), F.lit(-1)).otherwise(F.col("low")))
    shards = int((groups.agg(F.sum("words")).first()[0] or 0) // shard_words) + 1
    asked = todo.select(F.col(f"one.{ROW}").alias(ROW), F.struct("p", "f", "owner", "one.start", "one.size").alias("asked"))
    bodies = _with_texts(d, asked).select(ROW, "text", "asked").mapInArrow(_bodies, "p long, f long, owner long, body array<long>")
    packed = bodies.withColumn("shard", F.pmod(F.xxhash64("p"), F.lit(shards)))
    packed = packed.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "p", "f")
    folder = f"{shared_dir(docs.sparkSession)}/spill"
    stretches = materialize(packed.mapInArrow(_sorted_shards(passage, folder, limit), "p long, f long, s long, e long"), "stretches")
    # What is settled as a whole, and the stretches of the rest; from pieces back to rows, united.
    wholly = kinds.where("whole").select("p", "f", F.lit(0).cast("long").alias("s"), F.col("one.size").cast("long").alias("e"))
    partly = stretches.join(kinds.where("not whole").select("p", "f"), ["p", "f"], "left_semi")
    part = places.join(wholly.union(partly), ["p", "f"]).select(ROW, (F.col("start") + F.col("s")).alias("s"), (F.col("start") + F.col("e")).alias("e"))
    full = copies.select(ROW, F.lit(0).cast("long").alias("s"), F.col("words").cast("long").alias("e"))
    one = marked(part, copies.select(ROW), ROW, "left_anti").union(full)
    order = W.partitionBy(ROW).orderBy("s", "e")
    one = one.withColumn("top", F.max("e").over(order.rowsBetween(W.unboundedPreceding, -1)))
    one = one.withColumn("g", F.sum(F.when(F.col("s") <= F.col("top"), 0).otherwise(1)).over(order.rowsBetween(W.unboundedPreceding, 0)))
    one = materialize(one.groupBy(ROW, "g").agg(F.min("s").alias("start_word"), F.max("e").alias("end_word")).drop("g"), "united")
    return d.select(ROW, "doc_id").join(one, ROW).select("doc_id", "start_word", "end_word")


def _union(parts: tuple[DataFrame, ...]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9\x{80}-\x{10FFFF}]+'), lambda x: x != '') AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT r, doc_id, w, unnest(range(0, len(w) - 49)) AS i FROM w WHERE len(w) >= 50),
h AS (SELECT r, doc_id, i, md5(array_to_string(w[i + 1:i + 50], ' ')) AS h FROM g),
k AS (SELECT h FROM h GROUP BY h HAVING count(DISTINCT r) > 1),
s AS (SELECT r, doc_id, i FROM h WHERE h IN (SELECT h FROM k)),
n AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 50 THEN 0 ELSE 1 END AS f FROM s),
c AS (SELECT *, sum(f) OVER (PARTITION BY r ORDER BY i) AS island FROM n)
SELECT doc_id, min(i) AS start_word, max(i) + 50 AS end_word FROM c GROUP BY r, doc_id, island
"""
