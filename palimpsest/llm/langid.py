"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, own_names, release, text_buffers

WINDOW = 96
"""Bytes that the network reads in one go; a text is tiled by windows, and both directions start anew in each."""
TRAIN_ROWS = 1200
"""Labelled texts (about) that training reads, in total."""
LEAST_ROWS = 8
"""Texts of each language that training reads at least, if it has them, however many languages there are."""
UNITS = 8


def _gate(x: np.ndarray) -> np.ndarray:
    """Hard sigmoid of 4 (x - 0.5): the slope is in the weights."""
    return np.clip(x, 0.0, 1.0)


class Network:
    """Parameters of the two directions (e: input table 256 x 3H, u: recurrent 3H x H) and of the output (w: 2H x L, b: L)."""

    def __init__(self, languages: list[str], units: int = UNITS, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.languages, self.units = languages, units
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            e = rng.normal(0, 0.3, (256, 3 * units))
            e[:, : 2 * units] += 0.5
            self.p["e" + d] = e.astype(np.float32)
            self.p["u" + d] = rng.normal(0, 0.3 / units**0.5, (3 * units, units)).astype(np.float32)
        self.p["w"] = rng.normal(0, 0.1, (len(languages), 2 * units)).astype(np.float32)
        self.p["b"] = np.zeros(len(languages), np.float32)

    def _run(self, table: np.ndarray, u: np.ndarray, x: np.ndarray, keep: bool):
        """x: T x B bytes in reading order. States T x H x B, and what the backward pass needs. Gates: z and r hard sigmoid, n hard tanh."""
        t_, b_, h_ = x.shape[0], x.shape[1], self.units
        h = np.zeros((h_, b_), np.float32)
        out = np.empty((t_, h_, b_), np.float32)
        saved = []
        columns = np.ascontiguousarray(table.T)
        for t in range(t_):
            a = columns.take(x[t], axis=1)
            g = u @ h
            zr = a[: 2 * h_]
            zr += g[: 2 * h_]
            pre = zr.copy() if keep else None
            np.maximum(zr, 0, out=zr)
            np.minimum(zr, 1, out=zr)
            z, r = zr[:h_], zr[h_:]
            n = a[2 * h_ :]
            gn = g[2 * h_ :]
            n += r * gn
            pre_n = n.copy() if keep else None
            np.maximum(n, -1, out=n)
            np.minimum(n, 1, out=n)
            if keep:
                saved.append((h, z, r, n, gn, pre, pre_n))
            new = out[t]
            np.subtract(h, n, out=new)
            new *= z
            new += n
            h = new
        return out, saved

    def scores(self, x: np.ndarray, keep: bool = False):
        """x: T x B bytes. Logits T x L x B."""
        f, sf = self._run(self.p["ef"], self.p["uf"], x, keep)
        b, sb = self._run(self.p["eb"], self.p["ub"], x[::-1], keep)
        h = self.units
        logits = np.matmul(self.p["w"][:, :h], f) + np.matmul(self.p["w"][:, h:], b[::-1]) + self.p["b"][:, None]
        return (logits, f, b, sf, sb) if keep else logits

    def gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of every position against its window's language y, and its gradient by backpropagation through time."""
        logits, f, b, sf, sb = self.scores(x, keep=True)
        t_, l_, b_ = logits.shape
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        loss = -(np.log(p[:, y, np.arange(b_)] + 1e-9) * weight).sum() / weight.sum()
        p[:, y, np.arange(b_)] -= 1
        d = (p * weight[:, None, :] / weight.sum()).astype(np.float32)
        h = self.units
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["b"] = d.sum((0, 2))
        g["w"][:, :h] = np.einsum("tlb,thb->lh", d, f, optimize=True)
        g["w"][:, h:] = np.einsum("tlb,thb->lh", d, b[::-1], optimize=True)
        for name, state, back, way in (("f", sf, np.matmul(self.p["w"][:, :h].T, d), x), ("b", sb, np.matmul(self.p["w"][:, h:].T, d)[::-1], x[::-1])):
            u = self.p["u" + name]
            dh = np.zeros((h, b_), np.float32)
            for t in range(t_ - 1, -1, -1):
                h0, z, r, n, gn, pre, pre_n = state[t]
                dh = dh + back[t]
                dn = dh * (1 - z) * (np.abs(pre_n) < 1)
                dz = dh * (h0 - n) * ((pre[:h] > 0) & (pre[:h] < 1))
                dr = dn * gn * ((pre[h:] > 0) & (pre[h:] < 1))
                da = np.concatenate([dz, dr, dn])
                dg = np.concatenate([dz, dr, dn * r])
                np.add.at(g["e" + name], way[t], da.T)
                g["u" + name] += dg @ h0.T
                dh = dh * z + u.T @ dg
        return float(loss), g

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int, size: int, rate: float, seed: int) -> None:
        """Adam over random minibatches of windows (columns of x), with the gradient clipped."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(q) for k, q in self.p.items()}
        for s in range(1, steps + 1):
            i = rng.integers(0, x.shape[1], size)
            _, g = self.gradient(x[:, i], y[i], weight[:, i])
            norm = np.sqrt(sum(float((q * q).sum()) for q in g.values()))
            for k, q in g.items():
                q = q * min(1.0, 1.0 / max(norm, 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * q
                v[k] = 0.99 * v[k] + 0.01 * q * q
                step = rate * min(1.0, 2 * (1 - s / (steps + 1)))
                self.p[k] = (self.p[k] - step * (m[k] / (1 - 0.9**s)) / (np.sqrt(v[k] / (1 - 0.99**s)) + 1e-6)).astype(np.float32)


def places(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows that texts are cut into, each text from its own beginning: text, first byte and number of bytes."""
    size = np.diff(offsets)
    per = -(-size // WINDOW)
    doc = np.repeat(np.arange(len(size)), per)
    start = offsets[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)) * WINDOW
    return doc, start, np.minimum(WINDOW, offsets[1:][doc] - start)


def filled(data: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Time-major windows, WINDOW x B, padded with 0."""
    at = np.minimum(np.arange(WINDOW)[:, None] + start[None, :], max(0, len(data) - 1))
    x = data[at] if len(data) else np.zeros(at.shape, np.uint8)
    x[np.arange(WINDOW)[:, None] >= count[None, :]] = 0
    return x


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of texts, the text of each, and how many of its bytes count."""
    doc, start, count = places(offsets)
    return filled(data, start, count), doc, count


def sample(docs: DataFrame, rows: int, seed: int) -> pa.Table:
    """(lang, text) of distinct labelled texts: all if there are at most `rows` labelled rows, else of each language of docs
    those with the lowest hashes, rows / languages of them but at least LEAST_ROWS. Neither copies nor the order of reading matter.

    Scale: the labelled rows are read three times; what is shuffled is a hash of each, and the texts that were picked."""
    known = docs.select("text", "lang").where("lang is not null and lang != '' and text is not null and text != ''")
    sizes = known.groupBy("lang").count().collect()
    each = rows if sum(r["count"] for r in sizes) <= rows else max(LEAST_ROWS, rows // len(sizes))
    hashed = known.withColumn("h", F.xxhash64("text", "lang", F.lit(seed)))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    lowest = hashed.select("lang", "h").distinct().withColumn("nth", nth).where(F.col("nth") <= each).select("lang", "h")
    return hashed.join(F.broadcast(lowest), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text").toArrow()


def train(docs: DataFrame, rows: int = TRAIN_ROWS, steps: int = 260, seed: int = 3) -> Network:
    """A network for all languages that docs are labelled with (column lang; null and '' are no label).

    Training reads a sample of about `rows` labelled texts, in which every language has its part (see sample), and of
    those all windows, weighted so that each language counts alike. No labelled row gives a network with the one language 'und'.
    """
    picked = sample(docs, rows, seed).combine_chunks()
    if not picked.num_rows:
        return Network(["und"], seed=seed)
    picked = picked.sort_by([("lang", "ascending"), ("text", "ascending")]).combine_chunks()
    labels = picked["lang"].to_pylist()
    net = Network(sorted(set(labels)), seed=seed)
    text = picked["text"].combine_chunks() if isinstance(picked["text"], pa.ChunkedArray) else picked["text"]
    x, doc, count = windows(*text_buffers(text))
    y = np.array([net.languages.index(v) for v in labels])[doc]
    share_of = np.bincount(y, minlength=len(net.languages))
    weight = (np.arange(WINDOW)[:, None] < count[None, :]) / np.maximum(share_of, 1)[y][None, :]
    net.fit(x, y, weight.astype(np.float32), steps, 256, 0.03, seed)
    return net


def _pool(net: Network, data: np.ndarray, offsets: np.ndarray, columns: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Summed log-probabilities of each text's positions by language, and the label of every byte. `columns` windows are scored at
    a time; a text's windows are its own, whatever it is scored with."""
    texts, langs = len(offsets) - 1, len(net.languages)
    total, labels = np.zeros((texts, langs)), np.empty(len(data), label_type(net))
    doc, start, count = places(offsets)
    for c in range(0, len(doc), columns):
        k, n = doc[c : c + columns], count[c : c + columns]
        s = net.scores(filled(data, start[c : c + columns], n))
        on = np.arange(WINDOW)[:, None] < n[None, :]
        labels[start[c] : start[c + len(k) - 1] + n[-1]] = s.argmax(1).T[on.T]
        s -= s.max(1, keepdims=True)
        s -= np.log(np.exp(s).sum(1, keepdims=True))
        s *= on[:, None, :]
        np.add.at(total, k, s.sum(0).T)
    return total, labels


def label_type(net: Network) -> np.dtype:
    """The type of a position's label: one byte, or two (low byte first) where there are more than 256 languages."""
    return np.dtype("u1" if len(net.languages) <= 256 else "<u2")


def identify(docs: DataFrame, net: Network, column: str = "text") -> DataFrame:
    """docs with language STRING, confidence DOUBLE, probabilities ARRAY<DOUBLE> (by net.languages) and positions BINARY;
    columns of these names are replaced.

    positions has one byte for every byte of the UTF-8 text (two, the low one first, where there are more than 256 languages): the
    number of that position's most likely language. The text's
    probabilities are the softmax of the mean log-probabilities of all its positions, sharpened by the root of their number up to 8;
    language is the likeliest (the first in alphabetical order on a tie) and confidence its probability. Null and empty
    texts get null language, confidence and probabilities, and null and empty positions. Texts of any length are read whole.
    An empty table gives none.

    Scale: no shuffle; the network has a few thousand numbers.
    """
    bounded(docs.sparkSession)
    docs, names = own_names(docs)
    net = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            data, offsets = text_buffers(texts)
            total, labels = _pool(net.value, data, offsets)
            size = np.diff(offsets)
            none = pa.array(size == 0, pa.bool_())
            mean = total / np.maximum(size, 1)[:, None] * np.minimum(8.0, np.sqrt(np.maximum(size, 1)))[:, None]
            p = np.exp(mean - mean.max(1, keepdims=True)) if len(mean) else mean
            p /= p.sum(1, keepdims=True) if len(p) else 1
            best = p.argmax(1) if len(p) else np.zeros(0, int)
            names = pa.array([None if s == 0 else net.value.languages[k] for k, s in zip(best, size, strict=True)], pa.string())
            top = pa.array(p.max(1) if len(p) else np.zeros(0), mask=size == 0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * len(net.value.languages)), pa.array(p.ravel()), mask=none if len(p) else None)
            marks = pa.Array.from_buffers(pa.large_binary(), len(p), [None, pa.py_buffer(np.ascontiguousarray(offsets * labels.itemsize)), pa.py_buffer(labels)]).cast(pa.binary())
            if texts.null_count:
                import pyarrow.compute as pc

                marks = pc.if_else(texts.is_null(), pa.scalar(None, pa.binary()), marks)
            yield pa.StructArray.from_arrays([names, top, lists, marks], ["language", "confidence", "probabilities", "positions"])
        release()

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    named = F.arrow_udf(run, "language string, confidence double, probabilities array<double>, positions binary")
    fresh = ("language", "confidence", "probabilities", "positions")
    own = [c for c in docs.columns if c.lower() not in fresh]
    return docs.withColumn("_pl_lang", named(F.col(column))).select(*own, *[f"_pl_lang.{c}" for c in fresh]).withColumnsRenamed(names)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs.select("doc_id", "text"), train(docs)).drop("text")
