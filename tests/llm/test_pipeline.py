"""The pipeline's stages against brute force on small fixtures, with nulls, empty and long texts, repeats, ties and clashing columns."""

from __future__ import annotations

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import bpe, langid, pii

from .test_llm_operators import DOCS, LONG, brute_patterns, clash, gram_set


def rows():
    base = "the quick brown fox jumps over the lazy dog and runs far away into the deep dark forest at night"
    out = [(i, base + f" number {i % 3}", "en", "ab"[i % 2], 100) for i in range(8)]
    out += [(20 + i, f"some other words about thing {i} {'xyz' * i} and of a kind that none has", "en", "b", 60) for i in range(12)]
    out += [(40, "", "en", "a", 0), (41, None, "en", None, None), (42, " \n!!", "de", "c", 4), (None, base, "en", "a", 96), (43, LONG, "en", "c", len(LONG)), (44, LONG, "en", "c", len(LONG)), (43, LONG, "en", "c", len(LONG))]
    out += [(60 + i, f"please mail to user{i}@host{i}.example.com about it {'word' * i}", "en", "d", 50) for i in range(6)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return clash(spark.createDataFrame(rows(), DOCS), "language", "component", "copies", "_pl_row", "found", "tokens_")


def plain(df):
    return Counter(tuple(r) for r in df.collect())


def test_language_keeps_what_the_network_is_sure_of(spark, docs):
    kept = corpus_pipeline.language(spark, docs, "")
    assert kept.columns == docs.columns
    net = langid.train(docs)
    sure = {(r["doc_id"], r["text"]): r["language"] for r in langid.identify(docs.select("doc_id", "text"), net).collect() if r["confidence"] is not None and r["confidence"] >= corpus_pipeline.MIN_CONFIDENCE}
    got = kept.collect()
    assert {(r["doc_id"], r["text"]) for r in got} == set(sure) and all(r["lang"] == sure[r["doc_id"], r["text"]] and r["language"] == "own" for r in got)
    assert not any(r["text"] in (None, "") for r in got)


def test_near_duplicates_keep_one_of_each_class(spark, docs):
    all_, texts = rows(), [gram_set(r[1]) for r in rows()]
    n = len(all_)
    label = list(range(n))
    for i in range(n):
        for j in range(i):
            if texts[i] and texts[j] and len(texts[i] & texts[j]) / len(texts[i] | texts[j]) >= 0.5:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    best = {}
    for i, r in enumerate(all_):
        key = (r[0] is None, r[0] or 0, i)
        if texts[i]:
            best[label[i]] = min(best.get(label[i], key), key)
    want = Counter((all_[k[2]][0], all_[k[2]][1]) for k in best.values()) + Counter((r[0], r[1]) for i, r in enumerate(all_) if not texts[i])
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns and Counter((r["doc_id"], r["text"]) for r in kept.collect()) == want


def test_private_data_is_replaced_as_loops_replace_it(spark, docs):
    model = brute_patterns([r[1] for r in rows()])
    find = pii.finder(model)
    want = Counter()
    for i, text, _, _, size in rows():
        out, at = "", 0
        found = find(text or "")
        for start, length, kind, _, _ in found:
            out, at = out + text[at:start] + f"<{kind.upper()}>", start + length
        new = out + text[at:] if found else text
        want[i, new, len(new) if found else size] += 1
    done = corpus_pipeline.private_data(spark, docs, "")
    assert done.columns == docs.columns and Counter((r["doc_id"], r["text"], r["n_chars"]) for r in done.collect()) == want
    assert sum("<EMAIL>" in (k[1] or "") for k in want) == 6


def test_mixture_has_the_targets_rows(spark, docs):
    mixed = corpus_pipeline.mixture(spark, docs, "")
    got, have = Counter(r["source"] or "" for r in mixed.collect()), Counter(r[3] or "" for r in rows())
    total, upto, want = sum(math.sqrt(n) for n in have.values()), 0.0, {}
    for s in sorted(have):
        low, upto = upto, upto + math.sqrt(have[s])
        want[s] = math.floor(len(rows()) * upto / total + 0.5) - math.floor(len(rows()) * low / total + 0.5)
    assert mixed.columns == docs.columns and dict(got) == {s: n for s, n in want.items() if n} and all(r["copies"] == "own" for r in mixed.collect())


def test_tokens_decode_to_the_text(spark, docs):
    codec = bpe.Codec(bpe.model_bytes(bpe.read_ranks(bpe.VOCABULARY)), bpe.PATTERN)
    out = corpus_pipeline.tokens(spark, docs, "").collect()
    assert len(out) == len(rows())
    texts = {(r[0], r[2], r[3]): r[1] for r in rows()}
    for r in out:
        text = texts[r["doc_id"], r["lang"], r["source"]]
        if text is None:
            assert r["tokens"] is None and r["n_tokens"] is None
        else:
            import numpy as np

            assert r["round_trip"] and r["n_tokens"] == len(r["tokens"]) and codec.decode(np.array(r["tokens"], np.int32)) == text


def test_stages_of_empty_tables(spark, docs):
    none = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, "")
        assert out.collect() == [], name
        assert name == "tokens" or out.columns == docs.columns


def test_the_whole_pipeline(spark, docs, tmp_path):
    spark.createDataFrame(rows(), DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "private_data", "mixture", "tokens"]
    got = out.agg(F.count(F.lit(1)).alias("n"), F.min("round_trip").alias("ok")).first()
    assert 0 < got["n"] <= len(rows()) and got["ok"]
