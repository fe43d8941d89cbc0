"""Each operator against brute force on small fixtures, and its edge cases: nulls, empty and long texts, ties, repeats, clashes."""

from __future__ import annotations

import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import bpe, capture_index, components, induced, jaccard, langid, mixing, near_vectors, pii, sharding, suffix_dedup, topk

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i}" for i in range(30_000))


def doc_rows():
    base = "the quick brown fox jumps over the lazy dog and runs far away into the deep dark forest at night"
    return [
        (1, base, "en", "a", 95),
        (2, base, "en", "a", 95),
        (2, base, "en", "a", 95),
        (3, base.replace("lazy", "sleepy"), "en", "b", 97),
        (4, "", "en", "b", 0),
        (5, None, "en", None, None),
        (None, "quite another text with mail to jo.1@mail7.example.com and 4000123412341234", "en", "b", -3),
        (6, LONG, "en", "c", len(LONG)),
        (7, " \n\t!!", None, "c", 5),
        (8, "one", "", "c", 3),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(doc_rows(), DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def clash(df, *names):
    for n in names:
        df = df.withColumn(n, F.lit("own"))
    return df


# operator 1


def test_capture_index_matches_brute_force(spark):
    urls = ["https://www.A.example.com/x?y=1#z", "http://a.example.com/x?y=1", "http://b.example.com", None, "", "no-host", "http://u@c.example.com:80/p"] + [f"http://d.example.com/{i % 40}" for i in range(400)]
    rows = [(None if i == 1 else i, u, None if i == 2 else f"<p>{i}") for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    captures = capture_index.captures_of(pages)
    index = capture_index.CaptureIndex.build(captures, block_lines=7)
    got = {r["key"]: (r["captures"], r["first_id"], r["last_id"]) for r in index.resolve(captures).collect()}
    want = {}
    for r in captures.collect():
        if r["key"] is not None:
            want.setdefault(r["key"], []).append(r["page_id"])
    assert got == {k: (len(v), min((i for i in v if i is not None), default=None), max((i for i in v if i is not None), default=None)) for k, v in want.items()}
    assert "com,example,a)/x?y=1" in got and "com,example,b)/" in got and "com,example,c)/p" in got and "no-host" in got
    assert len(index.lookup("com,example,d)/7")) == 10 and index.lookup("com,example,zzz)/") == []
    missing = spark.createDataFrame([("com,example,zzz)/",), (None,)], "key string")
    assert [tuple(r) for r in index.resolve(missing).collect()] == [("com,example,zzz)/", 0, None, None)]


def test_capture_index_of_keys_with_signs_of_its_own(spark):
    keys = ["a\tb", "a!b", "a#b", "a$c", "a%09b", "a%b", "a\nb", "a\\b", "", "a" * 100_000, "a" * 100_001] * 2 + [None]
    captures = spark.createDataFrame([(k, i, "own") for i, k in enumerate(keys)], "key string, page_id long, line string")
    index = capture_index.CaptureIndex.build(captures, block_lines=2)
    got = {r["key"]: (r["captures"], r["first_id"], r["last_id"]) for r in index.resolve(captures.union(spark.createDataFrame([("a%c", 1, "")], captures.schema))).collect()}
    assert got == {k: (2, i, i + 11) for i, k in enumerate(keys[:11])} | {"a%c": (0, None, None)}
    assert [x["page_id"] for x in index.lookup("a\tb")] == [0, 11]


def test_capture_index_of_an_empty_table(spark):
    captures = capture_index.captures_of(spark.createDataFrame([], "page_id long, url string, html string"))
    assert capture_index.CaptureIndex.build(captures).resolve(captures).collect() == []


# operator 2


def test_hypergeometric_draws_follow_the_law():
    rng = np.random.default_rng(4)
    for good, bad, n in ((5, 9, 6), (300, 40, 170), (3, 3, 6), (7, 0, 4), (0, 7, 4), (50, 60, 1)):
        got = np.bincount(sharding.hypergeometric(rng, np.full(40_000, good), bad, n), minlength=n + 1)
        law = np.array([math.comb(good, k) * math.comb(bad, n - k) for k in range(n + 1)]) / math.comb(good + bad, n) * 40_000
        some = law > 8
        assert got[law == 0].sum() == 0 and ((got[some] - law[some]) ** 2 / law[some]).sum() < some.sum() + 5 * math.sqrt(2 * some.sum())
    # Beyond 10^9: mean and spread of the law, and a table of 10^13 rows.
    good, bad, n = 3 * 10**12, 7 * 10**12, 10**11
    x = sharding.hypergeometric(rng, np.full(4000, good), bad, n) - n * 0.3
    sd = math.sqrt(n * 0.3 * 0.7 * (1 - n / (good + bad)))
    assert abs(x.mean()) < 5 * sd / math.sqrt(4000) and 0.95 < x.std() / sd < 1.05


def test_matrix_rows_have_exact_margins():
    for before, sizes in (([0, 5, 5, 17, 40], [13, 13, 14]), ([0, 7], [3, 4]), ([0, 3 * 10**12, 10**13], [25 * 10**11] * 4)):
        before, sizes = np.array(before), np.array(sizes)
        m = np.stack([sharding.matrix_row(before, sizes, p, 3) for p in range(len(before) - 1)])
        assert (m >= 0).all() and m.sum(1).tolist() == np.diff(before).tolist() and m.sum(0).tolist() == sizes.tolist()


@pytest.mark.parametrize("shard_rows", [3, 4, 100])
def test_sharding_keeps_rows_and_sizes(spark, docs, none, shard_rows):
    d = clash(docs, "shard", "_pl_row", "_pl_key").union(clash(docs, "shard", "_pl_row", "_pl_key"))
    out = sharding.shuffle_to_shards(d, shard_rows).collect()
    sizes = Counter(r["shard"] for r in out)
    assert [sizes[i] for i in range(len(sizes))] == sharding.shard_sizes(d.count(), len(sizes)).tolist() and len(sizes) == -(-len(out) // shard_rows)
    assert all(sorted(r["position"] for r in out if r["shard"] == k) == list(range(n)) for k, n in sizes.items())
    assert Counter((r["doc_id"], r["text"], r["_pl_row"], r["_pl_key"]) for r in out) == Counter((r[0], r[1], "own", "own") for r in doc_rows() * 2)
    assert sharding.shuffle_to_shards(none).collect() == []


def test_buckets_of_many_shards_are_cut_as_their_sizes_say(spark):
    d = spark.range(1000).repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for rows in (7, 8, 3):
            out = sharding.shuffle_to_shards(d, rows).collect()
            sizes = Counter(r["shard"] for r in out)
            assert [sizes[i] for i in range(len(sizes))] == sharding.shard_sizes(1000, -(-1000 // rows)).tolist()
            assert sorted(r["id"] for r in out) == list(range(1000)) and len({(r["shard"], r["position"]) for r in out}) == 1000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_sharding_is_uniform_and_repeatable(spark):
    d = spark.range(400, numPartitions=5).withColumnRenamed("id", "doc_id")
    hits = np.zeros((4, 4))
    for seed in range(12):
        rows = sharding.shuffle_to_shards(d, shard_rows=100, seed=seed).collect()
        for r in rows:
            hits[r["doc_id"] // 100, r["shard"]] += 1
    chi = ((hits - 300) ** 2 / 300).sum()
    assert chi < 30, hits  # 9 degrees of freedom, a little less variance than multinomial
    again = sharding.shuffle_to_shards(d, shard_rows=100, seed=11).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


# operator 3


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.model_bytes(bpe.read_ranks(bpe.VOCABULARY)))


def test_bpe_equals_merging_by_rank(codec):
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(bpe.VOCABULARY))}

    def brute(word):
        parts = [bytes([b]) for b in word.encode()]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 30))
            if parts[best] + parts[best + 1] not in ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [ranks[p] for p in parts]

    for text in ["", "Hello  world's\n\n end ", "ção naïve 😀 \x00\x01", "▁a ▁ b", "<unk><|endoftext|>", "aaaaaaaaaaaaaaa 12345 $$$ ...", "   "]:
        assert codec.encode(text).tolist() == [i for w in codec.split(text) for i in brute(w)]
        assert codec.decode(codec.encode(text)) == text


def test_bpe_cache_and_batches_change_nothing(codec, monkeypatch):
    texts = [LONG[:5000], "", "the end", LONG[2000:9000]]
    want = [codec.encode(t).tolist() for t in texts]
    monkeypatch.setattr(bpe, "CACHE", 3)
    assert [x.tolist() for x in codec.encode_many(texts)] == want


def test_bpe_edge_cases(docs, none):
    rows = bpe.tokenize(clash(docs, "tokens")).collect()
    assert len(rows) == 10
    for r in rows:
        if r["text"] is None:
            assert r["tokens"] is None and r["n_tokens"] is None and r["round_trip"] is None
        else:
            assert r["round_trip"] and r["n_tokens"] == len(r["tokens"]) and (r["n_tokens"] > 0) == (r["text"] != "")
    assert bpe.tokenize(none).collect() == []


# operator 4


def union_find(vertices, edges):
    up = {v: v for v in vertices}

    def root(v):
        while up[v] != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {v: root(v) for v in vertices}


def test_near_vectors_match_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(60, 16))
    x = np.concatenate([base, base[:20] + rng.normal(size=(20, 16)) * 0.05, base[:5], base[:1] + rng.normal(size=(40, 16)) * 0.02]).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    odd = [(None, [1.0] * 16, 0), (900, None, 0), (901, [], 0), (902, [0.0] * 16, 0), (903, [1.0, None] * 8, 0), (904, [float("nan")] * 16, 0), (905, [1.0] * 3, 0), (3, x[3].tolist(), 1)]
    t = clash(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int"), "component", "id", "key")
    got = {r["vec_id"]: r["component"] for r in near_vectors.near_duplicates(t, threshold=0.95, chunk=16).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    want = union_find(range(len(x)), np.argwhere(np.triu(u @ u.T >= 0.95, 1)).tolist())
    assert got.keys() == want.keys() and sum(got[k] == want[k] for k in want) >= 0.95 * len(want)
    assert near_vectors.near_duplicates(t.limit(0)).collect() == []


@pytest.mark.parametrize("single", [0, 1_000_000])
def test_components_by_both_ways(spark, single):
    edges = [(i, i + 1) for i in range(30)] + [(100, 90), (90, 95), (7, 7), (200, 201), (201, 200), (None, 3)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long"), single).collect()}
    plain = [e for e in edges if None not in e and e[0] != e[1]]
    assert got == union_find({v for e in plain for v in e}, plain)


# operator 5


def gram_set(text, n=3):
    import re

    w = re.findall("[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
    return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {" ".join(w)} if w else set()


def near_copies(seed=0, n=120):
    rng = np.random.default_rng(seed)
    vocab = np.array([f"v{i}" for i in range(400)])
    rows = []
    for i in range(n):
        words = rng.choice(vocab, 80)
        if i % 3:
            words = np.array(rows[i - 1][1].split())
            words[rng.integers(0, 80, rng.integers(0, 12))] = "x"
        rows.append((i, " ".join(words), "en", "s", 9))
    return rows


def brute_classes(texts, ids, threshold=0.5):
    """(doc_id, class_id, links) by comparing all pairs of rows."""
    sets = [gram_set(t) for t in texts]
    near = [[j for j in range(len(sets)) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold] for i in range(len(sets))]
    out = []
    for i in range(len(sets)):
        seen, todo = {i}, [i]
        while todo:
            new = [j for j in near[todo.pop()] if j not in seen]
            seen.update(new)
            todo += new
        out.append((ids[i], min((ids[j] for j in seen if ids[j] is not None), default=None), len(near[i])))
    return Counter(out)


@pytest.mark.parametrize("chunk", [1024, 3])
def test_near_copies_match_brute_force(spark, chunk):
    rows = near_copies()
    rows += [(900 + i, rows[i % 7][1], "en", "s", 9) for i in range(20)]  # groups of equal texts
    got = Counter(map(tuple, jaccard.near_copies(spark.createDataFrame(rows, DOCS), chunk=chunk).collect()))
    want = brute_classes([r[1] for r in rows], [r[0] for r in rows])
    assert sum(links > 0 for _, _, links in want) > 60 and got == want


def test_near_copies_at_the_threshold(spark):
    # 1 2 3 and 2 3 4 of four and five words: two grams of which one is shared, 1/3; then 2 of 4, exactly 1/2.
    texts = ["a b c d", "b c d e", "p q r s t", "p q r s u", "p q r s t"]
    got = jaccard.near_copies(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)).collect()
    assert Counter(map(tuple, got)) == brute_classes(texts, list(range(5))) == Counter([(0, 0, 0), (1, 1, 0), (2, 2, 2), (3, 2, 2), (4, 2, 2)])


def test_jaccard_edge_cases(docs, none):
    got = jaccard.near_copies(clash(docs, "component", "a", "rep", "sig", "_pl_row", "links")).collect()
    assert Counter(map(tuple, got)) == brute_classes([r[1] for r in doc_rows()], [r[0] for r in doc_rows()])
    assert (2, 1, 3) in map(tuple, got) and (4, 4, 0) in map(tuple, got) and (None, None, 0) in map(tuple, got)
    assert jaccard.near_copies(none).collect() == []
    kept = jaccard.one_of_each(clash(docs, "component", "_pl_row")).collect()
    assert sorted((r["doc_id"] or 0) for r in kept) == [0, 1, 4, 5, 6, 7, 8] and all(r["component"] == r["_pl_row"] == "own" for r in kept)
    assert jaccard.one_of_each(none).collect() == []


def test_bayes_limits_are_the_posterior_tail():
    for n, m in jaccard.least_matches(0.5, 1e-4):
        grid = np.linspace(0, 1, 200_001)[1:-1]
        for k, keeps in ((m, True), (m - 1, False)):
            density = grid**k * (1 - grid) ** (n - k)
            assert (density[grid >= 0.5].sum() / density.sum() >= 1e-4 * 0.999) == keeps


# operator 6


def test_pii_forms():
    text = 'Mail a.b@mail7.example.com, call +1 (017) 555-7713 or 555-123-4567; from 10.0.255.1: 4000123412341234. token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce" Version 2.0. in 2026'
    found = [(k, m) for _, _, k, m, _ in pii.finder({})(text)]
    assert found == [("email", "a.b@mail7.example.com"), ("phone", "+1 (017) 555-7713"), ("phone", "555-123-4567"), ("ip", "10.0.255.1"), ("card", "4000123412341234"), ("secret", "b44e15e09fd311c3cf3163b66d5a9875b883d8ce")]
    assert all(text[s : s + n] == m for s, n, _, m, _ in pii.finder({})(text))


def test_pii_patterns_discover_what_seeds_do_not_show(spark):
    rows = [(i, f"please mail to u{i}@mail7.example.com now", "en", "s", 1) for i in range(40)]
    rows += [(100, "please mail to u77@mail7 now", "en", "s", 1), (101, "version u77 of it", "en", "s", 1)]
    rows += [(200 + i, f"badge no {1000 + i} and again u{i}@corp{i}.example.com", "en", "s", 1) for i in range(9)]
    d = spark.createDataFrame(rows, DOCS)
    model = {r["pattern"]: r["kind"] for r in pii.bootstrap(d).collect()}
    assert model["L2|mail to|a99@a9.a.a"] == "email" and not any("badge" in p for p in model)
    found = pii.identifiers(d).collect()
    assert {r["doc_id"] for r in found} >= set(range(40)) and not any(r["doc_id"] == 101 for r in found)


def test_pii_contexts_discover_forms_of_their_own(spark):
    rows = [(i, f"please mail to u{i}@mail7.example.com now", "en", "s", 1) for i in range(40)]
    rows += [(100, "please mail to u77@mail7 now", "en", "s", 1), (101, "version u77 of it", "en", "s", 1)]
    rows += [(200 + i, f"badge no {1000 + i} and again u{i}@corp{i}.example.com", "en", "s", 1) for i in range(9)]
    rows += [(300 + i, f"her phone is 555-{100 + i}-4567 today", "en", "s", 1) for i in range(20)]
    rows += [(400, "her phone is +44 20 7946 0958 today", "en", "s", 1), (401, "she wants 20 7946 of them", "en", "s", 1)]
    rows += [(500 + i, f"pay into account DE{10 + i}3704004405320130{10 + i} please", "en", "s", 1) for i in range(20)]
    rows += [(600, "pay into account 70412236 please", "en", "s", 1), (601, "of GB29 NWBK 6016 1331 9268 19 AND NO93 8601 1117 947", "en", "s", 1)]
    found = {}
    for r in pii.identifiers(spark.createDataFrame(rows, DOCS)).collect():
        found.setdefault(r["doc_id"], []).append((r["kind"], r["identifier"]))
    assert found[100] == [("email", "u77@mail7")] and found[400] == [("phone", "+44 20 7946 0958")] and found[600] == [("iban", "70412236")]
    assert found[601] == [("iban", "GB29 NWBK 6016 1331 9268 19"), ("iban", "NO93 8601 1117 947")]
    assert 101 not in found and 401 not in found and all(len(found[200 + i]) == 1 for i in range(9))


def test_pii_by_join_equals_pii_by_shipping(docs, none, monkeypatch):
    a = sorted(map(str, pii.identifiers(docs).collect()))
    cleaned = {r["text"] for r in pii.redact(clash(docs, "kind", "start", "score")).collect()}
    monkeypatch.setattr(pii, "MODEL_ROWS", -1)
    assert len(a) == 2 and sorted(map(str, pii.identifiers(docs).collect())) == a
    assert "quite another text with mail to <EMAIL> and <CARD>" in cleaned and len(cleaned) == 8
    assert pii.identifiers(none).collect() == [] and pii.redact(none).collect() == []


def brute_patterns(texts, rounds=3, support=3, trust=0.8):
    """bootstrap by loops over dictionaries."""
    edges, kinds = {}, {}
    for t in texts:
        for _, _, m, before, after in pii.mentions(t or ""):
            kinds[m] = pii.seed_kind(m)
            for p in pii.patterns_of(m, before, after):
                edges.setdefault(p, set()).add(m)
    scores = {m: {k: 1.0} for m, k in kinds.items() if k}
    for r in range(rounds):
        trusted = {}
        for p, ms in edges.items():
            if len(ms) >= support:
                for k in {k for m in ms for k in scores.get(m, {})}:
                    mass = sum(scores.get(m, {}).get(k, 0.0) for m in ms) / (len(ms) + 1)
                    if mass >= trust:
                        trusted[p, k] = mass
        scores = {m: {k: 1.0} for m, k in kinds.items() if k}
        for (p, k), v in trusted.items():
            for m in edges[p]:
                if not kinds[m]:
                    scores.setdefault(m, {})[k] = 1 - (1 - scores.get(m, {}).get(k, 0.0)) * (1 - v)
    out = {}
    for (p, k), v in sorted(trusted.items(), key=lambda x: (-x[1], x[0][1])):
        out.setdefault(p, (k, v))
    return out


def test_pii_equals_loops_over_dictionaries(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in d.collect()]
    model = brute_patterns([t for _, t in texts])
    got = {r["pattern"]: (r["kind"], r["score"]) for r in pii.bootstrap(d).collect()}
    assert model and got.keys() == model.keys() and all(got[p][0] == k and got[p][1] == pytest.approx(v) for p, (k, v) in model.items())
    find = pii.finder(model)
    want = Counter((i, s, n, k, m) for i, t in texts for s, n, k, m, _ in find(t or ""))
    assert Counter((r["doc_id"], r["start"], r["length"], r["kind"], r["identifier"]) for r in pii.identifiers(d).collect()) == want


def test_pii_context_words_are_whole():
    long, text = "q" * 5000, "x" * 300
    assert [m[2:] for m in pii.mentions(f"{text} {long} jo@a.com {long}z end")] == [("jo@a.com", f"{text} {long}", f"{long}z")]
    assert [m[2:] for m in pii.mentions("a, (b)   9,c\nd 8")] == [("9", "a b", "c"), ("8", "d", "")]
    many = "u1@a.com," * 40_000
    assert sum(1 for _ in pii.mentions(many)) == 40_000  # one word of white space's making, and still linear


def test_pii_redaction_sets_lengths(docs):
    rows = {r["doc_id"]: r for r in pii.redact(docs).collect()}
    assert rows[None]["n_chars"] == len(rows[None]["text"]) and rows[1]["n_chars"] == 95 and rows[5]["text"] is None


# operator 7


def test_gradient_by_differences():
    net = langid.Network(["a", "b"], units=3, seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(97, 105, (6, 5)), np.array([0, 1, 0, 1, 1])
    w = np.ones((6, 5), np.float32)
    _, g = net.gradient(x, y, w)
    for k in net.p:
        for at in [tuple(rng.integers(0, s) for s in net.p[k].shape) for _ in range(6)]:
            if k[0] == "e":
                at = (int(x[0, 0]), at[1])
            old, e = net.p[k][at], 1e-2
            net.p[k][at] = old + e
            up, _ = net.gradient(x, y, w)
            net.p[k][at] = old - e
            down, _ = net.gradient(x, y, w)
            net.p[k][at] = old
            assert abs((up - down) / (2 * e) - g[k][at]) < 2e-2 * max(1, abs(g[k][at])), (k, at)


def test_languages_on_held_out_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    net = langid.train(docs.where(half), rows=400, steps=150)
    rows = langid.identify(docs.where(~half), net).collect()
    right = sum(r["language"] == r["lang"] for r in rows)
    assert right >= 0.95 * len(rows)
    assert all(len(r["positions"]) == len(r["text"].encode()) and sum(r["probabilities"]) == pytest.approx(1) for r in rows)


def test_every_labelled_language_is_in_the_sample(spark):
    rows = [(i, "the same text again and again", "en", "s", 1) for i in range(2000)] + [(2000 + i, f"text number {i} of many", "en", "s", 1) for i in range(1000)]
    rows += [(5000 + i, f"teksto numero {i}", f"x{i}", "s", 1) for i in range(20)] + [(6000 + i, f"noch ein Text {i}", "de", "s", 1) for i in range(300)]
    d = spark.createDataFrame(rows, DOCS)
    picked = [(r["lang"], r["text"]) for r in langid.sample(d, 220, 3).to_pylist()]
    assert len(picked) == len(set(picked)) and Counter(lang for lang, _ in picked) == {"en": 10, "de": 10} | {f"x{i}": 1 for i in range(20)}
    assert sorted(picked) == sorted((r["lang"], r["text"]) for r in langid.sample(d.orderBy(F.desc("doc_id")).repartition(7), 220, 3).to_pylist())
    assert langid.train(d, rows=220, steps=1).languages == sorted({r[2] for r in rows})


def loop_scores(net, text):
    """Logits of every position, one step at a time."""
    h, out = net.units, []
    for a in range(0, len(text), langid.WINDOW):
        x = np.frombuffer(text[a : a + langid.WINDOW], np.uint8)
        pad = np.concatenate([x, np.zeros(langid.WINDOW - len(x), np.uint8)])
        states = []
        for e, u, seq in ((net.p["ef"], net.p["uf"], pad), (net.p["eb"], net.p["ub"], pad[::-1])):
            s, each = np.zeros(h), []
            for c in seq:
                g, v = u @ s, e[c]
                z, r = (np.clip(v[k * h : (k + 1) * h] + g[k * h : (k + 1) * h], 0, 1) for k in (0, 1))
                n = np.clip(v[2 * h :] + r * g[2 * h :], -1, 1)
                s = z * s + (1 - z) * n
                each.append(s)
            states.append(each)
        for t in range(len(x)):
            out.append(net.p["w"][:, :h] @ states[0][t] + net.p["w"][:, h:] @ states[1][langid.WINDOW - 1 - t] + net.p["b"])
    return np.array(out)


def test_language_scores_equal_a_loop_and_ignore_batches(spark):
    net = langid.Network(["a", "b", "c"], units=4, seed=2)
    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(97, 123, n, np.uint8)) for n in (1, langid.WINDOW, langid.WINDOW + 1, 5 * langid.WINDOW - 3, 0, 40)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    want = [loop_scores(net, t) if t else np.zeros((0, 3)) for t in texts]
    logs = [w - np.log(np.exp(w).sum(1, keepdims=True)) for w in want]
    for columns in (1, 3, 2048):
        total, labels = langid._pool(net, data, offsets, columns)
        assert np.allclose(total, [x.sum(0) for x in logs], rtol=1e-4, atol=1e-3)
        assert (labels == np.concatenate([w.argmax(1) for w in want])).mean() > 0.99
    long = bytes(rng.integers(97, 123, (8 << 20) + 1000, np.uint8))
    alone, mine = langid._pool(net, np.frombuffer(texts[3], np.uint8), offsets[[0, 4]] * [0, 1] + [0, -offsets[3]])
    both, labels = langid._pool(net, np.frombuffer(long + texts[3], np.uint8), np.array([0, len(long), len(long) + len(texts[3])]))
    assert np.allclose(both[1], alone[0], atol=1e-3) and (labels[len(long) :] == mine).all()


def test_more_languages_than_a_byte_counts(spark):
    net = langid.Network([f"x{i:03d}" for i in range(300)], units=2, seed=1)
    row = langid.identify(spark.createDataFrame([(1, "abcdefgh" * 10, "own")], "doc_id long, text string, _pl_lang string"), net).first()
    marks = np.frombuffer(bytes(row["positions"]), "<u2")
    assert len(marks) == 80 and marks.max() < 300 and row["_pl_lang"] == "own"


def test_language_edge_cases(spark, docs, none):
    net = langid.Network(["de", "en"])
    rows = {r["doc_id"]: r for r in langid.identify(clash(docs, "language", "positions"), net).collect()}
    assert rows[5]["language"] is None and rows[5]["positions"] is None and rows[4]["confidence"] is None and bytes(rows[4]["positions"]) == b""
    assert len(rows[6]["positions"]) == len(LONG) and rows[8]["language"] in ("de", "en")
    assert langid.identify(none, net).collect() == []
    assert langid.train(none).languages == ["und"] and langid.train(docs.where("doc_id = 7")).languages == ["und"]


# operator 8


def test_suffixes_and_prefixes_by_brute_force(tmp_path):
    rng = np.random.default_rng(0)
    for r in range(300):
        n, k = int(rng.integers(0, 60)), int(rng.integers(1, 6))
        t = np.append(np.tile(rng.integers(1, k + 1, max(1, n // 6)), 6) if r % 3 == 0 else rng.integers(1, k + 1, n), 0)
        sa, lcp = induced.suffixes(t, induced.Spill(str(tmp_path / str(r)), 5 if r % 2 else 1000))
        s = t.tolist()
        want = sorted(range(len(s)), key=lambda i: s[i:])
        assert sa.tolist() == want
        for i, (a, b) in enumerate(zip(want, want[1:]), 1):
            assert lcp[i] == next(c for c in range(len(s)) if s[a + c : a + c + 1] != s[b + c : b + c + 1])


def brute_passages(rows, n):
    import re

    texts = [re.findall("[a-z0-9\x80-\U0010ffff]+", (t or "").lower()) for t in rows]
    seen = {}
    for r, w in enumerate(texts):
        for i in range(len(w) - n + 1):
            seen.setdefault(tuple(w[i : i + n]), set()).add(r)
    out = []
    for w in texts:
        on = [False] * len(w)
        for i in range(len(w) - n + 1):
            if len(seen[tuple(w[i : i + n])]) > 1:
                on[i : i + n] = [True] * n
        i = 0
        for value, run in itertools.groupby(on):
            k = len(list(run))
            if value:
                out.append((i, i + k))
            i += k
    return Counter(out)


@pytest.mark.parametrize(("family_words", "limit"), [(10**6, 10**6), (50, 40)])
def test_passages_match_brute_force(spark, family_words, limit):
    rng = np.random.default_rng(3)
    vocab = [f"v{i}" for i in range(60)]
    parts = [" ".join(rng.choice(vocab, rng.integers(8, 40))) for _ in range(12)]
    texts = [" ".join(rng.choice(parts, rng.integers(1, 5))) + " " + " ".join(rng.choice(vocab, 15)) for _ in range(60)]
    texts += [texts[0], texts[0], None, "", "v1 " * 70, "v1 " * 90]
    rows = [(i % 50 or None, t, "en", "s", 1) for i, t in enumerate(texts)]
    got = suffix_dedup.repeated_passages(clash(spark.createDataFrame(rows, DOCS), "region", "family", "s"), 10, 200, family_words, limit).collect()
    assert Counter((r["start_word"], r["end_word"]) for r in got) == brute_passages(texts, 10)


def test_passages_edge_cases(docs, none):
    got = suffix_dedup.repeated_passages(docs, 10).collect()
    assert {r["doc_id"] for r in got} == {1, 2, 3}
    assert suffix_dedup.repeated_passages(none).collect() == []


# operator 9


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(300, 12)) * rng.gamma(1, 1, (300, 1))).astype(np.float32)
    x[50:60] = x[40]  # ties
    x[70] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(None, [1.0] * 12), (500, None), (501, [1.0]), (502, [float("nan")] * 12), (503, [None] * 12)]
    t = clash(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "rank", "score", "norm")
    got = {(r["vec_id"], r["rank"]): (r["neighbor_id"], r["score"]) for r in topk.top_k(t, 5, block=32, queries=64).collect()}
    s = np.round(x.astype(np.float64) @ x.astype(np.float64).T, 9)
    for i in range(300):
        order = sorted((j for j in range(300) if j != i), key=lambda j: (-s[i, j], j))[:5]
        assert [got[i, r + 1][0] for r in range(5)] == order
    assert len(got) == 1500 and topk.top_k(t.limit(0)).collect() == []
    some = topk.top_k(t, 5, t.where("vec_id % 20 = 0"), block=32, queries=4).collect()
    assert {(r["vec_id"], r["rank"]): (r["neighbor_id"], r["score"]) for r in some} == {k: v for k, v in got.items() if k[0] % 20 == 0}
    assert topk.top_k(t, 5, t.limit(0)).collect() == []


def test_top_k_of_repeated_rows(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [3.0, 0.0]), (3, [0.5, 1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 3, block=2).collect()
    want = Counter()
    for i, (a, x) in enumerate(rows):
        order = sorted(((-float(np.dot(x, y)), b) for b, y in rows if b != a))[:3]
        want.update((a, r, b, -s) for r, (s, b) in enumerate(order, 1))
    assert Counter(map(tuple, got)) == want


# operator 10


def test_mixing_has_exact_sizes_and_expected_inclusion(spark):
    rows = [(i, f"t{i}", "en", "big" if i < 300 else "small", 10 ** (i % 5)) for i in range(340)]
    d = spark.createDataFrame(rows, DOCS)
    seen = Counter()
    for seed in range(30):
        out = mixing.mix(d, {"big": 1, "small": 1, "absent": 5}, seed=seed).collect()
        per = Counter()
        for r in out:
            per[r["source"]] += r["copies"]
            seen[r["doc_id"]] += r["copies"]
        assert per == {"big": 170, "small": 170}
    bits = {i: len(bin(10 ** (i % 5))) - 2 for i in range(340)}
    total = {s: sum(bits[i] for i in r) for s, r in (("big", range(300)), ("small", range(300, 340)))}
    for k in range(5):
        ids = [i for i in range(300) if i % 5 == k]
        want = 170 * sum(bits[i] for i in ids) / total["big"] * 30
        assert abs(sum(seen[i] for i in ids) - want) < 5 * math.sqrt(want)
    for i in range(300, 340):
        want = 170 * bits[i] / total["small"]
        assert math.floor(want) * 30 <= seen[i] <= math.ceil(want) * 30


def test_mixing_edge_cases(docs, none):
    out = mixing.mix(clash(docs, "copies", "whole"), epochs=2.0)
    rows = out.collect()
    assert sum(r["copies"] for r in rows) == 20 and out.columns == [*docs.columns, "whole", "copies"]
    assert mixing.repeated(out).count() == 20 and mixing.repeated(out).columns == [*docs.columns, "whole"]
    assert mixing.mix(none).collect() == []
    assert mixing.mix(docs, {"absent": 1.0}).collect() == [] and mixing.mix(docs, {}).collect() == [] and mixing.mix(docs, {"a": 0.0}).collect() == []
    kept = mixing.mix(clash(docs, "_pl_src", "_pl_q")).collect()
    assert kept and all(r["_pl_src"] == r["_pl_q"] == "own" for r in kept)


def test_mixing_of_equal_rows_keeps_the_size(spark):
    d = spark.createDataFrame([(1, "t", "en", "s", 5)] * 7 + [(2, "u", "en", "r", 5)] * 3, DOCS)
    assert sum(r["copies"] for r in mixing.mix(d, {"s": 1, "r": 1}, epochs=0.8).collect()) == 8
