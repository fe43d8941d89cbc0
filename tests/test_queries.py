"""Every registered query against its SQL on the small tables, and what SQL cannot say against a loop."""

from __future__ import annotations

import os

import duckdb
import pytest

from palimpsest.plans.catalog import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return c


def rows(df) -> list[str]:
    df = df[sorted(df.columns)]
    return sorted(map(repr, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, duck, name):
    assert rows(QUERIES[name](spark, sf).toPandas()) == rows(duck.execute(SQL[name]).df())


def test_last_kept_by_a_loop(spark, sf):
    from palimpsest.sources import tables

    pages: dict[int, list[float]] = {}
    for r in tables.boxes(tables.table(spark, sf, "lineitem")).select("pno", "y0").collect():
        pages.setdefault(r["pno"], []).append(r["y0"])
    for pno, ys in pages.items():
        kept: list[float] = []
        for y in sorted(ys):
            if not kept or abs(y - kept[-1]) > 6:
                kept.append(y)
        pages[pno] = kept
    got = {r["pno"]: [float(y) for y in r["ys"].split(",")] for r in QUERIES["w7_last_kept"](spark, sf).collect()}
    assert got == pages


def test_citation_pages_by_the_rule(spark):
    from pyspark.sql import functions as F

    from palimpsest.functions import noise

    pages = [(1, 1000, 30), (2, 1000, 29), (3, 999, 500), (4, 4000, 40), (5, None, None)]
    got = spark.createDataFrame(pages, "id int, size long, digits long").where(noise.citation_dense(F.col("size"), F.col("digits"))).collect()
    assert [r["id"] for r in got] == [1]
    blocks = [(1, "س" * 100, 65.0), (2, "س" * 99, 99.0), (3, "س" * 100, 64.9), (4, "س" * 100, 0.65), (5, "س" * 100, None), (6, None, 90.0)]
    got = spark.createDataFrame(blocks, "id int, text string, conf double").where(noise.anchors_script(F.col("text"), F.col("conf"))).collect()
    assert [r["id"] for r in got] == [1, 4]


def test_anchors_fall_back_to_three_words(spark):
    from palimpsest.plans import queries

    verses = spark.createDataFrame([(1, "in the beginning was the word"), (2, "a time to keep silence"), (3, "jesus wept aloud")], "item_id int, text string")
    docs = [(1, "he read: in the beginning was light"), (2, "keep In the beginning!"), (3, "to keep silence"), (4, "in the beginning was a time to read"), (5, "jesus wept"), (6, "and Jesus wept aloud there"), (7, None)]
    got = queries.anchor_candidates(spark.createDataFrame(docs, "doc_id int, text string"), verses).collect()
    assert sorted((r["doc_id"], r["item_id"], r["gram"], r["hits"]) for r in got) == [(1, 1, 4, 1), (2, 1, 3, 1), (3, 2, 3, 1), (4, 1, 4, 1), (6, 3, 3, 1)]


def test_html_entities_and_places(spark):
    from pyspark.sql import functions as F

    from palimpsest.functions import text

    cases = {
        "<p>a &#8212; b&#160;c &#39;d&#39;</p>": "a \u2014 b\u00a0c 'd'",
        "&#x2014;&#x1F600;&#x27;&#0065;": "\u2014\U0001f600'A",
        "&#12a;|&#x110000;|&#99999999999;|&#xD800;": "?|?|?|?",
        "&#;&#xZZ;&#65 &#X41; &euro;": "&#;&#xZZ;&#65 &#X41; &euro;",
        "&amp;lt; &#38;lt; &amp;#65; <b title='&#65;'>x</b> > <i": "&lt; &lt; &#65; x  ",
        "": "",
    }
    d = spark.createDataFrame([*cases.items(), (None, None)], "html string, want string")
    for r in d.select("*", text.html_text(F.col("html")).alias("text"), text.html_plain(F.col("html")).alias("plain")).collect():
        assert r["text"] == r["want"]
        if r["html"] is None:
            assert r["plain"] is None
            continue
        assert r["plain"]["text"] == r["want"] and len(r["plain"]["places"]) == len(r["want"])
        assert all(c == r["html"][p] or r["html"][p] == "&" for c, p in zip(r["want"], r["plain"]["places"], strict=True))


def test_functions_on_text_only(spark):
    from pyspark.sql import functions as F

    from palimpsest.functions import text

    cases = {"a<b title='a'>ba</b\n>a > a": "A<b title='a'>BA</b\n>A > A", "<a><b a": "<a><b a", "aa": "AA", "": "", None: None}
    d = spark.createDataFrame(list(cases.items()), "html string, want string")
    assert all(r["got"] == r["want"] for r in d.select("want", text.on_text_only(F.col("html"), F.upper).alias("got")).collect())


def test_python_batches_are_bounded(spark, sf):
    QUERIES["t14_exact_fixes"](spark, sf)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000


def test_page_texts_carry_their_own_anchor_only(spark):
    from palimpsest.operators import review

    mark = '<span epub:type="pagebreak" id="page-%d"></span>%s'
    d = spark.createDataFrame([(1, 0, "x" + mark % (4, "<b>a</b> &amp; b") + mark % (5, " ") + mark % (7, "c")), (2, 0, None)], "book int, chapter int, xhtml string")
    got = review.page_texts(d)
    assert "ids" not in got._jdf.queryExecution().optimizedPlan().toString().split("ArrowEvalPython")[1].split("Generate")[0]
    assert sorted(map(tuple, got.collect())) == [(1, 0, 1, "page-4", "a & b"), (1, 0, 3, "page-7", "c")]


def test_merged_rules_number_by_scope_and_order_as_the_sql(spark, tmp_path):
    given = [("A", 1, 999_999, 1), ("A", 1, 1, 2), ("A", 2, 150_000, 1), ("A", 2, 100_000, 2), ("A", 3, 7, 1), ("B", 1, 8_999_999, 3), ("B", 1, 5, 7)]
    d = spark.createDataFrame(given, "l_returnflag string, l_partkey long, l_orderkey long, l_linenumber int")
    d.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert rows(QUERIES["s18_merged_rules"](spark, str(tmp_path)).toPandas()) == rows(c.execute(SQL["s18_merged_rules"]).df())


def test_cooked_pages_shuffle_spans_once(spark, sf):
    from pyspark.sql import functions as F

    from palimpsest.operators import pages as P
    from palimpsest.plans import fixtures, queries

    t = queries.Tables(spark, sf)
    spans, pages = fixtures.spans(t), fixtures.span_pages(t)
    got = P.cook_pages(spans, pages)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("l_linenumber#") > 0
    assert got._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 2
    lines, sizes = P.cook_lines(spans, pages), P.body_size(spans, pages)
    n = lines.join(P.note_zone(lines, sizes), P.PAGE, "left").where("text != ''").groupBy(*P.PAGE)
    n = n.agg(F.count_if(F.col("first").isNull() | (F.col("rank") < F.col("first"))).alias("n_body"), F.count_if(F.col("rank") >= F.col("first")).alias("n_notes"))
    want = sizes.join(P.headers(spans).drop("rank"), P.PAGE, "left").join(n, P.PAGE, "left").fillna(0, ["n_body", "n_notes"]).select(got.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_texts_meet_their_candidates_once(spark):
    from palimpsest.operators import corrections as K

    verses = spark.createDataFrame([(1, a, "كتب قلم دار نور " + w) for a, w in enumerate(["بحر", "جبل", "نهر"], 1)], "s int, a int, text string")
    texts = spark.createDataFrame([(1, "كتب قلم دار نور جبل"), (2, "كتب قلم دار نور"), (3, "دار نور بحر"), (4, "شمس قمر نجم")], "k int, text string")
    got = K.by_anchor(texts, ["k"], verses)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("collect_list")
    assert sorted((r["k"], r["a"]) for r in got.collect()) == [(1, 2), (2, 1), (3, 1)]
    cited = spark.createDataFrame([(k, 1, 3) for k in (1, 2, 3, 4)], "k int, s int, a int")
    assert sorted((r["k"], r["a"]) for r in K.by_citation(texts, ["k"], cited, verses).collect()) == [(1, 2), (2, 1), (3, 1)]
