"""Operators that SQL can't express, and the reference cases of those that it can, against loops and literal results."""

from __future__ import annotations

import re
import uuid
import zipfile
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.functions import typography
from palimpsest.operators import book, corrections, pages, review
from palimpsest.plugins import Registry
from palimpsest.sinks import epub, export, reports, stages
from palimpsest.sources import books, engines
from palimpsest.streaming import pages as streaming

C = F.col
ELEMENT = "book string, pno long, seq long, kind string, text string, level long, number string, printed long, conf double"


def column(spark, values, expression):
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r["o"] for r in d.select("i", expression(C("t")).alias("o")).orderBy("i").collect()]


def elements(spark, rows):
    return spark.createDataFrame([(b, p, s, k, t, lv, n, pr, -1.0) for b, p, s, k, t, lv, n, pr in rows], ELEMENT)


def test_digits(spark):
    cases = {"the term);3 rather": "the term);³ rather", "Smith1 has": "Smith¹ has", "Hajj. 1 This": "Hajj.¹ This", "In 2026 we": "In 2026 we", "obligation. 1 this": "obligation. 1 this", "": "", "a1 b2 c": "a¹ b² c", None: None}
    assert column(spark, list(cases), typography.raise_note_digits) == list(cases.values())


def test_quotes(spark):
    cases = {'Smith" states that': "Smith states that", 'He said "all is well." Then': 'He said "all is well." Then', 'the word." Next came': "the word. Next came", '<a title="Smith" states">x</a>': '<a title="Smith" states">x</a>', None: None}
    assert column(spark, list(cases), typography.strip_misread_quotes) == list(cases.values())


def test_runs(spark):
    cases = {"a" + " term" * 200: "a term", "x" + "." * 203: "x…", "'" * 200: "", "-" * 50: "-", "term term term term term": "term term term term term", "...": "...", "--": "--", "a" + " w" * 20_000 + " end": "a w end", None: None}
    assert column(spark, list(cases), typography.collapse_runs) == list(cases.values())


def test_broken_words_are_stitched_by_vocabulary(spark):
    vocabulary = spark.createDataFrame([("manuscript",)], "word string")
    rows = [(1, "<p>a manu- script and coro- nation</p>"), (2, '<a title="manu- script">x</a>'), (3, None), (4, "Manu- script, émanu- script")]
    got = {r["k"]: r["h"] for r in typography.stitch(spark.createDataFrame(rows, "k int, h string"), "k", "h", vocabulary).collect()}
    want = {k: h and "".join(p if p.startswith("<") else re.sub(typography.BROKEN, lambda m: m[1] + m[2] if (m[1] + m[2]).lower() == "manuscript" else m[0], p) for p in re.split("(<[^>]*>?)", h)) for k, h in rows}
    assert got == want and got[1] == "<p>a manuscript and coro- nation</p>" and got[2] == rows[1][1]


def test_tag_safe_fixes():
    note = '<a epub:type="noteref" href="#n"><sup>1</sup></a>'
    assert typography.fix_phrase(f"<p>che result{note} is</p>", "che result1 is", "the result is") == (f"<p>the result is{note}</p>", 1)
    assert typography.fix_phrase("<p>a <em>b</em> c</p>", "a b c", "x") == ("<p>a <em>b</em> c</p>", 0)
    assert typography.fix_phrase(f"<p>{note}:5 verse</p>", "1:5 verse", "2:5 verse") == ("<p>2:5 verse</p>", 1)
    assert typography.fix_phrase("<p>a &amp; b</p>", "a & b", "a and b") == ("<p>a and b</p>", 1)
    assert typography.fix_phrase("aa", "a", "aa")[1] == typography.MOST_FIXES
    assert typography.fix_all("one two", [("two three", "four"), ("two", "two three")])[0].startswith("one four")


def test_fix_report(spark):
    d = spark.createDataFrame([(1, "<p>good <em>old</em> text</p>")], "k int, h string")
    fixes = [("text", "words"), ("good old", "x"), ("absent", "y")]
    done = typography.repair(d, "k", "h", spark.createDataFrame([("x",)], "word string"), fixes)
    assert done.first()["h"] == "<p>good <em>old</em> words</p>"
    assert {r["find"]: r["state"] for r in typography.report(done, "h", fixes).collect()} == {"text": "applied", "good old": "tag_skipped", "absent": "no_op"}


def test_pages_merge(spark):
    rows = [("b", 1, 0, "paragraph", "it goes on without punctuation", 3, None, None), ("b", 2, 1, "paragraph", "into the next page's' nicely", 3, None, None), ("b", 2, 2, "footnote", "a note", 3, "4", None),
            ("b", 3, 3, "paragraph", "and this stays", 3, None, None), ("b", 4, 4, "paragraph", "ends here.", 3, None, None), ("b", 5, 5, "paragraph", "small but after an end", 3, None, None), ("c", 1, 0, "paragraph", "alone", 3, None, None)]
    got = {(r["book"], r["pno"], r["seq"]): r["text"] for r in book.merge_pages(elements(spark, rows)).collect()}
    # Page 2's only paragraph went to page 1, so page 3's stays where it is; page 3 runs on into page 4, whose only one it takes.
    assert got == {("b", 1, 0): "it goes on without punctuation into the next page's\x122:4\x13 nicely", ("b", 2, 2): "a note", ("b", 3, 3): "and this stays ends here.", ("b", 5, 5): "small but after an end", ("c", 1, 0): "alone"}


def chapters_by_loop(rows):
    out, chapter, title, filled = [], 0, "Front Matter", False
    for b, p, s, k, t, lv, n, pr in rows:
        if k == "heading" and lv <= 2 and filled:
            chapter, title, filled = chapter + 1, t, False
        else:
            filled = True
            out.append((p, s, chapter, title))
    return out


def test_chapters(spark):
    kinds = ["heading", "heading", "paragraph", "heading", "heading", "heading", "paragraph", "heading"]
    rows = [("b", i // 3 + 1, i, k, f"T{i}", 1, None, None) for i, k in enumerate(kinds)]
    got = sorted((r["pno"], r["seq"], r["chapter"], r["title"]) for r in book.assemble(elements(spark, rows)).collect())
    assert got == chapters_by_loop(rows)
    titles = spark.createDataFrame([("t2", "Two"), ("t3", "Three")], "norm string, title string")
    named = {r["seq"]: r["title"] for r in book.assemble(elements(spark, rows), titles, cover=3).collect()}
    assert named == {0: "Front Matter", 1: "Front Matter", 2: "Front Matter", 4: "Three", 5: "Three"}


@pytest.fixture(scope="module")
def assembled(spark):
    rows = [("b", 1, 0, "heading", "One", 1, None, 7), ("b", 1, 1, "paragraph", "A †1† & †9† \x02em\x03", 3, None, 7), ("b", 1, 2, "footnote", "First <note>", 3, "1", 7), ("b", 2, 3, "paragraph", "More †1†\x121:1\x13", 3, None, None),
            ("b", 2, 4, "arabic", "سلام\nعليكم", 3, None, None), ("b", 3, 5, "heading", "Two [x]", 2, None, None), ("b", 3, 6, "paragraph", "End", 3, None, None), ("b", 3, 7, "footnote", "Second", 3, "1", None)]
    return stages.stage(book.assemble(elements(spark, rows)), "test")


def test_rendered_chapters(spark, assembled):
    got = {r["chapter"]: r["xhtml"] for r in book.render(assembled).collect()}
    assert sorted(got) == [0, 1]
    body = got[0][got[0].index("<section") :]
    assert '<span epub:type="pagebreak" role="doc-pagebreak" id="page-7" aria-label="7"></span>\n<h1>One</h1>' in body
    assert '<p class="body">A <a epub:type="noteref" role="doc-noteref" id="fn-front-matter-note-001-ref-1" href="#fn-front-matter-note-001"><sup>1</sup></a> &amp; <sup>9</sup> <em>em</em></p>' in body
    assert 'id="page-pdf-2"' in body and 'lang="ar" xml:lang="ar" dir="rtl">سلام<br />عليكم</p>' in body
    assert '<aside epub:type="footnote" role="doc-footnote" id="fn-front-matter-note-001"><p><span class="fn-num">1.</span> First &lt;note&gt; <a href="#fn-front-matter-note-001-ref-1"' in body
    assert '<h1 id="title-ch-01-two-x">Two [x]</h1>' in got[1] and 'id="fn-ch-01-two-x-note-001"' in got[1]
    texts = {(r["chapter"], r["anchor"]): r["text"] for r in review.page_texts(book.render(assembled)).collect()}
    assert texts[0, "page-7"].startswith("One\nA [^1] & [^9] em") and (1, "page-pdf-3") in texts


def test_exports(spark, assembled):
    shelf = spark.createDataFrame([("b", "Title", "Author", "en", "2024")], "book string, title string, author string, language string, modified string")
    md, txt, html = (f(assembled, shelf).first()["text"] for f in (export.markdown, export.plain, export.html))
    assert md.startswith("# Title\n\n*Author*\n\n## Front Matter\n\n### One\n\n")
    assert r"A \[^fn-front-matter-note-001\] & \[^note-1-9\] *em*" in md and "[^fn-front-matter-note-001]: First <note>" in md and "## Two [x]" in md
    assert txt.startswith("Title\nAuthor\n") and "A [1] & [9] em" in txt and "[1] First <note>" in txt and "Two [x]\n=======" in txt
    assert '<sup><a href="#fn-front-matter-note-001">1</a></sup> &amp; <sup><a href="#fn-src-1-9">9</a></sup> <em>em</em>' in html
    assert export.normalize_formats(["md", "TXT", "markdown"]) == ["markdown", "text"] and export.normalize_formats(None) == ["epub"]
    with pytest.raises(ValueError, match="unknown format"):
        export.normalize_formats(["doc"])
    data = epub.archives(stages.stage(book.render(assembled), "rendered"), shelf).first()["epub"]
    with zipfile.ZipFile(BytesIO(data)) as z:
        assert z.namelist()[0] == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
        assert [n for n in z.namelist() if n.startswith("OEBPS/text/") and "ch" in n or "front" in n] == ["OEBPS/text/front-matter.xhtml", "OEBPS/text/ch-01-two-x.xhtml"]
        opf = z.read("OEBPS/content.opf").decode()
        assert '<itemref idref="cover-html" />\n<itemref idref="titlepage" />\n<itemref idref="front-matter" />' in opf and f"urn:uuid:{uuid.uuid5(epub.NAMESPACE, 'b|Title|Author')}" in opf
        assert "text/front-matter.xhtml#page-7" in z.read("OEBPS/nav.xhtml").decode()
    made = spark.createDataFrame([("b", bytearray(data)), ("c", bytearray(b"no zip"))], "book string, epub binary")
    names = epub.members(made, suffix="").select("book", "name")
    m, s = epub.read_package(epub.members(made, suffix="content.opf"))
    assert review.package_problems(names, m, s).collect() == []


def test_names(spark):
    rows = [("b", 1, i, "paragraph", t, 3, None, None, c) for i, (t, c) in enumerate([("so Ibn Arabi wrote", 96.0), ("and Ibn Arabi said", 94.0), ("but Ion Arabi too", 55.0), ("then Ion Arabi again", 95.0), ("Your Lord", 50.0)])]
    rows.append(("b", 2, 9, "footnote", "See In Arabi, Al-Futuhat.", 3, "1", None, 40.0))
    e = spark.createDataFrame(rows, ELEMENT)
    got = {r["seq"]: r["text"] for r in corrections.fix_names(e, corrections.name_decisions(e)).collect()}
    assert got == {0: "so Ibn Arabi wrote", 1: "and Ibn Arabi said", 2: "but Ibn Arabi too", 3: "then Ion Arabi again", 4: "Your Lord", 9: "See Ibn Arabi, Al-Futuhat."}
    assert [(r["display"], r["count"]) for r in corrections.learn_names(e).where("display = 'Ibn Arabi'").collect()] == [("Ibn Arabi", 2)]


def test_transliterations(spark):
    vocabulary = spark.createDataFrame([(w, w) for w in ("miqat", "taqsir", "kitab", "talbiyah")], "norm string, canonical string")
    words = spark.createDataFrame([(w,) for w in ("Migat", "TAGSIR", "kitab", "al-Kitāb", "ralbiyah", "other")], "word string")
    assert {r["word"]: r["corrected"] for r in corrections.correct_transliterations(words, vocabulary).collect()} == {"Migat": "Miqat", "TAGSIR": "TAQSIR", "ralbiyah": "talbiyah"}
    assert {r["word"]: r["norm"] for r in corrections.lookup(words, vocabulary).collect()} == {"kitab": "kitab", "al-Kitāb": "kitab"}
    assert {r["word"] for r in corrections.lookup_relaxed(words, vocabulary).collect()} == {"kitab", "al-Kitāb", "ralbiyah"}
    assert column(spark, ["Ǎế", "ʿAlī", "ﬁqh", "Ḥajj's", None], T.normalize_translit) == ["ae", "ali", "fiqh", "hajj's", None]


def test_exact_fixes(spark):
    new, log = corrections.exact_fixes("che result is here; chez", [("result is", "outcome was")], {"che": "the"})
    assert new == "the outcome was here; chez" and [x[0] for x in log] == ["phrase:result is", "word:che"] and log[1][2].startswith("the outcome")
    assert corrections.exact_fixes("Perfectly fine.", [("x", "y")], {"che": "the"}) == ("Perfectly fine.", [])


def test_best_slice():
    assert corrections.best_slice(["a", "b", "c"], ["x", "a", "b", "c", "y"]) == (1.0, 1, 3)
    assert corrections.best_slice(["a", "b"], ["x", "y"]) == (0.0, 0, -1)
    assert corrections.best_slice(["a", "b", "c", "d"], ["a", "x", "c", "d", "q"]) == (0.75, 0, 3)


def test_canonical_texts(spark):
    verses = spark.createDataFrame([(1, 1, "بِسْمِ اللَّهِ الرَّحْمَنِ الرَّحِيمِ"), (1, 2, "الحمد لله رب العالمين")], "s int, a int, text string")
    blocks = spark.createDataFrame([(1, "(... بسم الله الرحمن الرحيم)"), (2, "كلام آخر هنا"), (3, "الحمد لله رب")], "k int, text string")
    cited = spark.createDataFrame([(3, 1, 1)], "k int, s int, a int")
    got = {r["k"]: (r["text"], r["canonical"]) for r in corrections.canonical(blocks, ["k"], cited, verses).collect()}
    assert got[1] == ("﴿... بِسْمِ اللَّهِ الرَّحْمَنِ الرَّحِيمِ﴾", True) and got[2] == ("كلام آخر هنا", False) and got[3] == ("﴿الحمد لله رب﴾", True)
    aliases = spark.createDataFrame([("aalimran", 3), ("fatihah", 1)], "name string, s int")
    d = spark.createDataFrame([(1, "Quran, Aal-'Imran 3:97-98 and Fatihah 12:1")], "k int, text string")
    assert [(r["s"], r["a"], r["a_end"]) for r in corrections.citations(d, ["k"], aliases).collect()] == [(3, 97, 98)]


def test_model_answers(spark):
    assert review.parse_response("```json\n{}\n```") == ([], None) and review.parse_response("[]")[1] and review.parse_response("{")[1] and review.parse_response('{"corrections": 1}')[1]
    proposals = [("che", "the", "high", 1), ("che", "che", "high", 0), ("zzz", "y", "high", 0), ("che", "<b>x</b>", "high", 0), ("ch", "x", "high", 0), ("che", "thx", "low", 0), ("che", "t\nx", "high", 0)]
    d = spark.createDataFrame(proposals, "f string, r string, c string, ok int")
    got = d.select("ok", review.acceptable(C("f"), C("r"), C("c"), F.lit("see che text")).alias("a")).collect()
    assert [r["a"] for r in got] == [bool(r["ok"]) for r in got]
    days = spark.range(1, 8).withColumnRenamed("id", "pno")
    assert sorted(r["pno"] for r in review.select_pages(days, "3, 6-5,99").collect()) == [3, 5, 6] and review.select_pages(days, None).count() == 7
    with pytest.raises(ValueError, match="page spec"):
        review.select_pages(days, "x")


def test_fix_lists():
    body = '[phrase]\n"mine" = "x"\n'
    new, added = reports.merged_list(body, {"b": 'q"', "a": "1", "mine": "no"})
    assert added == 2 and new == f'[phrase]\n"mine" = "x"\n\n{reports.BEGIN}\n"a" = "1"\n"b" = "q\\""\n{reports.END}\n'
    again, added = reports.merged_list(new, {"b": "2"})
    assert added == 0 and '"a"' not in again and again.count(reports.BEGIN) == 1


def test_links(spark):
    files = spark.createDataFrame([("OEBPS/text/a.xhtml", '<p id="x"><a href="#x">1</a><a href="#no">2</a><a href="b.xhtml#y">3</a><a href="b.xhtml#n">4</a><a href="c.xhtml#y">5</a></p>'), ("OEBPS/text/b.xhtml", '<p id="y"></p>')], "file string, xhtml string")
    got = sorted((r["i"], r["kind"], r["excerpt"]) for r in review.link_findings(files).collect())
    assert got == [(1, "unresolved internal link", "#no"), (3, "missing fragment", "b.xhtml#n"), (4, "missing linked file", "c.xhtml#y")]


def test_page_kinds(spark):
    title = ["THE LONG ROAD", "TO SOMEWHERE", "a story", "Edited by Someone", "Translated by Other", "in the year", "of the book", "at the place"]
    rows = [("b", 1, i, t, 150.0, 300.0) for i, t in enumerate(title)] + [("b", 2, i, t, 50.0, 100.0) for i, t in enumerate(["Contents", "One", "Two", "Three"])]
    rows += [("b", 3, i, t, 150.0, 300.0) for i, t in enumerate(["ISBN 12345", "Copyright 2020", "Printed here", "More words", "Words more", "The last one"])] + [("b", 4, i, t, 150.0, 300.0) for i, t in enumerate(["The Foundation", "City"])]
    lines = spark.createDataFrame(rows, "book string, pno int, line_no int, text string, x0 double, x1 double")
    sizes = spark.createDataFrame([("b", p, 450.0, 600.0) for p in range(1, 5)], "book string, pno int, width double, height double")
    got = {r["pno"]: (r["imprint"], r["credits"], r["footer"]) for r in pages.page_kinds(lines, sizes).collect()}
    assert got == {1: (False, True, False), 2: (False, False, False), 3: (True, False, False), 4: (False, False, True)}


def test_engines(spark):
    calls = []

    def decode(name, pno, image, languages):
        calls.append((pno, tuple(languages)))
        if pno == 2:
            raise OSError("broken")
        return {"width": 100, "height": 200, "lines": [{"text": languages[0], "conf": 90.0, "x0": 0.0, "y0": 0.0, "x1": 1.0, "y1": 1.0, "rtl": languages[0] == "ara"}]}

    assert engines.passes(["ara", "eng", "fas"]) == [["eng"], ["ara", "fas"]]
    good, bad = (engines.read_page(decode, "b", p, b"", ["eng", "ara"], retries=1) for p in (1, 2))
    assert [x["text"] for x in good["en_lines"] + good["ar_lines"]] == ["eng", "ara"] and bad["error"] == "OSError: broken" and (bad["width"], len(calls)) == (612.0, 4)
    with pytest.raises(KeyError, match="no engine"):
        engines.get_engine("none")
    assert engines.get_engine("PyMuPDF") is engines.text_layer


def test_books_from_files(spark, tmp_path):
    (tmp_path / "m.toml").write_text('[[book]]\npath = "a"\nnote = 1\n')
    assert [(r["path"], r["extra"]) for r in books.read_manifest(spark, str(tmp_path / "m.toml")).collect()] == [("a", '{"note": 1}')]
    (tmp_path / "e.toml").write_text("")
    with pytest.raises(ValueError, match="names no"):
        books.read_manifest(spark, str(tmp_path / "e.toml"))
    (tmp_path / "bk").mkdir()
    (tmp_path / "bk/book.toml").write_text('title = "T"\nformats = ["md"]\n[qc]\nmax_cost_usd = 2.5\n')
    (tmp_path / "bk/headings.json").write_text('[["Chapter One", 1]]')
    folder = [str(tmp_path / "bk")]
    assert books.read_books(spark, folder).first()["formats"] == ["markdown"] and books.qc_settings(spark, folder).first()["max_cost_usd"] == 2.5 and books.headings(spark, folder).first()["norm"] == "chapter one"
    with pytest.raises(ValueError, match="heuristics"):
        books.check_config("x", {"title": "t", "heuristics": ["magic"]})
    with pytest.raises(ValueError, match="outside"):
        books.inside(tmp_path / "bk", "../m.toml")
    (tmp_path / "f.toml").write_text('[phrase]\n"a" = "a"\n"" = "x"\n')
    assert books.phrase_fixes(str(tmp_path / "f.toml")) == [("a", "a")] and books.phrase_fixes(str(tmp_path / "none.toml")) == []
    (tmp_path / "v.json").write_text('{"Kitāb": "كتاب", "n": 1}')
    got = {r["norm"]: r["canonical"] for r in books.vocabulary(spark, str(tmp_path / "v.json"), {"kitab": "own"}).collect()}
    assert got["kitab"] == "own"
    (tmp_path / "o").mkdir()
    (tmp_path / "o/ch-01-a.xhtml").write_text("<p>new</p>")
    over = books.overrides(spark, str(tmp_path / "o")).withColumn("book", F.lit("b"))
    new, stale = books.apply_overrides(spark.createDataFrame([("b", "ch-01-a", "old")], "book string, slug string, xhtml string"), over)
    assert new.first()["xhtml"] == "<p>new</p>" and stale.collect() == []


def test_resume(spark, tmp_path):
    todo = spark.createDataFrame([("b", p) for p in (1, 2, 3)], "book string, pno int")
    cached = spark.createDataFrame([("b", 1, None), ("b", 2, "bad")], "book string, pno int, error string")
    assert [r["pno"] for r in review.to_run(todo, cached, "retry").orderBy("pno").collect()] == [2, 3] and review.to_run(todo, cached, "force").count() == 3
    with pytest.raises(ValueError, match="failed before"):
        review.to_run(todo, cached)
    made = []
    for _ in range(2):
        stages.cached_stage(spark, str(tmp_path), {"book": "b"}, lambda: made.append(1) or todo)
    assert made == [1]


def test_plugins_run_in_order(spark, caplog):
    r = Registry()
    r.register("a", after=lambda d, s: d.withColumn("t", F.concat("t", F.lit(s["x"]))))
    r.register("b", after=lambda d, s: d.withColumn("t", F.concat("t", F.lit("b"))))
    d = spark.createDataFrame([("-",)], "t string")
    assert r.run("after", d, ["b", "gone", "a"], {"a": {"x": "!"}}).first()["t"] == "-b!"
    with pytest.raises(KeyError):
        r.run("after", d, ["gone"], strict=True)


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("b", 1, "bad", 1.0), ("b", 1, None, 1.0), ("b", 2, None, 1.0)], "book string, pno int, error string, usd double")
    (tmp_path / "in").mkdir()
    rows.where("error is not null").coalesce(1).write.parquet(str(tmp_path / "in/a"))
    rows.where("error is null").coalesce(1).write.parquet(str(tmp_path / "in/b"))
    s = streaming.stream(spark, str(tmp_path / "in/*"), "book string, pno int, error string, usd double", 1)
    q = streaming.keep_pages(s, str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(120)
    got = {r["pno"]: r["error"] for r in streaming.latest_pages(spark, str(tmp_path / "out")).collect()}
    assert got == {1: None, 2: None}


def fixed_by_loop(html, fixes):
    """fix_all without note marks, the plain text made anew for each change."""
    from palimpsest.functions import text

    counts = [0] * len(fixes)
    for _ in range(typography.PASSES):
        for i, (find, put) in enumerate(fixes):
            for _ in range(typography.MOST_FIXES):
                plain, places = text.plain_of_html(html)
                at = plain.find(find)
                if at < 0:
                    break
                end = places[at + len(find) - 1]
                entity = re.compile("&[#a-zA-Z0-9]+;").match(html, end)
                end = entity.end() if entity else end + 1
                new = html[: places[at]] + put + html[end:]
                if set("<>") & set(html[places[at] : end]) or new == html:
                    break
                html, counts[i] = new, counts[i] + 1
    return html, counts


def test_fixes_read_only_what_changes():
    import random
    import time

    r = random.Random(3)
    for _ in range(400):
        html = "".join(r.choice(["the", "a", "&", "&am", "p;", "&amp;", "&#6", "5;", "<b>", "</b>", "<", ">", " ", "lt;", "z" * 40]) for _ in range(r.randint(1, 40)))
        fixes = [(r.choice(["the", "a", "&", "<", "A", "p;", "a "]), r.choice(["thee", "", "&", "a", "<b>", "p;", "5;", "&lt;"])) for _ in range(3)]
        assert typography.fix_all(html, fixes) == fixed_by_loop(html, fixes)
    page, began = "<p>the " + "some words &amp; more</p><p>" * 40_000, time.time()
    html, counts = typography.fix_all(page, [("the", "thee"), ("of &", "of and")])
    assert counts == [200, 0] and html.startswith("<p>th" + "e" * 201 + " some") and time.time() - began < 20


def test_repair_applies_fixes_once(spark):
    d = spark.createDataFrame([(1, "<p>the man- ual</p>"), (2, None)], "k int, h string")
    done = typography.repair(d, "k", "h", spark.createDataFrame([("manual",)], "word string"), [("the", "a")])
    assert "run(" not in done._jdf.queryExecution().executedPlan().toString()
    assert {r["k"]: (r["h"], r["fix_counts"]) for r in done.collect()} == {1: ("<p>a manual</p>", [1]), 2: (None, None)}


def test_report_reads_once(spark):
    d = spark.createDataFrame([("<p>good <em>old</em> text</p>", [1, 0, 0]), (None, None), ("text", [2, 0, 0])], "h string, fix_counts array<int>")
    done = typography.report(d, "h", [("text", "words"), ("good old", "x"), ("absent", "y")])
    assert done._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2
    assert sorted(map(tuple, done.collect())) == [("absent", 0, "no_op"), ("good old", 0, "tag_skipped"), ("text", 3, "applied")]


def test_runs_by_the_former_patterns(spark):
    """The same as four plain patterns give, without trying each letter of a text that has no run."""
    import random

    from pyspark.sql import functions as F

    r = random.Random(4)
    rows = []
    for i in range(600):
        w, sep = r.choice(["a", "ab", "'é", "—", "ا", "a" * 30, "a" * 31, "1", ".", '"', "\x0b"]), r.choice([[" "], [" ", "\t", "  "], ["", " "], [""]])
        rows.append((i, r.choice(["", "x", " "]) + "".join((w if r.random() < 0.97 else "b") + r.choice(sep) for _ in range(r.choice([7, 9, 10, 12, 14, 30]))) + r.choice(["", "a", "the then"])))
    d = spark.createDataFrame([*rows, (-1, None), (-2, "")], "i int, t string")
    t = F.regexp_replace("t", r"( ?)([A-Za-z\x{c0}-\x{24f}\x{600}-\x{6ff}'\x{2018}\x{2019}\-]{1,30})(?:[ \t]+\2){9,}+", "$1$2")
    t = F.regexp_replace(t, r"([^A-Za-z0-9\s<>&.,'\"])\1{7,}", "$1")
    t = F.regexp_replace(F.regexp_replace(t, r"([.,])\1{7,}", "…"), r"(['\"])\1{7,}", "")
    new = typography.collapse_runs(F.col("t"))
    assert d.where(~new.eqNullSafe(t)).count() == 0 and d.where(new != F.col("t")).count() > 100
    assert "RLIKE" in d.select(new)._jdf.queryExecution().optimizedPlan().toString()


def test_page_list_and_chapters_without_rendering(spark, sf, monkeypatch):
    from palimpsest.operators import book as B
    from palimpsest.plans import chapters, queries
    from palimpsest.sinks import epub

    t = queries.Tables(spark, sf)
    rendered = chapters.rendered(t)
    want = [sorted(map(tuple, d.collect())) for d in (epub.page_list(rendered), rendered.select("book", "chapter", "slug"))]
    monkeypatch.setattr(B, "render", None)
    assert sorted(map(tuple, queries.QUERIES["k3_page_list"](spark, sf).collect())) == want[0] and want[0]
    assert queries.QUERIES["k2_manifest"](spark, sf).where("ord >= 5").count() == len(want[1])


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]


def test_merging_and_chapters_move_texts_once(spark):
    import random

    r, rows = random.Random(5), []
    for b in "abcdef":
        for p in (p for p in range(1, 40) if r.random() < 0.9):
            rows += [(b, p, p * 10 + i, r.choice(["paragraph", "paragraph", "paragraph", "heading", "footnote"]), r.choice(["goes on", "goes on", "ends.", "Capital", " "]), r.choice([1, 3]), "1", None) for i in range(r.choice([1, 1, 2, 3]))]
    e, want = elements(spark, rows), []
    for b in "abcdef":
        paragraphs, first, taken = [x for x in rows if x[0] == b and x[3] == "paragraph"], {}, False
        for x in rows:
            if x[0] == b and x[3] in ("paragraph", "heading"):
                first.setdefault(x[1], x)
        for x, y in zip(paragraphs, paragraphs[1:], strict=False):
            taken = not taken and y[1] == x[1] + 1 and first[y[1]] is y and x[4] in ("goes on", "Capital") and y[4] in ("goes on", "ends.")
            want += [(b, x[1], x[2], y[2])] if taken else []
    assert want and sorted(map(tuple, book.page_merges(e).collect())) == sorted(want)
    plan = physical(book.assemble(book.merge_pages(e)))
    assert plan.count("Exchange") == 1 and plan.count("Sort ") == 1


def test_exports_link_far_and_half_formed_marks(spark):
    rows = [("b", 1, 0, "paragraph", "x\x122:1\x13 †1† †1†", 3, None, None), ("b", 1, 1, "footnote", "of one †2†", 3, "1", None), ("b", 1, 2, "footnote", "again", 3, "1", None), ("b", 2, 3, "paragraph", "y †\x101†", 3, None, None),
            ("b", 2, 4, "footnote", "of two \x121:1\x13", 3, "1", None), ("b", 3, 5, "heading", "Last", 1, None, None), ("b", 3, 6, "footnote", "goes with no chapter's text", 3, "1", None)]
    shelf = spark.createDataFrame([("b", "T", "A", "en", "2024")], "book string, title string, author string, language string, modified string")
    done = stages.stage(book.assemble(elements(spark, rows[:-1])), "test")
    md, txt, html = (f(done, shelf).first()["text"] for f in (export.markdown, export.plain, export.html))
    one, two = "fn-front-matter-note-001", "fn-front-matter-note-002"
    assert rf"x\[^{two}\] \[^{one}\] \[^{one}\]" in md and f"[^{one}]: of one " + r"\[^note-1-2\]" in md and "again" not in md
    assert "x[1] [1] [1]" in txt and "[1] of two [1]" in txt
    assert f'y <sup><a href="#{two}">1</a></sup>' in html and f'<p id="{two}"><strong>1.</strong> of two <sup><a href="#{one}">1</a></sup></p>' in html
    assert html.count('class="pagebreak"') == 2
    for f, joins in ((export.markdown, 2), (export.html, 2), (export.plain, 1)):
        assert len(re.findall(r"\bJoin\b", f(done, shelf)._jdf.queryExecution().optimizedPlan().toString())) == joins


def test_rendering_joins_no_texts(spark, assembled):
    plan = book.render(assembled)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"\bJoin\b", plan)) == 3  # notes to marks, twice, and first references to notes


def test_texts_without_marks_are_left_alone(spark):
    texts = ["plain & text", "a \x02b\x03 \x10متن\x11", "open \x04x", "open \x10x", "†1† x\x121:2\x13", "", None]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string")
    got = book.replace_matches(d.withColumn("f", T.format_tags(C("t"))), "o", C("f"), book.PLACEHOLDER, lambda m, i: F.concat(F.lit("["), i.cast("string"), F.lit("]")))
    rows = {r["i"]: (r["f"], r["o"]) for r in got.collect()}
    assert [rows[i][0] for i in range(7)] == ["plain & text", 'a <em>b</em> <span lang="ar" xml:lang="ar" dir="rtl" class="arabic-inline">متن</span>', "open x", "open x", "†1† x\x121:2\x13", "", None]
    assert [rows[i][1] for i in (0, 4, 5, 6)] == ["plain & text", "[0] x\x121:2\x13", "", None]
    plan = d.select(T.format_tags(C("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN" in plan  # nothing is tried on texts without markers


def test_exchanges_are_tried_where_they_may_lead(spark):
    import random

    fold = str.maketrans("hejqt", "bcggr")
    assert all(a.translate(fold) == b.translate(fold) for a, b in corrections.SLIPS)
    r = random.Random(3)
    known = sorted({"".join(r.choices("bcehgjqrtax", k=r.choice([4, 5]))) for _ in range(300)} | set(corrections.KNOWN_SLIPS.values()))
    words = sorted({"".join(r.choices("bcehgjqrtax", k=r.choice([3, 4, 5]))).capitalize() for _ in range(300)} | set(corrections.KNOWN_SLIPS) | {"".join(dict(corrections.SLIPS).get(c, c) for c in w) for w in known[:150]})

    def once(w):
        return [w.replace(a, b) for a, b in corrections.SLIPS if a in w]

    def by_loop(word):
        n = word.lower()
        fixed = corrections.KNOWN_SLIPS.get(n)
        if len(n) < 4:
            return None
        if fixed in known:
            return fixed
        found = {v for one in once(n) for v in [one, *once(one)]} & set(known) - {n}
        return found.pop() if n not in known and len(found) == 1 else None

    want = {w: t.capitalize() if w[0].isupper() else t for w in words if (t := by_loop(w))}
    got = corrections.correct_transliterations(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(w,) for w in known], "norm string"))
    assert want and {x["word"]: x["corrected"] for x in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and plan.index("Generate explode") < plan.index("LeftSemi")


def test_ascii_words_skip_the_letter_tables(spark):
    assert not any(c.isascii() for c in "".join(T._ONE) + "".join(T._SEVERAL))
    cases = {"Miqat's": "miqat's", "A-b 1": "ab", "": "", "ʿAlī ﬁqh": "alifiqh", "Ǎế": "ae", None: None}
    assert column(spark, list(cases), T.normalize_translit) == list(cases.values())
    plan = spark.createDataFrame([("a",)], "t string").select(T.normalize_translit(C("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "[^\\x00-\\x7f]" in plan


def test_words_repeat_within_texts_no_more(spark, sf):
    from palimpsest.plans import queries, refinery

    plan = refinery._words(queries.Tables(spark, sf))._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(array_distinct(" in plan
