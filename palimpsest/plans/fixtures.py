"""What the later queries run over: lines of documents as elements of books, boxes as spans, benchmark texts as verses, and literal cases beside them.

Each comes as a DataFrame and as the SQL that says the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import BOXES_SQL, LINES_SQL

C = F.col

#: Cases beside the documents' own lines: (text). Scripts, garbled words, headers, hyphens, notes, names, citations.
CASES = [
    "بسم الله الرحمن الرحيم", "قُلْ هُوَ اللَّهُ أَحَدٌ", "ab 12 من", "سلام 08 2121800510135 این ۱۲ و ۱۴", "پارسی گفتار", "اردو ہے ٹڈ", "שלום עולם", "Καλημέρα κόσμε", "中文文本", "Привет мир", "हिन्दी पाठ",
    "Plain English words here", "wIll thE b1ad zxcvb Hello", "fo^o bar", "STRNGTH rhythm", "a", "", "   ", "12 THE BOOK OF DAYS", "THE BOOK OF DAYS 12", "CHAPTER ONE", "lower case title 3",
    "manu- script and coro- nation", "soft­hyphen here", "It ended. 1 This verse", "the term);3 rather", "Smith1 has seen", "In 2026 we were", 'Smith" states that', 'He said "yes." Then', 'word." Next one',
    "kaafir? is a person", "What? The next", "reward.' With this", "Ibn Arabi wrote", "Hie book and hi end", "‘quoted’ and “double”", "x y  z", "Aal-'Imran 3:97 and Fatihah 12:1", "( كتاب [ kitab ] )", "\x02em\x03 and \x04strong\x05 \x06both\x07 \x10متن\x11",
]


def literal(s: str) -> str:
    """A SQL string; characters that SQL text can't hold plainly by their number."""
    out, run = [], ""
    for c in s:
        if ord(c) < 32 or c == "­":
            out += [f"'{run}'", f"chr({ord(c)})"] if run else [f"chr({ord(c)})"]
            run = ""
        else:
            run += "''" if c == "'" else c
    return " || ".join(out + ([f"'{run}'"] if run or not out else []))


def cases(spark) -> DataFrame:
    """(id, text): the lines of all documents are joined by texts of CASES under negative numbers."""
    return spark.createDataFrame([(-i, c) for i, c in enumerate(CASES, 1)], "id long, text string")


def texts(t) -> DataFrame:
    """(id, text): every line of every document, and the CASES. id is doc_id * 1000 + line number."""
    return t.lines.select((C("doc_id") * 1000 + C("line_no")).alias("id"), C("line").alias("text")).unionByName(cases(t.spark))


TEXTS_SQL = (
    LINES_SQL
    + ",\ntexts AS (SELECT doc_id * 1000 + line_no AS id, line AS text FROM lines UNION ALL SELECT * FROM (VALUES "
    + ", ".join(f"({-i}, {literal(c)})" for i, c in enumerate(CASES, 1))
    + ") AS v(id, text))"
)


def elements(t) -> DataFrame:
    """Lines of documents as elements: five lines a page, the fifth a note; short lines that begin with a capital are headings; every third line is in small letters without its full stop, some lines end in a note mark, and every third page has a printed
    number."""
    d = t.lines.where(F.trim("line") != "")
    n = F.length("line")
    kind = F.when(C("line_no") % 5 == 4, "footnote").when(C("line").rlike("^[A-Z]") & (n <= 30), "heading").otherwise("paragraph")
    pno = F.floor(C("line_no") / 5) + 1
    mark = F.when((n % 4 == 0) & (C("line_no") % 5 < 4), F.concat(F.lit(" †"), (n % 3 + 1).cast("string"), F.lit("†"))).otherwise("")
    return d.select(
        C("doc_id").alias("book"), pno.cast("long").alias("pno"), C("line_no").cast("long").alias("seq"), kind.alias("kind"), F.concat(F.when(n % 3 == 0, F.lower(F.rtrim("line", F.lit(".")))).otherwise(C("line")), mark).alias("text"), (n % 3 + 1).cast("long").alias("level"),
        (n % 3 + 1).cast("string").alias("number"), F.when(pno % 3 == 0, pno + 10).cast("long").alias("printed"), (n % 101).cast("double").alias("conf"),
    )


ELEMENTS_SQL = (
    LINES_SQL
    + """,
elements AS (SELECT doc_id AS book, line_no // 5 + 1 AS pno, line_no AS seq, CASE WHEN line_no % 5 = 4 THEN 'footnote' WHEN regexp_matches(line, '^[A-Z]') AND length(line) <= 30 THEN 'heading' ELSE 'paragraph' END AS kind,
    CASE WHEN length(line) % 3 = 0 THEN lower(rtrim(line, '.')) ELSE line END || CASE WHEN length(line) % 4 = 0 AND line_no % 5 < 4 THEN ' †' || (length(line) % 3 + 1) || '†' ELSE '' END AS text, length(line) % 3 + 1 AS level, CAST(length(line) % 3 + 1 AS VARCHAR) AS number,
    CASE WHEN (line_no // 5 + 1) % 3 = 0 THEN line_no // 5 + 11 END AS printed, CAST(length(line) % 101 AS DOUBLE) AS conf FROM lines WHERE trim(line, ' ') != '')"""
)


def spans(t) -> DataFrame:
    """Boxes as spans of a text layer: two spans a line, in fonts and sizes by their numbers. Pages are 420 wide and 600 high."""
    b = t.boxes
    font = F.element_at(F.array(*map(F.lit, FONTS)), C("pick") % 4 + 1)
    word = F.element_at(F.array(*map(F.lit, WORDS)), C("pick") + 1)
    line = F.floor((C("seq") + 1) / 2)
    d = b.select(
        F.lit("b").alias("book"), C("pno"), F.when(C("conf") >= 98, 1).otherwise(0).alias("block_type"), line.cast("long").alias("line_no"), C("seq").cast("long").alias("span_no"), word.alias("text"), font.alias("font"),
        ((C("conf") % 9) + 6).alias("size"), (C("pick") * 3).alias("flags"), "x0", (C("y0") * 6).alias("y0"), "x1", (C("y1") * 6).alias("y1"),
    )
    from pyspark.sql import Window as W

    w = W.partitionBy("pno", "line_no")
    return d.withColumns({"lx0": F.min("x0").over(w), "ly0": F.min("y0").over(w), "lx1": F.max("x1").over(w), "ly1": F.max("y1").over(w)})


FONTS = ["Times-Roman", "Arial-BoldMT", "Arial-ItalicMT", "Arial"]
WORDS = ["THE LONG ROAD 12", "3", "of many", "x1y", "  ", "Good words follow.", "m", "*"]
SPANS_SQL = (
    BOXES_SQL
    + f""",
raw_spans AS (SELECT 'b' AS book, pno, CASE WHEN conf >= 98 THEN 1 ELSE 0 END AS block_type, CAST((seq + 1) // 2 AS BIGINT) AS line_no, CAST(seq AS BIGINT) AS span_no, ({WORDS})[pick + 1] AS text, ({FONTS})[pick % 4 + 1] AS font, conf % 9 + 6 AS size, pick * 3 AS flags, x0, y0 * 6 AS y0, x1, y1 * 6 AS y1 FROM boxes),
spans AS (SELECT *, min(x0) OVER w AS lx0, min(y0) OVER w AS ly0, max(x1) OVER w AS lx1, max(y1) OVER w AS ly1 FROM raw_spans WINDOW w AS (PARTITION BY pno, line_no))"""
)


def span_pages(t) -> DataFrame:
    return t.lineitem.select(C("l_orderkey").alias("pno")).distinct().select(F.lit("b").alias("book"), "pno", F.lit(420.0).alias("width"), F.lit(600.0).alias("height"))


PAGES_SQL = "span_pages AS (SELECT DISTINCT 'b' AS book, l_orderkey AS pno, 420.0::DOUBLE AS width, 600.0::DOUBLE AS height FROM lineitem)"


def vocabulary(t) -> DataFrame:
    """(norm, canonical): the small-letter words of the parts' names and some transliterations."""
    w = t.part.select(F.explode(F.split("p_name", " ")).alias("norm")).distinct()
    own = t.spark.createDataFrame([(w,) for w in OWN_WORDS], "norm string")
    return w.unionByName(own).distinct().select("norm", F.concat(F.lit("c:"), "norm").alias("canonical"))


OWN_WORDS = ["miqat", "taqsir", "talbiyah", "kitab", "on", "tin", "est", "ion", "lic", "rec"]
VOCABULARY_SQL = f"vocabulary AS (SELECT DISTINCT norm, 'c:' || norm AS canonical FROM (SELECT unnest(string_split(p_name, ' ')) AS norm FROM part UNION ALL SELECT unnest({OWN_WORDS})))"
