"""The registered queries: each runs one operator over whole tables, beside SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import noise, text
from ..operators import lines, overlap
from ..sinks.stages import stage
from ..sources import tables
from ..sources.tables import BOXES_SQL, LINES_SQL
from . import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: What a box's pick chooses: script with and without marks, mixtures, Latin text, other scripts.
TEXTS = ["بسم الله الرحمن", "قُلْ هُوَ اللَّهُ أَحَدٌ", "ab 12 من", "Plain English words here", "سلام 08 2121800510135", "پارسی گفتار", "اردو ہے ٹڈ", "שלום עולם"]
LANGS = ["ar-SA", "fa", "ur-PK", "HE", "el-GR", "en", "fr", "yi"]
PICKED = BOXES_SQL + f",\npicked AS (SELECT *, ({TEXTS})[pick + 1] AS text, ({LANGS})[pick + 1] AS tag FROM boxes)"
WORDS = r"words AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x != '')) AS word FROM documents)"
PAGE_LINES = LINES_SQL + ",\nplaced AS (SELECT *, CAST(line_no * 12 + 50 AS DOUBLE) AS y0, CAST(line_no * 12 + 60 AS DOUBLE) AS y1, CAST(40 + length(line) % 5 * 6 AS DOUBLE) AS x0, line ~ '^[A-Z]' AND length(line) <= 30 AS heading FROM lines)"


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        tables.bounded(spark)

    def __getattr__(self, name: str) -> DataFrame:
        return tables.table(self.spark, self.folder, name)

    @property
    def boxes(self) -> DataFrame:
        return tables.boxes(self.lineitem)

    @property
    def picked(self) -> DataFrame:
        at = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("pick") + 1)
        return self.boxes.withColumn("text", at(TEXTS)).withColumn("tag", at(LANGS))

    @property
    def lines(self) -> DataFrame:
        return tables.lines(self.documents)

    @property
    def placed(self) -> DataFrame:
        n = F.col("line_no")
        return self.lines.withColumns(
            {
                "y0": (n * 12 + 50).cast("double"),
                "y1": (n * 12 + 60).cast("double"),
                "x0": (F.length("line") % 5 * 6 + 40).cast("double"),
                "heading": F.col("line").rlike("^[A-Z]") & (F.length("line") <= 30),
            }
        )

    @property
    def words(self) -> DataFrame:
        return self.documents.select("doc_id", F.explode(noise.words(F.col("text"))).alias("word"))


def query(name: str, sql: str | None = None):
    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            SQL[name] = sql
        return f

    return register


def n(pattern: str, of: str = "text") -> str:
    """SQL for the number of matches."""
    return "len(regexp_extract_all({}, '{}'))".format(of, pattern.replace("'", "''"))


def has(pattern: str, of: str) -> str:
    return "regexp_matches({}, '{}')".format(of, pattern.replace("'", "''"))


def long(c: Column) -> Column:
    return c.cast("long")


C = F.col
AR, LATIN, DIA, CLUT = n(text.RTL), n("[A-Za-z]"), n(text.MARKS), n(text.CLUTTER)
CONF = "coalesce(CASE WHEN conf > 0 AND conf <= 1 THEN conf * 100 ELSE conf END, {})"

# Predicates and scalar functions


@query("f1_rtl_dominant", f"WITH {fixtures.TEXTS_SQL}, n AS (SELECT id, len(regexp_extract_all(text, '[\\x{{600}}-\\x{{6ff}}\\x{{fb50}}-\\x{{fdff}}\\x{{fe70}}-\\x{{feff}}]')) AS ar, len(regexp_extract_all(text, '[A-Za-z]')) AS latin FROM texts) SELECT id, ar >= 2 AND ar >= latin * 0.8 AS rtl, CAST(ar AS BIGINT) AS ar, CAST(latin AS BIGINT) AS latin FROM n")
def f1(t):
    x = C("text")
    return fixtures.texts(t).select("id", text.rtl_dominant(x).alias("rtl"), long(text.rtl_chars(x)).alias("ar"), long(text.latin_chars(x)).alias("latin"))


@query("f2_geometric_artifact", f"WITH {BOXES_SQL} SELECT pno, seq FROM boxes WHERE x1 > x0 AND y1 > y0 AND ((y1 - y0 > x1 - x0 AND x1 - x0 < 40) OR (x1 - x0 < (y1 - y0) * 0.5 AND x1 - x0 < 60))")
def f2(t):
    return t.boxes.where(noise.geometric_artifact(C("x0"), C("y0"), C("x1"), C("y1"))).select("pno", "seq")


@query("f3_clutter", f"WITH {LINES_SQL} SELECT doc_id, line_no, CAST({n(text.CLUTTER, 'line')} AS BIGINT) AS clutter, CAST({n('[0-9]', 'line')} AS BIGINT) AS digits FROM lines")
def f3(t):
    return t.lines.select("doc_id", long(C("line_no")).alias("line_no"), long(text.clutter_chars(C("line"))).alias("clutter"), long(text.digit_chars(C("line"))).alias("digits"))


SIGNS = f"((c < 35 AND {DIA} < {AR} * 0.05) OR (c < 50 AND {DIA} = 0) OR (c < 50 AND {CLUT} >= {AR} * 0.2) OR (c < 60 AND {DIA} < {AR} * 0.03 AND {CLUT} >= {AR} * 0.1))"
COVER = """it AS (SELECT pno, seq, x0, y0, x1, y1, conf, text FROM picked WHERE pick != 3), wd AS (SELECT pno, x0 AS wx0, y0 AS wy0, x1 AS wx1, y1 AS wy1 FROM picked WHERE pick = 3),
j AS (SELECT pno, seq, greatest(wx0, x0) AS a, least(wx1, x1) AS b FROM it JOIN wd USING (pno) WHERE wy1 >= y0 AND wy0 <= y1 AND least(wx1, x1) > greatest(wx0, x0)),
m AS (SELECT *, coalesce(max(b) OVER (PARTITION BY pno, seq ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a) AS top FROM j),
u AS (SELECT pno, seq, sum(greatest(0, b - greatest(a, top))) AS covered FROM m GROUP BY pno, seq),
cov AS (SELECT it.*, least(coalesce(covered, 0) / greatest(x1 - x0, 1), 1.0) AS coverage, """ + CONF.format(0) + " AS c FROM it LEFT JOIN u USING (pno, seq))"


def covered(t) -> DataFrame:
    p = t.picked
    return overlap.horizontal_coverage(p.where("pick != 3"), p.where("pick = 3"), "pno")


@query("j2_horizontal_coverage", f"WITH {PICKED}, {COVER} SELECT pno, seq, coverage FROM cov")
def j2(t):
    return covered(t).select("pno", "seq", "coverage")


@query("f4_line_hallucination", f"WITH {PICKED}, {COVER} SELECT pno, seq FROM cov WHERE {AR} > 0 AND coverage >= 0.5 AND {SIGNS}")
def f4(t):
    return covered(t).where(noise.line_hallucinated(C("text"), C("conf"), C("coverage"))).select("pno", "seq")


@query("f5_block_hallucination", f"WITH {PICKED}, {COVER} SELECT pno, seq FROM cov WHERE c < 45 AND {AR} > 0 AND {DIA} < {AR} * 0.03 AND coverage >= 0.5")
def f5(t):
    return covered(t).where(noise.block_hallucinated(C("text"), C("conf"), C("coverage"))).select("pno", "seq")


RUN4 = has(text.RTL_WORD + "{4,}", "text")
TINY = "len(list_filter(string_split(text, chr(10)), lambda s: length(trim(s)) > 3)) = 0"
DROP = f"({AR} < 5 OR {LATIN} > {AR} * 0.6 OR {TINY} OR (NOT {RUN4} AND c < 80))"


@query("f6_block_cascade", f"WITH {PICKED}, b AS (SELECT *, {CONF.format(100)} AS c FROM picked) SELECT pno, seq, NOT {DROP} AS kept, NOT ({DROP} OR {n('[0-9]')} >= {AR} * 0.2 OR ({AR} < 30 AND {n('[0-9]')} >= 1 AND c < 60)) AS kept_strict FROM b")
def f6(t):
    return t.picked.select("pno", "seq", noise.block_kept(C("text"), C("conf")).alias("kept"), noise.block_kept(C("text"), C("conf"), True).alias("kept_strict"))


@query(
    "f8_citation_dense",
    f"WITH {PICKED}, k AS (SELECT doc_id, sum(length(line)) AS size, sum({n('[0-9]', 'line')}) AS digits FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id), "
    f"a AS (SELECT DISTINCT pno FROM picked WHERE {AR} >= 12 AND conf >= 65) SELECT doc_id, CAST(digits AS BIGINT) AS digits FROM k WHERE size >= 1000 AND digits >= size * 0.005 AND doc_id NOT IN (SELECT pno FROM a)",
)
def f8(t):
    k = t.lines.groupBy("doc_id").agg(F.sum(F.length("line")).alias("size"), F.sum(text.digit_chars(C("line"))).alias("digits"))
    anchored = t.picked.where((text.rtl_chars(C("text")) >= 12) & (C("conf") >= 65)).select(C("pno").alias("doc_id"))
    return k.where((C("size") >= 1000) & (C("digits") >= C("size") * 0.005)).join(anchored, "doc_id", "left_anti").select("doc_id", "digits")


LONG_BLOCK = 12  # texts of a box in a block, that some reach 100 script characters


@query(
    "f8_citation_pages",
    f"WITH {PICKED}, k AS (SELECT doc_id, sum(length(line)) AS size, sum({n('[0-9]', 'line')}) AS digits FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id), "
    f"a AS (SELECT DISTINCT pno FROM (SELECT pno, repeat(text, {LONG_BLOCK}) AS text, {CONF.format(0)} AS c FROM picked) WHERE {AR} >= 100 AND c >= 65) "
    "SELECT doc_id, CAST(digits AS BIGINT) AS digits FROM k WHERE size >= 1000 AND digits >= size * 0.03 AND doc_id NOT IN (SELECT pno FROM a)",
)
def f8_pages(t):
    k = t.lines.groupBy("doc_id").agg(F.sum(F.length("line")).alias("size"), F.sum(text.digit_chars(C("line"))).alias("digits"))
    anchored = t.picked.where(noise.anchors_script(F.repeat("text", F.lit(LONG_BLOCK)), C("conf"))).select(C("pno").alias("doc_id"))
    return k.where(noise.citation_dense(C("size"), C("digits"))).join(anchored, "doc_id", "left_anti").select("doc_id", "digits")


HINT = text.HINTS.replace("'", "''")


def bad(w: str) -> str:
    up, lo = n(r"\p{Lu}", w), n(r"\p{Ll}", w)
    inner = n(r"\p{Lu}", f"substr({w}, 2)")
    return (
        f"CASE WHEN length({w}) < 3 THEN false WHEN {has(text.HINTS, w)} OR (NOT {has(r'^[A-Za-z\-\']+$', w)} AND {has('[A-Za-z][0-9]+[A-Za-z]', w)}) THEN true WHEN {n(r'\p{L}', w)} = 0 THEN false "
        f"WHEN {n(r'\p{L}', w)} >= 4 AND {n('[aeiouyAEIOUY]', w)} = 0 THEN true WHEN {has('[bcdfghjklmnpqrstvwxz]{4,}', f'lower({w})')} THEN true "
        f"ELSE {lo} >= 1 AND {inner} >= 1 AND {up} * 2 <= length({w}) AND (({lo} >= 2 AND length({w}) <= 7) OR {inner} >= 2) END"
    )


@query("f10_word_mojibake", f"WITH {WORDS} SELECT doc_id, count(*) AS words, count(*) FILTER ({bad('word')}) AS bad FROM words GROUP BY doc_id")
def f10(t):
    return t.words.groupBy("doc_id").agg(F.count(F.lit(1)).alias("words"), F.count_if(noise.word_is_mojibake(C("word"))).alias("bad"))


def line_is_bad(x: str) -> str:
    w = rf"list_filter(regexp_split_to_array(trim({x}), '\s+'), lambda w: w != '')"
    return (
        f"CASE WHEN trim({x}) = '' OR {has(text.RTL, x)} THEN false WHEN {has(text.HINTS, x)} THEN true WHEN NOT {has(r'\p{L}', x)} THEN false "
        f"ELSE len(list_filter({w}, lambda w: {bad('w')})) >= greatest(1, len({w}) // 2) END"
    )


REAL = f"len(list_filter(regexp_extract_all(line, '[A-Za-z][A-Za-z\\-'']{{2,}}'), lambda w: {has('[aeiouyAEIOUY]', 'w')} AND NOT ({bad('w')})))"


@query("f11_string_mojibake", f"WITH {LINES_SQL} SELECT doc_id, line_no, {line_is_bad('line')} AS bad FROM lines")
def f11(t):
    return t.lines.select("doc_id", long(C("line_no")).alias("line_no"), noise.string_is_mojibake(C("line")).alias("bad"))


@query("f12_real_words", f"WITH {LINES_SQL} SELECT doc_id, line_no, CAST({REAL} AS BIGINT) AS real FROM lines")
def f12(t):
    return t.lines.select("doc_id", long(C("line_no")).alias("line_no"), long(noise.real_words(C("line"))).alias("real"))


L_ = n(r"\p{L}", "trim(line)")


@query(
    "f13_line_filter",
    f"WITH {LINES_SQL} SELECT doc_id, line_no FROM lines WHERE {REAL} >= 2 OR (line_no % 5 != 0 AND NOT ({line_is_bad('line')}) AND NOT (({L_} < 2 AND NOT {has('[0-9]', 'line')}) OR ({L_} < 4 AND {L_} < length(trim(line)) * 0.4)))",
)
def f13(t):
    return t.lines.where(noise.keep_line(C("line"), C("line_no") % 5 == 0)).select("doc_id", long(C("line_no")).alias("line_no"))


@query(
    "f14_audit_words",
    rf"WITH {WORDS} SELECT doc_id, count(*) AS real FROM words WHERE regexp_matches(word, '^\p{{L}}+$') AND NOT ({n(r'\p{L}', 'word')} - {n('[aeiouyAEIOUY]', 'word')} >= 4 AND {n('[aeiouyAEIOUY]', 'word')} = 0) "
    rf"AND NOT ({n(r'\p{Lu}', 'substr(word, 2)')} >= 1 AND {n(r'\p{Lu}', 'word')} <= length(word) // 2 AND length(word) <= 7) GROUP BY doc_id",
)
def f14(t):
    return t.words.where(noise.audit_word(C("word"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("real"))


@query("f17_centered", f"WITH {BOXES_SQL}, m AS (SELECT *, min(x0) OVER (PARTITION BY pno) AS l, max(x1) OVER (PARTITION BY pno) AS r FROM boxes) SELECT pno, seq FROM m WHERE x1 - x0 <= greatest(r - l, 1) * 0.78 AND abs((x0 + x1) / 2 - (l + r) / 2) < 18")
def f17(t):
    w = W.partitionBy("pno")
    d = t.boxes.withColumn("l", F.min("x0").over(w)).withColumn("r", F.max("x1").over(w))
    return d.where(noise.centered(C("x0"), C("x1"), C("l"), C("r"))).select("pno", "seq")


@query(
    "f22_plausible_tokens",
    rf"WITH {WORDS}, b AS (SELECT doc_id, regexp_replace(word, '[!?,.;:]+$', '') AS b FROM words) SELECT doc_id, count(*) AS plausible FROM b WHERE b = '' OR lower(b) IN ({', '.join(repr(w) for w in noise.SAFE_SHORT)}) "
    "OR regexp_matches(b, '^[A-Z][a-z]{2,}$') OR (regexp_matches(b, '^[a-z]+(''[a-z]+)?$') AND length(replace(b, '''', '')) >= 4 AND regexp_matches(b, '[aeiouy]')) GROUP BY doc_id",
)
def f22(t):
    return t.words.where(noise.plausible_english(C("word"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("plausible"))


@query(
    "t1_detect_script",
    f"WITH {fixtures.TEXTS_SQL} SELECT id, CASE WHEN regexp_matches(text, '[\\x{{679}}\\x{{688}}\\x{{6d2}}\\x{{691}}\\x{{6ba}}]') THEN 'ur' WHEN regexp_matches(text, '[\\x{{67e}}\\x{{686}}\\x{{698}}\\x{{6af}}\\x{{6a9}}\\x{{6cc}}]') THEN 'fa' "
    "WHEN regexp_matches(text, '[\\x{600}-\\x{6ff}\\x{fb50}-\\x{fdff}\\x{fe70}-\\x{feff}]') THEN 'ar' WHEN regexp_matches(text, '[\\x{590}-\\x{5ff}\\x{fb1d}-\\x{fb4f}]') THEN 'he' WHEN regexp_matches(text, '[\\x{370}-\\x{3ff}\\x{1f00}-\\x{1fff}]') THEN 'el' "
    "WHEN regexp_matches(text, '[\\x{900}-\\x{97f}]') THEN 'hi' WHEN regexp_matches(text, '[\\x{4e00}-\\x{9fff}]') THEN 'zh' WHEN regexp_matches(text, '[\\x{400}-\\x{4ff}]') THEN 'ru' END AS script FROM texts",
)
def t1(t):
    return fixtures.texts(t).select("id", text.detect_script(C("text")).alias("script"))


P = "lower(split_part(tag, '-', 1))"


@query(
    "t2_direction_and_class",
    f"WITH {PICKED} SELECT pno, seq, {P} IN ('ar','fa','he','ur','yi','ps','sd') AS rtl, CASE {P} WHEN 'ar' THEN 'arabic' WHEN 'fa' THEN 'persian' WHEN 'ur' THEN 'urdu' WHEN 'he' THEN 'hebrew' WHEN 'el' THEN 'greek' END AS css FROM picked",
)
def t2(t):
    return t.picked.select("pno", "seq", text.is_rtl(C("tag")).alias("rtl"), text.css_class(C("tag")).alias("css"))


@query("t3_normalize_space", r"SELECT doc_id, trim(regexp_replace(replace(text, chr(160), ' '), '\s+', ' ', 'g')) AS text FROM documents")
def t3(t):
    return t.documents.select("doc_id", text.squeeze(C("text")).alias("text"))


@query("t5_hyphen_join", r"SELECT doc_id, replace(regexp_replace(text, '(\p{Ll})-\s+', '\1', 'g'), chr(173), '') AS text FROM documents")
def t5(t):
    return t.documents.select("doc_id", text.join_hyphenation(C("text")).alias("text"))


def _entities(x: str) -> str:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"), ("&#x27;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


@query("t10_html_to_text", "SELECT page_id, " + _entities("regexp_replace(html, '<[^>]*>?|>', '', 'g')") + " AS text FROM pages")
def t10(t):
    return t.pages.select("page_id", text.html_text(C("html")).alias("text"))


@query("t11_html_segments", "SELECT page_id, s LIKE '<%' AS tag, count(*) AS segments, CAST(sum(length(s)) AS BIGINT) AS chars FROM (SELECT page_id, unnest(regexp_extract_all(html, '<[^>]*>?|[^<]+')) AS s FROM pages) GROUP BY ALL")
def t11(t):
    d = t.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<[^>]*>?|[^<]+"), F.lit(0))).alias("s"))
    return d.groupBy("page_id", C("s").startswith("<").alias("tag")).agg(F.count(F.lit(1)).alias("segments"), F.sum(F.length("s")).alias("chars"))


@query("t17_transliteration", rf"WITH {WORDS} SELECT DISTINCT word, regexp_replace(replace(strip_accents(lower(word)), 'ı', 'i'), '[^a-z'']', '', 'g') AS norm FROM words")
def t17(t):
    return t.words.select("word").distinct().withColumn("norm", text.normalize_translit(C("word")))


@query("t18_strip_marks", f"WITH {fixtures.TEXTS_SQL} SELECT id, translate(regexp_replace(text, '[\\x{{610}}-\\x{{61a}}\\x{{64b}}-\\x{{65f}}\\x{{670}}\\x{{6d6}}-\\x{{6ed}}]', '', 'g'), 'ٱآأإىة', 'اااايه') AS bare FROM texts")
def t18(t):
    return fixtures.texts(t).select("id", text.strip_diacritics(C("text")).alias("bare"))


@query("t28_escape_html", "SELECT doc_id, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS text FROM documents")
def t28(t):
    return t.documents.select("doc_id", text.escape_html(C("text")).alias("text"))


@query("t33_json_fields", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def t33(t):
    return t.events.select("event_id", F.from_json("props", "k long").k.alias("k"))


@query("t34_content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def t34(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("hash"))


@query("w10_slugs", "WITH s AS (SELECT p_partkey, CASE WHEN s = '' THEN 'section' ELSE s END AS s FROM (SELECT p_partkey, lower(trim(regexp_replace(p_name, '[^A-Za-z0-9]+', '-', 'g'), '-')) AS s FROM part)), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY p_partkey) AS k FROM s) SELECT p_partkey, s || CASE WHEN k > 1 THEN '-' || k ELSE '' END AS slug FROM r")  # fmt: skip
def w10(t):
    d = t.part.select("p_partkey", text.slug(C("p_name")).alias("s"))
    k = F.row_number().over(W.partitionBy("s").orderBy("p_partkey"))
    return d.withColumn("k", k).select("p_partkey", F.when(C("k") > 1, F.concat("s", F.lit("-"), C("k").cast("string"))).otherwise(C("s")).alias("slug"))


# Joins of boxes


def sides(t, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    p = t.picked
    return p.where(a), p.where(b)


MEET = "greatest(0, least(a.{1}, b.{1}) - greatest(a.{0}, b.{0}))"
H, V = MEET.format("x0", "x1"), MEET.format("y0", "y1")


@query(
    "j1_best_refined",
    f"WITH {PICKED}, a AS (SELECT * FROM picked WHERE pick < 4), b AS (SELECT * FROM picked WHERE pick >= 4), j AS (SELECT a.pno, a.seq, b.text, b.conf, {H} * {V} / greatest((a.x1 - a.x0) * (a.y1 - a.y0), 1e-6) AS share, b.seq AS bs FROM a JOIN b ON a.pno = b.pno), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY pno, seq ORDER BY share DESC, bs) AS k FROM j WHERE share >= 0.3) SELECT a.pno, a.seq, coalesce(r.text, a.text) AS text, CASE WHEN r.conf > 0 THEN r.conf ELSE a.conf END AS conf FROM a LEFT JOIN r ON a.pno = r.pno AND a.seq = r.seq AND k = 1",
)
def j1(t):
    a, b = sides(t, "pick < 4", "pick >= 4")
    return overlap.best_refined(a, b.select("pno", "seq", "x0", "y0", "x1", "y1", "text", "conf"), "pno").select("pno", "seq", "text", "conf")


@query(
    "j3_first_zone",
    f"WITH {PICKED}, a AS (SELECT *, pick % 2 = 1 AS garbled FROM picked WHERE pick >= 3), b AS (SELECT pno, seq AS bs, y0 AS b0, y1 AS b1, {AR} AS n, CASE WHEN {AR} < 4 THEN 0.0 WHEN y1 - y0 >= 22 THEN 6.0 ELSE 2.0 END AS pad FROM picked WHERE pick < 3), "
    "j AS (SELECT a.*, bs, n, b0 - pad AS lo, b1 + pad AS hi, (y0 + y1) / 2 AS c FROM a JOIN b USING (pno)), "
    "z AS (SELECT pno, seq, min(bs) AS zone FROM j WHERE y1 >= lo AND y0 <= hi AND (n >= 4 OR (c BETWEEN lo - 0.5 AND hi + 0.5 AND garbled)) AND (c BETWEEN lo AND hi OR greatest(0, least(y1, hi) - greatest(y0, lo)) >= greatest(y1 - y0, 1) * 0.5) GROUP BY pno, seq) "
    "SELECT pno, seq, coalesce(zone, 0) AS zone FROM a LEFT JOIN z USING (pno, seq)",
)
def j3(t):
    a, b = sides(t, "pick >= 3", "pick < 3")
    return overlap.first_zone(a.withColumn("garbled", C("pick") % 2 == 1), b.withColumn("n", text.rtl_chars(C("text"))), "pno").select("pno", "seq", F.coalesce("zone", F.lit(0)).alias("zone"))


@query(
    "j4_without_overlays",
    f"WITH {BOXES_SQL}, a AS (SELECT * FROM boxes WHERE pick < 4), b AS (SELECT * FROM boxes WHERE pick >= 4 AND conf >= 80) SELECT pno, seq FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.pno = b.pno AND {V} / greatest(a.y1 - a.y0, 1e-6) >= 0.6 AND {H} * {V} / greatest((a.x1 - a.x0) * (a.y1 - a.y0), 1e-6) >= 0.85)",
)
def j4(t):
    a, b = sides(t, "pick < 4", "pick >= 4")
    return overlap.without_overlays(a, b, "pno").select("pno", "seq")


@query(
    "j5_line_format",
    f"WITH {PICKED}, a AS (SELECT * FROM picked WHERE pick < 5), b AS (SELECT *, x1 - x0 AS size FROM picked WHERE pick = 3 OR pick > 4), m AS (SELECT a.pno, a.seq, median(b.size) AS size, count(*) FILTER (b.pick = 3) > 0 AS it FROM a JOIN b ON a.pno = b.pno WHERE {V} >= (a.y1 - a.y0) * 0.4 GROUP BY a.pno, a.seq) "
    "SELECT pno, seq, CASE WHEN it THEN 'english,here,plain,words' ELSE '' END AS italic_words, coalesce(size, 0.0) AS size FROM a LEFT JOIN m USING (pno, seq)",
)
def j5(t):
    a, b = sides(t, "pick < 5", "pick = 3 or pick > 4")
    spans = b.select("pno", "y0", "y1", "text", (C("x1") - C("x0")).alias("size"), (C("pick") == 3).alias("italic"), F.lit(False).alias("bold"))
    return overlap.line_format(a, spans, "pno").select("pno", "seq", F.array_join("italic_words", ",").alias("italic_words"), "size")


@query(
    "j8_assign_once",
    f"WITH {BOXES_SQL} SELECT b.pno, b.seq AS block, min(a.seq) AS note FROM boxes a JOIN boxes b ON a.pno = b.pno WHERE a.pick < 3 AND b.pick >= 3 AND (b.y0 + b.y1) / 2 BETWEEN a.y0 - 4 AND a.y1 + 8 GROUP BY b.pno, b.seq",
)
def j8(t):
    a, b = sides(t, "pick < 3", "pick >= 3")
    return overlap.assign_once(a.withColumnRenamed("seq", "note"), b, "pno")


@query(
    "j10_last_marker",
    f"WITH {BOXES_SQL}, m AS (SELECT pno, y0 AS y FROM boxes WHERE pick < 2), l AS (SELECT pno, seq, (y0 + y1) / 2 AS c FROM boxes WHERE pick >= 2) SELECT l.pno, l.seq, (SELECT count(*) FROM m WHERE m.pno = l.pno AND m.y <= l.c + 4) AS bucket FROM l",
)
def j10(t):
    a, b = sides(t, "pick < 2", "pick >= 2")
    return overlap.last_marker(b.select("pno", "seq", ((C("y0") + C("y1")) / 2).alias("center")), a.select("pno", C("y0").alias("y")), "pno").select("pno", C("seq").cast("int").alias("seq"), "bucket")


HEADINGS = ["small rung", "red widgets", "Blue Bolt", "hot gear", "old gizmo"]


@query(
    "j14_known_titles",
    f"WITH h AS (SELECT unnest({HEADINGS}) AS title, unnest(range(0, {len(HEADINGS)})) AS ord), p AS (SELECT DISTINCT p_name FROM part), j AS (SELECT p_name, title, ord, lower(p_name) = lower(title) AS same FROM p JOIN h ON lower(p_name) = lower(title) OR (length(p_name) >= 4 AND length(title) >= 4 AND levenshtein(lower(p_name), lower(title)) <= 2)), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY same DESC, ord) AS k FROM j) SELECT p_name, title FROM r WHERE k = 1",
)
def j14(t):
    known = t.spark.createDataFrame([(h, i) for i, h in enumerate(HEADINGS)], "title string, ord int")
    a, b = F.lower("p_name"), F.lower("title")
    close = (F.length("p_name") >= 4) & (F.length("title") >= 4) & (F.levenshtein(a, b, 2) >= 0)
    j = t.part.select("p_name").distinct().join(F.broadcast(known), (a == b) | close)
    return j.groupBy("p_name").agg(F.min_by("title", F.struct((a != b).alias("other"), "ord")).alias("title"))


GRAMS = r"list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])"


BROADCAST_GRAMS = 2_000_000
"""So many grams of verses (16 bytes each) may go to all tasks; beyond that the grams of both sides are shuffled."""


def gram_hashes(df: DataFrame, key: str, n: int) -> DataFrame:
    """(key, g): a hash of each n words in a row of a text."""
    w = df.select(key, F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("w")).where(F.size("w") >= n)
    return w.select(key, F.explode(F.expr(f"transform(sequence(1, size(w) - {n - 1}), i -> xxhash64(array_join(slice(w, i, {n}), ' ')))")).alias("g"))


def gram_hits(docs: DataFrame, verses: DataFrame, n: int) -> DataFrame:
    """(doc_id, item_id, hits): how many different n-grams they share. Only the grams of documents that a verse has leave their task, as long as the verses' are few."""
    v = gram_hashes(verses, "item_id", n).distinct()
    few = v.limit(BROADCAST_GRAMS + 1).count() <= BROADCAST_GRAMS
    return gram_hashes(docs, "doc_id", n).join(F.broadcast(v) if few else v, "g").groupBy("doc_id", "item_id").agg(F.count_distinct("g").alias("hits"))


@query(
    "j16_anchor_join",
    "WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents), b AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark), "
    f"dg AS (SELECT DISTINCT doc_id, unnest({GRAMS}) AS g FROM d WHERE len(w) >= 4), bg AS (SELECT DISTINCT item_id, unnest({GRAMS}) AS g FROM b WHERE len(w) >= 4) SELECT doc_id, item_id, count(*) AS hits FROM dg JOIN bg USING (g) GROUP BY ALL",
)
def j16(t):
    return gram_hits(t.documents, t.benchmark, 4)


GRAMS3 = r"list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])"


def anchor_candidates(docs: DataFrame, verses: DataFrame) -> DataFrame:
    """(doc_id, item_id, gram, hits): pairs with a common 4-gram; for documents that have none, those with a common 3-gram."""
    four = stage(gram_hits(docs, verses, 4), "anchors")  # both parts need it
    three = gram_hits(docs.join(four.select("doc_id"), "doc_id", "left_anti"), verses, 3)
    return four.withColumn("gram", F.lit(4)).unionByName(three.withColumn("gram", F.lit(3)))


@query(
    "j16_anchor_candidates",
    "WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents), b AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark), "
    f"d4 AS (SELECT DISTINCT doc_id, unnest({GRAMS}) AS g FROM d WHERE len(w) >= 4), b4 AS (SELECT DISTINCT item_id, unnest({GRAMS}) AS g FROM b WHERE len(w) >= 4), h4 AS (SELECT doc_id, item_id, count(*) AS hits FROM d4 JOIN b4 USING (g) GROUP BY ALL), "
    f"d3 AS (SELECT DISTINCT doc_id, unnest({GRAMS3}) AS g FROM d WHERE len(w) >= 3 AND doc_id NOT IN (SELECT doc_id FROM h4)), b3 AS (SELECT DISTINCT item_id, unnest({GRAMS3}) AS g FROM b WHERE len(w) >= 3), "
    "h3 AS (SELECT doc_id, item_id, count(*) AS hits FROM d3 JOIN b3 USING (g) GROUP BY ALL) SELECT doc_id, item_id, hits, 4 AS gram FROM h4 UNION ALL SELECT doc_id, item_id, hits, 3 AS gram FROM h3",
)
def j16_candidates(t):
    return anchor_candidates(t.documents, t.benchmark)


@query("j19_overrides", "SELECT doc_id, coalesce(CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'poor' END, source) AS body, quality IS NOT NULL AS replaced FROM documents LEFT JOIN labels USING (doc_id)")
def j19(t):
    over = t.labels.select("doc_id", F.when(C("quality") == 1, "good").when(C("quality") == 0, "poor").alias("o"))
    return t.documents.join(over, "doc_id", "left").select("doc_id", F.coalesce("o", "source").alias("body"), C("o").isNotNull().alias("replaced"))


@query("j24_not_reviewed", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j24(t):
    return t.documents.join(t.labels, "doc_id", "left_anti").select("doc_id")


# Groupings


@query(
    "a1_words_to_lines",
    f"WITH {PICKED} SELECT pno, CAST(seq % 2 AS INTEGER) AS line, string_agg(trim(text), ' ' ORDER BY seq) AS text, min(x0) / 4 AS x0, min(y0) / 4 AS y0, max(x1) / 4 AS x1, max(y1) / 4 AS y1, avg(conf) AS conf FROM picked GROUP BY pno, seq % 2",
)
def a1(t):
    d = t.picked.withColumn("line", C("seq") % 2)
    d = d.select("pno", "line", "seq", "text", "conf", C("x0").alias("left"), C("y0").alias("top"), (C("x1") - C("x0")).alias("width"), (C("y1") - C("y0")).alias("height"))
    return lines.words_to_lines(d, ["pno", "line"], "seq", 4.0)


HEIGHT = "h AS (SELECT pno, median(y1 - y0) AS h FROM picked WHERE y1 > y0 GROUP BY pno)"


@query(
    "a2_lines_to_blocks",
    f"WITH {PICKED}, {HEIGHT}, f AS (SELECT p.*, CASE WHEN y0 - lag(y1) OVER (PARTITION BY pno ORDER BY y0, seq) <= coalesce(h, 14) * 0.1 THEN 0 ELSE 1 END AS s FROM picked p LEFT JOIN h USING (pno)), "
    "g AS (SELECT *, sum(s) OVER (PARTITION BY pno ORDER BY y0, seq) AS block FROM f) SELECT pno, CAST(block AS BIGINT) AS block, count(*) AS n_lines, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, string_agg(text, chr(10) ORDER BY y0, seq) AS text, avg(conf) AS conf FROM g GROUP BY pno, block",
)
def a2(t):
    return lines.lines_to_blocks(t.picked, ["pno"], ["y0", "seq"], factor=0.1)


@query("a3_body_size", f"WITH {PICKED} SELECT CAST(pno % 50 AS BIGINT) AS book, coalesce(median(CASE WHEN y1 - y0 BETWEEN 9 AND 14 AND {AR} = 0 THEN y1 - y0 END), 11.2) AS body_size FROM picked GROUP BY pno % 50")
def a3(t):
    d = t.picked.select((C("pno") % 50).alias("book"), (C("y1") - C("y0")).alias("size"), (text.rtl_chars(C("text")) > 0).alias("rtl"), F.lit(False).alias("garbled"))
    return lines.body_size(d, "book")


@query("a7_vocabulary", "SELECT DISTINCT lower(w) AS word FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]{2,}')) AS w FROM documents)")
def a7(t):
    return t.documents.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{2,}"), F.lit(0))).alias("w")).select(F.lower("w").alias("word")).distinct()


@query(
    "a8_audit_counts",
    "SELECT source, lang, CAST(sum(len(regexp_extract_all(text, '[A-Za-z]+'))) AS BIGINT) AS words, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) AS docs, 100.0 * count(*) FILTER (text LIKE '%@%') / count(*) AS share FROM documents GROUP BY ROLLUP (source, lang)",
)
def a8(t):
    d = t.documents.rollup("source", "lang").agg(
        F.sum(text.count(C("text"), "[A-Za-z]+")).alias("words"), F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("docs"), F.count_if(F.contains("text", F.lit("@"))).alias("at")
    )
    return d.select("source", "lang", "words", "chars", "docs", (F.lit(100.0) * C("at") / C("docs")).alias("share"))


@query("a10_batch_summary", "SELECT o_orderpriority, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS ok, count(*) FILTER (o_orderstatus != 'F') AS failed FROM orders GROUP BY o_orderpriority")
def a10(t):
    ok = C("o_orderstatus") == "F"
    return t.orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"))


@query("a11_token_estimate", "SELECT source, CAST(sum(greatest(64, length(text) // 3)) AS BIGINT) AS tokens FROM documents GROUP BY source")
def a11(t):
    return t.documents.groupBy("source").agg(F.sum(F.greatest(F.lit(64), F.floor(F.length("text") / 3))).alias("tokens"))


@query("k8_flat_cells", r"SELECT doc_id, regexp_replace(text, '[\t\n\r]+', ' ', 'g') AS excerpt FROM documents")
def k8(t):
    return t.documents.select("doc_id", F.regexp_replace("text", r"[\t\n\r]+", " ").alias("excerpt"))


@query("k4_markdown", r"WITH e AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN '### ' || regexp_replace(text, '([\\\[\]])', '\\\1', 'g') ELSE regexp_replace(text, '([\\\[\]])', '\\\1', 'g') END AS s FROM conversations) SELECT conv_id, string_agg(s, chr(10) || chr(10) ORDER BY turn) AS markdown FROM e GROUP BY conv_id")
def k4(t):
    s = F.regexp_replace("text", r"([\\\[\]])", r"\\$1")
    d = t.conversations.withColumn("s", F.when(C("role") == "user", F.concat(F.lit("### "), s)).otherwise(s))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "s"))), lambda e: e.s), "\n\n")
    return d.groupBy("conv_id").agg(joined.alias("markdown"))


# Sequences


@query(
    "w1_paragraphs",
    f"WITH {PAGE_LINES}, m AS (SELECT *, min(x0) OVER (PARTITION BY doc_id) AS l, lag(line) OVER w AS before, lag(heading) OVER w AS after_heading, lag(y1) OVER w AS top FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)), "
    "f AS (SELECT *, CASE WHEN before IS NULL OR heading OR after_heading OR y0 - top > 16 OR (x0 - l > 9 AND (regexp_matches(before, '[.!?][\"''\\x{2019})\\]]?\\s*$') OR before = '')) OR (regexp_matches(before, '[0-9]{1,3}\\s*$') AND regexp_matches(line, '^\\s*[\\x02\\x04\\x06]?[A-Z(\\x{2018}\\x{2019}'']')) THEN 1 ELSE 0 END AS s FROM m) "
    "SELECT doc_id, line_no, CAST(sum(s) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS paragraph FROM f",
)
def w1(t):
    d = t.placed.select("doc_id", "line_no", "x0", "y0", "y1", C("line").alias("text"), "heading")
    return lines.paragraph_starts(d, ["doc_id"], ["line_no"]).select("doc_id", long(C("line_no")).alias("line_no"), "paragraph")


@query(
    "w4_mojibake_zones",
    f"WITH {BOXES_SQL}, b AS (SELECT *, CAST(conf AS INTEGER) % 13 AS bad, pick AS good FROM boxes WHERE pick != 7), m AS (SELECT *, bad > good AND bad > 1 AS m FROM b), l AS (SELECT *, lag(m) OVER (PARTITION BY pno ORDER BY seq) AS pm FROM m), "
    "r AS (SELECT *, sum(CASE WHEN NOT m OR NOT coalesce(pm, false) THEN 1 ELSE 0 END) OVER (PARTITION BY pno ORDER BY seq) AS run FROM l), z AS (SELECT pno, run, arg_min(y0, seq) AS z0, max(y1) AS z1 FROM r WHERE m GROUP BY pno, run), "
    "y AS (SELECT *, CASE WHEN z0 - lag(z1) OVER (PARTITION BY pno ORDER BY run) < 6 THEN 0 ELSE 1 END AS s FROM z), g AS (SELECT *, sum(s) OVER (PARTITION BY pno ORDER BY run) AS zone FROM y) SELECT pno, CAST(zone AS BIGINT) AS zone, arg_min(z0, run) AS z0, arg_max(z1, run) AS z1 FROM g GROUP BY pno, zone",
)
def w4(t):
    d = t.boxes.select("pno", "seq", "y0", "y1", (C("conf").cast("int") % 13).alias("bad"), C("pick").alias("good"), F.when(C("pick") == 7, 0).otherwise(1).alias("n_spans"))
    return lines.mojibake_zones(d, ["pno"], ["seq"])


@query("w7_last_kept")
def w7(t):
    """A fold whose every step depends on the last one kept: beyond SQL; tests compare with a loop."""
    return lines.last_kept(t.boxes.select("pno", C("y0").alias("y")), ["pno"]).select("pno", F.array_join(C("ys").cast("array<string>"), ",").alias("ys"))


@query(
    "w14_notes",
    f"WITH {LINES_SQL}, k AS (SELECT *, CAST(length(line) % 5 * 2 AS DOUBLE) AS x0, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS i, regexp_matches(line, '^([0-9]{{1,3}}|[*])\\s+(.*)$') AS m FROM lines WHERE line != ''), "
    "f AS (SELECT *, CASE WHEN i = 1 OR (m AND x0 <= first_value(x0) OVER (PARTITION BY doc_id ORDER BY line_no) + 4) THEN 1 ELSE 0 END AS s FROM k), g AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY line_no) AS note FROM f) "
    "SELECT doc_id, CAST(note AS BIGINT) AS note, arg_min(CASE WHEN m THEN regexp_extract(line, '^([0-9]{1,3}|[*])\\s+(.*)$', 1) ELSE '•' END, line_no) AS number, trim(string_agg(CASE WHEN s = 1 AND m THEN regexp_extract(line, '^([0-9]{1,3}|[*])\\s+(.*)$', 2) ELSE line END, ' ' ORDER BY line_no)) AS text FROM g GROUP BY doc_id, note",
)
def w14(t):
    d = t.lines.select("doc_id", "line_no", (F.length("line") % 5 * 2).cast("double").alias("x0"), C("line_no").cast("double").alias("y0"), C("line").alias("text"))
    return lines.parse_notes(d, ["doc_id"], "line_no").drop("y")


@query(
    "w18_cost_cap",
    "WITH c AS (SELECT event_id, user_id, value, coalesce(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM events) SELECT event_id, CAST(spent AS BIGINT) AS spent FROM c WHERE spent < 50000",
)
def w18(t):
    w = W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, -1)
    cents = F.round(C("value") * 100).cast("long")
    return t.events.withColumn("spent", F.coalesce(F.sum(cents).over(w), F.lit(0))).where("spent < 50000").select("event_id", long(C("spent")).alias("spent"))


@query("l1_page_order", f"WITH {BOXES_SQL} SELECT pno, seq, CAST(row_number() OVER (PARTITION BY pno ORDER BY round_even(y0 / 2, 0), x0, seq) AS INTEGER) AS rank FROM boxes")
def l1(t):
    return lines.page_order(t.boxes, "pno").select("pno", "seq", "rank")
