"""Words to lines, lines to blocks, paragraphs, zones and notes: groupings of ordered rows by windows and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import conf_percent, fold_apostrophes


def running(keys: list[str], *order: str | Column):
    return W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)


def islands(df: DataFrame, starts: Column, keys: list[str], order: list, name: str = "group") -> DataFrame:
    """df with `name`: how many rows that start a group there are up to each row."""
    return df.withColumn("_start", F.coalesce(starts, F.lit(True)).cast("int")).withColumn(name, F.sum("_start").over(running(keys, *order))).drop("_start")


def page_order(spans: DataFrame, *keys: str) -> DataFrame:
    """Lines in reading order: `rank` by rounded half height (half to even), then left edge, then seq."""
    return spans.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.bround(F.col("y0") / 2), "x0", "seq")))


def words_to_lines(words: DataFrame, line: list[str], order: str, scale: float = 1.0) -> DataFrame:
    """One row for each line (`line`: its key columns): its words in order joined by spaces, its box divided by scale, the mean confidence.
    Blank words and those of negative or unreadable confidence are left out."""
    c = F.coalesce(F.col("conf").try_cast("double"), F.lit(-1.0))
    w = words.where((F.trim("text") != "") & (c >= 0)).withColumn("conf", c)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.trim("text").alias("t")))), lambda s: s.t), " ")
    return w.groupBy(*line).agg(
        text.alias("text"),
        (F.min("left") / scale).alias("x0"),
        (F.min("top") / scale).alias("y0"),
        (F.max(F.col("left") + F.col("width")) / scale).alias("x1"),
        (F.max(F.col("top") + F.col("height")) / scale).alias("y1"),
        F.avg("conf").alias("conf"),
    )


def lines_to_blocks(lines: DataFrame, keys: list[str], order: list, default: float = 14.0, factor: float = 1.5) -> DataFrame:
    """Blocks of lines whose gap to the line before is at most factor times the median line height of the page (default without any).
    Columns: keys, block (from 1), n_lines, box, text (lines joined by line ends), conf (mean of those >= 0, else -1)."""
    heights = lines.where("y1 > y0").groupBy(*keys).agg(F.median(F.col("y1") - F.col("y0")).alias("_h"))
    d = lines.join(heights, keys, "left").withColumn("_h", F.coalesce("_h", F.lit(default)))
    gap = F.col("y0") - F.lag("y1").over(W.partitionBy(*keys).orderBy(*order))
    d = islands(d.withColumn("_gap", gap), F.col("_gap") > F.col("_h") * factor, keys, order, "block")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "text"))), lambda s: s.text), "\n")
    return d.groupBy(*keys, "block").agg(
        F.count(F.lit(1)).alias("n_lines"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        text.alias("text"), F.coalesce(F.avg(F.when(F.col("conf") >= 0, F.col("conf"))), F.lit(-1.0)).alias("conf"),
    )


ENDS = r"[.!?][\"'\x{2019})\]]?\s*$"
OPENS = r"^\s*[\x02\x04\x06]?[A-Z(\x{2018}\x{2019}']"


def paragraph_starts(d: DataFrame, keys: list[str], order: list, indent: float = 9.0, gap: float = 1.6) -> DataFrame:
    """Text-layer lines with `paragraph`: a new one at the page's first line, a heading, after a heading, after a gap over 1.6 median heights,
    at an indent after a sentence's end, and at a capital after a closing number. Lines: x0, y0, y1, text, heading."""
    heights = d.groupBy(*keys).agg(F.median(F.when(F.col("y1") > F.col("y0"), F.col("y1") - F.col("y0"))).alias("_h"), F.min("x0").alias("_left"))
    d = d.join(heights, keys).withColumn("_h", F.coalesce("_h", F.lit(14.0)))
    w = W.partitionBy(*keys).orderBy(*order)
    before, ended = F.lag("text").over(w), F.coalesce(F.lag(F.col("text").rlike(ENDS) | (F.col("text") == "")).over(w), F.lit(True))
    number = F.coalesce(F.lag(F.col("text").rlike(r"[0-9]{1,3}\s*$")).over(w), F.lit(False))
    start = (
        before.isNull() | F.col("heading") | F.lag("heading").over(w)
        | (F.col("y0") - F.lag("y1").over(w) > F.col("_h") * gap)
        | ((F.col("x0") - F.col("_left") > indent) & ended) | (number & F.col("text").rlike(OPENS))
    )
    return islands(d.withColumn("_s", start), F.col("_s"), keys, order, "paragraph").drop("_s", "_h", "_left")


def recognised_paragraph_starts(d: DataFrame, keys: list[str], order: list, left: Column, right: Column) -> DataFrame:
    """Recognised lines with `paragraph`: as paragraph_starts, and at signature lines and after them, and after a short last line that ends a
    sentence before a capital. Lines: x0, x1, y0, y1, text, heading; left and right bound the body. Blank lines go."""
    d = d.withColumn("text", fold_apostrophes(F.col("text"))).where(F.trim("text") != "")
    heights = d.groupBy(*keys).agg(F.median(F.when(F.col("y1") > F.col("y0"), F.col("y1") - F.col("y0"))).alias("_h"))
    d = d.join(heights, keys).withColumn("_h", F.coalesce("_h", F.lit(14.0)))
    w = W.partitionBy(*keys).orderBy(*order)
    t = F.trim("text")
    signed = t.rlike(r"\bPresident of\b") | t.rlike(r"^[A-Z][A-Za-z]+ [0-9]{4}$") | t.rlike(r"^[A-Z][A-Za-z]+,\s+[A-Z][A-Za-z]+$")
    middle = (F.col("x0") > left + F.col("_h") * 2) & (right - F.col("x1") > F.col("_h") * 2)
    d = d.withColumn("signature", middle & ~F.col("heading") & (F.length("text") <= 90) & signed)
    ended = F.coalesce(F.lag(F.col("text").rlike(r"[.!?][\"')\]]?\s*$")).over(w), F.lit(True))
    number = F.coalesce(F.lag(F.col("text").rlike(r"[0-9]{1,3}\s*$")).over(w), F.lit(False))
    capital = F.col("text").rlike(r"^\s*[A-Z(']")
    short = F.lag("x1").over(w) <= right - F.greatest(right - left, F.lit(1.0)) * 0.2
    start = (
        F.lag("y1").over(w).isNull() | F.col("heading") | F.lag("heading").over(w) | F.col("signature") | F.lag("signature").over(w)
        | (F.col("y0") - F.lag("y1").over(w) > F.col("_h") * 1.6) | ((F.col("x0") - left > F.col("_h") * 0.6) & ended)
        | (number & capital) | (short & ended & capital)
    )
    return islands(d.withColumn("_s", start), F.col("_s"), keys, order, "paragraph").drop("_s", "_h")


def paragraphs(lines: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each paragraph of lines that have `paragraph`: its text joined by spaces, its extent, mean confidence of lines that have one."""
    c = conf_percent(F.col("conf"), zero_too=True)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "text"))), lambda s: s.text), " ")
    return lines.groupBy(*keys, "paragraph").agg(
        F.count(F.lit(1)).alias("n_lines"), F.trim(text).alias("text"), F.min("y0").alias("y0"), F.max("y1").alias("y1"),
        F.coalesce(F.avg(F.when(c >= 0, c)), F.lit(-1.0)).alias("conf"), F.bool_or("heading").alias("heading"),
    )


def mojibake_zones(lines: DataFrame, keys: list[str], order: list, close: float = 6.0) -> DataFrame:
    """(keys, zone, z0, z1): runs of lines with more garbled characters than good ones (two at least), merged where the next begins within
    `close` points of the last's end. Lines without spans (n_spans = 0) neither belong nor interrupt; a merged zone ends with its last part.
    Lines: y0, y1, bad, good, n_spans."""
    d = lines.where("n_spans > 0").withColumn("_m", (F.col("bad") > F.col("good")) & (F.col("bad") > 1))
    w = W.partitionBy(*keys).orderBy(*order)
    d = islands(d.withColumn("_new", ~F.col("_m") | ~F.coalesce(F.lag("_m").over(w), F.lit(False))), F.col("_new"), keys, order, "_run")
    first = F.min_by("y0", F.struct(*order))
    z = d.where("_m").groupBy(*keys, "_run").agg(first.alias("z0"), F.max("y1").alias("z1"))
    near = F.col("z0") - F.lag("z1").over(W.partitionBy(*keys).orderBy("_run")) < close
    z = islands(z.withColumn("_far", ~near), F.col("_far"), keys, ["_run"], "zone")
    return z.groupBy(*keys, "zone").agg(F.min_by("z0", "_run").alias("z0"), F.max_by("z1", "_run").alias("z1"))


def body_size(lines: DataFrame, key: str, default: float = 11.2) -> DataFrame:
    """(key, body_size): median of the line sizes from 9 to 14 of lines without right-to-left script that are not garbled."""
    ok = F.col("size").between(9, 14) & ~F.col("rtl") & ~F.col("garbled")
    return lines.groupBy(key).agg(F.coalesce(F.median(F.when(ok, F.col("size"))), F.lit(default)).alias("body_size"))


def page_mode_size(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, mode_size): the commonest span size, to quarters, from 9.5 to 14 in the upper 0.7 of the page; the most frequent one of 11 or more if it has
    0.3 of the top's count. Ties go to the size seen first. Spans: seq, size, y0, height."""
    d = spans.where((F.col("y0") < F.col("height") * 0.7)).withColumn("q", F.bround(F.col("size") * 4) / 4).where(F.col("q").between(9.5, 14))
    c = d.groupBy(*keys, "q").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("at"))
    rank = F.struct("n", -F.col("at"))
    top = c.groupBy(*keys).agg(F.max_by("q", rank).alias("q1"), F.max("n").alias("n1"), F.max_by("q", F.when(F.col("q") >= 11, rank)).alias("q2"), F.max(F.when(F.col("q") >= 11, F.col("n"))).alias("n2"))
    return top.select(*keys, F.when(F.col("n2") >= F.col("n1") * 0.3, F.col("q2")).otherwise(F.col("q1")).alias("mode_size"))


def note_boundary(lines: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, boundary): where a page's notes begin: the first marker line in the lower 0.3, else the first small line in the lower half from which on
    the median size stays small. Lines: y0, height, body, size, marker."""
    tail = W.partitionBy(*keys).orderBy(order).rowsBetween(0, W.unboundedFollowing)
    d = lines.withColumn("_tail", F.array_sort(F.collect_list(F.when(F.col("size") > 0, F.col("size"))).over(tail)))
    n = F.size("_tail")
    d = d.withColumn("_tail", F.when(n > 0, (F.get("_tail", ((n - 1) / 2).cast("int")) + F.get("_tail", (n / 2).cast("int"))) / 2))
    mark = F.min(F.when((F.col("y0") >= F.col("height") * 0.7) & F.col("marker"), F.col(order)))
    limit = F.col("body") * 0.82
    small = (F.col("y0") >= F.col("height") * 0.5) & (F.col("size") > 0) & (F.col("size") < limit) & (F.col("_tail") < limit + 1.0)
    return d.groupBy(*keys).agg(F.coalesce(mark, F.min(F.when(small, F.col(order)))).alias("boundary"))


def rule_threshold(marks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, threshold) by the first two signals: the highest long horizontal rule in the lower 0.6, else 8 points above the highest tiny digit near the
    left edge in the lower 0.28 (0.4 of the height at least), else 1.1 heights. Marks: kind (rule, digit), x0, x1, y0, y1, size, body, width, height."""
    h = F.col("height")
    rule = (F.col("kind") == "rule") & (F.abs(F.col("y1") - F.col("y0")) < 1.5) & (F.abs(F.col("x1") - F.col("x0")) > 60) & (F.col("y0") > h * 0.4)
    digit = (F.col("kind") == "digit") & (F.col("y0") >= h * 0.72) & (F.col("x0") <= F.col("width") * 0.22) & (F.col("size") < F.col("body") * 0.8)
    low = F.greatest(F.max(h) * 0.4, F.min(F.when(digit, F.col("y0"))) - 8)
    tiny = F.when(F.min(F.when(digit, F.col("y0"))).isNotNull(), low)
    return marks.groupBy(*keys).agg(F.coalesce(F.min(F.when(rule, (F.col("y0") + F.col("y1")) / 2)), tiny, F.max(h) * 1.1).alias("threshold"))


NOTE_START = r"^([0-9]{1,3}|[*])\s+(.*)$"


def parse_notes(lines: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, note, number, text, y): notes of a page's note lines. One starts at a line with a leading number or star that is not indented over 4 points
    against the first line (the first start may be); lines before any go to a note numbered by a bullet. Lines: x0, y0, text."""
    w = W.partitionBy(*keys).orderBy(order)
    d = lines.where(F.col("text") != "").withColumn("_x", F.first("x0").over(w)).withColumn("_m", F.col("text").rlike(NOTE_START))
    flush = F.col("_m") & (F.col("x0") <= F.col("_x") + 4)
    d = d.withColumn("_first", F.row_number().over(w) == 1).withColumn("_s", F.col("_first") | flush)
    d = islands(d, F.col("_s"), keys, [order], "note")
    body = F.when(F.col("_s") & F.col("_m"), F.regexp_extract("text", NOTE_START, 2)).otherwise(F.col("text"))
    number = F.when(F.col("_m"), F.regexp_extract("text", NOTE_START, 1)).otherwise(F.lit("•"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, body.alias("t")))), lambda s: s.t), " ")
    return d.groupBy(*keys, "note").agg(F.min_by(number, order).alias("number"), F.trim(text).alias("text"), F.min_by("y0", order).alias("y"))


def same_baseline(lines: DataFrame, keys: list[str], tolerance: float = 4.0) -> DataFrame:
    """(keys, line, text, x0, y0, x1, y1): fragments of one baseline joined by two spaces from left to right. A fragment joins the first group
    whose mean center is within `tolerance`, in order of centers: a fold over each page's array."""
    item = F.struct(((F.col("y0") + F.col("y1")) / 2).alias("c"), "seq", "x0", "y0", "x1", "y1", "text")
    pages = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"))
    kind = "array<struct<s:double,n:int,ids:array<int>>>"

    def step(groups: Column, x: Column) -> Column:
        hit = F.array_position(F.transform(groups, lambda g: F.abs(g.s / g.n - x.c) <= tolerance), True).cast("int")
        def grown(g: Column, i: Column) -> Column:
            joined = F.struct((g.s + x.c).alias("s"), (g.n + 1).alias("n"), F.array_append(g.ids, x.seq.cast("int")).alias("ids"))
            return F.when(i == hit - 1, joined).otherwise(g)
        fresh = F.struct(x.c.cast("double").alias("s"), F.lit(1).alias("n"), F.array(x.seq.cast("int")).alias("ids"))
        return F.when(hit > 0, F.transform(groups, grown)).otherwise(F.array_append(groups, fresh))

    pages = pages.withColumn("groups", F.aggregate("items", F.array().cast(kind), step))
    g = pages.select(*keys, F.posexplode(F.transform("groups", lambda g: g.ids)).alias("line", "ids")).select(*keys, "line", F.explode("ids").alias("seq"))
    d = lines.join(g, [*keys, "seq"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "seq", "text"))), lambda s: s.text), "  ")
    return d.groupBy(*keys, "line").agg(text.alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def last_kept(points: DataFrame, keys: list[str], apart: float = 6.0) -> DataFrame:
    """(keys, ys): sorted points of each page without those within `apart` of the last one kept."""
    ys = F.array_sort(F.collect_list(F.col("y").cast("double")))
    keep = F.aggregate(ys, F.array().cast("array<double>"), lambda a, y: F.when((F.size(a) > 0) & (F.abs(y - F.element_at(a, -1)) <= apart), a).otherwise(F.array_append(a, y)))
    return points.groupBy(*keys).agg(keep.alias("ys"))
