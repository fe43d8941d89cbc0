"""Joins of boxes on a page: every join has the page as its key, the geometry as a residual condition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def meet(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length of the overlap of two intervals, 0 at least."""
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def prefixed(df: DataFrame, prefix: str, *keys: str) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(prefix + c) for c in df.columns if c not in keys])


def horizontal_coverage(items: DataFrame, words: DataFrame, *keys: str) -> DataFrame:
    """items with `coverage`: the share of each box's width that words cover at its height.

    items: keys, seq, x0, y0, x1, y1. words: keys and a box. Words whose height touches the item's are clipped to its width; the length
    of their union is a running maximum of right ends over sorted left ends. An item without such words has 0.
    """
    j = items.select(*keys, "seq", "x0", "y0", "x1", "y1").join(prefixed(words.select(*keys, "x0", "y0", "x1", "y1"), "w_", *keys), list(keys))
    j = j.where((F.col("w_y1") >= F.col("y0")) & (F.col("w_y0") <= F.col("y1")))
    j = j.withColumn("a", F.greatest("w_x0", "x0")).withColumn("b", F.least("w_x1", "x1")).where("b > a")
    order = W.partitionBy(*keys, "seq").orderBy("a", "b").rowsBetween(W.unboundedPreceding, -1)
    j = j.withColumn("top", F.coalesce(F.max("b").over(order), F.col("a")))
    part = j.groupBy(*keys, "seq").agg(F.sum(F.greatest(F.lit(0.0), F.col("b") - F.greatest("a", "top"))).alias("covered"))
    width = F.greatest(F.col("x1") - F.col("x0"), F.lit(1.0))
    return items.join(part, [*keys, "seq"], "left").withColumn("coverage", F.least(F.coalesce("covered", F.lit(0.0)) / width, F.lit(1.0))).drop("covered")


def best_refined(blocks: DataFrame, refined: DataFrame, *keys: str, least: float = 0.3) -> DataFrame:
    """blocks with the text of the refined block that covers most of each (the first on a tie, `least` of its area at least), and its
    confidence where that is positive; others stay as they are. refined: keys, seq, box, text, conf."""
    j = blocks.select(*keys, "seq", "x0", "y0", "x1", "y1").join(prefixed(refined, "r_", *keys), list(keys))
    area = F.greatest((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), F.lit(1e-6))
    inter = meet(F.col("x0"), F.col("x1"), F.col("r_x0"), F.col("r_x1")) * meet(F.col("y0"), F.col("y1"), F.col("r_y0"), F.col("r_y1"))
    j = j.withColumn("share", inter / area).where(F.col("share") >= least)
    best = j.groupBy(*keys, "seq").agg(F.max_by(F.struct("r_text", "r_conf"), F.struct("share", -F.col("r_seq"))).alias("m"))
    out = blocks.join(best, [*keys, "seq"], "left")
    return out.withColumn("text", F.coalesce("m.r_text", "text")).withColumn("conf", F.when(F.col("m.r_conf") > 0, F.col("m.r_conf")).otherwise(F.col("conf"))).drop("m")


def first_zone(lines: DataFrame, blocks: DataFrame, *keys: str) -> DataFrame:
    """lines with `zone`, the seq of the first script block that each lies in, or null.

    blocks: keys, seq, y0, y1, n (script characters); lines: keys, seq, y0, y1, garbled. Blocks of 4 characters and more reach 2 points further, 6 from a
    height of 22 on; smaller ones take only garbled lines whose center is within. A line lies in a block with its center or half its height.
    """
    j = lines.select(*keys, "seq", "y0", "y1", "garbled").join(prefixed(blocks.select(*keys, "seq", "y0", "y1", "n"), "b_", *keys), list(keys))
    pad = F.when(F.col("b_n") < 4, 0.0).when(F.col("b_y1") - F.col("b_y0") >= 22, 6.0).otherwise(2.0)
    j = j.withColumn("lo", F.col("b_y0") - pad).withColumn("hi", F.col("b_y1") + pad)
    center, height = (F.col("y0") + F.col("y1")) / 2, F.greatest(F.col("y1") - F.col("y0"), F.lit(1.0))
    tiny = (F.col("b_n") >= 4) | (center.between(F.col("lo") - 0.5, F.col("hi") + 0.5) & F.col("garbled"))
    inside = center.between(F.col("lo"), F.col("hi")) | (meet(F.col("y0"), F.col("y1"), F.col("lo"), F.col("hi")) >= height * 0.5)
    j = j.where((F.col("y1") >= F.col("lo")) & (F.col("y0") <= F.col("hi")) & tiny & inside)
    return lines.join(j.groupBy(*keys, "seq").agg(F.min("b_seq").alias("zone")), [*keys, "seq"], "left")


def without_overlays(candidates: DataFrame, lines: DataFrame, *keys: str, sure: float = 80.0) -> DataFrame:
    """candidates that no sure line (conf >= `sure`) covers by 0.6 of their height and 0.85 of their area."""
    strong = prefixed(lines.where(F.col("conf") >= sure).select(*keys, "x0", "y0", "x1", "y1"), "e_", *keys)
    v = meet(F.col("y0"), F.col("y1"), F.col("e_y0"), F.col("e_y1"))
    h = meet(F.col("x0"), F.col("x1"), F.col("e_x0"), F.col("e_x1"))
    height = F.greatest(F.col("y1") - F.col("y0"), F.lit(1e-6))
    area = F.greatest((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), F.lit(1e-6))
    c, e = candidates.alias("c"), strong.alias("e")
    same = [F.col(f"c.{k}") == F.col(f"e.{k}") for k in keys]
    cond = (v / height >= 0.6) & (v * h / area >= 0.85)
    for s in same:
        cond = cond & s
    return c.join(e, cond, "left_anti")


def line_format(lines: DataFrame, spans: DataFrame, *keys: str) -> DataFrame:
    """lines with italic and bold word sets and the median size of the spans that overlap 0.4 of each line's height.

    spans: keys, y0, y1, text, size, italic, bold. Words have two letters at least; sets are sorted arrays; no span gives empty sets and size 0.
    """
    j = lines.select(*keys, "seq", "y0", "y1").join(prefixed(spans.select(*keys, "y0", "y1", "text", "size", "italic", "bold"), "s_", *keys), list(keys))
    j = j.where(meet(F.col("y0"), F.col("y1"), F.col("s_y0"), F.col("s_y1")) >= (F.col("y1") - F.col("y0")) * 0.4)
    words = F.filter(F.regexp_extract_all(F.lower("s_text"), F.lit("[a-z]+(?:[-'][a-z]+)*"), F.lit(0)), lambda w: F.length(w) >= 2)
    empty = F.array().cast("array<string>")

    def of(flag: str) -> Column:
        return F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col(flag), words).otherwise(empty)))))

    agg = j.groupBy(*keys, "seq").agg(of("s_italic").alias("italic_words"), of("s_bold").alias("bold_words"), F.median("s_size").alias("size"))
    out = lines.join(agg, [*keys, "seq"], "left")
    return out.withColumns({"italic_words": F.coalesce("italic_words", empty), "bold_words": F.coalesce("bold_words", empty), "size": F.coalesce("size", F.lit(0.0))})


def prefer_secondary(primary: DataFrame, secondary: DataFrame, *keys: str, band: float = 2.5) -> DataFrame:
    """primary with the text of the first secondary line within `band` points that is Latin, has as many words and less noise."""
    from ..functions.text import RTL, count

    j = primary.select(*keys, "seq", "y0", "text").join(prefixed(secondary.select(*keys, "seq", "y0", "text"), "s_", *keys), list(keys))
    a, b = F.col("text"), F.col("s_text")
    j = j.where((F.abs(F.col("s_y0") - F.col("y0")) <= band) & ~a.rlike(RTL) & ~b.rlike(RTL) & b.rlike("[A-Za-z]"))
    j = j.where((count(b, "[A-Za-z]+") >= count(a, "[A-Za-z]+")) & (count(b, "[^A-Za-z0-9 ]") < count(a, "[^A-Za-z0-9 ]")))
    best = j.groupBy(*keys, "seq").agg(F.min_by("s_text", F.struct("s_y0", "s_seq")).alias("better"))
    return primary.join(best, [*keys, "seq"], "left").withColumn("text", F.coalesce("better", "text")).drop("better")


def contained_italics(notes: DataFrame, spans: DataFrame, *keys: str) -> DataFrame:
    """(keys, note, words): the words of italic spans that lie within a note's height, 2 points beyond at either end."""
    j = notes.select(*keys, "note", "y0", "y1").join(prefixed(spans.where("italic").select(*keys, "y0", "y1", "text"), "s_", *keys), list(keys))
    j = j.where((F.col("s_y0") >= F.col("y0") - 2) & (F.col("s_y1") <= F.col("y1") + 2))
    words = F.regexp_extract_all(F.lower("s_text"), F.lit("[a-z]+(?:[-'][a-z]+)*"), F.lit(0))
    return j.groupBy(*keys, "note").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(words)))).alias("words"))


def assign_once(notes: DataFrame, blocks: DataFrame, *keys: str) -> DataFrame:
    """(keys, block, note): each block goes to the first note whose height holds its center, 4 points above to 8 below."""
    j = notes.select(*keys, "note", "y0", "y1").join(prefixed(blocks.select(*keys, "seq", "y0", "y1"), "b_", *keys), list(keys))
    center = (F.col("b_y0") + F.col("b_y1")) / 2
    j = j.where(center.between(F.col("y0") - 4, F.col("y1") + 8))
    return j.groupBy(*keys, F.col("b_seq").alias("block")).agg(F.min("note").alias("note"))


def last_marker(lines: DataFrame, markers: DataFrame, *keys: str, slack: float = 4.0) -> DataFrame:
    """lines (keys, seq, center) with `bucket`: the number of the last marker (keys, y) at most `slack` below the center, from 1; 0 before the first.

    An as-of join without a join: both sides in one sort per page.
    """
    m = markers.select(*keys, F.col("y").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("seq"))
    n = lines.select(*keys, (F.col("center") + slack).alias("at"), F.lit(1).alias("kind"), F.col("seq").cast("long"))
    order = W.partitionBy(*keys).orderBy("at", "kind").rowsBetween(W.unboundedPreceding, 0)
    both = m.unionByName(n).withColumn("bucket", F.sum(1 - F.col("kind")).over(order))
    return lines.join(both.where("kind = 1").select(*keys, "seq", "bucket"), [*keys, "seq"])
