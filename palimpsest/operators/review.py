"""Quality control by a model's proposals, and the audit of what was rendered."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

C = F.col
LEVELS = ("low", "medium", "high")

# Page texts

ANCHOR = r'<span\b[^>]*epub:type="pagebreak"[^>]*>\s*(?:</span>)?'


def page_texts(rendered: DataFrame) -> DataFrame:
    """(book, chapter, i, anchor, text): the plain text after each page anchor of a chapter up to the next, note references as [^N]; pages without text go. rendered: book,
    chapter, xhtml."""
    cut = F.split(F.regexp_replace("xhtml", ANCHOR, "\ue000"), "\ue000")
    ids = F.transform(F.regexp_extract_all("xhtml", F.lit(ANCHOR), F.lit(0)), lambda a: F.regexp_extract(a, r'\bid="([^"]*)"', 1))
    pairs = F.transform(cut, lambda p, i: F.struct(F.get(C("ids"), i - 1).alias("anchor"), p.alias("part")))
    d = rendered.select("book", "chapter", "xhtml", ids.alias("ids")).select("book", "chapter", F.posexplode(pairs).alias("i", "p")).where("i > 0")
    d = d.select("book", "chapter", C("i").cast("int").alias("i"), "p.anchor", T.trim_page(T.html_text(T.note_refs(C("p.part")))).alias("text"))
    return d.where("text != ''")


# Model output


def parse_response(body: str | None) -> tuple[list[dict] | None, str | None]:
    """(corrections, error) of a model's answer: a JSON object, within a fence or not, whose corrections, if there are any, are a list."""
    text = (body or "").strip()
    if text.startswith("```"):
        text = re.sub(r"\s*```$", "", re.sub(r"^```[A-Za-z]*\s*", "", text)).strip()
    try:
        data = json.loads(text)
    except ValueError:
        return None, "not JSON"
    if not isinstance(data, dict):
        return None, "not an object"
    items = data.get("corrections")
    if items is None:
        return [], None
    if not isinstance(items, list):
        return None, "corrections are no list"
    out = []
    for x in items:
        if isinstance(x, dict) and all(isinstance(x.get(k), str) for k in ("find", "replace", "confidence")):
            reason = x.get("reason", "")
            out.append({k: x[k] for k in ("find", "replace", "confidence")} | {"reason": reason if isinstance(reason, str) else ""})
    return out, None


FOUND = "struct<items:array<struct<find:string,replace:string,confidence:string,reason:string>>,error:string>"


def _responses(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    item = pa.struct([(n, pa.string()) for n in ("find", "replace", "confidence", "reason")])
    kind = pa.struct([("items", pa.list_(item)), ("error", pa.string())])
    for b in batches:
        yield pa.array([dict(zip(("items", "error"), parse_response(x), strict=True)) for x in b.to_pylist()], kind)


_responses.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}


def parsed(body: Column) -> Column:
    """STRUCT<items, error> by parse_response."""
    return F.arrow_udf(_responses, FOUND)(body)


def acceptable(find: Column, replace: Column, confidence: Column, page: Column, least: str = "medium") -> Column:
    """Whether a proposal may be applied: certain enough, of 3 to 300 characters that the page has, something else put in place of them, of up to 600 characters on one
    line without a tag."""
    tag, nul = r"</?[A-Za-z][^>]*>", "\x00"
    ok = confidence.isin(*LEVELS[LEVELS.index(least) :]) & (replace != "") & (find != replace) & F.length(find).between(3, 300) & (F.length(replace) <= 600)
    ok = ok & F.contains(page, find) & ~replace.rlike(tag)
    return F.coalesce(ok & ~F.exists(F.array(find, replace), lambda s: F.contains(s, F.lit(nul)) | F.contains(s, F.lit("\n"))), F.lit(False))


def corrections(answers: DataFrame, least: str = "medium") -> DataFrame:
    """(book, pno, i, find, replace, confidence, reason): the acceptable proposals of answers (book, pno, body, text), each pair of find and replace of a page once, the
    first; reasons are cut to 160 characters. Answers that can't be read have none."""
    d = answers.select("book", "pno", "text", parsed(C("body")).alias("p")).select("book", "pno", "text", F.posexplode("p.items").alias("i", "c"))
    d = d.where(acceptable(C("c.find"), C("c.replace"), C("c.confidence"), C("text"), least))
    g = d.groupBy("book", "pno", "c.find", "c.replace").agg(F.min(F.struct("i", "c.confidence", "c.reason")).alias("m"))
    return g.select("book", "pno", "m.i", "find", "replace", "m.confidence", F.substring("m.reason", 1, 160).alias("reason"))


def select_pages(available: DataFrame, spec: str | None, column: str = "pno") -> DataFrame:
    """Rows of available whose page is in spec: 'all', '*' or nothing, or a list like '3,8-5'. ValueError for anything else."""
    s = (spec or "").strip().lower()
    if s in ("", "all", "*"):
        return available
    ranges = []
    for part in s.split(","):
        m = re.fullmatch(r"\s*(\d+)\s*(?:-\s*(\d+)\s*)?", part)
        if not m:
            raise ValueError(f"bad page spec: {part!r}")
        a, b = int(m[1]), int(m[2] or m[1])
        ranges.append((min(a, b), max(a, b)))
    ok = F.lit(False)
    for a, b in ranges:
        ok = ok | C(column).between(a, b)
    return available.where(ok)


def merged_fixes(proposed: DataFrame, human: DataFrame) -> DataFrame:
    """(find, replace) for the automatic part of a fix list: the last proposal (by pno, i) for each text that no human rule is for."""
    last = proposed.groupBy("find").agg(F.max_by("replace", F.struct("pno", "i")).alias("replace"))
    return last.join(human.select("find").distinct(), "find", "left_anti")


def costs(pages: DataFrame, per_input: float, per_output: float, image_bytes: Column | None = None, answer_tokens: int = 200) -> DataFrame:
    """pages (book, pno, text) with input_tokens, output_tokens and usd as estimated before any call: a third of the characters (64 at least) and the image by its size."""
    size = F.lit(150_000) if image_bytes is None else image_bytes
    image = F.when(size < 50_000, 600).when(size < 250_000, 1500).otherwise(3000)
    tokens = F.greatest(F.lit(64), F.floor(F.length("text") / 3)) + image
    usd = tokens / 1e6 * per_input + F.lit(answer_tokens) / 1e6 * per_output
    return pages.withColumns({"input_tokens": tokens.cast("long"), "output_tokens": F.lit(answer_tokens).cast("long"), "usd": usd})


def unanswered(pages: DataFrame, cache: DataFrame) -> DataFrame:
    """Pages whose (model, image hash, text hash) no cached answer has."""
    return pages.join(cache.select("model", "image_sha", "text_sha").distinct(), ["model", "image_sha", "text_sha"], "left_anti")


# Audit


def ids_and_links(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files (file, xhtml): (file, id), distinct, and (file, i, target, fragment): links with a fragment; target '' is the file itself."""
    ids = files.select("file", F.explode(F.array_distinct(F.regexp_extract_all("xhtml", F.lit(r'<[^>]*?\bid="([^"]+)"'), F.lit(1)))).alias("id"))
    links = files.select("file", F.posexplode(F.regexp_extract_all("xhtml", F.lit(r'<[^>]*?\bhref="([^"]*#[^"]*)"'), F.lit(1))).alias("i", "href"))
    cut = F.instr("href", "#")
    return ids, links.select("file", "i", F.substr("href", F.lit(1), cut - 1).alias("target"), F.substr("href", cut + 1).alias("fragment"))


def link_findings(files: DataFrame) -> DataFrame:
    """(file, i, kind, excerpt): links to a fragment that isn't there, or to a file that isn't. A target is taken beside the file that links to it, or without its
    first folder, or else as the end of the first file's name that fits."""
    ids, links = ids_and_links(files)
    names = files.select(C("file").alias("there")).distinct()
    inner = links.where("target = ''")
    known = ids.select("file", C("id").alias("fragment"))
    own = inner.join(known, ["file", "fragment"], "left_anti").select("file", "i", F.lit("unresolved internal link").alias("kind"), F.concat(F.lit("#"), "fragment").alias("excerpt"))
    outer = links.where("target != ''").withColumn("path", F.concat(F.regexp_extract("file", "^(.*/)?[^/]*$", 1), "target"))
    short = F.regexp_replace("there", "^[^/]*/", "")
    tail = F.regexp_extract("target", "([^/]*)$", 1)
    by_tail = names.withColumn("tail", F.regexp_extract("there", "([^/]*)$", 1))
    j = outer.withColumn("tail", tail).join(by_tail, "tail", "left")
    j = j.withColumn("rank", F.when(C("path") == C("there"), 0).when(C("path") == short, 1).when(C("there").endswith(C("target")), 2))
    best = j.groupBy("file", "i", "target", "fragment", "path").agg(F.min(F.when(C("rank").isNotNull(), F.struct("rank", "there"))).alias("b"))
    # A target that fits without its first folder names no file itself, so its fragments are never found.
    best = best.withColumn("at", F.when(C("b.rank") == 1, C("path")).otherwise(C("b.there")))
    excerpt = F.concat("target", F.lit("#"), "fragment")
    missing = best.where("b is null").select("file", "i", F.lit("missing linked file").alias("kind"), excerpt.alias("excerpt"))
    broken = best.where("b is not null").join(known.select(C("file").alias("at"), "fragment"), ["at", "fragment"], "left_anti")
    return own.unionByName(missing).unionByName(broken.select("file", "i", F.lit("missing fragment").alias("kind"), excerpt.alias("excerpt")))


SUSPECTS = (
    ("question/exclamation-shaped footnote marker", r"\b[A-Za-z][A-Za-z-]*(?:\)?(?:\.{1,3}|[!,:;])[!?](?:$|\s)|\?(?=\s+[a-z]))"),
    ("common OCR typo", r"(?i)\b(?:bur|che|chis|dury)\b"),
    ("transliteration OCR variant", r"(?i)\b(?:ibram|mi(?:gar|gas|gat)|mubrim|tagsir)\b"),
    ("inline script read as Latin", r"\b(?:f'es|jes|jo|jé|ug)\b"),
    ("quote-shaped footnote marker", r"\b[A-Za-z][A-Za-z-]*[,:;]?['’]\s+[A-Z]"),
)


def suspicious(texts: DataFrame, key: str = "file", most: int | None = 80) -> DataFrame:
    """(key, kind, n, match): what looks like misreadings, in the order of texts, of kinds and of places; the report has the first `most`."""
    flat = F.regexp_replace("text", r"\s+", " ")
    d = texts.select(key, F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(name).alias("kind"), F.regexp_extract_all(flat, F.lit(p), F.lit(0)).alias("m")) for k, (name, p) in enumerate(SUSPECTS)])).alias("s"))
    d = d.select(key, "s.k", "s.kind", F.posexplode("s.m").alias("n", "match"))
    if most is not None:
        d = d.orderBy(key, "k", "n").limit(most)
    return d.select(key, "kind", "n", "match")


def package_problems(names: DataFrame, manifest: DataFrame, spine: DataFrame) -> DataFrame:
    """(book, problem): manifest entries (book, id, href) whose file the archive (book, name) lacks, and spine entries (book, idref) that the manifest lacks."""
    path = F.when(C("href").startswith("OEBPS/"), C("href")).otherwise(F.concat(F.lit("OEBPS/"), "href"))
    a = manifest.withColumn("name", path).join(names, ["book", "name"], "left_anti").select("book", F.concat(F.lit("manifest href '"), "href", F.lit("' has no file in zip")).alias("problem"))
    b = spine.join(manifest.select("book", C("id").alias("idref")), ["book", "idref"], "left_anti")
    return a.unionByName(b.select("book", F.concat(F.lit("spine itemref '"), "idref", F.lit("' has no manifest item")).alias("problem")))


def script_total(blocks: DataFrame, key: str = "book") -> DataFrame:
    """(key, chars): right-to-left characters of the blocks that have four or more."""
    n = T.rtl_chars(C("text"))
    return blocks.groupBy(key).agg(F.sum(F.when(n >= 4, n).otherwise(0)).alias("chars"))


def page_errors(pages: DataFrame) -> DataFrame:
    """(book, pno, error) of pages whose recognition failed."""
    return pages.where("error is not null and error != ''").select("book", "pno", "error")


def coverage(found: Column, real: Column) -> Column:
    """Percent of what is there that was found; 0 where nothing is."""
    return F.when(real > 0, 100.0 * found / real).otherwise(0.0)


# Runs again


def to_run(pages: DataFrame, cached: DataFrame, mode: str = "default") -> DataFrame:
    """The pages (book, pno) that an engine has to read: those without a cached one; with mode 'retry' also those whose cached one failed, with 'force' all. By default failed pages
    raise a ValueError, since a half-read book would go on."""
    if mode == "force":
        return pages
    failed = page_errors(cached).select("book", "pno")
    if mode == "retry":
        return pages.join(cached.join(failed, ["book", "pno"], "left_anti").select("book", "pno"), ["book", "pno"], "left_anti")
    if mode != "default":
        raise ValueError(f"unknown mode {mode!r}")
    if first := failed.head(1):
        raise ValueError(f"page {first[0]['pno']} of {first[0]['book']} failed before; run with mode 'retry' or 'force'")
    return pages.join(cached.select("book", "pno"), ["book", "pno"], "left_anti")


def merged_pages(old: DataFrame, new: DataFrame) -> DataFrame:
    """The pages of new, and those of old that new lacks."""
    return new.unionByName(old.join(new.select("book", "pno"), ["book", "pno"], "left_anti"))


def within_cap(pages: DataFrame, cap: float, key: str = "book", order: str = "pno") -> DataFrame:
    """Pages in order until their summed usd reaches cap; no cap where it is 0."""
    if cap <= 0:
        return pages
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return pages.withColumn("_spent", F.coalesce(F.sum("usd").over(w), F.lit(0.0))).where(C("_spent") < cap).drop("_spent")


def scorecard(a: DataFrame, b: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, a, b, delta) of two runs' sums."""
    total = lambda d: d.agg(*[F.sum(m).cast("double").alias(m) for m in metrics])
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), C(m).alias("v")) for m in metrics])).alias("x")
    x, y = total(a).select(pairs).select("x.metric", C("x.v").alias("a")), total(b).select(pairs).select("x.metric", C("x.v").alias("b"))
    return x.join(y, "metric").withColumn("delta", C("b") - C("a"))
