"""What a book brings along: manifest, configuration, rules, vocabularies, canonical texts and overrides. Small files are read by the driver and become tables."""

from __future__ import annotations

import json
import tomllib
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

C = F.col
FEATURES = ("imprint-fix",)
BOOK = "book string, title string, author string, language string, source string, engine string, ocr_languages array<string>, plugins array<string>, plugin_settings map<string,string>, formats array<string>, cover_page int, heuristics array<string>, extra string"
QC = "enabled boolean, engine string, dpi int, concurrency int, max_cost_usd double, retry int, min_confidence string, pages string, preserve_human boolean"


def _toml(path: Path) -> dict[str, Any]:
    return tomllib.loads(path.read_text("utf-8"))


def inside(root: Path, name: str) -> Path:
    """The file `name` under root; ValueError if it would lie outside."""
    path = (root / name).resolve()
    if not path.is_relative_to(root.resolve()):
        raise ValueError(f"{name!r} is outside {root}")
    return path


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(ord, path, extra JSON): the [[book]] entries of a batch manifest. ValueError where there are none or one lacks its path."""
    books = _toml(Path(path)).get("book")
    if not isinstance(books, list) or not books:
        raise ValueError(f"{path} names no [[book]]")
    for b in books:
        if not isinstance(b.get("path"), str) or not b["path"]:
            raise ValueError(f"{path}: a [[book]] has no path")
    rows = [(i, b["path"], json.dumps({k: v for k, v in b.items() if k != "path"}, default=str)) for i, b in enumerate(books)]
    return spark.createDataFrame(rows, "ord int, path string, extra string")


def check_config(slug: str, config: dict[str, Any]) -> tuple:
    """A row of BOOK from a book's settings. ValueError for a missing title or an unknown format, feature or level."""
    from ..sinks.export import normalize_formats

    if not config.get("title"):
        raise ValueError(f"{slug}: no title")
    unknown = [h for h in config.get("heuristics", []) if h not in FEATURES]
    if unknown:
        raise ValueError(f"{slug}: unknown heuristics {unknown}")
    known = {"title", "author", "language", "source", "engine", "ocr_languages", "plugins", "plugin", "formats", "cover_page", "heuristics", "qc", "headings"}
    return (
        slug, config["title"], config.get("author", ""), config.get("language", "en"), config.get("source"), config.get("engine", "text"),
        list(config.get("ocr_languages", [])), list(config.get("plugins", [])), {k: json.dumps(v) for k, v in config.get("plugin", {}).items()},
        normalize_formats(config.get("formats")), config.get("cover_page"), list(config.get("heuristics", [])), json.dumps({k: v for k, v in config.items() if k not in known}, default=str),
    )


def read_books(spark: SparkSession, folders: list[str]) -> DataFrame:
    """A row of BOOK for each folder with a book.toml; the folder's name is the book."""
    return spark.createDataFrame([check_config(Path(f).name, _toml(Path(f) / "book.toml")) for f in folders], BOOK)


def qc_settings(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(book, QC): quality settings with their defaults. ValueError for a level of confidence other than low, medium and high, or a negative cap."""
    rows = []
    for f in folders:
        q = _toml(Path(f) / "book.toml").get("qc", {})
        level, cap = q.get("min_confidence", "medium"), float(q.get("max_cost_usd", 0.0))
        if level not in ("low", "medium", "high") or cap < 0:
            raise ValueError(f"{f}: bad qc settings")
        rows.append((Path(f).name, bool(q.get("enabled", False)), q.get("engine", "stub"), int(q.get("dpi", 150)), int(q.get("concurrency", 4)), cap, int(q.get("retry", 3)), level, q.get("pages", "all"), bool(q.get("preserve_human", True))))
    return spark.createDataFrame(rows, f"book string, {QC}")


def headings(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(book, ord, title, level, norm): the headings that books name in headings.json as [title, level] pairs. Only data is read; code is not run."""
    rows = []
    for f in folders:
        path = inside(Path(f), "headings.json")
        if path.exists():
            rows += [(Path(f).name, i, str(t), int(n)) for i, (t, n) in enumerate(json.loads(path.read_text("utf-8")))]
    d = spark.createDataFrame(rows, "book string, ord int, title string, level int")
    return d.withColumn("norm", F.lower(T.normalize_heading(C("title"))))


def fix_rules(spark: SparkSession, files: list[str]) -> DataFrame:
    """(scope, rule_kind, ord, find, repl) of rule files [phrase] and [word], scope being the place in `files`, widest first; missing files are skipped."""
    rows = []
    for scope, f in enumerate(files):
        if Path(f).exists():
            data = _toml(Path(f))
            for kind in ("phrase", "word"):
                rows += [(scope, kind, i, k, v) for i, (k, v) in enumerate(data.get(kind, {}).items()) if isinstance(v, str)]
    return spark.createDataFrame(rows, "scope int, rule_kind string, ord int, find string, repl string")


def phrase_fixes(path: str) -> list[tuple[str, str]]:
    """The [phrase] rules of a fix list, also those that change nothing; none where the file is missing or can't be read."""
    try:
        phrases = _toml(Path(path)).get("phrase", {})
    except (OSError, ValueError):
        return []
    return [(k, v) for k, v in phrases.items() if k and isinstance(v, str)] if isinstance(phrases, dict) else []


def vocabulary(spark: SparkSession, path: str, curated: dict[str, str] | None = None) -> DataFrame:
    """(norm, canonical) of a JSON object of strings (a file or a folder of files); curated entries win, then later files."""
    d = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("k", "canonical"), F.input_file_name().alias("f"))
    d = d.where("canonical is not null").select(T.normalize_translit(C("k")).alias("norm"), "canonical", F.struct(F.lit(0).alias("p"), "f", "k").alias("r"))
    if curated:
        own = spark.createDataFrame(list(curated.items()), "k string, canonical string")
        d = d.unionByName(own.select(T.normalize_translit(C("k")).alias("norm"), "canonical", F.struct(F.lit(1).alias("p"), F.lit("").alias("f"), "k").alias("r")))
    return d.where("norm != ''").groupBy("norm").agg(F.max_by("canonical", "r").alias("canonical"))


def verse_lines(lines: DataFrame, order: list[str], column: str = "value") -> DataFrame:
    """(s, a, text) of lines 's|a|text'; blank lines, comments and lines whose numbers are none are skipped, and of lines for one verse the last counts."""
    part = F.split(F.trim(column), r"\|", 3)
    d = lines.where((F.trim(column) != "") & ~F.trim(column).startswith("#") & (F.size(part) == 3))
    d = d.select(*order, F.trim(F.get(part, F.lit(0))).try_cast("int").alias("s"), F.trim(F.get(part, F.lit(1))).try_cast("int").alias("a"), F.trim(F.get(part, F.lit(2))).alias("text"))
    return d.where("s is not null and a is not null").groupBy("s", "a").agg(F.max_by("text", F.struct(*order)).alias("text"))


def verses(spark: SparkSession, path: str) -> DataFrame:
    """verse_lines of a text file."""
    d = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    return verse_lines(d, ["at"])


def overrides(spark: SparkSession, folder: str) -> DataFrame:
    """(slug, xhtml) of the files slug.xhtml of a folder."""
    d = spark.read.text(f"{folder.rstrip('/')}/*.xhtml", wholetext=True)
    return d.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.xhtml$", 1).alias("slug"), C("value").alias("xhtml"))


def apply_overrides(rendered: DataFrame, over: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rendered (book, chapter, slug, xhtml) with the xhtml of over (book, slug, xhtml) where there is one, and the overrides of no chapter."""
    o = over.select("book", "slug", C("xhtml").alias("_o"))
    new = rendered.join(o, ["book", "slug"], "left").withColumns({"xhtml": F.coalesce("_o", "xhtml"), "replaced": C("_o").isNotNull()}).drop("_o")
    return new, over.join(rendered.select("book", "slug"), ["book", "slug"], "left_anti")


def archives(spark: SparkSession, path: str) -> DataFrame:
    """(book, epub BINARY) of archive files; the file's name is the book."""
    d = spark.read.format("binaryFile").load(path)
    return d.select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("book"), C("content").alias("epub"))


def scaled_box(x: Column, y: Column, w: Column, h: Column, page_w: Column, page_h: Column) -> Column:
    """A recogniser's box (fractions from the lower left) as a box in points from the upper left."""
    return F.struct((x * page_w).alias("x0"), ((1 - y - h) * page_h).alias("y0"), ((x + w) * page_w).alias("x1"), ((1 - y) * page_h).alias("y1"))


def padded_region(x0: Column, y0: Column, x1: Column, y1: Column, page_w: Column, page_h: Column, pad: float = 8.0) -> Column:
    """A region to be read again: the box with `pad` points around it, within the page."""
    zero = F.lit(0.0)
    return F.struct(F.greatest(zero, x0 - pad).alias("x0"), F.greatest(zero, y0 - pad).alias("y0"), F.least(page_w, x1 + pad).alias("x1"), F.least(page_h, y1 + pad).alias("y1"))


def from_region(x: Column, y: Column, region: Column, scale: Column) -> Column:
    """A point of a region's image, in pixels, on the page."""
    return F.struct((region.x0 + x / scale).alias("x"), (region.y0 + y / scale).alias("y"))
