"""Engines that read pages: a registry of functions from a table of pages to a table of what they say, with failures as rows."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import RTL_CODES

LINE = "struct<text:string,conf:double,x0:double,y0:double,x1:double,y1:double>"
READ = f"book string, pno int, width double, height double, en_lines array<{LINE}>, ar_lines array<{LINE}>, error string"
SPANS = "book string, pno int, block_type int, line_no int, span_no int, text string, font string, size double, flags int, x0 double, y0 double, x1 double, y1 double, lx0 double, ly0 double, lx1 double, ly1 double"
LOST_PAGE = (612.0, 792.0)
"""Width and height that a page gets which could not be opened."""


class Decoder(Protocol):
    """Reads one page: (book, pno, image bytes, languages) -> dict with width, height and lines (text, conf, x0, y0, x1, y1 in points, rtl)."""

    def __call__(self, book: str, pno: int, image: bytes, languages: list[str]) -> dict: ...


def passes(languages: list[str]) -> list[list[str]]:
    """The passes of a page: its left-to-right languages, then its right-to-left ones, empty ones left out."""
    rtl = [x for x in languages if x in RTL_CODES]
    return [p for p in ([x for x in languages if x not in RTL_CODES], rtl) if p]


def read_page(decode: Decoder, book: str, pno: int, image: bytes, languages: list[str], retries: int = 2, wait: float = 0.0) -> dict:
    """All passes of a page by a decoder that may fail: it is tried again, and a page that fails for good is a row with its error."""
    out = {"book": book, "pno": pno, "width": LOST_PAGE[0], "height": LOST_PAGE[1], "en_lines": [], "ar_lines": [], "error": None}
    for languages_ in passes(languages):
        for attempt in range(retries + 1):
            try:
                page = decode(book, pno, image, languages_)
                break
            except Exception as e:  # an engine may raise anything; it is kept as the page's error
                if attempt == retries:
                    return out | {"en_lines": [], "ar_lines": [], "error": f"{type(e).__name__}: {e}"}
                time.sleep(wait * 2**attempt)
        out |= {"width": float(page["width"]), "height": float(page["height"])}
        for x in page["lines"]:
            line = {k: x[k] for k in ("text", "conf", "x0", "y0", "x1", "y1")}
            out["ar_lines" if x.get("rtl") else "en_lines"].append(line)
    return out


def engine(decode: Decoder, retries: int = 2, wait: float = 0.0) -> Callable[[DataFrame], DataFrame]:
    """A function from pages (book, pno, image, languages) to READ, a row a page, whatever happens to it."""

    def run(pages: DataFrame) -> DataFrame:
        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = [read_page(decode, r.book, int(r.pno), r.image, list(r.languages), retries, wait) for r in b.itertuples()]
                yield pd.DataFrame(rows, columns=["book", "pno", "width", "height", "en_lines", "ar_lines", "error"])

        return pages.select("book", "pno", "image", "languages").mapInPandas(each, READ)

    return run


def text_layer(pages: DataFrame) -> DataFrame:
    """The engine that reads nothing: the text layer has it all."""
    from ..operators.pages import empty_envelopes

    return empty_envelopes(pages).select("book", "pno", "width", "height", "en_lines", "ar_lines", "error")


_ENGINES: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register(*names: str, run: Callable[[DataFrame], DataFrame]) -> None:
    for n in names:
        _ENGINES[n.lower()] = run


def get_engine(name: str) -> Callable[[DataFrame], DataFrame]:
    """An engine by one of its names, in letters of any size; KeyError with the known names for another."""
    try:
        return _ENGINES[name.lower()]
    except KeyError:
        raise KeyError(f"no engine {name!r}; there are {', '.join(sorted(_ENGINES))}") from None


register("text", "pdf", "pymupdf", run=text_layer)


class PageSource(DataSource):
    """spark.read.format('pages').option('decoder', 'module:name').load(path): the spans of documents. The decoder gives the rows of SPANS of a page (path, number), and
    its attribute `pages` a document's number of pages. A partition is a range of pages, so that a large document spreads."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SPANS

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(self.options)


class _Range(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class _PageReader(DataSourceReader):
    def __init__(self, options):
        self.decoder, self.paths = options["decoder"], options["path"].split(",")
        self.step = int(options.get("pagesPerPartition", "64"))

    def _decoder(self):
        import importlib

        module, _, name = self.decoder.partition(":")
        return getattr(importlib.import_module(module), name)

    def partitions(self):
        pages = self._decoder().pages
        return [_Range(p, a, min(n, a + self.step - 1)) for p in self.paths for n in [pages(p)] for a in range(1, n + 1, self.step)]

    def read(self, part: _Range):
        decode = self._decoder()
        for pno in range(part.first, part.last + 1):
            yield from decode(part.path, pno)


def register_page_source(spark: SparkSession) -> None:
    spark.dataSource.register(PageSource)


def split_by_direction(codes: Column) -> Column:
    """STRUCT<ltr, rtl> of an array of recogniser codes."""
    known = F.array(*map(F.lit, RTL_CODES))
    return F.struct(F.filter(codes, lambda x: ~F.array_contains(known, x)).alias("ltr"), F.filter(codes, lambda x: F.array_contains(known, x)).alias("rtl"))
