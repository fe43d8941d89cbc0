"""Books as EPUB packages: page list, navigation, manifest and spine, and the archive."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import book as B

C = F.col
MIME = "application/epub+zip"
CONTAINER = '<?xml version="1.0" encoding="utf-8"?>\n<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml" /></rootfiles></container>\n'
CSS = "body { line-height: 1.5; }\n.arabic, .persian, .urdu { direction: rtl; }\n.footnotes { font-size: 0.9em; }\n"
RTL = ("ar", "fa", "he", "ur")


def page_list(rendered: DataFrame) -> DataFrame:
    """(book, printed, href, label): the printed pages that chapters (book, chapter, slug, xhtml) have anchors of, each once, at its first anchor."""
    anchor = r'<span epub:type="pagebreak"[^>]*id="page-([0-9]+)"[^>]*aria-label="([0-9]+)"'
    d = rendered.select("book", "chapter", "slug", F.posexplode(F.regexp_extract_all("xhtml", F.lit(anchor), F.lit(0))).alias("i", "m"))
    d = d.withColumns({"id": F.regexp_extract("m", anchor, 1), "label": F.regexp_extract("m", anchor, 2)}).withColumn("printed", C("label").cast("long"))
    d = d.groupBy("book", "printed").agg(F.min(F.struct("chapter", "i", "slug", "id", "label")).alias("f"))
    return d.select("book", "printed", F.concat(F.lit("text/"), "f.slug", F.lit(".xhtml#page-"), "f.id").alias("href"), C("f.label").alias("label"))


def printed_pages(assembled: DataFrame) -> DataFrame:
    """page_list of what operators.book.render makes of assembled elements, without rendering: its anchors are the page breaks."""
    d = B.page_breaks(assembled, "slug", "printed").where("printed is not null")
    d = d.where(C("anchor").rlike("^page-[0-9]+$")).groupBy("book", "printed").agg(F.min(F.struct("chapter", "pno", "seq", "slug", "anchor")).alias("f"))
    return d.select("book", C("printed").cast("long").alias("printed"), F.concat(F.lit("text/"), "f.slug", F.lit(".xhtml#"), "f.anchor").alias("href"), F.substring_index("f.anchor", "-", -1).alias("label"))


def _list(order: str, s: Column) -> Column:
    """s of all rows, a line each, in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, s.alias("s")))), lambda x: x.s), "\n")


def navigation(rendered: DataFrame, books: DataFrame) -> DataFrame:
    """(book, nav): contents, landmarks and page list."""
    item = F.concat(F.lit('<li><a href="text/'), "slug", F.lit('.xhtml">'), T.escape_html(C("title")), F.lit("</a></li>"))
    toc = rendered.groupBy("book").agg(_list("chapter", item).alias("toc"), F.min_by("slug", "chapter").alias("first"))
    pages = page_list(rendered).groupBy("book").agg(_list("printed", F.concat(F.lit('<li><a href="'), "href", F.lit('">'), "label", F.lit("</a></li>"))).alias("pages"))
    d = books.join(toc, "book", "left").join(pages, "book", "left")
    begin = F.coalesce(F.concat(F.lit("text/"), "first", F.lit(".xhtml")), F.lit("text/cover.xhtml"))
    nav = F.concat(
        F.lit('<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>Navigation</title></head><body>\n<nav epub:type="toc" id="toc"><h1>Table of Contents</h1><ol>\n'),
        F.coalesce("toc", F.lit("")), F.lit('\n</ol></nav>\n<nav epub:type="landmarks" hidden=""><ol><li><a epub:type="cover" href="text/cover.xhtml">Cover</a></li><li><a epub:type="titlepage" href="text/titlepage.xhtml">Title Page</a></li><li><a epub:type="bodymatter" href="'),
        begin, F.lit('">Begin Reading</a></li></ol></nav>\n<nav epub:type="page-list" id="page-list"><ol>\n'), F.coalesce("pages", F.lit("")), F.lit("\n</ol></nav>\n</body></html>\n"),
    )
    return d.select("book", nav.alias("nav"))


FIXED = (("cover-image", "images/cover.jpg", "image/jpeg"), ("cover-html", "text/cover.xhtml", "application/xhtml+xml"), ("titlepage", "text/titlepage.xhtml", "application/xhtml+xml"), ("nav", "nav.xhtml", "application/xhtml+xml"), ("css", "styles/book.css", "text/css"))


def manifest(rendered: DataFrame, books: DataFrame) -> DataFrame:
    """(book, ord, id, href, media_type, spine): what a package holds; spine numbers those that are read in order, from 0."""
    fixed = F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(a).alias("id"), F.lit(b).alias("href"), F.lit(m).alias("media_type")) for i, (a, b, m) in enumerate(FIXED)])).alias("x")
    a = books.select("book", fixed).select("book", "x.*")
    b = rendered.select("book", (F.row_number().over(W.partitionBy("book").orderBy("chapter")) + len(FIXED) - 1).alias("ord"), C("slug").alias("id"), F.concat(F.lit("text/"), "slug", F.lit(".xhtml")).alias("href"), F.lit("application/xhtml+xml").alias("media_type"))
    spine = F.when(C("id") == "cover-html", 0).when(C("id") == "titlepage", 1).when(C("ord") >= len(FIXED), C("ord") - len(FIXED) + 2)
    return a.unionByName(b).withColumn("spine", spine)


def package(rendered: DataFrame, books: DataFrame) -> DataFrame:
    """(book, opf): the package document. books: book, title, author, language, modified."""
    m = manifest(rendered, books)
    prop = F.when(C("id") == "nav", ' properties="nav"').when(C("id") == "cover-image", ' properties="cover-image"').otherwise("")
    item = F.concat(F.lit('<item id="'), "id", F.lit('" href="'), "href", F.lit('" media-type="'), "media_type", F.lit('"'), prop, F.lit(" />"))
    ref = F.concat(F.lit('<itemref idref="'), "id", F.lit('" />'))
    spine = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(C("spine").isNotNull(), F.struct("spine", ref.alias("s"))))), lambda x: x.s), "\n")
    g = m.groupBy("book").agg(_list("ord", item).alias("items"), spine.alias("refs"))
    d = books.join(g, "book").withColumn("uid", book_uuid(C("book"), C("title"), C("author")))
    side = F.when(F.lower(F.substring_index("language", "-", 1)).isin(*RTL), "rtl").otherwise("ltr")
    opf = F.concat(
        F.lit('<?xml version="1.0" encoding="utf-8"?>\n<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="bookid" xml:lang="'), "language", F.lit('">\n<metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="bookid">urn:uuid:'), "uid",
        F.lit("</dc:identifier><dc:title>"), T.escape_html(C("title")), F.lit("</dc:title><dc:creator>"), T.escape_html(C("author")), F.lit("</dc:creator><dc:language>"), "language", F.lit('</dc:language><meta property="dcterms:modified">'), "modified",
        F.lit("</meta></metadata>\n<manifest>\n"), "items", F.lit('\n</manifest>\n<spine page-progression-direction="'), side, F.lit('">\n'), "refs", F.lit("\n</spine>\n</package>\n"),
    )
    return d.select("book", opf.alias("opf"))


NAMESPACE = uuid.NAMESPACE_URL


def book_uuid(*parts: Column) -> Column:
    """Version-5 UUID of the parts joined by bars: the same book has the same identifier in each build."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE.hex)), F.encode(F.concat_ws("|", *[p.cast("string") for p in parts]), "UTF-8")))
    variant = F.substring(F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8))), -1, 1)
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def archive(files: list[tuple[str, bytes]]) -> bytes:
    """A ZIP of files in order, the first one stored and the others deflated, with fixed dates: equal input gives equal bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i, (name, data) in enumerate(files):
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_DEFLATED if i else zipfile.ZIP_STORED
            z.writestr(info, data)
    return out.getvalue()


def _page(kind: str, title: str, body: str) -> bytes:
    return f'<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>{escape(title)}</title></head><body epub:type="{kind}">{body}</body></html>\n'.encode()


def archives(rendered: DataFrame, books: DataFrame, cover: bytes = b"") -> DataFrame:
    """(book, epub BINARY): an archive for each book. Chapters meet per book, in order; a book is what one archive holds, so it has to fit one task."""
    chapters = F.transform(F.array_sort(F.collect_list(F.struct("chapter", "slug", "xhtml"))), lambda x: F.struct(x.slug.alias("slug"), x.xhtml.alias("xhtml")))
    d = rendered.groupBy("book").agg(chapters.alias("chapters"))
    d = books.join(d, "book").join(navigation(rendered, books), "book").join(package(rendered, books), "book")
    d = d.select("book", "title", "author", "chapters", "nav", "opf")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                files = [("mimetype", MIME.encode()), ("META-INF/container.xml", CONTAINER.encode()), ("OEBPS/styles/book.css", CSS.encode())]
                files += [("OEBPS/text/cover.xhtml", _page("cover", "Cover", '<img src="../images/cover.jpg" alt="" />')), ("OEBPS/text/titlepage.xhtml", _page("titlepage", r.title, f"<h1>{escape(r.title)}</h1><p>{escape(r.author)}</p>")), ("OEBPS/images/cover.jpg", cover)]
                files += [(f"OEBPS/text/{c['slug']}.xhtml", c["xhtml"].encode()) for c in r.chapters]
                out.append(archive([*files, ("OEBPS/nav.xhtml", r.nav.encode()), ("OEBPS/content.opf", r.opf.encode())]))
            yield pd.DataFrame({"book": b["book"], "epub": out})

    return d.mapInPandas(pack, f"book {dict(books.dtypes)['book']}, epub binary")


def members(archives_: DataFrame, key: str = "book", column: str = "epub", suffix: str = ".xhtml") -> DataFrame:
    """(key, name, text): the members of ZIP archives whose name has the suffix ('' for all), as text; what is no archive has none."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, data in zip(b[key], b[column], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        rows += [(k, n, z.read(n).decode("utf-8", "replace")) for n in z.namelist() if n.endswith(suffix)]
                except (zipfile.BadZipFile, TypeError):
                    continue
            yield pd.DataFrame(rows, columns=[key, "name", "text"])

    return archives_.select(key, column).mapInPandas(read, f"{key} {dict(archives_.dtypes)[key]}, name string, text string")


def read_package(opf: DataFrame) -> tuple[DataFrame, DataFrame]:
    """opf (book, text): manifest (book, id, href) and spine (book, idref) of package documents."""
    m = opf.select("book", F.explode(F.regexp_extract_all("text", F.lit('<item id="[^"]+" href="[^"]+"'), F.lit(0))).alias("m"))
    m = m.select("book", F.regexp_extract("m", 'id="([^"]+)"', 1).alias("id"), F.regexp_extract("m", 'href="([^"]+)"', 1).alias("href"))
    return m, opf.select("book", F.explode(F.regexp_extract_all("text", F.lit('<itemref idref="([^"]+)"'), F.lit(1))).alias("idref"))
