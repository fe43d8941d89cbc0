"""Column expressions over text: character counts, scripts, normalisation, headings."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

RTL = r"[\x{600}-\x{6ff}\x{fb50}-\x{fdff}\x{fe70}-\x{feff}]"
RTL_WORD = r"[\x{600}-\x{6ff}]"
MARKS = r"[\x{64b}-\x{65f}\x{670}\x{6d6}-\x{6ed}]"
CLUTTER = r"[A-Za-z0-9\[\](){}<>,.:;'\"!?/\\|=+*-]"
HINTS = r"[\^\\{}<>|~`]"
STYLE = r"[\x02-\x07]"
CONTROL = r"[\x02-\x07\x10-\x13]"
NOTE = "\u2020"
SOFT_HYPHEN = "­"
NBSP = " "

SCRIPTS = (
    ("ur", r"[\x{679}\x{688}\x{6d2}\x{691}\x{6ba}]"),
    ("fa", r"[\x{67e}\x{686}\x{698}\x{6af}\x{6a9}\x{6cc}]"),
    ("ar", RTL),
    ("he", r"[\x{590}-\x{5ff}\x{fb1d}-\x{fb4f}]"),
    ("el", r"[\x{370}-\x{3ff}\x{1f00}-\x{1fff}]"),
    ("hi", r"[\x{900}-\x{97f}]"),
    ("zh", r"[\x{4e00}-\x{9fff}]"),
    ("ru", r"[\x{400}-\x{4ff}]"),
)


def count(text: Column, pattern: str) -> Column:
    """Matches of pattern in text."""
    return F.regexp_count(text, F.lit(pattern))


def rtl_chars(text: Column) -> Column:
    return count(text, RTL)


def latin_chars(text: Column) -> Column:
    return count(text, "[A-Za-z]")


def digit_chars(text: Column) -> Column:
    return count(text, "[0-9]")


def mark_chars(text: Column) -> Column:
    """Vowel marks of the Arabic script."""
    return count(text, MARKS)


def clutter_chars(text: Column) -> Column:
    """ASCII letters, digits, brackets, quotes and other scaffolding that script text hardly holds."""
    return count(text, CLUTTER)


def rtl_dominant(text: Column) -> Column:
    """Two right-to-left characters at least, and 0.8 for each ASCII letter."""
    return (rtl_chars(text) >= 2) & (rtl_chars(text) >= latin_chars(text) * 0.8)


def detect_script(text: Column) -> Column:
    """Language tag of the first script in the order of SCRIPTS that text has a character of, or null."""
    out = F.lit(None).cast("string")
    for tag, pattern in reversed(SCRIPTS):
        out = F.when(text.rlike(pattern), tag).otherwise(out)
    return out


def render_script(text: Column) -> Column:
    """fa or ur where detected, else ar."""
    return F.coalesce(F.when(detect_script(text).isin("fa", "ur"), detect_script(text)), F.lit("ar"))


def primary(lang: Column) -> Column:
    return F.lower(F.split_part(lang, F.lit("-"), F.lit(1)))


def is_rtl(lang: Column) -> Column:
    return F.coalesce(primary(lang).isin("ar", "fa", "he", "ur", "yi", "ps", "sd"), F.lit(False))


def css_class(lang: Column) -> Column:
    p = primary(lang)
    out = F.lit(None).cast("string")
    for tag, name in (("ar", "arabic"), ("fa", "persian"), ("ur", "urdu"), ("he", "hebrew"), ("el", "greek")):
        out = F.when(p == tag, name).otherwise(out)
    return out


def squeeze(text: Column) -> Column:
    """NBSP becomes a space, runs of white space one space, ends are trimmed."""
    return F.trim(F.regexp_replace(F.replace(text, F.lit(NBSP), F.lit(" ")), r"\s+", " "))


def strip_ends(text: Column, left: bool = True) -> Column:
    """White space of any kind goes at the end, and at the start too unless told otherwise."""
    return F.regexp_replace(text, r"^\s+|\s+$" if left else r"\s+$", "")


def fold_apostrophes(text: Column) -> Column:
    return F.translate(text, "\u2018\u2019", "''")


def normalize_heading(text: Column) -> Column:
    """Style markers go, quotes become straight, and two frequent misreadings of "the" are mended."""
    t = fold_apostrophes(F.regexp_replace(text, STYLE, ""))
    t = F.regexp_replace(F.regexp_replace(t, r"\bHie\b", "The"), r"\bhi\b", "the")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def join_hyphenation(text: Column) -> Column:
    """A hyphen and space after a small letter go, and soft hyphens."""
    return F.replace(F.regexp_replace(text, r"(\p{Ll})-\s+", "$1"), F.lit(SOFT_HYPHEN), F.lit(""))


def join_lines(lines: Column) -> Column:
    """One text from an array of lines: a soft hyphen, or a hyphen before a small letter, joins the word that it breaks."""

    def step(done: Column, line: Column) -> Column:
        line = F.replace(line, F.lit(NBSP), F.lit(" "))
        soft = done.endswith(SOFT_HYPHEN) | (done.endswith("-") & line.rlike(r"^\p{Ll}"))
        glued = F.concat(F.substring(done, F.lit(1), F.length(done) - 1), F.ltrim(line))
        return F.when(done == "", line).when(soft, glued).otherwise(F.concat(F.rtrim(done), F.lit(" "), F.ltrim(line)))

    return squeeze(F.aggregate(lines, F.lit(""), step))


def slug(text: Column) -> Column:
    s = F.lower(F.trim(F.regexp_replace(F.regexp_replace(text, STYLE, ""), "[^A-Za-z0-9]+", "-"), F.lit("-")))
    return F.when(s == "", "section").otherwise(s)


def conf_percent(conf: Column, zero_too: bool = False) -> Column:
    """A confidence of up to 1 counts as a fraction; 0 itself only with zero_too. Null and unreadable values are -1."""
    v = conf.try_cast("double")
    low = (v >= 0) if zero_too else (v > 0)
    return F.coalesce(F.when(low & (v <= 1), v * 100).otherwise(v), F.lit(-1.0))


def strip_control(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, CONTROL, ""), r"\s+", " "))


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def format_tags(text: Column) -> Column:
    """Style markers become tags; an opener without its closer goes. Inline script runs get language and direction."""
    plain = text
    for a, b, open_, close in (("\x02", "\x03", "<em>", "</em>"), ("\x04", "\x05", "<strong>", "</strong>"), ("\x06", "\x07", "<strong><em>", "</em></strong>")):
        text = F.regexp_replace(text, f"{a}([^{b}]*){b}", f"{open_}$1{close}")
        text = F.regexp_replace(text, f"{a}([^{b}]*)$", "$1")
    rtl = '<span lang="%s" xml:lang="%s" dir="rtl" class="%s-inline">$1</span>'
    inner = "([^\x11]*)"
    fa, ur = (p for tag, p in (SCRIPTS[1], SCRIPTS[0]))
    text = F.regexp_replace(text, f"\x10((?:[^\x11](?!{ur}))*?{ur}[^\x11]*)\x11", rtl % ("ur", "ur", "arabic"))
    text = F.regexp_replace(text, f"\x10([^\x11]*?{fa}[^\x11]*)\x11", rtl % ("fa", "fa", "persian"))
    text = F.regexp_replace(text, f"\x10{inner}\x11", rtl % ("ar", "ar", "arabic"))
    return F.when(plain.rlike("[\x02\x04\x06\x10]"), F.regexp_replace(text, f"\x10{inner}$", "$1")).otherwise(plain)  # every pattern begins with an opener


def ornate_brackets(text: Column, quran: Column) -> Column:
    """Verse brackets that were read as ASCII ones, restored in verses that have none yet; other text stays."""
    t = F.regexp_replace(text, r"^\s*\(\.\s*\.\.\s*", "\ufd3f... ")
    t = F.regexp_replace(t, r"^\s*\(\.\s*", "\ufd3f")
    t = F.regexp_replace(F.regexp_replace(t, r"^\s*\(\s*\.\.\.", "\ufd3f..."), r"^\s*\(", "\ufd3f")
    t = F.translate(F.regexp_replace(t, r"[)}]\s*$", "\ufd3e"), "}{", "\ufd3e\ufd3f")
    return F.when(quran & ~text.rlike("[\ufd3e\ufd3f]"), t).otherwise(text)


def strip_diacritics(text: Column) -> Column:
    """Arabic marks go and letter variants fold, for comparison."""
    bare = F.regexp_replace(text, r"[\x{610}-\x{61a}\x{64b}-\x{65f}\x{670}\x{6d6}-\x{6ed}]", "")
    return F.translate(bare, "ٱآأإىة", "اااايه")


def _letter_table() -> tuple[dict[str, str], dict[str, str]]:
    """Of each letter that compatibility decomposition makes ASCII letters of: what it is in small letters; one letter, and several."""
    one, several = {"ı": "i"}, {}
    for code in range(0x80, 0x1F000):
        c = chr(code)
        if unicodedata.category(c)[0] in "LN":
            bare = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()
            bare = "".join(x for x in bare if x in "abcdefghijklmnopqrstuvwxyz'")
            if bare:
                (one if len(bare) == 1 else several)[c] = bare
    return one, several


_ONE, _SEVERAL = _letter_table()


def normalize_translit(text: Column) -> Column:
    """A transliteration in plain small letters and apostrophes: letters by their compatibility decomposition, without combining marks; signs that decompose to
    none, and modifier letters, go."""
    table = F.create_map(*[F.lit(x) for pair in _SEVERAL.items() for x in pair])
    long = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    some = text.rlike("[" + "".join(_SEVERAL) + "]")
    plain = F.translate(F.when(some, long).otherwise(text), "".join(_ONE), "".join(_ONE.values()))
    t = F.lower(F.when(text.rlike("[^\\x00-\\x7f]"), plain).otherwise(text))  # the tables have no ASCII, and their class is slow to try on each letter
    return F.regexp_replace(t, "[^a-z']", "")


def trim_page(text: Column) -> Column:
    """Page text: special spaces become spaces, runs one, line starts bare, three line ends two."""
    t = F.regexp_replace(text, r"[\x{a0}\x{2007}\x{202f}]+", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n[ \t]+", "\n")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def note_refs(html: Column) -> Column:
    """Note references as [^N]."""
    t = F.regexp_replace(html, r'(?s)<a\b[^>]*epub:type="noteref"[^>]*>\s*<sup>\s*(\d+)\s*</sup>\s*</a>', "[^$1]")
    return F.regexp_replace(t, r"<sup\b[^>]*>\s*(\d+)\s*</sup>", "[^$1]")


ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#x27;": "'", "&nbsp;": NBSP}
HTML_PART = re.compile("(<[^>]*>?|>)|(" + "|".join(map(re.escape, ENTITIES)) + ")|&#(x?)([0-9a-fA-F]+);")


def _numeric(x: str, digits: str) -> str:
    """The character of a numeric entity; ? for a number that is none, or that no text can hold."""
    if not x and not digits.isdecimal():
        return "?"
    digits = digits.lstrip("0") or "0"
    code = int(digits, 16 if x else 10) if len(digits) <= 7 else 0x110000
    return chr(code) if code < 0xD800 or 0xDFFF < code < 0x110000 else "?"


def decoded(m: re.Match[str]) -> str:
    """The character of an entity that HTML_PART found."""
    return ENTITIES[m[2]] if m[2] else _numeric(m[3], m[4])


def plain_of_html(html: str) -> tuple[str, list[int]]:
    """Text of HTML, and for each of its characters the place in the HTML (from 0) where what made it begins."""
    out: list[str] = []
    places: list[int] = []
    at = 0
    for m in HTML_PART.finditer(html):
        out.append(html[at : m.start()])
        places.extend(range(at, m.start()))
        if not m[1]:
            out.append(decoded(m))
            places.append(m.start())
        at = m.end()
    out.append(html[at:])
    places.extend(range(at, len(html)))
    return "".join(out), places


def _html_texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for b in batches:
        yield pa.array([None if (h := x.as_py()) is None else HTML_PART.sub(lambda m: "" if m[1] else decoded(m), h) for x in b], pa.string())


def _html_plains(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.struct([("text", pa.string()), ("places", pa.list_(pa.int32()))])
    for b in batches:
        yield pa.array([None if h is None else dict(zip(("text", "places"), plain_of_html(h), strict=True)) for h in b.to_pylist()], kind)


for _f in (_html_texts, _html_plains):
    _f.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}


def html_text(html: Column) -> Column:
    """Text of HTML: tags and stray > go, the usual entities and numeric ones are decoded, once."""
    return F.arrow_udf(_html_texts, "string")(html)


def html_plain(html: Column) -> Column:
    """STRUCT<text, places>: html_text, and of each character the place in the HTML (from 0) where what made it begins."""
    return F.arrow_udf(_html_plains, "struct<text:string,places:array<int>>")(html)


def on_text_only(html: Column, f: Callable[[Column], Column]) -> Column:
    """HTML with f applied to each piece of text between tags; tags and what is in them stay."""
    pieces = F.regexp_extract_all(html, F.lit("<[^>]*>?|[^<]+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda s: F.when(s.startswith("<"), s).otherwise(f(s))), "")


def language_codes(langs: Column) -> Column:
    """Recogniser codes of an array of language tags: whole tag, then its primary part, else as it is; first occurrences; default eng."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGE_CODES.items() for x in pair])
    codes = F.array_distinct(F.transform(langs, lambda x: F.coalesce(F.try_element_at(table, F.lower(x)), F.try_element_at(table, primary(x)), x)))
    return F.when(F.coalesce(F.size(codes), F.lit(0)) <= 0, F.array(F.lit("eng"))).otherwise(codes)


LANGUAGE_CODES = dict(
    pair.split(":")
    for pair in (
        "en:eng en-us:eng en-gb:eng ar:ara ar-sa:ara ar-eg:ara fa:fas fa-ir:fas ur:urd ur-pk:urd he:heb he-il:heb el:ell el-gr:ell ru:rus "
        "ru-ru:rus uk:ukr tr:tur fr:fra fr-fr:fra de:deu de-de:deu it:ita es:spa es-es:spa es-mx:spa pt:por pt-br:por pt-pt:por pl:pol nl:nld "
        "ja:jpn ko:kor zh-cn:chi_sim zh-hans:chi_sim zh:chi_sim zh-tw:chi_tra zh-hant:chi_tra hi:hin bn:ben ta:tam th:tha vi:vie id:ind ms:msa"
    ).split()
)
RTL_CODES = ("ara", "fas", "urd", "heb", "yid", "pus", "snd")
