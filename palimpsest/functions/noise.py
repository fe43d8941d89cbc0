"""Predicates that tell recognition noise from text, word by word, line by line and block by block."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import HINTS, RTL, RTL_WORD, clutter_chars, count, detect_script, digit_chars, latin_chars, mark_chars, normalize_heading, rtl_chars

TOKEN = r"[A-Za-z][A-Za-z\-']{2,}"


def geometric_artifact(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A box too narrow for its height to be a line: taller than wide and under 40, or half as wide as high and under 60."""
    w = x1.try_cast("double") - x0.try_cast("double")
    h = y1.try_cast("double") - y0.try_cast("double")
    return F.coalesce((w > 0) & (h > 0) & (((h > w) & (w < 40)) | ((w < h * 0.5) & (w < 60))), F.lit(False))


def span_is_mojibake(text: Column, font: Column) -> Column:
    """A span of an Arial face that holds glyph numbers instead of text; italics and short marks are spared."""
    t = F.trim(text)
    arial = font.startswith("Arial") & ~font.startswith("Arial Unicode")
    mixed = t.rlike(r"[0-9].*[A-Za-z]|[A-Za-z].*[0-9]")
    short = t.rlike(r"^[0-9*\x{2022}()\[\].,:;!?\x{2013}\x{2014}-]+$") | t.rlike(r"^[A-Za-z]$") | t.rlike(r"^[0-9A-Za-z][.,)\]]?$")
    return (
        F.when((t == "") | t.rlike(RTL), False)
        .when(t.rlike(HINTS), True)
        .when(~arial, False)
        .when(font == "Arial-ItalicMT", mixed)
        .when(F.length(t) <= 2, ~short)
        .otherwise(True)
    )


def word_is_mojibake(word: Column) -> Column:
    """A token whose letters cannot be a word: hint characters, digits within letters, no vowel, four consonants, odd capitals.

    Most words are small ASCII letters after at most one capital, and need two tests only; capitals are counted only where one follows."""
    length, low = F.length(word), F.lower(word)
    bare = ~word.rlike("[aeiouyAEIOUY]")
    clustered = low.rlike("[bcdfghjklmnpqrstvwxz]{4}")
    sandwich = word.rlike("[A-Za-z][0-9]+[A-Za-z]")
    upper, lower = count(word, r"\p{Lu}"), count(word, r"\p{Ll}")
    inner = count(F.substring(word, 2, 1 << 30), r"\p{Lu}")
    caps = (lower >= 1) & (upper * 2 <= length) & (((lower >= 2) & (length <= 7)) | (inner >= 2))
    return (
        F.when(length < 3, False)
        .when(word.rlike("^[A-Z]?[a-z]+$"), ((length >= 4) & bare) | clustered)
        .when(word.rlike(HINTS) | sandwich, True)
        .when(~word.rlike(r"\p{L}"), False)
        .when(bare & word.rlike(r"(?:\p{L}\P{L}*){4}"), True)
        .when(clustered, True)
        .otherwise(word.rlike(r".\p{Lu}") & caps)
    )


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def string_is_mojibake(text: Column) -> Column:
    """A line that holds a hint character, or of whose words half (one at least) are mojibake; never one with right-to-left script."""
    t = F.trim(text)
    bad = F.size(F.filter(words(t), word_is_mojibake))
    half = F.greatest(F.lit(1), F.floor(F.size(words(t)) / 2))
    return F.when((t == "") | t.rlike(RTL), False).when(t.rlike(HINTS), True).when(~t.rlike(r"\p{L}"), False).otherwise(bad >= half)


def real_words(text: Column) -> Column:
    """How many tokens have a vowel and are not mojibake."""
    return F.size(F.filter(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda w: w.rlike("[aeiouyAEIOUY]") & ~word_is_mojibake(w)))


def looks_real(text: Column) -> Column:
    t = normalize_heading(text)
    return (F.length(t) >= 3) & (real_words(t) >= 1)


def keep_line(text: Column, in_zone: Column) -> Column:
    """Whether a line stays: two real words, or outside script zones, not mojibake, and with letters enough."""
    t = F.trim(text)
    letters = count(t, r"\p{L}")
    bare = ((letters < 2) & ~t.rlike("[0-9]")) | ((letters < 4) & (letters < F.length(t) * 0.4))
    return (real_words(t) >= 2) | (~in_zone & ~string_is_mojibake(t) & ~bare)


def audit_word(word: Column) -> Column:
    """A word that counts as real in an audit: letters only, not all consonants from four on, no odd inner capital when short."""
    upper, inner = count(word, r"\p{Lu}"), count(F.substring(word, 2, 1 << 30), r"\p{Lu}")
    vowels = count(word, "[aeiouyAEIOUY]")
    return word.rlike(r"^\p{L}+$") & ~((count(word, r"\p{L}") - vowels >= 4) & (vowels == 0)) & ~((inner >= 1) & (upper <= F.floor(F.length(word) / 2)) & (F.length(word) <= 7))


SAFE_SHORT = "a an and are as at be but by can did do for from had has have he her him his i if in is it its me my no nor not of off on one or our out own she so than that the their them then they this to too two up us was we were what when who will with you your".split()


def plausible_english(token: Column) -> Column:
    """A short common word, a capitalised name, or a small-letter word of four letters with a vowel; nothing but punctuation too."""
    bare = F.regexp_replace(token, r"[!?,.;:]+$", "")
    return (
        (bare == "")
        | F.lower(bare).isin(SAFE_SHORT)
        | bare.rlike("^[A-Z][a-z]{2,}$")
        | (bare.rlike("^[a-z]+('[a-z]+)?$") & (F.length(F.replace(bare, F.lit("'"), F.lit(""))) >= 4) & bare.rlike("[aeiouy]"))
    )


HEADER = r"^\s*(?:([0-9]{1,3})\s+)?((?:THE\s+)?[A-Z][A-Z'\x{2019} -]{2,}?)(?:\s+([0-9]{1,3}))?\s*$"


def running_header(text: Column, y: Column) -> Column:
    """STRUCT<title, printed> of a running header in the text layer, or null: capitals with a page number on either side, within 60 points."""
    t = F.trim(text)
    ok = (y <= 60) & t.rlike(HEADER)
    a, b = F.regexp_extract(t, HEADER, 1), F.regexp_extract(t, HEADER, 3)
    number = F.when(a != "", a).when(b != "", b).cast("int")
    return F.when(ok, F.struct(F.trim(F.regexp_extract(t, HEADER, 2)).alias("title"), number.alias("printed")))


def recognised_header(text: Column, y: Column) -> Column:
    """A running header or stray of the page top in recognised lines: blank, above 60, or above 100 as capitals with a number."""
    t = F.trim(text)
    titled = t.rlike(r"^[^0-9]+\s+[0-9]{1,3}$|^[0-9]{1,3}\s+[^0-9]+$") & (latin_chars(t) >= 4) & (F.upper(t) == t)
    return ((y < 100) & ((t == "") | titled)) | (y < 60)


def centered(x0: Column, x1: Column, left: Column, right: Column, tolerance: float = 18.0) -> Column:
    width = F.greatest(right - left, F.lit(1.0))
    return (x1 - x0 <= width * 0.78) & (F.abs((x0 + x1) / 2 - (left + right) / 2) < tolerance)


def block_kept(text: Column, conf: Column, strict: bool = False) -> Column:
    """The cascade for right-to-left blocks. conf: percent; null counts as 100.

    Dropped are blocks with under 5 script characters, many Latin letters, (strict) many digits, low confidence without a run of four, only
    tiny lines, or no longer run at middling confidence.
    """
    ar, conf = rtl_chars(text), F.coalesce(F.when((conf > 0) & (conf <= 1), conf * 100).otherwise(conf), F.lit(100.0))
    lines = F.filter(F.transform(F.split(text, "\n"), F.trim), lambda s: s != "")
    run4 = text.rlike(RTL_WORD + "{4,}")
    tiny = (F.size(lines) > 0) & F.forall(lines, lambda s: F.length(s) <= 3)
    drop = (ar < 5) | (latin_chars(text) > ar * 0.6) | ((conf < 50) & ~run4) | tiny | ((conf < 70) & ~run4) | (~run4 & (conf < 80))
    if strict:
        digits = digit_chars(text)
        drop = drop | (digits >= ar * 0.2) | ((ar < 30) & (digits >= 1) & (conf < 60))
    return ~drop


def line_hallucinated(text: Column, conf: Column, coverage: Column) -> Column:
    """A line of script read into Latin text: it lies over embedded words and its confidence, marks and clutter say so. Null conf counts as 0."""
    c = F.coalesce(F.when((conf > 0) & (conf <= 1), conf * 100).otherwise(conf), F.lit(0.0))
    ar, marks, clutter = rtl_chars(text), mark_chars(text), clutter_chars(text)
    signs = ((c < 35) & (marks < ar * 0.05)) | ((c < 50) & (marks == 0)) | ((c < 50) & (clutter >= ar * 0.2)) | ((c < 60) & (marks < ar * 0.03) & (clutter >= ar * 0.1))
    return F.coalesce((ar > 0) & (coverage >= 0.5) & signs, F.lit(False))


def block_hallucinated(text: Column, conf: Column, coverage: Column) -> Column:
    """The safety net behind line_hallucinated, for blocks."""
    c = F.coalesce(F.when((conf > 0) & (conf <= 1), conf * 100).otherwise(conf), F.lit(0.0))
    ar = rtl_chars(text)
    return F.coalesce((c < 45) & (ar > 0) & (mark_chars(text) < ar * 0.03) & (coverage >= 0.5), F.lit(False))


def citation_dense(size: Column, digits: Column) -> Column:
    """A page of citations by its Latin lines: 1000 characters of them, of which 3 % are digits."""
    return F.coalesce((size >= 1000) & (digits >= size * 0.03), F.lit(False))


def anchors_script(text: Column, conf: Column) -> Column:
    """A block that proves real script on its page: 100 script characters at a confidence of 65. Null conf counts as 0."""
    c = F.coalesce(F.when((conf > 0) & (conf <= 1), conf * 100).otherwise(conf), F.lit(0.0))
    return F.coalesce((rtl_chars(text) >= 100) & (c >= 65), F.lit(False))


def tagged_script(text: Column, kind: Column, own: dict[str, str] | None = None) -> Column:
    """Language of an element by the user's glyph classes, then by script; blocks of script default to ar; other kinds have none."""
    tag = detect_script(text)
    for name, glyphs in reversed((own or {}).items()):
        tag = F.when(text.rlike(glyphs), name).otherwise(tag)
    return F.when(kind == "arabic", F.coalesce(tag, F.lit("ar"))).when(kind.isin("footnote", "paragraph", "heading"), tag)
